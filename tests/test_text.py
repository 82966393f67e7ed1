import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.functions.numbers import measure_text
from tallyspark.operators import findings as D
from tallyspark.operators import joins


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("o")).first()["o"]


@pytest.mark.parametrize("value,want", [
    ("```sql\nSELECT 1\n```", "SELECT 1"), ("x ```a``` y ```json\nlonger\n``` z", "longer"), ("  plain ", "plain"), (None, ""), ("```a```b```c```", "a")])
def test_fence_body(spark, value, want):
    assert one(spark, X.fence_body, value) == want


@pytest.mark.parametrize("value,want", [
    ("", "empty output"), ("I'm sorry, no", "refusal detected"), ("As an AI model", "refusal detected"), ("aaaaaaa", "gibberish output"),
    ("ab", "gibberish output"), ("Sales rose in May", None)])
def test_text_verdict(spark, value, want):
    assert one(spark, X.text_verdict, value) == want


@pytest.mark.parametrize("value,want", [
    ("", "empty"), ("123 456", "no letters"), ("sales", "too short"), ("a b c", "single letters"), ("show asdf sales", "noise word"),
    ("show aaaab now", "noise word"), ("bcdfg sales now", "noise word"), ("what is this", "stop words only"), ("total sales by city", None)])
def test_noise_verdict(spark, value, want):
    assert one(spark, X.noise_verdict, value) == want


def test_json_list_items_and_words(spark):
    assert one(spark, lambda c: X.json_in_text(c)["kind"], '{"a": 1}') == "whole"
    assert one(spark, lambda c: X.json_in_text(c)["json"], 'so {"a": {"b": 2}} ok') == '{"a": {"b": 2}}'
    assert one(spark, lambda c: X.json_in_text(c)["kind"], "{a: ") == "none"
    assert one(spark, X.list_items, "Plan:\n1. **Cut** cost\n2) Hire\n- Sell\n") == ["Cut cost", "Hire", "Sell"]
    assert one(spark, X.list_items, "Cut cost. Hire now!  Sell.") == ["Cut cost", "Hire now!", "Sell"]
    assert one(spark, X.list_items, "only this") == ["only this"] and one(spark, X.list_items, " ") == []
    assert one(spark, X.plain_english, "The Median and z-score") == "The middle value and deviation score"
    nums = spark.createDataFrame([(1234567.0,), (-4321.4,), (150.25,), (3.456,)], "v double").select(measure_text(F.col("v")).alias("t"))
    assert [r["t"] for r in nums.collect()] == ["1.23M", "-4,321", "150.2", "3.46"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_fuzzy_join_finds_all_that_brute_force_finds(spark):
    rng = random.Random(5)
    vocab = {"customer", "category", "revenue", "quantity", "manufacturer", "responsibilities", "or", "ord"} | {
        "ab" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 16))) for _ in range(60)}
    tokens = set()
    for word in vocab:
        for _ in range(6):
            w = list(word)
            for _ in range(rng.randint(0, 4)):
                i = rng.randrange(len(w)) if w else 0
                kind = rng.randrange(3)
                if kind == 0 and len(w) > 2:
                    w.pop(i)
                elif kind == 1:
                    w.insert(i, rng.choice("abc"))
                elif w:
                    w[i] = rng.choice("abc")
            tokens.add("".join(w))
    frame = lambda s: spark.createDataFrame([(w,) for w in sorted(s)], "word string")
    got = {r["word"]: r["match"] for r in joins.fuzzy_vocab_join(frame(tokens), frame(vocab)).collect()}
    want = {}
    for t in tokens:
        if len(t) < 2 or t in vocab or t + "s" in vocab or (t.endswith("s") and t[:-1] in vocab):
            continue
        scored = [(-(1 - distance(t, v) / max(len(t), len(v))), v) for v in vocab if v[:2] == t[:2]]
        scored = sorted(s for s in scored if -s[0] >= 0.8 - 1e-9)
        if scored:
            want[t] = scored[0][1]
    assert got == want and len(want) > 50


def test_term_grounding_takes_plurals(spark):
    df = spark.createDataFrame([(1, "Clients and buyer_id of companies"), (2, "deliveries classes"), (3, "nothing")], "k int, t string")
    got = {(r["k"], r["term"]): r["score"] for r in joins.term_grounding(df, "k", "t").collect()}
    assert got == {(1, "customer"): 2, (2, "shipper"): 1}


def test_repeated_findings_are_dropped_per_metric(spark):
    rows = [("r", 1, "a", "Sales rose strongly in the west region", "sales"), ("r", 2, "b", "Sales rose strongly in the west region today", "sales"),
            ("r", 3, "b", "Sales rose strongly in the west region", "profit"), ("r", 4, "c", "Margins fell", "profit")]
    df = spark.createDataFrame([(*r, 10.0, "high", "s", 0.9, {"x": "1"}) for r in rows], ", ".join(
        f"{c} {'int' if c == 'place' else 'double' if c in ('magnitude_pct', 'relevance') else 'map<string,string>' if c == 'evidence' else 'string'}" for c in D.COLUMNS))
    scored = D.scored(df, "why did sales rise", "sales")
    assert scored.where("place = 1").first()["score"] == round(0.2 * 30 + 0.9 * 25 + 25 + 9 + 10, 2)
    kept = D.without_repeats(scored).orderBy("rank").collect()
    assert [(r["type"], r["metric"]) for r in kept] == [("a", "sales"), ("b", "profit"), ("c", "profit")]
    assert kept[0]["evidence"] == {"x": "1"}
    classes = {r["class"] for r in D.evidence_classes(df.withColumn("type", F.lit("anomaly"))).collect()}
    assert classes == {"fact", "next_check"}
