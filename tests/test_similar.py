import random
import re
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspark import session
from tallyspark.operators import findings as D
from tallyspark.operators import rooms, similar
from tallyspark.operators.similar import beaten, distinct_texts
from tallyspark.plans.reports import q_distinct_documents


def words(text):
    return {w for w in re.split("[^a-z0-9]+", re.sub(r"\bas\b", " ", (text or "").lower())) if w}


def drawn(seed, n):
    draw, pool = random.Random(seed), [f"w{i}" for i in range(40)]
    seeds = [draw.sample(pool, draw.randint(1, 14)) for _ in range(12)]
    out = []
    for _ in range(n):
        own = list(draw.choice(seeds))
        for _ in range(draw.randint(0, 3)):
            own[draw.randrange(len(own))] = draw.choice(pool)
        out.append(" ".join(draw.sample(own, len(own))))
    return out


@pytest.mark.parametrize("same", [0.5, 0.72, 1.0])
def test_texts_that_stay_equal_the_greedy_choice(spark, same):
    texts = drawn(int(same * 100), 160) + [None, "", "as AS", "...", "w1", "W1!", "w1 w1"]
    rows = [(i, t, random.Random(i).randint(0, 9), "xy"[i % 2]) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "z", "q") for r in rows], "id int, text string, score int, kind string, row string, key string")
    want = []
    for i, t, score, kind in sorted(rows, key=lambda r: (-r[2], r[0])):
        own = words(t)
        if not any(kind == k and own and len(own & o) / len(own | o) >= same for _, o, k in want):
            want.append((i, own, kind))
    found = distinct_texts(df, "text", [-F.col("score"), F.col("id")], same, ["kind"])
    assert found.columns == df.columns and sorted(r.id for r in found.collect()) == sorted(i for i, _, _ in want)


def test_a_chain_of_links_goes_alternately(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 9)] + [(3, 2)], "worse int, better int")
    assert sorted(r[0] for r in beaten(chain).collect()) == [1, 3, 5, 7]
    assert beaten(chain.limit(0)).collect() == []


def test_reports_of_any_size_equal_the_greedy_choice(spark):
    draw, rows = random.Random(8), []
    for i, text in enumerate(drawn(9, 150) + ["a b c", "a b c d", "c b a", "", None]):
        rows.append(("rs"[i % 2], i, draw.choice(["x", "y"]), f"{text} of is it" if text else text, draw.choice(["m", None]), 1.0, "high", "s",
                     draw.randint(0, 5) / 2))
    df = spark.createDataFrame(rows, "report string, place int, type string, statement string, metric string, magnitude_pct double, confidence string, source string, score double")
    df = df.withColumn("evidence", F.create_map(F.lit("at"), F.col("place").cast("string")))
    kept = {}
    for r in sorted(rows, key=lambda r: (r[0], -r[8], r[1])):
        own, stay = words(r[3]), kept.setdefault(r[0], [])
        long = {w for w in own if len(w) > 2}
        near = lambda y: len(long & words(y[3])) / max(1, len(long | words(y[3]))) >= D.SAME
        alike = lambda y: y[2] == r[2] and {w for w in words(y[3]) if len(w) > 2} == long
        if not any(y[4] == r[4] and (near(y) or alike(y)) for y in stay):
            stay.append(r)
    found = D.without_repeats(df).collect()
    assert {(r.report, r["rank"], r.place, r.evidence["at"]) for r in found} == {
        (k, i + 1, r[1], str(r[1])) for k, own in kept.items() for i, r in enumerate(own)}
    assert {(r.report, r["rank"]) for r in D.without_repeats(df, top=2).collect()} == {(k, i) for k in "rs" for i in (1, 2)}


def test_sketches_lose_no_pair_of_large_sets(spark):
    """Sets around the size at which the sketch grows, changed by just as many words as they may be, or by one more;
    only pairs that are similar are compared in full."""
    draw, rows = random.Random(3), []
    for i, n in enumerate((1, 2, 7, 300, similar.LARGE - 150, similar.LARGE, similar.LARGE + 1, similar.LARGE + 400)):
        own = [f"t{i}w{j}" for j in range(n)]
        rows.append(own)
        for gone in (int(n * 0.28), int(n * 0.28) + 1):  # left out
            rows.append(draw.sample(own, n - gone) or ["lone"])
        for new in (int(n * 0.14 / 0.86), int(n * 0.14 / 0.86) + 40):  # exchanged
            rows.append(own[new:] + [f"new{i}w{new}w{j}" for j in range(new)])
        rows.append([f"o{i}w{j}" for j in range(n - n // 4)] + own[: n // 4])  # a quarter in common
    items = spark.createDataFrame([(i, 0, w) for i, w in enumerate(rows)], "key int, block int, a array<string>")
    sets = [set(w) for w in rows]
    want = {(x, y) for x in range(len(sets)) for y in range(x + 1, len(sets)) if len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.72}
    assert {(r.x, r.y) for r in similar.similar_pairs(items, 0.72).collect()} == want
    times = spark.createDataFrame([(w, sum(w in s for s in sets)) for w in set().union(*sets)], "word string, times bigint")
    met = [similar._met(items, "a", times, 0.72, *c).count() for c in ((16, 0, similar.LARGE), (64, similar.LARGE, similar.MOST))]
    assert sum(met) <= len(want) + 8


def test_words_of_a_room_in_parts_lose_no_pair(spark, monkeypatch):
    """Many parts of a room, several blocks, copies of a key, sizes of several bands: all pairs, each once, and no other."""
    draw, rows = random.Random(5), []
    for text in drawn(4, 120) + [" ".join(f"{s}{i}" for i in range(40 + s)) for s in (1, 2, 2, 3)] + ["only"]:
        rows.append((len(rows), draw.randint(1, 2), sorted(set(text.split()))))
    want = set()
    for x, bx, a in rows:
        for y, by, b in rows[x + 1:]:
            if bx == by and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.6:
                want.add((x, y))
    monkeypatch.setattr(rooms, "ROOM", 20)
    monkeypatch.setattr(rooms, "GROUP", 4)
    df = spark.createDataFrame(rows + rows[:40], "key int, block long, words array<string>").select("key", "block", similar.hashes("words").alias("a"))
    assert max(rooms._parts(df, 0.6).values()) > 3
    found = rooms.similar_sets(df, 0.6).collect()
    assert len(found) == len(want) and {(r.x, r.y) for r in found} == want


def test_bands_hold_all_similar_sizes():
    for same in (0.5, 0.72, 0.9, 1.0):
        edges = rooms.bands(same, 400)
        band = [int((edges <= n).sum()) - 1 for n in range(1, 401)]
        for n in range(1, 401):
            for m in range(int(rooms.least_size(same, n)), n + 1):
                assert 0 <= band[n - 1] - band[m - 1] <= 1 and rooms.sketch_bits(same, band[m - 1]) >= m


def test_documents_are_not_carried_along(spark, tmp_path, monkeypatch):
    """What is written for documents are their sets of words, not their texts; without a language none repeats another."""
    draw = random.Random(6)
    noise = lambda: "".join(chr(draw.randint(0x4E00, 0x9F00)) for _ in range(20_000))
    rows = [(i, f"one two three w{i} {noise()} w{i} x{i} y{i} z{i}", "en") for i in range(40)]
    rows += [(100, "same words", None), (101, "same words", None), (102, "same words", "en"), (103, "words, same", "en")]
    rows = [(i, text, lang, len(text)) for i, text, lang in rows] + [(104, "same words!", "en", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(session, "scratch_dir", lambda spark, label: f"{tmp_path}/scratch/{label}-{uuid.uuid4().hex}")
    got = {r.doc_id for r in q_distinct_documents(spark, str(tmp_path)).collect()}
    assert got == {*range(40), 100, 101, 103}
    assert sum(f.stat().st_size for f in Path(f"{tmp_path}/scratch").rglob("*.parquet")) < 40 * 20_000
