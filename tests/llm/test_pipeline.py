import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tallyspark.llm import mixing
from tallyspark.llm.queries import MIXTURE, QUERIES, default_tokenizer

from .conftest import prose
from .test_copies import brute_classes, edited

ITEMS = [prose(1000 + i, 3).replace("\n", " ") for i in range(4)]


@pytest.fixture(scope="module")
def sf_dir(spark, judged, labels, tmp_path_factory):
    """Good and shouting documents, near and exact copies, and documents that hold an item."""
    folder = str(tmp_path_factory.mktemp("sf"))
    plain = [(100 + i, prose(100 + i, 30)) for i in range(60)]
    copies = [(200 + i, edited(prose(300 + i % 4, 60), 0.01 * (i % 3), i)) for i in range(20)]
    leaks = [(400 + i, f"{prose(500 + i, 12)} {ITEMS[i % 4]} {prose(600 + i, 12)}") for i in range(8)]
    rows = [(r.doc_id, r.text) for r in judged.collect()] + plain + copies + leaks
    rows = [(i, t, ("en", "de", "fr")[i % 3], f"src{i % 6}", len(t)) for i, t in rows] + [(900, "", "en", "src0", 0), (901, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def brute_rates(docs):
    def topic(text):
        low = text.lower()
        count = {name: low.count(part) for name, part in sorted(MIXTURE.topics.items())}
        best = max(count.values())
        return next(n for n, c in count.items() if c == best) if best else "other"

    cell = {r.doc_id: (r.source if r.source in MIXTURE.source else "other", r.lang if r.lang in MIXTURE.lang else "other", topic(r.text or "")) for r in docs}
    size = {r.doc_id: len((r.text or "").encode().split()) for r in docs}
    total = sum(size.values())
    share = {}
    for i, c in cell.items():
        share[c] = share.get(c, 0) + size[i] / total
    share = {c: s for c, s in share.items() if s}
    w = dict(share)
    for _ in range(MIXTURE.rounds):
        for axis, target in enumerate((MIXTURE.source, MIXTURE.lang, MIXTURE.topic)):
            has = {}
            for c, x in w.items():
                has[c[axis]] = has.get(c[axis], 0) + x
            goal = {v: target.get(v, 0) for v, h in has.items() if h > 0}
            w = {c: x * goal.get(c[axis], 0) / sum(goal.values()) / has[c[axis]] if has[c[axis]] else 0 for c, x in w.items()}
        w = {c: min(x, share[c] / MIXTURE.kept) for c, x in w.items()}
    return {i: w[c] * MIXTURE.kept / share[c] if size[i] else 1.0 for i, c in cell.items()}


def test_every_stage_against_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, sf_dir)
    assert good.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in good.collect()} - {900, 901} == set(range(20, 60, 2))
    single = stage["near_duplicates"](spark, good, sf_dir)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted(int(i) for i, c, _ in brute_classes(rows) if i == c)
    clean = stage["decontaminate"](spark, single, sf_dir)
    assert {r.doc_id for r in single.collect()} - {r.doc_id for r in clean.collect()} == {400 + i for i in range(8)}
    mixed = stage["mixture"](spark, clean, sf_dir)
    rate = brute_rates(clean.collect())
    draw = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) / 16**13 for i in rate}
    kept = sorted(i for i in rate if draw[i] < rate[i])
    assert sorted(r.doc_id for r in mixed.collect()) == kept and mixed.columns == docs.columns
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    tokenizer, start, want = Tokenizer.from_file(default_tokenizer()), 0, []
    for i in kept:
        ids = np.array([*tokenizer.encode(text[i], add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, stage["tokens"](spark, mixed, sf_dir).collect())) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == want


def test_rates_of_the_operator_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rate = brute_rates(docs.collect())
    assert all(r["__rate"] == pytest.approx(rate[r.doc_id], abs=1e-9) for r in mixing.weighted(docs, MIXTURE).collect())


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))


def test_stages_on_no_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        assert found.columns == docs.columns and found.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0
