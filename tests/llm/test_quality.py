import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import quality_crf, quality_rules
from tallyspark.llm.blocks import blocks
from tallyspark.llm.training import id_remainder

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text):
    words = BLANK.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, double = set(), 0
    for line in (text or "").split("\n"):
        if BLANK.search(line):
            double += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), double, len(repeated))


@pytest.fixture(scope="module")
def rules_model(judged, labels):
    return quality_rules.train(judged, labels)


@pytest.fixture(scope="module")
def crf_model(judged, labels):
    return quality_crf.train(judged, labels)


TRICKY = ["a b c a b c", "x\nx\n\n \nx", "a b\na b\nä ß # $ <| a b a b", "w " * 60, "q", "é é a b", "a\x0bb\x0cc\rd"]


def test_rule_counts_equal_brute_force(docs_of, odd, rules_model):
    rows = odd.unionAll(docs_of([(100 + i, t) for i, t in enumerate(TRICKY)]))
    want = sorted((str(r.doc_id), *brute_rules(r.text)) for r in rows.collect())
    found = quality_rules.judge(rows, rules_model).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept) and 0 <= r.quality <= 1


def test_rules_tell_good_from_bad(judged, rules_model):
    found = {r.doc_id: r.kept for r in quality_rules.judge(judged, rules_model).collect()}
    assert all(found[i] == bool(i % 2) for i in found)


def test_rules_without_rows(none, labels, judged):
    model = quality_rules.train(none, labels)
    assert quality_rules.judge(none, model).count() == 0 and quality_rules.judge(judged, model).count() == 40


def brute_marginals(score, step):
    """P(good) of every line by summing over all label sequences."""
    n, total, good = len(score), 0.0, np.zeros(len(score))
    for code in range(2**n):
        state = [code >> i & 1 for i in range(n)]
        p = np.exp(sum(score[i] * state[i] for i in range(n)) + sum(step[a, b] for a, b in zip(state, state[1:])))
        total, good = total + p, good + p * np.array(state)
    return good / total


def test_chain_marginals_equal_enumeration():
    draw = np.random.default_rng(3)
    score, step, first = draw.normal(size=14), draw.normal(size=(2, 2)), np.array([0, 5, 5 + 1, 14])
    found, pairs = quality_crf.chains(score, first, step)
    want = np.concatenate([brute_marginals(score[a:b], step) for a, b in zip(first, first[1:])])
    assert np.allclose(found, want) and np.isclose(pairs.sum(), 14 - 3)


def plain_chain(score, step):
    """P(good) of each line of one chain and the pair counts, a line after the other."""
    node = np.exp(np.stack([-np.maximum(score, 0), score - np.maximum(score, 0)], 1))
    move, n = np.exp(step - step.max()), len(score)
    ahead, back, pairs = np.ones((n, 2)), np.ones((n, 2)), np.zeros((2, 2))
    for t in range(n):
        a = node[t] * (ahead[t - 1] @ move if t else 1)
        ahead[t] = a / a.sum()
    for t in range(n - 2, -1, -1):
        b = move @ (node[t + 1] * back[t + 1])
        back[t] = b / b.sum()
    for t in range(1, n):
        p = ahead[t - 1][:, None] * move * (node[t] * back[t])
        pairs += p / p.sum()
    both = ahead * back
    return both[:, 1] / both.sum(1), pairs


@pytest.mark.parametrize("piece, group", [(256, 1 << 16), (4, 32), (1, 8)])
def test_chains_in_pieces_equal_one_line_after_the_other(monkeypatch, piece, group):
    monkeypatch.setattr(quality_crf, "PIECE", piece)
    monkeypatch.setattr(quality_crf, "GROUP", group)
    draw = np.random.default_rng(4)
    first = np.concatenate([[0], np.cumsum([3, 1, 700, 4, 5, 256, 257, 1, 90])])
    score, step = draw.normal(scale=4, size=first[-1]), draw.normal(scale=2, size=(2, 2))
    found, pairs = quality_crf.chains(score, first, step)
    want = [plain_chain(score[a:b], step) for a, b in zip(first, first[1:])]
    assert np.allclose(found, np.concatenate([w for w, _ in want]), atol=1e-12)
    assert np.allclose(pairs, sum(p for _, p in want))
    assert quality_crf.chains(np.zeros(0), np.array([0]), step)[1].sum() == 0


def test_features_in_slices_equal_those_of_all_lines(monkeypatch):
    texts = ["A b c.\nD e f.\nA b c.", "", "\n\n", "X!! Y!!\nZ\n \nZ", "", "q\n\n", "é # 1\nA b c."]
    block = next(blocks(pa.array(texts)))
    x, length, first = quality_crf.line_features(block)
    assert first.tolist() == [0, 3, 4, 7, 11, 12, 15, 17] and length.sum() == len("".join(texts).encode()) - sum(t.count("\n") for t in texts)
    assert np.flatnonzero(x[:, 10]).tolist() == [2, 10]
    begins = set(first.tolist())
    for i in range(len(x)):
        assert (x[i, 12:24] == (0 if i in begins else x[i - 1, :12])).all()
        assert (x[i, 24:] == (0 if i + 1 in begins else x[i + 1, :12])).all()
    weights = np.random.default_rng(5).normal(size=quality_crf.WIDTH)
    monkeypatch.setattr(quality_crf, "GROUP", 2)
    assert np.allclose(quality_crf.Lines(block).scores(weights, 0.5), x.astype(float) @ weights + 0.5)


def test_a_text_of_line_feeds_takes_seconds(crf_model):
    start = time.process_time()
    (score,) = quality_crf.scores(next(blocks(pa.array(["\n" * 2_000_000 + "a"]))), crf_model)
    assert 0 <= score <= 1 and time.process_time() - start < 60


def test_crf_scores(judged, crf_model, odd):
    found = {r.doc_id: r.predicted for r in quality_crf.judge(judged, crf_model).collect()}
    assert all(found[i] == i % 2 for i in found)
    rows = quality_crf.judge(odd, crf_model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    twice = [r.score for r in rows if r.doc_id == 7]
    assert len(twice) == 3 and len(set(twice)) <= 2
    kept = quality_crf.keep_good(odd, crf_model)
    assert kept.schema == odd.schema and kept.count() == sum(r.predicted for r in rows)


def test_crf_without_rows_or_with_one_label(none, labels, judged, spark):
    model = quality_crf.train(none, labels)
    assert quality_crf.judge(none, model).count() == 0
    assert len({r.score for r in quality_crf.judge(judged, model).collect()}) == 1
    only = quality_crf.train(judged, labels.where("quality = 1"))
    assert all(r.score > 0.7 for r in quality_crf.judge(judged, only).collect())


def test_score_does_not_depend_on_neighbours_in_a_block(crf_model):
    texts = ["A b c.\nD e f.", "", "X!! Y!!\nZ", "q\n\n"]
    together = quality_crf.scores(next(blocks(pa.array(texts))), crf_model)
    assert np.allclose(together, [quality_crf.scores(next(blocks(pa.array([t]))), crf_model)[0] for t in texts])


def test_held_out_ids(spark):
    rows = spark.range(50).select("id", id_remainder(F.col("id"), 4).alias("m"))
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 4 for r in rows.collect())


def test_line_bound_skips_only_what_does_not_fit(judged, labels, docs_of):
    usual = quality_crf.train(judged, labels, lines=10_000)
    long = docs_of([(i, "a\n" * 20_000) for i in range(1_000, 1_010)])
    more = labels.unionAll(long.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))
    model = quality_crf.train(judged.unionAll(long), more, lines=10_000)
    assert usual.fitted and model.fitted and np.allclose(model.weights, usual.weights)


def test_all_documents_stay_without_a_model(judged, labels):
    model = quality_crf.train(judged, labels.limit(0))
    assert quality_crf.keep_good(judged, model).count() == judged.count()
    assert all((r.score, r.predicted) == (0.5, 0) for r in quality_crf.judge(judged, model).collect())
