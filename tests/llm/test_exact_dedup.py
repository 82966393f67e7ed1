import hashlib

import numpy as np
import pytest

from tallyspark.llm.exact_dedup import CountingQuotientFilter, copies, merged


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        top = max(known) if known else None
        stays = False
        for i in ids:
            out.append((i, top, len(ids), i == top and not stays, hashlib.sha256(t.encode()).hexdigest()))
            stays |= i == top
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[4], str(r[0]), not r[3]))


@pytest.mark.parametrize("bits,n", [(64, 0), (64, 1), (64, 5_000), (54, 70_000), (10, 900), (6, 64), (3, 8)])
def test_a_filter_gives_back_what_went_in(bits, n):
    draw = np.random.default_rng(n)
    high = min(2**bits, 2**63)
    prints = np.unique(draw.integers(0, high, n, dtype=np.uint64)) if n < high else np.arange(high, dtype=np.uint64)
    counts = np.where(draw.random(len(prints)) < 0.2, draw.integers(2, 2**40, len(prints)), 1)
    whole = CountingQuotientFilter.from_bytes(CountingQuotientFilter.of(prints, counts, bits).to_bytes())
    got = whole.entries()
    assert (got[0] == prints).all() and (got[1] == counts).all() and len(got[0]) == len(prints)


def test_slots_hold_sorted_remainders_behind_their_home():
    f = CountingQuotientFilter.of(np.array([0, 1, 2, 3, 8, 63], np.uint64), np.array([1, 1, 3, 1, 1, 2]), 6)
    assert f.q == 3 and f.occupied.tolist() == [True, True, False, False, False, False, False, True]
    assert f.used.tolist() == [True] * 5 + [False] * 2 + [True] and f.remainder.tolist() == [0, 1, 2, 3, 0, 7]
    assert f.run_end.tolist() == [False] * 3 + [True, True, False, False, True] and f.counter.tolist() == [3, 2]


def test_merging_loses_nothing():
    draw = np.random.default_rng(5)
    lots = [draw.integers(0, 3_000, 2_000, dtype=np.uint64) for _ in range(7)]
    parts = [CountingQuotientFilter.of(*np.unique(x, return_counts=True), 14) for x in lots]
    prints, counts = merged(parts).entries()
    want = np.unique(np.concatenate(lots), return_counts=True)
    assert (prints == want[0]).all() and (counts == want[1]).all()
    a, b = merged([merged(parts[:3]), merged(parts[3:])]), merged(parts[::-1])
    assert a.to_bytes() == b.to_bytes()


@pytest.mark.parametrize("bits", [64, 4])
def test_odd_rows_equal_brute_force(odd, bits):
    want = brute([(r.doc_id, r.text) for r in odd.collect()])
    found = copies(odd, bits)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert order(found.collect()) == order(want)


@pytest.mark.parametrize("bits", [64, 3])
def test_hot_groups_and_collisions_equal_brute_force(docs_of, bits):
    rows = [(i, "same" if i % 3 == 0 else f"text {i // 2}" if i % 3 == 1 else f" text {i // 7}") for i in range(4_000)]
    rows += [(i, "same ") for i in range(50)] + [(None, "lost")] * 3 + [(7, "twice")] * 5 + [(9, "twice")] * 2
    docs = docs_of(rows, "doc_id bigint, text string").repartition(7)
    assert order(copies(docs, bits).collect()) == order(brute(rows))


def test_ids_of_any_type(docs_of):
    rows = [("b", "x"), ("a", "x"), ("c", None), (None, "")]
    assert order(copies(docs_of(rows, "doc_id string, text string")).collect()) == order(brute(rows))


def test_no_rows(none):
    assert copies(none).collect() == []
