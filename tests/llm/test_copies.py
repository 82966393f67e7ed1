import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import lsh_forest, span_dedup
from tallyspark.llm.blocks import blocks
from tallyspark.llm.graph import components

from .conftest import prose


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    head = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    return sorted((str(rows[i][0]), str(head[find(i)]) if sets[i] else str(rows[i][0]), links[i]) for i in range(len(rows)))


def edited(text, rate, seed):
    draw = random.Random(seed)
    return " ".join("zzz" if draw.random() < rate else w for w in text.split(" "))


@pytest.fixture(scope="module")
def copies(docs_of, odd):
    rows = [(200 + i, edited(prose(50 + i % 3, 60), 0.01 * (i % 4), i)) for i in range(40)]
    return odd.unionAll(docs_of(rows + [(300, "one two THREE four five"), (301, "one two three four five")]))


def test_classes_equal_brute_force(copies):
    want = brute_classes([(r.doc_id, r.text) for r in copies.select("doc_id", "text").collect()])
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in lsh_forest.near_duplicates(copies).collect())
    assert got == want


def test_small_blocks_give_the_same(copies, monkeypatch):
    want = sorted(map(str, lsh_forest.near_duplicates(copies).collect()))
    monkeypatch.setattr(lsh_forest, "BLOCK", 3)
    assert sorted(map(str, lsh_forest.near_duplicates(copies).collect())) == want


def test_keep_first(copies, none):
    kept = lsh_forest.keep_first(copies)
    assert kept.schema.names == copies.schema.names
    rows = kept.select("doc_id", "text").collect()
    classes = {(str(r.doc_id), r.class_id) for r in lsh_forest.near_duplicates(copies).collect()}
    ids = [str(r.doc_id) for r in rows]
    assert {i for i, c in classes if i == str(c)} <= set(ids)
    left = brute_classes([(r.doc_id, r.text) for r in rows])
    assert all(n == 0 for _, _, n in left)
    assert sum(r.text in (None, "") for r in rows) == 3
    assert lsh_forest.keep_first(none).count() == 0 and lsh_forest.near_duplicates(none).count() == 0


def test_prefixes_are_shortened_to_the_recall():
    assert lsh_forest.least_depth(0.8, 0.9) == 6 and lsh_forest.least_depth(0.8, 0.9995) == 4
    assert lsh_forest.least_depth(0.1, 0.9999) == 1
    none, high, low = (np.zeros(97) for _ in range(3))
    high[94], low[77] = 10_000, 10_000
    for pairs, depth in ((none, 4), (high, 6), (low, 4)):
        assert next(d for d in range(6, 0, -1) if lsh_forest.reached(pairs, d, 0.8) >= 0.9995) == depth


def forest_of(docs):
    signed = lsh_forest.signatures(docs).where("node is not null").dropDuplicates(["node"])
    return signed.withColumn("copies", F.lit(1).cast("bigint"))


def test_sorted_labels_share_what_all_pairs_say(copies):
    nodes = forest_of(copies)
    rows = {r.node: np.array(r.labels).reshape(lsh_forest.TREES, -1) for r in nodes.collect()}
    want = {}
    for a in rows:
        for t in range(lsh_forest.TREES):
            common = max(np.logical_and.accumulate(rows[a][t] == rows[b][t]).sum() for b in rows if b != a)
            if common >= 3:
                want[a, t] = common
    assert {(r.node, r.tree): r.shared for r in lsh_forest.tries(nodes, 3).collect()} == want and len(want) > 100


@pytest.mark.parametrize("block", [256, 3])
def test_each_pair_meets_once_and_at_its_deepest(copies, monkeypatch, block):
    monkeypatch.setattr(lsh_forest, "BLOCK", block)
    nodes = forest_of(copies)
    rows = {r.node: (r.size, np.array(r.labels).reshape(lsh_forest.TREES, -1)) for r in nodes.collect()}
    forest, met = lsh_forest.tries(nodes, 4), {}
    for depth in (6, 5, 4):
        for cell in lsh_forest.members(forest, nodes, depth, 0.8).groupBy(*lsh_forest.CELL, "tree").agg(
                F.collect_list(F.struct("node", "block", "guest")).alias("own")).collect():
            own = cell.own
            labels = np.stack([rows[m.node][1] for m in own])
            meet = lsh_forest.first_meetings(cell.tree, depth, cell.row, cell.col, np.array([m.block for m in own]),
                                             np.array([m.guest for m in own]), labels)
            for i, j in zip(*np.nonzero(meet)):
                met.setdefault(frozenset((own[i].node, own[j].node)), []).append(depth)
    assert all(len(found) == 1 for found in met.values())
    for a in rows:
        for b in rows:
            common = np.logical_and.accumulate(rows[a][1] == rows[b][1], 1).sum(1).max()
            if a < b and common >= 4 and min(rows[a][0], rows[b][0]) >= 0.8 * max(rows[a][0], rows[b][0]):
                assert met[frozenset((a, b))] == [common]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(10, 40)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 5 for i in range(10, 40)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


PASSAGE = prose(900, 18).replace("\n", " ")
PLAIN = " ".join(w.lower().strip(".") for w in prose(901, 18).split())


def test_repeated_passages_go_but_for_the_first(docs_of, odd):
    rows = [(400 + i, f"{prose(500 + i, 9)}\nstart {i} {passage} end {i} {prose(600 + i, 9)}")
            for i, passage in enumerate([PASSAGE, PASSAGE, PLAIN, PLAIN, PLAIN])]
    twice = (450, f"{prose(700, 9)} {PASSAGE[:900]} {prose(701, 9)} {PASSAGE[:900]}")
    docs = odd.unionAll(docs_of([*rows, twice, (460, "Is. Of. To. A. B. C.")])).unionAll(docs_of([(461, "Is. Of. To. A. B. C. D.")]))
    before = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: r for r in span_dedup.remove_repeats(docs).collect()}
    assert span_dedup.remove_repeats(docs).count() == docs.count()
    assert out[400].text == before[400] and out[402].text == before[402]

    def windows(text, size=50):
        words = text.split()
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}

    assert not windows(out[400].text) & windows(out[401].text) and 400 in out[401].first_docs
    assert not windows(out[402].text) & windows(out[403].text) and not windows(out[403].text) & windows(out[404].text)
    assert not windows(out[450].text) & windows(out[400].text)
    assert f"end 1 {prose(601, 9)}"[-200:] in out[401].text and prose(501, 9)[:200] in out[401].text
    assert out[1].n_removed == 0 and out[1].text == before[1]
    assert out[6].n_removed == out[6].n_sentences and out[6].first_docs == [1]
    assert out[2].text == "" and out[3].text == "" and out[4].text == before[4] and out[460].text == before[460]


def plain_sentences(text):
    """The sentences of a text as tuples of words, by the rule of the module's docstring."""
    words, last = [], []
    for line in (text or "").encode().split(b"\n"):
        own = line.split()
        words += own
        last += [w[-1:] in (b".", b"!", b"?") for w in own[:-1]] + [True] * bool(own)
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    known = dict(zip(low, next(blocks(pa.array([" ".join(w.decode() for w in low)]))).words().hash.tolist())) if low else {}
    ends = list(last)
    for i in range(len(low) - 7):
        if not any(last[i : i + 8]):
            ends[min(range(i, i + 8), key=lambda k: (known[low[k]], k))] = True
    out, held = [], []
    for w, end in zip(low, ends):
        held.append(w)
        if end:
            out.append(tuple(held))
            held = []
    return out


def plain_spans(own):
    """(first, end) of the shortest runs of three sentences and 30 words from and up to every sentence."""
    def enough(i, j):
        return j - i >= 3 and sum(map(len, own[i:j])) >= 30

    n = len(own)
    ahead = {(i, next((j for j in range(i, min(i + 40, n) + 1) if enough(i, j)), None)) for i in range(n)}
    behind = {(next((i for i in range(j, max(j - 40, 0) - 1, -1) if enough(i, j)), None), j) for j in range(1, n + 1)}
    return sorted(x for x in ahead | behind if None not in x)


def test_removed_sentences_equal_brute_force(docs_of, odd):
    rows = [(800 + i, f"{prose(810 + i, 6)} {PASSAGE if i % 2 else PLAIN} {prose(830 + i, 6)} {PLAIN if i % 3 == 0 else ''}") for i in range(6)]
    rows += [(None, rows[0][1]), (None, rows[0][1]), (799, f"{PASSAGE}\n{PASSAGE}"), (798, " ".join(PLAIN.split()[:45]))]
    docs = odd.where("doc_id is null or doc_id != 5").unionAll(docs_of(rows))
    texts = [(r.doc_id, plain_sentences(r.text)) for r in docs.collect()]
    key = [2**63 - 1 if d is None else d for d, _ in texts]
    found = [[(i, j, tuple(own[i:j])) for i, j in plain_spans(own)] for _, own in texts]
    first = {}
    for k, of_text in zip(key, found):
        for *_, span in of_text:
            first[span] = min(first.get(span, k), k)
    want = []
    for (doc_id, own), k, of_text in zip(texts, key, found):
        gone, keepers, seen = set(), set(), set()
        for i, j, span in of_text:
            if first[span] < k:
                keepers.add(first[span])
            if first[span] < k or span in seen:
                gone.update(range(i, j))
            seen.add(span)
        left = [w for n, s in enumerate(own) if n not in gone for w in s]
        want.append((str(doc_id), len(own), len(gone), sorted(keepers), b" ".join(left).decode()))

    def low(text):
        return b" ".join(bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in text.encode().split()).decode()

    got = [(str(r.doc_id), r.n_sentences, r.n_removed, sorted(r.first_docs or []), low(r.text)) for r in span_dedup.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] > 0 for w in want) > 5


def test_phrases_of_ten_words_stay(docs_of):
    phrase = " ".join(PLAIN.split()[:10])
    docs = docs_of([(i, f"{prose(860 + i, 9)} {phrase} {prose(880 + i, 9)}") for i in range(10)])
    assert all(r.n_removed == 0 for r in span_dedup.remove_repeats(docs).collect())


def test_spans_of_nothing(none):
    assert span_dedup.remove_repeats(none).count() == 0


def test_repeats_of_51_to_60_words_in_other_surroundings(docs_of):
    draw = random.Random(11)

    def words(n):
        return [w.lower().strip(".") for w in prose(draw.random(), 3 + n // 8).split()][:n]

    def marked(run):
        return [w + "." if i % 12 == 11 else w for i, w in enumerate(run)]

    passages = [run if i % 2 else marked(run) for i in range(200) for run in [words(51 + i // 2 % 10)]]
    rows = [(2 * i + k, " ".join([*words(40), *passages[i], *words(40)])) for i in range(200) for k in (0, 1)]
    out = {r.doc_id: r.text.split() for r in span_dedup.remove_repeats(docs_of(rows)).collect()}
    for i, passage in enumerate(passages):
        assert out[2 * i] == rows[2 * i][1].split()
        gone = 80 + len(passage) - len(out[2 * i + 1])
        assert len(passage) - 30 <= gone <= len(passage)
