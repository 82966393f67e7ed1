import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import suffix_tree, url_filter
from tallyspark.llm.blocks import LOWERED, blocks, sorting, span_hashes
from tallyspark.llm.queries import URL_RULES

from .conftest import prose


def tokens(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split() + [None]


class PlainTree:
    """The tree by dictionaries of whole tuples of tokens; None is the end."""

    def __init__(self, texts, depth=2, least=2, least_gain=6.0, divergence=0.01):
        streams = [[None, *tokens(t)] for t in texts]
        self.words = Counter(w for t in streams for w in t[1:])
        self.total, self.states = sum(self.words.values()), {}
        for length in range(1, depth + 1):
            follow, seen = defaultdict(Counter), Counter()
            for t in streams:
                for i in range(length, len(t)):
                    follow[tuple(t[i - length : i])][t[i]] += 1
                    seen[tuple(t[i - length : i])] += 1
            new = {}
            for context, nexts in follow.items():
                entries, n = {w: k for w, k in nexts.items() if k >= least}, seen[context]
                gain = sum(k * math.log(k / n / self.p(context[1:], w)) for w, k in entries.items())
                if entries and gain >= max(least_gain, divergence * n):
                    own = {w: (k - suffix_tree.DISCOUNT) / n for w, k in entries.items()}
                    new[context] = own, 1 - sum(own.values())
            self.states.update(new)

    def root(self, word):
        return (self.words[word] + 0.1) / (self.total + 0.1 * (len(self.words) + 1))

    def p(self, context, word):
        if not context:
            return self.root(word)
        shorter = self.p(context[1:], word)
        if context not in self.states:
            return shorter
        own, left = self.states[context]
        return own.get(word, 0.0) + left * shorter

    def score(self, text, depth=2):
        t = [None, *tokens(text)]
        return sum(math.log10(self.p(tuple(t[max(0, i - depth) : i]), t[i])) for i in range(1, len(t)))


@pytest.fixture(scope="module")
def tree(judged):
    return suffix_tree.train(judged)


def test_base_equals_brute_force(judged, odd, tree):
    count = Counter(w for r in judged.collect() for w in tokens(r.text))
    total, distinct = sum(count.values()), len(count)
    assert (tree.tokens, tree.distinct) == (total, distinct)
    docs = odd.unionAll(judged)
    want = sorted((str(r.doc_id), len(t := tokens(r.text)), sum(w in count for w in t),
                   round(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t), 4)) for r in docs.collect())
    rows = suffix_tree.score(docs, tree).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in rows) == want
    assert all(r.score <= 0 for r in rows)


@pytest.fixture(scope="module")
def ordered(docs_of):
    """Texts in which each word allows two next ones."""
    draw = random.Random(5)

    def chain(n):
        out, at = [], 0
        for _ in range(n):
            at = (at + draw.choice([1, 2])) % 30
            out.append(f"w{at}")
        return " ".join(out)

    return docs_of([(i, chain(200)) for i in range(60)])


@pytest.fixture(scope="module")
def deep(docs_of):
    """Texts of four words, drawn by the three words before."""
    draw = random.Random(8)
    weights = defaultdict(lambda: [draw.random() ** 4 for _ in range(4)])

    def chain(n):
        out = ["p", "q", "r"]
        while len(out) < n:
            out += draw.choices("pqrs", weights[tuple(out[-3:])])
        return " ".join(out)

    return docs_of([(i, chain(100)) for i in range(60)])


@pytest.mark.parametrize(("depth", "least", "gain", "parts"), [(2, 2, 6.0, 500), (3, 2, 6.0, 1_000_000), (1, 5, 2.0, 100)])
def test_tree_equals_plain_dictionaries(deep, judged, odd, depth, least, gain, parts, monkeypatch):
    monkeypatch.setattr(suffix_tree, "RANGE", parts)
    learned = deep.where("doc_id < 50").unionAll(judged.where("doc_id < 50"))
    plain = PlainTree([r.text for r in learned.collect()], depth, least, gain)
    assert {len(c) for c in plain.states} == set(range(1, depth + 1))
    docs = deep.unionAll(judged).unionAll(odd)
    model = suffix_tree.train(learned, depth, least, gain)
    got = Counter((str(r.doc_id), round(r.score, 5)) for r in suffix_tree.score(docs, model).collect())
    assert got == Counter((str(r.doc_id), round(plain.score(r.text, depth), 5)) for r in docs.collect())


def test_plain_probabilities_add_up_to_one(ordered):
    plain = PlainTree([r.text for r in ordered.where("doc_id < 50").collect()])
    for context in plain.states:
        assert sum(plain.p(context, w) for w in [*plain.words, "unknown"]) == pytest.approx(1.0)


def test_passes_and_packs_change_nothing(ordered, judged, monkeypatch):
    docs = ordered.unionAll(judged)
    want = sorted((r.doc_id, round(r.score, 6)) for r in suffix_tree.score(docs, suffix_tree.train(docs, passes=1), 1).collect())
    monkeypatch.setattr(suffix_tree, "HELD", 300)
    monkeypatch.setattr(suffix_tree, "RANGE", 100)
    got = suffix_tree.score(docs, suffix_tree.train(docs, passes=4), 5).collect()
    assert sorted((r.doc_id, round(r.score, 6)) for r in got) == want


def test_addends_come_once_a_range(judged, monkeypatch):
    """The rows that hold a tree grow as its ranges, not as their square."""
    monkeypatch.setattr(suffix_tree, "RANGE", 100)
    model = suffix_tree.train(judged)
    assert model.ranges > 50 and model.addends.count() <= (model.depth + 1) * model.ranges


def test_packs_go_a_few_at_a_time():
    """What Spark and Python hold of the packs of a task is a batch of bounded size, not all that it counted."""
    made = []

    def packs():
        for part in range(200):
            made.append(part)
            yield {"part": part, **dict.fromkeys(("prefix", "suffix", "n"), bytes(100_000))}

    sent = 0
    for batch in suffix_tree.rows_of(packs(), suffix_tree.PACKED):
        sent += batch.num_rows
        assert batch.nbytes <= suffix_tree.SENT + 400_000 and len(made) == sent
    assert sent == 200


def test_addends_lie_in_packs_of_bounded_size(judged, monkeypatch):
    docs = judged.where("doc_id < 50")
    want = sorted((r.doc_id, round(r.score, 6)) for r in suffix_tree.score(docs, suffix_tree.train(docs)).collect())
    monkeypatch.setattr(suffix_tree, "DEALT", 40)
    model = suffix_tree.train(docs)
    sizes = [len(r.key) // 8 for r in model.addends.collect()]
    assert max(sizes) == 40 and len(sizes) <= sum(sizes) / 40 + (model.depth + 1) * model.ranges
    assert sorted((r.doc_id, round(r.score, 6)) for r in suffix_tree.score(docs, model).collect()) == want


def test_training_moves_packs(ordered, monkeypatch):
    """Between the steps of training all but words lie in packs, a few rows whatever the number of runs in them."""
    rows, write = Counter(), suffix_tree.stored

    def stored(df, label, *options):
        table = write(df, label, *options)
        if label != "tree-words":
            rows[label] += table.count()
        return table

    monkeypatch.setattr(suffix_tree, "stored", stored)
    model = suffix_tree.train(ordered)
    assert sum(len(r.key) // 8 for r in model.addends.collect()) > 100 and rows["tree-runs"] and sum(rows.values()) < 50


def test_a_suffix_follows_from_key_and_prefix():
    prefix, suffix = (np.random.default_rng(i).integers(0, 1 << 64, 1_000, np.uint64) for i in (1, 2))
    assert (suffix_tree.last(suffix_tree.joined(prefix, suffix), prefix) == suffix).all()


def test_a_context_with_many_entries(docs_of, monkeypatch):
    """Entries of one context that come in many packs are judged together."""
    texts = [" ".join(f"the n{(7 * i + j) % 90} of" for j in range(30)) for i in range(40)]
    docs, plain = docs_of(list(enumerate(texts))), PlainTree(texts)
    monkeypatch.setattr(suffix_tree, "HELD", 20)
    monkeypatch.setattr(suffix_tree, "RANGE", 500)
    got = {r.doc_id: r.score for r in suffix_tree.score(docs, suffix_tree.train(docs)).collect()}
    assert (b"of",) in plain.states and (b"the",) in plain.states
    assert got == pytest.approx({i: plain.score(t) for i, t in enumerate(texts)}, abs=1e-6)


def test_word_hashes_and_their_order():
    texts = [prose(3, 3_000), "", "a" * 300_000 + " B", " \n", "x " * 70_000 + "Y" * 65_536, "É"]
    words = next(blocks(pa.array(texts), 1 << 24)).words()
    assert (words.hash == span_hashes(words.block.data, words.start, words.end, LOWERED)).all()
    for key in (words.hash, words.hash[:1], words.hash[:0], np.array([5 << 60 | 3, 5 << 60 | 1, 5 << 60 | 3, 7, 0, 7], np.uint64)):
        assert (sorting(key) == np.argsort(key, kind="stable")).all()


def test_a_rare_pair_keeps_its_entry_however_large_the_corpus(spark, docs_of):
    filler = spark.range(100).selectExpr("id + 100 AS doc_id", "repeat('the cat sat on the mat while a dog slept . ', 10000) AS text")
    pair = docs_of([(i, f"quasi{'xyz'[i % 3]} stellar object") for i in range(30)], "doc_id bigint, text string")
    model = suffix_tree.train(filler.unionAll(pair))
    assert model.tokens > 10_000_000
    found = suffix_tree.score(docs_of([(0, "quasix stellar"), (1, "quasix cat")]), model)
    pairs = {r.doc_id: r.score - r.base_score for r in found.collect()}
    assert pairs[0] > 5 > pairs[1]


def test_states_help_on_text_with_order(ordered):
    model = suffix_tree.train(ordered.where("doc_id < 50"))
    rows = suffix_tree.score(ordered.where("doc_id >= 50"), model).collect()
    assert all(r.score > 0.5 * r.base_score for r in rows)


def test_tree_of_nothing(none, odd):
    model = suffix_tree.train(none)
    assert suffix_tree.score(none, model).count() == 0
    assert all(r.n_known == 0 and r.score == pytest.approx(0) for r in suffix_tree.score(odd, model).collect())


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and ("allow" if best.allow else "block")


@pytest.fixture(scope="module")
def url_model(spark):
    return url_filter.train(spark.createDataFrame([(u, 1) for u in url_filter.BLOCKED] + [(u, 0) for u in url_filter.ALLOWED] + [(None, None)],
                                                  "url string, blocked int"))


def test_urls_equal_brute_force(spark, url_model):
    urls = ["http://A.example.ORG/es/1?x", "https://example.org/en/12#a", "http://notexample.org/en/1", "x://com/fr/", "http://a.com?b/c", "no scheme",
            None, "", "://", "http://", "http://ÄB.com/de/é", "a://b://c.com/fr/x", "http://org", "http://org/", "http://www.cheap-pills.example.net/en/4",
            "http://blog.there.example.net/en/9", "http://x.net/" + "y" * 50_000, "http://x.net/\n?", "http://www.cheap-pills.example.net/en/4"]
    pages = spark.createDataFrame([(i, u, "h", 0.0) for i, u in enumerate(urls)] + [(None, "http://com/de/", None, None)],
                                  "page_id bigint, url string, host string, score double")
    rows = url_filter.judge(pages, url_model, URL_RULES).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        host, path, rule, verdict = brute_url(urls[r.page_id] if r.page_id is not None else "http://com/de/")
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert rule is None or r.verdict == verdict
    by = {r.page_id: r.verdict for r in rows}
    assert by[14] == by[18] == "block" and by[15] == by[6] == by[5] == "allow"
    assert url_filter.judge(pages.limit(0), url_model, URL_RULES).count() == 0


def test_labelled_addresses(spark, url_model):
    for urls, verdict in ((url_filter.BLOCKED, "block"), (url_filter.ALLOWED, "allow")):
        pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
        assert {r.verdict for r in url_filter.judge(pages, url_model, []).collect()} == {verdict}
    with pytest.raises(ValueError):
        url_filter.train(spark.createDataFrame([("http://a", 1), ("http://b", 0)], "url string, blocked int"), rows=1)
    one = url_filter.train(spark.createDataFrame([("http://a", 1)], "url string, blocked int"))
    assert url_filter.judge(spark.createDataFrame([(1, "http://q/")], "page_id bigint, url string"), one, []).first().verdict == "block"


def test_gram_ids_do_not_cross_texts():
    texts = ["abc", "", "abcd", "x"]
    ids, bounds = url_filter.gram_ids(next(blocks(pa.array(texts))), 0)
    alone = [url_filter.gram_ids(next(blocks(pa.array([t]))), 0)[0] for t in texts]
    for i, own in enumerate(alone):
        assert sorted(ids[bounds[i] : bounds[i + 1]]) == sorted(own)
    assert len(alone[0]) == 3 + 2 + 1 and prose(1)
