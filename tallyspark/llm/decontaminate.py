"""Benchmark decontamination by latent semantic retrieval.

Documents and benchmark items are cut into passages. A randomised SVD of the TF-IDF matrix of the items and of
a sample of document passages gives a latent space; every passage of every document is folded into it and
compared, by cosine, with all pieces of the items. Beside it stands an exact way: every passage that shares a run
of RUN words with an item, or the whole of a shorter item, is a candidate too, whatever its cosine. Candidates are
verified on the words: the longest common subsequence with the item, and for paraphrases the item's answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.blocks import STEP, U64, Block, Words, blocks, map_batches, mix
from tallyspark.llm.suffix_tree import Lookup
from tallyspark.session import stored

BITS = 15
STRIDE = 16  # words of a step; a passage is two steps
PIECE = 48  # most words of a piece of an item
RUN = 5  # words of a run that makes a passage a candidate by itself
PART = 1 << 10  # features of a part of the factor matrix
NONE = 1 << BITS  # the feature of no word
CHUNK = 1_024  # steps folded in at a time, so that their sums stay in the processor's cache


@dataclass
class Item:
    item_id: object
    words: np.ndarray
    answer: np.ndarray

    def __post_init__(self):
        self.known = frozenset(self.words.tolist())


@dataclass
class Runs:
    """Word runs of one size: their hashes, and the items that hold each, from `first` on."""

    size: int
    known: Lookup
    first: np.ndarray
    item: np.ndarray


@dataclass
class Index:
    fold: np.ndarray  # feature -> latent space, with idf and scaling
    items: list[Item]
    pieces: np.ndarray  # unit vectors of the items' pieces
    owner: np.ndarray  # item of each piece
    cosine: float
    verbatim: float
    paraphrase: float
    runs: list[Runs]
    words: Runs  # single words
    sizes: np.ndarray  # words of each item


def feature(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - BITS)).astype(np.int64)


def steps(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each step (16 words, fewer at the end of a text), and the first step of each text."""
    count = -(-words.counts // STRIDE)
    first = np.concatenate([[0], np.cumsum(count)])
    within = np.arange(first[-1]) - np.repeat(first[:-1], count)
    return np.repeat(words.bounds[:-1], count) + within * STRIDE, first


def step_features(words: Words, starts: np.ndarray) -> np.ndarray:
    """One row per step: the features of its words, filled up with NONE."""
    out = np.full((len(starts), STRIDE), NONE, np.int32)
    size = np.diff(np.append(starts, len(words)))
    row = np.repeat(np.arange(len(starts)), size)
    out[row, np.arange(len(words)) - starts[row]] = feature(words.hash)
    return out


def passage_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many steps each feature occurs, over all documents, and the number of steps."""
    def run(batches):
        seen, total = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for block in blocks(batch.column("text")):
                words = block.words()
                starts, _ = steps(words)
                rows = np.sort(step_features(words, starts), axis=1)
                new = np.ones(rows.shape, bool)
                new[:, 1:] = rows[:, 1:] != rows[:, :-1]
                seen += np.bincount(rows[new], minlength=NONE + 1)[:NONE]
                total += len(starts)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(np.append(at, -1)), "n": pa.array(np.append(seen[at], total))})

    found = map_batches(docs.select("text"), run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    at, n = found.column("feature").to_numpy(), found.column("n").to_numpy()
    out = np.zeros(1 << BITS, np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return out, int(n[at < 0].sum())


def sample_passages(docs: DataFrame, rows: int, passages: int) -> DataFrame:
    """Features of at most `passages` passages from at most `rows` documents, both chosen by hashes."""
    def run(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                words = block.words()
                starts, first = steps(words)
                at = feature(words.hash)
                text_end = np.repeat(words.bounds[1:], np.diff(first))
                found = [at[s : min(s + 2 * STRIDE, e)] for s, e in zip(starts[::2], text_end[::2])]
                yield pa.RecordBatch.from_pydict({"features": pa.array(found, pa.list_(pa.int64())), "weight": pa.array(np.ones(len(found)))})

    few = docs.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = map_batches(docs.join(few, "doc_id", "left_semi").select("text"), run, "features array<bigint>, weight double")
    return found.orderBy(F.xxhash64("features"), "features").limit(passages)


def factor(matrix: DataFrame, idf: np.ndarray, rank: int, extra: int = 16) -> np.ndarray:
    """Right singular vectors of the matrix whose rows are weighted, unit-length TF-IDF passages.

    Randomised SVD: every task multiplies its rows by the same random block, which it draws itself; the Gram
    matrix of the products orthogonalises them; then every task projects its rows on that basis, and the
    projections are summed part by part over the features. Only sums whose sizes are set by the parameters
    come to the driver.
    """
    width = rank + extra
    sent = matrix.sparkSession.sparkContext.broadcast(idf.astype(np.float32))

    def rows_of(batches):
        """Feature, row and value of the entries of each batch, and the rows times the random block."""
        block = np.random.default_rng(7).standard_normal((1 << BITS, width), np.float32)
        for batch in batches:
            at = batch.column("features").flatten().to_numpy()
            size = np.diff(batch.column("features").offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            value = sent.value[at]
            length = np.sqrt(np.bincount(row, value**2, len(size)))
            value = (value * (batch.column("weight").to_numpy() / np.maximum(length, 1e-9))[row]).astype(np.float32)
            yield at, row, value, row_sums(block[at] * value[:, None], size)

    def gram(batches):
        total = np.zeros((width, width))
        for _, _, _, y in rows_of(batches):
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"sum": pa.array([total.tobytes()])})

    found = map_batches(matrix, gram, "sum binary").toArrow().column("sum").to_pylist()
    value, vector = np.linalg.eigh(sum(np.frombuffer(b).reshape(width, width) for b in found))
    keep = value > 1e-9 * max(float(value.max()), 1e-30)
    basis = (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)

    def project(batches):
        total = np.zeros((1 << BITS, basis.shape[1]), np.float32)
        for at, row, value, y in rows_of(batches):
            order = np.argsort(at, kind="stable")
            new = np.flatnonzero(np.diff(at[order], prepend=-1))
            if len(new):
                total[at[order][new]] += np.add.reduceat(((y @ basis)[row] * value[:, None])[order], new)
        for part in range(0, 1 << BITS, PART):
            if total[part : part + PART].any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([part]), "sum": pa.array([total[part : part + PART].tobytes()])})

    def add(group):
        total = 0
        for piece in group.column("sum"):
            total = total + np.frombuffer(piece.as_py(), np.float32)
        return pa.table({"part": group.column("part").slice(0, 1), "sum": pa.array([total.tobytes()])})

    parts = map_batches(matrix, project, "part bigint, sum binary")
    found = parts.groupBy("part").applyInArrow(add, "part bigint, sum binary").toArrow()
    projected = np.zeros((1 << BITS, basis.shape[1]), np.float32)
    for part, piece in zip(found.column("part").to_pylist(), found.column("sum").to_pylist()):
        projected[part : part + PART] = np.frombuffer(piece, np.float32).reshape(-1, basis.shape[1])
    sent.destroy()
    value, vector = np.linalg.eigh((projected.T @ projected).astype(np.float64))
    top = np.argsort(-value)[:rank]
    top = top[value[top] > 1e-7 * max(float(value.max()), 1e-30)]
    return projected @ (vector[:, top] / np.sqrt(value[top])).astype(np.float32)


def row_sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, `size` of them each."""
    out = np.zeros((len(size), values.shape[1]), np.float32)
    full = np.flatnonzero(size)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(size) - size)[full])
    return out


def read_items(benchmark: DataFrame, answer_words: int) -> Iterator[list[Item]]:
    """Items with words, in order of their ids, in blocks of at most 2,000. An `answer` column is used if
    there is one; else the last words of the item stand for its answer."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"), answer.alias("answer")).orderBy("item_id", "text")
    held: list[Item] = []
    for row in rows.toLocalIterator():
        words, own = (_hashes(t) for t in (row.text, row.answer or ""))
        if len(words):
            held.append(Item(row.item_id, words, own if len(own) else words[-answer_words:]))
        if len(held) == 2_000:
            yield held
            held = []
    if held:
        yield held


def _hashes(text: str) -> np.ndarray:
    return np.concatenate([b.words().hash for b in blocks(pa.array([text]))])


def runs_of(items: list[Item]) -> list[Runs]:
    """The runs of RUN words of all items; a shorter item is one run."""
    out = []
    sizes = np.array([min(RUN, len(item.words)) for item in items])
    for size in np.unique(sizes).tolist():
        held, owner = [], []
        for k in np.flatnonzero(sizes == size):
            words = items[k].words
            h = np.zeros(len(words) - size + 1, np.uint64)
            for i in range(size):
                h = h * STEP + words[i : i + len(h)]
            held.append(np.unique(mix(h)))
            owner.append(np.full(len(held[-1]), k))
        h, owner = np.concatenate(held), np.concatenate(owner)
        order = np.argsort(h, kind="stable")
        keys, first = np.unique(h[order], return_index=True)
        out.append(Runs(size, Lookup(keys), np.append(first, len(h)), owner[order]))
    return out


def words_of(items: list[Item]) -> Runs:
    """The words of all items, and the items that hold each."""
    held = [np.unique(item.words) for item in items]
    h, owner = np.concatenate(held), np.repeat(np.arange(len(items)), [len(x) for x in held])
    order = np.argsort(h, kind="stable")
    keys, first = np.unique(h[order], return_index=True)
    return Runs(1, Lookup(keys), np.append(first, len(h)), owner[order])


def holders(runs: Runs, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items that hold each of the known runs, one run after the other, and how many hold each."""
    size = runs.first[key + 1] - runs.first[key]
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return runs.item[np.repeat(runs.first[key], size) + within], size


def sharing_runs(words: Words, starts: np.ndarray, text: np.ndarray, index: Index) -> Iterator[tuple[int, int]]:
    """(passage, item) of every run that a text shares with an item and around which enough words of the item stand
    for a paraphrase; the passage is the one whose first step holds the run's first word.

    One run may be shared with all items, so the words around it are counted for all of them at once, over the
    postings of the words, before any is looked at by itself.
    """
    found = []
    for runs in index.runs:
        at, h = words.windows(runs.size)
        key = runs.known.find(h)
        hit = np.flatnonzero(key >= 0)
        item, size = holders(runs, key[hit])
        passage = np.searchsorted(starts, at[hit], "right") - 1
        found.append(np.repeat(passage, size) * len(index.items) + item)
    pairs = np.unique(np.concatenate(found))
    passage, item = pairs // len(index.items), pairs % len(index.items)
    known = index.words.known.find(words.hash) if len(pairs) else None
    cuts = np.flatnonzero(np.diff(passage, prepend=-1, append=-1))
    for lo, hi in zip(cuts, cuts[1:]):
        p, own = int(passage[lo]), item[lo:hi]
        around = int(index.sizes[own].max())
        region = known[max(words.bounds[text[p]], starts[p] - around) : min(words.bounds[text[p] + 1], starts[p] + 2 * STRIDE + around)]
        held, _ = holders(index.words, region[region >= 0])
        count = np.bincount(held, minlength=len(index.items))
        yield from ((p, int(k)) for k in own[count[own] >= index.paraphrase * index.sizes[own]])


def build_index(docs: DataFrame, items: list[Item], frequency: np.ndarray, total: int, rank: int = 128,
                sample_docs: int = 2_000, sample: int = 20_000, cosine: float = 0.65, verbatim: float = 0.8,
                paraphrase: float = 0.5) -> Index:
    """Fit the latent space on the items (each of their pieces weighs as `heavy` passages, so that the space
    is theirs first) and on the sample; idf comes from all passages of all documents."""
    spark = docs.sparkSession
    idf = np.log((total + 1) / (frequency + 1)) + 1e-3
    pieces, owner = [], []
    for k, item in enumerate(items):
        n = -(-len(item.words) // PIECE)
        for part in np.array_split(item.words, n):
            pieces.append(feature(part))
            owner.append(k)
    heavy = 6.0
    own = spark.createDataFrame(pa.table({"features": pa.array(pieces, pa.list_(pa.int64())), "weight": pa.array(np.full(len(pieces), heavy))}))
    matrix = stored(own.unionAll(sample_passages(docs, sample_docs, sample)), "latent-sample")
    fold = (factor(matrix, idf, rank) * idf[:, None]).astype(np.float32)
    fold = np.concatenate([fold, np.zeros((1, fold.shape[1]), np.float32)])  # NONE adds nothing
    unit = np.stack([fold[p].sum(0) for p in pieces])
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    return Index(fold, items, unit.astype(np.float32), np.array(owner), cosine, verbatim, paraphrase, runs_of(items),
                 words_of(items), np.array([len(item.words) for item in items]))


def folded(words: Words, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of all passages (two steps each, one for the last of a text), their first words, texts."""
    starts, first = steps(words)
    rank = index.fold.shape[1]
    each, places = np.zeros((len(starts), rank), np.float32), np.ascontiguousarray(step_features(words, starts).T)
    held = np.empty((CHUNK, rank), np.float32)
    for lo in range(0, len(starts), CHUNK):
        own = each[lo : lo + CHUNK]
        for at in places[:, lo : lo + CHUNK]:
            own += np.take(index.fold, at, axis=0, out=held[: len(at)], mode="clip")
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    both = each.copy()
    next_in_text = np.flatnonzero(text[1:] == text[:-1])
    both[next_in_text] += each[next_in_text + 1]
    both /= np.maximum(np.linalg.norm(both, axis=1, keepdims=True), 1e-9)
    return both, starts, text


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, one machine word of `a` per bit, a step per element of `b`."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b[np.isin(b, a)].tolist():
        u = row & masks[y]
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def found_in(block: Block, index: Index) -> list[tuple[int, int, float, float, bool]]:
    """(text, item, cosine, share of the item in its common subsequence, answer found) of all verified pairs,
    the best passage of each."""
    words = block.words()
    if not len(words):
        return []
    vectors, starts, text = folded(words, index)
    best: dict[tuple[int, int], tuple[float, float, bool]] = {}

    def nearest(p: int, k: int) -> np.float32:
        return (vectors[p] @ index.pieces[index.owner == k].T).max()

    def verify(p: int, k: int, cosine: float | None) -> None:
        t, s, item = int(text[p]), starts[p], index.items[k]
        known = best.get((t, k))
        if known is not None and known[1] == 1:  # only a nearer passage could take the place of one that holds the whole item
            cosine = nearest(p, k) if cosine is None else cosine
            if float(cosine) <= known[0]:
                return
        around = len(item.words)
        region = words.hash[max(words.bounds[t], s - around) : min(words.bounds[t + 1], s + 2 * STRIDE + around)]
        if sum(map(item.known.__contains__, region.tolist())) < index.paraphrase * len(item.words):
            return
        share = common_subsequence(item.words, region) / len(item.words)
        if share < index.paraphrase:
            return
        answer = common_subsequence(item.answer, region) >= 0.8 * len(item.answer)
        if share >= index.verbatim or answer:
            if cosine is None:
                cosine = nearest(p, k)
            if known is None or (share, cosine) > (known[1], known[0]):
                best[t, k] = (float(cosine), share, bool(answer))

    for lo in range(0, len(vectors), 4_096):
        near = vectors[lo : lo + 4_096] @ index.pieces.T
        for p, piece in zip(*np.nonzero(near >= index.cosine)):
            t, k, s = int(text[lo + p]), int(index.owner[piece]), starts[lo + p]
            item = index.items[k]
            own = words.hash[s : min(s + 2 * STRIDE, words.bounds[t + 1])].tolist()
            if sum(map(item.known.__contains__, own)) >= 0.4 * min(len(own), len(item.words)):
                verify(lo + p, k, near[p, piece])
    for p, k in sharing_runs(words, starts, text, index):
        verify(p, k, None)
    return [(t, k, *v) for (t, k), v in sorted(best.items())]


def indexes(docs: DataFrame, benchmark: DataFrame, answer_words: int = 5, **options) -> Iterator[Broadcast]:
    """One index per block of items; idf is computed once, over all documents."""
    frequency = None
    for items in read_items(benchmark, answer_words):
        if frequency is None:
            frequency, total = passage_frequencies(docs)
        yield docs.sparkSession.sparkContext.broadcast(build_index(docs, items, frequency, total, **options))


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per row of `docs` and item found in it: doc_id, item_id, cosine, lcs_share, answer_found.

    Null and empty texts and items without words hold and give nothing; repeated rows are judged one by one;
    items with the same text are all reported; other columns are not read.
    """
    kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {kind}, item_id {item_kind}, cosine double, lcs_share double, answer_found boolean"
    out = docs.sparkSession.createDataFrame([], schema)
    for sent in indexes(docs, benchmark, **options):
        def search(batches, sent=sent):
            for batch in batches:
                for block in blocks(batch.column("text")):
                    found = found_in(block, sent.value)
                    rows = batch.column("doc_id").take(pa.array([block.lo + f[0] for f in found], pa.int64()))
                    item = pa.array([sent.value.items[f[1]].item_id for f in found])
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [rows, item, *(pa.array([f[i] for f in found]) for i in (2, 3, 4))],
                            names=["doc_id", "item_id", "cosine", "lcs_share", "answer_found"])

        out = out.unionAll(map_batches(docs.select("doc_id", "text"), search, schema))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no item; no shuffle of texts."""
    for sent in indexes(docs, benchmark, **options):
        def keep(batches, sent=sent):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for block in blocks(batch.column("text")):
                    clean[[block.lo + f[0] for f in found_in(block, sent.value)]] = False
                yield batch.filter(pa.array(clean))

        docs = map_batches(docs, keep, docs.schema)
    return docs
