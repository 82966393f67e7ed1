"""Sentence-span de-duplication: remove sentences that lie in a run of sentences seen earlier.

A sentence ends with a word that ends in . ! or ? or stands last in its line. Where eight words follow each other
without such an end, one also ends after the word of the eight with the least hash. So any eight words hold an end
that they alone decide, and any 50 words, whatever stands around them, an end in their first eight, one in their last
eight and none further apart than eight between them, which nothing outside changes: at least three whole sentences
of 30 words or more together. From every sentence on, and up to every sentence, the shortest run of at least three
sentences and 30 words is a span; shorter phrases may repeat. The first document with a span, by id, keeps it; in all
others, and where it comes again in the same document, the span's sentences go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.blocks import STEP, U64, Block, Words, blocks, map_batches, mix, repeats_within
from tallyspark.session import stored

SENTENCES, MIN_WORDS, WINDOW = 3, 30, 8
BACK = U64(pow(int(STEP), -1, 2**64))
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?"]] = True


def sentences(block: Block) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words; the first word of each sentence, with the number of words last; first sentence of each text."""
    words = block.words()
    n = len(words)
    if not n:
        return words, np.zeros(1, np.int64), np.zeros(block.n + 1, np.int64)
    feeds = np.flatnonzero(block.data == 10)
    upto = np.searchsorted(feeds, words.start)
    last = ENDS[block.data[words.end - 1]]
    last[:-1] |= upto[1:] > upto[:-1]
    inner = words.bounds[1:][words.bounds[1:] > 0]
    last[inner - 1] = True
    last |= least_of_unmarked(words.hash, last)
    starts = np.concatenate([[0], np.flatnonzero(last) + 1])
    return words, starts, np.searchsorted(starts[:-1], words.bounds)


def least_of_unmarked(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Marks the word with the least hash, the first of equal ones, of every WINDOW words that hold no end."""
    least = np.zeros(len(h), bool)
    if len(h) >= WINDOW:
        upto = np.concatenate([[0], np.cumsum(last)])
        at = np.flatnonzero(upto[WINDOW:] == upto[:-WINDOW])
        least[at + np.lib.stride_tricks.sliding_window_view(h, WINDOW)[at].argmin(1)] = True
    return least


def spans(words: Words, starts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, sentence after the last, hash and text of every span."""
    n = len(starts) - 1
    if n < SENTENCES:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    size = np.diff(starts)
    within = np.arange(len(words)) - np.repeat(starts[:-1], size)
    power = np.cumprod(np.concatenate([[U64(1)], np.full(max(n, int(size.max())), STEP)]))
    back = np.cumprod(np.concatenate([[U64(1)], np.full(n, BACK)]))
    each = mix(np.add.reduceat(words.hash * power[within], starts[:-1]) + size.astype(np.uint64))
    upto = np.concatenate([[U64(0)], np.cumsum(each * power[:n])])
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    i = np.arange(n)
    ahead = np.stack([i, np.maximum(i + SENTENCES, np.searchsorted(starts, starts[:-1] + MIN_WORDS))])
    behind = np.stack([np.minimum(i + 1 - SENTENCES, np.searchsorted(starts, starts[1:] - MIN_WORDS, "right") - 1), i + 1])
    ahead = ahead[:, ahead[1] <= bounds[text + 1]]
    behind = behind[:, behind[0] >= bounds[text]]
    both = np.unique(np.concatenate([ahead[0] * (n + 1) + ahead[1], behind[0] * (n + 1) + behind[1]]))
    at, end = both // (n + 1), both % (n + 1)
    return at, end, mix((upto[end] - upto[at]) * back[at] + (end - at).astype(np.uint64)), text[at]


def span_rows(docs: DataFrame) -> DataFrame:
    """span, place and size (in sentences), key (id of the document, or the largest number) and tie (hash of
    the text) of every span's first occurrence in its text."""
    def run(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                words, starts, bounds = sentences(block)
                at, end, h, text = spans(words, starts, bounds)
                new = ~repeats_within(mix(h + text.astype(np.uint64) * U64(0xD6E8FEB86659FD93)), later_only=True)
                at, end, h, text = at[new], end[new], h[new], text[new]
                rows = pa.array(block.lo + text)
                yield pa.RecordBatch.from_pydict({
                    "span": pa.array(h.view(np.int64)), "place": pa.array((at - bounds[text]).astype(np.int32)),
                    "size": pa.array((end - at).astype(np.int32)), **{c: batch.column(c).take(rows) for c in ("key", "tie")}})

    return map_batches(keyed(docs).select("key", "tie", "text"), run, "span bigint, place int, size int, key bigint, tie bigint")


def keyed(docs: DataFrame) -> DataFrame:
    """Only the columns needed; ids are whole numbers, rows without one count as one last document."""
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(2**63 - 1)).alias("key"),
                       F.xxhash64("text").alias("tie"), "text")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, text without repeated sentences, n_sentences, n_removed and
    first_docs, the documents that keep what was removed.

    Rows with the same id count as one document and do not repeat each other. Null and empty texts stay
    empty; a text without repeats stays as it is, byte for byte. Other columns are not read.
    """
    seen = span_rows(docs).groupBy("span").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    repeated = stored(seen.where("first < last").select("span", "first"), "span-repeats")
    later = span_rows(docs).join(repeated, "span").where("key > first")
    place = F.struct("place", "size")  # a set: copies without an id share their places
    marks = stored(later.groupBy("key", "tie").agg(F.collect_set(place).alias("places"), F.collect_set("first").alias("first_docs")),
                   "span-marks")

    def cut(batches):
        for batch in batches:
            places = batch.column("places")
            for block in blocks(batch.column("text")):
                words, starts, bounds = sentences(block)
                at, end, h, text = spans(words, starts, bounds)
                again = repeats_within(mix(h + text.astype(np.uint64) * U64(0xD6E8FEB86659FD93)), later_only=True)
                own = places.slice(block.lo, block.n)
                count = pc.fill_null(pc.list_value_length(own), 0).to_numpy()
                flat = own.flatten()
                begin = np.repeat(bounds[:-1], count) + flat.field("place").to_numpy()
                change = np.zeros(len(starts), np.int64)
                np.add.at(change, np.concatenate([at[again], begin]), 1)
                np.add.at(change, np.concatenate([end[again], begin + flat.field("size").to_numpy()]), -1)
                gone = np.cumsum(change)[:-1] > 0
                texts = [_without(block, i, words, starts, bounds, gone) for i in range(block.n)]
                removed = [int(gone[bounds[i] : bounds[i + 1]].sum()) for i in range(block.n)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(block.lo, block.n), "text": pa.array(texts, pa.string()),
                    "n_sentences": pa.array(np.diff(bounds)), "n_removed": pa.array(removed, pa.int64()),
                    "first_docs": batch.column("first_docs").slice(block.lo, block.n)})

    met = keyed(docs).join(marks, ["key", "tie"], "left")
    return map_batches(met.select("doc_id", "text", "places", "first_docs"), cut,
                       "doc_id bigint, text string, n_sentences bigint, n_removed bigint, first_docs array<bigint>")


def _without(block: Block, i: int, words: Words, starts: np.ndarray, bounds: np.ndarray, gone: np.ndarray) -> str:
    lo, hi = int(block.offsets[i]), int(block.offsets[i + 1])
    drop = gone[bounds[i] : bounds[i + 1]]
    if not drop.any():
        return bytes(block.data[lo:hi]).decode()
    begin = words.start[starts[bounds[i] : bounds[i + 1]]]
    edge = np.concatenate([begin, [hi]])
    kept = [block.data[lo : begin[0]], *(block.data[edge[k] : edge[k + 1]] for k in np.flatnonzero(~drop))]
    return b"".join(bytes(p) for p in kept).decode()
