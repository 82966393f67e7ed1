"""Quality rules: plain limits first, then a calibrated logistic model on hashed word and character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.blocks import AS_IS, Block, U64, Words, blocks, map_batches, mix, repeats_within, span_hashes, sums
from tallyspark.llm.training import fit_calibration, fit_logistic, labelled_sample, sigmoid

WORD_BITS, CHAR_BITS = 12, 12
SIZE = (1 << WORD_BITS) + (1 << CHAR_BITS)
# The characters counted as symbols.
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass
class Model:
    weights: np.ndarray
    shift: float
    slope: float
    base: float


def gram_ids(block: Block, words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind (words and word pairs; runs of three UTF-8 bytes): feature of each gram, and bounds by text."""
    pair_at, pair = words.windows(2)
    at = np.concatenate([np.arange(len(words)), pair_at])
    order = np.argsort(at, kind="stable")
    word = (np.concatenate([words.hash, pair])[order] >> U64(64 - WORD_BITS)).astype(np.int64)
    word_bounds = np.searchsorted(at[order], words.bounds)
    d = block.data.astype(np.uint32)
    if len(d) > 2:
        gram = ((d[:-2] << 16 | d[1:-1] << 8 | d[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - CHAR_BITS)
        inside = np.ones(len(gram), bool)
        for back in (1, 2):
            cut = block.offsets[1:-1] - back
            inside[cut[(cut >= 0) & (cut < len(gram))]] = False
        where = np.flatnonzero(inside)
        char = gram[where].astype(np.int64)
    else:
        where = char = np.zeros(0, np.int64)
    return [(word, word_bounds), (char + (1 << WORD_BITS), np.searchsorted(where, block.offsets))]


def frequencies(text_block: Block) -> np.ndarray:
    """One row per text: share of each feature among the grams of its kind."""
    out = np.zeros((text_block.n, SIZE), np.float32)
    for ids, bounds in gram_ids(text_block, text_block.words(AS_IS)):
        for i in range(text_block.n):
            own = ids[bounds[i] : bounds[i + 1]]
            if len(own):
                out[i] += np.bincount(own, minlength=SIZE) / np.float32(len(own))
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = 2_000, learn=None) -> Model:
    """Fit on at most `rows` labelled documents; a fifth of them only sets the calibration.

    Shares are divided by the root of their mean over the sample, so that frequent and rare grams weigh
    alike; the scaling is folded into the weights. Without both labels in the sample every text gets the
    sample's share of good ones.
    """
    def features(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                label = batch.column("label").to_pylist()[block.lo : block.lo + block.n]
                for row, y in zip(frequencies(block), label):
                    at = np.flatnonzero(row)
                    yield pa.RecordBatch.from_pydict(
                        {"label": pa.array([y], pa.int32()), "at": pa.array([at], pa.list_(pa.int32())),
                         "share": pa.array([row[at]], pa.list_(pa.float32()))})

    sample = labelled_sample(docs, labels, "quality", rows, learn)
    found = map_batches(sample.select("text", "label"), features, "label int, at array<int>, share array<float>").toArrow()
    y = found.column("label").to_numpy().astype(float)
    x = np.zeros((len(y), SIZE), np.float32)
    if len(y):
        at, share = (found.column(c).combine_chunks() for c in ("at", "share"))
        x[np.repeat(np.arange(len(y)), np.diff(at.offsets)), at.flatten()] = share.flatten()
    if len(np.unique(y)) < 2:
        return Model(np.zeros(SIZE), 0.0, 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    order = np.lexsort([x.sum(1), x @ np.arange(SIZE, dtype=np.float32), y])  # the sample comes in any order
    x, y = x[order], y[order]
    scale = 1 / np.sqrt(x.mean(0) + 1e-4)
    x *= scale
    test = np.arange(len(y)) % 5 == 4
    w, b = fit_logistic(x[~test], y[~test], penalty=1e-3)
    slope, base = fit_calibration(x[test] @ w + b, y[test])
    return Model((w * scale).astype(np.float64), b, slope, base)


def probabilities(block: Block, words: Words, model: Model) -> np.ndarray:
    margin = np.full(block.n, model.shift)
    for ids, bounds in gram_ids(block, words):
        margin += sums(model.weights[ids], bounds) / np.maximum(np.diff(bounds), 1)
    return sigmoid(model.slope * margin + model.base)


def rule_counts(block: Block, words: Words) -> dict[str, np.ndarray]:
    """Counts of the plain rules, per text."""
    chars = np.flatnonzero((block.data & 0xC0) != 0x80)
    per_word = np.searchsorted(chars, words.end) - np.searchsorted(chars, words.start)
    at, key = words.windows(3)
    text_of = words.texts().astype(np.uint64)
    again = at[repeats_within(mix(key + text_of[at] * U64(0xD6E8FEB86659FD93)), later_only=False)] if len(at) else at
    repeated = np.zeros(len(words), bool)
    for i in range(3):
        repeated[again + i] = True
    starts, ends, first = block.lines()
    with_word = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    line_text = np.repeat(np.arange(block.n), np.diff(first)).astype(np.uint64)
    key = mix(span_hashes(block.data, starts, ends) + line_text * U64(0xD6E8FEB86659FD93))
    kept = np.flatnonzero(with_word)
    double = np.zeros(len(starts), bool)
    double[kept[repeats_within(key[kept], later_only=True)]] = True
    return {
        "n_words": words.counts,
        "word_chars": sums(per_word, words.bounds).astype(np.int64),
        "n_symbols": block.counts(np.flatnonzero(IS_SYMBOL[block.data])),
        "n_dup_lines": sums(double, first).astype(np.int64),
        "n_repeat_words": sums(repeated, words.bounds).astype(np.int64),
    }


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: Model, threshold: float = 0.5, min_words: int = 50,
          max_repeat_percent: int = 50) -> DataFrame:
    """One row per row of `docs`: doc_id, the rule counts, base_failed, quality (0 to 1) and kept.

    Null and empty texts have no words and fail the base rules; repeated rows are judged one by one; no other
    column is read. No shuffle: each batch is scored where it is read.
    """
    def score(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                words = block.words(AS_IS)
                counts = rule_counts(block, words)
                failed = (counts["n_words"] < min_words) | (
                    100 * counts["n_repeat_words"] > max_repeat_percent * counts["n_words"])
                quality = probabilities(block, words, model)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id").slice(block.lo, block.n)}
                    | {k: pa.array(counts[k].astype(np.int64)) for k in COLUMNS}
                    | {"base_failed": pa.array(failed), "quality": pa.array(quality),
                       "kept": pa.array(~failed & (quality >= threshold))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.col("text")), score, f"doc_id {kind}, "
                       + ", ".join(f"{k} bigint" for k in COLUMNS)
                       + ", base_failed boolean, quality double, kept boolean")
