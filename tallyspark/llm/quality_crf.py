"""Line quality by a linear-chain conditional random field, and document quality from its marginals.

Each line of a text is good or bad. A line's potential looks at its own features and at those of the lines
before and after it; transitions tie neighbours together. A document's quality is the mean marginal of
"good" over its lines, weighted by their lengths, turned into a probability by a logistic curve.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.blocks import Block, U64, blocks, map_batches, mix, repeats_within, span_hashes, sums
from tallyspark.llm.training import fit_calibration, fit_logistic, labelled_sample, sigmoid
from tallyspark.session import stored


def _set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


UPPER, LOWER, DIGIT = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _set("abcdefghijklmnopqrstuvwxyz"), _set("0123456789")
SYMBOL, SHOUT, POINT, STOP = _set("#*$%&|<>@^_=~\\{}[]+/"), _set("!?"), _set(",.;:'\"()-"), _set(".!?:")
OWN = 12  # features of one line
WIDTH = 3 * OWN


@dataclass
class Model:
    weights: np.ndarray  # of the potential of "good"; "bad" is 0
    shift: float
    step: np.ndarray  # 2 x 2 log potentials of (state before, state)
    slope: float
    base: float
    empty: float  # score of a text without characters
    fitted: bool = True


class Lines:
    """The lines of a block; their features are made slice by slice, so that a text of line feeds alone takes no
    more memory than a few numbers a line."""

    def __init__(self, block: Block):
        self.data = block.data
        self.starts, self.ends, self.first = block.lines()
        self.words = block.words().start
        self.begins = np.zeros(len(self.starts) + 1, bool)  # of a text; and the end of the last one
        self.begins[self.first] = True
        full = np.unique(np.searchsorted(self.starts, self.words, "right") - 1)
        text_of = (np.searchsorted(self.first, full, "right") - 1).astype(np.uint64)
        key = mix(span_hashes(self.data, self.starts[full], self.ends[full]) + text_of * U64(0xD6E8FEB86659FD93))
        self.double = np.zeros(len(self.starts), bool)
        self.double[full[repeats_within(key, later_only=True)]] = True

    def own(self, lo: int, hi: int) -> np.ndarray:
        """Features of the lines lo..hi by themselves."""
        starts, ends = self.starts[lo:hi], self.ends[lo:hi]
        base = int(starts[0]) if len(starts) else 0
        d = self.data[base : int(ends[-1])] if len(starts) else self.data[:0]
        length = ends - starts
        n_words = np.searchsorted(self.words, ends) - np.searchsorted(self.words, starts)

        def per(table: np.ndarray) -> np.ndarray:
            at = np.flatnonzero(table[d]) + base
            return np.searchsorted(at, ends) - np.searchsorted(at, starts)

        letters = np.maximum(per(UPPER) + per(LOWER), 1)
        size, some = np.maximum(length, 1), np.maximum(n_words, 1)
        last = np.zeros(len(starts), bool)
        ok = length > 0
        last[ok] = STOP[self.data[ends[ok] - 1]]
        return np.stack([
            np.log1p(length) / 6, np.log1p(n_words) / 4, per(UPPER) / letters, np.minimum(per(SYMBOL) / some, 2),
            np.minimum(per(SHOUT) / some, 2), per(DIGIT) / size, np.minimum(per(POINT) / some, 2), per(np.arange(256) > 127) / size,
            np.minimum(length / some, 30) / 10, last, self.double[lo:hi], length == 0], 1).astype(np.float32)

    def features(self, lo: int, hi: int) -> np.ndarray:
        """Features of the lines lo..hi, then those of the lines before and after them in the same text."""
        before, after = max(lo - 1, 0), min(hi + 1, len(self.starts))
        own = self.own(before, after)
        out = np.zeros((hi - lo, WIDTH), np.float32)
        out[:, :OWN] = own[lo - before : hi - before]
        at = np.flatnonzero(~self.begins[lo:hi])
        out[at, OWN : 2 * OWN] = own[at + lo - before - 1]
        at = np.flatnonzero(~self.begins[lo + 1 : hi + 1])
        out[at, 2 * OWN :] = own[at + lo - before + 1]
        return out

    def scores(self, weights: np.ndarray, shift: float) -> np.ndarray:
        """Potentials of "good" of all lines."""
        out = np.empty(len(self.starts))
        for lo in range(0, len(out), GROUP):
            hi = min(lo + GROUP, len(out))
            out[lo:hi] = self.features(lo, hi).astype(np.float64) @ weights + shift
        return out


def line_features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with their neighbours', line lengths in bytes, and the first line of each text."""
    lines = Lines(block)
    return lines.features(0, len(lines.starts)), lines.ends - lines.starts, lines.first


PIECE, GROUP = 256, 1 << 16  # lines of a piece of a chain, lines that are worked on at a time


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(v.sum(-1, keepdims=True), 1e-300)


class Pieces:
    """Pieces of chains, longest first, so that step t touches only those that still run."""

    def __init__(self, score: np.ndarray, start: np.ndarray, size: np.ndarray, head: np.ndarray, move: np.ndarray):
        self.size, self.head, self.move = size, head, move
        self.at = np.cumsum(size) - size
        self.lines = np.repeat(start - self.at, size) + np.arange(int(size.sum()))
        own = score[self.lines]
        top = np.maximum(own, 0)
        self.node = np.exp(np.stack([-top, own - top], 1))
        self.running = np.searchsorted(-size, -np.arange(int(size[0])), side="left")

    def products(self) -> np.ndarray:
        """Per piece the product of its steps, up to a factor: what takes the message before it to its last line."""
        out = np.tile(np.eye(2), (len(self.size), 1, 1))
        for t, n in enumerate(self.running):
            step = out[:n] @ self.move
            if t == 0:
                step[self.head] = np.eye(2)
            step *= self.node[self.at[:n] + t][:, None, :]
            out[:n] = step / np.maximum(step.sum((1, 2), keepdims=True), 1e-300)
        return out

    def marginals(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line and the sum of the pair marginals, from the messages that reach the pieces."""
        ahead, back = np.empty_like(self.node), np.empty_like(self.node)
        entry = np.empty_like(self.node)  # the message from the line before
        for t, n in enumerate(self.running):
            at = self.at[:n] + t
            entry[at] = before if t == 0 else ahead[at - 1]
            a = entry[at] @ self.move
            if t == 0:
                a[self.head] = 1.0
            ahead[at] = _unit(a * self.node[at])
        back[self.at + self.size - 1] = after
        for t in range(len(self.running) - 2, -1, -1):
            at = self.at[: self.running[t + 1]] + t
            back[at] = _unit((self.node[at + 1] * back[at + 1]) @ self.move.T)
        both = ahead * back
        inner = np.ones(len(both), bool)
        inner[self.at[self.head]] = False
        pair = entry[inner][:, :, None] * self.move[None] * (self.node[inner] * back[inner])[:, None, :]
        pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)
        return both[:, 1] / np.maximum(both.sum(1), 1e-300), pair.sum(0)


def chains(score: np.ndarray, first: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once: P(good) of each line, and the expected number of each
    (state before, state) pair.

    Long chains are cut into pieces: products of 2 x 2 matrices take the messages over whole pieces, then all pieces
    are worked on side by side. So a chain of n lines takes n / PIECE steps in a row, not n.
    """
    good, pairs = np.zeros(len(score)), np.zeros((2, 2))
    move = np.exp(step - step.max())
    count = -(-np.diff(first) // PIECE)
    chain_first = np.concatenate([[0], np.cumsum(count)])
    if not chain_first[-1]:
        return good, pairs
    within = np.arange(chain_first[-1]) - np.repeat(chain_first[:-1], count)
    start = np.repeat(first[:-1], count) + within * PIECE
    size = np.minimum(PIECE, np.repeat(first[1:], count) - start)
    before, after = np.ones((len(start), 2)), np.ones((len(start), 2))

    def groups(of: np.ndarray):
        order = of[np.argsort(-size[of], kind="stable")]
        lot = np.cumsum(size[order]) // GROUP
        for part in np.split(order, np.flatnonzero(np.diff(lot)) + 1):
            if len(part):
                yield part, Pieces(score, start[part], size[part], within[part] == 0, move)

    several = np.flatnonzero(np.repeat(count, count) > 1)
    if len(several):
        product = np.zeros((len(start), 2, 2))
        for part, pieces in groups(several):
            product[part] = pieces.products()
        long = np.flatnonzero(count > 1)
        long = long[np.argsort(-count[long], kind="stable")]
        most = count[long]
        for j in range(1, int(most[0])):
            own = chain_first[long[: np.searchsorted(-most, -j, side="left")]]
            p = own + j
            before[p] = _unit((before[p - 1][:, None, :] @ product[p - 1])[:, 0])
            p = chain_first[long[: len(own)] + 1] - 1 - j
            after[p] = _unit((product[p + 1] @ after[p + 1][:, :, None])[:, :, 0])
    for part, pieces in groups(np.arange(len(start))):
        good[pieces.lines], own = pieces.marginals(before[part], after[part])
        pairs += own
    return good, pairs


def fit_chain(x: np.ndarray, state: np.ndarray, first: np.ndarray, weight: np.ndarray, shift: float,
              steps: int = 120, rate: float = 0.05, penalty: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """Potentials that maximise the likelihood of the line states: observed minus expected counts, Adam steps."""
    begins = np.zeros(len(x) + 1, bool)
    begins[first] = True
    at = np.flatnonzero(~begins[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[at - 1], state[at]), 1)
    theta = np.concatenate([weight, [shift], np.zeros(4)]).astype(float)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    n = max(len(x), 1)
    for k in range(1, steps + 1):
        good, pairs = chains(x @ theta[:-5] + theta[-5], first, theta[-4:].reshape(2, 2))
        miss = state - good
        g = np.concatenate([x.T @ miss, [miss.sum()], (seen - pairs).ravel()]) / n - penalty * theta
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        theta = theta + rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2)


def train(docs: DataFrame, labels: DataFrame, rows: int = 2_000, lines: int = 200_000, learn=None) -> Model:
    """Fit on at most `rows` labelled documents, with at most `lines` lines among them (in order of a hash of
    the id, whole documents only; one that does not fit is left out and the next is tried).

    Labels are those of documents. Lines of good documents count as good. A line model fitted on the
    inherited labels decides which lines of bad documents are bad, at least the worst of each; the chain
    learns from those states. A fifth of the documents only sets the final curve.
    """
    def features(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                x, length, first = line_features(block)
                for i in range(block.n):
                    own = slice(first[i], first[i + 1])
                    if first[i + 1] - first[i] > lines:
                        continue
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": batch.column("doc_id").slice(block.lo + i, 1).cast(pa.string()),
                        "label": batch.column("label").slice(block.lo + i, 1),
                        "n": pa.array([int(first[i + 1] - first[i])], pa.int64()),
                        "x": pa.array([x[own].tobytes()], pa.binary()),
                        "length": pa.array([length[own].astype(np.int64).tobytes()], pa.binary())})

    sample = labelled_sample(docs, labels, "quality", rows, learn)

    found = stored(map_batches(sample.select("doc_id", "text", "label"), features,
                               "doc_id string, label int, n bigint, x binary, length binary"), "crf-lines")
    order = [F.xxhash64("doc_id"), "doc_id", "n"]
    left_out, held = [], 0
    for row in found.select("doc_id", "n").orderBy(*order).collect():
        if held + row.n <= lines:
            held += row.n
        else:
            left_out.append(row.doc_id)
    found = found.where(~F.col("doc_id").isin(left_out)).orderBy(*order).toArrow()
    y = found.column("label").to_numpy().astype(int)
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(WIDTH), 0.0, np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))), float(share), fitted=False)
    x = np.concatenate([np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in found.column("x").to_pylist()])
    length = np.concatenate([np.frombuffer(b, np.int64) for b in found.column("length").to_pylist()])
    first = np.concatenate([[0], np.cumsum(found.column("n").to_numpy())])
    doc = np.repeat(np.arange(len(y)), np.diff(first))
    fit = (np.arange(len(y)) % 5 != 4)[doc]
    inherited = y[doc]
    share = np.where(inherited == 1, 0.5 / max(inherited.sum(), 1), 0.5 / max((1 - inherited).sum(), 1))
    w, b = fit_logistic(x[fit].astype(np.float64), inherited[fit], share[fit], penalty=1e-4, steps=400)
    line = x @ w + b
    worst = np.full(len(y), np.inf)
    np.minimum.at(worst, doc, line)
    state = np.where(inherited == 1, 1, (line > 0) & (line > worst[doc])).astype(int)
    kept = np.flatnonzero(np.arange(len(y)) % 5 != 4)
    fit_first = np.concatenate([[0], np.cumsum(np.diff(first)[kept])])
    w, b, step = fit_chain(x[fit].astype(np.float64), state[fit], fit_first, w, b)
    model = Model(w, b, step, 1.0, 0.0, float((y.sum() + 1) / (len(y) + 2)))
    raw = aggregate(x.astype(np.float64) @ w + b, length, first, model)
    test = np.arange(len(y)) % 5 == 4
    model.slope, model.base = fit_calibration(raw[test], y[test])
    return model


def aggregate(score: np.ndarray, length: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """Length-weighted mean of P(good) per text; 0 where there are no characters."""
    good, _ = chains(score, first, model.step)
    return sums(good * length, first) / np.maximum(sums(length.astype(float), first), 1)


def scores(block: Block, model: Model) -> np.ndarray:
    lines = Lines(block)
    raw = aggregate(lines.scores(model.weights, model.shift), lines.ends - lines.starts, lines.first, model)
    out = sigmoid(model.slope * raw + model.base)
    return np.where(np.diff(block.offsets) > 0, out, model.empty)


def passes(p: np.ndarray, model: Model, threshold: float) -> np.ndarray:
    """Which scores reach the threshold; all, where the labels gave no model that could tell texts apart."""
    return (p >= threshold) | (not model.fitted)


def judge(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (1 from `threshold` on) of every row. Null and empty texts get the share of
    good documents in the sample; repeated rows are scored one by one; no other column is read."""
    def score(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                p = scores(block, model)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(block.lo, block.n), "score": pa.array(p),
                    "predicted": pa.array((p >= threshold).astype(np.int32))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), score, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` whose score reaches `threshold`, with all their columns and no shuffle."""
    def keep(batches):
        for batch in batches:
            good = [passes(scores(b, model), model, threshold) for b in blocks(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate(good))) if good else batch

    return map_batches(docs, keep, docs.schema)
