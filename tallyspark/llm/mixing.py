"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Documents fall into cells (source, language, topic). The tokens of the cells are raked until the shares of
every source, language and topic equal the targets, no cell above what it has (each document is kept at most
once); a document is then kept with a probability that turns its cell's tokens into the raked ones. The targets name the values they know and give the rest to `OTHER`, so the
number of cells is set by the targets, not by the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import let

OTHER = "other"
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Targets:
    """Share of the tokens that each value should have; `topics` maps a topic to what its texts are rich in."""

    source: dict[str, float]
    lang: dict[str, float]
    topic: dict[str, float]
    topics: dict[str, str]
    kept: float = 0.6  # tokens of the sample, as a share of all
    rounds: int = 40


def topic_of(text: Column, topics: dict[str, str]) -> Column:
    """The topic whose string takes up most of the text, by occurrences in the lower-cased text; the first in
    name order of equals; `OTHER` if none occurs."""
    order = sorted(topics.items())

    def counts(low: Column) -> Column:
        return F.array(*[((F.length(low) - F.length(F.replace(low, F.lit(part)))) / len(part)).cast("bigint") for _, part in order])

    def first(found: Column) -> Column:
        names = F.array(*[F.lit(name) for name, _ in order])
        return F.when(F.array_max(found) > 0, F.element_at(names, F.array_position(found, F.array_max(found)).cast("int"))).otherwise(OTHER)

    return let(F.lower(text), lambda low: let(counts(low), first))  # a text is lowered and searched once


def known(value: Column, targets: dict[str, float]) -> Column:
    """The value if the targets name it, else OTHER; null too."""
    return F.when(value.isin(*(k for k in targets if k != OTHER)), value).otherwise(OTHER)


def celled(docs: DataFrame, targets: Targets) -> DataFrame:
    """`docs` with __source, __lang, __topic and __tokens (words; 0 for null and empty texts)."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({
        "__source": known(F.col("source"), targets.source), "__lang": known(F.col("lang"), targets.lang),
        "__topic": topic_of(text, targets.topics), "__tokens": F.regexp_count(text, F.lit(WORD)).cast("bigint")})


def rake(tokens: np.ndarray, targets: list[np.ndarray], kept: float, rounds: int) -> np.ndarray:
    """Cell weights, of sum 1, whose marginals approach the targets, while `kept` times all tokens at these
    weights asks no cell for more than it has. Targets of values without tokens are left out and the others
    scaled up; targets that the tokens cannot meet are met as far as the limits allow."""
    share = tokens / max(tokens.sum(), 1)
    w, axes = share, range(tokens.ndim)
    for _ in range(rounds):
        for axis, target in zip(axes, targets):
            has = w.sum(tuple(a for a in axes if a != axis))
            goal = np.where(has > 0, target, 0)
            goal = goal / max(goal.sum(), 1e-300)
            factor = np.divide(goal, has, out=np.zeros_like(goal), where=has > 0)
            w = w * factor.reshape([-1 if a == axis else 1 for a in axes])
        w = np.minimum(w, share / kept)
    return w


def cell_rates(docs: DataFrame, targets: Targets) -> DataFrame:
    """source, lang, topic, tokens, weight (raked share of tokens) and rate (probability to keep a document)
    of every cell with tokens."""
    spark = docs.sparkSession
    sums = celled(docs, targets).groupBy("__source", "__lang", "__topic").agg(F.sum("__tokens").alias("tokens"))
    rows = sums.collect()  # at most one row per combination of the targets' values
    names = [sorted({*t, OTHER}) for t in (targets.source, targets.lang, targets.topic)]
    tokens = np.zeros([len(n) for n in names])
    for r in rows:
        tokens[tuple(n.index(v) for n, v in zip(names, r[:3]))] = r.tokens
    goals = [np.array([t.get(n, 0.0) for n in ns]) for ns, t in zip(names, (targets.source, targets.lang, targets.topic))]
    weight = rake(tokens, goals, targets.kept, targets.rounds)
    rate = np.divide(weight * targets.kept * tokens.sum(), tokens, out=np.zeros_like(weight), where=tokens > 0)
    found = [(names[0][i], names[1][j], names[2][k], int(tokens[i, j, k]), float(weight[i, j, k]), float(rate[i, j, k]))
             for i, j, k in zip(*np.nonzero(tokens))]
    return spark.createDataFrame(found, "source string, lang string, topic string, tokens bigint, weight double, rate double")


def draw(doc_id: Column) -> Column:
    """A number from 0 to 1 that depends on the id alone: the first 13 hexadecimal digits of its MD5."""
    return F.conv(F.left(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(13)), 16, 10).cast("double") / float(16**13)


def weighted(docs: DataFrame, targets: Targets) -> DataFrame:
    """`docs` with __source, __lang, __topic, __tokens, __rate and __kept.

    A document without tokens has rate 1. The rates are a handful of rows that reach the plan as one literal,
    so nothing is shuffled but the cell sums.
    """
    rates = {(r.source, r.lang, r.topic): r.rate for r in cell_rates(docs, targets).collect()}
    key = F.concat_ws("\x01", "__source", "__lang", "__topic")
    table = F.create_map(*(x for k, v in sorted(rates.items()) for x in (F.lit("\x01".join(k)), F.lit(v)))) if rates else None
    rate = F.lit(1.0) if table is None else F.when(F.col("__tokens") > 0, F.coalesce(table[key], F.lit(1.0))).otherwise(1.0)
    return celled(docs, targets).withColumn("__rate", rate).withColumn("__kept", draw(F.col("doc_id")) < F.col("__rate"))


def mix(docs: DataFrame, targets: Targets) -> DataFrame:
    """The sampled rows of `docs`, with all their columns. Rows with the same id are drawn together."""
    # The rows travel whole in one column, so that no name of theirs can clash.
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), "doc_id", "text", "lang", "source")
    return weighted(rows, targets).where("__kept").select("row.*")
