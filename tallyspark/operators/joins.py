"""Fact-to-dimension joins and the audits that tell whether they are safe."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tallyspark.session import small_frame


@dataclass(frozen=True)
class Edge:
    """A foreign key: `left` column of what is joined so far equals `right` of `table`."""

    table: DataFrame
    left: str
    right: str


def denormalize(fact: DataFrame, edges: Sequence[Edge], columns: Sequence[str] | None = None) -> DataFrame:
    """Inner equi-joins along the edges, in order.

    With `columns` given, edges that neither supply a wanted column nor lead to one are not joined,
    and only the wanted columns are kept. How each side is moved is left to the planner, which knows
    the table sizes; skewed keys are split by adaptive execution.
    """
    chosen = list(edges)
    if columns is not None:
        wanted, chosen = set(columns), []
        for edge in reversed(edges):
            if wanted & (set(edge.table.columns) - {edge.right}) or (
                edge.right in wanted and edge.right not in fact.columns
            ):
                chosen.insert(0, edge)
                wanted.add(edge.left)
    out = fact
    for edge in chosen:
        out = out.join(edge.table, out[edge.left] == edge.table[edge.right], "inner")
    return out.select(*columns) if columns is not None else out


def orphan_audit(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """One row: child rows, rows without a key, rows and distinct keys that no parent has.

    Children are counted per key before the join, so a key that holds most rows moves as one row.
    """
    per_key = child.groupBy(F.col(child_key).alias("k")).agg(F.count("*").alias("rows"))
    known = parent.select(F.col(parent_key).alias("k")).where(F.col("k").isNotNull()).distinct()
    flagged = per_key.join(known.withColumn("known", F.lit(True)), "k", "left")
    lost = F.col("k").isNotNull() & F.col("known").isNull()
    return flagged.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("child_rows"),
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("rows"))), F.lit(0)).alias("null_rows"),
        F.coalesce(F.sum(F.when(lost, F.col("rows"))), F.lit(0)).alias("orphan_rows"),
        F.count_if(lost).alias("orphan_keys"),
    ).select(F.lit(name).alias("edge"), "*")


def fanout_audit(
    parent: DataFrame, parent_key: str, measure: str, child: DataFrame, child_key: str, name: str, digits: int = 2
) -> DataFrame:
    """What joining a parent to its children does to the sum of a parent measure.

    The inflated sum is the measure times the number of matches; the fanned-out rows are never built.
    """
    matches = child.groupBy(F.col(child_key).alias("k")).agg(F.count("*").alias("matches"))
    m = F.coalesce("matches", F.lit(0))
    x = F.col(measure).cast("double")
    joined = parent.select(F.col(parent_key).alias("k"), x.alias("x")).join(matches, "k", "left")
    out = joined.agg(
        F.count("*").alias("parent_rows"), F.sum(m).alias("joined_rows"), F.max(m).alias("max_matches"),
        F.sum("x").alias("before"), F.sum(F.col("x") * m).alias("after"),
    )
    return out.select(
        F.lit(name).alias("edge"), "parent_rows", "joined_rows", "max_matches",
        F.round("before", digits).alias("sum_before"), F.round("after", digits).alias("sum_after"),
        (F.col("max_matches") > 1).alias("fans_out"),
    )


# --- words of a text column against a vocabulary ------------------------------------------------

# Canonical business terms and the words that mean the same.
SYNONYMS = {
    "customer": ("client", "buyer", "consumer", "purchaser", "account"),
    "product": ("item", "article", "merchandise", "sku", "part", "good"),
    "order": ("sale", "transaction", "purchase", "invoice", "booking"),
    "sale": ("order", "transaction", "purchase", "invoice", "deal"),
    "employee": ("staff", "person", "worker", "associate", "user", "member"),
    "store": ("branch", "outlet", "shop", "location", "site", "warehouse"),
    "shipper": ("shipping", "carrier", "courier", "delivery", "freight", "logistics"),
    "brand": ("make", "manufacturer", "vendor", "label", "supplier"),
    "category": ("group", "department", "segment", "class", "type", "division"),
    "quantity": ("qty", "units", "volume", "amount"),
    "price": ("cost", "amount", "value", "rate", "fee"),
    "revenue": ("sales", "income", "turnover", "gross", "earnings"),
    "status": ("state", "stage", "condition", "phase", "position"),
    "year": ("yr", "model_year", "manufacture_year", "production_year", "calendar_year"),
    "month": ("mth", "period", "month_name"),
    "date": ("date", "day", "timestamp", "created", "datetime", "time"),
}


def text_tokens(text: Column, only: Sequence[str]) -> Column:
    """Distinct lower-case words among `only`; a snake-case word also gives its parts."""
    low = F.lower(text)
    snake = F.filter(F.split(low, "[^a-z0-9_]+"), lambda w: w.contains("_"))
    return F.array_distinct(F.filter(F.concat(F.split(low, "[^a-z0-9]+"), snake), lambda w: w.isin(*only)))


def term_grounding(df: DataFrame, key: str, text: str, synonyms: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """How many words of each text mean a canonical term, by synonym, singular or plural.

    The vocabulary is a fixed small table, so the planner ships it to the tokens; texts are not shuffled
    before they are reduced to their matches.
    """
    synonyms = synonyms or SYNONYMS
    pairs = surface_words(synonyms)
    vocabulary = small_frame(df.sparkSession, pairs, "term string, word string")
    known = sorted({word for _, word in pairs})
    return (
        df.select(key, F.explode(text_tokens(F.col(text), known)).alias("word")).join(vocabulary, "word")
        .groupBy(key, "term").agg(F.count("*").alias("score"))
    )


def surface_words(synonyms: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """(term, word) for each word that means a term: its synonyms, themselves and with plural endings."""
    out = set()
    for term, group in synonyms.items():
        for form in {term, *group}:
            out |= {(term, form), (term, form + "s"), (term, form + "ss")}
            if form.endswith("y") and len(form) > 2:
                out.add((term, form[:-1] + "ies"))
    return sorted(out)


def vocabulary_counts(df: DataFrame, text: str) -> DataFrame:
    """Distinct alphabetic words of a text column with the number of texts they are in."""
    whole = F.array_distinct(F.split(F.lower(text), "[^a-z0-9_]+"))
    return df.select(F.explode(F.filter(whole, lambda w: w.rlike("^[a-z]+$"))).alias("word")).groupBy("word").agg(F.count("*").alias("texts"))


def fuzzy_vocab_join(tokens: DataFrame, vocabulary: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Best vocabulary word for every token the vocabulary lacks.

    `tokens` and `vocabulary` have a column `word`. A match shares the first two letters and has an
    edit similarity `1 - distance / longer length` of at least `threshold`; known words and their
    plain plurals or singulars need no correction. Candidates must agree in one segment of the rest
    of the word: with at most d edits, one of d + 1 segments survives unchanged and moves by at most
    d places. That is exact, and no pair is built only because two words share a prefix.
    """
    slack = 1.0 - threshold
    vocab = vocabulary.select(F.lower("word").alias("match")).where(F.length("match") >= 2).distinct()
    known = vocab.select(F.col("match").alias("word"))
    known = known.union(known.select(F.concat("word", F.lit("s")))).union(
        vocab.where(F.col("match").endswith("s")).select(F.expr("left(match, length(match) - 1)"))
    ).distinct()
    open_words = (
        tokens.select(F.lower("word").alias("word")).where(F.length("word") >= 2).distinct()
        .join(known, "word", "left_anti")
        # A word is few bytes but grows into dozens of probes, so words are spread over all cores.
        .repartition(tokens.sparkSession.sparkContext.defaultParallelism, "word")
    )

    # Edits allowed when the longer word has length n: floor(n * slack), guarded against 0.999999.
    def edits(longer: str) -> str:
        return f"cast(floor({longer} * {slack} + 1e-9) as int)"

    # Vocabulary side: for every longer length n the pair may have, the segments of the rest.
    lengths = f"sequence(length(match), cast(floor(length(match) / {threshold} + 1e-9) as int))"
    segments = (
        vocab.select("match", F.expr(f"explode({lengths})").alias("n"))
        .withColumn("d", F.expr(edits("n")))
        .select("match", "n", "d", F.expr("explode(sequence(0, d))").alias("i"))
        .withColumn("rest", F.expr("length(match) - 2"))
        .withColumn("from", F.expr("cast(floor(i * rest / (d + 1)) as int)"))
        .withColumn("upto", F.expr("cast(floor((i + 1) * rest / (d + 1)) as int)"))
        .select("match", "n", F.expr("left(match, 2)").alias("head"), "rest", "i",
                F.expr("substring(match, 3 + from, upto - from)").alias("piece"))
    )
    # Token side: the same cuts for each possible vocabulary length, at every shift up to d.
    shorter = f"sequence(greatest(2, cast(ceil(length(word) * {threshold} - 1e-9) as int)), " \
              f"cast(floor(length(word) / {threshold} + 1e-9) as int))"
    probes = (
        open_words.select("word", F.expr(f"explode({shorter})").alias("other"))
        .withColumn("n", F.expr("greatest(length(word), other)"))
        .withColumn("d", F.expr(edits("n")))
        .where("abs(length(word) - other) <= d")
        .withColumn("rest", F.expr("other - 2"))
        .select("*", F.expr("explode(sequence(0, d))").alias("i"))
        .withColumn("from", F.expr("cast(floor(i * rest / (d + 1)) as int)"))
        .withColumn("size", F.expr("cast(floor((i + 1) * rest / (d + 1)) as int) - from"))
        .select("*", F.expr("explode(sequence(-d, d))").alias("shift"))
        .where("from + shift >= 0 and from + shift + size <= length(word) - 2")
        .select("word", "n", F.expr("left(word, 2)").alias("head"), "rest", "i",
                F.expr("substring(word, 3 + from + shift, size)").alias("piece"))
    )
    pairs = probes.join(segments, ["n", "head", "rest", "i", "piece"]).select("word", "match").distinct()
    longer = F.greatest(F.length("word"), F.length("match"))
    scored = pairs.withColumn("similarity", 1 - F.levenshtein("word", "match") / longer)
    # Highest similarity, then the alphabetically first word: a plain aggregate, no window over a group.
    best = F.min_by("match", F.struct(-F.col("similarity"), F.col("match")))
    return (
        scored.where(F.col("similarity") >= threshold - 1e-9).groupBy("word")
        .agg(best.alias("match"), F.max("similarity").alias("similarity"))
        .select("word", "match", F.round("similarity", 4).alias("similarity"))
    )
