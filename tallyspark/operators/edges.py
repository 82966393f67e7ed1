"""Work on relationship rows: merging, checking, grading, comparing, drift.

An edge table has source_table, source_column, target_table, target_column; these tables have one row
per relationship, so they stay small however large the data is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tallyspark.session import small_frame

EDGE = ["source_table", "source_column", "target_table", "target_column"]


def edge_rows(spark, edges: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    return small_frame(spark, list(edges), ", ".join(f"{c} string" for c in EDGE))


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (table, column, ordinal, data_type) of the tables' schemas."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (t, f.name, i, f.dataType.simpleString())
        for t, df in tables.items() for i, f in enumerate(df.schema.fields, start=1)
    ]
    return small_frame(spark, rows, "table string, column string, ordinal int, data_type string")


def canonical_edges(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """Edges whose both ends exist in the catalog, each once."""
    ends = columns.select("table", "column").distinct()
    for side in ("source", "target"):
        ends_side = ends.select(F.col("table").alias(f"{side}_table"), F.col("column").alias(f"{side}_column"))
        edges = edges.join(ends_side, [f"{side}_table", f"{side}_column"], "left_semi")
    return edges.dropDuplicates(EDGE)


def merged_edges(declared: DataFrame, inferred: DataFrame, columns: DataFrame) -> DataFrame:
    """Declared and inferred edges in one table; a declared edge wins; `known` tells if both ends exist."""
    d = declared.select(*EDGE, F.lit("declared").alias("type"), F.lit(None).cast("double").alias("score"))
    i = inferred.select(*EDGE, F.lit("inferred").alias("type"), F.col("score").cast("double"))
    both = d.unionByName(i).groupBy(*EDGE).agg(F.min("type").alias("type"), F.max("score").alias("score"))
    known = canonical_edges(both, columns).select(*EDGE, F.lit(True).alias("known"))
    return both.join(known, EDGE, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def trust(kind: Column, confidence: Column) -> Column:
    """Trust of an edge; numeric confidence may be 0..1 or 0..100, labels are read for what they say."""
    label = F.lower(confidence.cast("string"))
    value = F.coalesce(
        label.try_cast("double"),
        F.when(label.contains("confirm") | label.contains("high"), 1.0)
        .when(label.contains("reason") | label.contains("medium"), 0.7).otherwise(0.0),
    )
    share = F.when(value > 1, value / 100).otherwise(value)
    return (
        F.when(kind == "declared", "DECLARED").when(share >= 0.8, "HIGH_CONFIDENCE_INFERRED")
        .when(share >= 0.6, "MEDIUM_CONFIDENCE_INFERRED").otherwise("LOW_CONFIDENCE_INFERRED")
    )


def edge_trust(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Trust and join direction kind per edge; `keys` has (table, column) of key columns."""
    is_key = keys.select(
        F.col("table").alias("target_table"), F.col("column").alias("target_column"), F.lit(True).alias("key")).distinct()
    return edges.join(is_key, ["target_table", "target_column"], "left").select(
        *EDGE, "type", trust(F.col("type"), F.col("score").cast("string")).alias("trust"),
        F.when(F.col("key"), "many_to_one").otherwise("many_to_many").alias("cardinality"),
    )


def both_directions(edges: DataFrame) -> DataFrame:
    """Neighbour rows (table, neighbour), each edge walked both ways."""
    there = edges.select(F.col("source_table").alias("table"), F.col("target_table").alias("neighbour"))
    back = edges.select(F.col("target_table").alias("table"), F.col("source_table").alias("neighbour"))
    return there.unionByName(back).distinct()


def edge_lists(edges: DataFrame) -> DataFrame:
    """Per table: what it refers to and what refers to it."""
    def side(table: str, arrow: Column, name: str) -> DataFrame:
        return edges.groupBy(F.col(table).alias("table")).agg(
            F.array_join(F.array_sort(F.collect_set(arrow)), "; ").alias(name))

    out = side("source_table", F.format_string("%s -> %s.%s", "source_column", "target_table", "target_column"), "outgoing")
    inc = side("target_table", F.format_string("%s.%s -> %s", "source_table", "source_column", "target_column"), "incoming")
    return out.join(inc, "table", "full_outer").select(
        "table", F.coalesce("outgoing", F.lit("")).alias("outgoing"), F.coalesce("incoming", F.lit("")).alias("incoming"))


def junction_tables(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Tables whose composite key refers to two or more other tables: each links them many to many."""
    member = keys.select(F.col("table").alias("source_table"), F.col("column").alias("source_column")).distinct()
    wide = member.groupBy("source_table").agg(F.count("*").alias("n")).where(F.col("n") >= 2).select("source_table")
    return (
        edges.where(F.col("source_table") != F.col("target_table"))
        .join(member, ["source_table", "source_column"], "left_semi").join(wide, "source_table", "left_semi")
        .groupBy(F.col("source_table").alias("junction_table"))
        .agg(F.array_join(F.array_sort(F.collect_set("source_column")), ",").alias("columns"),
             F.array_sort(F.collect_set("target_table")).alias("t"))
        .where(F.size("t") >= 2)
        .select("junction_table", "columns", F.array_join("t", ",").alias("tables"))
    )


def uncertain_edges(edges: DataFrame, used: DataFrame) -> DataFrame:
    """Edges a join uses that are uncertain, ambiguous or of middle or low trust."""
    low = trust(F.lit("inferred"), F.col("score").cast("string"))
    weak = (F.col("state") == "UNCERTAIN") | F.col("ambiguous") | low.isin("MEDIUM_CONFIDENCE_INFERRED", "LOW_CONFIDENCE_INFERRED")
    return edges.where(weak).join(used.select(*EDGE).distinct(), EDGE, "left_semi").select(
        *EDGE, "score", "state", "ambiguous", low.alias("trust"))


def fk_quality(found: DataFrame, known: DataFrame) -> DataFrame:
    """True and false positives, misses, and the ratios built from them."""
    mark = found.select(*EDGE).distinct().withColumn("f", F.lit(1)).join(
        known.select(*EDGE).distinct().withColumn("k", F.lit(1)), EDGE, "full_outer")
    s = mark.agg(
        F.count_if(F.col("f").isNotNull() & F.col("k").isNotNull()).alias("tp"),
        F.count_if(F.col("k").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return s.select(
        "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"),
        F.round(ratio(2 * p * r, p + r), 4).alias("f1"), F.round(ratio(fp, tp + fp), 4).alias("fpr"),
        F.round(ratio(fn, tp + fn), 4).alias("fnr"))


def mapping_summary(edges: DataFrame, rows: DataFrame, declared: int = 0) -> DataFrame:
    """Counts that describe a mapping: tables, empty ones, edges by strength, what needs review."""
    strong = F.col("state").isin("CONFIRMED", "PROBABLE") & (F.col("bucket") == "inferred")
    e = edges.agg(
        F.count_if(F.col("bucket") == "inferred").alias("inferred_fk_count"),
        F.count_if(strong).alias("strong_fk_count"),
        F.count_if((F.col("bucket") == "inferred") & ~strong).alias("weak_fk_count"),
        F.count_if(F.col("review_status").isin("flagged", "review")).alias("review_count"),
        F.count_if(F.col("bucket") == "rejected").alias("rejected_count"),
    ).select(F.struct("*").alias("e")).scalar()
    return rows.agg(
        F.count("*").alias("total_tables"), F.count_if("empty").alias("empty_tables"), F.sum("rows").alias("total_rows"),
    ).withColumn("e", e).select("total_tables", "empty_tables", "total_rows", F.lit(declared).alias("declared_fk_count"), "e.*")


def drop_empty_key_edges(edges: DataFrame, empty: DataFrame) -> DataFrame:
    """Edges without those that start at a column with no populated value."""
    dead = empty.where("empty").select(F.col("table").alias("source_table"), F.col("column").alias("source_column"))
    return edges.join(dead, ["source_table", "source_column"], "left_anti")


def cross_schema_candidates(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Containment pairs between different schemas that no known edge covers."""
    schema = lambda c: F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)
    return pairs.where(schema(F.col("source_table")) != schema(F.col("target_table"))).join(
        known.select(*EDGE), EDGE, "left_anti")


def with_hints(
    edges: DataFrame, hints: DataFrame, columns: DataFrame, declared: DataFrame, keys: DataFrame
) -> DataFrame:
    """Edges re-graded by claims from outside: agreement adds 20, a new claim starts with 45 for the claim.

    Claims on unknown tables or columns, on declared pairs, on columns that do not look like
    references, and on columns that have another inferred target are not used.
    """
    from tallyspark.functions.names import REFERENCE_SUFFIXES, compact_expr, singular_expr, words_expr
    from tallyspark.operators.keys import decide, score_edges

    kinds = columns.select(F.col("table").alias("source_table"), F.col("column").alias("source_column"), "data_type")
    suffix = "(" + "|".join(REFERENCE_SUFFIXES) + ")$"
    looks = (
        compact_expr(F.col("source_column")).endswith("id") | F.lower("source_column").rlike(suffix)
        | (compact_expr(F.col("source_column")) == compact_expr(F.col("target_column")))
        | F.col("data_type").rlike("int|decimal|bigint")
    )
    usable = (
        canonical_edges(hints, columns).join(kinds, ["source_table", "source_column"]).where(looks).drop("data_type")
        .join(declared.select("source_table", "source_column"), ["source_table", "source_column"], "left_anti")
    )
    agreed = edges.join(usable.select(*EDGE, F.lit(20).alias("plus")), EDGE, "left")
    points = F.coalesce("plus", F.lit(0))
    raised = decide(
        agreed.withColumn("score", F.least(F.col("score") + points, F.lit(100)))
        .withColumn("groups", F.col("groups") + (points > 0).cast("int"))
    ).drop("plus")
    fresh = usable.join(edges.select("source_table", "source_column"), ["source_table", "source_column"], "left_anti")
    is_key = keys.select(F.col("table").alias("target_table"), F.col("column").alias("target_column"),
                         F.lit(True).alias("target_is_key")).distinct()
    fresh = fresh.join(is_key, ["target_table", "target_column"], "left")
    base = singular_expr(F.regexp_replace("source_column", "(_id|(?<=..)id)$", ""))
    named = F.array_contains(F.transform(words_expr(F.col("target_table")), singular_expr), base)
    none = F.lit(None).cast("bigint")
    no = F.lit(False)
    new = score_edges(fresh.select(
        *EDGE, F.coalesce("target_is_key", no).alias("target_is_key"),
        none.alias("source_distinct"), none.alias("target_distinct"), none.alias("matched"),
        F.lit(None).cast("double").alias("ratio"), F.lit(0.0).alias("null_share"), named.alias("name_match"),
        F.lit(True).alias("reference_name"), no.alias("code_name"), no.alias("composite_member"), no.alias("type_match"),
        F.lit(True).alias("schema_match"), no.alias("ambiguous"), F.lit(45).alias("hint_points"),
    ), source_most=no).drop("hint_points", "target_is_key")
    return raised.unionByName(new.select(*raised.columns))


def schema_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (change, table, column, was, now) between two catalogs."""
    a = before.select("table", "column", F.lower("data_type").alias("was"))
    b = after.select("table", "column", F.lower("data_type").alias("now"))
    ta, tb = a.select("table").distinct().withColumn("a", F.lit(1)), b.select("table").distinct().withColumn("b", F.lit(1))
    tables = ta.join(tb, "table", "full_outer")
    none = F.lit(None).cast("string")
    whole = tables.where(F.col("a").isNull() | F.col("b").isNull()).select(
        F.when(F.col("a").isNull(), "table_added").otherwise("table_removed").alias("change"), "table",
        none.alias("column"), none.alias("was"), none.alias("now"))
    kept = tables.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("table")
    cols = a.join(b, ["table", "column"], "full_outer").join(kept, "table", "left_semi")
    change = (
        F.when(F.col("was").isNull(), "column_added").when(F.col("now").isNull(), "column_removed")
        .when(F.col("was") != F.col("now"), "type_changed")
    )
    return whole.unionByName(cols.select(change.alias("change"), "table", "column", "was", "now").where(F.col("change").isNotNull()))


def edge_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges added and removed between two edge tables."""
    a, b = before.select(*EDGE).distinct(), after.select(*EDGE).distinct()
    return b.exceptAll(a).withColumn("change", F.lit("edge_added")).unionByName(
        a.exceptAll(b).withColumn("change", F.lit("edge_removed")))


def table_kinds(columns: DataFrame, edges: DataFrame) -> DataFrame:
    """Per table: pure fact (every non-id column a measure) and entity (referred to, or has a text column)."""
    low = F.lower("column")
    counts = ~(low.endswith("_id") | (low == "id"))
    numeric = F.col("data_type").rlike("int|double|float|decimal")
    is_fk = edges.select(F.col("source_table").alias("table"), F.col("source_column").alias("column"), F.lit(True).alias("fk"))
    referred = edges.select(F.col("target_table").alias("table"), F.lit(True).alias("referred")).distinct()
    measure = numeric & F.col("fk").isNull()
    return (
        columns.join(is_fk.distinct(), ["table", "column"], "left").groupBy("table")
        .agg(F.coalesce(F.bool_and(F.when(counts, measure)), F.lit(True)).alias("pure_fact"),
             F.bool_or(F.col("data_type") == "string").alias("has_text"))
        .join(referred, "table", "left")
        .select("table", "pure_fact", (F.coalesce("referred", F.lit(False)) | F.col("has_text")).alias("entity"))
    )
