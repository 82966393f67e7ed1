"""Keys and foreign keys from the data: uniqueness, containment, best target, score.

All key-like columns of all tables go through one job: every distinct value is reduced to a bit mask
of the columns that hold it. Partial masks are combined before the shuffle, so a value that fills a
third of a column moves as one row per task; the number of different masks is small, and every
count a candidate pair needs is a sum over masks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tallyspark.functions import names
from tallyspark.operators.profile import null_stats
from tallyspark.session import small_frame

WORD_BITS = 62
MIN_OVERLAP = 0.85


def type_family(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    return kind.typeName()


def exact_value(column: str, kind: T.DataType) -> tuple[Column, Column]:
    """A value as (whole number, text): 1 equals 1.0, a number never equals a string, booleans are apart."""
    c = F.col(f"`{column}`")
    if isinstance(kind, T.IntegralType):
        return c.cast("bigint"), F.lit(None).cast("string")
    if isinstance(kind, T.NumericType):
        whole = (c == F.floor(c)) & (F.abs(c) < 9.0e15)
        return F.when(whole, c.cast("bigint")), F.when(~whole, F.concat(F.lit("n:"), c.cast("double").cast("string")))
    tag = "b:" if isinstance(kind, T.BooleanType) else "s:"
    return F.lit(None).cast("bigint"), F.concat(F.lit(tag), c.cast("string"))


def keyed_values(tables: dict[str, DataFrame], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows (id, num, text) of all non-null cells of the columns; one pass per table."""
    out = None
    for name, df in tables.items():
        picked = [(i, c) for i, (t, c) in enumerate(columns) if t == name]
        if not picked:
            continue
        kinds = {f.name: f.dataType for f in df.schema.fields}
        parts = []
        for i, c in picked:
            num, text = exact_value(c, kinds[c])
            parts.append(F.struct(F.lit(i).alias("id"), num.alias("num"), text.alias("text")))
        rows = df.select(F.inline(F.array(*parts))).where(F.col("num").isNotNull() | F.col("text").isNotNull())
        out = rows if out is None else out.unionByName(rows)
    return out


def value_signatures(tables: dict[str, DataFrame], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows (m0.., values, low, high): how many distinct values are held by exactly these columns."""
    words = [f"m{w}" for w in range((len(columns) - 1) // WORD_BITS + 1)]
    out = None
    for name, df in tables.items():
        kinds = {f.name: f.dataType for f in df.schema.fields}
        parts = []
        for i, (t, c) in enumerate(columns):
            if t == name:
                num, text = exact_value(c, kinds[c])
                bits = [F.lit(1 << (i % WORD_BITS) if i // WORD_BITS == w else 0).cast("bigint").alias(m) for w, m in enumerate(words)]
                parts.append(F.struct(num.alias("num"), text.alias("text"), *bits))
        if parts:
            rows = df.select(F.inline(F.array(*parts))).where(F.col("num").isNotNull() | F.col("text").isNotNull())
            out = rows if out is None else out.unionByName(rows)
    per_value = out.groupBy("num", "text").agg(*[F.bit_or(w).alias(w) for w in words])
    return per_value.groupBy(*words).agg(
        F.count("*").alias("values"), F.min("num").alias("low"), F.max("num").alias("high"))


def _members(n: int) -> Column:
    """Array of the column ids whose bit is set."""
    ids = [F.when(F.col(f"m{i // WORD_BITS}").bitwiseAND(F.lit(1 << (i % WORD_BITS)).cast("bigint")) != 0, F.lit(i)) for i in range(n)]
    return F.filter(F.array(*ids), lambda i: i.isNotNull())


def containment(
    tables: dict[str, DataFrame], columns: Sequence[tuple[str, str]], targets: Sequence[tuple[str, str]] | None = None
) -> DataFrame:
    """Rows per (source column, target column) that share a value: distinct counts, matches and ratio.

    Work on pairs starts only after values have become masks, a table no larger than the number of
    different column sets. A column paired with itself gives its own distinct count and range, so
    sizes and matches come from the same single pass over the tables.
    """
    ids = {pair: i for i, pair in enumerate(columns)}
    wanted = [ids[t] for t in (targets or columns)]
    both = (
        value_signatures(tables, columns).withColumn("members", _members(len(columns)))
        .select("members", "values", "low", "high", F.explode("members").alias("s"))
        .select("s", "values", "low", "high", F.explode("members").alias("t"))
        .where((F.col("s") == F.col("t")) | F.col("t").isin(*wanted))
        .groupBy("s", "t").agg(F.sum("values").alias("matched"), F.min("low").alias("low"), F.max("high").alias("high"))
    )
    own = F.col("s") == F.col("t")
    by_s, by_t = W.partitionBy("s"), W.partitionBy("t")
    pairs = (
        both.withColumn("source_distinct", F.max(F.when(own, F.col("matched"))).over(by_s))
        .withColumn("source_low", F.max(F.when(own, F.col("low"))).over(by_s))
        .withColumn("source_high", F.max(F.when(own, F.col("high"))).over(by_s))
        .withColumn("target_distinct", F.max(F.when(own, F.col("matched"))).over(by_t))
        .where(~own)
    )
    named = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(c).alias("column")) for t, c in columns])
    ends = pairs.withColumn("a", F.get(named, F.col("s"))).withColumn("b", F.get(named, F.col("t")))
    return ends.select(
        F.col("a.table").alias("source_table"), F.col("a.column").alias("source_column"),
        F.col("b.table").alias("target_table"), F.col("b.column").alias("target_column"),
        "source_distinct", "source_low", "source_high", "target_distinct", "matched",
        (F.col("matched") / F.col("source_distinct")).alias("ratio"))


def fk_containment(tables, columns, targets=None, minimum: float = MIN_OVERLAP) -> DataFrame:
    return containment(tables, columns, targets).where(F.col("ratio") >= minimum).select(
        "source_table", "source_column", "target_table", "target_column", "source_distinct", "target_distinct",
        "matched", F.round("ratio", 4).alias("ratio"),
    )


def composite_containment(child: DataFrame, child_cols: Sequence[str], parent: DataFrame, parent_cols: Sequence[str]) -> DataFrame:
    """One row: distinct child tuples, how many of them the parent has, and the ratio."""
    keys = [f"k{i}" for i in range(len(child_cols))]
    left = child.select(*[F.col(c).alias(k) for c, k in zip(child_cols, keys)]).dropna().distinct()
    right = parent.select(*[F.col(c).alias(k) for c, k in zip(parent_cols, keys)]).dropna().distinct()
    s = left.join(right.withColumn("hit", F.lit(1)), keys, "left").agg(
        F.count("*").alias("source_tuples"), F.count("hit").alias("matched"))
    return s.withColumn("ratio", F.round(F.col("matched") / F.col("source_tuples"), 4))


def key_stats(tables: dict[str, DataFrame], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows (table, column, rows, non_null, distinct, most, low, high) for the columns.

    Distinct values are counted as groups of (column, value), not as one distinct set per column.
    """
    per_value = keyed_values(tables, columns).groupBy("id", "num", "text").agg(F.count("*").alias("times"))
    stats = per_value.groupBy("id").agg(
        F.sum("times").alias("non_null"), F.count("*").alias("distinct"), F.max("times").alias("most"),
        F.min("num").alias("low"), F.max("num").alias("high"), F.count("num").alias("whole"),
    )
    spark = stats.sparkSession
    catalog = small_frame(spark, [(i, t, c) for i, (t, c) in enumerate(columns)], "id int, table string, column string")
    rows = None
    for name in dict.fromkeys(t for t, _ in columns):
        one = tables[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        rows = one if rows is None else rows.unionByName(one)
    zero = F.lit(0).cast("bigint")
    return catalog.join(rows, "table").join(stats, "id", "left").select(
        "table", "column", "rows", *[F.coalesce(c, zero).alias(c) for c in ("non_null", "distinct", "most")], "low", "high",
        F.coalesce("whole", zero).alias("whole"),
    )


def unique_keys(tables: dict[str, DataFrame], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Is the column a unique key: rows, none null, all different."""
    s = key_stats(tables, columns)
    full = (F.col("rows") > 0) & (F.col("non_null") == F.col("rows")) & (F.col("distinct") == F.col("rows"))
    return s.select("table", "column", "rows", "non_null", "distinct", full.alias("unique_key"))


def line_counters(tables: dict[str, DataFrame], columns: Sequence[tuple[str, str]], most: int = 6) -> DataFrame:
    """Columns whose values are exactly 1..n with n small: line numbers, not references."""
    s = key_stats(tables, columns)
    n = F.col("distinct")
    counter = (n <= most) & (n > 0) & (F.col("whole") == n) & (F.col("low") == 1) & (F.col("high") == n)
    return s.select("table", "column", n.alias("distinct"), F.coalesce(counter, F.lit(False)).alias("line_counter"))


def primary_keys_by_name(schema: dict[str, list[str]], declared: dict[str, list[str]] | None = None,
                         not_null: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Keys that names alone suggest. Every column gets its evidence; a table's key is the column that is
    alone with the strongest evidence that any single column has, unless something speaks against it."""
    declared, not_null = declared or {}, not_null or {}

    def evidence(table: str, column: str) -> list[tuple[int, bool]]:
        """(strength, nothing against it): named like the table's key; required; an id at all."""
        name, own = names.Name.of(column), names.own_key_names(table)
        foreign = name.flat.endswith("id") and name.flat not in ("id", names.Name.of(table).flat + "id")
        found = [(3, True)] if name.flat in own else []
        found += [(2, not foreign)] if column in not_null.get(table, ()) else []
        return found + ([(1, not names.names_other_table(column, table, list(schema)))] if name.low == "id" or name.low.endswith("_id") else [])

    out = dict(declared)
    for table in (t for t in schema if not declared.get(t)):
        by_strength: dict[int, list[tuple[str, bool]]] = {}
        for column in schema[table]:
            for strength, clear in evidence(table, column):
                by_strength.setdefault(strength, []).append((column, clear))
        single = max((s for s, columns in by_strength.items() if len(columns) == 1), default=None)
        if single is not None and by_strength[single][0][1]:
            out[table] = [by_strength[single][0][0]]
    return out


def pk_candidates(tables: dict[str, DataFrame], exclude: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Unique, full id-like columns that name no other table; of several only one with the table's own name is chosen."""
    columns = [
        (t, c) for t, df in tables.items() for c in df.columns
        if (c.lower().endswith("_id") or c.lower() == "id") and (t, c) not in exclude
        and not names.names_other_table(c, t, list(tables))
    ]
    own = F.create_map(*[F.lit(x) for t in tables for x in (t, names.singular(names.Name.of(t).flat) + "id")])
    flat = names.compact_expr(F.col("column"))
    primary = (flat == "id") | (flat == own[F.col("table")]) | (flat == F.concat(names.compact_expr(F.col("table")), F.lit("id")))
    w = W.partitionBy("table")
    return (
        unique_keys(tables, columns).where("unique_key").withColumn("primary", primary)
        .withColumn("candidates", F.count("*").over(w))
        .withColumn("named", F.count_if("primary").over(w))
        .select("table", "column", "rows", "candidates",
                ((F.col("candidates") == 1) | (F.col("primary") & (F.col("named") == 1))).alias("chosen"))
    )


def profiled_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """Key statistics of the columns worth key profiling, with what their names say."""
    columns = [
        (t, f.name) for t, df in tables.items() for f in df.schema.fields
        if names.is_profiled(f.name, type_family(f.dataType) == "numeric") or names.is_reference_name(f.name)
    ]
    said = small_frame(
        next(iter(tables.values())).sparkSession,
        [(t, c, names.is_reference_name(c), names.is_code_name(c)) for t, c in columns],
        "table string, column string, reference_name boolean, code_name boolean")
    return key_stats(tables, columns).join(said, ["table", "column"]).select(
        "table", "column", "rows", "non_null", "distinct", "reference_name", "code_name")


def compatible_pairs(
    tables: dict[str, DataFrame], sources: Sequence[tuple[str, str]], targets: Sequence[tuple[str, str]]
) -> DataFrame:
    """Source and key columns of one type family with their shared distinct values, none left out."""
    family = {(t, f.name): type_family(f.dataType) for t, df in tables.items() for f in df.schema.fields}
    pairs = [(*s, *t, family[s]) for s in sources for t in targets if s != t and family[s] == family[t]]
    spark = next(iter(tables.values())).sparkSession
    wanted = small_frame(spark, pairs, "source_table string, source_column string, target_table string, target_column string, family string")
    measured = containment(tables, sorted({*sources, *targets}), targets)
    on = ["source_table", "source_column", "target_table", "target_column"]
    return wanted.join(measured.select(*on, "matched", "ratio"), on, "left").select(
        *on, "family", F.coalesce("matched", F.lit(0)).alias("matched"), F.round(F.coalesce("ratio", F.lit(0.0)), 4).alias("ratio"))


def edge_cardinality(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """Kind of an edge from the largest number of rows per key on each side."""
    def most(df: DataFrame, key: str) -> Column:
        return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).scalar()

    one = child.sparkSession.range(1)
    many = one.select(F.lit(name).alias("edge"), most(child, child_key).alias("child_rows_per_key"),
                      most(parent, parent_key).alias("parent_rows_per_key"))
    c, p = F.col("child_rows_per_key") > 1, F.col("parent_rows_per_key") > 1
    kind = F.when(c & p, "many-to-many").when(c, "many-to-one").when(p, "one-to-many").otherwise("one-to-one")
    return many.withColumn("cardinality", kind)


# --- candidate foreign keys --------------------------------------------------------------------


@dataclass(frozen=True)
class Candidate:
    """What names and types say about a (source column, target key) pair, before any data is read."""

    source_table: str
    source_column: str
    target_table: str
    target_column: str
    name_match: bool
    best_named: bool
    any_best_named: bool
    self_reference: bool
    reference_name: bool
    code_name: bool
    composite_member: bool
    by_name_only: bool
    type_match: bool
    target_is_member: bool
    shared_target: bool
    schema_match: bool
    points_elsewhere: bool


CANDIDATE_SCHEMA = ", ".join(
    f"{f} {'boolean' if t in (bool, 'bool') else 'string'}" for f, t in Candidate.__annotations__.items()
)


def candidate_pairs(
    tables: dict[str, DataFrame], primary_keys: dict[str, list[str]], declared: Sequence[tuple[str, str]] = ()
) -> list[Candidate]:
    """Pairs worth measuring. Only table and column names and types are used, one record per pair."""
    all_tables = list(tables)
    owners: dict[str, list[str]] = {}
    for t, cols in primary_keys.items():
        for c in cols:
            owners.setdefault(c, []).append(t)
    kinds = {t: {f.name: f.dataType for f in df.schema.fields} for t, df in tables.items()}
    out = []
    for table in all_tables:
        key = primary_keys.get(table, [])
        for column, kind in kinds[table].items():
            if (table, column) in declared or key == [column]:
                continue
            member = column in key
            ref = names.is_reference_name(column)
            if not ref and not names.is_profiled(column, type_family(kind) == "numeric"):
                continue
            by_name = {t for t in names.named_tables(column, all_tables) if t != table}
            shared = len(owners.get(column, [])) >= 2
            hinted = by_name | ({t for t in owners.get(column, []) if t != table})
            pool = by_name if not shared else set()
            if not (ref or member) and hinted:
                continue
            best = names.best_named_table(column, [t for t in all_tables if primary_keys.get(t)])
            for target in all_tables:
                for target_column in primary_keys.get(target, []):
                    if (table, column) == (target, target_column):
                        continue
                    if (ref or member) and pool and target not in pool:
                        continue
                    target_kind = kinds[target][target_column]
                    match = type_family(kind) == type_family(target_kind)
                    if not match:
                        continue
                    several = len(owners.get(target_column, [])) >= 2
                    out.append(Candidate(
                        table, column, target, target_column,
                        name_match=target in by_name, best_named=best == target, any_best_named=best is not None,
                        self_reference=table == target and column.lower().endswith(names.SELF_REFERENCE_SUFFIXES),
                        reference_name=ref, code_name=names.is_code_name(column), composite_member=member,
                        by_name_only=bool(pool), type_match=match,
                        target_is_member=len(primary_keys[target]) > 1, shared_target=several,
                        schema_match=table.rpartition(".")[0] == target.rpartition(".")[0],
                        points_elsewhere=names.names_other_table(column, table, all_tables),
                    ))
    return out


def best_targets(
    spark: SparkSession, tables: dict[str, DataFrame], candidates: Sequence[Candidate], minimum: float = MIN_OVERLAP
) -> DataFrame:
    """The data-supported best target of each source column, and whether the data can tell it from others."""
    columns = sorted({(c.source_table, c.source_column) for c in candidates} | {(c.target_table, c.target_column) for c in candidates})
    targets = sorted({(c.target_table, c.target_column) for c in candidates})
    facts = small_frame(spark, [tuple(vars(c).values()) for c in candidates], CANDIDATE_SCHEMA)
    measured = containment(tables, columns, targets)
    return rank_targets(facts, measured, source_rows(tables, columns), minimum)


def source_rows(tables: dict[str, DataFrame], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows and null share per source column: (source_table, source_column, rows, null_share)."""
    wanted: dict[str, list[str]] = {}
    for t, c in columns:
        wanted.setdefault(t, []).append(c)
    out = None
    for t, cols in wanted.items():
        rows = null_stats(tables[t].select(*cols), t)
        out = rows if out is None else out.unionByName(rows)
    share = F.when(F.col("total_rows") > 0, F.col("nulls") / F.col("total_rows")).otherwise(0.0)
    return out.select(
        F.col("table").alias("source_table"), F.col("column").alias("source_column"),
        F.col("total_rows").alias("source_rows"), share.alias("null_share"))


def rank_targets(facts: DataFrame, measured: DataFrame, rows: DataFrame, minimum: float = MIN_OVERLAP) -> DataFrame:
    """One row per source column: target, evidence, `ambiguous`. Works on pair rows only."""
    src = ["source_table", "source_column"]
    pair = [*src, "target_table", "target_column"]
    wide = (F.col("source_distinct") >= 10) & (F.col("source_distinct") >= 0.05 * F.col("source_rows"))
    boost = (
        F.when(F.col("best_named"), 10)
        .when(F.col("self_reference") & (F.col("matched") == F.col("source_distinct")), 9).otherwise(0)
    )
    hits = (
        facts.join(measured, pair).join(rows, src)
        .where(F.col("ratio") >= minimum)
        .where(F.when(F.col("reference_name") | F.col("composite_member"), F.col("source_distinct") >= 2).otherwise(wide))
        .withColumn("boost", boost)
    )
    order = W.partitionBy(*src).orderBy(
        F.desc("ratio"), F.desc("matched"), F.desc("boost"), "target_distinct", F.desc("target_table"), F.desc("target_column")
    )
    second = F.lead(F.struct("ratio", "matched", "boost", "target_distinct")).over(order)
    ranked = hits.withColumn("nth", F.row_number().over(order)).withColumn("second", second)
    # Targets about as good whose sole key has the same name as the source column.
    first_ratio = F.max("ratio").over(W.partitionBy(*src))
    same = (first_ratio - F.col("ratio") < 0.05) & (F.col("target_column") == F.col("source_column")) & ~F.col("target_is_member")
    ranked = ranked.withColumn("same_key", F.count_if(same).over(W.partitionBy(*src)))
    two = F.col("second").isNotNull()
    s = F.col("second")
    full_tie = two & (F.col("ratio") == s["ratio"]) & (F.col("matched") == s["matched"]) & (F.col("boost") == s["boost"]) & (
        F.col("target_distinct") == s["target_distinct"])
    near = (F.col("ratio") - s["ratio"] < 0.03) & (
        F.abs(F.col("matched") - s["matched"]) <= F.greatest(F.lit(2), F.floor(F.col("matched") * 0.05)))
    tighter = F.col("target_distinct") < 0.5 * s["target_distinct"]
    looser = s["target_distinct"] < 0.5 * F.col("target_distinct")
    named = (F.col("boost") > s["boost"]) & F.col("best_named") & ~looser
    own = (F.col("boost") >= 9) & (F.col("source_table") == F.col("target_table")) & (F.col("matched") == F.col("source_distinct"))
    data_tie = two & ((near & ~named & ~tighter & ~own) | (F.col("same_key") >= 3))
    other_named = F.col("any_best_named") & ~F.col("best_named")
    thin = (F.col("boost") == 0) & (F.col("source_distinct") < 0.6 * F.col("target_distinct"))
    dense = (F.col("source_high") - F.col("source_low") + 1) <= F.col("source_distinct") * 1.5
    chance = thin & (F.coalesce(dense, F.lit(False)) | ~F.col("reference_name"))
    vague_key = ~F.col("name_match") & ~F.col("composite_member") & (F.col("source_table") != F.col("target_table")) & (
        F.col("target_is_member") | F.col("shared_target"))
    unsure = (full_tie & ~F.col("by_name_only")) | data_tie | other_named | chance | vague_key
    return ranked.where(F.col("nth") == 1).select(
        *pair, "source_distinct", "target_distinct", "matched", "ratio", "null_share", "name_match", "reference_name",
        "code_name", "composite_member", "type_match", "schema_match", unsure.alias("ambiguous"),
    )


def score_edges(edges: DataFrame, source_most: Column | None = None) -> DataFrame:
    """Evidence score 0..100, evidence groups, state and bucket for each edge row.

    Needs the columns of `best_targets`; `ratio` null means no value evidence. Cardinality is
    many-to-one when the source repeats keys (`repeats`, if present) or has fewer distinct keys.
    """
    ratio = F.col("ratio")
    overlap = F.when(ratio >= 0.99, 30).when(ratio >= 0.95, 25).when(ratio >= 0.80, 18).otherwise(0)
    many = source_most if source_most is not None else F.col("source_distinct") < 0.9 * F.col("target_distinct")
    nulls = F.when(F.col("null_share") > 0.8, -25).when(F.col("null_share") > 0.5, -10).otherwise(0)
    hint = F.col("hint_points") if "hint_points" in edges.columns else F.lit(0)
    key = F.col("target_is_key") if "target_is_key" in edges.columns else F.lit(True)
    raw = (
        F.when(F.col("schema_match"), 5).otherwise(0) + F.when(F.col("name_match"), 25).otherwise(0)
        + F.when(F.col("type_match"), 15).otherwise(0) + F.coalesce(overlap, F.lit(0))
        + F.when(key, 20).otherwise(0)
        + F.when(many, 10).otherwise(0) + nulls + hint
    )
    score = F.least(F.greatest(raw, F.lit(0)), F.lit(100))
    groups = (key | F.col("type_match")).cast("int") + F.col("name_match").cast("int") + ratio.isNotNull().cast("int") + (hint > 0).cast("int")
    scored = edges.withColumn("many", F.coalesce(many, F.lit(False))).withColumn("score", score).withColumn("groups", groups)
    return decide(scored)


def decide(scored: DataFrame) -> DataFrame:
    """State, bucket, level and band from score, evidence groups, ambiguity and code-like names."""
    s = F.col("score")
    veto = F.col("code_name") & ~F.col("name_match")
    state = (
        F.when(F.col("ambiguous"), "UNCERTAIN").when(veto, "REJECTED")
        .when((s >= 80) & (F.col("groups") >= 2), "CONFIRMED").when(s >= 60, "PROBABLE").otherwise("UNCERTAIN")
    )
    bucket = F.when(F.col("ambiguous"), "ambiguous").when(veto, "rejected").otherwise("inferred")
    review = (
        F.when(F.col("ambiguous"), "review").when(veto, "rejected").when(s >= 80, "auto-accept")
        .when(s >= 60, "flagged").otherwise("review")
    )
    level = F.when(s >= 90, "VERY_HIGH").when(s >= 80, "HIGH").when(s >= 60, "MEDIUM").otherwise("LOW")
    band = F.when(s >= 90, "High").when(s >= 75, "Medium").when(s >= 60, "Possible").otherwise("Low")
    return (
        scored.withColumn("state", state).withColumn("bucket", bucket).withColumn("review_status", review)
        .withColumn("confidence_level", level).withColumn("confidence_band", band)
    )


# --- foreign keys of several columns -----------------------------------------------------------

Mapping = frozenset  # of (key column, source column)


def tuple_value(columns: Sequence[str], kinds: dict[str, T.DataType]) -> Column:
    """Several values as one text, equal when all are equal as `exact_value` has it; null if one of them is.

    A number ends with ";", a text follows its length and ":". What is longer than a hash is hashed; a hash has
    neither sign, so it equals no unhashed text."""
    parts = []
    for c in columns:
        num, text = exact_value(c, kinds[c])
        parts.append(F.coalesce(F.concat(num.cast("string"), F.lit(";")), F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    whole = F.concat(*parts)
    return F.when(F.length(whole) > 32, F.md5(whole.cast("binary"))).otherwise(whole)


def _longer(hits: set[Mapping]) -> set[Mapping]:
    """Mappings one column longer, all of whose parts are hits."""
    out = set()
    for a in hits:
        for b in hits:
            whole = a | b
            if len(whole) == len(a) + 1 and len({k for k, _ in whole}) == len({c for _, c in whole}) == len(whole):
                if all(whole - {pair} in hits for pair in whole):
                    out.add(whole)
    return out


def composite_edges(
    tables: dict[str, DataFrame], primary_keys: dict[str, list[str]], minimum: float = MIN_OVERLAP
) -> DataFrame:
    """Tuples of columns that refer to a key of several columns: the best mapping per source and target table.

    Levelwise: single columns first, all pairs in one pass; a longer mapping is measured only if each of its parts
    holds, by the share of distinct source tuples that the key has. On every level a tuple is one short value and
    the level one pass (`containment`). Columns worth key profiling and such that are named as a part of the key
    take part; a tuple with a null refers to nothing. Of several mappings the one with more columns of the
    key's own names wins, then the higher ratio, then more matches; `ambiguous` if that does not tell two apart.

    Rows as of `best_targets`; columns of a mapping are joined by ", " in the order of the key.
    """
    spark = next(iter(tables.values())).sparkSession
    targets = {t: list(key) for t, key in primary_keys.items() if len(key) > 1 and t in tables}
    kinds = {t: {f.name: f.dataType for f in df.schema.fields} for t, df in tables.items()}
    parts = {k for key in targets.values() for k in key}
    sources = {t: [c for c, kind in own.items() if c in parts or names.is_reference_name(c)
                   or names.is_profiled(c, type_family(kind) == "numeric")] for t, own in kinds.items()}
    # (source table, target table) -> mappings that hold, level by level.
    level: dict[tuple[str, str], set[Mapping]] = {
        (s, t): {Mapping([(k, c)]) for k in key for c in sources[s] if type_family(kinds[s][c]) == type_family(kinds[t][k])}
        for t, key in targets.items() for s in tables}
    found: list[tuple] = []
    size = 1
    while any(level.values()):
        columns: dict[str, dict[str, Column]] = {}

        def side(table: str, cols: tuple[str, ...]) -> tuple[str, str]:
            name = "|".join(cols)
            # A single value goes as it is: `containment` tells equal ones itself.
            columns.setdefault(table, {})[name] = (tuple_value(cols, kinds[table]) if len(cols) > 1 else F.col(f"`{cols[0]}`")).alias(name)
            return table, name

        def ends(s: str, t: str, mapping: Mapping) -> tuple[tuple[str, str], tuple[str, str]]:
            pairs = sorted(mapping, key=lambda p: targets[t].index(p[0]))
            return side(s, tuple(c for _, c in pairs)), side(t, tuple(k for k, _ in pairs))

        wanted = {(s, t, m): ends(s, t, m) for (s, t), mappings in level.items() for m in mappings}
        derived = {t: tables[t].select(*cols.values()) for t, cols in columns.items()}
        pairs = containment(derived, sorted({e for both in wanted.values() for e in both}), sorted({b for _, b in wanted.values()}))
        rows = {(r.source_table, r.source_column, r.target_table, r.target_column): r
                for r in pairs.where(F.col("ratio") >= minimum).collect()}  # names and counts, a row per pair of columns
        held: dict[tuple[str, str], set[Mapping]] = {}
        for (s, t, m), (a, b) in wanted.items():
            r = rows.get((*a, *b))
            if r or a == b:  # a column holds itself
                held.setdefault((s, t), set()).add(m)
            if r and size == len(targets[t]):
                found.append((s, ", ".join(a[1].split("|")), t, ", ".join(b[1].split("|")), r.source_distinct, r.target_distinct, r.matched,
                              r.ratio, sum(k == c for k, c in m), s.rpartition(".")[0] == t.rpartition(".")[0], a[1]))
        level = {pair: longer for pair, hits in held.items() if size < len(targets[pair[1]]) and (longer := _longer(hits))}
        size += 1
    rows = small_frame(spark, [f[:-1] for f in found], "source_table string, source_column string, target_table string, target_column string, "
                       "source_distinct bigint, target_distinct bigint, matched bigint, ratio double, named int, schema_match boolean")
    w = W.partitionBy("source_table", "target_table")
    order = w.orderBy(F.desc("named"), F.desc("ratio"), F.desc("matched"), "source_column")
    second = F.lead(F.struct("named", "ratio", "matched")).over(order)
    best = rows.withColumn("nth", F.row_number().over(order)).withColumn("second", second).where(F.col("nth") == 1)
    nulls = [tables[s].agg(F.lit(s).alias("source_table"), F.lit(cols).alias("source_column"), F.coalesce(F.avg(
        tuple_value(name.split("|"), kinds[s]).isNull().cast("double")), F.lit(0.0)).alias("null_share"))
        for s, cols, name in sorted({(f[0], f[1], f[-1]) for f in found})]
    share = None
    for one in nulls:
        share = one if share is None else share.unionByName(one)
    if share is None:
        share = small_frame(spark, [], "source_table string, source_column string, null_share double")
    return best.join(share, ["source_table", "source_column"]).select(
        "source_table", "source_column", "target_table", "target_column", "source_distinct", "target_distinct", "matched", "ratio", "null_share",
        (F.col("named") > 0).alias("name_match"), F.lit(True).alias("reference_name"), F.lit(False).alias("code_name"),
        F.lit(True).alias("composite_member"), F.lit(True).alias("type_match"), "schema_match",
        F.coalesce(F.struct("named", "ratio", "matched") == F.col("second"), F.lit(False)).alias("ambiguous"))


def discover_edges(
    tables: dict[str, DataFrame], primary_keys: dict[str, list[str]], declared: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """Inferred foreign keys of a set of tables with score, state and bucket; rejected ones stay in.

    A reference-style name that points at another table but has no value evidence (an empty or
    unmatched column) is kept on its name alone. References to keys of several columns are rows of their own.
    """
    candidates = candidate_pairs(tables, primary_keys, declared)
    spark = next(iter(tables.values())).sparkSession
    best = best_targets(spark, tables, candidates)
    named = [c for c in candidates if c.name_match and c.points_elsewhere and not c.composite_member]
    if named:
        facts = small_frame(spark, [tuple(vars(c).values()) for c in named], CANDIDATE_SCHEMA)
        src = ["source_table", "source_column"]
        none = F.lit(None).cast("bigint")
        alone = facts.join(source_rows(tables, sorted({(c.source_table, c.source_column) for c in named})), src).select(
            *src, "target_table", "target_column", none.alias("source_distinct"), none.alias("target_distinct"),
            none.alias("matched"), F.lit(None).cast("double").alias("ratio"), "null_share", "name_match", "reference_name",
            "code_name", "composite_member", "type_match", "schema_match", F.lit(False).alias("ambiguous"))
        # A column keeps its name-only rows where it has no row with evidence.
        turn = F.rank().over(W.partitionBy(*src).orderBy(F.col("ratio").isNull()))
        best = best.unionByName(alone).withColumn("turn", turn).where(F.col("turn") == 1).drop("turn")
    if any(len(key) > 1 for key in primary_keys.values()):
        best = best.unionByName(composite_edges(tables, primary_keys))
    return score_edges(best)
