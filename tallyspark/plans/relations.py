"""Key and foreign-key queries, on the given tables and on the same tables with business names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import names
from tallyspark.operators import edges, joins, keys, paths, profile
from tallyspark.operators.keys import candidate_pairs, primary_keys_by_name
from tallyspark.plans.insight import union_all
from tallyspark.plans.views import KNOWN_EDGES, RENAMED, renamed_sql, renamed_tables, table
from tallyspark.session import small_frame, stored

# --- containment on the given tables -----------------------------------------------------------

KEYLIKE = [
    ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("lineitem", "l_suppkey"), ("orders", "o_orderkey"),
    ("orders", "o_custkey"), ("customer", "c_custkey"), ("customer", "c_nationkey"), ("nation", "n_nationkey"),
    ("nation", "n_regionkey"), ("region", "r_regionkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"),
    ("events", "user_id"), ("documents", "doc_id"), ("labels", "doc_id"), ("documents", "lang"), ("documents", "source"),
    ("lineitem", "l_quantity"), ("part", "p_size"),
]
NUMERIC_KEYS = [p for p in KEYLIKE if p[1] not in ("lang", "source")]
TEXT_KEYS = [p for p in KEYLIKE if p[1] in ("lang", "source")]


def _keylike_tables(spark, sf):
    return {t: table(spark, sf, t) for t in dict.fromkeys(t for t, _ in KEYLIKE)}


def q_fk_containment(spark, sf):
    return keys.fk_containment(_keylike_tables(spark, sf), KEYLIKE)


def distinct_sql(columns, source=lambda t: t) -> str:
    return union_all(
        f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, {c}::DOUBLE AS v FROM {source(t)} WHERE {c} IS NOT NULL"
        for t, c in columns)


PAIR_SQL = """SELECT a.t AS source_table, a.c AS source_column, b.t AS target_table, b.c AS target_column,
  any_value(na.n) AS source_distinct, any_value(nb.n) AS target_distinct, count(*) AS matched, count(*) / any_value(na.n) AS ratio,
  any_value(na.lo) AS source_low, any_value(na.hi) AS source_high
FROM vals a JOIN vals b ON a.v = b.v AND (a.t <> b.t OR a.c <> b.c)
JOIN sizes na ON na.t = a.t AND na.c = a.c JOIN sizes nb ON nb.t = b.t AND nb.c = b.c GROUP BY 1, 2, 3, 4"""

SQL_FK_CONTAINMENT = f"""WITH vals AS ({distinct_sql(NUMERIC_KEYS)}),
sizes AS (SELECT t, c, count(*) AS n, min(v) AS lo, max(v) AS hi FROM vals GROUP BY 1, 2), p AS ({PAIR_SQL})
SELECT source_table, source_column, target_table, target_column, source_distinct, target_distinct, matched,
  round(ratio, 4) AS ratio FROM p WHERE ratio >= 0.85"""


def q_composite_containment(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).alias("place"))
    return keys.composite_containment(orders, ["o_orderkey", "place"], table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


SQL_COMPOSITE = """WITH a AS (SELECT DISTINCT o_orderkey AS l_orderkey, o_orderkey % 7 + 1 AS l_linenumber FROM orders),
b AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT count(*) AS source_tuples, count(b.l_orderkey) AS matched, round(count(b.l_orderkey) / count(*), 4) AS ratio
FROM a LEFT JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber"""



def _line_tables(spark, sf):
    """Order lines; returns that point at them under the same names, checks that do so under other names with a tenth
    missing, and moves whose columns are in the key but not together."""
    li = table(spark, sf, "lineitem")
    back = li.where("l_returnflag = 'R'")
    tag = (F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return {
        "order_lines": li.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part_id")),
        "returns": back.select(tag.alias("return_id"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").alias("supplier_id")),
        "checks": li.select(tag.alias("check_id"), F.col("l_orderkey").alias("order_ref"),
                            F.when(F.col("l_partkey") % 11 != 0, F.col("l_linenumber")).otherwise(9).alias("line_no")),
        "moves": li.select(tag.alias("move_id"), F.col("l_orderkey").alias("order_id"), (F.col("l_linenumber") % 7 + 1).alias("line_no")),
    }


LINE_KEYS = {"order_lines": ["order_id", "line_no"], "returns": ["return_id"], "checks": ["check_id"], "moves": ["move_id"]}


def q_fk_composite(spark, sf):
    found = keys.composite_edges(_line_tables(spark, sf), LINE_KEYS)
    return found.select("source_table", "source_column", "target_table", "target_column", "source_distinct", "target_distinct", "matched",
                        F.round("ratio", 6).alias("ratio"), "name_match", "ambiguous")


_LINE_COLUMNS = {"returns": ("return_id", "order_id", "line_no", "supplier_id"), "checks": ("check_id", "order_ref", "line_no"),
                 "moves": ("move_id", "order_id", "line_no"), "order_lines": ("order_id", "line_no", "part_id")}


def _share_sql(source: str, mapping: dict[str, str]) -> str:
    """Share of the distinct source tuples that the order lines have."""
    own, key = ", ".join(mapping), ", ".join(mapping.values())
    return (f"(SELECT count(hit) / count(*) FROM (SELECT DISTINCT {own} FROM {source}) s LEFT JOIN (SELECT DISTINCT {key}, 1 AS hit FROM order_lines) t ON "
            + " AND ".join(f"s.{c} = t.{k}" for c, k in mapping.items()) + ")")


def _composite_sql() -> str:
    each = union_all(
        f"""SELECT '{t}' AS source_table, '{a}, {b}' AS source_column, (SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM {t})) AS source_distinct,
  {(a == 'order_id') + (b == 'line_no')} AS named, {_share_sql(t, {a: 'order_id', b: 'line_no'})} AS ratio,
  least({_share_sql(t, {a: 'order_id'})}, {_share_sql(t, {b: 'line_no'})}) AS part"""
        for t, columns in _LINE_COLUMNS.items() for a in columns for b in columns if a != b and (t, a, b) != ("order_lines", "order_id", "line_no"))
    tag = "l_orderkey * 10 + l_linenumber"
    return f"""WITH order_lines AS (SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id FROM lineitem),
returns AS (SELECT {tag} AS return_id, l_orderkey AS order_id, l_linenumber AS line_no, l_suppkey AS supplier_id FROM lineitem WHERE l_returnflag = 'R'),
checks AS (SELECT {tag} AS check_id, l_orderkey AS order_ref, CASE WHEN l_partkey % 11 <> 0 THEN l_linenumber ELSE 9 END AS line_no FROM lineitem),
moves AS (SELECT {tag} AS move_id, l_orderkey AS order_id, l_linenumber % 7 + 1 AS line_no FROM lineitem),
tried AS ({each}), held AS (SELECT *, row_number() OVER w AS nth, lead((named, ratio, source_distinct)) OVER w AS second
  FROM tried WHERE part >= 0.85 AND ratio >= 0.85 WINDOW w AS (PARTITION BY source_table ORDER BY named DESC, ratio DESC, ratio * source_distinct DESC, source_column))
SELECT source_table, source_column, 'order_lines' AS target_table, 'order_id, line_no' AS target_column, source_distinct,
  (SELECT count(*) FROM (SELECT DISTINCT order_id, line_no FROM order_lines)) AS target_distinct, round(ratio * source_distinct)::BIGINT AS matched,
  round(ratio, 6) AS ratio, named > 0 AS name_match, coalesce((named, ratio, source_distinct) = second, FALSE) AS ambiguous
FROM held WHERE nth = 1"""


# --- audits ------------------------------------------------------------------------------------


def q_orphan_audit(spark, sf):
    t = lambda n: table(spark, sf, n)
    good = joins.orphan_audit(t("orders"), "o_custkey", t("customer"), "c_custkey", "orders.o_custkey -> customer.c_custkey")
    wrong = joins.orphan_audit(t("lineitem"), "l_orderkey", t("part"), "p_partkey", "lineitem.l_orderkey -> part.p_partkey")
    cut = joins.orphan_audit(
        t("orders").select(F.when(F.col("o_custkey") % 5 != 0, F.when(F.col("o_custkey") % 7 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))).alias("k")),
        "k", t("customer"), "c_custkey", "orders.k -> customer.c_custkey")
    return good.unionByName(wrong).unionByName(cut)


def orphan_sql(name, child, key, parent, pkey) -> str:
    return f"""SELECT '{name}' AS edge, count(*) AS child_rows, count(*) - count({key}) AS null_rows,
  count(*) FILTER ({key} IS NOT NULL AND p IS NULL) AS orphan_rows, count(DISTINCT CASE WHEN p IS NULL THEN {key} END) AS orphan_keys
FROM {child} LEFT JOIN (SELECT DISTINCT {pkey} AS p FROM {parent}) ON {key} = p"""


SQL_ORPHAN_AUDIT = union_all([
    orphan_sql("orders.o_custkey -> customer.c_custkey", "orders", "o_custkey", "customer", "c_custkey"),
    orphan_sql("lineitem.l_orderkey -> part.p_partkey", "lineitem", "l_orderkey", "part", "p_partkey"),
    orphan_sql("orders.k -> customer.c_custkey", "(SELECT CASE WHEN o_custkey % 5 <> 0 THEN CASE WHEN o_custkey % 7 = 0 THEN -o_custkey ELSE o_custkey END END AS k FROM orders)",
               "k", "customer", "c_custkey")])


def q_fanout_audit(spark, sf):
    t = lambda n: table(spark, sf, n)
    a = joins.fanout_audit(t("orders"), "o_orderkey", "o_totalprice", t("lineitem"), "l_orderkey", "orders <- lineitem")
    b = joins.fanout_audit(t("orders"), "o_custkey", "o_totalprice", t("customer"), "c_custkey", "orders -> customer")
    return a.unionByName(b)


def fanout_sql(name, parent, key, measure, child, ckey) -> str:
    return f"""SELECT '{name}' AS edge, count(*) AS parent_rows, sum(m)::BIGINT AS joined_rows, max(m) AS max_matches,
  round(sum(x), 2) AS sum_before, round(sum(x * m), 2) AS sum_after, max(m) > 1 AS fans_out
FROM (SELECT {measure} AS x, coalesce(n, 0) AS m FROM {parent} LEFT JOIN (SELECT {ckey} AS k, count(*) AS n FROM {child} GROUP BY 1) ON {key} = k)"""


SQL_FANOUT_AUDIT = union_all([
    fanout_sql("orders <- lineitem", "orders", "o_orderkey", "o_totalprice", "lineitem", "l_orderkey"),
    fanout_sql("orders -> customer", "orders", "o_custkey", "o_totalprice", "customer", "c_custkey")])


def q_edge_cardinality(spark, sf):
    t = lambda n: table(spark, sf, n)
    a = keys.edge_cardinality(t("orders"), "o_custkey", t("customer"), "c_custkey", "orders -> customer")
    b = keys.edge_cardinality(t("labels"), "doc_id", t("documents"), "doc_id", "labels -> documents")
    c = keys.edge_cardinality(t("lineitem"), "l_suppkey", t("lineitem"), "l_partkey", "lineitem supplier -> part")
    return a.unionByName(b).unionByName(c)


def cardinality_sql(name, child, ckey, parent, pkey) -> str:
    return f"""SELECT '{name}' AS edge, c AS child_rows_per_key, p AS parent_rows_per_key,
  CASE WHEN c > 1 AND p > 1 THEN 'many-to-many' WHEN c > 1 THEN 'many-to-one' WHEN p > 1 THEN 'one-to-many' ELSE 'one-to-one' END AS cardinality
FROM (SELECT max(n) AS c FROM (SELECT count(*) AS n FROM {child} GROUP BY {ckey})), (SELECT max(n) AS p FROM (SELECT count(*) AS n FROM {parent} GROUP BY {pkey}))"""


SQL_EDGE_CARDINALITY = union_all([
    cardinality_sql("orders -> customer", "orders", "o_custkey", "customer", "c_custkey"),
    cardinality_sql("labels -> documents", "labels", "doc_id", "documents", "doc_id"),
    cardinality_sql("lineitem supplier -> part", "lineitem", "l_suppkey", "lineitem", "l_partkey")])

# --- discovery on business names ---------------------------------------------------------------

SCHEMA = {t: list(cols) for t, (_, cols) in RENAMED.items()}
PRIMARY_KEYS = primary_keys_by_name(SCHEMA)


def q_pk_candidates(spark, sf):
    tables = renamed_tables(spark, sf)
    return keys.pk_candidates({**tables, "tickets": tables["orders"].select(
        F.col("order_id").alias("ticket_id"), (F.col("order_id") + 7).alias("trace_id"), "customer_id")})


PK_COLUMNS = [(t, c) for t, cols in {**SCHEMA, "tickets": ["ticket_id", "trace_id", "customer_id"]}.items() for c in cols
              if c.endswith("_id") and not names.names_other_table(c, t, [*SCHEMA, "tickets"])]
TICKETS_SQL = "(SELECT o_orderkey AS ticket_id, o_orderkey + 7 AS trace_id, o_custkey AS customer_id FROM orders)"


def _source(t: str) -> str:
    return TICKETS_SQL if t == "tickets" else renamed_sql(t)


SQL_PK_CANDIDATES = "WITH u AS (" + union_all(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", {str(names.Name.of(c).flat in names.own_key_names(t)).upper()} AS prim,
  count(*) AS "rows", count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AND count(*) > 0 AS uniq FROM {_source(t)}""" for t, c in PK_COLUMNS
) + """) SELECT "table", "column", "rows", candidates, candidates = 1 OR (prim AND named = 1) AS chosen
FROM (SELECT *, count(*) OVER (PARTITION BY "table") AS candidates, count(*) FILTER (prim) OVER (PARTITION BY "table") AS named FROM u WHERE uniq)"""


def _discovered(spark, sf):
    """The mapping of these tables, kept as a table: it is small and read several times."""
    return stored(keys.discover_edges(renamed_tables(spark, sf), PRIMARY_KEYS), "mapping")


def q_fk_best_target(spark, sf):
    tables = renamed_tables(spark, sf)
    best = keys.best_targets(spark, tables, candidate_pairs(tables, PRIMARY_KEYS))
    return best.select("source_table", "source_column", "target_table", "target_column", "matched",
                       F.round("ratio", 4).alias("ratio"), "ambiguous")


def q_fk_scores(spark, sf):
    return keys.discover_edges(renamed_tables(spark, sf), PRIMARY_KEYS).select(
        "source_table", "source_column", "target_table", "target_column", F.round("ratio", 4).alias("ratio"), "name_match",
        "score", "groups", "state", "bucket", "review_status", "confidence_level", "confidence_band")


def _schema_frames():
    """Empty stand-ins with the columns' type families, to build the name facts without a session."""
    from pyspark.sql import types as T

    kind = {"double": T.DoubleType(), "long": T.LongType(), "string": T.StringType(), "ts": T.TimestampNTZType()}
    text = {"region_name", "nation_name", "name", "market_segment", "product_name", "brand", "type", "status", "priority", "return_flag"}
    ts = {"order_date", "ship_date"}

    class Shape:
        def __init__(self, cols):
            self.columns = cols
            self.schema = T.StructType([
                T.StructField(c, kind["string" if c in text else "ts" if c in ts else "long" if c.endswith("_id") or c in ("size", "line_no") else "double"])
                for c in cols])

    return {t: Shape(cols) for t, cols in SCHEMA.items()}


FACTS = candidate_pairs(_schema_frames(), PRIMARY_KEYS)


def _facts_sql() -> str:
    def lit(v):
        return str(v).upper() if isinstance(v, bool) else f"'{v}'"

    columns = list(vars(FACTS[0]))
    rows = ",\n".join("(" + ", ".join(lit(v) for v in vars(f).values()) + ")" for f in FACTS)
    return f"facts({', '.join(columns)}) AS (VALUES {rows})"


_SIDES = sorted({(f.source_table, f.source_column) for f in FACTS} | {(f.target_table, f.target_column) for f in FACTS})

BEST_CTES = f"""{_facts_sql()}, vals AS ({distinct_sql(_SIDES, renamed_sql)}),
sizes AS (SELECT t, c, count(*) AS n, min(v) AS lo, max(v) AS hi FROM vals GROUP BY 1, 2), p AS ({PAIR_SQL}),
n_rows AS ({union_all(f"SELECT '{t}' AS source_table, count(*) AS source_rows FROM {renamed_sql(t)}" for t in SCHEMA)}),
hits AS (SELECT *, CASE WHEN best_named THEN 10 WHEN self_reference AND matched = source_distinct THEN 9 ELSE 0 END AS boost
  FROM facts JOIN p USING (source_table, source_column, target_table, target_column) JOIN n_rows USING (source_table)
  WHERE ratio >= 0.85 AND CASE WHEN reference_name OR composite_member THEN source_distinct >= 2
    ELSE source_distinct >= 10 AND source_distinct >= 0.05 * source_rows END),
ranked AS (SELECT *, row_number() OVER w AS nth, lead(ratio) OVER w AS r2, lead(matched) OVER w AS m2, lead(boost) OVER w AS b2,
    lead(target_distinct) OVER w AS d2, max(ratio) OVER (PARTITION BY source_table, source_column) AS r1 FROM hits
  WINDOW w AS (PARTITION BY source_table, source_column ORDER BY ratio DESC, matched DESC, boost DESC, target_distinct,
    target_table DESC, target_column DESC)),
tied AS (SELECT *, count(*) FILTER (r1 - ratio < 0.05 AND target_column = source_column AND NOT target_is_member)
  OVER (PARTITION BY source_table, source_column) AS same_key FROM ranked),
best AS (SELECT *, (r2 IS NOT NULL AND ratio = r2 AND matched = m2 AND boost = b2 AND target_distinct = d2 AND NOT by_name_only)
  OR (r2 IS NOT NULL AND ((ratio - r2 < 0.03 AND abs(matched - m2) <= greatest(2, floor(matched * 0.05))
        AND NOT (boost > b2 AND best_named AND NOT d2 < 0.5 * target_distinct) AND NOT target_distinct < 0.5 * d2
        AND NOT (boost >= 9 AND source_table = target_table AND matched = source_distinct)) OR same_key >= 3))
  OR (any_best_named AND NOT best_named)
  OR (boost = 0 AND source_distinct < 0.6 * target_distinct
      AND (source_high - source_low + 1 <= source_distinct * 1.5 OR NOT reference_name))
  OR (NOT name_match AND NOT composite_member AND source_table <> target_table AND (target_is_member OR shared_target)) AS ambiguous
  FROM tied WHERE nth = 1)"""

SQL_FK_BEST_TARGET = f"""WITH {BEST_CTES} SELECT source_table, source_column, target_table, target_column, matched,
  round(ratio, 4) AS ratio, ambiguous FROM best"""

SCORED_CTES = f"""{BEST_CTES}, scored AS (SELECT *, least(greatest(
    CASE WHEN schema_match THEN 5 ELSE 0 END + CASE WHEN name_match THEN 25 ELSE 0 END + CASE WHEN type_match THEN 15 ELSE 0 END
    + CASE WHEN ratio >= 0.99 THEN 30 WHEN ratio >= 0.95 THEN 25 WHEN ratio >= 0.8 THEN 18 ELSE 0 END + 20
    + CASE WHEN source_distinct < 0.9 * target_distinct THEN 10 ELSE 0 END, 0), 100) AS score,
  2 + name_match::INT AS groups, code_name AND NOT name_match AS veto FROM best),
graded AS (SELECT *, CASE WHEN ambiguous THEN 'UNCERTAIN' WHEN veto THEN 'REJECTED' WHEN score >= 80 AND groups >= 2 THEN 'CONFIRMED'
    WHEN score >= 60 THEN 'PROBABLE' ELSE 'UNCERTAIN' END AS state,
  CASE WHEN ambiguous THEN 'ambiguous' WHEN veto THEN 'rejected' ELSE 'inferred' END AS bucket,
  CASE WHEN ambiguous THEN 'review' WHEN veto THEN 'rejected' WHEN score >= 80 THEN 'auto-accept' WHEN score >= 60 THEN 'flagged' ELSE 'review' END AS review_status,
  CASE WHEN score >= 90 THEN 'VERY_HIGH' WHEN score >= 80 THEN 'HIGH' WHEN score >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level,
  CASE WHEN score >= 90 THEN 'High' WHEN score >= 75 THEN 'Medium' WHEN score >= 60 THEN 'Possible' ELSE 'Low' END AS confidence_band FROM scored)"""

SQL_FK_SCORES = f"""WITH {SCORED_CTES} SELECT source_table, source_column, target_table, target_column, round(ratio, 4) AS ratio,
  name_match, score, groups, state, bucket, review_status, confidence_level, confidence_band FROM graded"""


def _accepted(spark, sf):
    return _discovered(spark, sf).where((F.col("bucket") == "inferred") & F.col("state").isin("CONFIRMED", "PROBABLE"))


def q_fk_quality(spark, sf):
    return edges.fk_quality(_accepted(spark, sf), edges.edge_rows(spark, KNOWN_EDGES))


KNOWN_SQL = "known(source_table, source_column, target_table, target_column) AS (VALUES " + ", ".join(str(e) for e in KNOWN_EDGES) + ")"
ACCEPTED_SQL = "accepted AS (SELECT * FROM graded WHERE bucket = 'inferred' AND state IN ('CONFIRMED', 'PROBABLE'))"

SQL_FK_QUALITY = f"""WITH {SCORED_CTES}, {ACCEPTED_SQL}, {KNOWN_SQL},
c AS (SELECT count(*) FILTER (a.score IS NOT NULL AND k.target_column IS NOT NULL) AS tp, count(*) FILTER (k.target_column IS NULL) AS fp,
  count(*) FILTER (a.score IS NULL) AS fn FROM accepted a FULL JOIN known k USING (source_table, source_column, target_table, target_column))
SELECT tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round(fp / (tp + fp), 4) AS fpr, round(fn / (tp + fn), 4) AS fnr FROM c"""


def _key_rows(spark):
    return small_frame(spark, [(t, c) for t, cols in PRIMARY_KEYS.items() for c in cols], "table string, column string")


def q_edge_trust(spark, sf):
    found = _accepted(spark, sf).select(*edges.EDGE, F.lit("inferred").alias("type"), "score")
    return edges.edge_trust(found, _key_rows(spark))


SQL_EDGE_TRUST = f"""WITH {SCORED_CTES}, {ACCEPTED_SQL} SELECT source_table, source_column, target_table, target_column, 'inferred' AS type,
  CASE WHEN score >= 80 THEN 'HIGH_CONFIDENCE_INFERRED' WHEN score >= 60 THEN 'MEDIUM_CONFIDENCE_INFERRED' ELSE 'LOW_CONFIDENCE_INFERRED' END AS trust,
  'many_to_one' AS cardinality FROM accepted"""


def q_edge_lists(spark, sf):
    return edges.edge_lists(_accepted(spark, sf))


SQL_EDGE_LISTS = f"""WITH {SCORED_CTES}, {ACCEPTED_SQL},
o AS (SELECT source_table AS t, string_agg(format('{{}} -> {{}}.{{}}', source_column, target_table, target_column), '; ' ORDER BY format('{{}} -> {{}}.{{}}', source_column, target_table, target_column)) AS outgoing FROM accepted GROUP BY 1),
i AS (SELECT target_table AS t, string_agg(format('{{}}.{{}} -> {{}}', source_table, source_column, target_column), '; ' ORDER BY format('{{}}.{{}} -> {{}}', source_table, source_column, target_column)) AS incoming FROM accepted GROUP BY 1)
SELECT t AS "table", coalesce(outgoing, '') AS outgoing, coalesce(incoming, '') AS incoming FROM o FULL JOIN i USING (t)"""

ITEM_KEY = [("order_items", "order_id"), ("order_items", "product_id"), ("orders", "order_id")]


def q_junction_tables(spark, sf):
    members = small_frame(spark, ITEM_KEY, "table string, column string")
    return edges.junction_tables(_accepted(spark, sf), members)


SQL_JUNCTION = f"""WITH {SCORED_CTES}, {ACCEPTED_SQL}
SELECT source_table AS junction_table, string_agg(DISTINCT source_column, ',' ORDER BY source_column) AS "columns",
  string_agg(DISTINCT target_table, ',' ORDER BY target_table) AS tables FROM accepted
WHERE source_table = 'order_items' AND source_column IN ('order_id', 'product_id') GROUP BY 1 HAVING count(DISTINCT target_table) >= 2"""


def q_mapping_summary(spark, sf):
    tables = renamed_tables(spark, sf)
    return edges.mapping_summary(_discovered(spark, sf), profile.row_counts(tables))


SQL_MAPPING_SUMMARY = f"""WITH {SCORED_CTES}
SELECT (SELECT count(*) FROM n_rows) AS total_tables, (SELECT count(*) FROM n_rows WHERE source_rows = 0) AS empty_tables,
  (SELECT sum(source_rows)::BIGINT FROM n_rows) AS total_rows, 0 AS declared_fk_count,
  count(*) FILTER (bucket = 'inferred') AS inferred_fk_count, count(*) FILTER (bucket = 'inferred' AND state IN ('CONFIRMED', 'PROBABLE')) AS strong_fk_count,
  count(*) FILTER (bucket = 'inferred' AND state NOT IN ('CONFIRMED', 'PROBABLE')) AS weak_fk_count,
  count(*) FILTER (review_status IN ('flagged', 'review')) AS review_count, count(*) FILTER (bucket = 'rejected') AS rejected_count FROM graded"""

DECLARED = KNOWN_EDGES[:3]


def q_edges_merged(spark, sf):
    tables = renamed_tables(spark, sf)
    declared = edges.edge_rows(spark, [*DECLARED, ("orders", "clerk_id", "clerks", "clerk_id")])
    return edges.merged_edges(declared, _accepted(spark, sf), edges.catalog(tables)).select(*edges.EDGE, "type", "score", "known")


SQL_EDGES_MERGED = f"""WITH {SCORED_CTES}, {ACCEPTED_SQL}, declared(source_table, source_column, target_table, target_column) AS
(VALUES {', '.join(str(e) for e in [*DECLARED, ('orders', 'clerk_id', 'clerks', 'clerk_id')])})
SELECT source_table, source_column, target_table, target_column, CASE WHEN d.f THEN 'declared' ELSE 'inferred' END AS type,
  a.score::DOUBLE AS score, target_table <> 'clerks' AS known
FROM accepted a FULL JOIN (SELECT *, TRUE AS f FROM declared) d USING (source_table, source_column, target_table, target_column)"""


#: The edges that a join uses: the known ones, a weak one, and two that no mapping holds.
USED = [*KNOWN_EDGES, ("order_items", "line_no", "nations", "nation_id"), ("orders", "clerk_id", "clerks", "clerk_id"), ("orders", "total", "products", "price")]


def q_edge_warnings(spark, sf):
    return edges.uncertain_edges(_discovered(spark, sf), edges.edge_rows(spark, USED))


SQL_EDGE_WARNINGS = f"""WITH {SCORED_CTES} SELECT source_table, source_column, target_table, target_column, score, state, ambiguous,
  CASE WHEN score >= 80 THEN 'HIGH_CONFIDENCE_INFERRED' WHEN score >= 60 THEN 'MEDIUM_CONFIDENCE_INFERRED' ELSE 'LOW_CONFIDENCE_INFERRED' END AS trust
FROM graded SEMI JOIN (VALUES {', '.join(str(e) for e in USED)}) u(source_table, source_column, target_table, target_column)
USING (source_table, source_column, target_table, target_column) WHERE state = 'UNCERTAIN' OR ambiguous OR score < 80"""


def q_edge_hints(spark, sf):
    tables = renamed_tables(spark, sf)
    hints = edges.edge_rows(spark, [
        ("orders", "customer_id", "customers", "customer_id"), ("orders", "total", "products", "price"),
        ("order_items", "line_no", "products", "product_id"), ("orders", "clerk_id", "clerks", "clerk_id")])
    out = edges.with_hints(_discovered(spark, sf), hints, edges.catalog(tables), edges.edge_rows(spark, DECLARED), _key_rows(spark))
    return out.select(*edges.EDGE, "score", "groups", "state", "bucket")


SQL_EDGE_HINTS = f"""WITH {SCORED_CTES}, h AS (SELECT source_table, source_column, target_table, target_column,
  least(score + CASE WHEN source_table = 'orders' AND source_column = 'customer_id' THEN 20 ELSE 0 END, 100) AS score,
  groups + CASE WHEN source_table = 'orders' AND source_column = 'customer_id' THEN 1 ELSE 0 END AS groups, ambiguous, veto, bucket FROM graded)
SELECT source_table, source_column, target_table, target_column, score, groups, CASE WHEN ambiguous THEN 'UNCERTAIN' WHEN veto THEN 'REJECTED'
  WHEN score >= 80 AND groups >= 2 THEN 'CONFIRMED' WHEN score >= 60 THEN 'PROBABLE' ELSE 'UNCERTAIN' END AS state, bucket FROM h
UNION ALL SELECT 'order_items', 'line_no', 'products', 'product_id', 70, 2, 'PROBABLE', 'inferred'
WHERE NOT EXISTS (SELECT 1 FROM graded WHERE source_table = 'order_items' AND source_column = 'line_no')"""


def q_cross_schema(spark, sf):
    plain = renamed_tables(spark, sf)
    home = {"order_items": "sales", "orders": "sales", "customers": "crm", "products": "stock", "suppliers": "stock", "nations": "geo", "regions": "geo"}
    tables = {f"{home[t]}.{t}": df for t, df in plain.items()}
    cols = [(t, c) for t, df in tables.items() for c in df.columns if c.endswith("_id")]
    targets = [(f"{home[t]}.{t}", c) for t, keyed in PRIMARY_KEYS.items() for c in keyed]
    known = edges.edge_rows(spark, [("sales.orders", "customer_id", "crm.customers", "customer_id")])
    return edges.cross_schema_candidates(keys.fk_containment(tables, cols, targets), known)


_HOME = {"order_items": "sales", "orders": "sales", "customers": "crm", "products": "stock", "suppliers": "stock", "nations": "geo", "regions": "geo"}
SQL_CROSS_SCHEMA = "WITH vals AS (" + union_all(
    f"SELECT DISTINCT '{_HOME[t]}.{t}' AS t, '{c}' AS c, {c}::DOUBLE AS v FROM {renamed_sql(t)}"
    for t, cols in SCHEMA.items() for c in cols if c.endswith("_id")) + f"""),
sizes AS (SELECT t, c, count(*) AS n, min(v) AS lo, max(v) AS hi FROM vals GROUP BY 1, 2), p AS ({PAIR_SQL})
SELECT source_table, source_column, target_table, target_column, source_distinct, target_distinct, matched, round(ratio, 4) AS ratio FROM p
WHERE ratio >= 0.85 AND split_part(source_table, '.', 1) <> split_part(target_table, '.', 1)
  AND (target_table, target_column) IN ({', '.join(f"('{_HOME[t]}.{t}', '{c}')" for t, cols in PRIMARY_KEYS.items() for c in cols)})
  AND NOT (source_table = 'sales.orders' AND source_column = 'customer_id' AND target_table = 'crm.customers')"""

def q_profile_columns(spark, sf):
    return keys.profiled_columns(renamed_tables(spark, sf))


PROFILED = [(t, f.name) for t, shape in _schema_frames().items() for f in shape.schema.fields
            if names.is_profiled(f.name, keys.type_family(f.dataType) == "numeric") or names.is_reference_name(f.name)]
SQL_PROFILE_COLUMNS = union_all(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", count(*) AS "rows", count({c}) AS non_null, count(DISTINCT {c}) AS "distinct",
  {str(names.is_reference_name(c)).upper()} AS reference_name, {str(names.is_code_name(c)).upper()} AS code_name FROM {renamed_sql(t)}""" for t, c in PROFILED)

PAIR_SOURCES = [(t, c) for t, cols in SCHEMA.items() for c in cols if c.endswith("_id") or c in ("status", "brand")]
PAIR_TARGETS = [(t, c) for t, cols in PRIMARY_KEYS.items() for c in cols]


def q_type_compatible_pairs(spark, sf):
    return keys.compatible_pairs(renamed_tables(spark, sf), PAIR_SOURCES, PAIR_TARGETS)


SQL_TYPE_COMPATIBLE = union_all(
    f"""SELECT '{st}' AS source_table, '{sc}' AS source_column, '{tt}' AS target_table, '{tc}' AS target_column, 'numeric' AS family,
  count(b.v) AS matched, round(count(b.v) / count(*), 4) AS ratio
FROM (SELECT DISTINCT {sc} AS v FROM {renamed_sql(st)}) a LEFT JOIN (SELECT DISTINCT {tc} AS v FROM {renamed_sql(tt)}) b ON a.v = b.v"""
    for st, sc in PAIR_SOURCES if sc.endswith("_id") for tt, tc in PAIR_TARGETS if (st, sc) != (tt, tc))


def q_fk_candidates(spark, sf):
    """Every candidate pair names and types allow, with its measured containment."""
    tables = renamed_tables(spark, sf)
    found = candidate_pairs(tables, PRIMARY_KEYS)
    sources = sorted({(c.source_table, c.source_column) for c in found})
    pairs = keys.compatible_pairs(tables, sources, PAIR_TARGETS)
    facts = small_frame(spark, [(c.source_table, c.source_column, c.target_table, c.target_column, c.name_match, c.reference_name) for c in found],
                        "source_table string, source_column string, target_table string, target_column string, name_match boolean, reference_name boolean")
    return facts.join(pairs, edges.EDGE).drop("family")


SQL_FK_CANDIDATES = union_all(
    f"""SELECT '{f.source_table}' AS source_table, '{f.source_column}' AS source_column, '{f.target_table}' AS target_table, '{f.target_column}' AS target_column,
  {str(f.name_match).upper()} AS name_match, {str(f.reference_name).upper()} AS reference_name, count(b.v) AS matched, round(count(b.v) / count(*), 4) AS ratio
FROM (SELECT DISTINCT {f.source_column} AS v FROM {renamed_sql(f.source_table)}) a
LEFT JOIN (SELECT DISTINCT {f.target_column} AS v FROM {renamed_sql(f.target_table)}) b ON a.v = b.v""" for f in FACTS)


def q_edges_canonical(spark, sf):
    found = _accepted(spark, sf).select(*edges.EDGE)
    stray = edges.edge_rows(spark, [("orders", "clerk_id", "clerks", "clerk_id"), ("orders", "customer_id", "customers", "customer_id")])
    return edges.canonical_edges(found.unionByName(stray), edges.catalog(renamed_tables(spark, sf)))


SQL_EDGES_CANONICAL = f"""WITH {SCORED_CTES}, {ACCEPTED_SQL} SELECT DISTINCT source_table, source_column, target_table, target_column FROM accepted"""


def q_edge_drift(spark, sf):
    before = edges.edge_rows(spark, [*KNOWN_EDGES[1:], ("order_items", "line_no", "products", "product_id")])
    return edges.edge_drift(before, _accepted(spark, sf))


SQL_EDGE_DRIFT = f"""WITH {SCORED_CTES}, {ACCEPTED_SQL}, {KNOWN_SQL}, was AS (SELECT * FROM known WHERE source_table <> 'nations'
  UNION ALL SELECT 'order_items', 'line_no', 'products', 'product_id'), now AS (SELECT source_table, source_column, target_table, target_column FROM accepted)
SELECT *, 'edge_added' AS change FROM (SELECT * FROM now EXCEPT SELECT * FROM was) UNION ALL SELECT *, 'edge_removed' FROM (SELECT * FROM was EXCEPT SELECT * FROM now)"""


def q_schema_drift(spark, sf):
    """The orders table against what a text export of it turns into when its types are inferred."""
    from tallyspark.plans.profiling import messy_orders
    from tallyspark.sources.tables import typed_table

    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("active"),
        F.col("o_orderpriority").alias("note"), F.col("o_custkey").alias("customer_id"))
    export = typed_table(messy_orders(spark, sf).select("order_id", "amount", "active", "note", "currency"))
    before = {"orders": orders, "nations": table(spark, sf, "nation")}
    return edges.schema_drift(edges.catalog(before), edges.catalog({"orders": export, "exports": export.select("order_id")}))


SQL_SCHEMA_DRIFT = """WITH t AS (SELECT CASE WHEN bool_and(o_orderstatus IS NOT NULL) THEN 'boolean' END AS active FROM orders)
SELECT 'type_changed' AS change, 'orders' AS "table", 'active' AS "column", 'string' AS was, active AS now FROM t
UNION ALL SELECT 'column_added', 'orders', 'currency', NULL, 'string' UNION ALL SELECT 'column_removed', 'orders', 'customer_id', 'bigint', NULL
UNION ALL SELECT 'table_added', 'exports', NULL, NULL, NULL UNION ALL SELECT 'table_removed', 'nations', NULL, NULL, NULL"""


def q_table_kinds(spark, sf):
    tables = renamed_tables(spark, sf)
    tables["readings"] = table(spark, sf, "events").select(F.col("event_id").alias("reading_id"), "value")
    return edges.table_kinds(edges.catalog(tables), _accepted(spark, sf))


SQL_TABLE_KINDS = f"""WITH {SCORED_CTES}, {ACCEPTED_SQL}, t(name, fact, txt) AS (VALUES ('regions', FALSE, TRUE), ('nations', FALSE, TRUE), ('customers', FALSE, TRUE),
  ('suppliers', FALSE, TRUE), ('products', FALSE, TRUE), ('orders', FALSE, TRUE), ('order_items', FALSE, TRUE), ('readings', TRUE, FALSE))
SELECT name AS "table", fact AS pure_fact, txt OR name IN (SELECT target_table FROM accepted) AS entity FROM t"""

def q_join_path(spark, sf):
    """Order lines with columns of four tables, joined along the smallest tree of the edges found in the data."""
    tables = renamed_tables(spark, sf)
    columns = {"order_id": "order_id", "line_no": "line_no", "segment": "market_segment", "nation": "nation_name", "region": "region_name", "brand": "brand"}
    return paths.denormalize_columns(tables, _accepted(spark, sf), "order_items", columns)


SQL_JOIN_PATH = """SELECT l_orderkey AS order_id, l_linenumber AS line_no, c_mktsegment AS segment, n_name AS nation, r_name AS region, p_brand AS brand
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey"""


QUERIES = {
    "profile_columns": (q_profile_columns, SQL_PROFILE_COLUMNS),
    "type_compatible_pairs": (q_type_compatible_pairs, SQL_TYPE_COMPATIBLE),
    "fk_candidates": (q_fk_candidates, SQL_FK_CANDIDATES),
    "edges_canonical": (q_edges_canonical, SQL_EDGES_CANONICAL),
    "edge_drift": (q_edge_drift, SQL_EDGE_DRIFT),
    "schema_drift": (q_schema_drift, SQL_SCHEMA_DRIFT),
    "table_kinds": (q_table_kinds, SQL_TABLE_KINDS),
    "fk_containment": (q_fk_containment, SQL_FK_CONTAINMENT),
    "join_path": (q_join_path, SQL_JOIN_PATH),
    "fk_composite": (q_fk_composite, _composite_sql()),
    "composite_containment": (q_composite_containment, SQL_COMPOSITE),
    "orphan_audit": (q_orphan_audit, SQL_ORPHAN_AUDIT),
    "fanout_audit": (q_fanout_audit, SQL_FANOUT_AUDIT),
    "edge_cardinality": (q_edge_cardinality, SQL_EDGE_CARDINALITY),
    "pk_candidates": (q_pk_candidates, SQL_PK_CANDIDATES),
    "fk_best_target": (q_fk_best_target, SQL_FK_BEST_TARGET),
    "fk_scores": (q_fk_scores, SQL_FK_SCORES),
    "fk_quality": (q_fk_quality, SQL_FK_QUALITY),
    "edge_trust": (q_edge_trust, SQL_EDGE_TRUST),
    "edge_lists": (q_edge_lists, SQL_EDGE_LISTS),
    "junction_tables": (q_junction_tables, SQL_JUNCTION),
    "mapping_summary": (q_mapping_summary, SQL_MAPPING_SUMMARY),
    "edges_merged": (q_edges_merged, SQL_EDGES_MERGED),
    "edge_warnings": (q_edge_warnings, SQL_EDGE_WARNINGS),
    "edge_hints": (q_edge_hints, SQL_EDGE_HINTS),
    "cross_schema_candidates": (q_cross_schema, SQL_CROSS_SCHEMA),
}
