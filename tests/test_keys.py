from pyspark.sql import functions as F

from tallyspark.functions import names
from tallyspark.operators import edges, keys


def test_name_rules():
    assert names.words("MediaTypeId") == ["media", "type", "id"] and names.words("support_rep_id") == ["support", "rep", "id"]
    assert [names.singular(w) for w in ("categories", "orders", "class", "ties")] == ["category", "order", "class", "tie"]
    assert [names.plural(w) for w in ("category", "box", "day", "order")] == ["categories", "boxes", "days", "orders"]
    assert names.is_identifier("orderId", "suffix") and names.is_identifier("paid", "wide") and not names.is_identifier("paid")
    assert names.is_code_name("country_code") and not names.is_code_name("customer_id")
    assert names.named_tables("customer_id", ["customers", "orders"]) == ["customers"]
    assert names.names_other_table("order_id", "payments", ["orders", "payments"])
    assert not names.names_other_table("order_id", "orders", ["orders", "payments"])
    assert names.label_column({"id": "numeric", "city": "text", "full_name": "text"}) == "full_name"
    assert names.measure_column({"order_id": "numeric", "total": "numeric"}) == "total"
    assert names.resolve_measure("why did profit fall", ["sales", "profit"]) == "profit"
    assert names.resolve_dimensions("sales by region", ["city", "region"]) == ["region"]
    assert names.resolve_dimensions("sales", ["city", "kind", "shop", "zone"]) == ["city", "kind", "shop", "zone"]
    assert names.resolve_dimensions("sales", ["city", "kind", "shop", "zone"], most=2) == ["city", "kind"]
    assert names.Name.of("OrderItemID").words == ("order", "item", "id") and names.Name.of("OrderItemID").stems == {"order", "item"}
    assert names.named_tables("order_item_id", ["orders", "order_items"]) == ["order_items"]


def test_primary_keys_by_name():
    schema = {"orders": ["order_id", "customer_id"], "customers": ["id", "name"], "items": ["order_id", "product_id"], "notes": ["note_id", "text"]}
    assert keys.primary_keys_by_name(schema) == {"orders": ["order_id"], "customers": ["id"], "notes": ["note_id"]}


def graded(spark, score, groups, code, name, ambiguous):
    df = spark.createDataFrame([(score, groups, code, name, ambiguous)], "score int, groups int, code_name boolean, name_match boolean, ambiguous boolean")
    r = keys.decide(df).first()
    return r["bucket"], r["state"]


def test_acceptance(spark):
    assert graded(spark, 80, 1, False, False, False) == ("inferred", "PROBABLE")
    assert graded(spark, 80, 2, False, False, False) == ("inferred", "CONFIRMED")
    assert graded(spark, 95, 2, True, False, False) == ("rejected", "REJECTED")
    assert graded(spark, 95, 3, True, True, False) == ("inferred", "CONFIRMED")
    assert graded(spark, 95, 2, False, True, True) == ("ambiguous", "UNCERTAIN")
    assert graded(spark, 59, 2, False, False, False) == ("inferred", "UNCERTAIN")


def shop(spark):
    customers = spark.createDataFrame([(i * 3, f"c{i}") for i in range(40)], "customer_id int, name string")
    orders = spark.createDataFrame([(i + 1000, (i % 40) * 3.0, i % 3, float(i)) for i in range(200)], "order_id long, customer_id double, status int, total double")
    employees = spark.createDataFrame([(i, None if i == 0 else i // 2) for i in range(30)], "employee_id int, reports_to int")
    empty = spark.createDataFrame([], "return_id int, order_id long")
    return {"customers": customers, "orders": orders, "employees": employees, "returns": empty}


def test_discovery_on_a_small_shop(spark):
    tables = shop(spark)
    pk = keys.primary_keys_by_name({t: d.columns for t, d in tables.items()})
    assert pk == {"customers": ["customer_id"], "orders": ["order_id"], "employees": ["employee_id"], "returns": ["return_id"]}
    found = {(r["source_table"], r["source_column"]): r for r in keys.discover_edges(tables, pk).collect()}
    edge = found["orders", "customer_id"]
    assert (edge["target_table"], edge["state"], edge["ratio"]) == ("customers", "CONFIRMED", 1.0)
    own = found["employees", "reports_to"]
    assert (own["target_table"], own["ambiguous"]) == ("employees", False)
    by_name = found["returns", "order_id"]
    assert by_name["target_table"] == "orders" and by_name["ratio"] is None and by_name["state"] == "PROBABLE"


def test_values_compare_by_number_not_by_type(spark):
    a = spark.createDataFrame([(1.0, True, "1"), (2.5, False, "2"), (None, None, None)], "x double, b boolean, s string")
    b = spark.createDataFrame([(1,), (2,)], "id int")
    pairs = keys.containment({"a": a, "b": b}, [("a", "x"), ("a", "b"), ("a", "s"), ("b", "id")], [("b", "id")]).collect()
    assert {(r["source_column"], r["matched"], r["ratio"]) for r in pairs} == {("x", 1, 0.5)}


def test_masks_span_several_words(spark):
    wide = spark.range(50).select(*[(F.col("id") + i).alias(f"k{i}") for i in range(70)])
    columns = [("w", f"k{i}") for i in range(70)]
    got = {r["source_column"]: (r["matched"], r["source_distinct"]) for r in keys.containment({"w": wide}, columns, [("w", "k0")]).collect()}
    assert got["k65" if "k65" in got else "k49"][0] == 1 and got["k10"] == (40, 50) and "k60" not in got


def test_edge_tables(spark):
    known = edges.edge_rows(spark, [("a", "b_id", "b", "id"), ("a", "c_id", "c", "id")])
    found = edges.edge_rows(spark, [("a", "b_id", "b", "id"), ("a", "x", "c", "id")])
    q = edges.fk_quality(found, known).first()
    assert (q["tp"], q["fp"], q["fn"], q["f1"]) == (1, 1, 1, 0.5)
    labels = spark.createDataFrame([("inferred", "llm-confirmed"), ("inferred", "85"), ("inferred", "0.65"), ("inferred", "maybe"), ("declared", None)], "k string, c string")
    got = [r[0] for r in labels.select(edges.trust(F.col("k"), F.col("c"))).collect()]
    assert got == ["HIGH_CONFIDENCE_INFERRED", "HIGH_CONFIDENCE_INFERRED", "MEDIUM_CONFIDENCE_INFERRED", "LOW_CONFIDENCE_INFERRED", "DECLARED"]
    before = spark.createDataFrame([("t", "a", "int"), ("u", "z", "int")], "table string, column string, data_type string")
    after = spark.createDataFrame([("t", "a", "string"), ("t", "b", "int")], "table string, column string, data_type string")
    assert {r["change"] for r in edges.schema_drift(before, after).collect()} == {"type_changed", "column_added", "table_removed"}
    bare = edges.catalog({"a": spark.range(1).withColumnRenamed("id", "b_id")})
    assert edges.canonical_edges(found, bare).count() == 0
    hood = {(r["table"], r["neighbour"]) for r in edges.both_directions(known).collect()}
    assert hood == {("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")}


def test_empty_key_columns_lose_their_edges(spark):
    from tallyspark.operators.profile import empty_columns

    a = spark.createDataFrame([(None, " "), (None, "")], "b_id int, c_id string")
    known = edges.edge_rows(spark, [("a", "b_id", "b", "id"), ("a", "c_id", "c", "id"), ("z", "b_id", "b", "id")])
    left = edges.drop_empty_key_edges(known, empty_columns(a, "a")).collect()
    assert [r["source_table"] for r in left] == ["z"]


def composite_shop(spark):
    lines = spark.createDataFrame([(o, n, float(o * n)) for o in range(1, 61) for n in range(1, 1 + o % 6 + 1)], "order_id long, line_no int, amount double")
    orders = spark.createDataFrame([(o, o % 3) for o in range(1, 61)], "order_id long, status int")
    have = [(r.order_id, r.line_no) for r in lines.collect()]
    returns = spark.createDataFrame([(i, float(o), n) for i, (o, n) in enumerate(have[::3])] + [(900, None, 1), (901, 5.0, None)], "return_id int, order_id double, line_no int")
    # Other names; one pair in nine does not exist.
    checks = spark.createDataFrame([(i, o, n if i % 9 else 7) for i, (o, n) in enumerate(have)], "check_id int, order_ref long, line_ref int")
    # Each column is in the key, the pairs are not.
    swapped = spark.createDataFrame([(i, o, 1 + (n + o) % 6) for i, (o, n) in enumerate(have)], "swap_id int, order_id long, line_no int")
    return {"lines": lines, "orders": orders, "returns": returns, "checks": checks, "swapped": swapped}


def test_composite_edges_equal_brute_force(spark):
    tables = composite_shop(spark)
    pk = {"lines": ["order_id", "line_no"], "orders": ["order_id"], "returns": ["return_id"], "checks": ["check_id"], "swapped": ["swap_id"]}
    rows = {t: [r.asDict() for r in df.collect()] for t, df in tables.items()}
    key = {(r["order_id"], r["line_no"]) for r in rows["lines"]}
    orders, numbers = ({k[i] for k in key} for i in (0, 1))
    want = {}
    for t, own in rows.items():
        columns = [c for c in own[0] if t != "lines"] if own else []
        for a in columns:
            for b in columns:
                first, second = {r[a] for r in own} - {None}, {r[b] for r in own} - {None}
                pairs = {(r[a], r[b]) for r in own if r[a] is not None and r[b] is not None}
                share = lambda x, y: len(x & y) / len(x)
                if a != b and share(first, orders) >= 0.85 and share(second, numbers) >= 0.85 and share(pairs, key) >= 0.85:
                    named = (a == "order_id") + (b == "line_no")
                    want.setdefault(t, []).append((-named, -share(pairs, key), f"{a}, {b}", len(pairs)))
    found = {r.source_table: r for r in keys.composite_edges(tables, pk).collect()}
    assert set(found) == set(want) >= {"returns", "checks"} and "swapped" not in found
    for t, options in want.items():
        _, ratio, columns, size = min(options)
        assert (found[t].source_column, found[t].source_distinct, found[t].target_column) == (columns, size, "order_id, line_no")
        assert abs(found[t].ratio + ratio) < 1e-12
    assert round(found["returns"].null_share * len(rows["returns"])) == 2 and found["returns"].name_match and not found["checks"].name_match
    edge = next(r for r in keys.discover_edges(tables, pk).collect() if r.source_table == "returns" and "," in r.source_column)
    assert (edge.bucket, edge.state, edge.ratio) == ("inferred", "CONFIRMED", 1.0)


def test_composite_edges_of_nothing(spark):
    tables = composite_shop(spark)
    assert keys.composite_edges(tables, {"orders": ["order_id"]}).collect() == []
    empty = {t: d.limit(0) for t, d in tables.items()}
    assert keys.composite_edges(empty, {"lines": ["order_id", "line_no"]}).collect() == []


def test_longer_mappings_need_all_their_parts():
    hit = lambda *pairs: frozenset(pairs)
    ones = {hit(("a", "x")), hit(("b", "y")), hit(("b", "x")), hit(("c", "z"))}
    twos = keys._longer(ones)
    assert hit(("a", "x"), ("b", "y")) in twos and hit(("a", "x"), ("b", "x")) not in twos and len(twos) == 4
    assert keys._longer(twos) == {hit(("a", "x"), ("b", "y"), ("c", "z"))}
    assert keys._longer(twos - {hit(("b", "y"), ("c", "z"))}) == set()


def test_tuples_are_short_and_told_apart(spark):
    """Tuples of numbers are no longer than their digits; equal only if all parts are, whatever signs texts hold."""
    rows = [(1, "2;", 3), (1, "2", 3), (12, ";", 3), (1, "12:s:2", 3), (1, "2;3;", 3), (1, "x" * 40, 3), (1, "x" * 41, 3), (1, None, 3), (123456789, "a", 7)]
    df = spark.createDataFrame(rows, "a bigint, b string, c int")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    found = [r[0] for r in df.select(keys.tuple_value(["a", "b", "c"], kinds)).collect()]
    assert found[7] is None and len(set(found)) == len(rows) and max(len(t) for t in found if t) <= 32
    swapped = [r[0] for r in df.select(keys.tuple_value(["b", "a", "c"], kinds)).collect()]
    assert not (set(found) & set(swapped)) - {None}
    numbers = df.select(keys.tuple_value(["a", "c"], kinds).alias("t"))
    assert numbers.agg(F.max(F.length("t"))).first()[0] <= 12
    whole = df.select(keys.tuple_value(["a", "c"], {**kinds, "c": kinds["a"]})).collect()
    assert whole == numbers.collect()
