import itertools
import random

import pytest

from tallyspark.operators import paths

SHOP = [("items", "order_id", "orders", "id"), ("items", "maker_id", "makers", "id"), ("orders", "customer_id", "customers", "id"),
        ("customers", "place_id", "places", "id"), ("makers", "place_id", "places", "id"), ("places", "land_id", "lands", "id")]


def brute(steps, start, tables):
    """All smallest trees, by trying every set of steps."""
    for size in range(len(steps) + 1):
        found = []
        for tree in itertools.combinations(steps, size):
            reached, grew = {start}, True
            while grew:
                grew = False
                for s in tree:
                    if s[0] in reached and s[2] not in reached:
                        reached.add(s[2])
                        grew = True
            if reached >= set(tables):
                found.append(frozenset(tree))
        if found:
            return set(found)
    return set()


def test_a_diamond():
    assert [s[2] for s in paths.join_plan(SHOP, "items", ["places"]).steps] == ["makers", "places"]
    assert [s[2] for s in paths.join_plan(SHOP, "items", ["places", "customers"]).steps] == ["orders", "customers", "places"]
    both = paths.join_plan(SHOP, "items", ["lands", "customers", "makers"])
    assert both.ambiguous and len(both.steps) == 5 and len(both.alternatives) == 1
    assert paths.join_plan(SHOP, "items", ["items"]).steps == ()
    with pytest.raises(ValueError, match="no foreign keys"):
        paths.join_plan(SHOP, "places", ["orders"])


@pytest.mark.parametrize("seed", range(25))
def test_trees_equal_brute_force(seed):
    draw = random.Random(seed)
    names = "abcdefg"
    steps = list(dict.fromkeys((s, f"{t}_id", t, "id") for s, t in ((draw.choice(names), draw.choice(names)) for _ in range(11)) if s != t))
    tables = draw.sample(names, 3)
    found = paths.smallest_trees(steps, "a", tables, most=1_000)
    assert {frozenset(t) for t in found} == brute(steps, "a", [*tables, "a"]) and len(found) == len(set(map(frozenset, found)))
    for tree in found:
        assert all(s[0] == "a" or s[0] in {x[2] for x in tree[:i]} for i, s in enumerate(tree))


def test_columns_by_name(spark):
    tables = {
        "items": spark.createDataFrame([(1, 10, 5.0), (1, 11, 6.0), (2, 10, 7.0), (None, 10, 8.0)], "order_id int, maker_id int, price double"),
        "orders": spark.createDataFrame([(1, 100, "x"), (2, 101, "y")], "id int, customer_id int, name string"),
        "customers": spark.createDataFrame([(100, 7, "ann"), (101, 8, "bob")], "id int, place_id int, name string"),
        "makers": spark.createDataFrame([(10, 7, "m"), (11, 8, "n")], "id int, place_id int, name string"),
        "places": spark.createDataFrame([(7, "here", 1), (8, "there", 1)], "id int, town string, land_id int"),
        "lands": spark.createDataFrame([(1, "L")], "id int, land string")}
    mapping = spark.createDataFrame(SHOP, "source_table string, source_column string, target_table string, target_column string")
    near = paths.denormalize_columns(tables, mapping, "items", {"price": "price", "town": "town"})
    assert sorted(map(tuple, near.collect())) == [(5.0, "here"), (6.0, "there"), (7.0, "here"), (8.0, "here")]
    far = paths.denormalize_columns(tables, mapping, "items", {"price": "price", "who": "customers.name", "town": "town"})
    assert sorted(map(tuple, far.collect())) == [(5.0, "ann", "here"), (6.0, "ann", "here"), (7.0, "bob", "there")]
    with pytest.raises(ValueError, match="say which"):
        paths.denormalize_columns(tables, mapping, "items", {"name": "name"})
    with pytest.raises(ValueError, match="as short as each other"):
        paths.denormalize_columns(tables, mapping, "items", {"a": "customers.name", "b": "makers.name", "c": "town"})
    assert paths.denormalize_columns(tables, mapping, "items", {"a": "customers.name", "b": "makers.name", "c": "town"}, "first").count() == 3
    with pytest.raises(ValueError, match="no table"):
        paths.denormalize_columns(tables, mapping, "items", {"x": "nowhere"})


def test_a_join_on_several_columns(spark):
    tables = {"returns": spark.createDataFrame([(1, 1, "bad"), (1, 3, "lost")], "order_id int, line int, why string"),
              "lines": spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0)], "order_id int, line_no int, price double")}
    mapping = spark.createDataFrame([("returns", "order_id, line", "lines", "order_id, line_no")],
                                    "source_table string, source_column string, target_table string, target_column string")
    assert paths.denormalize_columns(tables, mapping, "returns", {"why": "why", "price": "price"}).collect() == [("bad", 5.0)]
