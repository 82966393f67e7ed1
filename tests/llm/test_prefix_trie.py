import hashlib
import random
import zlib

from tallyspark.llm import prefix_trie
from tallyspark.llm.prefix_trie import numbered, trie, with_shared_openings
from tallyspark.llm.tree_contraction import subtree_sums


def brute(rows):
    own = {}
    for c, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows if c is not None),
                                      key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3])):
        own.setdefault(c, []).append((role, text))
    paths = {c: (own.get(int(c / 100) * 100, [])[:h] + turns[h:]) for c, turns in own.items() for h in [zlib.crc32(str(c).encode()) % 6]}
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    kids = dict.fromkeys(members, 0)
    for n in members:
        if n:
            kids[n[:-1]] += 1
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(n)).encode()).hexdigest())
                  for n, m in members.items())


SCHEMA = "conv_id bigint, turn bigint, role string, text string, node string, depth int, pos int, said string, n string, parent string"


def found(spark, rows):
    turns = spark.createDataFrame([(*r, "x", 1, 2, "y", "z", None) for r in rows], SCHEMA)
    return sorted(map(tuple, built(turns).collect()))


def built(turns):
    said, convs = numbered(turns)
    return trie(with_shared_openings(said, convs), convs)


def test_shared_openings_and_odd_rows(spark):
    draw = random.Random(3)
    rows = [(c, t, ("user", "assistant")[t % 2], draw.choice(["a", "bb", "", "ß😀"]) * draw.randint(0, 2)) for c in [*range(0, 12), *range(95, 130), 300, 301]
            for t in range(draw.randint(1, 9))]
    rows += [(5, None, None, None), (5, 2, None, "x"), (5, 2, "user", None), (5, 2, "user", None), (None, 1, "user", "lost"), (None, None, None, None)]
    rows += [(777, 0, "user", "base missing"), (1000, 0, "a\nb", "c"), (1001, 0, "a", "b\nc"), (-5, 0, "user", "below zero")]
    assert found(spark, rows) == brute(rows)


def test_a_long_and_a_common_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rows = [(50, t, "user", f"t{t % 7}") for t in range(220)] + [(51, t, "user", f"t{t % 7}") for t in range(190)]
    rows += [(c, t, "user", "same") for c in range(200, 500) for t in range(3)]
    assert found(spark, rows) == brute(rows)


def test_no_turns(spark):
    assert found(spark, []) == []


def test_sums_of_trees(spark):
    """Chains, stars, binary trees, combs and random trees, as one forest."""
    n, draw = 150, random.Random(4)
    shapes = [lambda i: i - 1, lambda i: 0, lambda i: (i - 1) // 2, lambda i: max(0, i - 1 - i % 2), lambda i: draw.randrange(max(0, i - 4), i),
              lambda i: None if i % 30 == 0 else i - 1]
    up = {}
    for k, parent in enumerate(shapes):
        for i in range(n):
            p = parent(i) if i else None
            up[k * n + i] = None if p is None else k * n + p
    depth, value = {}, {i: draw.randrange(-5, 100) for i in up}
    for i in up:
        depth[i] = 0 if up[i] is None else depth[up[i]] + 1
    want, size = dict(value), dict.fromkeys(up, 1)
    for i in reversed(up):
        if up[i] is not None:
            want[up[i]] += want[i]
            size[up[i]] += size[i]
    tree = spark.createDataFrame([(i, up[i], depth[i], value[i], 1) for i in up], "node bigint, parent bigint, depth bigint, v bigint, one bigint")
    sums = subtree_sums(tree, ["v", "one"]).collect()
    assert {r.node: (r.v, r.one) for r in sums} == {i: (want[i], size[i]) for i in up} and len(sums) == len(up)


def test_sums_of_no_tree(spark):
    assert subtree_sums(spark.createDataFrame([], "node bigint, parent bigint, depth bigint, v bigint"), ["v"]).collect() == []
