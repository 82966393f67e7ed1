"""Sums over all subtrees of a tree held as a table, by parallel tree contraction.

A round first rakes: every leaf leaves the tree, its sum is final, and its parent gets it. Then it compresses:
in unary chains, nodes that are not neighbours are cut out, and the one child of such a node is hung below the
node's parent, with what it has to carry over. Both are joins on node numbers; a chain of n nodes takes about
log2(n) rounds, and so does a balanced tree. Once the root is raked, the cut-out nodes come back in the
opposite order: the sum of each is its own weight plus that of the child it was cut out above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.session import stored


def subtree_sums(tree: DataFrame, values: list[str]) -> DataFrame:
    """(node, and the sum of each value over the node and all below it) for a table (node, parent, depth, values).

    A root has a null parent; there may be several trees, or none. `depth` is the number of steps from the root,
    `values` are whole numbers. Nodes occur once. Every round is written to the shared folder, twice.
    """
    carry = [f"carry_{v}" for v in values]
    kids = tree.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    active = stored(tree.join(kids, "node", "left").select(
        "node", "parent", "depth", F.coalesce("kids", F.lit(0)).alias("kids"), *values, *(F.lit(0).cast("bigint").alias(c) for c in carry)), "tree")
    deepest = active.agg(F.max("depth")).first()[0]
    bits = max(1, int(deepest or 0).bit_length())
    raked, back, left = [active.where("kids = 0").select("node", *values)], [], deepest is not None
    while left:
        active = _compress(stored(_rake(active, values, carry), "tree-rest"), values, carry, len(back) % bits)
        left, cut = active.agg(F.count(F.lit(1)), F.count("cut")).first()
        if left:
            raked.append(active.where("kids = 0").select("node", *values))
        back.append(active.where("cut is not null").select(F.col("cut").alias("node"), F.col("node").alias("child"), *(
            F.col(f"cut_{v}").alias(v) for v in values)) if cut else None)
    known = []
    for k in range(len(back) - 1, -1, -1):
        if back[k] is not None:
            # The child was still there after round k: its sum comes from a later round.
            later = _union([*raked[k + 1:], *(b for r, b in known if r > k)])
            below = later.select(F.col("node").alias("child"), *(F.col(v).alias(f"below_{v}") for v in values))
            known.append((k, stored(back[k].join(below, "child").select("node", *(
                (F.col(v) + F.col(f"below_{v}")).alias(v) for v in values)), "tree-back")))
    return _union([*raked, *(b for _, b in known)])


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole


def _rake(active: DataFrame, values: list[str], carry: list[str]) -> DataFrame:
    """The nodes that are no leaves, with what their leaves gave them; `kids` counts the children that are left,
    `child` is one of them."""
    leaf = F.col("kids") == 0
    below = active.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.sum((~leaf).cast("bigint")).alias("inner"), F.min(F.when(~leaf, F.col("node"))).alias("child"),
        *(F.sum(F.when(leaf, F.col(v) + F.col(c)).otherwise(0)).alias(f"gift_{v}") for v, c in zip(values, carry)))
    return active.where(~leaf).join(below, "node").select(
        "node", "parent", "depth", F.col("inner").alias("kids"), "child",
        *((F.col(v) + F.col(f"gift_{v}")).alias(v) for v in values), *carry)


def _compress(rest: DataFrame, values: list[str], carry: list[str], bit: int) -> DataFrame:
    """The nodes without those cut out of chains. Where the parent of a node was cut out, `cut` names it and
    `cut_...` is what the parent's sum has besides the node's.

    A node with one child is cut out if its depth has the bit of this round, unless its parent is such a node
    too. So no two neighbours go at once, and one of any two neighbours in a chain goes in some round. The number
    of children of the others stays.
    """
    chosen = rest.where("parent is not null and kids = 1").where(F.shiftright("depth", bit) % 2 == 1)
    out = chosen.join(chosen.select(F.col("child").alias("node")), "node", "left_anti")
    over = out.select(F.col("child").alias("node"), F.col("node").alias("cut"), F.col("parent").alias("above"), *(
        F.col(x).alias(f"over_{x}") for x in [*values, *carry]))
    kept = rest.join(out.select("node"), "node", "left_anti").join(over, "node", "left")
    moved = F.col("cut").isNotNull()
    return stored(kept.select(
        "node", F.when(moved, F.col("above")).otherwise(F.col("parent")).alias("parent"), "depth", "kids", *values,
        *(F.when(moved, F.col(c) + F.col(f"over_{v}") + F.col(f"over_{c}")).otherwise(F.col(c)).alias(c) for v, c in zip(values, carry)),
        "cut", *((F.col(f"over_{v}") + F.col(c)).alias(f"cut_{v}") for v, c in zip(values, carry))), "tree-active")
