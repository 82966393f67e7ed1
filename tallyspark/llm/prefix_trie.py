"""The trie of all openings of conversations, with totals over every subtree.

A node is a sequence of first turns that conversations share. It is known by a 128-bit digest of running sums:
the digest of every turn together with its place, in four parts of 32 bits, is summed along the conversation. So
a long conversation is summed in blocks, by as many tasks as it has blocks. Subtree totals come from
parallel tree contraction (`tree_contraction`).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.hot import hot_keys, join_hot
from tallyspark.llm.tree_contraction import subtree_sums
from tallyspark.session import ship, stored

#: Turns of a conversation that are summed in one group.
BLOCK = 1_024
PARTS = ("s0", "s1", "s2", "s3")


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos from 1, said, chars) in order, and conversations (conv_id, n).

    Ordered by turn (null first), then role, then text; null roles and texts are empty. `said` is a digest of role
    and text, `chars` the code points of the text. Rows without a conversation id belong to none and are left
    out. All rows are sorted by ranges, so that a conversation of any length is spread over tasks; a place is the
    place within the range plus the conversation's rows in earlier ranges.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    # The bounds of the ranges reach the driver, so they hold the beginnings of texts only.
    ranges = rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, 32), F.substring("text", 1, 32))
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    placed = stored(ranges.sortWithinPartitions("conv_id", "turn", "role", "text").select(
        "conv_id", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("seq"),
        said.alias("said"), F.length("text").cast("bigint").alias("chars")), "trie-turns")
    starts = placed.groupBy("range", "conv_id").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(starts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))), "trie-starts")
    found = placed.join(starts.hint("merge"), ["range", "conv_id"]).select(
        "conv_id", (F.col("seq") - F.col("first") + F.col("before") + 1).alias("pos"), "said", "chars")
    return found, starts.groupBy("conv_id").agg(F.sum("rows").alias("n"))


def with_shared_openings(turns: DataFrame, convs: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """Conversation c with its first h turns replaced by the first h of conversation c - c % every (all it has if
    fewer, none if it does not exist), h being the CRC-32 of c in decimal, modulo most + 1."""
    def h(conv: Column) -> Column:
        return (F.crc32(conv.cast("string").cast("binary")) % (most + 1)).cast("bigint")

    base = F.col("conv_id") - F.col("conv_id") % every
    opening = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") <= most)).withColumnRenamed("conv_id", "base")
    opening = stored(opening, "trie-openings")
    heads = convs.select("conv_id", base.alias("base")).join(opening, "base").where(F.col("pos") <= h(F.col("conv_id")))
    # Places move only where the base has fewer turns than h: a gap that needs no join for the others.
    own = turns.where(F.col("pos") > h(F.col("conv_id"))).select("conv_id", base.alias("base"), "pos", "said", "chars")
    has = convs.where((F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("base"), "n")
    gaps = stored(convs.select("conv_id", base.alias("base")).join(has, "base", "left").select(
        "conv_id", (h(F.col("conv_id")) - F.least(h(F.col("conv_id")), F.coalesce("n", F.lit(0)))).alias("gap")).where("gap > 0"), "trie-gaps")
    total = turns.agg(F.count(F.lit(1))).first()[0]
    hot = stored(hot_keys(convs, ["conv_id"], "n", total), "trie-hot")
    own = join_hot(own.drop("base"), gaps, ["conv_id"], hot, "left")
    return heads.select("conv_id", "pos", "said", "chars").unionAll(
        own.select("conv_id", (F.col("pos") - F.coalesce("gap", F.lit(0))).alias("pos"), "said", "chars"))


def _node(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *(s.cast("string") for s in sums)).cast("binary")))


def _prefixes(turns: DataFrame) -> DataFrame:
    """Every opening of every conversation: conv_id, depth, node, parent, chars of its last turn."""
    code = F.md5(F.concat(F.col("pos").cast("string"), F.lit(":"), "said").cast("binary"))
    parts = [F.conv(F.substring(code, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(s) for i, s in enumerate(PARTS)]
    rows = turns.select("conv_id", "pos", "chars", F.floor((F.col("pos") - 1) / BLOCK).alias("block"), *parts)
    rows = stored(rows, "trie-codes")
    inside = Window.partitionBy("conv_id", "block").orderBy("pos")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Conversations of one block have nothing before it; only the others take part in these sums.
    blocks = rows.groupBy("conv_id", "block").agg(F.max(F.col("pos") >= BLOCK).alias("full"), *(F.sum(s).alias(f"all_{s}") for s in PARTS))
    blocks = blocks.select("conv_id", "block", *(F.sum(f"all_{s}").over(earlier).alias(f"before_{s}") for s in PARTS)).where("block > 0")
    summed = rows.select("conv_id", "block", "pos", "chars", *PARTS, *(F.sum(s).over(inside).alias(f"sum_{s}") for s in PARTS))
    summed = summed.join(blocks.hint("merge"), ["conv_id", "block"], "left")
    upto = [F.col(f"sum_{s}") + F.coalesce(f"before_{s}", F.lit(0)) for s in PARTS]
    return summed.select("conv_id", F.col("pos").alias("depth"), "chars", _node(F.col("pos"), upto).alias("node"),
                         _node(F.col("pos") - 1, [u - F.col(s) for u, s in zip(upto, PARTS)]).alias("parent"))


def id_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the SHA-256 of each node's ids (node, conv_id), in ascending order, joined by commas.

    Ids are sorted and joined range by range; only the joined pieces of a node meet in one task, which adds one
    after the other to the digest and keeps none.
    """
    def joined(batches):
        for batch in batches:
            node, ids = batch.column("node").to_pylist(), batch.column("conv_id").to_numpy()
            at = [0, *(i for i in range(1, len(node)) if node[i] != node[i - 1]), len(node)]
            runs = [(i, j) for i, j in zip(at, at[1:]) if j > i]
            yield pa.RecordBatch.from_pydict({
                "node": pa.array([node[i] for i, _ in runs], pa.binary()), "first": pa.array(ids[[i for i, _ in runs]] if runs else np.zeros(0, np.int64)),
                "ids": pa.array([",".join(map(str, ids[i:j].tolist())) for i, j in runs], pa.string())})

    def digested(batches):
        last, digest = None, None
        for batch in batches:
            done = []
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if node != last:
                    done += [(last, digest.hexdigest())] if digest else []
                    last, digest = node, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield rows(done)
        if digest:
            yield rows([(last, digest.hexdigest())])

    def rows(done):
        return pa.RecordBatch.from_pydict({"node": pa.array([n for n, _ in done], pa.binary()),
                                           "ends_sha256": pa.array([d for _, d in done], pa.string())})

    ship(ends.sparkSession)
    pieces = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").select("node", "conv_id").mapInArrow(
        joined, "node binary, first bigint, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digested, "node binary, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of the sequences (conv_id, pos, said, chars) of all conversations (conv_id):
    conv_id, the smallest member; depth; parent_conv_id, the parent's (null for the root, the sequence of no turns);
    n_convs; n_children; n_leaves, the childless nodes in its subtree; saved_tokens, the code points of last
    turns that members beyond the first repeat, summed over the subtree; ends_sha256 of the members that end here.

    A conversation without turns ends at the root. Without conversations there is no node.
    """
    prefixes = stored(_prefixes(turns), "trie-prefixes")
    root = _node(F.lit(0), [F.lit(0)] * len(PARTS))
    nodes = prefixes.groupBy("node", "parent", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("depth"), "conv_id",
        "n_convs", F.lit(0).cast("bigint").alias("chars"))
    nodes = stored(nodes.unionAll(top), "trie-nodes")
    children = stored(nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("n_children")), "trie-children")
    sized = nodes.join(children, "node", "left").select(
        "node", "parent", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "chars")
    sums = subtree_sums(sized.select("node", "parent", "depth", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
                                     ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    last = prefixes.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    ends = convs.join(last, "conv_id", "left").select(F.coalesce("node", root).alias("node"), "conv_id")
    total = nodes.count()
    hot = stored(hot_keys(children, ["node"], "n_children", total).withColumnRenamed("node", "parent"), "trie-hot")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = sized.join(sums, "node").join(id_digests(ends), "node", "left")
    out = join_hot(whole.where("parent is not null"), above, ["parent"], hot).unionByName(
        whole.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
