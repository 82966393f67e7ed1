"""Near-duplicate join: pairs of texts whose sets of word shingles have a Jaccard similarity of a threshold or more.

A MinHash LSH forest finds the candidates. Each tree gives a text a label of DEPTH MinHash values. The labels of a
tree, sorted, are a prefix trie: texts below one trie node stand next to each other, and how deep two neighbours
share their labels is known from the sorted order. Matching begins at whole labels and shortens the matched prefix
level by level, until the pairs met so far, weighed by the chance with which a pair of their similarity meets at this
depth, say that the target recall is reached. Candidates are then verified on their whole shingle sets.

Texts with equal sets are one node, so thousands of copies cost as much as one. A node meets the others of its
trie node in cells of at most two blocks; trie nodes of more than one block are split by the sizes of the sets first,
since sets of too different sizes cannot be alike. A pair that shares prefixes at several depths or in several trees
is counted at the deepest one, in its first tree. No pair leaves a cell: what is written is a number of links per
node and one edge per node towards a root, which connected components turn into classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.blocks import STEP, U64, Block, blocks, map_batches, mix
from tallyspark.llm.graph import components
from tallyspark.session import stored

TREES, DEPTH, WORDS = 16, 6, 5
BLOCK = 256


def meeting_chance(similarity, depth: int, trees: int = TREES):
    """The chance that two texts of a similarity share a prefix of `depth` values in at least one tree."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(threshold: float, recall: float) -> int:
    """The depth at which even a pair at the threshold itself meets with the target recall: shorter prefixes are
    never needed, whatever the texts."""
    return next((d for d in range(DEPTH, 1, -1) if meeting_chance(threshold, d) >= recall), 1)


def reached(pairs: np.ndarray, depth: int, threshold: float) -> float:
    """Recall of all prefixes down to `depth`, as the met pairs tell it; `pairs` counts them by the number of equal
    MinHash values. Each stands for 1 / chance pairs of its similarity; one more, at the threshold, is assumed."""
    alike = np.arange(len(pairs)) / (len(pairs) - 1)
    own = alike >= threshold
    total = (pairs[own] / meeting_chance(alike[own], depth)).sum() + 1 / meeting_chance(threshold, depth)
    return float((pairs[own].sum() + 1) / total)


def permutations(trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(811)
    a = draw.integers(0, 2**32, (trees, depth), dtype=np.uint32) | np.uint32(1)
    return a, draw.integers(0, 2**32, (trees, depth), dtype=np.uint32)


def shingle_sets(block: Block, size: int = WORDS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes per text; all shingle hashes and their bounds by text. A text shorter
    than a shingle but with a word is one shingle; A-Z count as a-z."""
    words = block.words()
    at, key = words.windows(size)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for n, i in enumerate(short):
            for h in words.hash[words.bounds[i] : words.bounds[i + 1]]:
                whole[n : n + 1] = whole[n : n + 1] * STEP + h
        at = np.concatenate([at, words.bounds[short]])
        key = np.concatenate([key, mix(whole)])
        order = np.argsort(at, kind="stable")
        at, key = at[order], key[order]
    bounds = np.searchsorted(at, words.bounds)
    return [np.unique(key[bounds[i] : bounds[i + 1]]) for i in range(block.n)], key, bounds


def labels_of(key: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text with shingles, the DEPTH MinHash values of its label in each tree, one tree after the other."""
    full = bounds[1:] > bounds[:-1]
    begin = bounds[:-1][full]
    x = (key >> U64(32)).astype(np.uint32)
    a, b = permutations(TREES, DEPTH)
    out = np.zeros((len(full), TREES * DEPTH), np.uint32)
    for t in range(TREES):
        for k in range(DEPTH):
            out[full, t * DEPTH + k] = np.minimum.reduceat(x * a[t, k] + b[t, k], begin)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, tie (hash of the text), node (hash of the shingle set; null without words), size of the set and
    labels per row."""
    def sign(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                sets, key, bounds = shingle_sets(block)
                labels = labels_of(key, bounds).view(np.int32)
                node = np.array([int(mix(mix(s) + U64(1)).sum(dtype=np.uint64)) for s in sets], np.uint64).astype(np.int64)
                size = np.array([len(s) for s in sets], np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(block.lo, block.n),
                    "tie": batch.column("tie").slice(block.lo, block.n), "node": pa.array(node, mask=size == 0), "size": pa.array(size),
                    "labels": pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1, dtype=np.int32) * (TREES * DEPTH)),
                                                       pa.array(labels.ravel()))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("tie"), "text"), sign,
                       f"doc_id {kind}, tie bigint, node bigint, size int, labels array<int>")


def tries(nodes: DataFrame, least: int) -> DataFrame:
    """The forest: node, tree and label of every entry that shares at least `least` values with a neighbour in the
    sorted labels of its tree, and `shared`, the most values it shares with one."""
    def neighbours(batches):
        held, before = None, 0  # the last entry so far, and what it shares with the one before it
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks().to_batches()[0]
            label = np.asarray(part.column("label").flatten()).reshape(-1, DEPTH)
            tree = part.column("tree").to_numpy()
            equal = (label[1:] == label[:-1]) & (tree[1:] == tree[:-1])[:, None]
            common = np.concatenate([[before], np.logical_and.accumulate(equal, 1).sum(1), [0]])
            most = np.maximum(common[:-1], common[1:])
            yield entry(part, most, np.flatnonzero(most[:-1] >= least))
            held, before = pa.Table.from_batches([part.slice(part.num_rows - 1)]), int(common[-2])
        if held is not None and before >= least:
            yield entry(held.combine_chunks().to_batches()[0], np.array([before]), np.array([0]))

    def entry(part, most, at):
        rows = part.take(pa.array(at))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(most[at].astype(np.int32))], names=["node", "tree", "label", "shared"])

    labels = F.array(*[F.slice("labels", t * DEPTH + 1, DEPTH) for t in range(TREES)])
    entries = nodes.select("node", F.posexplode(labels).alias("tree", "label"))
    entries = entries.repartition("tree", F.slice("label", 1, least)).sortWithinPartitions("tree", "label")
    return map_batches(entries, neighbours, "node bigint, tree int, label array<int>, shared int")


def runs(batches, keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole runs of equal keys, from sorted batches, and the bounds of the runs in each."""
    rest = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        rest = part if rest is None else pa.concat_tables([rest, part])
        cuts = _cuts(rest, keys)
        if len(cuts) > 2:
            yield rest.slice(0, cuts[-2]).combine_chunks(), cuts[:-1]
            rest = rest.slice(cuts[-2])
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), _cuts(rest, keys)


def _cuts(table: pa.Table, keys: tuple[str, ...]) -> list[int]:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return [*np.flatnonzero(new).tolist(), table.num_rows]


def flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    return column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()


def prefixes(labels: np.ndarray, depth: int) -> np.ndarray:
    """Per node and tree, a hash of the first `depth` values of the label."""
    h = np.zeros(labels.shape[:2], np.uint64)
    for k in range(depth):
        h = h * STEP + labels[:, :, k].astype(np.uint32)
    return mix(h)


def first_meetings(tree: int, depth: int, row: int, column: int, block: np.ndarray, guest: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Which pairs of a cell have this tree and depth as the first ones where they share a prefix."""
    n = len(block)
    own = prefixes(labels, depth)
    same = own[:, None, : tree + 1] == own[None, :, : tree + 1]
    meet = np.triu(same[:, :, tree], 1) & ~same[:, :, :tree].any(2) & ~(guest[:, None] & guest[None, :])
    if row != column:
        meet &= block[:, None] != block[None, :]
    if depth < DEPTH and meet.any():
        deeper = prefixes(labels, depth + 1)
        for t in range(TREES):
            meet &= deeper[:, None, t] != deeper[None, :, t]
    return meet


def equal_values(labels: np.ndarray, meet: np.ndarray) -> np.ndarray:
    """How many pairs of each number of equal MinHash values meet."""
    flat_labels = labels.reshape(len(labels), -1)
    out = np.zeros(TREES * DEPTH + 1, np.int64)
    i, j = np.nonzero(meet)
    for lo in range(0, len(i), 1 << 14):
        equal = (flat_labels[i[lo : lo + (1 << 14)]] == flat_labels[j[lo : lo + (1 << 14)]]).sum(1)
        out += np.bincount(equal, minlength=len(out))
    return out


CELL = ("depth", "label", "part", "row", "col")


def members(forest: DataFrame, nodes: DataFrame, depth: int, threshold: float) -> DataFrame:
    """The nodes of each cell at a depth. Trie nodes with one child only bring no new pair and make no cell. One with
    more than BLOCK texts is split into parts by set size: a part holds one class of sizes and, as guests, the
    class below it."""
    label = F.xxhash64("tree", F.slice("label", 1, depth))
    child = F.xxhash64(F.slice("label", 1, depth + 1)) if depth < DEPTH else F.col("node")
    # A little wider than the threshold, so that rounding cannot put a pair two classes apart.
    kind = F.floor(F.log("size") / float(-np.log(threshold * 0.999))).cast("int")
    placed = forest.where(F.col("shared") >= depth).select("node", "tree", label.alias("label"), child.alias("child"))
    shared = placed.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("child").alias("lo"), F.max("child").alias("hi"))
    shared = shared.where("n > 1 and lo != hi").select("label", "n")
    texts = nodes.select("node", "copies", "labels", kind.alias("kind"))
    met = placed.drop("child").join(shared, "label").join(texts, "node")
    hot = F.col("n") > BLOCK
    met = met.withColumn("part", F.explode(F.when(hot, F.array("kind", F.col("kind") + 1)).otherwise(F.array(F.lit(-1)))))
    met = met.withColumn("guest", (F.col("part") >= 0) & (F.col("kind") < F.col("part")))
    parts = met.where("part >= 0").groupBy("label", "part").agg(F.count(F.lit(1)).alias("m"), F.min("guest").alias("guests"))
    met = met.join(parts, ["label", "part"], "left").where("part < 0 or (m > 1 and not guests)")
    blocks_of = F.greatest(F.lit(1), F.ceil(F.coalesce("m", F.lit(1)) / BLOCK).cast("int"))
    met = met.withColumn("blocks", blocks_of).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select(F.lit(depth).alias("depth"), "label", "part", F.least("block", "other").alias("row"),
                      F.greatest("block", "other").alias("col"), "tree", "block", "guest", "node", "copies", "labels")


def planned(met: DataFrame) -> DataFrame:
    """Cells and the nodes that are needed in each: those with at least one pair that meets there first. The first
    of them holds the cell's pairs, counted by equal MinHash values."""
    def plan(batches):
        for table, cuts in runs(batches, CELL):
            labels = flat(table, "labels")[0].reshape(-1, TREES, DEPTH)
            tree, depth, row, col, block = (table.column(c).to_numpy() for c in ("tree", "depth", "row", "col", "block"))
            guest = table.column("guest").to_numpy()
            need, pairs = np.zeros(table.num_rows, bool), [None] * table.num_rows
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo > 1:
                    meet = first_meetings(tree[lo], depth[lo], row[lo], col[lo], block[lo:hi], guest[lo:hi], labels[lo:hi])
                    need[lo:hi] = meet.any(0) | meet.any(1)
                    if need[lo:hi].any():
                        pairs[lo + int(np.argmax(need[lo:hi]))] = equal_values(labels[lo:hi], meet)
            table = table.append_column("pairs", pa.array(pairs, pa.list_(pa.int64())))
            for batch in table.filter(pa.array(need)).to_batches():
                yield batch

    return map_batches(met.repartition(*CELL).sortWithinPartitions(*CELL, "node"), plan, _schema(met) + ", pairs array<bigint>")


def met_pairs(cells: DataFrame) -> np.ndarray:
    """The pairs of all cells by number of equal MinHash values."""
    rows = cells.where("pairs is not null").select(F.posexplode("pairs").alias("equal", "n"))
    out = np.zeros(TREES * DEPTH + 1)
    for row in rows.groupBy("equal").agg(F.sum("n").alias("n")).collect():  # one row per number of equal values
        out[row.equal] = row.n
    return out


def matched(nodes: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, int]:
    """The cells of all depths from whole labels down to where the target recall is reached, and that depth."""
    least = least_depth(threshold, recall)
    forest = stored(tries(nodes, least), "lsh-forest")
    cells, pairs = None, np.zeros(TREES * DEPTH + 1)
    for depth in range(DEPTH, least - 1, -1):
        level = stored(planned(members(forest, nodes, depth, threshold)), "lsh-cells")
        cells = level if cells is None else cells.unionAll(level)
        pairs += met_pairs(level)
        if reached(pairs, depth, threshold) >= recall:
            break
    return cells.drop("pairs"), depth


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def shared_counts(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of common elements of every pair of sets, by products of membership columns; elements of a single
    set are left out first."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    order = np.argsort(values, kind="stable")
    v, owner = values[order], owner[order]
    new = np.concatenate([[True], v[1:] != v[:-1]])
    count = np.diff(np.concatenate([np.flatnonzero(new), [len(v)]]))
    several = np.repeat(count > 1, count)
    column = np.cumsum(new[several])[: int(several.sum())] - 1
    owner = owner[several]
    out = np.zeros((n, n), np.float32)
    width = 4_096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((n, min(width, int(column[-1]) + 1 - lo)), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    return out


def verified(cells: DataFrame, threshold: float) -> DataFrame:
    """Per cell and node with a link: node, links (copies of linked nodes) and root (the least node that the
    cell's links lead to)."""
    def verify(batches):
        for table, cuts in runs(batches, CELL):
            labels = flat(table, "labels")[0].reshape(-1, TREES, DEPTH)
            values, bounds = flat(table, "shingles")
            tree, depth, row, col, block, guest, node, copies = (
                table.column(c).to_numpy() for c in ("tree", "depth", "row", "col", "block", "guest", "node", "copies"))
            for lo, hi in zip(cuts, cuts[1:]):
                own = lo + np.unique(node[lo:hi], return_index=True)[1]
                if len(own) < 2:
                    continue
                sets = [values[bounds[i] : bounds[i + 1]] for i in own]
                size = np.array([len(s) for s in sets])
                common = shared_counts(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]))
                alike = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-6
                alike &= first_meetings(tree[lo], depth[lo], row[lo], col[lo], block[own], guest[own], labels[own])
                alike |= alike.T
                linked = np.flatnonzero(alike.any(1))
                if not len(linked):
                    continue
                root = np.arange(len(own))
                while True:
                    least = np.minimum(root, np.where(alike, root[None, :], len(own)).min(1))
                    if (least == root).all():
                        break
                    root = least
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array(node[own][linked]), "links": pa.array((alike @ copies[own])[linked].astype(np.int64)),
                    "root": pa.array(node[own][root][linked])})

    return map_batches(cells.repartition(*CELL).sortWithinPartitions(*CELL), verify, "node bigint, links bigint, root bigint")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and shingles of the wanted (doc_id, tie, node) rows."""
    def collect(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                sets = shingle_sets(block)[0]
                size = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "node": batch.column("node").slice(block.lo, block.n),
                    "shingles": pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate(sets).astype(np.int64)))})

    texts = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    wanted = wanted.hint("merge")  # it grows with the input: the same plan at every size
    met = texts.join(wanted, texts["tie"].eqNullSafe(wanted["tie"]) & texts["doc_id"].eqNullSafe(wanted["doc_id"]))
    return map_batches(met.select("node", "text"), collect, "node bigint, shingles array<bigint>")


def classes(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9995) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, tie, node) of all rows, and nodes (node, copies, links, class_id, class_tie).

    Nodes with links or copies form classes; class_id and class_tie name a class's first row, by id (null ids
    last) and then by a hash of the text. Texts without words have no node and belong to no class.
    """
    signed = stored(signatures(docs), "lsh-signatures")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tie")
    nodes = signed.where("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min(first).alias("first"), F.first("size").alias("size"), F.first("labels").alias("labels"))
    nodes = stored(nodes.select("node", "copies", "size", "first.doc_id", "first.tie", "labels"), "lsh-nodes")
    cells, _ = matched(nodes, threshold, recall)
    wanted = nodes.join(cells.select("node").distinct(), "node", "left_semi").select("doc_id", "tie", "node")
    sets = stored(sets_of(docs, stored(wanted, "lsh-wanted")), "lsh-sets")
    found = stored(verified(cells.join(sets, "node"), threshold), "lsh-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a != b").distinct())
    whole = (nodes.drop("labels", "size").join(links, "node", "left").join(roots, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tie")
    heads = whole.groupBy("root").agg(F.min(first).alias("head"))
    whole = whole.join(heads, "root").select(
        "node", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("head.doc_id").alias("class_id"), F.col("head.tie").alias("class_tie"))
    return signed.drop("labels", "size"), stored(whole, "lsh-classes")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id (the least id its links lead to; its own without any) and
    n_links, the number of other rows at the threshold or above, copies included.

    Null and empty texts link to nothing. Repeated rows are copies of each other. Other columns are not read.
    """
    members, nodes = classes(docs, threshold, recall)
    plain = members.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    met = members.where("node is not null").join(nodes, "node").select("doc_id", "class_id", "n_links")
    return met.unionAll(plain)


def keep_first(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """The rows of `docs`, with all their columns, that come first in their class; texts without words stay."""
    members, nodes = classes(docs, threshold, recall)
    rows = members.join(nodes, "node", "left").where(
        F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("tie") == F.col("class_tie"))))
    kept = stored(rows.groupBy(F.col("doc_id").alias("first_id"), F.col("tie").alias("first_tie")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.col("node").isNull()).alias("plain")), "lsh-kept")
    # The rows travel whole in one column, so that no name of theirs can clash.
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("tie"))
    met = whole.join(kept, whole["doc_id"].eqNullSafe(kept["first_id"]) & whole["tie"].eqNullSafe(kept["first_tie"]))
    single, repeated = F.col("plain") | (F.col("rows") == 1), ~F.col("plain") & (F.col("rows") > 1)
    return met.where(single).select("row.*").unionAll(
        met.where(repeated).dropDuplicates(["first_id", "first_tie"]).select("row.*"))
