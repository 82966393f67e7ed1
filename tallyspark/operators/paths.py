"""Which tables to join for the columns a question names: the smallest tree of foreign keys that connects them.

Edges lead from a referring table to the one it refers to, so a join along them never multiplies rows. The search
works on names of tables only; what it finds is an ordinary chain of equi-joins, planned by Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (source table, source column, target table, target column); columns of a composite key are joined by ", ".
Step = tuple[str, str, str, str]


@dataclass(frozen=True)
class JoinPlan:
    """The steps in an order in which each starts from a table already joined, and other trees of the same size."""

    start: str
    steps: tuple[Step, ...]
    alternatives: tuple[tuple[Step, ...], ...] = ()

    @property
    def ambiguous(self) -> bool:
        return bool(self.alternatives)


def _in_order(start: str, tree: Iterable[Step]) -> tuple[Step, ...]:
    left, out, reached = sorted(tree), [], {start}
    while left:
        step = next(s for s in left if s[0] in reached)
        left.remove(step)
        reached.add(step[2])
        out.append(step)
    return tuple(out)


def smallest_trees(steps: Sequence[Step], start: str, tables: Sequence[str], most: int = 4) -> list[tuple[Step, ...]]:
    """The trees with the fewest steps that lead from `start` to all `tables`, at most `most` of them, in the order of
    their names; none if a table cannot be reached.

    Best trees below every table, for ever larger sets of wanted tables: either two trees that part at the table, or
    one step and the best tree behind it.
    """
    wanted = sorted(set(tables) - {start})
    nodes = {start, *(t for s in steps for t in (s[0], s[2]))}
    bits = {t: 1 << i for i, t in enumerate(wanted)}
    best: list[dict[str, tuple[int, frozenset[frozenset[Step]]]]] = [{n: (0, frozenset([frozenset()])) for n in nodes}]

    def offer(table: dict, node: str, trees: Iterable[frozenset[Step]]) -> bool:
        size, old = table.get(node, (len(nodes) + 1, frozenset()))
        least = min((len(t) for t in trees), default=size + 1)
        if least > size:
            return False
        both = {t for t in trees if len(t) == least} | (set(old) if least == size else set())
        kept = frozenset(sorted(both, key=sorted)[:most])
        table[node] = (least, kept)
        return (size, old) != (least, kept)

    for mask in range(1, 1 << len(wanted)):
        own: dict[str, tuple[int, frozenset[frozenset[Step]]]] = {}
        for node in nodes:
            here = mask & ~bits.get(node, 0)
            if here != mask and node in best[here]:
                offer(own, node, best[here][node][1])
            part = (mask - 1) & mask
            while part:
                if part < mask - part and node in best[part] and node in best[mask - part]:
                    offer(own, node, [a | b for a in best[part][node][1] for b in best[mask - part][node][1]])
                part = (part - 1) & mask
        while any([s[2] in own and offer(own, s[0], [t | {s} for t in own[s[2]][1]]) for s in steps if s[0] != s[2]]):
            pass
        best.append(own)
    if start not in best[-1]:
        return []
    return [_in_order(start, tree) for tree in sorted(best[-1][start][1], key=sorted)]


def join_plan(steps: Sequence[Step], start: str, tables: Sequence[str]) -> JoinPlan:
    """The smallest tree from `start` to the tables. Where several have its size, the first by name, and `alternatives`
    holds the others: which one a question means cannot be told from the schema."""
    found = smallest_trees(list(dict.fromkeys(steps)), start, tables)
    if not found:
        raise ValueError(f"no foreign keys lead from {start} to all of {', '.join(sorted(set(tables) - {start}))}")
    return JoinPlan(start, found[0], tuple(found[1:]))


def home_of(column: str, start: str, columns: dict[str, Sequence[str]], steps: Sequence[Step]) -> tuple[str, str]:
    """(table, column) of `table.column`, or of a bare name: the start table's, else that of the nearest table that has
    it. Two tables as near make a bare name an error."""
    table, dot, name = column.rpartition(".")
    if dot and name in columns.get(table, ()):
        return table, name
    near, seen = {start}, {start}
    while near:
        having = sorted(t for t in near if column in columns.get(t, ()))
        if len(having) > 1:
            raise ValueError(f"{column} is in {' and in '.join(having)}; say which")
        if having:
            return having[0], column
        near = {s[2] for s in steps if s[0] in near} - seen
        seen |= near
    raise ValueError(f"no table that {start} refers to has a column {column}")


def steps_of(mapping: DataFrame) -> list[Step]:
    """The edges of a mapping (`discover_edges`, `edges_merged`), as many as a schema has foreign keys."""
    rows = mapping.select("source_table", "source_column", "target_table", "target_column").distinct().collect()
    return sorted(tuple(r) for r in rows)


def denormalize_columns(tables: dict[str, DataFrame], mapping: DataFrame, start: str, columns: dict[str, str],
                        ambiguous: str = "error") -> DataFrame:
    """Rows of `start` with the asked columns (output name -> column, bare or as `table.column`), inner joined along the
    smallest tree of the mapping's edges. Of several such trees none is taken, but with `ambiguous="first"` the first."""
    steps = [s for s in steps_of(mapping) if s[0] in tables and s[2] in tables]
    known = {t: df.columns for t, df in tables.items()}
    homes = {out: home_of(c, start, known, steps) for out, c in columns.items()}
    plan = join_plan(steps, start, [t for t, _ in homes.values()])
    if plan.ambiguous and ambiguous != "first":
        ways = " or ".join(", ".join(f"{s} -> {t}" for s, _, t, _ in way) for way in (plan.steps, *plan.alternatives))
        raise ValueError(f"joins as short as each other: {ways}")
    needed = {t: {c for tt, c in homes.values() if tt == t} for t in {start, *(s[2] for s in plan.steps)}}
    for s, left, t, right in plan.steps:
        needed[s] |= set(left.split(", "))
        needed[t] |= set(right.split(", "))

    def side(table: str) -> DataFrame:
        return tables[table].select(*[F.col(f"`{c}`").alias(f"{table}|{c}") for c in sorted(needed[table])])

    out = side(start)
    for s, left, t, right in plan.steps:
        on = [F.col(f"`{s}|{a}`") == F.col(f"`{t}|{b}`") for a, b in zip(left.split(", "), right.split(", "))]
        out = out.join(side(t), on, "inner")
    return out.select(*[F.col(f"`{t}|{c}`").alias(name) for name, (t, c) in homes.items()])
