"""CSV files whose quoted cells hold line breaks, read by many tasks.

A file is read as lines, in ranges of bytes. A line turns the state before it (outside or inside a quoted cell)
into the state behind it; a range cannot know the state it begins in, so it follows both. What a range does to
either state is one of four functions - keep, swap, always outside, always inside - and these compose, so an
ordered sum over the ranges of a file, a row per range, says how each begins and which record was left open before
it. Then every line knows its record. Records of one line, nearly all, are complete where they were read; only the
lines of longer ones are brought together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark.session import ship, stored

#: Characters of one record; a quote that is never closed would make all the rest of a file one record.
LONGEST = 16 << 20


def state_behind(line: str, inside: bool, sep: str, quote: str) -> bool:
    """Does a quoted cell go on behind this line? A quote opens a cell only at its beginning, two stand for one."""
    at = 0
    while True:
        if not inside:
            if not line.startswith(quote, at):
                at = line.find(sep, at) + 1
                if not at:
                    return False
                continue
            at += 1
        while True:
            at = line.find(quote, at) + 1
            if not at:
                return True
            if not line.startswith(quote, at):
                break
            at += 1
        inside = False
        at = line.find(sep, at) + 1
        if not at:
            return False


class Range:
    """Follows the lines of one byte range under both states it may begin in."""

    def __init__(self, place: tuple):
        self.place, self.state, self.records, self.seq = place, [False, True], [0, 0], 0

    def lines(self, value: pa.Array, sep: str, quote: str) -> list[pa.Array]:
        """Per line and beginning: is the state before it and behind it inside a cell, how many records began."""
        n = len(value)
        blank = pc.equal(pc.binary_length(pc.utf8_trim_whitespace(value)), 0).to_numpy(zero_copy_only=False)
        quoted = np.flatnonzero(pc.match_substring(value, quote).to_numpy(zero_copy_only=False))
        texts = value.take(pa.array(quoted)).to_pylist()
        out = [pa.array(np.arange(self.seq, self.seq + n))]
        for k in (0, 1):
            states = [self.state[k]]
            for text in texts:
                states.append(state_behind(text, states[-1], sep, quote))
            now = np.array(states)
            before = now[np.searchsorted(quoted, np.arange(n))]
            behind = now[np.searchsorted(quoted, np.arange(n), side="right")]
            begun = self.records[k] + np.cumsum(~before & ~blank)
            self.state[k], self.records[k] = states[-1], int(begun[-1]) if n else self.records[k]
            out += [pa.array(before), pa.array(behind), pa.array(begun)]
        self.seq += n
        return [*out, pa.array(blank)]


LINES = "file string, start bigint, value string, seq bigint, " + ", ".join(
    f"before{k} boolean, behind{k} boolean, record{k} bigint" for k in (0, 1)) + ", blank boolean"


def csv_lines(spark: SparkSession, path: str | list[str], sep: str, quote: str, charset: str = "UTF-8") -> DataFrame:
    """The lines of the files with their range (file, start), place in it, and states under both beginnings."""
    names = [c.split(" ")[0] for c in LINES.split(", ")]

    def follow(batches):
        current = None
        for batch in batches:
            file, start, value = (batch.column(c) for c in ("file", "start", "value"))
            where, paths = start.to_numpy(), file.to_pylist()
            at = [0, *(i for i in range(1, len(where)) if where[i] != where[i - 1] or paths[i] != paths[i - 1]), len(where)]
            for lo, hi in zip(at, at[1:]):
                if hi == lo:
                    continue
                place = (paths[lo], int(where[lo]))
                if current is None or current.place != place:
                    current = Range(place)
                part = value.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [file.slice(lo, hi - lo), start.slice(lo, hi - lo), part, *current.lines(part, sep, quote)], names=names)

    ship(spark)
    raw = spark.read.text(path, lineSep="\n")  # without the mark at the beginning of a file
    value = F.col("value") if charset == "UTF-8" else F.decode(F.col("value").cast("binary"), charset)
    # Splits may fall differently when the files are read again, so the lines are kept.
    return stored(raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                             value.alias("value")).mapInArrow(follow, LINES), "csv-lines")


def range_states(lines: DataFrame) -> DataFrame:
    """(file, start, inside, open_start, open_record): how each range begins, and the record that is open there."""
    ends = lines.groupBy("file", "start").agg(*(
        f(f"{c}{k}", *o).alias(f"{c}{k}") for k in (0, 1) for c, f, o in (("behind", F.max_by, ("seq",)), ("record", F.max, ()))))
    order = W.partitionBy("file").orderBy("start")
    upto, earlier = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
    swap = F.col("behind0") & ~F.col("behind1")
    fixed = F.col("behind0") == F.col("behind1")
    summed = ends.withColumn("swaps", F.sum(swap.cast("int")).over(upto))
    # A range that always ends in one state makes a new beginning: count swaps from there.
    summed = summed.withColumn("anchor", F.when(fixed, F.col("behind0").cast("int") + F.col("swaps")))
    odd = F.coalesce(F.last("swaps").over(earlier), F.lit(0)) + F.coalesce(F.last("anchor", ignorenulls=True).over(earlier), F.lit(0))
    known = summed.withColumn("inside", odd % 2 == 1)
    begun = F.when(F.col("inside"), F.col("record1")).otherwise(F.col("record0"))
    last = F.last(F.when(begun > 0, F.struct(F.col("start").alias("start"), begun.alias("record"))), ignorenulls=True).over(earlier)
    return known.withColumn("last", last).select(
        "file", "start", "inside", F.col("last.start").alias("open_start"), F.col("last.record").alias("open_record"))


def csv_records(lines: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(file, first, record): every record as text, without its line end; `first` marks that of a file. Blank lines
    outside of cells are no records. A record of more than `longest` characters is an error."""
    states = stored(range_states(lines), "csv-ranges")
    met = lines.join(states, ["file", "start"])

    def either(name: str) -> Column:
        return F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    inherited = either("record") == 0
    rows = met.select(
        "file", "start", "seq", "value", "blank", either("before").alias("before"), either("behind").alias("behind"),
        F.when(inherited, F.col("open_start")).otherwise(F.col("start")).alias("record_start"),
        F.when(inherited, F.col("open_record")).otherwise(either("record")).alias("record"))
    first = ((F.col("record_start") == 0) & (F.col("record") == 1)).alias("first")
    single = rows.where("not before and not behind and not blank").select("file", first, "value")
    parts = rows.where("before or behind")
    key = ["file", "record_start", "record"]
    long = parts.groupBy(*key).agg(F.sum(F.length("value") + 1).alias("chars")).where(F.col("chars") > longest).select("file").first()
    if long:
        raise ValueError(f"{long[0]}: a record has more than {longest} characters; is a quote never closed?")
    whole = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "seq", "value"))).alias("parts"))
    several = whole.select("file", first, F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))
    return single.unionAll(several).select("file", "first", F.regexp_replace("value", "\r$", "").alias("record"))


def parsed_records(records: DataFrame, columns: list[str], extra: str, options: dict) -> DataFrame:
    """The records but the first of each file as columns of text, and `extra`, the raw text of records with another
    number of cells. A file whose first record is not the header is an error."""
    names = [f"c{i}" for i in range(len(columns))]
    schema = ", ".join(f"{c} string" for c in [*names, extra])
    cells = F.from_csv("record", schema, {**options, "columnNameOfCorruptRecord": extra})
    rows = records.withColumn("cells", cells)
    found = F.array(*(F.coalesce(F.trim(F.col(f"cells.{c}")), F.lit("")) for c in names))
    wanted = F.array(*(F.lit(c.strip()) for c in columns))
    same = (found == wanted) & F.col(f"cells.{extra}").isNull()
    wrong = F.raise_error(F.concat(F.lit("CSV header does not conform to the schema: "), "file")).cast("boolean")
    rows = rows.where(F.when(~F.col("first"), F.lit(True)).when(same, F.lit(False)).otherwise(wrong))
    return rows.select(*(F.col(f"cells.{n}").alias(c) for n, c in zip(names, columns)), F.col(f"cells.{extra}").alias(extra))
