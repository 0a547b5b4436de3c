"""Records of delimited text: physical lines, read once, glued wherever a quoted cell goes on over line breaks.

Every line is written to the shared folder with its place: the split it was read in and its number there. All later work
reads that table, so what Spark chooses as splits at any other time does not matter. What a line means depends on
whether it begins inside a quoted cell; that is known once all splits before it are, so each line carries its state and
record number for both cases, and a catalogue of splits, one row each, says which case holds. A file of one cell with a
line break is so read by as many tasks as any other. Lines of broken records meet by record; no other line is moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costlens.sources.shared import written

#: Splits whose catalogue is broadcast, some 50 bytes each; beyond it the lines are shuffled to it.
MAX_SPLITS = 1_000_000
#: Splits that are looked up by name for the first rows; with more of them all lines are read.
MANY = 1_000
#: A line that is no record: blank, or one quoted cell of blanks.
BLANK = r'^\s*(?:"\s*")?\s*$'
LINES = "split long, source string, start long, i long, value string, in0 boolean, in1 boolean, out0 boolean, out1 boolean, num0 long, num1 long, blank boolean"


def _transitions(values: pa.Array, sep: str) -> tuple[np.ndarray, np.ndarray]:
    """For each line whether its end is inside a quoted cell, if its beginning is outside, and if it is inside. A quote opens a cell only as its first character."""
    s = re.escape(sep)
    text = '(?:[^"]|"")*'
    tail = f'(?:[^"{s}][^{s}]*)?'
    cells = f'(?:(?:"{text}"{tail}|[^"{s}][^{s}]*)?{s})*'
    after0, after1 = np.zeros(len(values), bool), np.ones(len(values), bool)
    quoted = np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))
    if len(quoted):
        own = values.take(pa.array(quoted))
        match = lambda p: pc.match_substring_regex(own, f"(?s)^{p}$").to_numpy(zero_copy_only=False)
        after0[quoted] = match(f'{cells}"{text}')
        after1[quoted] = match(text) | match(f'{text}"{tail}{s}{cells}"{text}')
    return after0, after1


def _states(after0: np.ndarray, after1: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """States before and after each line, the state before the first one given: the last line that fixes the state, and how many have turned it since."""
    fixes, turns = after0 == after1, np.cumsum(after0 & ~after1)
    last = np.maximum.accumulate(np.where(fixes, np.arange(len(fixes)), -1))
    since = turns - np.where(last >= 0, turns[last], 0)
    after = np.where(last >= 0, after0[last], first) ^ (since % 2 == 1)
    return np.concatenate(([first], after[:-1])), after


def _scan(batches: Iterator[pa.RecordBatch], sep: str) -> Iterator[pa.RecordBatch]:
    """Rows of LINES; what is kept from batch to batch is the split's state in both cases and its counts."""
    split, i, state, num = None, 0, [False, True], [0, 0]
    for b in batches:
        ids = b.column("split").to_numpy()
        values = b.column("value")
        after0, after1 = _transitions(values, sep)
        blank = pc.match_substring_regex(values, BLANK).to_numpy(zero_copy_only=False)
        size = len(ids)
        nth = np.empty(size, np.int64)
        before, after, number = ([np.empty(size, kind) for _ in range(2)] for kind in (bool, bool, np.int64))
        borders = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), size]
        for lo, hi in zip(borders, borders[1:], strict=False):
            if lo == hi:
                continue
            if ids[lo] != split:
                split, i, state, num = ids[lo], 0, [False, True], [0, 0]
            nth[lo:hi] = np.arange(i, i + hi - lo)
            i += hi - lo
            for h in range(2):
                before[h][lo:hi], after[h][lo:hi] = _states(after0[lo:hi], after1[lo:hi], state[h])
                number[h][lo:hi] = num[h] + np.cumsum(~before[h][lo:hi] & ~blank[lo:hi])
                state[h], num[h] = bool(after[h][hi - 1]), int(number[h][hi - 1])
        cells = [b.column("split"), b.column("source"), b.column("start"), pa.array(nth), values, *map(pa.array, (*before, *after, *number, blank))]
        yield pa.RecordBatch.from_arrays(cells, [c.split()[0] for c in LINES.split(", ")])


def split_cells(text: Column, sep: str) -> Column:
    """The cells of one record as an array: quoted cells without their quotes, doubled quotes single; what follows a closing quote belongs to its cell."""
    s = re.escape(sep)
    quoted = '"[^"]*+(?:""[^"]*+)*+"'
    cells = F.regexp_extract_all(F.concat(F.lit(sep), text), F.lit(f"(?s){s}({quoted}[^{s}]*+|[^{s}]*+)"), F.lit(1))
    part = lambda c, k: F.regexp_extract(c, '(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)$', k)
    plain = lambda c: F.when(c.startswith('"') & c.rlike(f"(?s)^{quoted}"), F.concat(F.replace(part(c, 1), F.lit('""'), F.lit('"')), part(c, 2))).otherwise(c)
    return F.when(F.contains(text, F.lit('"')), F.transform(cells, plain)).otherwise(F.split(text, s, -1))


@dataclass(frozen=True)
class Records:
    """The records of all files.

    rows: source (file), record (from 1 in its file, blank lines not counted; 1 is the header), line_no (from 1 over the
    data rows of all files, file after file by path; a header has the number before), text, unclosed. lines: the lines
    as they were read. catalogue: a row a split.
    """

    rows: DataFrame
    lines: DataFrame
    catalogue: DataFrame
    splits: int
    line_breaks: bool
    broken: bool

    def first_rows(self, n: int) -> DataFrame:
        """rows of the first n data rows and of headers before them: of the lines only those of the splits that hold them are read."""
        begun = F.col("ahead") + F.col("base") + F.when(F.col("inside") | F.lit(not self.line_breaks), 0).otherwise(1) - 1
        ids = [r["split"] for r in self.catalogue.where(begun <= n).select("split").limit(MANY + 1).collect()]
        lines = self.lines.where(F.col("split").isin(ids)) if len(ids) <= MANY else self.lines
        return _rows(lines, self.catalogue, self.splits, self.line_breaks, self.broken).where(F.col("line_no") <= n)

    def count(self) -> int:
        """Data rows of all files."""
        return self.catalogue.groupBy("source").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0).cast("long"))), F.lit(0).cast("long"))).first()[0]


def read_records(spark: SparkSession, path: str, sep: str = ",", line_breaks: bool = True) -> Records:
    """All records of the files under path. line_breaks: quoted cells may hold line breaks (they become \\n); without, each line is a record and no Python runs.

    A quoted cell that its file never closes is one record, unclosed, with the text of its first line only. A line whose
    split is not in the catalogue raises.
    """
    if len(sep) != 1:
        raise ValueError("the separator is one character")
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("start"))
    raw = raw.select(F.xxhash64("source", "start").alias("split"), "source", "start", "value")
    if line_breaks:
        lines = raw.mapInArrow(lambda batches: _scan(batches, sep), LINES)
    else:
        never, always = F.lit(False), F.monotonically_increasing_id()  # in the order in which a split's lines are read
        lines = raw.where(~F.col("value").rlike(BLANK)).select(
            "split", "source", "start", always.alias("i"), "value", *[never.alias(c) for c in ("in0", "in1", "out0", "out1")], F.lit(0).cast("long").alias("num0"),
            F.lit(0).cast("long").alias("num1"), never.alias("blank")
        )
    lines = written(lines)
    catalogue = written(_catalogue(lines, line_breaks))
    whole = catalogue.agg(F.count("*"), F.countDistinct("split"), F.max("broken")).first()
    if whole[0] != whole[1]:
        raise ValueError("two splits have one hash")
    broken = bool(whole[2])
    return Records(_rows(lines, catalogue, whole[0], line_breaks, broken), lines, catalogue, whole[0], line_breaks, broken)


def _catalogue(lines: DataFrame, line_breaks: bool) -> DataFrame:
    """One row a split: split, source, start, and

    inside: its first line begins inside a quoted cell. base: to add to its lines' numbers for the record in the file.
    ahead: data rows of the files before. open: number of the file's record that is never closed. n: records that begin
    in it. broken: some of its lines are parts of records.
    """
    of = lambda c: F.max_by(c, "i")
    counts = (F.max("num0"), F.max("num1"), F.lit(0).cast("long")) if line_breaks else (F.count("*"), F.count("*"), F.min("i"))
    splits = lines.groupBy("split", "source", "start").agg(
        of("out0").alias("end0"), of("out1").alias("end1"), F.max("out0").alias("any"), counts[0].alias("n0"), counts[1].alias("n1"), counts[2].alias("first"),
    )
    file = Window.partitionBy("source").orderBy("start")
    turns = (F.col("end0") & ~F.col("end1")).cast("int")
    splits = splits.withColumn("turned", F.sum(turns).over(file))
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.last(F.when(F.col("end0") == F.col("end1"), F.struct("end0", "turned")), ignorenulls=True).over(before)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    splits = splits.withColumn("fixed", fixed).withColumn("so_far", zero(F.sum(turns).over(before)))
    odd = (F.col("so_far") - zero(F.col("fixed.turned"))) % 2 == 1
    splits = splits.withColumn("inside", F.coalesce("fixed.end0", F.lit(False)) != odd)
    splits = splits.withColumn("n", F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0"))).withColumn("end", F.when(F.col("inside"), F.col("end1")).otherwise(F.col("end0")))
    splits = splits.withColumn("before", zero(F.sum("n").over(before)))
    files = splits.groupBy("source").agg(F.sum("n").alias("records"), F.max_by("end", "start").alias("open"))
    # One row a file; numbers run over all files.
    ahead = zero(F.sum(F.greatest(F.col("records") - 1, F.lit(0).cast("long"))).over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)))
    files = files.select("source", "records", ahead.alias("ahead"), F.when(F.col("open"), F.col("records")).alias("open"))
    return splits.join(files, "source").select(
        "split", "source", "start", "inside", (F.col("before") - F.col("first") + F.lit(0 if line_breaks else 1)).alias("base"), "ahead", "open", "n",
        (F.col("inside") | F.col("any")).alias("broken")
    )


def _rows(lines: DataFrame, catalogue: DataFrame, splits: int, line_breaks: bool, broken: bool) -> DataFrame:
    known = catalogue.select("split", "inside", "base", "ahead", "open")
    at = lines.join(F.broadcast(known) if splits <= MAX_SPLITS else known, "split", "left")
    at = at.withColumn("inside", F.when(F.col("inside").isNull(), F.raise_error(F.lit("a line of a split that is not in the catalogue")).cast("boolean")).otherwise(F.col("inside")))
    pick = lambda c: F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    number = F.col("base") + (pick("num") if line_breaks else F.col("i"))
    at = at.select("source", "start", "i", "value", pick("in").alias("within"), pick("out").alias("goes_on"), number.alias("record"), "ahead", "open", "blank")
    place = ["source", "record", (F.col("ahead") + F.col("record") - 1).alias("line_no")]
    at = at.where(F.col("within") | ~F.col("blank"))
    unclosed = F.coalesce(F.col("record") == F.col("open"), F.lit(False))
    one = at.where(~F.col("within") & (~F.col("goes_on") | unclosed)).select(*place, F.col("value").alias("text"), unclosed.alias("unclosed"))
    if not broken:
        return one
    several = at.where((F.col("within") | F.col("goes_on")) & ~unclosed).groupBy("source", "record", "ahead")
    pieces = F.array_sort(F.collect_list(F.struct("start", "i", "value")))
    glued = several.agg(F.array_join(F.transform(pieces, lambda x: x.value), "\n").alias("text"))
    return one.unionByName(glued.select(*place, "text", F.lit(False).alias("unclosed")))
