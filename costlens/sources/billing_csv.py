"""Billing exports as CSV in, report tables and resource lists out."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.functions.policy import Mapping, Policy
from costlens.functions.scalars import stripped
from costlens.sources.records import Records, read_records, split_cells
from costlens.sources.shared import written

BAD = "_malformed"
#: Different columns of all files together: the driver holds their names.
MAX_COLUMNS = 20_000
#: Files (a path each) and layouts (a number for each column) that are broadcast; beyond them rows are shuffled to theirs.
MAX_FILES, MAX_LAYOUTS = 100_000, 1_000


@dataclass(frozen=True)
class Export:
    """One export in one file or many: names (of all files, in order of first appearance), headers (source, position, header: one row a column of a file) and records (sources.records)."""

    names: list[str]
    headers: DataFrame
    records: Records
    sep: str


def open_export(spark: SparkSession, path: str, sep: str = ",", multi_line: bool | None = None) -> Export:
    """Reads the text of the files once and the header of each file. multi_line=False states that no cell holds a line break."""
    records = read_records(spark, path, sep, multi_line is not False)
    first = records.rows.where((F.col("record") == 1) & ~F.col("unclosed")).select("source", split_cells(F.regexp_replace("text", "^\ufeff", ""), sep).alias("cells"))
    headers = written(first.select("source", F.posexplode("cells").alias("position", "header")).select("source", "position", stripped(F.col("header")).alias("header")))
    return Export([n for n, _ in _columns(headers)], headers, records, sep)


def _columns(headers: DataFrame) -> list[tuple[str, int]]:
    """(name, how many of that name stand before it in its file) of all files' columns, by first appearance."""
    nth = F.row_number().over(Window.partitionBy("source", "header").orderBy("position")) - 1
    found = headers.select("source", "position", "header", nth.alias("nth")).groupBy("header", "nth").agg(F.min(F.struct("source", "position")).alias("first"))
    rows = found.orderBy("first").limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"the files have more than {MAX_COLUMNS} different columns")
    return [(r["header"], r["nth"]) for r in rows]


def read_headers(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The trimmed names of all files' columns, those of the first file first. Names that differ only in case stay apart."""
    return open_export(spark, path, sep).names


def has_open_quotes(spark: SparkSession, path: str, sep: str = ",") -> bool:
    """Whether some cell goes on in the next line."""
    return read_records(spark, path, sep).broken


def read_line_items(spark: SparkSession, path: str, sep: str = ",", multi_line: bool | None = None) -> DataFrame:
    """lines_of the export that open_export reads."""
    return lines_of(open_export(spark, path, sep, multi_line))


def lines_of(export: Export, first: int | None = None) -> DataFrame:
    """All cells (or those of the first data rows: only their splits are read) as text under c0, c1, ... (the export's names), with source (the file), line_no and the text of malformed rows.

    Each file's cells go by its own header, whatever the order of its columns; a column that a file has not is null. A
    row with another number of cells than its file's header, or with a quote that is never closed, is malformed. line_no
    is the 1-based position among all data rows, malformed ones included and blank lines not, file after file by path.
    Files without a header have no rows.
    """
    columns = _columns(export.headers)
    nth = F.row_number().over(Window.partitionBy("source", "header").orderBy("position")) - 1
    key = F.struct("header", nth.alias("nth"))
    layouts = export.headers.select("source", "position", key.alias("key")).groupBy("source").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "position"))).alias("at"), F.count("*").alias("width")
    )
    places = F.array(*[F.col("at")[F.struct(F.lit(n).alias("header"), F.lit(k).alias("nth"))] for n, k in columns]) if columns else F.array().cast("array<int>")
    # By text: a hash of the array itself would pass over the columns that a file has not.
    layout = F.xxhash64("width", F.array_join("places", ",", "-"))
    files = written(layouts.select(F.col("source").alias("file"), "width", places.alias("places")).withColumn("layout", layout))
    kinds = files.select("layout", "width", "places").distinct()
    if kinds.count() != kinds.select("layout").distinct().count():
        raise ValueError("two layouts have one hash")
    n_files, n_kinds = files.count(), kinds.count()
    rows = (export.records.rows if first is None else export.records.first_rows(first)).where(F.col("record") > 1)
    if n_kinds == 1:  # as in most exports: all files have the same columns in the same order
        one = kinds.first()
        rows = rows.withColumn("width", F.lit(one["width"]))
        cell = lambda i: F.get("cells", F.lit(one["places"][i]))
    else:
        # A row finds its file's layout, a number, and then the layout's places.
        small = lambda df, n, most: F.broadcast(df) if n <= most else df
        rows = rows.join(small(files.select("file", "layout"), n_files, MAX_FILES), F.col("source") == F.col("file"))
        rows = rows.join(small(kinds, n_kinds, MAX_LAYOUTS), "layout")
        cell = lambda i: F.get("cells", F.get("places", F.lit(i)))
    rows = rows.withColumn("cells", split_cells(F.col("text"), export.sep))
    fits = ~F.col("unclosed") & (F.size("cells") == F.col("width"))
    cells = [(F.when(fits, cell(i)) if i else F.when(fits, cell(i)).otherwise(F.get("cells", F.lit(0)))).alias(f"c{i}") for i in range(len(columns))]
    return rows.select("source", "line_no", *cells, F.when(~fits, F.col("text")).alias(BAD))


def split_malformed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the rejected ones: source (the file), line_no, text and first cell."""
    return df.where(F.col(BAD).isNull()).drop(BAD), df.where(F.col(BAD).isNotNull()).select("source", "line_no", BAD, "c0")


def sample_lines(df: DataFrame, n: int = 500) -> DataFrame:
    """The first rows, for a preview."""
    return df.orderBy("line_no").limit(n)


def sample_export(export: Export, n: int = 500) -> DataFrame:
    """The first good rows of an export: twice as many rows are looked at until n are good, so few splits are read however many there are."""
    ahead, total = n, export.records.count()
    while True:
        good, _ = split_malformed(lines_of(export, ahead))
        if ahead >= total or good.limit(n).count() >= n:
            return sample_lines(good, n)
        ahead *= 2


def header_table(spark: SparkSession, names: list[str], source: str = "file") -> DataFrame:
    return spark.createDataFrame([(source, i, n) for i, n in enumerate(names)], "source string, position int, header string")


def cell_table(df: DataFrame, source: str = "file") -> DataFrame:
    """source, line, position, value of every cell of c0, c1, ..."""
    cols = [c for c in df.columns if c[0] == "c" and c[1:].isdigit()]
    cells = F.array(*[F.struct(F.lit(int(c[1:])).alias("position"), F.col(c).alias("value")) for c in cols])
    return df.select(F.lit(source).alias("source"), F.col("line_no").alias("line"), F.explode(cells).alias("x")).select("source", "line", "x.position", "x.value")


def cells_by_source(df: DataFrame, names: list[str], headers: DataFrame) -> DataFrame:
    """source, line, position, value of the cells of lines_of many files, each at its place in its own file (of equal names the first)."""
    first = {n: i for i, n in reversed(list(enumerate(names)))}
    cells = F.array(*[F.struct(F.lit(n).alias("header"), F.col(f"c{i}").alias("value")) for n, i in first.items()])
    at = headers.groupBy("source", "header").agg(F.min("position").alias("position"))
    return df.select("source", F.col("line_no").alias("line"), F.explode(cells).alias("x")).select("source", "line", "x.*").join(at, ["source", "header"]).select("source", "line", "position", "value")


def with_headers(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns by header; of equal names the first."""
    first = {n: i for i, n in reversed(list(enumerate(names)))}
    return df.select("line_no", *[F.coalesce(f"c{i}", F.lit("")).alias(n) for n, i in first.items()])


REFUSALS = {"header": "the file has no header", "rows": "the file has no data rows", "tags": "no mandatory tag is mapped"}


def input_checks(names: list[str], df: DataFrame, mapping: Mapping | None = None, policy: Policy = Policy()) -> DataFrame:
    """check, passed: a header, data rows, and with a mapping a mapped tag."""
    rows = df.limit(1).agg((F.count("*") > 0).alias("passed")).select(F.lit("rows").alias("check"), "passed")
    known = {"header": any(names)} | ({"tags": bool(mapping.tracked(policy))} if mapping is not None else {})
    return df.sparkSession.createDataFrame(list(known.items()), "check string, passed boolean").unionByName(rows)


def input_guard(names: list[str], df: DataFrame, mapping: Mapping | None = None, policy: Policy = Policy()) -> None:
    """Refuses a file without a header, without data rows, and an audit without any mapped tag."""
    failed = {r["check"] for r in input_checks(names, df, mapping, policy).where("not passed").collect()}
    for check, message in REFUSALS.items():
        if check in failed:
            raise ValueError(message)


def resources_for_csv(resources: DataFrame, tags: list[str], currency: str | None = None) -> DataFrame:
    """The columns of the exported list; missing tags are blank."""
    cost = f"cost_{currency}" if currency else "cost"
    return resources.select(
        F.col("id").alias("resource_id"), F.coalesce("service", F.lit("")).alias("service"), F.col("cost").alias(cost), "line_items",
        *[F.when(F.array_contains("missing", k), "").otherwise(F.col(k)).alias(k) for k in tags]
    )


def write_resources_csv(resources: DataFrame, path: str, tags: list[str], currency: str | None = None) -> None:
    """CSV files in a folder, cells as they are: blanks around them stay."""
    resources_for_csv(resources, tags, currency).write.options(header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_resources_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What write_resources_csv wrote; an empty cell is an empty string."""
    back = spark.read.schema(schema).options(header=True, escape='"', multiLine=True).csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) if kind == "string" else F.col(c) for c, kind in back.dtypes])


def write_report(tables: dict[str, DataFrame], path: str) -> str:
    """One Parquet table for each part of the report, in a new folder; then the manifest that names them. Returns the version.

    What fails before the manifest is there leaves the report before as it is: read_report reads the parts of the
    newest manifest, so never parts of two reports.
    """
    root, version = path.rstrip("/"), f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/parts/{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version, name) for name in tables], "version string, part string").coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return version


def read_report(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    """The parts of the newest report under path, or of the version given."""
    root = path.rstrip("/")
    manifest = spark.read.schema("version string, part string").parquet(f"{root}/manifest")
    version = version or manifest.agg(F.max("version")).first()[0]
    names = sorted(r["part"] for r in manifest.where(F.col("version") == version).collect())
    if not names:
        raise ValueError(f"no report {version} in {path}")
    return {name: spark.read.parquet(f"{root}/parts/{version}/{name}") for name in names}
