"""Line dedup, in DataFrame functions only.

Lines are read once, as hashes with document and position. The hashes are range-partitioned and sorted by document, the
largest first, and position; one streaming pass over a hash's lines keeps those of the first document and marks the
others. Back go 64-line bitmaps per document, never text. A hash that holds more than one in common.HOT of all lines does
not go to one task: it is broadcast with its first document, and its lines are marked where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costlens.llm import common
from costlens.llm.common import written

#: What is stripped at both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII text takes the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def drop_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document that loses lines: doc_id, text_hash, dropped (map of word to 64 bits, bit p%64 of word p//64 is line p), n_dropped.

    A line's key is the line stripped and ASCII-lower-cased. Keys of at least min_chars code points in at least min_docs
    documents lose their lines except in the largest doc_id holding them. Each row is a document, so repeated rows count
    each and the copies of the largest id all keep. Null text is one empty line; a null id is smaller than all others.
    Documents without a dropped line have no row; the kept lines are all others.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    keys = F.transform(F.split(ascii_lower(F.col("text")), "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)))
    lines = base.select("doc_id", "row", F.xxhash64("text").alias("text_hash"), F.posexplode(keys).alias("pos", "key")).where(F.char_length("key") >= min_chars)
    lines = written(lines.select("doc_id", "row", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2")))
    sizes = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    hot = written(sizes.where(F.col("n") * common.HOT > F.lit(lines.count())))
    # Hot hashes, at most HOT: what is needed of each is counted in parts, row by row before all.
    found = lines.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"]).groupBy("h1", "h2", "row").agg(F.max("doc_id").alias("doc_id"))
    found = found.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("largest")).where(F.col("n_docs") >= min_docs).drop("n_docs")
    mine = ["doc_id", "text_hash", "pos"]
    lost_hot = lines.join(F.broadcast(found), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("largest"))).select(*mine)
    cold = lines.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2")
    whole = Window.partitionBy("h1", "h2")
    stream = whole.orderBy(F.col("doc_id").desc_nulls_last(), "row", "pos")
    cold = cold.withColumn("starts", F.coalesce(F.lag("row").over(stream) != F.col("row"), F.lit(True))).withColumn("largest", F.first("doc_id").over(stream))
    cold = cold.withColumn("n_docs", F.count_if("starts").over(whole))
    lost = cold.where((F.col("n_docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("largest"))).select(*mine).unionByName(lost_hot)
    words = lost.groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("doc_id", "text_hash").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"),
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped")
    )


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of docs with the dropped lines taken out of the text, and n_lines, n_dropped (replacing columns of these names)."""
    found = drop_bitmaps(docs, min_chars, min_docs, doc_id, text).select(
        F.struct("doc_id", "text_hash").alias("__k"), F.col("dropped").alias("__dropped"), F.col("n_dropped").alias("__n_dropped")
    )
    own = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    pair = own.join(found, F.col(doc_id).eqNullSafe(F.col("__k.doc_id")) & (F.xxhash64("__text") == F.col("__k.text_hash")), "left")
    kept = F.expr("array_join(filter(split(__text, '\\n', -1), (x, i) -> (shiftrightunsigned(coalesce(__dropped[cast(i div 64 as int)], 0L), cast(i % 64 as int)) & 1L) = 0L), '\\n')")
    out = pair.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in (text, "n_lines", "n_dropped")],
        F.when(F.col("__dropped").isNull(), F.col("__text")).otherwise(kept).alias(text),
        (F.octet_length("__text") - F.octet_length(F.replace("__text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce("__n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )
    return out


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document after line dedup."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
SQL = {
    "op5_line_dedup": r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
parts AS (SELECT rid, doc_id, string_split(text, chr(10)) AS ls FROM docs),
lines AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM parts),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5),
marked AS (SELECT k.rid, k.doc_id, k.pos, k.line, h.key IS NOT NULL AND k.doc_id IS DISTINCT FROM h.largest AS dropped FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, coalesce(sum(CASE WHEN dropped THEN 1 ELSE 0 END), 0)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY rid
"""
}
