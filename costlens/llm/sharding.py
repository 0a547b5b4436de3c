"""Sharding: a uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Every input partition learns beforehand how many of its rows each shard gets: the rows of the matrix are multivariate
hypergeometric draws from what the shards still lack, so that any assignment of rows to shards is equally likely. Then
rows are permuted inside their partition, dealt out by those counts, exchanged, and permuted again inside their shard.
Rows move between machines once. Only the matrix (partitions x shards counts, no rows) passes the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costlens.llm.common import written

#: Rows of a shard that one task orders; larger shards are ordered in random sub-buckets of about this size.
ROWS_PER_SORT = 1_000_000
#: Entries of the matrix up to which it is broadcast (some 128 MB); a larger one meets the rows by a merge join.
MATRIX = 16_000_000


def draw_matrix(counts: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Partition-to-shard counts: rows sum to counts, columns differ by one at most."""
    total = sum(counts)
    left = np.array([total // n_shards + (s < total % n_shards) for s in range(n_shards)], np.int64)
    rng, out = np.random.default_rng(seed), []
    for c in counts:
        row = np.zeros(n_shards, np.int64)
        need, pool = int(c), int(left.sum())
        for s in range(n_shards):
            rest = pool - int(left[s])
            row[s] = need if rest == 0 else _hypergeometric(rng, int(left[s]), rest, need)
            need -= int(row[s])
            pool = rest
        left -= row
        out.append(row.tolist())
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """numpy draws from up to 10**9; beyond that by inversion, with weights that go outward from the mode by their ratios until they vanish beside it."""
    t = good + bad
    if t < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (t + 2), low), high)
    reach = 60 + int(12 * math.sqrt(n * (good / t) * (bad / t) * ((t - n) / (t - 1))))
    down, up = np.arange(mode, max(low, mode - reach), -1, dtype=np.int64), np.arange(mode, min(high, mode + reach), dtype=np.int64)
    to_less = down / (good - down + 1.0) * ((bad - n + down) / (n - down + 1.0))
    to_more = (good - up) / (up + 1.0) * ((n - up) / (bad - n + up + 1.0))
    upto = np.cumsum(np.concatenate((np.cumprod(to_less)[::-1], [1.0], np.cumprod(to_more))))
    at = int(np.searchsorted(upto, rng.random() * upto[-1], "right"))
    return mode - len(down) + min(at, len(upto) - 1)


def shard(df: DataFrame, n_shards: int, seed: int = 7) -> DataFrame:
    """The rows of df with ``shard`` (0 to n_shards-1) and ``slot`` (0, 1, ... inside the shard).

    Shard sizes differ by one at most. All columns pass through; columns of df named shard or slot are replaced. Nulls,
    ties and repeated rows are ordinary rows. An empty table gives no rows.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c not in ("shard", "slot")]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")) if names else df.select(F.struct().alias("row"))
    placed = packed.select("row", F.spark_partition_id().alias("part"), F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("key"))
    # Permuted where they are, and numbered in the new order: the low 33 bits of the ever-increasing id count a partition's rows.
    permuted = placed.sortWithinPartitions("key").select("row", "part", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    # Written once: which partition a row stood in must not change if a task runs again.
    tagged = written(permuted)
    counts = [(r["part"], r["n"]) for r in tagged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()]
    matrix = draw_matrix([n for _, n in counts], n_shards, seed)
    dealt = spark.createDataFrame([(p, np.cumsum(m).tolist()) for (p, _), m in zip(counts, matrix, strict=True)], "part int, upto array<long>")
    side = F.broadcast(dealt) if len(counts) * n_shards <= MATRIX else dealt
    rows = tagged.join(side, "part").select("row", "part", "at", F.expr("cast(size(filter(upto, x -> x <= at)) as int)").alias("shard"))
    per_shard = max(1, sum(n for _, n in counts) // n_shards)
    buckets = max(1, per_shard // ROWS_PER_SORT)
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed + 1), "part", "at")).withColumn("sub", F.pmod(F.shiftright("key", 20), F.lit(buckets)).cast("int"))
    inner = Window.partitionBy("shard", "sub").orderBy("key", "part", "at")
    rows = rows.withColumn("rank", F.row_number().over(inner).cast("long"))
    if buckets == 1:
        return rows.select("row.*", "shard", (F.col("rank") - 1).alias("slot"))
    sizes = rows.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, ["shard", "sub"]).select("row.*", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards, law `rows`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(rows, 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_sharding": op9_sharding}
SQL: dict[str, str] = {}
