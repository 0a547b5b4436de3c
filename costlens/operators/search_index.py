"""A trigram index beside the resource table, for searches that must not read all of it.

Resources are stored in buckets by ranges of their ids, and the index says which trigrams each bucket holds, in ids or
services. A search reads the buckets that hold every trigram of its text, and looks for the text there; so what it finds
is what a scan finds. The index has a row for each trigram and bucket, whatever the number of resources in the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.operators.explore import search_resources

GRAM = 3
#: Resources in a bucket, about.
BUCKET_ROWS = 50_000
#: Buckets at most; with more resources a bucket is larger.
MAX_BUCKETS = 10_000


def _grams(text: Column) -> Column:
    return F.when(F.length(text) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda k: F.substring(text, k, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))


class ResourceIndex:
    """A stored resource table with its trigrams, below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        kind = spark.read.parquet(f"{self.path}/columns").schema  # a table without rows has no files to tell its columns
        self.resources = spark.read.schema(kind.add("bucket", "integer")).parquet(f"{self.path}/resources")
        self.grams = spark.read.schema("gram string, bucket int").parquet(f"{self.path}/grams")

    @classmethod
    def build(cls, resources: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS) -> ResourceIndex:
        """Stores the table, in ranges of ids, and then its trigrams as they were stored."""
        spark, root = resources.sparkSession, path.rstrip("/")
        n = min(MAX_BUCKETS, max(1, -(-resources.count() // bucket_rows)))
        dealt = resources.repartitionByRange(n, F.lower("id"), "first_line").withColumn("bucket", F.spark_partition_id())
        resources.limit(0).write.parquet(f"{root}/columns")
        dealt.write.partitionBy("bucket").parquet(f"{root}/resources")
        stored = spark.read.schema(dealt.schema).parquet(f"{root}/resources")
        text = F.array_union(_grams(F.lower("id")), _grams(F.lower(F.coalesce("service", F.lit("")))))
        grams = stored.select(F.explode(text).alias("gram"), F.col("bucket").cast("int").alias("bucket")).distinct()
        grams.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{root}/grams")
        return cls(spark, root)

    def buckets(self, text: str) -> list[int] | None:
        """The buckets that hold all trigrams of text; None where it is too short to say."""
        q = text.strip().lower()
        if len(q) < GRAM:
            return None
        grams = sorted({q[k : k + GRAM] for k in range(len(q) - GRAM + 1)})
        found = self.grams.where(F.col("gram").isin(grams)).groupBy("bucket").agg(F.count("*").alias("n"))
        return sorted(r["bucket"] for r in found.where(F.col("n") == len(grams)).collect())  # MAX_BUCKETS at most

    def search(self, text: str) -> DataFrame:
        """As search_resources over the whole table. Texts under three characters are looked for in all buckets."""
        own = self.buckets(text)
        rows = self.resources if own is None else self.resources.where(F.col("bucket").isin(own))
        return search_resources(rows, text).drop("bucket")
