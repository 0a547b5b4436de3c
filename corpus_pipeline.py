"""From raw documents to token ids: quality, repeated lines, near-duplicates, benchmark passages, encoding.

Every stage takes documents with any further columns, whose values stay, and an empty table, of which it returns an
empty one. A null text counts as an empty one, and the second stage makes it one; texts are judged whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.llm import bpe, decontaminate, line_dedup, near_duplicates, quality
from costlens.llm.common import written


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject. Null and empty texts are scored like others; repeated rows are each kept or rejected alike; ties do not arise; without labels none is rejected for its text."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without lines that five documents or more share, but in the one of the largest id; n_chars follows the text.

    A null text becomes an empty one, which is one empty line and never dropped. Of repeated rows of one id each is
    a document of that id: they keep and lose the same lines.
    """
    kept = line_dedup.dedup_lines(docs).drop("n_lines", "n_dropped")
    return kept.select(*[F.char_length("text").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class of near-duplicates.

    Repeated rows of that id all stay; a class of null ids stays whole. Null, empty and blank texts have no shingles:
    they are copies of each other only where they are equal, null and empty alike.
    """
    return near_duplicates.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null, empty and wordless texts have none and stay; so do all with an empty benchmark; repeated rows go or stay alike."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of what they decode to. A null or empty text has no tokens; repeated rows give a row each."""
    return bpe.digests(docs, with_ids=True)


STAGES = [
    ("quality", classify_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]

#: Classifier, MinHash forest and BPE are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each but the last is a table in the shared folder, which the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
