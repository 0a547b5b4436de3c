"""Approximate nearest neighbours by a permutation index.

Each vector is its ordered nearest pivots. Blocks of the table hold inverted files: for each pivot, the vectors that
list it and at which rank. A query adds up, over the files of its own pivots, what each vector saves against the
largest footrule distance of two truncated orders. Orders know directions only, so a line from savings to cosines is
fitted on a sample of the block for each query, and its upper bound times the vector's norm ranks the vectors: the best
are reranked by inner product. With equal norms that is the order of the footrule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pivots: a bounded sample of the vectors, in the order of a hash of their id.
PIVOTS = 256
#: Length of the stored orders.
ORDER = 64
#: Share of a block's vectors that is reranked, highest bound first.
RERANK = 0.2
#: Vectors of a block that the line from savings to cosines is fitted on, and standard errors that the bound lies above it.
FITTED, ABOVE = 512, 2.0
#: Vectors of a block and queries of a portion: each block meets each portion in a group of its own, so no task holds more of either.
BLOCK = 16_384
QUERIES_AT_ONCE = 64


def valid_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v (array<double>) of the rows that take part: id and vector not null, no null or non-finite component, not all zero."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")
    ).where(F.col("vec_id").isNotNull() & v.isNotNull()).where(F.coalesce(fine, F.lit(False)))


def orders(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Each row's nearest pivots by inner product of directions, nearest first, ties to the lower pivot."""
    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :length]


class Block:
    """Inverted files over some vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, order: int):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.x, self.order = ids[by_id], x[by_id], min(order, len(pivots))
        self.pivots = pivots
        listed = orders(self.x, pivots, self.order)
        flat = listed.ravel()
        at = np.argsort(flat, kind="stable")
        self.edges = np.searchsorted(flat[at], np.arange(len(pivots) + 1))
        self.rows, self.ranks = at // self.order, (at % self.order).astype(np.int32)
        self.norms = np.linalg.norm(self.x, axis=1)
        self.sample = np.unique(np.linspace(0, len(self.ids) - 1, FITTED).astype(np.int64))
        self.directions = self.x[self.sample] / self.norms[self.sample, None]

    def bounds(self, vec: np.ndarray, saved: np.ndarray) -> np.ndarray:
        """What each vector's inner product with the direction of vec may well reach, from its savings and its norm."""
        cosine, s = self.directions @ (vec / np.linalg.norm(vec)), saved[self.sample].astype(float)
        off = s - s.mean()
        slope = max(0.0, float(off @ cosine) / max(float(off @ off), 1.0))
        at = cosine.mean() - slope * s.mean()
        return self.norms * (at + slope * saved + ABOVE * (cosine - at - slope * s).std())

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, rerank: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        want = min(len(self.ids), max(int(len(self.ids) * rerank), 2 * k))
        for qid, vec, own in zip(q_ids.tolist(), q, orders(q, self.pivots, self.order), strict=True):
            # A pivot in both orders costs |r - s| instead of (order - r) + (order - s).
            saved = np.zeros(len(self.ids), np.int32)
            for r, p in enumerate(own.tolist()):
                a, z = self.edges[p], self.edges[p + 1]
                s = self.ranks[a:z]
                saved[self.rows[a:z]] += 2 * self.order - r - s - np.abs(r - s)
            if want < len(saved):
                bound = self.bounds(vec, saved)
                near = np.flatnonzero(bound >= -np.partition(-bound, want - 1)[want - 1])  # ties go along
            else:
                near = np.arange(len(saved))
            near = near[self.ids[near] != qid]
            if len(near) > k:  # what rounding cannot lift into the k best goes first
                rough = self.x[near] @ vec
                margin = 4 * len(vec) * np.finfo(float).eps * self.norms.max() * np.linalg.norm(vec)
                near = near[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 2 * margin]
            score = (self.x[near] * vec).sum(axis=1)  # row by row, so equal vectors have equal scores wherever they stand
            best = np.lexsort((self.ids[near], -score))[:k]
            yield qid, self.ids[near][best], score[best]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, n_pivots: int = PIVOTS, order: int = ORDER, rerank: float = RERANK,
    block: int = BLOCK, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """For each query the k rows found with the largest inner product: query_id, rank (from 1), vec_id, score.

    Every valid row is indexed (see valid_vectors). Vectors of several lengths have no inner product: they raise
    ValueError. A block's 2k best by the index, or the share rerank of it if that is more, are reranked. Ties go to the smaller vec_id. A row is never its own neighbour; ids must be unique (of repeated rows of one id each
    is a candidate of the others' queries, and the id is returned once). A group is one block and one portion of the
    queries, both of about ``block`` rows however many there are; only the pivots pass the driver.
    """
    spark = vectors.sparkSession
    rows, asked = valid_vectors(vectors, vec_id, embedding), valid_vectors(queries, vec_id, embedding)
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n_pivots).collect()
    schema = "query_id long, vec_id long, score double"
    if not got:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = rows.select(F.size("v").alias("d")).unionByName(asked.select(F.size("v").alias("d"))).agg(F.min("d").alias("least"), F.max("d").alias("most")).first()
    if lengths["least"] != lengths["most"]:
        raise ValueError(f"vectors of {lengths['least']} to {lengths['most']} components")
    dim = lengths["most"]
    pivots = np.array([r["v"] for r in got])
    sent = spark.sparkContext.broadcast(pivots / np.linalg.norm(pivots, axis=1, keepdims=True))
    blocks, portions = (max(1, -(-t.count() // block)) for t in (rows, asked))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n)).cast("int")
    posted = rows.withColumn("block", place(blocks)).withColumn("portion", numbers(portions))
    dealt = asked.withColumn("portion", place(portions)).withColumn("block", numbers(blocks))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = t.column("v").combine_chunks()
        return t.column("vec_id").to_numpy(), np.asarray(v.flatten() if isinstance(v, pa.Array) else pa.concat_arrays(v.chunks).flatten(), float).reshape(-1, dim)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if left.num_rows and right.num_rows:
            index = Block(*matrix(left), sent.value, order)
            q_ids, q = matrix(right)
            for lo in range(0, len(q_ids), QUERIES_AT_ONCE):
                out += [(np.full(len(ids), qid), ids, s) for qid, ids, s in index.search(q_ids[lo : lo + QUERIES_AT_ONCE], q[lo : lo + QUERIES_AT_ONCE], k, rerank)]
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    found = posted.groupBy("block", "portion").cogroup(dealt.groupBy("block", "portion")).applyInArrow(meet, schema).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", best.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


QUERIES = {"op10_ann": op10_ann}
SQL: dict[str, str] = {}
