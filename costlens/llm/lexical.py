"""Ranked lexical search with inverted treaps.

The index has one row for a block of documents: for each term the block's documents that hold it, in doc_id order, with
their term counts. It is built in one scan without a shuffle, and a row can be searched alone. Rows are small, as readers,
writers and Arrow hold many at once; a task takes the query terms' postings out of a row and searches those of several
rows as one portion. There the postings of each query term become a treap: search order is the document's place, heap
order its impact, so a node's impact bounds its subtree. All terms of a query are walked together over intervals of
documents: an interval's bound is the sum of its subtrees' weighted roots; below the k-th best score so far it is pruned,
else the document at the heaviest root is scored and the interval falls in two. The best so far are carried from portion
to portion of a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from costlens.llm.common import ASCII_LOWER, U64, as_bytes, column_slices, joined, mix, prefix_sums, setting, spans_hash, tokens, written
from costlens.llm.decontaminate import WORD

K = 10
#: Bytes of text in a block, about; a longer document is a block of its own.
BLOCK = 1 << 19
#: Rows in a file of the index: a writer's row group and a reader's batch are no larger (some 15 MB before compression).
FILE_ROWS = 16
#: Bytes of texts that go to Python at once while the index is built, about; a longer text goes alone.
BATCH = 1 << 23
#: Documents and postings of query terms that are searched at once, about: some 300 bytes each.
PORTION = 1 << 16
#: Pairs of query and term that are broadcast at once: some 100 bytes each.
MAX_PAIRS = 500_000
#: Pairs of interval and term that a walk may reach at once: some 100 bytes each.
WALK = 2_000_000
#: Tasks' best rows of an item are cut to its best in this many parts first.
PARTS = 64
LAST = np.iinfo(np.int64).max
INDEX = "n_docs long, n_terms long, ids array<long>, sizes array<long>, terms array<long>, starts array<long>, places array<int>, counts array<int>"


def _terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term of the texts in order, and the first of each text (one more at the end)."""
    buf, off = joined(texts)
    buf = ASCII_LOWER[buf]
    start, end, first = tokens(buf, off, WORD)
    return spans_hash(prefix_sums(buf), start, end).view(np.int64), first


def _block(ids: pa.Array, texts: list[bytes]) -> tuple | None:
    """One row of the index; None without a term. Documents without terms are left out; a null id stands last."""
    known = ids.fill_null(LAST).to_numpy(zero_copy_only=False)
    order = np.lexsort((ids.is_null().to_numpy(zero_copy_only=False), known))
    h, first = _terms_of([texts[k] for k in order])
    size = np.diff(first)
    if not len(h):
        return None
    place = np.repeat(np.cumsum(size > 0) - 1, size)
    terms, term = np.unique(h, return_inverse=True)
    n_docs = int((size > 0).sum())
    key, count = np.unique(term * np.int64(n_docs) + place, return_counts=True)
    starts = np.searchsorted(key, np.arange(len(terms) + 1, dtype=np.int64) * n_docs)
    return n_docs, len(h), ids.take(pa.array(order[size > 0])), size[size > 0], terms, starts, (key % n_docs).astype(np.int32), count.astype(np.int32)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The index, a row a block of documents (INDEX): write it once (write_index), search it often.

    Terms are runs of digits, letters (A-Z lower-cased) and non-ASCII characters, known by 64-bit hashes. Null, empty and
    termless texts are in no block; repeated rows are documents of their own; doc_ids are integers, null stands after
    all; a very long text is a block of its own; an empty table has no blocks. block: bytes of text in a block, about.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in column_slices(b.column(1), block):
                if row := _block(b.column(0).slice(lo, hi - lo), texts):
                    kinds = (pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4, *[pa.list_(pa.int32())] * 2)
                    cells = [pa.array([x], kind) if k < 2 else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x)) for k, (x, kind) in enumerate(zip(row, kinds, strict=True))]
                    yield pa.RecordBatch.from_arrays(cells, [c.split()[0] for c in INDEX.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, INDEX)


def write_index(index: DataFrame) -> DataFrame:
    """The index, built once in the shared folder, in files of FILE_ROWS rows at most, from Arrow batches of BATCH bytes."""
    with setting(index.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH):
        return written(index, maxRecordsPerFile=FILE_ROWS)


def query_terms(queries: DataFrame, query_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item, term) of all queries; rows of one id are one query."""
    kind = dict(queries.select(F.col(query_id).alias("item")).dtypes)["item"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, first = _terms_of(as_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), np.diff(first)))), pa.array(h)], ["item", "term"])

    return queries.select(F.col(query_id).alias("item"), F.col(text).alias("text")).mapInArrow(scan, f"item {kind}, term long").distinct()


def _cells(batch: pa.RecordBatch, names: list[str]) -> Iterator[list]:
    """The arrays of each row."""
    for i in range(batch.num_rows):
        yield [batch.column(n)[i].values for n in names]


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the values that both hold; both sorted and distinct."""
    if len(a) > len(b):
        return _common(b, a)[::-1]
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    own = np.flatnonzero(b[at] == a)
    return own, at[own]


def document_counts(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """Documents that hold each of the terms (sorted); reads only the index's terms and starts."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        total = np.zeros(len(wanted), np.int64)
        for b in batches:
            for own, starts in _cells(b, ["terms", "starts"]):
                own, starts = own.to_numpy(), starts.to_numpy()
                at, to = _common(own, wanted)
                total[to] += starts[at + 1] - starts[at]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[at]), pa.array(total[at])], ["term", "n"])

    rows = index.select("terms", "starts").mapInArrow(scan, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in rows.collect()}  # a row a query term at most


class Queries:
    """Pairs of query and weighted term, by query, with the collection's counts."""

    def __init__(self, pairs: list[tuple], found: dict[int, int], n_docs: int, n_terms: int, k: int = K):
        self.items = list(dict.fromkeys(p[0] for p in pairs))
        number = {x: i for i, x in enumerate(self.items)}
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in found.items()}
        kept = sorted((number[x], t) for x, t in pairs if weight.get(t, 0) > 0)  # a term without weight adds nothing
        self.terms = np.unique(np.array([t for _, t in kept], np.int64))
        self.query = np.array([q for q, _ in kept], np.int64)
        self.term = np.searchsorted(self.terms, np.array([t for _, t in kept], np.int64))
        self.weight = np.array([weight[t] for t in self.terms.tolist()], np.int64)
        self.n_docs, self.n_terms, self.k = n_docs, n_terms, k


class Best:
    """The k best (score, doc_id) of each query so far; score 0 stands for none."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.doc = k, np.zeros((n, k), np.int64), np.full((n, k), LAST)
        self.scored = 0

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        self.scored += len(query)
        new = (score > self.score[query, -1]) | ((score == self.score[query, -1]) & (doc < self.doc[query, -1]))
        if not new.any():
            return
        own = np.unique(query[new])
        q = np.concatenate((np.repeat(own, self.k), query[new]))
        s = np.concatenate((self.score[own].ravel(), score[new]))
        d = np.concatenate((self.doc[own].ravel(), doc[new]))
        order = np.lexsort((d, -s, q))
        first = np.searchsorted(q[order], own)
        take = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.score[own], self.doc[own] = s[take].reshape(-1, self.k), d[take].reshape(-1, self.k)


def treaps(starts: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left child, right child of each posting, and the root of each list, -1 for none. Lists are [starts[i], starts[i+1]), none empty; equal impacts are ordered by a hash, so that copies do not make chains."""
    n = len(impact)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((mix(np.arange(n, dtype=np.uint64) + U64(1)), impact))] = np.arange(n)
    child = np.full(2 * n, -1)  # left children, then right ones
    members, at, slot, roots = np.arange(n), starts[:-1], None, np.empty(0, np.int64)
    while len(members):
        part = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(members))))
        is_root = rank[members] == np.maximum.reduceat(rank[members], at)[part]
        root = members[is_root]
        if slot is None:
            roots = root
        else:
            child[slot] = root
        part, members = part[~is_root], members[~is_root]
        later = members > root[part]
        at = np.flatnonzero(np.diff(part * 2 + later, prepend=-1))
        slot = root[part[at]] + n * later[at]
    return child[:n], child[n:], roots


def _trim(node: np.ndarray, lo: np.ndarray, hi: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The roots of the subtrees' parts strictly between lo and hi; -1 for none."""
    node = node.copy()
    todo = np.flatnonzero(node >= 0)
    while len(todo):
        own = node[todo]
        p = place[own]
        over, under = p >= hi[todo], p <= lo[todo]
        out = over | under
        todo = todo[out]
        node[todo] = np.where(over[out], left[own[out]], right[own[out]])
        todo = todo[node[todo] >= 0]
    return node


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of start[1] ..."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def postings(row: list, wanted: Queries) -> tuple[np.ndarray, ...]:
    """Of a block: doc_ids, null as LAST; for each posting of a query term: the term's number, the document's place, the impact. Nothing refers to the row. row: ids, sizes, terms, starts, places, counts."""
    ids = np.array(row[0].fill_null(LAST).to_numpy(zero_copy_only=False))
    sizes, terms, starts, places, counts = (x.to_numpy() for x in row[1:])
    at, held = _common(terms, wanted.terms)
    size = starts[at + 1] - starts[at]
    own = _ranges(starts[at], size)
    place = places[own].astype(np.int64)
    tf = counts[own].astype(np.int64)
    m = 10 + 90 * sizes * wanted.n_docs // wanted.n_terms
    return ids, np.repeat(held, size), place, 10**9 * tf // (1000 * tf + 8 * m[place])


def search_block(row: list, wanted: Queries, best: Best) -> None:
    """Adds a block's best documents to best. row: ids, sizes, terms, starts, places, counts."""
    search_postings([postings(row, wanted)], wanted, best)


def search_postings(parts: list[tuple], wanted: Queries, best: Best) -> None:
    """Adds the best documents of some blocks to best. parts: postings() of each."""
    ids, term, place, impact = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(term):
        return
    # Documents of all blocks in doc_id order, postings by term and document.
    by_id = np.argsort(ids, kind="stable")
    to = np.empty(len(ids), np.int64)
    to[by_id] = np.arange(len(ids))
    docs = np.array([len(p[0]) for p in parts])
    place = to[place + np.repeat(np.cumsum(docs) - docs, [len(p[1]) for p in parts])]
    ids, stride = ids[by_id], np.int64(len(ids))
    order = np.argsort(term * stride + place)
    term, place, impact = term[order], place[order], impact[order]
    held, begin = np.unique(term, return_index=True)
    begin = np.append(begin, len(term))
    left, right, roots = treaps(begin, impact)
    key = np.repeat(np.arange(len(held)), np.diff(begin)) * stride + place
    number = np.full(len(wanted.terms), -1)
    number[held] = np.arange(len(held))
    there = number[wanted.term] >= 0
    query, lists = wanted.query[there], number[wanted.term][there]
    weight = wanted.weight[wanted.term][there]
    # As many queries at once as the walk's arrays allow.
    group = np.cumsum(np.ones(len(query), np.int64)) * min(len(ids), 4096) // WALK
    bounds = np.flatnonzero(np.diff(query, prepend=-1))
    group = np.repeat(group[bounds], np.diff(np.append(bounds, len(query))))
    for g in np.unique(group):
        p = group == g
        _walk(query[p], lists[p], weight[p], roots, left, right, place, impact, key, stride, ids, best)


def _walk(query, lists, weight, roots, left, right, place, impact, key, stride, ids, best: Best) -> None:
    """All queries at once, level by level. A pair is an interval and a term with postings in it; pairs of an interval stand together."""
    at = np.flatnonzero(np.diff(query, prepend=-1))
    asks, lo, hi = query[at], np.full(len(at), -1), np.full(len(at), stride)
    of, node = np.cumsum(np.diff(query, prepend=-1) > 0) - 1, roots[lists]
    while len(of):
        value = weight * impact[node]
        at = np.flatnonzero(np.diff(of, prepend=-1))
        bound = np.add.reduceat(value, at)
        asks, lo, hi = asks[of[at]], lo[of[at]], hi[of[at]]
        size = np.diff(np.append(at, len(of)))
        least, doc = best.score[asks, -1], best.doc[asks, -1]
        alive = (bound > least) | ((bound == least) & (bound > 0) & (ids[lo + 1] < doc))
        keep = np.repeat(alive, size)
        lists, weight, node, value = lists[keep], weight[keep], node[keep], value[keep]
        asks, lo, hi, size = asks[alive], lo[alive], hi[alive], size[alive]
        if not len(asks):
            return
        at = np.concatenate(([0], np.cumsum(size)[:-1]))
        of = np.repeat(np.arange(len(asks)), size)
        # The document at each interval's heaviest root, and its score over all terms of the interval.
        top = np.flatnonzero(value == np.maximum.reduceat(value, at)[of])
        cut = place[node[top[np.unique(of[top], return_index=True)[1]]]]
        look = lists * stride + cut[of]
        found = np.minimum(np.searchsorted(key, look), len(key) - 1)
        score = np.add.reduceat(np.where(key[found] == look, weight * impact[found], 0), at)
        best.add(asks, score, ids[cut])
        # Each interval in two, each subtree trimmed to both.
        p, mid = place[node], cut[of]
        low = _trim(np.where(p < mid, node, left[node]), lo[of], mid, place, left, right)
        high = _trim(np.where(p > mid, node, right[node]), mid, hi[of], place, left, right)
        node, both = np.concatenate((low, high)), np.concatenate((of * 2, of * 2 + 1))
        order = np.argsort(both, kind="stable")
        order = order[node[order] >= 0]
        of, node = both[order], node[order]
        lists, weight = np.tile(lists, 2)[order], np.tile(weight, 2)[order]
        asks, lo, hi = np.repeat(asks, 2), np.column_stack((lo, cut)).ravel(), np.column_stack((cut, hi)).ravel()


def search(index: DataFrame, queries: DataFrame, query_id: str = "item_id", text: str = "text", k: int = K) -> DataFrame:
    """item, rank, doc_id, score: each query's k highest-scoring documents with score above 0, ties to the smaller doc_id (null last).

    Counts are those of the whole index. Queries without terms, or with none that a document holds, have no rows;
    rows of one query id are one query; an empty index or no queries give no rows. Queries go out in blocks of
    MAX_PAIRS terms at most; each block reads the index once.
    """
    spark = index.sparkSession
    pairs = written(query_terms(queries, query_id, text))
    kind, arrow_kind = dict(pairs.dtypes)["item"], to_arrow_type(pairs.schema["item"].dataType)
    blocks = max(1, -(-pairs.count() // MAX_PAIRS))
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    names = ["ids", "sizes", "terms", "starts", "places", "counts"]
    parts = None
    for b in range(blocks):
        rows = [tuple(r) for r in pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()]  # bounded by MAX_PAIRS
        found = document_counts(index, np.unique(np.array([t for _, t in rows], np.int64)))
        sent = spark.sparkContext.broadcast(Queries(rows, found, n_docs, n_terms, k))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            wanted = sent.value
            best = Best(len(wanted.items), wanted.k)
            parts, size = [], 0
            for batch in batches:
                for row in _cells(batch, names):
                    parts.append(postings(row, wanted))
                    size += len(parts[-1][0]) + len(parts[-1][1])
                    if size >= PORTION:
                        search_postings(parts, wanted, best)
                        parts, size = [], 0
            if parts:
                search_postings(parts, wanted, best)
            q, r = np.nonzero(best.score)
            doc = best.doc[q, r]
            cells = [pa.array([wanted.items[i] for i in q.tolist()], arrow_kind), pa.array(doc, mask=doc == LAST), pa.array(best.score[q, r])]
            if len(q):
                yield pa.RecordBatch.from_arrays(cells, ["item", "doc_id", "score"])

        part = index.select(names).mapInArrow(scan, f"item {kind}, doc_id long, score long")
        parts = part if parts is None else parts.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    parts = parts.withColumn("part", F.spark_partition_id() % PARTS)
    parts = parts.withColumn("rank", nth("item", "part")).where(F.col("rank") <= k)
    return parts.withColumn("rank", nth("item")).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item, by the index of all documents."""
    # Read piece by piece: vectored reads of local files copy the whole texts of a row group outside the heap, beside those within.
    docs = spark.read.option("parquet.hadoop.vectored.io.enabled", "false").parquet(f"{sf_dir}/documents.parquet")
    index = write_index(build_index(docs))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("item", "item_id")


QUERIES = {"op12_lexical_search": op12_lexical_search}
SQL = {
    "op12_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark),
c AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) GROUP BY rid, t),
q AS (SELECT * FROM tf WHERE t IN (SELECT t FROM b)),
wt AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM q, c GROUP BY t),
m AS (SELECT rid, doc_id, 10 + 90 * len(w) * n_docs // n_terms AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT b.item_id, rid, m.doc_id, sum(weight * (1000000000 * tf // (1000 * tf + 8 * m)))::BIGINT AS score FROM b JOIN q USING (t) JOIN wt USING (t) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, rid)::INT AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 10
"""
}
