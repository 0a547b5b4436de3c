"""Benchmark decontamination with a broadcast hash set of normalised item windows.

Documents are scanned once, in Arrow batches: words are hashed, windows of consecutive words are looked up first in a
bit table, then in the sorted hashes, and hits are verified against the items' words. The set is broadcast in blocks of
at most MAX_WINDOWS windows, so what a task holds is bounded however many items there are; with more than one block
each block is one scan and the blocks' marks are united by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.llm.common import ASCII_LOWER, U64, as_bytes, grams, inside_documents, joined, per_document, prefix_sums, slices, spans_hash, tokens, written

WINDOW = 10
#: Windows broadcast at once: some 100 bytes each, so some 50 MB.
MAX_WINDOWS = 500_000
#: Bytes of words: digits, a-z after lower-casing, and all that is not ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def words_of(text: bytes) -> list[bytes]:
    """The normalised words of one text."""
    low = ASCII_LOWER[np.frombuffer(text + b" ", np.uint8)]
    start, end, _ = tokens(low, np.array([0, len(low)]), WORD)
    raw = low.tobytes()
    return [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (item string, n words, words joined by a space) of all items; a null text has none."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = set()
            for item, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                w = words_of(t)
                n = min(window, len(w))
                rows.update((item, n, b" ".join(w[i : i + n])) for i in range(len(w) - n + 1) if n)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.binary()))], ["item", "n", "words"])

    narrow = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), text)
    return narrow.mapInArrow(scan, "item string, n int, words binary").distinct()


class WindowSet:
    """Hashes of windows, by window length, with a bit table before the sorted array."""

    BITS = 22

    def __init__(self, rows: list[tuple[str, int, bytes]]):
        self.items: dict[bytes, list[str]] = {}
        for item, _, w in rows:
            self.items.setdefault(w, []).append(item)
        by_n: dict[int, list[bytes]] = {}
        for n, w in {(n, w) for _, n, w in rows}:
            by_n.setdefault(n, []).append(w)
        self.sorted = {n: np.unique(self._hash(ws, n)) for n, ws in sorted(by_n.items())}
        self.table = {n: self._bits(h) for n, h in self.sorted.items()}

    def _hash(self, windows: list[bytes], n: int) -> np.ndarray:
        buf, off = joined(windows)
        start, end, first = tokens(buf, off, WORD)
        h = grams(spans_hash(prefix_sums(buf), start, end), n)
        return h[first[:-1]]

    def _bits(self, h: np.ndarray) -> np.ndarray:
        t = np.zeros(1 << self.BITS, bool)
        t[h >> U64(64 - self.BITS)] = True
        return t

    def find(self, n: int, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[n][h >> U64(64 - self.BITS)])
        s = self.sorted[n]
        p = np.searchsorted(s, h[at])
        return at[s[np.minimum(p, len(s) - 1)] == h[at]]


def _scan_slice(texts: list[bytes], found: WindowSet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
    """Word starts, word ends, first word of each document, marks of hit words, and each document's items."""
    buf, off = joined(texts)
    buf = ASCII_LOWER[buf]
    start, end, first = tokens(buf, off, WORD)
    h = spans_hash(prefix_sums(buf), start, end)
    marks, items = np.zeros(len(start) + 1, np.int64), [set() for _ in texts]
    raw = buf.tobytes()
    for n in found.sorted:
        g = grams(h, n)
        at = found.find(n, g)
        at = at[inside_documents(first, n)[at]]
        # Each distinct hash is verified once in the slice, at its first place; the rest is marked by arrays.
        _, place, which = np.unique(g[at], return_index=True, return_inverse=True)
        own = [found.items.get(b" ".join(raw[start[k] : end[k]] for k in range(i, i + n))) for i in at[place].tolist()]
        good = np.array([x is not None for x in own], bool)[which] if len(at) else np.zeros(0, bool)
        at, which = at[good], which[good]
        np.add.at(marks, at, 1)
        np.add.at(marks, at + n, -1)
        doc = np.searchsorted(first, at, "right") - 1
        for d, w in np.unique(np.column_stack((doc, which)), axis=0).tolist():
            items[d].update(own[w])
    return start, end, first, np.cumsum(marks)[:-1] > 0, items


def scan_documents(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", window: int = WINDOW,
    max_windows: int = MAX_WINDOWS
) -> DataFrame:
    """One row per document row: doc_id, text_hash, n_words, n_hit, hits (word numbers as [from, to) pairs in one array), items (sorted strings).

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. A window is `window` consecutive
    words of an item, or all words of a shorter one. A document word inside an occurrence of a window is hit. Null and
    wordless texts have no words and no hits; wordless items have no windows; an empty benchmark hits nothing; repeated
    document rows give a row each; item ids are compared as strings and null is the empty string.
    """
    spark = docs.sparkSession
    windows = written(item_windows(benchmark, item_id, "text", window))  # the benchmark is read once, however many blocks there are
    total = windows.count()
    blocks = max(1, -(-total // max_windows))
    windows = windows.withColumn("block", F.pmod(F.xxhash64("words", "item"), F.lit(blocks)))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text_hash long, n_words long, n_hit long, hits array<int>, items array<string>"
    parts = None
    for b in range(blocks):
        rows = [tuple(r) for r in windows.where(F.col("block") == b).select("item", "n", "words").collect()]  # bounded by max_windows
        sent = spark.sparkContext.broadcast(WindowSet([(i, n, bytes(w)) for i, n, w in rows]))
        part = source.mapInArrow(lambda it, sent=sent: _scan(it, sent.value), schema)
        parts = part if parts is None else parts.unionByName(part)
    if blocks == 1:
        return parts
    numbered = parts.groupBy("doc_id", "text_hash").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    words = F.expr("array_distinct(flatten(transform(filter(sequence(0, size(hits) - 1), i -> i % 2 = 0 and size(hits) > 0), i -> sequence(hits[i], hits[i + 1] - 1))))")
    copies = source.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h")).agg(F.count("*").alias("__n"))
    hit = F.size(F.when(F.size("hits") > 0, words).otherwise(F.array().cast("array<int>"))).cast("long")
    united = numbered.select("doc_id", "text_hash", "n_words", hit.alias("n_hit"), "hits", "items").join(
        copies, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__h"))
    )
    return united.withColumn("__k", F.explode(F.expr("sequence(1L, __n)"))).drop("__id", "__h", "__n", "__k")


def _scan(batches: Iterator[pa.RecordBatch], found: WindowSet) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = as_bytes(b.column("text"))
        for lo, hi in slices(texts):
            _, _, first, hit, items = _scan_slice(texts[lo:hi], found)
            spans = []
            for d in range(hi - lo):
                a, z = int(first[d]), int(first[d + 1])
                if items[d]:
                    own = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:z].astype(np.int8), [0]))))
                    spans.append(own.tolist())
                else:
                    spans.append([])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").slice(lo, hi - lo),
                    b.column("text_hash").slice(lo, hi - lo),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array(per_document(hit.astype(np.int64), first), pa.int64()),
                    pa.array(spans, pa.list_(pa.int32())),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ],
                ["doc_id", "text_hash", "n_words", "n_hit", "hits", "items"],
            )


def remove_documents(docs: DataFrame, benchmark: DataFrame, min_share: float = 0.0, **options) -> DataFrame:
    """The rows and columns of docs whose share of hit words is not above min_share (with 0: documents without a hit)."""
    found = scan_documents(docs, benchmark, **options)
    bad = found.where(F.col("n_hit") > F.col("n_words") * min_share).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h")).distinct()
    return docs.join(
        bad,
        docs[options.get("doc_id", "doc_id")].eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs[options.get("text", "text")], F.lit(""))) == F.col("__h")),
        "left_anti"
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All rows and columns of docs; hit words, and what stands between two hit words next to each other, are cut from the text. Null stays null. Hits are those of the texts as given, of all blocks together."""
    found = scan_documents(docs, benchmark, doc_id=doc_id, text=text, **options).where(F.col("n_hit") > 0)
    hits = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"), F.col("hits").alias("__hits")).dropDuplicates(["__id", "__h"])
    marked = docs.join(
        hits, docs[doc_id].eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("__h")), "left"
    ).select(*[docs[f"`{c}`"] for c in docs.columns], "__hits")
    columns = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            texts, hits, out = as_bytes(b.column(at)), b.column("__hits").to_pylist(), []
            for t, own in zip(texts, hits, strict=True):
                if own:
                    buf, off = joined([t])
                    start, end, _ = tokens(ASCII_LOWER[buf], off, WORD)
                    hit = np.zeros(len(start) + 2, np.int8)
                    for i, j in zip(own[::2], own[1::2], strict=True):
                        hit[i + 1 : j + 1] = 1
                    keep, pos = [], 0
                    for i, j in np.flatnonzero(np.diff(hit)).reshape(-1, 2).tolist():
                        keep.append(t[pos : int(start[i])])
                        pos = int(end[j - 1])
                    t = b"".join([*keep, t[pos:]])
                out.append(t.decode())
            null = b.column(at).is_null().to_pylist()
            b = b.set_column(at, text, pa.array([None if n else t for n, t in zip(null, out, strict=True)], pa.string()))
            yield b.select(columns)

    return marked.mapInArrow(cut, docs.schema)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    joined_items = F.array_join("items", ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(joined_items.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


QUERIES = {"op7_decontaminate": op7_decontaminate}
SQL = {
    "op7_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, least(10, len(w)) AS n, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM bw),
ns AS (SELECT DISTINCT n FROM win),
dp AS (SELECT rid, ns.n, w, unnest(range(1, len(w) - ns.n + 2)) AS p FROM d, ns WHERE len(w) >= ns.n),
dw AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM dp),
hit AS (SELECT dw.rid, dw.n, dw.p, win.item FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
words AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS x FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
}
