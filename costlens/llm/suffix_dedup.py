"""Suffix-array dedup by a logarithmic index family.

A string of WIDTH bytes is removed wherever it starts if it starts anywhere else too. Suffixes are indexed sparsely:
every WIDTH-byte window names one anchor inside it, the leftmost smallest CORE-byte core by a random order, so equal
windows name the same anchor at the same distance, and one anchor stands for a run of some fifty windows. A suffix array
is sorted, but not by the alphabet: by fingerprints of the CORE bytes that begin at the anchor, then of the run's whole
context, as only equality of whole windows matters.

Documents come in batches. A batch's suffix arrays are cut into key ranges (costlens.llm.exchange), and each range's is a
row of a new level; levels of like size are merged, so sizes grow geometrically (SuffixIndex). To find what repeats, the
documents' suffix arrays are merge-scanned against all levels: runs whose context occurs once more repeat as a whole,
those whose core occurs nowhere else repeat nowhere, and for the rest, the ends of long matches, windows are compared.
Contexts are compared by 64 bits among those of one 64-bit core, windows by 96 bits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.llm.common import U64, as_bytes, joined, mix, powers, prefix_sums, shared_dir, slices, spans_hash, text_bytes
from costlens.llm.exchange import BUCKET_BYTES, Plan, Radix, Run, pack_run, pieces, run_of, united, unpack_run

WIDTH, CORE = 200, 100
#: A longer document is read in portions of this size that overlap by WIDTH - 1.
PORTION = 1 << 21
_ORDER = U64(0xA24BAED4963EE407)
_TOP = U64(0xFFFFFFFF00000000)
#: What is known of a run of windows: nothing like it elsewhere; all its windows repeat; open, its windows are asked; all repeat, and its windows answer for all its copies.
ALONE, REPEATED, OPEN, SPEAKER = range(1, 5)
#: Batches in which repeated_spans adds a table to an index.
BATCHES = 3


def portions(texts: list[bytes], width: int, portion: int = PORTION) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Buffer, its documents' starts in it, their numbers, and the offset of the buffer in its (then only) document."""
    for lo, hi in slices(texts, portion):
        if hi == lo + 1 and len(texts[lo]) > portion + width:
            for at in range(0, len(texts[lo]) - width + 1, portion):
                buf, off = joined([texts[lo][at : at + portion + width - 1]])
                yield buf, off, np.array([lo]), at
        else:
            buf, off = joined(texts[lo:hi])
            yield buf, off, np.arange(lo, hi), 0


class Runs:
    """Runs of windows with one anchor, in one portion: windows from a to z, the core's fingerprint and the context's."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, width: int, core: int):
        n = len(buf)
        self.sums, self.width = prefix_sums(buf), width
        if n < width:
            self.a = self.z = self.at = np.empty(0, np.int64)
            self.core = self.context = np.empty(0, U64)
            return
        low = (self.sums[core:] - self.sums[:-core]) * powers(n + 1)[1][: n - core + 1]
        key = ((low * _ORDER) & _TOP) | np.arange(len(low), dtype=U64)
        span, have = width - core + 1, 1
        while have * 2 <= span:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if have < span:
            key = np.minimum(key[: len(key) - (span - have)], key[span - have :])
        anchor = (key & ~_TOP).astype(np.int64)  # of each window
        bad = np.zeros(len(anchor) + 1, np.int32)
        np.add.at(bad, np.minimum(np.maximum(off[:-1], off[1:] - width), len(anchor)), 1)
        np.add.at(bad, np.minimum(off[1:], len(anchor)), -1)
        fine = np.cumsum(bad[:-1]) == 0
        same = np.zeros(len(anchor) + 1, bool)
        same[1:-1] = (anchor[1:] == anchor[:-1]) & fine[1:] & fine[:-1]
        self.a = np.flatnonzero(fine & ~same[:-1])
        self.z = np.flatnonzero(fine & ~same[1:])
        self.at = at = anchor[self.a]
        self.core = spans_hash(self.sums, at, at + core)
        self.context = mix(spans_hash(self.sums, self.a, self.z + width) ^ mix((at - self.a).astype(U64) * U64(1 << 20) + self.core))

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and fingerprints of the windows of the numbered runs, and 32 bits more from core and distance to it."""
        size = self.z[runs] - self.a[runs] + 1
        start = np.repeat(self.a[runs] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        check = mix(np.repeat(self.core[runs], size) + (start - np.repeat(self.at[runs], size)).astype(U64)) >> U64(32)
        return start, spans_hash(self.sums, start, start + self.width), check


def _cat(parts: list[np.ndarray], kind=U64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


class _Job:
    def __init__(self, width: int, core: int):
        self.width, self.core, self.portion = width, core, PORTION

    def runs(self, texts: list[bytes]) -> Iterator[tuple[Runs, np.ndarray, np.ndarray, int]]:
        for buf, off, own, at in portions(texts, self.width, self.portion):
            yield Runs(buf, off, self.width, self.core), off, own, at

    def suffixes(self, texts: list[bytes]) -> Iterator[Run]:
        """Suffix arrays of slices of the texts: their anchored suffixes in order, by core and context, with counts."""
        for r, *_ in self.runs(texts):
            if len(r.a):
                yield run_of(r.core, np.ones(len(r.a), np.int64), r.context)[0]

    def of_batch(self, docs: pa.Table) -> tuple[list[tuple], Run, np.ndarray]:
        """The portions of a batch, its suffix array, and the place of each run of windows in it."""
        parts = list(self.runs(as_bytes(docs.column("text"))))
        core, context = (_cat([getattr(p[0], name) for p in parts]) for name in ("core", "context"))
        run, place, _ = run_of(core, np.ones(len(core), np.int64), context)
        return parts, run, place

    def ask_runs(self, docs: pa.Table, found: dict) -> Run:
        return self.of_batch(docs)[1]

    @staticmethod
    def codes(asked: Run, held: list[bytes]) -> np.ndarray:
        """A merge-scan of asked suffixes and the levels that hold one range: what is known of each suffix."""
        levels = [unpack_run(b) for b in held]
        both, place, _ = united([*levels, Run(asked.keys, np.zeros(len(asked.keys), np.int64), asked.extra)])
        mine = place[len(place) - len(asked.keys) :]
        if not len(mine):
            return np.empty(0, np.int64)
        new = np.ones(len(both.keys), bool)
        new[1:] = both.keys[1:] != both.keys[:-1]
        of_core = np.add.reduceat(both.counts, np.flatnonzero(new))[np.cumsum(new) - 1]
        repeated, several = both.counts[mine] > 1, of_core[mine] > both.counts[mine]
        return np.where(repeated, np.where(several, SPEAKER, REPEATED), np.where(several, OPEN, ALONE))

    def open_windows(self, docs: pa.Table, found: dict) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """For each portion its runs, their codes, and the start and fingerprints of the windows to ask; all fingerprints."""
        parts, run, place = self.of_batch(docs)
        code, first = found[0].values[place], found[0].first[place]
        once = np.zeros(len(place), bool)  # of equal runs of this batch one speaks
        once[np.unique(place, return_index=True)[1]] = True
        asks = (code == OPEN) | ((code == SPEAKER) & first & once)
        at, out = 0, []
        for r, off, own, start in parts:
            c, some = code[at : at + len(r.a)], np.flatnonzero(asks[at : at + len(r.a)])
            at += len(r.a)
            out.append((r.a, r.z, c, *r.windows(some), off, own, start))
        return out, _cat([o[4] for o in out]), _cat([o[5] for o in out])

    def ask_windows(self, docs: pa.Table, found: dict) -> Run:
        _, keys, check = self.open_windows(docs, found)
        return run_of(keys, np.ones(len(keys), np.int64), check)[0]

    def spans(self, docs: pa.Table, found: dict) -> tuple[list[bytes], list[np.ndarray]]:
        """Texts and, of each, the maximal removed runs as [from, to) pairs."""
        texts = as_bytes(docs.column("text"))
        parts, keys, check = self.open_windows(docs, found)
        place = run_of(keys, np.ones(len(keys), np.int64), check)[1]
        repeated, asked = (found[1].values > 1)[place], 0
        doc, start, end = [], [], []
        for a, z, code, w, h, _, off, own, at in parts:
            sure = np.flatnonzero((code == REPEATED) | (code == SPEAKER))
            some = w[repeated[asked : asked + len(h)]]
            asked += len(h)
            s, e = np.concatenate([a[sure], some]), np.concatenate([z[sure], some]) + self.width
            d = np.searchsorted(off, s, "right") - 1
            doc.append(own[d]), start.append(s - off[d] + at), end.append(e - off[d] + at)
        doc, start, end = (_cat(x, np.int64) for x in (doc, start, end))
        order = np.lexsort((end, start, doc))
        doc, start, end = doc[order], start[order], end[order]
        big = np.int64(max(map(len, texts), default=0) + 1)
        reach = np.maximum.accumulate(end + doc * big) if len(end) else end
        new = np.ones(len(doc), bool)
        new[1:] = (start + doc * big)[1:] > reach[:-1]
        new[1:] |= doc[1:] != doc[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
        pairs = np.column_stack([start[first], (reach - doc * big)[last]]) if len(doc) else np.empty((0, 2), np.int64)
        edges = np.searchsorted(doc[first] if len(doc) else first, np.arange(len(texts) + 1))
        return texts, [pairs[a:z] for a, z in zip(edges[:-1], edges[1:], strict=True)]


def _kept(text: bytes, spans: np.ndarray) -> bytes:
    if not len(spans):
        return text
    out, at = [], 0
    for a, z in spans.tolist():
        out.append(text[at:a])
        at = z
    return b"".join([*out, text[at:]])


class SuffixIndex:
    """The index family of a growing corpus: levels of suffix arrays below one folder, which all executors see.

    A level is a table of sorted arrays, one row for each of ``buckets`` key ranges. A new batch becomes a level, united
    with the last levels as long as they are of its size or smaller, so sizes grow geometrically and each suffix is
    written again a logarithmic number of times. Levels do not change; the list of levels is a table of its own, to
    which each batch adds a version, so an index can be opened again and a batch that failed leaves no trace.
    """

    def __init__(self, spark: SparkSession, path: str, levels: list[tuple[str, int]], version: int, buckets: int, width: int, core: int):
        self.spark, self.path, self.levels, self.version, self.buckets, self.job = spark, path.rstrip("/"), levels, version, buckets, _Job(width, core)

    @classmethod
    def create(cls, spark: SparkSession, path: str, expected_bytes: int, width: int = WIDTH, core: int = CORE) -> SuffixIndex:
        """An empty index. expected_bytes: text that it will hold in the end; more is fine, but a bucket is then larger than BUCKET_BYTES."""
        return cls(spark, path, [], 0, Radix(max(1, -(-expected_bytes // BUCKET_BYTES))).buckets, width, core)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SuffixIndex:
        """The index as its last finished batch left it."""
        rows = spark.read.parquet(f"{path.rstrip('/')}/family")
        last = rows.where(F.col("version") == rows.agg(F.max("version")).first()[0]).orderBy("nth").collect()
        return cls(spark, path, [(r["level"], r["bytes"]) for r in last], last[0]["version"], last[0]["buckets"], last[0]["width"], last[0]["core"])

    def rows(self, levels: list[tuple[str, int]]) -> DataFrame:
        schema = "part int, body binary"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}" for name, _ in levels]) if levels else self.spark.createDataFrame([], schema)

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """A batch: documents not in the index yet (the same ones again would count as copies of themselves). Null text is empty; an empty batch is a level without suffixes."""
        size, kept = text_bytes(docs, text), list(self.levels)
        radix = Radix(self.buckets)
        rows = radix.narrowed(pieces(docs, text, radix, self.job.suffixes))[0].select("part", "body")
        while kept and kept[-1][1] <= size:
            rows = rows.unionByName(self.rows(kept[-1:]))
            size += kept.pop()[1]

        def unite(t: pa.Table) -> pa.Table:
            run = united([unpack_run(b) for b in t.column("body").to_pylist()])[0]
            return pa.table([t.column("part")[:1], pa.array([pack_run(run)], pa.binary())], names=["part", "body"])

        name = f"level-{self.version + 1}-{uuid.uuid4().hex}"
        rows.groupBy("part").applyInArrow(unite, "part int, body binary").write.parquet(f"{self.path}/{name}")
        self.levels, self.version = [*kept, (name, size)], self.version + 1
        family = [(self.version, k, n, b, self.buckets, self.job.width, self.job.core) for k, (n, b) in enumerate(self.levels)]
        self.spark.createDataFrame(
            family, "version int, nth int, level string, bytes long, buckets int, width int, core int"
        ).coalesce(1).write.mode("append").parquet(f"{self.path}/family")

    def spans(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_kept: bool = False) -> DataFrame:
        """As repeated_spans, for all documents of the index: those of earlier batches too lose what a later one repeats.

        docs are all documents of all batches: windows at the end of a match are counted among them. Others raise
        ValueError, known by their bytes.
        """
        size, held = text_bytes(docs, text), sum(b for _, b in self.levels)
        if size != held:
            raise ValueError(f"the documents have {size} bytes, those of the index {held}: give all of the index's documents and no others")
        return self._spans(docs, doc_id, text, with_kept)

    def _spans(self, docs: DataFrame, doc_id: str, text: str, with_kept: bool) -> DataFrame:
        columns = {"doc_id": F.col(doc_id), "text": F.coalesce(F.col(text), F.lit(""))}
        plan, job = Plan(docs, columns, text, buckets=self.buckets), self.job
        runs = plan.ask(job.ask_runs, 0, levels=self.rows(self.levels), value=job.codes)
        windows = plan.ask(job.ask_windows, 1, before=runs)
        kind = docs.select(F.col(doc_id)).dtypes[0][1]

        def last(table: pa.Table, found: dict) -> pa.Table:
            texts, spans = job.spans(table, found) if table.num_rows else ([], [])
            kept = [_kept(t, s) for t, s in zip(texts, spans, strict=True)]
            columns = [
                table.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([s.ravel().tolist() for s in spans], pa.list_(pa.int64())),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
            ]
            return pa.table(columns + [pa.array(kept, pa.binary())] * with_kept, names=["doc_id", "n_bytes", "spans", "kept_sha256", *["kept"] * with_kept])

        return plan.finish(runs.unionByName(windows), last, f"doc_id {kind}, n_bytes long, spans array<long>, kept_sha256 string" + ", kept binary" * with_kept)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, core: int = CORE, with_kept: bool = False, batches: int = BATCHES) -> DataFrame:
    """One row per row: doc_id, n_bytes, spans (maximal removed runs, [from, to) byte pairs in one array), kept_sha256, and with_kept the kept bytes (binary, as a cut may fall inside a character).

    Each byte covered by a width-byte string that also starts anywhere else in the table, the same document included, is
    removed; strings are judged on the input. Matches never cross documents. Null text is empty; texts shorter than
    width keep all; a text of any length is read in portions; repeated rows are copies of each other and lose all their
    windows. The table goes into a new index in ``batches`` batches, whose number does not change the result.
    """
    spark = docs.sparkSession
    index = SuffixIndex.create(spark, shared_dir(spark), text_bytes(docs, text), width, core)
    for k in range(batches):
        index.add(docs.where(F.pmod(F.xxhash64(doc_id, text), F.lit(batches)) == k), text)
    return index._spans(docs, doc_id, text, with_kept)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without its repeated 200-byte strings."""
    found = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.expr("aggregate(sequence(0, size(spans) div 2), 0L, (s, i) -> s + if(2 * i < size(spans), spans[2 * i + 1] - spans[2 * i], 0L))")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.expr("size(spans) div 2").alias("n_spans"), "kept_sha256")


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
SQL: dict[str, str] = {}
