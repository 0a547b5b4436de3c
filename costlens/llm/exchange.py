"""Counts of keys over all documents: batches of documents ask, key ranges answer.

Documents are dealt into batches by a hash of their id and text. A batch sends its distinct keys, sorted, as one packed
row to each key range; a range unites what it gets and answers each batch in the batch's own key order, so answers carry
no keys. Then batch and answers meet by cogroup. The documents' exchange is the same in all steps of one plan and Spark
reuses it. A batch holds about BATCH_BYTES of text (or one longer document) and a range ("bucket") about BUCKET_BYTES of
keys, whatever the size of the table; a key that all documents share is one entry a batch.

No step deals to more than RADIX ranges. Where more buckets are needed, keys go through steps of like fan-out: a step
unites the runs of as many batches as it has ranges before it deals them out anew, so rows keep their size and their
number is batches x fan-out a step, in proportion to the table. Answers take the same way back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.llm.common import U64, as_bytes, text_bytes

BATCH_BYTES, LEAST_BYTES = 10 << 20, 1 << 20
BUCKET_BYTES = 24 << 20
#: Ranges that one step deals to: one step serves up to 100 GB of keys, two 400 TB.
RADIX = 4096
ROWS = "owner long, part int, body binary"


class Run(NamedTuple):
    """Distinct keys in order, each with a count. Where 64 bits are too few, extra has 64 more, and pairs are distinct and in order."""

    keys: np.ndarray
    counts: np.ndarray
    extra: np.ndarray | None = None

    def part(self, a: int, z: int) -> Run:
        return Run(self.keys[a:z], self.counts[a:z], None if self.extra is None else self.extra[a:z])


def run_of(keys: np.ndarray, counts: np.ndarray, extra: np.ndarray | None = None, kind: str | None = None) -> tuple[Run, np.ndarray, np.ndarray]:
    """Equal keys united and their counts added; the place of each input in the run; whether it is the first input there (with kind "stable" or extra)."""
    order = np.argsort(keys, kind=kind) if extra is None else np.lexsort((extra, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if extra is not None:
        x = extra[order]
        new[1:] |= x[1:] != x[:-1]
    place = np.empty(len(k), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    at = np.flatnonzero(new)
    first = np.zeros(len(k), bool)
    first[order[at]] = True
    total = np.add.reduceat(counts[order], at, dtype=np.int64) if len(at) else np.empty(0, np.int64)
    return Run(k[at], total, None if extra is None else x[at]), place, first


def united(runs: list[Run]) -> tuple[Run, np.ndarray, np.ndarray]:
    """run_of of all runs one after another."""
    wide = any(r.extra is not None for r in runs)
    return run_of(np.concatenate([r.keys for r in runs]), np.concatenate([r.counts for r in runs]), np.concatenate([r.extra for r in runs]) if wide else None, "stable")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one body: their lengths, then their bytes."""
    return b"".join([np.array([len(arrays), *[a.nbytes for a in arrays]], "<i8").tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])


def unpack(body: bytes, *kinds: str) -> list[np.ndarray]:
    n = int(np.frombuffer(body, "<i8", 1)[0])
    sizes = np.frombuffer(body, "<i8", n, 8)
    at, out = 8 * (n + 1), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(body, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def small(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts as a bit each (whether it is not 1), a byte for those that are not, and 8 bytes for those from 255 on."""
    other = counts != 1
    some = counts[other]
    return np.packbits(other), np.minimum(some, 255).astype(np.uint8), some[some >= 255].astype("<i8")


def large(bits: np.ndarray, low: np.ndarray, big: np.ndarray, n: int) -> np.ndarray:
    some = low.astype(np.int64)
    some[low == 255] = big
    out = np.ones(n, np.int64)
    out[np.unpackbits(bits, count=n).astype(bool)] = some
    return out


def pack_run(run: Run) -> bytes:
    """Keys as their gaps; gaps and extra in as many bytes as the widest takes."""
    gaps, width = _narrow(np.diff(run.keys, prepend=run.keys[:1]))
    extra, wide = (np.empty(0, np.uint8), 0) if run.extra is None else _narrow(run.extra)
    return pack(run.keys[:1].astype("<u8"), np.array([len(run.keys), width, wide], "<i8"), gaps, *small(run.counts), extra)


def unpack_run(body: bytes) -> Run:
    start, (n, width, wide), gaps, *counts, extra = unpack(body, "<u8", "<i8", "u1", "u1", "u1", "<i8", "u1")
    keys = np.cumsum(_wide(gaps, int(n), int(width)), dtype=U64) + (start[0] if len(start) else U64(0))
    return Run(keys, large(*counts, int(n)), _wide(extra, int(n), int(wide)) if wide else None)


def _narrow(v: np.ndarray) -> tuple[np.ndarray, int]:
    width = max(1, (int(v.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(v.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width], width


def _wide(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.reshape(n, width)
    return out.view("<u8").ravel()


class Radix:
    """Buckets of the key space, reached in steps of at most RADIX ranges."""

    def __init__(self, buckets: int):
        self.depth = 1
        while RADIX**self.depth < buckets:
            self.depth += 1
        self.fan = next(f for f in range(max(1, int(buckets ** (1 / self.depth)) - 1), buckets + 1) if f**self.depth >= buckets)
        self.buckets = self.fan**self.depth

    def deal(self, run: Run, step: int, part: int = 0) -> list[bytes]:
        """Bodies for the fan ranges that range `part` of the step before is split into."""
        width = self.fan ** (self.depth - 1 - step)
        borders = np.array([((part * self.fan + k) * width << 64) // self.buckets for k in range(1, self.fan)], U64)
        edge = [0, *np.searchsorted(run.keys, borders).tolist(), len(run.keys)]
        return [pack_run(run.part(a, z)) for a, z in zip(edge[:-1], edge[1:], strict=True)]

    def narrowed(self, rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """Rows of the last step, whose ranges are buckets, and the rows of each step before it. rows: those of step 0."""
        before = []
        for step in range(1, self.depth):
            rows = rows.withColumn("up", F.expr(f"owner div {self.fan}"))
            before.append(rows)

            rows = rows.groupBy("up", "part").applyInArrow(self._again(step), ROWS)
        return rows, before

    def _again(self, step: int) -> Callable[[pa.Table], pa.Table]:
        def deal(t: pa.Table) -> pa.Table:
            part = t.column("part")[0].as_py()
            return rows_of(t.column("up")[0].as_py(), part * self.fan, self.deal(united([unpack_run(b) for b in in_order(t)[1]])[0], step, part))

        return deal

    def returned(
        self, answers: DataFrame, before: list[DataFrame], join: Callable[[list[bytes]], bytes],
        deal: Callable[[bytes, np.ndarray, np.ndarray, np.ndarray], list[bytes]]
    ) -> DataFrame:
        """Answers (owner, part, body) to the rows of step 0. join: one body of those of neighbouring ranges; deal: that body dealt to the runs united there."""
        for rows in reversed(before):

            def back(asked: pa.Table, found: pa.Table) -> pa.Table:
                owners, bodies = in_order(asked)
                runs = [unpack_run(b) for b in bodies]
                _, place, first = united(runs)
                by_part = np.argsort(found.column("part").to_numpy(), kind="stable")
                whole = join([found.column("body")[int(i)].as_py() for i in by_part])
                out = deal(whole, place, first, np.cumsum([0, *[len(r.keys) for r in runs]]))
                return pa.table(
                    [pa.array(owners, pa.int64()), pa.array([asked.column("part")[0].as_py()] * len(owners), pa.int32()), pa.array(out, pa.binary())],
                    names=["owner", "part", "body"]
                )

            up = answers.withColumn("above", F.expr(f"cast(part div {self.fan} as int)"))
            answers = rows.groupBy("up", "part").cogroup(up.groupBy("owner", "above")).applyInArrow(back, ROWS)
        return answers


def rows_of(owner: int, first_part: int, bodies: list[bytes]) -> pa.Table:
    n = len(bodies)
    return pa.table([pa.array([owner] * n, pa.int64()), pa.array(range(first_part, first_part + n), pa.int32()), pa.array(bodies, pa.binary())], names=["owner", "part", "body"])


def in_order(t: pa.Table) -> tuple[list[int], list[bytes]]:
    """Owners and bodies of rows (owner, part, body), by owner."""
    owner = t.column("owner").to_numpy()
    order = np.argsort(owner, kind="stable")
    return owner[order].tolist(), [t.column("body")[int(i)].as_py() for i in order]


class Found(NamedTuple):
    """Answers in key order: a value for each key, whether the asking run is the first of all to hold it, whether it is the only one, and what is summed over all ranges."""

    values: np.ndarray
    first: np.ndarray
    alone: np.ndarray
    totals: np.ndarray


def pack_found(f: Found) -> bytes:
    return pack(np.array([len(f.values)], "<i8"), *small(f.values), np.packbits(f.first), np.packbits(f.alone), f.totals.astype("<i8"))


def unpack_found(body: bytes) -> Found:
    (n,), *values, first, alone, totals = unpack(body, "<i8", "u1", "u1", "<i8", "u1", "u1", "<i8")
    return Found(large(*values, int(n)), *(np.unpackbits(bits, count=int(n)).astype(bool) for bits in (first, alone)), totals)


def _joined(bodies: list[bytes]) -> bytes:
    found = [unpack_found(b) for b in bodies]
    return pack_found(Found(
        np.concatenate([f.values for f in found]), np.concatenate([f.first for f in found]), np.concatenate([f.alone for f in found]),
        np.sum([f.totals for f in found], axis=0)
    ))


def _dealt(body: bytes, place: np.ndarray, first: np.ndarray, edge: np.ndarray) -> list[bytes]:
    f = unpack_found(body)
    alone = f.alone & (np.bincount(place, minlength=len(f.alone)) == 1)
    return [pack_found(Found(f.values[place[a:z]], f.first[place[a:z]] & first[a:z], alone[place[a:z]], f.totals)) for a, z in zip(edge[:-1], edge[1:], strict=True)]


def nothing(united_run: Run) -> np.ndarray:
    return np.empty(0, np.int64)


def same_counts(united_run: Run, levels: list[bytes]) -> np.ndarray:
    return united_run.counts


class Plan:
    """Documents in batches. columns: expressions that the batches carry beside the batch number b."""

    def __init__(self, docs: DataFrame, columns: dict[str, object], text: str = "text", bytes_per_text_byte: float = 1.0, buckets: int | None = None):
        total = text_bytes(docs, text)
        conf = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # Few large batches would leave cores idle: a batch may be as small as LEAST_BYTES until there is one for each task.
        self.n_batches = max(1, -(-total // BATCH_BYTES), min(conf, total // LEAST_BYTES))
        self.radix = Radix(buckets or max(1, -(-int(total * bytes_per_text_byte) // BUCKET_BYTES)))
        self.parts = min(self.n_batches, max(conf, 1))
        named = docs.select(*[c.alias(n) for n, c in columns.items()])
        key = [F.col(n) for n in columns]
        # Batches are spread evenly over tasks: batch b goes where b's hash says, one batch at a time.
        self.batches = named.withColumn("b", F.pmod(F.xxhash64(*key), F.lit(self.n_batches))).repartition(self.parts, "b")

    def asked(self, question: Callable[[pa.Table, dict], Run], before: DataFrame | None = None) -> DataFrame:
        """Rows (owner, part, body) of step 0: what the batches ask, each once in every range."""
        radix = self.radix
        ask = lambda docs, known: rows_of(docs.column("b")[0].as_py(), 0, radix.deal(question(docs, known), 0)) if docs.num_rows else rows_of(0, 0, [])
        if before is None:
            return self.batches.groupBy("b").applyInArrow(lambda docs: ask(docs, {}), ROWS)
        return self.batches.groupBy("b").cogroup(before.groupBy("owner")).applyInArrow(lambda docs, a: ask(docs, found_of(a)), ROWS)

    def ask(
        self, question: Callable[[pa.Table, dict], Run], step: int, before: DataFrame | None = None,
        totals: Callable[[Run], np.ndarray] = nothing, levels: DataFrame | None = None,
        value: Callable[[Run, list[bytes]], np.ndarray] = same_counts
    ) -> DataFrame:
        """Rows (owner, step, part, body) of answers, a value for each key asked: its count over all batches, unless value says otherwise, which also gets the bodies of levels (part, body). question also gets the answers of the steps before."""
        rows, earlier = self.radix.narrowed(self.asked(question, before))

        def merge(t: pa.Table, held: list[bytes]) -> pa.Table:
            if not t.num_rows:
                return rows_of(0, 0, [])
            owners, bodies = in_order(t)
            runs = [unpack_run(b) for b in bodies]
            whole, place, first = united(runs)
            every = np.ones(len(whole.keys), bool)
            found = pack_found(Found(value(whole, held), every, every, totals(whole)))
            out = _dealt(found, place, first, np.cumsum([0, *[len(r.keys) for r in runs]]))
            return pa.table([pa.array(owners, pa.int64()), t.column("part"), pa.array(out, pa.binary())], names=["owner", "part", "body"])

        if levels is None:
            answers = rows.groupBy("part").applyInArrow(lambda t: merge(t, []), ROWS)
        else:
            answers = rows.groupBy("part").cogroup(levels.groupBy("part")).applyInArrow(lambda t, held: merge(t, held.column("body").to_pylist()), ROWS)
        # Dealt like the batches, so that each later step finds them where its batches are.
        return self.radix.returned(answers, earlier, _joined, _dealt).repartition(self.parts, "owner").withColumn("step", F.lit(step))

    def finish(self, answers: DataFrame, last: Callable[[pa.Table, dict], pa.Table], schema: str) -> DataFrame:
        return self.batches.groupBy("b").cogroup(answers.groupBy("owner")).applyInArrow(lambda docs, a: last(docs, found_of(a)), schema)


def found_of(answers: pa.Table) -> dict[int, Found]:
    """By step, a batch's answers in the order of its keys."""
    by: dict[int, list[tuple[int, bytes]]] = {}
    for s, k, body in zip(answers.column("step").to_pylist(), answers.column("part").to_pylist(), answers.column("body").to_pylist(), strict=True):
        by.setdefault(s, []).append((k, body))
    return {s: unpack_found(_joined([body for _, body in sorted(own)])) for s, own in by.items()}


def pieces(docs: DataFrame, text: str, radix: Radix, question: Callable[[list[bytes]], Iterator[Run]]) -> DataFrame:
    """Rows (owner, part, body) of step 0 of documents that await no answer: they stay where they are read. question gives the runs of some texts."""
    owners = max(1, -(-text_bytes(docs, text) // BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in question(as_bytes(b.column(0))):
                # Any owner will do, as long as they are even and their number follows the table's size.
                owner = int(r.keys[len(r.keys) // 2] >> U64(33)) % owners if len(r.keys) else 0
                yield from rows_of(owner, 0, radix.deal(r, 0)).to_batches()

    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, ROWS)
