"""What several operators share: shared storage, Arrow text access and vectorised hashing of words and n-grams.

Everything here works on one Arrow batch, or one slice of it, at a time, so memory is bounded by the batch and not by
the table. Hashes are 64-bit polynomials with fixed random byte values, finished by a bijective mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.sources.shared import setting, shared_dir, written  # noqa: F401

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15 | 1
GRAM = U64(0xD1342543DE82EF95)
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: join_hot broadcasts the keys that hold more than one in HOT of all rows, so HOT rows at most.
HOT = 20_000
_pow: dict[str, np.ndarray] = {}


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str, spread: list[str]) -> DataFrame:
    """left with the columns of right (null where right has no row of the keys); right has one row for each keys, none null.

    weight: column of right (not returned) that says how many rows of left a row of right may meet. Rows with more than
    one in HOT of the whole weight are broadcast, so HOT rows at most; rows of left that meet them go on by a hash of
    spread, whatever their key, so no key of the merge join has more than that share of all rows.
    """
    values = [c for c in right.columns if c not in (*keys, weight)]
    as_key = lambda prefix: [F.col(k).alias(f"{prefix}{k}") for k in keys]
    total = right.agg(F.sum(weight)).first()[0] or 0
    heavy = right.where(F.col(weight) * HOT > F.lit(total)).select(*as_key("__hot_"), F.struct(*values).alias("__hot"))
    same = lambda a, b: [F.col(f"{a}{k}") == F.col(f"{b}{k}") for k in keys]
    met = left.join(F.broadcast(heavy), same("", "__hot_"), "left")
    cold = F.col("__hot").isNull()
    met = met.select(
        *left.columns, "__hot", F.when(cold, F.xxhash64(*keys)).otherwise(F.xxhash64(*spread)).alias("__at"),
        *[F.when(cold, F.col(k)).alias(f"__own_{k}") for k in keys]
    )
    rest = right.select(*as_key("__cold_"), F.struct(*values).alias("__cold"), F.xxhash64(*keys).alias("__cold_at"))
    both = met.join(rest, [F.col("__at") == F.col("__cold_at"), *same("__own_", "__cold_")], "left")
    return both.select(*left.columns, *[F.coalesce(F.col(f"__hot.{c}"), F.col(f"__cold.{c}")).alias(c) for c in values])


def held_out(doc_id: str, modulus: int, remainder: int):
    """Column: crc32 of the id's decimal text falls on the remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i below n at least."""
    if "p" not in _pow or len(_pow["p"]) < n:
        n = max(n, 1 << 20)
        for name, v in (("p", BASE), ("i", pow(BASE, -1, 2**64))):
            a = np.full(n, v, U64)
            a[0] = 1
            _pow[name] = np.multiply.accumulate(a)
    return _pow["p"], _pow["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that low and high bits are equally good."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """S with S[j]-S[i] = sum of BYTE[b]*BASE**position over positions i to j-1."""
    p, _ = powers(len(buf) + 1)
    s = np.empty(len(buf) + 1, U64)
    s[0] = 0
    np.cumsum(BYTE[buf] * p[: len(buf)], out=s[1:])
    return s


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end); equal bytes give equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(U64))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about limit bytes; a longer document stands alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def column_slices(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, list[bytes]]]:
    """The slices of a text column, each with its texts; only one slice's texts are held at a time."""
    lo = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if size and size + n > limit:
            yield lo, i, as_bytes(column.slice(lo, i - lo))
            lo, size = i, 0
        size += n + 1
    if lo < len(column):
        yield lo, len(column), as_bytes(column.slice(lo))


def joined(texts: list[bytes], sep: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a separator after each document, and the documents' starts (one more than documents)."""
    buf = np.frombuffer(sep.join([*texts, b""]), np.uint8)
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=off[1:])
    return buf, off


def tokens(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes marked in the 256-entry table inside, and the first token of each document (one more entry at the end). The separators must not be marked."""
    m = np.zeros(len(buf) + 2, np.int8)
    m[1:-1] = inside[buf]
    d = np.diff(m)
    start, end = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    return start, end, np.searchsorted(start, off)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive token hashes, at each position where n fit in the array; longer by order, not by sum."""
    if len(h) < n:
        return np.empty(0, U64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * GRAM + h[k : len(h) - n + 1 + k]
    return mix(out + U64(n))


def inside_documents(first: np.ndarray, n: int) -> np.ndarray:
    """For grams(): whether the n tokens from each position lie in one document. first: first token of each document."""
    total = int(first[-1])
    ok = np.ones(max(0, total - n + 1), bool)
    for back in range(1, n):
        at = first[1:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds; empty ranges give 0."""
    s = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=s[1:])
    return s[bounds[1:]] - s[bounds[:-1]]


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Total UTF-8 bytes of a text column: one pass that returns one number."""
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
