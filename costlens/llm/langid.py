"""Language identification by bit-sliced Bloom filters of byte n-grams.

The slots of one table hold a bit for each language; an n-gram of language l sets bit l in each of its slots, so that
the AND of an n-gram's slots is the set of all languages containing it. A document's score for a language is its share
of n-grams with that bit, corrected for the filter's false positives: (share - fp) / (1 - fp), where fp is the
language's fill to the power of the number of slots.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costlens.llm.common import ASCII_LOWER, SPACE, U64, as_bytes, held_out, joined, mix, per_document, slices, written

N = 4
#: Documents of each language to fit on, in the order of a hash of their id.
MAX_DOCS = 3_000
#: Ranges of hashes, as a power of two, whose sizes tell where a language's first ids end.
RANGES = 16
#: Chosen ids up to this number are broadcast to find their texts; more meet the texts by a merge join.
BROADCAST_IDS = 500_000
#: Each language's filter has 2**BITS slots, if the table has room, and ROOM for each n-gram of the language that has most.
BITS, HASHES, ROOM = 20, 2, 16
#: The table grows to 2**MOST_BITS words (128 MB); beyond that no n-gram is left out, but the corrected false positives rise.
MOST_BITS = 24
#: Slots of one bitmap of Spark's bitmap_construct_agg.
PAGE = 32_768
LETTER = re.compile(r"[^\W\d_]")
_MARKED = ASCII_LOWER.copy()
_MARKED[:48] = _MARKED[58:65] = _MARKED[91:97] = _MARKED[123:128] = 32
_MARKED[48:58] = 32


def gram_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit codes of the byte n-grams of each text, A-Z lower-cased, all ASCII but letters as blanks, n-grams of blanks only left out; and each text's first code (one more entry)."""
    buf, off = joined(texts)
    low = _MARKED[buf].astype(np.uint32)
    code = (low[:-3] << np.uint32(24)) | (low[1:-2] << np.uint32(16)) | (low[2:-1] << np.uint32(8)) | low[3:] if len(low) >= N else np.empty(0, np.uint32)
    ok = np.zeros(len(code), bool)
    ok[:] = ((low[1:-2] != 32) & (low[2:-1] != 32)) if len(code) else False
    for back in (0, 1, 2):  # a code must not go beyond its text's separator
        at = off[1:] - 1 - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    at = np.flatnonzero(ok)
    return code[at], np.searchsorted(at, off)


def slots(code: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(code.astype(U64) + U64(0x51ED270B))
    return [(h >> U64(k * bits)) & U64((1 << bits) - 1) for k in range(HASHES)]


def bits_for(n_languages: int, most_grams: int) -> int:
    """Slots, as a power of two, for filters of up to most_grams n-grams."""
    words = max(1, -(-n_languages // 64))
    most = MOST_BITS - (words - 1).bit_length()
    if 1 << most < PAGE:
        raise ValueError(f"{n_languages} languages: filters of so many do not fit into a table of 2**{MOST_BITS} words")
    return min(max(BITS, (ROOM * most_grams - 1).bit_length() if most_grams else 0), most)


class Filters:
    """The slot table, as many 64-bit words a slot as the languages need, of pages (language, number, bitmap)."""

    def __init__(self, languages: list[str], bits: int, pages: Iterable[tuple[str, int, bytes]]):
        self.languages, self.bits = languages, bits
        self.table = np.zeros((max(1, -(-len(languages) // 64)), 1 << bits), U64)
        number = {lang: k for k, lang in enumerate(languages)}
        for lang, page, bitmap in pages:
            k = number[lang]
            at = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")) + page * PAGE
            self.table[k // 64][at] |= U64(1) << U64(k % 64)
        fill = [(self.table[k // 64] >> U64(k % 64) & U64(1)).mean() for k in range(len(languages))]
        self.false = np.array([f**HASHES for f in fill])

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """Of each text and language: the corrected share of the text's n-grams."""
        out = [np.zeros((0, len(self.languages)))]
        for lo, hi in slices(texts):
            code, first = gram_codes(texts[lo:hi])
            at = slots(code, self.bits)
            total = np.maximum(np.diff(first), 1)
            share = np.zeros((hi - lo, len(self.languages)))
            for w, table in enumerate(self.table):
                mask = table[at[0]]
                for s in at[1:]:
                    mask &= table[s]
                for k in range(64 * w, min(64 * w + 64, len(self.languages))):
                    share[:, k] = per_document((mask >> U64(k % 64) & U64(1)).astype(np.int64), first) / total
            out.append(np.clip((share - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1))
        return np.concatenate(out)


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Filters:
    """Filters of every language of the rows that are not held out and have text and language. At most max_docs ids a language are fitted on; whole texts, and every n-gram of them."""
    source = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    ).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0))
    # A language may hold most documents: the sizes of its hash ranges tell which ranges hold its first ids, and only there ids are ranked, range by range.
    source = source.withColumn("range", F.shiftright(F.xxhash64("doc_id"), 64 - RANGES))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    first = source.groupBy("lang", "range").agg(F.count("*").alias("n")).select("lang", "range", F.coalesce(before, F.lit(0)).alias("before")).where(F.col("before") < max_docs)
    nth = F.row_number().over(Window.partitionBy("lang", "range").orderBy(F.xxhash64("doc_id"), "doc_id"))
    first = written(first)  # max_docs ranges a language at most
    first = F.broadcast(first) if first.count() <= BROADCAST_IDS else first.hint("merge")
    near = source.select("doc_id", "lang", "range").join(first, ["lang", "range"])
    chosen = near.withColumn("nth", nth).where(F.col("nth") + F.col("before") <= max_docs).select("doc_id", "lang").distinct()
    chosen = written(chosen)
    side = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen.hint("merge")
    train = source.join(side, ["doc_id", "lang"], "left_semi").select("lang", "text")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            texts = as_bytes(b.column("text"))
            for name in sorted(set(langs.tolist())):
                own = [texts[i] for i in np.flatnonzero(langs == name)]
                code = np.unique(np.concatenate([np.empty(0, np.uint32), *(np.unique(gram_codes(own[lo:hi])[0]) for lo, hi in slices(own))]))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code.astype(np.int64))], ["lang", "code"])

    seen = written(train.mapInArrow(distinct, "lang string, code long").distinct())
    names = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    most = seen.groupBy("lang").count().agg(F.max("count")).first()[0]
    bits = bits_for(len(names), most or 0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in slots(b.column("code").to_numpy(), bits):
                yield pa.RecordBatch.from_arrays(
                    [b.column("lang"), pa.array((at // U64(PAGE)).astype(np.int64)), pa.array((at % U64(PAGE)).astype(np.int64))],
                    ["lang", "page", "bit"]
                )

    # Each partition sets its bits in pages, and pages are united: what the driver gets is the table, however many n-grams there are.
    pages = seen.mapInArrow(place, "lang string, page long, bit long").groupBy("lang", "page").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    return Filters(names, bits, ((r["lang"], r["page"], bytes(r["bitmap"])) for r in pages.toLocalIterator()))


def predict(docs: DataFrame, filters: Filters, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, lang_pred, score (the best language's part of all languages' shares).

    `und` with score 0 where the text is null or has no letter. A text with letters but no known n-gram, or a tie,
    takes the first of the best languages by name, with equal parts. Without any language all is `und`.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # 8 MB for each 64 languages, and up to 128 MB with many n-grams
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Filters = sent.value
        for b in batches:
            texts = as_bytes(b.column("text"))
            names, scores = [], []
            shares = f.shares(texts)
            for t, share in zip(texts, shares, strict=True):
                if not f.languages or not LETTER.search(t.decode()):
                    names.append("und"), scores.append(0.0)
                    continue
                k = int(share.argmax())
                total = float(share.sum())
                names.append(f.languages[k]), scores.append(float(share[k]) / total if total > 0 else 1 / len(f.languages))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs)).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
SQL: dict[str, str] = {}
