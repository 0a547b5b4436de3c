"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts in Arrow batches. The trees are fitted on the driver from a bounded sample of labelled
rows (MAX_TRAIN, the only bound), flattened into arrays and walked by all rows of a batch at once, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.llm.common import ASCII_LOWER, SPACE, as_bytes, held_out, joined, per_document, prefix_sums, slices, spans_hash, tokens

#: Labelled rows to fit on, taken in the order of a hash of their id.
MAX_TRAIN = 20_000
#: Documents below this score are rejected.
THRESHOLD = 0.3

_CLASS = np.zeros((7, 256), bool)  # upper, lower, digit, ASCII punctuation, white, line ends, beyond ASCII
_CLASS[0, 65:91] = True
_CLASS[1, 97:123] = True
_CLASS[2, 48:58] = True
_CLASS[3, 33:48] = _CLASS[3, 58:65] = _CLASS[3, 91:97] = _CLASS[3, 123:127] = True
_CLASS[4] = SPACE
_CLASS[5, 10] = True
_CLASS[6, 128:] = True
FEATURES = [
    "log_bytes", "upper", "lower", "digit", "punctuation", "white", "beyond_ascii", "sentence_marks", "odd_marks", "bars", "log_words", "mean_word", "sd_word", "short_words", "long_words",
    "capital_words", "punctuated_words", "distinct_words", "top_word", "same_as_before", "distinct_pairs", "log_lines", "mean_line", "distinct_lines", "commas", "marks_a_word",
]


def statistics(texts: list[bytes]) -> np.ndarray:
    """FEATURES of each text; a text without words has zero shares."""
    out = [np.zeros((0, len(FEATURES)))]
    for lo, hi in slices(texts, 1 << 20):  # some twenty arrays of eight bytes a byte
        out.append(_slice_statistics(texts[lo:hi]))
    return np.concatenate(out)


def _distinct(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the commonest value, of each document."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(n_docs)
    np.maximum.at(top, doc[at], np.diff(np.append(at, len(h))))
    return np.bincount(doc[at], minlength=n_docs).astype(float), top


def _slice_statistics(texts: list[bytes]) -> np.ndarray:
    buf, off = joined(texts)
    n = len(texts)
    size = np.maximum(np.diff(off) - 1, 0).astype(float)
    share = lambda mask: per_document(mask.astype(np.int64), off) / np.maximum(size, 1)
    upper, lower, digit, punct, white, lines, far = (share(c[buf]) for c in _CLASS)
    white = np.maximum(white - 1 / np.maximum(size, 1), 0)  # the separator
    marks, commas, bars = share((buf == 46) | (buf == 63) | (buf == 33)), share(buf == 44), share(buf == 124)
    start, end, first = tokens(buf, off, ~SPACE)
    words = np.diff(first).astype(float)
    some = np.maximum(words, 1)
    length = (end - start).astype(float)
    doc = np.repeat(np.arange(n), np.diff(first))
    of = lambda v: per_document(np.asarray(v, float), first) / some
    mean = of(length)
    sd = np.sqrt(np.maximum(of(length**2) - mean**2, 0))
    capital, last = _CLASS[0][buf[start]], buf[end - 1]
    end_punct = _CLASS[3][last]
    plain_end = np.isin(last, np.frombuffer(b".,;:?!", np.uint8))
    h = spans_hash(prefix_sums(ASCII_LOWER[buf]), start, end)
    distinct, top = _distinct(h, doc, n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    pairs = h.copy()
    pairs[1:] += h[:-1] * np.uint64(3)
    distinct_pairs, _ = _distinct(pairs, doc, n)
    ls, le, lf = _lines(buf, off)
    n_lines = np.diff(lf).astype(float)
    line_h = spans_hash(prefix_sums(buf), ls, le)
    distinct_lines, _ = _distinct(line_h, np.repeat(np.arange(n), np.diff(lf)), n)
    return np.column_stack([
        np.log1p(size), upper, lower, digit, punct, white, far, marks, punct - marks - commas, bars, np.log1p(words), mean, sd, of(length <= 2), of(length >= 12),
        of(capital), of(end_punct & ~plain_end), distinct / some, top / some, of(same), distinct_pairs / some, np.log1p(n_lines), size / np.maximum(n_lines, 1), distinct_lines / np.maximum(n_lines, 1), commas, (punct * size) / some,
    ])


def _lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty lines: the separator after each document counts as a line end."""
    inside = np.ones(len(buf), bool)
    inside[buf == 10] = False
    inside[off[1:] - 1] = False
    d = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    start, end = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    return start, end, np.searchsorted(start, off)


class Trees:
    """Boosted regression trees for log-odds, as flat arrays: node k of a tree has children left[k] and left[k]+1; a leaf points to itself."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, value: np.ndarray, roots: np.ndarray, start: float, depth: int):
        self.feature, self.cut, self.left, self.value, self.roots, self.start, self.depth = feature, cut, left, value, roots, start, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.start)
        for root in self.roots.tolist():
            node = np.full(len(x), root)
            for _ in range(self.depth):
                left = self.left[node]
                node = np.where(left == node, node, left + (x[rows, self.feature[node]] > self.cut[node]))
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, min_rows: int = 8, ridge: float = 2.0) -> Trees:
    """Histogram boosting: features are binned once at quantiles; each level takes gradient histograms of all its nodes. No rows, or one class only, gives a constant score."""
    p0 = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    start = float(np.log(p0 / (1 - p0)))
    feature, cut, left, value, roots = [], [], [], [], []
    if len(y) >= 2 * min_rows and 0 < y.mean() < 1:
        n, d = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(d)]
        binned = np.column_stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(d)])
        flat = binned + np.arange(d) * bins
        f_score = np.full(n, start)
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-f_score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            base = len(feature)
            roots.append(base)
            feature.append(0), cut.append(0.0), left.append(base), value.append(0.0)
            at = {0: base}
            for _ in range(depth):
                live = sorted(at)
                index = np.full(max(live) + 1, -1)
                index[live] = np.arange(len(live))
                own = np.where(node >= 0, index[np.clip(node, 0, max(live))], -1)
                use = own >= 0
                key = (own[use, None] * (d * bins) + flat[use]).ravel()
                shape = (len(live), d, bins)
                hist = [np.bincount(key, np.repeat(v[use], d), len(live) * d * bins).reshape(shape).cumsum(2) for v in (g, h, np.ones(n))]
                (gl, hl, nl), tot = hist, [v[:, :, -1:] for v in hist]
                gain = gl**2 / (hl + ridge) + (tot[0] - gl) ** 2 / (tot[1] - hl + ridge) - tot[0] ** 2 / (tot[1] + ridge)
                gain[(nl < min_rows) | (tot[2] - nl < min_rows)] = -1
                for f in range(d):
                    gain[:, f, len(cuts[f]) :] = -1
                best = gain.reshape(len(live), -1).argmax(1)
                after, moved = {}, np.full(n, -1)
                for k, name in enumerate(live):
                    f, b = divmod(int(best[k]), bins)
                    mine = own == k
                    if gain[k, f, b] <= 1e-6:
                        self_at = at[name]
                        value[self_at] = -rate * g[mine].sum() / (h[mine].sum() + ridge)
                        f_score[mine] += value[self_at]
                        continue
                    here, child = at[name], len(feature)
                    feature[here], cut[here], left[here] = f, float(cuts[f][b]), child
                    for _ in range(2):
                        left.append(len(feature)), feature.append(0), cut.append(0.0), value.append(0.0)
                    right = binned[:, f] > b
                    moved[mine & ~right], moved[mine & right] = 2 * name, 2 * name + 1
                    after |= {2 * name: child, 2 * name + 1: child + 1}
                node, at = moved, after
                if not at:
                    break
            for name, here in at.items():
                mine = node == name
                value[here] = -rate * g[mine].sum() / (h[mine].sum() + ridge)
                f_score[mine] += value[here]
    return Trees(np.array(feature, np.int64), np.array(cut), np.array(left, np.int64), np.array(value), np.array(roots, np.int64), start, depth)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, doc_id: str = "doc_id", text: str = "text") -> Trees:
    """Fit on at most max_train rows of labels (doc_id, quality) with a known quality and an id not held out."""
    rows = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    train = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(rows), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(as_bytes(b.column("text")))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), flat], ["doc_id", "quality", "x"])

    found = train.mapInArrow(run, f"doc_id {dict(train.dtypes)['doc_id']}, quality int, x array<double>")
    # Repeated ids could give more rows than labels: the bound holds for what is collected too.
    got = found.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_train).collect()
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(FEATURES))
    return fit_trees(x, np.array([r["quality"] == 1 for r in got], float))


def score(docs: DataFrame, trees: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, text_hash, score (0 to 1). Null and empty texts are scored by their (zero) statistics."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)  # at most n_trees * 2**(depth+1) nodes
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.score(statistics(as_bytes(b.column("text"))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(s, pa.float64())], ["doc_id", "text_hash", "score"])

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, text_hash long, score double")


def keep_good(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows and columns of docs with a score of at least threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = sent.value.score(statistics(as_bytes(b.column(b.schema.get_field_index(text))))) >= threshold
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trees = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, trees).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted")
    )


QUERIES = {"op6_quality": op6_quality}
SQL: dict[str, str] = {}
