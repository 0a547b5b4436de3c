"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Each text has a label of MAX_DEPTH MinHash values of its word shingles in each of TREES trees; a tree is the prefix trie of
its labels, and the texts below a prefix are a node. A text asks the nodes of a prefix length of its own in each tree.
All lengths begin at MAX_DEPTH. Where few texts share the first MIN_DEPTH values that prefix is taken at once; other
prefixes are shortened one value at a time, the one first whose node stays smallest, until a partner at the threshold is
met in some tree with the target recall. So dense prefixes stay long where the other trees make up for them. A pair are
candidates if they share the shorter of their two prefixes in some tree, and count in the first such tree. Their sets of
shingles meet in the node, large nodes in pairs of blocks bounded by texts and bytes, and exact Jaccard decides.

A crowd of near-copies is not compared with itself: texts so close to a node's first text that by the triangle inequality
of the set difference any two of them are at the threshold or above form a ball, whose links are counted by its size.

Equal texts are one text throughout. Tasks return a link count for each text and a spanning forest, never pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.llm.common import ASCII_LOWER, SPACE, U64, as_bytes, grams, inside_documents, join_hot, joined, prefix_sums, slices, spans_hash, tokens, written

SHINGLE, THRESHOLD = 5, 0.8
TREES, MIN_DEPTH, MAX_DEPTH, RECALL = 12, 3, 8, 0.998
#: A prefix of MIN_DEPTH values that no more texts share is taken as it is.
SMALL = 64
#: Texts, and bytes of their shingles, that one task compares with each other; a larger node is split into blocks of about half as many, and every two blocks meet.
NODE, NODE_BYTES = 2048, 64 << 20
_RNG = np.random.default_rng(5)
_XOR = _RNG.integers(1, 2**63, TREES * MAX_DEPTH, dtype=np.uint64)
_MUL = _RNG.integers(1, 2**63, TREES * MAX_DEPTH, dtype=np.uint64) * U64(2) + U64(1)


def depths_for(sizes: list[list[int] | None], threshold: float, recall: float) -> list[int]:
    """A text's prefix length in each tree. sizes: of its nodes at MIN_DEPTH, MIN_DEPTH + 1, ..., MAX_DEPTH values, or None where the first is small."""
    depth = [MIN_DEPTH if s is None else MAX_DEPTH for s in sizes]
    while True:
        missed = np.prod([1 - threshold**d for d in depth])
        longer = [t for t, d in enumerate(depth) if d > MIN_DEPTH]
        if missed <= 1 - recall or not longer:
            return depth
        depth[min(longer, key=lambda t: (sizes[t][depth[t] - 1 - MIN_DEPTH], -depth[t], t))] -= 1


def shingles(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text (a text of fewer words, but not none, has one of all its words), and each text's first (one more entry). Words are runs of non-blank bytes with A-Z lower-cased."""
    out, counts = [np.empty(0, U64)], [np.zeros(1, np.int64)]
    for lo, hi in slices(texts, 1 << 20):
        buf, off = joined(texts[lo:hi])
        buf = ASCII_LOWER[buf]
        start, end, first = tokens(buf, off, ~SPACE)
        h = spans_hash(prefix_sums(buf), start, end)
        words = np.diff(first)
        g = grams(h, n)
        at = np.flatnonzero(inside_documents(first, n)) if len(g) else np.empty(0, np.int64)
        g = g[at]
        short = np.flatnonzero((words > 0) & (words < n))
        if len(short):
            own = np.array([int(grams(h[first[d] : first[d + 1]], int(words[d]))[0]) for d in short], U64)
            place = np.searchsorted(at, first[short])
            g = np.insert(g, place, own)
        out.append(g)
        counts.append(np.where(words >= n, words - n + 1, (words > 0).astype(np.int64)))
    return np.concatenate(out), np.cumsum(np.concatenate(counts))


def labels(texts: list[bytes], trees: int = TREES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's labels: in each tree the first MIN_DEPTH values as one hash, and a byte of each further value, the first one highest; and its number of shingles. Without shingles labels are meaningless."""
    g, first = shingles(texts)
    size = np.diff(first)
    have = np.flatnonzero(size > 0)
    heads, tails = np.zeros((len(texts), trees), U64), np.zeros((len(texts), trees), np.int64)
    for lo in range(0, len(have), 512):  # so that the temporary arrays stay small
        docs = have[lo : lo + 512]
        part = g[first[docs[0]] : first[docs[-1] + 1]]
        starts = first[docs] - first[docs[0]]
        for t in range(trees):
            acc, tail = np.full(len(docs), U64(t + 1)), np.zeros(len(docs), np.int64)
            for k in range(MAX_DEPTH):
                low = np.minimum.reduceat((part ^ _XOR[t * MAX_DEPTH + k]) * _MUL[t * MAX_DEPTH + k], starts)
                if k < MIN_DEPTH:
                    acc = acc * U64(0x9E3779B97F4A7C15) ^ low
                else:
                    tail = tail << 8 | ((low * U64(0xD6E8FEB86659FD93)) >> U64(56)).astype(np.int64)
            heads[docs, t], tails[docs, t] = acc, tail
    return heads, tails, size


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))


def _signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_hash, tid (16 bytes of the text's digest), n_shingles, heads, tails (null without words)."""
    source = _source(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column("text"))
            tid = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
            heads, tails, sizes = [], [], []
            for lo, hi in slices(texts):
                h, t, n = labels(texts[lo:hi])
                heads += [x if k else None for x, k in zip(h.astype(np.int64).tolist(), n.tolist(), strict=True)]
                tails += [x if k else None for x, k in zip(t.tolist(), n.tolist(), strict=True)]
                sizes += n.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("text_hash"), pa.array(tid, pa.binary()), pa.array(sizes, pa.int64()),
                    pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))
                ],
                ["doc_id", "text_hash", "tid", "n_shingles", "heads", "tails"]
            )

    return source.mapInArrow(run, f"doc_id {source.dtypes[0][1]}, text_hash long, tid binary, n_shingles long, heads array<long>, tails array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """tid and shingle set (sorted 64-bit integers) of the wanted texts: (doc_id, text_hash) of one document of each."""
    source = _source(docs, doc_id, text)
    # What is wanted grows with the table, so it is never broadcast.
    pick = wanted.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h")).hint("merge")
    source = source.join(pick, source.doc_id.eqNullSafe(F.col("__id")) & (source.text_hash == F.col("__h")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column("text"))
            for lo, hi in slices(texts):
                g, first = shingles(texts[lo:hi])
                sets = [np.unique(g[a:z]).astype("<u8").tobytes() for a, z in zip(first[:-1], first[1:], strict=True)]
                tid = [hashlib.blake2b(t, digest_size=16).digest() for t in texts[lo:hi]]
                yield pa.RecordBatch.from_arrays([pa.array(tid, pa.binary()), pa.array(sets, pa.binary())], ["tid", "shingles"])

    return source.mapInArrow(run, "tid binary, shingles binary").groupBy("tid").agg(F.any_value("shingles").alias("shingles"))


def _depths(posts: DataFrame, texts: DataFrame, threshold: float, recall: float) -> DataFrame:
    """tid, depths of the texts that have a dense prefix; all others' are MIN_DEPTH. posts: (tid, tree, head, tail, n), n texts having the head."""
    dense = posts.where(F.col("n") > SMALL)
    levels = F.explode(F.sequence(F.lit(MIN_DEPTH + 1), F.lit(MAX_DEPTH)))
    deeper = dense.select("tid", "tree", "head", "tail", "n", levels.alias("depth")).withColumn("prefix", _prefix("tail", "depth"))
    counts = written(deeper.groupBy("tree", "head", "depth", "prefix").agg(F.count("*").alias("m")))
    sizes = join_hot(deeper.select("tid", "tree", "head", "depth", "prefix", "n"), counts.withColumn("weight", F.col("m")), ["tree", "head", "depth", "prefix"], "weight", ["tid"])
    by_tree = sizes.groupBy("tid", "tree").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("depth", "m"))).alias("deeper"))
    by_text = by_tree.groupBy("tid").agg(F.collect_list(F.struct("tree", F.concat(F.array("n"), F.col("deeper.m")).alias("sizes"))).alias("dense"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for own in b.column("dense").to_pylist():
                sizes = [None] * TREES
                for t in own:
                    sizes[t["tree"]] = t["sizes"]
                out.append(depths_for(sizes, threshold, recall))
            yield pa.RecordBatch.from_arrays([b.column("tid"), pa.array(out, pa.list_(pa.int32()))], ["tid", "depths"])

    return by_text.mapInArrow(run, "tid binary, depths array<int>")


def _prefix(tail: str, depth: str):
    """The part of a label's tail that belongs to its first depth values."""
    return F.expr(f"shiftright({tail}, 8 * ({MAX_DEPTH} - {depth}))")


def _balls(members: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """tid, ball (tid of a text): texts of large nodes that are so near the first text of one that any two of a ball are linked."""
    large = nodes.where(F.col("n") > NODE).select("node", "low", F.ceil(F.col("n") / NODE).cast("int").alias("copies"))
    own = join_hot(members.select("tid", "node", "n"), large.withColumn("w", F.col("copies").cast("long")), ["node"], "w", ["tid"]).where(F.col("copies").isNotNull())
    # A text tries the large node whose first text is smallest; that text's set goes to as many places as the node is large.
    own = own.groupBy("tid").agg(F.min(F.struct("low", "node", "copies")).alias("at")).select("tid", "at.*")
    left = own.join(sets, "tid").withColumn("place", F.pmod(F.xxhash64("tid"), F.col("copies")).cast("int"))
    right = large.join(sets.select(F.col("tid").alias("low"), F.col("shingles").alias("center")), "low").select(
        "node", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("place"), "center"
    )
    pairs = left.join(right.hint("merge"), ["node", "place"]).select("tid", F.col("low").alias("ball"), "shingles", "center")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column("shingles"), b.column("center"), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                apart = len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True))
                # With both at most this far from the center, |x|+|y|-2|x&y| <= (|x|+|y|)(1-t)/(1+t), so |x&y| >= t |x|y|.
                near.append(apart * (1 + threshold) <= len(x) * (1 - threshold) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("tid"), b.column("ball")], ["tid", "ball"]).filter(pa.array(near, pa.bool_()))

    return pairs.mapInArrow(run, "tid binary, ball binary")


def _shared(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Numbers of common shingles between the first left sets and all sets."""
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(at, minlength=len(values)) > 1
    keep = often[at]
    col, row = (np.cumsum(often) - 1)[at[keep]], row[keep]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    out = np.zeros((left, len(sets)), np.float32)
    step = 4096
    for lo in range(0, int(often.sum()), step):
        a, z = np.searchsorted(col, (lo, lo + step))
        m = np.zeros((len(sets), step), np.float32)
        m[row[a:z], col[a:z] - lo] = 1
        out += m[:left] @ m.T
    return out


class _Rows:
    """The texts of one group: a node, or two blocks of one."""

    def __init__(self, rows: list[tuple]):
        self.tree, self.depth, self.pair = rows[0][1], rows[0][2], (rows[0][3], rows[0][4])
        rows.sort(key=lambda r: (r[5] != self.pair[0], r[6]))
        self.left = sum(r[5] == self.pair[0] for r in rows)
        self.tids = [r[6] for r in rows]
        self.heads, self.tails = np.array([r[7] for r in rows], np.int64), np.array([r[8] for r in rows], np.int64)
        self.depths = np.array([r[9] or [MIN_DEPTH] * TREES for r in rows], np.int64)
        self.ball = [r[10] for r in rows]
        number = {b: k for k, b in enumerate({b for b in self.ball if b is not None})}
        self.in_ball = np.array([-1 - k if b is None else number[b] for k, b in enumerate(self.ball)])
        self.sets = [np.frombuffer(r[11], "<u8") for r in rows]

    def new(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether this node is the first where a pair meets: at the shorter of its two prefixes, in no earlier tree, and not in a ball."""
        short = np.minimum(self.depths[i], self.depths[j])
        meets = (self.heads[i] == self.heads[j]) & ((self.tails[i] ^ self.tails[j]) >> (8 * (MAX_DEPTH - short)) == 0)
        return (short[:, self.tree] == self.depth) & ~meets[:, : self.tree].any(1) & (self.in_ball[i] != self.in_ball[j])

    def links(self, threshold: float) -> list[tuple[bytes, int, bytes, bytes]]:
        """Each linked text, its number of new links, its vertex (its ball, or itself), and a vertex that it hangs together with here."""
        size = np.array([len(s) for s in self.sets], np.float32)
        common = _shared(self.sets, self.left)
        near = common >= np.float32(threshold) * (size[: self.left, None] + size - common) - np.float32(1e-3)
        # float32 is exact for the counts; the product is checked in double precision below.
        i, j = np.nonzero(near)
        fine = (i < j) if self.pair[0] == self.pair[1] else (j >= self.left)
        i, j = i[fine], j[fine]
        c = common[i, j].astype(np.float64)
        fine = c >= threshold * (size[i].astype(np.float64) + size[j] - c) - 1e-9
        i, j = i[fine], j[fine]
        fine = self.new(i, j) if len(i) else np.empty(0, bool)
        i, j = i[fine], j[fine]
        if not len(i):
            return []
        n = len(self.tids)
        links = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        root = np.arange(n)
        while True:  # smallest label reaches all in as many rounds as a component is wide
            before = root.copy()
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            root = root[root]
            if (root == before).all():
                break
        touched = np.unique(np.concatenate([i, j]))
        # A component is a tree in which no vertex has more than 64 children.
        by_root = touched[np.argsort(root[touched], kind="stable")]
        new = np.ones(len(by_root), bool)
        new[1:] = root[by_root[1:]] != root[by_root[:-1]]
        start = np.flatnonzero(new)[np.cumsum(new) - 1]
        nth = np.arange(len(by_root)) - start
        parent = by_root[start + np.maximum(nth - 1, 0) // 64]
        vertex = lambda k: self.ball[k] or self.tids[k]
        return [(self.tids[k], int(links[k]), vertex(k), vertex(p)) for k, p in zip(by_root.tolist(), parent.tolist(), strict=True)]


def _links(nodes: DataFrame, threshold: float) -> DataFrame:
    """tid, links, a, b (vertices that hang together), from rows (node, tree, depth, p, q, block, tid, heads, tails, depths, ball, shingles) sorted by node, p and q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.binary(), pa.binary()))],
                ["tid", "links", "a", "b"]
            )

        for b in batches:
            out = []
            for r in zip(*[b.column(k).to_pylist() for k in range(12)], strict=True):
                if key is not None and r[:5] != key:
                    out += _Rows(rows).links(threshold)
                    rows = []
                key = r[:5]
                rows.append(r)
            yield packed(out)
        if rows:
            yield packed(_Rows(rows).links(threshold))

    return nodes.mapInArrow(run, "tid binary, links long, a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b): the smallest vertex of its component. Smallest labels spread along edges and jump along labels until none changes; each round is a table in the shared folder. Edges come from trees of few children a vertex; where many vertices wait for one label, adaptive execution splits the join."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct())
    label = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("root")))
    while True:
        near = both.join(label.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("m"))
        step = label.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "m").alias("mid"))
        jump = step.join(label.select(F.col("v").alias("mid"), F.col("root").alias("far")), "mid", "left")
        new = written(jump.select("v", "old", F.least("mid", F.coalesce("far", "mid")).alias("root")))
        if new.where(F.col("root") != F.col("old")).isEmpty():
            return new.select("v", "root")
        label = new.select("v", "root")


def _forest(sig: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """texts (tid, doc_id and text_hash of one document, n_shingles, heads, tails, depths) that have candidates; nodes; and members (tid, node, n) of nodes."""
    # One document stands for each text: the smallest id.
    texts = sig.where(F.col("heads").isNotNull()).groupBy("tid").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("one"), *[F.any_value(c).alias(c) for c in ("n_shingles", "heads", "tails")]
    )
    texts = texts.select("tid", "one.doc_id", "one.text_hash", "n_shingles", "heads", "tails")
    posts = texts.select(
        "tid", "n_shingles", F.posexplode(F.arrays_zip("heads", "tails")).alias("tree", "label")
    ).select("tid", "n_shingles", "tree", "label.heads", "label.tails").toDF("tid", "n_shingles", "tree", "head", "tail")
    shared = written(posts.groupBy("tree", "head").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    posts = written(join_hot(posts, shared.withColumn("weight", F.col("n")), ["tree", "head"], "weight", ["tid"]).where(F.col("n").isNotNull()))
    depths = written(_depths(posts, texts, threshold, recall))
    # A node is asked by the texts whose prefix it is; those below it with longer prefixes are there to be met.
    asked = posts.join(depths, "tid", "left").withColumn("own", F.coalesce(F.get("depths", F.col("tree")), F.lit(MIN_DEPTH))).drop("depths")
    asked = asked.withColumn("depth", F.explode(F.sequence(F.lit(MIN_DEPTH), F.col("own")))).withColumn("asks", F.col("own") == F.col("depth"))
    asked = asked.select("tid", "n_shingles", "tree", "depth", "asks", F.xxhash64("tree", "depth", "head", _prefix("tail", "depth")).alias("node"))
    each = F.xxhash64("tid", "asks").cast("decimal(38,0)")
    nodes = asked.groupBy("node").agg(
        F.first("tree").alias("tree"), F.first("depth").alias("depth"), F.count("*").alias("n"), F.count_if("asks").alias("n_asks"),
        F.sum("n_shingles").alias("shingles"), F.sum(each).alias("s"), F.min("tid").alias("low")
    )
    nodes = nodes.where((F.col("n") > 1) & (F.col("n_asks") > 0))
    # Of nodes with the same members the first tree's is left.
    nodes = nodes.groupBy("n", "n_asks", "s", "low").agg(F.min(F.struct("tree", "depth", "node", "shingles")).alias("at")).select("n", "low", "at.*")
    nodes = written(nodes)
    members = written(join_hot(
        asked.select("tid", "n_shingles", "node"), nodes.select("node", "n", F.col("n").alias("weight")), ["node"], "weight", ["tid"]
    ).where(F.col("n").isNotNull()))
    active = texts.join(members.select("tid").distinct(), "tid", "left_semi").join(depths, "tid", "left")
    return written(active), nodes, members


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, text_hash, class_id, n_links.

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at least threshold. class_id:
    the smallest doc_id among all documents whose texts hang together by links. n_links: how many other texts the text
    is linked with. Copies of a text share both. Null, empty and blank texts have no shingles, hence no links; such
    equal texts are copies of each other. A null doc_id is never a class_id unless all of its class are null. A pair at
    the threshold is missed with a chance of 1 - recall at most, a closer one with less; a threshold at which the
    shortest prefixes cannot reach the recall (below 0.74 for 0.998) raises ValueError. Very long texts are compared
    whole; an empty table gives no rows.
    """
    least = (1 - (1 - recall) ** (1 / TREES)) ** (1 / MIN_DEPTH)
    if threshold < least:
        raise ValueError(f"a recall of {recall} is reached from a threshold of {least:.3f} on: the shortest prefixes of all trees meet fewer pairs at {threshold}")
    sig = written(_signatures(docs, doc_id, text))
    active, nodes, members = _forest(sig, threshold, recall)
    sets = written(_sets(docs, active, doc_id, text))
    balls = written(_balls(members, nodes, sets, threshold))
    in_ball = written(balls.groupBy("ball").agg(F.count("*").alias("n_ball")))
    # In a large node the largest ball's texts meet all others, but not each other.
    many = (F.col("n") > NODE) | (F.col("shingles") * 8 > NODE_BYTES)
    big = nodes.where(many).select("node", "n")
    own = join_hot(members.select("tid", "node", "n_shingles"), big.select("node", F.lit(True).alias("big"), "n"), ["node"], "n", ["tid"]).where("big").join(balls, "tid", "left")
    kinds = own.groupBy("node", "ball").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("shingles"))
    parts = lambda n, shingles: F.greatest(F.ceil(n / (NODE // 2)), F.ceil(shingles * 8 / (NODE_BYTES // 2))).cast("int")
    split = kinds.groupBy("node").agg(
        F.max(F.when(F.col("ball").isNotNull(), F.struct("m", "ball", "shingles"))).alias("top"), F.sum("m").alias("n"),
        F.sum("shingles").alias("shingles")
    )
    zero = F.lit(0).cast("long")
    split = split.select(
        "node", F.col("top.ball").alias("main"),
        parts(F.col("n") - F.coalesce("top.m", zero), F.col("shingles") - F.coalesce("top.shingles", zero)).alias("others"),
        parts(F.coalesce("top.m", zero), F.coalesce("top.shingles", zero)).alias("mains")
    )
    nodes = written(nodes.join(split, "node", "left").select(
        "node", "tree", "depth", "n", "main", F.coalesce("others", F.lit(1)).alias("others"), F.coalesce("mains", F.lit(0)).alias("mains")
    ))
    dealt = join_hot(members.select("tid", "node"), nodes, ["node"], "n", ["tid"]).join(balls, "tid", "left")
    is_main = F.coalesce(F.col("main") == F.col("ball"), F.lit(False))
    place = F.pmod(F.xxhash64("tid", F.lit(9)), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    dealt = dealt.withColumn("block", F.when(is_main, F.col("others") + place).otherwise(place))
    dealt = dealt.withColumn("mate", F.explode(F.expr("if(block < others, sequence(0, others + mains - 1), if(others > 0, sequence(0, others - 1), array()))")))
    dealt = dealt.select("node", "tree", "depth", F.least("block", "mate").alias("p"), F.greatest("block", "mate").alias("q"), "block", "tid", "ball")
    rows = dealt.join(active.select("tid", "heads", "tails", "depths"), "tid").join(sets, "tid")
    rows = rows.select("node", "tree", "depth", "p", "q", "block", "tid", "heads", "tails", "depths", "ball", "shingles")
    found = written(_links(rows.repartition("node", "p", "q").sortWithinPartitions("node", "p", "q"), threshold))
    crowd = join_hot(balls, in_ball.withColumn("links", F.col("n_ball") - 1), ["ball"], "n_ball", ["tid"]).where(F.col("links") > 0)
    links = found.select("tid", "links").unionByName(crowd.select("tid", "links")).groupBy("tid").agg(F.sum("links").alias("n_links"))
    edges = written(found.select("a", "b").where(F.col("a") != F.col("b")))
    roots = components(edges)
    # Classes are settled among texts, so copies of one text count once; a class of very many texts is met by join_hot, as is a text of very many copies.
    copies = written(sig.groupBy("tid").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n_copies")))
    linked = copies.join(links, "tid").join(balls, "tid", "left").select("tid", "least_id", "n_links", F.coalesce("ball", "tid").alias("v"))
    weights = roots.join(in_ball.withColumnRenamed("ball", "v"), "v", "left").select("v", "root", F.coalesce("n_ball", F.lit(1).cast("long")).alias("w"))
    linked = join_hot(linked, written(weights), ["v"], "w", ["tid"])
    linked = written(linked.select("tid", "least_id", F.coalesce("root", "v").alias("root"), "n_links"))
    classes = written(linked.groupBy("root").agg(F.min("least_id").alias("class_id"), F.count("*").alias("n_texts")))
    of_text = join_hot(linked.select("tid", "root", "n_links"), classes, ["root"], "n_texts", ["tid"]).drop("root")
    # Texts of one copy and no link need no partner: their documents are classes of their own.
    known = copies.join(of_text, "tid", "left").where((F.col("n_copies") > 1) | F.col("n_links").isNotNull())
    known = written(known.select(
        "tid", "n_copies", F.when(F.col("n_links").isNull(), F.col("least_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    ))
    out = join_hot(sig.select("doc_id", "text_hash", "tid"), known, ["tid"], "n_copies", ["doc_id", "text_hash"])
    return out.select(
        "doc_id", "text_hash", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows and columns of docs that are the smallest doc_id of their class. Repeated rows of that id are all kept, as is a class of null ids."""
    own = near_duplicates(docs, doc_id=doc_id, text=text, **options)
    lost = own.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"))
    return docs.join(lost, docs[doc_id].eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("__h")), "left_anti")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")


QUERIES = {"op1_ngram_jaccard_join": op1_ngram_jaccard_join}
SQL: dict[str, str] = {}
