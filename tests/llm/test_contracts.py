"""Ties, thresholds and indexes that operators must not answer wrongly without a word."""

import collections
import random
import re

import numpy as np
import pytest

from costlens.llm import ann, common, decontaminate, near_duplicates, suffix_dedup


def test_equal_vectors_have_equal_scores_wherever_they_stand(spark):
    rng = np.random.default_rng(4)
    kinds = rng.normal(size=(40, 64))
    rows = [(k, [float(v) for v in kinds[k % 40]]) for k in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (16_384, 37):  # one block, and 17 blocks with two portions of queries
        got = collections.defaultdict(list)
        for r in ann.search(df, df.where("vec_id % 20 = 0"), 20, rerank=1.0, block=block).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["score"], r["vec_id"]))
        for q, found in got.items():
            by_kind = collections.defaultdict(set)
            for s, v in found:
                by_kind[v % 40].add(s)
            assert all(len(s) == 1 for s in by_kind.values())
            score = {k: float((kinds[k] * kinds[q % 40]).sum()) for k in range(40)}
            assert [v for _, v in found] == sorted((k for k in range(600) if k != q), key=lambda k: (-score[k % 40], k))[:20]


def test_equal_vectors_in_any_place_of_a_block():
    rng = np.random.default_rng(9)
    for _ in range(200):
        d = int(rng.integers(3, 130))
        x = rng.normal(size=(int(rng.integers(2, 60)), d))
        a, b = rng.choice(len(x), 2, replace=False)
        x[a] = x[b]
        pivots = x / np.linalg.norm(x, axis=1, keepdims=True)
        block = ann.Block(np.arange(len(x)), x, pivots, min(8, len(x)))
        ((_, ids, scores),) = block.search(np.array([-1]), rng.normal(size=(1, d)), len(x), 1.0)
        own = dict(zip(ids.tolist(), scores.tolist(), strict=True))
        assert own[int(a)] == own[int(b)] and abs(ids.tolist().index(a) - ids.tolist().index(b)) == 1 and ids.tolist().index(min(a, b)) < ids.tolist().index(max(a, b))


def test_thresholds_whose_recall_is_out_of_reach_raise(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    with pytest.raises(ValueError, match="from a threshold of 0.739"):
        near_duplicates.near_duplicates(df, threshold=0.7)
    reached = 1 - np.prod([1 - 0.74**near_duplicates.MIN_DEPTH] * near_duplicates.TREES)
    assert near_duplicates.near_duplicates(df, threshold=0.75).count() == 1 and reached >= 0.998 - 1e-4


def test_an_index_answers_for_all_of_its_documents_only(spark):
    df = spark.createDataFrame([(k, "some words of document " * 3 + str(k)) for k in range(6)], "doc_id long, text string")
    index = suffix_dedup.SuffixIndex.create(spark, common.shared_dir(spark), 1000, 20, 8)
    index.add(df)
    assert index.spans(df).count() == 6
    with pytest.raises(ValueError, match="all of the index's documents"):
        index.spans(df.where("doc_id < 3"))


@pytest.mark.parametrize("most", [500_000, 3])
def test_an_item_of_one_common_word_among_others(spark, most):
    """Every place of a common word is a hit; windows are verified once each, however often they stand."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "of", "w1", "w2", "w3"]) for _ in range(rng.randrange(0, 90))) for _ in range(30)] + [None, "", "The THE,the", "x " * 50]
    items = [("a", "the"), ("b", "of w1"), ("c", "w1 w2 w3 the of the w1 w2 of of w3 the"), ("d", " ".join(texts[0].split()[:15])), ("e", None), ("f", "w2 the"), ("g", "the")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.scan_documents(docs, bench, max_windows=most).collect()}
    words = lambda t: re.findall("[0-9a-z]+", (t or "").lower())
    for k, t in enumerate(texts):
        w, hit, own = words(t), set(), set()
        for item, text in items:
            x = words(text)
            n = min(10, len(x))
            for i in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[i : i + n]:
                        hit |= set(range(p, p + n))
                        own.add(item)
        assert got[k] == (len(w), len(hit), tuple(sorted(own)))
