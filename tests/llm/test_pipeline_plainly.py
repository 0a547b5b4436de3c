"""The pipeline's stages after the classifier against plain Python, on the smallest table; and the size of language filters."""

import collections
import hashlib
import os
import re
import sys

import numpy as np
import pytest

import corpus_pipeline
from costlens.llm import langid

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\v\f\r"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def without_repeated_lines(docs):
    key = lambda line: lower(line.strip(BLANKS))
    holders = collections.defaultdict(set)
    for i, t in docs.items():
        for line in t.split("\n"):
            holders[key(line)].add(i)
    gone = lambda line, i: len(key(line)) >= 40 and len(holders[key(line)]) >= 5 and i != max(holders[key(line)])
    return {i: "\n".join(x for x in t.split("\n") if not gone(x, i)) for i, t in docs.items()}


def one_of_each_class(docs):
    sets = {}
    for i, t in docs.items():
        w = re.findall("[^ \t-\r]+", lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if docs[a] == docs[b] or (small and small >= 0.8 * large and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: t for i, t in docs.items() if find(i) == i}


def clean(docs, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = collections.defaultdict(set)
    for t in items:
        w = words(t or "")
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[n].add(tuple(w[k : k + n]))
    hit = lambda w: any(tuple(w[k : k + n]) in own for n, own in windows.items() for k in range(len(w) - n + 1))
    return {i: t for i, t in docs.items() if not hit(words(t))}


def test_pipeline_against_plain_python(spark):
    tokenizers = pytest.importorskip("tokenizers")
    sys.path.append(os.path.dirname(os.path.realpath("/opt/tokenizers")))
    public = pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    left = {r["doc_id"]: r["text"] or "" for r in good.collect()}
    assert 0.5 * docs.count() < len(left) < docs.count()
    steps = [without_repeated_lines, one_of_each_class, lambda d: clean(d, [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])]
    now = good.persist()
    for (name, stage), plainly in zip(corpus_pipeline.STAGES[1:4], steps, strict=True):
        now, left = stage(spark, now, SF).persist(), plainly(left)
        assert {r["doc_id"]: r["text"] or "" for r in now.collect()} == left, name
    bpe = tokenizers.Tokenizer.from_file(str(public.path("word_bpe_49k.json")))
    bpe.no_truncation()
    bpe.no_padding()
    want = {}
    for i, t in left.items():
        ids = bpe.encode(t, add_special_tokens=False).ids
        back = bpe.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_filters_of_many_languages_stay_small():
    for n in (1, 4, 64, 65, 2_000, 10_000, 32_000):
        for grams in (0, 5_000, 10**6, 10**9):
            words = -(-n // 64)
            bits = langid.bits_for(n, grams)
            assert (words << bits) * 8 <= 128 << 20 and 1 << bits >= langid.PAGE
    assert langid.bits_for(4, 5_000) == langid.BITS and langid.bits_for(4, 10**6) == 24
    with pytest.raises(ValueError, match="languages"):
        langid.bits_for(100_000, 10)


def test_a_thousand_languages(spark):
    rows = [(k, f"word{k % 1000} common é{k % 1000}x" * 3, f"l{k % 1000:03d}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = langid.fit(docs)
    assert 950 < len(found.languages) <= 1000 and found.table.nbytes <= 128 << 20
    shares = found.shares([b"word7 common \xc3\xa97x"])[0]
    assert found.languages[int(np.argmax(shares))] == "l007"
