"""License scans: an exact set-similarity join of text blocks with license templates.

A template of n words meets the blocks of 2 n words that begin at every n-th word of a text, so any n words in a row lie
in one of them. A block matches when it holds the template's threshold of its distinct tokens. Tokens are ordered by
the number of documents of the whole table that hold them, rarest first: a match must hold one of the template's first
|T| - need + 1 tokens (prefix), need tokens that any template knows (length), and from the place of its first common
token on both must have enough tokens left (position). What passes is counted exactly. Phrases are templates of which
all tokens are needed; their blocks are then searched for the words in a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.llm.common import ASCII_LOWER, U64, as_bytes, joined, prefix_sums, slices, spans_hash, tokens
from costlens.llm.decontaminate import WORD, words_of

#: Share of a template's distinct tokens that a block must hold.
THRESHOLD = 0.8
#: Words of all templates that are broadcast at once: some 100 bytes each.
MAX_WORDS = 500_000
# Names of licenses as they stand in texts, with their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
# Notices that licenses ask for, and one-line statements, with their labels.
TEMPLATES = [
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "gpl-3.0"
    ),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache-2.0"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "mit"
    ),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "isc"
    ),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-4.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
]


def needed(n_tokens: int, threshold: float) -> int:
    """Distinct tokens of n_tokens that meet the threshold, one at least."""
    return max(1, math.ceil(n_tokens * threshold - 1e-9))


class TemplateSet:
    """Templates (words, label, need, is a phrase) with their tokens numbered by frequency, the rarest 0."""

    def __init__(self, templates: list[tuple[list[bytes], str, float, bool]], documents: dict[int, int]):
        self.templates = [(w, label, needed(len(set(w)), share), phrase) for w, label, share, phrase in templates if w]
        known = sorted({w for ws, *_ in self.templates for w in ws})
        h = hash_words(known)
        order = sorted(range(len(known)), key=lambda k: (documents.get(int(h[k]), 0), known[k]))
        rank = {known[k]: r for r, k in enumerate(order)}
        self.tokens = [known[k] for k in order]
        at = np.argsort(h)
        self.hashes, self.ranks = h[at], np.array([rank[known[k]] for k in at], np.int64)
        self.rows = [np.array([rank[w] for w in ws], np.int64) for ws, *_ in self.templates]
        self.sets = [np.unique(r) for r in self.rows]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each hashed word, -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ranks[at], -1)


def hash_words(words: list[bytes]) -> np.ndarray:
    buf, off = joined(words)
    start, end, _ = tokens(buf, off, WORD)
    return spans_hash(prefix_sums(buf), start, end).view(np.int64)


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Word hashes, starts and ends, the first word of each text, and the lower-cased buffer."""
    buf, off = joined(texts)
    buf = ASCII_LOWER[buf]
    start, end, first = tokens(buf, off, WORD)
    return spans_hash(prefix_sums(buf), start, end).view(np.int64), start, end, first, buf.tobytes()


def token_documents(docs: DataFrame, words: list[bytes], text: str = "text") -> dict[int, int]:
    """For each hash of words the documents of the whole table that hold it: one scan, a row a word and task."""
    sent = docs.sparkSession.sparkContext.broadcast(np.unique(hash_words(words)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        total = np.zeros(len(known), np.int64)
        for b in batches:
            texts = as_bytes(b.column(0))
            for lo, hi in slices(texts):
                h, _, _, first, _ = _hashed(texts[lo:hi])
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[at] == h)
                doc = np.searchsorted(first, hit, "right") - 1
                total += np.bincount(np.unique(doc * len(known) + at[hit]) % len(known), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(total)], ["token", "n"])

    rows = docs.select(text).mapInArrow(scan, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


def _matches(number: np.ndarray, first: np.ndarray, own: np.ndarray, n: int, need: int, phrase: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, block numbers and common tokens of the blocks that meet a template. number: each word's token number; own: the template's, sorted."""
    prefix = own[: len(own) - need + 1]
    at = np.flatnonzero((number >= 0) & np.isin(number, prefix))
    doc = np.searchsorted(first, at, "right") - 1
    block = (at - first[doc]) // n
    pair = np.unique(np.concatenate((np.column_stack((doc, block)), np.column_stack((doc, block - 1)))), axis=0)
    pair = pair[pair[:, 1] >= 0]
    doc, block = pair[:, 0], pair[:, 1]
    lo = first[doc] + block * n
    hi = np.minimum(lo + 2 * n, first[doc + 1])
    # Length: enough words that some template knows.
    known = np.flatnonzero(number >= 0)
    a, z = np.searchsorted(known, lo), np.searchsorted(known, hi)
    enough = z - a >= need
    doc, block, a, z = doc[enough], block[enough], a[enough], z[enough]
    size = z - a
    at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    base = int(number.max(initial=0)) + 1
    key = np.unique(np.repeat(np.arange(len(doc)), size) * base + number[known[at]])  # distinct tokens of each block, rarest first
    which, token = key // base, key % base
    left = np.searchsorted(which, which, "right") - np.arange(len(key))  # tokens of the block from this one on
    at = np.minimum(np.searchsorted(own, token), len(own) - 1)
    common = own[at] == token
    # Position: what is left on both sides from the first common token on.
    where = np.flatnonzero(common)
    head = where[np.unique(which[where], return_index=True)[1]]
    fits = np.zeros(len(doc), bool)
    fits[which[head]] = np.minimum(left[head], len(own) - at[head]) >= need
    overlap = np.bincount(which[common & fits[which]], minlength=len(doc))
    good = overlap >= need
    return doc[good], block[good], overlap[good]


def _places(number: np.ndarray, first: np.ndarray, row: np.ndarray, doc: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Words at which row stands as it is, within the given blocks."""
    n = len(row)
    lo = first[doc] + block * n
    at = np.unique(lo[:, None] + np.arange(n + 1))  # a block of 2 n words: any start whose n words lie in it
    at = at[at + n <= len(number)]
    for k in range(n):
        at = at[number[at + k] == row[k]]
    return at[np.searchsorted(first, at, "right") == np.searchsorted(first, at + n - 1, "right")]


def scan_licenses(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row a document: doc_id, n_words, places (phrase label, word), blocks (template number, label, first word, share of its tokens).

    Words are runs of digits, letters (A-Z lower-cased) and non-ASCII characters. Null, empty and wordless texts have no
    words and match nothing, and so do templates and phrases without words; overlapping and repeated places all count;
    repeated rows give a row each; long texts are scanned whole, a last block may be short; an empty table gives no rows.
    Templates and phrases are broadcast: beyond MAX_WORDS words together they raise ValueError.
    """
    pieces = [(words_of(p.encode()), label, 1.0, True) for p, label in phrases] + [(words_of(t.encode()), label, threshold, False) for t, label in templates]
    words = sorted({w for ws, *_ in pieces for w in ws})
    if sum(len(ws) for ws, *_ in pieces) > MAX_WORDS:
        raise ValueError(f"templates and phrases have more than {MAX_WORDS} words together: scan for parts of them")
    known = TemplateSet(pieces, token_documents(docs, words, text) if words else {})
    sent = docs.sparkSession.sparkContext.broadcast(known)
    kind = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]
    place, block = pa.struct([("label", pa.string()), ("word", pa.int64())]), pa.struct([("template", pa.int32()), ("label", pa.string()), ("word", pa.int64()), ("share", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            texts = as_bytes(b.column("text"))
            for lo, hi in slices(texts):
                n_words, places, blocks = _scan_slice(texts[lo:hi], own)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(n_words), pa.array(places, pa.list_(place)), pa.array(blocks, pa.list_(block))],
                    ["doc_id", "n_words", "places", "blocks"]
                )

    schema = f"doc_id {kind}, n_words long, places array<struct<label:string,word:long>>, blocks array<struct<template:int,label:string,word:long,share:double>>"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, schema)


def _scan_slice(texts: list[bytes], own: TemplateSet) -> tuple[np.ndarray, list[list[dict]], list[list[dict]]]:
    h, start, end, first, raw = _hashed(texts)
    places, blocks = [[] for _ in texts], [[] for _ in texts]
    if not own.templates or not len(h):
        return np.diff(first), places, blocks
    number = own.numbers(h)
    nth = 0
    for (words, label, need, phrase), row, distinct in zip(own.templates, own.rows, own.sets, strict=True):
        doc, block, overlap = _matches(number, first, distinct, len(words), need, phrase)
        if phrase:
            for at in _places(number, first, row, doc, block).tolist():
                if [raw[start[at + k] : end[at + k]] for k in range(len(words))] == words:  # the bytes, not only their hashes
                    d = int(np.searchsorted(first, at, "right")) - 1
                    places[d].append({"label": label, "word": at - int(first[d])})
            continue
        for d, k, n in zip(doc.tolist(), block.tolist(), overlap.tolist(), strict=True):
            blocks[d].append({"template": nth, "label": label, "word": k * len(words), "share": n / len(distinct)})
        nth += 1
    return np.diff(first), places, blocks


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License names and notices of every document; score is 1 where a name stands, else the largest share of a template."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.array_sort(F.array_distinct("places.label"))
    labels = F.array_sort(F.array_distinct(F.concat("places.label", "blocks.label")))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("blocks.share"), F.lit(0.0))).alias("score"),
    )


QUERIES = {"op11_license_scan": op11_license_scan}


def _sql() -> str:
    """The scan as SQL: all places of the phrases, all blocks of the templates."""
    row = lambda s: "[" + ", ".join(f"'{w.decode()}'" for w in words_of(s.encode())) + "]"
    phrases = ", ".join(f"({row(p)}, '{label}')" for p, label in PHRASES)
    templates = ", ".join(f"({row(t)}, {len(words_of(t.encode()))}, {needed(len(set(words_of(t.encode()))), THRESHOLD)}, '{label}')" for t, label in TEMPLATES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
ph AS (SELECT * FROM (VALUES {phrases}) AS x(p, label)),
te AS (SELECT * FROM (VALUES {templates}) AS x(t, n, need, label)),
dp AS (SELECT rid, p, label, w, unnest(range(1, len(w) - len(p) + 2)) AS i FROM d, ph WHERE len(w) >= len(p)),
pl AS (SELECT rid, label, i - 1 AS word FROM dp WHERE w[i:i + len(p) - 1] = p),
bp AS (SELECT rid, t, n, need, label, w, unnest(range(0, len(w), n)) AS i FROM d, te),
bl AS (SELECT rid, label, len(list_intersect(t, w[i + 1:i + 2 * n])) AS k, need, len(list_distinct(t)) AS size FROM bp),
hit AS (SELECT rid, label, k::DOUBLE / size::DOUBLE AS share FROM bl WHERE k >= need),
pa AS (SELECT rid, count(*) AS n_base, min(word) AS a, max(word) AS z, list(DISTINCT label) AS labels FROM pl GROUP BY rid),
ba AS (SELECT rid, max(share) AS share, list(DISTINCT label) AS labels FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, a AS first_word, z AS last_word,
    array_to_string(list_sort(coalesce(pa.labels, []::VARCHAR[])), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(pa.labels, []::VARCHAR[]), coalesce(ba.labels, []::VARCHAR[])))), ',') AS labels,
    CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN pa USING (rid) LEFT JOIN ba USING (rid)
"""


SQL = {"op11_license_scan": _sql()}
