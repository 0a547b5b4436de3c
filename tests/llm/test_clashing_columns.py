"""Columns of the documents that have the operators' own names do not change what they return."""

import pytest
from pyspark.sql import functions as F

from costlens.llm import langid, line_dedup, lm, quality, suffix_dedup
from costlens.llm.common import held_out

NAMES = ["spans", "part", "held_out", "score", "n_lines", "n_dropped", "x", "rank", "places", "node", "row", "key", "pos", "n", "range", "code", "page"]


@pytest.fixture(scope="module")
def both(spark):
    line = "one line of forty code points and more that stands everywhere"
    rows = [(k, f"words of document {k} " * (3 + k % 4) + f"\n{line if k % 2 else line.upper()}\nlast {k % 3}", "de" if k % 2 else "en") for k in range(24)]
    rows += [(24, None, "de"), (25, "", None), (7, rows[7][1], "de")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    return plain, plain.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])


def same(both, f):
    one, two = ([str(tuple(r)) for r in f(df).collect()] for df in both)
    assert sorted(one) == sorted(two) and one


def test_suffix_dedup(both):
    same(both, lambda df: suffix_dedup.repeated_spans(df, width=20, core=8).select("doc_id", "n_bytes", "spans", "kept_sha256"))


def test_lm_score_with_repeated_ids_in_several_batches(both):
    def scores(df):
        found = lm.score(df.repartition(5), held_out("doc_id", 5, 1))
        return found.select(*[F.round(c, 9) if k == "double" else F.col(c) for c, k in found.dtypes])

    same(both, scores)


def test_line_dedup(both):
    same(both, lambda df: line_dedup.dedup_lines(df).select("doc_id", "text", "n_lines", "n_dropped"))
    kept = line_dedup.dedup_lines(both[1])
    assert {r["spans"] for r in kept.select("spans").collect()} == {"own spans"}


def test_quality(spark, both):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(24)], "doc_id long, quality int, toxic int")
    same(both, lambda df: quality.score(df, quality.fit(df, labels)))
    good = quality.keep_good(both[1], quality.fit(both[1], labels))
    assert good.columns == both[1].columns


def test_language(both):
    same(both, lambda df: langid.predict(df, langid.fit(df)))


def test_language_of_a_text_of_megabytes(spark, both):
    long = spark.createDataFrame([(1, "words of document " * 200_000), (2, "words of document")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 2)) for r in langid.predict(long, langid.fit(both[0])).collect()}
    assert got[1][0] == got[2][0]
