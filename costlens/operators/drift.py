"""Drift: several spellings of one header or of one tag value.

Values are distinct per tag before they are compared, so the joins see spellings, not resources. Pairs are found by
equi-joins whose every match is a pair, so none is made to be thrown away:

* a value and a prefix of it, or it with one character deleted: one side has each key once. Keys that many rows ask for
  are met by broadcast.
* values of one token set, or alike but for the character at one place: groups by key. A group whose values have one
  digit skeleton has no pairs and goes before any join, so numbered names cost nothing. Groups of up to MOST values are
  compared; in a larger one each value meets one representative of another skeleton, with the number of all its pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costlens.functions.policy import ENV_ALIASES, Mapping, Policy
from costlens.functions.scalars import digit_skeleton, is_null_token, normalize_header, normalize_value, plain_header, strip_tag_prefix, stripped, token_set
from costlens.sources.shared import written

FINDING = ["type", "tag", "reason", "members", "stage", "position"]
#: Values of a group of which all pairs are made.
MOST = 200
#: A key of more than one in HOT of all rows is met by broadcast, so HOT keys at most.
HOT = 1_000
#: So few rows are one small task anyway.
SMALL = 20_000
TOKENS, PREFIX, TYPO = "same words, different order", "one is a prefix of the other", "differs by one character"


def synonym_table(spark: SparkSession, policy: Policy = Policy()) -> DataFrame:
    """tag, tag_rank, synonym: each tag's key and synonyms, normalised as headers are."""
    rows = [(t.key, i, s) for i, t in enumerate(policy.tags) for s in dict.fromkeys(map(plain_header, [t.key, *t.synonyms]))]
    return spark.createDataFrame(rows, "tag string, tag_rank int, synonym string")


def key_drift_normalized(headers: DataFrame) -> DataFrame:
    """Headers (source, position, header) of one source that differ but have one prefix-stripped normal form."""
    norm = normalize_header(strip_tag_prefix(F.col("header")))
    found = headers.withColumn("norm", norm).where(F.col("norm") != "").groupBy("source", "norm").agg(
        F.array_sort(F.collect_set("header")).alias("members"), F.min("position").alias("position")
    )
    return found.where(F.size("members") > 1).select(
        "source", F.lit("key").alias("type"), F.lit(None).cast("string").alias("tag"), F.lit("same header form").alias("reason"),
        "members", F.lit(0).alias("stage"), F.col("position").cast("long").alias("position")
    )


def key_drift_synonyms(headers: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Headers of one source that all name one mandatory tag."""
    forms = headers.withColumn("synonym", normalize_header(strip_tag_prefix(F.col("header"))))
    found = forms.join(F.broadcast(synonym_table(headers.sparkSession, policy)), "synonym").groupBy("source", "tag", "tag_rank").agg(F.array_sort(F.collect_set("header")).alias("members"))
    return found.where(F.size("members") > 1).select(
        "source", F.lit("key").alias("type"), "tag", F.lit("several columns of one tag").alias("reason"), "members",
        F.lit(1).alias("stage"), F.col("tag_rank").cast("long").alias("position")
    )


def tag_values(resources: DataFrame, mapping: Mapping, policy: Policy = Policy(), by: Sequence[str] = ()) -> DataFrame:
    """tag, norm, raws (trimmed spellings, sorted), raw (the first seen), first_line: distinct real values of the resources (of each group by)."""
    tags = mapping.tracked(policy)
    cells = F.array(*[F.struct(F.lit(k).alias("tag"), F.col(k).alias("raw")) for k in tags])
    long = resources.select(*by, "first_line", F.explode(cells).alias("c")).select(*by, "first_line", "c.tag", "c.raw").where(F.col("raw").isNotNull() & ~is_null_token(F.col("raw"), policy.null_tokens))
    long = long.select(*by, "tag", "first_line", normalize_value(F.col("raw")).alias("norm"), stripped(F.col("raw")).alias("raw"))
    return long.groupBy(*by, "tag", "norm").agg(
        F.array_sort(F.collect_set("raw")).alias("raws"), F.min_by("raw", F.struct("first_line", "raw")).alias("raw"),
        F.min("first_line").alias("first_line")
    )


def value_drift_variants(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Spellings of one normalised value."""
    return values.where(F.size("raws") > 1).select(
        *by, F.lit("value").alias("type"), "tag", F.lit("case or format variants").alias("reason"), F.col("raws").alias("members"),
        F.lit(2).alias("stage"), F.col("first_line").alias("position")
    )


def _alias_group(c: Column) -> Column:
    return reduce(lambda out, g: F.when(c.isin(g[1]), F.lit(g[0])).otherwise(out), enumerate(ENV_ALIASES), F.lit(None).cast("int"))


def value_drift_env_aliases(values: DataFrame, tag: str = "environment", by: Sequence[str] = ()) -> DataFrame:
    """Names of one environment, for that tag only."""
    found = values.where(F.col("tag") == tag).withColumn("group", _alias_group(F.col("norm"))).where(F.col("group").isNotNull()).groupBy(*by, "tag", "group").agg(F.array_sort(F.collect_list("raw")).alias("members"))
    return found.where(F.size("members") > 1).select(
        *by, F.lit("value").alias("type"), "tag", F.lit("environment aliases").alias("reason"), "members", F.lit(3).alias("stage"),
        F.col("group").cast("long").alias("position")
    )


def join_unique(many: DataFrame, one: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join; one has each key once. Keys of more than one in HOT of the rows of many are met by broadcast, so no key puts more than that share into one task."""
    keys = list(keys)
    counts = many.groupBy(*keys).agg(F.count("*").alias("__n"))
    total, most = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.max("__n"), F.lit(0))).first()
    if most * HOT <= total or total < SMALL:
        return many.join(one, keys)
    heavy = counts.where(F.col("__n") * HOT > total).drop("__n")  # fewer than HOT
    hot = one.join(F.broadcast(heavy), keys, "left_semi")
    return many.join(F.broadcast(hot), keys).unionByName(many.join(F.broadcast(heavy), keys, "left_anti").join(one, keys))


def _spellings(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """norm, raw, line and the skeleton of each value."""
    return values.select(*by, "tag", "norm", "raw", F.col("first_line").alias("line"), digit_skeleton(F.col("norm")).alias("skel"))


def _pair(rows: DataFrame, by: Sequence[str], reason: str, rank: int, pairs: Column | None = None) -> DataFrame:
    """Rows with both values in one orientation, the smaller first. pairs: how many pairs the row stands for, null for one."""
    swap = F.col("norm_a") > F.col("norm_b")
    side = lambda x, y: [F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for c in ("norm", "raw", "line")]
    pairs = F.lit(None).cast("long") if pairs is None else pairs
    return rows.where(~F.coalesce(_alias_group(F.col("norm_a")) == _alias_group(F.col("norm_b")), F.lit(False))).select(
        *by, "tag", *side("a", "b"), *side("b", "a"), F.lit(reason).alias("reason"), F.lit(rank).alias("rank"), pairs.alias("pairs")
    )


def _as(rows: DataFrame, s: str) -> DataFrame:
    return rows.withColumnsRenamed({c: f"{c}_{s}" for c in ("norm", "raw", "line", "skel")})


def _with_shorter(values: DataFrame, shorter: Column, least: int, by: Sequence[str], reason: str, rank: int) -> DataFrame:
    """Pairs of a value and one of its shorter forms that is a value of at least so many characters itself. Both must have other skeletons, which is known of the longer one alone."""
    rows = _spellings(values, by)
    long = _as(rows, "b").withColumn("key", F.explode(shorter(F.col("norm_b")))).where(digit_skeleton(F.col("key")) != F.col("skel_b"))
    short = _as(rows.where(F.length("norm") >= least), "a").withColumn("key", F.col("norm_a"))
    return _pair(join_unique(long, short, [*by, "tag", "key"]), by, reason, rank)


def _in_groups(values: DataFrame, keys: Column, by: Sequence[str], reason: str, rank: int, most: int) -> DataFrame:
    """Pairs of the values that share a key and have other skeletons: all of them in groups of up to most values, else one a value."""
    group = [*by, "tag", "key"]
    rows = written(_spellings(values, by).withColumn("key", F.explode(keys(F.col("norm")))))
    first = F.min(F.struct("line", "norm", "raw", "skel"))
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"), F.min("skel").alias("least"), F.max("skel").alias("largest"), first.alias("head"))
    sizes = written(sizes.where(F.col("least") != F.col("largest")))
    few = rows.join(sizes.where(F.col("n") <= most).select(*group), group, "left_semi")
    all_pairs = _as(few, "a").join(_as(few, "b"), group).where((F.col("norm_a") < F.col("norm_b")) & (F.col("skel_a") != F.col("skel_b")))
    found = _pair(all_pairs, by, reason, rank)
    if sizes.where(F.col("n") > most).isEmpty():
        return found
    # Larger groups: each value with the first one of another skeleton; n less its own skeleton's values is the number of its pairs.
    heads = sizes.where(F.col("n") > most).select(*group, "n", "head")
    many = join_unique(rows, heads, group)
    same = many.groupBy(*group, "skel").agg(F.count("*").alias("alike"))
    second = many.where(F.col("skel") != F.col("head.skel")).groupBy(*group).agg(first.alias("second"))
    many = join_unique(join_unique(many, second, group), same, [*group, "skel"])
    other = F.when(F.col("skel") != F.col("head.skel"), F.col("head")).otherwise(F.col("second"))
    star = _as(many.withColumn("other", other), "a").select("*", *[F.col(f"other.{c}").alias(f"{c}_b") for c in ("norm", "raw", "line", "skel")])
    return found.unionByName(_pair(star, by, reason, rank, F.col("n") - F.col("alike")))


PAIR = ["tag", "norm_a", "raw_a", "line_a", "norm_b", "raw_b", "line_b", "reason", "rank", "pairs"]


def value_drift_token_order(values: DataFrame, by: Sequence[str] = (), most: int = MOST) -> DataFrame:
    """Pairs of at least three characters of the same words.

    pairs: null, or how many pairs of norm_a or norm_b, in a group of more than most values, the row stands for.
    """
    key = lambda n: F.when((F.length(n) >= 3) & (F.size(token_set(n)) > 1), F.array(F.array_join(token_set(n), " ")))
    return _in_groups(values, key, by, TOKENS, 0, most).select(*by, *PAIR)


def value_drift_prefix(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of which one, of at least four characters, is a prefix of the other, at most seven longer."""
    prefixes = lambda n: F.when(F.length(n) >= 5, F.transform(F.sequence(F.greatest(F.lit(4), F.length(n) - 7), F.length(n) - 1), lambda k: F.substring(n, F.lit(1), k)))
    return _with_shorter(values, prefixes, 4, by, PREFIX, 1).select(*by, *PAIR)


def value_drift_typo(values: DataFrame, by: Sequence[str] = (), most: int = MOST) -> DataFrame:
    """Pairs of at least five characters at edit distance one: alike but for the character at one place, or for one that is left out. pairs as in value_drift_token_order."""
    rest = lambda n, k, gap: [F.substring(n, F.lit(1), k - 1), F.lit(gap), F.substring(n, k + 1, F.length(n))]
    places = lambda n, form: F.transform(F.sequence(F.lit(1), F.length(n)), form)
    holes = lambda n: F.when(F.length(n) >= 5, places(n, lambda k: F.concat(k.cast("string"), F.lit(":"), *rest(n, k, "\0"))))
    cut = lambda n: F.when(F.length(n) >= 6, F.array_distinct(places(n, lambda k: F.concat(*rest(n, k, "")))))
    same = _in_groups(values, holes, by, TYPO, 2, most)
    return same.unionByName(_with_shorter(values, cut, 5, by, TYPO, 2)).select(*by, *PAIR)


def value_drift_pairs(values: DataFrame, by: Sequence[str] = (), most: int = MOST) -> DataFrame:
    """All pairs, each with its first reason; of groups of more than most values as many rows as values."""
    found = value_drift_token_order(values, by, most).unionByName(value_drift_prefix(values, by)).unionByName(value_drift_typo(values, by, most))
    best = found.groupBy(*by, "tag", "norm_a", "norm_b").agg(F.min(F.struct("rank", "reason", "raw_a", "raw_b", "line_a", "line_b")).alias("b"))
    return best.select(
        *by, F.lit("value").alias("type"), "tag", F.col("b.reason").alias("reason"),
        F.array_sort(F.array("b.raw_a", "b.raw_b")).alias("members"), F.lit(4).alias("stage"),
        F.least("b.line_a", "b.line_b").alias("position")
    )


def earliest_finding(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Of findings with equal keys the first by stage and position."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("stage", "position", "reason"))
    return findings.withColumn("nth", nth).where(F.col("nth") == 1).drop("nth")


def drift_findings(headers: DataFrame, resources: DataFrame, mapping: Mapping, policy: Policy = Policy(), by: Sequence[str] = ()) -> DataFrame:
    """All findings of one export, equal ones once; headers first (stages 0 and 1), then values. With by (source) those of many exports, each for itself.

    The distinct values are written once: each rule reads them.
    """
    values = written(tag_values(resources, mapping, policy, by))
    keys = key_drift_normalized(headers).unionByName(key_drift_synonyms(headers, policy))
    keys = keys if by else keys.drop("source")
    found = reduce(DataFrame.unionByName, [keys, value_drift_variants(values, by), value_drift_env_aliases(values, by=by), value_drift_pairs(values, by)])
    return earliest_finding(found, [*by, "type", "tag", "members"]).select(*by, *FINDING)


def suggestions(findings: DataFrame) -> DataFrame:
    """findings with suggestion: what to do, naming the members."""
    names = F.array_join(F.transform("members", lambda m: F.concat(F.lit("\""), m, F.lit("\""))), ", ")
    what = F.when(F.col("type") == "key", F.concat(F.lit("Use one header for "), F.coalesce("tag", F.lit("this key")), F.lit(" in place of ")))
    what = what.otherwise(F.concat(F.lit("Use one spelling of "), F.col("tag"), F.lit(" in place of ")))
    return findings.withColumn("suggestion", F.concat(what, names, F.lit(" ("), F.col("reason"), F.lit(").")))
