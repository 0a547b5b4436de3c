"""Scores and breakdowns over the resource table (operators.resources.resource_table)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.functions.policy import DIVERGENCE_POINTS, NO_SERVICE, Mapping, Policy
from costlens.functions.scalars import grade, grade_label, is_placeholder, normalize_value, pct, round2
from costlens.operators.lines import currency_guard, has_cost, line_totals, mapped_tag

MONEY = "decimal(38,2)"


def _sum(condition=None):
    c = F.coalesce("cost", F.lit(0).cast("decimal(18,2)"))
    return F.coalesce(F.sum(c if condition is None else F.when(condition, c)), F.lit(0)).cast(MONEY)


def _marks(resources: DataFrame) -> list[Column]:
    """What each source maps, where there are several."""
    return [F.min(c).alias(c) for c in resources.columns if c == "mapped"]


def resource_totals(resources: DataFrame, *more: Column, by: Sequence[str] = ()) -> DataFrame:
    """One row of counts and sums over all resources (of each group by); more: further aggregates."""
    return resources.groupBy(*by).agg(
        *_marks(resources),
        F.count("*").alias("analyzed_resources"),
        F.count_if("compliant").alias("compliant_count"),
        F.count_if(~F.col("compliant")).alias("non_compliant_count"),
        _sum().alias("total"),
        _sum(F.col("compliant")).alias("compliant_cost"),
        F.count_if("negative").alias("negative_count"),
        *more,
    )


def _scores(totals: DataFrame, mapping: Mapping, policy: Policy = Policy()) -> DataFrame:
    has = F.lit(bool(mapping.roles.get("cost"))) & has_cost(totals, policy)
    out = totals.withColumn(
        "spend_score", F.when(has & (F.col("total") > 0), pct(F.col("compliant_cost"), F.col("total")))
    ).withColumn("resource_score", pct(F.col("compliant_count"), F.col("analyzed_resources")))
    return out.withColumn(
        "unallocated_cost", F.when(has, round2(F.col("total") - F.col("compliant_cost"))).otherwise(F.lit(0.0))
    ).withColumn("total_cost", F.col("total").cast("double"))


def spend_score(resources: DataFrame, mapping: Mapping) -> DataFrame:
    s = _scores(resource_totals(resources), mapping).withColumn("grade", grade(F.col("spend_score")))
    return s.select("spend_score", "grade", grade_label(F.col("grade"), "spend").alias("label"))


def resource_score(resources: DataFrame, mapping: Mapping) -> DataFrame:
    s = _scores(resource_totals(resources), mapping).withColumn("grade", grade(F.col("resource_score")))
    return s.select("resource_score", "grade", grade_label(F.col("grade"), "resource").alias("label"))


def grade_divergence(resources: DataFrame, mapping: Mapping) -> DataFrame:
    """Whether the two scores are 15 points or more apart, and which is higher; no spend score, no divergence."""
    s = _scores(resource_totals(resources), mapping)
    gap = F.col("spend_score") - F.col("resource_score")
    apart = F.coalesce(F.abs(gap) >= DIVERGENCE_POINTS, F.lit(False))
    return s.select("spend_score", "resource_score", apart.alias("diverges"), F.when(apart & (gap > 0), "spend").when(apart, "resources").alias("higher"))


def _held(resources: DataFrame, mapping: Mapping, policy: Policy) -> Column:
    """The normalised placeholders of a resource, one for each tag that has one."""
    tags = mapping.tracked(policy)
    cells = F.array(*[F.when(is_placeholder(F.col(k), policy.null_tokens), normalize_value(F.col(k))) for k in tags]) if tags else F.array().cast("array<string>")
    return F.filter(cells, lambda v: v.isNotNull())


def placeholder_values(resources: DataFrame, mapping: Mapping, policy: Policy = Policy(), by: Sequence[str] = ()) -> DataFrame:
    """value, occurrences, resources: a resource is one row, so its distinct values are found in the row, and both are plain counts."""
    one = resources.select(*by, _held(resources, mapping, policy).alias("held"))
    one = one.select(*by, "held", F.explode(F.array_distinct("held")).alias("value"))
    times = F.size(F.filter("held", lambda v: v == F.col("value"))).cast("long")
    return one.groupBy(*by, "value").agg(F.sum(times).alias("occurrences"), F.count("*").alias("resources")).orderBy(*by, F.desc("occurrences"), "value")


def placeholder_totals(resources: DataFrame, mapping: Mapping, policy: Policy = Policy(), by: Sequence[str] = ()) -> DataFrame:
    """All occurrences and the exact union of the resources that have one."""
    return resources.groupBy(*by).agg(*_placeholders(F.size(_held(resources, mapping, policy)).cast("long"), "occurrences", "resources"))


def _placeholders(held: Column, occurrences: str, resources: str) -> list[Column]:
    return [F.coalesce(F.sum(held), F.lit(0).cast("long")).alias(occurrences), F.count_if(held > 0).alias(resources)]


def solo_recoverable(resources: DataFrame) -> DataFrame:
    """tag, cost of the resources that lack only this tag."""
    return resources.where(F.size("missing") == 1).groupBy(F.get("missing", F.lit(0)).alias("tag")).agg(round2(_sum()).alias("solo_cost"))


def tag_coverage(resources: DataFrame, mapping: Mapping, policy: Policy = Policy(), by: Sequence[str] = ()) -> DataFrame:
    """One row for each tracked tag, in policy order (position); of a group by for the tags that it maps."""
    tags = mapping.tracked(policy)
    label = {t.key: t.label for t in policy.tags}
    place = {t.key: i for i, t in enumerate(policy.tags)}
    cost = F.coalesce("cost", F.lit(0).cast("decimal(18,2)"))
    has = bool(mapping.roles.get("cost"))
    # All tags in one pass: an aggregate for each tag, then one row to a row for each tag.
    per_tag = [c for k in tags for c in (
        F.count_if(~F.array_contains("missing", k)).alias(f"with_{k}"),
        F.coalesce(F.sum(F.when(~F.array_contains("missing", k), cost)), F.lit(0)).cast(MONEY).alias(f"cost_{k}"),
        F.count_if(is_placeholder(F.col(k), policy.null_tokens)).alias(f"held_{k}"),
        F.coalesce(F.sum(F.when((F.size("missing") == 1) & (F.get("missing", F.lit(0)) == k), cost)), F.lit(0)).cast(MONEY).alias(f"solo_{k}"),
    )]
    one = resources.groupBy(*by).agg(*_marks(resources), F.count("*").alias("n"), F.coalesce(F.sum(cost), F.lit(0)).cast(MONEY).alias("total"), *per_tag)
    has = F.lit(has) & has_cost(one, policy)
    rows = F.array(*[
        F.when(mapped_tag(one, place[k]), F.struct(
            F.lit(i).alias("position"), F.lit(k).alias("tag"), F.lit(label[k]).alias("label"), F.col(f"with_{k}").alias("w"),
            F.col(f"cost_{k}").alias("c"), F.col(f"held_{k}").alias("h"), F.col(f"solo_{k}").alias("s")
        )) for i,
        k in enumerate(tags)
    ])
    return one.select(*by, "n", "total", has.alias("has"), F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select(
        *by, "r.position", "r.tag", "r.label",
        pct(F.col("r.w"), F.col("n")).alias("resource_pct"),
        F.when(F.col("has") & (F.col("total") > 0), pct(F.col("r.c"), F.col("total"))).alias("cost_pct"),
        (F.col("n") - F.col("r.w")).alias("missing_count"),
        F.col("r.h").alias("placeholder_count"),
        F.when(F.col("has"), round2(F.col("r.s"))).alias("solo_recoverable_cost"),
    )


def service_breakdown(resources: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    bad = ~F.col("compliant")
    rows = resources.groupBy(*by, F.coalesce("service", F.lit(NO_SERVICE)).alias("service")).agg(
        round2(_sum()).alias("total_cost"), round2(_sum(bad)).alias("unallocated_cost"), F.count("*").alias("resource_count"), F.count_if(bad).alias("non_compliant_count")
    )
    return rows.orderBy(*by, F.desc("unallocated_cost"), "service")


def audit_summary(classified: DataFrame, resources: DataFrame, mapping: Mapping, policy: Policy = Policy(), limit: int = 5000, by: Sequence[str] = ()) -> DataFrame:
    """One row (of each group by): counts, costs, both scores and grades, line totals, placeholder totals, currencies.

    With several currencies the scores are null and refused is true: amounts are never added across currencies.
    """
    held = [is_placeholder(F.col(k), policy.null_tokens).cast("long") for k in mapping.tracked(policy)]
    per_resource = reduce(lambda a, b: a + b, [F.coalesce(h, F.lit(0).cast("long")) for h in held], F.lit(0).cast("long"))
    totals = resource_totals(resources, *_placeholders(per_resource, "placeholder_count", "placeholder_resources"), by=by)
    of_lines, guard = line_totals(classified, by), currency_guard(classified, by)
    if by:  # a group may have lines but no resource
        marks = classified.groupBy(*by).agg(*_marks(classified)) if _marks(classified) else None
        totals = totals.drop("mapped")
        one = of_lines.join(totals, list(by), "left").fillna(0).join(guard, list(by), "left").fillna({"currencies": "", "refused": False})
        one = one.join(marks, list(by)) if marks is not None else one
    else:  # one-row tables side by side
        one = totals.crossJoin(of_lines).crossJoin(guard)
    one = _scores(one, mapping, policy)
    fine = ~F.col("refused")
    return one.select(
        *by, "total_rows", "analyzed_resources", "compliant_count", "non_compliant_count",
        *[F.when(fine, F.col(c)).alias(c) for c in ("total_cost", "unallocated_cost", "spend_score", "resource_score")],
        *[F.when(fine, grade(F.col(f"{c}_score"))).alias(f"{c}_grade") for c in ("spend", "resource")],
        "credit_count", round2(F.col("credit_total")).alias("credit_total"), "netted_count", "negative_count", "untaggable_count",
        round2(F.col("untaggable_cost")).alias("untaggable_cost"), "cost_missing_count",
        (F.col("kept_lines") - F.col("analyzed_resources")).alias("merged_lines"), "placeholder_count", "placeholder_resources",
        (F.col("analyzed_resources") > limit).alias("truncated"), "currencies", "refused",
    )


def spend_composition(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """part, amount, share (percent of all parts); empty parts are left out."""
    a = F.greatest(F.lit(0.0), F.col("total_cost") - F.col("unallocated_cost"))
    rows = F.array(
        F.struct(F.lit("allocatable").alias("part"), a.alias("amount")),
        F.struct(F.lit("unallocated").alias("part"), F.col("unallocated_cost").alias("amount")),
        F.struct(F.lit("untaggable").alias("part"), F.greatest(F.lit(0.0), F.col("untaggable_cost")).alias("amount"))
    )
    whole = a + F.col("unallocated_cost") + F.greatest(F.lit(0.0), F.col("untaggable_cost"))
    return summary.select(*by, whole.alias("whole"), F.explode(rows).alias("r")).where((F.col("r.amount") > 0) & (F.col("whole") > 0)).select(
        *by, "r.part", round2(F.col("r.amount")).alias("amount"), pct(F.col("r.amount"), F.col("whole")).alias("share")
    )


def data_quality_notes(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """note, count, amount for each line counter that is not 0."""
    none = F.lit(None).cast("double")
    note = lambda name, count, amount: F.struct(F.lit(name).alias("note"), F.col(count).cast("long").alias("count"), amount.alias("amount"))
    rows = F.array(
        note("untaggable", "untaggable_count", F.col("untaggable_cost")), note("credits", "credit_count", F.col("credit_total")),
        note("netted", "netted_count", none), note("negative_resources", "negative_count", none),
        note("cost_missing", "cost_missing_count", none), note("merged_lines", "merged_lines", none)
    )
    return summary.select(*by, F.explode(rows).alias("r")).select(*by, "r.*").where(F.col("count") > 0)
