"""Roll-up of kept lines to resources.

Two partial-aggregable levels, (rkey, service) and rkey, so that a resource with a third of all lines shrinks to one row
a task before the shuffle. Lines are read and parsed once; those without an id are resources of one line each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.functions.policy import Mapping, Policy
from costlens.functions.scalars import is_null_token, is_placeholder, parse_tag_object, round2
from costlens.operators.lines import kept_lines, mapped_tag

EPSILON = "0.000000001"


def _offered(key: str, mapping: Mapping, own_keys: bool) -> list[Column]:
    """The values that a line offers for a tag: JSON first, then the column. own_keys: each row has its source's JSON keys in json_keys."""
    json_key = F.col("json_keys")[key] if own_keys else mapping.json_keys.get(key)
    out = [F.col("__json")[json_key]] if mapping.json_column and mapping.json_keys.get(key) else []
    return out + ([F.col(f"tag_{key}")] if mapping.tag_columns.get(key) else [])


def _per_line(kept: DataFrame, mapping: Mapping, policy: Policy, by: Sequence[str] = ()) -> DataFrame:
    if mapping.json_column and mapping.json_keys:
        kept = kept.withColumn("__json", parse_tag_object(F.col("tags_json")))
    filled = lambda name: F.when(F.col(name) != "", F.col(name)).alias(name)
    return kept.select(
        *by, *_marks(kept), "rkey", "line_no", "cost", F.when(F.col("has_id"), F.col("resource_id")).otherwise(F.col("rkey")).alias("id"), filled("service"), filled("provider"), filled("region"),
        *[_best_offer(_offered(k, mapping, "json_keys" in kept.columns), policy).alias(f"tag_{k}") for k in mapping.tracked(policy)],
    )


def _marks(rows: DataFrame) -> list[str]:
    """What a source maps, the same for all its rows."""
    return [c for c in rows.columns if c == "mapped"]


def _best_offer(offers: list[Column], policy: Policy) -> Column:
    """The value that a line has for a tag, as (placeholder, line, value): the least of these over all lines is the resource's. Null without any."""
    of = lambda rank, v: F.struct(F.lit(rank).alias("rank"), F.col("line_no").alias("n"), v.alias("v"))
    real = [F.when(~is_null_token(v, policy.null_tokens), of(0, v)) for v in offers]
    held = [F.when(is_placeholder(v, policy.null_tokens), of(1, v)) for v in offers]
    return F.coalesce(*real, *held)


def dominant_service(kept: DataFrame, mapping: Mapping, policy: Policy = Policy()) -> DataFrame:
    """rkey, service: the service with the largest sum of |cost| + 1e-9 a line; ties to the first seen; blank services do not count."""
    lines = _per_line(kept, mapping, policy).where(F.col("service").isNotNull())
    weight = F.sum(F.abs(F.coalesce("cost", F.lit(0).cast("decimal(38,12)"))) + F.lit(EPSILON).cast("decimal(38,12)"))
    return lines.groupBy("rkey", "service").agg(weight.alias("w"), F.min("line_no").alias("first")).groupBy("rkey").agg(F.max_by("service", F.struct("w", -F.col("first"))).alias("service"))


def resource_rollup(kept: DataFrame, mapping: Mapping, policy: Policy = Policy(), by: Sequence[str] = ()) -> DataFrame:
    """One row a resource (of each group by): rkey, id (first seen), service (dominant), provider and region (of the first line),
    cost (unparsed cells ignored; null without a cost column), line_items, first_line, and each tracked tag resolved: the
    first real value, else the first placeholder, else null."""
    tags = mapping.tracked(policy)
    lines, marks = _per_line(kept, mapping, policy, by), [F.min(c).alias(c) for c in _marks(kept)]
    zero = F.lit(0).cast("decimal(38,12)")
    inner = lines.groupBy(*by, "rkey", "service").agg(
        *marks,
        F.sum(F.coalesce("cost", zero)).alias("cost"),
        F.sum(F.abs(F.coalesce("cost", zero)) + F.lit(EPSILON).cast("decimal(38,12)")).alias("w"),
        F.count("*").alias("line_items"),
        F.min(F.struct("line_no", "id", "provider", "region")).alias("head"),
        *[F.min(f"tag_{k}").alias(f"tag_{k}") for k in tags],
    )
    merged = inner.groupBy(*by, "rkey").agg(
        *marks,
        F.sum("cost").alias("cost"),
        F.max(F.when(F.col("service").isNotNull(), F.struct("w", (-F.col("head.line_no")).alias("n"), F.col("service").alias("v")))).alias("best"),
        F.sum("line_items").alias("line_items"),
        F.min("head").alias("head"),
        *[F.min(f"tag_{k}").alias(f"tag_{k}") for k in tags],
    )
    out = merged.select(
        *by, *_marks(kept), "rkey", "head.id", F.col("best.v").alias("service"), "head.provider", "head.region", "cost", "line_items",
        F.col("head.line_no").alias("first_line"), *[F.col(f"tag_{k}.v").alias(k) for k in tags]
    )
    return out if mapping.roles.get("cost") else out.withColumn("cost", F.lit(None).cast("decimal(38,12)"))


def resolve_tags(kept: DataFrame, mapping: Mapping, policy: Policy = Policy()) -> DataFrame:
    return resource_rollup(kept, mapping, policy).select("rkey", *mapping.tracked(policy))


def first_seen(kept: DataFrame, mapping: Mapping, policy: Policy = Policy()) -> DataFrame:
    return resource_rollup(kept, mapping, policy).select("rkey", "id", "provider", "region", "first_line")


def clamp_and_round(resources: DataFrame) -> DataFrame:
    """cost to cents for each resource before any total; a net-negative resource becomes 0 and is marked."""
    negative = F.coalesce(F.col("cost") < 0, F.lit(False))
    return resources.withColumn("negative", negative).withColumn("cost", F.when(negative, F.lit(0).cast("decimal(18,2)")).otherwise(round2(F.col("cost")).cast("decimal(18,2)")))


def compliance(resources: DataFrame, mapping: Mapping, policy: Policy = Policy()) -> DataFrame:
    """resources with missing (tracked tags without a real value, in policy order) and compliant."""
    tags = mapping.tracked(policy)
    place = {t.key: i for i, t in enumerate(policy.tags)}
    lack = [F.when(is_null_token(F.col(k), policy.null_tokens) & mapped_tag(resources, place[k]), F.lit(k)) for k in tags]
    missing = F.filter(F.array(*lack), lambda x: x.isNotNull()) if tags else F.array().cast("array<string>")
    return resources.withColumn("missing", missing).withColumn("compliant", F.size("missing") == 0)


def resource_table(classified: DataFrame, mapping: Mapping, policy: Policy = Policy(), by: Sequence[str] = ()) -> DataFrame:
    """The audited resources, from classified lines."""
    return compliance(clamp_and_round(resource_rollup(kept_lines(classified), mapping, policy, by)), mapping, policy)
