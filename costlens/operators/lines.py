"""Billing lines: canonical columns, routing to buckets, and totals over all lines.

Canonical lines: line_no, resource_id, service, provider, region, cost_raw, currency, charge_type, one column tag_<key>
for each mapped tag column, tags_json. Unmapped roles are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costlens.functions.policy import Mapping, Policy
from costlens.functions.scalars import is_null_token, is_untaggable_charge, normalize_currency, parse_cost

ROLES = {"resource_id": "resourceId", "service": "service", "provider": "provider", "region": "region", "cost_raw": "cost", "currency": "currency", "charge_type": "chargeType"}

#: Currencies that the guard names.
CURRENCIES = 50


def mapped_tag(rows: DataFrame, k: int) -> Column:
    """Whether the source of a row maps the k-th tag of the policy. Rows of many exports say so in the bits of ``mapped``; rows of one export have only mapped tags."""
    return F.col("mapped").bitwiseAND(1 << k) != 0 if "mapped" in rows.columns else F.lit(True)


def has_cost(rows: DataFrame, policy: Policy) -> Column:
    """Whether the source of a row maps a cost column."""
    return mapped_tag(rows, len(policy.tags))


def to_canonical(df: DataFrame, mapping: Mapping, line_no: str | None = None) -> DataFrame:
    """Source columns under canonical names. Without a line_no column lines are numbered after the scan: unique, in order inside a file split, not gapless."""
    number = F.col(f"`{line_no}`") if line_no else F.monotonically_increasing_id() + 1
    take = lambda name: F.col(f"`{name}`").cast("string") if name else F.lit(None).cast("string")
    return df.select(
        number.cast("long").alias("line_no"),
        *[take(mapping.roles.get(r)).alias(c) for c, r in ROLES.items()],
        *[take(c).alias(f"tag_{k}") for k, c in mapping.tag_columns.items()],
        take(mapping.json_column).alias("tags_json"),
    )


def classify_lines(lines: DataFrame, mapping: Mapping, policy: Policy = Policy()) -> DataFrame:
    """lines with cost, cost_missing, has_id, untaggable, bucket (untaggable, credit, netted, usage) and rkey: the lower-cased, untrimmed id, or row-<line no> where there is none."""
    cost = parse_cost(F.col("cost_raw")) if mapping.roles.get("cost") else F.lit(None).cast("decimal(38,12)")
    out = lines.withColumn("cost", cost)
    has_id = F.col("resource_id").isNotNull() & ~is_null_token(F.col("resource_id"), policy.null_tokens)
    negative = F.coalesce(F.col("cost") < 0, F.lit(False))
    untaggable = is_untaggable_charge(F.col("charge_type")) if mapping.roles.get("chargeType") else F.lit(False)
    return out.select(
        "*",
        (F.col("cost").isNull() & has_cost(lines, policy) if mapping.roles.get("cost") else F.lit(False)).alias("cost_missing"),
        has_id.alias("has_id"),
        untaggable.alias("untaggable"),
        F.when(untaggable, "untaggable").when(negative & ~has_id, "credit").when(negative, "netted").otherwise("usage").alias("bucket"),
        F.when(has_id, F.lower("resource_id")).otherwise(F.concat(F.lit("row-"), F.col("line_no").cast("string"))).alias("rkey"),
    )


def kept_lines(classified: DataFrame) -> DataFrame:
    """Lines of usage and netted lines. Said without the bucket, so that the cost of a line with an id need not be parsed to keep it."""
    return classified.where(~F.col("untaggable") & (F.col("has_id") | ~F.coalesce(F.col("cost") < 0, F.lit(False))))


def line_aggregates() -> list[Column]:
    """Counts and sums over classified lines."""
    amount = F.coalesce("cost", F.lit(0).cast("decimal(38,12)"))
    of = lambda b: F.coalesce(F.sum(F.when(F.col("bucket") == b, amount)), F.lit(0)).cast("double")
    return [
        F.count("*").alias("total_rows"),
        F.count_if(F.col("bucket") == "credit").alias("credit_count"),
        of("credit").alias("credit_total"),
        F.count_if(F.col("bucket") == "netted").alias("netted_count"),
        F.count_if(F.col("bucket") == "untaggable").alias("untaggable_count"),
        of("untaggable").alias("untaggable_cost"),
        F.count_if("cost_missing").alias("cost_missing_count"),
        F.count_if(F.col("bucket").isin("usage", "netted")).alias("kept_lines"),
    ]


def line_totals(classified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row of counts and sums over all lines (of each group by). merged lines are kept lines less resources: see audit_summary."""
    return classified.groupBy(*by).agg(*line_aggregates())


def currency_inventory(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct normalised currencies of all lines."""
    return lines.select(*by, normalize_currency(F.col("currency")).alias("currency")).where(F.col("currency").isNotNull()).distinct()


def currency_guard(lines: DataFrame, by: Sequence[str] = (), names: int = CURRENCIES) -> DataFrame:
    """One row (for each group by that has a currency): the currencies, sorted, and whether the audit must be refused as there are several.

    At most ``names`` of them are named, the first ones, with the number of the others: a column of other texts than
    currencies does not fill a row. The distinct texts are counted where they are, and cut to the first before they meet.
    """
    found = currency_inventory(lines, by)
    nth = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("currency"))
    first = found.withColumn("nth", nth).where(F.col("nth") <= names).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("currency")), ",").alias("first"))
    count = found.groupBy(*by).agg(F.count("*").alias("n"))
    both = first.join(count, list(by)) if by else first.crossJoin(count)  # one row each
    more = F.when(F.col("n") > names, F.concat(F.lit(" and "), (F.col("n") - names).cast("string"), F.lit(" more"))).otherwise("")
    return both.select(*by, F.concat("first", more).alias("currencies"), (F.col("n") > 1).alias("refused"))
