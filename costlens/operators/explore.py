"""Ranked lists and filters over the resource table; limits are the feature (top-k)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costlens.functions.policy import NO_SERVICE
from costlens.sources.shared import written


def _cost() -> Column:
    return F.coalesce("cost", F.lit(0).cast("decimal(18,2)"))


def _first(rows: DataFrame, limit: int, by: Sequence[str], *order: Column) -> DataFrame:
    """The first rows in order, of each group by; groups are cut before they are shuffled."""
    if not by:
        return rows.orderBy(*order).limit(limit)
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= limit).drop("nth")


def top_offenders(resources: DataFrame, limit: int = 100, by: Sequence[str] = ()) -> DataFrame:
    return _first(resources.where(~F.col("compliant")), limit, by, _cost().desc(), F.col("first_line"))


def top_resources(resources: DataFrame, limit: int = 5000) -> DataFrame:
    return resources.orderBy(_cost().desc(), "first_line").limit(limit)


def fix_first(resources: DataFrame, limit: int = 20, within: int = 100, least: float = 0.01, by: Sequence[str] = ()) -> DataFrame:
    """The costliest offenders worth fixing with their missing tags, and how many of the first offenders are below least."""
    # The window is over the first offenders only, within (100) rows a group at most.
    first = top_offenders(resources, within, by).withColumn("negligible", F.count_if(_cost() < least).over(Window.partitionBy(*(by or [F.lit(0)]))))
    return _first(first.where(_cost() >= least), limit, by, _cost().desc(), F.col("first_line"))


def report_offenders(resources: DataFrame, limit: int = 10) -> DataFrame:
    return top_offenders(resources, limit)


def search_resources(resources: DataFrame, text: str) -> DataFrame:
    q = text.strip().lower()
    return resources.where(F.lower("id").contains(q) | F.lower(F.coalesce("service", F.lit(""))).contains(q)) if q else resources


def filter_status(resources: DataFrame, status: str = "all") -> DataFrame:
    return resources if status == "all" else resources.where(F.col("compliant") == F.lit(status == "compliant"))


def filter_missing_tag(resources: DataFrame, tag: str) -> DataFrame:
    return resources.where(F.array_contains("missing", tag))


def filter_service(resources: DataFrame, service: str) -> DataFrame:
    return resources.where(F.coalesce("service", F.lit(NO_SERVICE)) == service)


def sort_resources(resources: DataFrame, key: str = "cost", descending: bool = True) -> DataFrame:
    by = {"cost": _cost(), "id": F.col("id"), "service": F.coalesce("service", F.lit(""))}[key]
    return resources.orderBy(by.desc() if descending else by.asc(), "first_line")


def list_services(resources: DataFrame) -> DataFrame:
    return resources.select(F.coalesce("service", F.lit(NO_SERVICE)).alias("service")).distinct().orderBy("service")


def explore_resources(
    resources: DataFrame, text: str = "", status: str = "all", tag: str | None = None, service: str | None = None, key: str = "cost",
    descending: bool = True, limit: int = 200
) -> DataFrame:
    """All filters together over all resources; the first limit rows, each with the number of all matches. The matches are written once, to be counted and ranked."""
    found = filter_status(search_resources(resources, text), status)
    found = filter_missing_tag(found, tag) if tag else found
    found = filter_service(found, service) if service else found
    found = written(found)
    n = found.agg(F.count("*").alias("matches"))
    return sort_resources(found, key, descending).limit(limit).crossJoin(F.broadcast(n))
