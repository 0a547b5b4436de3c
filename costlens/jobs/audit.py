"""The audit of one export, or of many in one job, from files to report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costlens.functions.policy import ROLE_SYNONYMS, Mapping, Policy
from costlens.operators import coverage, drift, explore, lines, mapping, resources
from costlens.sources import billing_csv as io
from costlens.sources.shared import written


def audit_tables(canonical: DataFrame, headers: DataFrame, how: Mapping, policy: Policy = Policy(), by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """All parts of the report; with by (source) each part has the column and holds for each source by itself.

    The resource table and the summary are written once to the shared folder: other parts read them.
    """
    classified = lines.classify_lines(canonical, how, policy)
    table = written(resources.resource_table(classified, how, policy, by))
    summary = written(coverage.audit_summary(classified, table, how, policy, by=by))
    return {
        "summary": summary,
        "resources": table,
        "coverage": coverage.tag_coverage(table, how, policy, by),
        "placeholders": coverage.placeholder_values(table, how, policy, by),
        "services": coverage.service_breakdown(table, by),
        "composition": coverage.spend_composition(summary, by),
        "notes": coverage.data_quality_notes(summary, by),
        "offenders": explore.top_offenders(table, by=by),
        "fix_first": explore.fix_first(table, by=by),
        "drift": drift.drift_findings(headers, table, how, policy, by),
    }


def mapping_parts(headers: DataFrame, cells: DataFrame, how: Mapping, policy: Policy = Policy()) -> dict[str, DataFrame]:
    """What was mapped: mapping (kind, name, header, key), and preset, confidence and unmapped keys of the headers and the sample."""
    rows = [("role", r, h, None) for r, h in how.roles.items()] + [("tag", t, h, None) for t, h in how.tag_columns.items()]
    rows += [("tag", t, how.json_column, k) for t, k in how.json_keys.items()]
    spark = headers.sparkSession
    column = mapping.detect_json_tag_column(headers, cells, policy).select("source", "position")
    keys = mapping.discover_json_keys(cells.join(column, ["source", "position"]).select("source", "line", "value"))
    used = mapping.map_json_tag_keys(keys, mapping.map_tags(headers, cells, policy), policy)
    return {
        "mapping": spark.createDataFrame(rows, "kind string, name string, header string, key string"),
        "preset": mapping.classify_preset(headers),
        "confidence": mapping.mapping_confidence(headers, cells, policy),
        "unmapped_keys": mapping.unmapped_json_keys(keys, used),
    }


def audit_csv(
    spark: SparkSession, path: str, sep: str = ",", how: Mapping | None = None, policy: Policy = Policy(), sample: int = 500,
    multi_line: bool | None = None
) -> dict[str, DataFrame]:
    """Read, map (unless how is given), audit the files under path as one export. multi_line as in open_export. Several currencies raise ValueError, as does input without header, rows or mapped tag.

    The text is read once; canonical lines, of the mapped columns only, are written once, and all parts come from them.
    Besides the parts of audit_tables: rejected rows, what was mapped (mapping_parts), and the findings' suggestions.
    """
    export = io.open_export(spark, path, sep, multi_line)
    if not any(export.names):
        raise ValueError(io.REFUSALS["header"])
    good, rejected = io.split_malformed(io.lines_of(export))
    io.input_guard(export.names, good)
    headers, cells = io.header_table(spark, export.names), written(io.cell_table(io.sample_export(export, sample)))
    how = how or mapping.detect_mapping(headers, cells, "file", policy)
    io.input_guard(export.names, good, how, policy)
    canonical = written(lines.to_canonical(io.with_headers(good, export.names), how, "line_no"))
    guard = lines.currency_guard(canonical).first()
    if guard["refused"]:
        raise ValueError(f"several currencies: {guard['currencies']}")
    parts = audit_tables(canonical, headers, how, policy)
    return parts | {"rejected": rejected, "suggestions": drift.suggestions(parts["drift"])} | mapping_parts(headers, cells, how, policy)


def map_exports(headers: DataFrame, cells: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row a source: roles and tags (name to header), json_header, json_keys (tag to key), mapped (the policy's tags and, after them, the cost, as bits)."""
    as_map = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    tags = written(mapping.map_tags(headers, cells, policy))
    column = mapping.detect_json_tag_column(headers, cells, policy)
    keys = mapping.discover_json_keys(cells.join(column.select("source", "position"), ["source", "position"]).select("source", "line", "value"))
    of_keys = mapping.map_json_tag_keys(keys, tags, policy).groupBy("source").agg(as_map("tag", "key").alias("json_keys"))
    out = headers.select("source").distinct()
    out = out.join(mapping.map_roles(headers).groupBy("source").agg(as_map("role", "header").alias("roles")), "source", "left")
    out = out.join(tags.groupBy("source").agg(as_map("tag", "header").alias("tags")), "source", "left")
    out = out.join(column.select("source", F.col("header").alias("json_header")), "source", "left").join(of_keys, "source", "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    out = out.select("source", "json_header", *[F.coalesce(c, none).alias(c) for c in ("roles", "tags", "json_keys")])
    bits = [(F.map_contains_key("tags", t.key) | F.map_contains_key("json_keys", t.key), i) for i, t in enumerate(policy.tags)]
    bits.append((F.map_contains_key("roles", "cost"), len(policy.tags)))
    return out.withColumn("mapped", sum((F.when(has, F.lit(1 << i)).otherwise(0) for has, i in bits), F.lit(0)).cast("long"))


def canonical_of_exports(good: DataFrame, names: list[str], maps: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Canonical lines of many exports (lines_of), each by its own mapping (map_exports).

    Besides the columns of to_canonical they have source, mapped, and the JSON keys of the source's tags.
    """
    cells = F.array(*[F.col(f"c{i}") for i in range(len(names))])
    # Of equal names the first.
    look = lambda header: F.get("__cells", (F.array_position(F.array(*map(F.lit, names)), header) - 1).cast("int"))
    small = maps.count() <= io.MAX_FILES
    rows = good.select("source", "line_no", cells.alias("__cells")).join(F.broadcast(maps) if small else maps, "source")
    role = lambda r: F.when(F.map_contains_key("roles", r), look(F.col("roles")[r]))
    return rows.select(
        "source", "mapped", F.col("line_no").cast("long").alias("line_no"), *[role(r).alias(c) for c, r in lines.ROLES.items()],
        *[F.when(F.map_contains_key("tags", t.key), look(F.col("tags")[t.key])).alias(f"tag_{t.key}") for t in policy.tags],
        F.when(F.col("json_header").isNotNull(), look(F.col("json_header"))).alias("tags_json"), "json_keys",
    )


def audit_exports(spark: SparkSession, path: str, sep: str = ",", policy: Policy = Policy(), sample: int = 500, multi_line: bool | None = None) -> dict[str, DataFrame]:
    """Every file under path is an export of its own, with its own mapping; all are audited in one job, and every part has the column source (the file).

    A source with several currencies, or without a mapped tag, has no scores: its summary says refused or tracked = 0.
    Parts besides those of audit_tables: rejected, mapping (map_exports), preset, confidence, suggestions. Files without
    a header or a data row have no summary.
    """
    export = io.open_export(spark, path, sep, multi_line)
    if not any(export.names):
        raise ValueError(io.REFUSALS["header"])
    good, rejected = io.split_malformed(io.lines_of(export))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("line_no"))
    first = written(good.withColumn("nth", nth).where(F.col("nth") <= sample).drop("nth"))  # each source's rows are cut before they are shuffled
    headers = written(export.headers.where(F.col("header") != ""))
    cells = written(io.cells_by_source(first, export.names, headers))
    maps = written(map_exports(headers, cells, policy))
    canonical = written(canonical_of_exports(good, export.names, maps, policy))
    how = Mapping({r: r for r in ROLE_SYNONYMS}, {t.key: t.key for t in policy.tags}, "tags_json", {t.key: t.key for t in policy.tags})
    parts = audit_tables(canonical, headers, how, policy, ["source"])
    summary = parts["summary"].join(maps.select("source", F.bit_count(F.col("mapped").bitwiseAND((1 << len(policy.tags)) - 1)).alias("tracked")), "source")
    return parts | {
        "summary": summary, "rejected": rejected, "mapping": maps, "preset": mapping.classify_preset(headers),
        "confidence": mapping.mapping_confidence(headers, cells, policy), "suggestions": drift.suggestions(parts["drift"]),
    }
