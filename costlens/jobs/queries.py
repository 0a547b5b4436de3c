"""A query for each operator over the tables of a folder, and its result in DuckDB SQL.

The SQL side is a chain of views from the same derived lines; each query selects from the end of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.functions import scalars as S
from costlens.functions.policy import DEFAULT_TAGS, ENV_ALIASES, NULL_TOKENS, RESOURCE_LABELS, ROLE_SYNONYMS, SPEND_LABELS, UNTAGGABLE, Mapping
from costlens.operators import coverage, drift, explore, lines, mapping, resources
from costlens.operators.search_index import ResourceIndex
from costlens.sources import billing_csv, tables
from costlens.sources.shared import shared_dir, written

M = tables.EVENT_MAPPING
TAGS = ["owner", "team", "environment", "cost_center"]
quote = lambda xs: ", ".join("'" + x + "'" for x in xs)
NULLS, HELD = quote(NULL_TOKENS), quote(t for t in NULL_TOKENS if t)
BLANKS = " || ".join(f"chr({ord(c)})" for c in S.BLANK)
strip = lambda c: f"trim({c}, {BLANKS})"
norm = lambda c: "lower(" + strip(f"coalesce({c}, '')") + ")"
r2 = lambda x: f"(floor(({x})::DOUBLE * 100 + 0.5) / 100)"
pct = lambda a, b: f"(CASE WHEN ({b}) = 0 THEN 100.0 ELSE floor(({a})::DOUBLE / ({b})::DOUBLE * 100 * 100 + 0.5) / 100 END)"
header_norm = lambda c: f"regexp_replace(lower({c}), '{S.HEADER_MARKS}', '', 'g')"
grade = lambda s: f"(CASE WHEN {s} IS NULL THEN NULL WHEN {s} >= 95 THEN 'A' WHEN {s} >= 85 THEN 'B' WHEN {s} >= 70 THEN 'C' WHEN {s} >= 50 THEN 'D' ELSE 'F' END)"


def stripped_prefix(c: str) -> str:
    for p in S.TAG_PREFIXES:
        c = f"regexp_replace({c}, '^{p}', '', 'i')"
    return f"trim({c})"


real = lambda c: f"CASE WHEN {norm(c)} NOT IN ({NULLS}) THEN {c} END"
held = lambda c: f"CASE WHEN {norm(c)} IN ({HELD}) THEN {c} END"
JSON = "(CASE WHEN trim(tags_json) = '' OR lower(trim(tags_json)) = 'null' THEN NULL WHEN trim(tags_json) LIKE '{%' THEN trim(tags_json) ELSE '{' || trim(tags_json) || '}' END)"
CC = f"(CASE WHEN json_valid({JSON}) THEN json_extract_string({JSON}, '$.cc') END)"

CHAIN: list[tuple[str, str]] = [
    ("lines", tables.EVENT_LINES),
    ("c1", "SELECT *, trim(cost_raw) AS t, trim(cost_raw) LIKE '(%)' AS paren FROM lines"),
    ("c2", "SELECT *, CASE WHEN paren THEN t[2:-2] ELSE t END AS inn FROM c1"),
    ("c3", "SELECT *, paren OR inn LIKE '-%' AS neg, regexp_replace(inn, '[^0-9.,]', '', 'g') AS d FROM c2"),
    ("c4",
        "SELECT *, length(d) - length(replace(d, ',', '')) AS commas, length(d) - length(replace(d, '.', '')) AS dots, strpos(reverse(d), "
        "',') AS rc, strpos(reverse(d), '.') AS rd FROM c3"),
    ("c5",
        "SELECT *, CASE WHEN commas > 0 AND dots > 0 AND rc < rd THEN regexp_replace(replace(d, '.', ''), ',', '.') WHEN commas > 0 AND "
        "dots > 0 THEN replace(d, ',', '') WHEN commas = 1 AND rc <= 3 THEN replace(d, ',', '.') ELSE replace(d, ',', '') END AS num FROM "
        "c4"),
    ("parsed",
        "SELECT line_no, source, resource_id, service, provider, region, cost_raw, currency, charge_type, tag_owner, tag_team, tag_environment, "
        "tag_cost_center, tags_json, CASE WHEN regexp_matches(num, '[0-9]') THEN CASE WHEN neg THEN -try_cast(num AS DECIMAL(38,12)) ELSE "
        "try_cast(num AS DECIMAL(38,12)) END END AS cost FROM c5"),
    ("routed",
        f"SELECT *, cost IS NULL AS cost_missing, {norm('resource_id')} NOT IN ({NULLS}) AS has_id, {header_norm('charge_type')} IN "
        f"({quote(UNTAGGABLE)}) AS untaggable, coalesce(cost < 0, false) AS neg FROM parsed"),
    ("classified",
        "SELECT *, CASE WHEN untaggable THEN 'untaggable' WHEN neg AND NOT has_id THEN 'credit' WHEN neg THEN 'netted' ELSE 'usage' END AS "
        "bucket, CASE WHEN has_id THEN lower(resource_id) ELSE concat('row-', line_no) END AS rkey FROM routed"),
    ("kept", f"SELECT *, {CC} AS json_cc FROM classified WHERE bucket IN ('usage', 'netted')"),
    (
        "offers",
        "SELECT rkey, line_no * 2 AS n, 'cost_center' AS tag, json_cc AS v FROM kept WHERE json_cc IS NOT NULL UNION ALL " + " UNION ALL ".join(f"SELECT rkey, line_no * 2 + 1, '{k}', tag_{k} FROM kept" for k in TAGS)
    ),
    ("resolved", "SELECT rkey, " + ", ".join(
        f"coalesce(arg_min(v, n) FILTER (tag = '{k}' AND {norm('v')} NOT IN ({NULLS})), arg_min(v, n) FILTER (tag = '{k}' AND {norm('v')} "
        f"IN ({HELD}))) AS {k}" for k in TAGS) + " FROM offers GROUP BY rkey"),
    ("weights",
        "SELECT rkey, service, sum(abs(coalesce(cost, 0)) + 0.000000001::DECIMAL(38,12)) AS w, min(line_no) AS f FROM kept WHERE service "
        "<> '' GROUP BY rkey, service"),
    ("dominant", "SELECT rkey, service FROM (SELECT *, row_number() OVER (PARTITION BY rkey ORDER BY w DESC, f) AS k FROM weights) WHERE k = 1"),
    ("heads",
        "SELECT rkey, nullif(provider, '') AS provider, nullif(region, '') AS region, CASE WHEN has_id THEN resource_id ELSE rkey END AS "
        "id, line_no AS first_line, source FROM (SELECT *, row_number() OVER (PARTITION BY rkey ORDER BY line_no) AS k FROM kept) WHERE k = 1"),
    ("sums", "SELECT rkey, sum(coalesce(cost, 0)) AS cost, count(*) AS line_items FROM kept GROUP BY rkey"),
    ("rolled",
        "SELECT rkey, source, id, service, provider, region, cost, line_items, first_line, owner, team, environment, cost_center FROM heads JOIN "
        "sums USING (rkey) JOIN resolved USING (rkey) LEFT JOIN dominant USING (rkey)"),
    ("clamped", f"SELECT * REPLACE (CASE WHEN cost < 0 THEN 0 ELSE {r2('cost')} END::DECIMAL(18,2) AS cost), cost < 0 AS negative FROM rolled"),
    (
        "res",
        "SELECT *, list_filter([" + ", ".join(f"CASE WHEN {norm(k)} IN ({NULLS}) THEN '{k}' END" for k in TAGS) + "], lambda x: x IS NOT NULL) AS missing, len(missing) = 0 AS compliant FROM clamped"
    ),
    ("totals",
        "SELECT count(*) AS n, count(*) FILTER (compliant) AS ok, coalesce(sum(cost), 0) AS total, coalesce(sum(cost) FILTER (compliant), "
        "0) AS okc, count(*) FILTER (negative) AS negatives FROM res"),
    ("scores", f"SELECT *, CASE WHEN total > 0 THEN {pct('okc', 'total')} END AS spend, {pct('ok', 'n')} AS resource FROM totals"),
    ("cells", " UNION ALL ".join(f"SELECT rkey, source, first_line, '{k}' AS tag, {k} AS raw FROM res" for k in TAGS)),
    ("holders", f"SELECT rkey, source, tag, {norm('raw')} AS value FROM cells WHERE {norm('raw')} IN ({HELD})"),
    ("lt",
        f"SELECT count(*) AS total_rows, count(*) FILTER (bucket = 'credit') AS credit_count, coalesce(sum(coalesce(cost, 0)) FILTER "
        f"(bucket = 'credit'), 0)::DOUBLE AS credit_total, count(*) FILTER (bucket = 'netted') AS netted_count, count(*) FILTER (bucket = "
        f"'untaggable') AS untaggable_count, coalesce(sum(coalesce(cost, 0)) FILTER (bucket = 'untaggable'), 0)::DOUBLE AS untaggable_cost, "
        f"count(*) FILTER (cost_missing) AS cost_missing_count, count(*) FILTER (bucket IN ('usage', 'netted')) AS kept_lines FROM "
        f"classified"),
    ("cur", "SELECT DISTINCT CASE WHEN upper(trim(currency)) NOT IN ('', 'N/A', '-', 'NULL', 'NONE') THEN upper(trim(currency)) END AS currency FROM lines"),
    ("curs", "SELECT string_agg(currency, ',' ORDER BY currency) AS currencies, count(*) > 1 AS refused FROM cur WHERE currency IS NOT NULL"),
    ("held", "SELECT count(*) AS occurrences, count(DISTINCT rkey) AS resources FROM holders"),
    ("summary", f"""SELECT total_rows, n AS analyzed_resources, ok AS compliant_count, n - ok AS non_compliant_count, total::DOUBLE AS total_cost, {r2('total - okc')} AS unallocated_cost, spend AS spend_score, resource AS resource_score,
        {grade('spend')} AS spend_grade, {grade('resource')} AS resource_grade, credit_count, {r2('credit_total')} AS credit_total, netted_count, negatives AS negative_count, untaggable_count, {r2('untaggable_cost')} AS untaggable_cost, cost_missing_count,
        kept_lines - n AS merged_lines, occurrences AS placeholder_count, resources AS placeholder_resources, n > 5000 AS truncated, currencies, refused FROM scores, lt, held, curs"""),
    ("vals",
        f"SELECT tag, {norm('raw')} AS norm, list_sort(list(DISTINCT {strip('raw')})) AS raws, arg_min({strip('raw')}, row(first_line, {strip('raw')})) AS "
        f"raw, min(first_line) AS first_line FROM cells WHERE raw IS NOT NULL AND {norm('raw')} NOT IN ({NULLS}) GROUP BY 1, 2"),
    ("grouped", "SELECT *, CASE " + " ".join(f"WHEN norm IN ({quote(g)}) THEN {i}" for i, g in enumerate(ENV_ALIASES)) +
        " END AS g, regexp_replace(norm, '[0-9]+', '#', 'g') AS skel, "
        "array_to_string(list_sort(list_distinct(list_filter(string_split_regex(norm, '[\\s\\-_./]+'), lambda x: x <> ''))), ' ') AS "
        "words, len(list_distinct(list_filter(string_split_regex(norm, '[\\s\\-_./]+'), lambda x: x <> ''))) AS nw FROM vals"),
    ("near",
        "SELECT a.tag, a.norm AS norm_a, b.norm AS norm_b, a.raw AS raw_a, b.raw AS raw_b, least(a.first_line, b.first_line) AS line, "
        "length(a.norm) >= 3 AND length(b.norm) >= 3 AND a.nw > 1 AND a.words = b.words AS r0, length(a.norm) >= 4 AND length(b.norm) >= 4 "
        "AND abs(length(a.norm) - length(b.norm)) <= 7 AND (starts_with(a.norm, b.norm) OR starts_with(b.norm, a.norm)) AS r1, "
        "length(a.norm) >= 5 AND length(b.norm) >= 5 AND levenshtein(a.norm, b.norm) = 1 AS r2 FROM grouped a JOIN grouped b ON a.tag = "
        "b.tag AND a.norm < b.norm AND a.skel <> b.skel AND (a.g IS NULL OR b.g IS NULL OR a.g <> b.g)"),
    ("pairs",
        "SELECT 'value' AS type, tag, CASE WHEN r0 THEN 'same words, different order' WHEN r1 THEN 'one is a prefix of the other' ELSE "
        "'differs by one character' END AS reason, list_sort([raw_a, raw_b]) AS members, 4 AS stage, line AS position FROM near WHERE r0 "
        "OR r1 OR r2"),
    ("variants",
        "SELECT 'value' AS type, tag, 'case or format variants' AS reason, raws AS members, 2 AS stage, first_line AS position FROM vals "
        "WHERE len(raws) > 1"),
    ("aliases",
        "SELECT 'value' AS type, tag, 'environment aliases' AS reason, list_sort(list(raw)) AS members, 3 AS stage, g AS position FROM "
        "grouped WHERE tag = 'environment' AND g IS NOT NULL GROUP BY tag, g HAVING count(*) > 1"),
    ("headers", tables.HEADERS),
    ("hcells", tables.CELLS),
    (
        "syn",
        "SELECT * FROM (VALUES " + ", ".join(
            f"('{k}', {i}, '{s}')" for i, (k, _, names) in enumerate(DEFAULT_TAGS) for s in dict.fromkeys([k.replace("_", ""), *names])
        ) + ") AS x(tag, tag_rank, synonym)"
    ),
    (
        "role_syn",
        "SELECT * FROM (VALUES " + ", ".join(f"('{r}', {i}, '{s}')" for r, names in ROLE_SYNONYMS.items() for i, s in enumerate(names)) + ") AS x(role, syn_rank, synonym)"
    ),
    ("forms", f"SELECT source, position, header, {header_norm('header')} AS norm, {header_norm(stripped_prefix('header'))} AS tag_norm FROM headers"),
    ("roles",
        "SELECT source, role, position, header FROM (SELECT f.*, role, row_number() OVER (PARTITION BY source, role ORDER BY syn_rank, "
        "position) AS k FROM forms f JOIN role_syn ON norm = synonym) WHERE k = 1"),
    ("fill", "SELECT source, position, count(*) FILTER (trim(value) <> '') AS filled FROM hcells GROUP BY 1, 2"),
    ("tagged",
        "SELECT source, tag, position, header FROM (SELECT *, row_number() OVER (PARTITION BY source, tag ORDER BY filled DESC, position) "
        "AS k FROM (SELECT DISTINCT f.source, f.position, header, tag, coalesce(filled, 0) AS filled FROM forms f JOIN syn ON synonym IN "
        "(norm, tag_norm) LEFT JOIN fill ON fill.source = f.source AND fill.position = f.position WHERE NOT EXISTS (SELECT 1 FROM roles r "
        "WHERE r.source = f.source AND r.position = f.position))) WHERE k = 1"),
    ("jshare", """SELECT source, position, avg(CASE WHEN trim(value) LIKE '{%' OR regexp_matches(trim(value), '^"[^"]+"\\s*:') THEN 1.0 ELSE 0.0 END) AS share FROM hcells WHERE trim(value) <> '' AND lower(trim(value)) <> 'null' GROUP BY 1, 2"""),
    ("jcol",
        "SELECT source, position, header FROM (SELECT f.*, row_number() OVER (PARTITION BY f.source ORDER BY f.position) AS k FROM forms f "
        "JOIN jshare s ON s.source = f.source AND s.position = f.position AND share >= 0.5 WHERE norm IN ('tags', 'resourcetags', "
        "'labels') AND NOT EXISTS (SELECT 1 FROM roles r WHERE r.source = f.source AND r.position = f.position) AND NOT EXISTS (SELECT 1 "
        "FROM tagged r WHERE r.source = f.source AND r.position = f.position)) WHERE k = 1"),
    ("jtext",
        "SELECT c.source, c.line, CASE WHEN trim(value) LIKE '{%' THEN trim(value) ELSE '{' || trim(value) || '}' END AS j FROM hcells c "
        "JOIN jcol USING (source, position) WHERE trim(value) <> '' AND lower(trim(value)) <> 'null'"),
    ("jkeys",
        "SELECT source, key, min(row(line, place)) AS first FROM (SELECT source, line, unnest(json_keys(j)) AS key, "
        "unnest(range(len(json_keys(j)))) AS place FROM jtext WHERE json_valid(j)) GROUP BY 1, 2"),
    ("jmap",
        f"SELECT source, tag, key FROM (SELECT k.source, tag, key, row_number() OVER (PARTITION BY k.source, tag ORDER BY first) AS n FROM "
        f"jkeys k JOIN syn ON synonym = {header_norm('key')} WHERE NOT EXISTS (SELECT 1 FROM tagged t WHERE t.source = k.source AND t.tag = "
        f"syn.tag)) WHERE n = 1"),
    ("kd0",
        "SELECT source, 'key' AS type, NULL::VARCHAR AS tag, 'same header form' AS reason, list_sort(list(DISTINCT header)) AS members, 0 "
        "AS stage, min(position) AS position FROM forms WHERE tag_norm <> '' GROUP BY source, tag_norm HAVING count(DISTINCT header) > 1"),
    ("kd1",
        "SELECT source, 'key' AS type, tag, 'several columns of one tag' AS reason, list_sort(list(DISTINCT header)) AS members, 1 AS "
        "stage, tag_rank AS position FROM forms JOIN syn ON tag_norm = synonym GROUP BY source, tag, tag_rank HAVING count(DISTINCT "
        "header) > 1"),
]
# The same for each source by itself: views with the suffix _s.
_of = dict(CHAIN)
CHAIN += [
    ("totals_s", _of["totals"].replace("SELECT", "SELECT source,", 1) + " GROUP BY source"),
    ("lt_s", _of["lt"].replace("SELECT", "SELECT source,", 1) + " GROUP BY source"),
    ("summary_s",
        f"SELECT source, total::DOUBLE AS total_cost, {r2('total - okc')} AS unallocated_cost, {r2('untaggable_cost')} AS untaggable_cost, untaggable_count, credit_count, netted_count, negatives AS "
        f"negative_count, cost_missing_count, kept_lines - n AS merged_lines FROM totals_s JOIN lt_s USING (source)"),
    ("vals_s", _of["vals"].replace("SELECT tag", "SELECT source, tag", 1).replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3")),
    ("grouped_s", _of["grouped"].replace("FROM vals", "FROM vals_s")),
    ("near_s", _of["near"].replace("SELECT a.tag", "SELECT a.source, a.tag", 1).replace("FROM grouped a JOIN grouped b ON", "FROM grouped_s a JOIN grouped_s b ON a.source = b.source AND")),
    ("pairs_s", _of["pairs"].replace("SELECT", "SELECT source,", 1).replace("FROM near", "FROM near_s")),
    ("variants_s", _of["variants"].replace("SELECT", "SELECT source,", 1).replace("FROM vals", "FROM vals_s")),
    ("aliases_s", _of["aliases"].replace("SELECT", "SELECT source,", 1).replace("FROM grouped", "FROM grouped_s").replace("GROUP BY tag", "GROUP BY source, tag")),
    ("found_s",
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, type, tag, members ORDER BY stage, position, reason) AS k FROM (SELECT * FROM kd0 UNION ALL SELECT * FROM kd1 UNION ALL SELECT "
        "* FROM variants_s UNION ALL SELECT * FROM aliases_s UNION ALL SELECT * FROM pairs_s)) WHERE k = 1"),
    ("offenders_s",
        "SELECT source, cost, first_line FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cost DESC, first_line) AS k FROM res WHERE NOT compliant) WHERE k <= 100"),
]
NAMES = [n for n, _ in CHAIN]


def sql(select: str) -> str:
    """select over the views of the chain that it needs."""
    need, todo = set(), [select]
    import re

    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for n, q in CHAIN:
            if n in words and n not in need:
                need.add(n)
                todo.append(q)
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in CHAIN if n in need) + "\n" + select


def classified(spark: SparkSession, d: str) -> DataFrame:
    return lines.classify_lines(tables.event_lines(spark, d), M)


def rolled(spark: SparkSession, d: str) -> DataFrame:
    return resources.resource_rollup(lines.kept_lines(classified(spark, d)), M)


def table(spark: SparkSession, d: str) -> DataFrame:
    return resources.resource_table(classified(spark, d), M)


def summary(spark: SparkSession, d: str) -> DataFrame:
    c = classified(spark, d)
    return coverage.audit_summary(c, resources.resource_table(c, M), M)


def _joined(df: DataFrame) -> DataFrame:
    """Arrays as text and decimals as doubles, for comparison by value."""
    out = df
    for c, kind in df.dtypes:
        if kind == "array<string>":
            out = out.withColumn(c, F.array_join(c, "|"))
        elif kind.startswith("decimal"):
            out = out.withColumn(c, F.col(c).cast("double"))
    return out


def _scalar(expr, column: str = "tag_team"):
    return lambda s, d: tables.event_lines(s, d).select("line_no", expr(F.col(column)).alias("value"))


RES = "rkey, id, service, cost::DOUBLE AS cost, line_items, first_line, array_to_string(missing, '|') AS missing, compliant"
RES_COLUMNS = ["rkey", "id", "service", "cost", "line_items", "first_line", "missing", "compliant"]
F_COLS = "type, tag, reason, array_to_string(members, '|') AS members, stage, position::BIGINT AS position"


def _res(f):
    return lambda s, d: _joined(f(table(s, d)).select(*RES_COLUMNS))


def _find(f):
    return lambda s, d: _joined(f(written(drift.tag_values(table(s, d), M))))


def _pair(f):
    return lambda s, d: f(written(drift.tag_values(table(s, d), M))).select("tag", "norm_a", "norm_b", "reason")


def _head(f):
    return lambda s, d: f(tables.event_headers(s, d), tables.event_cells(s, d))


def _jkeys(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    h, c = tables.event_headers(s, d), tables.event_cells(s, d)
    col = mapping.detect_json_tag_column(h, c).select("source", "position")
    return mapping.discover_json_keys(c.join(col, ["source", "position"]).select("source", "line", "value")), mapping.map_tags(h, c)


def _map_json(s: SparkSession, d: str) -> DataFrame:
    return mapping.map_json_tag_keys(*_jkeys(s, d))


def _unmapped(s: SparkSession, d: str) -> DataFrame:
    keys, tags = _jkeys(s, d)
    return mapping.unmapped_json_keys(keys, mapping.map_json_tag_keys(keys, tags))


def source_table(spark: SparkSession, d: str) -> DataFrame:
    """The audited resources of all exports."""
    return resources.resource_table(classified(spark, d), M, by=["source"])


def _all_drift(s: SparkSession, d: str) -> DataFrame:
    return _joined(drift.drift_findings(tables.event_headers(s, d), source_table(s, d), M, by=["source"]))


def _explore(s: SparkSession, d: str) -> DataFrame:
    return _joined(explore.explore_resources(table(s, d), text="res-1", status="non-compliant", tag="owner").select(*RES_COLUMNS, "matches"))


def _export(s: SparkSession, d: str) -> str:
    """Events as four CSV files in the shared folder, in order: quoted cells with quotes, a field too many on every tenth row, in the second file line breaks inside cells, in the third the columns in another order, and in the fourth one column less and one more."""
    path = shared_dir(s)
    props = F.when(F.col("event_id") % 4 == 1, F.concat("props", F.lit("\nsecond line"))).otherwise(F.col("props"))
    quoted = F.concat(F.lit('"'), F.replace(props, F.lit('"'), F.lit('""')), F.lit('"'))
    file, event, last = F.col("event_id") % 4, F.col("event_id").cast("string"), F.when(F.col("event_id") % 10 == 0, F.lit("7,extra")).otherwise("7")
    row = F.when(file == 2, F.concat_ws(",", event, quoted, last, "event_type")).when(file == 3, F.concat_ws(",", event, F.col("user_id").cast("string"), quoted, F.when(F.col("event_id") % 10 == 0, F.lit("x,extra")).otherwise("x")))
    row = row.otherwise(F.concat_ws(",", event, F.col("event_type"), quoted, last))
    # Every file begins with the header: it sorts first in each partition.
    body = s.read.parquet(f"{d}/events.parquet").select(file.alias("p"), F.lit(1).alias("o"), F.col("event_id").alias("id"), row.alias("value"))
    names = F.when(F.col("id") == 2, "Event Id, Props ,n,Type").when(F.col("id") == 3, "Event Id,User, Props ,Type").otherwise("Event Id,Type, Props ,n")
    head = s.range(4).select(F.col("id").alias("p"), F.lit(0).alias("o"), F.lit(0).cast("long").alias("id"), names.alias("value"))
    body.unionByName(head).repartition(4, "p").sortWithinPartitions("p", "o", "id").select("p", "value").write.partitionBy("p").text(path)
    return f"{path}/p=*"


def _read(s: SparkSession, d: str) -> DataFrame:
    good, _ = billing_csv.split_malformed(billing_csv.read_line_items(s, _export(s, d)))
    return good.select("line_no", F.col("c0").cast("long").alias("event_id"), F.col("c1").alias("type"), F.col("c2").alias("props"), F.col("c3").alias("n"), F.col("c4").alias("user"))


def _rejected(s: SparkSession, d: str) -> DataFrame:
    _, bad = billing_csv.split_malformed(billing_csv.read_line_items(s, _export(s, d)))
    return bad.select("line_no", F.col("c0").cast("long").alias("event_id"), F.regexp_extract("source", "p=([0-9])/", 1).alias("file"))


def _checks(s: SparkSession, d: str) -> DataFrame:
    """The guard's checks of the exported file, with a mapping that has no tag."""
    path = _export(s, d)
    good, _ = billing_csv.split_malformed(billing_csv.read_line_items(s, path))
    return billing_csv.input_checks(billing_csv.read_headers(s, path), good, M).unionByName(billing_csv.input_checks([], good.limit(0), Mapping()).withColumn("check", F.concat(F.lit("empty "), "check")))


def _report(s: SparkSession, d: str) -> DataFrame:
    """All ten parts of the report on all exports written as tables; the number of rows of each and the sum of its amounts, read again."""
    from costlens.jobs.audit import audit_tables

    parts = audit_tables(tables.event_lines(s, d), tables.event_headers(s, d), M, by=["source"])
    path = shared_dir(s)
    billing_csv.write_report(parts, path)
    amounts = {
        "summary": "total_cost", "coverage": "solo_recoverable_cost", "placeholders": "occurrences", "services": "total_cost",
        "resources": "cost", "offenders": "cost", "fix_first": "cost", "composition": "amount", "notes": "count", "drift": "stage"
    }
    total = lambda k: S.round2(F.sum(F.col(amounts[k]).cast("double")))
    back = billing_csv.read_report(s, path)
    return reduce(DataFrame.unionByName, [back[k].agg(F.count("*").alias("n"), total(k).alias("amount")).select(F.lit(k).alias("part"), "n", "amount") for k in amounts])


#: Columns of the exports that _exports writes: the canonical column and its header in exports 0, 1, and all others.
EXPORT_COLUMNS = [
    ("resource_id", "lineItem/ResourceId", "ResourceId", "Resource ID"), ("service", "product/ProductName", "MeterCategory", "Service"),
    ("provider", "ProviderName", "CSP", "Cloud"), ("region", "product/region", "ResourceLocation", "Region"),
    ("cost_raw", "lineItem/UnblendedCost", "PreTaxCost", "monthly_cost"), ("currency", "lineItem/CurrencyCode", "BillingCurrencyCode", "Currency"),
    ("charge_type", "lineItem/LineItemType", "ChargeType", "Charge Type"), ("tag_owner", "resourceTags/user:owner", "tags/owner", "Owner"),
    ("tag_team", "resourceTags/user:Team", "tags/squad", "Team"), ("tag_environment", "resourceTags/user:env", "tags/Environment", "label:stage"),
    ("tag_cost_center", "resourceTags/user:cost-center", "tags/CostCenter", "cost center"),
]


def _exports(s: SparkSession, d: str) -> str:
    """The seven exports of the events as a CSV file each, with headers of their own, the columns of the second in reverse order, and lines in order."""
    path, columns = shared_dir(s), [c[0] for c in EXPORT_COLUMNS]
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    row = lambda cells: F.concat_ws(",", *[quoted(c) for c in cells])
    second = F.col("source") == "export-1"
    value = F.when(second, row([F.col(c) for c in reversed(columns)])).otherwise(row([F.col(c) for c in columns]))
    body = tables.event_lines(s, d).select("source", "line_no", value.alias("value"))
    names = F.when(second, row([F.lit(c[2]) for c in reversed(EXPORT_COLUMNS)])).when(F.col("source") == "export-0", row([F.lit(c[1]) for c in EXPORT_COLUMNS]))
    head = body.select("source").distinct().select("source", F.lit(0).cast("long").alias("line_no"), names.otherwise(row([F.lit(c[3]) for c in EXPORT_COLUMNS])).alias("value"))
    both = body.unionByName(head).withColumn("p", F.col("source"))
    both.repartition("p").sortWithinPartitions("p", "line_no").select("p", "value").write.partitionBy("p").text(path)
    return f"{path}/p=*"


def _audit_exports(s: SparkSession, d: str) -> DataFrame:
    """The summaries of all exports, each mapped by itself."""
    from costlens.jobs.audit import audit_exports

    found = audit_exports(s, _exports(s, d))["summary"]
    return found.select(F.regexp_extract("source", "p=([^/]+)/", 1).alias("export"), *SUMMARIES)


SUMMARIES = [
    "total_rows", "analyzed_resources", "compliant_count", "total_cost", "unallocated_cost", "spend_score", "resource_score", "credit_count", "netted_count", "negative_count",
    "untaggable_count", "untaggable_cost", "cost_missing_count", "merged_lines", "placeholder_count", "placeholder_resources",
]


def _resources_csv(s: SparkSession, d: str) -> DataFrame:
    """The exported list written as CSV and read again."""
    t, path = table(s, d), shared_dir(s)
    billing_csv.write_resources_csv(t, path, TAGS, "USD")
    return _joined(billing_csv.read_resources_csv(s, path, billing_csv.resources_for_csv(t, TAGS, "USD").schema))


def _grades(s: SparkSession, d: str) -> DataFrame:
    score = (F.col("value") * 10 % 100).alias("score")
    return s.read.parquet(f"{d}/events.parquet").select(
        "event_id", S.grade(score).alias("grade"), S.grade_label(S.grade(score), "spend").alias("spend_label"),
        S.grade_label(S.grade(score), "resource").alias("resource_label")
    )


def _labels(labels: dict[str, str], g: str) -> str:
    return f"CASE {g} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + " END"


def _best(s: SparkSession, d: str) -> DataFrame:
    """The best header of each role, and the best filled column of each source."""
    h, c = tables.event_headers(s, d), tables.event_cells(s, d)
    filled = mapping.best_per_group(h.join(mapping.column_fill_counts(c), ["source", "position"]), ["source"], F.desc("filled"), "position")
    return mapping.map_roles(h).select("source", F.col("role").alias("name"), "position", "header").unionByName(filled.select("source", F.lit("filled").alias("name"), "position", "header"))


#: Rows of the exported files, numbered file after file.
POSITIONS = "SELECT *, row_number() OVER (ORDER BY event_id % 4, event_id) AS line_no FROM events"
#: The parts of the report on all exports: rows and the sum of an amount.
SOLO = " UNION ALL ".join(f"SELECT {r2('coalesce(sum(cost) FILTER (missing = [' + repr(k) + ']), 0)')} AS s FROM res GROUP BY source" for k in TAGS)
SERVICES = "SELECT source, coalesce(service, '(no service)') AS service, floor(sum(cost)::DOUBLE * 100 + 0.5) / 100 AS total_cost FROM res GROUP BY 1, 2"
PARTS = "SELECT unnest(['allocatable', 'unallocated', 'untaggable']) AS part, unnest([greatest(0, total_cost - unallocated_cost), unallocated_cost, greatest(0, untaggable_cost)]) AS amount FROM summary_s"
NOTES = "SELECT unnest([untaggable_count, credit_count, netted_count, negative_count, cost_missing_count, merged_lines]) AS count FROM summary_s"
FIRST = "SELECT cost FROM (SELECT cost, row_number() OVER (PARTITION BY source ORDER BY cost DESC, first_line) AS k FROM offenders_s WHERE cost >= 0.01) WHERE k <= 20"
REPORT = " UNION ALL ".join(f"SELECT '{part}' AS part, count(*) AS n, {r2(f'sum({amount})')} AS amount FROM ({q}) AS q" for part, amount, q in [
    ("summary", "total_cost", "SELECT total_cost FROM summary_s"), ("coverage", "s", SOLO),
    ("placeholders", "occurrences", "SELECT source, value, count(*) AS occurrences FROM holders GROUP BY 1, 2"), ("services", "total_cost", SERVICES),
    ("resources", "cost", "SELECT cost FROM res"), ("offenders", "cost", "SELECT cost FROM offenders_s"), ("fix_first", "cost", FIRST),
    ("composition", "amount", f"SELECT {r2('amount')} AS amount FROM ({PARTS}) WHERE amount > 0"), ("notes", "count", f"SELECT count FROM ({NOTES}) WHERE count > 0"),
    ("drift", "stage", "SELECT stage FROM found_s"),
])
G = grade("(value * 10 % 100)")
Q: dict[str, tuple] = {
    "to_canonical": (lambda s, d: tables.event_lines(s, d), sql("SELECT * FROM lines")),
    "normalize_header": (
        _head(lambda h, c: h.select("source", "position", S.normalize_header(F.col("header")).alias("value"))),
        sql("SELECT source, position, norm AS value FROM forms")
    ),
    "strip_tag_prefix": (
        _head(lambda h, c: h.select("source", "position", S.strip_tag_prefix(F.col("header")).alias("value"))),
        sql(f"SELECT source, position, {stripped_prefix('header')} AS value FROM headers")
    ),
    "normalize_value": (_scalar(S.normalize_value), sql(f"SELECT line_no, {norm('tag_team')} AS value FROM lines")),
    "is_null_token": (_scalar(S.is_null_token), sql(f"SELECT line_no, {norm('tag_team')} IN ({NULLS}) AS value FROM lines")),
    "is_placeholder": (_scalar(S.is_placeholder, "tag_environment"), sql(f"SELECT line_no, {norm('tag_environment')} IN ({HELD}) AS value FROM lines")),
    "parse_cost": (_scalar(lambda c: S.parse_cost(c).cast("double"), "cost_raw"), sql("SELECT line_no, cost::DOUBLE AS value FROM parsed")),
    "normalize_currency": (_scalar(S.normalize_currency, "currency"), sql(
        "SELECT line_no, CASE WHEN upper(trim(currency)) NOT IN ('', 'N/A', '-', 'NULL', 'NONE') THEN upper(trim(currency)) END AS value "
        "FROM lines")),
    "is_untaggable_charge": (_scalar(S.is_untaggable_charge, "charge_type"), sql("SELECT line_no, untaggable AS value FROM routed")),
    "parse_tag_object": (_scalar(lambda c: F.array_join(F.array_sort(F.map_keys(S.parse_tag_object(c))), "|"), "tags_json"), sql(
        f"SELECT line_no, CASE WHEN {JSON} IS NOT NULL AND json_valid({JSON}) THEN array_to_string(list_sort(json_keys({JSON})), '|') END "
        f"AS value FROM lines")),
    "tag_from_json": (_scalar(lambda c: S.tag_from_json(S.parse_tag_object(c), "cc"), "tags_json"), sql(f"SELECT line_no, {CC} AS value FROM lines")),
    "round2": (
        lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", S.round2(F.col("value") / 7 - 20).alias("value")),
        f"SELECT event_id, {r2('value / 7 - 20')} AS value FROM events"
    ),
    "pct": (
        lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", S.pct(F.col("value"), F.col("user_id")).alias("value")),
        f"SELECT event_id, {pct('value', 'user_id')} AS value FROM events"
    ),
    "grade": (_grades,
        f"SELECT event_id, {G} AS grade, {_labels(SPEND_LABELS, G)} AS spend_label, {_labels(RESOURCE_LABELS, G)} AS resource_label FROM "
        f"events"),
    "display_id": (lambda s, d: table(s, d).select(
        "rkey",
        S.display_id(F.concat("id", F.when(F.col("first_line") % 3 == 0, F.repeat(F.lit("xy"), F.lit(40))).otherwise(""))).alias("value")
    ), sql(
        "SELECT rkey, CASE WHEN regexp_matches(i, '^row-[0-9]+$') THEN '(no resource id — line ' || i[5:] || ')' WHEN length(i) > 64 THEN "
        "i[:26] || '…' || right(i, 34) ELSE i END AS value FROM (SELECT rkey, id || CASE WHEN first_line % 3 = 0 THEN repeat('xy', 40) "
        "ELSE '' END AS i FROM res)")),
    "token_set": (_scalar(lambda c: F.array_join(S.token_set(c), "|")), sql(
        "SELECT line_no, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(tag_team, '[\\s\\-_./]+'), lambda x: x <> "
        "''))), '|') AS value FROM lines")),
    "digit_skeleton": (_scalar(S.digit_skeleton), sql("SELECT line_no, regexp_replace(tag_team, '[0-9]+', '#', 'g') AS value FROM lines")),
    "levenshtein": (
        lambda s,
        d: tables.event_lines(s, d).select("line_no", S.levenshtein(F.col("tag_team"), F.col("tag_environment"), of_bytes=True).cast("long").alias("value")),
        sql("SELECT line_no, levenshtein(tag_team, tag_environment) AS value FROM lines")
    ),
    "classify_lines": (
        lambda s, d: classified(s, d).select("line_no", "bucket", "rkey", "has_id", F.col("cost").cast("double").alias("cost")),
        sql("SELECT line_no, bucket, rkey, has_id, cost::DOUBLE AS cost FROM classified")
    ),
    "resource_key": (lambda s, d: classified(s, d).select("line_no", "rkey"), sql("SELECT line_no, rkey FROM classified")),
    "cost_missing_flag": (lambda s, d: classified(s, d).select("line_no", "cost_missing"), sql("SELECT line_no, cost_missing FROM classified")),
    "line_totals": (lambda s, d: lines.line_totals(classified(s, d)), sql("SELECT * FROM lt")),
    "currency_inventory": (lambda s, d: lines.currency_inventory(tables.event_lines(s, d)), sql("SELECT currency FROM cur WHERE currency IS NOT NULL")),
    "currency_guard": (lambda s, d: lines.currency_guard(tables.event_lines(s, d)), sql("SELECT * FROM curs")),
    "resource_rollup": (lambda s, d: rolled(s, d).withColumn("cost", F.col("cost").cast("double")), sql("SELECT * EXCLUDE (source) REPLACE (cost::DOUBLE AS cost) FROM rolled")),
    "resolve_tags": (lambda s, d: resources.resolve_tags(lines.kept_lines(classified(s, d)), M), sql("SELECT * FROM resolved")),
    "first_seen": (lambda s, d: resources.first_seen(lines.kept_lines(classified(s, d)), M), sql("SELECT rkey, id, provider, region, first_line FROM rolled")),
    "dominant_service": (lambda s, d: resources.dominant_service(lines.kept_lines(classified(s, d)), M), sql("SELECT * FROM dominant")),
    "clamp_and_round": (
        lambda s, d: _joined(resources.clamp_and_round(rolled(s, d)).select("rkey", "cost", "negative")),
        sql("SELECT rkey, cost::DOUBLE AS cost, negative FROM clamped")
    ),
    "compliance": (_res(lambda t: t), sql(f"SELECT {RES} FROM res")),
    "audit_summary": (summary, sql("SELECT * FROM summary")),
    "spend_score": (
        lambda s, d: coverage.spend_score(table(s, d), M),
        sql(f"SELECT spend AS spend_score, {grade('spend')} AS grade, {_labels(SPEND_LABELS, grade('spend'))} AS label FROM scores")
    ),
    "resource_score": (lambda s, d: coverage.resource_score(table(s, d), M), sql(
        f"SELECT resource AS resource_score, {grade('resource')} AS grade, {_labels(RESOURCE_LABELS, grade('resource'))} AS label FROM "
        f"scores")),
    "grade_divergence": (lambda s, d: coverage.grade_divergence(table(s, d), M), sql(
        "SELECT spend AS spend_score, resource AS resource_score, coalesce(abs(spend - resource) >= 15, false) AS diverges, CASE WHEN "
        "spend - resource >= 15 THEN 'spend' WHEN resource - spend >= 15 THEN 'resources' END AS higher FROM scores")),
    "tag_coverage": (lambda s, d: coverage.tag_coverage(table(s, d), M), sql(" UNION ALL ".join(
        f"SELECT {i} AS position, '{k}' AS tag, '{lab}' AS label, {pct('w', 'n')} AS resource_pct, CASE WHEN total > 0 THEN "
        f"{pct('c', 'total')} END AS cost_pct, n - w AS missing_count, h AS placeholder_count, {r2('s')} AS solo_recoverable_cost FROM "
        f"(SELECT count(*) AS n, sum(cost) AS total, count(*) FILTER (NOT list_contains(missing, '{k}')) AS w, coalesce(sum(cost) FILTER "
        f"(NOT list_contains(missing, '{k}')), 0) AS c, count(*) FILTER ({norm(k)} IN ({HELD})) AS h, coalesce(sum(cost) FILTER (missing = "
        f"['{k}']), 0) AS s FROM res)" for i, (k, lab, _) in enumerate(DEFAULT_TAGS)))),
    "solo_recoverable": (
        lambda s, d: coverage.solo_recoverable(table(s, d)),
        sql(f"SELECT missing[1] AS tag, {r2('sum(cost)')} AS solo_cost FROM res WHERE len(missing) = 1 GROUP BY 1")
    ),
    "placeholder_values": (
        lambda s, d: coverage.placeholder_values(table(s, d), M),
        sql("SELECT value, count(*) AS occurrences, count(DISTINCT rkey) AS resources FROM holders GROUP BY 1")
    ),
    "placeholder_totals": (lambda s, d: coverage.placeholder_totals(table(s, d), M), sql("SELECT * FROM held")),
    "service_breakdown": (lambda s, d: coverage.service_breakdown(table(s, d)), sql(
        f"SELECT coalesce(service, '(no service)') AS service, {r2('sum(cost)')} AS total_cost, "
        f"{r2('coalesce(sum(cost) FILTER (NOT compliant), 0)')} AS unallocated_cost, count(*) AS resource_count, count(*) FILTER (NOT "
        f"compliant) AS non_compliant_count FROM res GROUP BY 1")),
    "spend_composition": (lambda s, d: coverage.spend_composition(summary(s, d)), sql(
        f"SELECT part, {r2('amount')} AS amount, {pct('amount', 'whole')} AS share FROM (SELECT part, amount, sum(amount) OVER () AS whole "
        f"FROM (SELECT unnest(['allocatable', 'unallocated', 'untaggable']) AS part, unnest([greatest(0, total_cost - unallocated_cost), "
        f"unallocated_cost, greatest(0, untaggable_cost)]) AS amount FROM summary)) WHERE amount > 0 AND whole > 0")),
    "data_quality_notes": (lambda s, d: coverage.data_quality_notes(summary(s, d)), sql(
        "SELECT * FROM (SELECT unnest(['untaggable', 'credits', 'netted', 'negative_resources', 'cost_missing', 'merged_lines']) AS note, "
        "unnest([untaggable_count, credit_count, netted_count, negative_count, cost_missing_count, merged_lines]) AS count, "
        "unnest([untaggable_cost, credit_total, NULL, NULL, NULL, NULL]) AS amount FROM summary) WHERE count > 0")),
    "top_offenders": (_res(explore.top_offenders), sql(f"SELECT {RES} FROM res WHERE NOT compliant ORDER BY res.cost DESC, first_line LIMIT 100")),
    "top_resources": (_res(explore.top_resources), sql(f"SELECT {RES} FROM res ORDER BY res.cost DESC, first_line LIMIT 5000")),
    "fix_first": (lambda s, d: _joined(explore.fix_first(table(s, d)).select(*RES_COLUMNS, "negligible")), sql(
        f"SELECT {RES}, (SELECT count(*) FILTER (cost < 0.01) FROM (SELECT cost FROM res WHERE NOT compliant ORDER BY cost DESC, first_line "
        f"LIMIT 100)) AS negligible FROM res WHERE NOT compliant AND res.cost >= 0.01 ORDER BY res.cost DESC, first_line LIMIT 20")),
    "report_offenders": (_res(explore.report_offenders), sql(f"SELECT {RES} FROM res WHERE NOT compliant ORDER BY res.cost DESC, first_line LIMIT 10")),
    "search_resources": (
        _res(lambda t: explore.search_resources(t, " ES-2")),
        sql(f"SELECT {RES} FROM res WHERE contains(lower(id), 'es-2') OR contains(lower(coalesce(service, '')), 'es-2')")
    ),
    "search_index": (
        lambda s, d: _joined(ResourceIndex.build(table(s, d), shared_dir(s), 200).search(" ES-2").select(*RES_COLUMNS)),
        sql(f"SELECT {RES} FROM res WHERE contains(lower(id), 'es-2') OR contains(lower(coalesce(service, '')), 'es-2')")
    ),
    "filter_status": (_res(lambda t: explore.filter_status(t, "compliant")), sql(f"SELECT {RES} FROM res WHERE compliant")),
    "filter_missing_tag": (_res(lambda t: explore.filter_missing_tag(t, "owner")), sql(f"SELECT {RES} FROM res WHERE list_contains(res.missing, 'owner')")),
    "filter_service": (_res(lambda t: explore.filter_service(t, "(no service)")), sql(f"SELECT {RES} FROM res WHERE service IS NULL")),
    "sort_resources": (_res(lambda t: explore.sort_resources(t, "id", False)), sql(f"SELECT {RES} FROM res ORDER BY id, first_line")),
    "list_services": (lambda s, d: explore.list_services(table(s, d)), sql("SELECT DISTINCT coalesce(service, '(no service)') AS service FROM res")),
    "explore_resources": (_explore, sql(
        f"SELECT {RES}, count(*) OVER () AS matches FROM res WHERE contains(lower(id), 'res-1') AND NOT compliant AND "
        f"list_contains(res.missing, 'owner') ORDER BY res.cost DESC, first_line LIMIT 200")),
    "write_resources_csv": (
        _resources_csv,
        sql("SELECT id AS resource_id, coalesce(service, '') AS service, cost::DOUBLE AS \"cost_USD\", line_items, " + ", ".join(f"CASE WHEN list_contains(missing, '{k}') THEN '' ELSE {k} END AS {k}" for k in TAGS) + " FROM res")
    ),
    "write_report": (_report, sql(REPORT)),
    # The exports have no JSON column, so no value of one is offered.
    "audit_exports": (_audit_exports, sql(
        f"SELECT source AS export, total_rows, n AS analyzed_resources, ok AS compliant_count, total::DOUBLE AS total_cost, {r2('total - okc')} AS unallocated_cost, CASE WHEN total > 0 THEN "
        f"{pct('okc', 'total')} END AS spend_score, {pct('ok', 'n')} AS resource_score, credit_count, netted_count, negatives AS negative_count, untaggable_count, {r2('untaggable_cost')} AS untaggable_cost, "
        "cost_missing_count, kept_lines - n AS merged_lines, coalesce(occurrences, 0) AS placeholder_count, coalesce(resources, 0) AS placeholder_resources FROM totals_s JOIN lt_s USING (source) LEFT JOIN "
        "(SELECT source, count(*) AS occurrences, count(DISTINCT rkey) AS resources FROM holders GROUP BY source) USING (source)"
    ).replace("SELECT rkey, line_no * 2 AS n, 'cost_center' AS tag, json_cc AS v FROM kept WHERE json_cc IS NOT NULL UNION ALL SELECT rkey, line_no * 2 + 1, 'owner', tag_owner FROM kept",
              "SELECT rkey, line_no * 2 + 1 AS n, 'owner' AS tag, tag_owner AS v FROM kept")),
    "key_drift_normalized": (lambda s, d: _joined(drift.key_drift_normalized(tables.event_headers(s, d))), sql(f"SELECT source, {F_COLS} FROM kd0")),
    "key_drift_synonyms": (lambda s, d: _joined(drift.key_drift_synonyms(tables.event_headers(s, d))), sql(f"SELECT source, {F_COLS} FROM kd1")),
    "value_drift_variants": (_find(drift.value_drift_variants), sql(f"SELECT {F_COLS} FROM variants")),
    "value_drift_env_aliases": (_find(drift.value_drift_env_aliases), sql(f"SELECT {F_COLS} FROM aliases")),
    "value_drift_token_order": (_pair(drift.value_drift_token_order), sql("SELECT tag, norm_a, norm_b, 'same words, different order' AS reason FROM near WHERE r0")),
    "value_drift_prefix": (_pair(drift.value_drift_prefix), sql("SELECT tag, norm_a, norm_b, 'one is a prefix of the other' AS reason FROM near WHERE r1")),
    "value_drift_typo": (_pair(drift.value_drift_typo), sql("SELECT tag, norm_a, norm_b, 'differs by one character' AS reason FROM near WHERE r2")),
    "value_drift_pairs": (_find(drift.value_drift_pairs), sql(f"SELECT {F_COLS} FROM pairs")),
    "drift_findings": (_all_drift, sql(f"SELECT source, {F_COLS} FROM found_s")),
    "earliest_finding": (lambda s, d: _joined(drift.earliest_finding(
        drift.key_drift_normalized(tables.event_headers(s, d)).unionByName(drift.key_drift_synonyms(tables.event_headers(s, d))),
        ["source", "members"]
    )), sql(
        f"SELECT source, {F_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY source, members ORDER BY stage, position, reason) AS k "
        f"FROM (SELECT * FROM kd0 UNION ALL SELECT * FROM kd1)) WHERE k = 1")),
    "map_roles": (_head(lambda h, c: mapping.map_roles(h)), sql("SELECT * FROM roles")),
    "best_per_group": (_best, sql(
        "SELECT source, role AS name, position, header FROM roles UNION ALL SELECT source, 'filled', position, header FROM (SELECT "
        "h.source, h.position, header, row_number() OVER (PARTITION BY h.source ORDER BY filled DESC, h.position) AS k FROM headers h JOIN "
        "fill USING (source, position)) WHERE k = 1")),
    "map_tags": (_head(lambda h, c: mapping.map_tags(h, c)), sql("SELECT * FROM tagged")),
    "column_fill_counts": (_head(lambda h, c: mapping.column_fill_counts(c)), sql("SELECT * FROM fill")),
    "detect_json_tag_column": (_head(mapping.detect_json_tag_column), sql("SELECT * FROM jcol")),
    "discover_json_keys": (lambda s, d: _jkeys(s, d)[0].select("source", "key"), sql("SELECT source, key FROM jkeys")),
    "map_json_tag_keys": (_map_json, sql("SELECT * FROM jmap")),
    "unmapped_json_keys": (_unmapped, sql("SELECT source, key FROM jkeys EXCEPT SELECT source, key FROM jmap")),
    "classify_preset": (_head(lambda h, c: mapping.classify_preset(h)), sql(
        "SELECT source, CASE WHEN bool_or(norm = 'billedcost') AND bool_or(norm IN ('chargecategory', 'providername')) THEN 'focus' WHEN "
        "bool_or(norm LIKE 'lineitem%') THEN 'aws-cur' WHEN bool_or(norm IN ('metercategory', 'pretaxcost', 'costinbillingcurrency', "
        "'resourcelocation')) THEN 'azure-cost-mgmt' WHEN bool_or(norm IN ('unblendedcost', 'amortizedcost')) THEN 'aws-cost-explorer' "
        "ELSE 'generic' END AS preset FROM forms GROUP BY source")),
    "mapping_confidence": (_head(mapping.mapping_confidence), sql(
        "SELECT s.source, floor((coalesce((SELECT max(0.3::DOUBLE) FROM roles r WHERE r.source = s.source AND role = 'resourceId'), 0) + "
        "coalesce((SELECT max(0.3::DOUBLE) FROM roles r WHERE r.source = s.source AND role = 'cost'), 0) + 0.4::DOUBLE * ((SELECT count(*) "
        "FROM tagged t WHERE t.source = s.source)::DOUBLE / 4)) * 100 + 0.5) / 100 AS confidence FROM (SELECT DISTINCT source FROM "
        "headers) s")),
    "read_line_items": (_read,
        f"""SELECT line_no, event_id, CASE WHEN event_id % 4 = 3 THEN 'x' ELSE event_type END AS type, CASE WHEN event_id % 4 = 1 THEN props || chr(10) || 'second line' ELSE props END AS """
        f"""props, CASE WHEN event_id % 4 <> 3 THEN '7' END AS n, CASE WHEN event_id % 4 = 3 THEN user_id::VARCHAR END AS "user" FROM ({POSITIONS}) WHERE event_id % 10 <> 0"""),
    "split_malformed": (_rejected, f"SELECT line_no, event_id, (event_id % 4)::VARCHAR AS file FROM ({POSITIONS}) WHERE event_id % 10 = 0"),
    "input_guard": (_checks,
        "SELECT 'header' AS \"check\", true AS passed UNION ALL SELECT 'tags', true UNION ALL SELECT 'rows', count(*) > 0 FROM events "
        "WHERE event_id % 10 <> 0 UNION ALL SELECT 'empty header', false UNION ALL SELECT 'empty tags', false UNION ALL SELECT 'empty "
        "rows', count(*) < 0 FROM events"),
    "sample_lines": (
        lambda s, d: billing_csv.sample_lines(tables.event_lines(s, d)).select("line_no", "resource_id"),
        sql("SELECT line_no, resource_id FROM lines ORDER BY line_no LIMIT 500")
    ),
    "volume_rollup": (lambda s, d: _joined(resources.resource_rollup(
        lines.kept_lines(lines.classify_lines(tables.lineitem_lines(s, d), tables.VOLUME_MAPPING)), tables.VOLUME_MAPPING
    ).select("rkey", "cost", "line_items", "environment")),
        "SELECT concat('part-', l_partkey) AS rkey, sum(CAST(CAST(l_extendedprice AS STRING) AS DECIMAL(38,12)))::DOUBLE AS cost, count(*) "
        "AS line_items, CASE WHEN bool_or(l_returnflag <> 'R') THEN 'prod' ELSE 'n/a' END AS environment FROM lineitem GROUP BY 1"),
}
QUERIES = {k: q for k, (q, _) in Q.items()}
SQL = {k: q for k, (_, q) in Q.items()}
