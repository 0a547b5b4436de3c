"""Finding roles and tags in headers: joins of a header catalogue (source, position, header) with synonym tables.

Many exports are mapped in one pass. Cells for the tie-break and the JSON column come as (source, line, position, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costlens.functions.policy import ROLE_SYNONYMS, Mapping, Policy
from costlens.functions.scalars import normalize_header, parse_tag_object, plain_header, strip_tag_prefix, stripped
from costlens.operators.drift import synonym_table

JSON_HEADERS = ["tags", "resourcetags", "labels"]


def role_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, i, s) for r, names in ROLE_SYNONYMS.items() for i, s in enumerate(names)], "role string, syn_rank int, norm string")


def header_forms(headers: DataFrame) -> DataFrame:
    return headers.select("source", "position", "header", normalize_header(F.col("header")).alias("norm"), normalize_header(strip_tag_prefix(F.col("header"))).alias("tag_norm"))


def best_per_group(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") == 1).drop("nth")


def map_roles(headers: DataFrame) -> DataFrame:
    """source, role, header: the first synonym that a header equals, of equal headers the first."""
    found = header_forms(headers).join(F.broadcast(role_table(headers.sparkSession)), "norm")
    return best_per_group(found, ["source", "role"], "syn_rank", "position").select("source", "role", "position", "header")


def column_fill_counts(cells: DataFrame) -> DataFrame:
    """source, position, filled: cells that are not blank."""
    return cells.groupBy("source", "position").agg(F.count_if(stripped(F.col("value")) != "").alias("filled"))


def map_tags(headers: DataFrame, cells: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """source, tag, header: of the headers without a role that name the tag the one with most filled cells, then the first. A header serves one tag: the first in policy order that takes it."""
    forms = _free(headers).select("source", "position", "header", F.explode(F.array_distinct(F.array("norm", "tag_norm"))).alias("synonym"))
    found = forms.join(F.broadcast(synonym_table(headers.sparkSession, policy)), "synonym").select("source", "tag", "tag_rank", "position", "header").distinct()
    found = found.join(column_fill_counts(cells), ["source", "position"], "left").fillna(0, ["filled"])
    best = lambda rows: best_per_group(rows, ["source", "tag"], F.desc("filled"), "position")
    if not _overlapping(policy):
        return best(found).select("source", "tag", "position", "header")
    # Tags in policy order, each from the headers that are left: one fold over a source's candidates, best first.
    kind = "array<struct<tag:string,position:int,header:string>>"
    candidates = F.array_sort(F.collect_list(F.struct("tag_rank", (-F.col("filled")).alias("empty"), "position", "header", "tag")))
    free = lambda chosen, x: ~F.exists(chosen, lambda c: (c.tag == x.tag) | (c.header == x.header))
    take = lambda chosen, x: F.when(free(chosen, x), F.concat(chosen, F.array(F.struct(x.tag.alias("tag"), x.position.alias("position"), x.header.alias("header"))))).otherwise(chosen)
    chosen = found.groupBy("source").agg(F.aggregate(candidates, F.array().cast(kind), take).alias("chosen"))
    return chosen.select("source", F.explode("chosen").alias("c")).select("source", "c.tag", "c.position", "c.header")


def _free(headers: DataFrame) -> DataFrame:
    """Forms of the headers that no role takes; a header of the same name as one that is taken is taken too."""
    return header_forms(headers).join(map_roles(headers).select("source", "header").distinct(), ["source", "header"], "left_anti")


def _overlapping(policy: Policy) -> bool:
    """Whether a header may name two tags: by one synonym of both, or by one that ends in another's, whose prefix may be stripped."""
    names = [set(map(plain_header, (t.key, *t.synonyms))) for t in policy.tags]
    return any(x.endswith(y) for i, a in enumerate(names) for j, b in enumerate(names) if i != j for x in a for y in b if y)


def _used(headers: DataFrame, cells: DataFrame, policy: Policy) -> DataFrame:
    return map_roles(headers).select("source", "header").unionByName(map_tags(headers, cells, policy).select("source", "header"))


def detect_json_tag_column(headers: DataFrame, cells: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """source, position, header of the first free tags column of whose filled cells at least half look like JSON."""
    free = header_forms(headers).where(F.col("norm").isin(JSON_HEADERS)).join(_used(headers, cells, policy), ["source", "header"], "left_anti")
    v = stripped(F.col("value"))
    filled = cells.where((v != "") & (F.lower(v) != "null")).groupBy("source", "position").agg(F.avg(F.when(v.startswith("{") | v.rlike(r'^"[^"]+"\s*:'), 1.0).otherwise(0.0)).alias("share"))
    found = free.join(filled.where(F.col("share") >= 0.5), ["source", "position"])
    return best_per_group(found, ["source"], "position").select("source", "position", "header")


def discover_json_keys(json_cells: DataFrame) -> DataFrame:
    """source, key, first (line of the first cell that has it, then place in it) over all cells (source, line, value)."""
    keys = json_cells.select("source", "line", F.posexplode(F.map_keys(parse_tag_object(F.col("value")))).alias("place", "key"))
    return keys.groupBy("source", "key").agg(F.min(F.struct("line", "place")).alias("first"))


def map_json_tag_keys(keys: DataFrame, tags: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """source, tag, key: for tags without a column of their own the first key that names them."""
    found = keys.withColumn("synonym", normalize_header(F.col("key"))).join(F.broadcast(synonym_table(keys.sparkSession, policy)), "synonym")
    found = found.join(tags.select("source", "tag"), ["source", "tag"], "left_anti")
    return best_per_group(found, ["source", "tag"], "first").select("source", "tag", "key")


def unmapped_json_keys(keys: DataFrame, mapped: DataFrame) -> DataFrame:
    return keys.select("source", "key").join(mapped.select("source", "key"), ["source", "key"], "left_anti")


def classify_preset(headers: DataFrame) -> DataFrame:
    """source, preset: which provider's export the headers are, the most telling first."""
    norms = header_forms(headers).groupBy("source").agg(F.collect_set("norm").alias("n"))
    has = lambda *names: F.arrays_overlap("n", F.array(*[F.lit(x) for x in names]))
    preset = (
        F.when(has("billedcost") & has("chargecategory", "providername"), "focus")
        .when(F.exists("n", lambda x: x.startswith("lineitem")), "aws-cur")
        .when(has("metercategory", "pretaxcost", "costinbillingcurrency", "resourcelocation"), "azure-cost-mgmt")
        .when(has("unblendedcost", "amortizedcost"), "aws-cost-explorer")
        .otherwise("generic")
    )
    return norms.select("source", preset.alias("preset"))


def mapping_confidence(headers: DataFrame, cells: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """source, confidence: 0.3 for the id, 0.3 for the cost, 0.4 times the share of mandatory tags with a column."""
    roles = map_roles(headers).groupBy("source").agg(F.max(F.when(F.col("role") == "resourceId", 0.3)).alias("i"), F.max(F.when(F.col("role") == "cost", 0.3)).alias("c"))
    tags = map_tags(headers, cells, policy).groupBy("source").agg(F.count("*").alias("t"))
    out = headers.select("source").distinct().join(roles, "source", "left").join(tags, "source", "left").fillna(0)
    return out.select("source", (F.floor((F.col("i") + F.col("c") + F.lit(0.4) * (F.col("t") / max(1, len(policy.tags)))) * 100 + 0.5) / 100).alias("confidence"))


def detect_mapping(headers: DataFrame, cells: DataFrame, source: str, policy: Policy = Policy()) -> Mapping:
    """The mapping of one source, for the driver: some ten names."""
    h, c = headers.where(F.col("source") == source), cells.where(F.col("source") == source)
    roles = {r["role"]: r["header"] for r in map_roles(h).collect()}
    tags = map_tags(h, c, policy)
    columns = {r["tag"]: r["header"] for r in tags.collect()}
    js = detect_json_tag_column(h, c, policy).first()
    if js is None:
        return Mapping(roles, columns)
    keys = discover_json_keys(c.where(F.col("position") == js["position"]).select("source", "line", "value"))
    return Mapping(roles, columns, js["header"], {r["tag"]: r["key"] for r in map_json_tag_keys(keys, tags, policy).collect()})
