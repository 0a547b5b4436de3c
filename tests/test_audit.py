"""Small cases of the audit with known results, the sample exports, and the registered queries against their SQL."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from costlens.functions import scalars as S
from costlens.functions.policy import Mapping, Policy, Tag
from costlens.jobs.audit import audit_csv, audit_exports, audit_tables
from costlens.jobs.queries import Q
from costlens.operators import coverage, drift, lines, mapping, resources
from costlens.sources import billing_csv

SF = "/root/testdata/sf0.001"
M = Mapping({r: r for r in ("resourceId", "service", "provider", "region", "cost", "currency")}, {k: k for k in ("owner", "team", "environment", "cost_center")})


def bills(spark, rows, how=M):
    """rows: (id, service, cost, owner, team, environment, cost center)."""
    data = [(i + 1, r[0], r[1], None, None, r[2], None, None, *r[3:], None) for i, r in enumerate(rows)]
    names = ["line_no", *lines.ROLES, "tag_owner", "tag_team", "tag_environment", "tag_cost_center", "tags_json"]
    return spark.createDataFrame(data, ", ".join(f"{n} {'long' if n == 'line_no' else 'string'}" for n in names))


def table(spark, rows, how=M):
    c = lines.classify_lines(bills(spark, rows), how)
    t = resources.resource_table(c, how)
    return c, t


def test_parse_cost(spark):
    cases = {
        "$1,234.56": 1234.56, "1.234,56": 1234.56, "(123.45)": -123.45, "-5": -5, "$-5": 5, "5-": 5, "1.5E-5": 1.55, "5.": 5, ".5": 0.5,
        "1.2.3": None, "(-5)": -5, "12,5": 12.5, "1,234": 1234, "1,234,567": 1234567, "": None, " ": None, "abc": None, ".": None,
        ",": None, "USD 7": 7, None: None
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", S.parse_cost(F.col("t")).cast("double")).collect()
    assert {t: v for t, v in got} == cases


def test_plain_numbers_and_blanks(spark):
    """Plain numbers take a short way; the blanks stripped are ASCII's and Unicode's, at the ends only."""
    cases = {"12": 12.0, "-12.50": -12.5, " 12\n": 12.0, "\u00a012.5\u3000": 12.5, "12\n": 12.0, "1.5E-5": 1.55, "--5": 5.0 * -1, "-": None, "12.": 12.0}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select(
        "t", S.parse_cost(F.col("t")).cast("double"), S.stripped(F.concat(F.lit("\ufeff\x0b a b\u2009"), F.lit("\u2028")))
    ).collect()
    assert {r[0]: r[1] for r in got} == cases
    assert {r[2] for r in got} == {"a b"}


def test_null_tokens_and_currency(spark):
    df = spark.createDataFrame([(None,), ("",), (" N/A ",), ("test",), ("No Owner",), (" -",)], "t string")
    assert [r[0] for r in df.select(S.is_null_token(F.col("t"))).collect()] == [True, True, True, False, True, True]
    assert [r[0] for r in df.select(S.is_placeholder(F.col("t"))).collect()] == [False, False, True, False, True, True]
    assert [r[0] for r in spark.createDataFrame([(" eur ",), ("-",), (None,)], "t string").select(S.normalize_currency(F.col("t"))).collect()] == ["EUR", None, None]


def test_rounding_and_grades(spark):
    df = spark.createDataFrame([(1.005, 94.995), (-0.005, 95.0), (2.675, 49.99)], "a double, b double")
    assert [r[0] for r in df.select(S.round2(F.col("a"))).collect()] == [1.0, 0.0, 2.68]
    assert [r[0] for r in df.select(S.grade(S.round2(F.col("b")))).collect()] == ["A", "A", "F"]


def test_tag_object(spark):
    df = spark.createDataFrame([('{"a": "1"}',), ('"owner": "anna","env": "prod"',), ("null",), ("",), ("[1]",), ("{x",), (None,)], "t string")
    got = [r[0] for r in df.select(S.parse_tag_object(F.col("t"))).collect()]
    assert got[:2] == [{"a": "1"}, {"owner": "anna", "env": "prod"}] and not any(got[2:])


def test_resolution_netting_and_clamp(spark):
    rows = [
        ("R1", "a", "100", "", "t", "prod", "c"), ("r1", "b", "-30", "anna", "t", "prod", "c"), ("r1", "b", "x", "n/a", "t", "prod", "c"),
        ("r2", "", "10", "tbd", "t", "p", "c"), ("r2", "", "-50", "", "t", "p", "c"), ("n/a", "s", "-7", "o", "t", "p", "c"),
        ("", "s", "0", "o", "t", "p", "c")
    ]
    c, t = table(spark, rows)
    got = {r["rkey"]: r for r in t.collect()}
    assert set(got) == {"r1", "r2", "row-7"}
    assert (got["r1"]["id"], float(got["r1"]["cost"]), got["r1"]["owner"], got["r1"]["service"], got["r1"]["line_items"]) == ("R1", 70.0, "anna", "a", 3)
    assert (float(got["r2"]["cost"]), got["r2"]["negative"], got["r2"]["owner"], got["r2"]["missing"]) == (0.0, True, "tbd", ["owner"])
    s = coverage.audit_summary(c, t, M).first()
    assert (s["credit_count"], s["credit_total"], s["netted_count"], s["negative_count"], s["merged_lines"], s["cost_missing_count"]) == (1, -7.0, 2, 1, 3, 1)


def test_dominant_service_and_solo(spark):
    rows = [
        ("v", "Bandwidth", "5", "o", "t", "", "c"), ("v", "Virtual Machines", "100", "o", "t", "", "c"),
        ("v", "Storage", "2", "o", "t", "", "c"), ("w", "Storage", "9", "", "t", "", "c")
    ]
    _, t = table(spark, rows)
    assert {r["rkey"]: (r["service"], float(r["cost"])) for r in t.collect()} == {"v": ("Virtual Machines", 107.0), "w": ("Storage", 9.0)}
    assert [tuple(r) for r in coverage.solo_recoverable(t).collect()] == [("environment", 107.0)]


def test_drift(spark):
    teams = ["payments-team", "team-payments", "platform", "plaform", "CC-1042", "CC-1043", "n/a", "N/A", "prod", "production", "Platform"]
    _, t = table(spark, [(f"r{i}", "s", "1", "o", x, "prod" if i % 2 else "production", "c") for i, x in enumerate(teams)])
    found = drift.drift_findings(billing_csv.header_table(spark, ["env", "Environment", "tag:env", "owner"]), t, M).collect()
    assert {(r["tag"], tuple(r["members"])) for r in found} == {
        (None, ("env", "tag:env")), ("environment", ("Environment", "env", "tag:env")), ("team", ("Platform", "platform")),
        ("team", ("payments-team", "team-payments")), ("team", ("plaform", "platform")), ("environment", ("prod", "production"))
    }


def test_empty_input(spark):
    c, t = table(spark, [])
    s = coverage.audit_summary(c, t, M).first()
    assert (s["analyzed_resources"], s["resource_score"], s["spend_score"], s["resource_grade"]) == (0, 100.0, None, "A")
    assert coverage.tag_coverage(t, M).count() == 4


def test_presets_and_mapping(spark):
    azure = ["ResourceId", "MeterCategory", "ResourceLocation", "PreTaxCost", "tags/owner"]
    h = billing_csv.header_table(spark, azure)
    how = mapping.detect_mapping(h, spark.createDataFrame([], "source string, line long, position int, value string"), "file")
    assert how.roles == {"resourceId": "ResourceId", "service": "MeterCategory", "region": "ResourceLocation", "cost": "PreTaxCost"} and how.tag_columns == {"owner": "tags/owner"}
    assert mapping.classify_preset(h).first()["preset"] == "azure-cost-mgmt"


CUR = """lineItem/ResourceId,product/ProductName,product/region,lineItem/UnblendedCost,lineItem/CurrencyCode,lineItem/LineItemType,resourceTags/user:Owner,resourceTags/user:env,resourceTags/user:Team
i-1,Compute,eu-1,10.50,USD,Usage,anna,prod,web
I-1,Compute,eu-1,4.25,USD,Usage,,prod,web
i-2,Compute,eu-1,20,USD,Usage,n/a,production,web
vol-1,Storage,eu-2,2.5,USD,Usage,bob,dev,
,Support,,7.75,USD,Tax,,,
i-3,"Compute, spot",eu-1,1.00,USD,RIFee,anna,prod,web
,Credits,,-3.00,USD,Usage,,,
i-4,Storage,eu-1,-1,USD,Usage,eve,PROD,data
"""
FOCUS = '''BillingCurrency,ChargeCategory,BilledCost,ProviderName,RegionId,ResourceId,ServiceName,Tags
EUR,Usage,3.004,Cloud A,r1,db-1,Database,"{""owner"": ""kim"", ""cost-center"": ""CC-9"", ""app"": ""shop""}"
EUR,Usage,1.001,Cloud A,r1,db-1,Database,"{""owner"": ""kim""}"
EUR,Usage,6,Cloud B,r2,vm-1,Compute,"""owner"": ""lee"",""team"": ""ops"""
EUR,Purchase,9.99,Cloud B,r2,vm-1,Compute,
EUR,Usage,0.5,Cloud B,r2,vm-2,Compute,null
EUR,Usage,bad,Cloud B,r2,vm-3,Compute,"{""owner"": ""tbd"", ""costcenter"": ""1""}"
'''


def test_provider_exports(spark, tmp_path):
    parts = audit_csv(spark, write(tmp_path, "cur.csv", CUR))
    s = parts["summary"].first()
    assert (s["total_rows"], s["untaggable_count"], s["untaggable_cost"], s["credit_count"], s["netted_count"], s["negative_count"]) == (8, 2, 8.75, 1, 1, 1)
    assert (s["analyzed_resources"], s["merged_lines"], s["total_cost"], s["compliant_count"], s["unallocated_cost"]) == (4, 1, 37.25, 2, 22.5)
    assert (s["spend_score"], s["resource_score"], s["spend_grade"], s["resource_grade"]) == (39.6, 50.0, "F", "D")
    assert parts["preset"].first()["preset"] == "aws-cur" and parts["confidence"].first()["confidence"] == 0.9
    assert ("tag", "environment", "resourceTags/user:env", None) in map(tuple, parts["mapping"].collect()) and parts["unmapped_keys"].count() == 0
    told = {tuple(r["members"]): r["suggestion"] for r in parts["suggestions"].collect()}
    assert told[("PROD", "prod")] == 'Use one spelling of environment in place of "PROD", "prod" (case or format variants).' and ("prod", "production") in told

    parts = audit_csv(spark, write(tmp_path, "focus.csv", FOCUS))
    s = parts["summary"].first()
    assert (s["total_rows"], s["analyzed_resources"], s["merged_lines"], s["untaggable_count"], s["cost_missing_count"], s["currencies"]) == (6, 4, 1, 1, 1, "EUR")
    assert {(r["rkey"], tuple(r["missing"])) for r in parts["resources"].collect()} == {("db-1", ("team",)), ("vm-1", ("cost_center",)), ("vm-2", ("owner", "team", "cost_center")), ("vm-3", ("owner", "team", "cost_center"))}
    assert parts["preset"].first()["preset"] == "focus" and {r["key"] for r in parts["unmapped_keys"].collect()} == {"app", "costcenter"}
    assert {r["name"]: (r["header"], r["key"]) for r in parts["mapping"].where("kind = 'tag'").collect()} == {"owner": ("Tags", "owner"), "cost_center": ("Tags", "cost-center"), "team": ("Tags", "team")}


def test_many_exports_in_one_job(spark, tmp_path):
    """Each file with its own columns and mapping: every part as if it were audited alone; several currencies refuse one source, not all."""
    for name, text in (("cur.csv", CUR), ("focus.csv", FOCUS), ("mixed.csv", FOCUS + "USD,Usage,2,Cloud A,r1,db-2,Database,\n"), ("bare.csv", "Resource Id,note\nx-1,hello\n"), ("empty.csv", "Resource Id,Owner\n")):
        write(f"{tmp_path}/all", name, text)
    parts = audit_exports(spark, f"file://{tmp_path}/all")
    by = lambda rows: {k: sorted((str(sorted((c, v) for c, v in r.asDict().items() if c not in ("source", "mapped", "tracked", "first_line", "line_no", "position"))) for r in g)) for k, g in groups(rows)}

    def groups(rows):
        out = {}
        for r in rows:
            out.setdefault(os.path.basename(r["source"]), []).append(r)
        return out.items()

    got = {k: by(df.collect()) for k, df in parts.items() if k != "mapping"}
    for name in ("cur.csv", "focus.csv"):
        alone = audit_csv(spark, f"file://{tmp_path}/all/{name}")
        for part in ("summary", "coverage", "placeholders", "services", "composition", "notes", "offenders", "fix_first", "drift", "suggestions", "preset", "confidence", "resources"):
            one = alone[part]
            if part in ("resources", "offenders", "fix_first"):  # columns of tags that only other exports map
                one = one.select("*", *[F.lit(None).cast("string").alias(t) for t in ("owner", "team", "environment", "cost_center") if t not in one.columns])
            rows = [r.asDict() | {"source": name} for r in one.collect()]
            assert got[part].get(name, []) == by([Rec(r) for r in rows]).get(name, []), (name, part)
    summary = {os.path.basename(r["source"]): r for r in parts["summary"].collect()}
    assert set(summary) == {"cur.csv", "focus.csv", "mixed.csv", "bare.csv"}
    assert summary["mixed.csv"]["refused"] and summary["mixed.csv"]["currencies"] == "EUR,USD" and summary["mixed.csv"]["spend_score"] is None
    assert (summary["bare.csv"]["tracked"], summary["bare.csv"]["spend_score"], summary["bare.csv"]["cost_missing_count"], summary["cur.csv"]["tracked"]) == (0, None, 0, 3)


class Rec(dict):
    def asDict(self):
        return self


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return f"file://{folder}/{name}"


def test_a_failed_report_leaves_the_one_before(spark, tmp_path):
    path, one = f"file://{tmp_path}/report", spark.range(3)
    first = billing_csv.write_report({"a": one, "b": one}, path)
    broken = one.select(F.raise_error(F.lit("no more")).alias("id"))
    with pytest.raises(Exception, match="no more"):
        billing_csv.write_report({"a": spark.range(9), "b": broken}, path)
    assert {k: df.count() for k, df in billing_csv.read_report(spark, path).items()} == {"a": 3, "b": 3}
    billing_csv.write_report({"a": spark.range(9), "c": one}, path)
    assert {k: df.count() for k, df in billing_csv.read_report(spark, path).items()} == {"a": 9, "c": 3}
    assert billing_csv.read_report(spark, path, first)["a"].count() == 3
    with pytest.raises(ValueError, match="no report"):
        billing_csv.read_report(spark, path, "none")


def test_the_text_is_read_once(spark, tmp_path, monkeypatch):
    read, paths = type(spark.read).text, []
    monkeypatch.setattr(type(spark.read), "text", lambda self, path, **k: paths.append(path) or read(self, path, **k))
    parts = audit_csv(spark, write(tmp_path, "cur.csv", CUR))
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in parts.values()]
    assert len(paths) == 1 and not any("cur.csv" in p or "Relation [value" in p for p in plans)
    # The parts come from tables: none but the rejected rows goes back to the lines as they were read.
    assert not any("split_cells" in p or "num0" in p for k, p in zip(parts, plans, strict=True) if k != "rejected")


def test_same_answer_in_any_order_and_partitioning(spark):
    from costlens.sources import tables

    one = tables.event_lines(spark, SF)
    how = tables.EVENT_MAPPING
    rows = lambda df: sorted(map(str, resources.resource_table(lines.classify_lines(df, how), how).collect()))
    assert rows(one.coalesce(1)) == rows(one.orderBy(F.desc("cost_raw")).repartition(7))


@pytest.fixture(scope="module")
def db():
    import duckdb

    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return db


@pytest.mark.parametrize("name", sorted(Q))
def test_query_against_sql(spark, db, name):
    query, sql = Q[name]
    got, want = query(spark, SF).toPandas(), db.sql(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    flat = lambda d: sorted(map(tuple, d[cols].astype(str).values.tolist()))
    assert flat(got) == flat(want) and len(got)


def test_edit_distance_of_odd_texts_against_sql(spark, db, monkeypatch):
    """The query counts bytes, as its SQL does, and the operator by itself characters."""
    from costlens.sources import tables

    texts = ["", " ", "\u00a0", "e", "\u00e9", "\u00ea", "e\u0301", "Platform\u00a0 ", "\u00a0 prod", "PROD", "\u00c2\u00a0", "\u65e5\u672c", "\u65e5", "\U0001f600", "\U0001f601x", "a\0b", "\x7f\u0080\u00ff", "\ufffd", "x" * 300 + "\u00e9", None]
    pairs = [(i * len(texts) + k, a, b) for i, a in enumerate(texts) for k, b in enumerate(texts)]
    odd = spark.createDataFrame(pairs, "line_no long, tag_team string, tag_environment string")
    monkeypatch.setattr(tables, "event_lines", lambda s, d: odd)
    query, sql = Q["levenshtein"]
    cells = ", ".join(["(?, ?, ?)"] * len(pairs))
    want = db.execute(f"WITH lines(line_no, tag_team, tag_environment) AS (VALUES {cells}) {sql.splitlines()[-1]}", [x for p in pairs for x in p]).fetchall()
    got = {r.line_no: r.value for r in query(spark, SF).collect()}
    assert got == dict(want) and None in got.values()
    chars = odd.where("tag_team = '\u00e9' AND tag_environment = 'e' OR tag_team = 'Platform\u00a0 ' AND tag_environment = 'PROD'")
    assert [r[0] for r in chars.orderBy("line_no").select(S.levenshtein(F.col("tag_team"), F.col("tag_environment"))).collect()] == [1, 9]


def test_report_parts(spark):
    from costlens.sources import tables

    parts = audit_tables(tables.event_lines(spark, SF), tables.event_headers(spark, SF), tables.EVENT_MAPPING)
    assert parts["summary"].count() == 1 and parts["fix_first"].count() <= 20 and parts["offenders"].count() <= 100


@pytest.mark.parametrize("name", ["write_report", "write_resources_csv"])
def test_written_parts_against_sql(spark, db, name, monkeypatch):
    paths, one = [], billing_csv.write_report if name == "write_report" else billing_csv.write_resources_csv
    monkeypatch.setattr(billing_csv, name, lambda data, path, *a: paths.append(path) or one(data, path, *a))
    test_query_against_sql(spark, db, name)
    written = os.listdir(paths[0].removeprefix("file://"))
    if name == "write_report":
        assert sorted(written) == ["manifest", "parts"]
        versions = os.listdir(f"{paths[0].removeprefix('file://')}/parts")
        written = os.listdir(f"{paths[0].removeprefix('file://')}/parts/{versions[0]}")
        assert len(versions) == 1 and sorted(written) == ["composition", "coverage", "drift", "fix_first", "notes", "offenders", "placeholders", "resources", "services", "summary"]
    else:
        assert any(w.endswith(".csv") for w in written)


def test_resources_csv_keeps_cells(spark, tmp_path):
    rows = [(" a ", '5" disk, "b"', 1.5, 2, [], "two\nlines", " x"), ("b", None, 0.25, 1, ["team"], "t", "n/a")]
    t = spark.createDataFrame(rows, "id string, service string, cost double, line_items long, missing array<string>, owner string, team string")
    billing_csv.write_resources_csv(t, f"file://{tmp_path}/r", ["owner", "team"], "USD")
    want = billing_csv.resources_for_csv(t, ["owner", "team"], "USD")
    got = billing_csv.read_resources_csv(spark, f"file://{tmp_path}/r", want.schema)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.dtypes == want.dtypes


HEADER = "Resource Id,Service,Cost,Currency,Owner,Team,Environment,Cost Center"


def bill(tmp_path, *rows, name="bill.csv", header=HEADER, end="\n", bom=""):
    with open(f"{tmp_path}/{name}", "w", newline="", encoding="utf-8") as f:
        f.write(bom + end.join([header, *rows]) + end)
    return f"file://{tmp_path}/{name}"


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = bill(tmp_path, 'r1,"multi\nline",10,USD,anna,t,prod,c', 'r2,"a ""b"", c",5,USD,,t,prod,c')
    assert billing_csv.has_open_quotes(spark, path)
    parts = audit_csv(spark, path)
    s = parts["summary"].first()
    assert (s["total_rows"], s["total_cost"], s["unallocated_cost"]) == (2, 15.0, 5.0) and parts["rejected"].count() == 0
    assert {r["service"] for r in parts["resources"].collect()} == {"multi\nline", 'a "b", c'}


@pytest.mark.parametrize("end,bom", [("\r\n", "\ufeff"), ("\r\n", ""), ("\n", "\ufeff")])
def test_line_ends_and_byte_order_mark(spark, tmp_path, end, bom):
    path = bill(tmp_path, "r1,s,10,USD,anna,t,prod,c", "", "r2,s,5,USD,,t,prod,c", "   ", end=end, bom=bom)
    assert billing_csv.read_headers(spark, path)[0] == "Resource Id" and not billing_csv.has_open_quotes(spark, path)
    s = audit_csv(spark, path)["summary"].first()
    assert (s["total_rows"], s["analyzed_resources"], s["total_cost"], s["compliant_count"]) == (2, 2, 15.0, 1)


def test_ragged_rows_are_reported_by_position(spark, tmp_path):
    path = bill(tmp_path, "r1,s,10,USD,anna,t,prod,c", "short,row", "", "r2,s,5,USD,,t,prod,c", "r3,s,1,USD,a,t,prod,c,too,many", ",s,2,USD,a,t,prod,c")
    parts = audit_csv(spark, path)
    assert sorted(r["line_no"] for r in parts["rejected"].collect()) == [2, 4]
    assert {r["id"] for r in parts["resources"].collect()} == {"r1", "r2", "row-5"}


def test_positions_on_many_splits_and_files(spark, tmp_path):
    os.makedirs(f"{tmp_path}/d")
    for k in range(2):
        bill(f"{tmp_path}/d", *[f"id-{k * 20_000 + i},s,1,USD,a,t,prod,c" if i % 7 else "bad" for i in range(1, 20_001)], name=f"f{k}.csv")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        good, bad = billing_csv.split_malformed(billing_csv.read_line_items(spark, f"file://{tmp_path}/d"))
        assert good.rdd.getNumPartitions() > 10
        got = {(r["line_no"], r["c0"]) for r in good.select("line_no", "c0").collect()}
        lost = {r["line_no"] for r in bad.select("line_no", "c0").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(n, f"id-{n}") for n in range(1, 40_001) if (n - 1) % 20_000 % 7 != 6} and lost == {n for n in range(1, 40_001) if (n - 1) % 20_000 % 7 == 6}


def test_refusals(spark, tmp_path):
    row = "r1,s,10,USD,anna,t,prod,c"
    with pytest.raises(ValueError, match="EUR"):
        audit_csv(spark, bill(tmp_path, row, *[row] * 600, "r2,s,5, eur ,anna,t,prod,c", name="two.csv"))
    with pytest.raises(ValueError, match="no data rows"):
        audit_csv(spark, bill(tmp_path, name="headers.csv"))
    with pytest.raises(ValueError, match="no header"):
        audit_csv(spark, bill(tmp_path, name="empty.csv", header=""))
    with pytest.raises(ValueError, match="no mandatory tag"):
        audit_csv(spark, bill(tmp_path, "r1,s,1", name="no_tags.csv", header="Resource Id,Service,Cost"))


def test_policies_of_ones_own(spark):
    """Keys and synonyms are normalised as headers are; a header serves the first tag that takes it."""
    own = Policy((Tag("app.id", "App", ("Application-Id",)), Tag("unit", "Unit", ("Cost-Centre", "Application_Id"))))
    h = billing_csv.header_table(spark, ["application id", "cost centre", "Cost_Centre"])
    cells = spark.createDataFrame([("file", 1, 1, ""), ("file", 1, 2, "x")], "source string, line long, position int, value string")
    assert {r["tag"]: r["header"] for r in mapping.map_tags(h, cells, own).collect()} == {"app.id": "application id", "unit": "Cost_Centre"}
    found = drift.key_drift_synonyms(h, own).collect()
    assert {(r["tag"], tuple(r["members"])) for r in found} == {("unit", ("Cost_Centre", "application id", "cost centre"))}
    keys = spark.createDataFrame([("file", "APP ID", (1, 0))], "source string, key string, first struct<line:long,place:int>")
    none = spark.createDataFrame([], "source string, tag string")
    assert [(r["tag"], r["key"]) for r in mapping.map_json_tag_keys(keys, none, own).collect()] == [("app.id", "APP ID")]
