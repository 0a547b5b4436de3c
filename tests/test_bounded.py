"""What must stay bounded however the data are: drift pairs of large groups, currencies that are none, hot keys."""

import itertools
import random
import re

from pyspark.sql import functions as F

from costlens.functions.policy import Policy, Tag
from costlens.operators import drift, explore, lines, mapping
from costlens.operators.search_index import ResourceIndex


def table(spark, names, tag="team"):
    rows = [(tag, n, [n], n, k) for k, n in enumerate(names)]
    return spark.createDataFrame(rows, "tag string, norm string, raws array<string>, raw string, first_line long").repartition(4)


def pairs_plainly(names):
    skel = lambda n: re.sub("[0-9]+", "#", n)
    words = lambda n: sorted({w for w in re.split(r"[\s\-_./]+", n) if w})
    one = lambda a, b: (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1) or (len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b))))
    out = {0: set(), 1: set(), 2: set()}
    for a, b in itertools.combinations(sorted(names), 2):
        s, t = sorted((a, b), key=len)
        if skel(a) == skel(b):
            continue
        if min(len(a), len(b)) >= 3 and len(words(a)) > 1 and words(a) == words(b):
            out[0].add((a, b))
        if len(s) >= 4 and len(t) - len(s) <= 7 and t.startswith(s):
            out[1].add((a, b))
        if len(s) >= 5 and one(s, t):
            out[2].add((a, b))
    return out


def test_drift_pairs_against_all_pairs(spark, monkeypatch):
    base = ["payments-team", "team payments", "team_payments", "team/payments/team", "platform", "plaform", "platforms", "platfarm", "data", "database", "datab", "srv-1001", "srv-1002", "srv-a001", "srv-b001", "ops", "so-p", "p.so"]
    names = [*base, *[f"node{k}" for k in range(30)], *[f"zone{c}" for c in "abcdefghij"], *[f"zone{k}" for k in range(10)]]
    want = pairs_plainly(names)
    values = table(spark, names)
    for hot in (1000, 20):  # with plain joins, and with hot keys by broadcast
        monkeypatch.setattr(drift, "HOT", hot)
        monkeypatch.setattr(drift, "SMALL", 0)
        for rank, f in enumerate((drift.value_drift_token_order, drift.value_drift_prefix, drift.value_drift_typo)):
            assert sorted((r["norm_a"], r["norm_b"]) for r in f(values).collect()) == sorted(want[rank]), (hot, rank)


def test_large_groups_come_out_as_representative_and_members(spark):
    """Every value of a group meets one of another skeleton, with the number of its pairs."""
    names = [f"zone{c}" for c in "abcdefghijklmnop"] + [f"zone{k}" for k in range(10)]
    want = pairs_plainly(names)[2]
    got = drift.value_drift_typo(table(spark, names), most=5).collect()
    assert {(r["norm_a"], r["norm_b"]) for r in got} <= want and all(r["pairs"] for r in got) and len(got) == 26
    meets = {n: sum(n in p for p in want) for n in names[:26]}
    heads = {x for r in got for x in (r["norm_a"], r["norm_b"]) if sum(x in (q["norm_a"], q["norm_b"]) for q in got) > 2}
    assert heads == {"zonea"} and sorted(r["pairs"] for r in got) == sorted(meets.values())
    few = drift.value_drift_token_order(table(spark, ["team pay", "pay team", "pay_team"]), most=5).collect()
    assert len(few) == 3 and not any(r["pairs"] for r in few)


def test_a_hundred_thousand_spellings_of_one_prefix(spark):
    """One stem that 100,000 names begin with, and names that differ only in digits: pairs are linear, and no task has more than a share."""
    n = 100_000
    hexa = F.lower(F.hex(F.col("id") + 16**4))
    letters = F.translate(hexa, "0123456789", "ghijklmnop")
    names = spark.range(n).select(F.concat(F.lit("prod-"), letters).alias("norm")).unionByName(spark.range(n).select(F.concat(F.lit("host-"), F.col("id").cast("string")).alias("norm")))
    names = names.unionByName(spark.createDataFrame([("prod",), ("prod-",)], "norm string"))
    values = names.select(F.lit("team").alias("tag"), "norm", F.array("norm").alias("raws"), F.col("norm").alias("raw"), F.xxhash64("norm").alias("first_line"))
    found = drift.value_drift_prefix(values)
    # Both stems with every name within seven characters, and with each other.
    assert found.count() == 2 * n + 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "Cross" not in plan


def test_many_texts_in_the_currency_column(spark):
    rows = spark.range(30_000).select(F.concat(F.lit("cell "), F.col("id").cast("string")).alias("currency"), F.lit("a").alias("source"))
    rows = rows.unionByName(spark.createDataFrame([(" usd ", "b"), ("USD", "b"), (None, "c"), ("EUR", "d"), ("usd", "d")], "currency string, source string"))
    one = lines.currency_guard(rows, names=3).first()
    assert one["refused"] and one["currencies"] == "CELL 0,CELL 1,CELL 10 and 29999 more"
    got = {r["source"]: (r["currencies"], r["refused"]) for r in lines.currency_guard(rows, ["source"], 3).collect()}
    assert got == {"a": ("CELL 0,CELL 1,CELL 10 and 29997 more", True), "b": ("USD", False), "d": ("EUR,USD", True)}
    assert tuple(lines.currency_guard(rows.where("source = 'c'")).first()) == ("", False)


def test_search_by_trigrams_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"r{k}", f"{rng.choice(['i', 'Vol', 'ARN:aws'])}-{rng.randrange(10**6):06x}-{k}", rng.choice([None, "Compute", "Object Storage", "ñandú"]), k) for k in range(3000)]
    rows += [("x", "", None, 1), ("y", "ab", "s", 2)]
    resources = spark.createDataFrame(rows, "rkey string, id string, service string, first_line long").repartition(3)
    index = ResourceIndex.build(resources, f"file://{tmp_path}/index", 100)
    again = ResourceIndex(spark, f"file://{tmp_path}/index")
    for text in ("", " ", "i", "ab", "VOL-", "arn:aws-0", " storage", "ñandú", "-2999", "no such text", "e s", "compute", rows[7][1], "%_", "-1"):
        want = sorted(r["rkey"] for r in explore.search_resources(resources, text).collect())
        assert sorted(r["rkey"] for r in again.search(text).collect()) == want, text
    assert len(index.buckets(rows[7][1])) == 1 and len(index.buckets("vol-")) < 20 and index.buckets("no such text") == []
    none = ResourceIndex.build(resources.limit(0), f"file://{tmp_path}/none")
    assert none.search("vol").count() == 0


def test_a_policy_of_fifty_overlapping_tags(spark):
    """As a plain loop over tags in policy order; one plan, whatever the number of tags."""
    rng = random.Random(5)
    names = [f"name{k}" for k in range(60)]
    policy = Policy(tuple(Tag(f"tag{k}", "", tuple(rng.sample(names, 4))) for k in range(50)))
    heads = [(s, i, rng.choice(["", "tags/"]) + n) for s in ("a", "b", "c") for i, n in enumerate(rng.sample(names, 40))]
    fills = {(s, i): rng.randrange(3) for s, i, _ in heads}
    headers = spark.createDataFrame(heads, "source string, position int, header string")
    cells = spark.createDataFrame([(s, k, i, "x") for (s, i), n in fills.items() for k in range(n)], "source string, line long, position int, value string")
    want = set()
    for source in "abc":
        used = set()
        for tag in policy.tags:
            own = sorted((-fills[s, i], i, h) for s, i, h in heads if s == source and h not in used and h.removeprefix("tags/") in (tag.key, *tag.synonyms))
            if own:
                used.add(own[0][2])
                want.add((source, tag.key, own[0][1], own[0][2]))
    found = mapping.map_tags(headers, cells, policy)
    assert set(map(tuple, found.collect())) == want and len(want) > 60
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") < 8
