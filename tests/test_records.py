"""CSV input: records over any splits, headers by file, positions that no setting changes, against a plain reader."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from costlens.sources import billing_csv, records, shared


def read_plainly(text, sep=","):
    """Records of one file, as lists of cells; None in place of the cells of one whose quote is never closed."""
    out, cells, cell, quoted, began, i = [], [], "", False, False, 0
    text = text.replace("\r\n", "\n")

    def end():
        nonlocal cells, cell, began
        cells.append(cell)
        if not (len(cells) == 1 and not cells[0].strip()):
            out.append(cells)
        cells, cell, began = [], "", False

    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1 : i + 2] == '"':
                cell, i = cell + '"', i + 1
            elif c == '"':
                quoted = False
            else:
                cell += c
        elif c == '"' and not began:
            quoted = began = True
        elif c == sep:
            cells.append(cell)
            cell, began = "", False
        elif c == "\n":
            end()
        else:
            cell, began = cell + c, True
        i += 1
    if quoted:
        out.append(None)
    elif cell or cells:
        end()
    return out


def some_text(seed, rows=400, sep=","):
    rng = random.Random(seed)
    plain = ["a", "", 'in"side', "é ü", "x y", " lead", "5\" disk"]
    quoted = ['"a,b"', '"two\nlines"', '"say ""hi"""', '""', '"a"tail', '"\n\n"', '"one\n""two"",\nthree"', '"ends in quote"""', '",\n,"']
    lines = []
    for k in range(rows):
        cells = [f"r{k}"] + [rng.choice(quoted if rng.random() < 0.3 else plain) for _ in range(rng.choice([3, 3, 3, 2, 4]))]
        lines.append(sep.join(cells).replace(",", sep))
        if rng.random() < 0.05:
            lines.append(rng.choice(["", "  ", "\t"]))
    return "\n".join(["id,k1,k2,k3".replace(",", sep), *lines]) + "\n"


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return path


class conf:
    def __init__(self, spark, **values):
        self.spark, self.values = spark, {f"spark.sql.files.{k}": str(v) for k, v in values.items()}

    def __enter__(self):
        self.old = {k: self.spark.conf.get(k, None) for k in self.values}
        for k, v in self.values.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.old.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)


@pytest.mark.parametrize("sep", [",", ";", "|", "\t", "^"])
def test_states_and_cells_of_lines(spark, sep):
    """The state after each line, from outside and from inside, and the cells of whole records, against the plain reader."""
    open_after = lambda t: read_plainly(t, sep)[-1:] == [None]
    rng = random.Random(7)
    lines = ["".join(rng.choice(['"', '"', sep, "a", " ", "b"]) for _ in range(rng.randrange(0, 12))) for _ in range(4000)]
    after0, after1 = records._transitions(pa.array(lines), sep)
    assert [open_after(x) for x in lines] == after0.tolist()
    assert [open_after(f'"{x}' if not x.startswith('"') else f'"x{x}') for x in lines] == after1.tolist()
    whole = sorted({x for x, o in zip(lines, after0, strict=True) if read_plainly(x, sep) and not o})
    got = dict(map(tuple, spark.createDataFrame([(x,) for x in whole], "t string").select("t", records.split_cells(F.col("t"), sep)).collect()))
    assert got == {x: read_plainly(x, sep)[0] for x in whole}


def test_records_over_many_splits(spark, tmp_path):
    """One file of over a hundred splits, quoted cells across their borders: as one task reads it."""
    text = some_text(3, 200)
    path = put(f"{tmp_path}/d/a.csv", text)
    want = read_plainly(text)[1:]
    with conf(spark, maxPartitionBytes=40, openCostInBytes=0):
        export = billing_csv.open_export(spark, f"file://{path}")
        assert export.records.broken and export.records.splits > 100
        good, bad = billing_csv.split_malformed(billing_csv.lines_of(export))
        got = {r["line_no"]: [r["c0"], r["c1"], r["c2"], r["c3"]] for r in good.collect()}
        lost = {r["line_no"]: r["c0"] for r in bad.collect()}
    assert got == {n: w for n, w in enumerate(want, 1) if len(w) == 4} and lost == {n: w[0] for n, w in enumerate(want, 1) if len(w) != 4}
    few = billing_csv.sample_export(export, 7)
    assert [r["line_no"] for r in few.orderBy("line_no").collect()] == sorted(got)[:7]
    assert export.records.first_rows(12).select("source").count() < 20
    plan = export.records.first_rows(3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(split" in plan or "PushedFilters: [Or(" in plan or "EqualTo(split" in plan


def test_a_quote_that_is_never_closed(spark, tmp_path):
    put(f"{tmp_path}/d/a.csv", 'id,v\n1,a\n2,"open\n3,b\n4,c\n')
    put(f"{tmp_path}/d/b.csv", 'id,v\n5,"a\nb"\n6,x"\n')
    put(f"{tmp_path}/d/c.csv", '"id\n')
    put(f"{tmp_path}/d/e.csv", "")
    with conf(spark, maxPartitionBytes=6, openCostInBytes=0):
        good, bad = billing_csv.split_malformed(billing_csv.read_line_items(spark, f"file://{tmp_path}/d"))
        assert sorted((r["line_no"], r["c0"], r["c1"]) for r in good.collect()) == [(1, "1", "a"), (3, "5", "a\nb"), (4, "6", 'x"')]
        assert [(r["line_no"], os.path.basename(r["source"]), r[billing_csv.BAD]) for r in bad.collect()] == [(2, "a.csv", '2,"open')]


def test_settings_may_change_between_two_actions(spark, tmp_path):
    for k in range(4):
        put(f"{tmp_path}/d/f{k}.csv", "id,v\n" + "".join(f"{k * 10_000 + i},x\n" for i in range(10_000)))
    for line_breaks in (None, False):
        with conf(spark, minPartitionNum=4, openCostInBytes=1000):
            df = billing_csv.read_line_items(spark, f"file://{tmp_path}/d", multi_line=line_breaks)
            assert df.count() == 40_000
        with conf(spark, minPartitionNum=20, maxPartitionBytes=20_000, openCostInBytes=10):
            assert df.where("line_no = cast(c0 as long) + 1").count() == 40_000


def test_a_line_that_finds_no_split_raises(spark, tmp_path):
    found = records.read_records(spark, f"file://{put(f'{tmp_path}/a.csv', 'id,v' + chr(10) + '1,a' + chr(10))}")
    with pytest.raises(Exception, match="not in the catalogue"):
        records._rows(found.lines, found.catalogue.limit(0), 1, True, False).collect()
    with pytest.raises(ValueError, match="one character"):
        records.read_records(spark, f"file://{tmp_path}/a.csv", "::")


def test_each_file_goes_by_its_own_header(spark, tmp_path):
    put(f"{tmp_path}/d/a.csv", "id,cost,team\nr1,1,x\nr2,2\n")
    put(f"{tmp_path}/d/b.csv", "team,id,cost\ny,r3,3\n")
    put(f"{tmp_path}/d/c.csv", "\ufeffcost, id ,extra,id\n4,r4,e,second\nr5,5,5\n")
    for n in (100_000, 0):  # layouts by broadcast, and by a shuffle
        billing_csv.MAX_FILES, billing_csv.MAX_LAYOUTS = n, n
        export = billing_csv.open_export(spark, f"file://{tmp_path}/d")
        assert export.names == ["id", "cost", "team", "extra", "id"]
        good, bad = billing_csv.split_malformed(billing_csv.lines_of(export))
        assert sorted(tuple(r)[1:] for r in good.collect()) == [(1, "r1", "1", "x", None, None), (3, "r3", "3", "y", None, None), (4, "r4", "4", None, "e", "second")]
        assert sorted((r["line_no"], os.path.basename(r["source"])) for r in bad.collect()) == [(2, "a.csv"), (5, "c.csv")]
    billing_csv.MAX_FILES, billing_csv.MAX_LAYOUTS = 100_000, 1_000


def test_shared_tables_go_with_their_scope(spark):
    there = lambda p: os.path.exists(p.removeprefix("file://"))
    outside = shared.shared_dir(spark)
    with pytest.raises(KeyError), shared.shared_scope(spark):
        paths = [shared.shared_dir(spark)]
        spark.range(3).write.parquet(paths[0])
        with shared.shared_scope(spark):
            paths.append(shared.shared_dir(spark))
            spark.range(3).write.parquet(paths[1])
        assert there(paths[0]) and not there(paths[1])
        raise KeyError
    spark.range(3).write.parquet(outside)
    assert not there(paths[0]) and there(outside)


def test_layouts_that_differ_only_in_what_they_lack(spark, tmp_path):
    """Three columns at places 0, 1, 2 in each file, under other names: as arrays of places they differ in nulls alone."""
    for k, names in enumerate(("a,b,c", "d,e,f", "g,h,i")):
        put(f"{tmp_path}/d/{k}.csv", f"{names}\n{k}1,{k}2,{k}3\n")
    export = billing_csv.open_export(spark, f"file://{tmp_path}/d")
    good, _ = billing_csv.split_malformed(billing_csv.lines_of(export))
    got = sorted(tuple(x for x in r if x is not None)[2:] for r in good.collect())
    assert export.names == list("abcdefghi") and got == [(f"{k}1", f"{k}2", f"{k}3") for k in range(3)]
    assert [[r[f"c{3 * k}"] for r in good.where(f"c{3 * k} is not null").collect()] for k in range(3)] == [["01"], ["11"], ["21"]]
