"""Report files against Python's csv reader, ids over several loads, and facts that keep what reports say."""

import csv
import datetime as dt
import io
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from stockroom.operators.prefix_sum import numbered
from stockroom.sources import csv_load as cl
from stockroom.sources import registry as rg

SMALL_SPLITS = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of 64 bytes, so that records reach over them."""
    before = {k: spark.conf.get(k, None) for k in SMALL_SPLITS}
    for k, v in SMALL_SPLITS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def folder(files: dict[str, str]) -> str:
    d = tempfile.mkdtemp(prefix="stockroom-csv-")
    for name, text in files.items():
        with open(os.path.join(d, name), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return d


def by_csv(text: str) -> list[tuple]:
    rows = [r for r in csv.reader(io.StringIO(text)) if any(c.strip() for c in r)]
    return [tuple((c.strip(" ") or None) for c in (r + [""] * 3)[:3]) for r in rows]


def cell(rnd: random.Random) -> str:
    kind = rnd.random()
    plain = "".join(rnd.choice("ab x5") for _ in range(rnd.randint(0, 6)))
    if kind < 0.5:
        return plain
    if kind < 0.6:
        return (plain or "a") + '" stray'  # a quote inside an unquoted cell opens nothing
    inner = "".join(rnd.choice(['a', ' ', ',', '""', '\n', 'b']) for _ in range(rnd.randint(1, 12)))
    return f'"{inner}"'


def test_records_equal_the_csv_reader_over_many_splits(small_splits):
    rnd = random.Random(2)
    files, want = {}, []
    for k in range(6):
        body = "".join(",".join(["x" + str(i), cell(rnd), cell(rnd)]) + "\n" for i in range(40))
        files[f"f{k}.csv"] = f"Report {k}\nsome \"quote in the preamble\nA,B,C\n" + body
        want += [(f"f{k}.csv", *r) for r in by_csv(body)]
    lines = cl.read_lines(small_splits, folder(files))
    assert lines.select(F.shiftright("line_no", cl.SPLIT_BITS)).distinct().count() > 20
    got = cl.csv_with_preamble(lines, ["A", "B", "C"]).select(F.element_at(F.split("source_file", "/"), -1), "A", "B", "C")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_headers_differ_between_files(spark):
    d = folder({"a.csv": "B,A,A\n1,2,3\n", "b.csv": "﻿title\n\nA,x,y,B,Opt\n4,,,5,6\n", "c.csv": "A,B\n7,8\n\n \n9,\n"})
    got = {(r.A, r.B, r.Opt) for r in cl.csv_with_preamble(cl.read_lines(spark, d), ["A", "B"], ["Opt"]).collect()}
    assert got == {("3", "1", None), ("4", "5", "6"), ("7", "8", None), ("9", None, None)}
    with pytest.raises(ValueError):
        cl.csv_with_preamble(cl.read_lines(spark, d), ["A", "nowhere"])


def seq(df):
    return df.withColumn("load_seq", F.struct(F.lit(0).alias("report"), "source_file", "line_no"))


KEYS = "org_code string, location_code string, item_number string, uom_code string, category_name string, item_class string, source_file string, line_no long"


def rows(spark, *r):
    return spark.createDataFrame([(*x, "f", i) for i, x in enumerate(r)], KEYS)


def test_ids_are_handed_out_once(spark):
    first = rows(spark, ("O2", "L1", "b", "EA", None, None), ("O1", "L1", "a", "BOX", "C", None), ("O2", "L1", "a", "EA", None, "k"), ("O1", None, None, None, None, None))
    one = rg.register(rg.Registry(), [first])
    tables = {name: [tuple(r) for r in df.collect()] for name, df in one.tables().items()}
    assert {(r.org_code, r.org_id) for r in one.organizations.collect()} == {("O2", 1), ("O1", 2)}
    assert {(r.org_id, r.location_code, r.location_id) for r in one.locations.collect()} == {(1, "L1", 1), (2, "L1", 2)}
    again = rg.register(one, [first])
    assert {n: sorted(map(repr, (tuple(r) for r in df.collect()))) for n, df in again.tables().items()} == {n: sorted(map(repr, v)) for n, v in tables.items()}
    second = rows(spark, ("O0", "L9", "c", "KG", "D", None), ("O1", "L1", "a", "KG", "D", "late"), ("O2", "L1", "b", "EA", "C", "z"))
    two = rg.register(one, [second])
    assert {(r.org_code, r.org_id) for r in two.organizations.collect()} == {("O2", 1), ("O1", 2), ("O0", 3)}
    for name, df in two.tables().items():
        ids = [r[f"{ {'organizations': 'org', 'uoms': 'uom', 'categories': 'category', 'item_types': 'item_type', 'locations': 'location', 'items': 'item'}[name]}_id"] for r in df.collect()]
        assert sorted(ids) == list(range(1, len(ids) + 1))
    category = {r.category_name: r.category_id for r in two.categories.collect()}
    uom = {r.uom_code: r.uom_id for r in two.uoms.collect()}
    items = {r.item_number: (r.category_id, r.item_class, r.uom_id) for r in two.items.collect()}
    # stored attributes stay, empty ones are filled by the first that has one
    assert items == {"a": (category["C"], "k", uom["BOX"]), "b": (category["C"], "z", uom["EA"]), "c": (category["D"], None, uom["KG"])}
    facts = {(r.org_code, r.item_number): (r.org_id, r.location_id, r.item_id, r.uom_id) for r in rg.with_ids(second, two).collect()}
    assert facts["O1", "a"] == (2, 2, {r.item_number: r.item_id for r in two.items.collect()}["a"], uom["KG"])


def test_stored_rows_keep_ids_and_other_columns(spark):
    stored = spark.createDataFrame([(77, "C", None, "mine"), (5, "D", "kept", "too")], "category_id long, category_name string, category_description string, note string")
    new = spark.createDataFrame([("C", " ", "f", 0), ("C", "first", "f", 1), ("C", "second", "f", 2), ("D", "other", "f", 3), ("E", "e", "f", 4)], "category_name string, category_description string, source_file string, line_no long")
    out = rg.register(rg.Registry(categories=stored), [new]).categories
    got = {r.category_name: (r.category_id, r.category_description, r.note) for r in out.collect()}
    assert got == {"C": (77, "first", "mine"), "D": (5, "kept", "too"), "E": (78, "e", None)}


def test_numbers_run_through_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 10).alias("k"), "id")
    got = numbered(df, [F.col("k"), F.col("id")], "n", ranges=13).collect()
    want = {r: i + 1 for i, r in enumerate(sorted((x * 7 % 10, x) for x in range(1000)))}
    assert {(r.k, r.id): r.n for r in got} == want
    assert numbered(df.where("false"), [F.col("id")], "n").count() == 0


def test_times_of_day_and_zones_stay_as_written(spark):
    head = ",".join(cl.EXPIRY_COLUMNS)
    lines = [f"S,{when},I,L,1,EA,1,1,waste,C,LOT,05/01/2024" for when in ("2024-01-05T23:30:00Z", "2024-01-05 23:30:00+04:00", "05/01/2024", "12/31/2024", "2024-01-05T23:30:00.250", "soon")]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Dubai")
        got = [r.event_ts for r in cl.load_expiry_waste(cl.read_lines(spark, folder({"e.csv": "\n".join([head, *lines])}))).orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    late = dt.datetime(2024, 1, 5, 23, 30)
    assert got == [late, late, dt.datetime(2024, 1, 5), dt.datetime(2024, 12, 31), late.replace(microsecond=250000), None]


def test_every_parsed_row_gives_events_and_the_last_gives_the_balance(spark):
    head = ",".join(cl.OPENING_RECEIPTS_ISSUES_COLUMNS)
    body = ['L1,C,I1,d,EA,2,1,2,3,0,9', 'L1,C,I1,d,BOX,2,4,5,6,3,9', 'L1,C,I2,d,EA,2,0,null,,3,9', ',C,I3,d,EA,2,1,1,1,1,1']
    text = "\n".join(["Opening", "Period Start,01/02/2024", "Period End,29/02/2024", head, *body])
    parsed = cl.load_opening_receipts_issues(cl.read_lines(spark, folder({"o.csv": text})), "ORG")
    balances = {r.item_number: (r.opening_qty, r.uom_code) for r in cl.latest_balances(parsed).collect()}
    assert balances == {"I1": (4.0, "BOX"), "I2": (0.0, "EA")}
    events = sorted((r.item_number, r.event_type, r.quantity, r.uom_code, r.event_ts.day, r.is_aggregate) for r in cl.unpivot_movements(parsed).collect())
    assert events == sorted([("I1", t, q, u, 1 if t == "OPENING" else 29, True) for u, qs in (("EA", (1.0, 2.0, 3.0)), ("BOX", (4.0, 5.0, 6.0))) for t, q in zip(("OPENING", "RECEIPT", "ISSUE"), qs)])
    assert {r.item_number for r in rg.register(rg.Registry(), [parsed]).items.collect()} == {"I1", "I2", "I3"}


def test_levels_of_a_second_delivery_replace_whole_rows(spark):
    head = ",".join(cl.MIN_MAX_COLUMNS)
    one = cl.load_min_max(cl.read_lines(spark, folder({"m.csv": "\n".join([head, "O,L,I,EA,1,2,P,S,01/01/2024,01/01/2024", "O,L,J,EA,3,4,P,S,01/01/2024,01/01/2024"])})))
    two = cl.load_min_max(cl.read_lines(spark, folder({"m.csv": "\n".join([head, "O,L,I,BOX,,9,Q,,01/02/2024,2024-02-01T07:15:00Z"])})))
    registry = rg.register(rg.Registry(), [one])
    registry = rg.register(registry, [two])
    stored = rg.with_ids(cl.latest_min_max(one), registry)
    merged = {r.item_number: (r.uom_code, r.min_qty, r.max_qty, r.source_subinventory, r.updated_at) for r in cl.merge_min_max(stored, rg.with_ids(cl.latest_min_max(two), registry)).collect()}
    assert merged == {"I": ("BOX", None, 9.0, None, dt.datetime(2024, 2, 1, 7, 15)), "J": ("EA", 3.0, 4.0, "S", dt.datetime(2024, 1, 1))}


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_records_run_on_over_chunks_of_a_split(spark, monkeypatch, bits):
    """Windows hold a chunk of lines, not a split of a file; quoted cells may span several chunks."""
    monkeypatch.setattr(cl, "CHUNK_BITS", bits)
    rnd = random.Random(bits)
    body = "".join(",".join(["x" + str(i), cell(rnd), cell(rnd)]) + "\n" for i in range(120)) + 'last,"' + "a\n" * 40 + 'b",c\n'
    lines = cl.read_lines(spark, folder({"f.csv": "A,B,C\n" + body, "g.csv": "C,A,B\nno,quote,here\n"}))
    got = [tuple(r) for r in cl.csv_with_preamble(lines, ["A", "B", "C"]).select("A", "B", "C").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [*by_csv(body), ("quote", "here", "no")]))


def test_reports_leave_no_files_behind_but_their_rows(spark, tmp_path, monkeypatch):
    from stockroom import session
    from stockroom.plans import catalog

    monkeypatch.setattr(session, "ensure_checkpoint_dir", lambda _: str(tmp_path))
    pos = F.struct(F.lit(1).alias("s"), F.col("id").alias("k1"))
    text = F.when(F.col("id") == 0, "Item Type,Example").when(F.col("id") == 1, 'A,"two\nlines"').otherwise("B,x")
    report = spark.range(3).select(F.lit("t.csv").alias("source_file"), pos.alias("line_no"), text.alias("value"))
    rows = catalog._read_in(cl.load_item_types, report)
    assert sorted(r.item_type_name for r in rows.collect()) == ["A", "B"]
    assert [p.name.split("-")[0:2] for p in (tmp_path / "tables").iterdir()] == [["report", "rows"]]


def test_files_without_open_cells_are_not_dealt_by_chunk(spark, monkeypatch):
    """Only files with a record of several lines pass the windows; the others' lines are records as they are."""
    seen, plain = [], cl._spanning_records
    monkeypatch.setattr(cl, "_spanning_records", lambda body: seen.append({r.source_file[-5:] for r in body.collect()}) or plain(body))
    closed, spanning = 'A,B\n1,"x, ""y"""\n2,a"b\n', 'B,A\n"p\nq",3\nr,4\n'
    cases = (({"a.csv": closed, "b.csv": spanning}, [{"b.csv"}]), ({"a.csv": closed}, []), ({"b.csv": spanning}, [{"b.csv"}]))
    for files, want in cases:
        seen.clear()
        got = {tuple(r) for r in cl.csv_with_preamble(cl.read_lines(spark, folder(files)), ["A", "B"]).select("A", "B").collect()}
        assert seen == want
        assert got == {r for f in files for r in ([("1", 'x, "y"'), ("2", 'a"b')] if f == "a.csv" else [("3", "p\nq"), ("4", "r")])}


def test_dates_without_a_separator_of_a_format_are_not_tried(spark):
    from stockroom.functions.normalize import parse_date_multi, parse_number

    texts = ["03/04/2024", "12/31/2024", "2024-01-05", "2024-01-05T10:20/x", "2024-01-05 10:20", "20240105", "31/31/2024", "5-6-2024", "", None, " 1/2/2024 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_date_multi("t").alias("d"))
    five = dt.date(2024, 1, 5)
    assert [r.d for r in df.collect()] == [dt.date(2024, 4, 3), dt.date(2024, 12, 31), five, five, five, None, None, None, None, None, dt.date(2024, 2, 1)]
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("contains(") >= 2
    numbers = spark.createDataFrame([(t,) for t in (" 1,234.5 ", "null", "", "x", None, "1e3")], "t string").select(parse_number("t").alias("n"))
    assert [r.n for r in numbers.collect()] == [1234.5, None, None, None, None, 1000.0]
