"""Archives, sections, catalogue, typed columns, links, weather and population files."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.operators import joins
from panelspark.operators.quality import ExpectationError
from panelspark.sources import catalogue, climate, containers, links, quarantine, sections, tables, typed, weather

TWO_TABLES = (
    "C,SETP.WORLD,DVD,OPERATOR,PUBLIC,2020/06/04,00:03:11\n"
    "I,DISPATCH,UNIT,2,DUID,MW,NOTE\n"
    'D,DISPATCH,UNIT,2,A,1.5,"two\nlines"\n'
    "D,DISPATCH,UNIT,2,B,2.5,\n"
    "I,PRICE,,1,REGION,RRP\n"
    "D,PRICE,,1,NSW1,30\n"
    "D,PRICE,,1,QLD1,31\n"
    "D,PRICE,,1,VIC1,32\n"
    'C,"END OF REPORT",9\n'
)


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "plain.CSV").write_text(TWO_TABLES)
    inner = zipped(**{"deep.csv": TWO_TABLES.replace("END OF REPORT\",9", "END OF REPORT\",8"), "readme.txt": "hello"})
    (tmp_path / "outer.ZIP").write_bytes(zipped(**{"inner.zip": inner, "flat.CSV": TWO_TABLES, "broken.zip": b"not a zip"}))
    (tmp_path / "corrupt.zip").write_bytes(b"PK\x03\x04 nothing here")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    (tmp_path / "short.csv").write_text(TWO_TABLES.replace(",9\n", ",7\n"))
    (tmp_path / "late.csv").write_text(TWO_TABLES + "D,x\n")
    (tmp_path / "tail.csv").write_text(TWO_TABLES + "\n\n")
    (tmp_path / "open.csv").write_text("".join(TWO_TABLES.splitlines(True)[:-1]))
    (tmp_path / "empty_section.csv").write_text(
        "C,a,b,c,d,2020/01/01 00:00:00\nI,X,Y,1,COL\nI,P,Q,1,COL\nD,P,Q,1,v\nC,END OF REPORT,5\n"
    )
    (tmp_path / "odd.csv").write_text(TWO_TABLES.replace("D,PRICE,,1,QLD1,31", "Z,PRICE"))
    return tmp_path


@pytest.fixture
def records(spark, folder):
    return containers.read_containers(spark, str(folder)).cache()


def name_of(df):
    last = F.element_at(F.split("path", "/"), -1)
    return df.withColumn("file", F.when(F.col("member") == "", last).otherwise(F.concat_ws(":", last, "member")))


def test_archives_to_any_depth(records):
    members = {r["file"] for r in name_of(records).where("fields IS NOT NULL").select("file").distinct().collect()}
    assert {"plain.CSV", "outer.ZIP:flat.CSV", "outer.ZIP:inner.zip/deep.csv"} <= members
    quoted = name_of(records).where("file = 'plain.CSV' AND record_no = 3").first()
    assert quoted["fields"][-1] == "two\nlines"
    assert quoted["header"] == ["I", "DISPATCH", "UNIT", "2", "DUID", "MW", "NOTE"] and quoted["lead"][0] == "C"


def test_bad_members_become_rows(records):
    bad = {(r["file"], r["error_class"], r["severity"]) for r in name_of(containers.read_problems(records)).collect()}
    assert bad == {
        ("corrupt.zip", "BadZipFile", "error"),
        ("outer.ZIP:broken.zip", "BadZipFile", "error"),
        ("outer.ZIP:inner.zip/readme.txt", "UnknownFile", "warning"),
    }


def test_known_bad_archives_are_warnings(records):
    relaxed = containers.read_problems(records, known_bad=("corrupt.zip", "broken.zip"))
    assert {r["severity"] for r in relaxed.collect()} == {"warning"}


def test_units_are_runs_of_members(spark, tmp_path, monkeypatch):
    inner = zipped(**{f"i{k}.csv": TWO_TABLES for k in range(6)})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:  # stored, so the archive inside is entered
        z.writestr("inner.zip", inner)
        z.writestr("packed.zip", inner, zipfile.ZIP_DEFLATED)
        for k in range(5):
            z.writestr(f"o{k}.csv", TWO_TABLES)
        z.writestr("same.csv", TWO_TABLES)
    (tmp_path / "a.zip").write_bytes(out.getvalue())
    monkeypatch.setattr(containers, "UNIT", 2 * len(TWO_TABLES))
    run = [u for u in containers._units(str(tmp_path / "a.zip"), "", [], io.BytesIO(out.getvalue()))]
    assert [(u[1], u[2], u[3]) for u in run[:3]] == [("inner.zip", [0], [0, 1]), ("inner.zip", [0], [2, 3]), ("inner.zip", [0], [4, 5])]
    assert all(u[4] <= 2 * len(TWO_TABLES) or len(u[3]) == 1 for u in run)
    got = [row for u in run for row in containers._unit_records(str(tmp_path / "a.zip"), u[1], u[2], u[3])]
    whole = containers._open("p", "", "a.zip", io.BytesIO(out.getvalue()))
    assert sorted(r[1:4] for r in got) == sorted(r[1:4] for r in whole)
    assert len({r[1] for r in got}) == 18
    # the same through Spark, one task per unit
    records = containers.read_containers(spark, str(tmp_path), task_bytes=1)
    assert records.where("error IS NULL").count() == 18 * 9


def test_short_members_are_read_at_once_with_the_same_records(tmp_path, monkeypatch):
    """Short members need no stream; damaged ones still give the records in front of the damage."""
    good, late = b"C,a\nI,b\nD,\"x\r\ny\",2\n", b"C,a\n" + b"D,1\n" * 5000 + b"D,\xff\xfe\n"
    (tmp_path / "a.zip").write_bytes(zipped(**{"good.csv": good, "late.csv": late, "odd.txt": b"x"}))
    unit = (str(tmp_path / "a.zip"), "", [], [0, 1, 2])
    streamed = []
    kept = io.TextIOWrapper
    monkeypatch.setattr(containers.io, "TextIOWrapper", lambda stream, **how: (streamed.append(stream.name), kept(stream, **how))[1])
    quick = list(containers._unit_records(*unit))
    assert streamed == ["late.csv"]
    monkeypatch.setattr(containers, "SMALL", -1)
    assert quick == list(containers._unit_records(*unit))
    assert [r[1] for r in quick if r[-1]] == ["late.csv", "odd.txt"] and quick[2][3] == ["D", "x\r\ny", "2"]
    table = containers._table(quick)
    assert [tuple(r.values()) for r in table.to_pylist()] == quick


def test_write_archives_streams_members(spark, tmp_path):
    rows = [(f"{a}.zip", m, k, f"{m},{k}\n".encode()) for a in "xy" for m in ("z.csv", "in.zip/b.csv", "a.csv", "in.zip/a.csv") for k in range(3)]
    lines = spark.createDataFrame(rows, "archive string, member string, k int, line binary").repartition(3)
    made = containers.write_archives(lines, str(tmp_path / "out"), "archive", "member", "k", "line").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in made) == ["x.zip", "y.zip"]
    got = containers.read_containers(spark, str(tmp_path / "out")).collect()
    assert all(r.error is None and r.fields == [r.member, str(r.record_no - 1)] for r in got) and len(got) == len(rows)
    assert containers.read_containers(spark, str(tmp_path / "out"), "*.csv").count() == 0


def test_short_members_are_packed_at_once(tmp_path, monkeypatch):
    """One piece per short member however many batches its lines come in; a long one is streamed; the content is the same."""
    pieces = []
    kept = zipfile.ZipFile.writestr
    monkeypatch.setattr(zipfile.ZipFile, "writestr", lambda z, info, data: (pieces.append(info.filename), kept(z, info, data))[1])
    monkeypatch.setattr(containers, "SMALL", 20)
    rows = [("a.zip", m, f"{m},{k}\n".encode()) for m in ("in.zip/b.csv", "in.zip/c.csv", "x.csv", "y.csv") for k in range(2 if m[0] != "y" else 9)]
    packer = containers._Packer(str(tmp_path), 0)
    for name, member, line in [*rows, ("b.zip", "x.csv", b"1\n")]:
        packer.add(name, member, memoryview(line))
    packer.end_archive()
    assert pieces == ["x.csv", "x.csv"] and packer.done == [f"{tmp_path}/a.zip", f"{tmp_path}/b.zip"]
    units = containers._units(str(tmp_path / "a.zip"), "", [], io.BytesIO((tmp_path / "a.zip").read_bytes()))
    got = [r for u in units for r in containers._unit_records(*u[:4])]
    assert sorted((r[1], ",".join(r[3]) + "\n") for r in got) == sorted((m, line.decode()) for _, m, line in rows)


def test_a_line_without_a_member_is_refused(spark, tmp_path):
    lines = spark.createDataFrame([("x.zip", None, 1, b"a\n")], "archive string, member string, k int, line binary")
    with pytest.raises(Exception, match="lacks its archive"):
        containers.write_archives(lines, str(tmp_path / "out"), "archive", "member", "k", "line").collect()


def test_blocks_keep_header_and_first_record(monkeypatch):
    """A file in several blocks gives the same records as in one, an error after those in front of it."""
    text = TWO_TABLES * 3 + 'D,"\x00open'
    whole = list(containers._flat(containers._records("p", "m", io.StringIO(text, newline=""))))
    monkeypatch.setattr(containers, "BATCH_RECORDS", 4)
    blocks = list(containers._records("p", "m", io.StringIO(text, newline="")))
    assert len(blocks) > 6 and list(containers._flat(blocks)) == whole
    assert [r[2] for r in whole] == list(range(1, len(whole) + 1)) and all(r[5] == whole[0][3] for r in whole)
    blocks.append(containers._problem("p", "m", ValueError("bad")))
    rows = [tuple(r.values()) for r in containers._batch(blocks).to_pylist()]
    assert rows == [*whole, ("p", "m", None, None, None, None, "bad", "ValueError")]


def test_commit_sorts_no_records(spark):
    """Verdicts with errors come out of hash tables too, and the files set aside are looked up in one."""
    rows = spark.createDataFrame([("a", "b", 1, ["C"], None), ("a", "c", None, None, "bad")], "path string, member string, record_no bigint, fields array<string>, error string")
    verdicts = sections.validate_sections(rows, error_texts=False)
    plan = verdicts._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert {(r.member, r.problem) for r in verdicts.collect()} == {("b", "no closing record"), ("c", sections.UNREADABLE)}
    assert {(r.member, r.problem) for r in sections.validate_sections(rows).collect()} == {("b", "no closing record"), ("c", "bad")}
    bad = rows.where("error IS NOT NULL").select("path", "member")
    kept = joins.sized_join(rows, bad, ["path", "member"], "left_anti", max_rows=0, distinct=True)
    assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    assert [r.member for r in kept.collect()] == ["b"]


def test_commit_holds_sound_files_only(spark, folder, records, tmp_path):
    (folder / "cut.csv").write_bytes(TWO_TABLES.encode() * 3000 + b"D,\xff\xfe\n")
    records = containers.read_containers(spark, str(folder))
    assert records.where("member = '' AND path LIKE '%cut.csv' AND error IS NULL").count() > 0  # they flow first
    sink = str(tmp_path / "sink")
    with pytest.raises(Exception, match="(?i)path"):
        quarantine.read_committed(spark, sink)
    bad = {(r["file"], r["error_class"]) for r in name_of(quarantine.commit_sound(records, sink)).collect()}
    assert bad == {
        ("corrupt.zip", "BadZipFile"), ("outer.ZIP:broken.zip", "BadZipFile"), ("outer.ZIP:inner.zip/readme.txt", "UnknownFile"),
        ("cut.csv", "UnicodeDecodeError"), ("short.csv", "InvalidReport"), ("late.csv", "InvalidReport"),
        ("open.csv", "InvalidReport"), ("odd.csv", "InvalidReport"),
    }
    kept = {r["file"] for r in name_of(quarantine.read_committed(spark, sink)).select("file").distinct().collect()}
    assert kept == {"plain.CSV", "outer.ZIP:flat.CSV", "outer.ZIP:inner.zip/deep.csv", "other.csv", "tail.csv", "empty_section.csv"}
    counts = {r["file"]: r["records"] for r in name_of(spark.read.parquet(f"{sink}/manifest")).collect()}
    assert counts["plain.CSV"] == 9 and set(counts) == kept


def test_rejected_values_are_counted_in_the_load_itself(spark, tmp_path):
    from pyspark.sql import Observation

    rows = spark.createDataFrame([({"A": a, "B": b},) for a, b in (("1", "x"), ("300", ""), ("q", "2"), (None, " "))], "values map<string,string>")
    schema = T.StructType([T.StructField("A", T.ByteType()), T.StructField("B", T.IntegerType()), T.StructField("C", T.StringType())])
    assert [tuple(r) for r in typed.reject_counts(rows, schema).collect()] == [("A", 3, 2), ("B", 2, 1), ("C", 0, 0)]
    seen = Observation()
    typed.typed_table(typed.watch_rejects(rows, schema, seen), schema).write.parquet(str(tmp_path / "out"))
    assert seen.get == {"A": 2, "B": 1, "C": 0}
    typed.expect_readable(seen, at_most=2)
    with pytest.raises(ExpectationError, match="A: 2 unreadable values; B: 1"):
        typed.expect_readable(seen)


def test_validation(records):
    csvs = records.where("fields IS NOT NULL")
    out = {r["file"]: (r["is_report"], r["problem"]) for r in name_of(sections.validate_sections(csvs)).collect()}
    assert out["plain.CSV"] == out["outer.ZIP:flat.CSV"] == out["outer.ZIP:inner.zip/deep.csv"] == (True, None)
    assert out["tail.csv"] == out["empty_section.csv"] == (True, None)
    assert out["other.csv"] == (False, None)
    assert out["short.csv"] == (True, "closing count does not match")
    assert out["late.csv"] == (True, "records after the end")
    assert out["open.csv"] == (True, "no closing record")
    assert out["odd.csv"] == (True, "unexpected kind of record")


def test_validation_sorts_no_texts(spark):
    """Verdicts come out of hash tables, which hold numbers and flags only."""
    rows = spark.createDataFrame([("a", "b", 1, ["C"])], "path string, member string, record_no bigint, fields array<string>")
    plan = sections.validate_sections(rows)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_split_into_tables(records):
    csvs = records.where("fields IS NOT NULL")
    good, bad = sections.split_good_bad(csvs, sections.validate_sections(csvs))
    assert {r["file"] for r in name_of(bad).collect()} == {"short.csv", "late.csv", "open.csv", "odd.csv"}
    rows = name_of(sections.split_sections(good))
    per_table = {(r["report_name"], r["report_subtype"]): r["n"] for r in rows.where("file = 'plain.CSV'").groupBy("report_name", "report_subtype").agg(F.count("*").alias("n")).collect()}
    assert per_table == {("DISPATCH", "UNIT"): 2, ("PRICE", "NULL"): 3}
    one = rows.where("file = 'plain.CSV' AND record_no = 3").first()
    assert one["values"] == {"DUID": "A", "MW": "1.5", "NOTE": "two\nlines"}
    assert (one["schema_version"], one["top_timestamp"]) == ("2", "2020_06_04_00_03_11")
    # a section without data rows leaves nothing; a single time field is enough
    left = rows.where("file = 'empty_section.csv'").collect()
    assert [(r["report_name"], r["top_timestamp"]) for r in left] == [("P", "2020_01_01_00_00_00")]
    assert rows.where("file = 'other.csv'").count() == 0


@pytest.mark.parametrize("rows_per_chunk", [2, 1_000_000])
def test_headers_carried_forward_equal_the_readers(records, rows_per_chunk):
    csvs = records.where("fields IS NOT NULL")
    again = sections.attach_headers(csvs.drop("header", "lead"), rows_per_chunk=rows_per_chunk)
    keys = ["path", "member", "record_no"]
    a = {tuple(r[k] for k in keys): (r["header"], r["lead"]) for r in csvs.collect()}
    b = {tuple(r[k] for k in keys): (r["header"], r["lead"]) for r in again.collect()}
    assert a == b


def test_map_tables(spark):
    rows = spark.createDataFrame(
        [("DISPATCH", "PRICE"), ("DISPATCH", "CASESOLUTION"), ("TWO", "X"), ("DINT", "NULL"), ("TRADING", "PRICE"), ("GENCONSETTRK", "NULL"), ("SOLO", "NULL")],
        "report_name string, report_subtype string",
    )
    mapping = spark.createDataFrame(
        [("DISPATCH", "PRICE", "DISPATCHPRICE"), ("DISPATCH", "PRICE", "DISPATCHPRICE"), ("TWO", "X", "A"), ("TWO", "X", "B"), ("TRADING", "PRICE", "TRADINGPRICE"), ("SOLO", None, "SOLO")],
        "report_name string, report_subtype string, table_name string",
    )
    got = {(r["report_name"], r["report_subtype"]): r["table_name"] for r in sections.map_tables(rows, mapping, skip=sections.SKIPPED_TABLES).collect()}
    # two answers, a skipped table and an unlisted report drop out
    assert got == {("DISPATCH", "PRICE"): "DISPATCHPRICE", ("GENCONSETTRK", "NULL"): "GENCONSETTRK", ("SOLO", "NULL"): "SOLO"}
    only = sections.map_tables(rows, mapping, only=["SOLO"])
    assert [r["table_name"] for r in only.collect()] == ["SOLO"]


TYPES = {
    "VARCHAR2(10)": "string",
    "VARCHAR(5)": "string",
    "CHAR(1)": "string",
    "NUMBER(2,0)": "tinyint",
    "NUMBER(3)": "smallint",
    "NUMBER(4,0)": "smallint",
    "NUMBER(9,0)": "int",
    "NUMBER(10)": "bigint",
    "NUMBER(15,5)": "double",
    "NUMBER (10, 2)": "double",
    "DATE": "timestamp_ntz",
    "TIMESTAMP(3)": "timestamp_ntz",
}


def test_types(spark):
    assert {k: catalogue.source_type_to_spark(k).simpleString() for k in TYPES} == TYPES
    df = spark.createDataFrame([(k,) for k in [*TYPES, "BLOB"]], "source_type string")
    got = {r[0]: r[1] for r in df.select("source_type", catalogue.spark_type_column("source_type")).collect()}
    assert got == {**TYPES, "BLOB": None}
    with pytest.raises(ValueError):
        catalogue.source_type_to_spark("BLOB")
    assert catalogue.source_type_to_spark("NUMBER(15,5)", decimals=True) == T.DecimalType(15, 5)


def test_catalogue_rules(spark):
    rows = [
        ("DISPATCHLOAD", "DUID", 1, "VARCHAR2(10)", True, 1),
        ("DISPATCHLOAD", "RAISE6SEC", 2, "NUMBER(15,5)", False, 1),
        ("DISPATCHLOAD", "LOWERKEY", 3, "NUMBER(3)", True, 1),
        ("DUDETAIL", "MAXCAPACITY", 1, "NUMBER(6,0)", False, 2),
        ("DUDETAIL", "DUID", 2, "VARCHAR2(20)", False, 2),
        ("OTHER", "RAISEREG", 1, "NUMBER(3)", False, 3),
    ]
    cat = spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, source_type string, is_pk boolean, table_ordinal int")
    assert [tuple(r) for r in catalogue.columns_to_drop(cat).collect()] == [("DISPATCHLOAD", "RAISE6SEC")]
    assert catalogue.table_schema(catalogue.override_types(cat), "DUDETAIL")["MAXCAPACITY"].dataType == T.DoubleType()
    wanted = spark.createDataFrame([("NEW", "DUID")], "table_name string, column_name string")
    assert catalogue.borrow_types(cat, wanted).first()["source_type"] == "VARCHAR2(20)"
    with pytest.raises(ValueError, match="NOWHERE"):
        catalogue.borrow_types(cat, spark.createDataFrame([("NEW", "NOWHERE")], "table_name string, column_name string"))
    assert catalogue.unknown_types(cat).count() == 0


def test_typed_values(spark):
    schema = T.StructType([T.StructField("AT", T.TimestampNTZType()), T.StructField("N", T.ByteType()), T.StructField("GONE", T.StringType()), T.StructField("RAISE", T.DoubleType())])
    rows = spark.createDataFrame(
        [({"N": "7", "AT": "2020/06/04 00:03:11", "RAISE": "1"}, "3"), ({"AT": "9999/12/31 23:59:59.997", "N": "900"}, "x"), ({"AT": "", "N": " "}, None)],
        "values map<string,string>, schema_version string",
    )
    out = typed.typed_table(rows, schema, drop=["RAISE"]).collect()
    assert out[0]["AT"] == dt.datetime(2020, 6, 4, 0, 3, 11) and out[0]["N"] == 7 and out[0]["RAISE"] is None
    assert out[1]["AT"] == dt.datetime(9999, 12, 31, 23, 59, 59, 997000) and out[1]["N"] is None and out[1]["schema_version"] is None
    assert out[2]["AT"] is None and out[2]["N"] is None


def test_typed_csv_and_partitioned_rewrite(spark, tmp_path):
    import gzip

    source = tmp_path / "T" / "SCHEMA_VERSION=2" / "TOP_TIMESTAMP=2019_03_02_00_45_12"
    source.mkdir(parents=True)
    with gzip.open(source / "a.CSV.gz", "wt") as f:
        f.write("DUID,SETTLEMENTDATE\nA,2020/01/31 23:55:00\nB,2020/02/01 00:00:00\n")
    schema = T.StructType([T.StructField("SETTLEMENTDATE", T.TimestampNTZType()), T.StructField("DUID", T.StringType()), T.StructField("RAISE", T.DoubleType())])
    df = typed.read_typed_csv(spark, str(tmp_path / "T"), schema)
    assert df.schema["schema_version"].dataType == T.ByteType()
    assert {(r["DUID"], r["top_timestamp"], r["RAISE"]) for r in df.collect()} == {("A", "2019_03_02_00_45_12", None), ("B", "2019_03_02_00_45_12", None)}
    out = str(tmp_path / "out")
    typed.write_by_month(df, out, "SETTLEMENTDATE")
    # rewriting one month leaves the other alone
    typed.write_by_month(df.where("DUID = 'B'").withColumn("DUID", F.lit("C")), out, "SETTLEMENTDATE")
    assert {(r["DUID"], r["year"], r["month"]) for r in spark.read.parquet(out).collect()} == {("A", 2020, 1), ("C", 2020, 2)}


PAGE = """<html><A HREF="/">[To Parent Directory]</A><br><br>
Tuesday, January 2, 2024  8:00 AM       168243 <A HREF="/REPORTS/CURRENT/A.zip">A.zip</A><br>
Tuesday, January 2, 2024 10:00 PM          512 <a class="x" href='B.CSV'>B.CSV</a><br>
Tuesday, January 2, 2024  8:00 AM        &lt;dir&gt; <A HREF="/REPORTS/CURRENT/sub/">sub</A><br>
<a href="https://market.example/REPORTS/CURRENT/sub/C.zip">C</a> <a href="https://evil.example/REPORTS/CURRENT/D.zip">D</a>
<a href="/REPORTS/ARCHIVE/E.zip">E</a> <a href="/REPORTS/CURRENT/FCAS_F.zip">F</a> <a href="/REPORTS/CURRENT/notes.txt">n</a>
<a href="/REPORTS/CURRENT/MMSDM_2017_01.zip">roll up</a></html>"""


def test_links(spark):
    pages = spark.createDataFrame(
        [(1, "https://www.market.example/REPORTS/CURRENT/", PAGE), (2, "https://www.market.example/REPORTS/CURRENT/", '<a href="/REPORTS/CURRENT/x/A.zip">A</a>')],
        "page_id int, url string, html string",
    )
    found = links.extract_links(pages)
    assert found.where("page_id = 1").count() == 10
    kept = {r["file_name"]: (r["link"], r["size"]) for r in links.link_inventory(found).collect()}
    assert kept == {
        # the later page wins
        "A.zip": ("https://www.market.example/REPORTS/CURRENT/x/A.zip", None),
        "B.CSV": ("https://www.market.example/REPORTS/CURRENT/B.CSV", 512),
        "C.zip": ("https://market.example/REPORTS/CURRENT/sub/C.zip", None),
    }
    first = links.link_inventory(found.where("page_id = 1"))
    assert [r["file_name"] for r in links.by_size(first).collect()] == ["A.zip", "B.CSV", "C.zip"]


def test_hostile_pages(spark):
    html = (
        "<!-- <a href='c.zip'>no</a> --><base target=x><base href='/B/d/'><base href=/no/>"
        "<a href=one.zip>1</a><A\nHREF = 'two.zip?a=1&amp;b=&#50;&#x20AC;&amp;lt;&bad;&#1114112;'>2</a>"
        '<a title="x > y href=no" data-href=no href="three.zip" href=no>3</a><a name=n>4</a>'
        "<a href=it's.zip>5</a><abbr href=no><script>'<a href=no>'</script><a href=\"six.zip\"/>6</a>"
        "<style>a > b {} <a href=no></style>1 < 2 <a href=''>7</a><!-- open <a href=no>"
    )
    pages = spark.createDataFrame([(1, "https://h/R/x.html", html), (2, "https://h/", None), (3, "https://h/", "")], "page_id int, url string, html string")
    got = links.extract_links(pages).orderBy("pos").collect()
    assert [r["href"] for r in got] == ["one.zip", "two.zip?a=1&b=2\u20ac&lt;&bad;\ufffd", "three.zip", "it's.zip", "six.zip", ""]
    assert [r["link"] for r in got][0] == "https://h/B/d/one.zip" and {r["page_id"] for r in got} == {1}


def test_long_hostile_pages_are_linear(spark):
    pages = [(1, "https://a.example/", bad * 100_000) for bad in ("<a href=", "<!--", "<a href='", "='\"", "<a ", "&#", "< ")]
    found = links.extract_links(spark.createDataFrame(pages, "page_id int, url string, html string"))
    assert found.count() <= len(pages)


def test_long_page_without_links_is_linear(spark):
    html = "<p>" + "word " * 400_000 + "</p>"
    pages = spark.createDataFrame([(1, "https://a.example/", html)], "page_id int, url string, html string")
    assert links.extract_links(pages).count() == 0


def test_climate_documents(spark):
    def graph(values):
        return {"dataConfig": {"series": {"groups": [{"dateTime": "2020-01-01 00:00:00", "points": [{"x": 1, "y": v} for v in values]}]}}}

    doc = json.dumps({"data": {"climateGraphs": {"avg-wind-speed": graph([1, 3]), "max-wind-speed": graph([9])}}})
    df = spark.createDataFrame([("NSW1", doc)], "regionid string, json string")
    points = climate.flatten_climate(df, "json")
    assert {(r["metric"], r["value"]) for r in points.collect()} == {("avg_wind_speed_km_per_h", 1.0), ("avg_wind_speed_km_per_h", 3.0), ("max_wind_speed_km_per_h", 9.0)}
    out = climate.daily_metrics(points, ["avg_wind_speed_km_per_h", "max_wind_speed_km_per_h"]).first()
    assert (out["date"], out["avg_wind_speed_km_per_h"], out["max_wind_speed_km_per_h"]) == (dt.date(2020, 1, 1), 2.0, 9.0)


def write_weather(folder, prefix, city, column, values):
    lines = [f"Product code,Bureau station number,Year,Month,Day,{column},Quality"]
    lines += [f"X,1,2020,01,{i + 1:02d},{'' if v is None else v},Y" for i, v in enumerate(values)]
    (folder / f"{prefix}{city}.csv").write_text("\n".join(lines) + "\n")


def test_weather_files(spark, tmp_path):
    write_weather(tmp_path, "weather_", "sydney", weather.TEMPERATURE_COLUMN, [20, None, 24])
    write_weather(tmp_path, "weather_", "hobart", weather.TEMPERATURE_COLUMN, [10])
    got = weather.read_temperature(spark, str(tmp_path / "weather_*.csv"))
    assert {(r["regionid"], r["date_local"].day, r["temperature"]) for r in got.collect()} == {("NSW1", 1, 20.0), ("NSW1", 2, None), ("NSW1", 3, 24.0), ("TAS1", 1, 10.0)}
    (tmp_path / "sun").mkdir()
    write_weather(tmp_path / "sun", "sunshine-", "dubbo", weather.SUNSHINE_COLUMN, [3.6])
    assert weather.read_sunshine(spark, str(tmp_path / "sun")).first()["solar_exposure"] == pytest.approx(1.0)
    write_weather(tmp_path / "sun", "sunshine-", "atlantis", weather.SUNSHINE_COLUMN, [3.6])
    with pytest.raises(ExpectationError, match="known region"):
        weather.read_sunshine(spark, str(tmp_path / "sun"))


def test_population_sheet(spark, tmp_path):
    header = "x,junk," + ",".join(f"c{i}" for i in range(9))
    body = ["Unit,,000,,,,,,,,"] * 9 + ["Jun-2010,j,100,200,300,400,500,600,700,10,9999", "Jun-1990,j,1,2,3,4,5,6,7,8,9"]
    (tmp_path / "pop.csv").write_text("\n".join([header, *body]) + "\n")
    out = tables.population_sheet(tables.read_text_table(spark, str(tmp_path / "pop.csv")))
    assert {(r["regionid"], r["date"], r["population"]) for r in out.collect()} == {
        ("NSW1", dt.date(2010, 6, 1), 110.0), ("VIC1", dt.date(2010, 6, 1), 200.0), ("QLD1", dt.date(2010, 6, 1), 300.0),
        ("SA1", dt.date(2010, 6, 1), 400.0), ("TAS1", dt.date(2010, 6, 1), 600.0),
    }


def test_small_tables(spark, tmp_path):
    (tmp_path / "h.csv").write_text("Date,regionid\n2020-01-01,NSW1\n")
    assert tuple(tables.read_holidays(spark, str(tmp_path / "h.csv")).first()) == (dt.date(2020, 1, 1), "NSW1")
    (tmp_path / "t.csv").write_text("date,direction\n2020-04-05,stop\n")
    assert tuple(tables.read_transitions(spark, str(tmp_path / "t.csv")).first()) == (dt.date(2020, 4, 5), "stop")


def test_dot_steps_are_resolved_and_siblings_are_no_children(spark):
    page = "http://h/R/CURRENT/"
    html = " ".join(f'<a href="{h}">x</a>' for h in ("../ARCHIVE/y.zip", "./a.zip", "sub/../b.zip", "../CURRENT2/c.zip", "/R/CURRENT/d.zip"))
    found = links.extract_links(spark.createDataFrame([(1, page, html)], "page_id int, url string, html string"))
    assert [r["link"] for r in found.orderBy("pos").collect()] == [
        "http://h/R/ARCHIVE/y.zip", "http://h/R/CURRENT/a.zip", "http://h/R/CURRENT/b.zip", "http://h/R/CURRENT2/c.zip", "http://h/R/CURRENT/d.zip",
    ]
    kept = links.link_inventory(found, skip=(), roll_up=None)
    assert sorted(r["file_name"] for r in kept.collect()) == ["a.zip", "b.zip", "d.zip"]


def test_csv_columns_by_name_and_line_breaks(spark, tmp_path):
    for name, text in (("a", "X,Y\n1,2\n"), ("b", "Y,X\n20,10\n"), ("c", 'Y,Z\n"3\n4",5\n')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.csv").write_text(text)
    schema = T.StructType([T.StructField("X", T.IntegerType()), T.StructField("Y", T.StringType())])
    got = typed.read_typed_csv(spark, [str(tmp_path / n) for n in "abc"], schema, multi_line=True)
    assert sorted(((r["X"], r["Y"]) for r in got.collect()), key=str) == [(1, "2"), (10, "20"), (None, "3\n4")]
    # one path with two headers is refused
    (tmp_path / "a" / "g.csv").write_text("Y,X\n20,10\n")
    with pytest.raises(Exception, match="(?i)header"):
        typed.read_typed_csv(spark, str(tmp_path / "a"), schema).collect()
