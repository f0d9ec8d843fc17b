"""Multi-table files, catalogue rules, typed values, links and nested documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.operators.chunks import number_rows
from panelspark.session import scratch_folder, written
from panelspark.sources import catalogue, climate, containers, links, quarantine, sections, typed

from .registry import query


def _text(c):
    return F.col(c).cast("string")


def _records(t):
    """Every order as a report of its own: a section with the order, one with its lines."""
    def row(*fields):
        return F.array(*[F.lit(f) if isinstance(f, str) else f for f in fields])

    orders = t.orders.select(
        _text("o_orderkey").alias("member"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("part"), row("C", "SETP", "X", "Y", "Z", F.date_format("o_orderdate", "yyyy/MM/dd"), "00:05:00").alias("fields")),
                F.struct(F.lit(1).alias("part"), row("I", "SALES", "", "1", "KEY", "CUSTOMER", "TOTAL").alias("fields")),
                F.struct(F.lit(2).alias("part"), row("D", "SALES", "", "1", _text("o_orderkey"), _text("o_custkey"), _text("o_totalprice")).alias("fields")),
                F.struct(F.lit(3).alias("part"), row("I", "SALES", "LINES", "2", "PART", "QTY", "NOTE").alias("fields")),
            )
        ).alias("r"),
    ).select("member", F.lit(0).cast("bigint").alias("sub"), "r.part", "r.fields")
    lines = t.lineitem.select(
        _text("l_orderkey").alias("member"),
        F.xxhash64(*[F.col(c) for c in t.lineitem.columns]).alias("sub"),
        F.lit(4).alias("part"),
        row("D", "SALES", "LINES", "2", _text("l_partkey"), _text("l_quantity"), "a \n b").alias("fields"),
    )
    both = orders.unionByName(lines)
    # a running number per file; the order column is fine enough to be cut anywhere
    placed = both.withColumn("place", F.col("part") + (F.col("sub") / F.lit(2.0**64) + 0.5))
    ordered = number_rows(placed, ["member"], ["place", "sub"], "record_no", sized_by=both.select("member"))
    counts = both.groupBy("member").agg((F.count(F.lit(1)) + 1).alias("record_no"))
    closing = counts.select("member", "record_no", row("C", "END OF REPORT", _text("record_no")).alias("fields"))
    records = ordered.select("member", "record_no", "fields").unionByName(closing)
    # the records as a written table, as an ingest job would leave them
    return written(records.withColumn("path", F.lit("orders.zip")), "records")


@query("""
SELECT 'SALES' AS report_name, 'LINES' AS report_subtype, '2' AS schema_version, strftime(o_orderdate, '%Y_%m_%d') || '_00_05_00' AS top_timestamp,
  l_partkey::DOUBLE AS part, l_quantity AS qty, NULL::DOUBLE AS total, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
UNION ALL
SELECT 'SALES', 'NULL', '1', strftime(o_orderdate, '%Y_%m_%d') || '_00_05_00', NULL, NULL, o_totalprice, count(*) FROM orders GROUP BY ALL
""")
def section_split_roundtrip(t):
    plain = _records(t)
    # the verdicts need no headers
    good, _ = sections.split_good_bad(sections.attach_headers(plain), sections.validate_sections(plain))
    rows = sections.split_sections(good)

    def value(name, dtype):
        return F.try_element_at(F.col("values"), F.lit(name)).try_cast(dtype)

    return rows.groupBy(
        "report_name",
        "report_subtype",
        "schema_version",
        "top_timestamp",
        value("PART", "double").alias("part"),
        value("QTY", "double").alias("qty"),
        value("TOTAL", "double").alias("total"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS member, true AS is_report,
  CASE WHEN o_custkey % 7 = 0 THEN 'closing count does not match' WHEN o_custkey % 7 = 1 THEN 'no closing record'
    WHEN o_custkey % 7 = 2 THEN 'records after the end' END AS problem
FROM orders
""")
def section_validation(t):
    """Damage some of the reports and find out which."""
    damage = t.orders.select(_text("o_orderkey").alias("member"), (F.col("o_custkey") % 7).alias("kind"))
    records = _records(t).join(damage, "member")
    end = F.get("fields", F.lit(1)) == "END OF REPORT"
    wrong = F.array(F.lit("C"), F.lit("END OF REPORT"), F.lit("0"))
    late = F.array(F.lit("D"), F.lit("late"))
    this, no = F.struct("record_no", "fields"), F.col("record_no")
    # one reading of the joined records: a record that stays gives one or two
    left = (
        F.when(end & (F.col("kind") == 0), F.array(F.struct(no, wrong.alias("fields"))))
        .when(end & (F.col("kind") == 2), F.array(this, F.struct((no + 1).alias("record_no"), late.alias("fields"))))
        .otherwise(F.array(this))
    )
    damaged = records.where(~(end & (F.col("kind") == 1))).select("path", "member", F.explode(left).alias("r")).select("path", "member", "r.*")
    return sections.validate_sections(damaged).select("member", "is_report", "problem")


@query("""
WITH rows AS (SELECT l_returnflag AS report_name, CASE WHEN l_linenumber = 7 THEN 'NULL' ELSE CAST(l_linenumber AS VARCHAR) END AS report_subtype FROM lineitem),
mapping AS (
  SELECT DISTINCT l_returnflag AS report_name, CASE WHEN l_linenumber = 7 THEN 'NULL' ELSE CAST(l_linenumber AS VARCHAR) END AS report_subtype,
    l_returnflag || '_' || CASE WHEN l_linenumber IN (2, 4) THEN l_linestatus ELSE 'X' || l_linenumber END AS table_name
  FROM lineitem WHERE l_linenumber <> 5),
one AS (SELECT report_name, report_subtype, min(table_name) AS table_name FROM mapping GROUP BY ALL HAVING count(DISTINCT table_name) = 1)
SELECT report_name, report_subtype, coalesce(table_name, CASE WHEN report_name = 'R' AND report_subtype = '5' THEN 'R_FIVE' END) AS table_name, count(*) AS n
FROM rows LEFT JOIN one USING (report_name, report_subtype)
WHERE coalesce(table_name, CASE WHEN report_name = 'R' AND report_subtype = '5' THEN 'R_FIVE' END) NOT IN ('A_X1') GROUP BY ALL
""")
def map_tables(t):
    number = F.col("l_linenumber")
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("report_name"),
        F.when(number == 7, "NULL").otherwise(number.cast("string")).alias("report_subtype"),
    )
    suffix = F.when(number.isin(2, 4), F.col("l_linestatus")).otherwise(F.concat(F.lit("X"), number.cast("string")))
    mapping = (
        t.lineitem.where(number != 5)
        .select(
            F.col("l_returnflag").alias("report_name"),
            F.when(number == 7, "").otherwise(number.cast("string")).alias("report_subtype"),
            F.concat(F.col("l_returnflag"), F.lit("_"), suffix).alias("table_name"),
        )
        .distinct()
    )
    mapped = sections.map_tables(rows, mapping, {("R", "5"): "R_FIVE"}, skip=["A_X1"])
    return mapped.groupBy("report_name", "report_subtype", "table_name").agg(F.count(F.lit(1)).alias("n"))


TYPES_SQL = """
WITH c AS (
  SELECT p_partkey, p_brand AS table_name, p_name AS column_name, p_type, CASE p_partkey % 6
    WHEN 0 THEN 'NUMBER(' || p_size || ',0)' WHEN 1 THEN 'NUMBER (' || p_size || ', 2)' WHEN 2 THEN 'VARCHAR2(' || p_size || ')'
    WHEN 3 THEN 'DATE' WHEN 4 THEN 'number(' || p_size || ')' ELSE 'BLOB' END AS source_type, p_size
  FROM part)
"""


def _catalogue(t):
    size = F.col("p_size").cast("string")
    kinds = [
        F.concat(F.lit("NUMBER("), size, F.lit(",0)")),
        F.concat(F.lit("NUMBER ("), size, F.lit(", 2)")),
        F.concat(F.lit("VARCHAR2("), size, F.lit(")")),
        F.lit("DATE"),
        F.concat(F.lit("number("), size, F.lit(")")),
    ]
    source = F.lit("BLOB")
    for i, kind in enumerate(kinds):
        source = F.when(F.col("p_partkey") % 6 == i, kind).otherwise(source)
    return t.part.select(
        "p_partkey",
        F.col("p_brand").alias("table_name"),
        F.col("p_name").alias("column_name"),
        F.col("p_type"),
        source.alias("source_type"),
        F.col("p_partkey").alias("table_ordinal"),
        (F.col("p_partkey") % 4 == 0).alias("is_pk"),
    )


@query(TYPES_SQL + """
SELECT p_partkey, source_type, CASE p_partkey % 6 WHEN 1 THEN 'double' WHEN 2 THEN 'string' WHEN 3 THEN 'timestamp_ntz' WHEN 5 THEN NULL
  ELSE CASE WHEN p_size <= 2 THEN 'tinyint' WHEN p_size <= 4 THEN 'smallint' WHEN p_size <= 9 THEN 'int' ELSE 'bigint' END END AS spark_type
FROM c
""")
def type_mapping(t):
    return _catalogue(t).select("p_partkey", "source_type", catalogue.spark_type_column("source_type").alias("spark_type"))


@query(TYPES_SQL + """
SELECT 'NEW' AS table_name, column_name, arg_max(source_type, p_partkey) AS source_type FROM c GROUP BY column_name
""")
def borrowed_types(t):
    known = _catalogue(t)
    wanted = known.select(F.lit("NEW").alias("table_name"), "column_name").distinct()
    return catalogue.borrow_types(known, wanted).select("table_name", "column_name", "source_type")


@query("""
SELECT p_brand AS table_name, p_type || '_' || p_partkey AS column_name FROM part
WHERE p_brand IN ('Brand#1', 'Brand#2') AND (p_type LIKE 'ECON%' OR p_type LIKE 'SMALL%') AND p_partkey % 4 <> 0
""")
def columns_to_drop(t):
    known = _catalogue(t).withColumn("column_name", F.concat_ws("_", "p_type", _text("p_partkey")))
    return catalogue.columns_to_drop(known, ("Brand#1", "Brand#2"), "^(?i)(econ|small)")


@query("""
SELECT event_id, date_trunc('second', ts) AS at, CAST(user_id AS SMALLINT) AS user_id, value, NULL::INTEGER AS bad, NULL::VARCHAR AS absent,
  CAST(event_id % 9 AS TINYINT) AS schema_version FROM events
""")
def typed_columns(t):
    stamp = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).otherwise(
        F.concat(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.lit(".000"))
    )
    pairs = {"AT": stamp, "USER_ID": _text("user_id"), "VALUE": _text("value"), "BAD": F.col("event_type"), "EVENT_ID": _text("event_id")}
    rows = t.events.select(
        F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]).alias("values"),
        (F.col("event_id") % 9).cast("string").alias("schema_version"),
    )
    schema = T.StructType(
        [
            T.StructField("EVENT_ID", T.LongType()),
            T.StructField("AT", T.TimestampNTZType()),
            T.StructField("USER_ID", T.ShortType()),
            T.StructField("VALUE", T.DoubleType()),
            T.StructField("BAD", T.IntegerType()),
            T.StructField("ABSENT", T.StringType()),
        ]
    )
    out = typed.typed_table(rows, schema)
    return out.toDF(*[c.lower() for c in out.columns])


@query("""
SELECT event_id, event_type, 'k' AS key, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events
""")
def json_flatten(t):
    return climate.flatten_map(t.events, "props", ["event_id", "event_type"])


@query("""
SELECT event_type AS regionid, CAST(ts AS DATE) AS "date", round(avg(value), 6) AS avg_wind_speed_km_per_h,
  round(avg(value + 10), 6) AS max_wind_speed_km_per_h FROM events GROUP BY ALL
""")
def climate_documents(t):
    """Each event as a climate document of two metrics, flattened and averaged per day."""
    def metric(value):
        point = F.struct(F.hour("ts").cast("double").alias("x"), value.alias("y"))
        day = F.struct(F.date_format("ts", "yyyy-MM-dd 00:00:00").alias("dateTime"), F.array(point).alias("points"))
        return F.struct(F.struct(F.struct(F.array(day).alias("groups")).alias("series")).alias("dataConfig"))

    graphs = F.create_map(
        F.lit("avg-wind-speed"), metric(F.col("value")), F.lit("max-wind-speed"), metric(F.col("value") + 10)
    )
    docs = t.events.select(
        F.col("event_type").alias("regionid"),
        F.to_json(F.struct(F.struct(graphs.alias("climateGraphs")).alias("data"))).alias("json"),
    )
    metrics = ["avg_wind_speed_km_per_h", "max_wind_speed_km_per_h"]
    out = climate.daily_metrics(climate.flatten_climate(docs, "json"), metrics)
    return out.withColumns({m: F.round(m, 6) for m in metrics})


LINKS_SQL = """
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href,
    generate_subscripts(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1), 1) - 1 AS pos FROM pages),
l AS (SELECT page_id, url, CAST(pos AS INTEGER) AS pos, href, CASE
    WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
    WHEN href LIKE '//%' THEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*:') || href
    WHEN href LIKE '/%' THEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') || href
    ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '([^/:])/[^/]*$', '\\1') || '/' || href END AS link FROM a)
"""


@query(LINKS_SQL + "SELECT page_id, url, pos, href, link, NULL::BIGINT AS size FROM l")
def page_links(t):
    return links.extract_links(t.pages)


@query(LINKS_SQL + """
, h AS (SELECT *, regexp_replace(lower(regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS host,
  regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS home,
  string_split(link, '/')[-1] AS file_name FROM l)
SELECT file_name, arg_max(link, page_id * 1000000 + pos) AS link, NULL::BIGINT AS size FROM h
WHERE host = home AND link NOT LIKE '%/' AND lower(link) NOT LIKE '%fcas%' GROUP BY file_name
""")
def link_inventory(t):
    found = links.extract_links(t.pages)
    return links.link_inventory(found, suffixes=(), skip=("FCAS",), children_only=False)


def _lines(t, damaged=False):
    """Every order as a report file: packed by thousands of keys, every third one in an archive inside the archive."""
    key, kind = F.col("o_orderkey"), F.col("o_custkey") % 7
    part = F.date_format("o_orderdate", "yyyy/MM/dd")
    where = [F.concat(F.lit("a"), F.floor(key / 2000).cast("string"), F.lit(".zip")).alias("archive")]
    name = F.concat(F.lit("o"), key.cast("string"), F.lit(".csv"))
    if damaged:
        name = F.when(kind == 2, F.concat(F.lit("o"), key.cast("string"), F.lit(".zip"))).when(
            kind == 3, F.concat(F.lit("o"), key.cast("string"), F.lit(".txt"))
        ).otherwise(name)
    where.append(F.when(key % 3 == 0, F.concat(F.lit("inner.zip/"), name)).otherwise(name).alias("member"))

    def line(*fields):
        return F.encode(F.concat(F.concat_ws(",", *[F.lit(f) if isinstance(f, str) else f for f in fields]), F.lit("\n")), "utf-8")

    head = t.orders.select(
        *where,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("part"), line("C", "SETP", "X", "Y", "Z", part, "00:05:00").alias("line")),
                F.struct(F.lit(1).alias("part"), line("I", "SALES", "LINES", "2", "PART", "QTY", "FLAG", "NOTE").alias("line")),
            )
        ).alias("r"),
    ).select("archive", "member", "r.part", "r.line")
    orders = t.orders.select("o_orderkey", "o_custkey", *where)
    lines = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    flag = F.when(F.col("l_linenumber") == 1, F.lit("one")).otherwise(F.col("l_linenumber").cast("string"))
    data = line("D", "SALES", "LINES", "2", _text("l_partkey"), _text("l_quantity"), flag, F.lit('"a \n b"'))
    body = lines.select("archive", "member", F.lit(2).alias("part"), data.alias("line"))
    counts = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    closed = t.orders.select("o_orderkey", "o_custkey", *where).join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    count = F.coalesce("n", F.lit(0)) + 3
    if damaged:
        count = F.when(kind == 0, F.lit(0)).otherwise(count)
    end = closed.select("archive", "member", F.lit(4).alias("part"), line("C", "END OF REPORT", count.cast("string")).alias("line"))
    out = head.unionByName(body).unionByName(end)
    if damaged:  # bytes that are no text, after the data
        broken = orders.where(kind == 1).select("archive", "member", F.lit(3).alias("part"), F.unhex(F.lit("44FFFE0A")).alias("line"))
        out = out.unionByName(broken)
    return out


def _packed(t, damaged=False):
    """The records of archives written for the purpose."""
    folder = scratch_folder(t.spark, "archives")
    written(containers.write_archives(_lines(t, damaged), folder, "archive", "member", "part", "line"), "packed")
    return containers.read_containers(t.spark, folder)


PACKED_SQL = """
WITH f AS (SELECT o_orderkey, o_custkey % 7 AS kind, 'a' || (o_orderkey // 2000) || '.zip' AS file,
  CASE WHEN o_orderkey % 3 = 0 THEN 'inner.zip/' ELSE '' END || 'o' || o_orderkey AS stem FROM orders)
"""


@query(PACKED_SQL + """
SELECT file, stem || '.csv' AS member, 'D' AS kind, l_partkey AS part, l_quantity AS qty, count(*) AS n
FROM f JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
UNION ALL SELECT file, stem || '.csv', 'C', NULL, NULL, 2 FROM f UNION ALL SELECT file, stem || '.csv', 'I', NULL, NULL, 1 FROM f
""")
def container_roundtrip(t):
    """Orders packed into archives within archives, and read back member by member."""
    file = F.element_at(F.split("path", "/"), -1).alias("file")
    kind = F.get("fields", F.lit(0))

    def value(place, dtype):
        return F.when(kind == "D", F.get("fields", F.lit(place)).try_cast(dtype))

    records = _packed(t).where(F.col("error").isNull())
    return records.groupBy(
        file, "member", kind.alias("kind"), value(4, "bigint").alias("part"), value(5, "double").alias("qty")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(PACKED_SQL + """
SELECT file, stem || CASE kind WHEN 2 THEN '.zip' WHEN 3 THEN '.txt' ELSE '.csv' END AS member,
  CASE kind WHEN 0 THEN 'InvalidReport' WHEN 1 THEN 'UnicodeDecodeError' WHEN 2 THEN 'BadZipFile' WHEN 3 THEN 'UnknownFile' END AS error_class,
  CASE WHEN kind = 3 THEN 'warning' WHEN kind < 3 THEN 'error' ELSE 'sound' END AS verdict,
  CASE WHEN kind > 3 THEN 3 + (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) END AS records
FROM f
""")
def container_problems(t):
    """Damaged members set aside, records of sound ones committed."""
    sink = scratch_folder(t.spark, "sink")
    bad = quarantine.commit_sound(_packed(t, damaged=True), sink)
    kept = quarantine.read_committed(t.spark, sink).groupBy("path", "member").agg(F.count(F.lit(1)).alias("records"))
    file = F.element_at(F.split("path", "/"), -1).alias("file")
    none = F.lit(None)
    return bad.select(file, "member", "error_class", F.col("severity").alias("verdict"), none.cast("bigint").alias("records")).unionByName(
        kept.select(file, "member", none.cast("string").alias("error_class"), F.lit("sound").alias("verdict"), "records")
    )


@query("""
SELECT l_partkey AS part, l_quantity AS qty, CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber AS TINYINT) END AS flag, count(*) AS n,
  (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND o_custkey % 7 > 3) AS rejected
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 7 > 3 GROUP BY ALL
""")
def ingest_chain(t):
    """Archives to typed Parquet: read, set bad files aside, split, map, type, count what does not fit."""
    sink = scratch_folder(t.spark, "chain")
    quarantine.commit_sound(_packed(t, damaged=True), sink)
    rows = sections.split_sections(quarantine.read_committed(t.spark, sink))
    mapping = t.spark.createDataFrame([("SALES", "LINES", "SALES_LINES")], "report_name string, report_subtype string, table_name string")
    mapped = sections.map_tables(rows, mapping).drop("path", "member")
    kinds = {"PART": T.LongType(), "QTY": T.DoubleType(), "FLAG": T.ByteType(), "NOTE": T.StringType()}
    schema = T.StructType([T.StructField(name, dtype) for name, dtype in kinds.items()])
    counts = typed.write_typed_tables(mapped, {"SALES_LINES": schema}, f"{sink}/tables")
    rejected = counts.agg(F.sum("rejected")).first()[0]
    got = t.spark.read.parquet(f"{sink}/tables/SALES_LINES")
    per_row = got.groupBy(F.col("PART").alias("part"), F.col("QTY").alias("qty"), F.col("FLAG").alias("flag")).agg(F.count(F.lit(1)).alias("n"))
    return per_row.withColumn("rejected", F.lit(rejected).cast("bigint"))


@query("""
SELECT 'AT' AS column_name, count(*) AS filled, count(*) FILTER (event_id % 5 = 0) AS rejected FROM events
UNION ALL SELECT 'USER_ID', count(*) FILTER (event_id % 7 <> 0), count(*) FILTER (event_id % 7 <> 0 AND user_id > 127) FROM events
UNION ALL SELECT 'KIND', count(event_type), count(event_type) FROM events UNION ALL SELECT 'ABSENT', 0, 0 FROM (SELECT 1)
""")
def rejected_values(t):
    """How many values of each column do not fit its type."""
    stamp = F.when(F.col("event_id") % 5 == 0, F.lit("2020-13-45 99:00")).otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
    user = F.when(F.col("event_id") % 7 == 0, F.lit(" ")).otherwise(_text("user_id"))
    pairs = {"AT": stamp, "USER_ID": user, "KIND": F.col("event_type")}
    rows = t.events.select(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]).alias("values"))
    kinds = {"AT": T.TimestampNTZType(), "USER_ID": T.ByteType(), "KIND": T.IntegerType(), "ABSENT": T.StringType()}
    return typed.reject_counts(rows, T.StructType([T.StructField(name, dtype) for name, dtype in kinds.items()]))


@query(LINKS_SQL + "SELECT page_id, url, pos, href, link FROM l")
def page_links_hostile(t):
    """The same pages with values out of their quotes, coded letters, and links in comments and scripts."""
    bare = F.regexp_replace("html", """(?i)(<a\\s[^>]*?href\\s*=\\s*)["']([^"'\\s>]+)["']""", "$1$2")
    coded = F.regexp_replace(bare, """((?i:<a\\s[^>]*?href\\s*=\\s*)[^\\s>]*?)e""", "$1&#x65;")
    titled = F.regexp_replace(coded, r"(?i)<a\s", "<a title='a > b href=no' data-href=\"no\" ")
    noise = F.lit("<!-- <a href='no'> --><script>if (a < b) { x = \"<a href='no'>\" }</script><p a = b>1 < 2 <")
    return links.extract_links(t.pages.withColumn("html", F.concat(noise, F.lit(">"), titled, F.lit("<!-- <a href=no>")))).drop("size")


@query("""
WITH o AS (SELECT DISTINCT o_orderkey AS k, o_orderkey // 100 AS page, 'https://www.market.example/R/C' || (o_orderkey // 100) || '/' AS url FROM orders),
f AS (SELECT k, page, 'F' || (k % 997) || CASE k % 6 WHEN 0 THEN '.zip' ELSE '.CSV' END AS file_name,
  CASE k % 6 WHEN 0 THEN url ELSE url || 'sub/' END || 'F' || (k % 997) || CASE k % 6 WHEN 0 THEN '.zip' ELSE '.CSV' END AS link, k * 7 AS size
  FROM o WHERE k % 6 < 2)
SELECT file_name, arg_max(link, k) AS link, arg_max(size, k) AS size FROM f GROUP BY file_name
""")
def listed_files(t):
    """Listings of a hundred orders each with all rules on: own folder, endings, unwanted parts, roll-ups, sizes."""
    key = F.col("o_orderkey")
    page = F.floor(key / 100)
    name = F.concat(F.lit("F"), (key % 997).cast("string"))
    hrefs = [
        F.concat(name, F.lit(".zip")),
        F.concat(F.lit("/R/C"), page.cast("string"), F.lit("/sub/"), name, F.lit(".CSV")),
        F.concat(F.lit("/R/OTHER/"), name, F.lit(".zip")),
        F.concat(name, F.lit(".txt")),
        F.lit("MMSDM_2020_01.zip"),
        F.concat(F.lit("P_FCAS_"), name, F.lit(".zip")),
    ]
    href = hrefs[-1]
    for i, one in enumerate(hrefs[:-1]):
        href = F.when(key % 6 == i, one).otherwise(href)
    entry = F.concat(F.lit("<br> 1/02/2024 11:05 PM  "), (key * 7).cast("string"), F.lit(' <A HREF="'), href, F.lit('">x</A>'))
    rows = t.orders.select(page.alias("page_id"), F.struct(key.alias("k"), entry.alias("e")).alias("r")).distinct()
    pages = rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["e"]), "").alias("html"))
    url = F.concat(F.lit("https://www.market.example/R/C"), F.col("page_id").cast("string"), F.lit("/"))
    return links.link_inventory(links.extract_links(pages.withColumn("url", url)))
