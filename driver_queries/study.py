"""Side inputs and the whole study: panel, model frame, models, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.operators import grid
from panelspark.operators.joins import sized_join
from panelspark.operators.quality import verdicts
from panelspark.plans import describe, models, panel
from panelspark.session import scratch_folder
from panelspark.sources import tables, typed
from panelspark.stats.wls import coefficient_table, stat_table

from .calendars import CALENDAR_SQL, REGION_LIST, REGIONS, _calendar, _panel, _transitions
from .registry import query
from .windows import DAILY, LINE, _daily

SHEET_SQL = """
WITH m AS (
  SELECT date_trunc('month', o_orderdate)::DATE AS date, {counts} FROM orders GROUP BY ALL),
wide AS (SELECT date, c0 + c7 AS "NSW1", c1 AS "VIC1", c2 AS "QLD1", c3 AS "SA1", c5 AS "TAS1" FROM m
  WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'),
long AS (UNPIVOT wide ON "NSW1", "VIC1", "QLD1", "SA1", "TAS1" INTO NAME regionid VALUE population)
""".format(counts=", ".join(f"count(*) FILTER (o_custkey % 9 = {i})::DOUBLE AS c{i}" for i in range(9)))
# the years the orders fill
SHEET_DAYS = ("1995-01-01", "2001-12-31")


def _sheet(t):
    """Orders per month as the spreadsheet would show them: text, with other rows in between."""
    counts = [F.count_if(F.col("o_custkey") % 9 == i).cast("string").alias(f"c{i}") for i in range(9)]
    months = t.orders.groupBy(
        F.date_format("o_orderdate", "MMM-yyyy").alias("month")
    ).agg(*counts)
    preamble = t.orders.groupBy(F.col("o_orderpriority").alias("month")).agg(
        *[F.lit("Persons").alias(f"c{i}") for i in range(9)]
    )
    return months.unionByName(preamble).select("month", F.lit("unused").alias("note"), *[f"c{i}" for i in range(9)])


@query(SHEET_SQL + "SELECT date, regionid, population FROM long")
def population_sheet(t):
    return tables.population_sheet(_sheet(t), *SHEET_DAYS)


@query(SHEET_SQL + """
, g AS (SELECT regionid, CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT regionid FROM long)),
c AS (SELECT g.regionid, g.date, population AS v FROM g LEFT JOIN long USING (regionid, date)),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN date END IGNORE NULLS) OVER p AS d0, last_value(v IGNORE NULLS) OVER p AS v0,
   first_value(CASE WHEN v IS NOT NULL THEN date END IGNORE NULLS) OVER f AS d1, first_value(v IGNORE NULLS) OVER f AS v1
 FROM c WINDOW p AS (PARTITION BY regionid ORDER BY date ROWS UNBOUNDED PRECEDING),
   f AS (PARTITION BY regionid ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT regionid, date, round(CASE WHEN v IS NOT NULL THEN v WHEN d0 IS NOT NULL AND d1 IS NOT NULL
  THEN v0 + (v1 - v0) * (date - d0) / (d1 - d0) ELSE coalesce(v0, v1) END, 6) AS population FROM k
""")
def population_daily(t):
    sheet = tables.population_sheet(_sheet(t), *SHEET_DAYS)
    out = panel.daily_series(sheet, "date", "population", start=SHEET_DAYS[0], end=SHEET_DAYS[1])
    return out.withColumn("population", F.round("population", 6))


@query(DAILY.replace("c AS (SELECT g.user_id, g.d, d.v", "c0 AS (SELECT g.user_id, g.d, d.v") + """
, c AS (SELECT user_id, d, coalesce(v, avg(v) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS v FROM c0)
""" + LINE + """
SELECT user_id, d, round(CASE WHEN v IS NOT NULL THEN v WHEN d0 IS NOT NULL AND d1 IS NOT NULL
  THEN v0 + (v1 - v0) * (d - d0) / (d1 - d0) END, 6) AS v FROM k
""")
def weather_fill(t):
    return panel.filled_weather(_daily(t), "v", "d", "user_id").withColumn("v", F.round("v", 6))


STUDY_SQL = CALENDAR_SQL + f"""
, energy AS (SELECT regionid, hh_end, sum(CAST(v * 100 AS BIGINT)) / 970000.0 AS e, count(*) AS n FROM panel GROUP BY ALL),
side AS (SELECT regionid, CAST(hh_end AS DATE) AS d, 1000 + count(*) AS population, count(*) / 3.0 AS temperature FROM panel GROUP BY ALL),
holidays AS (
  SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, {REGIONS}[1 + o_custkey % 5] AS regionid FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'),
loc AS (
  SELECT energy.*, ((hh_end AT TIME ZONE 'Australia/Brisbane') AT TIME ZONE tz) AS hh_end_local FROM energy
  JOIN (SELECT DISTINCT regionid, tz FROM panel) USING (regionid)),
dated AS (SELECT *, hh_end_local - INTERVAL 30 MINUTE AS hh_start_local, CAST(hh_end_local - INTERVAL 30 MINUTE AS DATE) AS date_local FROM loc),
cal AS (
  SELECT dated.*, calendar.* EXCLUDE (d), holidays.d IS NOT NULL AS public_holiday, population, temperature,
    dated.regionid <> 'QLD1' AS dst_here_anytime, dayofweek(date_local) IN (0, 6) AS weekend_local,
    hour(hh_start_local) >= 12 AND hour(hh_end_local) < 15 AND hour(hh_start_local) <= hour(hh_end_local) AS midday,
    CASE WHEN dst_direction = 'start' THEN hh_end_local > CAST(dst_date AS TIMESTAMP)
      WHEN dst_direction = 'stop' THEN hh_end_local <= CAST(dst_date AS TIMESTAMP) END AS dst_now_anywhere
  FROM dated LEFT JOIN calendar ON calendar.d = date_local
    LEFT JOIN holidays ON holidays.d = date_local AND holidays.regionid = dated.regionid
    LEFT JOIN side ON side.d = date_local AND side.regionid = dated.regionid),
pc AS (SELECT *, e / population * 1000 AS energy, e / 2 / population * 1000 AS co2 FROM cal WHERE date_local BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'),
mid AS (SELECT regionid, date_local, CASE WHEN count(*) = count(co2) THEN avg(co2) END AS co2_mid FROM pc WHERE midday GROUP BY ALL),
study AS (SELECT pc.*, co2_mid, (co2 - co2_mid) * 1000 AS co2_vs FROM pc LEFT JOIN mid USING (regionid, date_local))
"""


def _study(t):
    energy = (
        _panel(t)
        .groupBy("regionid", "hh_end")
        .agg((F.sum(F.round(F.col("v") * 100).cast("bigint")) / 970000.0).alias("energy_mwh"))
        .withColumns(
            {
                "d": F.to_date("hh_end"),
                "co2_t": F.col("energy_mwh") / 2,
                "energy_mwh_adj_rooftop_solar": F.col("energy_mwh"),
                "total_renewables_today_mwh": F.col("energy_mwh"),
                "total_renewables_today_mwh_uigf": F.col("energy_mwh"),
            }
        )
    )
    side = _panel(t).groupBy("regionid", F.to_date("hh_end").alias("date_local")).agg(F.count(F.lit(1)).alias("n"))
    region = F.element_at(F.array(*[F.lit(r) for r in REGION_LIST]), (F.col("o_custkey") % 5 + 1).cast("int"))
    holidays = t.orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(
        F.to_date("o_orderdate").alias("date"), region.alias("regionid")
    )
    keys = ["regionid", "date_local"]
    return panel.build_panel(
        energy,
        _transitions(t).where("tz = 'Australia/Sydney'").drop("tz"),
        holidays.distinct(),
        side.select(*keys, (F.col("n") + 1000).alias("population")),
        side.select(*keys, (F.col("n") / 3.0).alias("temperature")),
        side.select(*keys, (F.col("n") / 7.0).alias("solar_exposure")),
        side.select(*keys, (F.col("n") * 2.0).alias("wind_km_per_h")),
        SHEET_DAYS,
        strict=False,
    )


@query(STUDY_SQL + """
SELECT regionid, hh_end AS hh_end_fixed, date_local, public_holiday, dst_transition_id, days_into_dst::DOUBLE AS days_into_dst, dst_now_anywhere,
  dst_here_anytime AND dst_now_anywhere AS dst_now_here, population::DOUBLE AS population, round(temperature, 6) AS temperature,
  round(energy, 6) AS energy_kwh_per_capita, round(co2_mid, 6) AS co2_kg_per_capita_midday, round(co2_vs, 4) + 0.0::DOUBLE AS co2_g_per_capita_vs_midday
FROM study
""")
def study_panel(t):
    return _study(t).select(
        "regionid",
        "hh_end_fixed",
        "date_local",
        "public_holiday",
        "dst_transition_id",
        F.col("days_into_dst").cast("double").alias("days_into_dst"),
        "dst_now_anywhere",
        "dst_now_here",
        F.col("population").cast("double").alias("population"),
        F.round("temperature", 6).alias("temperature"),
        F.round("energy_kwh_per_capita", 6).alias("energy_kwh_per_capita"),
        F.round("co2_kg_per_capita_midday", 6).alias("co2_kg_per_capita_midday"),
        (F.round("co2_g_per_capita_vs_midday", 4) + 0.0).alias("co2_g_per_capita_vs_midday"),
    )


@query(STUDY_SQL + """
SELECT regionid, hh_end AS hh_end_fixed, coalesce(dst_now_anywhere, false)::INT::DOUBLE AS dst_now_anywhere, dst_here_anytime::INT::DOUBLE AS dst_here_anytime,
  public_holiday::INT::DOUBLE AS public_holiday, weekend_local::INT::DOUBLE AS weekend_local, (NOT midday)::INT::DOUBLE AS not_midday,
  (CASE WHEN dst_here_anytime THEN days_into_dst END)::DOUBLE AS timevar, round((population - 1000) * 2.0 * (population - 1000) * 2.0 * (population - 1000) * 2.0 / 10000, 8) AS wind_3,
  round(CASE WHEN co2 > 0 THEN ln(co2) END, 8) AS ln_co2, round(CASE WHEN co2_vs > 0 THEN ln(co2_vs) END, 6) AS ln_co2_vs_midday
FROM study
""")
def model_frame(t):
    return models.model_frame(_study(t)).select(
        "regionid",
        "hh_end_fixed",
        "dst_now_anywhere",
        "dst_here_anytime",
        "public_holiday",
        "weekend_local",
        "not_midday",
        F.col("timevar").cast("double").alias("timevar"),
        F.round("wind_3", 8).alias("wind_3"),
        F.round("ln_co2", 8).alias("ln_co2"),
        F.round("ln_co2_vs_midday", 6).alias("ln_co2_vs_midday"),
    )


@query(STUDY_SQL + """
, f AS (SELECT dst_here_anytime AS a, coalesce(dst_now_anywhere, false) AS p, co2 AS y, population AS w FROM study WHERE co2 IS NOT NULL),
c AS (SELECT a, p, sum(w * y) / sum(w) AS m FROM f GROUP BY ALL),
k AS (SELECT max(m) FILTER (NOT a AND NOT p) AS c00, max(m) FILTER (a AND NOT p) AS c10, max(m) FILTER (NOT a AND p) AS c01, max(m) FILTER (a AND p) AS c11 FROM c)
SELECT 'co2_base' AS model, unnest(['_cons', 'dst_here_anytime', 'dst_now_anywhere', 'dst_here_anytime#dst_now_anywhere']) AS term,
  unnest([round(c00, 8), round(c10 - c00, 8), round(c01 - c00, 8), round(c11 - c10 - c01 + c00, 8)]) AS coef FROM k
""")
def study_base_model(t):
    fits = models.estimate(models.model_frame(_study(t)), {"co2_base": models.SPECS["co2_base"]})
    return coefficient_table(t.spark, fits).select("model", "term", F.round("coef", 8).alias("coef"))


@query(STUDY_SQL + """
, copies AS (
  SELECT 'as built' AS copy, date_local, dst_transition_id, population, energy FROM study
  UNION ALL SELECT 'broken', date_local, CASE WHEN regionid <> 'TAS1' THEN dst_transition_id END,
    CASE WHEN regionid <> 'SA1' THEN population END, energy FROM study),
holds AS (
  SELECT copy, bool_and(date_local IS NOT NULL) AS "every row has a local date",
    bool_and(dst_transition_id IS NOT NULL) AS "every row belongs to a clock change",
    bool_and(population IS NOT NULL) AS "every row has a population",
    bool_and(energy IS NOT NULL) AS "every row has energy",
    count(*) FILTER (population IS NULL) <= 1 AS "one row lacks wind at most" FROM copies GROUP BY copy)
SELECT copy, name AS "check", value AS holds FROM (UNPIVOT holds ON COLUMNS(* EXCLUDE (copy)) INTO NAME name VALUE value)
""")
def panel_checks(t):
    """The panel's checks on the panel as built and on a copy with gaps."""
    built = _study(t)
    gaps = {
        "dst_transition_id": F.when(F.col("regionid") != "TAS1", F.col("dst_transition_id")),
        "population": F.when(F.col("regionid") != "SA1", F.col("population")),
        "wind_km_per_h": F.when(F.col("regionid") != "SA1", F.col("wind_km_per_h")),
    }
    copies = {"as built": built, "broken": built.withColumns(gaps)}
    told = [verdicts(df, panel.panel_checks()).withColumn("copy", F.lit(name)) for name, df in copies.items()]
    return told[0].unionByName(told[1]).select("copy", "check", "holds")


@query()
def study_models(t):
    """Controls, triple difference, logs and event studies on the panel: every statistic of each model."""
    frame = models.model_frame(_study(t))
    chosen = ["co2_did", "co2_ddd", "ln_energy_ddd", "co2_midday_event", "co2_midday_event_start"]
    fits = models.estimate(frame, {name: models.SPECS[name] for name in chosen})
    coefs = coefficient_table(t.spark, fits).select("model", F.col("term").alias("name"), F.col("coef").alias("value"))
    return coefs.unionByName(stat_table(t.spark, fits).withColumnRenamed("stat", "name"))


@query("""
SELECT o_orderkey, o_orderdate, CASE WHEN month(o_orderdate) = 6 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice,
  CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders
""")
def partitioned_rewrite(t):
    """Write by year and month, then replace the Junes only."""
    folder = scratch_folder(t.spark, "orders")
    orders = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    typed.write_by_month(orders, folder, "o_orderdate")
    junes = orders.where(F.month("o_orderdate") == 6).withColumn("o_totalprice", -F.col("o_totalprice"))
    typed.write_by_month(junes, folder, "o_orderdate")
    return t.spark.read.parquet(folder)


@query("SELECT event_id, date_trunc('second', ts) AS at, value, event_type, NULL::INTEGER AS absent FROM events")
def typed_csv_scan(t):
    """Events written as gzip CSV with two timestamp formats and read back by schema."""
    folder = scratch_folder(t.spark, "events")
    stamp = F.date_format("ts", "yyyy/MM/dd HH:mm:ss")
    text = t.events.select(
        F.col("event_type").alias("EVENT_TYPE"),
        F.when(F.col("event_id") % 2 == 0, stamp).otherwise(F.concat(stamp, F.lit(".000"))).alias("AT"),
        F.col("event_id").alias("EVENT_ID"),
        F.col("value").alias("VALUE"),
    )
    text.write.option("header", True).option("compression", "gzip").csv(folder)
    schema = T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("at", T.TimestampNTZType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("event_type", T.StringType()),
            T.StructField("absent", T.IntegerType()),
        ]
    )
    return typed.read_typed_csv(t.spark, folder, schema)


@query("SELECT event_id, date_trunc('second', ts) AS at, value, event_type FROM events")
def typed_csv_mixed_headers(t):
    """Events in two sets of files whose columns differ in order, one with line breaks in a value."""
    stamp = F.date_format("ts", "yyyy/MM/dd HH:mm:ss").alias("AT")
    folders = [scratch_folder(t.spark, "events") for _ in range(2)]
    id, kind, value = F.col("event_id").alias("EVENT_ID"), F.col("event_type").alias("EVENT_TYPE"), F.col("value").alias("VALUE")
    odd = F.col("event_id") % 2 == 1
    note = F.concat(F.lit("first\n"), F.col("event_type")).alias("NOTE")
    t.events.where(~odd).select(id, kind, stamp, value).write.option("header", True).csv(folders[0])
    t.events.where(odd).select(value, note, stamp, kind, id).write.option("header", True).csv(folders[1])
    schema = T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("at", T.TimestampNTZType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("event_type", T.StringType()),
        ]
    )
    return typed.read_typed_csv(t.spark, folders, schema, multi_line=True)


SPAN_SQL = """
WITH k AS (SELECT DISTINCT c_mktsegment FROM customer), s AS (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders)
SELECT c_mktsegment, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM k, s
"""


@query(SPAN_SQL)
def time_grid(t):
    low, high = grid.span(t.orders, "o_orderdate")
    segments = t.customer.select("c_mktsegment").distinct()
    return grid.time_grid(segments, F.to_date(low), F.to_date(high), "1 day", "d")


@query(CALENDAR_SQL + """
SELECT dst_transition_id, count(*) AS orders, min(d) AS first_day, max(d) AS last_day
FROM orders JOIN calendar ON CAST(o_orderdate AS DATE) = d GROUP BY ALL
""")
def orders_per_transition(t):
    dated = t.orders.select(F.to_date("o_orderdate").alias("d"))
    return (
        sized_join(dated, _calendar(t), ["d"], written=True)
        .groupBy("dst_transition_id")
        .agg(F.count(F.lit(1)).alias("orders"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))
    )


@query(STUDY_SQL + """
SELECT name, round(value, 8) AS value, treated, post, not_midday FROM (
  WITH f AS (SELECT regionid = 'QLD1' AS treated, dst_now_anywhere AS post, NOT midday AS not_midday, co2 AS y, population AS w FROM study WHERE co2 IS NOT NULL),
  m AS (SELECT treated, post, not_midday, sum(w * y) / sum(w) AS mean FROM f GROUP BY ALL),
  s AS (SELECT f.treated, f.post, f.not_midday, any_value(mean) AS co2, sqrt(sum(w * (y - mean) ** 2) / ((count(*) - 1.0) / count(*) * sum(w))) AS co2_se
    FROM f JOIN m ON f.treated = m.treated AND f.post = m.post AND f.not_midday = m.not_midday GROUP BY ALL)
  UNPIVOT s ON co2, co2_se INTO NAME name VALUE value)
""")
def study_cell_means(t):
    known = _study(t).where("dst_now_anywhere IS NOT NULL AND co2_kg_per_capita IS NOT NULL")
    out = describe.panel_cell_means(known)
    return out.select(
        "name",
        F.round("value", 8).alias("value"),
        "treated",
        F.col("dst_now_anywhere").alias("post"),
        F.col("not_midday_control_local").alias("not_midday"),
    )
