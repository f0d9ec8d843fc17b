"""Local time, clock changes, holidays, midday and sun."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.plans import describe, panel

from .registry import query

ZONES = "['Australia/Brisbane', 'Australia/Sydney', 'Australia/Melbourne', 'Australia/Adelaide', 'Australia/Hobart']"
REGIONS = "['QLD1', 'NSW1', 'VIC1', 'SA1', 'TAS1']"
REGION_LIST = ("QLD1", "NSW1", "VIC1", "SA1", "TAS1")

# Every order becomes a half-hour of the region its customer lives in.
PANEL_SQL = f"""
WITH panel AS (
  SELECT o_orderkey, {REGIONS}[1 + c_nationkey % 5] AS regionid, {ZONES}[1 + c_nationkey % 5] AS tz, o_totalprice AS v,
    o_orderdate + to_minutes(CAST(30 * (o_orderkey % 48) AS INT)) AS hh_end
  FROM orders JOIN customer ON o_custkey = c_custkey),
local AS (
  SELECT *, ((hh_end AT TIME ZONE 'Australia/Brisbane') AT TIME ZONE tz) AS hh_end_local FROM panel),
timed AS (
  SELECT o_orderkey, regionid, v, hh_end AS hh_end_fixed, hh_end_local, hh_end - INTERVAL 30 MINUTE AS hh_start_fixed,
    hh_end_local - INTERVAL 30 MINUTE AS hh_start_local FROM local)
"""


def _panel(t):
    region = F.element_at(F.array(*[F.lit(r) for r in REGION_LIST]), (F.col("c_nationkey") % 5 + 1).cast("int"))
    homes = t.customer.select("c_custkey", region.alias("regionid"))
    return t.orders.join(homes, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        "regionid",
        F.col("o_totalprice").alias("v"),
        (F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 48 * 30).cast("int"))).alias("hh_end"),
    )


def _clock(c):
    midday = f"hour(hh_start_{c}) >= 12 AND hour(hh_end_{c}) < 15 AND hour(hh_start_{c}) <= hour(hh_end_{c})"
    return f"""CAST(hh_start_{c} AS DATE) AS date_{c}, {midday} AS midday_control_{c}, NOT ({midday}) AS not_midday_control_{c},
    hour(hh_start_{c}) + minute(hh_start_{c}) / 60.0 AS hr_{c}, CAST(dayofweek(hh_start_{c}) + 1 AS INTEGER) AS day_of_week_{c},
    dayofweek(hh_start_{c}) IN (0, 6) AS weekend_{c}"""


@query(PANEL_SQL + f"""
SELECT o_orderkey, regionid, hh_end_fixed, hh_end_local, hh_start_fixed, hh_start_local, {_clock('local')}, {_clock('fixed')} FROM timed
""")
def calendar_columns(t):
    return panel.calendar_columns(_panel(t)).drop("hh_end", "v")


# Offsets of each zone at every half-hour of the days its rows span.
TRANSITIONS_SQL = PANEL_SQL + """
, spans AS (SELECT tz, min(CAST(hh_end AS DATE)) AS lo, max(CAST(hh_end AS DATE)) AS hi FROM panel GROUP BY tz),
steps AS (
  SELECT tz, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 30 MINUTE)) AS utc FROM spans),
offs AS (
  SELECT tz, utc, ((utc AT TIME ZONE 'UTC') AT TIME ZONE tz) AS wall, ((utc AT TIME ZONE 'UTC') AT TIME ZONE tz) - utc AS off FROM steps),
moves AS (SELECT *, lag(off) OVER (PARTITION BY tz ORDER BY utc) AS before FROM offs),
transitions AS (
  SELECT tz, CAST(wall AS DATE) AS "date", CASE WHEN off > before THEN 'start' ELSE 'stop' END AS direction FROM moves WHERE off <> before)
"""


def _transitions(t):
    zoned = _panel(t).withColumn("tz", panel.zone_of("regionid"))
    return panel.tz_transitions(zoned, "tz", F.col("hh_end"), F.col("hh_end"))


@query(TRANSITIONS_SQL + "SELECT * FROM transitions")
def tz_transitions(t):
    return _transitions(t)


CALENDAR_SQL = TRANSITIONS_SQL + """
, e AS (SELECT "date" AS dst_date, direction AS dst_direction FROM transitions WHERE tz = 'Australia/Sydney'),
span2 AS (SELECT min(dst_date) AS lo, max(dst_date) AS hi FROM e),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM span2),
last AS (SELECT d, dst_date, dst_direction FROM days ASOF JOIN e ON d >= dst_date),
next AS (SELECT d, dst_date, dst_direction FROM days ASOF JOIN e ON d <= dst_date),
nearest AS (
  SELECT d, CASE WHEN next.dst_date - d <= d - last.dst_date THEN next.dst_date ELSE last.dst_date END AS dst_date,
    CASE WHEN next.dst_date - d <= d - last.dst_date THEN next.dst_direction ELSE last.dst_direction END AS dst_direction
  FROM last JOIN next USING (d)),
calendar AS (
  SELECT d, dst_date, dst_direction, year(dst_date) || '-' || dst_direction AS dst_transition_id,
    CAST(dst_date - d AS INTEGER) AS days_before_transition, CAST(d - dst_date AS INTEGER) AS days_after_transition,
    dst_direction = 'start' AS dst_start,
    CAST(CASE WHEN dst_direction = 'start' THEN d - dst_date ELSE dst_date - d END AS INTEGER) AS days_into_dst
  FROM nearest)
"""


def _calendar(t):
    sydney = _transitions(t).where("tz = 'Australia/Sydney'")
    return panel.transition_calendar(sydney)


@query(CALENDAR_SQL + "SELECT * FROM calendar")
def transition_calendar(t):
    return _calendar(t)


FLAGS_SQL = CALENDAR_SQL + """
, flagged AS (
  SELECT timed.*, CAST(hh_start_local AS DATE) AS date_local, calendar.* EXCLUDE (d),
    hh_end_local > CAST(dst_date AS TIMESTAMP) AS after_transition, regionid <> 'QLD1' AS dst_here_anytime,
    CASE WHEN dst_direction = 'start' THEN hh_end_local > CAST(dst_date AS TIMESTAMP)
      WHEN dst_direction = 'stop' THEN hh_end_local <= CAST(dst_date AS TIMESTAMP) END AS dst_now_anywhere
  FROM timed LEFT JOIN calendar ON CAST(hh_start_local AS DATE) = calendar.d)
"""


def _flagged(t):
    return panel.treatment_flags(panel.calendar_columns(_panel(t)), _calendar(t))


@query(FLAGS_SQL + """
SELECT o_orderkey, date_local, dst_date, dst_direction, dst_transition_id, days_before_transition::DOUBLE AS days_before_transition,
  days_after_transition::DOUBLE AS days_after_transition, dst_start, days_into_dst::DOUBLE AS days_into_dst,
  after_transition, dst_here_anytime, dst_now_anywhere, dst_here_anytime AND dst_now_anywhere AS dst_now_here,
  dst_transition_id || '-' || regionid AS dst_transition_id_and_region FROM flagged
""")
def treatment_flags(t):
    return _flagged(t).select(
        "o_orderkey",
        "date_local",
        "dst_date",
        "dst_direction",
        "dst_transition_id",
        F.col("days_before_transition").cast("double").alias("days_before_transition"),
        F.col("days_after_transition").cast("double").alias("days_after_transition"),
        "dst_start",
        F.col("days_into_dst").cast("double").alias("days_into_dst"),
        "after_transition",
        "dst_here_anytime",
        "dst_now_anywhere",
        "dst_now_here",
        "dst_transition_id_and_region",
    )


@query(FLAGS_SQL + """
, n AS (SELECT days_into_dst, count(*) AS n FROM flagged GROUP BY ALL),
known AS (SELECT * FROM n WHERE days_into_dst IS NOT NULL),
m AS (SELECT quantile_cont(n, 0.5) AS median FROM known), s AS (SELECT min(days_into_dst) AS lo, max(days_into_dst) AS hi FROM known)
SELECT days_into_dst, n, n < median AS days_into_dst_outlier, days_into_dst IN (lo, hi) AS days_into_dst_extreme_outlier FROM known, m, s
""")
def outlier_days(t):
    known = _flagged(t).select("days_into_dst").where(F.col("days_into_dst").isNotNull())
    return panel.outlier_flags(known).groupBy(
        "days_into_dst", "days_into_dst_outlier", "days_into_dst_extreme_outlier"
    ).agg(F.count(F.lit(1)).alias("n"))


@query(PANEL_SQL + """
, lists AS (
  SELECT CAST(o_orderdate AS DATE) AS d, ['qld', 'nsw', 'vic', 'sa', 'tas'][1 + o_custkey % 5] AS state FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'
  UNION SELECT CAST(o_orderdate AS DATE), ['QLD', 'NSW', 'VIC', 'SA', 'TAS'][1 + o_custkey % 5] FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F'),
holidays AS (SELECT DISTINCT d, upper(state) || '1' AS regionid FROM lists)
SELECT o_orderkey, timed.regionid, CAST(hh_start_local AS DATE) AS date_local, holidays.d IS NOT NULL AS public_holiday
FROM timed LEFT JOIN holidays ON holidays.d = CAST(hh_start_local AS DATE) AND holidays.regionid = timed.regionid
""")
def holiday_flag(t):
    states = F.element_at(
        F.array(*[F.lit(s) for s in ("qld", "nsw", "vic", "sa", "tas")]), (F.col("o_custkey") % 5 + 1).cast("int")
    )
    first = t.orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), states.alias("State")
    )
    second = t.orders.where("o_orderpriority = '5-LOW' AND o_orderstatus = 'F'").select(
        F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("Date"), F.upper(states).alias("Jurisdiction")
    )
    timed = panel.calendar_columns(_panel(t))
    out = panel.holiday_flag(timed, panel.merge_holidays(first, second))
    return out.select("o_orderkey", "regionid", "date_local", "public_holiday")


@query("""
WITH e AS (SELECT event_type, CAST(ts AS DATE) AS d, value, hour(ts) BETWEEN 12 AND 14 AS midday, event_id FROM events),
m AS (SELECT event_type, d, avg(value) AS base FROM e WHERE midday GROUP BY ALL)
SELECT event_id, round(base, 6) AS value_midday, round((value - base) * 1000, 4) AS vs_midday FROM e LEFT JOIN m USING (event_type, d)
""")
def midday_baseline(t):
    e = t.events.select(
        "event_id", "event_type", F.to_date("ts").alias("d"), "value", F.hour("ts").between(12, 14).alias("midday")
    )
    out = panel.midday_baseline(e, ["value"], "midday", ["event_type", "d"])
    return out.select(
        "event_id",
        F.round("value_midday", 6).alias("value_midday"),
        F.round((F.col("value") - F.col("value_midday")) * 1000, 4).alias("vs_midday"),
    )


DOWNSAMPLE_SQL = """
SELECT event_type, CAST(ts AS DATE) AS d, count(*) / 48.0 AS day_length_scale_factor, round(sum(value) {op} (count(*) / 48.0), 6) AS total,
  round(avg(value), 6) AS value, min(dayofweek(ts) + 1) AS weekday FROM events GROUP BY ALL
"""


def _downsample(t, as_published):
    e = t.events.select("event_type", F.to_date("ts").alias("d"), "value", F.dayofweek("ts").cast("bigint").alias("weekday"))
    out = panel.daily_downsample(
        e, ["event_type", "d"], {"total": ("value", 1.0)}, ["value"], ["weekday"], as_published=as_published
    )
    return out.withColumns({"total": F.round("total", 6), "value": F.round("value", 6)})


@query(DOWNSAMPLE_SQL.format(op="/"))
def daily_downsample(t):
    return _downsample(t, False)


@query(DOWNSAMPLE_SQL.format(op="*"))
def daily_downsample_as_published(t):
    return _downsample(t, True)


CITY_SQL = f"""
WITH cities AS (
  SELECT unnest({REGIONS}) AS regionid, unnest({ZONES}) AS tz, unnest([-27.467, -33.883, -37.783, -34.933, -42.883]::DOUBLE[]) AS lat,
    unnest([153.033, 151.217, 144.967, 138.6, 147.317]::DOUBLE[]) AS lon),
days AS (SELECT DISTINCT {REGIONS}[1 + user_id % 5] AS regionid, CAST(ts AS DATE) AS d FROM events),
g AS (SELECT regionid, tz, lat, lon, d, ((d - DATE '2000-01-01') - 0.5::DOUBLE) / 36525.0::DOUBLE AS century FROM days JOIN cities USING (regionid)),
p0 AS (SELECT *, r, 720.0::DOUBLE - 4.0::DOUBLE * lon AS guess FROM g, (SELECT unnest([true, false]) AS r))
"""


def _sun_pass(n):
    """One evaluation of the solar equations in SQL, from p{n-1}.guess to p{n}.guess."""
    return f"""
, a{n} AS (SELECT *, century + guess / 1440.0::DOUBLE / 36525.0::DOUBLE AS t FROM p{n - 1}),
b{n} AS (SELECT *, fmod(280.46646::DOUBLE + t * (36000.76983::DOUBLE + t * 0.0003032::DOUBLE), 360.0::DOUBLE) AS lng,
  357.52911::DOUBLE + t * (35999.05029::DOUBLE - 0.0001537::DOUBLE * t) AS anom, 0.016708634::DOUBLE - t * (0.000042037::DOUBLE + 0.0000001267::DOUBLE * t) AS ecc,
  125.04::DOUBLE - 1934.136::DOUBLE * t AS node FROM a{n}),
c{n} AS (SELECT *, lng + sin(radians(anom)) * (1.914602::DOUBLE - t * (0.004817::DOUBLE + 0.000014::DOUBLE * t)) + sin(radians(2 * anom)) * (0.019993::DOUBLE - 0.000101::DOUBLE * t)
    + sin(radians(3 * anom)) * 0.000289::DOUBLE - 0.00569::DOUBLE - 0.00478::DOUBLE * sin(radians(node)) AS app,
  23.0::DOUBLE + (26.0::DOUBLE + (21.448::DOUBLE - t * (46.815::DOUBLE + t * (0.00059::DOUBLE - t * 0.001813::DOUBLE))) / 60.0::DOUBLE) / 60.0::DOUBLE + 0.00256::DOUBLE * cos(radians(node)) AS obl FROM b{n}),
d{n} AS (SELECT *, asin(sin(radians(obl)) * sin(radians(app))) AS decl, pow(tan(radians(obl / 2)), 2) AS y FROM c{n}),
e{n} AS (SELECT *, 4 * degrees(y * sin(radians(2 * lng)) - 2 * ecc * sin(radians(anom)) + 4 * ecc * y * sin(radians(anom)) * cos(radians(2 * lng))
    - 0.5::DOUBLE * y * y * sin(radians(4 * lng)) - 1.25::DOUBLE * ecc * ecc * sin(radians(2 * anom))) AS eqt,
  degrees(acos(cos(radians(90.833::DOUBLE)) / (cos(radians(lat)) * cos(decl)) - tan(radians(lat)) * tan(decl))) AS ha FROM d{n}),
p{n} AS (SELECT regionid, tz, lat, lon, d, century, r, 720.0::DOUBLE - 4.0::DOUBLE * (lon + CASE WHEN r THEN ha ELSE -ha END) - eqt AS guess FROM e{n})
"""


SUN_SQL = CITY_SQL + _sun_pass(1) + _sun_pass(2) + """
, utc AS (SELECT regionid, tz, d, r, CAST(d AS TIMESTAMP) + to_seconds(CAST(floor(guess * 60) AS BIGINT)) AS u FROM p2),
sun AS (
  SELECT regionid, d,
    max(((u AT TIME ZONE 'UTC') AT TIME ZONE tz)) FILTER (r) AS sunrise_local, max(((u AT TIME ZONE 'UTC') AT TIME ZONE tz)) FILTER (NOT r) AS sunset_local,
    max(((u AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Brisbane')) FILTER (r) AS sunrise_fixed,
    max(((u AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Brisbane')) FILTER (NOT r) AS sunset_fixed
  FROM utc GROUP BY ALL)
"""


def _user_region():
    return F.element_at(F.array(*[F.lit(r) for r in REGION_LIST]), (F.col("user_id") % 5 + 1).cast("int"))


def _sun(t):
    grid = t.events.select(_user_region().alias("regionid"), F.to_date("ts").alias("d")).distinct()
    lat = F.create_map(*[F.lit(x) for r, c in panel.REGION_CITIES.items() for x in (r, c[1])])
    lon = F.create_map(*[F.lit(x) for r, c in panel.REGION_CITIES.items() for x in (r, c[2])])
    placed = grid.withColumns(
        {"lat": lat[F.col("regionid")], "lon": lon[F.col("regionid")], "tz": panel.zone_of("regionid")}
    )
    return panel.sun_times(placed, "d", "lat", "lon", "tz").drop("lat", "lon", "tz")


@query(SUN_SQL + "SELECT * FROM sun")
def sun_times(t):
    return _sun(t)


@query(SUN_SQL + f"""
, e AS (SELECT {REGIONS}[1 + user_id % 5] AS regionid, CAST(ts AS DATE) AS d, ts - INTERVAL 15 MINUTE AS mid, value, value * value / 100 AS co2, user_id + 1 AS population FROM events),
l AS (SELECT e.*, CASE
    WHEN mid BETWEEN sunrise_fixed - INTERVAL 1 HOUR AND sunrise_fixed THEN 'the hour before sunrise'
    WHEN abs(epoch_us(mid) - epoch_us(sunrise_fixed)) <= 3600000000 THEN 'the hour after sunrise'
    WHEN mid BETWEEN sunset_fixed AND sunset_fixed + INTERVAL 1 HOUR THEN 'the hour after sunset'
    WHEN abs(epoch_us(mid) - epoch_us(sunset_fixed)) <= 3600000000 THEN 'the hour before sunset'
    ELSE 'remainder of day' END AS label FROM e JOIN sun USING (regionid, d))
SELECT label, round(sum(value * population) / sum(population) * 1000, 4) AS wh_per_half_hour,
  round(sum(co2 * population) / sum(population) * 1000, 4) AS g_per_half_hour,
  round(sum(co2 / nullif(value, 0) * population) / sum(population) FILTER (value <> 0) * 1000, 4) AS co2_intensity
FROM l GROUP BY label
""")
def sun_labels(t):
    e = t.events.select(
        _user_region().alias("regionid"),
        F.to_date("ts").alias("date_fixed"),
        F.col("ts").alias("hh_end_fixed"),
        F.col("value").alias("energy_kwh_per_capita"),
        (F.col("value") * F.col("value") / 100).alias("co2_kg_per_capita"),
        (F.col("user_id") + 1).alias("population"),
    )
    out = describe.sun_position_table(describe.add_sun_label(e, _sun(t).withColumnRenamed("d", "date_fixed")))
    return out.withColumns({c: F.round(c, 4) for c in ("wh_per_half_hour", "g_per_half_hour", "co2_intensity")})
