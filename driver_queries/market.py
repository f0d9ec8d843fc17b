"""Unit readings to regional energy."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.plans import market

from .registry import query

STANDING_SQL = """
WITH g AS (
  SELECT DISTINCT ON (l_partkey) l_partkey AS gensetid, l_quantity AS maxcapacity, l_discount AS factor FROM lineitem
  WHERE l_returnflag <> 'R'
  ORDER BY l_partkey, l_linenumber DESC, l_shipdate DESC, l_orderkey DESC, l_quantity DESC, l_discount DESC),
d AS (SELECT DISTINCT l_suppkey AS duid, l_partkey AS gensetid FROM lineitem),
i AS (SELECT duid, sum(factor * maxcapacity) / sum(maxcapacity) AS factor FROM d JOIN g USING (gensetid) GROUP BY duid)
"""


def _genunits(t):
    return t.lineitem.select(
        F.col("l_partkey").alias("gensetid"),
        F.when(F.col("l_returnflag") == "R", "LOAD").otherwise("GENERATOR").alias("gensettype"),
        F.col("l_quantity").alias("maxcapacity"),
        F.col("l_discount").alias("co2e_emissions_factor"),
        F.col("l_linenumber").alias("schema_version"),
        F.col("l_shipdate").alias("top_timestamp"),
        F.col("l_orderkey").alias("lastchanged"),
    )


def _dudetail(t):
    """Two periods per unit; suppliers of nation 24 sit in the retired region."""
    start = F.lit("1996-01-01").cast("timestamp_ntz")
    split = F.lit("1999-01-01").cast("timestamp_ntz")
    region = F.concat(F.lit("REGION_"), (F.col("s_nationkey") % 5).cast("string"))
    later = F.concat(F.lit("REGION_"), ((F.col("s_nationkey") + 1) % 5).cast("string"))
    retired = F.col("s_nationkey") == 24
    periods = F.array(
        F.struct(start.alias("s"), split.alias("e"), F.when(retired, "SNOWY1").otherwise(region).alias("r")),
        F.struct(split.alias("s"), F.lit(None).cast("timestamp_ntz").alias("e"), later.alias("r")),
    )
    return t.supplier.select("s_suppkey", F.explode(periods).alias("p")).select(
        F.col("s_suppkey").alias("duid"),
        F.col("p.s").alias("start_date"),
        F.col("p.e").alias("end_date"),
        F.col("p.r").alias("regionid"),
        F.lit(1).alias("schema_version"),
        F.lit("a").alias("top_timestamp"),
        F.col("p.s").alias("lastchanged"),
    )


@query(STANDING_SQL + """
SELECT duid, CASE WHEN s_nationkey = 24 THEN 'REGION_' || (s_nationkey + 1) % 5 ELSE 'REGION_' || s_nationkey % 5 END AS regionid,
  round(factor, 8) AS co2e_emissions_factor FROM i JOIN supplier ON duid = s_suppkey
""")
def unit_standing(t):
    alloc = t.lineitem.select(F.col("l_suppkey").alias("duid"), F.col("l_partkey").alias("gensetid"))
    out = market.unit_standing(_genunits(t), alloc, _dudetail(t))
    return out.withColumn("co2e_emissions_factor", F.round("co2e_emissions_factor", 8))


# Readings are the events; every third one also exists in an older version with another value.
READINGS_SQL = """
WITH raw AS (
  SELECT user_id AS duid, date_trunc('second', ts) AS settlementdate, event_id AS runno, value FROM events WHERE event_type <> 'error'
  UNION ALL
  SELECT user_id, date_trunc('second', ts), event_id - 1000000, value * 2 FROM events WHERE event_type <> 'error' AND event_id % 3 = 0),
readings AS (
  SELECT duid, settlementdate, arg_max(value, runno) AS value FROM raw GROUP BY ALL)
"""


def _dispatch(t):
    copies = F.when(
        F.col("event_id") % 3 == 0,
        F.array(
            F.struct(F.col("event_id").alias("run"), F.col("value").alias("v")),
            F.struct((F.col("event_id") - 1_000_000).alias("run"), (F.col("value") * 2).alias("v")),
        ),
    ).otherwise(F.array(F.struct(F.col("event_id").alias("run"), F.col("value").alias("v"))))
    second = F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp"))).cast("timestamp_ntz")
    return t.events.select("user_id", second.alias("settlementdate"), "event_type", F.explode(copies).alias("c")).select(
        F.col("user_id").alias("duid"),
        "settlementdate",
        F.col("c.run").alias("runno"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("intervention"),
        F.col("c.v").alias("initialmw"),
        (F.col("c.v") / 2).alias("totalcleared"),
        F.lit(1).alias("schema_version"),
        F.lit("a").alias("top_timestamp"),
        F.lit(0).alias("lastchanged"),
    )


def _intensity(t):
    return t.customer.select(
        F.col("c_custkey").alias("duid"), (F.col("c_acctbal") / 9973).alias("co2e_emissions_factor")
    )


def _regions(t):
    """Every unit moves to the next region in the middle of January."""
    split = F.lit("2024-01-16").cast("timestamp_ntz")
    none = F.lit(None).cast("timestamp_ntz")
    periods = F.array(
        F.struct(F.lit("2023-01-01").cast("timestamp_ntz").alias("s"), split.alias("e"), F.lit(0).alias("k")),
        F.struct(split.alias("s"), none.alias("e"), F.lit(1).alias("k")),
    )
    region = F.concat(F.lit("REGION_"), ((F.col("n_regionkey") + F.col("p.k")) % 5).cast("string"))
    homes = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return homes.select("c_custkey", "n_regionkey", F.explode(periods).alias("p")).select(
        F.col("c_custkey").alias("duid"),
        F.col("p.s").alias("start_date"),
        F.col("p.e").alias("end_date"),
        region.alias("regionid"),
    )


REGIONAL_SQL = READINGS_SQL + """
, placed AS (
  SELECT r.*, c_acctbal / 9973 AS factor, 'REGION_' || (n_regionkey + CASE WHEN settlementdate >= '2024-01-16' THEN {moved} ELSE 0 END) % 5 AS regionid
  FROM readings r JOIN customer ON duid = c_custkey JOIN nation ON c_nationkey = n_nationkey),
energy AS (
  SELECT *, (value + coalesce(lead(value) OVER (PARTITION BY duid{month} ORDER BY settlementdate), value / 2)) / 2 * 5 / 60 AS e FROM placed)
SELECT regionid, {bucket} AS hh_end, round(sum(e), 6) AS energy_mwh, round(sum(e * factor), 6) AS co2_t
FROM energy GROUP BY ALL
"""


@query(REGIONAL_SQL.format(
    moved=1, month="",
    bucket="time_bucket(INTERVAL '30 minutes', settlementdate - INTERVAL 1 MICROSECOND) + INTERVAL 30 MINUTE",
))
def regional_energy(t):
    out = market.regional_energy(_dispatch(t), _intensity(t), _regions(t), per_interval=False)
    return out.withColumns({c: F.round(c, 6) for c in ("energy_mwh", "co2_t")})


@query(REGIONAL_SQL.format(
    moved=0, month=", date_trunc('month', settlementdate)", bucket="time_bucket(INTERVAL '30 minutes', settlementdate)"
))
def regional_energy_as_published(t):
    out = market.regional_energy(
        _dispatch(t),
        _intensity(t),
        _regions(t),
        region_mode="first",
        bucket_side="start",
        per_interval=False,
        within_month=True,
    )
    return out.withColumns({c: F.round(c, 6) for c in ("energy_mwh", "co2_t")})


@query("""
WITH v AS (
  SELECT user_id % 5 AS regionid, date_trunc('minute', ts) AS moment, event_id, value FROM events WHERE event_type <> 'error'),
k AS (SELECT DISTINCT ON (regionid, moment) regionid, moment, value FROM v ORDER BY regionid, moment, event_id DESC)
SELECT regionid, CAST(moment AS DATE) AS d, round(avg(value) * 24, 6) AS total_renewables_today_mwh,
  round(avg(CASE WHEN value < 100 THEN value END) * 24, 6) AS total_renewables_today_mwh_uigf
FROM k GROUP BY ALL
""")
def renewables_daily(t):
    minute = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60) * 60).cast("timestamp_ntz")
    sums = t.events.select(
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("intervention"),
        (F.col("user_id") % 5).alias("regionid"),
        minute.alias("settlementdate"),
        F.lit(0).alias("schema_version"),
        F.lit("").alias("top_timestamp"),
        F.col("event_id").alias("lastchanged"),
        F.col("value").alias("totalintermittentgeneration"),
        F.when(F.col("value") < 100, F.col("value")).alias("uigf"),
    )
    out = market.renewables_daily(sums)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("total")})


@query("""
WITH m AS (SELECT event_type, avg(value) FILTER (hour(ts) BETWEEN 4 AND 21) AS day, avg(value) FILTER (hour(ts) NOT BETWEEN 4 AND 21) AS night
  FROM events GROUP BY ALL)
SELECT round(avg(night / (night + day)), 8) AS night_share FROM m
""")
def night_share(t):
    return market.night_share(t.events, "ts", "value", "event_type").withColumn(
        "night_share", F.round("night_share", 8)
    )


@query("""
WITH r AS (
  SELECT o_custkey % 5 AS regionid, o_orderdate AS settlementdate, CAST(1 + o_orderkey % 48 AS INTEGER) AS periodid, o_totalprice, o_orderkey FROM orders),
k AS (SELECT DISTINCT ON (regionid, settlementdate, periodid) * FROM r ORDER BY regionid, settlementdate, periodid, o_orderkey DESC),
d AS (SELECT *, CASE WHEN settlementdate >= '2021-10-01' THEN 5 ELSE 30 END AS interval_duration FROM k)
SELECT regionid, settlementdate, periodid, o_totalprice AS energycost, o_totalprice / 2 AS netenergy, interval_duration,
  settlementdate + to_minutes(interval_duration * periodid) AS interval_end,
  settlementdate + to_minutes(interval_duration * (periodid - 1)) AS interval_start
FROM d
""")
def settlement_costs(t):
    rows = t.orders.select(
        (F.col("o_custkey") % 5).alias("regionid"),
        F.col("o_orderdate").alias("settlementdate"),
        (F.lit(1) + F.col("o_orderkey") % 48).cast("int").alias("periodid"),
        F.col("o_totalprice").alias("energycost"),
        (F.col("o_totalprice") / 2).alias("netenergy"),
        F.lit(1).alias("schema_version"),
        F.col("o_orderkey").alias("versionno"),
        F.lit("").alias("top_timestamp"),
        F.lit(0).alias("lastchanged"),
    )
    return market.settlement_costs(rows)


@query("""
WITH m AS (
  SELECT l_suppkey AS link, l_shipdate + to_minutes(5 * CAST(l_linenumber AS INT)) AS moment, l_quantity - 25 AS mw, l_orderkey, l_partkey FROM lineitem),
k AS (SELECT DISTINCT ON (link, moment) * FROM m ORDER BY link, moment, l_orderkey ASC, l_partkey DESC, mw DESC),
h AS (SELECT link, time_bucket(INTERVAL '30 minutes', moment - INTERVAL 1 MICROSECOND) + INTERVAL 30 MINUTE AS hh_end, avg(mw) * 5 / 60 AS e FROM k GROUP BY ALL),
j AS (SELECT h.*, s_nationkey AS f, (s_nationkey + 1) % 25 AS t FROM h JOIN supplier ON link = s_suppkey)
SELECT CAST(CASE WHEN e < 0 THEN t ELSE f END AS VARCHAR) AS regionfrom, CAST(CASE WHEN e < 0 THEN f ELSE t END AS VARCHAR) AS regionto,
  hh_end, round(abs(e), 6) AS energy_mwh FROM j
""")
def interconnector_flows(t):
    metered = t.lineitem.select(
        F.col("l_suppkey").alias("interconnectorid"),
        (F.col("l_shipdate") + F.make_dt_interval(mins=(F.col("l_linenumber") * 5).cast("int"))).alias("settlementdate"),
        F.col("l_orderkey").alias("runno"),
        F.col("l_partkey").alias("schema_version"),
        F.lit("").alias("top_timestamp"),
        F.lit(0).alias("lastchanged"),
        (F.col("l_quantity") - 25).alias("meteredmwflow"),
    )
    ends = t.supplier.select(
        F.col("s_suppkey").alias("interconnectorid"),
        F.col("s_nationkey").cast("string").alias("regionfrom"),
        ((F.col("s_nationkey") + 1) % 25).cast("string").alias("regionto"),
        F.lit(1).alias("schema_version"),
        F.lit("").alias("top_timestamp"),
        F.lit(0).alias("lastchanged"),
    )
    return market.interconnector_flows(metered, ends).withColumn("energy_mwh", F.round("energy_mwh", 6))
