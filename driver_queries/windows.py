"""Neighbours, fills, interpolation and time buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.timeparts import bucket_to
from panelspark.operators import chunks, grid
from panelspark.plans.market import five_minute_copies, midpoint_energy

from .registry import query


@query("""
SELECT event_id, user_id, ts,
  round((value + coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY ts), 0)) / 2 * 5 / 60, 6) AS energy_mwh
FROM events
""")
def midpoint_energy_events(t):
    out = midpoint_energy(t.events, ["user_id"], "ts", "value", F.lit(0.0), sized_by=t.events)
    return out.select("event_id", "user_id", "ts", F.round("energy_mwh", 6).alias("energy_mwh"))


@query("""
WITH n AS (SELECT *, lead(value) OVER w AS nv, lead(ts) OVER w AS nt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id, round((value + CASE WHEN nt - ts <= INTERVAL 120 MINUTE AND nv IS NOT NULL THEN nv ELSE value END) / 2 * 5 / 60, 6) AS energy_mwh
FROM n
""")
def midpoint_energy_max_gap(t):
    out = midpoint_energy(t.events, ["user_id"], "ts", "value", "value", max_gap_minutes=120, sized_by=t.events)
    return out.select("event_id", F.round("energy_mwh", 6).alias("energy_mwh"))


@query("""
SELECT event_type, time_bucket(INTERVAL '30 minutes', ts) AS hh_start,
  time_bucket(INTERVAL '30 minutes', ts - INTERVAL 1 MICROSECOND) + INTERVAL 30 MINUTE AS hh_end,
  count(*) AS n, round(sum(value), 6) AS total
FROM events GROUP BY ALL
""")
def half_hour_bucket(t):
    return t.events.groupBy(
        "event_type", bucket_to("ts", 30, "start").alias("hh_start"), bucket_to("ts", 30).alias("hh_end")
    ).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS last_purchase,
  last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING)::DOUBLE AS last_id,
  first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_purchase
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
""")
def fill_both_ways(t):
    bought = F.col("event_type") == "purchase"
    e = t.events.select(
        "event_id",
        "user_id",
        "ts",
        F.when(bought, F.col("value")).alias("purchase"),
        F.when(bought, F.col("event_id")).alias("id"),
    )
    down = chunks.carry_forward(e, ["user_id"], ["ts"], ["purchase", "id"], sized_by=t.events)
    both = chunks.carry_backward(down, ["user_id"], ["ts"], ["purchase"], sized_by=t.events)
    return both.select(
        "event_id",
        F.col("purchase_last").alias("last_purchase"),
        F.col("id_last").cast("double").alias("last_id"),
        F.col("purchase_next").alias("next_purchase"),
    )


DAILY = """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS d, avg(value) AS v FROM events GROUP BY ALL),
span AS (SELECT min(d) AS lo, max(d) AS hi FROM d),
g AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT DISTINCT user_id FROM d), span),
c AS (SELECT g.user_id, g.d, d.v FROM g LEFT JOIN d USING (user_id, d))
"""


def _daily(t):
    daily = t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"))
    return grid.complete(daily, ["user_id"], "d", "1 day")


@query("""
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL),
span AS (SELECT min(h) AS lo, max(h) AS hi FROM h),
g AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS h FROM (SELECT DISTINCT event_type FROM h), span)
SELECT event_type, h, n::DOUBLE AS n FROM g LEFT JOIN h USING (event_type, h)
""")
def grid_complete(t):
    hourly = t.events.groupBy("event_type", bucket_to("ts", 60, "start").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return grid.complete(hourly, ["event_type"], "h", "1 hour").withColumn("n", F.col("n").cast("double"))


LINE = """
, k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN d END IGNORE NULLS) OVER p AS d0, last_value(v IGNORE NULLS) OVER p AS v0,
   first_value(CASE WHEN v IS NOT NULL THEN d END IGNORE NULLS) OVER f AS d1, first_value(v IGNORE NULLS) OVER f AS v1
 FROM c WINDOW p AS (PARTITION BY user_id ORDER BY d ROWS UNBOUNDED PRECEDING),
   f AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""


@query(DAILY + LINE + """
SELECT user_id, d, round(CASE WHEN v IS NOT NULL THEN v
  WHEN d0 IS NOT NULL AND d1 IS NOT NULL THEN v0 + (v1 - v0) * (d - d0) / (d1 - d0)
  ELSE coalesce(v0, v1) END, 6) AS v FROM k
""")
def interpolate_hold(t):
    out = chunks.interpolate_linear(_daily(t), ["user_id"], "d", "v")
    return out.withColumn("v", F.round("v", 6))


@query(DAILY + LINE + """
SELECT user_id, d, round(CASE WHEN v IS NOT NULL THEN v
  WHEN d0 IS NOT NULL AND d1 IS NOT NULL THEN v0 + (v1 - v0) * (d - d0) / (d1 - d0) END, 6) AS v FROM k
""")
def interpolate_open(t):
    out = chunks.interpolate_linear(_daily(t), ["user_id"], "d", "v", ends="null")
    return out.withColumn("v", F.round("v", 6))


@query(DAILY + """
SELECT user_id, d, round(coalesce(v, avg(v) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)), 6) AS v FROM c
""")
def rolling_mean_fill(t):
    return chunks.rolling_mean_fill(_daily(t), ["user_id"], ["d"], "v").withColumn("v", F.round("v", 6))


@query("""
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
  round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running
FROM events
""")
def running_totals(t):
    numbered = chunks.number_rows(t.events, ["user_id"], ["ts", "event_id"], "n", sized_by=t.events)
    out = chunks.running_sum(numbered, ["user_id"], ["ts", "event_id"], {"running": "value"}, sized_by=t.events)
    return out.select("event_id", "n", F.round("running", 4).alias("running"))


@query("""
WITH h AS (SELECT event_type, time_bucket(INTERVAL '30 minutes', ts - INTERVAL 1 MICROSECOND) + INTERVAL 30 MINUTE AS hh_end, avg(value) AS mw FROM events GROUP BY ALL)
SELECT event_type, hh_end, unnest(generate_series(hh_end - INTERVAL 25 MINUTE, hh_end, INTERVAL 5 MINUTE)) AS settlementdate, round(mw, 6) AS mw FROM h
""")
def zero_order_hold(t):
    half_hours = t.events.groupBy("event_type", bucket_to("ts", 30).alias("hh_end")).agg(
        F.round(F.avg("value"), 6).alias("mw")
    )
    return five_minute_copies(half_hours, "hh_end")
