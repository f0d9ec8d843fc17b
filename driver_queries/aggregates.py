"""Deduplication, aggregates, reshaping and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.aggregates import avg_strict, sum_strict, wmean, wmean_ratio
from panelspark.operators import cumulative, dedupe, frequency, quality, reshape, weighted
from panelspark.plans import describe
from panelspark.plans.market import interval_minutes

from .registry import query


@query("""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC,
             l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn
  FROM lineitem)
WHERE rn = 1
""")
def keep_latest_lineitem(t):
    order = ["-l_shipdate", "-l_partkey", "-l_suppkey"]
    return dedupe.keep_latest(t.lineitem, ["l_orderkey", "l_linenumber"], order)


@query("""
SELECT * EXCLUDE (rn) FROM (
  SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice, o_orderdate, row_number() OVER (
    PARTITION BY o_custkey ORDER BY o_orderpriority ASC, o_orderdate DESC, o_totalprice ASC, o_orderkey ASC) AS rn
  FROM orders)
WHERE rn = 1
""")
def keep_first_mixed_order(t):
    cols = ["o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate"]
    order = ["o_orderpriority", "-o_orderdate", "o_totalprice", "o_orderkey"]
    return dedupe.keep_latest(t.orders.select(*cols), ["o_custkey"], order)


@query("""
SELECT c_nationkey AS nationkey, CAST(round(c_acctbal) AS BIGINT) AS balance FROM customer
UNION
SELECT s_nationkey, CAST(round(s_acctbal) AS BIGINT) FROM supplier
""")
def distinct_union(t):
    a = t.customer.select(F.col("c_nationkey").alias("nationkey"), F.round("c_acctbal").cast("bigint").alias("balance"))
    b = t.supplier.select(F.col("s_nationkey").alias("nationkey"), F.round("s_acctbal").cast("bigint").alias("balance"))
    return dedupe.union_distinct(a, b)


@query("""
SELECT event_type, CAST(ts AS DATE) AS d,
  round(CASE WHEN count(v) = count(*) THEN sum(v) END, 6) AS strict_sum,
  round(CASE WHEN count(v) = count(*) THEN avg(v) END, 6) AS strict_avg,
  round(sum(v), 6) AS lenient_sum
FROM (SELECT *, CASE WHEN value <= 250 THEN value END AS v FROM events)
GROUP BY ALL
""")
def strict_sum(t):
    e = t.events.withColumn("v", F.when(F.col("value") <= 250, F.col("value")))
    return e.groupBy("event_type", F.to_date("ts").alias("d")).agg(
        F.round(sum_strict("v"), 6).alias("strict_sum"),
        F.round(avg_strict("v"), 6).alias("strict_avg"),
        F.round(F.sum("v"), 6).alias("lenient_sum"),
    )


@query("""
WITH m AS (
  SELECT l_returnflag, l_linestatus, sum(l_quantity * l_discount) / sum(l_quantity) AS mean
  FROM lineitem GROUP BY ALL)
SELECT l.l_returnflag, l.l_linestatus, round(any_value(mean), 8) AS l_discount,
  round(sqrt(sum(l_quantity * (l_discount - mean) ** 2)
    / ((count(*) FILTER (l_quantity <> 0) - 1.0) / count(*) FILTER (l_quantity <> 0) * sum(l_quantity))), 8) AS l_discount_sd
FROM lineitem l JOIN m USING (l_returnflag, l_linestatus) GROUP BY l.l_returnflag, l.l_linestatus
""")
def weighted_sd(t):
    out = weighted.weighted_spread(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_discount"], "l_quantity")
    return out.withColumns({c: F.round(c, 8) for c in ("l_discount", "l_discount_sd")})


@query("""
SELECT p_brand, round(sum(l_quantity * l_extendedprice / p_retailprice) / sum(l_quantity), 6) AS price_ratio,
  round(sum(l_quantity * l_tax) / sum(l_quantity), 8) AS mean_tax
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand
""")
def ratio_weighted(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand").agg(
        F.round(wmean_ratio("l_extendedprice", "p_retailprice", "l_quantity"), 6).alias("price_ratio"),
        F.round(wmean("l_tax", "l_quantity"), 8).alias("mean_tax"),
    )


@query("""
WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey),
     m AS (SELECT quantile_cont(n, 0.5) AS median FROM n),
     s AS (SELECT min(l_partkey) AS lo, max(l_partkey) AS hi FROM lineitem)
SELECT l_partkey, n < median AS rare, l_partkey IN (lo, hi) AS extreme, count(*) AS row_count
FROM lineitem JOIN n USING (l_partkey), m, s GROUP BY ALL
""")
def rare_values(t):
    flagged = frequency.rare_value_flags(t.lineitem.select("l_partkey"), "l_partkey", "rare", "extreme")
    return flagged.groupBy("l_partkey", "rare", "extreme").agg(F.count(F.lit(1)).alias("row_count"))


@query("""
WITH j AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS (SELECT avg((doc_id IS NULL)::INT) AS doc_id, avg(("text" IS NULL)::INT) AS "text", avg((lang IS NULL)::INT) AS lang,
  avg((source IS NULL)::INT) AS source, avg((n_chars IS NULL)::INT) AS n_chars,
  avg((quality IS NULL)::INT) AS quality, avg((toxic IS NULL)::INT) AS toxic FROM j)
SELECT column_name, round(null_rate, 9) AS null_rate FROM (UNPIVOT r ON COLUMNS(*) INTO NAME column_name VALUE null_rate)
""")
def null_rates(t):
    joined = t.documents.join(t.labels, "doc_id", "left")
    return weighted.null_rates(joined).withColumn("null_rate", F.round("null_rate", 9))


@query("""
SELECT o_orderstatus, variable, n, round(mean, 2) AS mean, round(sd, 2) AS sd, round(lo, 2) AS "min", round(hi, 2) AS "max" FROM (
  SELECT o_orderstatus, 'o_totalprice' AS variable, count(o_totalprice) AS n, avg(o_totalprice) AS mean,
    stddev_samp(o_totalprice) AS sd, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus
  UNION ALL
  SELECT o_orderstatus, 'o_custkey', count(o_custkey), avg(o_custkey), stddev_samp(o_custkey), min(o_custkey), max(o_custkey)
  FROM orders GROUP BY o_orderstatus)
""")
def summary_stats(t):
    out = weighted.summary_stats(t.orders, ["o_totalprice", "o_custkey"], ["o_orderstatus"])
    return out.withColumns({c: F.round(c, 2) for c in ("mean", "sd", "min", "max")})


COST_SQL = """
SELECT frac_total_cost, cum_hours, frac_time FROM (
  SELECT round(sum(cost) OVER w / sum(cost) OVER (), 8) AS frac_total_cost,
    round(sum(minutes) OVER w / 60.0, 6) AS cum_hours,
    sum(minutes) OVER w / sum(minutes) OVER () AS ft,
    round(sum(minutes) OVER w / sum(minutes) OVER (), 10) AS frac_time,
    row_number() OVER w AS rn
  FROM (SELECT l_extendedprice AS cost, CASE WHEN l_shipdate >= '1998-01-01' THEN 5 ELSE 30 END AS minutes,
          l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)
  WINDOW w AS (ORDER BY 60 * cost / minutes DESC, minutes DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey
               ROWS UNBOUNDED PRECEDING))
WHERE ft <= 0.01 ORDER BY rn DESC LIMIT 1
"""


@query(COST_SQL)
def cost_concentration(t):
    costs = t.lineitem.select(
        F.col("l_extendedprice").alias("cost"), interval_minutes("l_shipdate", "1998-01-01").alias("minutes")
    )
    out = cumulative.cost_concentration(costs, "cost", "minutes")
    return out.select(
        F.round("frac_total_cost", 8).alias("frac_total_cost"),
        F.round("cum_hours", 6).alias("cum_hours"),
        F.round("frac_time", 10).alias("frac_time"),
    )


@query("""
WITH p AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spent, count(*) AS orders FROM orders GROUP BY o_custkey)
SELECT o_custkey, CAST(spent AS DOUBLE) AS spent,
  CAST(sum(spent) OVER w AS DOUBLE) AS cum_spent, CAST(sum(orders) OVER w AS BIGINT) AS cum_orders,
  round(CAST(sum(spent) OVER w AS DOUBLE) / CAST(sum(spent) OVER () AS DOUBLE), 9) AS frac_spent
FROM p WINDOW w AS (ORDER BY CAST(spent AS DOUBLE) DESC, o_custkey ROWS UNBOUNDED PRECEDING)
""")
def cumulative_share(t):
    per_customer = t.orders.groupBy("o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent"), F.count(F.lit(1)).alias("orders")
    )
    out = cumulative.cumulative_share(per_customer, "spent", {"spent": "spent", "orders": "orders"}, ["o_custkey"])
    return out.select(
        "o_custkey",
        F.col("spent").cast("double").alias("spent"),
        F.col("cum_spent").cast("double").alias("cum_spent"),
        "cum_orders",
        F.round("frac_spent", 9).alias("frac_spent"),
    )


@query("""
SELECT l_returnflag, l_linestatus, year(l_shipdate) AS y, count(*) AS n FROM lineitem GROUP BY ALL
""")
def value_counts(t):
    dated = t.lineitem.select(
        F.struct("l_returnflag", "l_linestatus", F.year("l_shipdate").cast("bigint").alias("y")).alias("cell")
    )
    return frequency.value_counts(dated, "cell").select("cell.*", "n")


@query("""
SELECT l_shipmonth, n_F, n_O, round(qty_F, 2) AS qty_F, round(qty_O, 2) AS qty_O FROM (
SELECT month(l_shipdate) AS l_shipmonth,
  count(*) FILTER (l_linestatus = 'F') AS n_F, count(*) FILTER (l_linestatus = 'O') AS n_O,
  sum(l_quantity) FILTER (l_linestatus = 'F') AS qty_F, sum(l_quantity) FILTER (l_linestatus = 'O') AS qty_O
FROM lineitem GROUP BY ALL)
""")
def pivot_wider(t):
    dated = t.lineitem.select(F.month("l_shipdate").cast("bigint").alias("l_shipmonth"), "l_linestatus", "l_quantity")
    return reshape.pivot_wider(
        dated,
        ["l_shipmonth"],
        "l_linestatus",
        ["F", "O"],
        {"n": F.count(F.lit(1)), "qty": F.round(F.sum("l_quantity"), 2)},
    )


CELLS = """
WITH f AS (
  SELECT *, l_returnflag = 'R' AS treated, l_shipdate >= '1998-07-01' AS post, l_linenumber > 3 AS not_midday
  FROM lineitem)
"""


def _flagged(t):
    return t.lineitem.withColumns(
        {
            "treated": F.col("l_returnflag") == "R",
            "post": F.col("l_shipdate") >= F.lit("1998-07-01").cast("timestamp_ntz"),
            "not_midday": F.col("l_linenumber") > 3,
        }
    )


@query(CELLS + """
, m AS (SELECT not_midday, treated, post, sum(l_quantity * l_discount) / sum(l_quantity) AS mean FROM f GROUP BY ALL),
s AS (
  SELECT not_midday, treated, post, any_value(mean) AS co2,
    sqrt(sum(l_quantity * (l_discount - mean) ** 2)
      / ((count(*) FILTER (l_quantity <> 0) - 1.0) / count(*) FILTER (l_quantity <> 0) * sum(l_quantity))) AS co2_se
  FROM f JOIN m USING (not_midday, treated, post) GROUP BY not_midday, treated, post)
SELECT not_midday, treated, post, name, round(value, 8) AS value
FROM (UNPIVOT s ON co2, co2_se INTO NAME name VALUE value)
""")
def cell_means(t):
    out = describe.cell_means(_flagged(t), ["not_midday", "treated", "post"], "l_discount", "l_quantity")
    return out.withColumn("value", F.round("value", 8))


@query(CELLS + """
, m AS (SELECT l_linenumber, not_midday, treated, post, sum(l_quantity * l_discount) / sum(l_quantity) AS a,
     sum(l_quantity * l_tax) / sum(l_quantity) AS b FROM f GROUP BY ALL),
d AS (SELECT l_linenumber, not_midday, treated, max(a) FILTER (post) - max(a) FILTER (NOT post) AS a,
     max(b) FILTER (post) - max(b) FILTER (NOT post) AS b FROM m GROUP BY ALL),
dd AS (SELECT l_linenumber, not_midday, max(a) FILTER (treated) - max(a) FILTER (NOT treated) AS discount,
     max(b) FILTER (treated) - max(b) FILTER (NOT treated) AS tax FROM d GROUP BY ALL)
SELECT l_linenumber, not_midday,
  round(discount - (SELECT avg(discount) FROM dd WHERE NOT not_midday), 9) AS discount, round(tax, 9) AS tax FROM dd
""")
def intraday_difference(t):
    out = describe.intraday_difference(
        _flagged(t),
        "l_linenumber",
        "not_midday",
        "treated",
        "post",
        {"discount": "l_discount", "tax": "l_tax"},
        "l_quantity",
        centre="discount",
    )
    return out.withColumns({c: F.round(c, 9) for c in ("discount", "tax")})


@query("""
WITH f AS (SELECT user_id % 5 AS region, user_id % 5 > 0 AS here, ts >= '2024-01-16' AS post, value, user_id + 1 AS w,
  hour(ts) AS h1, hour(ts + INTERVAL 30 MINUTE) AS h2, value * value / 100 AS value2 FROM events),
v AS (
  SELECT 'end' AS clock, 'group' AS grouping, CASE WHEN here THEN 'treatment' ELSE 'control' END AS member, h2 AS hr, post, value, value2, w FROM f
  UNION ALL SELECT 'start', 'group', CASE WHEN here THEN 'treatment' ELSE 'control' END, h1, post, value, value2, w FROM f
  UNION ALL SELECT 'end', 'region', CAST(region AS VARCHAR), h2, post, value, value2, w FROM f
  UNION ALL SELECT 'start', 'region', CAST(region AS VARCHAR), h1, post, value, value2, w FROM f),
p AS (
  SELECT clock, grouping, member, hr,
    sum(w * value) FILTER (NOT post) / sum(w) FILTER (NOT post) AS a0, sum(w * value) FILTER (post) / sum(w) FILTER (post) AS a1,
    sum(w * value2) FILTER (NOT post) / sum(w) FILTER (NOT post) AS b0, sum(w * value2) FILTER (post) / sum(w) FILTER (post) AS b1
  FROM v GROUP BY ALL)
SELECT clock, grouping, member, CAST(hr AS INTEGER) AS hr, round(a0, 6) AS value_pre, round(a1, 6) AS value_post, a1 > a0 AS value_increased,
  CASE WHEN a0 + a1 IS NOT NULL THEN round(least(a0, a1), 6) END AS value_lower,
  CASE WHEN a0 + a1 IS NOT NULL THEN round(greatest(a0, a1), 6) END AS value_upper,
  round(b0, 6) AS value2_pre, round(b1, 6) AS value2_post, b1 > b0 AS value2_increased,
  CASE WHEN b0 + b1 IS NOT NULL THEN round(least(b0, b1), 6) END AS value2_lower,
  CASE WHEN b0 + b1 IS NOT NULL THEN round(greatest(b0, b1), 6) END AS value2_upper
FROM p
""")
def intraday_profiles(t):
    e = t.events.select(
        (F.col("user_id") % 5).alias("region"),
        F.when(F.col("user_id") % 5 > 0, "treatment").otherwise("control").alias("side"),
        (F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).alias("post"),
        "value",
        (F.col("value") * F.col("value") / 100).alias("value2"),
        (F.col("user_id") + 1).alias("w"),
        F.hour("ts").alias("h1"),
        F.hour(F.col("ts") + F.expr("INTERVAL '30' MINUTE")).alias("h2"),
    )
    out = describe.intraday_profiles(
        e, {"start": "h1", "end": "h2"}, {"group": "side", "region": "region"}, "post", ["value", "value2"], "w"
    )
    parts = [f"{m}_{p}" for m in ("value", "value2") for p in ("pre", "post", "lower", "upper")]
    return out.withColumns({c: F.round(c, 6) for c in parts})


@query("""
SELECT unnest(['value is never negative', 'at most 5 large values', 'some purchase', 'timestamps are set', 'table has rows']) AS "check",
  unnest([bool_and(value >= 0), count(*) FILTER (value > 400) <= 5, bool_or(event_type = 'purchase'), bool_and(ts IS NOT NULL), count(*) > 0]) AS holds
FROM events
""")
def expectations(t):
    return quality.verdicts(
        t.events,
        {
            "value is never negative": quality.every_row(F.col("value") >= 0),
            "at most 5 large values": quality.at_most(5, F.col("value") > 400),
            "some purchase": quality.some_row(F.col("event_type") == "purchase"),
            "timestamps are set": quality.every_row(F.col("ts").isNotNull()),
            "table has rows": quality.not_empty(),
        },
    )
