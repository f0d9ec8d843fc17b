"""Joins on time, flows between regions, attached measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import joins
from panelspark.plans import market, panel

from .registry import query

PERIODS_SQL = """
WITH periods AS (
  SELECT s_suppkey, k, TIMESTAMP '1995-01-01' + to_months(24 * k + CAST(s_suppkey % 12 AS INT)) AS start_date,
    CASE WHEN k < 2 THEN TIMESTAMP '1995-01-01' + to_months(24 * (k + 1) + CAST(s_suppkey % 12 AS INT)) END AS end_date,
    s_acctbal * (k + 1) AS rate
  FROM supplier, (SELECT unnest([0, 1, 2]) AS k))
"""


def _periods(t):
    first = (F.col("s_suppkey") % 12).cast("int")
    base = F.lit("1995-01-01").cast("timestamp_ntz")

    def after(k):
        return base + F.make_ym_interval(months=F.lit(24) * k + first)

    return t.supplier.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        F.col("s_suppkey").alias("l_suppkey"),
        after(F.col("k")).alias("start_date"),
        F.when(F.col("k") < 2, after(F.col("k") + 1)).alias("end_date"),
        (F.col("s_acctbal") * (F.col("k") + 1)).alias("rate"),
    )


EFFECTIVE_SQL = PERIODS_SQL + """
SELECT l_suppkey, rate, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN periods
  ON l_suppkey = s_suppkey AND l_shipdate >= start_date AND (end_date IS NULL OR l_shipdate < end_date)
GROUP BY ALL
"""


def _per_rate(df):
    return df.groupBy("l_suppkey", "rate").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query(EFFECTIVE_SQL)
def effective_join(t):
    facts = t.lineitem.select("l_suppkey", "l_shipdate", "l_quantity")
    return _per_rate(joins.effective_join(facts, _periods(t), "l_suppkey", "l_shipdate"))


@query(EFFECTIVE_SQL)
def effective_join_without_broadcast(t):
    facts = t.lineitem.select("l_suppkey", "l_shipdate", "l_quantity")
    return _per_rate(joins.effective_join(facts, _periods(t), "l_suppkey", "l_shipdate", max_rows=0))


@query(PERIODS_SQL + """
SELECT l_suppkey, rate, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN periods ON l_suppkey = s_suppkey AND k = 0
GROUP BY ALL
""")
def effective_join_first(t):
    facts = t.lineitem.select("l_suppkey", "l_shipdate", "l_quantity")
    return _per_rate(joins.effective_join(facts, _periods(t), "l_suppkey", "l_shipdate", mode="first"))


@query(EFFECTIVE_SQL)
def effective_join_hostile(t):
    """Periods without a start are never in force, on the route for many periods as on that for few."""
    periods = _periods(t)
    unstarted = periods.withColumn("start_date", F.lit(None).cast(periods.schema["start_date"].dataType))
    facts = t.lineitem.select("l_suppkey", "l_shipdate", "l_quantity")
    return _per_rate(joins.effective_join(facts, periods.unionByName(unstarted), "l_suppkey", "l_shipdate", max_rows=0))


@query("""
SELECT o_orderkey, o_custkey, c_mktsegment, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0
""")
def sized_join_left(t):
    dim = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    return joins.sized_join(t.orders.select("o_orderkey", "o_custkey"), dim, ["o_custkey"], "left")


@query("""
SELECT n_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
""")
def salted_join(t):
    dim = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    # low bounds take the route for a dimension too large to broadcast and keys that are hot
    joined = joins.sized_join(t.orders.select("o_custkey", "o_totalprice"), dim, ["o_custkey"], "inner", max_rows=0)
    named = joined.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy("n_name", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


NEAREST_SQL = """
WITH v AS (SELECT CAST(o_orderdate AS DATE) AS event, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY ALL),
e AS (SELECT event FROM v WHERE cents > (SELECT avg(cents) * 1.2 FROM v)),
span AS (SELECT min(event) AS lo, max(event) AS hi FROM e),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM span),
last AS (SELECT d, event FROM days ASOF JOIN e ON d >= event),
next AS (SELECT d, event FROM days ASOF JOIN e ON d <= event)
SELECT d, CASE WHEN next.event - d <= d - last.event THEN next.event ELSE last.event END AS event
FROM days JOIN last USING (d) JOIN next USING (d)
"""


@query(NEAREST_SQL)
def nearest_event(t):
    # the events are the days on which orders add up to well over the average
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents")
    days = t.orders.groupBy(F.to_date("o_orderdate").alias("event")).agg(cents)
    usual = days.agg(F.avg("cents")).first()[0]
    return joins.nearest_event(days.where(F.col("cents") > usual * 1.2).select("event"), "event")


FLOWS_SQL = """
WITH l AS (
  SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem
  ORDER BY l_orderkey, l_linenumber, l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC),
raw AS (
  SELECT l_shipdate AS hh_end, sn.n_regionkey AS f, cn.n_regionkey AS t, CAST(sum(l_quantity - 25) AS DOUBLE) AS e
  FROM l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  WHERE sn.n_regionkey <> cn.n_regionkey GROUP BY ALL),
flows AS (
  SELECT hh_end, CASE WHEN e < 0 THEN t ELSE f END AS regionfrom, CASE WHEN e < 0 THEN f ELSE t END AS regionto, abs(e) AS energy_mwh
  FROM raw)
"""


def _flows(t):
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    from panelspark.operators.dedupe import keep_latest

    order = ["-l_shipdate", "-l_partkey", "-l_suppkey", "-l_quantity", "-l_extendedprice"]
    latest = keep_latest(lines, ["l_orderkey", "l_linenumber"], order)
    homes = t.nation.select("n_nationkey", "n_regionkey")
    buyers = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        homes, F.col("c_nationkey") == F.col("n_nationkey")
    ).select("o_orderkey", F.col("n_regionkey").alias("regionto"))
    sellers = t.supplier.join(homes, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("n_regionkey").alias("regionfrom")
    )
    trades = latest.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).join(
        sellers, F.col("l_suppkey") == F.col("s_suppkey")
    )
    net = (
        trades.where("regionfrom <> regionto")
        .groupBy(F.col("l_shipdate").alias("hh_end"), "regionfrom", "regionto")
        .agg(F.sum(F.col("l_quantity") - 25).alias("energy_mwh"))
    )
    return market.orient_flows(net, exclude=())


@query(FLOWS_SQL + "SELECT * FROM flows")
def oriented_flows(t):
    return _flows(t)


LOCAL_SQL = """
, local AS (
  SELECT l_shipdate AS hh_end, n_regionkey AS regionid, CAST(sum(l_quantity) AS DOUBLE) AS energy_mwh,
    sum(CAST(l_quantity * 100 AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) / 9973.0 AS co2_t
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
"""


def _local(t):
    placed = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        t.nation, F.col("s_nationkey") == F.col("n_nationkey")
    )
    whole = (F.col("l_quantity") * 100).cast("bigint") * F.round(F.col("l_discount") * 100).cast("bigint")
    return placed.groupBy(F.col("l_shipdate").alias("hh_end"), F.col("n_regionkey").alias("regionid")).agg(
        F.sum("l_quantity").alias("energy_mwh"), (F.sum(whole) / 9973.0).alias("co2_t")
    )


ATTRIBUTED_SQL = FLOWS_SQL + LOCAL_SQL + """
, moved AS (
  SELECT fl.hh_end, regionfrom, regionto, fl.energy_mwh, fl.energy_mwh * co2_t / nullif(lo.energy_mwh, 0) AS co2_t
  FROM flows fl JOIN local lo ON lo.hh_end = fl.hh_end AND lo.regionid = regionfrom),
pieces AS (
  SELECT hh_end, regionid, energy_mwh, co2_t FROM local
  UNION ALL SELECT hh_end, regionfrom, -energy_mwh, -co2_t FROM moved
  UNION ALL SELECT hh_end, regionto, energy_mwh, co2_t FROM moved),
attributed AS (
  SELECT regionid, hh_end, CASE WHEN count(co2_t) = count(*) THEN sum(co2_t) END AS co2_t,
    CASE WHEN count(energy_mwh) = count(*) THEN sum(energy_mwh) END AS energy_mwh
  FROM pieces GROUP BY ALL)
"""


@query(ATTRIBUTED_SQL + "SELECT regionid, hh_end, round(co2_t, 6) + 0.0::DOUBLE AS co2_t, energy_mwh + 0.0::DOUBLE AS energy_mwh FROM attributed")
def flow_attribution(t):
    out = market.attribute_flows(_local(t), _flows(t))
    # adding zero turns a negative zero into zero
    return out.withColumns({"co2_t": F.round("co2_t", 6) + 0.0, "energy_mwh": F.col("energy_mwh") + 0.0})


@query(FLOWS_SQL + LOCAL_SQL + """
SELECT regionid, hh_end, local.energy_mwh, power * 0.5 AS rooftop_solar_energy_mwh,
  local.energy_mwh + power * 0.5 AS energy_mwh_adj_rooftop_solar
FROM local LEFT JOIN (
  SELECT n_regionkey AS regionid, o_orderdate AS hh_end, CAST(count(*) AS DOUBLE) AS power FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderstatus = 'F' GROUP BY ALL) USING (regionid, hh_end)
""")
def rooftop_left_join(t):
    homes = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey")
    power = (
        t.orders.where("o_orderstatus = 'F'")
        .join(homes, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("n_regionkey").alias("regionid"), F.col("o_orderdate").alias("hh_end"))
        .agg((F.count(F.lit(1)) * 0.5).cast("double").alias("rooftop_solar_energy_mwh"))
    )
    return market.add_rooftop(_local(t).drop("co2_t"), power)


@query("""
WITH homes AS (SELECT n_regionkey AS regionid, count(*) AS population FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
""" + FLOWS_SQL.strip()[4:] + LOCAL_SQL + """
SELECT regionid, hh_end, population, round(co2_t / population * 1000, 6) AS co2_kg_per_capita,
  round(energy_mwh / population * 1000, 6) AS energy_kwh_per_capita,
  round((energy_mwh + 1) / population * 1000, 6) AS energy_kwh_adj_rooftop_solar_per_capita,
  round(energy_mwh * 24 / 1000000, 9) AS total_renewables_today_twh, round(energy_mwh * 12 / 1000000, 9) AS total_renewables_today_twh_uigf
FROM local JOIN homes USING (regionid)
""")
def per_capita(t):
    homes = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    heads = homes.groupBy(F.col("n_regionkey").alias("regionid")).agg(F.count(F.lit(1)).alias("population"))
    totals = _local(t).withColumns(
        {
            "energy_mwh_adj_rooftop_solar": F.col("energy_mwh") + 1,
            "total_renewables_today_mwh": F.col("energy_mwh") * 24,
            "total_renewables_today_mwh_uigf": F.col("energy_mwh") * 12,
        }
    )
    out = panel.per_capita(joins.sized_join(totals, heads, ["regionid"]))
    digits = {c: 9 if "twh" in c else 6 for c in out.columns if "capita" in c or "twh" in c}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})
