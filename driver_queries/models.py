"""Regressions and their tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.names import label_code
from panelspark.plans import models
from panelspark.stats import tables
from panelspark.stats.absorb import absorb, absorb_in_turns
from panelspark.stats.event_study import event_study as fit_event_study
from panelspark.stats.grouped import grouped_wls
from panelspark.stats.wls import coefficient_table, joint_test, stat_table, wls

from .registry import query


def _coefs(t, fit, *columns, digits=6):
    out = coefficient_table(t.spark, {"m": fit}).select("term", *columns)
    return out.withColumns({c: F.round(c, digits) for c in columns})


SIMPLE_SQL = """
WITH f AS (SELECT l_extendedprice AS y, l_quantity AS x, l_tax + 0.5 AS w, l_linenumber AS g FROM lineitem),
m AS (SELECT count(*) AS n, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM f),
s AS (SELECT any_value(n) AS n, any_value(sw) AS sw, any_value(mx) AS mx, any_value(my) AS my,
   sum(w * (x - mx) ** 2) * any_value(n) / any_value(sw) AS sxx, sum(w * (x - mx) * (y - my)) * any_value(n) / any_value(sw) AS sxy,
   sum(w * (y - my) ** 2) * any_value(n) / any_value(sw) AS syy FROM f, m),
b AS (SELECT *, sxy / sxx AS slope, my - sxy / sxx * mx AS icept, (syy - sxy * sxy / sxx) / (n - 2) AS s2 FROM s)
"""


@query(SIMPLE_SQL + """
SELECT 'l_quantity' AS term, round(slope, 4) AS coef, round(sqrt(s2 / sxx), 4) AS se FROM b
UNION ALL SELECT '_cons', round(icept, 4), round(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 4) FROM b
""")
def wls_simple(t):
    df = t.lineitem.withColumn("w", F.col("l_tax") + 0.5)
    return _coefs(t, wls(df, "l_extendedprice", "l_quantity", "w"), "coef", "se", digits=4)


@query(SIMPLE_SQL + """
, u AS (SELECT g, sum(w * (y - icept - slope * x) * (x - mx)) * any_value(n) / any_value(sw) / any_value(sxx) AS ub,
   sum(w * (y - icept - slope * x)) / any_value(sw) AS uc, any_value(mx) AS mx, any_value(n) AS n FROM f, b GROUP BY g),
v AS (SELECT count(*) / (count(*) - 1.0) * (any_value(n) - 1.0) / (any_value(n) - 2.0) AS k, sum(ub * ub) AS vb, sum((uc - mx * ub) ** 2) AS vc FROM u)
SELECT 'l_quantity' AS term, round(slope, 4) AS coef, round(sqrt(k * vb), 4) AS se, round(slope / sqrt(k * vb), 4) AS t FROM b, v
UNION ALL SELECT '_cons', round(icept, 4), round(sqrt(k * vc), 4), round(icept / sqrt(k * vc), 4) FROM b, v
""")
def wls_cluster(t):
    df = t.lineitem.withColumn("w", F.col("l_tax") + 0.5)
    fit = wls(df, "l_extendedprice", "l_quantity", "w", cluster="l_linenumber")
    return _coefs(t, fit, "coef", "se", "t", digits=4)


@query("""
WITH f AS (SELECT l_extendedprice AS y, l_quantity AS x, l_quantity * l_quantity AS z, l_tax + 0.5 AS w FROM lineitem),
m AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * z) / sum(w) AS mz, sum(w * y) / sum(w) AS my FROM f),
s AS (SELECT any_value(mx) AS mx, any_value(mz) AS mz, any_value(my) AS my, count(*) AS n, sum(w) AS sw,
  sum(w * (x - mx) ** 2) AS xx, sum(w * (z - mz) ** 2) AS zz, sum(w * (x - mx) * (z - mz)) AS xz,
  sum(w * (x - mx) * (y - my)) AS xy, sum(w * (z - mz) * (y - my)) AS zy, sum(w * (y - my) ** 2) AS yy FROM f, m),
b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM s),
r AS (SELECT *, 1 - (yy - bx * xy - bz * zy) / yy AS r2 FROM b)
SELECT 'coef' AS kind, 'l_quantity' AS name, round(bx, 4) AS value FROM r
UNION ALL SELECT 'coef', 'l_quantity#l_quantity', round(bz, 4) FROM r
UNION ALL SELECT 'coef', '_cons', round(my - bx * mx - bz * mz, 4) FROM r
UNION ALL SELECT 'stat', 'r2', round(r2, 4) FROM r
UNION ALL SELECT 'stat', 'r2_a', round(1 - (1 - r2) * (n - 1) / (n - 3), 4) FROM r
UNION ALL SELECT 'stat', 'rmse', round(sqrt((yy - bx * xy - bz * zy) * n / sw / (n - 3)), 4) FROM r
UNION ALL SELECT 'stat', 'n', n FROM r
UNION ALL SELECT 'stat', 'df_m', 2 FROM r
""")
def wls_controls(t):
    df = t.lineitem.withColumn("w", F.col("l_tax") + 0.5)
    fits = {"m": wls(df, "l_extendedprice", "l_quantity + l_quantity^2", "w")}
    coefs = coefficient_table(t.spark, fits).select(F.lit("coef").alias("kind"), F.col("term").alias("name"), F.col("coef").alias("value"))
    stats = stat_table(t.spark, fits).select(F.lit("stat").alias("kind"), F.col("stat").alias("name"), "value")
    return coefs.unionByName(stats).withColumn("value", F.round("value", 4))


FLAGS = """
WITH f AS (SELECT (l_returnflag = 'R')::INT AS a, (l_shipdate >= '1998-07-01')::INT AS p, (l_linenumber > 3)::INT AS m, l_discount AS y, l_quantity AS w FROM lineitem)
"""


def _flags(t):
    return t.lineitem.select(
        (F.col("l_returnflag") == "R").alias("treated"),
        (F.col("l_shipdate") >= F.lit("1998-07-01").cast("timestamp_ntz")).alias("post"),
        (F.col("l_linenumber") > 3).alias("not_midday"),
        "l_discount",
        "l_quantity",
        "l_linenumber",
    )


@query(FLAGS + """
, c AS (SELECT a, p, sum(w * y) / sum(w) AS m FROM f GROUP BY ALL),
k AS (SELECT max(m) FILTER (a = 0 AND p = 0) AS c00, max(m) FILTER (a = 1 AND p = 0) AS c10, max(m) FILTER (a = 0 AND p = 1) AS c01, max(m) FILTER (a = 1 AND p = 1) AS c11 FROM c)
SELECT unnest(['_cons', 'treated', 'post', 'treated#post']) AS term,
  unnest([round(c00, 8), round(c10 - c00, 8), round(c01 - c00, 8), round(c11 - c10 - c01 + c00, 8)]) AS coef FROM k
""")
def did_saturated(t):
    return _coefs(t, wls(_flags(t), "l_discount", "treated*post", "l_quantity"), "coef", digits=8)


@query(FLAGS + """
, c AS (SELECT a, p, m, sum(w * y) / sum(w) AS v FROM f GROUP BY ALL),
k AS (SELECT max(v) FILTER (a = 0 AND p = 0 AND m = 0) AS c000, max(v) FILTER (a = 1 AND p = 0 AND m = 0) AS c100,
  max(v) FILTER (a = 0 AND p = 1 AND m = 0) AS c010, max(v) FILTER (a = 0 AND p = 0 AND m = 1) AS c001,
  max(v) FILTER (a = 1 AND p = 1 AND m = 0) AS c110, max(v) FILTER (a = 1 AND p = 0 AND m = 1) AS c101,
  max(v) FILTER (a = 0 AND p = 1 AND m = 1) AS c011, max(v) FILTER (a = 1 AND p = 1 AND m = 1) AS c111 FROM c)
SELECT unnest(['_cons', 'treated', 'post', 'not_midday', 'treated#post', 'treated#not_midday', 'post#not_midday', 'treated#post#not_midday']) AS term,
  unnest([round(c000, 8), round(c100 - c000, 8), round(c010 - c000, 8), round(c001 - c000, 8), round(c110 - c100 - c010 + c000, 8),
    round(c101 - c100 - c001 + c000, 8), round(c011 - c010 - c001 + c000, 8),
    round(c111 - c110 - c101 - c011 + c100 + c010 + c001 - c000, 8)]) AS coef FROM k
""")
def ddd_saturated(t):
    fit = wls(_flags(t), "l_discount", "treated*post*not_midday", "l_quantity", cluster="l_linenumber")
    return _coefs(t, fit, "coef", digits=8)


@query("""
WITH f AS (SELECT ln(o_totalprice - 100000) AS y, o_custkey AS x FROM orders WHERE o_totalprice > 100000)
SELECT 'o_custkey' AS term, round(regr_slope(y, x), 9) AS coef FROM f UNION ALL SELECT '_cons', round(regr_intercept(y, x), 9) FROM f
""")
def log_outcome(t):
    above = F.col("o_totalprice") - 100000
    df = t.orders.withColumn("ln_y", F.when(above > 0, F.ln(above)))
    return _coefs(t, wls(df, "ln_y", "o_custkey"), "coef", digits=9)


@query("""
SELECT l_returnflag, l_linestatus, term, round(coef, 4) AS coef, round(r2, 8) AS r2 FROM (
  SELECT l_returnflag, l_linestatus, 'l_quantity' AS term, regr_slope(l_extendedprice, l_quantity) AS coef, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem GROUP BY ALL
  UNION ALL SELECT l_returnflag, l_linestatus, '_cons', regr_intercept(l_extendedprice, l_quantity), regr_r2(l_extendedprice, l_quantity) FROM lineitem GROUP BY ALL)
""")
def grouped_regression(t):
    keys = ["l_returnflag", "l_linestatus"]
    fits = wls(t.lineitem, "l_extendedprice", "l_quantity", by=keys)
    rows = [
        (*key, name, float(b), float(fit.stats["r2"])) for key, fit in fits.items() for name, b in zip(fit.names, fit.coef)
    ]
    out = t.spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, term string, coef double, r2 double")
    return out.withColumns({"coef": F.round("coef", 4), "r2": F.round("r2", 8)})


@query("""
WITH s AS (SELECT l_partkey, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
  regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, avg(l_quantity) AS mx FROM lineitem GROUP BY l_partkey),
e AS (SELECT *, greatest(syy - b * b * sxx, 0) AS rss FROM s WHERE n > 2 AND sxx > 0 AND syy > 0)
SELECT l_partkey, 'l_quantity' AS term, n, round(b, 4) AS coef, round(sqrt(rss / (n - 2) / sxx), 3) AS se, round(1 - rss / syy, 6) AS r2 FROM e
UNION ALL SELECT l_partkey, '_cons', n, round(a, 4), round(sqrt(rss / (n - 2) * (1.0 / n + mx * mx / sxx)), 3), round(1 - rss / syy, 6) FROM e
""")
def grouped_regression_many(t):
    out = grouped_wls(t.lineitem, "l_extendedprice", "l_quantity", ["l_partkey"])
    sound = out.where("df_resid > 0 and r2 is not null").withColumn("kept", F.min(F.col("coef").isNotNull()).over(Window.partitionBy("l_partkey")))
    rounded = {"coef": F.round("coef", 4), "se": F.round("se", 3), "r2": F.round("r2", 6)}
    return sound.where("kept").withColumns(rounded).select("l_partkey", "term", "n", "coef", "se", "r2")


@query("""
WITH f AS (SELECT l_suppkey AS g, l_extendedprice AS y, l_quantity AS x, l_discount AS z, l_tax + 0.5 AS w FROM lineitem),
m AS (SELECT g, count(*) AS n, sum(w * x) / sum(w) AS mx, sum(w * z) / sum(w) AS mz, sum(w * y) / sum(w) AS my FROM f GROUP BY g),
s AS (SELECT g, any_value(n) AS n, any_value(mx) AS mx, any_value(mz) AS mz, any_value(my) AS my,
  sum(w * (x - mx) ** 2) AS xx, sum(w * (z - mz) ** 2) AS zz, sum(w * (x - mx) * (z - mz)) AS xz,
  sum(w * (x - mx) * (y - my)) AS xy, sum(w * (z - mz) * (y - my)) AS zy FROM f JOIN m USING (g) GROUP BY g),
b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM s)
SELECT g AS l_suppkey, 'l_quantity' AS term, n, round(bx, 4) AS coef FROM b
UNION ALL SELECT g, 'l_discount', n, round(bz, 3) FROM b
UNION ALL SELECT g, '_cons', n, round(my - bx * mx - bz * mz, 3) FROM b
""")
def grouped_regression_weighted(t):
    df = t.lineitem.withColumn("w", F.col("l_tax") + 0.5)
    out = grouped_wls(df, "l_extendedprice", "l_quantity + l_discount", ["l_suppkey"], "w")
    digits = F.when(F.col("term") == "l_quantity", F.round("coef", 4)).otherwise(F.round("coef", 3))
    return out.select("l_suppkey", "term", "n", digits.alias("coef"))


@query("""
WITH f AS (SELECT l_extendedprice AS y, l_linenumber AS k, l_returnflag AS g FROM lineitem),
m AS (SELECT k, avg(y) AS my, count(*) AS nk FROM f GROUP BY k),
u AS (SELECT g, sum(CASE k WHEN 1 THEN y - my ELSE 0 END) / any_value((SELECT nk FROM m WHERE k = 1)) AS u1,
  sum(CASE k WHEN 2 THEN y - my ELSE 0 END) / any_value((SELECT nk FROM m WHERE k = 2)) AS u2,
  sum(CASE k WHEN 3 THEN y - my ELSE 0 END) / any_value((SELECT nk FROM m WHERE k = 3)) AS u3,
  sum(CASE k WHEN 4 THEN y - my ELSE 0 END) / any_value((SELECT nk FROM m WHERE k = 4)) AS u4 FROM f JOIN m USING (k) GROUP BY g),
c AS (SELECT 2 AS k, g, u2 - u1 AS d FROM u UNION ALL SELECT 3, g, u3 - u1 FROM u UNION ALL SELECT 4, g, u4 - u1 FROM u),
z AS (SELECT 1.5 * ((SELECT count(*) FROM f) - 1.0) / ((SELECT count(*) FROM f) - 7.0) AS factor),
t AS (SELECT 'leads first' AS test, 2 AS i, 3 AS j UNION ALL SELECT 'lags first', 4, 3),
v AS (SELECT test, any_value(i) AS i, any_value(j) AS j, sum(a.d * a.d) AS vii, sum(b.d * b.d) AS vjj, sum(a.d * b.d) AS vij
  FROM t JOIN c a ON a.k = t.i JOIN c b ON b.k = t.j AND b.g = a.g GROUP BY test),
e AS (SELECT v.*, mi.my - m1.my AS bi, mj.my - m1.my AS bj FROM v JOIN m mi ON mi.k = v.i JOIN m mj ON mj.k = v.j JOIN m m1 ON m1.k = 1),
w AS (SELECT test, (bi * bi * vjj - 2 * bi * bj * vij + bj * bj * vii) / (vii * vjj - vij * vij) / factor / 2 AS f FROM e, z)
SELECT test, round(f, 5) AS f, 2.0::DOUBLE AS df1, 2.0::DOUBLE AS df2, round(1 / (1 + f), 6) AS p FROM w
""")
def joint_test_dropped(t):
    """Three coefficients, three clusters: two constraints can be tested, in the order given."""
    lines = {f"line{k}": (F.col("l_linenumber") == k).cast("int") for k in range(2, 8)}
    fit = wls(t.lineitem.withColumns(lines), "l_extendedprice", " + ".join(lines), cluster="l_returnflag")
    orders = {"leads first": ["line2", "line3", "line4"], "lags first": ["line4", "line3", "line2"]}
    found = {name: joint_test(fit, terms, dropped=True) for name, terms in orders.items()}
    rows = [(name, round(r["f"], 5), r["df1"], r["df2"], round(r["p"], 6)) for name, r in found.items()]
    return t.spark.createDataFrame(rows, "test string, f double, df1 double, df2 double, p double")


# One regressor, days demeaned, the two-level effect as a dummy: two equations in two unknowns.
ABSORB_SQL = """
WITH f AS (SELECT l_extendedprice AS y, l_quantity AS x, (l_linestatus = 'O')::DOUBLE AS s, l_shipdate AS d, l_linenumber AS g, l_tax + 0.5 AS w FROM lineitem),
m AS (SELECT d, sum(w * y) / sum(w) AS my, sum(w * x) / sum(w) AS mx, sum(w * s) / sum(w) AS ms FROM f GROUP BY d),
q AS (SELECT w, g, y, x, y - my AS ty, x - mx AS tx, s - ms AS ts FROM f JOIN m USING (d)),
z AS (SELECT count(*) AS n, sum(w) AS sw, sum(w * x) / sum(w) AS xbar, sum(w * y) / sum(w) AS ybar,
  sum(w * tx * tx) AS xx, sum(w * ts * ts) AS ss, sum(w * tx * ts) AS xs, sum(w * tx * ty) AS xy, sum(w * ts * ty) AS sy FROM q),
b AS (SELECT *, (xy * ss - sy * xs) / (xx * ss - xs * xs) AS bx, (sy * xx - xy * xs) / (xx * ss - xs * xs) AS bs, xx - xs * xs / ss AS xxs FROM z),
"""


ABSORB_CLUSTER_SQL = ABSORB_SQL + """
u AS (SELECT g, sum(w * (tx - xs / ss * ts) * (ty - bx * tx - bs * ts)) / any_value(xxs) AS ub, sum(w * (ty - bx * tx - bs * ts)) / any_value(sw) AS uc FROM q, b GROUP BY g),
v AS (SELECT count(*) / (count(*) - 1.0) AS k, sum(ub * ub) AS vb, sum((uc - xbar * ub) ** 2) AS vc FROM u, b),
h AS (SELECT k * (n - 1.0) / (n - 1 - 1 - 1 - ((SELECT count(*) FROM m) - 1)) AS f, vb, vc, bx, ybar - xbar * bx AS cons FROM v, b)
SELECT 'l_quantity' AS term, round(bx, 4) AS coef, round(sqrt(f * vb), 4) AS se FROM h
UNION ALL SELECT '_cons', round(cons, 4), round(sqrt(f * vc), 4) FROM h
"""


@query(ABSORB_CLUSTER_SQL)
def absorb_two_way(t):
    df = t.lineitem.withColumn("w", F.col("l_tax") + 0.5)
    fit = absorb(df, "l_extendedprice", "l_quantity", ("l_linestatus", "l_shipdate"), "w", cluster="l_linenumber")
    return _coefs(t, fit, "coef", "se", digits=4)


@query(ABSORB_SQL + """
last AS (SELECT 1)
SELECT 'l_quantity' AS term, round(bx, 4) AS coef FROM b UNION ALL SELECT '_cons', round(ybar - xbar * bx, 4) FROM b
""")
def absorb_alternating(t):
    df = t.lineitem.withColumn("w", F.col("l_tax") + 0.5)
    fit = absorb_in_turns(df, "l_extendedprice", "l_quantity", ("l_linestatus", "l_shipdate"), "w")
    return _coefs(t, fit, "coef", digits=4)


# Orders as one effect and half of the lines of 32 orders as the other: each 32 orders are a part of their own,
# where the second effect is one dummy at most.
@query("""
WITH f AS (SELECT l_extendedprice AS y, l_quantity AS x, (l_linenumber > 3)::DOUBLE AS s, l_orderkey AS d, l_orderkey // 32 AS part, l_tax + 0.5 AS w FROM lineitem),
m AS (SELECT d, sum(w * y) / sum(w) AS my, sum(w * x) / sum(w) AS mx, sum(w * s) / sum(w) AS ms FROM f GROUP BY d),
q AS (SELECT part, w, y - my AS ty, x - mx AS tx, s - ms AS ts FROM f JOIN m USING (d)),
z AS (SELECT part, sum(w * ts * ts) AS ss, sum(w * tx * ts) AS xs, sum(w * ty * ts) AS ys FROM q GROUP BY part),
r AS (SELECT w, CASE WHEN ss > 1e-9 THEN tx - xs / ss * ts ELSE tx END AS rx, CASE WHEN ss > 1e-9 THEN ty - ys / ss * ts ELSE ty END AS ry FROM q JOIN z USING (part)),
b AS (SELECT sum(w * rx * ry) / sum(w * rx * rx) AS b, sum(w * rx * rx) AS xx, sum(w * ry * ry) AS yy, count(*) AS n,
  (SELECT count(*) FROM m) + (SELECT count(*) FROM z WHERE ss > 1e-9) AS levels FROM r),
t AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM f)
SELECT 'coef' AS kind, 'l_quantity' AS name, round(b, 4) AS value FROM b
UNION ALL SELECT 'coef', '_cons', round(my - b * mx, 4) FROM b, t
UNION ALL SELECT 'se', 'l_quantity', round(sqrt((yy - b * b * xx) / (n - 1 - levels) / xx), 4) FROM b
UNION ALL SELECT 'stat', 'absorbed', levels - 1 FROM b
UNION ALL SELECT 'stat', 'r2_within', round(b * b * xx / yy, 8) FROM b
""")
def absorb_parts(t):
    df = t.lineitem.select(
        "l_extendedprice", "l_quantity", "l_orderkey", (F.col("l_tax") + 0.5).alias("w"),
        F.concat_ws("-", F.expr("l_orderkey div 32"), F.col("l_linenumber") > 3).alias("half"),
    )
    fit = absorb(df, "l_extendedprice", "l_quantity", ("l_orderkey", "half"), "w", max_levels=100)
    coefs = coefficient_table(t.spark, {"m": fit})
    stats = stat_table(t.spark, {"m": fit}).where(F.col("stat").isin("absorbed", "r2_within"))
    rows = coefs.select(F.lit("coef").alias("kind"), F.col("term").alias("name"), F.round("coef", 4).alias("value"))
    rows = rows.unionByName(coefs.where("term <> '_cons'").select(F.lit("se").alias("kind"), F.col("term").alias("name"), F.round("se", 4).alias("value")))
    return rows.unionByName(stats.select(F.lit("stat").alias("kind"), F.col("stat").alias("name"), F.round("value", 8).alias("value")))


@query(ABSORB_CLUSTER_SQL)
def absorb_many_levels(t):
    """Both effects as if they were too long for dummies."""
    df = t.lineitem.withColumn("w", F.col("l_tax") + 0.5)
    fit = absorb(df, "l_extendedprice", "l_quantity", ("l_linestatus", "l_shipdate"), "w", cluster="l_linenumber", max_levels=1)
    return _coefs(t, fit, "coef", "se", digits=4)


EVENT_SQL = """
WITH p AS (SELECT user_id % 5 AS r, CAST(ts AS DATE) AS d, avg(value) AS y FROM events GROUP BY ALL),
g AS (SELECT d, avg(y) FILTER (r > 0) - max(y) FILTER (r = 0) AS gap, d - DATE '2024-01-16' AS k FROM p GROUP BY d),
base AS (SELECT gap AS b FROM g WHERE k = -1)
SELECT CASE WHEN k < 0 THEN 'lead' || -k ELSE 'lag' || k END AS term, round(gap - b, 6) AS coef FROM g, base WHERE k <> -1
"""


@query(EVENT_SQL)
def event_study(t):
    return _event_study(t)


def _event_study(t, **limits):
    daily = t.events.groupBy((F.col("user_id") % 5).alias("region"), F.to_date("ts").alias("d")).agg(
        F.avg("value").alias("y")
    )
    days = F.datediff("d", F.lit("2024-01-16").cast("date"))
    fit = fit_event_study(
        daily, "y", "", F.when(F.col("region") > 0, days), ("region", "d"), cluster="region", **limits
    )
    return _coefs(t, fit, "coef").where("term <> '_cons'")


@query(EVENT_SQL)
def event_study_many_levels(t):
    return _event_study(t, max_levels=1)


@query("""
SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INTEGER) AS code FROM orders
""")
def label_codes(t):
    return label_code(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code")


@query("""
SELECT unnest(['_cons', 'far']) AS term, unnest([round((regr_intercept(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * 1e7) / 1e7, 6),
  round(regr_slope(l_extendedprice, l_quantity), 6)]) AS coef FROM lineitem
""")
def wls_far_from_zero(t):
    """A regressor whose mean is a million times its spread; the constant is shown per 1e7."""
    fit = wls(t.lineitem.select("l_extendedprice", (F.col("l_quantity").cast("double") + 1e7).alias("far")), "l_extendedprice", "far")
    rows = coefficient_table(t.spark, {"m": fit})
    scale = F.when(F.col("term") == "_cons", 1e7).otherwise(1.0)
    return rows.select("term", F.round(F.col("coef") / scale, 6).alias("coef"))


# Saturated models: a coefficient is a signed sum of cell means (bits of the cell within the bits of the term), and so is its influence.
# With seven clusters t has six degrees of freedom, whose distribution is a short sum.
SATURATED_SQL = """
, c AS (SELECT model, c, sum(w) AS sw, sum(w * y) / sum(w) AS mean FROM x GROUP BY ALL),
s AS (SELECT model, g, c, sum(w * (y - mean)) / any_value(sw) AS u FROM x JOIN c USING (model, c) GROUP BY ALL),
t AS (SELECT model, c AS term FROM c),
b AS (SELECT model, term, sum((-1) ** (bit_count(term) - bit_count(c)) * mean) AS coef FROM t JOIN c USING (model) WHERE (c & term) = c GROUP BY ALL),
i AS (SELECT model, term, g, sum((-1) ** (bit_count(term) - bit_count(c)) * u) AS u FROM t JOIN s USING (model) WHERE (c & term) = c GROUP BY ALL),
v AS (SELECT model, term, sum(u * u) AS v FROM i GROUP BY ALL),
z AS (SELECT model, count(*) AS n, count(DISTINCT g) AS groups, sum(w * (y - mean) ** 2) AS rss, sum(w * y * y) - sum(w * y) ** 2 / sum(w) AS tss FROM x JOIN c USING (model, c) GROUP BY ALL),
k AS (SELECT model, count(*) AS k FROM c GROUP BY ALL),
r AS (
  SELECT model, coalesce(nullif(array_to_string(list_filter([CASE WHEN term & 1 > 0 THEN 'treated' END, CASE WHEN term & 2 > 0 THEN 'post' END,
      CASE WHEN term & 4 > 0 THEN 'not_midday' END], lambda q: q IS NOT NULL), '#'), ''), '_cons') AS term,
    coef, sqrt(v * groups / (groups - 1.0) * (n - 1.0) / (n - k)) AS se
  FROM b JOIN v USING (model, term) JOIN z USING (model) JOIN k USING (model)),
p AS (
  SELECT model, term, coef, se, 1 - sin(a) * (1 + cos(a) ** 2 / 2 + 3 * cos(a) ** 4 / 8) AS p FROM (SELECT *, atan(abs(coef / se) / sqrt(6)) AS a FROM r)),
st AS (SELECT model, n, 1 - rss / tss AS r2, 1 - rss / tss * (n - 1.0) / (n - k) AS r2_a FROM z JOIN k USING (model))
"""


def _six_digits(x: str) -> str:
    """SQL for six significant digits, zeros at the end included."""
    decimals = f"(5 - floor(log10(abs({x}))))::INT"
    return f"CASE WHEN abs({x}) BETWEEN 0.0001 AND 999999 THEN printf('%.' || {decimals} || 'f', {x}) ELSE printf('%.5e', {x}) END"


@query(FLAGS.replace("l_quantity AS w", "l_quantity AS w, l_linenumber AS g") + """
, x AS (SELECT 'base' AS model, a + 2 * p AS c, y, w, g FROM f UNION ALL SELECT 'triple', a + 2 * p + 4 * m, y, w, g FROM f)
""" + SATURATED_SQL + f"""
, cells AS (
  SELECT model, term AS row, {_six_digits("coef")} || CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END
    || ' (' || {_six_digits("se")} || ')' AS cell FROM p
  UNION ALL SELECT model, 'n', {_six_digits("n::DOUBLE")} FROM st
  UNION ALL SELECT model, 'r2', {_six_digits("r2")} FROM st
  UNION ALL SELECT model, 'r2_a', {_six_digits("r2_a")} FROM st)
SELECT row, max(cell) FILTER (model = 'base') AS base, max(cell) FILTER (model = 'triple') AS triple FROM cells GROUP BY row
""")
def result_table(t):
    """Two models side by side with standard errors and stars."""
    flags = _flags(t)
    fits = {
        "base": wls(flags, "l_discount", "treated*post", "l_quantity", "l_linenumber"),
        "triple": wls(flags, "l_discount", "treated*post*not_midday", "l_quantity", "l_linenumber"),
    }
    return tables.model_table(t.spark, fits)


SAMPLE_SQL = ["true", "l_linestatus = 'O'", "l_linestatus <> 'O' AND l_quantity > 10"]


@query("WITH f AS (SELECT (l_returnflag = 'R')::INT AS a, (l_shipdate >= '1998-07-01')::INT AS p, l_discount AS y, l_quantity AS w, l_linenumber AS g, l_linestatus, l_quantity FROM lineitem)"
    ", x AS (" + " UNION ALL ".join(f"SELECT 's{i}' AS model, a + 2 * p AS c, y, w, g FROM f WHERE {s}" for i, s in enumerate(SAMPLE_SQL)) + ")"
    + SATURATED_SQL + """
SELECT model, term, round(coef, 8) AS coef, round(se, 8) AS se, round(p, 6) AS p FROM p
UNION ALL SELECT model, 'r2_a', round(r2_a, 8), NULL, NULL FROM st UNION ALL SELECT model, 'n', n, NULL, NULL FROM st
""")
def sample_models(t):
    """One specification on three sub-samples, fitted together."""
    frame = t.lineitem.select(
        (F.col("l_returnflag") == "R").cast("double").alias("treated"),
        (F.col("l_shipdate") >= F.lit("1998-07-01").cast("timestamp_ntz")).cast("double").alias("post"),
        "l_discount", "l_quantity", "l_linenumber", "l_linestatus",
    )
    samples = {f"s{i}": s for i, s in enumerate(SAMPLE_SQL)}
    specs = {s: models.Spec("l_discount", "treated*post", sample=s) for s in samples}
    fits = models.estimate(frame, specs, "l_quantity", "l_linenumber", samples=samples)
    rows = coefficient_table(t.spark, fits).select("model", "term", F.round("coef", 8).alias("coef"), F.round("se", 8).alias("se"), F.round("p", 6).alias("p"))
    stats = stat_table(t.spark, fits).where(F.col("stat").isin("n", "r2_a"))
    none = F.lit(None).cast("double")
    return rows.unionByName(stats.select("model", F.col("stat").alias("term"), F.round("value", 8).alias("coef"), none.alias("se"), none.alias("p")))
