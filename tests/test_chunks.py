"""Chunked windows must equal plain windows, whatever the chunk size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import chunks


def hot_frame():
    """One key holds most rows, times cluster, and values are missing in runs."""
    rng = np.random.default_rng(7)
    n = 600
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", None], n))
    t = np.concatenate([rng.integers(0, 50, n // 2), rng.integers(0, 100_000, n - n // 2)])
    pdf = pd.DataFrame({"k": key, "t": t.astype("int64"), "i": np.arange(n)})
    pdf = pdf.drop_duplicates(["k", "t"]).reset_index(drop=True)
    v = rng.integers(0, 100, len(pdf)).astype(float)
    pdf["v"] = np.where(rng.random(len(pdf)) < 0.5, np.nan, v)
    return pdf


def frame(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))



OPS = {
    "next": (lambda d, **s: chunks.next_value(d, ["k"], ["t"], {"o": "v", "o2": "t"}, **s), ["o", "o2"]),
    "previous": (lambda d, **s: chunks.previous_value(d, ["k"], ["t"], {"o": "v", "o2": "t"}, **s), ["o", "o2"]),
    "forward": (lambda d, **s: chunks.carry_forward(d, ["k"], ["t"], ["v", "t"], **s), ["v_last", "t_last"]),
    "backward": (lambda d, **s: chunks.carry_backward(d, ["k"], ["t"], ["v", "t"], **s), ["v_next", "t_next"]),
    "line_hold": (lambda d, **s: chunks.interpolate_linear(d, ["k"], "t", "v", "o", **s), ["o"]),
    "line_null": (lambda d, **s: chunks.interpolate_linear(d, ["k"], "t", "v", "o", ends="null", **s), ["o"]),
    "rolling": (lambda d, **s: chunks.rolling_mean_fill(d, ["k"], ["t"], "v", "o", **s), ["o"]),
    "sum": (lambda d, **s: chunks.running_sum(d, ["k"], ["t"], {"o": "v"}, **s), ["o"]),
    "global_sum": (lambda d, **s: chunks.running_sum(d, [], ["t", "i"], {"o": "v"}, **s), ["o"]),
    "number": (lambda d, **s: chunks.number_rows(d, ["k"], ["t"], "o", **s), ["o"]),
}


def brute(name, pdf):
    """The same answers from pandas, key by key."""
    rows = {}
    by = pdf["k"].astype(object).where(pdf["k"].notna(), "(none)").astype(str)
    groups = [(None, pdf)] if name == "global_sum" else [(k, pdf[by == k]) for k in by.unique()]
    for group, g in groups:
        g = g.sort_values(["t", "i"])
        v, t = g["v"], g["t"].astype(float)
        if name == "next":
            out = pd.DataFrame({"o": v.shift(-1), "o2": t.shift(-1)})
        elif name == "previous":
            out = pd.DataFrame({"o": v.shift(1), "o2": t.shift(1)})
        elif name == "forward":
            out = pd.DataFrame({"v_last": v.ffill(), "t_last": t.where(v.notna()).ffill()})
        elif name == "backward":
            out = pd.DataFrame({"v_next": v.bfill(), "t_next": t.where(v.notna()).bfill()})
        elif name.startswith("line"):
            known = v.notna()
            line = np.interp(t, t[known], v[known]) if known.any() else np.full(len(v), np.nan)
            if name == "line_null" and known.any():
                line = np.where((t < t[known].min()) | (t > t[known].max()), np.nan, line)
            out = pd.DataFrame({"o": line}, index=g.index)
        elif name == "rolling":
            out = pd.DataFrame({"o": v.fillna(v.rolling(3, center=True, min_periods=1).mean())})
        elif name.endswith("sum"):
            total = v.fillna(0).cumsum()
            out = pd.DataFrame({"o": total.where(v.notna().cumsum() > 0)})
        else:
            out = pd.DataFrame({"o": np.arange(1, len(g) + 1)}, index=g.index)
        out["i"] = g["i"]
        rows[group] = out
    return pd.concat(rows.values()).sort_values("i").set_index("i")


@pytest.mark.parametrize("rows_per_chunk", [5, 40, 1_000_000])
@pytest.mark.parametrize("name", list(OPS))
def test_any_chunk_size_equals_pandas(spark, name, rows_per_chunk):
    pdf = hot_frame()
    op, out = OPS[name]
    got = op(frame(spark, pdf), rows_per_chunk=rows_per_chunk)
    got = got.select("i", *out).toPandas().sort_values("i").set_index("i")
    want = brute(name, pdf)
    assert len(got) == len(pdf)
    for c in out:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, err_msg=c)


def test_hot_key_is_split(spark):
    """No (key, chunk) holds much more than the bound, although one key holds most rows."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        # half of the rows crowd into one hundredth of the time span
        F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") * 100).alias("t"),
    )
    cuts = chunks.plan_cuts(df, ["t"], rows_per_chunk=500)
    sizes = cuts.numbered(chunks.with_tie(df), "c").groupBy("k", "c").count()
    assert sizes.agg(F.max("count")).first()[0] <= 600


def test_short_table_takes_plain_window(spark):
    assert chunks.plan_cuts(spark.range(10), ["id"]) is None


def test_one_outlier_does_not_crowd_a_chunk(spark):
    df = spark.range(20_000).select(F.when(F.col("id") == 0, F.lit(1e15)).otherwise(F.col("id") / 1000).alias("t"))
    cuts = chunks.plan_cuts(df, ["t"], rows_per_chunk=500)
    sizes = cuts.numbered(chunks.with_tie(df), "c").groupBy("c").count()
    assert sizes.agg(F.max("count")).first()[0] <= 600


@pytest.mark.parametrize("rows_per_chunk", [5, 1_000_000])
def test_text_orders_chunks_too(spark, rows_per_chunk):
    words = sorted({f"{c}{i % 37}é{i}" for i, c in enumerate("zebra quick lazy ñandú" * 10)} | {"", "a" * 20, "a" * 21})
    df = spark.createDataFrame([(w,) for w in words], "w string").withColumn("one", F.lit(1))
    got = chunks.number_rows(df, [], ["w"], "n", rows_per_chunk=rows_per_chunk).collect()
    assert [r["w"] for r in sorted(got, key=lambda r: r["n"])] == sorted(words, key=lambda w: w.encode())


@pytest.mark.parametrize("rows_per_chunk", [5, 1_000_000])
def test_an_order_that_cannot_be_cut_is_refused_at_any_size(spark, rows_per_chunk):
    df = spark.range(10).select("id", F.array("id").alias("a"))
    with pytest.raises(TypeError, match="must be a number"):
        chunks.number_rows(df, [], ["a"], "n", rows_per_chunk=rows_per_chunk)


def crowded(share_null, share_tied, n=6000):
    rng = np.random.default_rng(9)
    draw = rng.random(n)
    t = np.where(draw < share_null, np.nan, np.where(draw < share_null + share_tied, 500.0, rng.integers(0, 1000, n)))
    pdf = pd.DataFrame({"k": rng.choice(["hot", "a"], n, p=[0.95, 0.05]), "t": t, "i": np.arange(n)})
    pdf["v"] = np.where(rng.random(n) < 0.5, np.nan, rng.integers(0, 100, n).astype(float))
    return pdf


@pytest.mark.parametrize("null,tied,order", [(0.9, 0.0, ["t"]), (0.0, 0.9, ["t", "i"]), (0.5, 0.4, ["t"])])
def test_nulls_and_ties_are_cut_like_all_others(spark, null, tied, order):
    df = spark.createDataFrame(crowded(null, tied)).withColumn("t", F.when(~F.isnan("t"), F.col("t")))
    cuts = chunks.plan_cuts(df, order, rows_per_chunk=300)
    sizes = cuts.numbered(chunks.with_tie(df), "c").groupBy("c").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert sizes[0] <= 600 and sizes[1] < 100


@pytest.mark.parametrize("null,tied,keys", [(0.9, 0.0, ["k"]), (0.0, 0.9, [])])
def test_crowded_orders_equal_pandas(spark, null, tied, keys):
    pdf = crowded(null, tied, 3000)
    df = spark.createDataFrame(pdf).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("t", "v")})
    order, sizing = ["t", "i"], {"rows_per_chunk": 200}
    done = {
        "nx": chunks.next_value(df, keys, order, {"nx": "i"}, **sizing),
        "pv": chunks.previous_value(df, keys, order, {"pv": "i"}, **sizing),
        "sum": chunks.running_sum(df, keys, order, {"sum": "i"}, **sizing),
        "v_last": chunks.carry_forward(df, keys, order, ["v"], **sizing),
        "v_next": chunks.carry_backward(df, keys, order, ["v"], **sizing),
        "mean": chunks.rolling_mean_fill(df, keys, order, "v", "mean", **sizing),
        "n": chunks.number_rows(df, keys, order, "n", **sizing),
    }
    parts = []
    for _, g in pdf.groupby("k") if keys else [(None, pdf)]:
        g = g.sort_values(order, na_position="first")
        mean = g.v.fillna(pd.concat([g.v.shift(1), g.v.shift(-1)], axis=1).mean(axis=1))
        parts.append(pd.DataFrame({"nx": g.i.shift(-1), "pv": g.i.shift(1), "sum": g.i.cumsum(), "v_last": g.v.ffill(), "v_next": g.v.bfill(), "mean": mean,
                                   "n": np.arange(1, len(g) + 1), "i": g.i}))
    want = pd.concat(parts).set_index("i").sort_index()
    for c, out in done.items():
        got = out.select("i", c).toPandas().set_index("i").sort_index()
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), err_msg=c)


def test_many_short_keys_need_no_borders(spark):
    """A long table of short keys takes the plain window; of one long key and short ones only the long one is cut."""
    short = spark.range(20_000).select((F.col("id") % 5000).alias("k"), F.col("id").alias("t"))
    assert chunks.plan_cuts(short, ["t"], rows_per_chunk=500, keys=["k"]) is None
    both = short.unionByName(spark.range(4_000).select(F.lit(-1).cast("bigint").alias("k"), F.col("id").alias("t")))
    cuts = chunks.plan_cuts(both, ["t"], rows_per_chunk=500, keys=["k"])
    numbered = cuts.numbered(chunks.with_tie(both))
    assert {r["k"] for r in cuts.of_cut_keys(both).select("k").distinct().collect()} == {-1}
    assert numbered.groupBy("k", "_chunk").count().agg(F.max("count")).first()[0] <= 600
