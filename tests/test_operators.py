"""Deduplication, joins, reshaping, weighted statistics and checks on small frames."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.aggregates import avg_strict, sum_strict, wmean
from panelspark.functions.names import label_code, snake_case, with_labels
from panelspark.functions.timeparts import bucket_to, is_midday, to_local
from panelspark.operators import cumulative, dedupe, frequency, grid, joins, quality, reshape, weighted


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def ts(text):
    return dt.datetime.fromisoformat(text)


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


# --- keep_latest -------------------------------------------------------------------------


def test_keep_latest_descending_and_missing_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), ("b", None, "w")], "k string, v int, s string")
    assert rows(dedupe.keep_latest(df, ["k"], ["-v"]), "k", "v", "s") == [("a", 3, "y"), ("b", None, "w")]


@pytest.mark.parametrize(
    "dtype,values",
    [
        ("int", [5, -2147483648, 7]),
        ("double", [0.5, -3.5, float("nan")]),
        ("string", ["AB", "A", "B"]),
        ("date", [dt.date(2020, 1, 2), dt.date(1950, 1, 1), dt.date(2021, 1, 1)]),
        ("boolean", [True, False, True]),
    ],
)
def test_keep_first_ascending_takes_smallest_and_missing_loses(spark, dtype, values):
    df = spark.createDataFrame([("k", v) for v in values] + [("k", None)], f"k string, v {dtype}")
    smallest = min(v for v in values if not (isinstance(v, float) and math.isnan(v)))
    assert dedupe.keep_latest(df, ["k"], ["v"]).first()["v"] == smallest


def test_keep_latest_does_not_depend_on_partitioning_and_is_idempotent(spark):
    random.seed(3)
    data = [(random.choice("ab"), random.randint(0, 3), random.randint(0, 3), i % 5) for i in range(300)]
    df = spark.createDataFrame(data, "k string, a int, b int, c int")
    once = dedupe.keep_latest(df.repartition(1), ["k"], ["a", "-b"])
    other = dedupe.keep_latest(df.repartition(7), ["k"], ["a", "-b"])
    assert rows(once, *df.columns) == rows(other, *df.columns)
    assert rows(dedupe.keep_latest(once, ["k"], ["a", "-b"]), *df.columns) == rows(once, *df.columns)


def test_keep_latest_carries_maps(spark):
    df = spark.createDataFrame([("a", 1, {"x": 1}), ("a", 2, {"x": 2})], "k string, v int, m map<string,int>")
    assert dedupe.keep_latest(df, ["k"], ["-v"]).first()["m"] == {"x": 2}


def test_keep_latest_reduces_before_the_shuffle(spark):
    """A key with most of the rows must not be shuffled whole."""
    df = spark.range(10_000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    plan = dedupe.keep_latest(df, ["k"], ["-v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


# --- aggregates --------------------------------------------------------------------------


def test_strict_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "k string, v double")
    out = df.groupBy("k").agg(sum_strict("v").alias("s"), avg_strict("v").alias("m"))
    assert rows(out, "k", "s", "m") == [("a", None, None), ("b", 6.0, 3.0)]


def test_weighted_mean_uses_the_same_rows_for_both_sums(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 100.0), (4.0, 2.0), (9.0, None)], "x double, w double")
    assert df.agg(wmean("x", "w")).first()[0] == 3.0
    assert df.agg(wmean("x", "w", strict=True)).first()[0] is None


def test_weighted_spread_formula(spark):
    rng = np.random.default_rng(1)
    x, w = rng.normal(1e6, 1, 50), rng.integers(0, 4, 50).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, w)], "x double, w double")
    out = weighted.weighted_spread(df, [], ["x"], "w").first()
    mean = np.average(x, weights=w)
    n = (w != 0).sum()
    assert out["x"] == pytest.approx(mean)
    assert out["x_sd"] == pytest.approx(math.sqrt((w * (x - mean) ** 2).sum() / ((n - 1) / n * w.sum())))


def test_cost_concentration_equals_row_by_row(spark):
    rng = np.random.default_rng(5)
    cost = rng.integers(1, 6, 400).astype(float)  # many ties
    minutes = np.where(rng.random(400) < 0.5, 5, 30)
    df = spark.createDataFrame([(float(c), int(m)) for c, m in zip(cost, minutes)], "c double, m int")
    pdf = pd.DataFrame({"c": cost, "m": minutes}).assign(r=lambda d: 60 * d.c / d.m)
    pdf = pdf.sort_values(["r", "m"], ascending=False)
    for share in (0.01, 0.1, 0.5, 1.0):
        upto = pdf[pdf.m.cumsum() / pdf.m.sum() <= share]
        for sizing in ({}, {"rows_per_chunk": 2}):
            got = cumulative.cost_concentration(df, "c", "m", share, **sizing).collect()
            assert len(got) == 1
            assert got[0]["frac_total_cost"] == pytest.approx(upto.c.sum() / pdf.c.sum())
            assert got[0]["cum_hours"] == pytest.approx(upto.m.sum() / 60)
    assert cumulative.cost_concentration(df, "c", "m", 1e-6).collect() == []


def test_rare_values(spark):
    df = spark.createDataFrame([(v,) for v in [1, 1, 1, 2, 2, 3, 4, 4]], "v int")
    out = frequency.rare_value_flags(df, "v", "rare", "extreme").distinct()
    assert rows(out, "v", "rare", "extreme") == [(1, False, True), (2, False, False), (3, True, False), (4, False, True)]


# --- joins -------------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_sized_join_is_the_same_either_way(spark, how):
    facts = spark.createDataFrame([("hot", i) for i in range(50)] + [("b", 1), ("none", 2), (None, 3)], "k string, v int")
    dim = spark.createDataFrame([("hot", 1.0), ("b", 2.0)], "k string, d double")
    small = joins.sized_join(facts, dim, ["k"], how)
    shuffled = joins.sized_join(facts, dim, ["k"], how, max_rows=0)
    plain = facts.join(dim, "k", how)
    want = rows(plain, *plain.columns)
    assert want == rows(small, *plain.columns) == rows(shuffled, *plain.columns)


def test_wide_rows_are_not_broadcast(spark):
    wide = spark.range(50).select("id", F.repeat(F.lit("x"), 10_000).alias("v"))
    assert joins.fits_broadcast(wide) and not joins.fits_broadcast(wide, max_bytes=100_000)


def test_nearest_event_keeps_records_whole(spark):
    day = "2024-01-05"
    events = spark.createDataFrame([(day, "a", 9), (day, "b", 1)], "event string, n string, v int")
    out = joins.nearest_event(events.withColumn("event", F.to_date("event")), "event").first()
    assert (out["n"], out["v"]) == ("b", 1)


@pytest.mark.parametrize("max_rows", [200_000, 0])
def test_periods_without_start_or_that_overlap(spark, max_rows):
    facts = spark.createDataFrame([("a", 5), ("a", 15), ("b", 5)], "k string, at int")
    open_start = spark.createDataFrame([("a", None, 10, 1.0), ("a", 10, 20, 2.0), ("b", 0, None, 3.0)], "k string, start_date int, end_date int, r double")
    got = joins.effective_join(facts, open_start, "k", "at", max_rows=max_rows)
    assert rows(got, "k", "at", "r") == [("a", 15, 2.0), ("b", 5, 3.0)]
    overlapping = spark.createDataFrame([("a", 0, None, 1.0), ("a", 4, 8, 2.0)], open_start.schema)
    with pytest.raises(ValueError, match="overlap"):
        joins.effective_join(facts, overlapping, "k", "at", max_rows=max_rows)


def test_not_a_number_is_missing_in_both_directions(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 2.0), ("b", float("nan"))], "k string, v double")
    assert [r["v"] for r in dedupe.keep_latest(df, ["k"], ["-v"]).where("k = 'a'").collect()] == [2.0]
    assert [r["v"] for r in dedupe.keep_latest(df, ["k"], ["v"]).where("k = 'a'").collect()] == [1.0]


def brute_nearest(days, events):
    out = {}
    for d in days:
        last = max(e for e in events if e <= d)
        nxt = min(e for e in events if e >= d)
        out[d] = nxt if nxt - d <= d - last else last
    return out


def test_nearest_event_ties_go_forward(spark):
    events = [dt.date(2020, 1, 1), dt.date(2020, 1, 5), dt.date(2020, 1, 6), dt.date(2020, 1, 13), dt.date(2020, 3, 1)]
    df = spark.createDataFrame([(e, str(e)) for e in events + events[:2]], "e date, name string")
    got = {r["d"]: r["e"] for r in joins.nearest_event(df, "e").collect()}
    days = [events[0] + dt.timedelta(i) for i in range((events[-1] - events[0]).days + 1)]
    assert got == brute_nearest(days, events)


def test_effective_join_all_routes(spark):
    facts = ntz(
        spark.createDataFrame(
            [("a", ts("2020-01-01")), ("a", ts("2020-06-01")), ("a", ts("2019-01-01")), ("b", ts("2020-06-01")), ("c", ts("2020-06-01"))],
            "k string, at timestamp",
        ),
        "at",
    )
    periods = ntz(
        spark.createDataFrame(
            [
                ("a", ts("2020-01-01"), ts("2020-06-01"), "north"),
                ("a", ts("2020-06-01"), None, "south"),
                ("b", ts("2020-01-01"), ts("2020-02-01"), "east"),
            ],
            "k string, start_date timestamp, end_date timestamp, region string",
        ),
        "start_date",
        "end_date",
    )
    want = [("a", ts("2020-01-01"), "north"), ("a", ts("2020-06-01"), "south")]
    for max_rows in (100, 0):
        got = joins.effective_join(facts, periods, "k", "at", max_rows=max_rows)
        assert rows(got, "k", "at", "region") == want
    first = joins.effective_join(facts, periods, "k", "at", mode="first")
    assert {(r["k"], r["region"]) for r in first.collect()} == {("a", "north"), ("b", "east")}


def test_effective_join_with_many_periods_of_one_key(spark):
    """More periods than are searched row by row, on chunks of a few rows."""
    days = spark.range(200).select(F.lit("k").alias("k"), F.col("id").alias("at"))
    periods = spark.range(100).select(
        F.lit("k").alias("k"), (F.col("id") * 2).alias("start_date"), (F.col("id") * 2 + 1).alias("end_date"), F.col("id").alias("p")
    )
    got = joins.effective_join(days, periods, "k", "at")
    assert rows(got, "at", "p") == sorted([(2 * i, i) for i in range(100)], key=repr)


def test_complete_and_grid(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1), ("b", dt.date(2020, 1, 3), 2)], "k string, d date, v int")
    out = grid.complete(df, ["k"], "d", "1 day")
    assert out.count() == 6
    assert out.where("v IS NOT NULL").count() == 2


# --- shape -------------------------------------------------------------------------------


def test_pivot_difference_and_envelope(spark):
    df = spark.createDataFrame([("a", True, 5.0), ("a", False, 3.0), ("b", True, 1.0)], "k string, post boolean, v double")
    assert rows(reshape.pivot_diff(df, ["k"], "post", ["v"]), "k", "v") == [("a", 2.0), ("b", None)]
    wide = spark.createDataFrame([(3.0, 5.0), (5.0, 3.0), (None, 1.0)], "v_pre double, v_post double")
    out = reshape.envelope(wide, ["v"])
    assert rows(out, "v_increased", "v_lower", "v_upper") == [(False, 3.0, 5.0), (None, None, None), (True, 3.0, 5.0)]


def test_pivot_wider_names(spark):
    df = spark.createDataFrame([("a", True, 1.0), ("a", False, 2.0)], "k string, f boolean, v double")
    one = reshape.pivot_wider(df, ["k"], "f", [True, False], {"v": F.sum("v")})
    assert one.columns == ["k", "v_true", "v_false"] and tuple(one.first()) == ("a", 1.0, 2.0)
    two = reshape.pivot_wider(df, ["k"], "f", [True, False], {"v": F.sum("v"), "n": F.count("v")})
    assert set(two.columns) == {"k", "v_true", "n_true", "v_false", "n_false"}


def test_names_and_labels(spark):
    df = spark.createDataFrame([(1, 2, 3)], "REGIONID int, `Daily max (Degree C)` int, co2T int")
    assert snake_case(df).columns == ["regionid", "daily_max_degree_c", "co2_t"]
    labelled = with_labels(spark.createDataFrame([(1,)], "a int"), {"a": "Alpha"})
    assert labelled.schema["a"].metadata["comment"] == "Alpha"
    codes = label_code(spark.createDataFrame([("b",), ("a",), ("b",)], "s string"), "s", "code")
    assert rows(codes, "s", "code") == [("a", 1), ("b", 2), ("b", 2)]


# --- time --------------------------------------------------------------------------------


def test_bucket_sides(spark):
    stamps = ["2020-01-01T12:00:00", "2020-01-01T12:05:00", "2020-01-01T12:30:00", "1969-12-31T23:50:00"]
    df = ntz(spark.createDataFrame([(ts(s),) for s in stamps], "t timestamp"), "t")
    got = df.select(bucket_to("t", 30, "start").alias("s"), bucket_to("t", 30).alias("e")).collect()
    assert [r["s"] for r in got] == [ts(s) for s in ("2020-01-01T12:00:00", "2020-01-01T12:00:00", "2020-01-01T12:30:00", "1969-12-31T23:30:00")]
    assert [r["e"] for r in got] == [ts(s) for s in ("2020-01-01T12:00:00", "2020-01-01T12:30:00", "2020-01-01T12:30:00", "1970-01-01T00:00:00")]
    assert df.select(bucket_to("t", 30).alias("e")).schema["e"].dataType == T.TimestampNTZType()


def test_local_time_over_a_clock_change(spark):
    df = ntz(spark.createDataFrame([(ts("2023-10-01T02:00:00"), z) for z in ("Australia/Sydney", "Australia/Adelaide")], "t timestamp, z string"), "t")
    got = [r[0] for r in df.select(to_local("t", F.col("z"))).collect()]
    assert got == [ts("2023-10-01T03:00:00"), ts("2023-10-01T01:30:00")]


def test_midday_half_hours(spark):
    grid_ = spark.range(48).select(F.timestamp_seconds(F.col("id") * 1800).cast("timestamp_ntz").alias("s"))
    both = grid_.withColumn("e", F.col("s") + F.expr("INTERVAL '30' MINUTE"))
    assert both.where(is_midday("s", "e")).select(F.date_format("s", "HH:mm")).toPandas().iloc[:, 0].tolist() == [
        "12:00", "12:30", "13:00", "13:30", "14:00"
    ]


# --- checks ------------------------------------------------------------------------------


def test_expectations_name_what_failed(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "v int, s string")
    checks = {"v is set": quality.every_row(F.col("v").isNotNull()), "s is set": quality.every_row(F.col("s").isNotNull())}
    with pytest.raises(quality.ExpectationError, match="^v is set$"):
        quality.expect(df, checks)
    assert quality.expect(df, {"few": quality.at_most(1, F.col("v").isNull())}) is df
    assert list(quality.no_nulls(df, "^s$")) == ["v has no NULL"]
    with pytest.raises(quality.ExpectationError):
        quality.expect(df.limit(0), {"rows": quality.not_empty()})


def test_null_rates(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert rows(weighted.null_rates(df), "column_name", "null_rate") == [("a", 0.0), ("b", 0.5)]
