"""Energy, flows and costs: every disputed rule in both readings, and conservation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark.plans import market


def ts(text):
    return dt.datetime.fromisoformat(text)


VERSION = "schema_version int, top_timestamp string, lastchanged timestamp"
V = (1, "a", ts("2020-01-01"))


def frame(spark, rows, schema, *times):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in [*times, "lastchanged"] if c in df.columns})


@pytest.fixture
def dispatch(spark):
    """Two units over a month's end; an older version, an intervention row and a missing next value."""
    rows = []
    start = ts("2020-01-31T23:45:00")
    for i in range(6):
        rows.append(("A", start + dt.timedelta(minutes=5 * i), 1, 0, 10.0 * i, 99.0, *V))
    rows.append(("A", start, 0, 0, 1000.0, 99.0, *V))  # older run
    rows.append(("A", start, 5, 1, 1000.0, 99.0, *V))  # intervention
    rows.append(("B", ts("2020-01-31T12:05:00"), 1, 0, 60.0, 120.0, *V))
    rows.append(("S", ts("2020-01-31T12:05:00"), 1, 0, 60.0, 60.0, *V))  # retired region
    return frame(
        spark,
        rows,
        f"duid string, settlementdate timestamp, runno int, intervention int, initialmw double, totalcleared double, {VERSION}",
        "settlementdate",
    )


@pytest.fixture
def standing(spark):
    gen = frame(
        spark,
        [("g1", "GENERATOR", 30.0, 1.0, *V), ("g2", "GENERATOR", 10.0, 0.0, *V), ("g2", "GENERATOR", 10.0, 9.0, 0, "a", V[2]), ("g3", "LOAD", 5.0, 7.0, *V), ("g4", "GENERATOR", 1.0, 0.5, *V), ("g5", "GENERATOR", 1.0, None, *V)],
        f"gensetid string, gensettype string, maxcapacity double, co2e_emissions_factor double, {VERSION}",
    )
    alloc = spark.createDataFrame([("A", "g1"), ("A", "g2"), ("A", "g2"), ("A", "g3"), ("B", "g4"), ("S", "g4"), ("N", "g5"), ("N", "g4")], "duid string, gensetid string")
    detail = frame(
        spark,
        [("A", ts("2000-01-01"), ts("2020-02-01"), "NSW1", *V), ("A", ts("2020-02-01"), None, "VIC1", *V), ("B", ts("2000-01-01"), None, "QLD1", *V), ("S", ts("2000-01-01"), None, "SNOWY1", *V), ("N", ts("2000-01-01"), None, "SA1", *V)],
        f"duid string, start_date timestamp, end_date timestamp, regionid string, {VERSION}",
        "start_date",
        "end_date",
    )
    return gen, alloc, detail


def test_standing(standing):
    got = {r["duid"]: (r["regionid"], r["co2e_emissions_factor"]) for r in market.unit_standing(*standing).collect()}
    # capacity-weighted, latest version, generators only; a missing factor makes the unit's missing
    assert got == {"A": ("NSW1", 0.75), "B": ("QLD1", 0.5), "N": ("SA1", None)}


def table(df, *cols):
    return {tuple(r[c] for c in cols[:-1]): r[cols[-1]] for r in df.collect()}


@pytest.mark.parametrize("rows_per_chunk", [2, 1_000_000])
def test_regional_energy_as_documented(dispatch, standing, rows_per_chunk):
    gen, alloc, detail = standing
    out = market.regional_energy(
        dispatch, market.unit_intensity(gen, alloc), market.unit_regions(detail), per_interval=False, rows_per_chunk=rows_per_chunk
    )
    got = table(out, "regionid", "hh_end", "energy_mwh")
    # 23:45 23:50 23:55 00:00 | 00:05 00:10: midpoints 5 15 25 35 | 45 (50 + 99) / 2; by region from 1 February on
    assert got[("QLD1", ts("2020-01-31T12:30:00"))] == pytest.approx(90 / 12)
    assert got[("NSW1", ts("2020-02-01T00:00:00"))] == pytest.approx((5 + 15 + 25) / 12)
    assert got[("VIC1", ts("2020-02-01T00:00:00"))] == pytest.approx(35 / 12)
    assert got[("VIC1", ts("2020-02-01T00:30:00"))] == pytest.approx((45 + 74.5) / 12)
    assert len(got) == 4
    co2 = table(out, "regionid", "hh_end", "co2_t")
    assert co2[("NSW1", ts("2020-02-01T00:00:00"))] == pytest.approx(0.75 * 45 / 12)


def test_regional_energy_as_published(dispatch, standing):
    gen, alloc, detail = standing
    out = market.regional_energy(
        dispatch,
        market.unit_intensity(gen, alloc),
        market.unit_regions(detail),
        region_mode="first",
        bucket_side="start",
        within_month=True,
        per_interval=False,
    )
    got = table(out, "regionid", "hh_end", "energy_mwh")
    # the month's last interval ends at its plan, buckets are floored, the first region stays
    assert got[("QLD1", ts("2020-01-31T12:00:00"))] == pytest.approx(90 / 12)
    assert got[("NSW1", ts("2020-01-31T23:30:00"))] == pytest.approx((5 + 15 + (20 + 99) / 2) / 12)
    assert got[("NSW1", ts("2020-02-01T00:00:00"))] == pytest.approx((35 + 45 + 74.5) / 12)
    assert len(got) == 3


def test_gap_ends_at_the_plan(spark):
    df = frame(spark, [("A", ts("2020-01-01T00:05:00"), 12.0, 0.0), ("A", ts("2020-01-01T00:20:00"), 24.0, 0.0)], "k string, t timestamp, p double, plan double", "t")
    free = table(market.midpoint_energy(df, ["k"], "t", "p", "plan"), "t", "energy_mwh")
    tight = table(market.midpoint_energy(df, ["k"], "t", "p", "plan", max_gap_minutes=5), "t", "energy_mwh")
    assert free[(ts("2020-01-01T00:05:00"),)] == pytest.approx(18 / 12)
    assert tight[(ts("2020-01-01T00:05:00"),)] == pytest.approx(6 / 12)


def test_flow_direction(spark):
    df = spark.createDataFrame([("N", "Q", 5.0), ("N", "Q", -5.0), ("N", "Q", 0.0), ("SNOWY1", "N", 1.0)], "regionfrom string, regionto string, energy_mwh double")
    right = sorted(tuple(r) for r in market.orient_flows(df).collect())
    assert right == [("N", "Q", 0.0), ("N", "Q", 5.0), ("Q", "N", 5.0)]
    # the published reading sends a reversed flow from the destination to itself
    assert ("Q", "Q", 5.0) in [tuple(r) for r in market.orient_flows(df, sequential=True).collect()]


def test_attribution_moves_co2_and_keeps_totals(spark):
    at = ts("2020-01-01T00:30:00")
    regional = frame(spark, [("QLD1", at, 100.0, 20.0), ("NSW1", at, 100.0, 10.0)], "regionid string, hh_end timestamp, energy_mwh double, co2_t double", "hh_end")
    flows = frame(spark, [("QLD1", "NSW1", at, 50.0)], "regionfrom string, regionto string, hh_end timestamp, energy_mwh double", "hh_end")
    out = {r["regionid"]: (r["energy_mwh"], r["co2_t"]) for r in market.attribute_flows(regional, flows).collect()}
    assert out == {"QLD1": (50.0, 10.0), "NSW1": (150.0, 20.0)}


def test_attribution_totals_on_random_data(spark):
    grid = spark.range(200).select(
        F.concat(F.lit("R"), (F.col("id") % 4).cast("string")).alias("regionid"),
        F.timestamp_seconds((F.col("id") / 4).cast("int") * 1800).cast("timestamp_ntz").alias("hh_end"),
        (F.rand(1) * 100 + 1).alias("energy_mwh"),
        (F.rand(2) * 50).alias("co2_t"),
    )
    flows = spark.range(300).select(
        F.concat(F.lit("R"), (F.col("id") % 4).cast("string")).alias("regionfrom"),
        F.concat(F.lit("R"), ((F.col("id") + 1) % 4).cast("string")).alias("regionto"),
        F.timestamp_seconds((F.col("id") % 50) * 1800).cast("timestamp_ntz").alias("hh_end"),
        (F.rand(3) * 10).alias("energy_mwh"),
    )
    out = market.attribute_flows(grid, flows).agg(F.sum("co2_t"), F.sum("energy_mwh")).first()
    want = grid.agg(F.sum("co2_t"), F.sum("energy_mwh")).first()
    assert tuple(out) == pytest.approx(tuple(want))


def test_missing_reading_makes_the_total_missing(spark):
    at = ts("2020-01-01T00:30:00")
    regional = frame(spark, [("QLD1", at, 100.0, None), ("QLD1", at, 1.0, 1.0)], "regionid string, hh_end timestamp, energy_mwh double, co2_t double", "hh_end")
    none = frame(spark, [], "regionfrom string, regionto string, hh_end timestamp, energy_mwh double", "hh_end")
    row = market.attribute_flows(regional, none).first()
    assert row["co2_t"] is None and row["energy_mwh"] == 101.0


def test_interconnector_flows_average_half_hours(spark):
    metered = frame(
        spark,
        [("i", ts("2020-01-01T00:05:00"), 1, 12.0, *V), ("i", ts("2020-01-01T00:05:00"), 2, 999.0, *V), ("i", ts("2020-01-01T00:30:00"), 1, -36.0, *V)],
        f"interconnectorid string, settlementdate timestamp, runno int, meteredmwflow double, {VERSION}",
        "settlementdate",
    )
    ends = frame(spark, [("i", "N", "Q", *V)], f"interconnectorid string, regionfrom string, regionto string, {VERSION}")
    row = market.interconnector_flows(metered, ends).collect()
    assert [(r["regionfrom"], r["regionto"], r["hh_end"], r["energy_mwh"]) for r in row] == [("Q", "N", ts("2020-01-01T00:30:00"), 1.0)]
    raw = market.interconnector_flows(metered, ends, average=False)
    assert raw.count() == 2


def test_rooftop(spark):
    rows = [("QLD1", ts("2020-01-01T12:00:00"), t, q, p, *V) for t, q, p in [("SATELLITE", 1.0, 5.0), ("DAILY", 0.1, 6.0), ("DAILY", 0.2, 8.0), ("MEASUREMENT", 1.0, 7.0)]]
    rows.append(("QLDN", ts("2020-01-01T12:00:00"), "DAILY", 1.0, 1.0, *V))
    rooftop = frame(spark, rows, f"regionid string, interval_datetime timestamp, type string, qi double, power double, {VERSION}", "interval_datetime")
    out = market.rooftop_energy(rooftop)
    assert [tuple(r) for r in out.collect()] == [("QLD1", ts("2020-01-01T12:00:00"), 4.0)]
    assert market.rooftop_energy(rooftop, minutes=5).first()[2] == pytest.approx(8 / 12)
    panel = frame(spark, [("QLD1", ts("2020-01-01T12:00:00"), 10.0), ("QLD1", ts("2020-01-01T12:30:00"), 1.0)], "regionid string, hh_end timestamp, energy_mwh double", "hh_end")
    got = table(market.add_rooftop(panel, out), "hh_end", "energy_mwh_adj_rooftop_solar")
    assert got == {(ts("2020-01-01T12:00:00"),): 14.0, (ts("2020-01-01T12:30:00"),): None}


def test_renewables_belong_to_the_day_the_interval_starts(spark):
    sums = frame(
        spark,
        [("N", ts("2020-01-01T10:00:00"), 0, 10.0, None, *V), ("N", ts("2020-01-01T11:00:00"), 0, 20.0, None, *V), ("N", ts("2020-01-01T12:00:00"), 1, 900.0, 1.0, *V), ("N", ts("2020-01-01T11:00:00"), 0, 99.0, 9.0, 0, "a", V[2])],
        f"regionid string, settlementdate timestamp, intervention int, totalintermittentgeneration double, uigf double, {VERSION}",
        "settlementdate",
    )
    daily = market.renewables_daily(sums)
    assert (daily.first()["total_renewables_today_mwh"], daily.first()["total_renewables_today_mwh_uigf"]) == (360.0, None)
    panel = frame(spark, [("N", ts("2020-01-02T00:00:00")), ("N", ts("2020-01-02T00:30:00"))], "regionid string, hh_end timestamp", "hh_end")
    got = table(market.add_renewables(panel, daily), "hh_end", "total_renewables_today_mwh")
    assert got == {(ts("2020-01-02T00:00:00"),): 360.0, (ts("2020-01-02T00:30:00"),): None}


def test_settlement_intervals(spark):
    rows = [(ts(d), p, "N", 1.0, 1.0, 1, 1, "a", V[2]) for d, p in [("2021-09-30", 2), ("2021-10-01", 2)]]
    costs = market.settlement_costs(frame(spark, rows, f"settlementdate timestamp, periodid int, regionid string, energycost double, netenergy double, versionno int, {VERSION}", "settlementdate"))
    got = table(costs, "settlementdate", "interval_end")
    assert got == {(ts("2021-09-30"),): ts("2021-09-30T01:00:00"), (ts("2021-10-01"),): ts("2021-10-01T00:10:00")}


def test_zero_order_hold(spark):
    df = frame(spark, [(ts("2020-01-01T12:30:00"), 1.0)], "hh_end timestamp, v double", "hh_end")
    got = [r["settlementdate"] for r in market.five_minute_copies(df, "hh_end").orderBy("settlementdate").collect()]
    assert got == [ts("2020-01-01T12:05:00") + dt.timedelta(minutes=5 * i) for i in range(6)]
