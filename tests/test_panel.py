"""Calendar, weather and descriptive columns, published reference values, and the whole panel."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelspark.operators.weighted import null_rates
from panelspark.operators.quality import ExpectationError, expect
from panelspark.plans import describe, models, panel
from panelspark.stats.wls import wls

# Clock changes of Sydney, 2000 to 2024 (public record).
STARTS = """2000-08-27 2001-10-28 2002-10-27 2003-10-26 2004-10-31 2005-10-30 2006-10-29 2007-10-28 2008-10-05 2009-10-04
2010-10-03 2011-10-02 2012-10-07 2013-10-06 2014-10-05 2015-10-04 2016-10-02 2017-10-01 2018-10-07 2019-10-06
2020-10-04 2021-10-03 2022-10-02 2023-10-01 2024-10-06""".split()
STOPS = """2000-03-26 2001-03-25 2002-03-31 2003-03-30 2004-03-28 2005-03-27 2006-04-02 2007-03-25 2008-04-06 2009-04-05
2010-04-04 2011-04-03 2012-04-01 2013-04-07 2014-04-06 2015-04-05 2016-04-03 2017-04-02 2018-04-01 2019-04-07
2020-04-05 2021-04-04 2022-04-03 2023-04-02 2024-04-07""".split()


def ts(text):
    return dt.datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def transitions(spark):
    zone = spark.createDataFrame([("Australia/Sydney", dt.date(2000, 1, 1), dt.date(2024, 12, 31))], "tz string, a date, b date")
    return panel.tz_transitions(zone, "tz", F.col("a"), F.col("b")).select("date", "direction").cache()


def test_fifty_clock_changes(transitions):
    got = {(r["date"].isoformat(), r["direction"]) for r in transitions.collect()}
    assert got == {(d, "start") for d in STARTS} | {(d, "stop") for d in STOPS}


def test_zone_without_clock_changes(spark):
    zone = spark.createDataFrame([("Australia/Brisbane", dt.date(2000, 1, 1), dt.date(2024, 12, 31))], "tz string, a date, b date")
    assert panel.tz_transitions(zone, "tz", F.col("a"), F.col("b")).count() == 0


def test_calendar_around_a_stop(transitions):
    days = {r["d"]: r for r in panel.transition_calendar(transitions).where("d BETWEEN '2020-04-03' AND '2020-04-07'").collect()}
    # the day before a stop still counts one day into summer time
    assert [days[dt.date(2020, 4, d)]["days_into_dst"] for d in (3, 4, 5, 6, 7)] == [2, 1, 0, -1, -2]
    row = days[dt.date(2020, 4, 4)]
    assert (row["dst_transition_id"], row["days_before_transition"], row["days_after_transition"]) == ("2020-stop", 1, -1)


@pytest.fixture(scope="module")
def grid(spark):
    """Every half-hour of five regions over the study's local days."""
    regions = spark.createDataFrame([(r,) for r in panel.REGION_ZONES], "regionid string")
    lo, hi = (F.lit(d).cast("timestamp_ntz") for d in ("2009-06-30", "2023-12-03"))
    half_hours = regions.withColumn("hh_end", F.explode(F.sequence(lo, hi, F.expr("INTERVAL '30' MINUTE"))))
    timed = panel.calendar_columns(half_hours)
    return timed.where(F.col("date_local").between(*[F.lit(d).cast("date") for d in panel.STUDY_DAYS]))


def test_published_counts(grid, transitions):
    """Row counts of the calendar flags over the study period, as published."""
    flagged = panel.treatment_flags(grid, panel.transition_calendar(transitions))
    flags = ["dst_start", "after_transition", "dst_now_anywhere", "dst_here_anytime", "dst_now_here", "weekend_local", "not_midday_control_local"]
    row = flagged.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(f).alias(f) for f in flags],
        F.count_distinct("date_local").alias("days"),
        F.min("days_into_dst").alias("low"),
        F.max("days_into_dst").alias("high"),
    ).first()
    assert row.asDict() == {
        "rows": 1_264_072,
        "dst_start": 649_560,
        "after_transition": 629_272,
        "dst_now_anywhere": 626_280,
        "dst_here_anytime": 1_011_256,
        "dst_now_here": 501_000,
        "weekend_local": 360_952,
        "not_midday_control_local": 1_132_397,
        "days": 5_267,
        "low": -94,
        "high": 91,
    }


def test_local_start_is_wall_arithmetic(spark):
    df = spark.createDataFrame([("NSW1", ts("2023-10-01T02:00:00"))], "regionid string, hh_end timestamp")
    row = panel.calendar_columns(df.withColumn("hh_end", F.col("hh_end").cast("timestamp_ntz"))).first()
    # 02:00 market time is 03:00 on the wall; half an hour of wall time earlier never existed
    assert row["hh_end_local"] == ts("2023-10-01T03:00:00") and row["hh_start_local"] == ts("2023-10-01T02:30:00")
    assert row["hr_local"] == 2.5 and row["day_of_week_local"] == 1 and row["weekend_local"] is True


def test_holidays(spark):
    a = spark.createDataFrame([("2020-01-01", "nsw"), ("2020-01-27", "qld")], "Date string, State string")
    b = spark.createDataFrame([(20200101, "NSW"), (20210101, "vic")], "Date int, Jurisdiction string")
    merged = panel.merge_holidays(a, b)
    assert sorted((r["date"].isoformat(), r["regionid"]) for r in merged.collect()) == [("2020-01-01", "NSW1"), ("2020-01-27", "QLD1"), ("2021-01-01", "VIC1")]
    days = spark.createDataFrame([("NSW1", dt.date(2020, 1, 1)), ("QLD1", dt.date(2020, 1, 1))], "regionid string, date_local date")
    assert {r["regionid"]: r["public_holiday"] for r in panel.holiday_flag(days, merged).collect()} == {"NSW1": True, "QLD1": False}


def test_population_is_linear_between_quarters_and_flat_at_the_ends(spark):
    df = spark.createDataFrame([("NSW1", dt.date(2020, 1, 11), 100.0), ("NSW1", dt.date(2020, 1, 21), 200.0), ("NSW1", dt.date(2019, 1, 1), 1.0)], "regionid string, date date, population double")
    out = panel.daily_series(df, "date", "population", start="2020-01-01", end="2020-01-31")
    got = {r["date"].day: r["population"] for r in out.collect()}
    assert len(got) == 31 and got[1] == 100.0 and got[31] == 200.0 and got[16] == 150.0


def test_weather_gaps(spark):
    values = [None, 10.0, None, 20.0, None, None, 50.0, None]
    df = spark.createDataFrame([("N", dt.date(2020, 1, i + 1), v) for i, v in enumerate(values)], "regionid string, date_local date, v double")
    got = {r["date_local"].day: r["v"] for r in panel.filled_weather(df, "v").collect()}
    # neighbours' mean next to known values (also at the ends), straight line elsewhere
    assert [got[i] for i in range(1, 9)] == [10.0, 10.0, 15.0, 20.0, 20.0, 50.0, 50.0, 50.0]


def test_per_capita(spark):
    df = spark.createDataFrame([(2.0, 4.0, 6.0, 1e6, 2e6, 1000.0), (2.0, 4.0, None, None, None, 0.0)], "co2_t double, energy_mwh double, energy_mwh_adj_rooftop_solar double, total_renewables_today_mwh double, total_renewables_today_mwh_uigf double, population double")
    a, b = panel.per_capita(df).collect()
    assert (a["co2_kg_per_capita"], a["energy_kwh_per_capita"], a["energy_kwh_adj_rooftop_solar_per_capita"], a["total_renewables_today_twh"]) == (2.0, 4.0, 6.0, 1.0)
    assert b["co2_kg_per_capita"] is None


def test_day_length(spark):
    df = spark.createDataFrame([("N", i, 1.0) for i in range(46)], "k string, i int, v double")
    right = panel.daily_downsample(df, ["k"], {"s": ("v", 1.0)}, []).first()
    published = panel.daily_downsample(df, ["k"], {"s": ("v", 1.0)}, [], as_published=True).first()
    assert right["s"] == pytest.approx(48) and published["s"] == pytest.approx(46 * 46 / 48)


def test_sun_times_near_almanac(spark):
    """Within two minutes of published times for Sydney."""
    days = [dt.date(2023, 6, 21), dt.date(2023, 12, 22)]
    _, lat, lon = panel.REGION_CITIES["NSW1"]
    df = spark.createDataFrame([(d, lat, lon, "Australia/Sydney") for d in days], "d date, lat double, lon double, tz string")
    got = {r["d"]: r for r in panel.sun_times(df, "d", "lat", "lon", "tz").collect()}
    want = {days[0]: ("07:00", "16:54"), days[1]: ("05:41", "20:05")}
    for d, times in want.items():
        for event, clock in zip(("sunrise_local", "sunset_local"), times):
            assert abs((got[d][event] - ts(f"{d}T{clock}:00")).total_seconds()) <= 120, (d, event, got[d][event])
        assert got[d]["sunrise_local"] - got[d]["sunrise_fixed"] == dt.timedelta(hours=1 if d.month == 12 else 0)


def test_polar_night_has_no_sunrise(spark):
    df = spark.createDataFrame([(dt.date(2023, 12, 22), 80.0, 0.0, "UTC")], "d date, lat double, lon double, tz string")
    row = panel.sun_times(df, "d", "lat", "lon", "tz").first()
    assert row["sunrise_local"] is None and row["sunset_fixed"] is None


def test_sun_labels_first_match_wins(spark):
    up, down = ts("2020-01-01T06:00:00"), ts("2020-01-01T18:00:00")
    minutes = {"04:59": describe.REMAINDER, "05:00": describe.BEFORE_SUNRISE, "06:00": describe.BEFORE_SUNRISE, "06:01": describe.AFTER_SUNRISE, "07:00": describe.AFTER_SUNRISE,
               "07:01": describe.REMAINDER, "17:00": describe.BEFORE_SUNSET, "18:00": describe.AFTER_SUNSET, "19:00": describe.AFTER_SUNSET, "19:01": describe.REMAINDER}
    df = spark.createDataFrame([(m, ts(f"2020-01-01T{m}:00"), up, down) for m in minutes], "m string, at timestamp, up timestamp, down timestamp")
    got = {r["m"]: r["l"] for r in df.select("m", describe.sun_label(F.col("at"), F.col("up"), F.col("down")).alias("l")).collect()}
    assert got == minutes


# Published cell means of CO2 per person, by (not midday, control region, summer time).
CELLS = {
    (0, 1, 1): 0.6100947924362032,
    (0, 1, 0): 0.5515983357298271,
    (0, 0, 1): 0.4420651689268902,
    (0, 0, 0): 0.4286955563851767,
    (1, 1, 1): 0.599130595998301,
    (1, 1, 0): 0.5788130653127077,
    (1, 0, 1): 0.4331396171298314,
    (1, 0, 0): 0.4443788598720925,
}
# Published coefficients of the triple difference without controls.
COEFS = {
    "_cons": 0.5515983,
    "t": -0.1229028,
    "p": 0.0584965,
    "t#p": -0.0451268,
    "m": 0.0272147,
    "t#m": -0.0115314,
    "p#m": -0.0381789,
    "t#p#m": 0.0135701,
}


def test_published_triple_difference(spark):
    rows = [(1 - c, p, m, v, 2.0 + i) for i, ((m, c, p), v) in enumerate(CELLS.items())]
    df = spark.createDataFrame(rows * 2, "t int, p int, m int, y double, w double")
    fit = wls(df, "y", "t*p*m", "w")
    got = dict(zip(fit.names, fit.coef))
    assert {k: round(v, 7) for k, v in got.items()} == pytest.approx(COEFS, abs=2e-7)


def test_whole_panel_and_every_model(spark, transitions):
    """All stages on a year of made-up energy: panel, tables and every published specification."""
    regions = spark.createDataFrame([(r, float(i + 1)) for i, r in enumerate(panel.REGION_ZONES)], "regionid string, size double")
    lo, hi = (F.lit(d).cast("timestamp_ntz") for d in ("2018-08-31", "2019-05-03"))
    energy = regions.withColumn("hh_end", F.explode(F.sequence(lo, hi, F.expr("INTERVAL '30' MINUTE"))))
    noise = (F.xxhash64("regionid", "hh_end") % 1000) / 1000
    energy = energy.select(
        "regionid",
        "hh_end",
        F.to_date("hh_end").alias("d"),
        ((F.lit(2) + noise) * F.col("size")).alias("energy_mwh"),
        ((F.lit(1.5) + noise) * F.col("size")).alias("co2_t"),
        noise.alias("rooftop_solar_energy_mwh"),
        ((F.lit(2) + 2 * noise) * F.col("size")).alias("energy_mwh_adj_rooftop_solar"),
        F.lit(10.0).alias("total_renewables_today_mwh"),
        F.lit(12.0).alias("total_renewables_today_mwh_uigf"),
    )
    days = regions.withColumn("date_local", F.explode(F.sequence(F.lit("2018-08-01").cast("date"), F.lit("2019-06-01").cast("date"))))
    wobble = F.pmod(F.xxhash64("regionid", "date_local"), F.lit(100)) / 10.0

    def daily(name, value):
        return days.select("regionid", "date_local", value.alias(name))

    holidays = spark.createDataFrame([(dt.date(2019, 1, 1), r) for r in panel.REGION_ZONES], "date date, regionid string")
    study = ("2018-09-01", "2019-05-01")
    out = panel.build_panel(
        energy,
        transitions,
        holidays,
        daily("population", F.col("size") * 1000),
        daily("temperature", wobble + 15),
        daily("solar_exposure", F.pmod(wobble * 7, F.lit(9.0))),
        daily("wind_km_per_h", F.pmod(wobble * 13, F.lit(31.0))),
        study,
    ).cache()
    assert out.count() == 5 * 48 * 243
    # rows without a clock change stop the build
    with pytest.raises(ExpectationError, match="clock change"):
        expect(out.withColumn("dst_transition_id", F.lit(None).cast("string")), panel.panel_checks())
    assert null_rates(out).where("null_rate > 0").collect() == []
    assert panel.daily_panel(out).count() == 5 * 243
    assert describe.panel_cell_means(out).count() == 16
    assert describe.panel_intraday_difference(out).count() == 48
    profiles = describe.panel_profiles(out)
    assert profiles.where("grouping = 'group'").select("member").distinct().count() == 2
    frame = models.model_frame(out).cache()
    assert frame.schema["wind_3"].metadata["comment"].startswith("Wind")
    chosen = ["co2_base", "energy_did", "co2_ddd", "ln_co2_ddd", "co2_ddd_base", "co2_midday_event", "co2_midday_event_start", "energy_midday_event_without_tas"]
    fits = models.estimate(frame, {k: models.SPECS[k] for k in chosen})
    assert fits["co2_base"].stats["n"] == out.count()
    cells = {(r["dst_here_anytime"], r["dst_now_anywhere"]): r["m"] for r in out.groupBy("dst_here_anytime", "dst_now_anywhere").agg((F.sum(F.col("co2_kg_per_capita") * F.col("population")) / F.sum("population")).alias("m")).collect()}
    effect = cells[True, True] - cells[True, False] - cells[False, True] + cells[False, False]
    assert fits["co2_base"].coef[2] == pytest.approx(effect, abs=1e-9)
    event = fits["co2_midday_event"]
    assert "lead1" not in event.names and "lead2" in event.names and event.stats["clusters"] == 5
    assert (event.stats["leads_df1"], event.stats["leads_df2"]) == (4, 4)
    assert fits["energy_midday_event_without_tas"].stats["clusters"] == 4
    short = frame.where(models.SAMPLES["short"])
    assert {r[0] for r in short.select("dst_transition_id").distinct().collect()} == {"2019-stop"}
    assert all(math.isfinite(v) for v in fits["co2_ddd"].coef)
