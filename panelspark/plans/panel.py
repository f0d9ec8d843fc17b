"""Calendar, holiday, population, weather and baseline columns of the half-hour panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import units
from ..functions.aggregates import avg_strict, sum_strict
from ..functions.solar import add_sun_times
from ..functions.timeparts import (
    MARKET_ZONE,
    day_of_week,
    hour_number,
    is_midday,
    is_weekend,
    minus_minutes,
    to_local,
)
from ..operators.chunks import interpolate_linear, rolling_mean_fill
from ..operators.dedupe import union_distinct
from ..operators.frequency import rare_value_flags
from ..operators.grid import complete, time_grid
from ..operators.joins import nearest_event, sized_join
from ..operators.quality import at_most, every_row, expect
from ..session import checkpointed

# Clock of each market region.
REGION_ZONES = {
    "QLD1": "Australia/Brisbane",
    "NSW1": "Australia/Sydney",
    "VIC1": "Australia/Melbourne",
    "TAS1": "Australia/Hobart",
    "SA1": "Australia/Adelaide",
}
# Fixed value: the region that never changes its clocks.
CONTROL_REGION = "QLD1"
# First and last local day of the study.
STUDY_DAYS = ("2009-07-01", "2023-12-01")
# Capital of each region with its latitude and longitude in degrees.
REGION_CITIES = {
    "QLD1": ("Brisbane", -27.467, 153.033),
    "NSW1": ("Sydney", -33.883, 151.217),
    "VIC1": ("Melbourne", -37.783, 144.967),
    "SA1": ("Adelaide", -34.933, 138.6),
    "TAS1": ("Hobart", -42.883, 147.317),
}


def zone_of(region: str | Column, zones: dict[str, str] = REGION_ZONES) -> Column:
    """The zone name of a region column, as a literal map look-up (no join)."""
    region = F.col(region) if isinstance(region, str) else region
    pairs = F.create_map(*[F.lit(x) for pair in zones.items() for x in pair])
    return F.try_element_at(pairs, region)


# --- clock changes -----------------------------------------------------------------------


def tz_transitions(df: DataFrame, zone: str, start: Column, end: Column) -> DataFrame:
    """Clock changes of each zone in the time its rows span: (zone, date, direction start/stop).

    The offset from UTC is compared day by day, then by half-hour on the days that differ.
    Windows run over the days of one zone, which the calendar bounds.
    """
    spans = df.groupBy(zone).agg(F.min(F.to_date(start)).alias("_lo"), F.max(F.to_date(end)).alias("_hi"))
    days = time_grid(spans, F.col("_lo"), F.date_add("_hi", 1), "1 day", "_day")
    midnight = F.col("_day").cast("timestamp_ntz")

    def offset(at: Column) -> Column:
        local = F.convert_timezone(F.lit("UTC"), F.col(zone), at)
        return F.unix_seconds(local.cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))

    by_day = Window.partitionBy(zone).orderBy("_day")
    changed = days.select(zone, "_day", offset(midnight).alias("_now")).withColumn("_then", F.lead("_now").over(by_day))
    changed = changed.where(F.col("_then") != F.col("_now"))
    hours = changed.withColumn(
        "_at",
        F.explode(
            F.sequence(
                F.col("_day").cast("timestamp_ntz") + F.expr("INTERVAL '30' MINUTE"),
                F.date_add("_day", 1).cast("timestamp_ntz"),
                F.expr("INTERVAL '30' MINUTE"),
            )
        ),
    )
    moved = hours.where(offset(F.col("_at")) != F.col("_now"))
    first = moved.groupBy(zone, "_day", "_now", "_then").agg(F.min("_at").alias("_at"))
    return first.select(
        zone,
        F.to_date(F.convert_timezone(F.lit("UTC"), F.col(zone), F.col("_at"))).alias("date"),
        F.when(F.col("_then") > F.col("_now"), F.lit("start")).otherwise(F.lit("stop")).alias("direction"),
    )


def transition_calendar(transitions: DataFrame, date: str = "date", direction: str = "direction") -> DataFrame:
    """One row per day with the nearest clock change and the distance to it.

    ``days_into_dst`` counts days after a start and days before a stop, so it is negative
    outside summer time in either case.
    """
    events = transitions.select(
        F.col(date).alias("dst_date"),
        F.col(direction).alias("dst_direction"),
        F.concat_ws("-", F.year(date).cast("string"), F.col(direction)).alias("dst_transition_id"),
    )
    after = F.datediff(F.col("d"), F.col("dst_date"))
    return nearest_event(events, "dst_date", "d").select(
        "d",
        "dst_date",
        "dst_direction",
        "dst_transition_id",
        (-after).alias("days_before_transition"),
        after.alias("days_after_transition"),
        (F.col("dst_direction") == "start").alias("dst_start"),
        F.when(F.col("dst_direction") == "start", after).otherwise(-after).alias("days_into_dst"),
    )


def treatment_flags(
    panel: DataFrame, calendar: DataFrame, region: str = "regionid", control: str = CONTROL_REGION
) -> DataFrame:
    """Join the calendar by local day and add who is on summer time when."""
    dated = sized_join(panel, calendar.withColumnRenamed("d", "date_local"), ["date_local"], "left", written=True)
    after = F.col("hh_end_local") > F.col("dst_date").cast("timestamp_ntz")
    anywhere = F.when(F.col("dst_direction") == "start", after).otherwise(~after)
    here = F.col(region) != F.lit(control)
    return dated.withColumns(
        {
            "after_transition": after,
            "dst_now_anywhere": F.when(F.col("dst_direction").isNotNull(), anywhere),
            "dst_here_anytime": here,
            "dst_now_here": here & anywhere,
            "dst_transition_id_and_region": F.when(
                F.col("dst_transition_id").isNotNull(), F.concat_ws("-", "dst_transition_id", region)
            ),
        }
    )


def outlier_flags(panel: DataFrame) -> DataFrame:
    """Flag days-into-DST values that are rare or extreme."""
    return rare_value_flags(panel, "days_into_dst", "days_into_dst_outlier", "days_into_dst_extreme_outlier")


def calendar_columns(
    panel: DataFrame, hh_end: str = "hh_end", zone: Column | None = None, market_zone: str = MARKET_ZONE
) -> DataFrame:
    """Start, end, day, hour, weekday and midday of each half-hour on the local and the fixed clock.

    Local start is local end minus 30 minutes of wall time, also across a clock change.
    """
    zone = zone_of("regionid") if zone is None else zone
    ends = panel.withColumns(
        {"hh_end_fixed": F.col(hh_end), "hh_end_local": to_local(hh_end, zone, market_zone)}
    )
    starts = ends.withColumns(
        {f"hh_start_{c}": minus_minutes(f"hh_end_{c}", units.MINUTES_PER_HALF_HOUR) for c in ("fixed", "local")}
    )
    columns = {}
    for c in ("local", "fixed"):
        start, end = F.col(f"hh_start_{c}"), F.col(f"hh_end_{c}")
        weekday = day_of_week(F.to_date(start))
        columns |= {
            f"date_{c}": F.to_date(start),
            f"midday_control_{c}": is_midday(start, end),
            f"not_midday_control_{c}": ~is_midday(start, end),
            f"hr_{c}": hour_number(start),
            f"day_of_week_{c}": weekday,
            f"weekend_{c}": is_weekend(weekday),
        }
    return starts.withColumns(columns)


# --- holidays ----------------------------------------------------------------------------


def merge_holidays(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two overlapping lists, (Date, State) and (yyyymmdd Date, Jurisdiction), as (date, regionid)."""
    a = first.select(F.to_date("Date").alias("date"), F.col("State").alias("state"))
    b = second.select(
        F.to_date(F.col("Date").cast("string"), "yyyyMMdd").alias("date"), F.col("Jurisdiction").alias("state")
    )
    both = [x.select("date", F.concat(F.upper("state"), F.lit("1")).alias("regionid")) for x in (a, b)]
    return union_distinct(*both)


def holiday_flag(panel: DataFrame, holidays: DataFrame, day: str = "date_local", region: str = "regionid") -> DataFrame:
    """``public_holiday``: is the local day a holiday in the region."""
    marks = holidays.select(F.col("date").alias(day), F.col("regionid").alias(region)).distinct()
    joined = sized_join(panel, marks.withColumn("public_holiday", F.lit(True)), [day, region], "left")
    return joined.withColumn("public_holiday", F.coalesce("public_holiday", F.lit(False)))


# --- population and weather --------------------------------------------------------------


def daily_series(
    df: DataFrame,
    t: str,
    value: str,
    key: str = "regionid",
    start: str = STUDY_DAYS[0],
    end: str = STUDY_DAYS[1],
    ends: str = "hold",
) -> DataFrame:
    """Complete a sparse series to every day of the study and draw straight lines through the gaps."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = df.where(F.col(t).between(lo, hi)).select(key, t, value)
    return interpolate_linear(complete(inside, [key], t, "1 day", lo, hi), [key], t, value, ends=ends)


def filled_weather(df: DataFrame, value: str, t: str = "date_local", key: str = "regionid") -> DataFrame:
    """Close one-day gaps by the mean of the neighbours, longer ones by a straight line."""
    short = rolling_mean_fill(df, [key], [t], value)
    return interpolate_linear(short, [key], t, value, ends="null", sized_by=df)


def add_daily(panel: DataFrame, daily: DataFrame, key: str = "regionid", day: str = "date_local") -> DataFrame:
    """Left join of per-region daily values onto the half-hours of the day."""
    return sized_join(panel, daily, [key, day], "left")


# --- measures ----------------------------------------------------------------------------


def per_capita(panel: DataFrame, population: str = "population") -> DataFrame:
    """Per-person energy (kWh) and CO2 (kg), renewables in TWh; the totals are dropped."""
    heads = F.col(population)
    return panel.withColumns(
        {
            "co2_kg_per_capita": F.try_divide(F.col("co2_t"), heads) * units.KG_PER_T,
            "energy_kwh_per_capita": F.try_divide(F.col("energy_mwh"), heads) * units.KWH_PER_MWH,
            "energy_kwh_adj_rooftop_solar_per_capita": F.try_divide(F.col("energy_mwh_adj_rooftop_solar"), heads)
            * units.KWH_PER_MWH,
            "total_renewables_today_twh": F.col("total_renewables_today_mwh") / units.MWH_PER_TWH,
            "total_renewables_today_twh_uigf": F.col("total_renewables_today_mwh_uigf") / units.MWH_PER_TWH,
        }
    ).drop(
        "co2_t",
        "energy_mwh",
        "energy_mwh_adj_rooftop_solar",
        "total_renewables_today_mwh",
        "total_renewables_today_mwh_uigf",
    )


def midday_baseline(
    panel: DataFrame, measures: Sequence[str], midday: str, keys: Sequence[str] = ("regionid", "date_local")
) -> DataFrame:
    """Add ``<m>_midday``, the group's mean over its midday rows.

    Group means are a partial aggregate joined back, so the panel itself is not shuffled
    while the means are few enough to broadcast.
    """
    means = (
        panel.where(F.col(midday)).groupBy(*keys).agg(*[avg_strict(m).alias(f"{m}_midday") for m in measures])
    )
    return sized_join(panel, means, list(keys), "left", written=True)


def midday_deviations(panel: DataFrame) -> DataFrame:
    """Midday means of energy and CO2 and the deviation from them in Wh and g."""
    based = midday_baseline(panel, ["co2_kg_per_capita", "energy_kwh_per_capita"], "midday_control_local")
    return based.withColumns(
        {
            "energy_wh_per_capita_vs_midday": (
                F.col("energy_kwh_per_capita") - F.col("energy_kwh_per_capita_midday")
            )
            * units.WH_PER_KWH,
            "co2_g_per_capita_vs_midday": (F.col("co2_kg_per_capita") - F.col("co2_kg_per_capita_midday"))
            * units.G_PER_KG,
        }
    )


def daily_downsample(
    panel: DataFrame,
    keys: Sequence[str],
    sums: dict[str, tuple[str, float]],
    means: Sequence[str],
    carried: Sequence[str] = (),
    slots_per_day: int = units.HALF_HOURS_PER_DAY,
    as_published: bool = False,
) -> DataFrame:
    """One row per day: sums normalised to a day of ``slots_per_day`` intervals, and means.

    ``sums`` maps out -> (in, unit factor). A short or long day (clock change) is scaled to
    the usual length by dividing by n / slots; ``as_published`` multiplies instead. ``carried``
    columns are constant within a day and are picked, not grouped by.
    """
    length = F.count(F.lit(1)) / F.lit(float(slots_per_day))
    scale = (lambda total: total * length) if as_published else (lambda total: total / length)
    return panel.groupBy(*keys).agg(
        length.alias("day_length_scale_factor"),
        *[scale(sum_strict(c) * F.lit(factor)).alias(out) for out, (c, factor) in sums.items()],
        *[avg_strict(m).alias(m) for m in means],
        *[F.first(c).alias(c) for c in carried],
    )


def daily_panel(panel: DataFrame, as_published: bool = False) -> DataFrame:
    """The daily version of the half-hour panel."""
    kg = units.KG_PER_T if as_published else 1.0
    daily = daily_downsample(
        panel,
        ["date_local", "regionid"],
        {
            "co2_kg_per_capita": ("co2_kg_per_capita", kg),
            "energy_kwh_per_capita": ("energy_kwh_per_capita", 1.0),
            "energy_kwh_adj_rooftop_solar_per_capita": ("energy_kwh_adj_rooftop_solar_per_capita", 1.0),
            "energy_kwh_per_capita_vs_midday": ("energy_wh_per_capita_vs_midday", 1 / units.WH_PER_KWH),
            "co2_kg_per_capita_vs_midday": ("co2_g_per_capita_vs_midday", 1 / units.G_PER_KG),
        },
        [
            "energy_kwh_per_capita_midday",
            "co2_kg_per_capita_midday",
            "total_renewables_today_twh",
            "total_renewables_today_twh_uigf",
            "population",
            "temperature",
            "solar_exposure",
            "wind_km_per_h",
        ],
        [
            "dst_date",
            "dst_direction",
            "dst_start",
            "dst_transition_id",
            "dst_transition_id_and_region",
            "after_transition",
            "dst_now_anywhere",
            "dst_here_anytime",
            "dst_now_here",
            "days_before_transition",
            "days_after_transition",
            "days_into_dst",
            "days_into_dst_outlier",
            "days_into_dst_extreme_outlier",
            "public_holiday",
            "day_of_week_local",
            "weekend_local",
        ],
        as_published=as_published,
    )
    renamed = {"date_local": "date", "day_of_week_local": "day_of_week", "weekend_local": "weekend"}
    return daily.withColumnsRenamed(renamed)


# --- sun ---------------------------------------------------------------------------------


def sun_times(grid: DataFrame, day: str, lat: str, lon: str, zone: str, market_zone: str = MARKET_ZONE) -> DataFrame:
    """Sunrise and sunset of each (place, day) on the local and on the market clock."""
    timed = add_sun_times(grid, day, lat, lon)
    clocks = {}
    for event in ("sunrise", "sunset"):
        clocks[f"{event}_local"] = F.convert_timezone(F.lit("UTC"), F.col(zone), F.col(f"{event}_utc"))
        clocks[f"{event}_fixed"] = F.convert_timezone(F.lit("UTC"), F.lit(market_zone), F.col(f"{event}_utc"))
    return timed.withColumns(clocks).drop("sunrise_utc", "sunset_utc")


def panel_checks() -> dict[str, Column]:
    """What has to hold for a finished panel; rows that fail would enter the models as untreated."""
    return {
        "every row has a local date": every_row(F.col("date_local").isNotNull()),
        "every row belongs to a clock change": every_row(F.col("dst_transition_id").isNotNull()),
        "every row has a population": every_row(F.col("population").isNotNull()),
        "every row has energy": every_row(F.col("energy_kwh_per_capita").isNotNull()),
        "one row lacks wind at most": at_most(1, F.col("wind_km_per_h").isNull()),
    }


def build_panel(
    energy: DataFrame,
    transitions: DataFrame,
    holidays: DataFrame,
    population: DataFrame,
    temperature: DataFrame,
    sunshine: DataFrame,
    wind: DataFrame,
    study_days: tuple[str, str] = STUDY_DAYS,
    strict: bool = True,
) -> DataFrame:
    """The half-hour analysis panel from the joined market panel and the side inputs.

    A ``strict`` panel is written once and raises ``ExpectationError`` unless ``panel_checks``
    hold; pass False to look at their ``verdicts`` instead.

    Side inputs are daily per region, so each is small enough to broadcast. Rare days are
    judged on the whole panel, then the study's days are kept.
    """
    lo, hi = (F.lit(d).cast("date") for d in study_days)
    timed = calendar_columns(energy.drop("d")).drop("hh_end")
    flagged = treatment_flags(holiday_flag(timed, holidays), transition_calendar(transitions))
    weathered = outlier_flags(flagged).where(F.col("date_local").between(lo, hi))
    for daily in (population, temperature, sunshine, wind):
        weathered = add_daily(weathered, daily)
    panel = midday_deviations(per_capita(weathered))
    return expect(checkpointed(panel), panel_checks()) if strict else panel
