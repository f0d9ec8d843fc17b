"""Descriptive tables of the half-hour panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units
from ..functions.aggregates import wmean, wmean_ratio
from ..functions.timeparts import minus_minutes
from ..operators.joins import sized_join
from ..operators.reshape import envelope, pivot_diff, pivot_longer, pivot_wider
from ..operators.weighted import weighted_spread
from .panel import CONTROL_REGION

# Names of the parts of the day around sunrise and sunset.
BEFORE_SUNRISE = "the hour before sunrise"
AFTER_SUNRISE = "the hour after sunrise"
AFTER_SUNSET = "the hour after sunset"
BEFORE_SUNSET = "the hour before sunset"
REMAINDER = "remainder of day"


def sun_label(at: Column, sunrise: Column, sunset: Column, minutes: int = 60) -> Column:
    """Part of the day of an instant; an instant near both is called by sunrise first."""
    span = F.expr(f"INTERVAL '{minutes}' MINUTE")
    return (
        F.when(at.between(sunrise - span, sunrise), F.lit(BEFORE_SUNRISE))
        .when(at.between(sunrise - span, sunrise + span), F.lit(AFTER_SUNRISE))
        .when(at.between(sunset, sunset + span), F.lit(AFTER_SUNSET))
        .when(at.between(sunset - span, sunset + span), F.lit(BEFORE_SUNSET))
        .otherwise(F.lit(REMAINDER))
    )


def add_sun_label(panel: DataFrame, sun: DataFrame) -> DataFrame:
    """Label each half-hour by its midpoint, given sun times per (regionid, date_fixed)."""
    joined = sized_join(panel, sun.select("regionid", "date_fixed", "sunrise_fixed", "sunset_fixed"),
                        ["regionid", "date_fixed"], "left")
    middle = minus_minutes("hh_end_fixed", units.MINUTES_PER_HALF_HOUR // 2)
    return joined.withColumn("label", sun_label(middle, F.col("sunrise_fixed"), F.col("sunset_fixed")))


def sun_position_table(
    labelled: DataFrame,
    energy: str = "energy_kwh_per_capita",
    co2: str = "co2_kg_per_capita",
    w: str = "population",
) -> DataFrame:
    """Weighted energy (Wh), CO2 (g) and CO2 intensity (g/kWh) per half-hour, by part of the day."""
    return labelled.groupBy("label").agg(
        (wmean(energy, w) * units.WH_PER_KWH).alias("wh_per_half_hour"),
        (wmean(co2, w) * units.G_PER_KG).alias("g_per_half_hour"),
        (wmean_ratio(co2, energy, w) * units.G_PER_KG).alias("co2_intensity"),
    )


def cell_means(
    df: DataFrame, flags: Sequence[str], value: str, w: str, mean_name: str = "co2", sd_name: str = "co2_se"
) -> DataFrame:
    """Weighted mean and sample deviation of every combination of flags, in long form."""
    cells = weighted_spread(df, flags, [value], w)
    named = cells.select(*flags, F.col(value).alias(mean_name), F.col(f"{value}_sd").alias(sd_name))
    return pivot_longer(named, flags, [mean_name, sd_name])


def intraday_difference(
    df: DataFrame,
    hour: str,
    not_midday: str,
    treated: str,
    post: str,
    measures: dict[str, str],
    w: str,
    centre: str | None = None,
) -> DataFrame:
    """Per hour of day: (post - pre) of the treated minus (post - pre) of the others.

    ``measures`` maps out -> in. ``centre`` names an output from which its mean over the
    midday hours is subtracted.
    """
    cells = df.groupBy(hour, not_midday, treated, post).agg(*[wmean(c, w).alias(out) for out, c in measures.items()])
    outs = list(measures)
    by_group = pivot_diff(cells, [hour, not_midday, treated], post, outs)
    diff = pivot_diff(by_group, [hour, not_midday], treated, outs)
    if centre is None:
        return diff
    typical = diff.where(~F.col(not_midday)).agg(F.avg(centre)).first()[0]
    return diff.withColumn(centre, F.col(centre) - F.lit(typical).cast("double"))


def intraday_profiles(
    df: DataFrame,
    clocks: dict[str, str],
    groupings: dict[str, str | Column],
    post: str,
    measures: Sequence[str],
    w: str,
) -> DataFrame:
    """Average day before and after the change, per clock and per way of grouping, in one pass.

    Every row counts once per (clock, grouping); the copies are reduced before the shuffle.
    Result: clock, grouping, member, hr, and per measure pre, post, increased, lower, upper.
    """
    views = F.array(
        *[
            F.struct(
                F.lit(clock).alias("clock"),
                F.lit(grouping).alias("grouping"),
                (F.col(g) if isinstance(g, str) else g).cast("string").alias("member"),
                F.col(hr).alias("hr"),
            )
            for clock, hr in clocks.items()
            for grouping, g in groupings.items()
        ]
    )
    ids = ["clock", "grouping", "member", "hr"]
    long = df.select(F.explode(views).alias("v"), F.when(F.col(post), "post").otherwise("pre").alias("period"), w, *measures)
    wide = pivot_wider(
        long.select("v.*", "period", w, *measures),
        ids,
        "period",
        ["pre", "post"],
        {m: wmean(m, w) for m in measures},
    )
    return envelope(wide, measures)


def panel_profiles(panel: DataFrame, days: int = 28) -> DataFrame:
    """The intraday profiles of the half-hour panel, for days nearer than ``days`` to a change."""
    near = panel.where(F.abs("days_into_dst") < days)
    group = F.when(F.col("dst_here_anytime"), "treatment").otherwise("control")
    return intraday_profiles(
        near,
        {"hr_local": "hr_local", "hr_fixed": "hr_fixed"},
        {"group": group, "regionid": "regionid"},
        "dst_now_anywhere",
        [
            "co2_kg_per_capita",
            "co2_g_per_capita_vs_midday",
            "energy_kwh_per_capita",
            "energy_wh_per_capita_vs_midday",
        ],
        "population",
    )


def panel_cell_means(panel: DataFrame, inverted_label: bool = True) -> DataFrame:
    """Eight cells of the triple difference.

    In published tables ``treated`` marks the control region; ``inverted_label`` keeps that.
    """
    is_control = F.col("regionid") == CONTROL_REGION
    flagged = panel.withColumn("treated", is_control if inverted_label else ~is_control)
    return cell_means(
        flagged, ["not_midday_control_local", "treated", "dst_now_anywhere"], "co2_kg_per_capita", "population"
    )


def panel_intraday_difference(panel: DataFrame, inverted_label: bool = True) -> DataFrame:
    is_control = F.col("regionid") == CONTROL_REGION
    flagged = panel.withColumn("_treated", is_control if inverted_label else ~is_control)
    return intraday_difference(
        flagged,
        "hr_fixed",
        "not_midday_control_fixed",
        "_treated",
        "dst_now_anywhere",
        {"co2": "co2_kg_per_capita", "energy": "energy_wh_per_capita_vs_midday"},
        "population",
        centre="co2",
    )
