"""From unit power readings to energy and CO2 per region and half-hour.

Column names are those of the market tables in any letter case.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units
from ..functions.aggregates import sum_strict, wmean
from ..functions.timeparts import bucket_to, micros, minus_minutes, plus_minutes
from ..operators.chunks import next_value
from ..operators.dedupe import keep_latest
from ..operators.joins import effective_join, sized_join

# Columns that tell a newer copy of a row from an older one, newest first.
VERSION_ORDER = ("-schema_version", "-top_timestamp", "-lastchanged")
# Fixed value: a region that was merged into its neighbour and is left out everywhere.
RETIRED_REGIONS = ("SNOWY1",)


def unit_intensity(genunits: DataFrame, dualloc: DataFrame, order: Sequence[str] = VERSION_ORDER) -> DataFrame:
    """CO2 per MWh of each dispatch unit: capacity-weighted over its generating sets."""
    sets = keep_latest(
        genunits.where(F.col("gensettype") == "GENERATOR").select(
            "gensetid", "maxcapacity", "co2e_emissions_factor", *[c.lstrip("-") for c in order]
        ),
        ["gensetid"],
        order,
    )
    owners = dualloc.select("duid", "gensetid").distinct()
    return (
        sized_join(owners, sets, ["gensetid"])
        .groupBy("duid")
        .agg(wmean("co2e_emissions_factor", "maxcapacity", strict=True).alias("co2e_emissions_factor"))
    )


def unit_regions(
    dudetail: DataFrame, order: Sequence[str] = VERSION_ORDER, exclude: Sequence[str] = RETIRED_REGIONS
) -> DataFrame:
    """Latest version of every unit's region periods (duid, start_date, end_date, regionid)."""
    kept = dudetail.where(~F.col("regionid").isin(*exclude))
    cols = ["duid", "start_date", "end_date", "regionid", *[c.lstrip("-") for c in order]]
    return keep_latest(kept.select(*cols), ["duid", "start_date"], order).select(*cols[:4])


def unit_standing(genunits: DataFrame, dualloc: DataFrame, dudetail: DataFrame) -> DataFrame:
    """(duid, regionid, factor), the region being that of the unit's earliest period."""
    first = keep_latest(unit_regions(dudetail), ["duid"], ["start_date"]).select("duid", "regionid")
    return sized_join(unit_intensity(genunits, dualloc), first, ["duid"])


def midpoint_energy(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    power: str,
    planned: str | Column,
    minutes: int = units.DISPATCH_MINUTES,
    out: str = "energy_mwh",
    max_gap_minutes: int | None = None,
    within_month: bool = False,
    **sizing,
) -> DataFrame:
    """Energy of each interval from the power at its start and at the start of the next one.

    The last interval of a key ends at the planned power instead; so does an interval whose
    successor is more than ``max_gap_minutes`` later, or lies in another month if
    ``within_month`` is set.
    """
    nxt = next_value(df, keys, [ts], {"_next_power": power, "_next_ts": ts}, **sizing)
    usable = F.lit(True)
    if max_gap_minutes is not None:
        usable = usable & (micros("_next_ts") - micros(ts) <= max_gap_minutes * 60_000_000)
    if within_month:
        usable = usable & (F.trunc("_next_ts", "month") == F.trunc(ts, "month"))
    planned = F.col(planned) if isinstance(planned, str) else planned
    final = F.coalesce(F.when(usable, F.col("_next_power")), planned)
    energy = (F.col(power) + final) / 2 * (minutes / units.MINUTES_PER_HOUR)
    return nxt.withColumn(out, energy).drop("_next_power", "_next_ts")


def regional_energy(
    dispatch: DataFrame,
    intensity: DataFrame,
    regions: DataFrame,
    region_mode: str = "range",
    bucket_side: str = "end",
    per_interval: bool = True,
    within_month: bool = False,
    max_gap_minutes: int | None = None,
    **sizing,
) -> DataFrame:
    """Energy and CO2 per region and half-hour (and 5-minute interval if ``per_interval``).

    One plan over the whole history: newest version of each reading, energy by the midpoint
    rule, then a partial aggregate. Units with no region or no intensity are left out.
    """
    needed = ["duid", "settlementdate", "initialmw", "totalcleared", "runno"]
    readings = dispatch.where(F.col("intervention") == 0)
    versions = [c.lstrip("-") for c in VERSION_ORDER]
    latest = keep_latest(
        readings.select(*needed, *versions), ["duid", "settlementdate"], ["-runno", *VERSION_ORDER]
    ).select("duid", "settlementdate", "initialmw", "totalcleared")
    placed = effective_join(
        sized_join(latest, intensity, ["duid"]), regions, "duid", "settlementdate", mode=region_mode
    )
    energy = midpoint_energy(
        placed,
        ["duid"],
        "settlementdate",
        "initialmw",
        "totalcleared",
        within_month=within_month,
        max_gap_minutes=max_gap_minutes,
        **{"sized_by": readings, **sizing},
    )
    keys = ["regionid", "hh_end", *(["settlementdate"] if per_interval else [])]
    return (
        energy.withColumn("hh_end", bucket_to("settlementdate", units.MINUTES_PER_HALF_HOUR, bucket_side))
        .groupBy(*keys)
        .agg(
            F.sum("energy_mwh").alias("energy_mwh"),
            F.sum(F.col("energy_mwh") * F.col("co2e_emissions_factor")).alias("co2_t"),
        )
    )


def orient_flows(
    flows: DataFrame,
    frm: str = "regionfrom",
    to: str = "regionto",
    value: str = "energy_mwh",
    exclude: Sequence[str] = RETIRED_REGIONS,
    sequential: bool = False,
) -> DataFrame:
    """Make every flow non-negative by swapping its ends where it is negative.

    ``sequential`` instead overwrites the first end before the second reads it, so that both
    ends of a reversed flow become the old destination; kept to reproduce published figures.
    """
    kept = flows.where(~F.col(frm).isin(*exclude) & ~F.col(to).isin(*exclude)) if exclude else flows
    reverse = F.col(value) < 0
    start = F.when(reverse, F.col(to)).otherwise(F.col(frm))
    end = F.col(to) if sequential else F.when(reverse, F.col(frm)).otherwise(F.col(to))
    return kept.withColumns({frm: start, to: end, value: F.abs(F.col(value))})


def interconnector_flows(
    tradinginterconnect: DataFrame,
    interconnector: DataFrame,
    minutes: int = units.DISPATCH_MINUTES,
    average: bool = True,
    sequential: bool = False,
) -> DataFrame:
    """Oriented energy per 5 minutes between two regions (regionfrom, regionto, hh_end, energy_mwh).

    With ``average`` the metered power is first averaged to half-hours, so that one row stands
    for each half-hour whatever the metering interval; otherwise rows keep their own time.
    """
    power = keep_latest(tradinginterconnect, ["interconnectorid", "settlementdate"], ["runno", *VERSION_ORDER])
    ends = keep_latest(interconnector, ["interconnectorid"], VERSION_ORDER).select(
        "interconnectorid", "regionfrom", "regionto"
    )
    if average:
        power = (
            power.withColumn("hh_end", bucket_to("settlementdate", units.MINUTES_PER_HALF_HOUR))
            .groupBy("interconnectorid", "hh_end")
            .agg(F.avg("meteredmwflow").alias("meteredmwflow"))
        )
    else:
        power = power.withColumn("hh_end", F.col("settlementdate"))
    energy = F.col("meteredmwflow") * (minutes / units.MINUTES_PER_HOUR)
    joined = sized_join(power, ends, ["interconnectorid"], "left").withColumn("energy_mwh", energy)
    return orient_flows(joined, sequential=sequential).select("regionfrom", "regionto", "hh_end", "energy_mwh")


def attribute_flows(
    regional: DataFrame,
    flows: DataFrame,
    region: str = "regionid",
    at: str = "hh_end",
    energy: str = "energy_mwh",
    co2: str = "co2_t",
    frm: str = "regionfrom",
    to: str = "regionto",
) -> DataFrame:
    """Move the CO2 of exported energy to the region that used it.

    A flow carries the CO2 intensity its source region has at that time. Both sides of every
    flow come out of one joined row, so the join runs once; the total over regions is unchanged.
    A missing value anywhere makes its region's total missing.
    """
    source = regional.select(
        F.col(region).alias(frm), F.col(at), F.col(energy).alias("_src_energy"), F.col(co2).alias("_src_co2")
    )
    moved = flows.select(frm, to, at, F.col(energy).alias("_moved")).join(source, [frm, at])
    carried = F.col("_moved") * F.try_divide(F.col("_src_co2"), F.col("_src_energy"))
    sides = F.array(
        F.struct(F.col(frm).alias(region), (-F.col("_moved")).alias(energy), (-carried).alias(co2)),
        F.struct(F.col(to).alias(region), F.col("_moved").alias(energy), carried.alias(co2)),
    )
    exchanged = moved.select(at, F.explode(sides).alias("s")).select(at, "s.*")
    local = regional.select(at, region, energy, co2)
    return (
        exchanged.unionByName(local)
        .groupBy(region, at)
        .agg(sum_strict(co2).alias(co2), sum_strict(energy).alias(energy))
    )


def rooftop_energy(rooftop: DataFrame, minutes: int = units.MINUTES_PER_HALF_HOUR) -> DataFrame:
    """(regionid, hh_end, rooftop_solar_energy_mwh) from half-hourly power, whole regions only."""
    order = ["type", "-qi", *VERSION_ORDER]
    whole = rooftop.where(F.col("regionid").endswith("1"))
    latest = keep_latest(whole, ["regionid", "interval_datetime"], order)
    return latest.select(
        "regionid",
        F.col("interval_datetime").alias("hh_end"),
        (F.col("power") * (minutes / units.MINUTES_PER_HOUR)).alias("rooftop_solar_energy_mwh"),
    )


def add_rooftop(panel: DataFrame, rooftop: DataFrame) -> DataFrame:
    """Left join of the rooftop energy and the energy including it."""
    joined = panel.join(rooftop, ["regionid", "hh_end"], "left")
    total = F.col("energy_mwh") + F.col("rooftop_solar_energy_mwh")
    return joined.withColumn("energy_mwh_adj_rooftop_solar", total)


def night_share(rooftop: DataFrame, at: str, power: str, region: str, day_hours: tuple[int, int] = (4, 21)) -> DataFrame:
    """One row: mean over regions of night / (night + day) mean power; near zero if clocks are right."""
    day = F.hour(at).between(*day_hours)
    means = rooftop.groupBy(region).agg(
        F.avg(F.when(day, F.col(power))).alias("_day"), F.avg(F.when(~day, F.col(power))).alias("_night")
    )
    return means.agg(F.avg(F.try_divide(F.col("_night"), F.col("_night") + F.col("_day"))).alias("night_share"))


def renewables_daily(regionsum: DataFrame) -> DataFrame:
    """Daily renewable energy per region: mean power over the day times 24 hours."""
    cols = ["regionid", "settlementdate", "totalintermittentgeneration", "uigf"]
    versions = [c.lstrip("-") for c in VERSION_ORDER]
    kept = regionsum.where(F.col("intervention") == 0).select(*cols, *versions)
    latest = keep_latest(kept, ["regionid", "settlementdate"], VERSION_ORDER)
    return latest.groupBy("regionid", F.to_date("settlementdate").alias("d")).agg(
        (F.avg("totalintermittentgeneration") * units.HOURS_PER_DAY).alias("total_renewables_today_mwh"),
        (F.avg("uigf") * units.HOURS_PER_DAY).alias("total_renewables_today_mwh_uigf"),
    )


def add_renewables(panel: DataFrame, renewables: DataFrame) -> DataFrame:
    """Left join by the day in which the half-hour starts."""
    dated = panel.withColumn("d", F.to_date(minus_minutes("hh_end", units.MINUTES_PER_HALF_HOUR)))
    return sized_join(dated, renewables, ["regionid", "d"], "left")


def joined_panel(
    regional: DataFrame, flows: DataFrame, rooftop: DataFrame, regionsum: DataFrame
) -> DataFrame:
    """The regional half-hour panel with flows, rooftop energy and renewables."""
    panel = attribute_flows(regional, flows)
    return add_renewables(add_rooftop(panel, rooftop_energy(rooftop)), renewables_daily(regionsum))


# Settlement intervals were 30 minutes long before this day, 5 from it on.
INTERVAL_CHANGE_DATE = "2021-10-01"
INTERVAL_MINUTES = (30, 5)


def interval_minutes(day: str | Column, change: str = INTERVAL_CHANGE_DATE) -> Column:
    day = F.col(day) if isinstance(day, str) else day
    old, new = INTERVAL_MINUTES
    return F.when(day >= F.lit(change).cast("timestamp_ntz"), F.lit(new)).otherwise(F.lit(old))


def settlement_costs(setgendataregion: DataFrame) -> DataFrame:
    """Latest cost rows with the length, start and end of their interval."""
    order = ["-schema_version", "-versionno", "-top_timestamp", "-lastchanged"]
    cols = ["settlementdate", "periodid", "regionid", "energycost", "netenergy"]
    latest = keep_latest(
        setgendataregion.select(*cols, *[c.lstrip("-") for c in order]), cols[:3], order
    ).select(*cols)
    sized = latest.withColumn("interval_duration", interval_minutes("settlementdate"))
    length = F.col("interval_duration") * F.col("periodid")
    end = F.col("settlementdate") + F.make_dt_interval(mins=length.cast("int"))
    return sized.withColumn("interval_end", end).withColumn(
        "interval_start", F.col("interval_end") - F.make_dt_interval(mins=F.col("interval_duration").cast("int"))
    )


def five_minute_copies(df: DataFrame, at: str, minutes: int = 30, step: int = 5, out: str = "settlementdate") -> DataFrame:
    """Repeat a half-hour row for each of its 5-minute intervals (zero-order hold)."""
    first = minus_minutes(at, minutes - step)
    steps = F.sequence(first, plus_minutes(at, 0), F.expr(f"INTERVAL '{step}' MINUTE"))
    return df.withColumn(out, F.explode(steps))
