"""Concentration of a total in its largest parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .chunks import running_sum


def cumulative_share(
    df: DataFrame, by: str, measures: dict[str, str], then: list[str] | None = None, **sizing
) -> DataFrame:
    """Running totals and running shares of ``measures`` (out -> in) from the largest ``by`` down.

    Adds ``cum_<out>`` and ``frac_<out>``. ``then`` settles the order among equal ``by``.
    """
    # rows without a value come last
    down = df.withColumn("_down", F.coalesce(-F.col(f"`{by}`").cast("double"), F.lit(float("inf"))))
    totals = df.agg(*[F.sum(f"`{c}`").cast("double").alias(out) for out, c in measures.items()]).first()
    cum = running_sum(
        down, [], ["_down", *(then or [])], {f"cum_{out}": c for out, c in measures.items()}, **sizing
    ).drop("_down")
    shares = {
        f"frac_{out}": F.try_divide(F.col(f"cum_{out}").cast("double"), F.lit(totals[out]).cast("double"))
        for out in measures
    }
    return cum.withColumns(shares)


def cost_concentration(df: DataFrame, cost: str, minutes: str, time_share: float = 0.01, **sizing) -> DataFrame:
    """Share of all cost that falls into the dearest ``time_share`` of time.

    Intervals are taken from the highest cost per hour down, while their summed length stays
    within ``time_share`` of all time; one row (frac_total_cost, cum_hours, frac_time) comes
    back, none if even the dearest interval is too long. Intervals of one price and length
    are interchangeable, so they are added up before anything is sorted; the group that
    straddles the limit contributes the whole intervals that still fit.
    """
    rate: Column = F.try_divide(F.col(cost) * F.lit(60), F.col(minutes))
    # written once: sizing, totals and the running sums all read it
    groups = checkpointed(
        df.groupBy(rate.alias("rate"), F.col(minutes).alias("_len")).agg(
            F.count(F.lit(1)).alias("_n"), F.sum(cost).alias("_cost")
        )
    )
    groups = groups.withColumns({"_time": F.col("_n") * F.col("_len"), "_short": -F.col("_len")})
    totals = groups.agg(F.sum("_cost").cast("double"), F.sum("_time").cast("double")).first()
    all_cost, all_time = (F.lit(v).cast("double") for v in totals)
    steps = cumulative_share(groups, "rate", {"cost": "_cost", "time": "_time"}, ["_short"], **sizing)
    excess = F.col("cum_time") - all_time * F.lit(time_share)
    # whole intervals to take back from a group that reaches past the limit
    back = F.least(F.ceil(excess / F.col("_len") - F.lit(1e-9)), F.col("_n"))
    steps = steps.withColumn("_back", F.when(F.col("frac_time") > time_share, back).otherwise(F.lit(0)))
    kept_time = F.col("cum_time") - F.col("_back") * F.col("_len")
    kept_cost = F.col("cum_cost") - F.col("_back") * F.col("_cost") / F.col("_n")
    # the cut lies in the last group that still adds an interval
    adding = steps.where(F.col("_back") < F.col("_n")).select(
        F.try_divide(kept_cost, all_cost).alias("frac_total_cost"),
        (kept_time / F.lit(60.0)).alias("cum_hours"),
        F.try_divide(kept_time, all_time).alias("frac_time"),
        F.struct((-F.col("rate")).alias("r"), F.col("_short").alias("s")).alias("_at"),
    )
    return (
        adding.groupBy()
        .agg(*[F.max_by(c, "_at").alias(c) for c in ("frac_total_cost", "cum_hours", "frac_time")])
        .where(F.col("frac_time").isNotNull())
    )
