"""Joins whose physical strategy depends on a measured size, and joins on time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

# Rows and bytes a dimension may have and still be copied to every executor.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 128 << 20
# Rows of a dimension without repeated keys a task may keep in a hash table.
HASHED_ROWS = 500_000
# Periods one key may have and still be searched row by row.
PERIODS_PER_KEY = 64


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Look at no more than ``max_rows + 1`` rows of ``df``: are they few and short enough to be broadcast?"""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    return seen["n"] <= max_rows and (seen["b"] or 0) <= max_bytes


def sized_join(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    written: bool = False,
    distinct: bool = False,
) -> DataFrame:
    """Join a large table to a smaller one on equal columns.

    A dimension of at most ``max_rows`` rows and ``BROADCAST_BYTES`` is broadcast, so the facts
    are not shuffled. Beyond that both sides are shuffled, and adaptive execution splits the
    partitions of hot keys by the rows they really have, repeating the dimension's
    rows for every part (``RUNTIME_CONF`` forces this). Facts without a key cannot match: where
    they stay in the result they go past the join. The rows are the same either way.

    ``written`` puts the dimension into the checkpoint folder first. Set it where the
    dimension is itself an aggregate of large data, which counting would compute twice. ``distinct`` says
    that the dimension has each key once, so that its rows spread over the tasks: if they are at most ``HASHED_ROWS``
    a task, by a count, they are looked up in a hash table and the facts are not sorted.
    """
    if how not in ("inner", "left", "left_anti", "left_semi"):
        raise ValueError(f"unsupported join type {how!r}")
    on = list(on)
    if written:
        dim = checkpointed(dim)
    if fits_broadcast(dim, max_rows):
        return facts.join(F.broadcast(dim), on, how)
    keyed = F.lit(True)
    for c in on:
        keyed = keyed & F.col(f"`{c}`").isNotNull()
    strategy = "merge"
    if distinct and dim.count() <= HASHED_ROWS * int(dim.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        strategy = "shuffle_hash"
    joined = facts.where(keyed).join(dim.hint(strategy), on, how)
    if how not in ("left", "left_anti"):
        return joined
    return joined.unionByName(facts.where(~keyed), allowMissingColumns=True)


def nearest_event(events: DataFrame, date: str, out: str = "d") -> DataFrame:
    """For each day from the first to the last event, the nearest event; ties go to the next one.

    Every event owns the days from half-way to its predecessor up to half-way to its
    successor, so the days are generated from the events and nothing is searched. Events are
    reduced to one per day first: the window sees at most one row per calendar day.
    """
    rest = [c for c in events.columns if c != date]
    # the largest event of a day as a whole, not the largest of each column
    one = events.groupBy(date).agg(F.max(F.struct(*rest)).alias("_event")) if rest else events.distinct()
    daily = one.select(date, "_event.*") if rest else one
    by_date = Window.orderBy(date)
    gap_before = F.datediff(F.col(date), F.lag(date).over(by_date))
    gap_after = F.datediff(F.lead(date).over(by_date), F.col(date))
    # a day d belongs to the next event when next - d <= d - last
    owned = daily.withColumns(
        {
            "_from": F.date_sub(F.col(date), F.coalesce(F.floor(gap_before / 2).cast("int"), F.lit(0))),
            "_to": F.date_add(F.col(date), F.coalesce((F.ceil(gap_after / 2) - 1).cast("int"), F.lit(0))),
        }
    )
    return owned.withColumn(out, F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")


def effective_join(
    facts: DataFrame,
    periods: DataFrame,
    key: str,
    ts: str,
    start: str = "start_date",
    end: str = "end_date",
    mode: str = "range",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Look up the period of ``key`` in force at ``ts`` (``start <= ts < end``; inner).

    ``mode='first'`` ignores the dates and takes each key's earliest period instead.
    A period without a start is never in force; periods of one key that overlap raise
    ``ValueError``, whatever their number. Beyond ``max_rows`` periods, or many for one key, the
    lookup carries the latest period start forward along the facts, which compares no pairs.
    """
    from .chunks import carry_forward, next_value
    from .dedupe import keep_latest

    if mode == "first":
        first = keep_latest(periods, [key], [start]).drop(start, end)
        return sized_join(facts, first, [key], "inner", max_rows)
    if mode != "range":
        raise ValueError(f"mode must be 'range' or 'first', not {mode!r}")
    # a period without a start or a key is never in force
    periods = periods.where(F.col(start).isNotNull() & F.col(key).isNotNull())
    following = next_value(periods.select(key, start, end), [key], [start, end], {"_next": start})
    if not following.where(F.col(end).isNull() & F.col("_next").isNotNull() | (F.col(end) > F.col("_next"))).isEmpty():
        raise ValueError(f"periods of one {key} overlap")
    sizes = periods.limit(max_rows + 1).groupBy(key).count().agg(F.sum("count"), F.max("count")).first()
    if (sizes[0] or 0) <= max_rows and (sizes[1] or 0) <= PERIODS_PER_KEY and fits_broadcast(periods, max_rows):
        p = F.broadcast(periods.withColumnRenamed(key, "_key"))
        in_force = (F.col("_key") == F.col(key)) & (F.col(ts) >= F.col(start)) & (
            F.col(end).isNull() | (F.col(ts) < F.col(end))
        )
        return facts.join(p, in_force, "inner").drop("_key", start, end)
    attrs = [c for c in periods.columns if c != key]
    # each instant of a key is looked up once, however many facts share it; a period sorts
    # ahead of an instant that equals its start
    points = facts.select(key, ts).distinct().withColumn("_point", F.lit(1))
    marks = periods.select(key, F.col(start).alias(ts), F.lit(0).alias("_point"), F.struct(*attrs).alias("_period"))
    filled = carry_forward(
        points.unionByName(marks, allowMissingColumns=True), [key], [ts, "_point"], ["_period"], suffix=""
    )
    in_force = F.col(f"_period.{end}").isNull() | (F.col(ts) < F.col(f"_period.{end}"))
    kept = [c for c in attrs if c not in (start, end)]
    found = filled.where((F.col("_point") == 1) & F.col("_period").isNotNull() & in_force).select(
        key, ts, *[F.col(f"_period.`{c}`").alias(c) for c in kept]
    )
    joined = sized_join(facts, found, [key, ts], "inner", max_rows, written=True)
    return joined.select(*facts.columns, *kept)
