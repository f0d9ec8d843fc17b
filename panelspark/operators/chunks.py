"""Neighbour look-ups, fills and running sums that never put one key into one task.

A plain window ``partitionBy(key)`` hands all rows of a key to a single task. Here a long
table is cut into chunks of a bounded row count, windows run per (key, chunk), and what has to
cross a cut travels as *boundary rows*: one extra row per (key, chunk), computed from a partial
aggregate, placed before or after the chunk's own rows and dropped again afterwards. A table
below the bound takes the plain window.

Cuts follow the keys, then the whole order, a hash of the row behind it, nulls first: rows without a value
and rows of one value are cut like all others; only rows equal in every column cannot be told apart. Only keys
longer than a chunk are cut, so boundary rows are as few as chunks, however many short keys there are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

# Rows a chunk is meant to have, and rows looked at to place one border.
ROWS_PER_CHUNK = 4_000_000
SEEN_PER_CHUNK = 128
# Settles the order of rows whose order columns are equal.
TIE = "_tie"


@dataclass(frozen=True)
class Carry:
    """How one column crosses chunk borders.

    ``summary`` reduces a chunk to one value; ``over`` turns the per-chunk values (a column
    name) into the boundary value, given the window over the key's other chunks.
    """

    summary: Column
    over: Callable[[str, WindowSpec], Column]


@dataclass(frozen=True)
class Cuts:
    """Chunk borders, one sorted array of places in the long keys: as many entries as chunks, whatever the rows."""

    order: tuple[str, ...]
    borders: DataFrame
    count: int
    keys: tuple[str, ...] = ()

    def numbered(self, df: DataFrame, out: str = "_chunk") -> DataFrame:
        """Add the number of borders at or in front of each row, found by halving, one projection a step.

        ``df`` needs ``TIE``.
        """
        borders, place, found = self.borders.scalar(), _keyed_place(self.keys, self.order), F.col(out)
        df = df.withColumn(out, F.lit(0))
        for bit in reversed(range(self.count.bit_length())):
            step = 1 << bit
            passed = (found + step <= self.count) & (F.get(borders, found + (step - 1)) <= place)
            df = df.withColumn(out, F.when(passed, found + step).otherwise(found))
        return df

    def of_cut_keys(self, df: DataFrame) -> DataFrame:
        """The rows of keys that have a border, which are as few as borders."""
        if not self.keys:
            return df
        cut = self.borders.select(F.explode("borders").alias("b")).select("b.key.*").distinct()
        same = [F.col(f"`{c}`").eqNullSafe(F.col(f"_cut_{i}")) for i, c in enumerate(self.keys)]
        return df.join(F.broadcast(cut.toDF(*[f"_cut_{i}" for i in range(len(self.keys))])), same, "left_semi")


def with_tie(df: DataFrame) -> DataFrame:
    """Add a hash of the row; maps and variants have none, columns of this module are copies of others."""
    own = {"_peek", "_seen", "_knot", "_edge"}
    hashed = [f.name for f in df.schema.fields if f.name not in own and not re.search(r"\b(map|variant)\b", f.dataType.simpleString())]
    return df.withColumn(TIE, F.xxhash64(*[F.col(f"`{c}`") for c in hashed]) if hashed else F.lit(0).cast("bigint"))


def position(df: DataFrame, column: str) -> Column:
    """The order column as a double that never falls where the column rises.

    Text is placed by its first six bytes; what shares them stays together.
    """
    dtype, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return (F.unix_micros(c.cast("timestamp")) / F.lit(1e6)).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    if isinstance(dtype, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    raise TypeError(f"{column} must be a number, text, date or timestamp to be cut into chunks")


def plan_cuts(
    df: DataFrame, order: Sequence[str], rows_per_chunk: int = ROWS_PER_CHUNK, keys: Sequence[str] = (), total: int | None = None
) -> Cuts | None:
    """Choose chunk borders from a row count and, for a long table, a sorted sample of its keys and order.

    None means that the table, or each of its keys, is short enough for a plain window. Every so many rows of the
    sample one is a border, and the first of each sorted partition, so chunks may be smaller than asked for but hardly
    larger. With ``keys`` there are two borders to a chunk, and a key with a single one is left whole. ``total``
    is a number of rows known to be no smaller.
    """
    total = df.count() if total is None else total
    if total <= rows_per_chunk:
        return None
    parts = -(-total * (10 if keys else 5) // (rows_per_chunk * 4))
    share = SEEN_PER_CHUNK * parts / total
    seen = with_tie(df.sample(share, 1) if share < 1 else df).select(_keyed_place(keys, order).alias("at"))
    step = SEEN_PER_CHUNK if share < 1 else max(1, total // parts)
    # the lower 33 bits count the rows of a partition
    numbered = seen.orderBy("at").withColumn("n", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    every = numbered.where(F.col("n") % step == 0).select("at").distinct()
    if keys:
        many = F.count(F.lit(1)).over(Window.partitionBy(F.col("at.key")))
        every = every.withColumn("many", many).where(F.col("many") > 1)
    borders = written(every.agg(F.sort_array(F.collect_set("at")).alias("borders")), "borders")
    count = borders.select(F.size("borders")).first()[0]
    return Cuts(tuple(order), borders, count, tuple(keys)) if count > 0 else None


def over_chunks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    compute: Callable[[WindowSpec], dict[str, Column]],
    before: dict[str, Carry] | None = None,
    after: dict[str, Carry] | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Add the columns of ``compute(window)``, the window running in ``order`` within ``keys``.

    ``before`` / ``after`` say what the boundary row ahead of / behind a chunk carries.
    ``sized_by`` is a cheaper table with at least as many rows as ``df``, such as the input it
    was made from: counted instead of ``df``, and cut instead of it if it has the key and order columns. Rows
    of equal order follow each other by a hash of all their columns.
    """
    keys, order = list(keys), list(order)
    position(df, order[0])  # an order column that cannot be cut is refused at any size
    total = None if sized_by is None else sized_by.count()
    known = sized_by if sized_by is not None and {*keys, *order} <= set(sized_by.columns) else df
    cuts = plan_cuts(known, order, rows_per_chunk, keys, total)
    detail = with_tie(df)
    if cuts is None:
        plain = Window.partitionBy(*keys).orderBy(*order, TIE)
        return detail.withColumns(compute(plain)).drop(TIE)

    rows = cuts.numbered(detail).withColumn("_edge", F.lit(0))
    before, after = before or {}, after or {}
    if before or after:
        # one reading of the rows that have cuts gives what crosses them in either direction
        summaries = {f"_b_{n}": c.summary for n, c in before.items()} | {f"_a_{n}": c.summary for n, c in after.items()}
        summary = cuts.numbered(cuts.of_cut_keys(detail)).groupBy(*keys, "_chunk").agg(*[c.alias(n) for n, c in summaries.items()])
        per_key = Window.partitionBy(*keys).orderBy("_chunk")
        ahead, behind = per_key.rowsBetween(Window.unboundedPreceding, -1), per_key.rowsBetween(1, Window.unboundedFollowing)
        crossing = {f"_b_{n}": c.over(f"_b_{n}", ahead) for n, c in before.items()}
        crossing |= {f"_a_{n}": c.over(f"_a_{n}", behind) for n, c in after.items()}
        crossing = summary.select(*keys, "_chunk", *[c.alias(n) for n, c in crossing.items()])
        edges = [e for e, carries in ((-1, before), (1, after)) if carries]
        crossing = crossing.withColumn("_edge", F.explode(F.array(*[F.lit(e) for e in edges])))

        def carried(name: str) -> Column:
            one = F.when(F.col("_edge") == -1, F.col(f"_b_{name}")) if name in before else None
            two = F.when(F.col("_edge") == 1, F.col(f"_a_{name}")) if name in after else None
            return two if one is None else one if two is None else F.coalesce(one, two)

        boundary = crossing.select(*keys, "_chunk", "_edge", *[carried(n).alias(n) for n in {**before, **after}])
        rows = rows.unionByName(boundary, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_edge", *order, TIE)
    done = rows.withColumns(compute(inside)).where(F.col("_edge") == 0)
    return done.drop("_chunk", "_edge", TIE)


def _nearest_first(name: str, others: WindowSpec) -> Column:
    return F.first(name, ignorenulls=True).over(others)


def _nearest_last(name: str, others: WindowSpec) -> Column:
    return F.last(name, ignorenulls=True).over(others)


def _sum_of(name: str, others: WindowSpec) -> Column:
    return F.sum(name).over(others)


def _place(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in order], F.col(TIE))


def _key(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)])


def _keyed_place(keys: Sequence[str], order: Sequence[str]) -> Column:
    return F.struct(_key(keys).alias("key"), _place(order).alias("place")) if keys else _place(order)


def next_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str], **sizing
) -> DataFrame:
    """Add, per ``columns`` entry out -> in, the value of the next row of the key (NULL on its last row)."""
    ins = list(columns.values())
    packed = df.withColumn("_peek", F.struct(*[F.col(f"`{c}`") for c in ins]))
    # a chunk's first row, whatever its values, is the successor of the previous chunk's last row
    carry = Carry(F.min_by("_peek", _place(order)), _nearest_first)
    done = over_chunks(packed, keys, order, lambda w: {"_next": F.lead("_peek").over(w)}, after={"_peek": carry}, **sizing)
    return done.withColumns({out: F.col(f"_next.`{c}`") for out, c in columns.items()}).drop("_peek", "_next")


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str], **sizing
) -> DataFrame:
    """Mirror image of :func:`next_value`."""
    ins = list(columns.values())
    packed = df.withColumn("_peek", F.struct(*[F.col(f"`{c}`") for c in ins]))
    carry = Carry(F.max_by("_peek", _place(order)), _nearest_last)
    done = over_chunks(packed, keys, order, lambda w: {"_prev": F.lag("_peek").over(w)}, before={"_peek": carry}, **sizing)
    return done.withColumns({out: F.col(f"_prev.`{c}`") for out, c in columns.items()}).drop("_peek", "_prev")


def _present(columns: Sequence[str]) -> Column:
    """The columns as one struct, NULL where the first of them is NULL."""
    return F.when(F.col(f"`{columns[0]}`").isNotNull(), F.struct(*[F.col(f"`{c}`") for c in columns]))


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], suffix: str = "_last", **sizing
) -> DataFrame:
    """Fill down: for every row, the columns of the latest row (itself included) where the first column is set.

    Results are named ``column + suffix``; an empty suffix replaces the columns.
    """
    packed = df.withColumn("_seen", _present(columns))
    set_only = F.when(F.col("_seen").isNotNull(), _place(order))
    carry = Carry(F.max_by("_seen", set_only), _nearest_last)

    def compute(w: WindowSpec) -> dict[str, Column]:
        return {"_fill": F.last("_seen", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))}

    done = over_chunks(packed, keys, order, compute, before={"_seen": carry}, **sizing)
    return done.withColumns({f"{c}{suffix}": F.col(f"_fill.`{c}`") for c in columns}).drop("_seen", "_fill")


def carry_backward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], suffix: str = "_next", **sizing
) -> DataFrame:
    """Fill up: mirror image of :func:`carry_forward`."""
    packed = df.withColumn("_seen", _present(columns))
    set_only = F.when(F.col("_seen").isNotNull(), _place(order))
    carry = Carry(F.min_by("_seen", set_only), _nearest_first)

    def compute(w: WindowSpec) -> dict[str, Column]:
        return {"_fill": F.first("_seen", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))}

    done = over_chunks(packed, keys, order, compute, after={"_seen": carry}, **sizing)
    return done.withColumns({f"{c}{suffix}": F.col(f"_fill.`{c}`") for c in columns}).drop("_seen", "_fill")


def interpolate_linear(
    df: DataFrame, keys: Sequence[str], t: str, value: str, out: str | None = None, ends: str = "hold", **sizing
) -> DataFrame:
    """Fill missing values on the straight line between their neighbours in ``t``.

    Before the first and after the last known value the series is held flat
    (``ends='hold'``) or left missing (``ends='null'``).
    """
    if ends not in ("hold", "null"):
        raise ValueError(f"ends must be 'hold' or 'null', not {ends!r}")
    out = out or value
    packed = df.withColumn("_pos", position(df, t)).withColumn("_knot", _present([value, "_pos"]))
    set_only = F.when(F.col("_knot").isNotNull(), _place([t]))

    def compute(w: WindowSpec) -> dict[str, Column]:
        return {
            "_a": F.last("_knot", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "_b": F.first("_knot", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
        }

    done = over_chunks(
        packed,
        keys,
        [t],
        compute,
        before={"_knot": Carry(F.max_by("_knot", set_only), _nearest_last)},
        after={"_knot": Carry(F.min_by("_knot", set_only), _nearest_first)},
        **sizing,
    )
    va, ta = F.col(f"_a.`{value}`"), F.col("_a._pos")
    vb, tb = F.col(f"_b.`{value}`"), F.col("_b._pos")
    line = va + (vb - va) * ((F.col("_pos") - ta) / (tb - ta))
    edge = F.coalesce(va, vb) if ends == "hold" else F.lit(None).cast("double")
    filled = (
        F.when(F.col(f"`{value}`").isNotNull(), F.col(f"`{value}`").cast("double"))
        .when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), line)
        .otherwise(edge)
    )
    return done.withColumn(out, filled).drop("_pos", "_knot", "_a", "_b")


def rolling_mean_fill(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str | None = None, **sizing
) -> DataFrame:
    """Replace a missing value by the mean of the rows before and after it that have one."""
    packed = df.withColumn("_peek", F.struct(F.col(f"`{value}`").cast("double").alias("v")))

    def compute(w: WindowSpec) -> dict[str, Column]:
        return {"_prev": F.lag("_peek").over(w), "_next": F.lead("_peek").over(w)}

    done = over_chunks(
        packed,
        keys,
        order,
        compute,
        before={"_peek": Carry(F.max_by("_peek", _place(order)), _nearest_last)},
        after={"_peek": Carry(F.min_by("_peek", _place(order)), _nearest_first)},
        **sizing,
    )
    pv, nx = F.col("_prev.v"), F.col("_next.v")
    mean = F.when(pv.isNotNull() & nx.isNotNull(), (pv + nx) / 2).otherwise(F.coalesce(pv, nx))
    return done.withColumn(out or value, F.coalesce(F.col(f"`{value}`").cast("double"), mean)).drop("_peek", "_prev", "_next")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str], **sizing
) -> DataFrame:
    """Add running totals out -> in along ``order``; pass no keys for a total over the whole table."""
    staged = df.withColumns({f"_v_{out}": F.col(f"`{c}`") for out, c in columns.items()})
    carries = {f"_v_{out}": Carry(F.sum(f"_v_{out}"), _sum_of) for out in columns}

    def compute(w: WindowSpec) -> dict[str, Column]:
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        return {out: F.sum(f"_v_{out}").over(upto) for out in columns}

    done = over_chunks(staged, keys, order, compute, before=carries, **sizing)
    return done.drop(*[f"_v_{out}" for out in columns])


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, **sizing) -> DataFrame:
    """Running row number from 1 within ``keys``."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_sum(ones, keys, order, {out: "_one"}, **sizing).drop("_one")
