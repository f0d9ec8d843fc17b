"""Mix sources to target weights by temperature; DataFrame functions only.

The share of a source is its part of all tokens. Raised to an exponent between 0 and 1 and
normalised, shares become weights: 1 keeps them, 0 makes them equal. The exponent is bisected
until the weights meet a target entropy; a repetition limit may hold it higher. A weight times
the budget is the token budget of a source. It is drawn in blocks, each a permutation of all rows of
the source by a keyed hash; the last block is cut where the budget ends.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# Target entropy as a part of the largest possible one, most times a source may be repeated, and
# bisection steps in all and per scan of the sources.
ENTROPY, REPEATS, STEPS, AT_ONCE = 0.95, 8.0, 40, 4
# Rows of one source per piece of its permutation, and bytes of plans that are broadcast.
PIECE_ROWS, PLAN_BYTES = 10_000, 8 << 20
HEX_DIGITS = 8


def words(text: Column) -> Column:
    """Tokens of a text if nothing better is known: parts between blanks; 0 for null or empty."""
    parts = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1
    return F.when(F.length(text) > 0, parts).otherwise(0).cast("bigint")


def named(source: Column) -> Column:
    """The source as a text that is never null: null is empty, anything else starts with ``=``."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def order_key(seed: int, source: Column, block: Column, id: Column) -> Column:
    """Place of a row in one block's permutation, as hexadecimal text."""
    parts = [F.lit(str(seed)), source, block.cast("string"), F.coalesce(id.cast("string"), F.lit(""))]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def _probe(sources: DataFrame, exponents: list[float], budget: float) -> list[tuple[float, float]]:
    """Entropy and largest repetition under each exponent, in one scan of the sources."""
    sums = []
    for i, t in enumerate(exponents):
        raised = F.pow("share", F.lit(t))
        sums += [F.sum(raised).alias(f"z{i}"), F.sum(raised * F.ln("share")).alias(f"s{i}")]
        sums.append(F.max(raised * budget / F.col("tokens")).alias(f"r{i}"))
    row = sources.agg(*sums).first()
    return [(math.log(row[f"z{i}"]) - t * row[f"s{i}"] / row[f"z{i}"], row[f"r{i}"] / row[f"z{i}"]) for i, t in enumerate(exponents)]


def exponent(sources: DataFrame, budget: float, entropy: float | None, repeats: float | None) -> float:
    """The largest exponent whose weights have at least ``entropy`` (a part of the logarithm of
    the number of sources), raised to the smallest that repeats no source more than ``repeats``
    times if that is more. 1 if the shares as they are will do, or if nothing can.

    ``sources (tokens, share)`` stays in Spark; a scan gives the values of the next
    ``AT_ONCE`` steps of the bisection.
    """
    n = sources.count()
    if n < 2:
        return 1.0
    target = None if entropy is None else entropy * math.log(n)

    def bisect(enough) -> float:
        """Largest exponent in [0, 1] (to ``STEPS`` halvings) with ``enough`` true from 0 up to it."""
        low, high = 0.0, 1.0
        if enough(*_probe(sources, [1.0], budget)[0]):
            return 1.0
        for _ in range(0, STEPS, AT_ONCE):
            cells = 1 << AT_ONCE
            points = [low + (high - low) * k / cells for k in range(1, cells)]
            values = _probe(sources, points, budget)
            kept = next((k for k, v in enumerate(values) if not enough(*v)), len(values))
            low, high = ([low, *points, high])[kept], ([low, *points, high])[kept + 1]
        return low

    found = 1.0 if target is None else bisect(lambda h, _: h >= target)
    if repeats is not None and found < 1:
        _, most = _probe(sources, [found], budget)[0]
        if most > repeats:
            # repetition falls as the exponent rises: look from the other end
            below = bisect(lambda _, r: r > repeats)
            found = min(1.0, below + 2.0**-STEPS) if below < 1 else 1.0
    return found


def source_plans(
    docs: DataFrame, id: str, source: str, tokens: Column, epochs: float, entropy: float | None, repeats: float | None, seed: int
) -> DataFrame:
    """One row per source: ``source, tokens, rows, weight, budget, blocks, cut``.

    ``blocks`` whole blocks are drawn, and of block number ``blocks`` the rows whose order key is
    at most ``cut`` (null: none).
    """
    narrow = docs.select(F.col(f"`{id}`").alias("id"), named(F.col(f"`{source}`")).alias("source"), tokens.alias("tokens"))
    narrow = written(narrow, "tokens")
    totals = written(narrow.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "totals")
    whole = totals.agg(F.sum("tokens")).first()[0] or 0
    spoken = totals.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(whole or 1)))
    asked = epochs * whole
    power = exponent(spoken, asked, entropy, repeats)
    raised = F.pow("share", F.lit(power))
    z = spoken.agg(F.sum(raised)).first()[0] or 1.0
    weighed = spoken.withColumn("weight", raised / F.lit(z))
    weighed = weighed.withColumn("budget", F.floor(F.col("weight") * F.lit(asked) + 0.5).cast("bigint"))
    weighed = weighed.withColumn("blocks", F.floor(F.col("budget") / F.col("tokens")).cast("bigint"))
    nothing = {"weight": F.lit(0.0), "budget": F.lit(0).cast("bigint"), "blocks": F.lit(1).cast("bigint")}
    silent = totals.where("tokens = 0").withColumns(nothing)
    shares = written(weighed.drop("share").unionByName(silent), "shares")

    # the last block is cut by running sums: first over pieces of the permutation, then inside one
    last = shares.where("tokens > 0").select(
        "source",
        "blocks",
        (F.col("budget") - F.col("blocks") * F.col("tokens")).alias("rest"),
        F.ceil(F.col("rows") / PIECE_ROWS).cast("bigint").alias("pieces"),
    )
    key = order_key(seed, F.col("source"), F.col("blocks"), F.col("id"))
    place = F.conv(F.substring("key", 1, HEX_DIGITS), 16, 10).cast("bigint")
    piece = F.floor(place * F.col("pieces") / F.lit(16**HEX_DIGITS)).cast("bigint")
    keyed = narrow.join(F.broadcast(last) if fits(last) else last, "source")
    keyed = keyed.withColumn("key", key).select("source", "rest", piece.alias("piece"), "key", "tokens")
    keyed = written(keyed, "keyed")
    sums = keyed.groupBy("source", "rest", "piece").agg(F.sum("tokens").alias("sum"), F.max("key").alias("end"))
    before = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    edge = sums.withColumn("ahead", F.coalesce(F.sum("sum").over(before), F.lit(0))).where("ahead <= rest")
    edge = written(edge, "edge")
    whole_pieces = edge.where("ahead + sum <= rest").groupBy("source").agg(F.max("end").alias("end"))
    broken = edge.where("ahead + sum > rest").select("source", "piece", "ahead")
    inner = Window.partitionBy("source", "piece").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # rows that share a key (repeated ids) are one here: in or out together
    rows = keyed.join(F.broadcast(broken) if fits(broken) else broken, ["source", "piece"])
    rows = rows.groupBy("source", "piece", "key", "ahead", "rest").agg(F.sum("tokens").alias("tokens"))
    inside = rows.withColumn("running", F.col("ahead") + F.sum("tokens").over(inner)).where("running <= rest")
    # pieces follow the order of keys, so the largest key taken is the cut
    ends = inside.select("source", F.col("key").alias("end")).unionByName(whole_pieces)
    cuts = ends.groupBy("source").agg(F.max("end").alias("cut"))
    return written(shares.join(cuts, "source", "left"), "plans")


def fits(df: DataFrame) -> bool:
    """Is a small table known to be small enough for a broadcast? Measured in bytes of its text."""
    width = reduce(lambda a, b: a + b, [F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns])
    return (df.agg(F.sum(width)).first()[0] or 0) <= PLAN_BYTES


def draw(
    docs: DataFrame,
    id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    tokens: Column | None = None,
    epochs: float = 1.0,
    entropy: float | None = ENTROPY,
    repeats: float | None = REPEATS,
    seed: int = 42,
    block: str = "block",
    key: str = "order_key",
) -> DataFrame:
    """Rows of ``docs`` as often as drawn, with the block number and the place in its permutation.

    Sort by ``(block, order_key)`` to read them in mixed order. ``tokens`` defaults to the parts of the
    text between blanks; the budget is ``epochs`` times all tokens of ``docs``. A null source is a source of its
    own. Rows without tokens (null or empty text) come with every whole block; a source that has
    nothing else is drawn once. Repeated rows share their place, so all of them fall
    into a block or none. The tokens drawn from a source never exceed its budget. An empty table
    gives an empty table. Neither rows nor sources are collected; ``docs`` is not shuffled unless
    its sources are too many to broadcast.
    """
    counted = words(F.col(f"`{text}`")) if tokens is None else tokens
    plans = source_plans(docs, id, source, counted, epochs, entropy, repeats, seed)
    plan = plans.select(F.col("source").alias("_source"), F.struct("blocks", "cut").alias("_plan"))
    rows = docs.join(F.broadcast(plan) if fits(plans) else plan, named(F.col(f"`{source}`")) == F.col("_source"))
    own, blocks = F.col("_source"), F.col("_plan.blocks")
    # blocks 0 .. blocks - 1 whole, the next up to its cut
    taken = F.coalesce(order_key(seed, own, blocks, F.col(f"`{id}`")) <= F.col("_plan.cut"), F.lit(False))
    rows = rows.withColumn("_number", blocks + taken.cast("bigint")).where("_number > 0")
    rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_number") - 1)))
    place = order_key(seed, own, F.col("_block"), F.col(f"`{id}`"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_block").alias(block), place.alias(key))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The drawn rows with the columns of ``docs`` only; see ``draw``."""
    names = {"block": "_drawn_block", "key": "_drawn_key"}
    return draw(docs, **options, **names).drop(*names.values())
