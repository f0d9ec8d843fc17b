"""Two effects as a graph: their levels are the nodes, their cells the edges.

Taking both effects out of a column is a least-squares problem in one number per level. With the
levels of one effect eliminated it becomes a linear system in the levels of the other whose matrix is
that of the weighted graph, and conjugate gradients solve it with nothing but sums over edges: to
the one side and back, a few dozen times. Vectors are tables of one row per level; what reaches the
driver is a handful of inner products per column. The system has one redundant equation per
connected part of the graph, which does not disturb the iteration but costs degrees of freedom.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import fits_broadcast
from ..session import written

# Columns solved for at once, squared relative length of the residual at the end, steps allowed.
AT_ONCE, TOLERANCE, STEPS = 12, 1e-24, 2_000
# Pairs of small levels at one big level, per edge, that are multiplied out, and small levels one may have for it.
PAIRS_PER_EDGE, MAX_DEGREE = 8, 1_000
# Relative rounding of sums of products.
ROUNDING = 1e-14


class NotSettled(RuntimeError):
    pass


def parts(cells: DataFrame, first: str = "_big", second: str = "_small") -> int:
    """Number of connected parts of the graph whose edges are the distinct pairs of two columns.

    Every node moves to the node next to it that is first in an order drawn anew each round, and
    edges inside a node go. That halves the nodes or better whatever the shape of the graph, and each
    round is written, so plans stay short.
    """
    # levels of the first column only link levels of the second: each to the smallest one beside it
    pairs = written(cells.select(F.col(first).alias("a"), F.col(second).alias("b")).distinct(), "pairs")
    smallest = pairs.groupBy("a").agg(F.min("b").alias("to"))
    links = pairs.join(smallest, "a").where("b <> to").select(F.col("to").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    edges = written(links.distinct(), "edges")
    turn, nodes = 0, _nodes(edges).count()
    # a level without a link is a part of its own
    found = pairs.select("b").distinct().count() - nodes
    while nodes:
        to = _nodes(edges, "b")
        place = lambda c: F.struct(F.xxhash64(F.lit(turn), c), F.col(c).alias("at"))  # noqa: B023, E731
        first_of = to.groupBy("node").agg(F.min(place("b")).alias("to"))
        moved = written(first_of.select("node", F.least("to", place("node"))["at"].alias("next")), "moves")
        images = moved.select("next").distinct().count()
        a = moved.select(F.col("node").alias("a"), F.col("next").alias("x"))
        b = moved.select(F.col("node").alias("b"), F.col("next").alias("y"))
        left = edges.join(a, "a").join(b, "b").where("x <> y")
        edges = written(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        nodes = _nodes(edges).count()
        found += images - nodes
        turn += 1
    return found


def _nodes(edges: DataFrame, *also: str) -> DataFrame:
    """Each end of each edge (with the other end); without it, the distinct ends."""
    ends = edges.select(F.col("a").alias("node"), F.col("b")).union(edges.select(F.col("b"), F.col("a")))
    return ends if also else ends.select("node").distinct()


def _joined(edges: DataFrame, vector: DataFrame, on: str, small: bool) -> DataFrame:
    return edges.join(F.broadcast(vector) if small else vector, on)


class _Gradients:
    """Conjugate gradients for some columns at once, scaled by the weight of each level."""

    def __init__(self, edges: DataFrame, small_vectors: bool):
        self.edges, self.small_vectors = edges, small_vectors
        self.product = None if small_vectors else self._product()

    def _product(self) -> DataFrame | None:
        """``(_small, to, w)``: the way to the big levels and back as one matrix, made once, if few small levels share a big one."""
        degrees = self.edges.groupBy("_big").agg(F.count(F.lit(1)).alias("n"))
        sizes = degrees.agg(F.sum("n"), F.sum(F.col("n") * F.col("n")), F.max("n")).first()
        if sizes[0] is None or sizes[1] > PAIRS_PER_EDGE * sizes[0] or sizes[2] > MAX_DEGREE:
            return None
        ends = self.edges.groupBy("_big").agg(F.collect_list(F.struct("_small", "w")).alias("at"), F.sum("w").alias("whole"))
        one = ends.select("at", "whole", F.explode("at").alias("a"))
        two = one.select("a", "whole", F.explode("at").alias("b"))
        entry = F.sum(F.col("a.w") * F.col("b.w") / F.col("whole"))
        return written(two.groupBy(F.col("a._small").alias("_small"), F.col("b._small").alias("to")).agg(entry.alias("w")), "product")

    def through(self, vector: DataFrame, names: list[str]) -> DataFrame:
        """``(_small, names)``: weighted mean of ``vector`` (by small level) at each big level, summed back to the small ones."""
        if self.product is not None:
            held = self.product.join(vector.select("_small", *names), "_small")
            return held.groupBy(F.col("to").alias("_small")).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in names])
        there = _joined(self.edges, vector.select("_small", *names), "_small", self.small_vectors)
        means = there.groupBy("_big").agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in names])
        return self.back(means, names)

    def back(self, means: DataFrame, names: list[str]) -> DataFrame:
        held = self.edges.join(means, "_big")
        return held.groupBy("_small").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in names])

    def solve(self, start: DataFrame, n: int, size: np.ndarray) -> DataFrame:
        """``start`` is (_small, d, r0 ...): the weight of each level and the right-hand sides; gives (_small, x0 ...).

        ``size`` are squared lengths below whose rounding a right-hand side counts as nothing.
        """
        r, p, q, x = ([f"{c}{j}" for j in range(n)] for c in "rpqx")
        state = start.withColumns({x[j]: F.lit(0.0) for j in range(n)} | {p[j]: F.col(r[j]) / F.col("d") for j in range(n)})
        first = None
        for _ in range(STEPS):
            turned = self.through(state, p).withColumnsRenamed(dict(zip(p, q)))
            state = written(
                state.join(turned, "_small").withColumns({q[j]: F.col("d") * F.col(p[j]) - F.col(q[j]) for j in range(n)}), "gradients"
            )
            inner = []
            for j in range(n):
                inner += [F.sum(F.col(p[j]) * F.col(q[j])), F.sum(F.col(r[j]) ** 2 / F.col("d"))]
                inner += [F.sum(F.col(r[j]) * F.col(q[j]) / F.col("d")), F.sum(F.col(q[j]) ** 2 / F.col("d"))]
            row = np.array(state.agg(*inner).first(), float).reshape(n, 4)
            pq, rr, rq, qq = row.T
            first = rr if first is None else first
            live = (rr > TOLERANCE * np.maximum(first, ROUNDING * size)) & (rr > ROUNDING**2 * size) & (pq > 0)
            if not live.any():
                return state.select("_small", *x)
            alpha = np.where(live, rr / np.where(live, pq, 1.0), 0.0)
            left = np.maximum(rr - 2 * alpha * rq + alpha**2 * qq, 0.0)
            beta = np.where(live, left / np.where(live, rr, 1.0), 0.0)
            state = state.withColumns(
                {x[j]: F.col(x[j]) + float(alpha[j]) * F.col(p[j]) for j in range(n)} | {r[j]: F.col(r[j]) - float(alpha[j]) * F.col(q[j]) for j in range(n)}
            )
            state = state.withColumns({p[j]: F.col(r[j]) / F.col("d") + float(beta[j]) * F.col(p[j]) for j in range(n)}).drop(*q)
        raise NotSettled(f"the effects did not settle within {STEPS} steps")


def residual_effects(cells: DataFrame, sums: Sequence[Column], w: str = "sw") -> DataFrame:
    """``cells`` with ``f``: for every column, the two effects' share in each cell, as an array.

    ``cells`` hold ``_big``, ``_small`` and the weight ``w``; ``sums`` are the weighted sums of the columns per cell. A column
    less ``f`` is its residual after both effects.
    """
    edges = written(cells.groupBy("_big", "_small").agg(F.sum(w).alias("w")), "edges")
    weights = edges.groupBy("_small").agg(F.sum("w").alias("d"))
    solver = _Gradients(edges, fits_broadcast(weights, max_bytes=(64 << 20) // AT_ONCE))
    sides: dict[str, DataFrame | None] = {"_big": None, "_small": None}
    for low in range(0, len(sums), AT_ONCE):
        some = list(sums[low : low + AT_ONCE])
        n = len(some)
        m, r, x = ([f"{c}{j}" for j in range(n)] for c in "mrx")
        narrow = cells.select("_big", "_small", w, *[F.coalesce(c, F.lit(0.0)).alias(name) for c, name in zip(some, m)])
        # the means of the big levels, and what they leave at the small ones
        means = written(narrow.groupBy("_big").agg(*[(F.sum(c) / F.sum(w)).alias(c) for c in m]), "means")
        taken = solver.back(means, m).withColumnsRenamed(dict(zip(m, r)))
        start = narrow.groupBy("_small").agg(F.sum(w).alias("d"), *[F.sum(c).alias(c) for c in m]).join(taken, "_small")
        start = written(start, "start")
        size = np.array(start.agg(*[F.sum(F.col(c) ** 2 / F.col("d")) for c in m]).first(), float)
        found = solver.solve(start.select("_small", "d", *[(F.col(a) - F.col(b)).alias(b) for a, b in zip(m, r)]), n, size)
        held = _joined(edges, found, "_small", solver.small_vectors)
        moved = held.groupBy("_big").agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in x])
        big = means.join(moved, "_big").select("_big", F.array(*[F.col(a) - F.col(b) for a, b in zip(m, x)]).alias("f"))
        for side, vector in (("_big", big), ("_small", found.select("_small", F.array(*x).alias("f")))):
            before = sides[side]
            if before is not None:
                more = vector.withColumnRenamed("f", "more")
                vector = before.join(more, side).select(side, F.concat("f", "more").alias("f"))
            sides[side] = written(vector, "levels")
    at_big = sides["_big"].withColumnRenamed("f", "_fb")
    at_small = sides["_small"].withColumnRenamed("f", "_fs")
    joined = cells.join(at_big, "_big").join(at_small, "_small")
    return joined.withColumn("f", F.zip_with("_fb", "_fs", lambda a, b: a + b)).drop("_fb", "_fs")
