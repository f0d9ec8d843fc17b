"""Connected components of links that stay in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``; nodes of one component share a root.

    Randomised contraction: every node moves to the neighbour (or itself) that comes first in a
    pseudo-random order drawn anew each round, the links are relabelled, and links inside a node
    go. The graph shrinks by a constant factor per round whatever its shape, so long chains and
    large stars both end after a logarithmic number of rounds. Each round is written to the
    shared folder; nothing but one row count reaches the driver. Nulls and links of a node to
    itself are ignored.
    """
    edges = written(links.select("a", "b").where("a != b").distinct(), "links")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        place = F.xxhash64(F.lit(len(moves)), F.col("b"))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(place.alias("h"), "b")).alias("to"))
        own = F.struct(F.xxhash64(F.lit(len(moves)), F.col("node")).alias("h"), F.col("node").alias("b"))
        move = written(first.select("node", F.least("to", own)["b"].alias("next")), "moves")
        moves.append(move)
        at_a = move.select(F.col("node").alias("a"), F.col("next").alias("x"))
        at_b = move.select(F.col("node").alias("b"), F.col("next").alias("y"))
        contracted = edges.join(at_a, "a").join(at_b, "b").where("x != y")
        ordered = contracted.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = written(ordered.distinct(), "links")
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    roots = moves[0].select("node", F.col("next").alias("root"))
    for move in moves[1:]:
        step = move.select(F.col("node").alias("root"), "next")
        roots = roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return written(roots, "roots")


class Forest:
    """Merges numbered items inside one task; ``label`` gives each item's smallest merged item."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def merge(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(label, high, low)
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up
