"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector falls into all filters whose cap it lies in. The directions
form a random product code: the space is cut into blocks, every block has a list of random unit
vectors, and a direction is one choice per block. All directions a vector exceeds the limit
with are list-decoded block by block, with the best the remaining blocks can add as a bound, so
far more filters can be had than could be tried one by one. Every code turns the vectors in a
random way of its own before it cuts them, so that no vector has its energy in one block of all
codes, and a vector that few directions of a code reach takes the best ones. Vectors meet in their common
filters and are compared exactly there. A pair counts in the first filter it shares, so nothing
has to be removed afterwards and no pair is ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, ship, written
from .components import Forest, components

COSINE = 0.98
# Independent codes, filters of each that most vectors fall into, vectors per filter aimed at,
# longest list of a block, vectors compared with each other in one task, and rows of a
# comparison done at once.
CODES, HITS, CROWD, LIST, TILE, ROWS = 8, 3, 2.0, 1024, 4096, 256
# Members up to which all pairs of a filter are compared at once with those of other filters.
FEW = 16
SEED = 7
# Components up to which a turn is a random orthogonal matrix.
DENSE = 1024


@lru_cache(maxsize=2 * CODES)
def code(dim: int, blocks: int, size: int, number: int = 0, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Per block, ``size`` random unit vectors."""
    draw = np.random.default_rng([seed, dim, blocks, size, number])
    found = []
    for part in np.array_split(np.arange(dim), blocks):
        vectors = draw.normal(size=(size, len(part)))
        found.append((vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32))
    return tuple(found)


@lru_cache(maxsize=2 * CODES)
def turn(dim: int, number: int, seed: int = SEED) -> np.ndarray:
    """The random turn of a code: an orthogonal matrix, or three rows of signs for long vectors."""
    draw = np.random.default_rng([seed, dim, number])
    if dim > DENSE:
        return draw.choice(np.array([-1.0, 1.0]), (3, dim))
    matrix, upper = np.linalg.qr(draw.normal(size=(dim, dim)))
    return matrix * np.where(np.diag(upper) < 0, -1.0, 1.0)


def turned(vectors: np.ndarray, number: int, seed: int = SEED) -> np.ndarray:
    """Rows turned for a code. Long vectors take signs and a Hartley transform three times, which
    spreads like a random matrix and needs none."""
    by = turn(vectors.shape[1], number, seed)
    if vectors.shape[1] <= DENSE:
        return vectors @ by
    for signs in by:
        waves = np.fft.fft(vectors * signs, axis=1)
        vectors = (waves.real - waves.imag) / math.sqrt(vectors.shape[1])
    return vectors


def scores(vector: np.ndarray, lists: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    cuts = np.cumsum([c.shape[1] for c in lists])[:-1]
    return [c @ part for c, part in zip(lists, np.split(vector, cuts))]


@lru_cache(maxsize=1024)
def shape(vectors: int, dim: int, hits: int = HITS, crowd: float = CROWD) -> tuple[int, int, float]:
    """Blocks, list size and limit of a code whose filters hold about ``crowd`` of ``vectors``
    vectors: the limit that half of all random directions pass ``hits`` times."""
    filters = max(256.0, vectors * hits / crowd)
    blocks = 1
    while blocks < dim and filters ** (1 / blocks) > LIST:
        blocks += 1
    size = max(2, math.ceil(filters ** (1 / blocks)))
    lists = code(dim, blocks, size)
    draw, passed = np.random.default_rng(SEED), []
    for _ in range(100):
        vector = draw.normal(size=dim)
        sums = np.zeros(1)
        # the best sums need only the best entries of each block
        for s in scores(vector / np.linalg.norm(vector), lists):
            best = np.sort(s)[-8 * hits :]
            sums = np.sort((sums[:, None] + best[None, :]).ravel())[-8 * hits :]
        passed.append(sums[-min(hits, len(sums))])
    return blocks, size, float(np.median(passed))


def decoded(parts: list[np.ndarray], limit: float) -> np.ndarray:
    """Numbers of all directions whose block scores add up to ``limit`` or more, sorted."""
    best = [float(s.max()) for s in parts]
    total, number = np.zeros(1), np.zeros(1, np.int64)
    for b, s in enumerate(parts):
        order = np.argsort(-s)
        falling = -s[order]
        # how many entries, best first, still can reach the limit with the best of the rest
        enough = np.searchsorted(falling, total + sum(best[b + 1 :]) - limit, "right")
        each = np.repeat(np.arange(len(total)), enough)
        place = np.arange(len(each)) - np.repeat(np.cumsum(enough) - enough, enough)
        total = total[each] - falling[place]
        number = number[each] * len(s) + order[place]
    return np.sort(number)


def nearest(parts: list[np.ndarray], count: int) -> np.ndarray:
    """Numbers of the ``count`` directions with the largest sums of block scores, sorted."""
    total, number = np.zeros(1), np.zeros(1, np.int64)
    for s in parts:
        order = np.argsort(-s, kind="stable")[:count]
        number = (number[:, None] * len(s) + order).ravel()
        total = (total[:, None] + s[order]).ravel()
        best = np.argsort(-total, kind="stable")[:count]
        total, number = total[best], number[best]
    return np.sort(number)


def reached(parts: list[np.ndarray], limit: float, least: int) -> np.ndarray:
    """Directions at ``limit`` or more, or the ``least`` best ones if they are fewer."""
    found = decoded(parts, limit)
    return found if len(found) >= least else nearest(parts, least)


def filters_of(vectors: np.ndarray, blocks: int, size: int, limit: float, least: int) -> list[np.ndarray]:
    """The filters of every row of ``vectors`` in all codes, in ascending order."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    found: list[list[np.ndarray]] = [[] for _ in unit]
    for c in range(CODES):
        lists = code(unit.shape[1], blocks, size, c)
        # the directions of one block are as random without a turn
        for own, vector in zip(found, turned(unit, c) if blocks > 1 else unit):
            own.append(reached(scores(vector, lists), limit, least) + c * size**blocks)
    return [np.concatenate(own) for own in found]


def _filters(most: int, hits: int):
    """Task function: adds the list of filters to rows ``(rep, label, vector, copies)``; the code
    follows from the length of a vector and ``most``, the vectors of the largest label."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            found: list[np.ndarray] = [np.zeros(0, np.int64)] * batch.num_rows
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                for at in range(0, len(rows), ROWS):
                    some = rows[at : at + ROWS]
                    vectors = np.array(batch.column(2).take(pa.array(some)).to_pylist(), np.float64)
                    for i, own in zip(some.tolist(), filters_of(vectors, *shape(most, dim, hits), hits)):
                        found[i] = own
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.int64()))], ["rep", "label", "vector", "copies", "filters"]
            )

    return work


def compared(vectors: np.ndarray, copies: np.ndarray, earlier: list[np.ndarray], side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of the vectors of one filter (or of two tiles of it): per vector the copies linked
    to it in pairs that have no earlier filter in common, and the first vector of its set.

    ``side`` says from which tile a vector comes; with two tiles only pairs across count.
    """
    n = len(vectors)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    names, place = np.unique(np.concatenate(earlier) if n else np.zeros(0, np.int64), return_inverse=True)
    member = np.zeros((n, len(names)), np.float32)
    member[np.repeat(np.arange(n), [len(e) for e in earlier]), place] = 1
    both = side.min() != side.max()
    counts, forest = np.zeros(n, np.int64), Forest(n)
    for at in range(0, n, ROWS):
        near = unit[at : at + ROWS] @ unit.T >= cosine
        near[np.arange(len(near)), np.arange(at, at + len(near))] = False
        if both:
            near &= side[at : at + ROWS, None] != side[None, :]
        i, j = np.nonzero(near)
        if not len(i):
            continue
        forest.merge(i + at, j)
        first = near & (member[at : at + ROWS] @ member.T == 0)
        counts[at : at + ROWS] += first @ copies
    return counts, forest.label


def few_pairs(unit: np.ndarray, start: np.ndarray, size: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs within many small groups of rows at once."""
    pair = np.repeat(np.arange(len(start)), size * size)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(size * size) - size * size, size * size)
    i, j = start[pair] + place // size[pair], start[pair] + place % size[pair]
    i, j = i[i < j], j[i < j]
    near = [np.einsum("ij,ij->i", unit[i[k : k + 65536]], unit[j[k : k + 65536]]) >= cosine for k in range(0, len(i), 65536)]
    near = np.concatenate(near) if near else np.zeros(0, bool)
    return i[near], j[near]


def _links(cosine: float):
    """Task function: rows in order of (label, dim, filter, tile); gives ``(rep, first, n)``."""

    def links(rows: pa.Table, fresh: np.ndarray) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        reps, copies, side = (rows.column(c).to_numpy() for c in ("rep", "copies", "mine"))
        filters = rows.column("filters").combine_chunks()
        numbers, bounds = filters.flatten().to_numpy(), filters.value_lengths().to_numpy().cumsum()
        own = rows.column("filter").to_numpy()

        def earlier(i: int) -> np.ndarray:
            found = numbers[(bounds[i - 1] if i else 0) : bounds[i]]
            return found[: np.searchsorted(found, own[i])]

        counts, label = np.zeros(len(reps), np.int64), np.arange(len(reps))
        start = np.flatnonzero(fresh)
        size = np.diff(np.append(start, len(fresh)))
        dims = rows.column("dim").to_numpy()
        values = rows.column("vector").combine_chunks()
        ends = values.value_lengths().to_numpy().cumsum()
        flat = values.flatten().to_numpy()
        for dim in np.unique(dims).tolist():
            # groups of one length of vectors are side by side in memory
            here = dims[start] == dim
            members = np.flatnonzero(dims == dim)
            at = np.zeros(len(dims), np.int64)
            at[members] = np.arange(len(members))
            vectors = flat[(ends[members] - dim)[:, None] + np.arange(dim)].astype(np.float64)
            unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            few = here & (size > 1) & (size <= FEW)
            i, j = few_pairs(unit, at[start[few]], size[few], cosine)
            i, j = members[i], members[j]
            one_tile = np.repeat(np.maximum.reduceat(side, start) == np.minimum.reduceat(side, start), size)
            across = one_tile[i] | (side[i] != side[j])
            i, j = i[across], j[across]
            forest = Forest(len(reps))
            forest.merge(i, j)
            moved = forest.label != np.arange(len(reps))
            label[moved] = forest.label[moved]
            for x, y in zip(i.tolist(), j.tolist()):
                if not len(np.intersect1d(earlier(x), earlier(y), assume_unique=True)):
                    counts[x] += copies[y]
                    counts[y] += copies[x]
            for first, n in zip(start[here & (size > FEW)].tolist(), size[here & (size > FEW)].tolist()):
                part = slice(at[first], at[first] + n)
                before = [earlier(k) for k in range(first, first + n)]
                found, own_label = compared(vectors[part], copies[first : first + n], before, side[first : first + n], cosine)
                counts[first : first + n], label[first : first + n] = found, own_label + first
        told = (counts > 0) | (label != np.arange(len(reps)))
        return pa.RecordBatch.from_arrays([pa.array(reps[told]), pa.array(reps[label[told]]), pa.array(counts[told])], ["rep", "first", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            fresh = changes(held)
            # the last filter may go on in the next batch
            cut = int(np.flatnonzero(fresh)[-1])
            if cut:
                yield links(held.slice(0, cut), fresh[:cut])
                held = held.slice(cut)
        if held is not None:
            yield links(held, changes(held))

    return work


def changes(rows: pa.Table) -> np.ndarray:
    """Where a new (label, dim, filter, tile) begins."""
    fresh = np.ones(rows.num_rows, bool)
    label = rows.column("label").combine_chunks().dictionary_encode()
    codes = (label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy()
    keys = [codes, *(rows.column(c).to_numpy() for c in ("dim", "filter", "tile"))]
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return fresh


def cap_links(reps: DataFrame, cosine: float = COSINE, hits: int = HITS, tile: int = TILE) -> DataFrame:
    """``(rep, first, n)``: parts of link counts and links that connect what is connected, for
    distinct vectors ``(rep, label, vector, copies)``. Rows are at most one per vector and filter."""
    spark = reps.sparkSession
    ship(spark)
    # the code grows with the largest label, so that a filter stays as crowded as it is
    top = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    kind = reps.schema["vector"].dataType.simpleString()
    fields = f"rep bigint, label string, vector {kind}, copies bigint, filters array<bigint>"
    filtered = reps.select("rep", "label", "vector", "copies").mapInArrow(_filters(top, hits), fields)
    filtered = written(filtered.withColumn("dim", F.size("vector")), "filters")
    key = ["label", "dim", "filter"]
    entries = filtered.select("rep", "label", "dim", F.explode("filters").alias("filter"))
    crowds = written(entries.groupBy(*key).count().where("count > 1"), "crowds")
    tiles = F.when(F.col("count") > tile, F.ceil(F.col("count") * 2 / F.lit(tile))).otherwise(1).cast("int")
    members = entries.join(crowds.withColumn("tiles", tiles), key)
    mine = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    # every two tiles meet once; a tile meets itself in a tile pair of its own
    meets = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda other: F.least("mine", other) * F.col("tiles") + F.greatest("mine", other),
    )
    members = members.withColumn("mine", mine).select("rep", "filter", "mine", F.explode(meets).alias("tile"))
    members = members.join(filtered, "rep")
    dealt = members.repartition(partitions(spark), *key, "tile").sortWithinPartitions(*key, "tile", "rep")
    return dealt.select("rep", *key, "tile", "mine", "vector", "copies", "filters").mapInArrow(_links(cosine), "rep bigint, first bigint, n bigint")


def near_vectors(
    table: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, hits: int = HITS
) -> DataFrame:
    """``id, n_links, component_id, kept`` of every row.

    Rows are linked if their labels are equal and not null, their vectors have the same number of components,
    and the cosine in double precision is at least ``cosine``. A vector that is null, empty, zero
    or holds a null or non-finite component is linked with nothing. Rows with equal vectors and
    labels are compared as one and linked with each other. ``component_id`` is the smallest
    id that links reach. A row with a null id is linked and counted, but names a component (null)
    only if no other row is in it. Other columns are ignored; an empty table gives an empty table.
    """
    rows = table.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    sound = F.coalesce(F.col("label").isNotNull() & sound, F.lit(False))
    valid = rows.where(sound)
    reps = valid.groupBy("label", "vector").agg(F.min("id").alias("smallest"), F.count(F.lit(1)).alias("copies"))
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    links = written(cap_links(reps.select("rep", "label", "vector", "copies"), cosine, hits), "links")
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(links.select(F.col("rep").alias("a"), F.col("first").alias("b")))
    known = reps.join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.withColumn("root", F.coalesce("root", "rep"))
    known = written(known.withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("copies") - 1), "known")
    smallest = written(known.groupBy("root").agg(F.min("smallest").alias("component_id")), "smallest")
    named = known.join(smallest, "root").select("label", "vector", "n_links", "component_id")
    found = valid.join(named, ["label", "vector"]).select("id", "n_links", "component_id")
    lone = rows.where(~sound).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    every = found.unionByName(lone)
    return every.select(F.col("id").alias(id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
