"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints that differ in at most ``distance`` bits agree on at least one of
``distance + 1`` blocks of bits. The pattern under each block's mask is an upper node of the
index; these nodes are spread over the cluster. Below a node, fingerprints are sorted by Gray
rank (neighbours in that order differ little), runs of neighbours form nodes that hold the bits
all their members share, and the tree is joined with itself from the top: a pair of nodes
carries the differences counted so far and is dropped, with everything under it, as soon as
they exceed the distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, partitions, ship, spare, strings, written
from .components import Forest, components

SHINGLE, DISTANCE, SEED = 4, 4, 42
# Fingerprints under one upper node before it is split by further bits, children of a node below
# it, pairs of nodes compared at once, and shingles hashed at once.
NODE_ROWS, FANOUT, PAIRS, SHINGLES = 4096, 8, 1 << 20, 1 << 16
# At most this many splits; a node that is still too large is compared tile by tile.
SPLITS = 3


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit ``hashes`` have each bit set, lowest bit first."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = len(bits) // 255 * 255
    # sums of 255 rows fit a byte
    blocks = bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8)
    return blocks.sum(axis=0, dtype=np.int64) + bits[full:].sum(axis=0, dtype=np.int64)


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; a bit is set if it is set in over half of the hashes of the word shingles.

    A-Z are lower-cased, words are what ASCII white space separates, repeated shingles count
    each time, fewer words than ``shingle`` are one shingle, no words give 0.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    width = min(shingle, len(words))
    first, last = start[: len(words) - width + 1], (start + size)[width - 1 :]
    digest, total, counts = xxhash.xxh64_intdigest, len(first), np.zeros(64, np.int64)
    for at in range(0, total, SHINGLES):
        ends = zip(first[at : at + SHINGLES].tolist(), last[at : at + SHINGLES].tolist())
        counts += bit_counts(np.array([digest(body[s:e], seed) for s, e in ends], np.uint64))
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, bits)``: the fingerprint of every row's text as a signed long. Null is empty."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(v, shingle) for v in strings(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["id", "bits"])

    narrow = columns(docs, id=id, text=text)
    return narrow.mapInArrow(work, f"id {narrow.schema[0].dataType.simpleString()}, bits bigint")


def masks(level: int, distance: int = DISTANCE) -> list[int]:
    """Masks of the upper nodes: every pair within ``distance`` agrees on one of them.

    Each level splits the bits left over by the level above into ``distance + 1`` blocks.
    """
    found = [0]
    for _ in range(level):
        deeper = []
        for mask in found:
            left = [i for i in range(64) if not mask >> i & 1]
            for block in np.array_split(np.array(left), distance + 1):
                deeper.append(mask | sum(1 << int(i) for i in block))
        found = deeper
    return found


def gray_rank(bits: Column) -> Column:
    """Position of a bit pattern in the reflected Gray sequence."""
    return reduce(lambda x, n: x.bitwiseXOR(F.shiftrightunsigned(x, n)), (1, 2, 4, 8, 16, 32), bits)


def under(rows: DataFrame, level: int, distance: int) -> DataFrame:
    """Every fingerprint once under each of its upper nodes ``(level, mask, pattern)``."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(level, distance)]
    patterns = F.array(*[F.col("bits").bitwiseAND(F.lit(m).cast("bigint")) for m in signed])
    return rows.select("bits", F.posexplode(patterns).alias("mask", "pattern")).withColumn("level", F.lit(level))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


class GrayTree:
    """Index of fingerprints that are sorted by (upper node, Gray rank).

    ``heads`` are the first positions of the upper nodes. Level 0 holds the fingerprints, each
    level above the bits that up to ``FANOUT`` neighbours share and their common pattern, until
    every upper node has one root.
    """

    def __init__(self, bits: np.ndarray, heads: np.ndarray):
        self.levels = [(np.full(len(bits), ~np.uint64(0)), bits)]
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        heads = np.append(heads, len(bits))
        while True:
            sizes = np.diff(heads)
            if (sizes <= 1).all():
                break
            parts = -(-sizes // FANOUT)
            firsts = np.concatenate(([0], np.cumsum(parts)))
            node = np.arange(firsts[-1])
            group = np.repeat(np.arange(len(sizes)), parts)
            start = heads[:-1][group] + (node - firsts[:-1][group]) * FANOUT
            end = np.minimum(start + FANOUT, heads[1:][group])
            mask, pattern = self.levels[-1]
            ones = np.bitwise_and.reduceat(pattern, start)
            any_one = np.bitwise_or.reduceat(pattern, start)
            shared = np.bitwise_and.reduceat(mask, start) & ~(ones ^ any_one)
            self.levels.append((shared, ones & shared))
            self.children.append((start, end))
            heads = firsts
        self.roots = heads[:-1]

    def close_pairs(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions at ``distance`` or less, in portions of bounded size."""
        top = len(self.children)
        if not top:
            return
        zero = np.zeros(len(self.roots), np.uint64)
        stack = [(top, self.roots, self.roots, zero.astype(np.int16), zero)]
        while stack:
            level, x, y, differences, counted = stack.pop()
            if len(x) > 1 and len(x) * FANOUT * FANOUT > PAIRS:
                half = len(x) // 2
                stack.append((level, x[half:], y[half:], differences[half:], counted[half:]))
                stack.append((level, x[:half], y[:half], differences[:half], counted[:half]))
                continue
            if level == 0:
                yield x, y
                continue
            start, end = self.children[level - 1]
            nx, ny = end[x] - start[x], end[y] - start[y]
            total = nx * ny
            pair = np.repeat(np.arange(len(x)), total)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(total) - total, total)
            cx, cy = start[x][pair] + place // ny[pair], start[y][pair] + place % ny[pair]
            once = cx < cy if level == 1 else cx <= cy
            pair, cx, cy = pair[once], cx[once], cy[once]
            mask, pattern = self.levels[level - 1]
            both = mask[cx] & mask[cy]
            more = differences[pair] + popcount((pattern[cx] ^ pattern[cy]) & both & ~counted[pair])
            near = more <= distance
            stack.append((level - 1, cx[near], cy[near], more[near], both[near]))


def _linked(distance: int):
    """Task function: rows ``(level, mask, pattern, tile, bits)`` in order of their upper node
    and Gray rank; gives a tree of links ``(a, b)`` per connected set under a node."""

    def links(batch: pa.Table) -> pa.RecordBatch:
        keys = [batch.column(i).to_numpy() for i in range(4)]
        bits = batch.column(4).to_numpy().view(np.uint64)
        fresh = np.ones(len(bits), bool)
        fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        forest = Forest(len(bits))
        for i, j in GrayTree(bits, np.flatnonzero(fresh)).close_pairs(distance):
            forest.merge(i, j)
        moved = np.flatnonzero(forest.label != np.arange(len(bits)))
        a, b = bits[moved].view(np.int64), bits[forest.label[moved]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last upper node may go on in the next batch
            keys = [batch.column(i).to_numpy() for i in range(4)]
            other = np.logical_or.reduce([k != k[-1] for k in keys])
            cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if held:
                last = [held[-1].column(i)[-1].as_py() for i in range(4)]
                if [k[0] for k in keys] != last:
                    yield links(pa.Table.from_batches(held))
                    held = []
            if cut:
                yield links(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield links(pa.Table.from_batches(held))

    return work


def close_links(distinct: DataFrame, distance: int = DISTANCE, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints ``bits`` within ``distance`` of each other.

    Every pair within the distance is found; of the pairs found under one upper node a spanning
    tree is returned, so the links grow with the fingerprints and not with their pairs. An upper
    node with over ``node_rows`` fingerprints is split by further bits, and one that no bits can
    split well (a dense cloud) into tiles of which every two meet in a task.
    """
    spark = distinct.sparkSession
    ship(spark)
    key, rank = ["level", "mask", "pattern"], gray_rank(F.col("bits"))
    level, total = 1, distinct.count()
    while level < SPLITS and total / 2 ** bin(masks(level, distance)[0]).count("1") > node_rows / 2:
        level += 1
    parts: list[DataFrame] = []
    rows = distinct.select("bits")
    while True:
        placed = under(rows, level, distance)
        sizes = placed.groupBy(*key).count()
        large = written(sizes.where(F.col("count") > node_rows), "large")
        if large.isEmpty():
            parts.append(placed.withColumn("tile", F.lit(0)))
            break
        parts.append(placed.join(large, key, "left_anti").withColumn("tile", F.lit(0)))
        crowded = placed.join(large, key)
        if level < SPLITS:
            rows = written(crowded.select("bits").distinct(), "crowded")
            level += 1
            continue
        # tiles of half the size, so that two fit
        n = F.ceil(F.col("count") * 2 / F.lit(node_rows)).cast("int")
        mine = F.pmod(F.xxhash64("bits"), n).cast("int")
        tiled = crowded.withColumn("n", n).withColumn("mine", mine)
        pair = F.transform(
            F.sequence(F.lit(0), F.col("n") - 1),
            lambda other: F.least("mine", other) * F.col("n") + F.greatest("mine", other),
        )
        parts.append(tiled.select("bits", "mask", "pattern", "level", F.explode(pair).alias("tile")))
        break
    nodes = reduce(DataFrame.unionByName, parts)
    key = [*key, "tile"]
    dealt = nodes.select(*key, "bits").repartition(partitions(spark), *key)
    ordered = dealt.sortWithinPartitions(*key, rank)
    return ordered.mapInArrow(_linked(distance), "a bigint, b bigint")


def named_components(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(bits, component_id)`` of every fingerprint in ``prints (id, bits)``: the smallest id of its component."""
    distinct = written(prints.groupBy("bits").agg(F.min("id").alias("first")), "distinct")
    linked = components(close_links(distinct, distance)).select(F.col("node").alias("bits"), "root")
    members = written(distinct.join(linked, "bits"), "members")
    smallest = written(members.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    in_groups = members.join(smallest, "root").select("bits", "component_id")
    alone = distinct.join(linked, "bits", "left_anti").select("bits", F.col("first").alias("component_id"))
    return in_groups.unionByName(alone)


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """``id, fingerprint, component_id`` for every row.

    Rows whose fingerprints differ in at most ``distance`` bits are linked; ``component_id`` is
    the smallest id that links reach. A null or empty text, or one without words, has
    fingerprint zero and is linked like any other. A row with a null id is linked too, but names
    a component (null) only if no other row is in it. Repeated rows come back as often as they
    went in; an empty table gives an empty table; other columns are ignored.
    """
    prints = written(fingerprints(docs, id, text, shingle), "fingerprints")
    named = written(named_components(prints, distance), "named")
    shown = F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint")
    return prints.join(named, "bits").select(F.col("id").alias(id), shown, "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs``, one per component: that with the smallest id, null ids last; of rows
    that share it, the one whose text has the smallest hash. All columns stay as they are."""
    key, none, one, two, row = (spare(docs, c) for c in ("_key", "_none", "_one", "_two", "_row"))
    column, body = F.col(f"`{id}`"), F.col(f"`{text}`")
    # two hashes tell the texts of one id apart
    told = [column.isNull().alias(none), F.xxhash64(body).alias(one), F.xxhash64(F.lit(SEED), body).alias(two)]
    ranked = docs.select(F.struct(told[0], column.alias(key), *told[1:]).alias(key), body)
    prints = written(fingerprints(ranked, key, text, shingle), "fingerprints")
    named = F.coalesce(F.col(key).cast("string"), F.lit("")).alias(key)
    first = named_components(prints, distance).select("component_id.*")
    # rows with one key have one text, so every component keeps one row
    kept = written(first.select(named, none, one, two).distinct(), "kept")
    marked = docs.select("*", F.coalesce(column.cast("string"), F.lit("")).alias(key), *told)
    # texts travel once, at any size: the window finds them where the join has put them
    stays = marked.join(kept.hint("merge"), [key, none, one, two], "left_semi")
    place = F.row_number().over(Window.partitionBy(key, none, one, two).orderBy(two))
    return stays.withColumn(row, place).where(F.col(row) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
