"""MinHash fingerprints, near-duplicate classes, and fingerprints of edited texts.

The shingles of a text are runs of five words. Each of 128 universal hash functions keeps the
smallest value over all shingles; the share of equal slots of two fingerprints estimates the
Jaccard similarity of their shingle sets. Texts that agree on a whole band of slots meet in
Spark, and the Jaccard similarity of every link is computed from the shingle sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, ship, strings, written
from .components import components
from .pieces import Memory

SHINGLE, SLOTS, SEED, SIMILAR = 5, 128, 1, 0.8
# Bands and slots of each; a pair at similarity 0.8 shares one with probability 0.9996.
BANDS, BAND_SLOTS = 20, 5
# Bands looked at per round: links found in one round spare the next the texts they join.
ROUNDS = (1, 3, 16)
# Shingles hashed at once, texts compared with each other in one task, rows that may be broadcast.
AT_ONCE, TILE, BROADCAST = 1024, 4096, 1_000_000


@lru_cache(maxsize=2)
def functions(slots: int = SLOTS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of ``slots`` permutations x -> a x + b of the 32-bit numbers."""
    draw = np.random.default_rng(seed)
    a = draw.integers(0, 2**32, slots, np.uint32) | np.uint32(1)
    return a[:, None], draw.integers(0, 2**32, slots, np.uint32)[:, None]


_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(SHINGLE)]
_words = Memory(xxhash.xxh64_intdigest)


def shingles(text: str) -> np.ndarray:
    """32-bit hashes of the distinct runs of five words (all words if fewer; none: empty)."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint32)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    runs = sum(h[k : len(h) - width + 1 + k] * _POWERS[k] for k in range(width))
    runs ^= runs >> np.uint64(29)
    return np.unique((runs * _POWERS[0] >> np.uint64(32)).astype(np.uint32))


def signature(found: np.ndarray) -> np.ndarray:
    """16 bits per slot, mixed from the smallest hash value; no shingles give all ones."""
    a, b = functions()
    least = np.full(SLOTS, ~np.uint32(0))
    for at in range(0, len(found), AT_ONCE):
        np.minimum(least, (a * found[None, at : at + AT_ONCE] + b).min(axis=1), out=least)
    if not len(found):
        return np.full(SLOTS, 0xFFFF, np.uint16)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def shown(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), body.alias("text"))
    return rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), F.col("text"))})


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs = [signature(shingles(t)).tobytes() for t in strings(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(sigs, pa.binary())], ["id", "h1", "h2", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = [shingles(t).tobytes() for t in strings(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["rep", "found"])


def similar_trees(sets: list[np.ndarray], similar: float) -> Iterator[tuple[int, int]]:
    """Tree links between sets of Jaccard similarity ``similar`` or more.

    Searches from one set to all that no tree holds yet; every link is a computed similarity,
    and two sets that are similar end in the same tree.
    """
    size = np.array([len(s) for s in sets])
    left = np.arange(len(sets))
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            x = todo.pop()
            joined = np.concatenate([sets[i] for i in left])
            # sets are sorted, so membership is a search
            place = np.minimum(np.searchsorted(sets[x], joined), max(size[x] - 1, 0))
            hit = sets[x][place] == joined if size[x] else np.zeros(len(joined), bool)
            ends = np.cumsum(size[left])
            total = np.concatenate(([0], np.cumsum(hit)))
            common = total[ends] - total[ends - size[left]]
            either = size[left] + size[x] - common
            near = common >= similar * either - 1e-9
            for y in left[near].tolist():
                yield x, y
                todo.append(y)
            left = left[~near]


def _verified(similar: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        key, out = None, []

        def close() -> None:
            if len(held) > 1:
                out.extend((held[x][0], held[y][0]) for x, y in similar_trees([s for _, s in held], similar))
            held.clear()

        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for own, rep, found in zip(keys, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if own != key:
                    close()
                    key = own
                held.append((rep, np.frombuffer(found, np.uint32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return work


def small(df: DataFrame, rows: int = BROADCAST) -> DataFrame:
    """Mark narrow rows for broadcast if their number is small enough."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", similar: float = SIMILAR, tile: int = TILE) -> DataFrame:
    """``(id, h1, h2, sig, class_id)``: fingerprints and near-duplicate classes of all rows.

    ``class_id`` is the smallest id that links of Jaccard similarity ``similar`` or more reach;
    ``h1, h2`` are hashes of the text. Equal texts are one from the start. Texts of one band
    are compared by searches that stop at what is already joined; bands are taken in rounds, and
    a later round sees only bands that hold texts of different classes. Two texts of a band with
    more than ``tile`` texts meet tile by tile. No pairs leave a task but the links of trees.
    Texts without words are one class.
    """
    spark = docs.sparkSession
    ship(spark)
    keyed = _keyed(docs, id, text)
    prints = written(keyed.mapInArrow(_signatures, "id bigint, h1 bigint, h2 bigint, sig binary"), "prints")
    reps = prints.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.any_value("sig").alias("sig"))
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "texts")
    width = 2 * BAND_SLOTS
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * width + 1, width)) for b in range(BANDS)])
    entries = reps.select("rep", F.posexplode(keys).alias("band", "key"))
    crowds = written(entries.groupBy("key").count().where("count > 1"), "bands")
    members = written(entries.join(crowds, "key"), "members")
    known = small(members.select("rep").distinct().join(reps.select("rep", "h1", "h2", "first"), "rep"))
    same = ["h1", "h2"]
    own = keyed.join(known, same).where(F.col("id").eqNullSafe(F.col("first"))).select("rep", "text")
    sets = own.mapInArrow(_sets, "rep bigint, found binary").groupBy("rep").agg(F.any_value("found").alias("found"))
    sets = written(sets, "sets")
    links: list[DataFrame] = []
    roots, start = None, 0
    for bands in ROUNDS:
        now = members.where(F.col("band").between(start, start + bands - 1))
        start += bands
        if roots is not None:
            labelled = now.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
            split = labelled.groupBy("key").agg(F.min(F.coalesce("root", "rep")).alias("a"), F.max(F.coalesce("root", "rep")).alias("b"))
            now = now.join(split.where("a <> b").select("key"), "key", "left_semi")
        tiles = F.ceil(F.col("count") * 2 / F.lit(tile)).cast("int")
        now = now.withColumn("tiles", F.when(F.col("count") > tile, tiles).otherwise(1))
        now = now.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
        meets = F.transform(
            F.sequence(F.lit(0), F.col("tiles") - 1),
            lambda other: F.least("mine", other) * F.col("tiles") + F.greatest("mine", other),
        )
        dealt = now.select("rep", "key", F.explode(meets).alias("tile")).join(sets, "rep")
        dealt = dealt.repartition(partitions(spark), "key", "tile").sortWithinPartitions("key", "tile", "rep")
        links.append(written(dealt.select("key", "tile", "rep", "found").mapInArrow(_verified(similar), "a bigint, b bigint"), "links"))
        roots = components(reduce(DataFrame.unionByName, links))
    joined = reps.join(roots.withColumnRenamed("node", "rep"), "rep").select("root", "h1", "h2", "first")
    joined = written(joined, "joined")
    smallest = written(joined.groupBy("root").agg(F.min("first").alias("class_id")), "smallest")
    # a text in no class of several is its own: found by its hashes, equal texts included
    in_classes = joined.join(smallest, "root").select("h1", "h2", "class_id")
    alone = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left_anti").select("h1", "h2", F.col("first").alias("class_id"))
    every = written(in_classes.unionByName(alone), "classes")
    return prints.join(every, ["h1", "h2"]).select("id", "h1", "h2", "sig", "class_id")


ROW = "pid int, tail int, id bigint, h1 bigint, h2 bigint, kind int, body binary, class_id bigint"


def _packed(cuts: list[int]):
    """Task function: text rows ``(id, text, h1, h2)`` to compressed rows with their place."""
    edges = np.array(cuts, np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            n = batch.num_rows
            bodies = [squeeze.compress(t.encode()) for t in strings(batch.column(1))]
            zero = pa.array(np.zeros(n, np.int32))
            yield pa.RecordBatch.from_arrays(
                [_place(batch.column(0), edges), zero, batch.column(0), batch.column(2), batch.column(3),
                 pa.array(np.ones(n, np.int32)), pa.array(bodies, pa.binary()), pa.nulls(n, pa.int64())],
                ["pid", "tail", "id", "h1", "h2", "kind", "body", "class_id"],
            )

    return work


def _place(ids: pa.Array, edges: np.ndarray) -> pa.Array:
    """Partition of an id: the first holds the largest ids, the last also the nulls."""
    values = ids.fill_null(0).to_numpy(zero_copy_only=False)
    place = len(edges) - np.searchsorted(edges, values, "right")
    place[~ids.is_valid().to_numpy(zero_copy_only=False)] = len(edges)
    return pa.array(place.astype(np.int32))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in descending order of ids, each text behind a row with its fingerprint and class, and at the end
    the text that follows the last one."""
    open_ = zstandard.ZstdDecompressor()
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    waiting, pid, own_class, own_sig, out = None, None, None, None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(7 + 1)]
        for place, tail, id, _, _, kind, body, class_id in zip(*columns):
            if place != pid:
                waiting, pid = None, place
            if kind == 0:
                own_class, own_sig = class_id, np.frombuffer(body, np.uint16)
                continue
            text = open_.decompress(body, max_output_size=1 << 31).decode() if body else ""
            sig = signature(shingles(text)) if tail else own_sig
            if waiting is not None:
                last_id, last_text, last_sig, last_class = waiting
                half = len(last_text) // 2
                edited = last_text[: len(last_text) - half] + text[:half]
                changed = signature(shingles(edited))
                out.append(
                    (last_id, len(last_text), sha256(edited.encode()).hexdigest(), shown(last_sig), shown(changed),
                     likeness(last_sig, changed), likeness(last_sig, sig), last_class)
                )
            waiting = None if tail else (id, text, sig, own_class)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def fingerprint_edits(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id``.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the
    first as many (or all there are) of the next text in descending order of ids; after the last comes the first. ``near_edited``
    and ``near_next`` compare the fingerprint with that of the edited and of the next text.
    A null text is empty; empty texts have equal fingerprints and likeness 1 with each other.
    Null ids come last; rows that share an id follow each other by the hash of their texts. A lone
    row is its own next. An empty table gives an empty table; other columns are ignored.

    Rows travel once, compressed, to ranges of ids; the text behind the end of a range is
    found by its id and sent along, so ranges do not wait for each other.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, id, text)
    named = written(classes(docs, id, text), "class-of")
    parts = partitions(spark)
    quantiles = [i / parts for i in range(1, parts)]
    found = named.where("id is not null").approxQuantile("id", quantiles, 0.1 / parts) if quantiles else []
    cuts = sorted({int(x) for x in found})
    edges = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    above = F.size(F.filter(edges, lambda c: c > F.col("id")))
    placed = named.withColumn("pid", F.when(F.col("id").isNull(), len(cuts)).otherwise(above).cast("int"))
    # the row a range starts with follows the range in front of it: one row per range
    order = F.struct(F.col("id").isNull().alias("last"), (-F.col("id")).alias("down"), "h1", "h2")
    heads = sorted((r.pid, r.head) for r in placed.groupBy("pid").agg(F.min(order).alias("head")).collect())
    ends = [(heads[i - 1][0], None if h.last else -h.down, h.h1, h.h2) for i, (_, h) in enumerate(heads)]
    tails = spark.createDataFrame(ends, "to int, id bigint, h1 bigint, h2 bigint").withColumnsRenamed({"id": "tid", "h1": "t1", "h2": "t2"})
    packed = keyed.mapInArrow(_packed(cuts), ROW)
    follows = F.col("id").eqNullSafe(F.col("tid")) & (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2"))
    first_rows = keyed.join(F.broadcast(tails), follows).select("id", "text", "h1", "h2", "to")
    behind = first_rows.select("id", "text", "h1", "h2").mapInArrow(_packed(cuts), ROW)
    behind = behind.join(F.broadcast(tails), follows).select(F.col("to").alias("pid"), F.lit(1).alias("tail"), "id", "h1", "h2", "kind", "body", "class_id")
    marks = placed.select("pid", F.lit(0).alias("tail"), "id", "h1", "h2", F.lit(0).alias("kind"), F.col("sig").alias("body"), "class_id")
    rows = packed.unionByName(marks).unionByName(behind)
    rows = rows.repartitionById(len(cuts) + 1, F.col("pid"))
    rows = rows.sortWithinPartitions("pid", "tail", F.col("id").desc_nulls_last(), "h1", "h2", "kind")
    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id bigint"
    return rows.mapInArrow(_edited, schema).withColumnRenamed("id", id)
