"""Ranked lexical search the other way round: the items are indexed and the documents stream by.

The inverted index over the items' terms is small and goes to every task. A document's counts of
those terms run through it and update one bounded heap per item; the heaps of all tasks are merged
in Spark. Nothing about a document leaves its task but what stands in a heap.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, ship, strings, written

TOP = 20
# Different (item, term) pairs of one index; more items make more indexes, used one after the other.
POSTINGS = 500_000
# Scores held at once in a task (documents times items), and postings opened at once.
SCORES, OPENED = 2_000_000, 2_000_000

_SEPARATED = bytes(32 if i <= 0x2F or 0x3A <= i <= 0x40 or 0x5B <= i <= 0x60 or 0x7B <= i <= 0x7F else i for i in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of digits, letters and anything beyond ASCII; A-Z lower-cased."""
    return text.encode().lower().translate(_SEPARATED).split()


class _Down:
    """An id that compares the other way round; null comes last of all."""

    __slots__ = ("id",)

    def __init__(self, id):
        self.id = id

    def __lt__(self, other: _Down) -> bool:
        if self.id is None or other.id is None:
            return self.id is None and other.id is not None
        return self.id > other.id

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Down) and self.id == other.id


class Heaps:
    """The ``size`` best ``(score, id)`` per item: higher scores first, equal ones by ascending id."""

    def __init__(self, items: int, size: int):
        self.size = size
        self.heaps: list[list[tuple[int, _Down]]] = [[] for _ in range(items)]
        # a score has to reach this to enter
        self.least = np.ones(items, np.int64)

    def add(self, scores: np.ndarray, ids: list) -> None:
        """``scores[document, item]``; 0 is no match."""
        while True:
            row, item = np.nonzero(scores >= self.least)
            if not len(row):
                return
            # one item's scores from the highest down: the heap fills with its best at once
            order = np.lexsort((-scores[row, item], item))
            for r, i in zip(row[order].tolist(), item[order].tolist()):
                heap, score = self.heaps[i], int(scores[r, i])
                if len(heap) < self.size:
                    heapq.heappush(heap, (score, _Down(ids[r])))
                elif score >= heap[0][0]:
                    heapq.heappushpop(heap, (score, _Down(ids[r])))
                if len(heap) == self.size:
                    self.least[i] = heap[0][0]
            return

    def rows(self) -> tuple[list[int], list, list[int]]:
        found = [(item, down.id, score) for item, heap in enumerate(self.heaps) for score, down in heap]
        return tuple(map(list, zip(*found))) if found else ([], [], [])


@dataclass
class Index:
    """Postings of one block of items: term t has ``item`` and ``times`` at ``begin[t] : begin[t + 1]``."""

    items: list[int]
    weight: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    times: np.ndarray

    def scores(self, doc: np.ndarray, term: np.ndarray, worth: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` documents: entry k says that ``term[k]`` is worth ``worth[k]`` in ``doc[k]``."""
        out = np.zeros(n * len(self.items), np.int64)
        size = self.begin[term + 1] - self.begin[term]
        ends = np.cumsum(size)
        start = 0
        while start < len(term):
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + OPENED, "right"))
            stop = max(stop, start + 1)
            s = size[start:stop]
            first = np.repeat(self.begin[term[start:stop]] - (np.cumsum(s) - s), s)
            at = first + np.arange(len(first))
            np.add.at(out, np.repeat(doc[start:stop], s) * len(self.items) + self.item[at], np.repeat(worth[start:stop], s) * self.times[at])
            start = stop
        return out.reshape(n, len(self.items))


def _counted(vocabulary: dict[bytes, int]):
    """Task function: ``(id, text)`` to the number of terms and the counts of those in ``vocabulary``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in batches:
            n, found, counts = [], [], []
            for value in strings(batch.column(1)):
                split = terms(value)
                n.append(len(split))
                tally = Counter(split)
                both = sorted((vocabulary[t], tally[t]) for t in tally.keys() & known)
                found.append([t for t, _ in both])
                counts.append([c for _, c in both])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                ["id", "n", "terms", "counts"],
            )

    return work


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the n + 1 offsets of its rows."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _heaped(index: Index, size: int):
    """Task function: ``(id, m, terms, counts)`` to the rows of the task's heaps."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, kind = Heaps(len(index.items), size), None
        portion = max(1, SCORES // max(1, len(index.items)))
        for batch in batches:
            kind = batch.schema.field(0).type
            for start in range(0, batch.num_rows, portion):
                part = batch.slice(start, portion)
                m = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                term, ends = _flat(part.column(2))
                tf, _ = _flat(part.column(3))
                doc = np.repeat(np.arange(part.num_rows), np.diff(ends))
                tf, term = tf.astype(np.int64), term.astype(np.int64)
                worth = index.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                heaps.add(index.scores(doc, term, worth, part.num_rows), part.column(0).to_pylist())
        if kind is not None:
            item, ids, score = heaps.rows()
            item = [index.items[i] for i in item]
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, kind), pa.array(score, pa.int64())], ["item", "id", "score"])

    return work


def _blocks(entries: DataFrame, postings: int) -> int:
    """How many blocks deal the items so that each holds at most ``postings`` entries, or a single item."""
    total = entries.count()
    blocks = max(1, -(-total // postings))
    while True:
        by = entries.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"))
        crowded = by.agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("a"), F.max("item").alias("b"))
        if crowded.where((F.col("n") > postings) & (F.col("a") < F.col("b"))).isEmpty():
            return blocks
        blocks *= 2


def search(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    top: int = TOP, postings: int = POSTINGS,
) -> DataFrame:
    """``item_id, rank, id, score``: the ``top`` documents of every item with a score above 0.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. N counts the documents with
    a term, L all their terms, df the documents that hold a term, n a document's terms, tf a term's count there:

        w = floor(1000 ln((2 N + 2) / (2 df + 1)))          m = 75 + (25 n N) div L
        score = sum over the item's terms, repeats included, of w ((10^9 tf) div (1000 tf + 12 m))

    Ranks start at 1 and are unique; equal scores go by ascending id (null last). Null and empty texts hold no
    terms: such documents are never found and such items find nothing. Every row of ``items`` is an item of
    its own and every row of ``docs`` a document, also if ids repeat or are null. Empty tables give an empty table;
    other columns are ignored.

    Items are dealt to indexes of at most ``postings`` different (item, term) pairs (or one item), which bounds what is sent
    to the tasks. Per index the texts are read once: their counts of the index's terms are written to the shared
    folder, from which the corpus figures and then the scores are taken.
    """
    spark = docs.sparkSession
    ship(spark)
    asked = columns(items, item_id=item_id, text=item_text).withColumn("item", F.monotonically_increasing_id())
    asked = written(asked, "items")

    def entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, value in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                found = Counter(terms(value))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(found), pa.int64()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                    ["item", "term", "times"],
                )

    entries = written(asked.select("item", "text").mapInArrow(entries_of, "item bigint, term binary, times bigint"), "item-terms")
    blocks = _blocks(entries, postings)
    narrow = columns(docs, id=id, text=text)
    kind = narrow.schema[0].dataType.simpleString()
    heaps = []
    for block in range(blocks):
        mine = entries.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow().to_pydict()
        vocabulary = {t: k for k, t in enumerate(sorted(set(mine["term"])))}
        rows = sorted(zip((vocabulary[t] for t in mine["term"]), mine["item"], mine["times"]))
        numbers = sorted(set(mine["item"]))
        place = {item: k for k, item in enumerate(numbers)}
        counted = narrow.mapInArrow(_counted(vocabulary), f"id {kind}, n bigint, terms array<int>, counts array<bigint>")
        counted = written(counted.where("n > 0"), "term-counts")
        whole = counted.agg(F.count(F.lit(1)).alias("N"), F.sum("n").cast("bigint").alias("L")).first()
        if not whole.N or not rows:
            continue
        holding = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        rarity = F.floor(1000 * F.log(F.lit(2 * whole.N + 2).cast("double") / (2 * F.col("df") + 1))).alias("w")
        weight = np.zeros(len(vocabulary), np.int64)
        for r in holding.select("term", rarity).collect():  # at most one row per posting
            weight[r.term] = r.w
        begin = np.searchsorted([t for t, _, _ in rows], np.arange(len(vocabulary) + 1))
        index = Index(numbers, weight, begin, np.array([place[i] for _, i, _ in rows]), np.array([c for _, _, c in rows], np.int64))
        # decimals: 25 n N may pass 64 bits before it is divided
        m = F.expr(f"75 + cast(25 * n as decimal(20, 0)) * cast({whole.N} as decimal(18, 0)) div cast({whole.L} as decimal(20, 0))")
        streamed = counted.where(F.size("terms") > 0).select("id", m.cast("bigint").alias("m"), "terms", "counts")
        heaps.append(streamed.mapInArrow(_heaped(index, top), f"item bigint, id {kind}, score bigint"))
    if not heaps:
        nothing = columns(items, item_id=item_id).join(narrow.select("id").limit(0), F.lit(True))
        return nothing.select(F.col("item_id").alias(item_id), F.lit(0).alias("rank"), F.col("id").alias(id), F.lit(0).cast("bigint").alias("score")).limit(0)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = reduce(DataFrame.unionByName, heaps).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    named = ranked.join(asked.select("item", "item_id"), "item")
    return named.select(F.col("item_id").alias(item_id), "rank", F.col("id").alias(id), "score")
