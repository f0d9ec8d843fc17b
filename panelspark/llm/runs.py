"""Periodic runs of words, found by uniting suffix classes in descending order of common prefixes.

Suffixes of a text that share their first l words form a class. Neighbours in suffix order are
united from the longest common prefix (LCP) down, as Kruskal's algorithm unites the ends of the
heaviest edges, with union-find over ordered sets of positions. Two positions that become
neighbours in a united set, d words apart at LCP l, start a stretch of l + d words with period d.
A run of length L and smallest period q is the pair (start, start + q) at l = L - q: any position
between them in their class would give the stretch a smaller period. So every run is seeded once,
at its own start, and with its smallest period.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, ship, strings

# A run has at least this many words and periods.
WORDS, PERIODS = 24, 3
# Characters handled at once, and different words numbered before the numbers start anew.
SLICE, NUMBERED = 4 << 20, 1_000_000


class Numbers(dict):
    """Numbers words in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def common_words(words: int, periods: int) -> int:
    """The shortest LCP that can seed a run: length - period, where length >= max(words, periods * period)."""
    return words - words // periods


def repeating(ids: np.ndarray, owner: np.ndarray, least: int) -> np.ndarray:
    """Owners of two equal stretches of ``least`` words; equal hashes suffice, so some may have none.

    ``owner`` is the ascending number of the text of each word.
    """
    n = len(ids) - least + 1
    if n < 2:
        return np.zeros(0, owner.dtype)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    # a stretch is put together from stretches of 1, 2, 4 ... words
    total, done, part, size, base = np.zeros(len(ids), np.uint64), 0, mixed, 1, 0xD6E8FEB86659FD93
    while done < least:
        if least & size:
            power = np.uint64(pow(0xD6E8FEB86659FD93, done, 1 << 64))
            total = total[: len(part) - done] + part[done:] * power
            done += size
        if done < least:
            part = part[:-size] + part[size:] * np.uint64(base)
            base, size = base * base % (1 << 64), size * 2
    total = total[:n] ^ (owner[:n].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    inside = np.flatnonzero(owner[:n] == owner[least - 1 :])
    order = inside[np.argsort(total[inside])]
    same = total[order[1:]] == total[order[:-1]]
    return np.unique(owner[order[1:][same]])


def suffix_order(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, rank, first)`` of all suffixes by doubled prefixes; texts end in words of their own.

    ``first[rank]`` is the smallest rank of the class that shares ``least`` or more words (a power of two
    at most ``least``), so edges of shorter prefixes need not be looked at.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    slots = np.arange(n)
    rank = np.empty(n, np.int64)

    def begun(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        alone = new & np.concatenate((new[1:], [True]))
        return np.maximum.accumulate(np.where(new, at, 0)), at[~alone]

    start, open_ = begun(ids[order], slots)
    rank[order] = start
    first, size = slots.copy(), 1
    while len(open_):
        if 2 * size > least >= size:
            first[open_] = rank[order[open_]]
        at = order[open_]
        key = rank[at] * (n + 1) + rank[at + size]
        moved = np.argsort(key)
        at, key = at[moved], key[moved]
        order[open_] = at
        start, still = begun(key, open_)
        rank[at] = start
        open_, size = still, 2 * size
    return order, rank, first


def neighbour_lcps(ids: np.ndarray, order: np.ndarray, rank: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """LCP of every suffix with the one in front of it in order, 0 where it is below ``least``.

    A suffix keeps all but one word of what the suffix at the position before it shares, so
    matching goes on where it ended.
    """
    lcp = np.zeros(len(ids), np.int64)
    wanted = np.flatnonzero(first[rank] < rank)
    where = rank[wanted]
    before = order[where - 1]
    word, found = memoryview(np.ascontiguousarray(ids)), []
    known = 1 << least.bit_length() - 1
    shared, last = known, -2
    for i, j in zip(wanted.tolist(), before.tolist()):
        shared = max(shared - (i - last), known)
        last = i
        while word[i + shared] == word[j + shared]:
            shared += 1
        found.append(shared)
    lcp[where] = found
    lcp[lcp < least] = 0
    return lcp


def seeds(order: np.ndarray, lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(position, next position, LCP)`` whenever two positions become neighbours in a united class."""
    edges = np.flatnonzero(lcp)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    above: dict[int, int] = {}
    held: dict[int, list[int]] = {}

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            top = above.get(up, up)
            above[x] = top
            x = top
        return x

    lefts, rights = order[edges - 1].tolist(), order[edges].tolist()
    for x, y, shared in zip(lefts, rights, lcp[edges].tolist()):
        a, b = root(x), root(y)
        big, small = held.get(a) or [a], held.get(b) or [b]
        if len(big) < len(small):
            a, b, big, small = b, a, small, big
        above[b] = a
        held.pop(b, None)
        at, previous = 0, -1
        places = []
        for k, p in enumerate(small):
            at = bisect_left(big, p, at)
            places.append(at)
            # neighbours in the united set that come from different sets
            if at and big[at - 1] > previous:
                yield big[at - 1], p, shared
            if at < len(big) and (k + 1 == len(small) or small[k + 1] > big[at]):
                yield p, big[at], shared
            previous = p
        if 8 * len(small) < len(big):
            for p, at in zip(reversed(small), reversed(places)):
                big.insert(at, p)
        else:
            big = sorted(big + small)  # two ascending lists: one merge
        held[a] = big


def word_runs(texts: list[np.ndarray], words: int = WORDS, periods: int = PERIODS) -> list[list[tuple[int, int, int]]]:
    """Runs ``(start, length, period)`` of every text of word numbers, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    least = common_words(words, periods)
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return out
    ids = np.concatenate(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    some = repeating(ids, owner, least)
    if not len(some):
        return out
    # a word of its own ends each text
    top = int(ids.max()) + 1
    ids = np.concatenate([part for k, t in enumerate(some.tolist()) for part in (texts[t], [top + k])]).astype(np.int64)
    ends = np.cumsum(sizes[some] + 1)
    order, rank, first = suffix_order(ids, least)
    lcp = neighbour_lcps(ids, order, rank, first, least)
    found = [
        (p, shared + q - p, q - p)
        for p, q, shared in seeds(order, lcp)
        if shared >= (periods - 1) * (q - p) and shared + q - p >= words
    ]
    for p, length, period in sorted(found):
        k = int(np.searchsorted(ends, p, "right"))
        offset = int(ends[k - 1]) if k else 0
        # only the pair at the start of a run; the same word in front would make an earlier one
        if p == offset or ids[p - 1] != ids[p + period - 1]:
            out[some[k]].append((p - offset, length, period))
    return out


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; of equal ones that of smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Mask of the words that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def find_runs(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, periods: int = PERIODS, collapsed: bool = True
) -> DataFrame:
    """``id, n_words, runs, collapsed`` of every row.

    Words are what ASCII white space separates. ``runs`` are all maximal stretches ``(start, length, period)``
    with smallest period ``period`` and at least ``words`` words and ``periods`` periods, by start and period;
    ``collapsed`` is the text with every run cut to its first period, words joined by one space (null if not wanted).
    A null or empty text has no words, no runs and collapses to the empty text. Repeated rows and ids come back
    as often as they went in; an empty table gives an empty table; other columns are ignored. Texts are read
    whole, in portions of ``SLICE`` characters or one text, and nothing is shuffled.
    """
    if periods < 2 or words < 2:
        raise ValueError("a run has at least two words and periods")
    ship(docs.sparkSession)
    narrow = columns(docs, id=id, text=text)
    kind = narrow.schema[0].dataType.simpleString()
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
        for batch in batches:
            start = size = 0
            texts = strings(batch.column(1))
            for i, value in enumerate(texts):
                size += len(value)
                if size >= SLICE or i + 1 == len(texts):
                    yield batch.column(0).slice(start, i + 1 - start), texts[start : i + 1]
                    start, size = i + 1, 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for ids, texts in portions(batches):
            if len(numbers) > NUMBERED:
                numbers.clear()
            split, whole = [t.encode().split() for t in texts], []
            for w in split:
                whole.append(np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)))
            runs = word_runs(whole, words, periods)
            short = []
            if collapsed:
                for w, r in zip(split, runs):
                    w = [w[i] for i in np.flatnonzero(kept_words(len(w), r))] if r else w
                    short.append(b" ".join(w).decode())
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(w) for w in split], pa.int64()), pa.array(rows, run),
                 pa.array(short, pa.string()) if collapsed else pa.nulls(len(texts), pa.string())],
                ["id", "n_words", "runs", "collapsed"],
            )

    schema = f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return narrow.mapInArrow(work, schema).withColumnRenamed("id", id)


def with_planted_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, text``: the texts, a tenth of them (by crc32 of the decimal id) with a repeated stretch of words.

    With h the checksum, g = h div 10 and h divisible by 10, word i >= a of n words becomes word a + (i - a) mod p,
    where a = g mod n and p = 1 + (n - a) div (3 + g mod 8). Rows without an id or words stay as they are.
    """
    rows = columns(docs, id=id, text=text).withColumn("h", F.crc32(F.col("id").cast("string").cast("binary")))
    planted = F.col("h") % 10 == 0
    split = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("w", F.when(planted, split)).withColumn("n", F.size("w"))
    rows = rows.withColumn("g", F.floor(F.col("h") / 10).cast("bigint"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    block = F.slice("w", F.col("a") + 1, F.col("p"))
    again = F.flatten(F.array_repeat(block, F.expr("cast((n - a) div p + 1 as int)")))
    edited = F.concat(F.slice("w", 1, F.col("a")), F.slice(again, 1, F.col("n") - F.col("a")))
    changed = F.when(planted & (F.col("n") > 0), F.array_join(edited, " ")).otherwise(F.col("text"))
    return rows.select(F.col("id").alias(id), changed.alias(text))


def run_digests(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` of every row.

    The run shown is that of the greatest length / period; without a run its four columns are null.
    """
    # the fraction itself decides, not its rounded quotient: a run is ahead if a.length * b.period > b.length * a.period
    ahead = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate("runs", F.get("runs", 0), lambda a, b: F.when(ahead(b, a), b).otherwise(a))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    found = find_runs(docs, id, text)
    some = F.size("runs") > 0
    found = found.withColumn("best", F.when(some, best))
    return found.select(
        F.col(f"`{id}`"),
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )
