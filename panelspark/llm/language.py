"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts of up to three bytes. A byte costs
-log2 of its share under the longest context that has been followed by it; every longer context
that is known, but was never followed by it, first charges for its escape (method C: a context
seen n times with q different followers gives a follower seen c times c / (n + q) and the escape
q / (n + q); no exclusion). After training the statistics are frozen, so the cost of a byte
depends on four bytes only and the code length of a text is a sum of table entries. The language
with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw_bytes, ship, spare, written

UNKNOWN = "und"
# Trees made and held together have at most so many (four-byte string, language) cells, one language at least.
CELLS = 4_000_000
# Least belief in a language for a row to be kept.
SURE = 0.5
# A text may cost so many times the bits a byte that all but one in a hundred held-out texts of its
# language stay below, and so many bits more (short texts vary).
DEARER, COMMON, SPARE_BITS = 1.5, 0.99, 200.0
# Bytes counted or scored at once.
SLICE = 1 << 18
BLANK = 32

# ASCII other than letters is a blank; text is lower-cased before it comes here.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128][[not chr(i).isalpha() for i in range(128)]] = BLANK


def normalised(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with runs of non-letters as one blank, and the new bounds of the values."""
    data = _PLAIN[data]
    blank = data == BLANK
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[bounds[:-1][bounds[:-1] < len(data)]] = True  # a value does not depend on the one before it
    kept = np.concatenate(([0], np.cumsum(keep)))
    return data[keep], kept[bounds]


def previous(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The bytes one, two and three places back, blanks in front of a value."""
    start, end = bounds[:-1], bounds[1:]
    found = []
    for back in (1, 2, 3):
        moved = np.full(len(data), BLANK, np.uint8)
        moved[back:] = data[:-back]
        for i in range(back):
            at = start + i
            moved[at[at < end]] = BLANK
        found.append(moved)
    return found


def grams(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    one, two, three = (p.astype(np.uint32) for p in previous(data, bounds))
    return three << 24 | two << 16 | one << 8 | data


def added(keys: Sequence[np.ndarray], counts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum counts of equal keys."""
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(place, np.concatenate(counts), len(key)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four-byte strings per language of the texts of one task."""
    seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for lang in batch.column(0).unique().to_pylist():
            part = table.filter(pa.compute.equal(table.column(0), lang)).column(1).combine_chunks()
            data, bounds = raw_bytes(part)
            for _, _, body, own, known in _parts(data, bounds):
                key, count = np.unique(grams(body, own)[known:], return_counts=True)
                if lang in seen:
                    key, count = added([seen[lang][0], key], [seen[lang][1], count])
                seen[lang] = key, count
    for lang, (key, count) in seen.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(count.astype(np.int64))], ["lang", "gram", "n"]
        )


def _slices(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of values of about ``SLICE`` bytes, at least one value each."""
    first = 0
    while first < len(bounds) - 1:
        last = int(np.searchsorted(bounds, bounds[first] + SLICE, "right")) - 1
        last = min(max(last, first + 1), len(bounds) - 1)
        yield first, last
        first = last


def _parts(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """The values in parts of bounded size: first and last value, normalised bytes, their bounds,
    and how many bytes in front belong to the part before. A long value comes in several parts,
    each with the three bytes before it, which are all that a byte's cost depends on."""
    for first, last in _slices(bounds):
        raw = data[bounds[first] : bounds[last]]
        if len(raw) <= SLICE:
            yield first, last, *normalised(raw, bounds[first : last + 1] - bounds[first]), 0
            continue
        carried = raw[:0]
        for at in range(0, len(raw), SLICE):
            body = np.concatenate((carried, raw[at : at + SLICE]))
            body, own = normalised(body, np.array([0, len(body)]))
            yield first, last, body, own, len(carried)
            carried = body[-3:]


@dataclass
class Trees:
    """Frozen costs in bits of all languages, ready for look-up."""

    langs: list[str]
    symbol: np.ndarray  # byte -> number, 0: never seen
    third: np.ndarray  # three numbers -> row of a known three-byte string, or -1
    fourth: np.ndarray  # (row of context, number) -> row of a known four-byte string, or -1
    cost4: np.ndarray
    escape3: np.ndarray
    cost3: np.ndarray
    escape2: np.ndarray  # by two bytes
    cost2: np.ndarray  # by two bytes

    @classmethod
    def of(cls, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Trees:
        """From (language number, four-byte string, count). Shorter strings are sums of these."""
        size = len(langs)
        known = [np.unique(gram & np.uint32((1 << 8 * k) - 1)) for k in (1, 2, 3)] + [np.unique(gram)]
        count = [np.zeros((len(k), size)) for k in known]
        for k in range(4):
            mask = np.uint32((1 << 8 * (k + 1)) - 1)
            np.add.at(count[k], (np.searchsorted(known[k], gram & mask), lang), n)
        # cost of every known string and escape of every known context, from order 0 upwards
        cost: np.ndarray = np.full((256, size), 8.0)
        costs, escapes = [], []
        for k in range(4):
            context = known[k] >> np.uint32(8)
            contexts, place = np.unique(context, return_inverse=True)
            total, followers = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
            np.add.at(total, place, count[k])
            np.add.at(followers, place, count[k] > 0)
            all_of = total + followers
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2(all_of) - np.log2(followers), 0.0)
                direct = np.log2(all_of)[place] - np.log2(count[k])
            shorter = (known[k] & np.uint32((1 << 8 * k) - 1)) if k else known[k]
            below = cost[shorter] if k == 0 else costs[-1][np.searchsorted(known[k - 1], shorter)]
            costs.append(np.where(count[k] > 0, direct, escape[place] + below))
            escapes.append((contexts, escape))
        # full tables for one and two bytes; unseen ones pay the escapes on the way down
        cost1 = np.tile(escapes[0][1][0] + 8.0, (256, 1)) if len(known[0]) else cost
        cost1[known[0]] = costs[0]
        escape1 = np.zeros((256, size))
        escape1[escapes[1][0]] = escapes[1][1]
        pairs = np.arange(65536)
        cost2 = escape1[pairs >> 8] + cost1[pairs & 255]
        cost2[known[1]] = costs[1]
        escape2 = np.zeros((65536, size))
        escape2[escapes[2][0]] = escapes[2][1]
        # a three-byte string is known as a string, as a context, or both
        rows = np.unique(np.concatenate([known[2], escapes[3][0]]))
        cost3 = escape2[rows >> 8] + cost2[rows & 65535]
        cost3[np.searchsorted(rows, known[2])] = costs[2]
        escape3 = np.zeros((len(rows), size))
        escape3[np.searchsorted(rows, escapes[3][0])] = escapes[3][1]
        used = np.unique(np.concatenate([(gram >> np.uint32(8 * i)) & np.uint32(255) for i in range(4)]))
        symbol = np.zeros(256, np.int32)
        symbol[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        number = [symbol[(rows >> np.uint32(8 * i)) & np.uint32(255)] for i in (2, 1, 0)]
        third = np.full(width**3, -1, np.int32)
        third[(number[0] * width + number[1]) * width + number[2]] = np.arange(len(rows))
        fourth = np.full(len(rows) * width, -1, np.int32)
        at = np.searchsorted(rows, known[3] >> np.uint32(8))
        fourth[at * width + symbol[known[3] & np.uint32(255)]] = np.arange(len(known[3]))
        small = [x.astype(np.float32) for x in (costs[3], escape3, cost3, escape2, cost2)]
        return cls(langs, symbol, third, fourth, *small)

    def bits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Code length of every value under every language; ``data`` is normalised."""
        one, two, three = previous(data, bounds)
        width = np.int32(len(self.symbol[self.symbol > 0]) + 1)
        s0, s1, s2, s3 = (self.symbol[x] for x in (data, one, two, three))
        context = self.third[(s3 * width + s2) * width + s1]
        row = self.fourth[context * width + s0]
        row[context < 0] = -1
        cost = self.cost4[row]
        miss = np.flatnonzero(row < 0)
        if len(miss):
            context = context[miss]
            short = self.third[(s2[miss] * width + s1[miss]) * width + s0[miss]]
            # a byte never seen shares number 0 with others: only the two-byte tables know it
            pair = two[miss].astype(np.int32) << 8 | one[miss]
            deep = self.escape2[pair] + self.cost2[one[miss].astype(np.int32) << 8 | data[miss]]
            deep = np.where((short >= 0)[:, None], self.cost3[short], deep)
            cost[miss] = np.where((context >= 0)[:, None], self.escape3[context], np.float32(0)) + deep
        out = np.zeros((len(bounds) - 1, len(self.langs)))
        filled = np.flatnonzero(bounds[1:] > bounds[:-1])
        if len(filled):
            out[filled] = np.add.reduceat(cost, bounds[:-1][filled], axis=0, dtype=np.float64)
        return out


def held_out(id: str, folds: int = 4, fold: int = 2) -> Column:
    """Is the row kept out of training? By the checksum of its id; a null id is not in any fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id}`").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def groups(sizes: dict[str, int], most: int) -> list[list[str]]:
    """Languages in order of names, cut into runs of at most ``most`` cells (strings times
    languages) or one language."""
    found: list[list[str]] = []
    held = 0
    for lang in sorted(sizes):
        if not found or (held + sizes[lang]) * (len(found[-1]) + 1) > most:
            found.append([])
            held = 0
        found[-1].append(lang)
        held += sizes[lang]
    return found


def train(docs: DataFrame, text: str = "text", lang: str = "lang", cells: int = CELLS) -> list[Broadcast[Trees]]:
    """Trees of all languages from every row with a language and a text.

    All rows are counted, in Spark, and every string counts. A language's tree needs its own
    strings only, so trees come to the driver and go to the tasks in groups of at most ``cells``
    strings times languages, which is what their tables hold, or of one language. The strings of
    a language are bounded by its alphabet, not by the rows.
    """
    spark = docs.sparkSession
    ship(spark)
    read = docs.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    read = read.select(F.col(f"`{lang}`").alias("lang"), F.lower(F.col(f"`{text}`")).alias("text"))
    partial = read.mapInArrow(_count, "lang string, gram bigint, n bigint")
    counts = written(partial.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    sizes = {r.lang: r.n for r in counts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = []
    for languages in groups(sizes, cells):
        kept = counts.where(F.col("lang").isin(languages)).toArrow()
        order = pa.compute.index_in(kept.column("lang"), pa.array(languages, kept.schema.field("lang").type))
        codes = order.to_numpy().astype(np.int64)
        trees = Trees.of(languages, codes, kept.column("gram").to_numpy().astype(np.uint32), kept.column("n").to_numpy())
        shared.append(spark.sparkContext.broadcast(trees))
    return shared


def code_lengths(shared: list[Broadcast[Trees]], data: np.ndarray, bounds: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All languages, every value's code lengths under them, and its normalised bytes; of several
    groups of trees one is in memory at a time."""
    langs: list[str] = []
    found = [np.zeros((len(bounds) - 1, 0))]
    size = np.zeros(len(bounds) - 1)
    for group in shared:
        alone = len(shared) > 1 and getattr(group, "_path", None)
        trees = group.load_from_path(group._path) if alone else group.value
        langs += trees.langs
        own = np.zeros((len(bounds) - 1, len(trees.langs)))
        size[:] = 0
        for first, last, body, at, known in _parts(data, bounds):
            own[first:last] += trees.bits(body, at)
            size[first:last] += np.diff(at) - known
            if known:
                own[first:last] -= trees.bits(body[:known], np.array([0, known]))
        found.append(own)
        del trees
    return langs, np.hstack(found), size


def identify(
    docs: DataFrame,
    shared: list[Broadcast[Trees]],
    text: str = "text",
    pred: str = "lang_pred",
    score: str = "score",
    bits: str | None = None,
    size: str | None = None,
) -> DataFrame:
    """``docs`` with the predicted language and its share of belief (0 to 1).

    The score is the posterior of the language under equal priors: 2 to the minus code length,
    normalised. A null text or one without a letter is ``und`` with score 0, and so is every row
    if nothing was learned. Equal code lengths go to the first language in order of names. Only
    the text is read; all columns pass through. With ``bits`` and ``size`` the code length under
    the predicted language and the number of bytes it is for come too (0 for ``und``).
    """
    spark = docs.sparkSession
    ship(spark)
    given = docs.columns
    extra = [name for name in (bits, size) if name]
    body = F.col(f"`{text}`")
    rows = docs.select(
        *[F.col(f"`{c}`") for c in given],
        F.when(body.rlike(r"\p{L}"), F.lower(body)).alias("_lower_text"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lower = batch.column(batch.num_columns - 1)
            data, bounds = raw_bytes(lower)
            langs, lengths, n_bytes = code_lengths(shared, data, bounds)
            if langs:
                best, least = lengths.argmin(axis=1), lengths.min(axis=1)
                share = 1 / np.exp2(least[:, None] - lengths).sum(axis=1)
            else:
                best, least, share = np.zeros(len(lower), int), np.zeros(len(lower)), np.zeros(len(lower))
            letters = lower.is_valid().to_numpy(zero_copy_only=False)
            names = [langs[b] if ok and langs else UNKNOWN for b, ok in zip(best, letters)]
            scores = np.where(letters, share, 0.0)
            measured = [pa.array(np.where(letters, x, 0.0)) for x, name in ((least, bits), (n_bytes, size)) if name]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores), *measured],
                [*given, pred, score, *extra],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    more = "".join(f", `{name}` double" for name in extra)
    return rows.mapInArrow(work, f"{fields}, `{pred}` string, `{score}` double{more}")


def predict_languages(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``id, held_out, lang_pred, score`` of every row.

    Trained on the rows of ``docs`` that have a language and are not held out. Repeated rows
    come back as often as they went in; an empty table gives an empty table; other columns are
    ignored.
    """
    rows = docs.select(F.col(f"`{id}`"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), held_out(id).alias("held_out"))
    trees = train(rows.where(f"not held_out and `{id}` is not null"))
    return identify(rows.select(f"`{id}`", "held_out", "text"), trees).drop("text")


def dearest(docs: DataFrame, shared: list[Broadcast[Trees]], text: str = "text") -> dict[str, float]:
    """Most bits a byte a text of each language may cost, from ``docs``, texts no tree has seen.

    One row per learned language comes to the driver.
    """
    seen = identify(docs.select(F.col(f"`{text}`").alias("text")), shared, bits="bits", size="size")
    rate = F.percentile_approx(F.col("bits") / F.col("size"), COMMON, 1000)
    rows = seen.where("size > 0").groupBy("lang_pred").agg(rate.alias("rate")).collect()
    return {r.lang_pred: DEARER * r.rate for r in rows}


def keep_known(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sure: float = SURE) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language, with the columns they have.

    Rows without letters and rows whose best language has less than ``sure`` of the belief go. So
    do rows their best language explains badly, as it does a language nobody labelled or letters
    without sense: more than ``DEARER`` times the bits a byte of the held-out labelled texts. A
    language without held-out texts sets no such limit.
    """
    apart, labelled = held_out(id), F.col(f"`{lang}`").isNotNull()
    trees = train(docs.where(~apart & F.col(f"`{id}`").isNotNull()), text, lang)
    limits = dearest(docs.where(apart & labelled), trees, text)
    pred, score, bits, size = (spare(docs, name) for name in ("_pred", "_belief", "_bits", "_size"))
    known = identify(docs, trees, text, pred, score, bits, size)
    most = F.lit(float("inf"))
    if limits:
        table = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
        most = F.coalesce(F.try_element_at(table, F.col(pred)) * F.col(size) + SPARE_BITS, most)
    sound = (F.col(pred) != UNKNOWN) & (F.col(score) >= sure) & (F.col(bits) <= most)
    return known.where(sound).drop(pred, score, bits, size)
