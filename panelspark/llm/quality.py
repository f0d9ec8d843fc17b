"""Quality scores without hand-made labels.

Several rules vote good, bad or nothing on every text. Expectation-maximisation over the counts
of vote patterns of all texts estimates how often each rule is right, and so the posterior of
every pattern. The posteriors train a linear scorer on hashed word shapes and byte pairs, which
then scores every text by itself, also where the rules are silent.

Words are measured in code points. Rules that need blanks between words are not asked about texts in
scripts that set none, and what is written in scripts other than Latin is judged by the label model: the
scorer's byte pairs and word shapes say nothing about it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_bytes, ship, spare

# Rows the scorer is fitted on at most (the pseudo-random smallest by hash), slots per feature
# family, bytes read at once, and the score from which a text is kept.
SAMPLE, SLOTS, SLICE, KEPT = 8192, 1024, 1 << 17, 0.5
# Fewest words a rule votes on.
FEW = 8
# Assumed of the rules: a good text is called bad by one rule at most this often, and the texts
# that are bad in a rule's way are seen by it at least this often.
FALSE_ALARM, SEEN = 0.01, 0.9
# Rules: (name, measure, bad if below, bad if above, good from, good up to).
RULES = (
    ("letters", "letters", 0.70, 9.0, 0.85, 1.0),
    ("capitals", "capitals", -1.0, 0.30, 0.0, 0.10),
    ("symbols", "symbols", -1.0, 0.10, 0.0, 0.03),
    ("repeats", "repeats", -1.0, 0.10, 0.0, 0.03),
    ("marks", "marks", -1.0, 0.10, 0.0, 0.03),
    ("length", "length", 2.5, 15.0, 3.5, 11.0),
    ("sentences", "sentences", -1.0, 9.0, 0.02, 0.4),
)
ABSTAIN, GOOD, BAD = 0, 1, 2
# Rules that mean nothing where words are not set apart by blanks, the share of such letters from which
# a text is of that kind, and the digit of a vote pattern that says so.
NEED_BLANKS, LOOSE, UNASKED = ("length", "sentences"), 0.2, 3 ** len(RULES)
# Marks that end a sentence in other scripts, in UTF-8.
STOPS = [int.from_bytes(c.encode(), "big") for c in "\u3002\uff01\uff1f\u0964\u0965\u1362\u17d4\u104b\u061f\u06d4\u0589"]

# Byte classes.
LETTER, CAPITAL, DIGIT, MARK, SYMBOL, BLANK = range(6)
_CLASS = np.full(256, SYMBOL, np.uint8)
_CLASS[128:] = LETTER
_CLASS[ord("a") : ord("z") + 1] = LETTER
_CLASS[ord("A") : ord("Z") + 1] = CAPITAL
_CLASS[ord("0") : ord("9") + 1] = DIGIT
_CLASS[[ord(c) for c in ".,;:?!'\"()-"]] = MARK
_CLASS[[9, 10, 11, 12, 13, 32]] = BLANK
_POWER = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], np.uint64)


def slot(code: np.ndarray) -> np.ndarray:
    """Multiplicative hash of small codes to ``SLOTS``."""
    return ((code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(SLOTS)


@dataclass
class Reading:
    """What the rules and the scorer see of a portion of texts."""

    texts: int
    words: np.ndarray  # words per text
    loose: np.ndarray  # letters per text that belong to a script without blanks
    is_loose: np.ndarray
    known: np.ndarray  # share of a text, by bytes of words, that the scorer can judge
    measures: dict[str, np.ndarray]
    word_text: np.ndarray  # text of each word the scorer can judge
    word_slot: np.ndarray
    pair_text: np.ndarray  # text of each byte pair
    pair_slot: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, bounds: np.ndarray) -> Reading:
        n = len(bounds) - 1
        kind = _CLASS[data]
        solid = kind != BLANK
        opens, closes = solid.copy(), solid.copy()
        opens[1:] &= ~solid[:-1]
        closes[:-1] &= ~solid[1:]
        filled = bounds[:-1][bounds[1:] > bounds[:-1]]
        opens[filled] = solid[filled]
        last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
        closes[last] = solid[last]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        text = np.searchsorted(bounds, start, "right") - 1
        size = end - start
        first = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else np.zeros(0, np.int64)
        body = np.flatnonzero(solid)

        def per_word(values: np.ndarray, kind=np.int64) -> np.ndarray:
            return np.add.reduceat(values, first, dtype=kind) if len(first) else np.zeros(0, kind)

        # first bytes of letters beyond the Latin ones, and of scripts without blanks
        after = np.append(data[1:], np.uint8(0))
        far = (data == 0xF0) & (after >= 0xA0)
        other = ((data >= 0xCD) & (data <= 0xE1) | (data >= 0xE3) & (data <= 0xED) | far) & ~(
            (data == 0xE1) & (after >= 0xB8) & (after <= 0xBB)
        )
        tight = (
            (data >= 0xE4) & (data <= 0xE9)
            | (data == 0xE3) & (after >= 0x81)
            | (data == 0xE0) & (after >= 0xB8)
            | (data == 0xE1) & ((after <= 0x81) | (after == 0x9E) | (after == 0x9F))
            | far
        )
        points = per_word(data[body] & 0xC0 != 0x80)
        strange = per_word(other[body]) > 0
        inside = kind[body]
        capital, letter = per_word(inside == CAPITAL), per_word(inside <= CAPITAL)
        symbol, digit = per_word(inside == SYMBOL), per_word(inside == DIGIT)
        place = body - np.repeat(start, size)
        name = per_word(data[body].astype(np.uint64) * _POWER[place & 63], np.uint64)

        def same(back: int) -> np.ndarray:
            found = np.zeros(len(name), bool)
            found[back:] = (name[back:] == name[:-back]) & (text[back:] == text[:-back])
            return found

        repeat, second = same(1), same(2)
        tail = data[end - 1] if len(end) else np.zeros(0, np.uint8)
        tail_kind = _CLASS[tail]
        before = np.where(size > 1, data[np.maximum(end - 2, 0)], 0) if len(end) else tail
        shout = (capital >= 2) & (capital == letter)
        double = (tail == before) & (tail_kind >= MARK)
        stop = np.isin(tail, [ord(c) for c in ".!?"]) & ~double
        if strange.any() or (tail >= 128).any():
            two = before.astype(np.int64) << 8 | tail
            three = np.where(size > 2, data[np.maximum(end - 3, 0)], 0).astype(np.int64) << 16 | two
            stop |= np.isin(two, STOPS) | np.isin(three, STOPS)

        words = np.bincount(text, minlength=n)
        some = np.maximum(words, 1)

        def share(flags: np.ndarray) -> np.ndarray:
            return np.bincount(text, flags, n) / some

        bytes_of = np.bincount(text, size, n)
        measures = {
            "letters": np.bincount(text, letter, n) / np.maximum(bytes_of - np.bincount(text, digit, n), 1),
            "capitals": share(shout),
            "symbols": share(tail_kind == SYMBOL),
            "repeats": share(repeat),
            "marks": share(double),
            "length": np.bincount(text, points, n) / some,
            "sentences": share(stop),
        }
        shape = (
            shout
            | (_CLASS[data[start]] == CAPITAL) << 1
            | repeat << 2
            | second << 3
            | double << 4
            | (symbol > 0) << 5
            | tail_kind.astype(np.int64) << 6
            | np.minimum(points, 15) << 9
        ) if len(start) else np.zeros(0, np.int64)
        follows = np.ones(max(len(data) - 1, 0), bool)
        follows[filled[filled > 0] - 1] = False
        at = np.flatnonzero(follows)
        owner = np.repeat(np.arange(n), np.maximum(np.diff(bounds) - 1, 0))
        known = np.ones(n)
        if strange.any():
            unread = np.zeros(len(data), bool)
            unread[body] = np.repeat(strange, size)
            read = ~(unread[at] | unread[at + 1])
            at, owner = at[read], owner[read]
            known = 1 - np.bincount(text, size * strange, n) / np.maximum(bytes_of, 1)
        pair = data[at].astype(np.int64) << 8 | data[at + 1]
        loose = np.bincount(text, per_word(tight[body]), n)
        is_loose = loose > LOOSE * np.maximum(np.bincount(text, points, n), 1)
        return cls(n, words, loose, is_loose, known, measures, text[~strange], slot(shape[~strange]), owner, slot(pair))

    def votes(self) -> np.ndarray:
        """One digit in base three per rule, one more where rules on blanks are not asked."""
        code = self.is_loose * np.int64(UNASKED)
        # two letters of a script without blanks count as a word
        enough = self.words + self.loose // 2 >= FEW
        for i, (name, measure, below, above, low, high) in enumerate(RULES):
            value = self.measures[measure]
            vote = np.where((value < below) | (value > above), BAD, np.where((value >= low) & (value <= high), GOOD, ABSTAIN))
            asked = enough & ~self.is_loose if name in NEED_BLANKS else enough
            code += np.where(asked, vote, ABSTAIN) * 3**i
        return code

    def features(self) -> np.ndarray:
        """Share of each slot among a text's words and among its byte pairs."""
        a = np.bincount(self.word_text * SLOTS + self.word_slot.astype(np.int64), minlength=self.texts * SLOTS)
        b = np.bincount(self.pair_text * SLOTS + self.pair_slot.astype(np.int64), minlength=self.texts * SLOTS)
        a, b = a.reshape(-1, SLOTS), b.reshape(-1, SLOTS)
        return np.hstack([x / np.maximum(x.sum(axis=1, keepdims=True), 1) for x in (a, b)]).astype(np.float32)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Features times weights, without the features."""
        words = np.maximum(np.bincount(self.word_text, minlength=self.texts), 1)
        a = np.bincount(self.word_text, weights[:SLOTS][self.word_slot], self.texts) / words
        pairs = np.maximum(np.bincount(self.pair_text, minlength=self.texts), 1)
        return a + np.bincount(self.pair_text, weights[SLOTS:][self.pair_slot], self.texts) / pairs


def readings(column: pa.Array) -> Iterator[Reading]:
    data, bounds = raw_bytes(column)
    first = 0
    while first < len(bounds) - 1:
        last = int(np.searchsorted(bounds, bounds[first] + SLICE, "right")) - 1
        last = min(max(last, first + 1), first + 1024, len(bounds) - 1)
        yield Reading.of(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


def _asked(rule: int, code: np.ndarray) -> np.ndarray:
    """Whether a rule was put to the texts of vote patterns."""
    return (code < UNASKED) | (RULES[rule][0] not in NEED_BLANKS)


@dataclass
class LabelModel:
    """Latent kinds of text: good ones first, then one kind of bad text per rule.

    Bad texts are bad in different ways, and rules that see the same defect vote together, so
    one class of bad texts would be ruled by the rules that overlap most.
    """

    kinds: np.ndarray  # share of each kind
    shares: np.ndarray  # (rule, kind, vote)

    def belief(self, code: np.ndarray) -> np.ndarray:
        """Probability of each kind for vote patterns."""
        log = np.tile(np.log(self.kinds), (len(code), 1))
        for i in range(len(RULES)):
            log += np.where(_asked(i, code), np.log(self.shares[i][:, code // 3**i % 3]), 0.0).T
        share = np.exp(log - log.max(axis=1, keepdims=True))
        return share / share.sum(axis=1, keepdims=True)

    def posterior(self, code: np.ndarray) -> np.ndarray:
        """Probability of good; without a vote it is the share of good texts."""
        return np.where(code % UNASKED > 0, self.belief(code)[:, 0], self.kinds[0])

    def accuracies(self) -> dict[str, float]:
        """Per rule, how often its vote is right when it votes."""
        found = {}
        for i, (name, *_) in enumerate(RULES):
            votes = self.shares[i] * self.kinds[:, None]
            found[name] = float((votes[0, GOOD] + votes[1:, BAD].sum()) / votes[:, 1:].sum())
        return found


def _bounded(votes: np.ndarray, low: float, high: float) -> None:
    """Move the share of bad votes into a range, the others in proportion."""
    bad = min(max(votes[BAD], low), high)
    votes[[ABSTAIN, GOOD]] *= (1 - bad) / (1 - votes[BAD])
    votes[BAD] = bad


def fit_labels(code: np.ndarray, count: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over counted vote patterns.

    Starts from the plain opinion that a bad vote makes a text bad in that rule's way, shared
    out if several rules vote bad. Votes are independent given the kind; shares are smoothed
    and kept within what is assumed of the rules, without which a kind may drift to what two
    rules overlap on. Texts on which no rule votes tell nothing and are left out; a rule that was not asked
    about a text learns nothing from it.
    """
    heard = code % UNASKED > 0
    code, count = code[heard], count[heard]
    vote = np.stack([code // 3**i % 3 for i in range(len(RULES))])
    bad = (vote == BAD).astype(float)  # a rule that was not asked has the digit of one that abstains
    belief = np.vstack([np.where(bad.any(axis=0), 0.1, 10.0), bad + 0.01]).T
    belief /= belief.sum(axis=1, keepdims=True)
    while True:
        weight = (belief * count[:, None]).T
        shares = np.full((len(RULES), len(RULES) + 1, 3), 0.5)
        for i in range(len(RULES)):
            for v in (ABSTAIN, GOOD, BAD):
                shares[i, :, v] += weight[:, (vote[i] == v) & _asked(i, code)].sum(axis=1)
        shares /= shares.sum(axis=2, keepdims=True)
        for i in range(len(RULES)):
            _bounded(shares[i, 0], 0.0, FALSE_ALARM)
            _bounded(shares[i, i + 1], SEEN, 1.0)
        kinds = weight.sum(axis=1) + 0.5
        model = LabelModel(kinds / kinds.sum(), shares)
        new = model.belief(code) if len(code) else belief
        rounds -= 1
        if not rounds or np.abs(new - belief).max(initial=0) < 1e-9:
            return model
        belief = new


def fit_scorer(x: np.ndarray, good: np.ndarray, rounds: int = 300, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; full-batch gradient steps with momentum.

    Good and bad weigh the same in total. Returns weights of the raw features and the constant.
    """
    if not len(x):
        return np.zeros(2 * SLOTS), 0.0
    scale = np.maximum(x.std(axis=0), 1e-4).astype(np.float32)
    middle = x.mean(axis=0)
    z = (x - middle) / scale
    balance = good / max(good.sum(), 1e-9) + (1 - good) / max((1 - good).sum(), 1e-9)
    balance = (balance / balance.sum()).astype(np.float32)
    w, b = np.zeros(z.shape[1], np.float32), 0.0
    speed, speed_b, step = np.zeros_like(w), 0.0, 0.3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
        error = (p - good) * balance
        speed = 0.9 * speed - step * (z.T @ error / 8 + decay * w)
        speed_b = 0.9 * speed_b - step * error.sum()
        w, b = w + speed, b + speed_b
    weights = (w / scale).astype(np.float64)
    return weights, float(b - weights @ middle)


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    constant: float


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> QualityModel:
    """Count the vote patterns of all texts, fit the label model, and fit the scorer to the
    posteriors of at most ``sample`` different texts: those with the smallest hashes (texts mostly in scripts
    the scorer does not judge are left out of it). There are no more patterns than twice three to the number
    of rules, which bounds what comes to the driver."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(f"`{text}`").alias("text"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for reading in readings(batch.column(0)):
                code, count = np.unique(reading.votes()[reading.words > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(count.astype(np.int64))], ["code", "n"])

    counted = texts.mapInArrow(patterns, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    counted = counted.orderBy("code").toArrow()
    labels = fit_labels(counted.column("code").to_numpy(), counted.column("n").to_numpy())

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for reading in readings(batch.column(0)):
                some = (reading.words > 0) & (reading.known >= 0.5)
                rows = reading.features()[some].astype(np.float16)
                place = batch.column(1).slice(done, reading.texts).filter(pa.array(some))
                done += reading.texts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reading.votes()[some]), pa.array([r.tobytes() for r in rows], pa.binary()), place], ["code", "x", "h"]
                )

    # one row per text: copies of a few texts do not fill the sample
    place, spoken = F.xxhash64("text"), texts.where(F.col("text").rlike("[^\\x09-\\x0d ]"))
    last = spoken.select(place.alias("h")).distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    near = spoken.where(place <= F.lit(last).cast("bigint")).groupBy(place.alias("h")).agg(F.min("text").alias("text"))
    rows = near.select("text", "h").mapInArrow(examples, "code bigint, x binary, h bigint")
    taken = rows.orderBy("h", "code").limit(sample).toArrow()
    raw = b"".join(taken.column("x").to_pylist())
    x = np.frombuffer(raw, np.float16).reshape(-1, 2 * SLOTS).astype(np.float32)
    good = labels.posterior(taken.column("code").to_numpy()).astype(np.float32)
    return QualityModel(labels, *fit_scorer(x, good))


def score(
    docs: DataFrame, model: QualityModel, text: str = "text", posterior: str = "weak_good", out: str = "score"
) -> DataFrame:
    """``docs`` with the label model's posterior of good and the scorer's score, 0 to 1.

    A null or empty text, or one of white space, scores 0. Only the text is read; all columns
    pass through.
    """
    ship(docs.sparkSession)
    given = docs.columns
    at = given.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, value = [np.zeros(0)], [np.zeros(0)]
            for reading in readings(batch.column(at)):
                spoken = reading.words > 0
                weak = model.labels.posterior(reading.votes())
                sure = np.clip(weak, 1e-3, 1 - 1e-3)
                raw = reading.sums(model.weights) + model.constant
                # the label model speaks for what the scorer cannot judge
                raw = np.clip(reading.known * raw + (1 - reading.known) * np.log(sure / (1 - sure)), -30, 30)
                good.append(np.where(spoken, weak, 0.0))
                value.append(np.where(spoken, 1 / (1 + np.exp(-raw)), 0.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(good)), pa.array(np.concatenate(value))], [*given, posterior, out]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(work, f"{fields}, `{posterior}` double, `{out}` double")


def quality(docs: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE, kept: float = KEPT) -> DataFrame:
    """``id, weak_good, score, kept`` of every row, trained on ``docs`` itself.

    ``kept`` is whether the score reaches the limit. Repeated rows come back as often as they
    went in; an empty table gives an empty table; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id}`"), F.col(f"`{text}`").alias("_text"))
    scored = score(rows, train(docs, text, sample), "_text")
    return scored.select(F.col(f"`{id}`"), "weak_good", "score", (F.col("score") >= kept).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", sample: int = SAMPLE, kept: float = KEPT) -> DataFrame:
    """The rows of ``docs`` whose score reaches the limit, with the columns they have."""
    good, value = spare(docs, "_good"), spare(docs, "_score")
    scored = score(docs, train(docs, text, sample), text, good, value)
    return scored.where(F.col(value) >= kept).drop(good, value)
