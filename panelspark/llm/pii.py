"""Personal data in texts: patterns propose spans, checks confirm them, words nearby move the score.

Every pattern reads a text in linear time, however it is built: patterns that could start anew
inside the run they just failed on are held to the start of the run, and an address is searched
from its @ outwards.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, ship, strings

# Code points in front of and behind a span whose words count, what a word is worth, and the lowest score of
# a span that is not of a base kind.
NEAR, WORTH, SCORE = 60, 0.25, 0.6

# Letters of a country and length of its account numbers, in alphabetical order.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
PARTS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])")
SOCIAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
INLAND = re.compile(r"(?<![0-9+().-])(?:\([0-9]{2,5}\) ?|0?[0-9]{2,4}[ /.-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])")
DIGIT = re.compile(r"[0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: the longest local part in front of each @ that a domain follows."""
    free = 0
    for m in DOMAIN.finditer(text):
        start = at = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            free = m.end()


def spans_of(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


def bytes_of_four(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))


def n_digits(found: str) -> int:
    return sum(map(len, DIGIT.findall(found)))


def luhn(digits: str) -> bool:
    """Every second digit from the right but one is doubled, nines cast out; the sum is divisible by ten."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def card(found: str) -> bool:
    return 12 <= n_digits(found) <= 19 and luhn("".join(DIGIT.findall(found)))


def mod_97(found: str) -> bool:
    """Country and check digits moved to the end, letters as 10 to 35: the number leaves 1 when divided by 97."""
    compact = found.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def account_end(found: str) -> int:
    """Length of the account number in front of what else the pattern took, 0 if there is none."""
    wanted, seen = IBAN_LENGTHS.get(found[:2], 0), 0
    for i, c in enumerate(found):
        seen += c != " "
        if seen == wanted:
            whole = i + 1 == len(found) or found[i + 1] == " "
            return i + 1 if whole and mod_97(found[: i + 1]) else 0
    return 0


def accounts(text: str) -> Iterator[tuple[int, int]]:
    for m in ACCOUNT.finditer(text):
        if size := account_end(m[0]):
            yield m.start(), m.start() + size


def issued(found: str) -> bool:
    """Areas 000, 666 and from 900, group 00 and serial 0000 are never given out."""
    area, group, serial = found.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


@dataclass(frozen=True)
class Kind:
    name: str
    propose: Callable[[str], Iterator[tuple[int, int]]]
    confirm: Callable[[str], bool]
    # the score of a confirmed span without words nearby; words that speak for it and against it
    score: float
    words: frozenset[str]
    against: frozenset[str] = frozenset()


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


NUMBERING = _words("version order invoice isbn ticket serial item part checksum hash commit build sku article versión pedido factura version facture commande bestellung rechnung artikel")
CALLS = _words("phone tel telephone mobile cell call fax whatsapp sms teléfono telefono móvil llame llamar téléphone mobile appelez telefon handy anrufen rufnummer")
# Base kinds in their fixed order, each kept whatever its score.
BASE = (
    Kind("email", emails, lambda found: True, 0.9, _words("email e-mail mail contact write correo contacto courriel contactez kontakt schreiben")),
    Kind("ip", spans_of(PARTS), bytes_of_four, 0.6, _words("ip address host server login client dirección servidor adresse serveur rechner"), NUMBERING | _words("release section chapter")),
    Kind("card", spans_of(DIGITS), card, 0.7, _words("card credit visa mastercard amex debit payment tarjeta crédito pago carte bancaire paiement karte kreditkarte zahlung"), NUMBERING),
    Kind("phone", spans_of(DIALLED), lambda found: 9 <= n_digits(found) <= 15, 0.8, CALLS),
)
# What the method adds: these need a checksum or words nearby to reach the lowest score.
ADDED = (
    Kind("iban", accounts, lambda found: True, 0.95, _words("iban account bank transfer cuenta banco compte banque konto bank überweisung")),
    Kind("ssn", spans_of(SOCIAL), issued, 0.4, _words("ssn social security taxpayer"), NUMBERING),
    Kind("inland_phone", spans_of(INLAND), lambda found: 7 <= n_digits(found) <= 12, 0.4, CALLS, NUMBERING),
)
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def nearby(text: str, start: int, end: int, kind: Kind) -> float:
    """What the words around a span add to its score: each side says yes, no or nothing."""
    sides = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    total = 0.0
    for side in sides:
        found = set(WORD.findall(side.lower()))
        total += WORTH * (not kind.words.isdisjoint(found)) - WORTH * (not kind.against.isdisjoint(found))
    return total


def scan(text: str, base=BASE, added=ADDED, least: float = SCORE) -> list[Span]:
    """Spans by start, then kind as listed; ``end`` is exclusive, both count code points."""
    out: list[tuple[int, int, Span]] = []
    taken: list[tuple[int, int]] = []
    if not any(c in text for c in "@0123456789"):
        return []
    for order, kind in enumerate((*base, *added)):
        for start, end in kind.propose(text):
            if not kind.confirm(text[start:end]):
                continue
            score = round(min(1.0, max(0.0, kind.score + nearby(text, start, end, kind))), 2)
            if order < len(base):
                taken.append((start, end))
            elif score < least or _overlaps(taken, start, end, kind.name != "iban"):
                continue
            out.append((start, order, Span(kind.name, start, end, score)))
        if order + 1 == len(base):
            taken.sort()
    return [s for _, _, s in sorted(out, key=lambda x: x[:2])]


def _overlaps(taken: list[tuple[int, int]], start: int, end: int, matters: bool) -> bool:
    """Whether base spans, by start, touch the span; numbers inside an account number are its own."""
    if not matters:
        return False
    at = bisect_left(taken, (end, 0))
    return any(e > start for _, e in taken[max(0, at - len(BASE)) : at])


def find_personal(docs: DataFrame, id: str = "doc_id", text: str = "text", base=BASE, added=ADDED, least: float = SCORE) -> DataFrame:
    """``id, spans``: personal data in every row, ``spans`` an array of ``(kind, start, end, score)``.

    Spans count code points, ``end`` exclusive, and go by start, then by kind as listed. Spans of ``base`` kinds are
    the leftmost non-overlapping matches of each kind's pattern that its check confirms; they stay whatever their score.
    Spans of ``added`` kinds need a score of ``least`` and lie beside the base spans (an account number may hold some).
    The score is that of the kind, moved by words within ``NEAR`` code points. A null or empty text has no spans.
    Repeated rows and ids come back as often as they went in; an empty table gives an empty table; other columns are
    ignored. Texts are read whole and in linear time; nothing is shuffled.
    """
    ship(docs.sparkSession)
    narrow = columns(docs, id=id, text=text)
    kind = narrow.schema[0].dataType.simpleString()
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[vars(s) for s in scan(t, base, added, least)] for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, item)], ["id", "spans"])

    return narrow.mapInArrow(work, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>").withColumnRenamed("id", id)


def personal_digest(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_email, n_ip, n_card, n_phone, base_sha256, spans, score`` of every row.

    Counts and the digest are those of the base kinds, ``spans`` names all as ``kind:start:end``, comma-joined, and
    ``score`` is the highest (0 without a span).
    """
    names = [k.name for k in BASE]
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    told = lambda spans: F.array_join(F.transform(spans, one), ",")
    own = F.filter("spans", lambda s: s["kind"].isin(names))
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("bigint")
    return find_personal(docs, id, text).select(
        F.col(f"`{id}`"),
        *[count(name).alias(f"n_{name}") for name in names],
        F.sha2(told(own), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max("spans.score"), F.lit(0.0)).alias("score"),
    )
