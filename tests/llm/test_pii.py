import random
import re
import time
from hashlib import sha256

import pytest

from panelspark.llm.pii import IBAN_LENGTHS, account_end, find_personal, luhn, mod_97, personal_digest, scan

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for k, d in enumerate(reversed([int(c) for c in digits])):
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def plain_base(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x[-1] for x in sorted(out)]


def told(spans):
    return [f"{s.kind}:{s.start}:{s.end}" for s in spans]


def base_of(text):
    return [x for x in told(scan(text)) if x.split(":")[0] in PATTERNS]


def test_base_spans_equal_the_patterns_on_hostile_texts():
    draw = random.Random(7)
    for alphabet in ("ab@.-_1 ", "01.", "0123456789 -", "+12 ().-", "a1@.+-% 9é_", "1.+@a 2-"):
        for _ in range(3000):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60)))
            assert base_of(text) == plain_base(text), text


@pytest.mark.parametrize(
    "text",
    ["a" * 400_000, "1" * 400_000, "1." * 200_000, "a.b@" * 100_000, "a@b" * 100_000, "+1 (" * 100_000, "+1" + "(" * 400_000, "1 " * 200_000, "AB12" * 100_000,
     "AB12 " * 80_000, "123-45-" * 50_000, "a@b." * 100_000, "0" * 5000 + ".1.1.1"],
)
def test_long_texts_take_linear_time(text):
    start = time.time()
    found = scan(text)
    assert time.time() - start < 10
    if text.startswith("0"):
        assert told(found) == ["ip:0:5006"]


def test_checksums():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    draw = random.Random(1)
    for _ in range(500):
        digits = "".join(draw.choice("0123456789") for _ in range(draw.randint(12, 19)))
        assert luhn(digits) == plain_luhn(digits)
    assert mod_97("GB82 WEST 1234 5698 7654 32") and not mod_97("GB82 WEST 1234 5698 7654 33")
    assert account_end("DE89370400440532013000") == 22 and account_end("DE89370400440532013001") == 0
    assert account_end("GB82 WEST 1234 5698 7654 32 AND") == 27
    assert account_end("ZZ82WEST12345698765432") == 0 and all(15 <= n <= 32 for n in IBAN_LENGTHS.values())


def test_words_nearby_move_the_score():
    def score(text, kind):
        return {s.kind: s.score for s in scan(text)}.get(kind)

    assert score("4111 1111 1111 1111", "card") == 0.7
    assert score("credit card 4111 1111 1111 1111", "card") == 0.95
    assert score("invoice 4111 1111 1111 1111", "card") == 0.45
    # what the method adds needs its words, a checksum does without
    assert score("it has 078-05-1120 in it", "ssn") is None and score("SSN 078-05-1120", "ssn") == 0.65
    assert score("SSN 666-05-1120", "ssn") is None
    assert score("call (555) 123-4567 now", "inland_phone") == 0.65 and score("see (555) 123-4567", "inland_phone") is None
    assert score("DE89 3704 0044 0532 0130 00", "iban") == 0.95
    # a number that is a base span already is not told twice
    assert told(scan("call +1 (555) 123-4567")) == ["phone:5:22"]


def test_whole_documents_equal_brute_force(spark, documents, odd_documents):
    for docs in (documents, odd_documents, odd_documents.limit(0)):
        want = []
        for r in docs.select("doc_id", "text").collect():
            base = plain_base(r.text)
            n = [sum(x.startswith(k + ":") for x in base) for k in PATTERNS]
            want.append((r.doc_id, *n, sha256(",".join(base).encode()).hexdigest()))
        got = personal_digest(docs).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1:])
        assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
        for r in got:
            assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.spans)
            kept = [x for x in r.spans.split(",") if x.split(":")[0] in PATTERNS]
            assert sha256(",".join(kept).encode()).hexdigest() == r.base_sha256
    assert documents.count() and any(r.n_card for r in personal_digest(documents).collect())


def test_positions_are_code_points(spark):
    docs = spark.createDataFrame([("k", "\U0001f600é a.b@c.de!")], "name string, body string")
    (row,) = find_personal(docs, "name", "body").collect()
    assert [(s.kind, s.start, s.end) for s in row.spans] == [("email", 3, 11)]
