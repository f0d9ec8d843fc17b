import random
import re
from hashlib import sha256
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm.runs import best_run, find_runs, kept_words, run_digests, seeds, with_planted_repeats, word_runs


def plain_runs(w, words=24, periods=3):
    """Every maximal stretch of every period, kept if no smaller period holds in it."""
    found = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            stretch = w[i : i + n]
            smaller = any(stretch[p:] == stretch[:-p] for p in range(1, q))
            if n >= max(words, periods * q) and not smaller:
                found.append((i, n, q))
            i = j + 1
    return sorted(found)


def edited(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_digests(doc_id, text):
    w = edited(doc_id, text)
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (
        len(runs),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(),
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=4), st.integers(2, 9), st.integers(2, 4))
def test_runs_equal_brute_force(texts, words, periods):
    got = word_runs([np.array(t, np.int64) for t in texts], words, periods)
    assert got == [plain_runs(t, words, periods) for t in texts]


def test_runs_inside_runs_and_at_production_length():
    draw = random.Random(3)
    for _ in range(25):
        unit = [draw.randint(0, 2) for _ in range(draw.randint(1, 14))]
        inner = unit * draw.randint(1, 12) + unit[: draw.randint(0, len(unit))]
        outer = ([draw.randint(0, 3) for _ in range(draw.randint(0, 6))] + inner) * draw.randint(1, 5)
        texts = [outer + inner, inner, outer[::-1]]
        assert word_runs([np.array(t, np.int64) for t in texts]) == [plain_runs(t) for t in texts]


def test_every_run_is_seeded_once_and_sets_stay_ordered():
    w = [1] * 60
    runs = word_runs([np.array(w), np.array([1, 2] * 30 + [3]), np.array([], np.int64)])
    assert runs == [[(0, 60, 1)], [(0, 60, 2)], []]
    order, lcp = np.array([4, 2, 0, 3, 1]), np.array([0, 1, 3, 0, 2])
    # positions 0 and 2 unite at 3, 1 and 3 at 2, then 4 joins 0 and 2
    assert list(seeds(order, lcp)) == [(0, 2, 3), (1, 3, 2), (2, 4, 1)]


def test_best_run_and_kept_words():
    assert best_run([(0, 30, 10), (5, 24, 8), (9, 60, 20)]) == (0, 30, 10)
    assert best_run([(0, 30, 10), (5, 25, 8)]) == (5, 25, 8)
    assert best_run([]) is None
    assert kept_words(6, [(1, 4, 2)]).tolist() == [True, True, True, False, False, True]


def test_whole_documents_equal_brute_force(spark, documents, odd_documents):
    small = documents.where("length(text) < 1500")  # the brute force is quadratic
    for docs in (small, odd_documents.where("length(text) < 1000 or text is null"), odd_documents.limit(0)):
        key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
        got = sorted((tuple(r) for r in run_digests(with_planted_repeats(docs)).collect()), key=key)
        want = sorted(((r.doc_id, *plain_digests(r.doc_id, r.text)) for r in docs.select("doc_id", "text").collect()), key=key)
        assert got == want
    assert any(plain_runs(edited(r.doc_id, r.text)) for r in small.limit(100).collect())


def test_odd_rows(spark, odd_documents):
    rows = {(r.doc_id, r.n_words): r for r in find_runs(odd_documents).collect()}
    assert rows[5, 60_000].runs == [(0, 60_000, 1)] and rows[5, 60_000].collapsed == "word"
    assert rows[1, 0].runs == [] and rows[1, 0].collapsed == ""
    assert rows[6, 1].runs == [] and len(rows[6, 1].collapsed) == 70_000
    assert find_runs(odd_documents).where("doc_id = 3").count() == 2
    assert find_runs(odd_documents, collapsed=False).where("collapsed is not null").count() == 0


def test_a_long_text(spark):
    line = " ".join(f"w{i}" for i in range(997))
    text = " ".join([line] * 300) + " end"
    row = find_runs(spark.createDataFrame([("a", text)], "name string, body string"), "name", "body").first()
    assert row.runs == [(0, 299_100, 997)] and row.collapsed == line + " end"
