import math
import re
from collections import Counter

import numpy as np
import pytest

from panelspark.llm import search as module
from panelspark.llm.search import Heaps, search, terms


def plain_terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def plain_search(docs, items, top=20):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    N, L = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        wanted, found = Counter(plain_terms(text)), []
        for i, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * N) // L
            score = sum(
                k * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t, k in wanted.items()
                if t in c
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_terms_equal_the_pattern(documents):
    texts = [r.text for r in documents.limit(50).collect()] + ["", "ÀB c\x7fd[e]f_g@h:1²x\x00Y"]
    for t in texts:
        assert [w.decode() for w in terms(t)] == plain_terms(t)


def test_whole_tables_equal_brute_force(spark, documents, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain_search([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = search(documents, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert rows(got) == want
    # the same with several indexes
    assert rows(search(documents, items, postings=700)) == want


def test_small_portions_do_not_change_scores(monkeypatch):
    draw = np.random.default_rng(4)
    index = module.Index([3, 5, 9], draw.integers(1, 50, 40), np.arange(0, 82, 2), draw.integers(0, 3, 80), draw.integers(1, 4, 80))
    doc, term = np.sort(draw.integers(0, 30, 300)), draw.integers(0, 40, 300)
    worth = draw.integers(1, 1000, 300)
    want = np.zeros((30, 3), np.int64)
    for d, t, v in zip(doc, term, worth):
        for k in range(index.begin[t], index.begin[t + 1]):
            want[d, index.item[k]] += v * index.times[k]
    assert (index.scores(doc, term, worth, 30) == want).all()
    monkeypatch.setattr(module, "OPENED", 7)
    assert (index.scores(doc, term, worth, 30) == want).all()


def test_heaps_keep_the_best_and_break_ties_by_id():
    draw = np.random.default_rng(5)
    scores, ids = draw.integers(0, 12, (500, 4)), [None, *draw.permutation(499).tolist()]
    heaps = Heaps(4, 7)
    for at in range(0, 500, 60):
        heaps.add(scores[at : at + 60], ids[at : at + 60])
    item, found, score = heaps.rows()
    for i in range(4):
        want = sorted((-int(s), k is None, k or 0) for s, k in zip(scores[:, i], ids) if s > 0)[:7]
        assert sorted((-s, k is None, k or 0) for j, k, s in zip(item, found, score) if j == i) == want


def test_odd_rows(spark, odd_documents, documents):
    items = spark.createDataFrame(
        [(1, "the same words, THE same", 0.1), (1, "the same words, THE same", 0.2), (None, "word number", 0.3), (2, None, 0.4), (3, "", 0.5), (4, "größe 日本", 0.6)],
        "item_id bigint, text string, score double",
    )
    want = plain_search([(r.doc_id, r.text) for r in odd_documents.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows(search(odd_documents, items)) == want
    assert search(odd_documents.limit(0), items).collect() == []
    assert search(odd_documents, items.limit(0)).collect() == []
    assert search(odd_documents.where("text is null"), items).collect() == []


@pytest.mark.parametrize("top", [1, 3])
def test_text_ids_and_other_names(spark, top):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "x z z"), (None, "x y")], "name string, body string")
    items = spark.createDataFrame([("q", "x y")], "name string, question string")
    got = search(docs.withColumnRenamed("name", "doc"), items, "doc", "body", "name", "question", top)
    assert [r.doc for r in got.orderBy("rank").collect()] == ["a", "b", None][:top]
