import math
import re
import zlib
from collections import Counter

import pytest

from panelspark.llm import language
from panelspark.llm.language import UNKNOWN, groups, held_out, identify, keep_known, predict_languages, train

TRAIN = [
    ("en", "The cat sat on the mat. The dog ran!"),
    ("en", "then there, the other"),
    ("de", "Der Hund und die Katze, über Größe"),
    ("de", "und dann der andere"),
    ("xx", "日本 日本"),
]


def clean(text):
    return re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", text.lower().encode())


def brute_bits(lang, text):
    """Plain prediction by partial matching, byte by byte."""
    follow = [{} for _ in range(4)]
    for other, sample in TRAIN:
        if other == lang:
            data = b"   " + clean(sample)
            for i in range(3, len(data)):
                for k in range(4):
                    follow[k].setdefault(data[i - k : i], Counter())[data[i]] += 1
    data, bits = b"   " + clean(text), 0.0
    for i in range(3, len(data)):
        for k in (3, 2, 1, 0):
            seen = follow[k].get(data[i - k : i])
            if seen is None:
                continue
            both = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / both)
                break
            bits -= math.log2(len(seen) / both)
        else:
            bits += 8
    return bits


@pytest.fixture(scope="module")
def trees(spark):
    return train(spark.createDataFrame(TRAIN, "lang string, text string"))


def test_code_lengths_equal_brute_force(spark, trees):
    texts = ["the mat", "der hut", "Zyx wvu", "日本", "日x本", "q", "über the ÿ dog", "a" * 50, "ther--42--then", "é"]
    rows = identify(spark.createDataFrame([(t,) for t in texts], "text string"), trees).collect()
    assert [r.text for r in rows] == texts
    for r in rows:
        bits = {lang: brute_bits(lang, r.text) for lang in ("de", "en", "xx")}
        best = min(bits, key=lambda x: (round(bits[x], 3), x))
        assert r.lang_pred == best
        assert r.score == pytest.approx(1 / sum(2 ** (bits[best] - b) for b in bits.values()), rel=1e-3)


def test_held_out_accuracy_on_whole_documents(documents):
    rows = predict_languages(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def test_labels_of_held_out_rows_play_no_part(spark, documents):
    from pyspark.sql import functions as F

    spoiled = documents.withColumn("lang", F.when(held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang")))
    a = {r.doc_id: (r.lang_pred, r.score) for r in predict_languages(documents).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in predict_languages(spoiled).collect()}
    assert a == b


def test_odd_documents(odd_documents):
    rows = predict_languages(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == UNKNOWN and by_id[i].score == 0 for i in (1, 2, 7, 8))
    assert by_id[4].lang_pred in ("en", "fr", "de")
    assert by_id[None].held_out is False
    assert predict_languages(odd_documents.limit(0)).count() == 0


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id bigint, text string, lang string")
    row = predict_languages(docs).first()
    assert (row.lang_pred, row.score) == (UNKNOWN, 0.0)


def test_a_rare_language_beside_a_hot_one_keeps_all_its_strings(spark):
    hot = [("hot", f"{a}{b}{c} {c}{a}{b}") for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"] * 3
    rare = [("rare", "zyzzyva zymurgy über")]
    given = spark.createDataFrame(hot + rare, "lang string, text string")
    texts = spark.createDataFrame([("zyzzyva",), ("aiq qai",), ("über",), ("bjr",), ("y",)], "text string")
    whole = identify(texts, train(given)).collect()
    assert [r.lang_pred for r in whole] == ["rare", "hot", "rare", "hot", "rare"]
    for bound in (1, 20, 500, 5000):
        assert identify(texts, train(given, "text", "lang", bound)).collect() == whole


def test_long_texts_are_cut_without_a_trace(spark, trees, monkeypatch):
    import numpy as np

    from panelspark.llm.language import code_lengths

    texts = ["the mat  ", "  der hut -- und 42 Größe, 日本 " * 40, "", " --- ", "!" * 300 + "a", "then"]
    raw = [t.lower().encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    _, want, size = code_lengths(trees, data, bounds)
    for cut in (1, 2, 5, 64):
        monkeypatch.setattr(language, "SLICE", cut)
        _, found, n_bytes = code_lengths(trees, data, bounds)
        assert np.allclose(found, want, atol=1e-6) and (n_bytes == size).all()


def test_memory_of_a_very_long_text_and_of_many_languages(trees):
    import tracemalloc

    import numpy as np

    data = np.frombuffer(b"the cat sat on the mat and the dog " * 500_000, np.uint8)
    tracemalloc.start()
    language.code_lengths(trees, data, np.array([0, len(data)]))
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()
    runs = groups({f"l{i:03}": 100_000 for i in range(200)}, language.CELLS)
    assert sum(map(len, runs)) == 200 and max(len(r) ** 2 * 100_000 for r in runs) <= language.CELLS


def test_texts_no_language_explains_go_and_clean_ones_stay(spark, documents):
    import random

    draw = random.Random(4)
    junk = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(3000))
    foreign = "zażółć gęślą jaźń wszystkich chrząszczy brzmiących w trzcinie szczebrzeszyńskiej " * 30
    fields = documents.schema
    rows = [tuple({"doc_id": 10**9 + i, "text": t}.get(f.name) for f in fields) for i, t in enumerate([junk, foreign])]
    kept = keep_known(documents.unionByName(spark.createDataFrame(rows, fields)))
    assert kept.where("doc_id >= 1000000000").count() == 0
    assert kept.count() == documents.where(r"text rlike '\\p{L}'").count()
