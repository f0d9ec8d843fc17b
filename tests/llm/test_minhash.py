import random
from hashlib import sha256

import numpy as np
import pytest

from panelspark.llm import minhash
from panelspark.llm.minhash import classes, fingerprint_edits, likeness, shingles, signature, similar_trees


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_estimate_jaccard(documents):
    texts = [r.text for r in documents.limit(60).collect()]
    draw, errors = random.Random(1), []
    for t in texts:
        words = t.split()
        changed = " ".join(w if draw.random() > 0.03 else "zz" for w in words)
        a, b = shingles(t), shingles(changed)
        assert len(a) == len(plain_shingles(t))
        errors.append(likeness(signature(a), signature(b)) - jaccard(plain_shingles(t), plain_shingles(changed)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def grouped(sets, similar=0.8):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        if label[i] == i:
            todo = [i]
            while todo:
                x = todo.pop()
                for y in range(len(sets)):
                    if y != i and label[y] == y and jaccard(sets[x], sets[y]) >= similar:
                        label[y] = i
                        todo.append(y)
    return label


def test_trees_join_what_is_similar():
    draw = random.Random(2)
    sets = []
    for _ in range(8):
        base = draw.sample(range(10_000), 60)
        sets += [set(base[draw.randint(0, 9) :] + draw.sample(range(10_000), draw.randint(0, 6))) for _ in range(8)]
    sets += [set(), set()]
    arrays = [np.array(sorted(s), np.uint32) for s in sets]
    pairs = list(similar_trees(arrays, 0.8))
    assert all(jaccard(sets[a], sets[b]) >= 0.8 for a, b in pairs)
    want = grouped(sets)
    root = list(range(len(sets)))
    for a, b in pairs:
        a, b = root[a], root[b]
        root = [min(a, b) if r in (a, b) else r for r in root]
    assert root == want


def wanted(rows):
    rows = sorted(rows, key=lambda r: -r.doc_id)
    for k, r in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)].text or ""
        t = r.text or ""
        half = len(t) // 2
        yield r.doc_id, t, t[: len(t) - half] + nxt[:half], nxt


@pytest.mark.parametrize("parts", [1, 5])
def test_whole_documents(spark, documents, parts, monkeypatch):
    monkeypatch.setattr(minhash, "partitions", lambda _: parts)
    rows = documents.collect()
    got = {r.doc_id: r for r in fingerprint_edits(documents).collect()}
    assert len(got) == len(rows)
    for id, text, edited, nxt in wanted(rows):
        r = got[id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == sha256(edited.encode()).hexdigest()
        own = signature(shingles(text))
        assert r.fingerprint == minhash.shown(own) and r.edited_fingerprint == minhash.shown(signature(shingles(edited)))
        assert r.near_edited == likeness(own, signature(shingles(edited)))
        assert r.near_next == likeness(own, signature(shingles(nxt)))
    rows = sorted(rows)
    label = grouped([plain_shingles(r.text) for r in rows])
    assert sum(got[r.doc_id].class_id == rows[k].doc_id for r, k in zip(rows, label)) >= len(rows) - 1


@pytest.mark.parametrize("tile", [4096, 8])
def test_classes_of_many_near_copies(spark, tile):
    draw = random.Random(3)
    base = [f"w{draw.randint(0, 5000)}" for _ in range(150)]
    texts = []
    for _ in range(40):
        words = list(base)
        words[draw.randrange(150)] = "changed"
        texts.append(" ".join(words))
    texts += [" ".join(f"u{draw.randint(0, 5000)}" for _ in range(100)) for _ in range(20)] + [texts[0]] * 5
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.id: r.class_id for r in classes(docs, tile=tile).collect()}
    sets = [plain_shingles(t) for t in texts]
    assert [got[i] for i in range(len(texts))] == grouped(sets)


def test_odd_documents(odd_documents):
    rows = fingerprint_edits(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(by_id[3]) == 2 and by_id[3][0].fingerprint == by_id[4][0].fingerprint
    assert by_id[4][0].near_next == 1.0 and by_id[4][0].class_id == 3
    assert by_id[2][0].near_next == 1.0 and by_id[2][0].n_chars == 0
    # null ids come last and are followed by the first
    assert by_id[1][0].near_next == 0 and by_id[None][0].near_next == 0
    last, first = "A text without a number, and some more words in it", "Größe ▁ 日本 \U0001f600 naïve \x00 end"
    edited = last[: len(last) - len(last) // 2] + first[: len(last) // 2]
    assert by_id[None][0].edited_sha256 == sha256(edited.encode()).hexdigest()
    assert fingerprint_edits(odd_documents.limit(0)).count() == 0
    one = fingerprint_edits(odd_documents.where("doc_id = 4")).first()
    assert one.near_next == 1.0
