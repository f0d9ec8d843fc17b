import random
import re

import numpy as np
import pytest
import xxhash

from panelspark.llm.components import components
from panelspark.llm.simhash import close_links, fingerprint, keep_one, masks, near_duplicates


def plain_fingerprint(text, shingle=4, seed=42):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=seed).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(items, linked):
    """Smallest position reachable, by plain search."""
    label = {}
    for i in range(len(items)):
        if i in label:
            continue
        todo, label[i] = [i], i
        while todo:
            x = todo.pop()
            for y in range(len(items)):
                if y not in label and linked(items[x], items[y]):
                    label[y] = i
                    todo.append(y)
    return [label[i] for i in range(len(items))]


def near(a, b):
    return (a ^ b).bit_count() <= 4


def test_fingerprint_of_odd_texts():
    for text in ["", " \n", "one", "a b c", "A b\x0bC d e f", "x " * 1000, "É é ß a b c d e", None]:
        assert fingerprint(text or "") == plain_fingerprint(text)


def test_every_close_pair_agrees_on_a_mask():
    draw = random.Random(1)
    for level in (1, 2, 3):
        found = masks(level)
        assert len(found) == 5**level
        for _ in range(300):
            difference = sum(1 << b for b in draw.sample(range(64), 4))
            assert any(difference & m == 0 for m in found)


def cloud(n, seed):
    """Dense clouds, chains and lone fingerprints."""
    draw = random.Random(seed)
    found = set()
    for _ in range(3):
        x = draw.getrandbits(64)
        for _ in range(n // 6):
            found.add(x ^ sum(1 << draw.randrange(64) for _ in range(draw.randint(0, 3))) & (2**64 - 1))
        for _ in range(20):
            x ^= 1 << draw.randrange(64) | 1 << draw.randrange(64) | 1 << draw.randrange(64)
            found.add(x)
    found |= {draw.getrandbits(64) for _ in range(n // 3)}
    return sorted(found)


@pytest.mark.parametrize("node_rows", [4096, 40, 6])
def test_links_connect_what_brute_force_connects(spark, node_rows):
    bits = cloud(400, node_rows)
    signed = np.array(bits, np.uint64).view(np.int64).tolist()
    links = close_links(spark.createDataFrame([(b,) for b in signed], "bits bigint"), node_rows=node_rows)
    root = {r.node: r.root for r in components(links).collect()}
    got = [root.get(s, s) for s in signed]
    want = grouped(bits, near)
    seen = {}
    assert all(seen.setdefault(g, w) == w for g, w in zip(got, want))
    assert len(set(got)) == len(set(want))


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    both = spark.createDataFrame([*chain, *star, (5, 5), (None, 3), (7, None)], "a bigint, b bigint")
    rows = components(both).collect()
    assert len(rows) == 601
    assert len({r.root for r in rows if r.node < 1000}) == 1
    assert len({r.root for r in rows}) == 2
    assert components(both.limit(0)).count() == 0


def test_whole_documents(documents):
    rows = sorted(documents.select("doc_id", "text").collect())
    bits = [plain_fingerprint(r.text) for r in rows]
    want = grouped(bits, near)
    got = sorted(near_duplicates(documents).collect())
    assert [(r.doc_id, r.fingerprint, r.component_id) for r in got] == [
        (r.doc_id, f"{b:016x}", rows[w].doc_id) for r, b, w in zip(rows, bits, want)
    ]
    kept = keep_one(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({rows[w].doc_id for w in want})


def test_odd_documents(odd_documents):
    got = near_duplicates(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by_id = {r.doc_id: r for r in got}
    assert {by_id[i].component_id for i in (1, 2, 7)} == {1}
    assert by_id[1].fingerprint == "0" * 16
    assert by_id[3].component_id == by_id[4].component_id == 3
    assert by_id[None].component_id is None
    kept = keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 5, 6, 8, 9]
    assert near_duplicates(odd_documents.limit(0)).count() == 0
    assert keep_one(odd_documents.limit(0)).count() == 0


def test_every_component_keeps_one_row(spark):
    def prose(seed):
        draw = random.Random(seed)
        return " ".join("".join(draw.choices("abcdefgh", k=6)) for _ in range(60))

    rows = [
        # texts without an id, two of them equal, one equal to a text with an id
        (None, prose(1)), (None, prose(2)), (None, prose(3)), (None, prose(3)), (None, prose(4)), (9, prose(4)),
        # one id with texts of several groups, one of which a smaller id has too
        (5, prose(5)), (5, prose(6)), (5, prose(7)), (2, prose(7)),
        (7, None), (7, prose(8)),
    ]
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, _key int")
    kept = keep_one(table)
    assert kept.columns == table.columns
    want = [(None, prose(1)), (None, prose(2)), (None, prose(3)), (9, prose(4)), (5, prose(5)), (5, prose(6)), (2, prose(7)), (7, None), (7, prose(8))]
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t in want)
