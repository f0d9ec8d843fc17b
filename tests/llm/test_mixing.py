import math
from collections import Counter, defaultdict
from hashlib import md5

import duckdb
import pytest

from panelspark.llm import mixing
from panelspark.llm.mixing import draw, mix
from panelspark.llm.queries import ORACLE, QUERIES


def tokens(text):
    return len(text.split(" ")) if text else 0


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w)


def checked(rows, drawn, epochs):
    """Blocks are whole permutations, the last one as far as the budget goes; returns drawn shares."""
    total, ids = Counter(), defaultdict(list)
    for r in rows:
        name = "" if r.source is None else "=" + r.source
        total[name] += tokens(r.text)
        ids[name].append((r.doc_id, tokens(r.text)))
    got = defaultdict(lambda: defaultdict(list))
    for r in drawn:
        got["" if r.source is None else "=" + r.source][r.block].append((r.doc_id, r.order_key))
    spent = Counter()
    for name, blocks in got.items():
        size = dict(ids[name])
        assert sorted(blocks) == list(range(len(blocks)))
        for block, members in blocks.items():
            for doc, key in members:
                assert key == md5(f"42|{name}|{block}|{'' if doc is None else doc}".encode()).hexdigest()
            spent[name] += sum(size[doc] for doc, _ in members)
            order = sorted((md5(f"42|{name}|{block}|{'' if d is None else d}".encode()).hexdigest(), d) for d, _ in ids[name])
            # every block is the front of its permutation
            assert sorted(key for _, key in members) == [key for key, _ in order[: len(members)]]
            if block < len(blocks) - 1:
                assert len(members) == len(ids[name])
    return total, spent


@pytest.mark.parametrize("piece_rows", [10_000, 3])
def test_budgets_and_permutations(spark, documents, monkeypatch, piece_rows):
    monkeypatch.setattr(mixing, "PIECE_ROWS", piece_rows)
    rows = documents.collect()
    drawn = draw(documents, epochs=2.5, entropy=0.999, repeats=None).collect()
    total, spent = checked(rows, drawn, 2.5)
    whole = sum(total.values())
    assert sum(spent.values()) <= 2.5 * whole + len(total)
    longest = max(tokens(r.text) for r in rows)
    weights = [spent[s] / (2.5 * whole) for s in total]
    assert entropy([w / sum(weights) for w in weights]) > 0.99 * math.log(len(total))
    assert all(2.5 * whole / len(total) * 0.7 - longest < spent[s] < 2.5 * whole / len(total) * 1.6 for s in total)


def test_repetition_limit_holds(spark):
    rows = [(i, "w " * 9 + "w", "big" if i < 900 else f"s{i % 3}") for i in range(909)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    free = Counter(r.source for r in draw(docs, entropy=1.0, repeats=None).collect())
    assert max(free.values()) - min(free.values()) <= 2
    held = draw(docs, entropy=1.0, repeats=4.0).collect()
    small = Counter((r.source, r.block) for r in held if r.source != "big")
    assert max(b for _, b in small) <= 3
    assert sum(n for (s, _), n in small.items() if s == "s0") in (11, 12)
    kept = Counter(r.source for r in draw(docs, entropy=0.0, repeats=None).collect())
    assert kept == Counter(r[2] for r in rows)


def test_sql_gives_the_same_rows(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(ORACLE["op10_temperature_mix"]).fetchall()
    got = [tuple(r) for r in QUERIES["op10_temperature_mix"](spark, sf).collect()]
    assert sorted(got) == sorted(want)


def test_odd_documents(odd_documents):
    drawn = draw(odd_documents, epochs=3.0).collect()
    checked(odd_documents.collect(), drawn, 3.0)
    assert {None, "a", "b", "c"} == {r.source for r in drawn}
    assert mix(odd_documents).columns == odd_documents.columns
    assert draw(odd_documents.limit(0)).count() == 0
    silent = odd_documents.where("doc_id in (1, 2)")
    assert sorted(r.doc_id for r in draw(silent).collect()) == [1, 2]
