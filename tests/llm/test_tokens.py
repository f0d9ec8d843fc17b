import random
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece

from panelspark.llm.codec import encode_decode
from panelspark.llm.pieces import PieceTable
from panelspark.llm.token_counts import PrefixCounts, count_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def table():
    with open(PATH, "rb") as f:
        return PieceTable(f.read())


def texts(n, most, seed):
    parts = [*"abcdethnis  ▁\n\t.,!$É日\x00𐍈<s>0x'", "the ", "ing", "   ", "tion", "▁▁▁▁▁", " " * 24, "<0x0A>", "été"]
    draw = random.Random(seed)
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, most))) for _ in range(n)]


def test_ids_and_text_equal_the_library(library, table):
    for text in [*texts(4000, 40, 1), "a" * 5000, "▁" * 100, " " * 100, "\n\n", "x y" * 3000]:
        ids = library.encode(text)
        assert table.encode(text) == ids
        assert table.decode(ids) == library.decode(ids)


def test_counts_of_all_prefixes_equal_encoding_each(library, table):
    for text in texts(150, 25, 2):
        counts = PrefixCounts(table, text)
        each = [len(library.encode(text[:n])) for n in range(len(text) + 1)]
        assert [counts.at(n) for n in range(len(text) + 1)] == each
        for budget in range(0, 14, 3):
            assert counts.longest(budget) == max(n for n, tokens in enumerate(each) if tokens <= budget)


def test_questions_are_answered_without_encoding(library, table, monkeypatch):
    for text in ["", "a" * 3000, "one word and another\nline " * 5000]:
        counts = PrefixCounts(table, text)
        with monkeypatch.context() as closed:
            closed.setattr(PieceTable, "prefixes", None)
            closed.setattr(PieceTable, "chunk_counts", None)
            for n in (0, 1, 7, len(text) // 2, len(text)):
                assert counts.at(n) == len(library.encode(text[:n]))
            fits = counts.longest(50)
        assert len(library.encode(text[:fits])) <= 50 and (fits == len(text) or counts.least[fits + 1] > 50)
        assert len(counts.counts) == len(text) + 1 and counts.counts.itemsize == 4


def test_counts_of_a_text_of_many_blocks(library, table, monkeypatch):
    monkeypatch.setattr("panelspark.llm.token_counts.BLOCK", 3)
    for text in texts(60, 30, 5):
        counts = PrefixCounts(table, text)
        assert [counts.at(n) for n in range(len(text) + 1)] == [len(library.encode(text[:n])) for n in range(len(text) + 1)]


def test_neighbours_are_what_encoding_both_texts_says(library, table):
    draw = random.Random(3)
    plain = [i for p, i in table.ids.items() if not p.startswith("▁")]
    start = [i for p, i in table.ids.items() if p.startswith("▁") and p.strip("▁")]
    for _ in range(1500):
        a, b = draw.choice(start), draw.choice(plain)
        whole = (table.text[a] + table.text[b])[1:].replace("▁", " ")
        assert table.side_by_side(a, b) == (library.encode(whole) == [a, b])


def test_operators_on_whole_and_odd_documents(library, documents, odd_documents):
    for docs in (documents, odd_documents, odd_documents.limit(0)):
        want = []
        for row in docs.collect():
            text = row.text or ""
            ids = library.encode(text)
            back = library.decode(ids)
            want.append((row.doc_id, len(text.encode()), len(ids), len(ids) > 4096,
                         sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(back.encode()).hexdigest()))
        key = lambda r: (r[0] is None, r[0] or 0, r[1:])
        counts = [tuple(r) for r in count_tokens(docs, PATH).drop("fit_chars").collect()]
        assert sorted(counts, key=key) == sorted((w[:4] for w in want), key=key)
        coded = encode_decode(docs, PATH).collect()
        assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded), key=key) == sorted(
            ((w[0], w[2], w[4], w[5]) for w in want), key=key
        )
        for row in coded:
            assert library.decode(row.ids) == row.decoded


def test_budget_of_a_long_text(library, odd_documents):
    row = count_tokens(odd_documents.where("doc_id = 5"), PATH, limit=100).first()
    text = "word " * 60_000
    assert row.over_limit and len(library.encode(text[: row.fit_chars])) <= 100
    assert all(len(library.encode(text[:n])) > 100 for n in range(row.fit_chars + 1, row.fit_chars + 20))
