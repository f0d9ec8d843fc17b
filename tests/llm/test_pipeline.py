from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from panelspark.llm.language import predict_languages
from panelspark.llm.quality import quality

from .test_mixing import checked
from .test_simhash import grouped, near, plain_fingerprint


@pytest.fixture(scope="module")
def steps(spark, documents):
    """The table before each stage and the final one."""
    tables = [documents]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], "").cache())
    return tables


def ids(table):
    return Counter(r.doc_id for r in table.select("doc_id").collect())


def test_filters_drop_what_their_operators_reject(documents, steps):
    good = {r.doc_id for r in quality(documents).collect() if r.kept}
    assert ids(steps[1]) == Counter(good) and 0 < len(good) < documents.count()
    sure = {r.doc_id for r in predict_languages(steps[1]).collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert ids(steps[2]) == Counter(sure)


def test_one_document_of_each_group_stays(steps):
    rows = sorted(steps[2].select("doc_id", "text").collect())
    label = grouped([plain_fingerprint(r.text) for r in rows], near)
    assert ids(steps[3]) == Counter({rows[k].doc_id for k in label})


def test_mixing_draws_whole_and_cut_blocks(spark, steps):
    from panelspark.llm.mixing import draw

    rows = steps[3].collect()
    drawn = draw(steps[3]).collect()
    checked(rows, drawn, 1.0)
    assert ids(steps[4]) == Counter(r.doc_id for r in drawn)


def test_ids_are_the_library_s(steps):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    rows = steps[5].collect()
    assert Counter(r.doc_id for r in rows) == ids(steps[4])
    for r in rows:
        want = library.encode(texts[r.doc_id])
        assert r.ids == want and r.n_tokens == len(want)
        assert r.decoded_sha256 == sha256(library.decode(want).encode()).hexdigest()


def test_columns_pass_through(documents, steps):
    assert all(t.columns == documents.columns for t in steps[:-1])


def test_run_gives_the_rows_of_the_last_stage(spark, sf, steps):
    got = Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == Counter((r.doc_id, r.ids_sha256) for r in steps[-1].collect())


def test_odd_and_empty_tables(spark, odd_documents):
    for table in (odd_documents, odd_documents.limit(0)):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == odd_documents.columns
        last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
        # what is left has words, letters and one row per group; a row is drawn at most nine times
        times = ids(last)
        assert set(times) <= {None, 3, 5, 6, 9} and max(times.values(), default=0) <= 9
        assert bool(times) == (not table.isEmpty())
