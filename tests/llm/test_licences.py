import random
import re

from panelspark.llm.licences import PHRASES, TEMPLATES, Automaton, Scanner, licence_summary, scan_licences


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def plain_summary(text):
    found, w = [], plain_words(text)
    for label, phrase in PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [s for s, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_matching_statistics_equal_brute_force():
    draw = random.Random(5)
    sequences = [[draw.randint(1, 4) for _ in range(draw.randint(1, 12))] for _ in range(6)]
    runs = {tuple(s[i:j]): None for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    automaton = Automaton(sequences)
    for _ in range(200):
        text = [draw.randint(1, 5) for _ in range(30)]
        for i, (size, state) in enumerate(automaton.statistics(text)):
            longest = max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in runs), default=0)
            assert size == longest
            if size:
                run = text[i + 1 - size : i + 1]
                where = {(t, e) for t, s in enumerate(sequences) for e in range(size, len(s) + 1) if s[e - size : e] == run}
                assert set(automaton.ends[state]) == where


def test_spans_cover_whole_broken_and_partial_templates():
    scanner = Scanner()
    for t, (label, text) in enumerate(TEMPLATES):
        n, _, spans = scanner.scan("some words first. " + text + " and more after")
        mine = [s for s in spans if s.template == t + scanner.phrases]
        size = len(plain_words(text))
        assert [(s.label, s.start, s.end, s.covered) for s in mine] == [(label, 3, 3 + size, size)]
    grant = TEMPLATES[1][1].split()
    broken = " ".join([*grant[:14], "oddword", *grant[14:30], "another", *grant[31:]])
    assert any(s.template == 1 + scanner.phrases for s in scanner.scan(broken)[2])
    assert not any(s.template == 1 + scanner.phrases for s in scanner.scan(" ".join(grant[:10]))[2])
    twice = scanner.scan(TEMPLATES[4][1] + " " + "x " * 60 + TEMPLATES[4][1])[2]
    assert len([s for s in twice if s.template == 4 + scanner.phrases]) == 2


def test_whole_and_odd_documents(spark, documents, odd_documents):
    made = spark.createDataFrame(
        [(1, "MIT License mit\nlicense; MIT-LICENSE mit  licensed"), (2, "the general public license general public license"), (3, "émit license")],
        "doc_id bigint, text string",
    )
    for docs in (documents, odd_documents, made, odd_documents.limit(0)):
        texts = docs.select("doc_id", "text").collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1:2])
        got = sorted(licence_summary(docs).collect(), key=key)
        want = sorted(((r.doc_id, *plain_summary(r.text)) for r in texts), key=key)
        assert [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == want
        for r in got:
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
            assert 0 <= r.score <= 1


def test_a_long_text_is_streamed(spark):
    text = "filler words " * 700_000 + "released under the MIT License " + "tail " * 10
    row = scan_licences(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row.n_words == 1_400_000 + 15
    assert [(p.start, p.label) for p in row.places] == [(1_400_003, "mit")]
    assert [(s.label, s.start, s.end) for s in row.spans] == [("mit", 1_400_000, 1_400_005)]
