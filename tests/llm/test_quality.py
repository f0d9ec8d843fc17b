import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm.quality import ABSTAIN, BAD, GOOD, RULES, SLOTS, Reading, fit_labels, fit_scorer, quality, readings, score, train


def test_measures_equal_plain_counting(documents):
    texts = [r.text for r in documents.limit(40).collect()] + ["", None, "  \n ", "One two.", "A!! A!! b || 12"]
    at = 0
    for reading in readings(pa.array(texts)):
        for i in range(reading.texts):
            words = (texts[at] or "").encode().split()
            at += 1
            n = max(len(words), 1)
            assert reading.words[i] == len(words)
            assert reading.measures["repeats"][i] == pytest.approx(sum(a == b for a, b in zip(words, words[1:])) / n)
            assert reading.measures["length"][i] == pytest.approx(sum(len(w.decode()) for w in words) / n)
            caps = sum(len([c for c in w if 65 <= c <= 90]) >= 2 and not any(97 <= c <= 122 or c > 127 for c in w) for w in words)
            assert reading.measures["capitals"][i] == pytest.approx(caps / n)
    assert at == len(texts)


def test_sums_are_features_times_weights(documents):
    texts = [r.text for r in documents.limit(30).collect()] + [None, "", "a", "a b"]
    weights = np.random.default_rng(1).normal(size=2 * SLOTS)
    for reading in readings(pa.array(texts)):
        assert np.allclose(reading.features() @ weights, reading.sums(weights), atol=1e-4)


SCRIPTS = {
    "zh": "城市的图书馆每天早上九点开门。许多学生喜欢在那里安静地读书，也有老人来看报纸。管理员会帮助读者寻找他们需要的资料，并且介绍新到的书籍。",
    "th": "ห้องสมุดของเมืองเปิดทุกวันตั้งแต่เก้าโมงเช้า นักเรียนหลายคนชอบอ่านหนังสือที่นั่นอย่างเงียบสงบ และผู้สูงอายุก็มาอ่านหนังสือพิมพ์",
    "hi": "शहर का पुस्तकालय हर सुबह नौ बजे खुलता है। बहुत से छात्र वहाँ शांति से पढ़ना पसंद करते हैं। बुज़ुर्ग लोग भी अख़बार पढ़ने आते हैं।",
    "el": "Η βιβλιοθήκη της πόλης ανοίγει κάθε πρωί στις εννέα. Πολλοί μαθητές διαβάζουν εκεί με ησυχία. Έρχονται και ηλικιωμένοι για τις εφημερίδες.",
    "ru": "Общеобразовательная государственная библиотека открывается ежедневно утром. Старшеклассники предпочитают заниматься самостоятельно. Преподаватели рекомендуют дополнительную литературу.",
    "ar": "تفتح مكتبة المدينة أبوابها كل صباح في الساعة التاسعة. يحب كثير من الطلاب القراءة هناك بهدوء. هل يأتي كبار السن لقراءة الصحف؟",
    "ja": "町の図書館は毎朝九時に開きます。多くの学生がそこで静かに本を読みます。お年寄りも新聞を読みに来ます。",
    "ko": "도시의 도서관은 매일 아침 아홉 시에 문을 엽니다. 많은 학생들이 그곳에서 조용히 책을 읽습니다. 어르신들도 신문을 보러 오십니다.",
}


def test_clean_text_of_other_scripts_is_kept(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    rows = [(-1 - 2 * i, text) for i, text in enumerate(SCRIPTS.values())]
    rows += [(-2 - 2 * i, " ".join([text.split()[0]] * 60)) for i, text in enumerate(SCRIPTS.values())]
    added = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality(docs.unionByName(added)).where("doc_id < 0").collect()}
    for i, name in enumerate(SCRIPTS):
        clean, junk = got[-1 - 2 * i], got[-2 - 2 * i]
        assert clean.kept and clean.weak_good > 0.5, (name, clean)
        assert not junk.kept, (name, junk)  # one word over and over
    # and if nothing else is there
    only = spark.createDataFrame([(i, t) for i, t in enumerate(SCRIPTS.values())], "doc_id bigint, text string")
    assert all(r.kept for r in quality(only).collect())


def test_points_and_marks_of_other_scripts():
    for name, text in SCRIPTS.items():
        (reading,) = readings(pa.array([text, "plain words."]))
        words = text.split()
        assert reading.measures["length"][0] == pytest.approx(sum(map(len, words)) / len(words))
        assert reading.is_loose.tolist() == [name in ("zh", "th", "ja"), False]
        assert reading.known[0] == pytest.approx(0, abs=0.02) and reading.known[1] == 1
        if name != "th":
            assert reading.measures["sentences"][0] > 0


def test_label_model_recovers_accuracies():
    draw = np.random.default_rng(2)
    n = 60_000
    kind = draw.choice(3, n, p=[0.8, 0.12, 0.08])
    code = np.zeros(n, int)
    for i in range(len(RULES)):
        alarm = np.where(kind == i + 1, 0.95, 0.004)
        vote = np.where(draw.random(n) < alarm, BAD, np.where(draw.random(n) < 0.9, GOOD, ABSTAIN))
        code += vote * 3**i
    patterns, count = np.unique(code, return_counts=True)
    model = fit_labels(patterns, count)
    assert model.kinds[0] == pytest.approx(0.8, abs=0.03)
    assert ((model.posterior(code) > 0.5) == (kind == 0)).mean() > 0.97
    for i, (name, *_) in enumerate(RULES):
        vote = code // 3**i % 3
        right = ((vote == GOOD) & (kind == 0)) | ((vote == BAD) & (kind > 0))
        assert model.accuracies()[name] == pytest.approx(right.sum() / (vote > 0).sum(), abs=0.02)


def test_scorer_separates_soft_labels():
    draw = np.random.default_rng(3)
    x = draw.random((500, 2 * SLOTS)).astype(np.float32)
    good = np.where(x[:, 3] > 0.5, 0.95, 0.05).astype(np.float32)
    w, b = fit_scorer(x, good)
    assert (((x @ w + b) > 0) == (good > 0.5)).mean() > 0.9
    assert fit_scorer(x[:0], good[:0])[1] == 0


def test_hand_made_labels_agree(spark, documents, sf):
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/labels.parquet")
    whole = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet")
    rows = quality(whole).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) / len(good) > 0.995
    assert sum(r.kept for r in bad) / len(bad) < 0.05
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_documents(odd_documents):
    rows = quality(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].score == 0 and not by_id[i].kept for i in (1, 2, 7))
    assert quality(odd_documents.limit(0)).count() == 0
    scored = score(odd_documents, train(odd_documents), posterior="p", out="s")
    assert scored.columns == [*odd_documents.columns, "p", "s"] and scored.count() == len(rows)


def test_copies_do_not_fill_the_sample(spark, documents, monkeypatch):
    from pyspark.sql import functions as F

    from panelspark.llm import quality as module

    texts = documents.select("text").where("length(text) > 50").distinct()
    hot = texts.orderBy(F.xxhash64("text")).limit(1)
    copies = hot.crossJoin(spark.range(300)).select("text")
    seen = []
    monkeypatch.setattr(module, "fit_scorer", lambda x, good: seen.append(x) or fit_scorer(x, good))
    train(texts.unionByName(copies), sample=20)
    assert len(seen[0]) == 20 and len(np.unique(seen[0], axis=0)) == 20
