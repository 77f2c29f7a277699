from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators import chapters, concepts, index, layout, quiz, scores, similarity, textrank, tfidf


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([(1, ["모듈", "응집력", "모듈", "결합도", "설계"]), (2, ["설계", "원리", "모듈"]), (3, []), (4, ["하나", "하나"])], "doc_id long, tokens array<string>")


def test_single_document_tfidf(pair):
    rows = {r.term: r.score for r in tfidf.fit_single(pair.filter("doc_id = 1")).collect()}
    assert rows["모듈"] == pytest.approx(math.log(3) * (math.log(10 / 3) + 1), abs=1e-6)
    assert "모듈_응집력" in rows


def test_corpus_mean_counts_documents_without_the_term(pair):
    counts = tfidf.term_counts(pair, with_bigrams=False)
    vocab = tfidf.vocabulary(counts, 4)
    got = {r.term: r.score for r in tfidf.corpus_scores(tfidf.transform(counts, vocab), 4).collect()}
    assert got["원리"] == pytest.approx(math.log(2) * (math.log(5 / 2) + 1) / 4, abs=1e-6)


def test_power_iteration_matches_dense():
    rng = np.random.default_rng(1)
    n = 12
    a = (rng.random((n, n)) < 0.3) * rng.random((n, n))
    src, dst = np.nonzero(a)
    got, _ = textrank.power(src, dst, a[src, dst], n)
    m = (a / np.maximum(a.sum(1, keepdims=True), 1e-300)).T
    want = np.full(n, 1 / n)
    for _ in range(100):
        new = 0.15 / n + 0.85 * m @ want
        moved, want = np.abs(new - want).sum(), new
        if moved < 1e-4:
            break
    assert np.allclose(got, want)


def test_textrank_falls_back_to_counts(pair):
    got = {(r.doc_id, r.term): r.score for r in textrank.keywords(pair).collect()}
    assert got[(4, "하나")] == 2.0
    assert not any(d == 3 for d, _ in got)


def test_repeated_neighbour_adds_its_nearest_weight(spark):
    df = spark.createDataFrame([(1, ["a", "b", "b"])], "doc_id long, tokens array<string>")
    got = {(r.src, r.dst): r.w for r in textrank.edges(df).collect()}
    assert got[("a", "b")] == 2.0  # once at distance 1, and again with that place


def test_sentences_without_likeness_come_first(spark):
    df = spark.createDataFrame([(1, ["a b", "c d"], ["a", "b", "c", "d"])], "doc_id long, sentences array<string>, tokens array<string>")
    assert [(r.sid, r.score) for r in textrank.top_sentences(df).orderBy("sid").collect()] == [(0, 1.0), (1, 1.0)]


def test_coverage_and_density(spark):
    df = spark.createDataFrame([(["모듈", "응집", "없음"], ["모듈", "응집력", "설계", "모듈"]), ([], ["a"])], "k array<string>, t array<string>")
    a, b = df.select(similarity.coverage(F.col("k"), F.col("t")).alias("c"), similarity.keyword_density(F.col("k"), F.col("t")).alias("d")).collect()
    assert (a.c.covered, a.c.partial, a.c.missing, a.c.coverage_rate) == (["모듈"], ["응집"], ["없음"], 0.5)
    assert (a.d, b.c.coverage_rate) == (0.5, 1.0)
    report = similarity.coverage_report(df.select(F.col("k").alias("keywords"), F.col("t").alias("source_tokens"), F.array().cast("array<string>").alias("target_tokens"))).first()
    assert (report.coverage_rate, report.missing) == (0.0, ["모듈", "응집", "없음"])


def test_cosines(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], ["a", "a", "b"], ["a"])], "x array<double>, y array<double>, s array<string>, t array<string>")
    got = df.select(similarity.cosine(F.col("x"), F.col("y")), similarity.cosine_tokens(F.col("s"), F.col("t"))).first()
    assert got[0] == pytest.approx(2**-0.5)
    assert got[1] == pytest.approx(2 / 5**0.5)


def test_index(pair, spark):
    ix = index.build(pair).cache()
    assert {(r.doc_id, r.frequency, tuple(r.positions)) for r in index.exact(ix, "모듈").collect()} == {(1, 2, (0, 2)), (2, 1, (2,))}
    assert [r.doc_id for r in index.all_of(ix, ["모듈", "설계"]).orderBy("doc_id").collect()] == [1, 2]
    assert index.all_of(ix, ["모듈", "absent"]).count() == 0
    assert index.search(ix, "  ").count() == 0
    tf = {(r.term, r.doc_id): r.tf for r in index.term_frequency(ix).collect()}
    assert tf[("모듈", 1)] == 0.4
    new = index.build(spark.createDataFrame([(1, ["새말"])], "doc_id long, tokens array<string>"))
    assert [r.term for r in index.upsert(ix, new).filter("doc_id = 1").collect()] == ["새말"]
    assert index.near(ix, "응집력", "결합도", 2).first().distance == 2


def test_concepts_join_both_scores(pair):
    rows = concepts.extract(pair, k=5).filter("doc_id = 1").collect()
    assert len(rows) == 5
    assert all(r.combined_score == pytest.approx(0.6 * r.tfidf_score + 0.4 * r.textrank_score, abs=2e-6) for r in rows)


SENTENCES = ["응집력은 모듈 내부 요소들이 서로 관련된 정도를 나타내는 개념이다.", "결합도는 모듈 사이의 상호 의존 정도를 나타내는 개념이다.", "정보 은닉은 모듈 내부의 세부 내용을 숨기는 설계 원리이다.", "정답: 응집력은 높을수록 좋다고 말할 수 있다."]


def test_cloze_uses_a_sentence_once(spark):
    df = spark.createDataFrame([(1, SENTENCES, ["응집력", "모듈", "결합도", "x"])], "doc_id long, sentences array<string>, keywords array<string>")
    got = {r.keyword: r for r in quiz.blank_quizzes(df).collect()}
    assert got["응집력"].question == "[____]은 모듈 내부 요소들이 서로 관련된 정도를 나타내는 개념이다."
    assert got["모듈"].context == SENTENCES[1]
    assert "결합도" not in got  # its only sentence is used up


def test_true_and_false_alternate_and_reruns_agree(spark):
    df = spark.createDataFrame([(1, SENTENCES, ["응집력", "결합도", "정보 은닉"])], "doc_id long, sentences array<string>, keywords array<string>")
    got = quiz.ox_quizzes(df).orderBy("place").collect()
    assert sorted(r.answer for r in got) == ["O", "O", "X"]
    false = next(r for r in got if r.answer == "X")
    assert false.question not in SENTENCES
    assert got == quiz.ox_quizzes(df).orderBy("place").collect()


def test_long_cloze_is_cut_around_its_keyword(spark):
    s = "앞부분 문장이 " * 20 + "핵심어 " + "뒷부분 설명이 " * 20
    got = spark.createDataFrame([(s,)], "s string").select(quiz.trim_blank(F.col("s"), F.lit("핵심어")).alias("t")).first().t
    assert "핵심어" in got and got.startswith("…") and got.endswith("…") and len(got) <= 102


@pytest.mark.parametrize(("kind", "answer", "given", "right"), [("blank", "정보 은닉", "정보은닉", True), ("blank", "UML", "uml ", True), ("ox", "O", "맞다", True), ("ox", "X", "true", False), ("ox", "X", "거짓", True)])
def test_grading(spark, kind, answer, given, right):
    assert spark.createDataFrame([(kind, answer, given)], "k string, a string, g string").select(quiz.is_correct(F.col("k"), F.col("a"), F.col("g"))).first()[0] is right


def test_score(spark):
    s = spark.range(1).select(scores.score(F.lit(8), F.lit(10), F.lit(0.5), F.lit(0.3)).alias("s")).first().s
    assert (s.total_score, s.passed, s.grade) == (66.0, True, "D")
    assert spark.range(1).select(scores.score(F.lit(0), F.lit(0), F.lit(0.0), F.lit(0.0)).alias("s")).first().s.total_score == 0.0


def test_chapters(spark):
    pages = spark.createDataFrame([(1, 1, "머리말", [9.0]), (1, 2, "제1장 소개", [18.0]), (1, 3, "본문", [9.0])], "doc_id int, page_num int, text string, font_sizes array<double>")
    got = [(r.title, r.start_page, r.end_page) for r in chapters.chapters(pages).orderBy("chapter_idx").collect()]
    assert got == [("서론", 1, 1), ("제1장 소개", 2, 3)]


def test_layout_rows_and_continuations():
    lines = ["1. 응집력(Cohesion)", "등급 이름 설명 예시 평가", "7  Functional  모든 요소가 하나의 기능을  계산기  최상", "수행함", "", "결합도  모듈 사이의 상호 의존 정도"]
    got, pages = layout.read_document([(3, s) for s in lines])
    assert got[0] == "응집력 등급:7, 이름:Functional, 설명:모든 요소가 하나의 기능을수행함, 예시:계산기, 평가:최상"
    assert pages == {3}


def test_layout_ignores_code_and_weak_subjects():
    got, _ = layout.read_document([(1, "int x = f();  return x;"), (1, "정의  모듈 내부의 요소들이 관련된 정도")])
    assert got == []


def test_keywords_against_converged_ranks(spark):
    """The one pass over a document's tokens against edges and ranks by brute force: dense matrices in place of sparse ones."""
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "xyzéß가"]
    texts = [[words[k] for k in rng.integers(0, m, n)] for m, n in [(60, 400), (5, 30), (2, 9), (60, 3), (60, 2), (1, 6), (40, 1500)]] + [[], None]
    got = {}
    for r in textrank.keywords(spark.createDataFrame(list(enumerate(texts)), "doc_id long, tokens array<string>"), k=7).collect():
        got.setdefault(r.doc_id, []).append((r.rank, r.term, r.score))
    for i, t in enumerate(texts):
        nodes = sorted(set(t or ()))
        at = {w: k for k, w in enumerate(nodes)}
        m = np.zeros((len(nodes), len(nodes)))
        for k, a in enumerate(t or ()):
            near = t[k + 1 : k + 1 + textrank.WINDOW]
            for b in near:
                if a != b:
                    m[at[a], at[b]] += 1 / (near.index(b) + 1)
                    m[at[b], at[a]] += 1 / (near.index(b) + 1)
        if m.any():
            scores = np.full(len(nodes), 1 / len(nodes))
            for _ in range(textrank.ROUNDS):
                new = (1 - textrank.DAMPING) / len(nodes) + textrank.DAMPING * (m / m.sum(1, keepdims=True)).T @ scores
                moved, scores = np.abs(new - scores).sum(), new
                if moved < textrank.CLOSE:
                    break
        else:
            scores = np.array([float(len(t or ()))] * len(nodes))
        want = sorted((-round(float(x), 6), w) for w, x in zip(nodes, scores, strict=True))[:7]
        assert sorted(got.get(i, [])) == [(k, w, -x) for k, (x, w) in enumerate(want, 1)]
