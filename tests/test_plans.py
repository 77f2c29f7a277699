from __future__ import annotations

from inkwell.plans import analysis


def test_analysis_of_a_document(spark):
    text = "응집력은 모듈 내부 요소들이 관련된 정도이다. 결합도는 모듈 사이의 의존 정도이다. 정보 은닉은 세부 내용을 숨기는 원리이다."
    docs = spark.createDataFrame([(1, text), (2, "   ")], "doc_id long, text string")
    got = analysis.analyse(docs, k=20)
    assert got["keywords"].filter("doc_id = 1").count() == 20
    assert got["keywords"].filter("doc_id = 2").count() == 0
    first = got["documents"].orderBy("doc_id").first()
    assert (first.language, first.sentence_count) == ("ko", 4)  # the line also reads as a table row
    assert [r.sid for r in got["sentences"].filter("doc_id = 1").orderBy("sid").collect()] == [0, 1, 2, 3]
    assert got["inverted_index"].filter("term = '모듈'").first().frequency == 2


def test_processing_blank_text(spark):
    r = analysis.process(spark.createDataFrame([(1, " \n "), (2, None)], "doc_id int, text string")).orderBy("doc_id").collect()
    assert [(x.language, x.tokens, x.sentences) for x in r] == [("ko", [], []), ("ko", [], [])]


def test_pages_with_tables_become_sentences(spark):
    from inkwell import catalog
    from inkwell.plans import analysis

    pages = spark.createDataFrame([(1, 1, "머리말  본문"), (1, 2, "표가 있는 쪽"), (1, 3, "맺음말"), (2, 1, "표 없는 문서"), (3, 1, " ")], "doc_id long, page_num int, text string")
    lines = [(1, 2, i, s) for i, s in enumerate(catalog.LAYOUT)] + [(2, 1, 0, "표 없는 문서")]
    from inkwell.operators import layout

    found, tables = layout.read_document([(2, s) for s in catalog.LAYOUT])
    got = {r.doc_id: r.text for r in analysis.parsed(pages, spark.createDataFrame(lines, "doc_id long, page int, line_no int, line string")).collect()}
    body = "머리말 본문\n\n맺음말" if 2 in tables else "머리말 본문\n\n표가 있는 쪽\n\n맺음말"
    assert found and got == {1: body + "\n\n" + "\n".join(found), 2: "표 없는 문서", 3: ""}


def test_short_cuts_and_lookups(spark):
    from pyspark.sql import functions as F

    from inkwell.operators import index, quiz, similarity, tfidf

    docs = spark.createDataFrame([(1, ["a1", "b1", "a1", "c1"]), (2, ["b1", "d1"])], "doc_id long, tokens array<string>")
    top = tfidf.keywords(docs, 2)
    assert {(r.doc_id, r["rank"]) for r in top.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    maps = {r.doc_id: r.scores for r in tfidf.as_map(top).collect()}
    assert len(maps[1]) == 2 and all(v > 0 for v in maps[1].values())
    best, vocab = tfidf.corpus_keywords(docs, 2)
    assert best.count() == 2 and vocab.count() == 4 and vocab.filter("term = 'b1'").first().df == 2
    gaps = spark.createDataFrame([(1, "x", "missing", 0.2), (1, "y", "missing", 0.9), (1, "z", "partial", 0.5)], "doc_id long, word string, status string, importance double")
    assert [tuple(r) for r in similarity.top_gaps(gaps, "missing", 1).collect()] == [(1, ["y"])]
    rows = spark.createDataFrame([(1, "blank", "q1"), (1, "ox", "q2"), (1, "ox", "q3")], "doc_id long, quiz_type string, question string")
    assert sorted((r.question, r.place) for r in quiz.session_order(rows, 3, "ox").collect())[0][0] == "q2" and quiz.session_order(rows, 3).count() == 3
    said = spark.range(1).select(quiz.feedback(F.lit(True), F.lit("답")).alias("a"), quiz.feedback(F.lit(False), F.lit("답")).alias("b")).first()
    assert said.a.startswith("✓") and said.b.endswith("답")
    ix = index.build(docs)
    assert index.remove(ix, [1]).select("doc_id").distinct().count() == 1
    assert index.as_rows(ix, 2).count() == 2
