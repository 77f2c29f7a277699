from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkwell.operators.store import Store
from inkwell.sources import files


def test_store_changes_and_cascades(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    s.insert("subjects", [{"name": " 공학 "}, {"name": "수학"}])
    s.insert("documents", [{"subject_id": 1, "title": "a", "source_type": "text", "content": "본문 내용"}])
    s.add_user_keyword(1, " 사용자 ")
    rows = spark.createDataFrame([("자동", 1.0)], "word string, tfidf_score double")
    assert s.replace_keywords(1, rows) == 1
    assert s.replace_keywords(1, rows) == 1
    assert [(r.word, r.is_user_added) for r in s.keywords_of(1).collect()] == [("자동", False), ("사용자", True)]
    s.update_document_content(1, ["한 문장", "두 문장"])
    assert s.read("documents").first().char_count == 9
    s.insert("quizzes", [{"document_id": 1, "quiz_type": "ox", "question": "q", "answer": "O"}])
    s.insert("quiz_sessions", [{"document_id": 1}])
    s.insert("quiz_results", [{"session_id": 1, "quiz_id": 1, "user_answer": "O", "is_correct": True}])
    s.complete_session(1, 1, 1, 60.005)
    assert s.read("quiz_sessions").first().completed
    s.delete("subjects", F.col("id") == 1)
    assert [s.read(t).count() for t in ("subjects", "documents", "keywords", "quizzes", "quiz_sessions", "quiz_results")] == [1, 0, 0, 0, 0, 0]
    with pytest.raises(ValueError):
        s.insert("subjects", [{"name": "  "}])
    assert Store(spark, str(tmp_path / "db")).read("subjects").count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("안녕하세요".encode("cp949"))
    (tmp_path / "b.txt").write_text("hello", encoding="utf-8")
    (tmp_path / "c.pdf").write_bytes(b"no pdf")
    (tmp_path / "d.doc").write_bytes(b"x")
    (tmp_path / "e.txt").write_bytes(b"")  # the source leaves out empty files, which hold nothing to read
    read = files.read_files(spark, str(tmp_path))
    ok = {r.path.rsplit("/", 1)[1]: r.ok for r in files.validate(read).collect()}
    assert ok == {"a.txt": True, "b.txt": True, "c.pdf": False, "d.doc": False}
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_text(read.filter("path like '%.txt'")).collect()}
    assert texts == {"a.txt": "안녕하세요", "b.txt": "hello"}
    assert files.list_files(spark, str(tmp_path)).count() == 3
    said = {r.path.rsplit("/", 1)[1]: r.message for r in files.check_paths(spark, [str(tmp_path / x) for x in ("a.txt", "c.pdf", "d.doc", "e.txt", "none.txt")] + [str(tmp_path)]).collect()}
    assert said == {"a.txt": "OK", "c.pdf": "OK", "d.doc": "unsupported extension: .doc", "e.txt": "empty file", "none.txt": "no such file", tmp_path.name: "not a file"}
    pdfs = spark.createDataFrame([("1", b"no pdf"), ("2", b"%PDF-1"), ("3", b"%PDF-0"), ("4", b"%PDF-x")], "path string, content binary")
    pages = lambda b: {"pages": [("p", [])] * int(b[-1:])}
    assert [(r.path, r.ok, r.page_count) for r in files.validate_pdf(pdfs, pages).orderBy("path").collect()] == [("1", False, 0), ("2", True, 1), ("3", False, 0), ("4", False, 0)]
    pdf = files.read_pdf(read.filter("path like '%.pdf'"), lambda b: {"metadata": {"title": "t"}, "pages": [("one", [12.0]), (" ", []), ("three", [9.0, 11.0])]})
    assert [(r.page_num, r.text, r.title) for r in pdf.orderBy("page_num").collect()] == [(1, "one", "t"), (3, "three", "t")]


def test_stream_indexes_a_folder(spark, tmp_path):
    from inkwell.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("cohesion coupling cohesion")
    q = ingest.index_stream(ingest.read_texts(spark, str(tmp_path / "in")), str(tmp_path / "ix"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r.term: r.positions for r in ingest.read_index(spark, str(tmp_path / "ix")).collect()}
    assert got == {"cohesion": [0, 2], "coupling": [1]}


def test_changes_turn_over_together(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "db"))
    s.insert("subjects", [{"name": "a"}, {"name": "b"}])
    s.insert("documents", [{"subject_id": k, "title": str(k), "source_type": "text", "content": "x"} for k in (1, 1, 2)])
    assert [(r.id, r.title) for r in s.of("documents", 1).orderBy("id").collect()] == [(1, "1"), (2, "1")]
    s.insert("quiz_sessions", [{"document_id": 1}, {"document_id": 3}])
    # where names a column that changes.
    s.update("quiz_sessions", ~F.col("completed"), completed=True, score=50.0, total_questions=4)
    assert {(r.completed, r.score, r.total_questions) for r in s.read("quiz_sessions").collect()} == {(True, 50.0, 4)}
    s.update("quiz_sessions", F.col("id") == 1, total_questions=F.col("correct_count") + 7, correct_count=3)
    assert [(r.total_questions, r.correct_count) for r in s.read("quiz_sessions").filter("id = 1").collect()] == [(7, 3)]
    # A cascade that fails half way changes nothing.
    write, seen = Store._write, []

    def failing(self, table, df):
        seen.append(table)
        if len(seen) == 2:
            raise OSError("disk full")
        return write(self, table, df)

    monkeypatch.setattr(Store, "_write", failing)
    with pytest.raises(OSError):
        s.delete("subjects", F.col("id") == 1)
    monkeypatch.setattr(Store, "_write", write)
    assert [s.read(t).count() for t in ("subjects", "documents", "quiz_sessions")] == [2, 3, 2]
    rows = spark.range(1000).repartition(7).select(F.lit(2).alias("document_id"), F.col("id").cast("string").alias("word"))
    assert s.insert("keywords", rows) == 1000 and s.insert("keywords", rows) == 1000
    ids = [r.id for r in s.read("keywords").select("id").collect()]
    assert sorted(ids) == list(range(1, 2001))
    s.compact("keywords")
    assert s.read("keywords").count() == 2000 and len(s._folders()["keywords"]) == 1
    assert [r.name for r in s.subjects().collect()] == ["b", "a"]


def test_questions_from_generating_to_scoring(spark, tmp_path):
    from inkwell.plans import quizzes

    s = Store(spark, str(tmp_path / "db"))
    s.insert("subjects", [{"name": "공학"}])
    lecture = "응집력은 모듈 내부 요소들이 서로 관련된 정도를 나타내는 개념이다.\n결합도는 모듈 사이의 상호 의존 정도를 나타내는 개념이다.\n정보은닉은 모듈 내부의 세부 내용을 숨기는 설계 원리이다."
    s.insert("documents", [{"subject_id": 1, "title": "a", "source_type": "text", "content": lecture}, {"subject_id": 1, "title": "b", "source_type": "text", "content": "  "}])
    assert quizzes.generate(s, 1) == quizzes.Generated() and quizzes.generate(s, 2) == quizzes.Generated()
    s.insert("keywords", [{"document_id": 1, "word": w, "tfidf_score": x, "textrank_score": y} for w, x, y in (("응집력", 1.0, 0.0), ("결합도", 0.0, 2.0), ("정보은닉", 0.5, 0.5))])
    s.remove_keyword(3)
    assert [r.keywords for r in quizzes.source(s, 1).collect()] == [["결합도", "응집력"]]
    s.remove_keyword(3, False)
    tried = quizzes.generate(s, 1, save=False)
    assert s.read("quizzes").count() == 0 and tried.blank and not tried.saved_ids
    first = quizzes.generate(s, 1)
    assert first.saved_ids and first.blank + first.ox == len(first.saved_ids) == s.quizzes_of(1).count()
    again = quizzes.generate(s, 1, "blank")
    assert again.blank == first.blank and again.ox == 0 and s.quizzes_of(1, "ox").count() == first.ox and len(again.saved_ids) == len(first.saved_ids)
    session = quizzes.start(s, 1)
    asked = s.quizzes_of(1).collect()
    answers = spark.createDataFrame([(q.id, f" {q.answer} " if k else "wrong") for k, q in enumerate(asked)], "quiz_id long, user_answer string")
    got = quizzes.evaluate(s, session, 1, answers, coverage=0.5, density=0.2).first()
    n = len(asked)
    assert (got.total, got.correct, got.wrong_keywords) == (n, n - 1, [asked[0].keyword])
    want = round(60 * (n - 1) / n + 0.3 * 50 + 0.1 * 20, 2)
    assert abs(got.total_score - want) < 0.011
    kept = s.read("quiz_sessions").first()
    assert (kept.completed, kept.total_questions, kept.correct_count, kept.score) == (True, n, n - 1, got.total_score)
    assert s.read("quiz_results").filter("is_correct").count() == n - 1
    saved = s.read("comprehension_scores").first()
    assert saved.total_score == got.total_score and saved.missing_concepts == [asked[0].keyword]
    none = quizzes.evaluate(s, quizzes.start(s, 1), 1, answers.limit(0), missing=["개념"]).first()
    assert (none.total, none.correct, none.grade) == (0, 0, "F") and s.read("comprehension_scores").count() == 2
    assert [(r.place, r.completed) for r in quizzes.report(s, 1).collect()] == [(1, True), (2, True)]
    s.delete_quizzes(1, "blank")
    assert s.quizzes_of(1).count() == first.ox and s.read("quiz_results").count() == first.ox


def test_saved_index_is_searched(spark, tmp_path):
    from inkwell.operators import index

    s = Store(spark, str(tmp_path / "db"))
    s.insert("subjects", [{"name": "a"}])
    s.insert("documents", [{"subject_id": 1, "title": "a", "source_type": "text", "content": "x"}])
    tokens = spark.createDataFrame([(1, ["cohesion", "coupling", "cohesion"])], "doc_id long, tokens array<string>")
    for _ in range(2):  # loading an index twice changes nothing
        index.save(s, index.build(tokens))
    assert [(r.term, r.doc_id, r.frequency, r.positions) for r in index.search(s.postings(), "COHES").collect()] == [("cohesion", 1, 2, [0, 2])]
