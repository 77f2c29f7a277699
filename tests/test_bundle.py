"""Saving a whole analysis, rows from outside, files, spans and settings."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from inkwell.operators import index, store
from inkwell.plans import analysis
from inkwell.settings import DEFAULT, Settings
from inkwell.sources import files

LECTURE = "Cohesion describes how closely elements of one module belong together. Coupling describes how strongly modules depend on each other. Hiding keeps details inside a module."


def test_an_analysis_is_saved_whole(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    s.insert("subjects", [{"name": "a"}])
    s.insert("documents", [{"subject_id": 1, "title": "old", "source_type": "text", "content": "x"}])
    docs = spark.createDataFrame([(7, LECTURE, "week1.pdf"), (9, LECTURE.replace("module", "system"), "notes"), (11, " ", "empty.TXT")], "doc_id long, text string, title string").repartition(3)
    ids = {r.doc_id: r.id for r in analysis.save(s, docs, 1, k=10).collect()}
    assert sorted(ids.values()) == [2, 3, 4] and s.read("documents").count() == 4
    saved = {r.id: r for r in s.of("documents", 1).collect()}
    assert [(saved[ids[d]].title, saved[ids[d]].source_type, saved[ids[d]].language) for d in (7, 9, 11)] == [("week1.pdf", "pdf", "en"), ("notes", "text", "en"), ("empty.TXT", "txt", "ko")]
    assert saved[ids[7]].content == LECTURE and saved[ids[7]].char_count == len(LECTURE)
    words = {d: [r.word for r in s.keywords_of(ids[d]).collect()] for d in ids}
    assert len(words[7]) == len(words[9]) == 10 and not words[11]
    assert {r.doc_id for r in index.search_saved(s.index, "SYST").collect()} == {ids[9]}
    assert {r.doc_id for r in index.exact(s.index.words(["module"]), "module").collect()} == {ids[7]}
    s.delete("documents", F.col("id") == ids[7])
    assert s.postings().filter(F.col("doc_id") == ids[7]).count() == 0 and s.postings().filter(F.col("doc_id") == ids[9]).count() > 0
    assert s.read("inverted_index").select("word").distinct().count() == s.postings().select("term").distinct().count()
    with pytest.raises(ValueError):
        s.insert("inverted_index", [{"word": "w"}])
    with pytest.raises(ValueError):
        s.insert("subjects", [{"name": "b"}, {"nme": "c"}])
    s.insert("subjects", [{"name": "b"}, {"name": "c", "description": "later keys count"}])
    assert s.read("subjects").filter("name = 'c'").first().description == "later keys count"


def test_rows_from_outside(spark):
    rows = spark.createDataFrame([("1", "5", "blank", "2024-05-06T07:08:09"), ("x", "", "other", "2024-13-06"), (None, None, None, " ")], "id string, document_id string, quiz_type string, created_at string")
    got = store.decode("quizzes", rows).collect()
    assert [(r.id, r.document_id, r.quiz_type, r.created_at) for r in got] == [(1, 5, "blank", datetime.datetime(2024, 5, 6, 7, 8, 9)), (None, None, None, None), (None, None, None, None)]
    rows = spark.createDataFrame([(1, "0", "1"), (2, "true", "no")], "id long, is_user_added string, is_user_removed string")
    assert [(r.is_user_added, r.is_user_removed, r.word) for r in store.decode("keywords", rows).collect()] == [(False, True, None), (True, None, None)]
    rows = spark.createDataFrame([('["a","b"]', "61.5"), ("[", "")], "missing_concepts string, total_score string")
    assert [(r.missing_concepts, r.total_score) for r in store.decode("comprehension_scores", rows).collect()] == [(["a", "b"], 61.5), (None, None)]


def test_empty_files_and_spans(spark):
    rows = spark.createDataFrame([("a.txt", b"text"), ("b.txt", b""), ("c.txt", "한글".encode("cp949"))], "path string, content binary")
    assert {(r.path, r.text, r.error) for r in files.read_text(rows, errors=True).collect()} == {("a.txt", "text", None), ("b.txt", None, "empty file"), ("c.txt", "한글", None)}
    assert files.read_text(rows).count() == 2
    pages = lambda b: {"metadata": {"author": b.decode()}, "pages": [[(" Chapter ", 16), ("", 9), ("1", 14)], [(" ", 8)], ("whole", [9.0])]}
    got = files.read_pdf(spark.createDataFrame([("x.pdf", b"x"), ("y.pdf", b"y")], "path string, content binary"), pages).orderBy("path", "page_num").collect()
    assert [(r.path, r.page_num, r.text, r.font_sizes, r.author) for r in got][:2] == [("x.pdf", 1, "Chapter 1", [16.0, 14.0], "x"), ("x.pdf", 3, "whole", [9.0], "x")] and len(got) == 4


def test_settings():
    assert (DEFAULT.max_features, DEFAULT.damping, DEFAULT.score_weights) == (500, 0.85, (0.6, 0.3, 0.1))
    for wrong in ({"damping": 1.5}, {"top_n": 0}, {"score_weights": (0.5, 0.5, 0.5)}):
        with pytest.raises(ValueError):
            Settings(**wrong)
