"""Cloze questions against a plain greedy form, and true or false questions' promises, over the documents' own sentences."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from inkwell import catalog
from inkwell.operators import quiz

WORDS = ["cohesion", "coupling", "module", "hiding", "test", "plan", "응집력", "x"] * 6 + ["class ", "10", "3-4", "정답:", "{", "a - b"]


def fits(s, k):
    end = s.rstrip()
    bad = [*quiz.ANSWER_KEYS, *quiz.CODE_BLANK]
    return (
        len(s) >= 15 and k in s and 2 * len(k) <= len(s) and not any(m in s for m in bad) and s.count(" - ") < 3
        and not re.search(r"\s\d+\.?\s*$", end) and not re.search(r"\d[-.]\d+\.?\s*$", end) and not any(m in s[:20] for m in quiz.OPENERS)
    )


def clipped(s, k, side):
    at = s.index(k)
    start, end = max(0, at - side), min(len(s), at + len(k) + side)
    if start and 0 <= (space := s.find(" ", start)) < at - 2:
        start = space + 1
    return ("…" if start else "") + s[start:end].strip() + ("…" if end < len(s) else "")


def question(s, k):
    if len(s) > 100:
        s = clipped(s, k, 35)
        if len(s) > 100:
            s = clipped(s, k, 50) if k in s else s[:100] + "…"
    return s.replace(k, "[____]", 1)


def greedy(sentences, keywords, count=10):
    used, out = set(), {}
    for k in keywords:
        if len(out) == count:
            break
        able = [s for i, s in enumerate(sentences) if i not in used and len(k) >= 2 and fits(s, k)]
        if not able:
            continue
        s = next((x for x in able if len(x) <= 150), able[0])
        q = question(s, k)
        if "[____]" in q and len(q.replace("[____]", "").replace("…", "").strip()) >= 12:
            used.add(sentences.index(s))
            out[k] = (q, s[:200])
    return out


@pytest.fixture
def lectures():
    rng = random.Random(14)
    rows = []
    for d in range(60):
        sentences = list(dict.fromkeys(" ".join(rng.choice(WORDS) for _ in range(rng.choice([2, 6, 14, 40, 70]))).strip() + rng.choice([".", "", " 7", "?"]) for _ in range(14)))
        rows.append((d, sentences, rng.sample(["cohesion", "coupling", "module", "hiding", "test", "plan", "응집력", "x", "cohesion coupling", "absent"], 8)))
    return [*rows, (100, [], ["test"]), (101, ["a test of something here."], []), (102, ["test test."], ["test"])]


def test_cloze_questions_are_the_greedy_ones(spark, lectures):
    df = spark.createDataFrame(lectures, "doc_id long, sentences array<string>, keywords array<string>").repartition(3)
    got = {}
    for r in quiz.blank_quizzes(df).collect():
        assert r.answer == r.keyword and r.quiz_type == "blank"
        got.setdefault(r.doc_id, {})[r.keyword] = (r.question, r.context)
    want = {d: g for d, s, k in lectures if (g := greedy(s, k))}
    assert got == want and sum(map(len, want.values())) > 100


def test_true_or_false_over_korean_documents(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 5)))
    texts = [". ".join(" ".join(word() for _ in range(rng.randint(5, 12))) for _ in range(12)) for _ in range(8)]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    rated = catalog.ox_candidates(spark, d)
    assert rated.filter("fits").count() > 20
    rows = rated.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "sentence"))), lambda x: x["sentence"]).alias("sentences"))
    rows = rows.join(catalog.topped(catalog.korean_docs(spark, d)).select("doc_id", "keywords"), "doc_id")
    said = {r.doc_id: r for r in rows.collect()}
    made = quiz.ox_quizzes(rows).collect()
    assert made
    for r in made:
        source = said[r.doc_id]
        assert r.answer in ("O", "X") and r.keyword in source.keywords
        whole = any(r.question.rstrip("…") == s or s.startswith(r.question.rstrip("…")) for s in source.sentences)
        assert whole == (r.answer == "O")
    for d in {r.doc_id for r in made}:
        answers = [r.answer for r in made if r.doc_id == d]
        assert abs(answers.count("O") - answers.count("X")) <= 1 or "O" in answers
