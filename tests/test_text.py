from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as t
from inkwell.functions import words
from inkwell.operators import sentences, tfidf


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


def test_normalise_keeps_lines_and_drops_signs(spark):
    assert one(spark, " Ａ　B@@C\n가\t나  ① ", t.normalize) == "A B C\n가 나 ①"


def test_composing_reaches_hangul_and_marks(spark):
    rows = [(1, "한글"), (2, "café bar"), (3, None)]
    got = {r.id: r.normal for r in t.normalized(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert got == {1: "한글", 2: "caf bar", 3: None}


@pytest.mark.parametrize(("text", "language"), [("", "ko"), ("가나다 abc", "mixed"), ("가나다라마바사 ab", "ko"), ("hello 가", "en")])
def test_language(spark, text, language):
    assert one(spark, text, t.detect_language) == language


def test_tokens_by_class_in_order(spark):
    got = one(spark, "The 모듈 Cohesion 그리고 100개 3.5kg 50% x 결합도", lambda c: t.tokens(c, "ko"))
    assert got == ["모듈", "결합도", "cohesion", "kg", "100개", "3.5kg", "50%"]


def test_bigrams_and_chunks(spark):
    assert one(spark, ["a", "b", "c"], t.bigrams, "array<string>") == ["a_b", "b_c"]
    assert one(spark, ["a"], t.bigrams, "array<string>") == []
    assert len(one(spark, "x" * 2500, t.chunks)) == 3
    assert one(spark, "short", t.chunks) == ["short"]
    with pytest.raises(ValueError):
        t.chunks(F.lit("x"), 10, 10)


def test_small_functions(spark):
    assert one(spark, ' a:b?"c ', t.safe_name) == "a_b__c"
    assert one(spark, 1536, t.human_size, "long") == "1.5 KB"
    assert one(spark, "/data/x/y.txt", lambda c: t.relative_path(c, "/data")) == "x/y.txt"
    assert one(spark, ["a", "b", "a"], t.frequencies, "array<string>") == {"a": 2, "b": 1}
    with pytest.raises(ValueError):
        words.stop_words("fr")
    assert words.is_stop_word("The")


def test_sections_are_carried_and_rows_become_sentences(spark):
    text = "1-1. 자료 흐름도의 개념\n① 처리 과정은 자료를 변환하는 동작이다.\n응집력 모듈 내부 요소들의 연관성 정도\n종류 일곱 가지로 나누어 설명한다"
    got = sentences.split_sentences(spark.createDataFrame([(1, text), (2, "")], "id int, normal string")).collect()
    first = got[0].sentences
    assert "자료 흐름도의 개념 ① 처리 과정은 자료를 변환하는 동작이다." in first
    assert "응집력은 모듈 내부 요소들의 연관성 정도." in first
    assert not any(s.startswith("종류는") for s in first)
    assert got[1].sentences == []


def test_equal_beginnings_stay_once(spark):
    s = "이 문장은 충분히 길어서 남는다 그리고 같은 문장이다."
    got = sentences.split_sentences(spark.createDataFrame([(1, f"{s}\n{s}\n그 다음 문장도 충분히 길게 이어진다.")], "id int, normal string")).first()
    assert len(got.sentences) == 2


def test_long_sentences_are_refined(spark):
    long = "첫 번째 항목은 자료의 흐름을 설명한다 " * 5 + "핵심포인트 두 번째 항목은 자료의 저장을 설명한다 " + "1 셋째 항목을 길게 적는다 " * 8
    got = spark.createDataFrame([([long, "짧은 문장은 그대로 남는다.", "가" * 151 + " 키:값"],)], "s array<string>").select(sentences.refine(F.col("s")).alias("r")).first().r
    assert any(x.startswith("핵심포인트") for x in got)
    assert "짧은 문장은 그대로 남는다." in got
    assert got[-1] == "가" * 151 + " 키:값"
    assert all(len(x) >= 15 for x in got)


def test_normalising_equals_its_plain_form(spark):
    """One pass over Latin-1 texts, and letters counted only where both kinds stand, against a regular expression and a count of every letter."""
    rng = random.Random(3)
    pool = [*map(chr, range(1, 300)), *"가힣나①⑩⑪Ａ～　！😀;K한é   ​  \t\t\n\n"]
    rows = [(i, "".join(rng.choice(pool[: (127, 255, len(pool))[i % 3]]) for _ in range(rng.randrange(40)))) for i in range(3000)] + [(-1, None)]
    got = t.normalized(spark.createDataFrame(rows, "id int, text string")).withColumn("language", t.detect_language(F.col("normal")))
    plain = F.regexp_replace(F.regexp_replace(t.narrow(F.col("text")), t.DROPPED, " "), "[ \\t]+", " ")
    ko, en = (F.regexp_count("normal", F.lit(kind)) for kind in (t.HANGUL, t.LATIN))
    language = F.when(ko + en == 0, "ko").when(ko / (ko + en) >= 0.7, "ko").when(ko / (ko + en) <= 0.3, "en").otherwise("mixed")
    composed = F.col("text").rlike(t.COMPOSES)  # those are tested above
    assert got.filter(~composed & ~F.col("normal").eqNullSafe(t.strip(plain)) | ~F.col("language").eqNullSafe(language)).count() == 0
    assert got.select("language").distinct().count() == 3
    assert "regexp_extract_all" not in got.select("language")._jdf.queryExecution().toString()  # an array of all letters


def test_words_are_told_apart_before_they_are_rows(spark):
    rows = [(1, ["a", "b", "a", None]), (2, None), (3, []), (4, ["b", "c", ""])]
    words = tfidf.distinct_words(spark.createDataFrame(rows, "doc_id int, tokens array<string>").repartition(2))
    assert sorted((r.word for r in words.collect()), key=str) == ["", None, "a", "b", "c"]
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
