"""Edges of words and of sentences: summed where the documents lie, many or few at a time."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as t
from inkwell.operators import index, sentences, textrank


@pytest.mark.parametrize("together", [1, 7, 100_000])
def test_edges_of_documents_summed_together(spark, together):
    rng = random.Random(5)
    docs = [(i, [rng.choice("abcde") for _ in range(rng.randint(0, 9))]) for i in range(30)] + [(30, None), (31, ["a", None, "b"])]
    want = Counter()
    for i, words in docs:
        words = [w for w in words or [] if w is not None]
        for k, a in enumerate(words):
            ahead = words[k + 1 : k + 1 + textrank.WINDOW]
            for b in ahead:
                if a != b:
                    want[i, a, b] += 1 / (ahead.index(b) + 1)
                    want[i, b, a] += 1 / (ahead.index(b) + 1)
    got = textrank.edges(spark.createDataFrame(docs, "doc_id long, tokens array<string>").coalesce(1), rounded=True, together=together)
    assert {(r.doc_id, r.src, r.dst): r.w for r in got.collect()} == pytest.approx({k: round(w, 6) for k, w in want.items()})


@pytest.mark.parametrize("cells", [1, 10, 1_000_000])
def test_sentences_meet_where_their_document_lies(spark, cells):
    rng = random.Random(6)
    docs = [(i, [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 8))], list("abcdef")) for i in range(20)] + [(20, None, ["a"]), (21, ["a b", "a"], None)]
    want = {}
    for i, said, known in docs:
        counts = [Counter(w for w in s.split() if w in (known or ())) for s in said or []]
        for a, x in enumerate(counts):
            for b, y in enumerate(counts):
                if a != b and (dot := sum(n * y[w] for w, n in x.items())):
                    want[i, a, b] = dot / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))
    df = spark.createDataFrame(docs, "doc_id long, sentences array<string>, tokens array<string>")
    got = textrank.sentence_edges(df, cells=cells)
    assert "Exchange" not in got._jdf.queryExecution().toString()
    assert {(r.doc_id, r.src, r.dst): r.w for r in got.collect()} == pytest.approx(want)


def test_sentence_ranks_take_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    textrank.top_sentences(spark.createDataFrame([(1, ["a b"], ["a"])], "doc_id long, sentences array<string>, tokens array<string>"))
    assert int(spark.conf.get(key)) == 8 << 20


def test_tokens_and_marks_as_the_plain_patterns_say(spark):
    texts = ["Kg 5kg 3.5% ÀB Kelvin İx 가나 12개", "THE Cohesion of 10g 2.5kg a1b", "x (1) y 2) z 3-1. Abc", "x (1)y ①a 가 3.1. 나", "", "…  a　", "4) a 5) b"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, c string")
    low = F.transform(F.regexp_extract_all("c", F.lit("[A-Za-z]{2,}"), F.lit(0)), F.lower)
    plain = F.concat(F.regexp_extract_all("c", F.lit("[가-힣]{2,}"), F.lit(0)), F.filter(low, lambda x: ~x.isin(*sorted(t.STOP_EN | t.STOP_CODE))), F.regexp_extract_all("c", F.lit(t.NUMBER_UNIT), F.lit(0)))
    m = F.col("c")
    for pattern in (f"({sentences.CIRCLED})", "(?U)(\\(\\d{1,2}\\)\\s)", "(?U)(?<!\\w)(\\d{1,2}\\)\\s)", "(?U)\\s+(\\d+[-\\.]\\d+\\.\\s+[가-힣A-Z])"):
        m = F.regexp_replace(m, pattern, "\n$1")
    for r in df.select(t.tokens(F.col("c"), "en").alias("a"), plain.alias("b"), sentences.marked(F.col("c")).alias("x"), m.alias("y"), t.strip(F.col("c")).alias("s"), F.regexp_replace("c", r"(?U)^\s+|\s+\z", "").alias("z")).collect():
        assert (r.a, r.x, r.s) == (r.b, r.y, r.z)


def test_postings_of_a_batch_are_those_of_its_documents(spark):
    docs = [(1, ["b", "", "a", "b", None]), (2, None), (3, []), (4, ["a"]), (5, [""])]
    got = index.build(spark.createDataFrame(docs, "doc_id long, tokens array<string>").coalesce(1)).collect()
    assert sorted((r.term, r.doc_id, r.frequency, r.positions) for r in got) == [("a", 1, 1, [2]), ("a", 4, 1, [0]), ("b", 1, 2, [0, 3])]
