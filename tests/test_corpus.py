"""Vocabularies from sketches, coverage by automaton, and rounding, against plain forms."""

from __future__ import annotations

import random
import time
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.functions.arrays import ngrams, numbered, round6
from inkwell.operators import similarity, tfidf


@pytest.mark.parametrize(("capacity", "whole"), [(10, True), (60, False), (5000, False)])
def test_vocabulary_of_sketches(spark, capacity, whole):
    """The same terms and counts, whether sketches tell all, leave some to be counted, or too much."""
    rng = random.Random(capacity)
    rows = [(i, [f"w{min(rng.randrange(400), rng.randrange(400), rng.randrange(400))}" for _ in range(rng.randint(0, 30))]) for i in range(400)]
    docs = spark.createDataFrame([*rows, (400, []), (401, None)], "doc_id long, tokens array<string>").repartition(4)
    df = Counter(t for _, x in rows for t in {*x, *(f"{a}_{b}" for a, b in zip(x, x[1:], strict=False))})
    want = [(t, n) for t, n in sorted(df.items(), key=lambda x: (-x[1], x[0]))[:12]]
    sketch = tfidf._sketched(docs, "tokens", True, capacity)
    lost = sketch.agg(F.sum("lost")).first()[0]
    assert (lost > want[-1][1]) == whole or capacity == 60
    vocab, n = tfidf.fit_vocabulary(docs, 12, capacity=capacity)
    assert n == 402 and [(r.term, r.df) for r in vocab.orderBy(F.desc("df"), "term").collect()] == want
    for term, count in sketch.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n")).collect():
        assert df[term] - lost <= count <= df[term]
    counts = {(r.doc_id, r.term): r.tf for r in tfidf.vocabulary_counts(docs, vocab).collect()}
    assert counts == {(r.doc_id, r.term): r.tf for r in tfidf.term_counts(docs).join(vocab, "term").collect()}


def test_vocabulary_of_no_documents(spark):
    vocab, n = tfidf.fit_vocabulary(spark.createDataFrame([], "doc_id long, tokens array<string>"))
    assert (vocab.count(), n) == (0, 0)


def test_coverage_against_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc가") for _ in range(rng.randint(1, 5)))
    rows = [(i, [word() for _ in range(rng.randint(0, 12))], [word() for _ in range(rng.randint(0, 8))]) for i in range(300)]
    rows += [(300, [], []), (301, ["", "a"], ["ab"]), (302, ["a_b", "a", "a"], ["a"]), (303, ["ab"], None), (304, ["x"], ["x", None])]
    df = spark.createDataFrame(rows, "id int, keywords array<string>, tokens array<string>")
    for r in df.select("*", similarity.coverage(F.col("keywords"), F.col("tokens")).alias("c")).collect():
        said = [t for t in r.tokens or [] if t is not None]
        near = [t for t in said if len(t) >= 2]
        of = {k: 0 if k in said else 1 if any(k in t or t in k for t in near) else 2 for k in r.keywords}
        for n, name in enumerate(("covered", "partial", "missing")):
            assert r.c[name] == [k for k in r.keywords if of[k] == n], r
        want = 1.0 if not r.keywords else (sum(of[k] == 0 for k in r.keywords) + 0.5 * sum(of[k] == 1 for k in r.keywords)) / len(r.keywords)
        assert abs(r.c.coverage_rate - want) < 1e-4


def test_coverage_of_many_keywords_and_tokens(spark):
    """5,000 keywords and 200,000 tokens: their product would be a thousand million comparisons."""
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(4999)), lambda i: F.concat(F.lit("key"), i)).alias("k"), F.transform(F.sequence(F.lit(0), F.lit(199_999)), lambda i: F.concat(F.lit("t"), i, F.lit("key"), i % 2000)).alias("t"))
    began = time.time()
    got = df.select(similarity.coverage(F.col("k"), F.col("t")).alias("c")).select(F.size("c.covered"), F.size("c.partial"), F.size("c.missing")).first()
    assert tuple(got) == (0, 2000, 3000) and time.time() - began < 60


def test_rounding_as_spark_does(spark):
    rng = random.Random(0)
    x = [rng.uniform(-9, 9) for _ in range(5000)] + [rng.randrange(10**7) / 10**6 + 5e-7 for _ in range(5000)] + [0.0, 1234567.1234565, 0.0000005, -0.0000005, 2.5e-7]
    spark_says = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert round6(np.array(x)).tolist() == spark_says
    assert [float(Decimal(repr(v)).quantize(Decimal("1e-6"), ROUND_HALF_UP)) for v in x] == spark_says


@pytest.mark.parametrize("tokens", [["b", "a", "b", "a", "b"], ["a_b", "a", "b", "a_b"], ["x"], ["가", "é", "z", "가"]])
def test_ngrams_of_one_document(tokens):
    terms, counts, place = ngrams(*numbered(pa.array(tokens)))
    want = Counter(tokens) + Counter(f"{a}_{b}" for a, b in zip(tokens, tokens[1:], strict=False))
    assert terms.to_pylist() == sorted(want) and dict(zip(terms.to_pylist(), counts.tolist(), strict=True)) == want
    assert [terms[int(i)].as_py() for i in place] == sorted(set(tokens))
