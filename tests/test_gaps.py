"""Keywords of many documents counted together, and gaps found where the documents lie."""

from __future__ import annotations

import math
import random
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell import catalog
from inkwell.operators import similarity, tfidf

LISTS = "doc_id long, tokens array<string>"


def rounded(x: float) -> float:
    return float(Decimal(repr(x)).quantize(Decimal("1e-6"), ROUND_HALF_UP))


def plain_top(tokens, k, sublinear, with_bigrams):
    pairs = ["_".join(x for x in p if x is not None) for p in zip(tokens, tokens[1:])] if with_bigrams else []
    tf = Counter(x for x in [*tokens, *pairs] if x is not None)
    total = sum(tf.values())
    scores = {x: rounded((math.log1p(n) if sublinear else n / total) * (math.log((total + 1) / (n + 1)) + 1)) for x, n in tf.items()}
    return [(x, tf[x], scores[x]) for x in sorted(tf, key=lambda x: (-scores[x], x))[:k]]


@pytest.mark.parametrize("words", [["a", "ab", "a1", "b", "가", "ab1", "z"], ["a", "a_b", "b", "", "b_a"], ["a", None, "b", "c"]])
@pytest.mark.parametrize(("sublinear", "with_bigrams"), [(True, True), (True, False), (False, True)])
def test_best_terms_of_documents_counted_together(spark, words, sublinear, with_bigrams):
    rng = random.Random(7)
    docs = [(i, [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 30, 200]))]) for i in range(60)] + [(60, None), (61, []), (62, [words[0]] * 50)]
    df = spark.createDataFrame(docs, LISTS).coalesce(1)
    for k in (1, 4, 1000):
        got = tfidf.with_top(df, k, sublinear=sublinear, with_bigrams=with_bigrams)
        assert got.columns == ["doc_id", "tokens", "top"]
        assert tfidf.with_top(df, k, tokens_too=False).columns == ["doc_id", "top"]
        for r in got.collect():
            assert [(x.term, x.tf, -x.minus) for x in r.top] == plain_top(r.tokens or [], k, sublinear, with_bigrams)


def test_gaps_of_a_row_as_joined_rows_say(spark):
    rng = random.Random(8)
    term = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    rows = [(i, [(w, round(rng.random(), 6)) for w in {term() for _ in range(rng.randint(1, 10))}], [term() for _ in range(rng.randint(0, 3))]) for i in range(200)]
    rows += [(200, [("a", 1.0), ("abc", None)], None), (201, [("a", 1.0)], []), (202, [], ["a"])]
    df = spark.createDataFrame(rows, "doc_id long, top array<struct<word:string,score:double>>, note array<string>")
    got = df.select("doc_id", F.explode(similarity.gaps_of(F.col("top"), F.col("note"))).alias("x")).select("doc_id", "x.*")
    status = []
    for i, top, note in rows:
        said, some = set(note or []), [t for t in note or [] if len(t) >= 2]
        status += [(i, w, "covered" if w in said else "partial" if any(w in t or t in w for t in some) else "missing") for w, _ in top]
    scores = df.select("doc_id", F.inline("top"))
    want = similarity.gaps(spark.createDataFrame(status, "doc_id long, word string, status string"), scores)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("many", [False, True])
def test_few_keywords_and_many_are_found_alike(many):
    rng = random.Random(9)
    term = lambda: "".join(rng.choice("ab\n") for _ in range(rng.randint(0, 4)))
    for _ in range(300):
        words, tokens = [term() for _ in range(rng.randint(0, 8))] + [None], [term() for _ in range(rng.randint(0, 4))] + [None]
        more = [f"x{i}" for i in range(similarity.FEW + 1)] if many else []
        automaton = similarity._automaton(words + more)
        assert (automaton is not None) == many
        some = [t for t in tokens if t is not None and len(t) >= 2]
        want = [2 if k is None else 0 if k in tokens else 1 if any(k in t or t in k for t in some) else 2 for k in words]
        assert similarity._found(words + more, pa.array(tokens, pa.string()), automaton)[: len(words)] == want


def test_gap_detect_tokenises_texts_once_and_shuffles_nothing(spark, tmp_path):
    d = str(tmp_path)
    texts = [(i, f"cohesion of modules and coupling of module number{'abcdefghij'[i]} systems design", "en", "src", 1) for i in range(10)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, "coupling of module"), (1, "nothing here"), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    found = catalog.queries()["gap_detect"](spark, d)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<doc_id:bigint,text:string>") == 1
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan
    rows = {(r.doc_id, r.word): r for r in found.collect()}
    assert {i for i, _ in rows} == set(range(10))
    assert rows[0, "modules"].status == "partial" and rows[1, "modules"].status == "missing" and rows[2, "modules"].gap_rate == 1.0
    assert (0, "coupling") not in rows
