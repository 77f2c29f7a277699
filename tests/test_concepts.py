"""Concepts of documents, with ranks that have converged, against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from inkwell import catalog

WORDS = [a + b for a in ("mod", "cal", "ren", "tis", "gor", "pal", "ned", "vik") for b in ("ule", "ance", "der", "ion", "ity", "or")]


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    rng = random.Random(4)
    # Some words follow few others, so that ranks need many rounds.
    texts = [" ".join(WORDS[min(rng.randrange(len(WORDS)), rng.randrange(len(WORDS)))] for _ in range(n)) for n in (300, 700, 40)]
    texts += [" ".join(w for w in WORDS for _ in range(2)), "module module module", "", None]
    d = str(tmp_path_factory.mktemp("concepts"))
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").selectExpr("*", "'s' AS source").write.parquet(f"{d}/documents.parquet")
    return d


def pagerank(tokens, rounds):
    """Rounded scores of words, and how many rounds it took; counts where there is one word alone."""
    if len(set(tokens)) < 2:
        return {w: float(n) for w, n in Counter(tokens).items()}, 0
    nodes = sorted(set(tokens))
    at = {w: i for i, w in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for i, x in enumerate(tokens):
        near = tokens[i + 1 : i + 5]
        for y in near:
            if x != y:
                a[at[x], at[y]] += 1 / (near.index(y) + 1)
                a[at[y], at[x]] += 1 / (near.index(y) + 1)
    m = (a / a.sum(1, keepdims=True)).T
    r, k, moved = np.full(len(nodes), 1 / len(nodes)), 0, 1.0
    while moved >= 1e-4 and k < rounds:
        new = 0.15 / len(nodes) + 0.85 * m @ r
        moved, r, k = np.abs(new - r).sum(), new, k + 1
    return dict(zip(nodes, r, strict=True)), k


def best(scores, k):
    return dict(sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k])


def wanted(tokens, scored, rounds=100):
    ranked = best(pagerank(tokens, rounds)[0], 100)
    words = {w: 0.6 * scored.get(w, 0) + 0.4 * ranked.get(w, 0) for w in {*scored, *ranked}}
    return {w: (scored.get(w, 0), ranked.get(w, 0), Counter(tokens).get(w, 1), x) for w, x in best(words, 50).items()}


def terms(tokens):
    return Counter(tokens + [f"{a}_{b}" for a, b in zip(tokens, tokens[1:], strict=False)])


def tokens_of(spark, place):
    return {r.doc_id: r.tokens or [] for r in catalog.docs(spark, place).collect()}


def compare(rows, want):
    """Words near the last rank may change places by rounding; their scores may not."""
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, {})[r.word] = (r.tfidf_score, r.textrank_score, r.frequency, r.combined_score)
    assert set(got) == {i for i, w in want.items() if w}
    for i, words in got.items():
        assert sorted(x[3] for x in words.values()) == pytest.approx(sorted(x[3] for x in want[i].values()), abs=3e-6)
        assert len(words.keys() & want[i].keys()) >= len(words) - 2
        for w in words.keys() & want[i].keys():
            assert words[w] == pytest.approx(want[i][w], abs=3e-6)


def test_concepts_of_documents(spark, place):
    docs = tokens_of(spark, place)
    assert max(map(len, docs.values())) > 500
    want = {}
    for i, tokens in docs.items():
        n = terms(tokens)
        want[i] = wanted(tokens, best({w: math.log(1 + c) * (math.log((n.total() + 1) / (c + 1)) + 1) for w, c in n.items()}, 150))
    compare(catalog.queries()["concept_extract_docs"](spark, place).collect(), want)
    assert any(pagerank(t, 100)[1] > 10 for t in docs.values())  # 10 rounds would not do
    assert "concept_extract_docs" not in catalog.oracle_sql()


def test_concepts_of_documents_in_their_corpus(spark, place):
    docs = tokens_of(spark, place)
    found = Counter(w for t in docs.values() for w in terms(t))
    vocab = {w: math.log((len(docs) + 1) / (c + 1)) + 1 for w, c in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:150]}
    want = {i: wanted(t, best({w: math.log(1 + terms(t)[w]) * x for w, x in vocab.items()}, 50) if t else {}) for i, t in docs.items()}
    compare(catalog.queries()["concept_extract_multi_docs"](spark, place).collect(), want)
