"""Concepts: TF-IDF and TextRank scores of words, joined and combined."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.arrays import best, each, gathered, ngrams, numbered, round6
from ..functions.shared import kept, small_batches
from . import textrank, tfidf

TFIDF_WEIGHT, RANK_WEIGHT, MOST = 0.6, 0.4, 50


def combine(scored: DataFrame, ranked: DataFrame, counts: DataFrame, doc: str = "doc_id", k: int = MOST, weights: tuple[float, float] = (TFIDF_WEIGHT, RANK_WEIGHT)) -> DataFrame:
    """(doc, word, tfidf_score, textrank_score, frequency, combined_score, rank) of the union of both lists; a score that is missing is 0, a count that is missing 1."""
    a = scored.select(doc, F.col("term").alias("word"), F.col("score").alias("tfidf_score"))
    b = ranked.select(doc, F.col("term").alias("word"), F.col("score").alias("textrank_score"))
    c = counts.select(doc, F.col("term").alias("word"), F.col("tf").alias("frequency"))
    both = a.join(b, [doc, "word"], "full_outer").join(c, [doc, "word"], "left")
    zero = lambda x: F.coalesce(x, F.lit(0.0)).alias(x)
    both = both.select(doc, "word", zero("tfidf_score"), zero("textrank_score"), F.coalesce("frequency", F.lit(1)).cast("long").alias("frequency"))
    both = both.withColumn("_order", F.round(weights[0] * F.col("tfidf_score") + weights[1] * F.col("textrank_score"), 6))
    both = both.withColumn("combined_score", F.round(TFIDF_WEIGHT * F.col("tfidf_score") + RANK_WEIGHT * F.col("textrank_score"), 6))
    return tfidf.top(both, k, doc, "_order", "word").drop("_order")


def _united(terms: pa.Array, place: np.ndarray, counts: np.ndarray, codes: np.ndarray, chosen: np.ndarray, scores: np.ndarray, k: int, weights: tuple[float, float]):
    """Terms, scores, counts and combined scores of a document's k best concepts.

    chosen and scores are terms and their TF-IDF; place tells where the document's words stand among the terms, codes number its tokens.
    """
    ranked, rank_scores = textrank.best_words(codes, len(place), 2 * k)
    tf, tr, frequency, here = (np.zeros(len(terms)) for _ in range(4))
    tf[chosen], tr[place[ranked]], frequency[place] = scores, rank_scores, np.bincount(codes, minlength=len(place))
    here[chosen] = here[place[ranked]] = 1
    at = np.flatnonzero(here)
    at = at[best(round6(weights[0] * tf[at] + weights[1] * tr[at]), k)]
    return terms.take(pa.array(at)), tf[at], tr[at], np.maximum(frequency[at], 1).astype(np.int64), round6(TFIDF_WEIGHT * tf[at] + RANK_WEIGHT * tr[at])


def _each(docs: DataFrame, doc: str, tokens: str, concepts_of) -> DataFrame:
    """The rows of concepts_of(words, codes) for each document: one pass, nothing is shuffled."""

    def rows(batches):
        for batch in batches:
            for i, words, codes in each(batch.column(1)):
                word, tf, tr, frequency, combined = concepts_of(words, codes)
                ids = batch.column(0).take(pa.array(np.full(len(word), i)))
                yield [ids, word, pa.array(tf), pa.array(tr), pa.array(frequency), pa.array(combined), pa.array(np.arange(1, len(word) + 1), pa.int32())]

    def run(batches):
        return gathered(rows(batches), names)

    small_batches(docs.sparkSession)
    names = [doc, "word", "tfidf_score", "textrank_score", "frequency", "combined_score", "rank"]
    kinds = "string, double, double, long, double, int".split(", ")
    return docs.select(doc, tokens).mapInArrow(run, f"`{doc}` {docs.schema[doc].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in zip(names[1:], kinds, strict=True)))


def extract(docs: DataFrame, doc: str = "doc_id", tokens: str = "tokens", k: int = MOST, ranked: DataFrame | None = None, weights: tuple[float, float] = (TFIDF_WEIGHT, RANK_WEIGHT)) -> DataFrame:
    """Concepts of each document alone, from one pass over its tokens. ranked (doc, term, score) takes the place of converged TextRank."""
    if ranked is not None:
        return combine(tfidf.fit_single(docs, doc, tokens, 3 * k), tfidf.top(ranked, 2 * k, doc), tfidf.term_counts(docs, doc, tokens, False), doc, k, weights)

    def concepts_of(words: pa.Array, codes: np.ndarray):
        terms, counts, place = ngrams(words, codes)
        total = counts.sum()
        scores = round6(np.log1p(counts) * (np.log((total + 1) / (counts + 1)) + 1))
        chosen = best(scores, 3 * k)
        return _united(terms, place, counts, codes, chosen, scores[chosen], k, weights)

    return _each(docs, doc, tokens, concepts_of)


def extract_corpus(docs: DataFrame, doc: str = "doc_id", tokens: str = "tokens", k: int = MOST, ranked: DataFrame | None = None, weights: tuple[float, float] = (TFIDF_WEIGHT, RANK_WEIGHT)) -> DataFrame:
    """Concepts with TF-IDF fitted on all documents, from one pass over each one's tokens once the vocabulary (3k terms) is known.

    The k best terms of the vocabulary count even at score 0: a document with fewer takes the first of the others.
    """
    docs = kept(docs.select(doc, tokens))  # texts are tokenised once
    vocab = sorted((r.term, r.idf) for r in tfidf.fit_vocabulary(docs, 3 * k, doc, tokens)[0].collect())
    if ranked is not None:
        return _extract_by_joins(docs, doc, tokens, k, ranked, weights, vocab)
    known, idf = pa.array([t for t, _ in vocab], pa.string()), np.array([x for _, x in vocab])

    def concepts_of(words: pa.Array, codes: np.ndarray):
        terms, counts, place = ngrams(words, codes)
        found = pc.index_in(known, value_set=terms)
        have = found.is_valid().to_numpy(zero_copy_only=False)
        scores = np.zeros(len(known))
        scores[have] = round6(np.log1p(counts[found.drop_null().to_numpy()]) * idf[have])
        chosen = best(scores, k)
        # Terms that the document lacks are put in their place among its own.
        everything, codes_of = numbered(pa.concat_arrays([terms, known.take(pa.array(chosen))]))
        return _united(everything, codes_of[place], counts, codes, codes_of[len(terms) :], scores[chosen], k, weights)

    return _each(docs, doc, tokens, concepts_of)


def _extract_by_joins(docs: DataFrame, doc: str, tokens: str, k: int, ranked: DataFrame, weights: tuple[float, float], vocab: list[tuple[str, float]]) -> DataFrame:
    """extract_corpus() for ranks that are given as a table."""
    terms = docs.sparkSession.createDataFrame(vocab, "term string, idf double")
    scored = tfidf.transform(tfidf.term_counts(docs, doc, tokens), terms, doc).withColumn("score", F.round("tfidf", 6))
    full = docs.filter(F.size(tokens) > 0).select(doc, F.explode(F.lit([t for t, _ in vocab])).alias("term"))
    scored = tfidf.top(full.join(scored, [doc, "term"], "left").select(doc, "term", F.coalesce("score", F.lit(0.0)).alias("score")), k, doc)
    return combine(scored, tfidf.top(ranked, 2 * k, doc), tfidf.term_counts(docs, doc, tokens, False), doc, k, weights)


def leading_sentences(docs: DataFrame, doc: str = "doc_id", sentences: str = "sentences", tokens: str = "tokens", k: int = MOST, shown: int = 5) -> DataFrame:
    """The first few, in document order, of each document's 2k best sentences."""
    return textrank.top_sentences(docs, doc, sentences, tokens, 2 * k, shown)
