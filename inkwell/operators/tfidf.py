"""TF-IDF of one document alone, and over a corpus; sparse rows (doc, term) throughout.

Scores are compared and ranked at 6 decimals, ties by term.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.shared import kept, small_batches
from ..functions.text import ngrams, pinned

MAX_FEATURES, MIN_DF = 500, 1
#: Most rows of a table that is broadcast; they are counted before.
BROADCAST_ROWS = 50_000


def term_counts(docs: DataFrame, doc: str = "doc_id", tokens: str = "tokens", with_bigrams: bool = True) -> DataFrame:
    """(doc, term, tf) of tokens and, if wanted, bigrams."""
    terms = ngrams(F.col(tokens)) if with_bigrams else F.col(tokens)
    return docs.select(doc, F.explode(terms).alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def distinct_words(docs: DataFrame, tokens: str = "tokens", to: str = "word") -> DataFrame:
    """(to) each token once. Those of a batch of documents are told apart before they become rows."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).flatten().unique().cast(pa.string())], [to])

    small_batches(docs.sparkSession)
    return docs.select(tokens).mapInArrow(run, f"`{to}` string").distinct()


def top(df: DataFrame, k: int, doc: str = "doc_id", score: str = "score", term: str = "term", rank: str = "rank") -> DataFrame:
    """The k best rows of each document, ranked from 1."""
    best = W.partitionBy(doc).orderBy(F.desc(score), term)
    return df.withColumn(rank, F.row_number().over(best)).filter(F.col(rank) <= k)


def _counted(lists: pa.ListArray, with_bigrams: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of all rows, and for each row's distinct terms the row, the word, the word that follows it in a bigram or -1, and the count; then how many terms each row has.

    Bigrams are pairs of numbers. Where they could read like a word or another pair, or where nulls stand among the tokens, they become words themselves.
    """
    flat, row = lists.flatten(), np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    pairs = np.flatnonzero(row[:-1] == row[1:]) if with_bigrams else np.array([], np.int64)
    words = flat.unique()
    if len(pairs) and (words.null_count or pc.any(pc.match_substring(words, "_")).as_py() or len(lists) * len(words) ** 2 >= 1 << 63):
        a, b = flat.take(pa.array(pairs)), flat.take(pa.array(pairs + 1))
        a = pc.if_else(pc.and_(a.is_null(), b.is_null()), "", a)  # two nulls would be left out of what is joined
        joined = pc.binary_join_element_wise(a, b, "_", null_handling="skip")
        flat, row, pairs = pa.concat_arrays([flat, joined]), np.concatenate([row, row[pairs]]), pairs[:0]
    row = row[flat.is_valid().to_numpy(zero_copy_only=False)]
    coded = flat.drop_null().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    n = max(len(words), 1)
    single, tf = np.unique(row * n + codes, return_counts=True)
    double, times = np.unique((row[pairs] * n + codes[pairs]) * n + codes[pairs + 1], return_counts=True)
    first = np.concatenate([single, double // n])
    second = np.concatenate([np.full(len(single), -1), double % n])
    totals = np.bincount(row, minlength=len(lists)) + np.bincount(row[pairs], minlength=len(lists))
    return words, first // n, first % n, second, np.concatenate([tf, times]), totals


def _best(words: pa.Array, row: np.ndarray, first: np.ndarray, second: np.ndarray, tf: np.ndarray, totals: np.ndarray, k: int, sublinear: bool) -> np.ndarray:
    """Places of the terms of _counted() that can be among the k best of their rows, row by row."""
    # Scores depend on the row and the count alone: one cell for each row and each count that occurs.
    counts = np.flatnonzero(np.bincount(tf))
    level = np.searchsorted(counts, np.arange(counts[-1] + 1))[tf]
    shape = len(totals), len(counts)
    cell = row * len(counts) + level
    held = np.bincount(cell, minlength=shape[0] * shape[1]).reshape(shape)
    total = np.maximum(totals, 1)[:, None]
    score = np.where(held > 0, (np.log1p(counts) if sublinear else counts / total) * (np.log((total + 1) / (counts + 1)) + 1), -np.inf)
    order = np.argsort(-score, axis=1)
    reached = np.cumsum(np.take_along_axis(held, order, 1), 1) >= k
    last = np.take_along_axis(score, np.take_along_axis(order, reached.argmax(1)[:, None], 1), 1)
    last[~reached.any(1)] = -np.inf
    # Scores are compared at six decimals: counts whose scores come this near to the last place stay, as does all above it.
    near = (score > last - 2e-6) & (score < last + 2e-6)
    above = held * (score >= last + 2e-6)
    tied = near & (near.sum(1) == 1)[:, None]
    able = (score > last - 2e-6).ravel()[cell]
    cut = np.flatnonzero(tied.ravel()[cell])
    if len(cut):  # of terms with one count, the first ones in order
        # A bigram stands where its first word and the underscore stand among words with and without one.
        place = np.empty(2 * len(words), np.int64)
        place[pc.array_sort_indices(pa.concat_arrays([words, pc.binary_join_element_wise(words, "", "_")])).to_numpy()] = np.arange(2 * len(words))
        a, b = place[first[cut] + np.where(second[cut] < 0, 0, len(words))], np.where(second[cut] < 0, -1, place[second[cut]])
        cut = cut[np.lexsort((b, a, row[cut]))]
        starts = np.searchsorted(row[cut], np.arange(len(totals)))
        able[cut[np.arange(len(cut)) - starts[row[cut]] >= k - above.sum(1)[row[cut]]]] = False
    chosen = np.flatnonzero(able)
    return chosen[np.argsort(row[chosen], kind="stable")]


def with_top(df: DataFrame, k: int = MAX_FEATURES, tokens: str = "tokens", to: str = "top", sublinear: bool = True, with_bigrams: bool = True, tokens_too: bool = True) -> DataFrame:
    """df with its k best terms: array<struct<minus, term, tf>> in order, minus being the score's negative. Terms are counted where the documents' rows lie, a batch at a time; nothing is shuffled.

    tokens_too: False leaves the tokens out, which then do not come back from Python.
    """
    small_batches(df.sparkSession)
    others = [c for c in df.drop(to).columns if c != tokens]
    rows = df.select(*others, tokens)
    fields = rows.schema.fields if tokens_too else rows.schema.fields[:-1]
    schema = T.StructType([*fields, *T._parse_datatype_string("_t array<string>, _n array<bigint>, _all bigint").fields])

    def run(batches):
        for batch in batches:
            words, row, first, second, tf, totals = _counted(batch.column(batch.num_columns - 1), with_bigrams)
            best = _best(words, row, first, second, tf, totals, k, sublinear) if len(tf) else np.array([], np.int64)
            ends = pa.array(np.searchsorted(row[best], np.arange(batch.num_rows + 1)), pa.int32())
            follows = words.take(pa.array(second[best], mask=second[best] < 0))
            terms = pc.binary_join_element_wise(words.take(pa.array(first[best])), follows, "_", null_handling="skip")
            lists = [pa.ListArray.from_arrays(ends, x) for x in (terms.cast(pa.string()), pa.array(tf[best], pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], *lists, pa.array(totals, pa.int64())], schema.names)

    counted = rows.mapInArrow(run, schema)
    total = F.col("_all")

    def scored(x: Column) -> Column:
        weight = F.log1p(x["_n"]) if sublinear else x["_n"] / total
        score = F.round(weight * (F.log((total + 1) / (x["_n"] + 1)) + 1), 6)
        return F.struct((-score).alias("minus"), x["_t"].alias("term"), x["_n"].alias("tf"))

    best = pinned(F.slice(F.array_sort(F.transform(F.arrays_zip("_t", "_n"), scored)), 1, k)).alias(to)
    return counted.select(*[c for c in df.drop(to).columns if tokens_too or c != tokens], best)


def fit_single(docs: DataFrame, doc: str = "doc_id", tokens: str = "tokens", k: int = MAX_FEATURES, sublinear: bool = True, with_bigrams: bool = True) -> DataFrame:
    """(doc, term, tf, score, rank): ln(1+tf) * (ln((T+1)/(tf+1)) + 1) with T all terms of the document; tf/T in place of ln(1+tf) unless sublinear. Rows are documents: those of one id are not put together."""
    rows = with_top(docs.select(doc, tokens), k, tokens, "_top", sublinear, with_bigrams, tokens_too=False)
    best = rows.select(doc, F.posexplode("_top").alias("_at", "_x"))
    return best.select(doc, F.col("_x.term").alias("term"), F.col("_x.tf").alias("tf"), (-F.col("_x.minus")).alias("score"), (F.col("_at") + 1).alias("rank"))


def vocabulary(counts: DataFrame, n_docs: int, k: int = MAX_FEATURES, min_df: int = MIN_DF, smooth: bool = True) -> DataFrame:
    """(term, df, idf) of the k terms found in most documents; counts has a row for each document and term."""
    return _with_idf(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n_docs, k, min_df, smooth)


def _with_idf(df: DataFrame, n_docs: int, k: int, min_df: int, smooth: bool) -> DataFrame:
    idf = F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1 if smooth else F.log(F.lit(n_docs) / F.greatest("df", F.lit(1))) + 1
    return df.filter(F.col("df") >= min_df).orderBy(F.desc("df"), "term").limit(k).withColumn("idf", idf)


def vocabulary_counts(docs: DataFrame, vocab: DataFrame, doc: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """term_counts() of the terms in a vocabulary alone: others are not shuffled. The vocabulary has at most its k terms and is broadcast."""
    rows = docs.select(doc, F.explode(ngrams(F.col(tokens))).alias("term")).join(F.broadcast(vocab.select("term")), "term", "left_semi")
    return rows.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def _sketched(docs: DataFrame, tokens: str, with_bigrams: bool, capacity: int) -> DataFrame:
    """(term, n, lost): for each partition, terms and a count of its documents that hold them, at most capacity of them; counts are short by lost at most, and so is 0 for terms left out."""
    small_batches(docs.sparkSession)
    terms = ngrams(F.col(tokens)) if with_bigrams else F.col(tokens)

    def run(batches):
        counts: dict[str, int] = {}
        lost = 0
        for batch in batches:
            found = pc.value_counts(batch.column(0).flatten().drop_null())
            for word, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True):
                counts[word] = counts.get(word, 0) + n
            if len(counts) > capacity:
                less = sorted(counts.values(), reverse=True)[capacity]
                counts = {w: n - less for w, n in counts.items() if n > less}
                lost += less
        words = list(counts)
        for i in range(0, len(words), 10_000):
            part = words[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[w] for w in part], pa.int64()), pa.nulls(len(part), pa.int64())], ["term", "n", "lost"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([lost], pa.int64())], ["term", "n", "lost"])

    return docs.select(F.array_distinct(terms).alias("t")).mapInArrow(run, "term string, n long, lost long")


def fit_vocabulary(docs: DataFrame, k: int = MAX_FEATURES, doc: str = "doc_id", tokens: str = "tokens", min_df: int = MIN_DF, smooth: bool = True, with_bigrams: bool = True, capacity: int = 50_000) -> tuple[DataFrame, int]:
    """vocabulary() of documents, and how many they are; rows are documents.

    Each partition keeps a sketch of its commonest terms, and what its counts may lack. A term whose sum of counts stays below the k-th sum by more than all
    partitions may lack is none of the k: only the others, which may be, are counted in full. If the sketches lack too much to tell, all terms are counted.
    """
    n_docs = docs.count()
    sketch = kept(_sketched(docs, tokens, with_bigrams, capacity))
    lost = sketch.agg(F.sum("lost")).first()[0] or 0
    sums = sketch.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df"))
    if lost == 0:
        df = sums
    else:
        edge = sums.orderBy(F.desc("df")).limit(k).agg(F.min("df"), F.count(F.lit(1))).first()
        terms = F.array_distinct(ngrams(F.col(tokens)) if with_bigrams else F.col(tokens))
        rows = docs.select(F.explode(terms).alias("term"))
        if edge[1] == k and edge[0] > lost:  # terms in no sketch are none of the k
            able = kept(sums.filter(F.col("df") + lost >= edge[0]).select("term"))
            rows = rows.join(F.broadcast(able) if able.count() <= BROADCAST_ROWS else able, "term", "left_semi")
        df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return _with_idf(df, n_docs, k, min_df, smooth), n_docs


def transform(counts: DataFrame, vocab: DataFrame, doc: str = "doc_id", sublinear: bool = True) -> DataFrame:
    """(doc, term, tfidf) in a fitted space. The vocabulary has at most its k terms and is broadcast."""
    tf = F.log1p("tf") if sublinear else F.col("tf") / F.sum("tf").over(W.partitionBy(doc))
    return counts.withColumn("_w", tf).join(F.broadcast(vocab), "term").select(doc, "term", (F.col("_w") * F.col("idf")).alias("tfidf"))


def corpus_scores(weights: DataFrame, n_docs: int) -> DataFrame:
    """(term, score): mean over all documents, those without the term included."""
    return weights.groupBy("term").agg((F.sum("tfidf") / n_docs).alias("score")).withColumn("score", F.round("score", 6))


def keywords(docs: DataFrame, top_n: int = 50, doc: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(doc, term, score, rank) of each document's top_n terms, out of twice as many features."""
    return fit_single(docs, doc, tokens, 2 * top_n).filter(F.col("rank") <= top_n).select(doc, "term", "score", "rank")


def corpus_keywords(docs: DataFrame, top_n: int = 50, doc: str = "doc_id", tokens: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """(term, score, rank) of a corpus's top_n terms, out of a vocabulary of twice as many, and that vocabulary (term, df, idf)."""
    vocab, n = fit_vocabulary(docs, 2 * top_n, doc, tokens)
    vocab = kept(vocab)
    counts = vocabulary_counts(docs, vocab, doc, tokens)
    best = corpus_scores(transform(counts, vocab, doc), n).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "term")))  # at most 2 * top_n rows
    return best.filter(F.col("rank") <= top_n), vocab


def as_map(scored: DataFrame, doc: str = "doc_id", term: str = "term", score: str = "score") -> DataFrame:
    """(doc, scores map<term, score>) of rows (doc, term, score)."""
    return scored.groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(term, score)))).alias("scores"))
