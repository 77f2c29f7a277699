"""Positional inverted index: rows (term, doc_id, frequency, positions), with documents' lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.arrays import ROWS
from ..functions.shared import small_batches
from .term_table import TermTable


def build(docs: DataFrame, doc: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(term, doc, frequency, positions). Empty tokens are left out but take a position.

    A document's postings come from its own row: nothing is shuffled. The documents of an Arrow batch are sorted together. Rows are documents: those of one id are not put together.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten()
            at = np.flatnonzero(pc.fill_null(pc.not_equal(words, ""), False).to_numpy(zero_copy_only=False))
            if not len(at):
                continue
            of = np.repeat(np.arange(len(sizes)), sizes)[at]
            position = at - (np.cumsum(sizes) - sizes)[of]
            coded = words.take(pa.array(at)).dictionary_encode()
            key = of * len(coded.dictionary) + coded.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) > 0]))
            first = order[starts]
            ends = np.append(starts, len(order)).astype(np.int32)
            positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(position[order].astype(np.int32)))
            columns = [coded.dictionary.take(coded.indices.take(pa.array(first))), batch.column(0).take(pa.array(of[first])), pa.array(np.diff(ends).astype(np.int64)), positions]
            found = pa.RecordBatch.from_arrays(columns, ["term", doc, "frequency", "positions"])
            for k in range(0, found.num_rows, ROWS):
                yield found.slice(k, ROWS)

    small_batches(docs.sparkSession)
    return docs.select(doc, tokens).mapInArrow(run, f"term string, `{doc}` {docs.schema[doc].dataType.simpleString()}, frequency long, positions array<int>")


def save(store, index: DataFrame, doc: str = "doc_id") -> int:
    """Put an index into a store, in place of all that its documents had there; how many postings. store.postings() gives it back for searching."""
    return store.replace_postings(index.select(F.col("term").alias("word"), F.col(doc).alias("document_id"), "frequency", "positions"))


def search_saved(table: TermTable, query: str, doc_id: int | None = None, limit: int = 50, shown: int = 10) -> DataFrame:
    """search() over a saved index: reads the buckets of matching terms alone."""
    return search(table.containing(query), query, doc_id, limit, shown)


def lengths(index: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, n_tokens): the sum of frequencies."""
    return index.groupBy(doc).agg(F.sum("frequency").alias("n_tokens"))


def upsert(index: DataFrame, new: DataFrame, doc: str = "doc_id") -> DataFrame:
    """index with all postings of new's documents replaced by new."""
    return index.join(new.select(doc).distinct(), doc, "left_anti").select(*index.columns).unionByName(new)


def remove(index: DataFrame, ids: list, doc: str = "doc_id") -> DataFrame:
    return index.filter(~F.col(doc).isin(*ids))


def search(index: DataFrame, query: str, doc_id: int | None = None, limit: int = 50, shown: int = 10, doc: str = "doc_id") -> DataFrame:
    """Terms that hold the query in any case: the most frequent first, with their first positions and score ln(1+frequency). A blank query finds nothing."""
    q = query.strip().lower()
    found = index.filter(F.lower("term").contains(q) if q else F.lit(False))
    if doc_id is not None:
        found = found.filter(F.col(doc) == doc_id)
    return found.select("term", doc, "frequency", F.slice("positions", 1, shown).alias("positions"), F.round(F.log1p("frequency"), 6).alias("score")).orderBy(F.desc("frequency"), "term", doc).limit(limit)


def exact(index: DataFrame, word: str) -> DataFrame:
    return index.filter(F.col("term") == word)


def all_of(index: DataFrame, words: list[str], doc: str = "doc_id") -> DataFrame:
    """Documents that hold every word."""
    words = sorted(set(words))
    return index.filter(F.col("term").isin(*words)).groupBy(doc).agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(words)).select(doc)


def any_of(index: DataFrame, words: list[str], doc: str = "doc_id") -> DataFrame:
    """Documents that hold one of the words."""
    return index.filter(F.col("term").isin(*words)).select(doc).distinct()


def term_frequency(index: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(term, doc, frequency, tf): frequency over the document's length."""
    return index.withColumn("tf", F.round(F.col("frequency") / F.sum("frequency").over(W.partitionBy(doc)), 6)).select("term", doc, "frequency", "tf")


def vocabulary(index: DataFrame) -> DataFrame:
    return index.select("term").distinct()


def counts(index: DataFrame, doc: str = "doc_id") -> DataFrame:
    return index.agg(F.count_distinct(doc).alias("doc_count"), F.count_distinct("term").alias("word_count"))


def top_words(index: DataFrame, k: int = 10, doc: str = "doc_id") -> DataFrame:
    best = W.partitionBy(doc).orderBy(F.desc("frequency"), "term")
    return index.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(doc, "term", "frequency", "rank")


def keyword_counts(index: DataFrame, keywords: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, term, frequency) of wanted (doc, term), 0 where a document lacks one."""
    return keywords.join(index.select(doc, "term", "frequency"), [doc, "term"], "left").select(doc, "term", F.coalesce("frequency", F.lit(0)).alias("frequency"))


def search_titles(index: DataFrame, documents: DataFrame, query: str, subject: object | None = None, limit: int = 50, doc: str = "doc_id") -> DataFrame:
    """Postings whose term is like %query% in any case, with title and subject of their document."""
    docs = documents.filter(F.col("subject") == subject) if subject is not None else documents
    found = index.filter(F.col("term").ilike(f"%{query}%")).join(docs.select(doc, "title", "subject"), doc)
    return found.select("term", doc, "title", "subject", "frequency").orderBy(F.desc("frequency"), "term", doc).limit(limit)


def search_keywords(keywords: DataFrame, documents: DataFrame, query: str, subject: object | None = None, doc: str = "doc_id") -> DataFrame:
    """Distinct (word, doc) of keywords not removed that hold the query in any case."""
    docs = documents.filter(F.col("subject") == subject) if subject is not None else documents
    found = keywords.filter(~F.col("is_user_removed") & F.lower("word").contains(query.strip().lower()))
    return found.join(docs.select(doc, "title", "subject"), doc).groupBy("word", doc, "title", "subject").agg(F.max("frequency").alias("frequency"))


def near(index: DataFrame, a: str, b: str, within: int = 5, doc: str = "doc_id") -> DataFrame:
    """(doc, distance) of documents where a and b stand within so many positions: an extension of positional search. A word is 0 from itself."""
    if a == b:
        return index.filter(F.col("term") == a).select(doc, F.lit(0).alias("distance")).filter(F.lit(0) <= within)
    pick = lambda w: index.filter(F.col("term") == w).select(doc, F.transform("positions", lambda x: F.struct(x.alias("at"), F.lit(w).alias("w"))).alias(f"_{w == a}"))
    # The nearest two of different words stand side by side once both lists are merged.
    merged = pick(a).join(pick(b), doc).select(doc, F.array_sort(F.concat(f"_{True}", f"_{False}")).alias("all"))
    steps = F.transform("all", lambda x, i: F.when((i > 0) & (F.get("all", i - 1)["w"] != x["w"]), x["at"] - F.get("all", i - 1)["at"]))
    return merged.select(doc, F.array_min(steps).alias("distance")).filter(F.col("distance") <= within)


def as_rows(index: DataFrame, doc_id: int, doc: str = "doc_id") -> DataFrame:
    """Postings of one document with positions as JSON, as they are stored outside."""
    return index.filter(F.col(doc) == doc_id).select("term", doc, "frequency", F.to_json("positions").alias("positions"))
