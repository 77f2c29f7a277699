"""Whole analyses: from raw texts to tokens, sentences, concepts and postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as t
from ..operators import chapters, concepts, index, layout, sentences, textrank
from ..operators.store import Store
from ..sources import files


def process(df: DataFrame, text: str = "text", language: str | None = None, with_bigrams: bool = True) -> DataFrame:
    """df with normal, language, sentences, tokens, bigrams, and counts of tokens, sentences and distinct tokens. Blank texts have nothing, and language ko."""
    df = t.normalized(df, text)
    found = F.lit(language) if language else t.detect_language(F.col("normal"))
    df = df.withColumn("language", F.when(F.coalesce(F.col("normal"), F.lit("")) == "", F.lit("ko")).otherwise(found))
    df = sentences.split_sentences(df.withColumn("normal", F.coalesce("normal", F.lit(""))))
    df = df.withColumn("tokens", t.tokens(F.col("normal"), F.col("language")))
    df = df.withColumn("bigrams", t.bigrams(F.col("tokens")) if with_bigrams else F.array().cast("array<string>"))
    return df.withColumn("token_count", F.size("tokens")).withColumn("sentence_count", F.size("sentences")).withColumn("unique_token_count", F.size(F.array_distinct("tokens")))


def process_chapters(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Each chapter processed by itself, keyed by (doc, chapter_idx)."""
    return process(chapters.chapters(pages, doc))


def parsed(pages: DataFrame, lines: DataFrame, doc: str = "doc_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """(doc, text) of documents from pages (doc, page_num, text) and their layout lines (doc, page, line_no, line).

    Pages that hold tables leave the body; the sentences read from tables follow it.
    """
    said = layout.table_sentences(lines, doc)
    rows = said.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("idx", "sentence"))).alias("_s"), F.first("table_pages").alias("_t"))
    tables = rows.select(doc, F.explode("_t").alias(page))
    cleaned = pages.select(doc, page, chapters.clean_page(F.col(text)).alias(text)).filter(F.col(text) != "")
    body = chapters.full_text(cleaned.join(tables, [doc, page], "left_anti"), doc, page, text)
    every = pages.select(doc).distinct().join(body, doc, "left").join(rows.select(doc, F.array_join(F.transform("_s", lambda x: x["sentence"]), "\n").alias("_more")), doc, "left")
    return every.select(doc, F.concat_ws("\n\n", F.coalesce(text, F.lit("")), F.nullif("_more", F.lit(""))).alias(text))


def analyse(docs: DataFrame, doc: str = "doc_id", requested: str = "ko", k: int = concepts.MOST) -> dict[str, DataFrame]:
    """The tables of one analysis: documents, keywords, sentences that lead, postings."""
    rows = files.ingest(docs, requested).drop("normal")
    done = process(rows.withColumnRenamed("language", "_stored")).withColumnRenamed("language", "detected").withColumnRenamed("_stored", "language")
    return {
        "documents": done.select(doc, "language", "text", F.length("text").alias("char_count"), "token_count", "sentence_count", "unique_token_count"),
        "keywords": concepts.extract(done, doc, k=k),
        "sentences": concepts.leading_sentences(done, doc, k=k),
        "inverted_index": index.build(done, doc),
    }


def save(store: Store, docs: DataFrame, subject_id: int, doc: str = "doc_id", requested: str = "ko", k: int = concepts.MOST) -> DataFrame:
    """Analyse docs (doc, text; title and file_path if they have them) and keep it all: documents, their keywords, their postings. (doc, id) of the documents.

    Documents and keywords turn over together; postings follow, a part at a time. A title that ends in .pdf or .txt names the kind; other texts were typed.
    """
    for name, value in (("title", F.col(doc).cast("string")), ("file_path", F.lit(None).cast("string"))):
        docs = docs if name in docs.columns else docs.withColumn(name, value)
    kind = F.when(F.lower("title").endswith(".pdf"), "pdf").when(F.lower("title").endswith(".txt"), "txt").otherwise("text")
    tables = analyse(docs, doc, requested, k)
    rows = tables["documents"].select(F.col(doc).alias("_doc"), "language", F.col("text").alias("content")).join(docs.select(F.col(doc).alias("_doc"), "title", "file_path", kind.alias("source_type")), "_doc")
    rows = store.with_ids("documents", rows.withColumn("subject_id", F.lit(subject_id).cast("long")))
    ids = rows.select(F.col("_doc").alias(doc), F.col("id").alias("document_id"))
    keywords = tables["keywords"].join(ids, doc).select("document_id", "word", "tfidf_score", "textrank_score", F.col("frequency").cast("int").alias("frequency"))
    store.change(added={"keywords": keywords}, numbered={"documents": rows.drop("_doc")})
    postings = tables["inverted_index"].join(ids, doc).select(F.col("term").alias("word"), "document_id", "frequency", "positions")
    store.replace_postings(postings, ids.select(F.col("document_id").alias("doc_id")))
    return ids.select(doc, F.col("document_id").alias("id"))


def summary(docs: DataFrame, doc: str = "doc_id", keywords: int = textrank.TOP, shown: int = 5) -> DataFrame:
    """(doc, sid, sentence, score) of the leading sentences alone."""
    return concepts.leading_sentences(process(docs), doc, k=keywords, shown=shown)
