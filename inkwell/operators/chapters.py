"""Pages of documents: cleaning, headings, chapters, full text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import strip

HEADING_SIZE = 14.0
# Patterns of chapter titles.
TITLES = ("^제\\s*\\d+\\s*장", "^\\d+\\s*장\\b", "(?i)^chapter\\s+\\d+", "^\\d+\\.\\s+[A-Za-z가-힣]", "^\\d+\\.\\d+\\s+[A-Za-z가-힣]", "^[IVX]+\\.\\s+[A-Za-z가-힣]")
# What a page has besides its text: form feeds, lines of a page number alone, rules.
NOISE = "\\f|^\\s*\\d+\\s*$|^\\s*[-–—]{3,}\\s*$"


def clean_page(c: Column) -> Column:
    """A page without form feeds, page numbers and rules; blanks collapsed; words split at line ends joined."""
    c = F.regexp_replace(F.regexp_replace(c, f"(?mdU){NOISE}", " "), "[ \\t]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(c, "\\n{3,}", "\n\n"), "(?U)-\\n(\\S)", "$1"))


def is_heading(sizes: Column) -> Column:
    """Whether a page's mean font size is that of a heading."""
    return F.coalesce(F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(sizes), F.lit(0)) >= HEADING_SIZE, F.lit(False))


def title(text: Column, heading: Column) -> Column:
    """A page's chapter title, or null: its first line if that looks like one, or is short on a heading page."""
    first = strip(F.substring_index(strip(text), "\n", 1))
    matches = F.lit(False)
    for p in TITLES:
        matches = matches | first.rlike("(?U)" + p)
    return F.when((first != "") & ((matches & (F.length(first) <= 80)) | (heading & (F.length(first) <= 50))), first)


def chapters(pages: DataFrame, doc: str = "doc_id", page: str = "page_num", text: str = "text", sizes: str = "font_sizes") -> DataFrame:
    """(doc, chapter_idx, title, start_page, end_page, text). A title begins a chapter unless it stands on the first page; the first chapter is 서론."""
    order = W.partitionBy(doc).orderBy(page)
    marked = pages.withColumn("_t", title(F.col(text), is_heading(F.col(sizes)))).withColumn("_first", F.row_number().over(order) == 1)
    cut = marked.withColumn("_b", F.col("_t").isNotNull() & ~F.col("_first"))
    numbered = cut.withColumn("chapter_idx", F.sum(F.col("_b").cast("int")).over(order))
    rows = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t"))))
    out = numbered.groupBy(doc, "chapter_idx").agg(F.max(F.when(F.col("_b"), F.col("_t"))).alias("title"), F.min(page).alias("start_page"), F.max(page).alias("end_page"), rows.alias("_r"))
    return out.select(doc, "chapter_idx", F.coalesce("title", F.lit("서론")).alias("title"), "start_page", "end_page", F.array_join(F.transform("_r", lambda x: x["t"]), "\n\n").alias("text"))


def full_text(pages: DataFrame, doc: str = "doc_id", page: str = "page_num", text: str = "text", join: str = "\n\n") -> DataFrame:
    """(doc, text) with the pages in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t"))))
    return pages.groupBy(doc).agg(F.array_join(F.transform(rows, lambda x: x["t"]), join).alias("text"))
