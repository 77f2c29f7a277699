"""Files as DataFrames: listing, validation, text with its encoding, PDF through an extractor that is passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.shared import small_batches
from ..functions.text import normalized, strip

MAX_MB, MAX_CHARS, LEAST_CHARS = 100, 500_000, 20
EXTENSIONS = (".pdf", ".txt")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "(\\.[^./]+)\\z", 1))


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, modificationTime, length), newest first, of files below folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")
    return files.filter(extension(F.col("path")).isin(*extensions)).orderBy(F.desc("modificationTime"), "path")


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))


def validate(files: DataFrame) -> DataFrame:
    """files with ok and message: extension, size, and a PDF's first bytes."""
    ext = extension(F.col("path"))
    bad = (
        F.when(~ext.isin(*EXTENSIONS), F.concat(F.lit("unsupported extension: "), ext))
        .when(F.col("length") > MAX_MB * 1024 * 1024, F.lit(f"larger than {MAX_MB} MB"))
        .when((ext == ".pdf") & (F.substring("content", 1, 5) != F.lit(b"%PDF-")), F.lit("damaged PDF"))
    )
    return files.withColumn("ok", bad.isNull()).withColumn("message", F.coalesce(bad, F.lit("OK")))


def check_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, ok, message) of named paths, from their metadata: whether each is there, a file, of a known kind, not empty, and not too large. validate() judges contents."""
    rows = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        ending = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
        status = fs.getFileStatus(p) if fs.exists(p) else None
        bad = (
            "no such file" if status is None
            else "not a file" if not status.isFile()
            else f"unsupported extension: {ending}" if ending not in EXTENSIONS
            else "empty file" if status.getLen() == 0
            else f"larger than {MAX_MB} MB" if status.getLen() > MAX_MB * 1024 * 1024
            else None
        )
        rows.append((path, bad is None, bad or "OK"))
    return spark.createDataFrame(rows, "path string, ok boolean, message string")


def validate_pdf(files: DataFrame, extractor: Callable[[bytes], dict]) -> DataFrame:
    """(path, ok, message, page_count) of PDF files (path, content): first bytes, whether the extractor can read them, and pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                if bytes(content[:5]) != b"%PDF-":
                    rows.append((path, False, "damaged PDF", 0))
                    continue
                try:
                    n = len(extractor(bytes(content))["pages"])
                except Exception as e:  # whatever the extractor that was passed in raises
                    rows.append((path, False, f"damaged PDF: {e}", 0))
                else:
                    rows.append((path, n > 0, "OK" if n else "PDF without pages", n))
            yield pd.DataFrame(rows, columns=["path", "ok", "message", "page_count"])

    return files.select("path", "content").mapInPandas(run, "path string, ok boolean, message string, page_count int")


@F.pandas_udf(T.StringType())
def _decoded(s: pd.Series) -> pd.Series:
    def one(b):
        for name in ("cp949", "latin-1"):
            try:
                return bytes(b).decode(name)
            except UnicodeDecodeError:
                continue

    return s.map(one)


def read_text(files: DataFrame, errors: bool = False) -> DataFrame:
    """(path, text) of text files: UTF-8, else CP949, else Latin-1. Only files that are not UTF-8 pass through Python.

    An empty file has nothing to read: with errors there is a column error besides, which says so, and the file's text is null; else it is left out.
    """
    if errors:
        empty = files.filter(F.coalesce(F.length("content"), F.lit(0)) == 0).select("path", F.lit(None).cast("string").alias("text"), F.lit("empty file").alias("error"))
        return read_text(files).withColumn("error", F.lit(None).cast("string")).unionByName(empty)
    full = files.filter(F.length("content") > 0)
    good = F.is_valid_utf8(F.col("content").cast("string"))
    utf8 = full.filter(good).select("path", F.col("content").cast("string").alias("text"))
    return utf8.union(full.filter(~good).select("path", _decoded("content").alias("text")))


def typed_text(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Typed texts: cut to the most characters allowed, stripped, at least 20 characters, with a label."""
    cut = strip(F.substring(text, 1, MAX_CHARS))
    return df.withColumn(text, cut).filter(F.length(text) >= LEAST_CHARS).withColumn(label, F.coalesce(F.nullif(strip(F.col(label)), F.lit("")), F.lit("직접 입력")))


def read_pdf(files: DataFrame, extractor: Callable[[bytes], dict]) -> DataFrame:
    """(path, page_num, text, font_sizes, title, author, subject, keywords, creator) of every page that is not blank.

    extractor(content) returns {"metadata": {...}, "pages": [...]}; a page is (text, [font sizes]), or a list of spans (text, font size), which are
    joined by a space, blank ones left out. Pages count from 1. Files go to Python a few at a time, and each file's pages come back by themselves.
    """
    small_batches(files.sparkSession)

    def page_of(page) -> tuple[str, list[float]]:
        if isinstance(page, tuple):
            return page[0], [float(x) for x in page[1]]
        spans = [(text.strip(), float(size)) for text, size in page if text.strip()]
        return " ".join(text for text, _ in spans), [size for _, size in spans]

    fields = ("title", "author", "subject", "keywords", "creator")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                got = extractor(bytes(content))
                meta = [str(got.get("metadata", {}).get(f) or "") for f in fields]
                rows = [(path, i, text, sizes, *meta) for i, (text, sizes) in enumerate(map(page_of, got["pages"]), 1) if text.strip()]
                yield pd.DataFrame(rows, columns=["path", "page_num", "text", "font_sizes", *fields])

    return files.select("path", "content").mapInPandas(run, "path string, page_num int, text string, font_sizes array<double>, title string, author string, subject string, keywords string, creator string")


def ingest(df: DataFrame, requested: str = "ko", text: str = "text") -> DataFrame:
    """df with language: detected on the first 2,000 characters if ko is requested, else as requested; mixed counts as ko."""
    from ..functions.text import detect_language

    found = detect_language(F.substring(text, 1, 2000)) if requested == "ko" else F.lit(requested)
    return normalized(df.withColumn("language", F.when(found == "mixed", "ko").otherwise(found)), text)
