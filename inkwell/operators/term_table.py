"""Postings on disk: changed by document, searched by term.

Rows (term, doc_id, further columns) lie in folders part=, by a hash of the
document, and bucket=, by a hash of the term, in order of their terms. A change
of documents rewrites the folders of their parts alone (dynamic partition
overwrite); a search reads the buckets of the terms it asks for alone.

A search for part of a term goes through the terms' trigrams, which lie in
folders of their own by a hash of the trigram: terms that hold all trigrams of
the query are candidates, and each is held against the query itself. Queries
without a trigram read the list of terms, which is short beside the postings.
Terms of documents that have gone stay in that list; they have no rows.

Every folder of a part that is written gets a row without a term, so that a
folder whose last term has gone is written over too. One writer at a time is
assumed. A null term or id is not kept.
"""

from __future__ import annotations

import re
import uuid
import zlib

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, functions as F, types as T

from ..functions.shared import forget, kept

#: Terms that a filter on the postings names one by one; if there are more of them, their rows are found by the condition itself.
NAMED = 500
GRAM = 3


def _hash(c: Column, n: int) -> Column:
    """Of a term or trigram: a hash that Python computes as well."""
    return (F.crc32(c.cast("binary")) % n).cast("int")


def _place(s: str, n: int) -> int:
    return zlib.crc32(s.encode()) % n


def trigrams(c: Column) -> Column:
    """Distinct runs of three characters."""
    starts = F.sequence(F.lit(1), F.length(c) - (GRAM - 1))
    return F.array_distinct(F.when(F.length(c) >= GRAM, F.transform(starts, lambda i: F.substring(c, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>")))


class TermTable:
    def __init__(self, spark: SparkSession, root: str, schema: str = "term string, doc_id long, frequency long, positions array<int>", parts: int = 16, buckets: int = 16) -> None:
        """Opens a table, or makes an empty one. schema has term and doc_id; parts and buckets count when it is made."""
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = T._parse_datatype_string(schema)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._fs.exists(self._path(f"{self.root}/layout")):
            spark.createDataFrame([(parts, buckets)], "parts int, buckets int").coalesce(1).write.json(f"{self.root}/layout")
        layout = spark.read.schema("parts int, buckets int").json(f"{self.root}/layout").first()
        self.parts, self.buckets = layout.parts, layout.buckets

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        if not self._fs.exists(self._path(f"{self.root}/{name}")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _files(self) -> DataFrame:
        return self._read("rows", T.StructType([*self.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("bucket", T.IntegerType())]))

    def _terms(self) -> DataFrame:
        return self._read("terms", T._parse_datatype_string("term string, bucket int"))

    def _grams(self) -> DataFrame:
        return self._read("grams", T._parse_datatype_string("gram string, term string, bucket int, at int"))

    def _part(self, doc_id: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(self.parts)).cast("int")

    def rows(self) -> DataFrame:
        """All rows."""
        return self._files().filter("term IS NOT NULL").select(*self.schema.names)

    def of_documents(self, ids: list) -> DataFrame:
        """The rows of some documents; reads their parts alone."""
        kind = self.schema["doc_id"].dataType
        parts = {r[0] for r in self.spark.createDataFrame([(i,) for i in ids], T.StructType([T.StructField("doc_id", kind)])).select(self._part(F.col("doc_id"))).collect()} if ids else set()
        return self._files().filter(F.col("part").isin(*parts) & F.col("term").isNotNull() & F.col("doc_id").isin(*ids)).select(*self.schema.names)

    def replace(self, rows: DataFrame, docs: DataFrame | None = None) -> None:
        """rows in place of all that their documents had. docs (doc_id) names documents besides that have none any more."""
        new = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]).filter("term IS NOT NULL AND doc_id IS NOT NULL")
        if not self._fs.exists(self._path(f"{self.root}/rows")):
            self._fill(new)
            return
        new = kept(new)  # read four times below
        changed = new.select("doc_id")
        if docs is not None:
            changed = changed.union(docs.select(F.col("doc_id").cast(self.schema["doc_id"].dataType)))
        changed = changed.distinct()
        touched = sorted(r[0] for r in changed.select(self._part(F.col("doc_id")).alias("part")).distinct().filter("part IS NOT NULL").collect())  # at most one row a part
        if not touched:
            return
        old = self._files().filter(F.col("part").isin(*touched) & F.col("term").isNotNull()).select(*self.schema.names).join(changed, "doc_id", "left_anti").select(*self.schema.names)
        placed = self._placed(old.unionByName(new))
        empty = self.spark.range(self.buckets).select(F.explode(F.array(*map(F.lit, touched))).alias("part"), F.col("id").cast("int").alias("bucket"))
        placed = placed.unionByName(empty, allowMissingColumns=True)
        self._learn(new)
        self._writer(placed).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.root}/rows")
        forget(new)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", self._part(F.col("doc_id"))).withColumn("bucket", _hash(F.col("term"), self.buckets))

    def _writer(self, placed: DataFrame) -> DataFrameWriter:
        # Folders are split over tasks where they are large and put together where they are small.
        return placed.hint("rebalance", "part", "bucket").sortWithinPartitions("part", "bucket", "term").write.partitionBy("part", "bucket")

    def _fill(self, new: DataFrame) -> None:
        """The first rows of a table without any: nothing to compare them with, so they are written once. They get their name when their terms are known."""
        path = f"{self.root}/first-{uuid.uuid4().hex}"
        self._writer(self._placed(new)).parquet(path)
        self._learn(self.spark.read.schema(new.schema).parquet(path))
        if not self._fs.rename(self._path(path), self._path(f"{self.root}/rows")):
            raise OSError(f"{path} could not be renamed")

    def _learn(self, new: DataFrame) -> None:
        """Terms that the table has not met yet, with their trigrams. They come before the rows: terms without rows do no harm."""
        terms = new.select("term").distinct().join(self._terms().select("term"), "term", "left_anti").select("term", _hash(F.col("term"), self.buckets).alias("bucket"))
        terms = kept(terms)  # the same ones in both lists
        # A trigram that a term holds twice may stand twice: searches count different ones.
        grams = terms.filter(F.length(F.lower("term")) >= GRAM).select(F.lower("term").alias("low"), "term", "bucket")
        grams = grams.select(F.explode(F.sequence(F.lit(1), F.length("low") - (GRAM - 1))).alias("i"), "low", "term", "bucket")
        grams = grams.select(F.substring("low", F.col("i"), F.lit(GRAM)).alias("gram"), "term", "bucket").withColumn("at", _hash(F.col("gram"), self.buckets))
        # Trigrams first: a term that stands in the list of terms has all its trigrams, whatever fails between.
        grams.hint("rebalance", "at").sortWithinPartitions("at", "gram").write.mode("append").partitionBy("at").parquet(f"{self.root}/grams")
        terms.sortWithinPartitions("term").write.mode("append").parquet(f"{self.root}/terms")

    def remove(self, docs: DataFrame) -> None:
        """No rows any more for documents (doc_id)."""
        self.replace(self.spark.createDataFrame([], self.schema), docs)

    def clear(self) -> None:
        """No rows and no terms; the layout stays."""
        for name in ("rows", "grams", "terms"):
            self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def words(self, words: list[str]) -> DataFrame:
        """The rows of whole terms; reads their buckets alone."""
        return self._files().filter(F.col("bucket").isin(*{_place(w, self.buckets) for w in words}) & F.col("term").isin(*words)).select(*self.schema.names)

    def _matching(self, pieces: list[str], holds: Column) -> DataFrame:
        """(term, bucket) of terms that hold all pieces, by their trigrams, and then the condition on term."""
        grams = sorted({p[i : i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)})
        if not grams:
            return self._terms().filter(holds).distinct()
        found = self._grams().filter(F.col("at").isin(*{_place(g, self.buckets) for g in grams}) & F.col("gram").isin(*grams))
        return found.groupBy("term", "bucket").agg(F.count_distinct("gram").alias("n")).filter((F.col("n") == len(grams)) & holds).select("term", "bucket")

    def _rows_of(self, terms: DataFrame, holds: Column) -> DataFrame:
        """The rows of terms, which are all that fulfil the condition: named one by one, or, if they are too many, by the condition itself. Nothing is joined."""
        found = terms.limit(NAMED + 1).collect()
        if len(found) <= NAMED:
            return self._files().filter(F.col("bucket").isin(*{r.bucket for r in found}) & F.col("term").isin(*{r.term for r in found})).select(*self.schema.names)
        return self._files().filter(holds).select(*self.schema.names)

    def containing(self, query: str) -> DataFrame:
        """The rows whose term holds the query, in any case; none if it is blank."""
        q = query.strip().lower()
        if not q:
            return self.rows().limit(0)
        holds = F.lower("term").contains(q)
        return self._rows_of(self._matching([q], holds), holds)

    def like(self, query: str) -> DataFrame:
        """The rows whose term is like %query% in any case; % and _ in the query stand for what they do in LIKE."""
        pieces = re.split("[%_\\\\]", query.lower())
        holds = F.col("term").ilike(f"%{query}%")
        return self._rows_of(self._matching(pieces, holds), holds)
