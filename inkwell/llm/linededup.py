"""Line dedup across documents (native).

Lines are exploded, normalised and hashed; hashes found in enough distinct
documents lose their lines everywhere but in the document with the largest
id; the remaining lines are put back together by position.

Only 16-byte hashes and positions are shuffled to count; the texts move once,
to meet the positions they lose. A very common line is pre-aggregated in each
task, and its second use is a sort-merge join whose partitions Spark may split.

Defined results: a null or empty text is one empty line; rows with equal id
count as one document, and identical rows lose the same lines; a null id
counts as a document below every other; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SPACE, ascii_lower, cut, same


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _keyed(docs: DataFrame, min_chars: int) -> DataFrame:
    """(_id, _th, pos, h1, h2) of every line long enough. 128 bits of hash keep different keys apart."""
    lines = docs.select("_id", "_th", F.posexplode(F.split("_text", "\n")).alias("pos", "line"))
    key = lines.filter(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    return key.select("_id", "_th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text; columns of docs with these names give way."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rest = [c for c in docs.columns if c != text]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), F.col(f"`{doc_id}`").alias("_id"), t.alias("_text"), F.col(f"`{text}`").isNull().alias("_null"), F.xxhash64(t).alias("_th"))
    keyed = _keyed(base, min_chars)
    # Written out, so that the join below reads two plain shuffles, which Spark can split where a line is very common.
    common = cut(
        keyed.select("h1", "h2", "_id").distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("_id").alias("last"))
        .filter(F.col("n") >= min_docs).select("h1", "h2", "last")
    )
    lost = (
        keyed.join(common, ["h1", "h2"])
        .filter(~same(F.col("_id"), F.col("last")))
        .groupBy("_id", "_th").agg(F.collect_set("pos").alias("lost"))
        .select(F.col("_id").alias("_id2"), F.col("_th").alias("_th2"), "lost")
    )
    met = base.join(lost.hint("shuffle_hash"), same(F.col("_id"), F.col("_id2")) & (F.col("_th") == F.col("_th2")), "left")
    met = met.withColumn("_lines", F.split("_text", "\n"))
    stays = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(stays, lambda p: F.get("_lines", p)), "\n"))
    return met.select(
        *[F.when(~F.col("_null"), F.col("_text")).alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")],
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )


def without_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with the repeated lines gone from their texts; n_chars, where there is one, follows."""
    df = drop_lines(docs, doc_id, text, **how)
    new = {text: F.when(F.col(f"`{text}`").isNotNull(), F.col("kept_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return df.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
