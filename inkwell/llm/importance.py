"""Importance resampling towards a target: hashed features, Gumbel scores, exact draw.

Features are runs of words, hashed to buckets; a bucket's gain is the scaled log
ratio of its smoothed shares in target and corpus. A document's weight is the
sum of its features' gains, looked up in one array; a hash of its id adds Gumbel
noise, so that the highest integer scores are a draw without replacement in
proportion to the weights.

Nothing is sorted to find them. Scores are counted in a histogram, whose suffix
sums give each score's rank offset and the score at which the draw ends; rows of
the surviving scores alone are numbered by id within their score. Rows that
share score and id are counted by their part of the table first, so that no
group of them meets in one task. Texts are read once: later passes read the
buckets of their features.

Defined results: a null or empty text has no features and weight 0; a null id is
hashed as 'null' and comes last among ties; repeated rows are documents of their
own, in any order among themselves; an empty corpus gives an empty table, and an
empty target gains that only tell how frequent features are. Of further columns,
those named in carry stay, save those with the names of results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import ascii_lower, cut, finished, in_order, running, same, small

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What monotonically_increasing_id() shifts the number of a partition by.
PART = 33


@dataclass(frozen=True)
class Draw:
    buckets: int = 10_000
    min_n: int = 1
    max_n: int = 1
    seed: int = 2024
    min_words: int = 20
    percent: int = 10


DRAW = Draw()


def lower_words(c: Column) -> Column:
    """Runs of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), SEPARATOR), "")


def hashed(words: Column, how: Draw = DRAW) -> Column:
    """Buckets of all runs of min_n to max_n words."""
    bucket = lambda x: F.pmod(F.crc32(x.cast("binary")), F.lit(how.buckets)).cast("int")

    def runs(n: int) -> Column:
        if n == 1:
            return F.transform(words, bucket)
        starts = F.filter(F.transform(words, lambda x, i: i + 1), lambda i: i <= F.size(words) - (n - 1))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(words, i, n), " ")))

    return F.concat(*[runs(n) for n in range(how.min_n, how.max_n + 1)])


def _counted(buckets: DataFrame, name: str) -> DataFrame:
    return buckets.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(corpus: DataFrame, target: DataFrame, how: Draw = DRAW) -> DataFrame:
    """(bucket, gain) of every bucket, from tables with a column buckets."""
    both = corpus.sparkSession.range(how.buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(_counted(corpus, "s"), "bucket", "left").join(_counted(target, "t"), "bucket", "left").fillna(0)
    whole = W.partitionBy(F.lit(0))  # one row a bucket
    s, t, total_s, total_t = (c.cast("double") for c in (F.col("s"), F.col("t"), F.sum("s").over(whole), F.sum("t").over(whole)))
    ratio = ((t + 1) * (total_s + how.buckets)) / ((s + 1) * (total_t + how.buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, how: Draw = DRAW) -> Column:
    """Scaled Gumbel noise from a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranks(scored: DataFrame, how: Draw = DRAW) -> DataFrame:
    """(row, rank) of the drawn rows; scored has row, id, n_words and score."""
    able = scored.filter(F.col("n_words") >= how.min_words)
    drawn = able.count() * how.percent // 100
    order = [F.desc("score")]
    histogram = cut(running(in_order(able.groupBy("score").agg(F.count(F.lit(1)).alias("n")), *order), order, upto=F.col("n")))
    edge = histogram.filter((F.col("upto") >= drawn) & (F.col("upto") - F.col("n") < drawn)).select("score").first()  # at most one score
    least = F.lit(edge.score if edge else None).cast("long")
    offsets = histogram.filter(F.col("score") >= least).select("score", (F.col("upto") - F.col("n")).alias("above"))
    best = able.filter(F.col("score") >= least).select("row", "id", "score", F.shiftright("row", PART).alias("part"))
    # Equal scores and ids are counted by part before they meet.
    groups = best.groupBy("score", "id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "part").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(offsets, "score")
    groups = groups.select(F.col("score").alias("s"), F.col("id").alias("i"), F.col("part").alias("p"), (F.col("above") + F.col("before")).alias("start"))
    placed = best.join(groups, (F.col("score") == F.col("s")) & same(F.col("id"), F.col("i")) & (F.col("part") == F.col("p")))
    own = W.partitionBy("score", "id", "part").orderBy("row")
    return placed.select("row", (F.col("start") + F.row_number().over(own)).alias("rank")).filter(F.col("rank") <= drawn)


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", carry: tuple[str, ...] = (), how: Draw = DRAW) -> DataFrame:
    """carry, doc_id, n_features, weight, score and rank of every document; rank is null unless the draw takes it."""
    return finished(lambda: _resampled(docs, target, doc_id, text, target_text, carry, how))


def _resampled(docs: DataFrame, target: DataFrame, doc_id: str, text: str, target_text: str, carry: tuple[str, ...], how: Draw) -> DataFrame:
    keep = [c for c in carry if c not in (doc_id, "n_features", "weight", "score", "rank")]
    split = lambda df, c, *more: df.select(*more, lower_words(F.col(f"`{c}`")).alias("words"))
    rows = split(docs, text, F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_")).alias("_carry"), F.col(f"`{doc_id}`").alias("id"), F.monotonically_increasing_id().alias("row"))
    rows = cut(rows.select("_carry", "id", "row", F.size("words").cast("long").alias("n_words"), hashed(F.col("words"), how).alias("buckets")))
    wanted = cut(split(target, target_text).select(hashed(F.col("words"), how).alias("buckets")))

    table = {r.bucket: r.gain for r in gains(rows, wanted, how).collect()}  # one row a bucket
    # One literal: building the array value by value would take as many calls.
    array = F.split(F.lit(",".join(str(table[i]) for i in range(how.buckets))), ",").cast("array<bigint>")
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.get(array, b))
    scored = cut(rows.select("_carry", "id", "row", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("id"), how)))
    out = scored.join(ranks(scored.select("row", "id", "n_words", "score"), how), "row", "left")
    return out.select(*[F.col("_carry")[c].alias(c) for c in keep], F.col("id").alias(doc_id), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
