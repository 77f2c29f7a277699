"""Mixing sources to target weights (native).

Targets: sources in code-point order, null last, weigh 5, 2, 1 and so on; they
share a budget, none above a multiple of its size (water filling). Each source
takes its documents whole floor(target / size) times; the rest of its budget is
met by a hash threshold. Words are summed by source and hash bucket, cumulated
over at most 4,096 buckets a source, and the one bucket where the budget
runs out is refined twice, down to 36 bits of hash; no documents are sorted.
Only (id, source, size, hash) are kept between passes; texts are read once.

Defined results: a null text has no words; rows are taken one by one, rows with
equal id and text together (their hash is equal); a null source is a source of its own;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import cut, finished, in_order, running, same, small, words

BITS, LEVELS = 12, 3


def hash36(doc_id: Column, text: Column) -> Column:
    """36 bits of the MD5 of id and text, which other engines can compute too. Rows of one id that holds very many can be told apart by their texts."""
    whole = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 9), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(_source, source_size) with target. Sources are ranked and summed up in parts, so that there may be as many as there are hosts."""
    rank = [F.col("_source").asc_nulls_last()]
    ranked = running(in_order(sizes, *rank), rank, rank=F.lit(1)).drop("_p")
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
    limited = weighed.withColumn("limit", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("limit") / F.col("weight"))
    by = [F.col("ratio"), F.col("rank")]
    summed = cut(running(in_order(limited, *by), by, limits=F.col("limit"), weights=F.col("weight")))
    total = summed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if total.size is None:
        return summed.select("_source", "source_size", F.lit(0.0).alias("target"))
    # If all before one are at their limit, the rest share at this level; the right level is the highest.
    level = (F.lit(total.size * share) - (F.col("limits") - F.col("limit"))) / (F.lit(total.weight) - F.col("weights") + F.col("weight"))
    highest = max(summed.agg(F.max(level)).first()[0], 0.0)
    return summed.select("_source", "source_size", F.least(F.col("limit"), F.lit(highest) * F.col("weight")).alias("target"))


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, DataFrame, int]:
    """Rows (_id, _source, size, hash), and for each source (s, source_size, target, times, threshold); how many sources."""
    sized = cut(docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{source}`").alias("_source"), F.size(words(F.col(f"`{text}`"))).cast("long").alias("size"), hash36(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("hash")))
    sizes = cut(sized.groupBy("_source").agg(F.sum("size").alias("source_size")))
    n = sizes.count()
    p = targets(sizes, weights, share, cap)
    p = p.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    p = p.withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")).withColumn("before", F.lit(0).cast("long")).withColumn("prefix", F.lit(0).cast("long"))
    p = cut(p)  # a row a source: each level reads it and adds to it
    for i in range(LEVELS):
        shift = BITS * (LEVELS - 1 - i)
        now = p.select(F.col("_source").alias("s"), "rest", "before", "prefix")
        inside = sized.join(small(now, n), same(F.col("_source"), F.col("s")) & (F.shiftright("hash", shift + BITS) == F.col("prefix")) & (F.col("rest") > 0))
        bins = inside.groupBy("_source", F.shiftright("hash", shift).alias("bin")).agg(F.sum("size").alias("sum"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        upto = F.col("before") + F.sum("sum").over(W.partitionBy("_source").orderBy("bin"))
        edge = bins.withColumn("upto", upto).filter((F.col("upto") - F.col("sum") < F.col("rest")) & (F.col("upto") >= F.col("rest")))
        edge = edge.select(F.col("_source").alias("s"), F.col("bin").alias("bin"), (F.col("upto") - F.col("sum")).alias("lower"), F.col("upto").alias("upper"))
        joined = p.join(edge, same(F.col("_source"), F.col("s")), "left")
        last = i == LEVELS - 1
        # The last bin is one hash: it goes in if that brings the sum nearer to the budget.
        prefix = F.coalesce(F.col("bin") + (F.when(F.col("lower") + F.col("upper") < 2 * F.col("rest"), 1).otherwise(0) if last else F.lit(0)), F.lit(0))
        p = cut(joined.select("_source", "source_size", "target", "times", "rest", F.coalesce("lower", F.lit(0).cast("long")).alias("before"), prefix.cast("long").alias("prefix")))
    return sized, p.select(F.col("_source").alias("s"), "source_size", "target", "times", F.col("prefix").alias("threshold")), n


def _copies(hashed: Column) -> Column:
    return (F.col("times") + F.when(hashed < F.col("threshold"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): copies is how often the mix takes the row."""
    sized, final, n = plan(docs, doc_id, text, source, **how)
    out = sized.join(small(final, n), same(F.col("_source"), F.col("s")))
    return out.select(F.col("_id").alias(doc_id), F.col("_source").alias(source), "size", "source_size", "target", _copies(F.col("hash")).alias("copies"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it."""
    final = finished(lambda: plan(docs, doc_id, text, source, **how)[1])
    n = final.count()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{source}`").alias("_source"), hash36(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("_hash"))
    taken = rows.join(small(final, n), same(F.col("_source"), F.col("s"))).withColumn("_copies", _copies(F.col("_hash"))).filter("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
