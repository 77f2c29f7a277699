"""Filter interaction audit: what each filter removes, in every order of filters.

Expressions judge a row by four filters and give a mask of failures; the fifth,
exact copies, needs the smallest id of each text. Rows are grouped by a hash of
their text for that, and counted on the way: rows of one text share the other
four bits, so a group of copies has a row for each part and label, however many
copies there are. What remains is a histogram of 32 masks a part, from which all
orders follow: a step keeps the rows whose mask has no bit of it or of the steps
before. A filter's sum over all orders has a closed form: a row that fails k
filters is removed by each of them in one of k orders.

Defined results: a null text is an empty text; a null part is an empty string; a
row with null id is neither a smaller nor a larger copy, and has no labels; rows of equal id and
text are each other's copies but none is smaller; an id with several labels has
all of them; an empty table gives an empty table. Further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import UPPER, same, small, words

FILTERS = "ABCDE"
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
SYMBOLS = r"[#$%&*|]"
COPY = 1 << FILTERS.index("E")


def own_mask(t: Column, found: Column) -> Column:
    """Bits of the filters that a text fails by itself: A few words, B few distinct ones, C capitals, D symbols; found are its words."""
    n = F.length(t)
    fails = (
        F.size(found) < FEWEST_WORDS,
        100 * F.size(F.array_distinct(found)) < DISTINCT_PERCENT * F.size(found),
        100 * (n - F.length(F.translate(t, UPPER, ""))) > CAPITAL_PERCENT * n,
        t.rlike(SYMBOLS),
    )
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): the histogram of failure masks."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), t.alias("t"), words(F.col(f"`{text}`")).alias("w"))
    rows = rows.select("id", "part", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("hash"), own_mask(F.col("t"), F.col("w")).alias("mask"))
    # Repeated rows become one row with a count before anything is joined.
    rows = rows.groupBy("id", "part", "hash", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(small(marks, labels.count()), F.col("id") == F.col("_id"), "left").fillna(0, ["good", "toxic"])
    # Rows of one text: a row for each part and label, with how many have the smallest id there, or none.
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    same_text = rows.groupBy("hash", "part", "mask", "good", "toxic", "id").agg(F.sum("n").alias("n")).groupBy("hash", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), first.alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("without")
    )
    least = F.min("first.id").over(W.partitionBy("hash"))
    fresh = F.col("without") + F.when(same(F.col("first.id"), least), F.coalesce("first.n", F.lit(0))).otherwise(0)
    split = same_text.withColumn("fresh", fresh).select("part", "good", "toxic", F.inline(F.array(F.struct("mask", F.col("fresh").alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))))
    total = lambda c: F.sum(F.col("n") * c).cast("long")
    return split.filter("n > 0").groupBy("part", "mask").agg(total(F.lit(1)).alias("n"), total(F.col("good")).alias("good"), total(F.col("toxic")).alias("toxic"))


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of its filter, bits of the filters before) of all orders."""
    out = []
    for order in permutations(FILTERS):
        bits = [1 << FILTERS.index(f) for f in order]
        out += [("".join(order), i + 1, bits[i], sum(bits[:i])) for i in range(len(bits))]
    return out


def audit(cell: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step."""
    parts = cell.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32 cells
    plan = F.expr("array(" + ", ".join(f"named_struct('o', '{o}', 'i', {i}, 'f', {f}, 'b', {b})" for o, i, f, b in steps()) + ")")
    rows = parts.select("part", "cells", F.explode(plan).alias("s"))
    own, before = F.col("s.f"), F.col("s.b")
    orders = len(list(permutations(FILTERS)))

    def total(where, c=lambda x: x["n"]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + F.when(where(x["mask"]), c(x)).otherwise(0))

    fails = lambda m: m.bitwiseAND(own) != 0
    passed = lambda m: m.bitwiseAND(before) == 0
    gone = lambda m: fails(m) & passed(m)
    return rows.select(
        "part",
        F.col("s.o").alias("filter_order"),
        F.col("s.i").alias("step"),
        total(lambda m: ~fails(m) & passed(m)).alias("kept"),
        total(gone).alias("removed"),
        total(lambda m: fails(m) & ~passed(m)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"),
        total(gone, lambda x: x["good"]).alias("good_lost"),
        total(gone, lambda x: x["toxic"]).alias("toxic_lost"),
        total(fails, lambda x: (x["n"] * (F.lit(orders) / F.bit_count(x["mask"])).cast("long")).cast("long")).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return audit(cells(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
