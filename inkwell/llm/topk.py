"""Exact top-k search by inner product with MaxScore.

Vectors become integers, floor(256 * x). A shard holds one posting list a
dimension: the vectors whose component is not 0. For a query, a list's bound is
the most it can add. Lists are taken by falling bound; those whose bounds add
up to less than the score to beat are non-essential: vectors found in no other
list cannot compete. Essential lists are summed in full, the others are probed
for the vectors that can still reach the score to beat, which rises on the way.

Vectors are dealt to shards and queries to blocks by id hash; every shard meets
every block once, keeps k results a query, and the results are merged. Work
grows as queries times vectors, as exact search must; sizes of shards and
blocks are bounded, so no task grows.

Defined results: vectors that are null or hold null or non-finite components,
and rows without id, take no part; repeated rows count once; vectors of
different lengths are padded with zeros; ties go to the smaller id; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

SHARD, BLOCK = 65_536, 4_096
#: Dimensions summed at once.
STEP = 8


class Shard:
    """Posting lists of some vectors, as columns."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, rows = ids[order], vectors[order]
        keep = np.ones(len(rows), bool)
        for i in range(1, len(rows)):  # repeated rows stand beside each other if ids are equal
            if self.ids[i] == self.ids[i - 1]:
                j = i - 1
                while j >= 0 and self.ids[j] == self.ids[i]:
                    if np.array_equal(rows[j], rows[i]):
                        keep[i] = False
                        break
                    j -= 1
        self.ids, rows = self.ids[keep], rows[keep]
        self.rows = rows
        self.columns = np.ascontiguousarray(rows.T)
        none = np.zeros(len(self.columns), rows.dtype)
        self.high = self.columns.max(1) if len(rows) else none
        self.low = self.columns.min(1) if len(rows) else none
        self.lists = [None if x.all() else np.flatnonzero(x) for x in self.columns]
        sparse = np.array([x is not None for x in self.lists], bool)
        # Where a list lacks vectors, those get nothing from it.
        self.high, self.low = np.where(sparse, np.maximum(self.high, 0), self.high), np.where(sparse, np.minimum(self.low, 0), self.low)

    def top(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best vectors for q but those with id own, ties to the smaller id."""
        n = len(self.ids)
        if not n:
            return np.zeros(0, int), np.zeros(0, q.dtype)
        bound = np.maximum(q * self.high, q * self.low)
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # most that the lists from here on add
        # A score to beat from the vectors that the best list favours.
        first = self.columns[order[0]] * q[order[0]]
        tried = np.argpartition(-first, min(n - 1, 8 * k))[: 8 * k + 1]
        tried = tried[self.ids[tried] != own]
        best = np.sort(self.rows[tried] @ q)[::-1]
        beat = best[k - 1] if len(best) >= k else None
        d, essential = len(order), len(order)
        if beat is not None:
            essential = int(np.argmax(rest < beat)) if (rest < beat).any() else d
        essential = max(essential, 1) if d else 0
        held = [self.lists[i] for i in order[:essential]]
        at = np.arange(n) if any(x is None for x in held) else np.unique(np.concatenate(held))
        if beat is not None and rest[0] < beat:
            at = at[:0]
        at = at[self.ids[at] != own]
        sums = q[order[:0]] @ self.columns[order[:0]][:, at] if not d else np.zeros(len(at), q.dtype)
        done = 0
        while done < d and len(at):
            upto = min(done + STEP, d)
            some = order[done:upto]
            part = self.columns[some] if len(at) == n else self.columns[np.ix_(some, at)]
            sums = sums + q[some] @ part
            done = upto
            if done >= essential or done * 2 >= d:
                if len(at) > 4 * k:
                    # The leaders' exact scores may raise the score to beat.
                    lead = at[np.argpartition(-sums, 2 * k)[: 2 * k]]
                    best = np.sort(self.rows[lead] @ q)[::-1][k - 1]
                    beat = best if beat is None else max(beat, best)
                if beat is not None:
                    alive = sums + rest[done] >= beat
                    if alive.sum() < 0.7 * len(at):
                        at, sums = at[alive], sums[alive]
        pick = np.lexsort((self.ids[at], -sums))[:k]
        return at[pick], sums[pick]


def _matrix(table: pa.Table) -> np.ndarray:
    """Vectors as rows, padded with zeros."""
    column = table.column("v").combine_chunks()
    column = column if isinstance(column, pa.ListArray) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max()) if len(lengths) else 0
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def search(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best for each vector whose id is divisible by every."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("e"))
    v = v.filter(F.col("id").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    v = v.select("id", F.transform("e", lambda x: F.floor(x * 256)).alias("v"))
    n, n_queries = v.agg(F.count(F.lit(1)), F.count_if(F.col("id") % every == 0)).first()
    shards = max(-(-n // SHARD), min(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 256)), 1)
    blocks = max(-(-n_queries // BLOCK), 1)
    held = v.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = v.filter(F.col("id") % every == 0).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, queries = _matrix(left), _matrix(right)
        width = max(rows.shape[1], queries.shape[1])
        rows, queries = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (rows, queries))
        most = max([int(np.abs(x).max()) for x in (rows, queries) if x.size], default=0)
        if width * most * most < 2**53:  # then doubles hold every sum exactly
            rows, queries = rows.astype(float), queries.astype(float)
        shard = Shard(left.column("id").to_numpy(), rows)
        out: list[list[np.ndarray]] = [[], [], []]
        for own, q in zip(right.column("id").to_numpy(), queries, strict=True):
            at, scores = shard.top(own, q, k)
            for x, y in zip(out, (np.full(len(at), own), shard.ids[at], scores.astype(np.int64)), strict=True):
                x.append(y)
        return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    found = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.dropDuplicates().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
