"""Scores as they come: each document's sessions, best, average and latest score, kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scores import PASS, average, grade

_STATE = "n long, total double, best double, measured_at timestamp, id long, latest double"


def live_scores(scores: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, session_count, total, best_score, measured_at, id, total_score) of each document that a batch of scores (doc, id, measured_at, total_score) touches.

    The latest score is the one with the greatest time, then id, in whatever order they come. A row without a score or a time is not one.
    """
    kind = scores.schema[doc].dataType.simpleString()

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, best, at, of, latest = state.get if state.exists else (0, 0.0, None, None, None, None)
        for pdf in parts:
            pdf = pdf.dropna(subset=["measured_at", "total_score"])
            if pdf.empty:
                continue
            n, total = n + len(pdf), total + float(pdf.total_score.sum())
            best = float(pdf.total_score.max()) if best is None else max(best, float(pdf.total_score.max()))
            new = pdf.sort_values(["measured_at", "id"]).iloc[-1]
            if at is None or (new.measured_at, new.id) > (pd.Timestamp(at), of):
                at, of, latest = new.measured_at.to_pydatetime(), int(new.id), float(new.total_score)
        if n:
            state.update((n, total, best, at, of, latest))
            yield pd.DataFrame({doc: [key[0]], "session_count": [n], "total": [total], "best_score": [best], "measured_at": [at], "id": [of], "total_score": [latest]})

    rows = scores.select(doc, "id", F.col("measured_at").cast("timestamp").alias("measured_at"), "total_score")
    out = f"`{doc}` {kind}, session_count long, total double, best_score double, measured_at timestamp, id long, total_score double"
    return rows.groupBy(doc).applyInPandasWithState(update, out, _STATE, "update", GroupStateTimeout.NoTimeout)


def keep_live(scores: DataFrame, root: str, checkpoint: str, doc: str = "doc_id", **trigger) -> StreamingQuery:
    """Write what each batch changes to a folder of its own below root; a batch run twice is written once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return live_scores(scores, doc).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_live(spark: SparkSession, root: str, doc: str = "doc_id") -> DataFrame:
    """(doc, session_count, best_score, avg_score, total_score, measured_at, passed, grade) as of the newest batch of each document."""
    rows = spark.read.parquet(root).drop("batch")
    # A document's count of sessions only grows.
    new = rows.groupBy(doc).agg(F.max_by(F.struct(*[c for c in rows.columns if c != doc]), "session_count").alias("x")).select(doc, "x.*")
    new = new.withColumn("avg_score", average(F.col("total") / F.col("session_count")))
    return new.select(doc, "session_count", "best_score", "avg_score", "total_score", "measured_at", (F.col("total_score") >= PASS).alias("passed"), grade(F.col("total_score")).alias("grade"))
