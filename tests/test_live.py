"""Scores kept as state over several batches, out of order, against the report of all of them."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from inkwell.operators import scores
from inkwell.streaming import live


def test_stream_equals_report(spark, tmp_path):
    rng = random.Random(5)
    start = datetime.datetime(2025, 1, 1)
    rows = [(i, rng.randrange(12), start + datetime.timedelta(minutes=rng.randrange(50)), round(rng.uniform(0, 100), 2)) for i in range(300)]
    rng.shuffle(rows)
    schema = "id long, doc_id long, measured_at timestamp, total_score double"
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        live.keep_live(stream, root, str(tmp_path / "state")).awaitTermination(180)
        return {r.doc_id: (r.session_count, r.best_score, r.avg_score, r.total_score, r.passed, r.grade) for r in live.read_live(spark, root).collect()}

    def want(some):
        full = spark.createDataFrame(some, schema).select("*", *[F.lit(0.0).alias(c) for c in ("quiz_score", "coverage_score", "keyword_density")], F.lit(None).cast("array<string>").alias("missing_concepts"))
        titles = spark.range(12).select(F.col("id").alias("doc_id"), F.lit("t").alias("title"))
        report = scores.document_report(titles, full.filter("total_score IS NOT NULL AND measured_at IS NOT NULL")).filter("session_count > 0")
        return {r.doc_id: (r.session_count, r.best_score, r.avg_score, r.total_score, r.passed, r.grade) for r in report.collect()}

    spark.createDataFrame(rows[:200], schema).repartition(3).write.parquet(folder)
    assert run() == want(rows[:200])
    # State goes on where it was; rows without a score or a time count for nothing.
    late = rows[200:] + [(900, 3, None, 50.0), (901, 3, start, None)]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(folder)
    assert run() == want(rows)


def test_averages_at_a_half(spark, tmp_path):
    """36.35 exactly, but 36.349999999999994 as a sum of doubles."""
    rows = [(i, 1, datetime.datetime(2025, 1, i + 1), x, x, 0.0, 0.0, ["a"]) for i, x in enumerate((29.37, 38.0, 13.32, 64.71))]
    schema = "id long, doc_id long, measured_at timestamp, total_score double, quiz_score double, coverage_score double, keyword_density double, missing_concepts array<string>"
    history, titles = spark.createDataFrame(rows, schema).coalesce(1), spark.createDataFrame([(1, "t", "s")], "doc_id long, title string, subject string")
    assert scores.document_report(titles, history).first().avg_score == 36.4
    assert scores.subject_stats(titles, titles.select("doc_id"), history).first().avg_score == 36.4
    history.select("id", "doc_id", "measured_at", "total_score").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, doc_id long, measured_at timestamp, total_score double").parquet(str(tmp_path / "in"))
    live.keep_live(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(180)
    assert live.read_live(spark, str(tmp_path / "out")).first().avg_score == 36.4
