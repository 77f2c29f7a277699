"""Text files of a folder as a stream into the inverted index: each file is tokenised once, as in a batch, and its postings replace older ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import detect_language, normalized, tokens
from ..operators import index
from ..operators.term_table import TermTable


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of (doc_id, text): the path's hash and the whole text."""
    files = spark.readStream.format("text").option("wholetext", "true").load(folder)
    return files.select(F.xxhash64("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def index_stream(stream: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Put each batch's postings into the table at root, in place of all that its documents had; an emptied document has none. A batch run twice changes nothing."""
    normal = normalized(stream)
    tokened = normal.select("doc_id", tokens(F.col("normal"), detect_language(F.col("normal"))).alias("tokens"))

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        TermTable(batch.sparkSession, root).replace(index.build(batch), batch.select("doc_id"))
        batch.unpersist()

    return tokened.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """All postings of the table at root."""
    return TermTable(spark, root).rows()
