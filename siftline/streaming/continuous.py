"""Search over files as they arrive, and an index that follows them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.patterns import Pattern
from siftline.operators import index, search


def watch(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """A stream of documents from a folder's Parquet files with the columns of ``documents``."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return rows.select("doc_id", path.alias("path"), F.col("text").alias("body"))


def continuous_matches(docs: DataFrame, p: Pattern) -> DataFrame:
    """Stateless: each batch's matches, append only."""
    return search.matching_lines(docs, p)


def follow(docs: DataFrame, index_path: str, checkpoint: str):
    """Add everything seen to the index, a folder per batch (a batch that is run again overwrites its
    own); searches by the index find it there. Without a generation, additions are the index."""

    def put(batch: DataFrame, number: int) -> None:
        index.add(batch, index_path, f"batch-{number}")

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
