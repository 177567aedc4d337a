"""Incremental jobs: files that arrive are decoded and reflowed, each batch exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from scrivener.operators.reflow import reflow
from scrivener.sources.readers import decode

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, path: str, pattern: str = "*", per_batch: int = 1000) -> DataFrame:
    """path, content of files that appear in the folder."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(path).select("path", "content")


def reflow_arriving(spark: SparkSession, path: str, out: str, checkpoint: str, charset: str = "UTF-8", compact: bool = False) -> StreamingQuery:
    """Reflows what is there and ends; started again, it takes what came since."""
    texts = decode(arriving(spark, path), charset)
    return reflow(texts, "path", "text", compact=compact).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
