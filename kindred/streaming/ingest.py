"""A drop folder as a stream: each batch of new files is one run. People are joined within a batch, not across batches."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from kindred.plans.config import DEFAULT, OutputConfig
from kindred.plans.pipeline import run_pipeline
from kindred.plans.store import Store
from kindred.sources.readers import numbered

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, store: Store, checkpoint: str, config: OutputConfig = DEFAULT, once: bool = True) -> StreamingQuery:
    """Starts the stream; with `once` it stops when all files that are there have been run."""
    files = spark.readStream.format("binaryFile").schema(FILES).load(folder).select("path", "content")

    def batch(df, _: int) -> None:
        if not df.isEmpty():
            run_pipeline(spark, numbered(df), config, store)

    out = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="1 minute")).start()
