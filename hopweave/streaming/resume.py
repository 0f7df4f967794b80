"""Resumable appends: what is already in the output is not done again.

Batch: the inputs whose id the output lacks are processed and appended. Streaming: new input
files arrive through Structured Streaming, each micro-batch is appended the same way, so a
restart, or an executor lost in the middle of a batch, neither repeats nor loses rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import exists


def pending(inputs: DataFrame, output: DataFrame, key: str = "id") -> DataFrame:
    """Inputs not yet in the output; a repeated id counts once."""
    return inputs.join(output.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def append(inputs: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, key: str = "id") -> int:
    """Processes pending inputs, appends the results as Parquet and returns how many were pending."""
    spark = inputs.sparkSession
    todo = pending(inputs, spark.read.parquet(path), key) if exists(spark, path) else inputs.dropDuplicates([key])
    n = todo.count()
    if n:
        process(todo).write.mode("append").parquet(path)
    return n


def follow(spark: SparkSession, source: str, schema: str, process: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Follows a folder of JSON lines until all present files are done (``availableNow``)."""
    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(lambda batch, _: append(batch, process, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
