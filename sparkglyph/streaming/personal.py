"""Learning words from a stream of events, with keyed state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkglyph.sources.store import shared_folder


def word_frequencies(spark: SparkSession, path: str, state: str | None = None) -> DataFrame:
    """(user_id, w, frequency) after all events of `path` went through the stream once. With a lasting `state` folder a later
    run takes only new files on top. Reads the result from the state itself, so no sink holds a second copy."""
    state = state or f"{shared_folder(spark)}/words-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(schema).parquet(path)
    kept = source.select("user_id", F.col("event_type").alias("w")).groupBy("user_id", "w").agg(F.count("*").alias("frequency"))
    kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    held = spark.read.format("statestore").load(state)
    return held.select(F.col("key.user_id").alias("user_id"), F.col("key.w").alias("w"), F.col("value.count").alias("frequency"))
