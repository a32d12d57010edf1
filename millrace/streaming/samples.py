"""Streams of turns or samples: stateless predicates, an anti-join with a reference set, and duplicates within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column


def read_stream(spark: SparkSession, path: str, like: DataFrame, files: int = 64) -> DataFrame:
    """A stream of the Parquet files of a folder or pattern, of the columns of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def keep(stream: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a predicate holds: no state."""
    return stream.where(condition)


def drop_known(stream: DataFrame, reference: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text isn't in a reference set, by digest: a join of the stream with a table, without state."""
    known = reference.select(F.sha2(F.col(text), 256).alias("_known")).where("_known is not null").distinct()
    return stream.withColumn("_digest", F.sha2(F.col(text), 256)).join(known, F.col("_digest") == F.col("_known"), "left_anti").drop("_digest")


def drop_repeats(stream: DataFrame, at: str, delay: str, *keys: str) -> DataFrame:
    """The first of rows with equal keys; state is dropped once the watermark has passed."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Takes in all there is, then stops; the checkpoint makes a later run go on from there."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
