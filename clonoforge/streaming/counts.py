"""Streaming forms of the stateless parse and count operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clonoforge.session import checkpoint_dir


def stream_table(spark: SparkSession, folder: str, pattern: str, schema: StructType) -> DataFrame:
    """The files of `pattern` in a folder as an unbounded table, or all Parquet files of the folder that `pattern` names; new files are new rows."""
    named = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    system = named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(named) and system.getFileStatus(named).isDirectory():
        folder, pattern = f"{folder}/{pattern}", "*.parquet"
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now, through a Parquet sink in the shared folder, exactly once."""
    spark = stream.sparkSession
    at = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4()}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def windowed_counts(events: DataFrame, time: str, key: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, key, n) per tumbling window, final once the watermark has passed; later rows are dropped."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), key, "n")
