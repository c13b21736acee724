"""Where written tables go that driver and executors share, and the sinks: appended CSV under a header, streams into Parquet."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir; a local one only under a local master.
    It goes when the driver's JVM ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + os.environ.get("LOGWEAVE_SHARED_DIR", "/tmp/checkpoints")
    text = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return text


def append_csv(rows: DataFrame, path: str) -> None:
    """Append rows to a CSV result; every file has the header, so reading takes it once. Another header is an error."""
    spark = rows.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        there = spark.read.csv(path, header=True).columns
        if there != rows.columns:
            raise ValueError(f"{path} has the header {there}, not {rows.columns}")
    rows.write.mode("append").csv(path, header=True)


def appended_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there of a stream to Parquet and end; started again, it goes on where it was."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def ingest_stream(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """A broker's ingest as a stream of Parquet files, oldest first, so many in a micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
