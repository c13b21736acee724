"""Trial artifacts: recursive CSV with a key=value sidecar, log lines by pattern, and concatenation under one header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(column: str) -> Column:
    return F.regexp_replace(column, r"/[^/]*$", "")


def with_sidecars(spark: SparkSession, root: str, name: str, sidecar: str) -> DataFrame:
    """Rows of every CSV of that name below root, as text columns, with artifact_dir and the sidecar's pairs as a map."""
    read = spark.read.option("recursiveFileLookup", True)
    rows = read.option("pathGlobFilter", name).csv(root, header=True, enforceSchema=False).withColumn("artifact_dir", _folder(F.input_file_name()))
    lines = read.option("pathGlobFilter", sidecar).text(root).withColumn("artifact_dir", _folder(F.input_file_name()))
    parts = F.split("value", "=", 2)
    pairs = lines.where(F.size(parts) == 2).select("artifact_dir", F.struct(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value")).alias("p"))
    meta = pairs.groupBy("artifact_dir", "p.key").agg(F.max("p.value").alias("value")).groupBy("artifact_dir").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))
    return rows.join(meta, "artifact_dir", "left")


def log_lines(spark: SparkSession, path: str, mark: str, **fields: str) -> DataFrame:
    """Lines (plain or gzip) that hold the mark, with each named field taken out by its pattern's first group."""
    lines = spark.read.text(path).where(F.col("value").contains(mark))
    return lines.select(*(F.nullif(F.regexp_extract("value", p, 1), F.lit("")).alias(n) for n, p in fields.items()), F.input_file_name().alias("file"))


def numeric(column: str) -> Column:
    """A decorated number (`12.5 us`, `<3`), null if there is none."""
    return F.expr(f"try_cast(nullif(regexp_extract({column}, '[-+]?[0-9]+\\\\.?[0-9]*(?:[eE][-+]?[0-9]+)?', 0), '') as double)")


def concatenated(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files' rows under one header; another header is an error that names the file."""
    frames = [(p, spark.read.csv(p, header=True)) for p in paths]
    for path, frame in frames[1:]:
        if frame.columns != frames[0][1].columns:
            raise ValueError(f"{path} has the header {frame.columns}, not {frames[0][1].columns}")
    out = frames[0][1]
    for _, frame in frames[1:]:
        out = out.unionByName(frame)
    return out
