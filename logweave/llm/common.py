"""Shared plumbing of the llm operators: shared storage, Arrow maps and byte helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

#: Rows and bytes of an Arrow batch at most (a single longer row is a batch of its own): texts can be long, and a worker
#: holds a batch, its copy as Python objects and what is made of it.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: On a local disk Hadoop writes a checksum file beside each file and starts a process for the permissions of each;
#: intermediate tables go without the former. Other file systems don't look at these options.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Where that is unset a local folder serves a local master; on a cluster it is an error, as executors would not see
    each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + os.environ.get("LOGWEAVE_SHARED_DIR", "/tmp/checkpoints")


def _written(df: DataFrame, name: str, files: int | None) -> str:
    spark = df.sparkSession
    text = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, path = _located(spark, text)
    fs.deleteOnExit(path)
    try:
        (df.coalesce(min(files, 1 << 30)) if files else df).write.options(**_PLAIN_FILES).parquet(text)
    except Exception:
        remove(spark, text)
        raise
    return text


def materialize(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back, which cuts the lineage and survives lost executors.

    The table goes when the driver's JVM ends, as it does if the write fails.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_written(df, name, files))


def _located(spark: SparkSession, text: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, *paths: str) -> None:
    for text in paths:
        fs, path = _located(spark, text)
        fs.delete(path, True)
        fs.cancelDeleteOnExit(path)


def files_for(df: DataFrame, each: int = 16 << 20) -> int:
    """Files of a table that is derived from df: one for each so many bytes of df as Spark estimates them, and two for
    each core at least. Fewer and larger files than shuffle partitions make."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // each))


class Scratch:
    """Tables that one operator writes into the shared folder on its way, removed together once its result is written or
    the operator has failed: `with Scratch(spark) as scratch`. files: how many a table has at most."""

    def __init__(self, spark: SparkSession, files: int | None = None):
        self.spark, self.files = spark, files
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, *self.paths)
        self.paths = []
        self.release()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(_written(df, name, self.files))
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def release(self) -> None:
        """Collect garbage on the driver: shuffle files of plans that nothing refers to go with it."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, remembers: str = "") -> DataFrame:
    """mapInArrow with batches of at most BATCH_ROWS rows and BATCH_BYTES bytes.

    Both bounds are settings of the session; where it has its own for the bytes, that one holds. remembers: under which name
    fn keeps things between batches, see remember().
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        _forget_others(remembers)
        yield from fn(batches)

    return df.mapInArrow(run, schema)


_REMEMBERING: dict[str, Callable[[], None]] = {}
_SERVED = [""]  # the name under which this worker's last task ran


def remember(name: str, forget: Callable[[], None]) -> None:
    """Say how a worker forgets what an operator keeps in it between batches. Workers serve one operator after the other;
    what is kept goes when a task of another name begins."""
    _REMEMBERING[name] = forget


def _forget_others(name: str) -> None:
    others = [n for n in _REMEMBERING if n != name]
    for other in others:
        _REMEMBERING.pop(other)()
    if others or name != _SERVED[0]:  # operators that keep nothing leave freed memory behind too
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # what C's allocator has left over, where it can give it back
            ctypes.CDLL(None).malloc_trim(0)
    _SERVED[0] = name


def utf8(column: str = "text") -> Column:
    """The column's UTF-8 bytes; null stays null."""
    return F.col(column).cast("string").cast("binary")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def byte_lists(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The binary column's values, null as empty."""
    return [x or b"" for x in batch.column(column).to_pylist()]


def packed(arrays: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(arrays[f.name], f.type) for f in schema], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit words that spreads every bit (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Mark for broadcast only if a count proves that df has at most so many rows; else leave the join to shuffle.

    Only for rows of numbers and short keys, whose number bounds the bytes.
    """
    if any(isinstance(f.dataType, (ArrayType, MapType, StructType)) for f in df.schema):
        raise TypeError("rows of unbounded width: their number bounds nothing")
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded_sample(marked: DataFrame, docs: DataFrame, rows: int) -> DataFrame:
    """docs(doc_id, ...) joined with marked(doc_id, _y), for at most `rows` of its ids, those of the smallest hashes.

    The ids are chosen before any text is read, and as their number is bounded they are broadcast: no text is shuffled.
    """
    ids = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.join(F.broadcast(ids), "doc_id")


def first_rows(sample: DataFrame, rows: int) -> DataFrame:
    """At most `rows` of the sample, whatever the number of rows that an id has."""
    return sample.orderBy(F.xxhash64("doc_id"), F.xxhash64(*[c for c in sample.columns if c != "doc_id"])).limit(rows)


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A public vocabulary file: in the given folder, in LOGWEAVE_TOKENIZERS, or where the installed package has it."""
    folder = folder or os.environ.get("LOGWEAVE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
