"""Helpers that the corpus operators share: shared-folder tables and id ranges."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a null id counts as where rows are put in order: the smallest long.
NULL_ID = -(2**63)


#: Bytes of a batch that Spark hands to Python: texts are long, and the JVM's buffers for them, twice
#: as large while they grow, are never given back.
BATCH = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's batches to BATCH, unless they are smaller already."""
    now = spark.conf.get(_BATCH_KEY, "64m")
    size = int(re.match("[0-9]+", now)[0]) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now.rstrip("bB")[-1:].lower(), 1)
    if size > BATCH:
        spark.conf.set(_BATCH_KEY, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session has none and runs on one machine (tests) a temporary folder becomes it.
    """
    small_batches(spark)
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    This cuts the lineage: what was computed outlives the executors that computed it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(*frames: DataFrame) -> None:
    """Delete tables that ``written`` wrote and that nothing needs any more: what was computed from
    them has been written itself. Other frames are left alone."""
    for df in frames:
        found = {m[0] for f in df.inputFiles()[:1] if (m := re.match(r".*/[a-z-]+-[0-9a-f]{32}(?=/)", f))}
        spark = df.sparkSession
        for path in found:
            if path.split(":")[-1].lstrip("/").startswith(shared_dir(spark).split(":")[-1].lstrip("/")):
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: What a worker process keeps from task to task; each entry forgets its own.
KEPT: list = []


def lean() -> None:
    """Called where a task of an operator begins that keeps nothing from task to task: what the
    worker still holds of other operators goes, and free memory back to the system."""
    for forget in KEPT:
        forget()
    trim()


def trim() -> None:
    """Free memory of a worker goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def id_bounds(df: DataFrame, column: str, parts: int) -> np.ndarray:
    """At most ``parts - 1`` ascending ids that cut the rows into ranges of about one size.

    Reads that column alone. The driver gets the bounds, not the ids.
    """
    if parts < 2:
        return np.empty(0, np.int64)
    probs = [i / parts for i in range(1, parts)]
    ids = df.select(F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID)).alias("id"))
    found = ids.agg(F.percentile_approx("id", probs, 100 * parts).alias("q")).first()["q"]
    return np.unique(np.array(found or [], np.int64))


def id_array(column) -> np.ndarray:
    """An Arrow column of ids as int64, nulls as NULL_ID."""
    return column.cast("int64").fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def ranges(df: DataFrame, rows_each: int = 16384, most: int = 4096) -> int:
    """How many id ranges to cut ``df`` into: by its rows, at least one per shuffle partition."""
    return min(most, max(partitions(df), -(-df.count() // rows_each)))


def flushed(rows: Iterator[tuple], schema, every: int = 4096, nbytes: int = 16 << 20):
    """Record batches of ``schema`` from tuples, cut at so many rows or about so many bytes."""
    held: list[tuple] = []
    size = 0

    def batch():
        cols = list(zip(*held)) if held else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= every or size >= nbytes:
            yield batch()
            held.clear()
            size = 0
    if held:
        yield batch()
