"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Where driver and executors both write: what ``spark.checkpoint.dir`` names; on one machine a
    temporary folder, if it names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found or f"file://{tempfile.mkdtemp(prefix='spark-')}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a table of its own in the shared folder and read again: the lineage ends
    there, so a lost executor costs no more than its tasks."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table that ``kept`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {m[0] for f in df.inputFiles()[:1] if (m := re.match(r".*/[a-z-]+-[0-9a-f]{32}(?=/)", f))}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def few_bytes(spark: SparkSession, most: int = 8 << 20) -> None:
    """Batches that go to Python hold so many bytes at most: rows of long arrays are large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))
