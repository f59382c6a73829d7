"""Recordings as streams: daily charge with late rows and open days, and appended totals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Run an aggregation over all that is there now, to tables in ``folder``, and read the last.

    Each batch writes the totals of all rows so far (complete mode), so windows that are still open
    count, and rows that are later than a watermark. A batch that is run again replaces its table.
    """
    at, spark, batches = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}", stream.sparkSession, []

    def store(totals: DataFrame, batch: int) -> None:
        totals.write.mode("overwrite").parquet(f"{at}/rows/{batch}")
        batches.append(batch)

    query = stream.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows/{batches[-1]}") if batches else spark.createDataFrame([], stream.schema)


def source(spark: SparkSession, folder: str, name: str, per_trigger: int = 100) -> DataFrame:
    """The files of a table, one or a folder of parts, as a stream, some at a time."""
    at = f"{folder}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    whole = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isDirectory()
    stream = spark.readStream.schema(spark.read.parquet(at).schema).option("maxFilesPerTrigger", per_trigger)
    return stream.parquet(at) if whole else stream.option("pathGlobFilter", name).parquet(folder)


def daily(events: DataFrame, time: str, key: str, value: str) -> DataFrame:
    """Rows and sum per key and day, late rows too: state is one row per key and day."""
    marked = events.withColumn("_at", F.col(time).cast("timestamp"))
    return marked.groupBy(F.window("_at", "1 day"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("day"), key, "n", "total")


def appended(totals: DataFrame, new: DataFrame, key: str, value: str, count: str) -> DataFrame:
    """Stored totals with those of new recordings added: what an incremental build stores next."""
    both = totals.select(key, value, count).unionByName(new.select(key, value, count))
    return both.groupBy(key).agg(F.sum(value).alias(value), F.sum(count).alias(count))
