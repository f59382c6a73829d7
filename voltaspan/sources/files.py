"""Files in and out: recordings by cell, name fields, stubs, idempotent writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the columns of raw recordings.
RENAMED = {"Zeit": "Time", "Spannung": "Voltage", "Strom": "Current", "T1": "Temperature", "Prozedur": "Procedure", "Zustand": "State"}


def name_fields(path: Column) -> dict[str, Column]:
    """The fields of a recording's name, which ``=`` parts, and the tokens in it."""
    name = F.element_at(F.split(path, "/"), -1)
    parts = F.split(F.regexp_replace(name, r"\.parquet$", ""), "=")
    part = lambda i: F.try_element_at(parts, F.lit(i))
    token = lambda pattern: F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    return {
        "project": part(1), "specimen": part(2), "started": F.try_to_timestamp(part(3), F.lit("yyyy-MM-dd_HHmmss")), "programme": part(4), "test": part(5), "equipment": part(6),
        "bytes": token(r"filesize-([0-9]+)").cast("long"), "finished": ~name.contains("=unfinished"), "eis": token(r"((?:EIS|INS)[0-9]+)"), "bm": token(r"_BM([0-9]+)_").cast("int"),
        "soh": token(r"_([0-9.]+)SOH").try_cast("double"),
    }


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """All recordings under a path, with columns under their usual names, missing ones null, and
    the fields of the file's name."""
    rows = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(path)
    rows = rows.withColumnsRenamed({k: v for k, v in RENAMED.items() if k in rows.columns})
    for c in RENAMED.values():
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string" if c in ("Procedure", "State") else "timestamp" if c == "Time" else "double"))
    rows = rows.withColumn("State", F.regexp_replace("State", r"^(PAUO?)\*\*$", "$1"))
    return rows.withColumns({"file": F.col("_metadata.file_path"), **name_fields(F.col("_metadata.file_path"))})


def impedance_csv(spark: SparkSession, path: str) -> DataFrame:
    """Spectra from CSV; the line of units and rows before settling have no positive frequency."""
    rows = spark.read.option("header", "true").csv(path)
    number = {c: F.col(c).try_cast("double") for c in ("ActFreq", "Zreal1", "Zimg1", "Betrag", "Phase", "U1") if c in rows.columns}
    return rows.withColumns(number).where("ActFreq > 0 and Betrag > 0")


def missing(new: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that aren't there yet by their keys; null keys count as equal."""
    same = None
    right = there.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    for k in keys:
        one = new[k].eqNullSafe(right[f"_{k}"])
        same = one if same is None else same & one
    return new.join(right, same, "left_anti")


#: Rows of a cell beyond which its files become more than one.
FILE_ROWS = 1_000_000


def write_by_cell(rows: DataFrame, path: str, key: str = "cell", mode: str = "overwrite") -> None:
    """A table of one folder per cell, of one file, as files are what such a table costs. Rows of a
    large cell are spread over one file for each ``FILE_ROWS``, so it is no single task's."""
    n = F.ceil(F.col("_n") / FILE_ROWS).cast("int")
    large = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > FILE_ROWS).select(F.col(key).alias("_key"), n.alias("_files"))
    spread = rows.join(large, rows[key].eqNullSafe(F.col("_key")), "left").withColumn("_file", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_files", F.lit(1))))
    written_by(spread, [key, "_file"], [key], path, rows.columns, mode=mode)


def _parts(rows: DataFrame) -> int:
    spark = rows.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def written_by(rows: DataFrame, deal: list[str], keys: list[str], path: str, columns: list[str], order: list[str] | None = None, mode: str = "overwrite", kind: str = "parquet") -> None:
    """Rows dealt to tasks by ``deal`` and written to a folder for each value of ``keys``. Tasks move
    their files to their places themselves: the driver would do it one at a time, and a job that
    fails leaves a table that its caller never reads."""
    dealt = rows.repartition(_parts(rows), *deal).sortWithinPartitions(*keys, *(order or [])).select(*columns)
    dealt.write.mode(mode).option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*keys).format(kind).save(path)


def write_in_order(rows: DataFrame, path: str, keys: list[str], folders: list[str] | None = None, mode: str = "overwrite") -> None:
    """A table in files by ranges of the keys, sorted by them: each file tells its least and greatest
    key, so whoever reads one key opens one file or two, and the number of files is that of tasks,
    not that of keys. A key of many rows is shared by tasks, as ranges end within it."""
    ranged = rows.repartitionByRange(_parts(rows), *keys, F.xxhash64(*rows.columns)).sortWithinPartitions(*(folders or []), *keys)
    ranged.write.mode(mode).partitionBy(*(folders or [])).parquet(path)
