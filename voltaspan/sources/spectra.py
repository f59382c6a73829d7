"""Impedance spectra from folders of files, CSV and Parquet mixed, each told by its first bytes.

Spark lists the files and hands each one's bytes to a task, so any store will do. A file is one
measurement, a few hundred rows. What can't be used isn't an error of the job: every file with
something in it is either in the table of spectra or in the table of reasons.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaspan.sources.shared import kept

# Fixed names: columns of the devices' files and what they are called here; the token that marks a
# measurement's name; its time of day.
COLUMNS = {"Zeit": "time", "ActFreq": "frequency", "Zreal1": "z_real", "Zimg1": "z_imag", "Betrag": "z_abs", "Phase": "phase", "U1": "u"}
NEEDED = ("ActFreq", "Zreal1", "Zimg1", "Betrag")
MARKER = r"(?:EIS|INS)\d+"
DATE = r"\d{4}-\d{2}-\d{2}[ _]\d{6}"

NUMBERS = ("frequency", "z_real", "z_imag", "z_abs", "phase", "u")
SCHEMA = pa.schema(
    [("path", pa.string()), ("cell", pa.string()), ("eis_number", pa.string()), ("test_date", pa.timestamp("us", "UTC")), ("time", pa.timestamp("us", "UTC"))]
    + [(c, pa.float64()) for c in NUMBERS] + [("reason", pa.string())]
)


def identity(path: str, marker: str = MARKER) -> dict | None:
    """Cell, number and date that a name tells, from the last part of a path that has the token;
    None if there is none. A cell is the second field of the name, else the folder."""
    parts = path.replace("%3D", "=").split("/")
    for at in range(len(parts) - 1, -1, -1):
        if found := re.search(marker, parts[at]):
            fields = re.sub(r"\.\w+$", "", parts[at]).split("=")
            date = re.search(DATE, parts[at])
            return {"cell": fields[1] if len(fields) > 2 else parts[at - 1] if at else None, "eis_number": found[0], "test_date": date and pd.to_datetime(date[0].replace("_", " "), errors="coerce", utc=True)}
    return None


def raw(content: bytes) -> pd.DataFrame:
    """Rows of a file. The second line of a CSV file has units."""
    if content[:4] == b"PAR1":
        return pd.read_parquet(io.BytesIO(content))
    return pd.read_csv(io.BytesIO(content), skiprows=[1], float_precision="round_trip")


def settled(rows: pd.DataFrame) -> pd.DataFrame:
    """The last row of each frequency, of those with a positive frequency and magnitude, in the order
    of frequencies."""
    for c in set(COLUMNS) & set(rows.columns) - {"Zeit"}:
        rows[c] = pd.to_numeric(rows[c], errors="coerce")
    fine = rows[(rows["ActFreq"] > 0) & (rows["Betrag"] > 0)]
    last = fine.drop_duplicates("ActFreq", keep="last").rename(columns=COLUMNS).sort_values("frequency")
    last["time"] = pd.to_datetime(last["time"], errors="coerce", utc=True) if "time" in last else pd.NaT
    return last


def _read(batches: Iterator[pa.RecordBatch], marker: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            of, reason, found = identity(path, marker), None, None
            if of is None:
                reason = "no measurement's name"
            else:
                try:
                    rows = raw(content)
                    lacking = [c for c in NEEDED if c not in rows.columns]
                    found = settled(rows) if not lacking else None
                    reason = f"no column {', '.join(lacking)}" if lacking else "no settled point" if not len(found) else None
                except Exception as error:  # noqa: BLE001  whatever is wrong with a file is told of
                    reason = f"unreadable: {type(error).__name__}"
            of = of or {"cell": None, "eis_number": None, "test_date": None}
            rows = found if reason is None else pd.DataFrame(index=[0])
            rows = rows.assign(path=path, cell=of["cell"], eis_number=of["eis_number"], test_date=of["test_date"], reason=reason)
            rows = rows.reindex(columns=SCHEMA.names)
            rows["time"] = pd.to_datetime(rows["time"], utc=True)  # a column of nulls has no type of its own
            yield pa.RecordBatch.from_pandas(rows, schema=SCHEMA, preserve_index=False)


def read(spark: SparkSession, folder: str, marker: str = MARKER, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """The spectra under a folder (path, cell, eis_number, test_date, time, frequency, z_real,
    z_imag, z_abs, phase, u), and path and reason of each file without one. Each file is read once.
    Files whose name lacks the marker are no measurements; one that can't be read, lacks a column,
    or never settles has a reason too. Files
    without a byte aren't listed by Spark and are in neither table. Columns that a file doesn't have are null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    parts = spark.sparkContext.defaultParallelism
    found = kept(files.select("path", "content").repartition(parts, "path").mapInArrow(lambda b: _read(b, marker), _ddl()), "spectra")
    return found.where("reason is null").drop("reason"), found.where("reason is not null").select("path", "reason")


def _ddl() -> str:
    kinds = {pa.string(): "string", pa.float64(): "double"}
    return ", ".join(f"{f.name} {kinds.get(f.type, 'timestamp')}" for f in SCHEMA)


def metas(spectra: DataFrame) -> DataFrame:
    """One row per measurement: first settled time, points, mean voltage."""
    keys = ["path", "cell", "eis_number", "test_date"]
    return spectra.groupBy(*keys).agg(F.min("time").alias("meas_time"), F.count("*").alias("n_points"), F.avg("u").alias("mean_u"))
