"""Builds that are committed: a folder of versions, each whole or not there.

A version is a set of tables written under names of their own and a manifest that names them. The
manifest is written beside its place and moved there in one step, last of all; the highest manifest
is the version that counts. Whoever is stopped on the way leaves the version before as it was.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaspan.operators import build
from voltaspan.operators.segment import program_index
from voltaspan.sources.shared import kept


class Conflict(RuntimeError):
    """Another build has committed the version in the meantime."""


@dataclass(frozen=True)
class Version:
    number: int
    tables: dict[str, str]  # folder and columns of each table
    columns: dict[str, str]


class Store:
    """Versions of a build in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> Version | None:
        """The highest committed version; None before the first."""
        path, files = self._path("manifests")
        if not files.exists(path):
            return None
        names = [s.getPath().getName() for s in files.listStatus(path)]
        found = sorted(n for n in names if re.fullmatch(r"v\d{9}\.json", n))
        if not found:
            return None
        text = "".join(r.value for r in self.spark.read.text(f"{self.folder}/manifests/{found[-1]}", wholetext=True).collect())  # one row
        return Version(**json.loads(text))

    def table(self, name: str, version: Version | None = None) -> DataFrame:
        version = version or self.current()
        return self.spark.read.schema(version.columns[name]).parquet(f"{self.folder}/{version.tables[name]}")

    def write(self, name: str, df: DataFrame) -> str:
        """A table under a name of its own, which no version has yet."""
        folder = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{folder}")
        return folder

    def publish(self, version: Version) -> None:
        """The manifest goes to its place in one step, unless one is there."""
        (waiting, files), (folder, _) = self._path(f"waiting-{uuid.uuid4().hex}.json"), self._path("manifests")
        place, _ = self._path(f"manifests/v{version.number:09d}.json")
        out = files.create(waiting)
        out.write(bytearray(json.dumps({"number": version.number, "tables": version.tables, "columns": version.columns}).encode()))
        out.close()
        files.mkdirs(folder)
        if files.exists(place) or not files.rename(waiting, place):
            files.delete(waiting, False)
            raise Conflict(f"version {version.number} is there already")

    def commit(self, tables: dict[str, DataFrame], after: Version | None) -> Version:
        """All tables, then the manifest of the version that follows ``after``."""
        columns = {name: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) for name, df in tables.items()}
        version = Version(after.number + 1 if after else 1, {name: self.write(name, df) for name, df in tables.items()}, columns)
        self.publish(version)
        return version

    def cleared(self, keep: int = 2) -> int:
        """Deletes tables that none of the last ``keep`` versions names, and waiting manifests; how
        many. Not to be called while another build writes."""
        now = self.current()
        if now is None:
            return 0
        named = set()
        for number in range(max(1, now.number - keep + 1), now.number + 1):
            text = self.spark.read.text(f"{self.folder}/manifests/v{number:09d}.json", wholetext=True).first().value
            named |= set(json.loads(text)["tables"].values())
        path, files = self._path("")
        old = [s.getPath() for s in files.listStatus(path) if s.getPath().getName() not in named | {"manifests"}]
        return sum(bool(files.delete(p, True)) for p in old)


def update(store: Store, rows: DataFrame, cell: str, file: str, program: str, time: str, tie: str, current: str, factor: float, unfinished: str = "=unfinished") -> Version | None:
    """A version with what is new among ``rows``: recordings whose file is finished and in no version.

    Tables: ``rows`` (cell, time, current, charge), ``files``, ``programs`` (number of each program
    within its cell, made anew over all). New rows go on from where their cell stands. A cell
    that has a late row, at or before its last time, is built anew from all its recordings, and only
    such a cell. Without a new file there is no new version (None). Files whose name is null are
    passed over.
    """
    now = store.current()
    names = rows.select(F.col(file).cast("string").alias("name")).where("name is not null").distinct()
    known = store.table("files", now) if now else names.limit(0)
    new = build.pending(names, known, unfinished=unfinished)
    if not new.take(1):
        return None
    of = F.col(file).cast("string")
    files = kept(new, "files")
    fresh = rows.join(files.select(F.col("name").alias("_name")), of == F.col("_name"), "left_semi")
    known = known.unionByName(files)
    programs = fresh.select(cell, program).distinct()
    columns = list(dict.fromkeys((cell, file, time, tie, current)))
    if now is None:
        table = build.built(fresh.select(*columns), cell, file, time, tie, current, factor)
    else:
        before = store.table("rows", now)
        last = kept(build.totals(before, cell, time), "last")
        first = fresh.groupBy(cell).agg(F.min(time).alias("_first"))
        late = kept(first.join(last, cell).where(F.col("_first") <= F.col("_last")).select(cell), "late")
        # what comes and, of cells with late rows, all that is known: built in one go
        again = rows.join(late, cell, "left_semi").join(known.select(F.col("name").alias("_name")), of == F.col("_name"), "left_semi")
        made = build.built(fresh.join(late, cell, "left_anti").select(*columns).unionByName(again.select(*columns)), cell, file, time, tie, current, factor)
        moved = made.join(last.join(late, cell, "left_anti"), cell, "left").withColumn("ah", F.col("ah") + F.coalesce(F.col("_ah"), F.lit(0.0))).drop("_ah", "_last")
        table = before.join(late, cell, "left_anti").unionByName(moved)
        programs = store.table("programs", now).select(cell, program).unionByName(programs)
    return store.commit({"rows": table, "files": known, "programs": program_index(programs, cell, program)}, now)
