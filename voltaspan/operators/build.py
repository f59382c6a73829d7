"""The table of recordings with their charge, built once or extended by what is new, and what
reports make of it. A manifest has one row per recording that is in the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltaspan.operators import charge
from voltaspan.operators.rules import name_field
from voltaspan.sources.shared import kept

LAYERS = ("BRONZE", "SILVER", "GOLD")


def listed(spark: SparkSession, folder: str, pattern: str = "*.parquet", reserved: Sequence[str] = LAYERS) -> DataFrame:
    """Rows path, cell (the folder of a file), name, bytes of the files under a folder, without
    those of its own layers. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", F.col("length").alias("bytes"))
    parts = F.split("path", "/")
    rows = files.select("path", F.element_at(parts, -2).alias("cell"), F.element_at(parts, -1).alias("name"), "bytes")
    return rows.where(~F.exists(parts, lambda p: p.isin(*reserved)))


def key_path(*parts: str | None, root: str | None = None, tag: str | None = None) -> str:
    """A key of a store: the parts that are there, under a tag, under a root."""
    return "/".join(x.strip("/") if k or x[:1] != "/" else x.rstrip("/") for k, x in enumerate(y for y in (root, tag, *parts) if y))


def named_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Tables of cells from CSV, with the name of each one's file but for its ending."""
    reader = spark.read.option("header", "true")
    rows = (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return rows.select("*", F.regexp_replace(name, r"(_[a-z]+)?\.csv$", "").alias("Name"))


def pending(files: DataFrame, manifest: DataFrame, name: str = "name", unfinished: str = "=unfinished") -> DataFrame:
    """Files that aren't in the manifest; those that still run never are."""
    return files.where(~F.col(name).contains(unfinished)).join(manifest.select(name).distinct(), name, "left_anti")


def built(rows: DataFrame, cell: str, file: str, time: str, tie: str, current: str, factor: float) -> DataFrame:
    """Rows cell, time, current, contrib, ah: each file integrated by itself, merged, summed up. What is
    merged is written to a table, as the sum reads it twice."""
    merged = kept(charge.merged_files(rows, cell, file, time, tie, current, factor), "merged")
    width = F.floor(F.col(time) / F.lit(charge.SLICE))
    return charge.running(merged.withColumn("_slice", width), [cell], time, tie).drop("_slice")


def totals(table: DataFrame, cell: str, time: str) -> DataFrame:
    """What an extension goes on from: the charge and the last time of each cell."""
    return table.groupBy(cell).agg(F.max_by("ah", time).alias("_ah"), F.max(time).alias("_last"))


def extended(table: DataFrame, rows: DataFrame, cell: str, file: str, time: str, tie: str, current: str, factor: float) -> tuple[DataFrame, DataFrame]:
    """The table with the rows of new files, and of these the ones that are late: at or before the
    last time of their cell. With a late row the table has to be built anew."""
    before = totals(table, cell, time)
    new = built(rows, cell, file, time, tie, current, factor).join(before, cell, "left")
    late = new.where(F.col(time) <= F.col("_last")).drop("_ah", "_last")
    moved = new.withColumn("ah", F.col("ah") + F.coalesce(F.col("_ah"), F.lit(0.0))).drop("_ah", "_last")
    return table.unionByName(moved), late


def provisional(table: DataFrame, running: DataFrame, cell: str, file: str, time: str, tie: str, current: str, factor: float) -> DataFrame:
    """Per cell the charge and last time that there would be with the files that still run: a view
    made anew each time, never part of the table."""
    both, _ = extended(table, running, cell, file, time, tie, current, factor)
    return both.groupBy(cell).agg(F.max_by("ah", time).alias("ah"), F.max(time).alias("last"), F.max_by(current, time).alias("current"))


def diluted(rows: DataFrame, cell: str, file: str, time: str, tie: str, current: str, factor: float) -> DataFrame:
    """The charge of the union of all files of a cell, taken as one series: too much where files
    overlap. Only a measure of what integrating each file by itself is worth."""
    once = rows.groupBy(cell, file, time).agg(F.max_by(F.struct(current, tie), tie).alias("_x")).select(cell, time, f"_x.{current}", f"_x.{tie}")
    return charge.totals(charge.contributions(once, [cell], time, tie, current, factor), [cell])


def stubs(rows: DataFrame, file: str, order: Sequence[str], whole: Column) -> DataFrame:
    """All rows of the files that count whole (the check-ups), of others the first."""
    first = F.row_number().over(Window.partitionBy(file).orderBy(*order)) == 1
    return rows.withColumn("_keep", first | whole).where("_keep").drop("_keep")


def procedures_of(manifest: DataFrame, cell: str = "cell", name: str = "name") -> DataFrame:
    """Per cell the procedures that its files name, in the order of the names: their fourth field."""
    field = name_field(F.element_at(F.split(F.col(name), "/"), -1), 4)
    rows = manifest.select(cell, name, field.alias("_p")).where("_p is not null")
    listed_ = F.transform(F.array_sort(F.collect_list(F.struct(name, "_p"))), lambda x: x["_p"])  # files of one cell
    return rows.groupBy(cell).agg(listed_.alias("procedures"))


def capacity_table(capacities: DataFrame, procedures: DataFrame, cell: str = "cell", time: str = "start") -> DataFrame:
    """The fleet's capacities: each row with the cell's name, procedures and time (null where there
    is none, or the text of it isn't one)."""
    rows = capacities.join(procedures, cell, "left")
    at = F.col(time).try_cast("timestamp") if time in capacities.columns else F.lit(None).cast("timestamp")
    return rows.withColumns({"Name": F.col(cell).cast("string"), "Time": at})


def block_starts(rows: DataFrame, keys: Sequence[str], time: str, temperature: str) -> DataFrame:
    """First time and mean temperature (two decimals; null without any) of each bundle."""
    return rows.groupBy(*keys).agg(F.min(time).alias("start"), F.bround(F.avg(temperature), 2).alias("temperature"))


def merged_blocks(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Documents by block: what a run made, and of an older one the blocks that it lacks."""
    return new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def documents(rows: DataFrame, key: str, block: str) -> DataFrame:
    """One JSON document per key: its blocks by name, each a list of records without nulls."""
    fields = [c for c in rows.columns if c not in (key, block)]
    record = F.struct(*[F.when(~F.isnan(c), F.col(c)).alias(c) if dict(rows.dtypes)[c] in ("double", "float") else F.col(c) for c in fields])
    lists = rows.groupBy(key, block).agg(F.collect_list(record).alias("_r"))  # records of one block
    return lists.groupBy(key).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(block), F.col("_r")))))).alias("document"))


def first_object(text: Column) -> Column:
    """The first balanced JSON object in a text, braces in strings not counted; null without one."""
    start = F.instr(text, "{")
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        quote = (c == '"') & ~s["escaped"]
        quoted = s["quoted"] != quote
        depth = s["depth"] + F.when(s["quoted"], 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        n = s["n"] + 1
        end = F.when(s["end"] > 0, s["end"]).when((depth == 0) & ~s["quoted"] & (c == "}"), n).otherwise(0)
        return F.struct(depth.alias("depth"), quoted.alias("quoted"), (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"), n.alias("n"), end.alias("end"))

    rest = F.substring(text, start, F.length(text))
    end = F.aggregate(F.split(rest, ""), state, step, lambda s: s["end"])
    return F.when((start > 0) & (end > 0), F.substring(rest, F.lit(1), end))


def status_report(rows: DataFrame, columns: Sequence[str], classes: str, order: Sequence[Column | str], title: str) -> DataFrame:
    """A report as one row of HTML: a table of at most one line per cell, with classes and in order.
    Made for fleets (thousands of cells), whose reports one page holds."""
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("")), F.lit("</td>"))
    line = F.concat(F.lit('<tr class="'), F.coalesce(F.col(classes), F.lit("")), F.lit('">'), *[cell(c) for c in columns], F.lit("</tr>"))
    ranked = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order))).select("_n", line.alias("_line"))
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    body = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]))
    return ranked.agg(F.concat(F.lit(f"<h1>{title}</h1>\n<table>\n{head}\n"), body, F.lit("\n</table>")).alias("html"))
