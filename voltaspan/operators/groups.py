"""Small groups dealt out to many tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def dealt(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows by their keys in a number of partitions that Spark leaves as it is. Groups that are fitted
    are a few bytes and much work: left to its measure of bytes, Spark puts all of them into one task."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


#: Whole groups wait for a call until they have so many rows; batches that Spark hands over are smaller.
ROWS = 32_768


def together(rows: DataFrame, keys: Sequence[str], order: Sequence[str], many: Callable, schema: str) -> DataFrame:
    """Groups dealt out and sorted, many of them in one call, for work that is little for each of them.

    ``many`` takes whole groups as columns (arrays of all their rows) and the place where each begins,
    and gives, for each row of its result, the number of its group, and the columns besides the keys.
    Nulls of a key are one group.
    """
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = [batch.column(k) for k in keys]
            begins = np.zeros(batch.num_rows, bool)
            for n, c in enumerate(whole):
                before = pa.concat_arrays([last[n] if last else c.slice(0, 1), c.slice(0, len(c) - 1)])
                begins |= pc.fill_null(pc.not_equal(c, before), False).to_numpy(zero_copy_only=False) | pc.xor(c.is_null(), before.is_null()).to_numpy(zero_copy_only=False)
            last = [c.slice(len(c) - 1, 1) for c in whole]
            at = np.flatnonzero(begins)
            if len(at) and sum(b.num_rows for b in waiting) + at[-1] >= ROWS:
                yield from made([*waiting, batch.slice(0, at[-1])])
                waiting, batch = [], batch.slice(at[-1])
            waiting.append(batch)
        yield from made(waiting)

    def made(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sum(b.num_rows for b in batches):
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        begins = np.zeros(table.num_rows, bool)
        begins[0] = True
        for c in (table.column(k) for k in keys):
            a, b = c.slice(1), c.slice(0, len(c) - 1)
            begins[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy() | pc.xor(a.is_null(), b.is_null()).to_numpy()
        starts = np.flatnonzero(begins)
        of, columns = many({c: table.column(c).to_numpy() for c in table.column_names if c not in keys}, starts)
        at = pa.array(starts[of], pa.int64())
        yield from pa.table({**{k: table.column(k).take(at) for k in keys}, **{c: pa.array(x, from_pandas=True) for c, x in columns.items()}}).to_batches(max_chunksize=10_000)

    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return dealt(rows, keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{types}, {schema}")


def curves(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], one: Callable, names: Sequence[str]) -> DataFrame:
    """A curve of each group: ``one`` takes its columns in order and gives arrays of doubles, of one length,
    by their names, or None."""

    def many(values: dict[str, np.ndarray], starts: np.ndarray):
        ends = np.append(starts[1:], len(values[columns[0]]))
        found = [one(*(values[c][a:b] for c in columns)) for a, b in zip(starts, ends)]
        sizes = [len(f[names[0]]) if f is not None else 0 for f in found]
        made = {n: np.concatenate([np.empty(0), *[f[n] for f in found if f is not None]]) for n in names}
        return np.repeat(np.arange(len(starts)), sizes), made

    return together(rows, keys, order, many, ", ".join(f"{n} double" for n in names))


def padded(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Groups of an array as rows of a table, zeros behind the shorter ones."""
    most = int((ends - starts).max(initial=0))
    places = starts[:, None] + np.arange(most)
    inside = places < ends[:, None]
    return np.where(inside, values[np.where(inside, places, 0)], 0.0)
