"""Charge as a stream: the running integral of each recording, carried from batch to batch.

State is a few numbers per cell and file: what has been integrated, the newest sample, and the one
before it. The newest sample may still be replaced by another of its time, so what leads to it is
only added once a later one comes. Recordings lie on shelves, by hash, whose state is read and written
whole: a call to Python costs much more than the rows of one recording.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000_000.0

#: A checkpoint keeps the number of shelves that it began with.
SHELVES = 1024

_NAMES = {"cell": "string", "file": "string", "settled": "double", "n": "long", "late": "long", "us": "long", "tie": "long", "current": "double", "before_us": "long", "before_current": "double", "due": "long"}
_STATE = ", ".join(f"{name} array<{kind}>" for name, kind in _NAMES.items())
_TYPES = {"string": object, "double": float, "long": np.int64}


def _step(state: dict, us: int, tie: int, current: float | None, cut: float) -> None:
    """One sample more, of one recording. A sample at the newest time replaces that one if its tie is higher; one
    before it is late and isn't integrated."""
    if state["us"] is not None and us < state["us"]:
        state["late"] += 1
        return
    if us == state["us"]:
        if tie > state["tie"]:
            state.update(tie=tie, current=current)
        return
    if state["us"] is not None:
        state.update(settled=state["settled"] + _part(state, cut), before_us=state["us"], before_current=state["current"])
    state.update(us=us, tie=tie, current=current, n=state["n"] + 1)


def _part(state: dict, cut: float) -> float:
    """What leads to the newest sample: nothing after a gap, or where a current isn't known."""
    a, b = state["before_current"], state["current"]
    if state["before_us"] is None or a is None or b is None or a != a or b != b:
        return 0.0
    dt = state["us"] - state["before_us"]
    return 0.0 if dt > cut else (abs(a) + abs(b)) / 2 * dt / HOUR


def _steps(state: dict[str, np.ndarray], batch: pd.DataFrame, cut: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """``_step`` for all rows of a batch and all recordings of a shelf at once. The state after it, which
    recordings have rows in the batch, and what leads to the newest sample of each. Where there is none
    before the newest its time stands there again."""
    had = len(state["us"])
    pairs = [pd.factorize(np.concatenate([state[c], batch[c].to_numpy(object)]), use_na_sentinel=False)[0].astype(np.int64) for c in ("cell", "file")]
    ids, _ = pd.factorize(pairs[0] * (pairs[1].max() + 1) + pairs[1])
    first, many = np.unique(ids, return_index=True)[1], ids.max() + 1
    of, us = ids[had:], batch["us"].to_numpy(np.int64)
    told = np.bincount(of, minlength=many) > 0
    late = np.zeros(len(of), bool)
    late[of < had] = us[of < had] < state["us"][of[of < had]]

    # rows of a recording: the one before, the newest, those that come; of one time the highest tie counts
    earlier = np.flatnonzero(state["before_us"] < state["us"])
    come = np.flatnonzero(~late)
    rec = np.concatenate([earlier, np.arange(had), of[come]])
    t = np.concatenate([state["before_us"][earlier], state["us"], us[come]])
    tie = np.concatenate([np.zeros(len(earlier), np.int64), state["tie"], batch["tie"].to_numpy(np.int64)[come]])
    current = np.concatenate([state["before_current"][earlier], state["current"], batch["current"].to_numpy(float)[come]])
    order = np.lexsort((-np.arange(len(rec)), tie, t, rec))  # of equal ties the first stands
    rec, t, tie, current = rec[order], t[order], tie[order], current[order]
    last = np.append((rec[1:] != rec[:-1]) | (t[1:] != t[:-1]), True)
    rec, t, tie, current = rec[last], t[last], tie[last], current[last]

    part, dt = np.zeros(len(rec)), np.diff(t)
    part[1:] = np.where((rec[1:] == rec[:-1]) & (dt <= cut), np.nan_to_num((np.abs(current[1:]) + np.abs(current[:-1])) / 2 * dt / HOUR), 0.0)
    ends = np.flatnonzero(np.append(rec[1:] != rec[:-1], True))  # every recording has a row
    newest = part[ends]
    part[ends] = 0.0
    size = np.diff(ends, prepend=-1)
    before = np.where(size > 1, ends - 1, ends)
    grown = lambda c, kind: np.concatenate([state[c], np.zeros(many - had, kind)])
    names = {c: np.concatenate([state[c], batch[c].to_numpy(object)])[first] for c in ("cell", "file")}
    n = grown("n", np.int64) + size
    n[:had] -= 1
    n[earlier] -= 1
    after = names | {
        "settled": grown("settled", float) + np.bincount(rec, part, many), "n": n, "late": grown("late", np.int64) + np.bincount(of[late], minlength=many),
        "us": t[ends], "tie": tie[ends], "current": current[ends], "before_us": t[before], "before_current": current[before], "due": grown("due", np.int64),
    }
    return after, told, newest


class RunningIntegral(StatefulProcessor):
    """Rows cell, file, us, tie, current of a shelf in; the state of its recordings out, of each after every
    batch that has rows of it, and once more (``stale``) when none came for ``patience`` milliseconds."""

    def __init__(self, cut: float, patience: int):
        self.cut, self.patience = cut, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("integral", _STATE)

    def _stored(self) -> dict[str, np.ndarray]:
        lists = self.state.get() if self.state.exists() else [[] for _ in _NAMES]
        state = {}
        for (name, kind), values in zip(_NAMES.items(), lists):
            state[name] = np.empty(len(values), _TYPES[kind])
            state[name][:] = values
        return state

    def _store(self, state: dict[str, np.ndarray]) -> None:
        self.state.update(tuple(state[name].tolist() for name in _NAMES))
        if self.patience:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if (state["due"] > 0).any():
                self.handle.registerTimer(int(state["due"][state["due"] > 0].min()))

    def _told(self, state: dict[str, np.ndarray], which: np.ndarray, newest: np.ndarray, stale: bool) -> pd.DataFrame:
        out = {"cell": state["cell"], "file": state["file"], "ah": state["settled"] + newest, "n": state["n"], "late": state["late"], "last_us": state["us"], "last_current": state["current"]}
        return pd.DataFrame(out)[which].assign(stale=stale)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, told, newest = _steps(self._stored(), pd.concat(list(rows)), self.cut)
        if self.patience:
            state["due"][told] = timerValues.getCurrentProcessingTimeInMs() + self.patience
        self._store(state)
        yield self._told(state, told, newest, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            state = self._stored()
            over = (state["due"] > 0) & (state["due"] <= expiredTimerInfo.getExpiryTimeInMs())
            dt = state["us"] - state["before_us"]
            newest = np.where(dt <= self.cut, np.nan_to_num((np.abs(state["current"]) + np.abs(state["before_current"])) / 2 * dt / HOUR), 0.0)
            state["due"][over] = 0
            self._store(state)
            yield self._told(state, over, newest, True)

    def close(self) -> None:
        pass


def integrated(stream: DataFrame, cell: str, file: str, time: str, tie: str, current: str, cut: float, patience: int = 0) -> DataFrame:
    """The stream of states: cell, file, ah, n (times), late, last_us, last_current, stale. Gaps over ``cut``
    microseconds carry no charge. Rows without a time or a tie are passed over. With ``patience`` a
    file of which nothing more comes is told of once, as one that may have ended."""
    rows = stream.where(F.col(time).isNotNull() & F.col(tie).isNotNull()).select(F.col(cell).cast("string").alias("cell"), F.col(file).cast("string").alias("file"), F.col(time).cast("long").alias("us"), F.col(tie).cast("long").alias("tie"), F.col(current).cast("double").alias("current"))
    schema = "cell string, file string, ah double, n long, late long, last_us long, last_current double, stale boolean"
    processor = RunningIntegral(float(cut), patience)
    shelf = F.pmod(F.xxhash64("cell", "file"), F.lit(SHELVES)).cast("int")
    return rows.withColumn("shelf", shelf).groupBy("shelf").transformWithStateInPandas(processor, outputStructType=schema, outputMode="update", timeMode="ProcessingTime" if patience else "None")


def drained(stream: DataFrame, folder: str, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream of states over all that is there now, and reads each file's newest. A batch that
    is run again replaces its table. With the same ``checkpoint`` a later run goes on from there."""
    spark, at = stream.sparkSession, checkpoint or f"{folder.rstrip('/')}/integral-{uuid.uuid4().hex}"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # what state by processors needs

    def store(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/rows/batch={batch}")

    try:
        query = stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return newest(spark.read.parquet(f"{at}/rows"))


def newest(states: DataFrame, keys: Sequence[str] = ("cell", "file")) -> DataFrame:
    """The last state of each file."""
    others = [c for c in states.columns if c not in (*keys, "batch")]
    return states.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("s")).select(*keys, "s.*")
