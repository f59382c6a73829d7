"""The running integral as a stream: any split into batches gives what one batch job gives."""

import random
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltaspan.operators import charge
from voltaspan.streaming import integral

CUT = 30_000_000
COLUMNS = "cell long, file string, us long, seq long, current double"


def recordings(seed=1):
    rng, rows, seq = random.Random(seed), [], 0
    for cell in (1, 2, 3):
        for file in "ab":
            us = rng.randrange(10) * 1_000_000
            for _ in range(60):
                us += rng.choice((0, 1, 5, 5, 90)) * 1_000_000  # repeated times and gaps
                seq += 1
                rows.append((cell, file, us, seq, rng.choice((None, 2.0, -3.0, 1.5, 0.0))))
    return rows


def whole(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    once = df.groupBy("cell", "file", "us").agg(F.max_by(F.struct("current", "seq"), "seq").alias("x")).select("cell", "file", "us", "x.current", "x.seq")
    parts = charge.contributions(once, ["cell", "file"], "us", "seq", "current", cut=CUT)
    return {(str(r.cell), r.file): (r.ah, r.n) for r in parts.groupBy("cell", "file").agg(F.sum("contrib").alias("ah"), F.count("*").alias("n")).collect()}


@pytest.mark.parametrize("batches", [1, 5])
def test_any_split_equals_the_whole(spark, batches):
    rows, rng = recordings(), random.Random(batches)
    folder = tempfile.mkdtemp(prefix="spark-")
    cuts = sorted(rng.sample(range(1, len(rows)), batches - 1))
    by_file = sorted(rows, key=lambda r: (r[2], r[3]))  # all files grow side by side
    for k, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(by_file[i:j], COLUMNS).coalesce(1).write.parquet(f"{folder}/in/part={k}")
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    found = integral.drained(integral.integrated(stream, "cell", "file", "us", "seq", "current", CUT), folder)
    got, want = {(r.cell, r.file): (r.ah, r.n) for r in found.collect()}, whole(spark, rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])
    assert {r.late for r in found.collect()} == {0}


def test_late_rows_are_counted_and_a_later_run_goes_on(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    run = lambda: {(r.cell, r.file): r for r in integral.drained(integral.integrated(spark.readStream.schema(COLUMNS).option("recursiveFileLookup", "true").parquet(f"{folder}/in"), "cell", "file", "us", "seq", "current", CUT), folder, f"{folder}/at").collect()}
    spark.createDataFrame([(1, "a", 0, 1, 3.6), (1, "a", 10_000_000, 2, 3.6)], COLUMNS).write.parquet(f"{folder}/in/part=0")
    first = run()["1", "a"]
    assert first.ah == pytest.approx(0.01) and first.n == 2
    spark.createDataFrame([(1, "a", 5_000_000, 9, 99.0), (1, "a", 20_000_000, 3, 3.6), (1, None, 0, 4, 1.0), (1, "a", None, 5, 1.0)], COLUMNS).write.parquet(f"{folder}/in/part=1")
    later = run()
    assert later["1", "a"].ah == pytest.approx(0.02) and later["1", "a"].late == 1 and later["1", "a"].n == 3
    assert later["1", None].ah == 0


def test_steps_by_hand():
    state = {"settled": 0.0, "n": 0, "late": 0, "us": None, "tie": None, "current": None, "before_us": None, "before_current": None}
    for us, tie, current in ((0, 1, 1.0), (10, 2, 5.0), (10, 3, 3.0), (4, 9, 7.0), (100, 4, 1.0), (110, 5, None)):
        integral._step(state, us * 1_000_000, tie, current, 30e6)
    assert state["late"] == 1 and state["n"] == 4
    assert state["settled"] + integral._part(state, 30e6) == pytest.approx((1 + 3) / 2 * 10 / 3600)


@pytest.mark.parametrize("seed", range(4))
def test_steps_of_a_shelf_are_those_of_each_recording(seed):
    rng = random.Random(seed)
    names = ("settled", "n", "late", "us", "tie", "current", "before_us", "before_current")
    alone, shelf = {}, {c: np.empty(0, integral._TYPES[kind]) for c, kind in integral._NAMES.items()}
    for _ in range(4):
        rows = [(rng.choice(("1", "2", None)), rng.choice(("a", "b", None)), rng.randrange(40) * 1_000_000, rng.randrange(10_000), rng.choice((None, 2.0, -3.0, 0.5))) for _ in range(rng.choice((1, 30)))]
        for cell, file, us, tie, current in sorted(rows, key=lambda r: (r[2], r[3])):
            integral._step(alone.setdefault((cell, file), dict(zip(names, (0.0, 0, 0, *[None] * 5)))), us, tie, current, 5e6)
        shelf, told, newest = integral._steps(shelf, pd.DataFrame(rows, columns=["cell", "file", "us", "tie", "current"]), 5e6)
        assert len(shelf["us"]) == len(alone) and told.sum() == len({r[:2] for r in rows})
        for k, key in enumerate(zip(shelf["cell"], shelf["file"])):
            want = alone[tuple(None if x != x else x for x in key)]
            assert [shelf[c][k] for c in ("n", "late", "us", "tie")] == [want[c] for c in ("n", "late", "us", "tie")]
            assert shelf["settled"][k] + newest[k] == pytest.approx(want["settled"] + integral._part(want, 5e6))


def test_recordings_share_calls(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.range(600).select((F.col("id") % 300).alias("cell"), F.lit("a").alias("file"), (F.col("id") * 1_000_000).alias("us"), F.col("id").alias("seq"), F.lit(1.0).alias("current")).write.parquet(f"{folder}/in")
    monkeypatch.setattr(integral, "SHELVES", 2)
    stream = integral.integrated(spark.readStream.schema(COLUMNS).parquet(f"{folder}/in"), "cell", "file", "us", "seq", "current", 1e12)
    found = integral.drained(stream, folder, f"{folder}/at")
    assert found.count() == 300 and found.where("n = 2").count() == 300
    kept = spark.read.format("statestore").option("stateVarName", "integral").load(f"{folder}/at/state")
    assert kept.count() == 2
