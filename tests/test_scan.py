"""Scans over slices equal windows over whole keys; medians equal those of sorted lists."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from voltaspan.operators import charge, joins, median, scan, segment

KINDS = ("sum", "max", "min", "last", "lag", "next")


@pytest.fixture(scope="module")
def rows(spark):
    rng, made = random.Random(1), []
    for key in (1, 2, None):
        for k in range(150):
            made.append((key, rng.choice((None, *range(-40, 400))) if key == 2 else rng.randrange(300), k, rng.choice((None, *range(5))), rng.choice("ab")))
    return spark.createDataFrame(made, "key long, t long, tie long, v long, s string").repartition(4)


@pytest.mark.parametrize("width", [7, 100, 10_000, None])
def test_scans_equal_windows(rows, width):
    found = scan.scanned(rows, ["key"], ["t", "tie"], {k: scan.Carry(k, F.col("v")) for k in KINDS}, width)
    w = Window.partitionBy("key").orderBy("t", "tie")
    so_far, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = rows.select(
        *rows.columns, F.sum("v").over(so_far).alias("sum"), F.max("v").over(so_far).alias("max"), F.min("v").over(so_far).alias("min"), F.last("v", True).over(so_far).alias("last"),
        F.lag("v").over(w).alias("lag"), F.first("v", True).over(ahead).alias("next"),
    )
    assert sorted(map(str, found.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_no_window_over_a_whole_key(spark, rows):
    """Every window over rows is by slice; those by key alone see a row per slice."""
    for df in (segment.run_table(rows, ["key"], ["t", "tie"], "s", "t"), segment.cycles(rows, ["key"], "t", "tie", 5), joins.held(rows, rows, ["key"], "t", "v")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and not any(re.search(r"\[key#\d+L\], \[t#", line) for line in windows)


def test_runs_over_slices(spark):
    made = [(1, t, t, "ab"[(t // 37) % 2]) for t in range(400)]
    frame = spark.createDataFrame(made, "key long, t long, tie long, s string")
    new = lambda now, was: F.coalesce(now["v"] != was["v"], F.lit(True))
    for width in (1, 10, 37, 5000):
        runs = scan.numbered(frame, ["key"], ["t", "tie"], {"v": F.col("s")}, new, "run", {"begin": F.col("t")}, {"total": scan.Carry("sum", F.col("t")), "even": scan.Carry("last", F.when(F.col("t") % 50 == 0, F.col("t")))}, width)
        assert {r.t: (r.run, r.begin, r.total, r.even) for r in runs.collect()} == {t: (t // 37 + 1, t // 37 * 37, t * (t + 1) // 2, t // 50 * 50) for t in range(400)}


def test_medians(spark):
    rng = np.random.default_rng(2)
    groups = {1: rng.integers(0, 10**9, 501), 2: rng.integers(-50, 50, 400), 3: np.array([5]), 4: np.array([1, 10**12]), 5: np.full(9, 7), None: rng.integers(900_000, 1_100_000, 300)}
    made = [(key, int(v)) for key, vs in groups.items() for v in vs] + [(6, None), (1, None)]
    found = median.medians(spark.createDataFrame(made, "key long, v long").repartition(4), ["key"], "v").collect()
    assert {r.key: (r.n, r["median"]) for r in found} == {key: (len(vs), float(np.median(vs))) for key, vs in groups.items()}
    real = [(1, float(v)) for v in rng.normal(size=101)]
    assert median.medians(spark.createDataFrame(real, "key long, v double"), ["key"], "v").first()["median"] == np.median([v for _, v in real])


def test_first_rows_without_an_interval(spark):
    one = spark.createDataFrame([(1, 5, 0, 2.0)], "cell long, us long, seq long, current double")
    assert charge.totals(charge.contributions(one, ["cell"], "us", "seq", "current"), ["cell"]).first().ah == 0
