"""What queries cost as tables grow: files by cell, tasks of fits, points of a grid; ties of rounding."""

from __future__ import annotations

import glob
import itertools

import numpy as np
from pyspark.sql import functions as F

from voltaspan.functions import kernels
from voltaspan.operators import fleet, isolation, sweeps
from voltaspan.operators.groups import dealt
from voltaspan.sources import files


def _rows(spark):
    return spark.range(400).select((F.col("id") % 40).alias("cell"), (F.col("id") % 3).alias("bm"), "id", F.lit("qOCV_CHA").alias("target"))


def test_a_small_cell_has_one_file(spark, tmp_path):
    files.write_by_cell(_rows(spark), str(tmp_path / "t"))
    assert len(glob.glob(f"{tmp_path}/t/cell=*/*.parquet")) == 40
    assert spark.read.parquet(str(tmp_path / "t")).count() == 400


def test_a_large_cell_has_several(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILE_ROWS", 5)
    files.write_by_cell(_rows(spark).where("cell = 1 or id < 3"), str(tmp_path / "t"))
    assert len(glob.glob(f"{tmp_path}/t/cell=1/*.parquet")) > 1 == len(glob.glob(f"{tmp_path}/t/cell=2/*.parquet"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 12


def test_files_in_order_are_as_many_as_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_parts", lambda rows: 4)
    files.write_in_order(_rows(spark), str(tmp_path / "t"), ["cell"])
    assert len(glob.glob(f"{tmp_path}/t/*.parquet")) == 4
    assert spark.read.parquet(str(tmp_path / "t")).exceptAll(_rows(spark)).count() == 0


def test_exported_sweeps_come_back_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_parts", lambda rows: 2)
    sweeps.exported(_rows(spark), spark.createDataFrame([(1, 0, 0.9)], "cell long, bm long, soh double"), str(tmp_path / "t"))
    found = spark.read.parquet(str(tmp_path / "t"))
    assert found.count() == 400 and {r.soh for r in found.select("soh").distinct().collect()} == {"0.9", "NA"}
    assert len(glob.glob(f"{tmp_path}/t/target=qOCV_CHA/*.parquet")) == 2


def test_ties_of_health_go_by_the_double(spark):
    x = 154050.0 / 300000.0 * 100  # just under 51.35, ten times it is 513.5
    found = spark.createDataFrame([(154050.0,)], "c double").select(fleet.soh(F.col("c"), 300000.0).alias("s")).first().s
    assert x * 10 == 513.5 and found == 51.4


def test_groups_of_little_data_have_many_tasks(spark):
    n = spark.sparkContext.defaultParallelism
    assert dealt(spark.range(50).withColumnRenamed("id", "k"), ["k"]).rdd.getNumPartitions() >= 4 * n


def test_a_grid_is_solved_at_once_and_gives_the_same(monkeypatch):
    rng, calls = np.random.default_rng(3), []
    solved = kernels.solved
    t, y = np.linspace(0, 50, 40), rng.normal(size=40) + np.exp(-np.linspace(0, 50, 40) / 3)
    design = lambda a, b: kernels.beside(np.ones_like(t), np.exp(-t / a), np.exp(-t / b))
    monkeypatch.setattr(kernels, "levenberg_marquardt", lambda residual, start, *rest: (start, 0.0))
    monkeypatch.setattr(kernels, "solved", lambda *a: calls.append(0) or solved(*a))
    found = kernels.searched(design, y, [(0.2, 60.0), (20.0, 600.0)], [True, False, True], ordered=2, points=7, rounds=1, together=True)
    grid = [at for at in itertools.product(np.linspace(np.log(0.2), np.log(60.0), 7), np.linspace(np.log(20.0), np.log(600.0), 7)) if at[0] <= at[1]]
    best = min((solved(design(*np.exp(at)), y, np.array([True, False, True]))[1], k) for k, at in enumerate(grid))
    assert found[2] == best[0] and np.array_equal(found[0], np.exp(grid[best[1]]))
    assert len(calls) < len(grid) / 2


def test_paths_of_a_batch_are_those_of_its_rows(spark):
    rows = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 9 != 0, F.col("id") / 3).alias("b"))
    forest = isolation.isolation_forest(rows, "id", ["a", "b"], trees=4, sample=16).first()
    found = {r.id: r.score for r in isolation.outliers(rows, rows, "id", ["a", "b"], None, trees=4, sample=16).collect()}
    for r in rows.collect():
        if r.b is None:
            assert found[r.id] is None
            continue
        paths = []
        for tree in forest.trees:
            node = 1
            while tree.feature[node] >= 0:
                node = 2 * node + ([r.a, r.b][tree.feature[node]] >= tree.split[node])
            paths.append(tree.path[node])
        assert abs(found[r.id] - 2 ** (-np.mean(paths) / forest.usual)) < 1e-12
