"""Operators on made cases: gaps, slices, nulls, discards, neighbours, files, streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from voltaspan.operators import charge, joins, ladder, segment
from voltaspan.sources import files
from voltaspan.streaming import incremental

MINUTE = 60_000_000


def test_previous_row_crosses_slices(spark):
    rows = [("a", 10 * i + (i % 3), i, float(i)) for i in range(50)] + [("b", 5, 100, 1.0)]
    df = spark.createDataFrame(rows, "cell string, us long, seq long, x double")
    for width in (7, 45, 10**9):
        out = {r["seq"]: r["prev_x"] for r in charge.with_previous(df, ["cell"], "us", "seq", ["x"], width).collect()}
        assert out == {**{i: float(i - 1) if i else None for i in range(50)}, 100: None}


def test_gap_is_masked_and_null_counts_as_no_charge(spark):
    at = [0, 60, 120, 180, 240, 10_000, 10_060]
    rows = [("a", s * 1_000_000, i, 2.0 if i != 3 else None) for i, s in enumerate(at)]
    df = spark.createDataFrame(rows, "cell string, us long, seq long, current double")
    parts = charge.contributions(df, ["cell"], "us", "seq", "current", 50.0)
    assert round(charge.totals(parts, ["cell"]).first()["ah"], 9) == round(3 * 2.0 * 60 / 3600, 9)
    last = charge.running(parts, ["cell"], "us", "seq", F.lit(1.0)).orderBy(F.col("us").desc()).first()["ah"]
    assert round(last, 9) == round(1 + 3 * 2.0 * 60 / 3600, 9)


def program(states, minutes, bm=0, names=None):
    us, rows = 0, []
    for i, (s, m) in enumerate(zip(states, minutes)):
        us += m * MINUTE
        rows.append(("c", bm, us, 1000 * bm + i, s, (names or ["P"] * len(states))[i]))
    return rows


def segmented(spark, rows, min_rows=3):
    df = spark.createDataFrame(rows, "cell string, bm long, us long, seq long, state string, procedure string")
    return {r["seq"]: r for r in segment.procedures(df, limits=segment.Limits(9.9, min_rows)).collect()}


def test_procedures(spark):
    states = ["CHA"] * 4 + ["PAU"] * 4 + ["DCH"] * 4 + ["PAU"] * 2 + ["DCH"] * 4
    out = segmented(spark, program(states, [1] * 5 + [8] * 3 + [1] * 10))
    assert [out[i]["proc"] for i in range(4)] == [1] * 4
    assert out[5]["proc"] == out[6]["proc"] == 0  # inside of a long pause
    assert out[8]["proc"] > 1 and out[12]["proc"] == out[13]["proc"] == 0  # a short pause
    assert out[14]["proc"] == out[8]["proc"]


def test_small_programs(spark):
    rows = program(["CHA", "DCH"], [1, 1]) + program(["CHA", "PAU", "CHA"], [1] * 3, 1) + program(["PAU"] * 6, [1] * 6, 2)
    out = segmented(spark, rows, min_rows=4)
    assert set(out) == {0, 1} and {r["target"] for r in out.values()} == {"AGING"} and {r["proc"] for r in out.values()} == {0}


def test_null_state_is_a_boundary(spark):
    df = spark.createDataFrame([("c", i, i, s) for i, s in enumerate(["A", "A", None, None, "A"])], "cell string, us long, seq long, state string")
    assert [r["run"] for r in segment.runs(df, ["cell"], ["us", "seq"], "state").orderBy("us").collect()] == [1, 1, 2, 3, 4]


def test_nearest_prefers_the_earlier_of_two(spark):
    left = spark.createDataFrame([("c", 1, 100), ("c", 2, 500), ("c", 3, 2000)], "cell string, id long, us long")
    right = spark.createDataFrame([("c", 90, 10), ("c", 110, 11), ("c", 530, 12), ("d", 2000, 13)], "cell string, at long, mark long")
    out = {r["id"]: r["mark"] for r in joins.nearest(left, right, ["cell"], "us", "at", 40, "mark").collect()}
    assert out == {1: 10, 2: 12}


def test_blocks_and_ladder(spark):
    rows = [("c", i, t, s) for i, (t, s) in enumerate([("EIS", 0.0), ("EIS", 0.0), ("CYC", -300.0), ("PAU", 0.0), ("EIS", 0.0), ("CYC", -200.0), ("EIS", 0.0)], 1)]
    found = ladder.blocks(spark.createDataFrame(rows, "cell string, proc long, target string, step double"), ["cell"], "proc", "target", "step")
    out = ladder.block_soc(found, ["cell"], 1000.0, 100.0).orderBy("block").collect()
    assert [(r["first_proc"], r["last_proc"], r["pauses_before"], r["soc"]) for r in out] == [(1, 2, 0, 100.0), (5, 5, 1, 70.0), (7, 7, 1, 50.0)]


def test_bracketed_is_clamped(spark):
    points = spark.createDataFrame([("c", 0), ("c", 15), ("c", 20), ("c", 99), ("d", 1)], "cell string, at long")
    knots = spark.createDataFrame([("c", 10, 1.0), ("c", 20, 3.0)], "cell string, at long, v double")
    assert {(r["cell"], r["at"]): r["v"] for r in joins.bracketed(points, knots, ["cell"], "at", "v").collect()} == {("c", 0): 1.0, ("c", 15): 2.0, ("c", 20): 3.0, ("c", 99): 3.0, ("d", 1): None}


def test_file_names_and_recordings(spark, tmp_path):
    name = "proj=cell1=2026-01-02_030405=CYC_BM3_91.5SOH=EIS0007=eq=filesize-123=unfinished.parquet"
    rows = spark.createDataFrame([(1.0, "PAU**"), (2.0, "CHA")], "Strom double, Zustand string")
    rows.coalesce(1).write.parquet(str(tmp_path / "raw"))
    part = next((tmp_path / "raw").glob("*.parquet"))
    (tmp_path / "in").mkdir()
    part.rename(tmp_path / "in" / name)
    out = files.recordings(spark, str(tmp_path / "in")).collect()
    assert {r["State"] for r in out} == {"PAU", "CHA"} and {r["Voltage"] for r in out} == {None}
    r = out[0]
    assert (r["project"], r["specimen"], r["programme"], r["bytes"], r["finished"], r["eis"], r["bm"], r["soh"]) == ("proj", "cell1", "CYC_BM3_91.5SOH", 123, False, "EIS0007", 3, 91.5)
    assert r["started"] == datetime.datetime(2026, 1, 2, 3, 4, 5)


def test_missing_rows_and_cells(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (None, "y")], "k long, v string")
    assert [r["v"] for r in files.missing(a, b, ["k", "v"]).collect()] == ["z"]
    files.write_by_cell(a.withColumnRenamed("k", "cell"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_impedance_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text("ActFreq,Zreal1,Zimg1,Betrag\nHz,Ohm,Ohm,Ohm\n0,0,0,0\n10,1,-0.1,1\n100,0.9,0.1,0.9\n")
    assert files.impedance_csv(spark, str(tmp_path / "e.csv")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    start = datetime.datetime(2026, 1, 1)
    rows = [(start + datetime.timedelta(hours=5 * i), f"k{i % 3}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in" / "events.parquet"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "events.parquet"))
    out = incremental.drained(incremental.daily(stream, "ts", "kind", "value"), str(tmp_path / "out"))
    batch = df.groupBy(F.window("ts", "1 day"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("day"), "kind", "n", "total")
    got, want = (sorted(map(tuple, x.collect())) for x in (out, batch))
    assert got and set(got) <= set(want) and len(want) - len(got) <= 3  # the last day is still open


def test_appending_equals_rebuilding(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1), ("a", 4.0, 1)], "cell string, ah double, n long")
    total = lambda df: df.groupBy("cell").agg(F.sum("ah").alias("ah"), F.sum("n").alias("n"))
    parts = incremental.appended(total(rows.where("ah < 2")), total(rows.where("ah >= 2")), "cell", "ah", "n")
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, total(rows).collect()))


@pytest.mark.parametrize("steps,want", [(4, [None, 1.0, 1.0, 3.0, 3.0]), (1, [None, 1.0, None, 3.0, None])])
def test_look_back(spark, steps, want):
    df = spark.createDataFrame([("c", 1, 1.0, "CYC"), ("c", 2, 2.0, "PAU"), ("c", 3, 3.0, "CYC"), ("c", 4, 4.0, "PAU"), ("c", 6, 6.0, "CYC")], "cell string, proc long, v double, t string")
    out = joins.look_back(df, ["cell"], "proc", "v", "t <> 'PAU'", steps).orderBy("proc")
    assert [r["prev_v"] for r in out.collect()] == want


def test_all_curves_are_whole(spark, tmp_path):
    from voltaspan.plans.catalog import CATALOG

    rows = [(i, [float(i + k) for k in range(11)] if i % 7 else None) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = sorted(map(tuple, CATALOG["O10_all_curves"].run(spark, str(tmp_path)).collect()))
    assert out == [(i, k, x) for i, v in rows if v for k, x in enumerate(v)]


def test_streamed_days_are_whole(spark, tmp_path):
    """Open days, rows far later than those of an earlier batch, and a table of many part files."""
    start = datetime.datetime(2026, 1, 1)
    for i in (9, 5, 7, 0, 2):
        part = spark.createDataFrame([(start + datetime.timedelta(hours=8 * i + k), f"k{k % 2}", float(i)) for k in range(8)], "ts timestamp, kind string, value double")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / "events.parquet"))
    stream = incremental.source(spark, str(tmp_path / "in"), "events.parquet", 1)
    out = incremental.drained(incremental.daily(stream, "ts", "kind", "value"), str(tmp_path / "out"))
    df = spark.read.parquet(str(tmp_path / "in" / "events.parquet"))
    batch = df.groupBy(F.date_trunc("day", "ts").alias("day"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect())) and out.agg(F.sum("n")).first()[0] == 40
