"""Raw recordings, builds, stores and labels on small written fixtures."""

import datetime as dt
import json
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from voltaspan.operators import build, clusters, models, raw, rules
from voltaspan.operators.joins import nearest
from voltaspan.plans.catalog import CATALOG
from voltaspan.plans.recordings import QUERIES


def test_prepared_recording(spark):
    at = dt.datetime(2024, 7, 1, 12)
    rows = [
        (at, 3.5, 1.0, 25.0, "CHA", None, None, 1.0), (at, 3.5, 1.0, 25.0, "PAU**", None, None, 1.0), (at, 3.6, 0.0, 25.0, "PAUO**", 3.7, None, 1.0),
        (at, 3.6, 0.0, 25.0, "PAU", 3.7, 50.0, None), (at, 3.6, 0.0, 25.0, "PAU", 3.7, 50.0, 2.0), (at, 3.6, 0.0, 25.0, "PAU", 4.5, None, 1.0), (None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "Zeit timestamp, Spannung double, Strom double, T1 double, State string, Floater_1_Voltage double, EIS_freq double, AhAkku double")
    out = raw.prepared(df, 4.2, zone="Europe/Berlin", placeholders=["target"])
    assert [r["State"] for r in out.collect()] == ["CHA", "PAU", "FLOATER", "EIS", "FLOATER", None]  # 4.5 V of the floater is over 1.05 x 4.2
    first = out.collect()[0]
    assert first["Power"] == 3.5 and first["target"] is None and out.schema["Voltage"].dataType.simpleString() == "float"
    assert first["Time_UTC"] == dt.datetime(2024, 7, 1, 10)
    assert raw.prepared(df.drop("Strom").limit(0), 4.2).count() == 0
    with pytest.raises(ValueError, match="Strom"):
        rules.required(df.drop("Strom"), ["Strom", "Zeit"])


def test_listing_names_and_keys(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    for name in ("cellA/x=1=2=P.parquet", "cellA/y=1=2=P=unfinished.parquet", "GOLD/z.parquet"):
        spark.range(3).coalesce(1).write.parquet(f"{folder}/{name}")
    found = build.listed(spark, folder, "part-*")
    assert found.count() == 2 and "GOLD" not in {r["path"].split("/")[-3] for r in found.collect()}
    assert build.key_path("cell", "a.parquet", root="/data/", tag="v1") == "/data/v1/cell/a.parquet"
    assert build.key_path("cell", None, "a.parquet") == "cell/a.parquet"
    spark.createDataFrame([(1, 2.0)], "id int, cap double").coalesce(1).write.option("header", "true").csv(f"{folder}/csv")
    assert build.named_csv(spark, f"{folder}/csv").columns == ["id", "cap", "Name"]


def recordings(spark, weeks):
    rows = [(c, w, w * 10**9 + k * 10**7, 1000 * w + k, float((k % 5) - 2)) for c in (1, 2) for w in weeks for k in range(20)]
    return spark.createDataFrame(rows, "cell long, file long, us long, seq long, i double")


def test_extension_equals_a_full_build(spark):
    args = ("cell", "file", "us", "seq", "i", 3.0)
    whole = build.built(recordings(spark, range(6)), *args)
    both, late = build.extended(build.built(recordings(spark, range(4)), *args), recordings(spark, (4, 5)), *args)
    assert late.count() == 0
    as_rows = lambda d: sorted((r["cell"], r["us"], round(r["ah"], 9)) for r in d.collect())
    assert as_rows(both) == as_rows(whole)
    _, late = build.extended(build.built(recordings(spark, (3,)), *args), recordings(spark, (1,)), *args)
    assert late.count() == 40
    view = build.provisional(build.built(recordings(spark, range(4)), *args), recordings(spark, (4, 5)), *args)
    assert {r["cell"]: round(r["ah"], 9) for r in view.collect()} == {r["cell"]: round(r["ah"], 9) for r in build.totals(whole, "cell", "us").select("cell", F.col("_ah").alias("ah")).collect()}


def test_manifests(spark):
    files = spark.createDataFrame([("a", "x=1=2=P1=3"), ("a", "x=1=2=P2"), ("b", "y=1"), ("b", "z=1=2=P9=unfinished")], "cell string, name string")
    assert [r["name"] for r in build.pending(files, files.limit(0)).orderBy("name").collect()] == ["x=1=2=P1=3", "x=1=2=P2", "y=1"]
    assert {r["cell"]: r["procedures"] for r in build.procedures_of(files).collect()} == {"a": ["P1", "P2"], "b": ["P9"]}


def test_documents(spark):
    new = spark.createDataFrame([("c", "pulse", 1.0), ("c", "pulse", float("nan"))], "cell string, block string, r double")
    old = spark.createDataFrame([("c", "pulse", 9.0), ("c", "eis", 2.0)], "cell string, block string, r double")
    (row,) = build.documents(build.merged_blocks(new, old, ["cell", "block"]), "cell", "block").collect()
    found = json.loads(row["document"])
    assert found["eis"] == [{"r": 2.0}] and sorted(map(len, found["pulse"])) == [0, 1]
    text = spark.createDataFrame([('say {"a": "}{", "b": {"c": 1}} and {x}',), ("none",), ("{open",), (None,)], "t string")
    assert [r[0] for r in text.select(build.first_object(F.col("t"))).collect()] == ['{"a": "}{", "b": {"c": 1}}', None, None, None]


def test_labels(spark):
    rows = spark.createDataFrame(
        [("full_discharge_x", 0.95, -1.0, 0.5), ("full_charge_x", 0.95, 1.0, 0.05), ("mixed_c20", 0.5, -1.0, 2.4), (" Big Pulse", None, None, None), ("rest", 0.9, 0.0, 0.0), ("full_x", None, 1.0, 1.0)],
        "label string, spanned double, i double, rate double",
    )
    out = rows.select(rules.canonical_label(F.col("label"), F.col("spanned"), F.col("i"), F.col("rate"), 0.5, 0.05).alias("x"), rules.tagged_label(F.col("label"), F.col("rate"), 0.5, 0.05).alias("y")).collect()
    assert [r["x"] for r in out] == ["cap", "qocv", "partial_dch_2c", "pulse", "rest", "full_x"]
    assert [r["y"] for r in out] == ["CAP*", "QOCV*", "mixed_c20", "PUL*", "rest", "full_x"]
    names = spark.createDataFrame([(["RPT", "jri_Aging_80DOD_50SOC_25grad_1C"],), (["x_y_z_2C_25_mean50dod80", "a_Cyc_b_2C_25_mean50dod80"],), ([],)], "p array<string>")
    got = names.select(*[c.alias(f"a{k}") for k, c in rules.aging_conditions(F.col("p")).items()], *[c.alias(f"b{k}") for k, c in rules.cycling_conditions(F.col("p")).items()]).collect()
    assert [got[0][c] for c in ("aDOD", "aSOC", "aTemperature", "aC_Rate")] == [80, 50, 25, "1C"] and got[0]["bDOD"] is None
    assert [got[1][c] for c in ("bDOD", "bSOC", "bTemperature", "bC_Rate")] == [80, 50, 25, "2C"] and got[2]["aDOD"] is None


def test_means_on_a_limit_do_not_hang_on_files(spark):
    """The mean of each cell is 6, the limit; its sum in doubles lies on one side of it row by row, on the other by halves."""
    values = {1: [6.28, 8.9, 8.06, 0.76], 2: [0.97, 2.15, 4.49, 16.39], 3: [None] * 4}
    rows = [(7 * c - 3 + k, dt.datetime(2024, 1, 2, k), c, "click", v, None) for c, of in values.items() for k, v in enumerate(of)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    labels = []
    for cuts in ([F.lit(True)], [F.hour("ts") < 2, F.hour("ts") >= 2]):
        folder = tempfile.mkdtemp(prefix="spark-")
        for cut in cuts:
            events.where(cut).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
        labels.append({r["cell"]: r["llm"] for r in QUERIES["P20_tagged_labels"].run(spark, folder).collect()})
    con = duckdb.connect(config={"threads": 1})
    con.register("rows", events.orderBy("event_id").toPandas())
    con.execute("CREATE TABLE events AS SELECT * FROM rows ORDER BY event_id")
    want = {cell: llm for cell, _, llm, _ in con.execute(QUERIES["P20_tagged_labels"].sql).fetchall()}
    assert labels == [want, want] and want == {1: "full_charge_c20", 2: "QOCV*", 3: "full_charge_c20"}


def test_rules_on_means_do_not_hang_on_files(spark):
    """Means of 20, whose sums in doubles are 80 by halves; row by row those of the first week and of the second cell are not."""
    weeks = {(1, 1): [28.33, 22.46, 27.75, 1.46], (1, 8): [19.06, 22.51, 24.06, 14.37], (2, 1): [25.93, 28.53, 18.75, 6.79]}
    rows = [(1000 * c + 10 * day + k + 1, dt.datetime(2024, 1, day + k // 3 * 2, 10 * k % 24), c, "signup" if c == 2 and k == 1 else "purchase", v, None) for (c, day), of in weeks.items() for k, v in enumerate(of)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    con = duckdb.connect(config={"threads": 1})
    con.register("rows", events.toPandas())
    con.execute("CREATE TABLE events AS SELECT * FROM rows ORDER BY event_id")
    folder = tempfile.mkdtemp(prefix="spark-")
    for half in (F.col("event_id") % 10 < 3, F.col("event_id") % 10 >= 3):
        events.where(half).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    for name, column, want in (("M2_capacity_rule", "cap", [0, 1, 1]), ("M4_demoted_labels", "target", ["-1", "-1", "CAP"])):
        found = CATALOG[name].run(spark, folder).orderBy("cell", "week").collect()
        assert [r[column] for r in found] == want
        assert sorted(map(tuple, found)) == sorted(con.execute(CATALOG[name].sql).fetchall())


def test_filtered_labels(spark):
    rows = spark.createDataFrame(
        [(1, 0, 1, "CHA", 1.0, 25.0, 0.5, "-1"), (1, 0, 2, "CHA", 0.1, 25.0, -0.5, "CAP*"), (1, 0, 3, "CHA", 0.2, 25.0, -0.5, "CAP*"), (1, 0, 9, "CHA", 0.2, 40.0, -0.5, "CAP*"), (1, 0, 20, "CHA", 0.2, -25.0, -0.5, "CAP*"), (1, 0, 21, "CHA", 0.2, 25.0, -0.6, "PUL*")],
        "cell long, bm long, proc long, state string, end_voltage double, temperature double, current_mean double, target string",
    )
    out = {r["proc"]: r["target"] for r in clusters.filtered(rows).collect()}
    assert out == {1: "-1", 2: "CAP*", 3: "-1", 9: "-1", 20: "CAP*", 21: "PUL*"}


def test_forest_and_clusters(spark):
    rows = spark.createDataFrame([(c, k, float(k % 2) + 0.01 * c, float(c), "A" if k % 2 else "B") for c in range(6) for k in range(20)] + [(9, 1, None, 1.0, "A")], "cell long, k long, x double, y double, target string")
    out = models.held_out(rows, ["x", "y"], "target", "cell", trees=5, folds=3, depth=3).collect()
    assert len(out) == 121 and all(r["predicted"] == (r["target"] if r["x"] is not None else "-1") for r in out)
    folder = tempfile.mkdtemp(prefix="spark-")
    models.stored(models.forest(rows, ["x", "y"], "target", trees=3, depth=2), folder, {"features": ["x", "y"]})
    model, facts = models.loaded(spark, folder)
    assert facts == {"features": ["x", "y"]} and models.predicted(rows, model, ["x", "y"]).where("predicted = target").count() == 120
    found = models.centred(rows, ["x"], 2).collect()
    assert len(found) == 120 and len({(r["cluster"], r["target"]) for r in found}) == 2 and not any(r["outlier"] for r in found)


def test_nearest_keeps_repeated_rows(spark):
    left = spark.createDataFrame([(1, 10), (1, 10), (1, 90)], "cell long, us long")
    right = spark.createDataFrame([(1, 12, 7)], "cell long, at long, id long")
    assert nearest(left, right, ["cell"], "us", "at", 5, "id").count() == 2
