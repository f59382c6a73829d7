"""Queries of fits, clusters, models and streams."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from voltaspan.operators import density, features, fits, fractional, isolation, sweeps
from voltaspan.operators import pulses as pulse
from voltaspan.operators import spectra as impedance_fits
from voltaspan.plans.base import SAMPLES, Query, rounded, sampled, samples, shared_folder, table
from voltaspan.plans.reports import spectra
from voltaspan.sources.shared import kept
from voltaspan.streaming import incremental, integral


def drt(spark, sf_dir):
    return fits.drt(spectra(spark, sf_dir), "eis", "f", "re", "im")


def kk(spark, sf_dir):
    return fits.kk_screen(spectra(spark, sf_dir), "eis", "f", "re", "im")


def relaxations(spark, sf_dir):
    return fits.relaxations(samples(spark, sf_dir), ["cell", "week"], "us", "value")


def differential(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("q", F.col("us") / 3.6e9)
    return fits.differential(rows, ["cell", "week"], "us", "value", "q", 11)


def _segments(spark, sf_dir):
    found = features.segment_features(samples(spark, sf_dir), ["cell", "week"], ["us", "seq"], "current", "value", 100.0, 0.0, 500.0)
    return found.where("current_std is not null")


def clusters(spark, sf_dir):
    found = density.density_clusters(_segments(spark, sf_dir), ["cell"], "week", ["duration_log", "abs_current_mean"], 3, epsilon=0.1)
    return found.withColumnsRenamed({"cell": "key", "week": "item"})


def kmeans(spark, sf_dir):
    data = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=8, seed=1, maxIter=5).fit(data).transform(data).select("vec_id", F.col("prediction").alias("cluster"))


def isolated(spark, sf_dir):
    """Parts set apart by size, price and weight of their name; those of the first brands are normal."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("price"), F.length("p_name").cast("double").alias("name"))
    found = isolation.outliers(parts, parts.where("p_brand < 'Brand#3'"), "p_partkey", ["size", "price", "name"], 0.02)
    return found.select("p_partkey", "score", "outlier")


def forest(spark, sf_dir):
    names = ["voltage_mean", "voltage_std", "current_mean", "current_std", "duration_log", "norm_duration"]
    data = _segments(spark, sf_dir).withColumn("target", F.when(F.col("current_mean") > 0, "CHA").otherwise("DCH")).na.drop(subset=names)
    stages = [StringIndexer(inputCol="target", outputCol="label"), VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features"), RandomForestClassifier(numTrees=20, maxDepth=5, seed=1)]
    model = Pipeline(stages=stages).fit(data.where("cell % 4 <> 0"))
    return model.transform(data.where("cell % 4 = 0")).select("cell", "week", "target", F.col("prediction").cast("int").alias("predicted"), F.array_max(vector_to_array("probability")).alias("confidence"))


def as_pulses(rows, keys):
    """The samples of each key as a pulse and the rest after it (hours as seconds), and the table of
    these: half of the time is the pulse."""
    ends = rows.groupBy(*keys).agg(
        F.min("us").alias("us0"), F.max("us").alias("us1"), F.count("*").alias("n"), F.min_by("value", F.struct("us", "seq")).alias("v_pre"), F.max(F.when(F.col("current") != 0, F.abs("current"))).alias("i_p")
    )
    pulses = ends.where("n >= 8 and i_p > 0 and us1 > us0").select(*keys, "us0", ((F.col("us1") - F.col("us0")) / 7.2e9).alias("t_p"), "i_p", "v_pre", F.lit(0.01).alias("r0"))
    of = rows.join(pulses, keys).select(*keys, ((F.col("us") - F.col("us0")) / 3.6e9).alias("t"), F.col("value").alias("v"), F.col("current").alias("i"), "seq")
    return of, pulses.drop("us0")


def weekly(spark, sf_dir):
    """Pulses by cell and week."""
    return as_pulses(samples(spark, sf_dir), ["cell", "week"])


def _by_cell(spark, sf_dir):
    """One pulse of each cell; cells of one number modulo 10 are a check-up."""
    return as_pulses(samples(spark, sf_dir).withColumn("checkup", F.col("cell") % 10), ["checkup", "cell"])


def good_pulses(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("target", F.when((F.col("seq") % 4 == 0) & (F.col("week") % 2 == 0), "PUL"))
    return pulse.selected(rows, ["cell", "week"], ["us", "seq"], "current", "state", "target", amplitudes=[20, 50, 80], tolerance=0.4)


def resistances(spark, sf_dir):
    rows, pulses = weekly(spark, sf_dir)
    first = rows.groupBy("cell", "week", "t").agg(F.max_by(F.struct("v", "i"), "seq").alias("x")).select("cell", "week", "t", "x.v", "x.i")
    found = pulse.model_free(first, pulses, ["cell", "week"], 5.0, 1.0)
    return found.select("cell", "week", *[rounded(c, 5).alias(c) for c in ("r_dc_onset", "r_onset", "r_termination", "r_dc_termination")])


def joint(spark, sf_dir):
    return pulse.joint(*weekly(spark, sf_dir), ["cell", "week"])


def with_diffusion(spark, sf_dir):
    rows, pulses = weekly(spark, sf_dir)
    return pulse.joint(rows, pulses, ["cell", "week"], diffusion=True)


def extrapolated(spark, sf_dir):
    rows, pulses = weekly(spark, sf_dir)
    return pulse.extrapolated(rows, pulses.withColumn("cap", F.lit(0.1)), ["cell", "week"])


def staged(spark, sf_dir):
    return pulse.staged(*weekly(spark, sf_dir), ["cell", "week"])


def fractional_chain(spark, sf_dir):
    return fractional.chain(*_by_cell(spark, sf_dir), ["checkup", "cell"], ["checkup"])


def shared_resistance(spark, sf_dir):
    found = kept(fractional.prepared(*_by_cell(spark, sf_dir), ["checkup", "cell"]), "prepared")
    return fractional.series_resistance(found, ["checkup"])[0].select("checkup", F.col("value").alias("r_s"))


def rested(spark, sf_dir):
    """Rests of two samples or more that follow a step: where they begin and what was before."""
    found = pulse.rests(samples(spark, sf_dir), ["cell"], ["us", "seq"], "state", "us", "current", "value", 2)
    return found.groupBy("cell", "segment").agg(F.count("*").alias("n"), F.max("v_last").alias("v_last"), F.max("i_p").alias("i_p"), rounded(F.max("t"), 3).alias("seconds"))


def by_health(spark, sf_dir):
    rows = good_pulses(spark, sf_dir)
    health = rows.select("cell", "week").distinct().withColumn("soh", F.col("cell") % 30 + 70)
    return pulse.by_health(rows, health, ["cell", "week"], ["amplitude"], pulse.kind_of(F.lit(1.0), F.col("amplitude"), 50.0))


def ramp(spark, sf_dir):
    rows = samples(spark, sf_dir).groupBy("cell", "week", "us").agg(F.max_by("current", "seq").alias("current")).withColumns({"start": F.lit(0.0), "end": F.lit(1.0)})
    return pulse.charge_ramp(rows, ["cell", "week"], "us", "current", "start", "end").select("cell", "week", "us", rounded("ocv", 6).alias("ocv"))


def series_resistance(spark, sf_dir):
    return impedance_fits.series_resistance(spectra(spark, sf_dir), "eis", f_min=10.0)


def arcs(spark, sf_dir):
    return impedance_fits.arcs(spectra(spark, sf_dir), "eis")


def plain_arcs(spark, sf_dir):
    return impedance_fits.arcs(spectra(spark, sf_dir), "eis", n=2, diffusion=False, depressed=False)


def spectrum_table(spark, sf_dir):
    return impedance_fits.spectrum_table(spectra(spark, sf_dir), "eis", f_min=10.0)


def peaks(spark, sf_dir):
    return impedance_fits.relaxation_peaks(spectra(spark, sf_dir), "eis")


def labelled_peaks(spark, sf_dir):
    states = spectra(spark, sf_dir).select("eis").distinct().withColumn("soc", F.col("eis") % 10 * 10)
    return impedance_fits.labelled_peaks(peaks(spark, sf_dir), states, "eis", [0.01, 0.1], ["contact", "transfer", "diffusion"])


def vote(spark, sf_dir):
    """Line items as peaks: the ship mode's time, the price's height."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("bundle"), F.col("l_orderkey").alias("eis"), F.col("l_quantity").cast("double").alias("tau"), F.col("l_extendedprice").alias("height"))
    return impedance_fits.branch_vote(l, ["bundle"], "eis", 10, 40, 0.5)


def decades(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    found = impedance_fits.decade_table(l.select(F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("tau"), F.col("l_quantity").cast("double").alias("r")), ["s"], F.col("tau"), "r", [3, 30, 300, 3000, 30000, 300000])
    return found.select("s", "decade", "r", "largest", "r_pulse", "r_fast", "r_slow")


def soc_by_voltage(spark, sf_dir):
    """Sweeps from samples, one per cell and direction; states of charge of the pauses' voltages."""
    rows = samples(spark, sf_dir)
    branch = lambda kind: sweeps.soc_axis(rows.where(F.col("kind") == kind).groupBy("cell", "us").agg(F.max("value").alias("v")).withColumn("q", F.col("us").cast("double")), ["cell"], "q").select("cell", "soc", "v")
    eta = sweeps.polarisation(branch("click"), branch("purchase"), ["cell"], 21)
    knots = sweeps.lookup(branch("purchase"), eta, ["cell"], "discharge")
    points = rows.where("kind = 'error'").select("cell", "seq", F.col("value").alias("v"))
    return sweeps.mapped(points, knots, ["cell"]).select("cell", "seq", rounded("soc", 4).alias("soc"), "clipped")


def differential_capacity(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("q", F.col("us") / 3.6e9)
    return sweeps.differential_capacity(rows, ["cell", "week"], "value", "q", 4.0, 1.0, 11)


def overlaid(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("q", F.col("us") / 3.6e9)
    curves = sweeps.differential_voltage(rows, ["cell", "week"], "value", "q", 25, window=11)
    health = rows.select("cell", "week").distinct().withColumn("soh", F.col("cell") % 30 + 70)
    return sweeps.overlaid(curves, health, ["cell", "week"], "soc")


def streamed_days(spark, sf_dir):
    events = incremental.source(spark, sf_dir, "events.parquet")
    found = incremental.drained(incremental.daily(events, "ts", "event_type", "value"), shared_folder(spark))
    return found.select(F.unix_micros("day").alias("day_us"), "event_type", "n", F.round("total", 3).alias("total"))


def running_integral(spark, sf_dir):
    """Each kind of a cell is a recording; gaps over two days carry no charge."""
    stream = sampled(incremental.source(spark, sf_dir, "events.parquet"))
    found = integral.drained(integral.integrated(stream, "cell", "kind", "us", "seq", "current", 2 * 86_400_000_000), shared_folder(spark))
    return found.select(F.col("cell").cast("long").alias("cell"), F.col("file").alias("kind"), F.round("ah", 3).alias("ah"), "n", "last_us")


def appended_totals(spark, sf_dir):
    rows = samples(spark, sf_dir).groupBy("cell", (F.col("seq") % 2).alias("half")).agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    found = incremental.appended(rows.where("half = 0"), rows.where("half = 1"), "cell", "total", "n")
    return found.select("cell", F.round("total", 3).alias("total"), "n")


QUERIES = {
    "FIT17_relaxation_times": Query(drt),
    "FIT19_linear_kk": Query(kk),
    "FIT7_relaxations": Query(relaxations),
    "F6_differential": Query(differential),
    "M1_density_clusters": Query(clusters),
    "M7_kmeans": Query(kmeans),
    "M7_isolation_forest": Query(isolated),
    "M6_random_forest": Query(forest),
    "FIT1_good_pulses": Query(
        good_pulses,
        f"""WITH {SAMPLES}, a AS (SELECT *, sum(CASE WHEN state IS DISTINCT FROM lag_state THEN 1 ELSE 0 END) OVER (PARTITION BY cell, week ORDER BY us, seq) AS segment FROM (SELECT *, lag(state) OVER (PARTITION BY cell, week ORDER BY us, seq) AS lag_state FROM s)),
b AS (SELECT *, row_number() OVER (PARTITION BY cell, week, segment ORDER BY us, seq) AS k, count(*) OVER (PARTITION BY cell, week, segment) AS n FROM a WHERE state IN ('CHA', 'DCH')),
g AS (SELECT cell, week, segment, count(*) AS n, median(CASE WHEN k = 1 AND current = 0 AND n > 1 THEN NULL ELSE abs(current) END) AS mid, stddev_samp(CASE WHEN k = 1 AND current = 0 AND n > 1 THEN NULL ELSE current END) AS sd, median(abs(current)) FILTER (abs(current) > 0.05) AS amplitude, bool_or(seq % 4 = 0 AND week % 2 = 0) AS pul FROM b GROUP BY ALL),
h AS (SELECT *, bool_or(pul) OVER (PARTITION BY cell, week) AS labelled FROM g)
SELECT cell, week, CAST(segment AS BIGINT) AS segment, amplitude, n FROM h WHERE mid >= 0.05 AND NOT coalesce(sd > 0.05 * mid, false) AND (abs(amplitude - 20) <= 8 OR abs(amplitude - 50) <= 20 OR abs(amplitude - 80) <= 32) AND (NOT labelled OR pul)""",
    ),
    "FIT2_model_free": Query(
        resistances,
        f"""WITH {SAMPLES}, e AS (SELECT cell, week, min(us) AS us0, max(us) AS us1, count(*) AS n, arg_min(value, (us, seq)) AS v_pre, max(abs(current)) FILTER (current <> 0) AS i_p FROM s GROUP BY cell, week),
p AS (SELECT cell, week, us0, (us1 - us0) / 7200000000.0 AS t_p, i_p, v_pre FROM e WHERE n >= 8 AND i_p > 0 AND us1 > us0),
x AS (SELECT cell, week, us, arg_max(value, seq) AS v, arg_max(current, seq) AS i FROM s GROUP BY cell, week, us),
d AS (SELECT x.cell, x.week, (us - us0) / 3600000000.0 AS t, v, i, t_p, i_p, v_pre FROM x JOIN p ON x.cell = p.cell AND x.week = p.week),
f AS (SELECT *, abs((v - lag(v) OVER w) / (t - lag(t) OVER w)) AS slope FROM d WINDOW w AS (PARTITION BY cell, week ORDER BY t)),
g AS (SELECT cell, week, any_value(i_p) AS i_p, any_value(v_pre) AS v_pre, arg_min(v, t) FILTER (t >= 5) AS v5, arg_min(i, t) FILTER (t >= 5) AS i5,
 arg_min(v, t) FILTER (t > 0 AND t <= least(2.0, t_p) AND slope < abs(i_p)) AS knee, arg_max(v, t) FILTER (t > 0 AND t <= least(2.0, t_p)) AS early, arg_min(v, t) AS v0,
 arg_max(v, t) FILTER (t <= t_p) AS ve, arg_max(i, t) FILTER (t <= t_p) AS ie, arg_min(v, t) FILTER (t > t_p) AS vr, arg_min(v, t) FILTER (t >= t_p + 5) AS va, arg_min(i, t) FILTER (t >= t_p + 5) AS ia FROM f GROUP BY cell, week)
SELECT cell, week, round(CASE WHEN abs(i5) >= 1e-6 THEN abs((v_pre - v5) / (0 - i5)) END, 5) AS r_dc_onset, round(abs((coalesce(knee, early, v0) - v_pre) / i_p), 5) AS r_onset, round(abs((vr - ve) / i_p), 5) AS r_termination, round(CASE WHEN abs(ie - ia) >= 1e-6 THEN abs((ve - va) / (ie - ia)) END, 5) AS r_dc_termination FROM g""",
    ),
    "FIT3_joint_fit": Query(joint),
    "FIT4_extrapolated": Query(extrapolated),
    "FIT5_staged": Query(staged),
    "FIT6_with_diffusion": Query(with_diffusion),
    "FIT7_rests_after_steps": Query(
        rested,
        f"""WITH {SAMPLES}, a AS (SELECT *, sum(CASE WHEN state IS DISTINCT FROM lag_state THEN 1 ELSE 0 END) OVER (PARTITION BY cell ORDER BY us, seq) AS segment FROM (SELECT *, lag(state) OVER (PARTITION BY cell ORDER BY us, seq) AS lag_state FROM s)),
g AS (SELECT cell, segment, any_value(state) AS st, count(*) AS n, min(us) AS t0, max(us) AS t1, arg_max(value, (us, seq)) AS v, arg_max(current, (us, seq)) AS i FROM a GROUP BY cell, segment),
h AS (SELECT *, lag(st) OVER w AS was, lag(v) OVER w AS v_last, lag(i) OVER w AS i_p FROM g WINDOW w AS (PARTITION BY cell ORDER BY segment))
SELECT cell, CAST(segment AS BIGINT) AS segment, n, v_last, i_p, round((t1 - t0) / 1e6, 3) AS seconds FROM h WHERE st IN ('PAU', 'PAUO') AND was IN ('CHA', 'DCH') AND n >= 2""",
    ),
    "FIT8_by_health": Query(by_health),
    "FIT10_fractional_chain": Query(fractional_chain),
    "FIT23_shared_resistance": Query(shared_resistance),
    "FIT11_decade_table": Query(
        decades,
        "WITH d AS (SELECT l_suppkey AS s, l_extendedprice AS tau, CAST(l_quantity AS DOUBLE) AS r, CASE WHEN l_extendedprice < 30 THEN 1 WHEN l_extendedprice < 300 THEN 2 WHEN l_extendedprice < 3000 THEN 3 WHEN l_extendedprice < 30000 THEN 4 ELSE 5 END AS decade FROM lineitem), w AS (SELECT s, sum(r) AS r_pulse, coalesce(sum(r) FILTER (tau <= 1), 0) AS r_fast, coalesce(sum(r) FILTER (tau > 1), 0) AS r_slow FROM d GROUP BY s) SELECT s, decade, sum(r) AS r, max(r) AS largest, any_value(r_pulse) AS r_pulse, any_value(r_fast) AS r_fast, any_value(r_slow) AS r_slow FROM d JOIN w USING (s) GROUP BY s, decade",
    ),
    "FIT13_series_resistance": Query(series_resistance),
    "FIT14_arcs": Query(arcs),
    "FIT15_plain_arcs": Query(plain_arcs),
    "FIT16_spectrum_table": Query(spectrum_table),
    "FIT17_peaks": Query(peaks),
    "FIT18_labelled_peaks": Query(labelled_peaks),
    "FIT22_charge_ramp": Query(
        ramp,
        f"WITH {SAMPLES}, x AS (SELECT cell, week, us, arg_max(current, seq) AS i FROM s GROUP BY cell, week, us), d AS (SELECT *, coalesce((abs(i) + abs(lag(i) OVER w)) / 2 * (us - lag(us) OVER w), 0) AS dq FROM x WINDOW w AS (PARTITION BY cell, week ORDER BY us)) SELECT cell, week, us, round(coalesce(sum(dq) OVER (PARTITION BY cell, week ORDER BY us) / nullif(sum(dq) OVER (PARTITION BY cell, week), 0), 0), 6) AS ocv FROM d",
    ),
    "A32_votes": Query(
        vote,
        "WITH b AS (SELECT l_suppkey AS bundle, l_orderkey AS eis, l_extendedprice AS h, max(l_extendedprice) OVER (PARTITION BY l_suppkey, l_orderkey) AS top FROM lineitem WHERE l_quantity BETWEEN 10 AND 40), n AS (SELECT bundle, eis, count(*) AS n FROM b WHERE h >= 0.5 * top GROUP BY ALL) SELECT bundle, CAST(least(greatest(round_even(avg(n), 0), 1), 2) AS INT) AS branches FROM n GROUP BY bundle",
    ),
    "O_SOC2_by_voltage": Query(soc_by_voltage),
    "F6_differential_capacity": Query(differential_capacity),
    "F7_overlaid_curves": Query(overlaid),
    "T2_streamed_days": Query(streamed_days, "SELECT epoch_us(date_trunc('day', ts)) AS day_us, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL"),
    "T5_running_integral": Query(
        running_integral,
        f"WITH {SAMPLES}, x AS (SELECT cell, kind, us, arg_max(current, seq) AS i FROM s WHERE us IS NOT NULL GROUP BY cell, kind, us), d AS (SELECT *, us - lag(us) OVER w AS dt, lag(i) OVER w AS p FROM x WINDOW w AS (PARTITION BY cell, kind ORDER BY us)) SELECT cell, kind, round(sum(CASE WHEN dt > 172800000000 THEN 0.0 ELSE coalesce((abs(i) + abs(p)) / 2 * dt / 3600000000.0, 0.0) END), 3) AS ah, count(*) AS n, max(us) AS last_us FROM d GROUP BY cell, kind",
    ),
    "T1_appended_totals": Query(appended_totals, "SELECT user_id AS cell, round(sum(value), 3) AS total, count(*) AS n FROM events GROUP BY user_id"),
}
