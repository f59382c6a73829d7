"""Queries on single series: charge, runs, procedures, cycles, rolling windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltaspan.operators import charge, segment
from voltaspan.plans.base import CUT, SAMPLES, Query, contributed, samples

KEYS = ["cell"]
LIMITS = segment.Limits(pause_minutes=600, min_rows=4, qocv=("P3",))


def _contributions(spark, sf_dir):
    return charge.contributions(samples(spark, sf_dir), KEYS, "us", "seq", "current", CUT)


def gap_masked(spark, sf_dir):
    return charge.totals(_contributions(spark, sf_dir), KEYS).select("cell", "n", "cut_us", F.round("ah", 4).alias("ah"))


def cumulative(spark, sf_dir):
    return charge.running(_contributions(spark, sf_dir), KEYS, "us", "seq").select("cell", "seq", F.round("ah", 4).alias("ah"))


def per_file(spark, sf_dir):
    merged = charge.merged_files(samples(spark, sf_dir), "cell", "kind", "us", "seq", "current", CUT)
    return merged.groupBy("cell").agg(F.count("*").alias("n"), F.round(F.sum("contrib"), 4).alias("ah"))


def concurrent(spark, sf_dir):
    found = charge.concurrent(samples(spark, sf_dir), "cell", "kind", "us", "current")
    return found.select("cell", "kind", "begin", "prev_finish")


def watermark(spark, sf_dir):
    rows = charge.running(_contributions(spark, sf_dir), KEYS, "us", "seq")
    return charge.watermark(rows, KEYS, "us", "seq", ["ah", "current"]).select("cell", F.round("ah", 4).alias("ah"), "current", "last_us")


def segment_capacity(spark, sf_dir):
    return charge.segment_capacity(samples(spark, sf_dir), ["cell", "week"], "us", "seq", "current").select("cell", "week", "n", F.round("capacity", 4).alias("capacity"), F.round("seconds", 3).alias("seconds"))


def state_runs(spark, sf_dir):
    found = segment.run_table(samples(spark, sf_dir), KEYS, ["us", "seq"], "state", "us")
    return found.select("cell", "run", "state", "n", "first_us", "last_us", F.round("minutes", 4).alias("minutes"))


def program_index(spark, sf_dir):
    return segment.programs(samples(spark, sf_dir), "cell", "week").groupBy("cell", "bm").agg(F.count("*").alias("n"), F.min("us").alias("first_us"))


def segmented(spark, sf_dir):
    """By cell and week throughout, so one exchange serves the windows and the index joined after them."""
    rows = samples(spark, sf_dir)
    return segment.procedures(rows, bm="week", limits=LIMITS).join(segment.program_index(rows, "cell", "week"), ["cell", "week"])


def procedures(spark, sf_dir):
    return segmented(spark, sf_dir).select("cell", "bm", "seq", "proc", "target", "relabelled")


def segments(spark, sf_dir):
    return segment.segment_table(segmented(spark, sf_dir)).select("cell", "bm", "proc", "n", "target", F.round("minutes", 4).alias("minutes"))


def cycle_split(spark, sf_dir):
    found = segment.cycles(samples(spark, sf_dir), KEYS, "us", "seq", 1440 * 60e6)
    return found.groupBy("cell", "cycle").agg(F.count("*").alias("n"), F.max("since").alias("length_us"))


def cycle_soc(spark, sf_dir):
    """State of charge by the order of cycles, 90, 50, 10, where a file has three; else 50."""
    found = segment.cycles(samples(spark, sf_dir), ["cell", "week"], "us", "seq", 2160 * 60e6)
    whole = Window.partitionBy("cell", "week")
    soc = F.when(F.max("cycle").over(whole) == 3, F.element_at(F.array(F.lit(90), F.lit(50), F.lit(10)), (F.pmod(F.col("cycle") - 1, F.lit(3)) + 1).cast("int"))).otherwise(50)
    return found.withColumn("soc", soc).groupBy("cell", "soc").agg(F.count("*").alias("n"))


def rolling_median(spark, sf_dir):
    w = Window.partitionBy("cell", "week").orderBy("us", "seq").rowsBetween(-2, 2)
    return samples(spark, sf_dir).select("cell", "seq", F.round(F.percentile("value", F.lit(0.5)).over(w), 6).alias("median"))


def drawdown(spark, sf_dir):
    order = Window.partitionBy("cell", "week").orderBy("us", "seq")
    peak = F.max("value").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = samples(spark, sf_dir).withColumn("drop", peak - F.col("value"))
    at = F.struct("us", "seq")
    return rows.groupBy("cell", "week").agg(F.min_by("value", at).alias("first"), F.max_by("value", at).alias("last"), F.round(F.max("value") - F.min("value"), 6).alias("span"), F.round(F.max("drop"), 6).alias("drawdown"))


def direction(spark, sf_dir):
    at = F.struct("us", "seq")
    ends = samples(spark, sf_dir).groupBy("cell", "week").agg((F.max_by("value", at) - F.min_by("value", at)).alias("d"), (F.max("value") - F.min("value")).alias("span"))
    least = F.greatest(F.lit(0.02), 0.05 * F.col("span"))
    return ends.select("cell", "week", F.when(F.abs("d") >= least, F.when(F.col("d") > 0, "charge").otherwise("discharge")).alias("direction"))


def every_nth(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("cell", "week").orderBy("us", "seq"))
    return samples(spark, sf_dir).withColumn("n", n).where("(n - 1) % 5 = 0").select("cell", "week", "seq")


def first_last_stub(spark, sf_dir):
    ends = samples(spark, sf_dir).groupBy("cell", "week").agg(F.min(F.struct("us", "seq", "value")).alias("a"), F.max(F.struct("us", "seq", "value")).alias("b"))
    rows = ends.select("cell", "week", F.explode(F.array_distinct(F.array("a", "b"))).alias("r"))
    return rows.select("cell", "week", "r.seq", "r.value", F.lit("AGING").alias("procedure"))


def keep_positions(spark, sf_dir):
    """Position in the group by program as text, then number; those on a list keep their label."""
    order = Window.partitionBy("cell", "kind").orderBy(F.col("week").cast("string"), "us", "seq")
    n = F.row_number().over(order)
    return samples(spark, sf_dir).where("kind = 'error'").select("cell", "seq", F.when(n.isin(1, 3, 5), "PUL").otherwise("PUL*RES").alias("target"))


def latest_five(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("cell").orderBy(F.col("us").desc(), F.col("seq").desc()))
    return samples(spark, sf_dir).withColumn("n", n).where("n <= 5").select("cell", "n", "seq")


def soc_axis(spark, sf_dir):
    """Throughput of a segment as 0 to 100; 0 where it has no span."""
    rows = segment.programs(samples(spark, sf_dir), "cell", "week")
    q = F.sum(F.abs("current")).over(Window.partitionBy("cell", "bm").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0))
    rows, whole = rows.withColumn("q", q), Window.partitionBy("cell", "bm")
    low, high = F.min("q").over(whole), F.max("q").over(whole)
    return rows.select("cell", "bm", "seq", F.round(F.when(high > low, 100 * (F.col("q") - low) / (high - low)).otherwise(0.0), 4).alias("soc"))


RUNS = "r AS (SELECT *, sum(new) OVER (PARTITION BY {k} ORDER BY us, seq) AS run FROM (SELECT *, CASE WHEN {c} = lag({c}) OVER (PARTITION BY {k} ORDER BY us, seq) THEN 0 ELSE 1 END AS new FROM {t}))"
BM = "b AS (SELECT *, dense_rank() OVER (PARTITION BY cell ORDER BY week) - 1 AS bm FROM s)"
_W = "PARTITION BY cell, bm"
_O = f"{_W} ORDER BY us, seq"
PROCEDURES = f"""{BM},
g AS (SELECT * FROM (SELECT *, count(*) OVER ({_W}) AS n_bm, bool_and(state IN ('PAU','PAUO','...')) OVER ({_W}) AS all_pause FROM b) WHERE n_bm <= 2 OR (n_bm >= 4 AND NOT all_pause)),
{RUNS.format(k="cell, bm", c="state", t="g")},
r2 AS (SELECT *, (max(us) OVER ({_W}, run) - min(us) OVER ({_W}, run)) / 60e6 AS minutes,
 CASE WHEN state IN ('PAU','PAUO','...') AND contains(procedure, '_EIS_') AND NOT bool_or(state IN ('CHA','DCH')) OVER ({_W}, procedure) THEN 'EIS' ELSE state END AS relabelled FROM r),
r3 AS (SELECT *, relabelled IN ('PAU','PAUO','...') AS pause, relabelled IN ('PAU','PAUO','...') AND minutes > 600 AS long, coalesce(run <> lag(run) OVER ({_O}), true) AS new_run FROM r2),
r4 AS (SELECT *, CASE WHEN (long AND new_run) OR (new_run AND coalesce(lag(long) OVER ({_O}), false)) OR coalesce(procedure <> lag(procedure) OVER ({_O}), true) OR (contains(procedure, 'P3') AND new_run) THEN 1 ELSE 0 END AS edge,
 row_number() OVER ({_W}, run ORDER BY us, seq) = 1 OR row_number() OVER ({_W}, run ORDER BY us DESC, seq DESC) = 1 AS stub FROM r3),
r5 AS (SELECT *, CASE WHEN n_bm <= 2 OR (pause AND (NOT long OR NOT stub)) THEN 0 ELSE p END AS proc0 FROM (SELECT *, sum(edge) OVER ({_O}) AS p FROM r4)),
r6 AS (SELECT *, bool_and(pause) OVER ({_W}, proc0) AS only_pause, bool_and(relabelled = 'EIS') OVER ({_W}, proc0) AS only_eis, bool_or(relabelled = 'EIS') OVER ({_W}, proc0) AS any_eis, count(*) OVER ({_W}, proc0) AS n_proc FROM r5),
r7 AS (SELECT *, CASE WHEN n_bm <= 2 THEN 'AGING' WHEN only_pause THEN 'PAU' WHEN only_eis THEN 'EIS' END AS pre, CASE WHEN n_proc < 4 AND NOT only_pause AND NOT any_eis AND n_bm > 2 THEN 0 ELSE proc0 END AS proc FROM r6),
q AS (SELECT *, CASE WHEN bool_or(pre = 'AGING') OVER ({_W}, proc) THEN 'AGING' WHEN bool_or(pre = 'PAU') OVER ({_W}, proc) THEN 'PAU' WHEN bool_or(pre = 'EIS') OVER ({_W}, proc) THEN 'EIS' WHEN bool_or(procedure IS NULL) OVER ({_W}, proc) THEN 'EIS' ELSE '-1' END AS target FROM r7)"""
_FILES = f"f AS (SELECT cell, kind, us, max(seq) AS seq, arg_max(current, seq) AS current FROM s GROUP BY cell, kind, us)"
_RUNNING = f"WITH {SAMPLES}, {contributed('cell')}, t AS (SELECT *, sum(contrib) OVER (PARTITION BY cell ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS ah FROM c)"
_CYCLES = "y AS (SELECT *, sum(n) OVER (PARTITION BY {k} ORDER BY us, seq) AS cycle FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY {k} ORDER BY us, seq) > {g} THEN 1 WHEN lag(us) OVER (PARTITION BY {k} ORDER BY us, seq) IS NULL THEN 1 ELSE 0 END AS n FROM s))"

QUERIES = {
    "A1_gap_masked_trapezoid": Query(gap_masked, f"WITH {SAMPLES}, {contributed('cell')} SELECT cell, count(*) AS n, max(cut) AS cut_us, round(sum(contrib), 4) AS ah FROM c GROUP BY cell"),
    "A2_cumulative_ah": Query(cumulative, f"{_RUNNING} SELECT cell, seq, round(ah, 4) AS ah FROM t"),
    "A3_per_file_then_merge": Query(per_file, f"WITH {SAMPLES}, {_FILES}, {contributed('cell, kind', 'f')}, m AS (SELECT cell, us, sum(contrib) AS contrib FROM c GROUP BY cell, us) SELECT cell, count(*) AS n, round(sum(contrib), 4) AS ah FROM m GROUP BY cell"),
    "A4_concurrent_recordings": Query(concurrent, f"WITH {SAMPLES}, f AS (SELECT cell, kind, min(us) AS b, max(us) AS e FROM s GROUP BY cell, kind HAVING max(abs(current)) > 0.01), p AS (SELECT *, lag(e) OVER (PARTITION BY cell ORDER BY b, kind) AS prev_finish FROM f) SELECT cell, kind, b AS begin, prev_finish FROM p WHERE b < prev_finish"),
    "A5_watermark": Query(watermark, f"{_RUNNING} SELECT cell, round(arg_max(ah, (us, seq)), 4) AS ah, arg_max(current, (us, seq)) AS current, max(us) AS last_us FROM t GROUP BY cell"),
    "A10_segment_capacity": Query(segment_capacity, f"WITH {SAMPLES}, d AS (SELECT *, us - lag(us) OVER w AS dt, lag(current) OVER w AS p FROM s WINDOW w AS (PARTITION BY cell, week ORDER BY us, seq)) SELECT cell, week, count(*) AS n, round(coalesce(sum((abs(current) + abs(p)) / 2 * dt / 3600000000.0), 0.0), 4) AS capacity, round((max(us) - min(us)) / 1e6, 3) AS seconds FROM d GROUP BY cell, week"),
    "W1_state_runs": Query(state_runs, f"WITH {SAMPLES}, {RUNS.format(k='cell', c='state', t='s')} SELECT cell, CAST(run AS BIGINT) AS run, min(state) AS state, count(*) AS n, min(us) AS first_us, max(us) AS last_us, round((max(us) - min(us)) / 60e6, 4) AS minutes FROM r GROUP BY cell, run"),
    "W7_program_index": Query(program_index, f"WITH {SAMPLES}, {BM} SELECT cell, CAST(bm AS INT) AS bm, count(*) AS n, min(us) AS first_us FROM b GROUP BY cell, bm"),
    "W2_procedures": Query(procedures, f"WITH {SAMPLES}, {PROCEDURES} SELECT cell, CAST(bm AS INT) AS bm, seq, CAST(proc AS BIGINT) AS proc, target, relabelled FROM q"),
    "A7_segments": Query(segments, f"WITH {SAMPLES}, {PROCEDURES} SELECT cell, CAST(bm AS INT) AS bm, CAST(proc AS BIGINT) AS proc, count(*) AS n, max(target) AS target, round((max(us) - min(us)) / 60e6, 4) AS minutes FROM q GROUP BY cell, bm, proc"),
    "W9_cycle_split": Query(cycle_split, f"WITH {SAMPLES}, {_CYCLES.format(k='cell', g='86400000000')} SELECT cell, CAST(cycle AS BIGINT) AS cycle, count(*) AS n, max(us) - min(us) AS length_us FROM y GROUP BY cell, cycle"),
    "W10_cycle_soc": Query(cycle_soc, f"WITH {SAMPLES}, {_CYCLES.format(k='cell, week', g='129600000000')}, z AS (SELECT *, CASE WHEN max(cycle) OVER (PARTITION BY cell, week) = 3 THEN CASE cycle WHEN 1 THEN 90 WHEN 2 THEN 50 ELSE 10 END ELSE 50 END AS soc FROM y) SELECT cell, soc, count(*) AS n FROM z GROUP BY cell, soc"),
    "W18_rolling_median": Query(rolling_median, f"WITH {SAMPLES} SELECT cell, seq, round(median(value) OVER (PARTITION BY cell, week ORDER BY us, seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS median FROM s"),
    "A30_drawdown": Query(drawdown, f"WITH {SAMPLES}, d AS (SELECT *, max(value) OVER (PARTITION BY cell, week ORDER BY us, seq) - value AS dd FROM s) SELECT cell, week, arg_min(value, (us, seq)) AS first, arg_max(value, (us, seq)) AS last, round(max(value) - min(value), 6) AS span, round(max(dd), 6) AS drawdown FROM d GROUP BY cell, week"),
    "P26_sweep_direction": Query(direction, f"WITH {SAMPLES}, d AS (SELECT cell, week, arg_max(value, (us, seq)) - arg_min(value, (us, seq)) AS d, max(value) - min(value) AS span FROM s GROUP BY cell, week) SELECT cell, week, CASE WHEN abs(d) >= greatest(0.02, 0.05 * span) THEN CASE WHEN d > 0 THEN 'charge' ELSE 'discharge' END END AS direction FROM d"),
    "W21_every_nth": Query(every_nth, f"WITH {SAMPLES} SELECT cell, week, seq FROM (SELECT *, row_number() OVER (PARTITION BY cell, week ORDER BY us, seq) AS n FROM s) WHERE (n - 1) % 5 = 0"),
    "S5_first_last_stub": Query(first_last_stub, f"WITH {SAMPLES} SELECT cell, week, seq, value, 'AGING' AS procedure FROM (SELECT *, row_number() OVER (PARTITION BY cell, week ORDER BY us, seq) AS a, row_number() OVER (PARTITION BY cell, week ORDER BY us DESC, seq DESC) AS b FROM s) WHERE a = 1 OR b = 1"),
    "W8_keep_positions": Query(keep_positions, f"WITH {SAMPLES} SELECT cell, seq, CASE WHEN row_number() OVER (PARTITION BY cell ORDER BY CAST(week AS VARCHAR), us, seq) IN (1, 3, 5) THEN 'PUL' ELSE 'PUL*RES' END AS target FROM s WHERE kind = 'error'"),
    "W15_latest_five": Query(latest_five, f"WITH {SAMPLES} SELECT cell, CAST(n AS INT) AS n, seq FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY us DESC, seq DESC) AS n FROM s) WHERE n <= 5"),
    "O_SOC4_throughput_axis": Query(soc_axis, f"WITH {SAMPLES}, {BM}, q AS (SELECT *, sum(abs(current)) OVER ({_O}) AS q FROM b), m AS (SELECT *, min(q) OVER ({_W}) AS lo, max(q) OVER ({_W}) AS hi FROM q) SELECT cell, CAST(bm AS INT) AS bm, seq, round(CASE WHEN hi > lo THEN 100 * (q - lo) / (hi - lo) ELSE 0.0 END, 4) AS soc FROM m"),
}
