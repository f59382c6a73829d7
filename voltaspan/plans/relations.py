"""Queries that join: labels, neighbours in time and order, look-back, features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltaspan.operators import features, joins, scan, segment
from voltaspan.operators import neighbours as nearby
from voltaspan.plans.base import SAMPLES, Query, rounded, samples, table
from voltaspan.plans.series import BM, PROCEDURES, segmented

TOLERANCE = 600 * 60_000_000
DAY = 86_400_000_000
FEATURES = ["voltage_mean", "voltage_std", "voltage_max", "voltage_min", "voltage_range", "current_mean", "current_std", "current_max", "current_min", "current_range", "minutes", "duration_log", "abs_current_mean", "norm_duration"]


def segment_features(spark, sf_dir):
    found = features.segment_features(samples(spark, sf_dir), ["cell", "week"], ["us", "seq"], "current", "value", 100.0, 0.0, 500.0)
    return found.select("cell", "week", *[rounded(c, 5).alias(c) for c in FEATURES])


def look_back(spark, sf_dir):
    rows = segment.programs(samples(spark, sf_dir), "cell", "week")
    ends = rows.groupBy("cell", "bm").agg(F.max_by("value", F.struct("us", "seq")).alias("end_value"), F.min_by("kind", F.struct("us", "seq")).alias("target"))
    found = joins.look_back(ends, ["cell"], "bm", "end_value", "target <> 'view'")
    spread = F.when(F.col("prev_end_value").isNotNull(), F.round(F.abs(F.col("end_value") - F.col("prev_end_value")), 6))
    return found.select("cell", "bm", "target", "end_value", "prev_end_value", spread.alias("true_range"))


def nearest_time(spark, sf_dir):
    rows = samples(spark, sf_dir)
    buys = rows.where("kind = 'purchase'").select("cell", "seq", "us")
    errors = rows.where("kind = 'error'").select("cell", F.col("us").alias("error_us"), F.col("seq").alias("error_seq"))
    return joins.nearest(buys, errors, ["cell"], "us", "error_us", TOLERANCE, "error_seq").select("cell", "seq", "error_seq")


def backward_as_of(spark, sf_dir):
    rows = samples(spark, sf_dir)
    soc = rows.where("kind = 'signup'").select("cell", "us", F.col("value").alias("soc"))
    return joins.held(rows.where("kind = 'error'").select("cell", "seq", "us"), soc, ["cell"], "us", "soc").select("cell", "seq", "soc")


def interval_join(spark, sf_dir):
    rows = samples(spark, sf_dir)
    stubs = rows.where("kind = 'error'").select("cell", F.col("seq").alias("stub"), F.col("us").alias("t0"), (F.col("us") + DAY).alias("t1"))
    found = joins.within(rows.select("cell", "seq", "us", "value"), stubs, ["cell"], "us", "t0", "t1", DAY)
    return found.groupBy("cell", "stub").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def adjacent(spark, sf_dir):
    table_ = segment.segment_table(segmented(spark, sf_dir))
    pulses = table_.where("target = '-1' and proc > 0")
    return joins.beside(pulses, table_, ["cell", "bm"], "proc").select("cell", "bm", "proc", "n")


def pulse_and_rest(spark, sf_dir):
    runs = segment.run_table(samples(spark, sf_dir), ["cell"], ["us", "seq"], "state", "us")
    w = Window.partitionBy("cell").orderBy("run")
    rows = runs.withColumns({"before": F.lag("state").over(w), "after": F.lead("state").over(w), "rest_us": F.lead("last_us").over(w) - F.lead("first_us").over(w)})
    return rows.where("state in ('CHA', 'DCH') and after like 'PAU%'").select("cell", "run", "state", "before", "after", "rest_us")


def labels_on_segments(spark, sf_dir):
    rows = segment.programs(samples(spark, sf_dir), "cell", "week")
    labels = rows.groupBy("cell", "bm").agg(F.count("*").alias("n")).where("n >= 12").select("cell", "bm", F.lit("CYC").alias("label"))
    return rows.join(labels, ["cell", "bm"], "left").groupBy("cell", F.coalesce("label", "kind").alias("target")).agg(F.count("*").alias("n"))


def program_semi(spark, sf_dir):
    rows = segment.programs(samples(spark, sf_dir), "cell", "week")
    return rows.where("kind = 'purchase'").join(rows.where("kind = 'signup'"), ["cell", "bm"], "left_semi").select("cell", "bm", "seq")


def program_anti(spark, sf_dir):
    rows = segment.programs(samples(spark, sf_dir), "cell", "week")
    kept = rows.where("kind = 'purchase' and value >= 50")
    gone = rows.where("kind = 'purchase'").join(kept, ["cell", "bm", "seq"], "left_anti").select("cell", "seq", F.lit("-1").alias("target"))
    return gone.unionByName(kept.select("cell", "seq", F.lit("CAP").alias("target")))


def _derived(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("n_chars") > 300, "1").otherwise("0").alias("a"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("b"))
    return docs, labels


def label_diff(spark, sf_dir):
    docs, labels = _derived(spark, sf_dir)
    return docs.join(labels, "doc_id").where("a <> b").select("doc_id", "lang", "a", "b")


def label_counts_outer(spark, sf_dir):
    docs, labels = _derived(spark, sf_dir)
    left = docs.where("a = '1'").groupBy("lang").agg(F.count("*").alias("n_a"))
    right = docs.join(labels, "doc_id").where("b = '0'").groupBy("lang").agg(F.count("*").alias("n_b"))
    both = left.join(right, "lang", "full").na.fill(0, ["n_a", "n_b"])
    return both.withColumn("delta", F.col("n_a") - F.col("n_b"))


def key_sets(spark, sf_dir):
    docs, labels = _derived(spark, sf_dir)
    a, b = docs.select("doc_id"), labels.where("b = '1'").select("doc_id")
    parts = [("both", a.intersect(b)), ("only_a", a.join(b, "doc_id", "left_anti")), ("only_b", b.exceptAll(a))]
    rows = [p.select(F.lit(n).alias("part"), "doc_id") for n, p in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("part").agg(F.count("*").alias("n"), F.sum("doc_id").alias("total"))


def transitions(spark, sf_dir):
    docs, labels = _derived(spark, sf_dir)
    return docs.join(labels, "doc_id").groupBy(F.concat_ws("->", "a", "b").alias("change")).agg(F.count("*").alias("n"))


def report(spark, sf_dir):
    docs, labels = _derived(spark, sf_dir)
    cells = docs.join(labels, "doc_id").groupBy("a", "b").agg(F.count("*").alias("n"))
    per = cells.select(F.explode(F.array(F.struct(F.col("a").alias("k"), F.col("n").alias("p"), F.lit(0).cast("long").alias("s")), F.struct(F.col("b").alias("k"), F.lit(0).cast("long").alias("p"), F.col("n").alias("s")))).alias("x"), (F.col("a") == F.col("b")).alias("hit"), "n")
    rows = per.groupBy("x.k").agg(F.sum("x.p").alias("p"), F.sum("x.s").alias("s"), (F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)) / 2).alias("tp"))
    precision, recall = F.try_divide("tp", "p"), F.try_divide("tp", "s")
    return rows.select(F.col("k").alias("label"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(F.try_divide(2 * precision * recall, precision + recall), 6).alias("f1"), F.col("s").alias("support"))


def largest_per_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("orderkey"))


def borrowed(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("own"))
    joined = c.join(o, "c_custkey", "left")
    nation = joined.groupBy("c_nationkey").agg(F.avg("own").alias("mean"))
    rows = joined.join(nation, "c_nationkey")
    source = F.when(F.col("own").isNotNull(), "own").when(F.col("mean").isNotNull(), "mean").otherwise("none")
    return rows.select("c_custkey", F.round(F.coalesce("own", "mean"), 4).alias("temperature"), source.alias("source"))


def interpolated(spark, sf_dir):
    rows = samples(spark, sf_dir)
    knots = rows.where("kind = 'signup'").groupBy("cell", "us").agg(F.avg("value").alias("ref"))
    found = joins.bracketed(rows.where("kind = 'error'").select("cell", "seq", "us"), knots, ["cell"], "us", "ref", scan.SLICE)
    return found.select("cell", "seq", F.round("ref", 4).alias("ref"))


def pairs(spark, sf_dir):
    rows = segment.programs(samples(spark, sf_dir), "cell", "week")
    sweep = lambda kind, name: rows.where(f"kind = '{kind}'").groupBy("cell", "bm").agg(F.max("value").alias(name))
    return sweep("click", "cha").join(sweep("purchase", "dch"), ["cell", "bm"])


def neighbours(spark, sf_dir):
    """At most four nearest of each brand's parts in the plane of size and price, each pair once."""
    found = nearby.nearest_points(table(spark, sf_dir, "part"), ["p_brand"], "p_partkey", ["p_size", "p_retailprice"], 4)
    return nearby.lines(found, ["p_brand"], "p_partkey").select("u", "v")


def same_direction_nearest(spark, sf_dir):
    """For each cell the sweep of each direction that begins nearest to the cell's last error."""
    rows = samples(spark, sf_dir)
    ref = rows.where("kind = 'error'").groupBy("cell").agg(F.max("us").alias("ref"))
    sweeps = rows.where("kind in ('click', 'purchase')").join(ref, "cell", "left")
    at = F.struct(F.coalesce(F.abs(F.col("us") - F.col("ref")), F.lit(0)), "us", "seq")
    return sweeps.groupBy("cell", "kind").agg(F.min_by("seq", at).alias("seq"))


_F = """SELECT cell, week, round(avg(v), 5) AS voltage_mean, round(stddev_samp(v), 5) AS voltage_std, round(max(v), 5) AS voltage_max, round(min(v), 5) AS voltage_min, round(max(v) - min(v), 5) AS voltage_range,
 round(avg(i) / 100, 5) AS current_mean, round(stddev_samp(i) / 100, 5) AS current_std, round(sign(avg(i)) * max(abs(i)) / 100, 5) AS current_max, round(sign(avg(i)) * min(abs(i)) / 100, 5) AS current_min, round((max(abs(i)) - min(abs(i))) / 100, 5) AS current_range,
 round((max(us) - min(us)) / 60e6, 5) AS minutes, round(ln(1 + (max(us) - min(us)) / 60e6), 5) AS duration_log, round(abs(avg(i) / 100), 5) AS abs_current_mean, round(abs(avg(i) / 100) * ((max(us) - min(us)) / 60e6) / 60, 5) AS norm_duration FROM f GROUP BY cell, week"""
_DOCS = "d AS (SELECT doc_id, lang, CASE WHEN n_chars > 300 THEN '1' ELSE '0' END AS a FROM documents), l AS (SELECT doc_id, CAST(quality AS VARCHAR) AS b FROM labels)"
_RUNT = "WITH {S}, r AS (SELECT *, sum(new) OVER (PARTITION BY cell ORDER BY us, seq) AS run FROM (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY cell ORDER BY us, seq) THEN 0 ELSE 1 END AS new FROM s)), t AS (SELECT cell, run, min(state) AS state, min(us) AS first_us, max(us) AS last_us FROM r GROUP BY cell, run)".replace("{S}", SAMPLES)

QUERIES = {
    "A8_segment_features": Query(segment_features, f"WITH {SAMPLES}, f AS (SELECT cell, week, us, value / 500.0 AS v, CASE WHEN row_number() OVER w > 2 AND row_number() OVER w < count(*) OVER (PARTITION BY cell, week) THEN current END AS i FROM s WINDOW w AS (PARTITION BY cell, week ORDER BY us, seq)) {_F}"),
    "J5_look_back": Query(look_back, f"WITH {SAMPLES}, {BM}, e AS (SELECT cell, bm, arg_max(value, (us, seq)) AS end_value, arg_min(kind, (us, seq)) AS target FROM b GROUP BY cell, bm), p AS (SELECT *, (SELECT arg_max(x.end_value, x.bm) FROM e x WHERE x.cell = e.cell AND x.bm BETWEEN e.bm - 4 AND e.bm - 1 AND x.target <> 'view') AS prev_end_value FROM e) SELECT cell, CAST(bm AS INT) AS bm, target, end_value, prev_end_value, round(abs(end_value - prev_end_value), 6) AS true_range FROM p"),
    "J11_nearest_time": Query(nearest_time, f"WITH {SAMPLES} SELECT a.cell, a.seq, arg_min(b.seq, (abs(a.us - b.us), b.us, b.seq)) AS error_seq FROM s a JOIN s b ON a.cell = b.cell AND b.kind = 'error' AND abs(a.us - b.us) <= {TOLERANCE} WHERE a.kind = 'purchase' GROUP BY a.cell, a.seq"),
    "J13_backward_as_of": Query(backward_as_of, f"WITH {SAMPLES} SELECT cell, seq, (SELECT arg_max(b.value, b.us) FROM s b WHERE b.cell = a.cell AND b.kind = 'signup' AND b.us <= a.us) AS soc FROM s a WHERE kind = 'error'"),
    "J14_interval_join": Query(interval_join, f"WITH {SAMPLES} SELECT a.cell, a.seq AS stub, count(*) AS n, round(sum(b.value), 4) AS total FROM s a JOIN s b ON a.cell = b.cell AND b.us BETWEEN a.us AND a.us + {DAY} WHERE a.kind = 'error' GROUP BY a.cell, a.seq"),
    "J15_adjacent_procedures": Query(adjacent, f"WITH {SAMPLES}, {PROCEDURES}, t AS (SELECT cell, bm, proc, count(*) AS n, max(target) AS target FROM q GROUP BY cell, bm, proc) SELECT cell, CAST(bm AS INT) AS bm, CAST(proc AS BIGINT) AS proc, n FROM t WHERE proc <> 0 AND EXISTS (SELECT 1 FROM t p WHERE p.cell = t.cell AND p.bm = t.bm AND p.target = '-1' AND p.proc > 0 AND abs(p.proc - t.proc) = 1)"),
    "J16_pulse_and_rest": Query(pulse_and_rest, f"{_RUNT}, x AS (SELECT *, lag(state) OVER w AS before, lead(state) OVER w AS after, lead(last_us) OVER w - lead(first_us) OVER w AS rest_us FROM t WINDOW w AS (PARTITION BY cell ORDER BY run)) SELECT cell, CAST(run AS BIGINT) AS run, state, before, after, rest_us FROM x WHERE state IN ('CHA', 'DCH') AND after LIKE 'PAU%'"),
    "J1_labels_on_segments": Query(labels_on_segments, f"WITH {SAMPLES}, {BM}, l AS (SELECT cell, bm, 'CYC' AS label FROM b GROUP BY cell, bm HAVING count(*) >= 12) SELECT cell, coalesce(label, kind) AS target, count(*) AS n FROM b LEFT JOIN l USING (cell, bm) GROUP BY ALL"),
    "J6_program_semi": Query(program_semi, f"WITH {SAMPLES}, {BM} SELECT cell, CAST(bm AS INT) AS bm, seq FROM b WHERE kind = 'purchase' AND EXISTS (SELECT 1 FROM b x WHERE x.cell = b.cell AND x.bm = b.bm AND x.kind = 'signup')"),
    "J7_rejected_anti": Query(program_anti, f"WITH {SAMPLES} SELECT cell, seq, CASE WHEN value >= 50 THEN 'CAP' ELSE '-1' END AS target FROM s WHERE kind = 'purchase'"),
    "J8_label_diff": Query(label_diff, f"WITH {_DOCS} SELECT doc_id, lang, a, b FROM d JOIN l USING (doc_id) WHERE a <> b"),
    "J9_label_counts_outer": Query(label_counts_outer, f"WITH {_DOCS}, x AS (SELECT lang, count(*) AS n_a FROM d WHERE a = '1' GROUP BY lang), y AS (SELECT lang, count(*) AS n_b FROM d JOIN l USING (doc_id) WHERE b = '0' GROUP BY lang) SELECT lang, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(n_a, 0) - coalesce(n_b, 0) AS delta FROM x FULL JOIN y USING (lang)"),
    "J10_key_sets": Query(key_sets, f"WITH {_DOCS}, z AS (SELECT d.doc_id AS i, l.doc_id AS j FROM d FULL JOIN (SELECT * FROM l WHERE b = '1') l ON d.doc_id = l.doc_id) SELECT CASE WHEN j IS NULL THEN 'only_a' WHEN i IS NULL THEN 'only_b' ELSE 'both' END AS part, count(*) AS n, CAST(sum(coalesce(i, j)) AS BIGINT) AS total FROM z GROUP BY part"),
    "A24_label_transitions": Query(transitions, f"WITH {_DOCS} SELECT a || '->' || b AS change, count(*) AS n FROM d JOIN l USING (doc_id) GROUP BY change"),
    "A37_classification_report": Query(report, f"WITH {_DOCS}, j AS (SELECT a, b FROM d JOIN l USING (doc_id)), k AS (SELECT a AS label FROM j UNION SELECT b FROM j), c AS (SELECT label, (SELECT count(*) FROM j WHERE a = label) AS p, (SELECT count(*) FROM j WHERE b = label) AS s, (SELECT count(*) FROM j WHERE a = label AND b = label) AS tp FROM k), m AS (SELECT label, s, tp / nullif(p, 0) AS pr, tp / nullif(s, 0) AS re FROM c) SELECT label, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / nullif(pr + re, 0), 6) AS f1, s AS support FROM m"),
    "J19_largest_per_group": Query(largest_per_group, "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS orderkey FROM orders GROUP BY o_custkey"),
    "J20_borrowed_temperature": Query(borrowed, "WITH j AS (SELECT c_custkey, c_nationkey, avg(o_totalprice) AS own FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL), n AS (SELECT c_nationkey, avg(own) AS mean FROM j GROUP BY c_nationkey) SELECT c_custkey, round(coalesce(own, mean), 4) AS temperature, CASE WHEN own IS NOT NULL THEN 'own' WHEN mean IS NOT NULL THEN 'mean' ELSE 'none' END AS source FROM j JOIN n USING (c_nationkey)"),
    "J21_interpolated_reference": Query(interpolated, f"WITH {SAMPLES}, k AS (SELECT cell, us, avg(value) AS v FROM s WHERE kind = 'signup' GROUP BY cell, us), p AS (SELECT cell, seq, us, (SELECT max(us) FROM k WHERE k.cell = s.cell AND k.us <= s.us) AS k0, (SELECT min(us) FROM k WHERE k.cell = s.cell AND k.us >= s.us) AS k1 FROM s WHERE kind = 'error') SELECT p.cell, seq, round(CASE WHEN k1 > k0 THEN a.v + (p.us - k0) / (k1 - k0) * (z.v - a.v) ELSE coalesce(a.v, z.v) END, 4) AS ref FROM p LEFT JOIN k a ON a.cell = p.cell AND a.us = k0 LEFT JOIN k z ON z.cell = p.cell AND z.us = k1"),
    "J17_sweep_pairs": Query(pairs, f"WITH {SAMPLES}, {BM} SELECT cell, CAST(bm AS INT) AS bm, max(value) FILTER (kind = 'click') AS cha, max(value) FILTER (kind = 'purchase') AS dch FROM b GROUP BY cell, bm HAVING count(*) FILTER (kind = 'click') > 0 AND count(*) FILTER (kind = 'purchase') > 0"),
    "J22_nearest_neighbours": Query(
        neighbours,
        "WITH d AS (SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(a.p_size AS DOUBLE) - b.p_size AS x, CAST(a.p_retailprice AS DOUBLE) - b.p_retailprice AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey), n AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY x * x + y * y, b) AS n FROM d) SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM n WHERE n <= 4",
    ),
    "J12_same_direction_nearest": Query(same_direction_nearest, f"WITH {SAMPLES}, r AS (SELECT cell, max(us) AS ref FROM s WHERE kind = 'error' GROUP BY cell) SELECT cell, kind, arg_min(seq, (coalesce(abs(us - ref), 0), us, seq)) AS seq FROM s LEFT JOIN r USING (cell) WHERE kind IN ('click', 'purchase') GROUP BY cell, kind"),
}
