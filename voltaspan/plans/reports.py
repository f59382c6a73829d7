"""Queries of the fleet layer, spectra, ladders, reshaping and text rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltaspan.operators import fleet, impedance, ladder, pulses, scan, segment
from voltaspan.plans.base import SAMPLES, Query, rounded, samples, shared_folder, table
from voltaspan.plans.series import BM
from voltaspan.sources import files
from voltaspan.sources import spectra as spectra_source


def checkups(spark, sf_dir):
    """Orders as check-ups: name, time, capacity, running charge, conditions."""
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    rows = rows.select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("id"), at.alias("day_us"), F.col("o_totalprice").alias("capacity"), F.col("c_mktsegment").alias("c_rate"), F.col("n_regionkey").alias("temperature"))
    ah = F.sum("capacity").over(Window.partitionBy("name").orderBy("day_us", "id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("ah", ah)


def cell_table(spark, sf_dir):
    return fleet.cell_table(checkups(spark, sf_dir), "name", ["day_us", "id"], ["c_rate", "temperature"], "capacity", "ah")


def cells(spark, sf_dir):
    return cell_table(spark, sf_dir).select("name", "c_rate", "temperature", "n_cu", F.round("loss", 4).alias("loss"), F.round("delta_ah", 4).alias("delta_ah"))


def matrix(spark, sf_dir):
    found = fleet.aging_matrix(cell_table(spark, sf_dir).where("n_cu >= 2"), "name", ["c_rate", "temperature"])
    return found.select("c_rate", "temperature", "n", F.sha2("names", 256).alias("names"), *[F.round(c, 3).alias(c) for c in ("loss_mean", "loss_std", "ah_mean", "ah_std")], F.round("ratio", 6).alias("ratio"))


def rollup(spark, sf_dir):
    return cell_table(spark, sf_dir).rollup("temperature", "c_rate").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 3).alias("loss"))


def soh_map(spark, sf_dir):
    first = checkups(spark, sf_dir).groupBy("name").agg(F.min_by("capacity", F.struct("day_us", "id")).alias("capacity"))
    return first.select("name", F.coalesce(fleet.soh(F.col("capacity"), 300000.0).cast("decimal(10,1)").cast("string"), F.lit("NA")).alias("soh"))


def capacity_summary(spark, sf_dir):
    rows = checkups(spark, sf_dir).withColumn("bm", F.dense_rank().over(Window.partitionBy("name").orderBy(F.floor(F.col("day_us") / (30 * 86_400_000_000)))) - 1)
    return rows.groupBy("name", "bm").agg(F.min_by("capacity", F.struct("day_us", "id")).alias("capacity"), F.round(F.min("ah"), 4).alias("ah"), F.min("day_us").alias("start_us"))


def slope(spark, sf_dir):
    found = fleet.recent_slope(checkups(spark, sf_dir), "name", ["day_us", "id"], "capacity")
    return found.select("name", "n_cu", "latest", F.round("slope", 4).alias("slope"))


def latest_row(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("name").orderBy("capacity", "id"))
    return checkups(spark, sf_dir).withColumn("n", n).where("n = 1").select("name", "id", "capacity")


def span_column(spark, sf_dir):
    w = Window.partitionBy("name")
    return checkups(spark, sf_dir).select("name", "id", F.round(F.max("capacity").over(w) - F.min("capacity").over(w), 4).alias("span"))


def fleet_status(spark, sf_dir):
    seen = samples(spark, sf_dir).groupBy("cell").agg(F.max("us").alias("us"), F.max_by("kind", F.struct("us", "seq")).alias("kind"))
    now = seen.agg(F.max("us").alias("now"))
    rows = fleet.status(seen.join(F.broadcast(now)), "cell", "us", F.col("now"), 5, F.col("kind") != "error")  # one row
    return rows.select("cell", "us", "status", "rank")


def schedule(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("cell", "procedure").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def checkup_labels(spark, sf_dir):
    """Programs with a signup are check-ups, numbered; those between are aging after the last."""
    rows = segment.programs(samples(spark, sf_dir), "cell", "week").groupBy("cell", "bm").agg(F.max(F.col("kind") == "signup").alias("cu"))
    w = Window.partitionBy("cell").orderBy("bm").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.col("cu").cast("int")).over(w)
    return rows.select("cell", "bm", F.when(F.col("cu"), F.concat(F.lit("Checkup_"), n.cast("string"))).when(n > 0, F.concat(F.lit("Aging_"), n.cast("string"))).alias("label"))


def program_counts(spark, sf_dir):
    rows = segment.programs(samples(spark, sf_dir), "cell", "week")
    of = rows.groupBy("cell", "bm").agg(F.max(F.col("procedure").rlike("P[23]").cast("int")).alias("hit"), F.min(F.col("state").isin("PAU", "PAUO").cast("int")).alias("pause"))
    return of.groupBy("cell").agg(F.count("*").alias("n"), F.sum("hit").alias("n_hit"), F.sum("pause").alias("n_pause"))


def signature(spark, sf_dir):
    rows = samples(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("mean"), F.round(F.min("value"), 3).alias("low"), F.round(F.max("value"), 3).alias("high"), F.mode("kind", True).alias("target"))
    return rows.withColumn("key", F.concat_ws("|", "state", F.col("n").cast("string"), "target"))


def signed_charge(spark, sf_dir):
    rows = samples(spark, sf_dir)
    q = F.sum(F.abs("current")).over(Window.partitionBy("cell", "week").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0))
    mean = F.avg("current")
    return rows.withColumn("q", q).groupBy("cell", "week").agg(F.round(F.when(F.abs(mean) <= 1e-3, 0.0).otherwise((F.max("q") - F.min("q")) * F.signum(mean)), 4).alias("step")).withColumn("step", F.col("step") + 0.0)


def spectra(spark, sf_dir):
    at = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("eis"), F.col("l_quantity").cast("double").alias("f"), (F.col("l_extendedprice") / 1e5).alias("re"), (F.col("l_discount") - 0.05 + F.col("l_tax") / 100).alias("im"), at.alias("us"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    return impedance.reduced(rows, ["eis"], "f", "re", ["us", "o", "n"], ["re", "im", "us"])


def reduced_spectrum(spark, sf_dir):
    return spectra(spark, sf_dir).select("eis", "f", rounded("re", 6).alias("re"), rounded("im", 6).alias("im"))


def _spectra_files(spark, sf_dir):
    """A supplier's line items as a device's files: every third in Parquet, others in CSV with a line
    of units; of every seventh a column has another name, every eleventh never settles."""
    at = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    s = F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("EIS"), F.lpad(s.cast("string"), 8, "0")).alias("name"), F.row_number().over(Window.partitionBy(s).orderBy(at, "l_orderkey", "l_linenumber")).alias("k"), s.alias("s"), F.timestamp_micros(at).cast("string").alias("Zeit"),
        F.when(s % 11 == 0, 0.0).otherwise(F.col("l_quantity").cast("double")).alias("ActFreq"), (F.col("l_extendedprice") / 1e5).cast("double").alias("Zreal1"), (F.col("l_discount") - 0.05 + F.col("l_tax") / 100).cast("double").alias("Zimg1"),
        (F.col("l_extendedprice") / 1e5).cast("double").alias("Betrag"),
    )
    folder, names = f"{shared_folder(spark)}/spectra-{uuid.uuid4().hex}", ["Zeit", "ActFreq", "Zreal1", "Zimg1", "Betrag"]
    files.written_by(rows.where("s % 3 = 0"), ["name"], ["name"], f"{folder}/a", ["name", *names], ["k"])
    head = F.when(F.col("s") % 7 == 0, "Zeit,ActFreq,Zreal1,Zimg1,Size").otherwise(",".join(names))
    csv = rows.where("s % 3 != 0")
    tops = csv.groupBy("name", "s").agg(F.array(F.struct(F.lit(-2).alias("k"), F.first(head).alias("value")), F.struct(F.lit(-1).alias("k"), F.lit("-,Hz,Ohm,Ohm,Ohm").alias("value"))).alias("top"))
    lines = csv.select("name", "k", F.concat_ws(",", *names).alias("value")).unionByName(tops.select("name", F.inline("top")))
    files.written_by(lines, ["name"], ["name"], f"{folder}/b", ["name", "value"], ["k"], kind="text")
    return spectra_source.read(spark, folder, pattern="part-*")


def spectra_files(spark, sf_dir):
    found, _ = _spectra_files(spark, sf_dir)
    return found.select(F.substring("eis_number", 4, 8).cast("long").alias("eis"), F.col("frequency").alias("f"), rounded("z_real", 6).alias("re"), rounded("z_imag", 6).alias("im"))


def spectra_reasons(spark, sf_dir):
    _, reasons = _spectra_files(spark, sf_dir)
    return reasons.select(F.regexp_extract("path", "EIS([0-9]+)", 1).cast("long").alias("eis"), "reason")


def spectrum_meta(spark, sf_dir):
    return spectra(spark, sf_dir).groupBy("eis").agg(F.min("us").alias("first_us"), F.count("*").alias("n"), F.round(F.avg("re"), 5).alias("mean"))


def fit_free(spark, sf_dir):
    found = impedance.fit_free(spectra(spark, sf_dir), ["eis"], "f", "re", "im")
    return found.select("eis", "n", *[rounded(c, 4).alias(c) for c in ("r_cross", "f_cross", "r_tot", "r_pol", "arc_peak", "f_peak")])


def rough(spark, sf_dir):
    return impedance.roughness(spectra(spark, sf_dir), ["eis"], ["f"], "re").select("eis", F.round("roughness", 5).alias("roughness"))


def agreement(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("x"))
    apart = F.abs(F.col("x") - F.col("p_retailprice")) / F.greatest(F.abs("x"), F.abs("p_retailprice"))
    return p.join(l, "p_partkey").groupBy("p_brand").agg(F.round(F.percentile(apart, F.lit(0.5)), 5).alias("agreement"))


def fit_summary(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    e = F.col("l_discount")
    return l.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum((e == 0).cast("int")).alias("fails"), F.round(F.avg(e), 5).alias("mean"), F.round(F.percentile(e, F.lit(0.5)), 5).alias("median"), F.max(e).alias("high"), F.round(F.stddev_samp(e), 5).alias("std"))


def leave_one_out(spark, sf_dir):
    """For each supplier the median balance of the others of its nation."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("x"))
    found = pulses.left_out(s, ["g"], "i", ["x"]).where("x_others is not null")
    return found.select("i", F.round("x_others", 4).alias("borrowed"))


def plateau(spark, sf_dir):
    rows = segment.programs(samples(spark, sf_dir), "cell", "week").where("kind = 'purchase'")
    return ladder.plateaus(rows, ["cell"], ["us", "seq"], "bm", "seq", "value", 50.0).groupBy("cell", "plateau").agg(F.count("*").alias("n"))


def _blocks(spark, sf_dir):
    rows = samples(spark, sf_dir)
    rows = scan.scanned(rows, ["cell"], ["us", "seq"], {"proc": scan.Carry("sum", F.lit(1).cast("long"))})
    target = F.when(F.col("state") == "EIS", "EIS").when(F.col("state") == "PAU", "PAU").otherwise("CYC")
    return ladder.blocks(rows.select("cell", "proc", target.alias("target"), "current"), ["cell"], "proc", "target", "current")


def blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select("cell", "first_proc", "last_proc", "n", "step", "pauses_before")


def block_soc(spark, sf_dir):
    return ladder.block_soc(_blocks(spark, sf_dir), ["cell"], 1000.0, 100.0).select("cell", "first_proc", F.round("soc", 4).alias("soc"))


def pivoted(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("cell").pivot("state", ["PAU", "PAUO", "CHA", "DCH", "EIS"]).agg(F.count(F.lit(1)))


def unrolled(spark, sf_dir):
    wide = samples(spark, sf_dir).groupBy("cell").agg(F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").cast("double").alias("n"))
    return wide.unpivot("cell", ["high", "low", "n"], "name", "value")


def curves(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("vec_id < 50").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return e.where("i < 8").select("vec_id", "i", F.round(F.col("x").cast("double"), 5).alias("x"))


def all_curves(spark, sf_dir):
    """Every component of every embedding that isn't null, as it is. ``curves`` keeps to the cut in its SQL."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", F.col("x").cast("double").alias("x"))


def custom_order(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    first = F.when(F.col("c_mktsegment") == "MACHINERY", 0).when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(2)
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(first, F.col("c_acctbal").asc_nulls_last(), "c_custkey"))
    return c.select("c_nationkey", "c_custkey", n.alias("place")).where("place <= 10")


def union_missing(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True).groupBy(F.col("name").isNull().alias("missing")).agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("x"))


def prefix_union(spark, sf_dir):
    """Names under the new tag and, where it lacks them, under the old."""
    new = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("name"), F.lit("new").alias("tag"))
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.lit("old").alias("tag"))
    return new.unionByName(old.join(new, "name", "left_anti"))


def names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    parts = F.split("p_name", " ")
    return p.select("p_partkey", F.element_at(parts, 1).alias("first"), F.element_at(parts, -1).alias("last"), F.size(parts).alias("n"), F.try_element_at(F.regexp_extract_all("p_brand", F.lit("([0-9]+)"), 1), F.lit(1)).try_cast("int").alias("number"), F.upper("p_type").contains("BRASS").alias("marked"))


def rules(spark, sf_dir):
    """Row rules: C-rate tags, weak labels, decades, temperature and rate masks, duplicates."""
    s, v = samples(spark, sf_dir), F.col("value")
    rate = v / 100
    tag = F.when(v.isNull() | (rate <= 0), "cNA").when(rate >= 0.95, F.concat(F.bround(rate).cast("int").cast("string"), F.lit("c"))).otherwise(F.concat(F.lit("c"), F.bround(1 / rate).cast("int").cast("string")))
    weak = F.when((v >= 10) & (F.col("current") > 0), "SOC_ADJUST").when((v >= 10) & (F.col("current") < 0), "PREP").otherwise("-1")
    decade = F.least(F.greatest(F.floor(F.log10(F.greatest(v, F.lit(0.1)))), F.lit(-1)), F.lit(3)).cast("int")
    near = F.exists(F.array(F.lit(25.0), F.lit(40.0)), lambda t: F.abs(v - t) < 3)
    return s.groupBy(tag.alias("tag"), weak.alias("weak"), decade.alias("decade"), near.alias("near")).agg(F.count("*").alias("n"))


def first_state_rows(spark, sf_dir):
    """One row per time and state, the first; saved and rest states go."""
    n = F.row_number().over(Window.partitionBy("cell", "us", "state").orderBy("seq"))
    return samples(spark, sf_dir).withColumn("n", n).where("n = 1 and state not in ('SAVE', 'REST')").groupBy("cell").agg(F.count("*").alias("n"))


def excluded_ranges(spark, sf_dir):
    """Samples outside the (start, end] of each cell's first three days."""
    s = samples(spark, sf_dir)
    start = F.min("us").over(Window.partitionBy("cell"))
    return s.withColumn("t0", start).where(~((F.col("us") > F.col("t0")) & (F.col("us") <= F.col("t0") + 3 * 86_400_000_000))).groupBy("cell").agg(F.count("*").alias("n"))


def cell_gate(spark, sf_dir):
    """Cells with some procedure that matches; their rows alone are read on."""
    s = samples(spark, sf_dir)
    return s.join(s.where(F.col("procedure").contains("P3") & (F.col("value") > 60)).select("cell").distinct(), "cell", "left_semi").groupBy("cell").agg(F.count("*").alias("n"))


def distinct_targets(spark, sf_dir):
    return samples(spark, sf_dir).where("procedure is not null").groupBy("cell").agg(F.sort_array(F.collect_set("procedure")).alias("p")).select("cell", F.explode("p").alias("procedure")).groupBy("procedure").agg(F.count("*").alias("n"))


_CU = """k AS (SELECT o_custkey AS name, o_orderkey AS id, epoch_us(o_orderdate) AS day_us, o_totalprice AS capacity, c_mktsegment AS c_rate, n_regionkey AS temperature, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS ah FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT name, arg_min(c_rate, (day_us, id)) AS c_rate, arg_min(temperature, (day_us, id)) AS temperature, count(capacity) AS n_cu, max(capacity) - min(capacity) AS loss, max(ah) - min(ah) AS delta_ah FROM k GROUP BY name)"""
_SP = "z AS (SELECT l_suppkey AS eis, CAST(l_quantity AS DOUBLE) AS f, arg_max(l_extendedprice / 1e5, (l_shipdate, l_orderkey, l_linenumber)) AS re, arg_max(l_discount - 0.05 + l_tax / 100, (l_shipdate, l_orderkey, l_linenumber)) AS im, epoch_us(arg_max(l_shipdate, (l_shipdate, l_orderkey, l_linenumber))) AS us FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY ALL)"
_BL = f"""WITH {SAMPLES}, g AS (SELECT cell, row_number() OVER (PARTITION BY cell ORDER BY us, seq) AS proc, CASE state WHEN 'EIS' THEN 'EIS' WHEN 'PAU' THEN 'PAU' ELSE 'CYC' END AS target, current FROM s),
h AS (SELECT *, sum(CASE WHEN target = 'EIS' AND coalesce(lag_target, '') <> 'EIS' THEN 1 ELSE 0 END) OVER (PARTITION BY cell ORDER BY proc) AS block FROM (SELECT *, lag(target) OVER (PARTITION BY cell ORDER BY proc) AS lag_target FROM g)),
m AS (SELECT *, last_value(CASE WHEN target = 'CYC' THEN current END IGNORE NULLS) OVER (PARTITION BY cell ORDER BY proc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS step0, count(*) FILTER (target = 'PAU') OVER (PARTITION BY cell ORDER BY proc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM h),
x AS (SELECT cell, block, min(proc) AS first_proc, max(proc) AS last_proc, count(*) AS n, arg_min(struct_pack(v := step0), proc).v AS step, min(p) AS pauses_before FROM m WHERE target = 'EIS' GROUP BY cell, block)"""

QUERIES = {
    "A17_cell_table": Query(cells, f"WITH {_CU} SELECT name, c_rate, temperature, n_cu, round(loss, 4) AS loss, round(delta_ah, 4) AS delta_ah FROM t"),
    "A18_aging_matrix": Query(matrix, f"WITH {_CU} SELECT c_rate, temperature, count(*) AS n, sha256(string_agg(CAST(name AS VARCHAR), '; ' ORDER BY name)) AS names, round(avg(loss), 3) AS loss_mean, round(stddev_samp(loss), 3) AS loss_std, round(avg(delta_ah), 3) AS ah_mean, round(stddev_samp(delta_ah), 3) AS ah_std, round(avg(loss) / nullif(avg(delta_ah), 0), 6) AS ratio FROM t WHERE n_cu >= 2 GROUP BY c_rate, temperature"),
    "A18_fleet_rollup": Query(rollup, f"WITH {_CU} SELECT temperature, c_rate, count(*) AS n, round(avg(loss), 3) AS loss FROM t GROUP BY ROLLUP (temperature, c_rate)"),
    "A13_soh_map": Query(soh_map, f"WITH {_CU} SELECT name, coalesce(CAST(CAST(round(arg_min(capacity, (day_us, id)) / 300000.0 * 100, 1) AS DECIMAL(10,1)) AS VARCHAR), 'NA') AS soh FROM k GROUP BY name"),
    "A14_capacity_summary": Query(capacity_summary, f"WITH {_CU}, b AS (SELECT *, dense_rank() OVER (PARTITION BY name ORDER BY floor(day_us / 2592000000000.0)) - 1 AS bm FROM k) SELECT name, CAST(bm AS INT) AS bm, arg_min(capacity, (day_us, id)) AS capacity, round(min(ah), 4) AS ah, min(day_us) AS start_us FROM b GROUP BY name, bm"),
    "A23_recent_slope": Query(slope, f"WITH {_CU}, n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY day_us DESC, id DESC) AS back FROM k) SELECT name, count(*) AS n_cu, max(capacity) FILTER (back = 1) AS latest, CASE WHEN count(*) >= 2 THEN round(regr_slope(capacity, -back) FILTER (back <= 5), 4) END AS slope FROM n GROUP BY name"),
    "A22_lowest_row": Query(latest_row, f"WITH {_CU} SELECT name, arg_min(id, (capacity, id)) AS id, min(capacity) AS capacity FROM k GROUP BY name"),
    "A20_span_column": Query(span_column, f"WITH {_CU} SELECT name, id, round(max(capacity) OVER (PARTITION BY name) - min(capacity) OVER (PARTITION BY name), 4) AS span FROM k"),
    "T3_fleet_status": Query(fleet_status, f"WITH {SAMPLES}, l AS (SELECT cell, max(us) AS us, arg_max(kind, (us, seq)) AS kind FROM s GROUP BY cell), x AS (SELECT cell, us, CASE WHEN (SELECT max(us) FROM l) - us <= 432000000000 THEN 'running' WHEN kind = 'error' THEN 'unfinished' ELSE 'finished' END AS status FROM l) SELECT cell, us, status, CASE status WHEN 'unfinished' THEN 0 WHEN 'running' THEN 1 ELSE 2 END AS rank FROM x"),
    "W17_schedule": Query(schedule, f"WITH {SAMPLES} SELECT cell, procedure, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY cell, procedure"),
    "W16_checkup_labels": Query(checkup_labels, f"WITH {SAMPLES}, {BM}, g AS (SELECT cell, bm, bool_or(kind = 'signup') AS cu FROM b GROUP BY cell, bm), n AS (SELECT *, sum(CAST(cu AS INT)) OVER (PARTITION BY cell ORDER BY bm) AS n FROM g) SELECT cell, CAST(bm AS INT) AS bm, CASE WHEN cu THEN 'Checkup_' || CAST(n AS INT) WHEN n > 0 THEN 'Aging_' || CAST(n AS INT) END AS label FROM n"),
    "A15_program_counts": Query(program_counts, f"WITH {SAMPLES}, {BM}, g AS (SELECT cell, bm, bool_or(regexp_matches(procedure, 'P[23]')) AS hit, bool_and(state IN ('PAU', 'PAUO')) AS pause FROM b GROUP BY cell, bm) SELECT cell, count(*) AS n, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS n_hit, CAST(sum(CAST(pause AS INT)) AS BIGINT) AS n_pause FROM g GROUP BY cell"),
    "A25_signature": Query(signature, f"WITH {SAMPLES} SELECT state, count(*) AS n, round(avg(value), 3) AS mean, round(min(value), 3) AS low, round(max(value), 3) AS high, mode(kind) AS target, state || '|' || count(*) || '|' || mode(kind) AS key FROM s GROUP BY state"),
    "A26_signed_charge": Query(signed_charge, f"WITH {SAMPLES}, q AS (SELECT *, sum(abs(current)) OVER (PARTITION BY cell, week ORDER BY us, seq) AS q FROM s) SELECT cell, week, round(CASE WHEN abs(avg(current)) <= 1e-3 THEN 0.0 ELSE (max(q) - min(q)) * sign(avg(current)) END, 4) + 0.0 AS step FROM q GROUP BY cell, week"),
    "A27_reduced_spectrum": Query(reduced_spectrum, f"WITH {_SP} SELECT eis, f, round(re, 6) AS re, round(im, 6) AS im FROM z"),
    "S24_spectra_files": Query(spectra_files, f"WITH {_SP} SELECT eis, f, round(re, 6) AS re, round(im, 6) AS im FROM z WHERE eis % 11 <> 0 AND (eis % 3 = 0 OR eis % 7 <> 0)"),
    "S10_spectra_reasons": Query(spectra_reasons, "SELECT DISTINCT l_suppkey AS eis, CASE WHEN l_suppkey % 3 <> 0 AND l_suppkey % 7 = 0 THEN 'no column Betrag' ELSE 'no settled point' END AS reason FROM lineitem WHERE l_suppkey % 11 = 0 OR l_suppkey % 3 <> 0 AND l_suppkey % 7 = 0"),
    "A28_spectrum_meta": Query(spectrum_meta, f"WITH {_SP} SELECT eis, min(us) AS first_us, count(*) AS n, round(avg(re), 5) AS mean FROM z GROUP BY eis"),
    "FIT12_fit_free": Query(fit_free, f"WITH {_SP}, w AS (SELECT *, im * lead(im) OVER v < 0 AS c, re + im / (im - lead(im) OVER v) * (lead(re) OVER v - re) AS rc, f + im / (im - lead(im) OVER v) * (lead(f) OVER v - f) AS fc FROM z WINDOW v AS (PARTITION BY eis ORDER BY f)), g AS (SELECT eis, count(*) AS n, coalesce(arg_max(rc, f) FILTER (c), arg_min(re, (abs(im), f))) AS r_cross, coalesce(arg_max(fc, f) FILTER (c), arg_min(f, (abs(im), f))) AS f_cross, arg_min(re, f) AS r_tot, min(im) AS arc_peak, arg_min(f, (im, f)) AS f_peak FROM w GROUP BY eis) SELECT eis, n, round(r_cross, 4) AS r_cross, round(f_cross, 4) AS f_cross, round(r_tot, 4) AS r_tot, round(r_tot - r_cross, 4) AS r_pol, round(arc_peak, 4) AS arc_peak, round(f_peak, 4) AS f_peak FROM g"),
    "A33_roughness": Query(rough, f"WITH {_SP}, d AS (SELECT *, abs(re - lag(re) OVER (PARTITION BY eis ORDER BY f)) AS d FROM z) SELECT eis, round(avg(d) / nullif(median(abs(re)), 0), 5) AS roughness FROM d GROUP BY eis"),
    "A34_agreement": Query(agreement, "WITH x AS (SELECT l_partkey, avg(l_extendedprice / l_quantity) AS x FROM lineitem GROUP BY l_partkey) SELECT p_brand, round(median(abs(x - p_retailprice) / greatest(abs(x), abs(p_retailprice))), 5) AS agreement FROM part JOIN x ON p_partkey = l_partkey GROUP BY p_brand"),
    "A35_fit_summary": Query(fit_summary, "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_discount = 0 AS INT)) AS BIGINT) AS fails, round(avg(l_discount), 5) AS mean, round(median(l_discount), 5) AS median, max(l_discount) AS high, round(stddev_samp(l_discount), 5) AS std FROM lineitem GROUP BY l_returnflag"),
    "A36_leave_one_out": Query(leave_one_out, "SELECT a.s_suppkey AS i, round(median(b.s_acctbal), 4) AS borrowed FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY a.s_suppkey"),
    "W11_plateaus": Query(plateau, f"WITH {SAMPLES}, {BM}, p AS (SELECT *, sum(j) OVER (PARTITION BY cell ORDER BY us, seq) AS plateau FROM (SELECT *, CASE WHEN bm <> lag(bm) OVER w OR abs(seq - lag(seq) OVER w) > 1 OR abs(value - lag(value) OVER w) > 50 THEN 1 ELSE 0 END AS j FROM b WHERE kind = 'purchase' WINDOW w AS (PARTITION BY cell ORDER BY us, seq))) SELECT cell, CAST(plateau AS BIGINT) AS plateau, count(*) AS n FROM p GROUP BY cell, plateau"),
    "W12_blocks": Query(blocks, f"{_BL} SELECT cell, first_proc, last_proc, n, step, pauses_before FROM x"),
    "W13_block_soc": Query(block_soc, f"{_BL}, y AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0.0 ELSE step END AS l FROM x WINDOW w AS (PARTITION BY cell ORDER BY block)) SELECT cell, first_proc, round(CASE WHEN count(*) OVER (PARTITION BY cell) >= 2 AND count(l) OVER (PARTITION BY cell) = count(*) OVER (PARTITION BY cell) THEN 100.0 + 100 * sum(l) OVER (PARTITION BY cell ORDER BY block) / 1000.0 END, 4) AS soc FROM y"),
    "O8_pivot": Query(pivoted, f"WITH {SAMPLES} SELECT cell, " + ", ".join(f"nullif(count(*) FILTER (state = '{x}'), 0) AS {x}" for x in ("PAU", "PAUO", "CHA", "DCH", "EIS")) + " FROM s GROUP BY cell"),
    "O9_unroll": Query(unrolled, f"WITH {SAMPLES}, w AS (SELECT cell, max(value) AS high, min(value) AS low, CAST(count(*) AS DOUBLE) AS n FROM s GROUP BY cell) SELECT cell, name, value FROM (UNPIVOT w ON high, low, n INTO NAME name VALUE value)"),
    "O10_curves": Query(curves, "SELECT vec_id, CAST(i - 1 AS INT) AS i, round(CAST(embedding[i] AS DOUBLE), 5) AS x FROM embeddings, range(1, 9) r(i) WHERE vec_id < 50"),
    "O10_all_curves": Query(all_curves, "SELECT vec_id, CAST(i - 1 AS INT) AS i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"),
    "O1_custom_order": Query(custom_order, "SELECT c_nationkey, c_custkey, CAST(place AS INT) AS place FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END, c_acctbal NULLS LAST, c_custkey) AS place FROM customer) WHERE place <= 10"),
    "O5_union_missing": Query(union_missing, "WITH u AS (SELECT c_acctbal AS x, CAST(NULL AS VARCHAR) AS name FROM customer UNION ALL SELECT NULL, s_name FROM supplier) SELECT name IS NULL AS missing, count(*) AS n, round(sum(x), 2) AS x FROM u GROUP BY missing"),
    "S8_prefix_union": Query(prefix_union, "SELECT c_custkey AS name, CASE WHEN c_acctbal > 0 THEN 'new' ELSE 'old' END AS tag FROM customer"),
    "S11_name_parts": Query(names, "SELECT p_partkey, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', -1) AS last, CAST(len(string_split(p_name, ' ')) AS INT) AS n, TRY_CAST(nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') AS INT) AS number, contains(upper(p_type), 'BRASS') AS marked FROM part"),
    "P18_row_rules": Query(rules, f"WITH {SAMPLES} SELECT CASE WHEN value / 100 <= 0 OR value IS NULL THEN 'cNA' WHEN value / 100 >= 0.95 THEN CAST(CAST(round_even(value / 100, 0) AS INT) AS VARCHAR) || 'c' ELSE 'c' || CAST(CAST(round_even(1 / (value / 100), 0) AS INT) AS VARCHAR) END AS tag, CASE WHEN value >= 10 AND current > 0 THEN 'SOC_ADJUST' WHEN value >= 10 AND current < 0 THEN 'PREP' ELSE '-1' END AS weak, CAST(least(greatest(floor(log10(greatest(value, 0.1))), -1), 3) AS INT) AS decade, abs(value - 25) < 3 OR abs(value - 40) < 3 AS near, count(*) AS n FROM s GROUP BY ALL"),
    "P8_first_state_rows": Query(first_state_rows, f"WITH {SAMPLES} SELECT cell, count(*) AS n FROM (SELECT DISTINCT cell, us, state FROM s WHERE state NOT IN ('SAVE', 'REST')) GROUP BY cell"),
    "P10_excluded_ranges": Query(excluded_ranges, f"WITH {SAMPLES}, t AS (SELECT *, min(us) OVER (PARTITION BY cell) AS t0 FROM s) SELECT cell, count(*) AS n FROM t WHERE NOT (us > t0 AND us <= t0 + 259200000000) GROUP BY cell"),
    "S2_cell_gate": Query(cell_gate, f"WITH {SAMPLES} SELECT cell, count(*) AS n FROM s WHERE cell IN (SELECT cell FROM s WHERE contains(procedure, 'P3') AND value > 60) GROUP BY cell"),
    "A39_distinct_targets": Query(distinct_targets, f"WITH {SAMPLES} SELECT procedure, count(DISTINCT cell) AS n FROM s WHERE procedure IS NOT NULL GROUP BY procedure"),
}
