"""Queries of raw recordings, labels, cluster rules and incremental builds."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltaspan.operators import build, clusters, models, raw, rules, versions
from voltaspan.plans.base import CUT, SAMPLES, Query, contributed, mean_in_order, rounded, samples, shared_folder, table

PROTOCOL = clusters.Protocol(cap_rate=0.01, qocv_rate=0.02, pulse_seconds=90000.0, pulse_tolerance=1.0, qocv_tolerance=2.0)


def recorded(spark, sf_dir):
    """Events as raw recordings, under the names that those have."""
    kind, odd = F.col("kind"), F.col("seq") % 3 == 0
    state = F.when(odd & F.col("state").startswith("PAU"), F.concat("state", F.lit("**"))).otherwise(F.col("state"))
    return samples(spark, sf_dir).select(
        "cell", "seq", F.timestamp_micros("us").alias("Zeit"), F.col("value").alias("Spannung"), F.col("current").alias("Strom"), state.alias("State"), "procedure",
        F.when(kind == "error", F.col("value")).alias("Floater_Voltage"), F.when(kind == "view", F.col("value")).alias("Floater_T"), F.when(kind.isin("signup", "error") & (F.col("seq") % 2 == 0), F.col("value")).alias("EIS_f"), F.when(F.col("seq") % 5 == 0, F.col("value")).alias("AhAkku"),
    )


RAW = f"""WITH {SAMPLES}, r AS (SELECT cell, seq, us, value, current, procedure, CASE WHEN seq % 3 = 0 AND state IN ('PAU', 'PAUO') THEN state || '**' ELSE state END AS st,
 CASE WHEN kind = 'error' THEN value END AS fv, CASE WHEN kind = 'view' THEN value END AS ft, CASE WHEN kind IN ('signup', 'error') AND seq % 2 = 0 THEN value END AS ef, CASE WHEN seq % 5 = 0 THEN value END AS ah FROM s)"""


def narrowed(spark, sf_dir):
    rows = raw.narrowed(raw.renamed(recorded(spark, sf_dir)))
    return rows.select("cell", "seq", F.col("Voltage").cast("double").alias("voltage"), F.col("Current").cast("double").alias("current"))


def utc(spark, sf_dir):
    rows = raw.in_utc(raw.renamed(recorded(spark, sf_dir)), zone="+02:00")
    return rows.select("cell", "seq", F.unix_micros("Time_UTC").alias("utc_us"))


def power(spark, sf_dir):
    rows = raw.with_power(raw.renamed(recorded(spark, sf_dir)), placeholders=["target"])
    return rows.select("cell", "seq", F.col("Power").alias("power"), F.col("target").isNull().alias("open"))


def relabelled(spark, sf_dir):
    rows = raw.relabelled(recorded(spark, sf_dir).withColumn("State", raw.plain_state(F.col("State"))))
    return rows.select("cell", "seq", F.col("State").alias("state"))


def plausible(spark, sf_dir):
    return raw.plausible(recorded(spark, sf_dir), 80.0).groupBy("cell").agg(F.count("*").alias("n"))


def prepared(spark, sf_dir):
    rows = raw.prepared(recorded(spark, sf_dir), 80.0, zone="+02:00")
    return rows.groupBy("cell", F.col("State").alias("state")).agg(F.count("*").alias("n"), F.min(F.unix_micros("Time_UTC")).alias("first_us"))


def countable(spark, sf_dir):
    """Recordings without a current among those that have one: their rows stay and carry nothing."""
    rows = raw.renamed(recorded(spark, sf_dir))
    bare = raw.countable(rows.where("seq % 4 = 0").drop("Current"))
    both = rows.where("seq % 4 <> 0").unionByName(bare)
    return both.groupBy("cell").agg(F.count("*").alias("n"), F.count("Current").alias("counted"))


def projected(spark, sf_dir):
    rows = recorded(spark, sf_dir)
    stub = rows.select("cell", "seq", "Zeit", "procedure")
    found = raw.projected(rows.drop("procedure"), ["cell", "seq", "Time", "procedure", "Voltage"], stub)
    return found.select("cell", "seq", "procedure", F.col("Voltage").isNull().alias("open"))


def charge_on_rows(spark, sf_dir):
    rows = samples(spark, sf_dir)
    counted = build.built(rows.where("kind <> 'view'"), "cell", "kind", "us", "seq", "current", CUT)
    found = raw.with_charge(rows.select("cell", "us", "seq"), counted.select("cell", "us", "ah"), ["cell"], "us")
    return found.groupBy("cell").agg(F.count("*").alias("n"), F.count("ah").alias("counted"), rounded(F.max("ah"), 3).alias("ah"))


def segments(spark, sf_dir):
    """One row per cell and week, as segments: figures that labels go by."""
    of = mean_in_order(samples(spark, sf_dir), ["cell", "week"], ["seq", "us"], "current", "i", F.max("value").alias("high"), F.min("value").alias("low"), ((F.max("us") - F.min("us")) / 60e6).alias("minutes"), F.count("*").alias("n"), F.max("seq").alias("last"))
    names = ["full_charge_c20", "Pulse 3", "qOCV sweep", "partial_x", " rest", "mixed_c2", "CAP"]
    label = F.element_at(F.array(*map(F.lit, names)), (F.col("last") % 7 + 1).cast("int"))
    return of.select("*", label.alias("label"), (F.col("high") / 100).alias("spanned"), (F.abs("i") / 50).alias("rate"))


SEGMENTS = f"""WITH {SAMPLES}, g0 AS (SELECT cell, week, avg(current) AS i, max(value) AS high, min(value) AS low, (max(us) - min(us)) / 60000000.0 AS minutes, count(*) AS n, max(seq) AS last FROM s GROUP BY cell, week),
g AS (SELECT *, (['full_charge_c20', 'Pulse 3', 'qOCV sweep', 'partial_x', ' rest', 'mixed_c2', 'CAP'])[last % 7 + 1] AS label, high / 100 AS spanned, abs(i) / 50 AS rate FROM g0)"""
_TAG = "CASE WHEN rate IS NULL OR rate <= 0 THEN 'cNA' WHEN rate >= 0.95 THEN CAST(CAST(round_even(rate, 0) AS INT) AS VARCHAR) || 'c' ELSE 'c' || CAST(CAST(round_even(1 / rate, 0) AS INT) AS VARCHAR) END"


def temperature_mask(spark, sf_dir):
    return samples(spark, sf_dir).where(rules.near_any(F.col("current"), [25.0, 60.0], 3.0)).select("cell", "seq")


def leftover(spark, sf_dir):
    return segments(spark, sf_dir).select("cell", "week", rules.leftover_label(F.col("label"), F.col("i") / 20, F.col("high") / 100, F.col("low") / 100).alias("target"))


def canonical(spark, sf_dir):
    return segments(spark, sf_dir).select("cell", "week", rules.canonical_label(F.col("label"), F.col("spanned"), F.col("i"), F.col("rate"), cap_rate=0.4, qocv_rate=0.1, cap_tolerance=0.5).alias("target"))


def tagged(spark, sf_dir):
    rows = segments(spark, sf_dir)
    return rows.select("cell", "week", rules.tagged_label(F.col("label"), F.col("rate"), cap_rate=0.4, qocv_rate=0.1, cap_tolerance=0.5).alias("llm"), rules.tagged_class(F.col("label")).alias("class"))


def conditions(spark, sf_dir):
    """Conditions from names made of part attributes, by ending and by place."""
    size, brand = F.col("p_size").cast("string"), F.regexp_extract("p_brand", "([0-9]+)", 1)
    first = F.concat(F.lit("jri_Aging_"), size, F.lit("DOD_"), brand, F.lit("SOC_25grad_1C"))
    second = F.concat_ws("_", F.lit("x"), F.lit("Cyc"), F.lit("y"), F.lit("2C"), size, F.concat(F.lit("mean"), brand, F.lit("dod"), size))
    p = table(spark, sf_dir, "part").select("p_partkey", F.array(F.lit("RPT"), F.when(F.col("p_size") % 2 == 0, first).otherwise("other"), second).alias("names"))
    a, b = rules.aging_conditions(F.col("names")), rules.cycling_conditions(F.col("names"))
    return p.select("p_partkey", *[c.alias(f"a_{k}".lower()) for k, c in a.items()], *[c.alias(f"b_{k}".lower()) for k, c in b.items()])


def state_current(spark, sf_dir):
    return samples(spark, sf_dir).select("cell", "seq", rules.state_and_current(F.concat("state", F.lit("_x")), F.col("current")).alias("label"))


def degree_tags(spark, sf_dir):
    return samples(spark, sf_dir).select("cell", "seq", rules.degree_tag(F.when(F.col("kind") != "error", F.col("current"))).alias("tag"))


def symbols(spark, sf_dir):
    rate = F.element_at(F.array(*map(F.lit, ["05C", " 1c", "0.5", "1.0", "2C", "c/2"])), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", rules.rate_symbol(rate).alias("symbol"))


def manifest_procedures(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.concat_ws("=", F.lit("p"), F.col("o_custkey").cast("string"), F.col("o_orderdate").cast("string"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string"))
    return build.procedures_of(o.select(F.col("o_custkey").alias("cell"), name.alias("name"))).select("cell", F.concat_ws(";", "procedures").alias("procedures"))


def clustered(spark, sf_dir):
    """Segments with a cluster: by how long they last."""
    rows = segments(spark, sf_dir).withColumn("cluster", F.when(F.col("minutes") > 0, F.floor(F.col("minutes") / 1500)).otherwise(-1).cast("int"))
    return rows.withColumns({"current_mean": F.col("i") / 2000, "abs_current": F.abs(F.col("i")) / 2000})


def means(spark, sf_dir):
    return clustered(spark, sf_dir).groupBy("cell", "cluster").agg(
        F.count("*").alias("n"), F.avg("current_mean").alias("current_mean"), F.avg("abs_current").alias("abs_current"), F.avg("minutes").alias("minutes"), F.lit(0.0).alias("current_std"), F.lit(0.0).alias("voltage_min")
    )


MEANS = f"{SEGMENTS}, k AS (SELECT *, CASE WHEN minutes > 0 THEN CAST(floor(minutes / 1500) AS INT) ELSE -1 END AS cluster, i / 2000 AS cm, abs(i) / 2000 AS ca FROM g), m AS (SELECT cell, cluster, count(*) AS n, avg(cm) AS cm, avg(ca) AS ca, avg(minutes) AS minutes FROM k GROUP BY cell, cluster)"


def cluster_means(spark, sf_dir):
    found = clusters.cluster_means(clustered(spark, sf_dir), ["cell"], "cluster", ["minutes", "current_mean"])
    return found.select("cell", "cluster", "n", *[rounded(c, 6).alias(c) for c in found.columns[3:]])


def capacity_clusters(spark, sf_dir):
    return clusters.capacity_first(means(spark, sf_dir), ["cell"], PROTOCOL.cap_rate).select("cell", "cluster", "cap", "again")


def capacity_second(spark, sf_dir):
    return clusters.capacity_second(means(spark, sf_dir), ["cell"], 0.005, 1, 0).select("cell", "cluster", "cap", "merged")


def pulse_qocv(spark, sf_dir):
    return clusters.qocv_clusters(clusters.pulse_clusters(means(spark, sf_dir), PROTOCOL), ["cell"], PROTOCOL).select("cell", "cluster", "pulse", "qocv")


def labelled_segments(spark, sf_dir):
    flags = clusters.qocv_clusters(clusters.pulse_clusters(clusters.capacity_first(means(spark, sf_dir), ["cell"], PROTOCOL.cap_rate), PROTOCOL), ["cell"], PROTOCOL)
    return clusters.labelled(clustered(spark, sf_dir), flags, ["cell"])


def filtered_labels(spark, sf_dir):
    week = F.dense_rank().over(Window.partitionBy("cell").orderBy("week"))
    rows = labelled_segments(spark, sf_dir).withColumns({"bm": F.lit(0), "proc": week, "temperature": F.col("low"), "end_voltage": F.col("spanned"), "state": F.when(F.col("n") > 1, "CHA").otherwise("PAU"), "power": F.lit(0.0)})
    found = clusters.filtered(rows, targets=(5.0, 10.0), rate=0.005, top=0.5)
    return found.select("cell", "week", "target")


def reunited(spark, sf_dir):
    rows = labelled_segments(spark, sf_dir).select("cell", "week", "n", "target")
    return clusters.reunited(rows.where("n >= 3"), rows.where("n < 3").drop("target")).select("cell", "week", "target")


def two_layers(spark, sf_dir):
    """Segments by how long they last and their current, then what may be capacity tests by current."""
    rows = segments(spark, sf_dir).select(
        "cell", "week", (F.col("minutes") / 1500).alias("duration"), "minutes", (F.col("i") / 2000).alias("current_mean"), (F.abs("i") / 2000).alias("abs_current"), F.lit(0.0).alias("current_std"), F.lit(0.0).alias("voltage_min")
    )
    found = clusters.two_layers(rows, ["cell"], "week", 1, PROTOCOL, clusters.Layer(2), clusters.Layer(2))
    return found.select("cell", "week", "cluster", "cluster_id", "target")


def extended(spark, sf_dir):
    """The first weeks built, the later ones added: as if all were built at once. A file is a week."""
    rows = samples(spark, sf_dir).withColumn("early", F.col("week") < F.lit(1_706_000_000_000_000))
    old = build.built(rows.where("early"), "cell", "week", "us", "seq", "current", CUT)
    both, late = build.extended(old, rows.where("not early"), "cell", "week", "us", "seq", "current", CUT)
    found = both.groupBy("cell").agg(F.count("*").alias("n"), F.round(F.max_by("ah", "us"), 3).alias("ah"))
    return found.join(late.groupBy("cell").agg(F.count("*").alias("late")), "cell", "left").select("cell", "n", "ah", F.coalesce("late", F.lit(0)).alias("late"))


def committed(spark, sf_dir):
    """Two versions: the second brings weeks between those of the first, so cells with late rows are
    built anew. A file is a week of a cell, a program a procedure."""
    rows = samples(spark, sf_dir).withColumns({"file": F.concat_ws("=", "cell", "week"), "program": F.col("procedure")})
    store = versions.Store(spark, f"{shared_folder(spark)}/builds-{uuid.uuid4().hex}")
    even = F.floor(F.col("week") / F.lit(7 * 86_400_000_000)) % 2 == 0
    for part in (rows.where(even), rows):
        versions.update(store, part, "cell", "file", "program", "us", "seq", "current", CUT)
    numbers = store.table("programs").groupBy("cell").agg(F.max("bm").alias("last_bm"))
    found = store.table("rows").groupBy("cell").agg(F.count("*").alias("n"), F.round(F.max_by("ah", "us"), 3).alias("ah"))
    return found.join(numbers, "cell").select("cell", "n", "ah", "last_bm", F.lit(store.current().number).alias("version"))


def provisional(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("done", F.col("week") < F.lit(1_706_000_000_000_000))
    table_ = build.built(rows.where("done"), "cell", "week", "us", "seq", "current", CUT)
    found = build.provisional(table_, rows.where("not done"), "cell", "week", "us", "seq", "current", CUT)
    return found.select("cell", F.round("ah", 3).alias("ah"), F.col("last").alias("last_us"), "current")


def diluted(spark, sf_dir):
    return build.diluted(samples(spark, sf_dir), "cell", "kind", "us", "seq", "current", CUT).select("cell", "n", F.round("ah", 3).alias("ah"))


def pending_files(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat("o_orderkey", F.lit("="), "o_orderstatus", F.when(F.col("o_orderstatus") == "O", "=unfinished").otherwise("")).alias("name"), "o_totalprice")
    return build.pending(o, o.where("o_totalprice > 200000")).select("name")


def stub_rows(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("file", F.concat_ws("-", "cell", "week"))
    return build.stubs(rows, "file", ["us", "seq"], F.coalesce(F.col("procedure") == "P1", F.lit(False))).groupBy("cell").agg(F.count("*").alias("n"))


def capacities(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cell"), F.col("o_totalprice").alias("capacity"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate").cast("date").cast("string")).otherwise("soon").alias("start"), "o_orderpriority")
    names = o.select("cell", F.concat_ws("=", F.lit("a"), F.lit("b"), F.lit("c"), "o_orderpriority").alias("name")).distinct()
    found = build.capacity_table(o, build.procedures_of(names))
    return found.select("Name", "capacity", F.size("procedures").alias("n_procedures"), F.unix_micros("Time").alias("time_us"))


def bundle_starts(spark, sf_dir):
    found = build.block_starts(samples(spark, sf_dir).withColumn("t", F.when(F.col("kind") == "click", F.floor("value"))), ["cell", "procedure"], "us", "t")
    return found.select("cell", "procedure", F.col("start").alias("start_us"), "temperature")


def report_blocks(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = c.where("c_custkey % 3 = 0").withColumn("run", F.lit("new"))
    return build.merged_blocks(new, c.withColumn("run", F.lit("old")), ["c_custkey"]).groupBy("run").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"))


def report_lengths(spark, sf_dir):
    c = table(spark, sf_dir, "supplier").withColumn("class", rules.status_class(F.col("s_acctbal")))
    html = build.status_report(c, ["s_suppkey", "s_name"], "class", ["s_suppkey"], "Suppliers")
    return html.select(F.length("html").cast("long").alias("n_chars"), F.sha2("html", 256).alias("sha"))


def first_objects(spark, sf_dir):
    text = F.concat(F.lit("said: "), "props", F.lit(' and {"then": "}"}'))
    return table(spark, sf_dir, "events").select("event_id", build.first_object(text).alias("found"))


def held_out_forest(spark, sf_dir):
    rows = segments(spark, sf_dir).withColumn("target", F.when(F.col("i") > 0, "CHA").otherwise("DCH"))
    return models.held_out(rows, ["high", "low", "minutes", "i"], "target", "cell", trees=300, folds=2, depth=4).select("cell", "week", "target", "predicted")


def centred(spark, sf_dir):
    rows = segments(spark, sf_dir)
    return models.centred(rows, ["high", "low", "minutes"], 4).select("cell", "week", "cluster", "silhouette", "outlier")


_EXTENDED = f"WITH {SAMPLES}, x AS (SELECT cell, week, us, max(seq) AS seq, arg_max(current, seq) AS current FROM s GROUP BY cell, week, us), {contributed('cell, week', 'x')}"

QUERIES = {
    "P2_narrowed": Query(narrowed, f"{RAW} SELECT cell, seq, CAST(CAST(value AS FLOAT) AS DOUBLE) AS voltage, CAST(CAST(current AS FLOAT) AS DOUBLE) AS current FROM r"),
    "P3_in_utc": Query(utc, f"{RAW} SELECT cell, seq, us - 7200000000 AS utc_us FROM r"),
    "P4_power": Query(power, f"{RAW} SELECT cell, seq, current * value AS power, true AS open FROM r"),
    "P6_relabelled": Query(relabelled, f"{RAW} SELECT cell, seq, CASE WHEN ef IS NOT NULL AND ah IS NULL THEN 'EIS' WHEN fv IS NOT NULL OR ft IS NOT NULL THEN 'FLOATER' WHEN st LIKE 'PAU%**' THEN left(st, length(st) - 2) ELSE st END AS state FROM r"),
    "P7_plausible": Query(plausible, f"{RAW} SELECT cell, count(*) AS n FROM r WHERE fv IS NULL OR fv <= 84 GROUP BY cell"),
    "P5_prepared": Query(
        prepared,
        f"{RAW} SELECT cell, CASE WHEN ef IS NOT NULL AND ah IS NULL THEN 'EIS' WHEN fv IS NOT NULL OR ft IS NOT NULL THEN 'FLOATER' WHEN st LIKE 'PAU%**' THEN left(st, length(st) - 2) ELSE st END AS state, count(*) AS n, min(us) - 7200000000 AS first_us FROM r WHERE fv IS NULL OR fv <= 84 GROUP BY ALL",
    ),
    "P32_countable": Query(countable, f"{RAW} SELECT cell, count(*) AS n, count(*) FILTER (seq % 4 <> 0 AND current IS NOT NULL) AS counted FROM r GROUP BY cell"),
    "S27_projected": Query(projected, f"{RAW} SELECT cell, seq, procedure, true AS open FROM r"),
    "J3_charge_on_rows": Query(
        charge_on_rows,
        f"WITH {SAMPLES}, x AS (SELECT cell, kind, us, max(seq) AS seq, arg_max(current, seq) AS current FROM s WHERE kind <> 'view' GROUP BY cell, kind, us), {contributed('cell, kind', 'x')}, h AS (SELECT cell, us, sum(contrib) AS q FROM c GROUP BY cell, us), a AS (SELECT *, sum(q) OVER (PARTITION BY cell ORDER BY us) AS ah FROM h) SELECT cell, count(*) AS n, count(ah) AS counted, round(max(ah), 3) AS ah FROM s LEFT JOIN a USING (cell, us) GROUP BY cell",
    ),
    "P15_temperature_mask": Query(temperature_mask, f"WITH {SAMPLES} SELECT cell, seq FROM s WHERE abs(current) > 22 AND abs(current) < 28 OR abs(current) > 57 AND abs(current) < 63"),
    "P17_leftover_labels": Query(
        leftover,
        f"{SEGMENTS} SELECT cell, week, CASE WHEN label IN ('CAP', 'PUL', 'PUL*RES', 'qOCV_DCH', 'qOCV_CHA', '-1') THEN label WHEN abs(i / 20) >= 0.1 AND i > 0 AND high / 100 > 0.95 THEN 'PREP_CHA' WHEN abs(i / 20) >= 0.1 AND (i > 0 AND high / 100 <= 0.95 OR i < 0 AND low / 100 > 0.05) THEN 'SOC_ADJUST' ELSE '-1' END AS target FROM g",
    ),
    "P19_canonical_labels": Query(
        canonical,
        f"{SEGMENTS}, t AS (SELECT *, trim(label) AS l, {_TAG} AS tag FROM g) SELECT cell, week, CASE WHEN lower(l) LIKE '%pulse%' THEN 'pulse' WHEN NOT (l LIKE 'full\\_%' ESCAPE '\\' OR l LIKE 'partial\\_%' ESCAPE '\\' OR l LIKE 'mixed\\_%' ESCAPE '\\' OR lower(l) LIKE '%qocv%') THEN l WHEN spanned >= 0.9 AND rate <= 0.1 * 1.2 THEN 'qocv' WHEN spanned >= 0.9 AND i <= 0 AND rate BETWEEN 0.4 * 0.5 AND 0.4 * 1.5 THEN 'cap' WHEN spanned >= 0.9 THEN (CASE WHEN i > 0 THEN 'full_charge_' ELSE 'full_discharge_' END) || tag ELSE (CASE WHEN i > 0 THEN 'partial_cha_' ELSE 'partial_dch_' END) || tag END AS target FROM t",
    ),
    "P20_tagged_labels": Query(
        tagged,
        f"{SEGMENTS} SELECT cell, week, CASE WHEN lower(label) LIKE '%pulse%' THEN 'PUL*' WHEN lower(label) LIKE '%qocv%' THEN 'QOCV*' WHEN lower(label) = 'cap' THEN 'CAP*' WHEN lower(label) LIKE '%full_charge%' AND rate <= 0.1 * 1.2 THEN 'QOCV*' ELSE label END AS llm, CASE label WHEN 'CAP' THEN 'CAP*' END AS class FROM g",
    ),
    "P21_conditions": Query(
        conditions,
        "WITH p AS (SELECT p_partkey, CAST(p_size AS INT) AS z, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS b FROM part) SELECT p_partkey, CASE WHEN z % 2 = 0 THEN z END AS a_dod, CASE WHEN z % 2 = 0 THEN b END AS a_soc, CASE WHEN z % 2 = 0 THEN 25 END AS a_temperature, CASE WHEN z % 2 = 0 THEN '1C' END AS a_c_rate, z AS b_dod, b AS b_soc, '2C' AS b_c_rate, z AS b_temperature FROM p",
    ),
    "P25_state_and_current": Query(state_current, f"WITH {SAMPLES} SELECT cell, seq, (CASE WHEN state IN ('CHA', 'DCH') THEN state ELSE state || '_x' END) || '/' || printf('%.1f', current) AS label FROM s"),
    "P29_degree_tags": Query(degree_tags, f"WITH {SAMPLES} SELECT cell, seq, CASE WHEN kind = 'error' OR current IS NULL THEN 'NAdegreeC' ELSE printf('%.0f', current) || 'degreeC' END AS tag FROM s"),
    "P34_rate_symbols": Query(symbols, "SELECT c_custkey, CASE c_custkey % 6 WHEN 1 THEN 'square' WHEN 3 THEN 'square' WHEN 4 THEN 'diamond' ELSE 'circle' END AS symbol FROM customer"),
    "P35_manifest_procedures": Query(manifest_procedures, "SELECT o_custkey AS cell, string_agg(o_orderpriority, ';' ORDER BY 'p=' || o_custkey || '=' || CAST(CAST(o_orderdate AS TIMESTAMP) AS VARCHAR) || '=' || o_orderpriority || '=' || o_orderkey) AS procedures FROM orders GROUP BY o_custkey"),
    "A9_cluster_means": Query(
        cluster_means, f"{MEANS} SELECT cell, cluster, count(*) AS n, round(avg(minutes), 6) AS minutes_mean, round(stddev_samp(minutes), 6) AS minutes_std, round(avg(cm), 6) AS current_mean_mean, round(stddev_samp(cm), 6) AS current_mean_std FROM k GROUP BY cell, cluster"
    ),
    "M2_capacity_clusters": Query(
        capacity_clusters,
        f"{MEANS}, f AS (SELECT *, abs(cm) > 0.009 AND abs(cm) < 0.011 AND cm < 0 AND minutes > 4800 AND minutes < 7200 AS clean, CASE WHEN cluster >= 0 AND minutes > 4200 AND minutes < 7800 THEN abs(ca - 0.01) END AS d FROM m), h AS (SELECT *, NOT bool_or(clean) OVER (PARTITION BY cell) AND d IS NOT NULL AND row_number() OVER (PARTITION BY cell ORDER BY d NULLS LAST, cluster) = 1 AS again FROM f) SELECT cell, cluster, clean OR again AS cap, again FROM h",
    ),
    "M2_second_layer": Query(
        capacity_second,
        f"{MEANS}, f AS (SELECT *, CASE WHEN cluster >= 0 AND cm < 0 AND abs(cm) > 0.00475 AND abs(cm) < 0.00525 THEN abs(abs(cm) - 0.005) END AS d FROM m), h AS (SELECT *, d IS NOT NULL AND row_number() OVER (PARTITION BY cell ORDER BY d NULLS LAST, cluster) = 1 AS cap FROM f) SELECT cell, cluster, cap, cap AND n > 1 AS merged FROM h",
    ),
    "M3_pulse_and_qocv": Query(
        pulse_qocv,
        f"{MEANS}, f AS (SELECT *, CASE WHEN cluster >= 0 AND minutes <= 6000 THEN abs(minutes - 3000) END AS d FROM m) SELECT cell, cluster, cluster >= 0 AND minutes < 1500 AS pulse, d IS NOT NULL AND row_number() OVER (PARTITION BY cell ORDER BY d NULLS LAST, cluster) = 1 AS qocv FROM f",
    ),
    "M4_filtered_labels": Query(filtered_labels),
    "M5_reunited_segments": Query(reunited),
    "M5_two_layers": Query(two_layers),
    "T1_extended_build": Query(extended, f"{_EXTENDED} SELECT cell, count(DISTINCT us) AS n, round(sum(contrib), 3) AS ah, 0 AS late FROM c GROUP BY cell"),
    "T1_committed_build": Query(
        committed,
        f"{_EXTENDED} SELECT cell, n, ah, last_bm, CAST(2 AS INT) AS version FROM (SELECT cell, count(DISTINCT us) AS n, round(sum(contrib), 3) AS ah FROM c GROUP BY cell) JOIN (SELECT cell, count(DISTINCT procedure) - 1 AS last_bm FROM s GROUP BY cell) USING (cell)",
    ),
    "T2_provisional_state": Query(provisional, f"{_EXTENDED} SELECT cell, round(sum(contrib), 3) AS ah, max(us) AS last_us, arg_max(current, (us, seq)) AS current FROM c GROUP BY cell"),
    "A44_diluted_charge": Query(diluted, f"WITH {SAMPLES}, x AS (SELECT cell, kind, us, max(seq) AS seq, arg_max(current, seq) AS current FROM s GROUP BY cell, kind, us), {contributed('cell', 'x')} SELECT cell, count(*) AS n, round(sum(contrib), 3) AS ah FROM c GROUP BY cell"),
    "S22_pending_files": Query(pending_files, "SELECT o_orderkey || '=' || o_orderstatus AS name FROM orders WHERE o_orderstatus <> 'O' AND o_totalprice <= 200000"),
    "S28_stub_rows": Query(stub_rows, f"WITH {SAMPLES}, n AS (SELECT *, row_number() OVER (PARTITION BY cell, week ORDER BY us, seq) AS k FROM s) SELECT cell, count(*) AS n FROM n WHERE k = 1 OR procedure = 'P1' GROUP BY cell"),
    "A21_capacity_table": Query(capacities, "SELECT CAST(o_custkey AS VARCHAR) AS Name, o_totalprice AS capacity, CAST(count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS INT) AS n_procedures, CASE WHEN o_orderkey % 3 <> 0 THEN epoch_us(CAST(o_orderdate AS DATE)) END AS time_us FROM orders"),
    "A29_bundle_starts": Query(bundle_starts, f"WITH {SAMPLES} SELECT cell, procedure, min(us) AS start_us, round_even(avg(CASE WHEN kind = 'click' THEN floor(value) END), 2) AS temperature FROM s GROUP BY cell, procedure"),
    "F9_first_objects": Query(first_objects, "SELECT event_id, props AS found FROM events"),
    "M6_held_out_forest": Query(held_out_forest),
    "M7_centred_clusters": Query(centred),
    "S18_merged_blocks": Query(report_blocks, "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS run, count(*) AS n, min(c_custkey) AS first, max(c_custkey) AS last FROM customer GROUP BY 1"),
    "S19_status_report": Query(
        report_lengths,
        "WITH h AS (SELECT '<h1>Suppliers</h1>' || chr(10) || '<table>' || chr(10) || '<tr><th>s_suppkey</th><th>s_name</th></tr>' || chr(10) || string_agg('<tr class=\"' || (CASE WHEN s_acctbal IS NULL THEN '' WHEN s_acctbal < 60 THEN 'red' WHEN s_acctbal < 70 THEN 'amber' ELSE 'ok' END) || '\"><td>' || s_suppkey || '</td><td>' || coalesce(s_name, '') || '</td></tr>', chr(10) ORDER BY s_suppkey) || chr(10) || '</table>' AS html FROM supplier) SELECT length(html) AS n_chars, sha256(html) AS sha FROM h",
    ),
}
