"""Row rules, labels, lookups and summaries: operators bound to the tables, each with SQL of its own.

In the SQL ``{s}`` stands for the samples, ``{orders}`` and the like for tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltaspan.operators import rules
from voltaspan.plans.base import SAMPLES, Query, mean_in_order, rounded, samples, table

SEGMENT, TIME = ["cell", "week"], ["us", "seq"]


def plain(text: str) -> str:
    """A statement for DuckDB, over the sample table's SQL where it uses that."""
    out = re.sub(r"\{(\w+)\}", r"\1", text)
    if "{s}" in text:
        return f"WITH {SAMPLES}, {out[5:]}" if out.startswith("WITH ") else f"WITH {SAMPLES} {out}"
    return out


def selected(name: str, *columns: str | Column, where: Callable[[], Column] | None = None, **made: Callable[[], Column]):
    """A query of a table (``s``: the samples): columns as they are, columns made, rows kept."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = samples(spark, sf_dir) if name == "s" else table(spark, sf_dir, name)
        rows = rows if where is None else rows.where(where())
        return rows.select(*columns, *[f().alias(k) for k, f in made.items()])

    return run


def qocv_guard(spark, sf_dir):
    of = mean_in_order(samples(spark, sf_dir), SEGMENT, ["seq", "us"], "current", "mean", F.stddev_samp("current").alias("spread"))
    return of.select(*SEGMENT, rules.qocv_target(F.col("mean"), F.col("spread"), 50, 40, 60).alias("target"))


def pulse_resistance(spark, sf_dir):
    dv = F.col("value") - F.lag("value").over(Window.partitionBy(*SEGMENT).orderBy(*TIME))
    rows = samples(spark, sf_dir).withColumn("dv", dv).where((F.col("kind") == "purchase") & (F.abs("current") > 0.5) & F.col("dv").isNotNull())
    return rows.select("cell", "seq", F.round(F.abs("dv") / F.abs("current"), 6).alias("r"))


def any_all_flags(spark, sf_dir):
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return samples(spark, sf_dir).groupBy(*SEGMENT).agg(
        F.min(flag(F.col("state").isin("PAU", "PAUO"))).alias("pure_pause"), F.max(flag(F.col("state") == "EIS")).alias("any_eis"), F.max(flag(F.col("procedure").isNull())).alias("any_null")
    )


def two_way_matrix(spark, sf_dir):
    mean, spread = F.avg("value"), F.stddev_samp("value")
    ratio = spread / F.nullif(mean, F.lit(0))
    return samples(spark, sf_dir).groupBy("procedure", "kind").agg(F.count("*").alias("n"), F.round(mean, 4).alias("mean"), F.round(spread, 4).alias("spread"), F.round(ratio, 5).alias("ratio"))


def reason_counts(spark, sf_dir):
    reason = F.concat_ws(";", F.when(F.col("l_discount") == 0, "r"), F.when(F.col("l_tax") == 0, "t"))
    return table(spark, sf_dir, "lineitem").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def branch_vote(spark, sf_dir):
    box = table(spark, sf_dir, "lineitem").where(F.col("l_quantity").between(10, 12)).select("l_suppkey", F.col("l_extendedprice").alias("g"))
    tops = box.groupBy("l_suppkey").agg(F.max("g").alias("top"))
    tall = box.join(tops, "l_suppkey").where(F.col("g") >= 0.95 * F.col("top")).groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return tall.select("l_suppkey", F.least(F.greatest(F.col("n"), F.lit(1)), F.lit(2)).alias("branches"))


def distinct_procedures(spark, sf_dir):
    return samples(spark, sf_dir).select("procedure").distinct().where(F.col("procedure").isNotNull())


def parameter_summary(spark, sf_dir):
    x = F.col("l_tax")
    railed = ((x == 0) | (x >= 0.08)).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("spread"), F.min(x).alias("low"), F.max(x).alias("high"), F.round(F.avg(F.coalesce(railed, F.lit(0))), 6).alias("railed")
    )


def first_target(spark, sf_dir):
    return samples(spark, sf_dir).groupBy(*SEGMENT).agg(F.min_by("kind", F.struct(*TIME)).alias("target"))


def window_temperature(spark, sf_dir):
    return samples(spark, sf_dir).groupBy(*SEGMENT).agg(F.round(F.avg(F.when(F.col("kind") == "click", F.col("value"))), 4).alias("temperature"))


def sweep_summary(spark, sf_dir):
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("value")))
    return samples(spark, sf_dir).groupBy("cell").agg(of("click").alias("cha"), of("purchase").alias("dch"), F.round(F.avg("value"), 4).alias("mean"))


def run_duration_back(spark, sf_dir):
    """Spans are made once per group and joined back; nulls of a key meet each other."""
    rows, keys = samples(spark, sf_dir), [*SEGMENT, "kind"]
    spans = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg((F.max("us") - F.min("us")).alias("span_us"))
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = one if same is None else same & one
    return rows.join(spans, same, "left").select("cell", "seq", "span_us")


def plateau_lookup(spark, sf_dir):
    levels = table(spark, sf_dir, "nation").where("n_regionkey < 4").select(F.col("n_nationkey").alias("s_nationkey"), (F.col("n_regionkey") * 20).alias("soc"))
    return table(spark, sf_dir, "supplier").join(levels, "s_nationkey", "left").select("s_suppkey", "s_acctbal", "soc")


def fill_from_previous(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_mktsegment").alias("old"))
    rows = c.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("seg")).join(old, "c_custkey", "left")
    return rows.select("c_custkey", rules.coalesced(F.col("seg"), F.col("old")).alias("seg"))


def capacity_rule(spark, sf_dir):
    of = mean_in_order(samples(spark, sf_dir), SEGMENT, ["seq", "us"], "current", "i", ((F.max("us") - F.min("us")) / 60e6).alias("minutes"))
    lasting = lambda low, high: ((F.col("i") < 0) & F.col("minutes").between(low, high)).cast("int")
    marked = of.withColumns({"hit": lasting(5000, 9000), "loose": lasting(3000, 11000)})
    hits = F.sum("hit").over(Window.partitionBy("cell"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy((F.col("loose") == 1).desc(), F.abs(F.abs("i") - 20), "week"))
    return marked.withColumns({"hits": hits, "place": place}).select(*SEGMENT, F.when(F.col("hits") > 0, F.col("hit")).when(F.col("place") == 1, F.col("loose")).otherwise(0).alias("cap"))


def demoted_labels(spark, sf_dir):
    has = lambda kind: F.max((F.col("kind") == kind).cast("int")) == 1
    of = mean_in_order(samples(spark, sf_dir), SEGMENT, ["seq", "us"], "value", "t", has("purchase").alias("cap"), has("signup").alias("pul"))
    return of.select(*SEGMENT, F.when(F.col("cap") & F.col("pul") & (F.col("t") > 20), "CAP").when(F.col("pul"), "PUL").otherwise("-1").alias("target"))


def closest(spark, sf_dir):
    """The smallest distance per cell comes from a partial aggregation; no cell is sorted."""
    return samples(spark, sf_dir).groupBy("cell").agg(F.min_by("seq", F.struct(F.abs(F.col("value") - 50), "seq")).alias("seq"))


def ladder(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("cell").orderBy(*TIME)) - 1
    return samples(spark, sf_dir).where("kind = 'purchase'").select("cell", "seq", rules.descending_soc(place, 10).cast("long").alias("soc"))


def true_range(spark, sf_dir):
    """The voltage before, from 0 to 500: up to the top for charging, down to the bottom else."""
    before = F.lag("value").over(Window.partitionBy("cell").orderBy(*TIME))
    rows = samples(spark, sf_dir).withColumn("before", before)
    return rows.select("cell", "seq", F.round(rules.true_range(F.col("value"), F.col("before"), F.col("current"), 0.0, 500.0), 6).alias("range"))


def derived(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", rounded(price / 300000, 6).alias("cap_norm"), rounded(rules.equivalent_cycles(price, 3.0), 4).alias("efc"), rules.name_field(F.col("o_orderpriority"), 1, "-").alias("prefix"))


def neighbour_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("bm"), F.col("event_id").alias("proc"))
    return rules.with_neighbours(rows, "proc").select("id", "next")


def text_targets(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.col("toxic").cast("string").alias("target")).dropna()


def tail_row(spark, sf_dir):
    last = F.max_by(F.struct("us", "procedure"), F.struct(*TIME)).alias("last")
    return samples(spark, sf_dir).groupBy("cell").agg(last).select("cell", "last.us", "last.procedure")


def skip_existing(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


def sweep_catalogue(spark, sf_dir):
    rows = samples(spark, sf_dir).where(F.col("kind").isin("click", "purchase"))
    return rows.groupBy(*SEGMENT, F.col("kind").alias("direction")).agg(F.min("us").alias("first_us"))


def replace_unfinished(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    found = rules.first_of(o, ["o_custkey", "o_orderdate"], [F.col("o_orderstatus") == "O", "o_orderkey"])
    return found.select("o_orderkey", "o_custkey", "o_orderstatus")


def one_per_id(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("l_linenumber"))


def charge_rest_discharge(spark, sf_dir):
    rows = samples(spark, sf_dir).select("cell", "seq", "us", "state")
    return rules.followed_by(rows, ["cell"], TIME, "state", [("CHA",), ("PAU", "PAUO"), ("DCH",)]).select("cell", "seq")


RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "A11_qocv_guard": qocv_guard,
    "A12_pulse_resistance": pulse_resistance,
    "A16_any_all_flags": any_all_flags,
    "A19_two_way_matrix": two_way_matrix,
    "A31_reason_counts": reason_counts,
    "A32_branch_vote": branch_vote,
    "A38_distinct_procedures": distinct_procedures,
    "A40_parameter_summary": parameter_summary,
    "A42_first_target": first_target,
    "A43_window_temperature": window_temperature,
    "A45_sweep_summary": sweep_summary,
    "J2_run_duration_back": run_duration_back,
    "J18_plateau_lookup": plateau_lookup,
    "J23_fill_from_previous": fill_from_previous,
    "M2_capacity_rule": capacity_rule,
    "M4_demoted_labels": demoted_labels,
    "O3_closest": closest,
    "O7_coalesced_columns": selected("customer", k=lambda: F.col("c_custkey"), x=lambda: rules.coalesced(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), F.col("c_nationkey").cast("double"))),
    "O_SOC3_ladder": ladder,
    "P9_substring_any": selected("part", "p_partkey", where=lambda: rules.contains_any(F.col("p_type"), "STEEL") | rules.contains_any(F.col("p_brand"), "1") | rules.contains_any(F.col("p_name"), "q")),
    "P11_cell_selection": selected("customer", "c_custkey", "c_name", where=lambda: rules.chosen_cell(F.col("c_name"), "Customer", ["7", "3"])),
    "P12_normalised": selected(
        "s", "cell", "seq", v=lambda: F.round(rules.scaled_voltage(F.col("value"), 2.5, 4.2), 6), i=lambda: F.round(rules.scaled_current(F.col("current"), 3.0), 6), p=lambda: F.round(rules.scaled_power(F.col("value") * F.col("current"), 3.6, 3.0), 5)
    ),
    "P14_true_range": true_range,
    "P16_rate_mask": selected("s", "cell", "seq", where=lambda: rules.rate_near(F.col("current"), 50.0)),
    "P22_derived": derived,
    "P23_neighbour_ids": neighbour_ids,
    "P24_current_state": selected("s", "cell", "seq", step=lambda: rules.current_state(F.col("current"))),
    "P27_amplitude_list": selected("s", "cell", "seq", where=lambda: rules.amplitude_in(F.col("current"), [20, 80])),
    "P28_status_class": selected("customer", "c_custkey", **{"class": lambda: rules.status_class(F.col("c_acctbal"))}),
    "P30_decade": selected("lineitem", "l_orderkey", "l_linenumber", decade=lambda: rules.place_among(F.col("l_extendedprice"), [3, 30, 300, 3000, 30000, 300000])),
    "P33_capacity_reference": selected("customer", "c_custkey", capacity=lambda: F.round(rules.capacity_reference(F.col("c_acctbal"), 3.0), 4)),
    "P36_targets_as_text": text_targets,
    "S4_tail_row": tail_row,
    "S21_skip_existing": skip_existing,
    "S26_sweep_catalogue": sweep_catalogue,
    "T4_replace_unfinished": replace_unfinished,
    "W14_one_per_id": one_per_id,
    "W20_charge_rest_discharge": charge_rest_discharge,
}

SQL = {
    "A11_qocv_guard": "SELECT cell, week, CASE WHEN abs(abs(avg(current)) - 50) <= 40 AND stddev_samp(current) < 60 THEN CASE WHEN avg(current) > 0 THEN 'qOCV_CHA' ELSE 'qOCV_DCH' END ELSE '-1' END AS target FROM {s} GROUP BY cell, week",
    "A12_pulse_resistance": "WITH p AS (SELECT *, value - lag(value) OVER (PARTITION BY cell, week ORDER BY us, seq) AS dv FROM {s}) SELECT cell, seq, round(abs(dv) / abs(current), 6) AS r FROM p WHERE kind = 'purchase' AND abs(current) > 0.5 AND dv IS NOT NULL",
    "A16_any_all_flags": "SELECT cell, week, min(CASE WHEN state IN ('PAU', 'PAUO') THEN 1 ELSE 0 END) AS pure_pause, max(CASE WHEN state = 'EIS' THEN 1 ELSE 0 END) AS any_eis, max(CASE WHEN procedure IS NULL THEN 1 ELSE 0 END) AS any_null FROM {s} GROUP BY cell, week",
    "A19_two_way_matrix": "SELECT procedure, kind, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS spread, round(stddev_samp(value) / nullif(avg(value), 0), 5) AS ratio FROM {s} GROUP BY procedure, kind",
    "A31_reason_counts": "SELECT CASE WHEN l_discount = 0 AND l_tax = 0 THEN 'r;t' WHEN l_discount = 0 THEN 'r' WHEN l_tax = 0 THEN 't' ELSE '' END AS reason, count(*) AS n FROM {lineitem} GROUP BY 1",
    "A32_branch_vote": "WITH m AS (SELECT l_suppkey, l_extendedprice AS g, max(l_extendedprice) OVER (PARTITION BY l_suppkey) AS top FROM {lineitem} WHERE l_quantity BETWEEN 10 AND 12), c AS (SELECT l_suppkey, count(*) AS n FROM m WHERE g >= 0.95 * top GROUP BY l_suppkey) SELECT l_suppkey, CASE WHEN n < 1 THEN 1 WHEN n > 2 THEN 2 ELSE n END AS branches FROM c",
    "A38_distinct_procedures": "SELECT DISTINCT procedure FROM {s} WHERE procedure IS NOT NULL",
    "A40_parameter_summary": "SELECT l_linestatus, round(avg(l_tax), 6) AS mean, round(stddev_samp(l_tax), 6) AS spread, min(l_tax) AS low, max(l_tax) AS high, round(avg(CASE WHEN l_tax = 0 OR l_tax >= 0.08 THEN 1 ELSE 0 END), 6) AS railed FROM {lineitem} GROUP BY l_linestatus",
    "A42_first_target": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY cell, week ORDER BY us, seq) AS n FROM {s}) SELECT cell, week, kind AS target FROM n WHERE n = 1",
    "A43_window_temperature": "SELECT cell, week, round(avg(CASE WHEN kind = 'click' THEN value END), 4) AS temperature FROM {s} GROUP BY cell, week",
    "A45_sweep_summary": "SELECT cell, max(CASE WHEN kind = 'click' THEN value END) AS cha, max(CASE WHEN kind = 'purchase' THEN value END) AS dch, round(avg(value), 4) AS mean FROM {s} GROUP BY cell",
    "J2_run_duration_back": "SELECT cell, seq, max(us) OVER (PARTITION BY cell, week, kind) - min(us) OVER (PARTITION BY cell, week, kind) AS span_us FROM {s}",
    "J18_plateau_lookup": "WITH f AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM {supplier}), p AS (SELECT n_nationkey, n_regionkey * 20 AS soc FROM {nation} WHERE n_regionkey < 4) SELECT s_suppkey, s_acctbal, soc FROM f LEFT JOIN p ON s_nationkey = n_nationkey",
    "J23_fill_from_previous": "WITH o AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS seg FROM {customer}), p AS (SELECT c_custkey, c_mktsegment AS old FROM {customer} WHERE c_custkey % 2 = 0) SELECT o.c_custkey, coalesce(seg, old) AS seg FROM o LEFT JOIN p ON o.c_custkey = p.c_custkey",
    "M2_capacity_rule": "WITH f AS (SELECT cell, week, avg(current) AS i, stddev_samp(current) AS sd, (max(us) - min(us)) / 60000000.0 AS minutes FROM {s} GROUP BY cell, week), m AS (SELECT *, CASE WHEN i < 0 AND minutes BETWEEN 5000 AND 9000 THEN 1 ELSE 0 END AS hit, CASE WHEN i < 0 AND minutes BETWEEN 3000 AND 11000 THEN 1 ELSE 0 END AS loose FROM f), k AS (SELECT *, sum(hit) OVER (PARTITION BY cell) AS hits, row_number() OVER (PARTITION BY cell ORDER BY CASE WHEN loose = 1 THEN 0 ELSE 1 END, abs(abs(i) - 20), week) AS place FROM m) SELECT cell, week, CASE WHEN hits > 0 THEN hit WHEN place = 1 THEN loose ELSE 0 END AS cap FROM k",
    "M4_demoted_labels": "WITH c AS (SELECT cell, week, max(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) AS cap, max(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) AS pul, avg(value) AS t FROM {s} GROUP BY cell, week) SELECT cell, week, CASE WHEN cap = 1 AND pul = 1 AND t > 20 THEN 'CAP' WHEN pul = 1 THEN 'PUL' ELSE '-1' END AS target FROM c",
    "O3_closest": "WITH d AS (SELECT cell, seq, row_number() OVER (PARTITION BY cell ORDER BY abs(value - 50), seq) AS n FROM {s}) SELECT cell, seq FROM d WHERE n = 1",
    "O7_coalesced_columns": "SELECT c_custkey AS k, coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, CAST(c_nationkey AS DOUBLE)) AS x FROM {customer}",
    "O_SOC3_ladder": "WITH n AS (SELECT cell, seq, row_number() OVER (PARTITION BY cell ORDER BY us, seq) - 1 AS p FROM {s} WHERE kind = 'purchase') SELECT cell, seq, cast(CASE WHEN 100 - 10 * p < 0 THEN 0 ELSE 100 - 10 * p END as bigint) AS soc FROM n",
    "P9_substring_any": "SELECT p_partkey FROM {part} WHERE p_type LIKE '%STEEL%' OR p_brand LIKE '%1%' OR p_name LIKE '%q%'",
    "P11_cell_selection": "SELECT c_custkey, c_name FROM {customer} WHERE c_name LIKE '%Customer%' AND lower(c_name) NOT LIKE '%eis%' AND (c_name LIKE '%7%' OR c_name LIKE '%3%')",
    "P12_normalised": "SELECT cell, seq, round((value - 2.5) / (4.2 - 2.5), 6) AS v, round(current / 3.0, 6) AS i, round(value * current / (3.6 * 3.0), 5) AS p FROM {s}",
    "P14_true_range": "WITH p AS (SELECT cell, seq, value, current, lag(value) OVER (PARTITION BY cell ORDER BY us, seq) AS prev FROM {s}) SELECT cell, seq, round(CASE WHEN prev IS NOT NULL AND current > 0 THEN 500 - prev WHEN prev IS NOT NULL THEN prev ELSE value END, 6) AS range FROM p",
    "P16_rate_mask": "SELECT cell, seq FROM {s} WHERE current / 50.0 > 0.95 AND current / 50.0 < 1.05",
    "P22_derived": "SELECT o_custkey, o_orderkey, round(o_totalprice / 300000, 6) AS cap_norm, round(o_totalprice / 3.0 / 2, 4) AS efc, substring(o_orderpriority, 1, 1) AS prefix FROM {orders}",
    "P23_neighbour_ids": "SELECT concat(cast(user_id as string), '_', cast(event_id as string)) AS id, concat(cast(user_id as string), '_', cast(event_id + 1 as string)) AS next FROM {events}",
    "P24_current_state": "SELECT cell, seq, CASE WHEN abs(current) < 0.05 THEN 'rest' WHEN current > 0 THEN 'cha' ELSE 'dch' END AS step FROM {s}",
    "P27_amplitude_list": "SELECT cell, seq FROM {s} WHERE abs(abs(current) - 20) <= 0.05 * 20 OR abs(abs(current) - 80) <= 0.05 * 80",
    "P28_status_class": "SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN '' WHEN c_acctbal < 60 THEN 'red' WHEN c_acctbal < 70 THEN 'amber' ELSE 'ok' END AS class FROM {customer}",
    "P30_decade": "SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice < 30 THEN 1 WHEN l_extendedprice < 300 THEN 2 WHEN l_extendedprice < 3000 THEN 3 WHEN l_extendedprice < 30000 THEN 4 ELSE 5 END AS decade FROM {lineitem}",
    "P33_capacity_reference": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(3.0 * c_acctbal / 100, 4) ELSE 3.0 END AS capacity FROM {customer}",
    "P36_targets_as_text": "SELECT cast(doc_id as string) AS id, cast(toxic as string) AS target FROM {labels} WHERE toxic IS NOT NULL AND doc_id IS NOT NULL",
    "S4_tail_row": "WITH n AS (SELECT cell, us, procedure, row_number() OVER (PARTITION BY cell ORDER BY us DESC, seq DESC) AS n FROM {s}) SELECT cell, us, procedure FROM n WHERE n = 1",
    "S21_skip_existing": "WITH done AS (SELECT DISTINCT o_custkey FROM {orders} WHERE o_totalprice > 400000) SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM done WHERE o_custkey = c_custkey)",
    "S26_sweep_catalogue": "SELECT cell, week, kind AS direction, min(us) AS first_us FROM {s} WHERE kind IN ('click', 'purchase') GROUP BY cell, week, kind",
    "T4_replace_unfinished": "WITH n AS (SELECT o_orderkey, o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END, o_orderkey) AS n FROM {orders}) SELECT o_orderkey, o_custkey, o_orderstatus FROM n WHERE n = 1",
    "W14_one_per_id": "WITH n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM {lineitem}) SELECT l_orderkey, l_linenumber FROM n WHERE n = 1",
    "W20_charge_rest_discharge": "WITH n AS (SELECT cell, seq, state, lead(state) OVER (PARTITION BY cell ORDER BY us, seq) AS a, lead(state, 2) OVER (PARTITION BY cell ORDER BY us, seq) AS b FROM {s}) SELECT cell, seq FROM n WHERE state = 'CHA' AND a IN ('PAU', 'PAUO') AND b = 'DCH'",
}

QUERIES = {name: Query(run, plain(SQL[name])) for name, run in RUN.items()}
