"""Density clusters: the tree in blocks equals the one of a single task."""

import numpy as np
import pytest

from voltaspan.functions import numeric
from voltaspan.operators import clusters, density
from voltaspan.operators.groups import together


def blobs(seed, n=500, parts=4):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(rng.uniform(-5, 5, 2), rng.uniform(0.05, 0.6), (n // parts, 2)) for _ in range(parts)])
    x[: n // 10] = rng.uniform(-6, 6, (n // 10, 2))
    x[-20:] = x[-1]  # copies
    return x


def frame(spark, groups):
    rows = [(key, i, float(a), float(b)) for key, x in groups.items() for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "key long, item long, a double, b double").repartition(3)


@pytest.mark.parametrize("block,columns", [(64, ["a", "b"]), (100, ["a"])])
def test_blocks_equal_one_task(spark, block, columns):
    groups = {1: blobs(1), 2: blobs(2, 300, 2), 3: blobs(3, 40, 1)}  # the last one fits a block
    found = density.density_clusters(frame(spark, groups), ["key"], "item", columns, least=6, block=block).collect()
    assert len(found) == sum(map(len, groups.values()))
    for key, x in groups.items():
        got = np.array([r.cluster for r in sorted((r for r in found if r.key == key), key=lambda r: r.item)])
        want = numeric.density_clusters(x[:, : len(columns)], 6)
        assert (got == want).all(), (key, (got != want).sum())


def test_tree_has_the_least_weight(spark):
    x = blobs(5, 200, 3)
    points = spark.createDataFrame([(1, i, p.tolist(), 0.0) for i, p in enumerate(x)], "key long, id long, x array<double>, core double")
    tree = density.spanning_tree(points, ["key"], 2, 32).toPandas()
    assert len(tree) == len(x) - 1
    assert tree["distance"].sum() == pytest.approx(numeric.spanning_edges(x)[:, 0].sum())


def test_epsilon_joins_what_parts_below_it():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.02, (40, 1)) for c in (0.0, 0.3, 3.0, 3.3, 9.0)])
    assert len(set(numeric.density_clusters(x, 5).tolist()) - {-1}) >= 5
    joined = numeric.density_clusters(x, 5, epsilon=1.0)
    assert len(set(joined.tolist()) - {-1}) == 3 and len(set(joined[:80].tolist()) - {-1}) == 1


def test_odd_rows(spark):
    rows = [(1, 0, None, 1.0), (1, 1, float("nan"), 1.0), (1, 2, 1.0, 1.0), (2, 5, 0.0, float("inf"))]
    found = density.density_clusters(spark.createDataFrame(rows, "key long, item long, a double, b double"), ["key"], "item", ["a", "b"]).collect()
    assert sorted((r.key, r.item, r.cluster) for r in found) == [(1, 0, -1), (1, 1, -1), (1, 2, -1), (2, 5, -1)]


def test_two_layers_find_the_capacity_tests(spark):
    """Cell 1 has clear capacity tests; those of cell 2 vary in current, beside charges of like
    length, so its second layer must part them."""
    rng, rows = np.random.default_rng(4), []

    def add(cell, n, minutes, current, spread, low):
        for _ in range(n):
            i = current + spread * rng.standard_normal()
            rows.append((cell, len(rows), minutes / 100 + 0.01 * rng.standard_normal(), minutes + 0.0, i, abs(i), 0.0005, low))

    for cell in (1, 2):
        add(cell, 12, 0.4, -2.0, 0.01, 0.5)  # pulses
        add(cell, 6, 1200.0, -0.05, 0.0005, 0.0)  # slow sweeps
        add(cell, 9, 600.0, 0.2, 0.001, 0.3)  # neither
    add(1, 8, 120.0, -0.5, 0.001, 0.0)
    add(2, 8, 120.0, -0.49, 0.003, 0.2)  # ends too high to be clear
    add(2, 8, 120.0, 0.47, 0.003, 0.2)
    columns = "cell long, item long, duration double, minutes double, current_mean double, abs_current double, current_std double, voltage_min double"
    segments = spark.createDataFrame(rows, columns).repartition(3)
    found = clusters.two_layers(segments, ["cell"], "item", 6, clusters.Protocol(), clusters.Layer(4, 0.05), clusters.Layer(4, 0.05)).collect()
    assert len(found) == len(rows)
    for r in found:
        want = {0.4: "PUL*", 1200.0: "QOCV*", 600.0: str(r.cluster)}.get(r.minutes)
        if r.minutes == 120.0:
            want = "CAP*" if r.current_mean < 0 else str(r.cluster)
            assert r.cluster_id.startswith("cap_layer_") == (r.cell == 2)
        assert r.target == want, r


def test_keys_too_small_for_two_clusters_are_noise_without_work(spark, monkeypatch):
    rows = [(None if c == 5 else c, i, float(i % 2), 0.0) for c in range(40) for i in range(3)] + [(c, i, float(i // 4 * 9 + i % 4), 0.0) for c in range(50, 60) for i in range(8)]
    df = spark.createDataFrame(rows, "cell long, week long, a double, b double")
    found = density.density_clusters(df, ["cell"], "week", ["a", "b"], 3)
    labels = {(r.cell, r.week): r.cluster for r in found.collect()}
    assert len(labels) == found.count() == len(rows) and all(labels[c, i] == (-1 if c is None or c < 50 else i // 4) for c, i, _, _ in rows)
    calls = []
    monkeypatch.setattr(density, "together", lambda rows, *rest: calls.append(rows.select("cell").distinct().count()) or together(rows, *rest))
    density.density_clusters(df, ["cell"], "week", ["a", "b"], 3).count()
    assert calls == [11]  # ten of eight points, and the one without a name
