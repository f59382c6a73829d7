"""The isolation forest: planted outliers, paths by hand, the same rows giving the same scores."""

import numpy as np
import pytest

from voltaspan.operators import isolation


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 2))
    x[:6] = [(9, 9), (-9, 8), (12, 7), (11, -8), (-10, -10), (8, -9)]
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(5000, None, 1.0), (5001, float("nan"), 0.0)]
    return spark.createDataFrame(rows, "id long, a double, b double")


def test_planted_outliers_come_first(points):
    found = isolation.outliers(points, points, "id", ["a", "b"], 0.003).collect()
    ranked = sorted((r for r in found if r.score is not None), key=lambda r: -r.score)
    assert {r.id for r in ranked[:5]} <= set(range(6)) <= {r.id for r in ranked[:10]} and all(0 < r.score < 1 for r in ranked)
    assert {r.id for r in found if r.outlier} <= {r.id for r in ranked[:10]} and sum(bool(r.outlier) for r in found) >= 5
    assert {r.id for r in found if r.score is None} == {5000, 5001}
    assert np.median([r.score for r in ranked]) < 0.5 < ranked[0].score


def test_same_rows_same_scores(points):
    score = lambda df, seed=42: {r.id: r.score for r in isolation.outliers(df, df, "id", ["a", "b"], None, trees=20, seed=seed).collect()}
    one = score(points)
    assert one == score(points.repartition(7)) and one != score(points, 1)


def test_scores_are_those_of_the_trees(spark, points):
    forest = isolation.isolation_forest(points, "id", ["a", "b"], trees=5, sample=64).first()
    found = {r.id: r.score for r in isolation.outliers(points, points, "id", ["a", "b"], None, trees=5, sample=64).collect()}
    assert len(forest.trees) == 5 and forest.depth == 6 and forest.usual == pytest.approx(isolation.usual_path(64))
    for r in points.where("id < 40").collect():
        paths = []
        for tree in forest.trees:
            node = 1
            while tree.feature[node] >= 0:
                node = 2 * node + ((r.a, r.b)[tree.feature[node]] >= tree.split[node])
            paths.append(tree.path[node])
        assert found[r.id] == pytest.approx(2 ** (-np.mean(paths) / forest.usual))


def test_few_or_equal_rows(spark):
    same = spark.createDataFrame([(i, 1.0) for i in range(9)], "id long, a double")
    assert len({r.score for r in isolation.outliers(same, same, "id", ["a"], None, trees=5).collect()}) == 1
    assert [r.outlier for r in isolation.outliers(same.limit(1), same.limit(0), "id", ["a"], trees=3).collect()] == [None]
