import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from pathloom.operators import forest as fo


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        x = [rng.random() for _ in range(4)]
        rows.append((i, int(x[0] + x[1] * x[2] > 0.9), i % 3, Vectors.dense(x)))
    df = spark.createDataFrame(rows, ["sample", "label", "fold", "vector"]).cache()
    return df, fo.classifier(depth=4, trees=3).fit(df)


def test_contributions_add_up_to_probability(fitted):
    df, model = fitted
    total = {r[0]: r[1] for r in fo.contributions(model, df, "sample").groupBy("sample").sum("shap_value").collect()}
    for r in fo.probabilities(model, df).collect():
        assert math.isclose(total[r["sample"]], r["score"], abs_tol=1e-9)


def test_leaf_game_against_all_coalitions():
    leaf = fo.Leaf(0.7, [0, 1, 2], [0.2, -math.inf, 0.1], [math.inf, 0.5, 0.9], [0.3, 0.6, 0.5])
    x = np.array([[0.5, 0.4, 0.95], [0.1, 0.2, 0.3]])
    got = fo.leaf_contributions(leaf, x)
    for row, have in zip(x, got, strict=True):
        passes = [float(a < v <= b) for v, a, b in zip(row, leaf.low, leaf.high, strict=True)]
        worth = lambda s: leaf.value * math.prod(passes[k] if k in s else leaf.share[k] for k in range(3))
        for j in range(3):
            others = [k for k in range(3) if k != j]
            value = sum(
                math.factorial(n) * math.factorial(2 - n) / 6 * (worth({*s, j}) - worth(set(s)))
                for n in range(3) for s in itertools.combinations(others, n)
            )
            assert math.isclose(have[j], value, abs_tol=1e-12)


def test_depth_limit_search_and_out_of_fold(fitted):
    df, _ = fitted
    assert fo.classifier(depth=40).getMaxDepth() == 30
    scored = fo.out_of_fold(df, fo.classifier(depth=3, trees=2))
    assert scored.count() == df.count()
    best = fo.search(df, depths=(2, 3), leaves=(1,), trees=2)
    assert len(best.avgMetrics) == 2
    curve = fo.learning_curve(df, fo.classifier(depth=2, trees=2), "sample", shares=(0.5, 1.0), folds=2)
    assert len(curve) == 4


def test_rules_text(fitted):
    _, model = fitted
    assert "feature" in fo.tree_rules(model, depth=2)


def test_saved_forests_come_back(spark, fitted, tmp_path):
    df, model = fitted
    fo.save(model, str(tmp_path / "m"))
    back = fo.load(str(tmp_path / "m"), 4)
    score = lambda m: [r["score"] for r in fo.probabilities(m, df).orderBy("sample").collect()]
    assert score(back) == score(model)
    with pytest.raises(ValueError):
        fo.load(str(tmp_path / "m"), 5)


def test_refit_with_fixed_threshold(spark, fitted):
    df, _ = fitted
    train, test = df.filter("sample < 150"), df.filter("sample >= 150")
    forest = fo.classifier(depth=3, trees=2)
    scored = fo.refitted(train, test, forest, 0.3).collect()
    assert len(scored) == 50 and all((r["score"] >= 0.3) == (r["y_pred"] == 1) and r["y_true"] == r["label"] for r in scored)
    with pytest.raises(ValueError):
        fo.refitted(train, test.filter("label = 0"), forest, 0.3)
    wider = spark.createDataFrame([(1, 0, Vectors.dense([0.0] * 5)), (2, 1, Vectors.dense([1.0] * 5))], ["sample", "label", "vector"])
    with pytest.raises(ValueError):
        fo.refitted(train, wider, forest, 0.3)


def test_sparse_rows_keep_their_entries(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, Vectors.sparse(1000, {7: rng.random() + i % 2, 500: rng.random()})) for i in range(60)]
    df = spark.createDataFrame(rows, ["sample", "label", "vector"])
    model = fo.classifier(depth=3, trees=5).fit(df)
    total = {r[0]: r[1] for r in fo.contributions(model, df, "sample").groupBy("sample").sum("shap_value").collect()}
    assert all(math.isclose(total[r["sample"]], r["score"], abs_tol=1e-9) for r in fo.probabilities(model, df).collect())
    assert "weights: [" in fo.tree_rules(model, names={7: "mov add"})
