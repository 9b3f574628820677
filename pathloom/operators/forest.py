"""Random forests: fitting, search, out-of-fold scores, learning curves and exact contributions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import numbered

#: Spark's trees are at most this deep.
DEEPEST = 30


def classifier(depth: int = DEEPEST, trees: int = 200, leaf: int = 1, seed: int = 42) -> RandomForestClassifier:
    """Gini forest over the square root of the features. A deeper tree than Spark's limit is asked for as 30."""
    return RandomForestClassifier(
        featuresCol="vector", labelCol="label", maxDepth=min(depth, DEEPEST), numTrees=trees, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", impurity="gini", seed=seed
    )


def search(train: DataFrame, depths: tuple[int, ...] = (15, 20, 30), leaves: tuple[int, ...] = (1, 2), trees: int = 200, folds: int = 3, fold_col: str = "fold") -> CrossValidatorModel:
    """Grid search on weighted F1 over given folds, then a refit on all rows. Folds run on the cluster side by side."""
    forest = classifier(trees=trees)
    grid = ParamGridBuilder().addGrid(forest.maxDepth, list(depths)).addGrid(forest.minInstancesPerNode, list(leaves)).build()
    judge = MulticlassClassificationEvaluator(labelCol="label", metricName="f1")
    return CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, foldCol=fold_col, parallelism=4).fit(train)


def probabilities(model: RandomForestClassificationModel, rows: DataFrame, positive: int = 1) -> DataFrame:
    """rows with score, the probability of the positive class, and prediction."""
    if rows.schema["vector"].dataType != VectorUDT():
        raise TypeError("vector must hold vectors")
    return model.transform(rows).withColumn("score", vector_to_array("probability")[positive]).drop("rawPrediction", "probability")


def out_of_fold(train: DataFrame, forest: RandomForestClassifier, folds: int = 3, fold_col: str = "fold") -> DataFrame:
    """Each row scored by a forest fitted without its fold."""
    out = None
    for k in range(folds):
        model = forest.fit(train.filter(F.col(fold_col) != k))
        part = probabilities(model, train.filter(F.col(fold_col) == k))
        out = part if out is None else out.unionByName(part)
    return out


def learning_curve(train: DataFrame, forest: RandomForestClassifier, order: str, shares: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 1.0), folds: int = 3, fold_col: str = "fold") -> list[dict]:
    """F1 of the positive class on the training part and on the held-out fold, by share of the training rows. Rows are numbered within
    their fold over ranges, so no task holds a fold."""
    judge = MulticlassClassificationEvaluator(labelCol="label", metricName="fMeasureByLabel", metricLabel=1.0)
    sizes = train.groupBy(F.col(fold_col).alias("_fold")).agg(F.count("*").alias("_size"))
    placed = numbered(train, [F.col(order)], "_place", (fold_col,))
    ranked = placed.join(F.broadcast(sizes), placed[fold_col] == sizes["_fold"]).withColumn("_share", F.col("_place") / F.greatest(F.col("_size") - 1, F.lit(1)))
    out = []
    for share in shares:
        for k in range(folds):
            part = ranked.filter((F.col(fold_col) != k) & (F.col("_share") <= share))
            model = forest.fit(part)
            held = ranked.filter(F.col(fold_col) == k)
            out.append({"size": share, "fold": k, "train_f1": judge.evaluate(model.transform(part)), "validation_f1": judge.evaluate(model.transform(held))})
    return out


def save(model: RandomForestClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str, features: int | None = None) -> RandomForestClassificationModel:
    """A saved forest. features: what the samples to score have; another number is refused."""
    model = RandomForestClassificationModel.load(path)
    if features is not None and model.numFeatures != features:
        raise ValueError(f"the model has {model.numFeatures} features, the samples {features}")
    return model


def refitted(train: DataFrame, test: DataFrame, forest: RandomForestClassifier, threshold: float, positive: int = 1) -> DataFrame:
    """test with score and y_pred at a fixed threshold, by a forest of fixed parameters fitted on train and not kept. Both must have
    the same binary labels, the positive one among them, and vectors of one size."""
    labels = [sorted({r[0] for r in rows.select("label").distinct().limit(10).collect()}) for rows in (train, test)]
    if labels[0] != labels[1]:
        raise ValueError(f"the labels differ: {labels[0]} in training, {labels[1]} in test")
    if len(labels[0]) != 2 or positive not in labels[0]:
        raise ValueError(f"two labels with {positive} among them are needed, not {labels[0]}")
    sizes = [rows.select("vector").first()[0].size for rows in (train, test)]
    if sizes[0] != sizes[1]:
        raise ValueError(f"the feature counts differ: {sizes[0]} in training, {sizes[1]} in test")
    scored = probabilities(forest.fit(train), test, positive)
    other = next(x for x in labels[0] if x != positive)
    return scored.withColumn("y_true", F.col("label")).withColumn("y_pred", F.when(F.col("score") >= threshold, positive).otherwise(other))


# --- contributions ---------------------------------------------------------------------------------------

@dataclass
class Leaf:
    """A leaf's path, feature by feature: what its splits ask of the feature together, and the share of
    training rows that they let through."""

    value: float
    features: list[int]
    low: list[float]  # x > low
    high: list[float]  # x <= high
    share: list[float]


def tree_table(model: RandomForestClassificationModel, positive: int = 1) -> list[list[Leaf]]:
    """Leaves of every tree; a leaf's value is the share of the positive class among its training rows."""
    trees = []
    for tree in model.trees:
        leaves: list[Leaf] = []
        stack = [(tree._call_java("rootNode"), {})]
        while stack:
            node, seen = stack.pop()
            if node.numDescendants() == 0:
                stats = list(node.impurityStats().stats())
                names = sorted(seen)
                leaves.append(Leaf(stats[positive] / sum(stats), names, *[[seen[n][i] for n in names] for i in range(3)]))
                continue
            split = node.split()
            feature, threshold = split.featureIndex(), split.threshold()
            rows = float(sum(node.impurityStats().stats()))
            low, high, share = seen.get(feature, (-math.inf, math.inf, 1.0))
            for child, bounds in ((node.leftChild(), (low, min(high, threshold))), (node.rightChild(), (max(low, threshold), high))):
                part = float(sum(child.impurityStats().stats())) / rows
                stack.append((child, seen | {feature: (*bounds, share * part)}))
        trees.append(leaves)
    return trees


def leaf_contributions(leaf: Leaf, x: np.ndarray) -> np.ndarray:
    """Shapley values of one leaf's game for each row of x (columns: the leaf's features).

    A coalition's worth is the leaf's value times, for each feature, 1 or 0 (inside: does the row pass the splits)
    or the share let through (outside). The sum over coalitions of a given size is a coefficient of the
    product of (share + pass * t) over the other features."""
    d = len(leaf.features)
    passes = ((x > np.array(leaf.low)) & (x <= np.array(leaf.high))).astype(float)
    share = np.array(leaf.share)
    weight = np.array([math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)])
    out = np.empty((len(x), d))
    for j in range(d):
        poly = np.zeros((len(x), d))
        poly[:, 0] = 1.0
        for k in range(d):
            if k != j:
                poly[:, 1:] = poly[:, 1:] * share[k] + poly[:, :-1] * passes[:, [k]]
                poly[:, 0] *= share[k]
        out[:, j] = leaf.value * (passes[:, j] - share[j]) * (poly @ weight)
    return out


def picked_entries(vector, column: dict[int, int]) -> list[float]:
    """A vector's entries of the asked features, in their order."""
    if not hasattr(vector, "indices"):
        return [float(vector[f]) for f in column]
    out = [0.0] * len(column)
    for f, value in zip(vector.indices.tolist(), vector.values.tolist(), strict=True):
        if f in column:
            out[column[f]] = value
    return out


def contributions(model: RandomForestClassificationModel, rows: DataFrame, sample: str, positive: int = 1) -> DataFrame:
    """(sample, feature_id, value, shap_value) for every feature that a tree asks about, and the base value under
    feature_id -1: they add up to the forest's probability. The trees are the model itself, so their size
    is bounded by its parameters; rows stream through in Arrow batches."""
    trees = tree_table(model, positive)
    asked = sorted({f for leaves in trees for leaf in leaves for f in leaf.features})
    column = {f: i for i, f in enumerate(asked)}
    base = float(np.mean([sum(leaf.value * math.prod(leaf.share) for leaf in leaves) for leaves in trees]))
    kinds = dict(rows.dtypes)
    state = rows.sparkSession.sparkContext.broadcast((trees, asked, column, base))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, asked, column, base = state.value
        for batch in batches:
            x = np.array([list(v) for v in batch["asked"]], float).reshape(len(batch), len(asked))
            total = np.zeros((len(batch), len(asked)))
            for leaves in trees:
                for leaf in leaves:
                    if leaf.features:
                        at = [column[f] for f in leaf.features]
                        total[:, at] += leaf_contributions(leaf, x[:, at])
            total /= len(trees)
            n = len(asked)
            yield pd.DataFrame({
                sample: np.repeat(batch[sample].to_numpy(), n + 1),
                "feature_id": np.tile([-1, *asked], len(batch)),
                "value": np.hstack([np.zeros((len(batch), 1)), x]).ravel(),
                "shap_value": np.hstack([np.full((len(batch), 1), base), total]).ravel(),
            })

    # entry by entry, so that no row becomes an array as long as the vocabulary
    parts = F.udf(lambda v: picked_entries(v, state.value[2]), "array<double>") if len(asked) < model.numFeatures else None
    picked = rows.select(sample, parts("vector").alias("asked") if parts else vector_to_array("vector").alias("asked"))
    return picked.mapInPandas(run, f"{sample} {kinds[sample]}, feature_id int, value double, shap_value double")


def tree_rules(model: RandomForestClassificationModel, tree: int = 0, depth: int = 4, names: dict[int, str] | None = None) -> str:
    """One tree as indented text, down to a depth. names: of the features by id; leaves show the training rows of each class."""
    lines = []
    stack = [(model.trees[tree]._call_java("rootNode"), 0, "")]
    while stack:
        node, level, text = stack.pop()
        if text:
            lines.append("  " * (level - 1) + text)
        if node.numDescendants() == 0:
            weights = ", ".join(f"{w:.2f}" for w in node.impurityStats().stats())
            lines.append("  " * level + f"weights: [{weights}] class: {int(node.prediction())}")
        elif level >= depth:
            lines.append("  " * level + "...")
        else:
            split = node.split()
            name = (names or {}).get(split.featureIndex(), f"feature {split.featureIndex()}")
            stack.append((node.rightChild(), level + 1, f"{name} > {split.threshold():.6f}"))
            stack.append((node.leftChild(), level + 1, f"{name} <= {split.threshold():.6f}"))
    return "\n".join(lines)
