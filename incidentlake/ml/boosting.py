"""Gradient boosting with patience: the best prefix of the ensemble by the loss on held-out rows.

MLlib ends boosting at the first round that gains less than its tolerance, and can't go on from a
model that is there. Here rounds are fitted in growing blocks without that test; after each block the loss of
every prefix is taken from one pass over the held-out rows. Boosting ends once ``patience`` rounds
have brought nothing better, or at the most rounds allowed, and the trees after the best prefix are cut off.
A block of three times the rounds repeats those before it (same seed, same checkpointed rows, so the same
trees), 400 rounds at most before the last block of 700; MLlib checkpoints its residuals every ten rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame

from incidentlake import fixed_values as V


@dataclass
class Boosted:
    model: GBTClassificationModel  # the best prefix
    losses: list[float]  # of every prefix that was looked at, on the held-out rows

    @property
    def trees(self) -> int:
        return self.model.getNumTrees


def best_prefix(losses: list[float], patience: int) -> tuple[int, bool]:
    """(rounds of the best prefix before patience ran out, whether it ran out)."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def truncated(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model of the first ``rounds`` trees, with their weights."""
    whole, gateway = model._java_obj, SparkContext._active_spark_context._gateway
    ml = gateway.jvm.org.apache.spark.ml
    trees = gateway.new_array(ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    for i, (tree, weight) in enumerate(zip(list(whole.trees())[:rounds], model.treeWeights)):
        trees[i], weights[i] = tree, weight
    cut = ml.classification.GBTClassificationModel(whole.uid(), trees, weights, whole.numFeatures(), 2)
    return GBTClassificationModel(whole.copyValues(cut, whole.extractParamMap()))


def fit(
    train: DataFrame, held: DataFrame, params: dict, seed: int, bins: int, patience: int = V.PATIENCE,
    label: str = "attack_present", weight: str = "weight",
) -> Boosted:
    """Boosted trees on ``train`` (features, label, weight), stopped by the log loss on ``held``; both are read often."""
    rounds = 2 * patience
    while True:
        rounds = min(rounds, params["iterations"])
        model = GBTClassifier(
            labelCol=label, weightCol=weight, maxIter=rounds, maxDepth=params["depth"], stepSize=params["learning_rate"],
            maxBins=bins, seed=seed,
        ).fit(train)
        losses = list(model.evaluateEachIteration(held))
        best, ended = best_prefix(losses, patience)
        if ended or rounds >= params["iterations"]:
            return Boosted(truncated(model, best), losses[: best + patience])
        rounds *= 3
