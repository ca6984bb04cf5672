"""Boosting loops over Spark's distributed regression trees (M2, M8).

Each round fits one tree by distributed histogram aggregation, and takes what
the next round needs from one aggregate. Rows never leave Spark; the driver
holds the trees and a few numbers of each round. The columns that change
(prediction so far, weight) are written to the shared folder every
``EVERY`` rounds, so that neither the plan nor the lineage grows with the rounds.

* :class:`AdaBoostR2` (linear loss, weighted median): rows that a tree predicts
  badly count more for the next one. Spark's trees take the weights themselves,
  so no sample is drawn.
* :class:`EarlyStopBoosting` (squared loss): a tree is fitted to what is left
  of the target; boosting stops when the error on validation rows has not
  fallen for ``patience`` rounds, and the rounds up to the best one are kept.

Both are used like Spark's estimators: ``fit(train)`` and ``transform(df)``.
"""

from __future__ import annotations

from math import log

from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .split import seeded_key

EVERY = 5


class _Boosting:
    """What both have in common: column names, the trees' parameters, a tree's prediction as a column."""

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", seed: int = 42,
                 rounds: int = 50, **tree):
        self.features, self.label, self.prediction = featuresCol, labelCol, predictionCol
        self.seed, self.rounds, self.tree_options = seed, rounds, tree
        self.trees: list = []

    def _tree(self, df: DataFrame, label: str, weight: str | None = None):
        extra = {"weightCol": weight} if weight else {}
        return DecisionTreeRegressor(featuresCol=self.features, labelCol=label, predictionCol="__t", seed=self.seed, **extra, **self.tree_options).fit(df)


def weighted_median(pairs: Column) -> Column:
    """The least value of an array of (value, weight) at which the weights up to it reach half of their sum."""
    ordered = F.array_sort(pairs)
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["weight"])
    none = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("value"))

    def step(acc: Column, p: Column) -> Column:
        run = acc["run"] + p["weight"]
        return F.struct(run.alias("run"), F.coalesce(acc["value"], F.when(run >= total / 2, p["value"])).alias("value"))

    return F.aggregate(ordered, none, step, lambda acc: acc["value"])


class AdaBoostR2(_Boosting):
    """``weights`` are those of the trees, ``betas`` the factors by which well-predicted rows lose weight."""

    def fit(self, train: DataFrame) -> AdaBoostR2:
        self.trees, self.weights, self.betas = [], [], []
        d = written(train.select(self.features, F.col(self.label).cast("double").alias("__y"), F.lit(1.0).alias("__w")), "boost")
        if d.isEmpty():   # no rows, no trees: every prediction is missing
            return self
        for k in range(self.rounds):
            tree = self._tree(d, "__y", "__w")
            d = tree.transform(d).withColumn("__e", F.abs(F.col("__t") - F.col("__y"))).drop("__t")
            worst, loss, total = d.agg(F.max("__e"), F.sum(F.col("__w") * F.col("__e")), F.sum("__w")).first()
            if not worst:   # a perfect tree decides alone what the others leave open
                self.trees.append(tree)
                self.weights.append(1.0)
                break
            mean = loss / (worst * total)
            if mean >= 0.5:
                if not self.trees:
                    self.trees, self.weights = [tree], [1.0]
                break
            beta = mean / (1 - mean)
            self.trees.append(tree)
            self.betas.append(beta)
            self.weights.append(log(1 / beta))
            # scaled by the total, so that weights neither vanish nor grow with the rounds
            factor = F.pow(F.lit(beta), 1 - F.col("__e") / worst) * scale_of(total)
            d = d.withColumn("__w", F.col("__w") * factor).drop("__e")
            if (k + 1) % EVERY == 0:
                d = written(d, "boost")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for k, tree in enumerate(self.trees):
            out = tree.transform(out).withColumnRenamed("__t", f"__t{k}")
        names = [f"__t{k}" for k in range(len(self.trees))]
        pairs = F.array(*[F.struct(F.col(n).alias("value"), F.lit(w).alias("weight")) for n, w in zip(names, self.weights)])
        value = weighted_median(pairs) if names else F.lit(None).cast("double")
        return out.withColumn(self.prediction, value).drop(*names)


def scale_of(total: float) -> float:
    """A power of two near 1 / total: rescaling by it changes no bit of a weight's fraction."""
    return 2.0 ** -round(log(total, 2)) if total > 0 else 1.0


class EarlyStopBoosting(_Boosting):
    """``errors`` has the validation RMSE of each round that ran; ``trees`` those up to the best round.

    Validation rows are those where ``validationCol`` is true, or else a share of
    ``validation`` of the rows, chosen by a hash of their values.
    """

    def __init__(self, patience: int = 10, rate: float = 0.1, validation: float = 0.2, validationCol: str | None = None, **options):
        super().__init__(**options)
        self.patience, self.rate, self.validation, self.validation_col = patience, rate, validation, validationCol

    def fit(self, train: DataFrame) -> EarlyStopBoosting:
        by_hash = F.pmod(seeded_key(self.seed, self.label, self.features), F.lit(1000)) < 1000 * self.validation
        held = F.col(self.validation_col) if self.validation_col else by_hash
        y = F.col(self.label).cast("double")
        self.trees, self.errors = [], []
        self.start = train.where(~held).agg(F.avg(y)).first()[0]
        if self.start is None:
            return self
        d = written(train.select(self.features, y.alias("__y"), held.alias("__held"), F.lit(self.start).alias("__p")), "boost")
        best, kept = None, 0
        for k in range(self.rounds):
            d = d.withColumn("__r", F.col("__y") - F.col("__p"))
            tree = self._tree(d.where(~F.col("__held")), "__r")
            d = tree.transform(d).withColumn("__p", F.col("__p") + self.rate * F.col("__t")).drop("__t", "__r")
            if (k + 1) % EVERY == 0:
                d = written(d, "boost")
            error = d.where("__held").agg(F.sqrt(F.avg((F.col("__y") - F.col("__p")) ** 2))).first()[0]
            self.trees.append(tree)
            self.errors.append(error)
            if error is not None and (best is None or error < best):
                best, kept = error, k + 1
            if error is not None and k + 1 - kept >= self.patience:
                break
        self.trees = self.trees[:kept] if best is not None else self.trees
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn(self.prediction, F.lit(self.start).cast("double"))
        for tree in self.trees:
            out = tree.transform(out).withColumn(self.prediction, F.col(self.prediction) + self.rate * F.col("__t")).drop("__t")
        return out


MODELS = {"AdaBoostR2": AdaBoostR2, "EarlyStopBoosting": EarlyStopBoosting}
