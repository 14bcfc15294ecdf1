"""Classifiers on feature tables, by MLlib: one model of all rows.  ``operators.trees`` grows models of many keys together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

# Model sizes and seed.
TREES = 100
ROUNDS = 100
SEED = 42

#: Partitions of the rows that a model is fitted on; a model depends on it, so it is an argument, not a count of rows.
PARTITIONS = 8


@dataclass(frozen=True)
class Fitted:
    """A fitted classifier with the features it was fitted on."""

    model: PipelineModel
    features: tuple[str, ...]
    label: str

    def score(self, df: DataFrame) -> DataFrame:
        """``prediction`` (int) and ``probability`` of class 1 on every row."""
        out = self.model.transform(df)
        return out.withColumns(
            {
                "probability": vector_to_array("class_probability")[1],
                "prediction": F.col("prediction").cast("int"),
            }
        ).drop("raw_features", "scaled", "class_probability", "rawPrediction")

    def importances(self, spark) -> DataFrame:
        """One row per feature; their number is that of the features."""
        tree = self.model.stages[-1]
        rows = list(zip(self.features, [float(x) for x in tree.featureImportances.toArray()], strict=True))
        return spark.createDataFrame(rows, "feature string, importance double")


def _fit(train: DataFrame, features: Sequence[str], label: str, tree, scale: bool, partitions: int = PARTITIONS) -> Fitted:
    assemble = VectorAssembler(inputCols=list(features), outputCol="raw_features" if scale else "scaled")
    stages = [assemble]
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="scaled", withMean=True, withStd=True))
    tree.setFeaturesCol("scaled").setLabelCol(label).setProbabilityCol("class_probability")
    # fitting reads the rows many times; what does not fit in memory goes to disk
    rows = train.select(*features, label)
    # bagging and split sampling follow the partitions: dealt by the row's values and sorted, they don't follow the files
    rows = rows.repartition(partitions, *features).sortWithinPartitions(*features, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = Pipeline(stages=[*stages, tree]).fit(rows)
    finally:
        rows.unpersist()
    return Fitted(model, tuple(features), label)


def forest(train: DataFrame, features: Sequence[str], label: str, trees: int = TREES, seed: int = SEED, partitions: int = PARTITIONS) -> Fitted:
    """Scaled features and a random forest, one model for all keys together."""
    return _fit(train, features, label, RandomForestClassifier(numTrees=trees, seed=seed), scale=True, partitions=partitions)


def boost(train: DataFrame, features: Sequence[str], label: str, rounds: int = ROUNDS, seed: int = SEED, partitions: int = PARTITIONS) -> Fitted:
    """Boosted trees on the plain features."""
    return _fit(train, features, label, GBTClassifier(maxIter=rounds, seed=seed), scale=False, partitions=partitions)
