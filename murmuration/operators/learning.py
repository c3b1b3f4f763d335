"""Models trained here: a random forest for account scores."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train_accounts(rows: DataFrame, features: list[str], label: str = "label", key: str = "id", trees: int = 100) -> tuple[PipelineModel, float]:
    """A forest and its area under the curve on the fifth of each class that a hash of the key holds out."""
    out = F.pmod(F.xxhash64(key), F.lit(5)) == 0
    forest = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=8, seed=42)
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), forest]).fit(rows.where(~out))
    area = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC").evaluate(model.transform(rows.where(out)))
    return model, area


def score_accounts(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows with `bot_probability`."""
    return model.transform(rows).withColumn("bot_probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
