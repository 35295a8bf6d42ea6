"""Models behind candidate generation, with MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame


def assembled(features: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="skip")


def fit_cell_forest(df: DataFrame, features: list[str], targets: list[str], weight: str | None = None, trees: int = 20, depth: int = 6, share: float = 0.5, seed: int = 1) -> dict[str, PipelineModel]:
    """A forest for each cell parameter: MLlib's have one output."""
    out = {}
    for target in targets:
        forest = RandomForestRegressor(featuresCol="features", labelCol=target, predictionCol=f"{target}_pred", numTrees=trees, maxDepth=depth, subsamplingRate=share, seed=seed)
        if weight:
            forest = forest.setWeightCol(weight)
        out[target] = Pipeline(stages=[assembled(features), forest]).fit(df)
    return out


def fit_template_score(df: DataFrame, features: list[str], target: str, rounds: int = 10, depth: int = 3, seed: int = 1) -> PipelineModel:
    return Pipeline(stages=[assembled(features), GBTRegressor(featuresCol="features", labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed)]).fit(df)


def augmentation_test(df: DataFrame, features: list[str], flag: str, trees: int = 20, seed: int = 1) -> tuple[PipelineModel, DataFrame]:
    """A classifier of real and made rows, and the importance of each feature: the nearer its accuracy to 0.5, the better the made ones."""
    model = Pipeline(stages=[assembled(features), RandomForestClassifier(featuresCol="features", labelCol=flag, numTrees=trees, seed=seed)]).fit(df)
    rows = [(f, float(v)) for f, v in zip(features, model.stages[-1].featureImportances.toArray(), strict=True)]
    return model, df.sparkSession.createDataFrame(rows, "feature string, importance double")


def grid_search(df: DataFrame, features: list[str], target: str, depths: list[int], trees: list[int], folds: int = 3, seed: int = 1) -> DataFrame:
    """(depth, trees, rmse) of k-fold cross-validation."""
    forest = RandomForestRegressor(featuresCol="features", labelCol=target, seed=seed)
    grid = ParamGridBuilder().addGrid(forest.maxDepth, depths).addGrid(forest.numTrees, trees).build()
    found = CrossValidator(estimator=Pipeline(stages=[assembled(features), forest]), estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=target, metricName="rmse"), numFolds=folds, seed=seed).fit(df)
    rows = [(int(p[forest.maxDepth]), int(p[forest.numTrees]), float(m)) for p, m in zip(grid, found.avgMetrics, strict=True)]
    return df.sparkSession.createDataFrame(rows, "depth int, trees int, rmse double")


def encode_and_scale(train: DataFrame, label: str, features: list[str]) -> PipelineModel:
    """Label indices and standardised features, fitted on the training rows only; `scaled` is an array."""
    return Pipeline(stages=[StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="keep", stringOrderType="alphabetAsc"), assembled(features, "_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True)]).fit(train)


def scaled(df: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(df).withColumn("scaled", vector_to_array("_scaled")).drop("_raw", "_scaled")


def fit_lattice_classifier(df: DataFrame, features: list[str], label: str, hidden: list[int], steps: int = 50, seed: int = 1) -> PipelineModel:
    classes = df.select(label).distinct().count()
    return Pipeline(stages=[StringIndexer(inputCol=label, outputCol="label_index"), assembled(features), MultilayerPerceptronClassifier(featuresCol="features", labelCol="label_index", layers=[len(features), *hidden, classes], maxIter=steps, seed=seed)]).fit(df)


