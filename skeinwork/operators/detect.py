"""Classification of sessions by their features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.sampling import stratified_split
from skeinwork.storage import Stash


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: tp, fp, fn, tn, and precision, recall, F1 of the positive class, accuracy."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    c = df.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()).agg(
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn")
    )
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def _classifier(kind: str, width: int, seed: int):
    common = {"featuresCol": "scaled", "labelCol": "label"}
    if kind == "forest":
        return RandomForestClassifier(**common, weightCol="weight", numTrees=50, maxDepth=6, seed=seed)
    if kind == "logistic":
        return LogisticRegression(**common, weightCol="weight", regParam=0.01)
    if kind == "perceptron":
        return MultilayerPerceptronClassifier(**common, layers=[width, 32, 16, 2], maxIter=100, seed=seed)
    raise ValueError(f"unknown classifier: {kind}")


def train(rows: DataFrame, label: str, features: str, kind: str, seed: int = 42) -> PipelineModel:
    """A fitted pipeline of scaling and classifier; classes weigh the same in all (where the kind allows)."""
    counts = {r["label"]: r["n"] for r in rows.groupBy(F.col(label).cast("double").alias("label")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    weight = F.coalesce(*[F.when(F.col("label") == k, total / (len(counts) * n)) for k, n in counts.items()], F.lit(1.0))
    ready = rows.select(array_to_vector(F.col(features)).alias("features"), F.col(label).cast("double").alias("label")).withColumn("weight", weight)
    width = len(rows.first()[features])
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    return Pipeline(stages=[scaler, _classifier(kind, width, seed)]).fit(ready)


def predict(model: PipelineModel, rows: DataFrame, key: str, features: str) -> DataFrame:
    out = model.transform(rows.select(key, array_to_vector(F.col(features)).alias("features")))
    return out.select(key, F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability")[1].alias("probability"))


def evaluate(rows: DataFrame, key: str, label: str, features: str, kind: str, seed: int = 42) -> DataFrame:
    """``key, split, label, predicted, probability``: trained on a stratified 0.7, applied to all rows.
    The rest never takes part in training or its choices."""
    stash = Stash(rows.sparkSession, "detect")
    data = rows.where(F.col(label).isNotNull())
    parts = stash.put(data.join(stratified_split(data, key, label, {"train": 0.7, "test": 0.3}, seed), key))
    model = train(parts.where("split = 'train'"), label, features, kind, seed)
    return parts.select(key, "split", label).join(predict(model, parts, key, features), key)


class PositiveF1(Evaluator):
    """F1 of the positive class; 0 for a fold that has none."""

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(confusion(dataset, "label", "prediction").first()["f1"])

    def isLargerBetter(self) -> bool:
        return True


#: Rows of features that fill a partition.
ROWS = 20_000
#: Grids of the classifiers that are compared in folds.
FOREST_GRID = {"maxDepth": [5, 10]}
LOGISTIC_GRID = {"regParam": [0.1, 0.01, 0.001], "elasticNetParam": [0.0, 1.0]}


def evaluate_grid(rows: DataFrame, key: str, label: str, features: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """``key, model, split, label, predicted, probability`` of a forest and a regression, each with the setting of
    its grid that has the best F1 of the positive class in ``folds`` folds of a stratified 0.8; the rest takes
    no part in training or choice."""
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    stash = Stash(rows.sparkSession, "grid")
    data = rows.where(F.col(label).isNotNull())
    parts = stash.put(data.join(stratified_split(data, key, label, {"train": 0.8, "test": 0.2}, seed), key))
    taught = parts.where("split = 'train'")
    counts = {r["label"]: r["n"] for r in taught.groupBy(F.col(label).cast("double").alias("label")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    weight = F.coalesce(*[F.when(F.col("label") == k, total / (len(counts) * n)) for k, n in counts.items()], F.lit(1.0))
    # a fold is a pass over the rows: as many partitions as they fill, not as many as made them
    ready = stash.put(taught.select(array_to_vector(F.col(features)).alias("features"), F.col(label).cast("double").alias("label")).withColumn("weight", weight), int(total // ROWS) + 1)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    judge = PositiveF1()
    out = None
    for kind, grid in (("forest", FOREST_GRID), ("logistic", LOGISTIC_GRID)):
        classifier = _classifier(kind, 0, seed)
        options = ParamGridBuilder()
        for name, values in grid.items():
            options = options.addGrid(classifier.getParam(name), values)
        search = CrossValidator(estimator=Pipeline(stages=[scaler, classifier]), estimatorParamMaps=options.build(), evaluator=judge, numFolds=folds, seed=seed, parallelism=4)
        found = predict(search.fit(ready).bestModel, parts, key, features).withColumn("model", F.lit(kind))
        out = found if out is None else out.unionByName(found)
    return parts.select(key, "split", label).join(out, key).select(key, "model", "split", label, "predicted", "probability")


def save_model(model: PipelineModel, path: str) -> None:
    """Write a fitted pipeline; an earlier one there is replaced."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
