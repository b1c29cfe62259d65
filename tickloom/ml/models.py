"""Models of pyspark.ml under the names and sizes that users choose, and what is done with their predictions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml import classification as clf
from pyspark.ml import regression as reg
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sizes of each preset (fixed values): trees, depth, rate; iterations and penalties of linear models.
PRESETS = {
    "light": {"trees": 300, "depth": 6, "rate": 0.1, "rounds": 50, "reg": 1.0, "mix": 0.5},
    "moderate": {"trees": 600, "depth": 8, "rate": 0.05, "rounds": 100, "reg": 0.1, "mix": 0.5},
    "heavy": {"trees": 1200, "depth": 10, "rate": 0.03, "rounds": 200, "reg": 0.01, "mix": 0.5},
}


@dataclass(frozen=True)
class Task:
    """``kind`` regression, binary or multiclass."""

    kind: str
    features: tuple[str, ...]
    label: str = "label"
    classes: int = 2
    weight: str | None = None
    seed: int = 42


def _forest(t: Task, p: dict):
    if t.kind == "regression":
        return reg.RandomForestRegressor(labelCol=t.label, numTrees=p["trees"], maxDepth=p["depth"], seed=t.seed)
    made = clf.RandomForestClassifier(labelCol=t.label, numTrees=p["trees"], maxDepth=p["depth"], seed=t.seed)
    return made.setWeightCol(t.weight) if t.weight else made


def _boosted(t: Task, p: dict):
    depth = p["depth"]
    if t.kind == "regression":
        return reg.GBTRegressor(labelCol=t.label, maxIter=p["rounds"], maxDepth=depth, stepSize=p["rate"], seed=t.seed)
    one = clf.GBTClassifier(labelCol=t.label, maxIter=p["rounds"], maxDepth=depth, stepSize=p["rate"], seed=t.seed)
    return one.setWeightCol(t.weight) if t.weight and t.kind == "binary" else one if t.kind == "binary" else clf.OneVsRest(classifier=one, labelCol=t.label)


def _logistic(t: Task, p: dict):
    if t.kind == "regression":
        raise ValueError("a logistic model needs classes")
    made = clf.LogisticRegression(labelCol=t.label, maxIter=p["rounds"], regParam=p["reg"] / 100, elasticNetParam=0.0, family="multinomial" if t.kind == "multiclass" else "auto", featuresCol="scaled")
    return made.setWeightCol(t.weight) if t.weight else made


def _elastic(t: Task, p: dict):
    if t.kind != "regression":
        raise ValueError("an elastic net predicts numbers")
    return reg.LinearRegression(labelCol=t.label, maxIter=p["rounds"], regParam=p["reg"] / 100, elasticNetParam=p["mix"], featuresCol="scaled")


#: Builders by name; the boosting libraries' names give Spark's own boosted trees.
REGISTRY: dict[str, Callable] = {"rf": _forest, "hgbt": _boosted, "logreg": _logistic, "enet": _elastic, **dict.fromkeys(("xgb", "lgbm", "cat"), _boosted)}


def build(name: str, task: Task, preset: str = "light", **changes: float) -> Pipeline:
    """An unfitted pipeline from feature columns on; rows with a missing feature are skipped in fitting."""
    if name not in REGISTRY:
        raise ValueError(f"no model {name!r}; there are {', '.join(sorted(REGISTRY))}")
    stages = [VectorAssembler(inputCols=list(task.features), outputCol="features", handleInvalid="skip")]
    if name in ("logreg", "enet"):
        stages.append(StandardScaler(inputCol="features", outputCol="scaled", withMean=False))
    return Pipeline(stages=[*stages, REGISTRY[name](task, PRESETS[preset] | changes)])


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy()
    weights = counts.select(F.col(label).alias("__l"), (F.sum("__n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("__n"))).alias(name))
    # one row for each class
    return df.join(F.broadcast(weights), F.col(label) == F.col("__l")).drop("__l")


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """Rows of class 0 per row of class 1."""
    of = lambda v: F.sum((F.col(label) == v).cast("int"))
    return df.agg(F.try_divide(of(0), of(1)).alias("weight"))


def predict(model: PipelineModel, df: DataFrame, task: Task, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns with ``prediction`` and, for classes, ``prob`` (of class 1) or ``prob_0`` and so on.

    Every row comes out; one with a missing feature has nulls."""
    assembler, *rest = model.stages
    out = PipelineModel([assembler.copy().setHandleInvalid("keep"), *rest]).transform(df)
    whole = reduce(lambda p, q: p & q, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in task.features], F.lit(True))
    cols: list[Column] = [F.col(c) for c in keep] + [F.when(whole, F.col("prediction")).alias("prediction")]
    if "probability" in out.columns:
        p = vector_to_array("probability")
        cols += [F.when(whole, p[1]).alias("prob")] if task.kind == "binary" else [F.when(whole, p[i]).alias(f"prob_{i}") for i in range(task.classes)]
    return out.select(*cols)


def importances(model: PipelineModel, features: Sequence[str]) -> str | None:
    """JSON of feature importances, largest first; None if the model has none."""
    last: Model = model.stages[-1]
    values = getattr(last, "featureImportances", None)
    if values is None:
        return None
    return json.dumps(dict(sorted(zip(features, map(float, values.toArray())), key=lambda x: (-x[1], x[0]))))


def permuted(df: DataFrame, column: str, seed: int = 0) -> DataFrame:
    """``df`` with one column's values dealt anew among rows of a hash part; parts keep the deal distributed."""
    part = F.pmod(F.xxhash64(*[c for c in df.columns if c != column]), F.lit(64))
    w = Window.partitionBy("__p")
    a = df.withColumn("__p", part).withColumns({"__i": F.row_number().over(w.orderBy(F.xxhash64(F.struct(*df.columns)))), "__j": F.row_number().over(w.orderBy(F.xxhash64(F.struct(*df.columns), F.lit(seed))))})
    values = a.select(F.col("__p").alias("__q"), F.col("__j").alias("__k"), F.col(column).alias("__v"))
    joined = a.join(values, (F.col("__p") == F.col("__q")) & (F.col("__i") == F.col("__k")))
    return joined.withColumn(column, F.col("__v")).select(*df.columns)


def permutation_importance(model: PipelineModel, df: DataFrame, task: Task, score: Callable[[DataFrame], float], seed: int = 0) -> dict[str, float]:
    """Fall of a score when a feature's values are dealt anew; ``score`` takes predictions with the label."""
    base = score(model.transform(df))
    return {c: base - score(model.transform(permuted(df, c, seed))) for c in task.features}


def calibrate(scored: DataFrame, score: str, label: str, method: str = "platt") -> PipelineModel:
    """A fitted calibration of a score: logistic (platt), which adds ``calibrated_probability``, or isotonic, which adds ``calibrated``."""
    v = VectorAssembler(inputCols=[score], outputCol="score_vector")
    if method == "platt":
        model = clf.LogisticRegression(featuresCol="score_vector", labelCol=label, probabilityCol="calibrated_probability", rawPredictionCol="calibrated_raw", predictionCol="calibrated_class")
    elif method == "isotonic":
        model = reg.IsotonicRegression(featuresCol="score_vector", labelCol=label, predictionCol="calibrated")
    else:
        raise ValueError(f"no calibration {method!r}")
    return Pipeline(stages=[v, model]).fit(scored)


def config_hash(config: dict) -> str:
    """SHA-256 of the configuration as sorted JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def save_artifacts(model: PipelineModel, path: str, features: Sequence[str], metrics: dict, config: dict) -> None:
    """The model and, beside it as text, its features, scores, column map, importances and configuration."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    notes = {"features_used": "\n".join(features), "metrics": json.dumps(metrics, sort_keys=True), "column_map": json.dumps({c: i for i, c in enumerate(features)}), "config": json.dumps({**config, "hash": config_hash(config)}, sort_keys=True, default=str)}
    if found := importances(model, features):
        notes["importances"] = found
    spark.createDataFrame(sorted(notes.items()), "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/notes")


def load_artifacts(spark: SparkSession, path: str) -> tuple[PipelineModel, dict[str, str]]:
    notes = {r["name"]: r["value"] for r in spark.read.schema("name string, value string").json(f"{path}/notes").collect()}
    return PipelineModel.load(f"{path}/model"), notes


def missing_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features that a table lacks; only its schema is read."""
    return sorted(set(features) - set(df.columns))
