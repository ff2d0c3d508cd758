"""Targets and weights of the study, calibration and the type model on MLlib."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridorwatch.functions.columns import logit
from corridorwatch.functions.rows import with_row
from corridorwatch.functions.selection import exact_medians, exact_modes
from corridorwatch.session import new_path

MISSING = "__missing_"


def class_ratio(train: DataFrame, cap: float) -> DataFrame:
    """One row: min(cap, negatives / positives)."""
    positive = F.greatest(F.sum("target_event_30m"), F.lit(1))
    negative = F.greatest(F.count(F.lit(1)) - positive, F.lit(1))
    return train.agg(F.least(F.lit(cap), negative / positive).alias("__ratio"))


def add_weight(train: DataFrame, cap: float) -> DataFrame:
    weight = F.when(F.col("target_event_30m") == 1, F.col("__ratio")).otherwise(1.0)
    return with_row(train, class_ratio(train, cap)).withColumn("__weight", weight).drop("__ratio")


def soft_target(train: DataFrame, teacher_score: str) -> DataFrame:
    """0.72 of the label plus 0.28 of the teacher, and the student's sample weight."""
    target = 0.72 * F.col("target_event_30m") + 0.28 * F.col(teacher_score)
    return add_weight(train.withColumn("soft_target", target), 20.0).withColumnRenamed("__weight", "sample_weight")


def score_models(df: DataFrame, scorers: dict, keep: list[str]) -> DataFrame:
    """Score a table with every model and return (keep, model, score)."""
    wide = reduce(lambda d, item: item[1](d, f"score_{item[0]}"), scorers.items(), df)
    return wide.unpivot(keep, [f"score_{m}" for m in scorers], "model", "score").withColumn(
        "model", F.regexp_replace("model", "^score_", "")
    )


@dataclass(frozen=True)
class Platt:
    """Calibrated probability = 1 / (1 + exp(-(intercept + coefficient * log-odds of the score)))."""

    coefficient: float
    intercept: float

    def probability(self, score: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-(F.lit(self.intercept) + F.lit(self.coefficient) * logit(score))))


def fit_platt(df: DataFrame, score: str, label: str, strength: float) -> Platt:
    """Logistic fit on the log-odds; ``strength`` is the inverse penalty of the summed loss, the intercept is free.

    Rows are reduced to counts per score once; every Newton step is one aggregate over the counts,
    of which six numbers come back. A step that raises the loss is halved. A table of one
    class, or none, gets a constant: the rate of positives with one row of each class added.
    """
    spark = df.sparkSession
    path = new_path(spark, "platt-counts")
    y = F.col(label).cast("double")
    known = df.select(logit(F.col(score)).alias("x"), y.alias("y")).dropna()
    known.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("pos")).write.parquet(path)
    counts = spark.read.parquet(path)
    n, pos = counts.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("pos"), F.lit(0.0))).first()
    if not 0 < pos < n:
        return Platt(0.0, math.log((pos + 1) / (n - pos + 1)))
    a, b, step, loss = math.log(pos / (n - pos)), 0.0, (0.0, 0.0), math.inf
    for _ in range(100):
        z = F.lit(a + step[0]) + F.lit(b + step[1]) * F.col("x")
        p = 1.0 / (1.0 + F.exp(-z))
        h = F.col("n") * p * (1.0 - p)
        error = F.col("n") * p - F.col("pos")
        softplus = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        terms = [F.col("n") * softplus - F.col("pos") * z, error, error * F.col("x"), h, h * F.col("x"), h * F.col("x") * F.col("x")]
        value, ga, gb, haa, hab, hbb = counts.agg(*[F.sum(t) for t in terms]).first()
        value += (b + step[1]) ** 2 / (2 * strength)
        if value > loss * (1 + 1e-14):
            step = (step[0] / 2, step[1] / 2)
            continue
        if max(map(abs, step)) < 1e-12 and loss < math.inf:
            break
        a, b, loss = a + step[0], b + step[1], value
        gb, hbb = gb + b / strength, hbb + 1 / strength
        det = haa * hbb - hab * hab
        step = ((hab * gb - hbb * ga) / det, (hab * ga - haa * gb) / det)
    return Platt(b, a)


def apply_platt(model: Platt, df: DataFrame, score: str, name: str) -> DataFrame:
    """Calibrated probability as a plain column expression of the fitted line."""
    return df.withColumn(name, model.probability(F.col(score)))


def type_inputs(df: DataFrame, numeric: list[str], categorical: list[str], stats: DataFrame) -> DataFrame:
    """Median and mode for missing cells, missing flags, rare categories folded together.

    ``stats`` is the single row of ``type_statistics``.
    """
    df = with_row(df, stats)
    columns = {f"{MISSING}{c}": F.col(c).isNull().cast("double") for c in numeric}
    columns |= {f"__x_{c}": F.coalesce(F.col(c).cast("double"), F.col(f"__median_{c}"), F.lit(0.0)) for c in numeric}
    for c in categorical:
        value = F.coalesce(F.col(c).cast("string"), F.col(f"__mode_{c}"), F.lit("?"))
        columns[f"__c_{c}"] = F.when(F.array_contains(f"__common_{c}", value), value).otherwise("__rare")
    return df.withColumns(columns).drop(*stats.columns)


def type_statistics(train: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """One row: medians, modes, and the categories seen at least twice."""
    medians, modes = exact_medians(train, numeric), exact_modes(train, categorical)
    row = train.sparkSession.range(1).select(
        *[F.lit(medians[c]).cast("double").alias(f"__median_{c}") for c in numeric],
        *[F.lit(modes[c]).cast("string").alias(f"__mode_{c}") for c in categorical],
    )
    for c in categorical:
        common = train.groupBy(F.col(c).cast("string").alias("v")).count().where("count >= 2 AND v IS NOT NULL")
        row = with_row(row, common.agg(F.array_sort(F.collect_set("v")).alias(f"__common_{c}")))
    return row


def fit_type(
    train: DataFrame,
    numeric: list[str],
    categorical: list[str],
    label: str = "model_type",
    trees: int = 420,
    depth: int = 8,
    seed: int = 20260730,
) -> tuple[PipelineModel, DataFrame]:
    """Forest over imputed numbers and one-hot categories, classes weighted equally."""
    stats = type_statistics(train, numeric, categorical)
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    totals = counts.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    weights = with_row(counts, totals).select(label, (F.col("__all") / (F.col("__k") * F.col("__n"))).alias("__weight"))
    data = type_inputs(train, numeric, categorical, stats).join(F.broadcast(weights), label)
    label_index = StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc").fit(data)
    stages = [label_index]
    for c in categorical:
        stages.append(StringIndexer(inputCol=f"__c_{c}", outputCol=f"__i_{c}", handleInvalid="keep"))
    stages.append(OneHotEncoder(inputCols=[f"__i_{c}" for c in categorical], outputCols=[f"__o_{c}" for c in categorical]))
    inputs = [f"__x_{c}" for c in numeric] + [f"{MISSING}{c}" for c in numeric] + [f"__o_{c}" for c in categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="__features"))
    stages.append(
        RandomForestClassifier(
            featuresCol="__features",
            labelCol="__label",
            weightCol="__weight",
            numTrees=trees,
            maxDepth=depth,
            minInstancesPerNode=3,
            featureSubsetStrategy="sqrt",
            seed=seed,
            predictionCol="__prediction",
            probabilityCol="__probability",
            rawPredictionCol="__raw",
        )
    )
    stages.append(IndexToString(inputCol="__prediction", outputCol="predicted_type", labels=label_index.labels))
    return Pipeline(stages=stages).fit(data), stats


def score_type(model: PipelineModel, stats: DataFrame, df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Predicted type, its confidence, and the class probabilities with their labels."""
    stages = [s for s in model.stages if getattr(s, "getOutputCol", lambda: "")() != "__label"]
    scored = PipelineModel(stages).transform(type_inputs(df, numeric, categorical, stats))
    probability = vector_to_array("__probability")
    labels = F.array(*[F.lit(x) for x in model.stages[0].labels])
    return scored.select(
        *[c for c in df.columns if c != "predicted_type"],
        "predicted_type",
        F.array_max(probability).alias("prediction_confidence"),
        probability.alias("class_probabilities"),
        labels.alias("class_labels"),
    )
