"""Boosted trees fitted in legs that survive lost executors and can be resumed.

A leg is a short run of MLlib's boosted trees. Between legs the raw scores of the training
rows are written next to the leg's model, so the lineage never holds more than one leg, and a
fit that stops goes on behind its last finished leg. The next leg is fitted on the working
residual of the raw scores: of the label for the squared loss; for the logistic loss
(label - p) / (p (1 - p)), weighted by p (1 - p). A leg aims at the share of that residual that its
rounds would take away at the step size, 1 - (1 - step) ^ rounds.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridorwatch.functions.columns import clip
from corridorwatch.functions.rows import with_row

MISSING = "__missing_"
#: Working residuals of the logistic loss stay within this bound.
MOST = 4.0
#: Rows of a partition while a leg is fitted: a round is a short job per level, whose tasks cost more than a few rows do.
PARTITION_ROWS = 8192


@dataclass(frozen=True)
class BoostConfig:
    """``rounds`` trees of at most ``depth`` levels, fitted ``leg_rounds`` at a time."""

    rounds: int
    depth: int
    step: float
    min_rows: int
    leg_rounds: int = 30
    row_share: float = 0.85
    feature_share: str = "0.82"
    seed: int = 20260730

    def legs(self) -> list[int]:
        """The rounds of every leg."""
        whole, rest = divmod(self.rounds, self.leg_rounds)
        return [self.leg_rounds] * whole + [rest] * (rest > 0)


#: Fixed values of the study's two kinds of models.
TEACHER = BoostConfig(rounds=360, depth=8, step=0.035, min_rows=45)
STUDENT = BoostConfig(rounds=96, depth=5, step=0.045, min_rows=55, leg_rounds=24)


def add_inputs(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles with 0 for missing, plus a missing flag each."""
    return df.withColumns(
        {f"__x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features}
        | {f"{MISSING}{c}": F.col(c).isNull().cast("double") for c in features}
    )


def assembler(features: list[str]) -> VectorAssembler:
    inputs = [f"__x_{c}" for c in features] + [f"{MISSING}{c}" for c in features]
    return VectorAssembler(inputCols=inputs, outputCol="__features")


@dataclass
class Boosted:
    """Legs with the features they read; ``base`` is the raw score before the first tree."""

    features: list[str]
    logistic: bool
    base: float
    config: BoostConfig
    folder: str
    legs: list[GBTRegressionModel] = field(default_factory=list)

    def raw(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        """``df`` with the output of every leg, and the raw score after each of them."""
        scored = assembler(self.features).transform(add_inputs(df, self.features))
        total, after = F.lit(self.base), []
        for k, leg in enumerate(self.legs):
            scored = leg.setFeaturesCol("__features").setPredictionCol(f"__leg_{k}").transform(scored)
            total = total + F.col(f"__leg_{k}")
            after.append(total)
        return scored, after

    def score_of(self, raw: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-raw)) if self.logistic else clip(raw, 0.0, 1.0)

    def score(self, df: DataFrame, name: str) -> DataFrame:
        scored, after = self.raw(df)
        return scored.withColumn(name, self.score_of(after[-1] if after else F.lit(self.base))).select(*df.columns, name)


def _residual(logistic: bool) -> tuple[Column, Column]:
    """The working residual of the raw score and the factor of the row's weight."""
    if not logistic:
        return F.col("y") - F.col("raw"), F.lit(1.0)
    p = 1.0 / (1.0 + F.exp(-F.col("raw")))
    h = F.greatest(p * (1.0 - p), F.lit(1e-6))
    return clip((F.col("y") - p) / h, -MOST, MOST), h


def _finished(spark, path: str) -> DataFrame | None:
    """The written raw scores of a leg; a write that was cut off has no files."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def boost(train: DataFrame, features: list[str], label: str, weight: str, logistic: bool, config: BoostConfig, folder: str) -> Boosted:
    """Fit in legs below ``folder``; legs that are finished there are taken as they are.

    A folder belongs to one training table and one configuration but for ``rounds``: more
    rounds in whole legs continue an earlier fit.
    """
    spark = train.sparkSession
    begin = f"{folder}/start"
    rows = _finished(spark, begin)
    if rows is None:
        given = assembler(features).transform(add_inputs(train, features))
        flat = given.select("__features", F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"))
        mean = flat.agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("mean"))
        share = clip(F.coalesce("mean", F.lit(0.5)), 1e-6, 1 - 1e-6)
        base = mean.select((F.ln(share / (1.0 - share)) if logistic else F.coalesce("mean", F.lit(0.0))).alias("raw"))
        with_row(flat, base).write.mode("overwrite").parquet(begin)
        rows = spark.read.parquet(begin)
    first = rows.select("raw").head()
    model = Boosted(features, logistic, float(first.raw) if first else 0.0, config, folder)
    for k, rounds in enumerate(config.legs() if first else []):
        model.legs.append(_leg(rows, f"{folder}/leg-{k:03d}-{rounds}", rounds, logistic, replace(config, seed=config.seed + k)))
        rows = spark.read.parquet(f"{folder}/leg-{k:03d}-{rounds}/rows")
    return model


def _leg(rows: DataFrame, path: str, rounds: int, logistic: bool, config: BoostConfig) -> GBTRegressionModel:
    if _finished(rows.sparkSession, f"{path}/rows") is not None:
        return GBTRegressionModel.load(f"{path}/model")
    residual, factor = _residual(logistic)
    aim = 1.0 - (1.0 - config.step) ** rounds
    trees = GBTRegressor(
        featuresCol="__features",
        labelCol="z",
        weightCol="zw",
        predictionCol="__leg",
        maxIter=rounds,
        maxDepth=config.depth,
        stepSize=config.step,
        subsamplingRate=config.row_share,
        featureSubsetStrategy=config.feature_share,
        minInstancesPerNode=config.min_rows,
        seed=config.seed,
    )
    given = rows.select("__features", (residual * aim).alias("z"), (F.col("w") * factor).alias("zw"))
    leg = trees.fit(given.coalesce(-(-rows.count() // PARTITION_ROWS)))
    leg.write().overwrite().save(f"{path}/model")
    # the scores come last: they mark the leg as finished
    scored = leg.transform(rows).select("__features", "y", "w", (F.col("raw") + F.col("__leg")).alias("raw"))
    scored.write.mode("overwrite").parquet(f"{path}/rows")
    return leg


def leg_history(model: Boosted, datasets: dict[str, DataFrame], label: str, name: str) -> DataFrame:
    """(model, dataset, metric, iteration, value): the loss after every leg, one pass per data set."""
    done = [sum(model.config.legs()[: k + 1]) for k in range(len(model.legs))]
    parts = []
    for dataset, df in datasets.items():
        scored, after = model.raw(df)
        y = F.col(label).cast("double")
        losses = []
        for raw in after:
            p = clip(model.score_of(raw), 1e-15, 1 - 1e-15)
            loss = -(y * F.ln(p) + (1.0 - y) * F.ln(1.0 - p)) if model.logistic else F.pow(y - raw, F.lit(2.0))
            losses.append(F.avg(loss))
        metric = "binary_logloss" if model.logistic else "l2"
        entries = [F.struct(F.lit(n).cast("long").alias("iteration"), loss.alias("value")) for n, loss in zip(done, losses)]
        long = scored.agg(F.array(*entries).alias("e")).select(F.explode("e").alias("e"))
        parts.append(long.select(F.lit(name).alias("model"), F.lit(dataset).alias("dataset"), F.lit(metric).alias("metric"), "e.iteration", "e.value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def tree_importance(model: Boosted, spark) -> DataFrame:
    """feature, gain_importance, split_importance, gain_share, largest gain first.

    Read from the nodes of the saved trees: a feature's value and missing flag count together, a
    split's gain by the rows it splits.
    """
    names = spark.createDataFrame([(i, f) for i, f in enumerate(model.features * 2)], "at int, feature string")
    nodes = [spark.read.parquet(f"{model.folder}/leg-{k:03d}-{n}/model/data") for k, n in enumerate(model.config.legs()[: len(model.legs)])]
    found = names.select("feature", F.lit(0.0).alias("gain"), F.lit(0).cast("long").alias("splits"))
    for part in nodes:
        split = part.where("nodeData.split.featureIndex >= 0").select(
            F.col("nodeData.split.featureIndex").alias("at"), (F.col("nodeData.gain") * F.col("nodeData.rawCount")).alias("gain"), F.lit(1).cast("long").alias("splits")
        )
        found = found.unionByName(split.join(names, "at").select("feature", "gain", "splits"))
    sums = found.groupBy("feature").agg(F.sum("gain").alias("gain_importance"), F.sum("splits").alias("split_importance"))
    total = sums.agg(F.greatest(F.sum("gain_importance"), F.lit(1e-12)).alias("total"))
    share = (F.col("gain_importance") / F.col("total")).alias("gain_share")
    return with_row(sums, total).select("feature", "gain_importance", "split_importance", share).orderBy(F.col("gain_importance").desc(), "feature")
