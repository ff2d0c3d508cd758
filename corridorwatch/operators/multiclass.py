"""Classification of accident types and response families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridorwatch import vocabulary as V
from corridorwatch.functions.columns import literal_map, lookup
from corridorwatch.functions.rows import with_row


def response_family(accident_type: Column) -> Column:
    return lookup(V.RESPONSE_FAMILY, accident_type)


def family_actions(family: Column) -> Column:
    """Action set of a family; unknown families give NULL."""
    codes = {f: "|".join(a) for f, a in V.FAMILY_ACTIONS.items()}
    return F.split(lookup(codes, family), r"\|")


def set_intersect(left: Column, right: Column) -> Column:
    return F.array_sort(F.array_intersect(left, right))


def set_f1(left: Column, right: Column) -> Column:
    """F1 of two sets; 0 when they share nothing."""
    overlap = F.size(F.array_intersect(left, right))
    precision = overlap / F.greatest(F.size(left), F.lit(1))
    recall = overlap / F.greatest(F.size(right), F.lit(1))
    return 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))


def add_families(df: DataFrame) -> DataFrame:
    """True and predicted family, their action sets' F1."""
    df = df.withColumns(
        {
            "true_response_family": response_family(F.col("accident_type")),
            "predicted_response_family": response_family(F.col("predicted_type")),
        }
    )
    f1 = set_f1(family_actions(F.col("predicted_response_family")), family_actions(F.col("true_response_family")))
    return df.withColumn("policy_action_f1", f1)


def pair_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """One row per label in the given order, one column per predicted label, zero filled."""
    counts = (
        pair_counts(df, truth, predicted)
        .groupBy("truth")
        .agg(*[F.sum(F.when(F.col("predicted") == label, F.col("n"))).alias(label) for label in labels])
    )
    spark = df.sparkSession
    rows = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("position", "truth"))
    return rows.join(counts, "truth", "left").na.fill(0).select("position", "truth", *[f"`{x}`" for x in labels])


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class occurring on either side."""
    pairs = pair_counts(df, truth, predicted)
    per = reduce(
        DataFrame.unionByName,
        [
            pairs.select(F.col("truth").alias("label"), F.lit(0).alias("as_predicted"), F.col("n").alias("as_truth"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits")),
            pairs.select(F.col("predicted").alias("label"), F.col("n").alias("as_predicted"), F.lit(0).alias("as_truth"), F.lit(0).alias("hits")),
        ],
    )
    totals = per.groupBy("label").agg(
        F.sum("hits").alias("hits"), F.sum("as_predicted").alias("predicted"), F.sum("as_truth").alias("support")
    )
    hits = F.col("hits")

    def share(b: Column) -> Column:
        return F.when(b == 0, 0.0).otherwise(hits / b)

    return totals.select(
        "label",
        "hits",
        "support",
        share(F.col("predicted")).alias("precision"),
        share(F.col("support")).alias("recall"),
        F.when(F.col("predicted") + F.col("support") == 0, 0.0)
        .otherwise(2 * hits / (F.col("predicted") + F.col("support")))
        .alias("f1"),
    )


def multiclass_metrics(df: DataFrame, truth: str, predicted: str, labels: list[str] | None = None) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted F1 in one row.

    Macro F1 averages over ``labels`` if given (absent classes count 0), else over
    the classes that occur.
    """
    report = class_report(df, truth, predicted)
    support = F.col("support")
    listed = F.lit(True) if labels is None else F.col("label").isin(labels)
    classes = F.count_if(listed) if labels is None else F.lit(len(labels))
    return report.agg(
        F.sum("support").alias("rows"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(support > 0, F.col("recall"))).alias("balanced_accuracy"),
        (F.sum(F.when(listed, F.col("f1")).otherwise(0.0)) / classes).alias("macro_f1"),
        (F.sum(F.col("f1") * support) / F.sum("support")).alias("weighted_f1"),
    )


def family_summary(predictions: DataFrame) -> DataFrame:
    """Type accuracy, family metrics and the mean action F1 in one row."""
    df = add_families(predictions)
    family = multiclass_metrics(df, "true_response_family", "predicted_response_family", V.FAMILY_LABELS)
    plain = df.agg(
        F.count(F.lit(1)).alias("test_events"),
        F.avg((F.col("accident_type") == F.col("predicted_type")).cast("double")).alias("six_class_type_accuracy"),
        F.avg("policy_action_f1").alias("mean_policy_action_f1"),
    )
    named = family.select(
        F.col("accuracy").alias("operational_family_accuracy"),
        F.col("balanced_accuracy").alias("operational_family_balanced_accuracy"),
        F.col("macro_f1").alias("operational_family_macro_f1"),
    )
    return with_row(plain, named)


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """Occurrences of every value but NULL, most frequent first."""
    counts = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.col("count").desc(), name)


def label_of(mapping: dict, key: Column) -> Column:
    """Lookup with the key itself as default."""
    return F.coalesce(F.try_element_at(literal_map(mapping), key), key)
