"""Measures of predictions: confusion, accuracy, ROC, threshold curves, summaries over folds.

Predictions have label, prediction and possibly fold; scored records have label (0 or 1), score in [0, 1].
`by` names the columns measured apart, usually ("fold",).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleloom.operators.indexing import depth_ranges

THRESHOLDS = tuple(i / 10 for i in range(1, 11))
DECISION_THRESHOLD = 0.6


def confusion(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return predictions.groupBy(*by, "label", "prediction").agg(F.count("*").alias("n"))


def accuracy(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    right = (F.col("label") == F.col("prediction")).cast("double")
    return predictions.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.avg(1.0 - right).alias("test_error")
    )


def cv_confusion(fold_matrices: DataFrame) -> DataFrame:
    """Confusion matrices of all folds added cell by cell, as shares of all records."""
    cells = fold_matrices.groupBy("label", "prediction").agg(F.sum("n").alias("n"))
    # One row per cell: the window holds classes x classes rows.
    everyone = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return cells.withColumn("share", F.col("n") / F.sum("n").over(everyone))


def describe(measures: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(measure, mean, variance, stddev) of each column over the rows, e.g. folds; population formulas."""
    rows = measures.select(
        *by, F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns]))
    )
    return rows.groupBy(*by, "measure").agg(
        F.avg("v").alias("mean"), F.var_pop("v").alias("variance"), F.stddev_pop("v").alias("stddev")
    )


def _cumulative(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per distinct score: its positives and negatives, and those at or above it (tp, fp). Rows without a score are left out.

    Score ranges hold about equally many points, wherever the scores crowd. Their totals are summed first, so a window
    spans the points of one range or the ranges of one curve, never the points of a curve.
    """
    positive = F.col("label") == 1
    points = scored.where(F.col("score").isNotNull()).groupBy(*by, "score").agg(
        F.count(F.when(positive, 1)).alias("pos"), F.count(F.when(~positive, 1)).alias("neg")
    )
    points = depth_ranges(points, [*[F.asc(c) for c in by], F.desc("score")], "_range")
    sums = points.groupBy(*by, "_range").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    one = [*by] or [F.lit(0)]
    above = W.partitionBy(*one).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *by, "_range", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("_pos", "_neg")]
    )
    inside = W.partitionBy(*by, "_range").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    return (
        points.join(F.broadcast(offsets), [*by, "_range"])
        .withColumn("tp", F.sum("pos").over(inside) + F.col("_pos_above"))
        .withColumn("fp", F.sum("neg").over(inside) + F.col("_neg_above"))
        .select(*by, "score", "pos", "neg", "tp", "fp")
    )


def _class_totals(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    positive = F.col("label") == 1
    return scored.groupBy(*by).agg(
        F.count(F.when(positive, 1)).alias("positives"), F.count(F.when(~positive, 1)).alias("negatives")
    )


def roc(scored: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """ROC points at every distinct score, from (0, 0) to (1, 1); `score` is null at both ends.

    The rate of a class without records is 0.
    """
    totals = _class_totals(scored, by)
    curve = (
        _cumulative(scored, by)
        .join(F.broadcast(totals), [*by])
        .select(
            *by,
            F.lit(1).alias("part"),
            "score",
            F.coalesce(F.try_divide("fp", "negatives"), F.lit(0.0)).alias("fpr"),
            F.coalesce(F.try_divide("tp", "positives"), F.lit(0.0)).alias("tpr"),
        )
    )
    ends = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(part).alias("part"),
                    F.lit(None).cast("double").alias("score"),
                    F.lit(at).alias("fpr"),
                    F.lit(at).alias("tpr"),
                )
                for part, at in ((0, 0.0), (2, 1.0))
            ]
        )
    )
    return curve.unionByName(totals.select(*by, ends))


def auc(scored: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Area under the ROC curve by trapezoids: each score adds its negatives times the mean true positives.

    Without positives the curve runs along the bottom, area 0; without negatives along the top, area 1.
    """
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    positives, negatives = F.sum("pos"), F.sum("neg").cast("double")
    share = F.when(positives == 0, 0.0).when(negatives == 0, 1.0).otherwise(F.try_divide(area, positives * negatives))
    return _cumulative(scored, by).groupBy(*by).agg(share.alias("auc"))


def threshold_predict(scored: DataFrame, threshold: float = DECISION_THRESHOLD) -> DataFrame:
    return scored.withColumn("prediction", F.when(F.col("score") < threshold, 0).otherwise(1))


def accuracy_curve(
    scored: DataFrame, by: Sequence[str] = ("fold",), thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """Accuracy at each threshold, all thresholds in one aggregation."""
    right = [
        F.avg(((F.col("score") >= t) == (F.col("label") == 1)).cast("double")).alias(f"_t{i}")
        for i, t in enumerate(thresholds)
    ]
    points = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_t{i}").alias("accuracy"))
            for i, t in enumerate(thresholds)
        ]
    )
    return scored.groupBy(*by).agg(*right).select(*by, F.inline(points))


def mean_curve(curves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and standard deviation of the accuracy over folds, per threshold."""
    return curves.groupBy(*by, "threshold").agg(
        F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("stddev")
    )


def best_threshold(curves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The threshold with the best mean accuracy; the lowest on ties."""
    order = F.struct(-F.round("mean", 12), F.col("threshold"))
    return (
        mean_curve(curves, by)
        .groupBy(*by)
        .agg(F.min_by(F.struct("threshold", "mean", "stddev"), order).alias("best"))
        .select(*by, "best.threshold", "best.mean", "best.stddev")
    )
