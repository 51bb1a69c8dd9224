"""Evaluation of class predictions: confusion, gates, calibration, ranking quality."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photospark.functions.rules import CLASS_NAMES
from photospark.functions.scalars import arg_max
from photospark.plans.prefix import prefix_sum, range_cells

N_CLASSES = len(CLASS_NAMES)

# Acceptance thresholds; the last two are upper limits.
THRESHOLDS = {"accuracy": 0.90, "planet_recall": 0.85, "planet_precision": 0.80, "fpr": 0.10, "ece": 0.04}


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, F.try_divide(a, b)).otherwise(F.lit(0.0))


def confusion(df: DataFrame, y: str = "label", pred: str = "pred") -> DataFrame:
    """Counts of every (true, predicted) pair, empty cells included: one row per true class."""
    cells = df.agg(*[
        F.count_if((F.col(y) == i) & (F.col(pred) == j)).alias(f"_{i}{j}")
        for i in range(N_CLASSES) for j in range(N_CLASSES)
    ])
    rows = ", ".join(f"{i}, " + ", ".join(f"_{i}{j}" for j in range(N_CLASSES)) for i in range(N_CLASSES))
    names = ", ".join(f"pred_{j}" for j in range(N_CLASSES))
    return cells.selectExpr(f"stack({N_CLASSES}, {rows}) AS (label, {names})")


def binary_rates(df: DataFrame, y: str = "label", pred: str = "pred", positive: int = 0) -> DataFrame:
    """One row: rows, accuracy, and recall, precision and false-positive rate of the positive class."""
    true, hit = F.col(y) == positive, F.col(pred) == positive
    counts = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == F.col(pred)).alias("_ok"),
        F.count_if(true).alias("_p"), F.count_if(hit).alias("_h"), F.count_if(true & hit).alias("_tp"),
        F.count_if(~true).alias("_n"), F.count_if(~true & hit).alias("_fp"),
    )
    return counts.select(
        "n", _ratio(F.col("_ok"), F.col("n")).alias("accuracy"), _ratio(F.col("_tp"), F.col("_p")).alias("planet_recall"),
        _ratio(F.col("_tp"), F.col("_h")).alias("planet_precision"), _ratio(F.col("_fp"), F.col("_n")).alias("fpr"),
    )


def binary_gates(rates: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Add a pass flag per rate and the severity: 0 all passed, 1 a critical gate failed, 2 another one.

    Accuracy, recall and calibration are critical. A rate the table does not have is not judged.
    """
    upper, critical = {"fpr", "ece"}, {"accuracy", "planet_recall", "ece"}
    judged = [n for n in thresholds if n in rates.columns]
    passed = {
        n: (F.col(n) <= thresholds[n]) if n in upper else (F.col(n) >= thresholds[n]) for n in judged
    }
    fails = lambda names: reduce(lambda a, b: a | b, [~passed[n] for n in names], F.lit(False))
    severity = F.when(fails([n for n in judged if n in critical]), 1).when(
        fails([n for n in judged if n not in critical]), 2
    ).otherwise(0)
    return rates.withColumns({**{f"{n}_pass": p for n, p in passed.items()}, "severity": severity})


def class_report(df: DataFrame, y: str = "label", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class; 0 for a zero denominator."""
    counts = df.agg(*[
        c for i in range(N_CLASSES) for c in (
            F.count_if((F.col(y) == i) & (F.col(pred) == i)).alias(f"_tp{i}"),
            F.count_if(F.col(pred) == i).alias(f"_h{i}"), F.count_if(F.col(y) == i).alias(f"_s{i}"),
        )
    ])
    rows = ", ".join(f"{i}, '{n}', _tp{i}, _h{i}, _s{i}" for i, n in enumerate(CLASS_NAMES))
    long = counts.selectExpr(f"stack({N_CLASSES}, {rows}) AS (label, name, _tp, _h, support)")
    p, r = _ratio(F.col("_tp"), F.col("_h")), _ratio(F.col("_tp"), F.col("support"))
    return long.select(
        "label", "name", p.alias("precision"), r.alias("recall"), _ratio(p * r * 2.0, p + r).alias("f1"), "support"
    )


def macro_f1(report: DataFrame, present_only: bool = True) -> DataFrame:
    """One row: mean F1 over the classes that occur."""
    rows = report.filter((F.col("support") > 0) | (F.col("f1") > 0)) if present_only else report
    return rows.agg(F.avg("f1").alias("f1_macro"))


def _confidence_bins(df: DataFrame, y: str, probs: str, n_bins: int, keys: Sequence[str] = ()) -> DataFrame:
    top = F.array_max(probs)
    index = (F.ceil(top * n_bins) - 1).cast("int")
    return df.filter(top > 0).groupBy(*keys, index.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.sum(top).alias("_conf"),
        F.sum((arg_max(F.col(probs)) == F.col(y)).cast("double")).alias("_ok"),
    )


def calibration(df: DataFrame, y: str = "label", probs: str = "probs", n_bins: int = 10) -> DataFrame:
    """Reliability table: accuracy and mean confidence per confidence bin (low, high], empty bins 0."""
    binned = _confidence_bins(df, y, probs, n_bins)
    spine = df.sparkSession.range(n_bins).select(
        F.col("id").cast("int").alias("bin"), ((F.col("id") + 0.5) / n_bins).alias("bin_center")
    )
    zero = F.lit(0.0)
    return spine.join(binned, "bin", "left").select(
        "bin", "bin_center",
        F.coalesce(F.try_divide("_ok", "count"), zero).alias("accuracy"),
        F.coalesce(F.try_divide("_conf", "count"), zero).alias("confidence"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )


def expected_calibration_error(
    df: DataFrame, y: str = "label", probs: str = "probs", n_bins: int = 10, keys: Sequence[str] = ()
) -> DataFrame:
    """Mean gap between accuracy and confidence, weighted by bin size."""
    binned = _confidence_bins(df, y, probs, n_bins, keys)
    gap = F.sum(F.abs(F.col("_ok") - F.col("_conf")))
    return binned.groupBy(*keys).agg((gap / F.sum("count")).alias("ece"))


def roc_auc_ovr(df: DataFrame, y: str = "label", probs: str = "probs") -> DataFrame:
    """Area under the ROC curve of every class against the rest; null if a class is absent or alone.

    Rows are reduced to distinct scores. A score's positives beat all
    negatives with a lower score and half of those with the same one; the
    negatives below come from a running total over range-partitioned scores.
    """
    long = df.select(
        y, F.posexplode(probs).alias("label_class", "score")
    ).select(
        "label_class", "score", (F.col(y) == F.col("label_class")).cast("bigint").alias("_p"),
    )
    scores = long.groupBy("label_class", "score").agg(
        F.sum("_p").alias("pos"), (F.count(F.lit(1)) - F.sum("_p")).alias("neg")
    )
    celled = range_cells(scores, [F.col("label_class"), F.col("score")], "_range")
    running = prefix_sum(celled, ["label_class"], F.col("_range"), [F.col("score")], {"below": F.col("neg")})
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") * 0.5))
    positives, negatives = F.sum("pos"), F.sum("neg")
    return running.groupBy("label_class").agg(
        positives.alias("n_pos"), negatives.alias("n_neg"),
        F.when((positives > 0) & (negatives > 0), F.try_divide(wins, positives.cast("double") * negatives)).alias("auc"),
    )


def macro_auc(auc: DataFrame) -> DataFrame:
    """One row: mean area over all classes, null if one of them is undefined."""
    return auc.agg(F.when(F.count("auc") == F.count(F.lit(1)), F.avg("auc")).alias("roc_auc"))


def class_weights(df: DataFrame, y: str = "label") -> DataFrame:
    """Balanced weight n / (k * n_class) over the k classes present; an absent class gets 1."""
    counts = df.filter(F.col(y).between(0, N_CLASSES - 1)).agg(
        *[F.count_if(F.col(y) == i).alias(f"_{i}") for i in range(N_CLASSES)]
    )
    total = " + ".join(f"_{i}" for i in range(N_CLASSES))
    present = " + ".join(f"if(_{i} > 0, 1, 0)" for i in range(N_CLASSES))
    rows = ", ".join(f"{i}, _{i}" for i in range(N_CLASSES))
    return counts.selectExpr(f"{total} AS _n", f"{present} AS _k", f"stack({N_CLASSES}, {rows}) AS (label, n)").select(
        "label", "n",
        F.when(F.col("n") > 0, F.try_divide(F.col("_n").cast("double"), F.col("_k") * F.col("n"))).otherwise(F.lit(1.0)).alias("weight"),
    )


def evaluate(df: DataFrame, y: str = "label", pred: str = "pred", probs: str = "probs") -> DataFrame:
    """All headline metrics of a test table in one row, with gates and severity.

    Rows without label or prediction are left out.
    """
    rows = df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull())
    table = binary_rates(rows, y, pred)
    for part in (
        expected_calibration_error(rows, y, probs),
        macro_f1(class_report(rows, y, pred)),
        macro_auc(roc_auc_ovr(rows, y, probs)),
    ):
        table = table.unionByName(part, allowMissingColumns=True)
    # four rows, each with its own columns filled
    return binary_gates(table.agg(*[F.max(c).alias(c) for c in table.columns]))
