"""Classification metrics as aggregates (R3 use, A12-A14, J6).

Everything is computed from (truth, pred) counts; no per-row Python.  Class
rows come from the union of true and predicted labels, zero denominators give
0 (as the reference's report does).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.operators.ranking import batch_number


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def align_predictions(pred: DataFrame, truth: DataFrame, key="row_id") -> DataFrame:
    """Pair each prediction with its truth by row id."""
    return pred.join(truth, key, "inner")


def confusion_counts(df: DataFrame, truth: str = "truth", pred: str = "pred",
                     group: list[str] | None = None) -> DataFrame:
    """(group..., truth, pred, n)."""
    g = list(group or [])
    return df.groupBy(*g, truth, pred).agg(F.count(F.lit(1)).alias("n"))


def per_class_counts(df: DataFrame, truth: str = "truth", pred: str = "pred",
                     group: list[str] | None = None) -> DataFrame:
    """(group..., label, tp, n_pred, n_truth) for every label seen on either
    side -- each row contributes to its predicted and to its true label."""
    g = list(group or [])
    sides = F.explode(F.array(
        F.struct(F.col(pred).alias("label"), F.lit(1).alias("p"), F.lit(0).alias("t"),
                 (F.col(pred) == F.col(truth)).cast("int").alias("tp")),
        F.struct(F.col(truth).alias("label"), F.lit(0).alias("p"), F.lit(1).alias("t"),
                 F.lit(0).alias("tp")),
    )).alias("s")
    return df.select(*g, sides).groupBy(*g, "s.label").agg(
        F.sum("s.tp").cast("long").alias("tp"), F.sum("s.p").cast("long").alias("n_pred"),
        F.sum("s.t").cast("long").alias("n_truth"))


def classification_report(df: DataFrame, truth: str = "truth", pred: str = "pred",
                          group: list[str] | None = None) -> DataFrame:
    """Per class precision / recall / f1 / support, then 'accuracy',
    'macro avg' and 'weighted avg' rows (weights = true support).
    Columns: group..., label (string), precision, recall, f1, support."""
    g = list(group or [])
    c = per_class_counts(df, truth, pred, g)
    prec = _safe_div(F.col("tp"), F.col("n_pred"))
    rec = _safe_div(F.col("tp"), F.col("n_truth"))
    f1 = _safe_div(2 * F.col("tp"), F.col("n_pred") + F.col("n_truth"))
    rows = c.select(*g, F.col("label").cast("string").alias("label"), prec.alias("precision"),
                    rec.alias("recall"), f1.alias("f1"), F.col("n_truth").alias("support"),
                    F.col("tp"))
    tot = rows.groupBy(*g).agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("n"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = tot.select(*g, F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"),
                     _safe_div(F.col("tp"), F.col("n")).alias("f1"), F.col("n").alias("support"))
    macro = tot.select(*g, F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").alias("support"))
    weighted = tot.select(*g, F.lit("weighted avg").alias("label"),
                          _safe_div(F.col("wp"), F.col("n")).alias("precision"),
                          _safe_div(F.col("wr"), F.col("n")).alias("recall"),
                          _safe_div(F.col("wf"), F.col("n")).alias("f1"), F.col("n").alias("support"))
    return rows.drop("tp").unionByName(acc).unionByName(macro).unionByName(weighted)


def batched_weighted_f1(df: DataFrame, order_key: str, batch_size: int = 32, truth: str = "truth",
                        pred: str = "pred", weights: str = "predicted",
                        group: list[str] | None = None) -> DataFrame:
    """Weighted F1 of every batch of `batch_size` rows in `order_key`
    order, then the plain mean over batches (the last, shorter batch counts
    fully).  `weights='predicted'` reproduces the reference's swapped
    arguments (Q11); 'truth' weights by true support.  One row per group."""
    g = list(group or [])
    b = batch_number(df, order_key, batch_size, group=g)
    c = per_class_counts(b, truth, pred, [*g, "batch"])
    w = F.col("n_pred") if weights == "predicted" else F.col("n_truth")
    f1 = _safe_div(2 * F.col("tp"), F.col("n_pred") + F.col("n_truth"))
    per_batch = c.groupBy(*g, "batch").agg(_safe_div(F.sum(f1 * w), F.sum(w)).alias("f1"))
    return per_batch.groupBy(*g).agg(F.avg("f1").alias("mean_f1"), F.count(F.lit(1)).cast("long").alias("n_batches"))
