"""Label counts (A10/U4), pairing and evaluation of stored predictions.

The heads themselves are trained and scored by `operators/trainer.py` (M1, M2,
A15).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def num_labels(df: DataFrame, targets) -> DataFrame:
    """A10 (+U4): number of distinct non-null labels per target, one row.

    Unpivot + distinct (target, label) pairs with map-side partial aggregation,
    instead of N count-distincts that would expand every row N times."""
    targets = list(targets)
    pairs = df.select(*[F.col(c).cast("int").alias(c) for c in targets]) \
        .unpivot([], targets, "target", "label") \
        .where(F.col("label").isNotNull()) \
        .distinct()
    counts = pairs.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    wide = counts.groupBy().pivot("target", targets).agg(F.first("n"))
    return wide.select(*[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in targets])


def paired(scored: DataFrame, truth: DataFrame, key: str, targets) -> DataFrame:
    """(key, target, truth, pred) of the rows that have both."""
    from threadline.operators.metrics import align_predictions
    long_truth = truth.select(key, *[F.col(t).cast("int").alias(t) for t in targets]) \
        .unpivot([key], list(targets), "target", "truth")
    return align_predictions(scored, long_truth, [key, "target"]).select(key, "target", "truth", "pred")


def evaluate(pairs: DataFrame, key: str, label_map_df=None, batch_size: int = 32) -> DataFrame:
    """M3: per target the report in original labels (J5 -> A13) and the mean
    weighted F1 over batches in key order (A14, label `mean batch f1`, its
    support the number of batches)."""
    from threadline.operators.metrics import batched_weighted_f1, classification_report
    batched = batched_weighted_f1(pairs, key, batch_size, group=["target"]).select(
        "target", F.lit("mean batch f1").alias("label"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), F.col("mean_f1").alias("f1"),
        F.col("n_batches").alias("support"))
    if label_map_df is not None:
        pairs = _decode_pairs(pairs, label_map_df)
    return classification_report(pairs, group=["target"]).unionByName(batched)


def _decode_pairs(pairs: DataFrame, label_map_df: DataFrame) -> DataFrame:
    """J5 on a long (target, truth, pred) table: a broadcast-free left join on
    (target, encoded label) per side; the map has a row per negative label."""
    m = label_map_df.select("target", "encoded_label", "original_label")
    for side in ("truth", "pred"):
        mm = m.select(F.col("target").alias("__t"), F.col("encoded_label").alias("__e"),
                      F.col("original_label").alias("__o"))
        pairs = pairs.join(mm, (F.col("target") == F.col("__t")) & (F.col(side) == F.col("__e")), "left") \
            .withColumn(side, F.coalesce(F.col("__o"), F.col(side))).drop("__t", "__e", "__o")
    return pairs
