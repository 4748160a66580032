"""Metric queries over the `scores` view (logits per row, true label)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadline.functions.arrays import argmax
from threadline.functions.text import parse_scores
from threadline.operators import metrics as M
from threadline.plans import fixtures as fx
from threadline.plans.catalog import register

BATCH = 32
_S = fx.with_ctes(fx.SQL_SCORES)
_PRED = _S + """, pr AS (SELECT row_id, truth,
  CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred FROM scores)
"""


def _pred(spark, sf):
    return fx.scores(spark, sf).select("row_id", "truth", argmax("logits").alias("pred"))


@register("argmax", sql=_PRED + "SELECT row_id, pred FROM pr")
def q_argmax(spark, sf):
    return _pred(spark, sf).select("row_id", "pred")


@register("confusion", sql=_PRED + "SELECT truth, pred, count(*) AS n FROM pr GROUP BY truth, pred")
def q_confusion(spark, sf):
    return M.confusion_counts(_pred(spark, sf))


_COUNTS = """, sides AS (SELECT pred AS label, 1 AS p, 0 AS t, CAST(pred = truth AS INTEGER) AS tp FROM pr
                UNION ALL SELECT truth, 0, 1, 0 FROM pr),
c AS (SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(p) AS BIGINT) AS n_pred,
             CAST(sum(t) AS BIGINT) AS n_truth FROM sides GROUP BY label),
r AS (SELECT CAST(label AS VARCHAR) AS label,
             CASE WHEN n_pred = 0 THEN 0.0 ELSE tp / n_pred END AS precision,
             CASE WHEN n_truth = 0 THEN 0.0 ELSE tp / n_truth END AS recall,
             CASE WHEN n_pred + n_truth = 0 THEN 0.0 ELSE 2 * tp / (n_pred + n_truth) END AS f1,
             n_truth AS support, tp FROM c),
tot AS (SELECT sum(tp) AS tp, sum(support) AS n, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
               sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM r)
"""


@register("classification_report", sql=_PRED + _COUNTS + """
SELECT label, precision, recall, f1, support FROM r
UNION ALL SELECT 'accuracy', NULL, NULL, tp / n, CAST(n AS BIGINT) FROM tot
UNION ALL SELECT 'macro avg', mp, mr, mf, CAST(n AS BIGINT) FROM tot
UNION ALL SELECT 'weighted avg', wp / n, wr / n, wf / n, CAST(n AS BIGINT) FROM tot""")
def q_classification_report(spark, sf):
    return M.classification_report(_pred(spark, sf))


def _sql_batched(weight: str) -> str:
    return _PRED + f""", b AS (SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // {BATCH} AS batch FROM pr),
sides AS (SELECT batch, pred AS label, 1 AS p, 0 AS t, CAST(pred = truth AS INTEGER) AS tp FROM b
          UNION ALL SELECT batch, truth, 0, 1, 0 FROM b),
c AS (SELECT batch, label, sum(tp) AS tp, sum(p) AS n_pred, sum(t) AS n_truth FROM sides GROUP BY batch, label),
pb AS (SELECT batch, sum(CASE WHEN n_pred + n_truth = 0 THEN 0.0 ELSE 2.0 * tp / (n_pred + n_truth) END * {weight})
                     / sum({weight}) AS f1 FROM c GROUP BY batch)
SELECT avg(f1) AS mean_f1, count(*) AS n_batches FROM pb"""


@register("batched_f1", sql=_sql_batched("n_pred"))
def q_batched_f1(spark, sf):
    return M.batched_weighted_f1(_pred(spark, sf), "row_id", BATCH)


@register("batched_f1_truth_weights", sql=_sql_batched("n_truth"))
def q_batched_f1_truth(spark, sf):
    return M.batched_weighted_f1(_pred(spark, sf), "row_id", BATCH, weights="truth")


# Printed score blocks: every cell holds up to four rows of logits printed as
# integer micro-units, '[a b c]\n[d e f]' (the shape the notebook reads back).
ROWS_PER_CELL = 4


def _printed(spark, sf):
    s = fx.scores(spark, sf)
    line = F.concat(F.lit("["), F.array_join(F.transform(
        "logits", lambda x: F.round(x * 1e6).cast("long").cast("string")), " "), F.lit("]"))
    cells = s.select(F.floor(F.col("row_id") / ROWS_PER_CELL).cast("long").alias("cell_id"),
                     F.struct(F.col("row_id"), line.alias("line")).alias("r")) \
        .groupBy("cell_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return cells.select("cell_id", F.array_join(F.transform("rs", lambda r: r["line"]), "\n").alias("printed"))


@register("parse_scores", sql=_S + f""", lines AS (
  SELECT row_id // {ROWS_PER_CELL} AS cell_id, row_id,
         list_transform(logits, lambda x: CAST(CAST(round(x * 1e6) AS BIGINT) AS DOUBLE)) AS v FROM scores)
SELECT CAST(cell_id AS BIGINT) AS cell_id,
       CAST(row_number() OVER (PARTITION BY cell_id ORDER BY row_id) - 1 AS INTEGER) AS pos,
       CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS pred,
       round(list_sum(v), 6) AS total FROM lines""")
def q_parse_scores(spark, sf):
    """Printed blocks back to number rows, then argmax per row (Q17)."""
    rows = _printed(spark, sf).select("cell_id", F.posexplode(parse_scores("printed")).alias("pos", "v"))
    return rows.select("cell_id", F.col("pos").cast("int").alias("pos"), argmax("v").alias("pred"),
                       F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
