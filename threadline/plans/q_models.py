"""The training chain (M4 -> T4 -> O5 -> P8 -> S7) and per-target training and
evaluation on it (M1-M3, A15, S8).  Fitted values have no SQL form; the
inputs, the label counts and the stored predictions' support have."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadline.functions.text import clean_text
from threadline.operators import labels as L
from threadline.operators import models as MD
from threadline.operators import ranking as R
from threadline.operators import tokens as TK
from threadline.operators import trainer as TR
from threadline.plans import fixtures as fx
from threadline.plans.catalog import register
from threadline.plans.q_labels import MERGED, _cols, sql_m4
from threadline.plans.q_tokens import MAX_LEN
from threadline.plans.sql_text import sql_clean_text
from threadline.schemas import Y_COLS
from threadline.session import materialize, scratch_path
from threadline.sources import posts as S

SPLITS = ("train", "validation", "test")


def training_inputs(spark, sf):
    """The written splits (S7) with padded ids, masks and the cast labels, and
    the label map.  Rows are distinct after A1, so a digest of the whole row is
    their key."""
    df, lm = L.prepare_training_set(fx.coded_old(spark, sf), fx.coded_new(spark, sf))
    # written here: stacking the text cleaning on the long M4 plan makes
    # Catalyst's constraint propagation explode
    df = materialize(df, "training-set")
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in MERGED]))
    rows = materialize(df.withColumn("row_key", key).withColumn("cleaned_text", clean_text("text")), "training-text")
    vocab = TK.build_vocab(rows.dropna().withColumn("words", TK.words_of("cleaned_text")))
    enc = TK.convert_text(rows, "text", vocab, MAX_LEN, cleaned=True)
    path = scratch_path(spark, "splits")
    S.write_splits(R.split_exact(L.cast_labels(enc), "row_key", 42), path)
    return spark.read.parquet(path), lm


_INPUTS = f"""WITH m4 AS ({sql_m4()}),
k AS (SELECT *, md5(concat_ws('|', {", ".join(f'CAST("{c}" AS VARCHAR)' for c in MERGED)})) AS row_key,
             {sql_clean_text('text')} AS cleaned_text FROM m4),
w AS (SELECT *, list_filter(string_split(cleaned_text, ' '), lambda x: x <> '') AS words FROM k
      WHERE cleaned_text IS NOT NULL AND policies IS NOT NULL AND ask_requests IS NOT NULL),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER) AS id FROM
          (SELECT token, count(*) AS n FROM (SELECT unnest(words) AS token FROM w) GROUP BY token)),
ids AS (SELECT e.row_key, list(v.id ORDER BY e.pos) AS body FROM
        (SELECT row_key, unnest(words) AS tok, generate_subscripts(words, 1) AS pos FROM w) e
        JOIN vocab v ON v.token = e.tok GROUP BY e.row_key),
enc AS (SELECT w.*, [2] || ids.body || [3] AS input_ids FROM w JOIN ids USING (row_key)),
r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || row_key), row_key) AS rk, count(*) OVER () AS n FROM enc),
s AS (SELECT *, n - CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT) AS c1,
             CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT) AS h FROM r),
inputs AS (SELECT *, CASE WHEN rk <= c1 THEN 'train'
                          WHEN rk <= c1 + h - CAST(ceil(CAST(0.5 AS DOUBLE) * h) AS BIGINT) THEN 'validation'
                          ELSE 'test' END AS split,
                  CASE WHEN len(input_ids) >= {MAX_LEN} THEN input_ids[1:{MAX_LEN}]
                       ELSE input_ids || list_transform(range({MAX_LEN} - len(input_ids)), lambda i: 0) END AS padded
           FROM s)
"""


@register("training_inputs", sql=_INPUTS + f"""SELECT row_key, split, {_cols(Y_COLS)},
  array_to_string(padded, ' ') AS padded,
  array_to_string(list_transform(padded, lambda x: CAST(x > 0 AS INTEGER)), ' ') AS mask FROM inputs""")
def q_training_inputs(spark, sf):
    """M4 -> T4 -> O5 -> P8 -> S7, read back: the nine outputs of the chain."""
    rows, _ = training_inputs(spark, sf)
    return rows.select("row_key", "split", *Y_COLS, F.array_join("padded", " ").alias("padded"),
                       F.array_join("mask", " ").alias("mask"))


@register("num_labels", sql=_INPUTS + "SELECT " + ", ".join(
    f'count(DISTINCT "{c}") AS "{c}"' for c in Y_COLS) + " FROM inputs")
def q_num_labels(spark, sf):
    """U4 + A10: distinct labels per target over the union of the three splits,
    in one pass over the rows."""
    rows, _ = training_inputs(spark, sf)
    union = None
    for split in SPLITS:
        part = rows.where(F.col("split") == split)
        union = part if union is None else union.unionByName(part)
    return MD.num_labels(union, Y_COLS)


def trained(spark, sf):
    """(rows, label map, stored predictions, model) of one training run: A10 over
    all splits, M1 on the train split in O6's order, M2 on every row of every
    split, S8.  Every call trains anew."""
    rows, lm = training_inputs(spark, sf)
    _, classes = TR.class_counts(rows, Y_COLS)
    model = TR.train_joint(rows.where(F.col("split") == "train"), Y_COLS, classes=classes)
    path = scratch_path(spark, "predictions")
    S.write_predictions(TR.score_joint(rows, model, ["row_key", "split"]), path)
    return rows, lm, path, model


@register("train_and_evaluate")
def q_train_and_evaluate(spark, sf):
    """Train all targets' heads on the train split, store the predictions
    of every row by target (S8), read them back and report on the validation
    split per target in the original label space."""
    rows, lm, path, _ = trained(spark, sf)
    valid = S.read_predictions(spark, path).where(F.col("split") == "validation")
    report = MD.evaluate(MD.paired(valid, rows, "row_key", Y_COLS), "row_key", lm)
    return report.select("target", "label", F.round("precision", 6).alias("precision"),
                         F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), "support")


@register("prediction_support", sql=_INPUTS + f"""
SELECT split, target, CAST(label AS INTEGER) AS label, count(*) AS n FROM
  (UNPIVOT (SELECT split, {_cols(Y_COLS)} FROM inputs) ON {_cols(Y_COLS)} INTO NAME target VALUE label)
GROUP BY split, target, label""")
def q_prediction_support(spark, sf):
    """S8 + J6: stored predictions of all splits paired with their truth, rows
    per split, target and true label."""
    rows, _, path, _ = trained(spark, sf)
    preds = S.read_predictions(spark, path)
    pairs = MD.paired(preds.drop("split"), rows, "row_key", Y_COLS).join(rows.select("row_key", "split"), "row_key")
    return pairs.groupBy("split", "target", F.col("truth").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("loss_history")
def q_loss_history(spark, sf):
    """Average loss of an epoch's batches, per target and epoch."""
    model = trained(spark, sf)[3]
    return spark.createDataFrame(model.losses, "target string, epoch int, loss double")
