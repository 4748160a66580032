from pyspark.sql import functions as F

from threadline.operators import metrics as M


def test_report_with_class_never_predicted(spark):
    # truth 0,0,1,1,2 ; pred 0,1,1,1,1 -> class 2 never predicted
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)], "truth int, pred int")
    rep = {r.label: r for r in M.classification_report(df).collect()}
    assert rep["0"].precision == 1.0 and rep["0"].recall == 0.5
    assert abs(rep["1"].precision - 0.5) < 1e-12 and rep["1"].recall == 1.0
    assert rep["2"].precision == 0.0 and rep["2"].f1 == 0.0 and rep["2"].support == 1
    assert rep["accuracy"].f1 == 0.6 and rep["accuracy"].support == 5
    f1s = [2 / 3, 2 / 3, 0.0]
    assert abs(rep["macro avg"].f1 - sum(f1s) / 3) < 1e-12
    assert abs(rep["weighted avg"].f1 - (2 * f1s[0] + 2 * f1s[1]) / 5) < 1e-12


def test_batched_f1_weights(spark):
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate([(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)])],
                               "row_id long, truth int, pred int")
    one = M.batched_weighted_f1(df, "row_id", batch_size=10).first()
    # predicted-support weights (Q11): class 0 weight 1, class 1 weight 4
    assert abs(one.mean_f1 - (1 * 2 / 3 + 4 * 2 / 3) / 5) < 1e-12 and one.n_batches == 1
    two = M.batched_weighted_f1(df, "row_id", batch_size=3).first()
    assert two.n_batches == 2
