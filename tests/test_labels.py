from pyspark.sql import functions as F

from threadline.functions.arrays import argmax, attention_mask, one_hot_decode, pad_or_truncate
from threadline.operators import labels as L


def test_label_map_and_round_trip(spark):
    df = spark.createDataFrame([(1, -1, 0), (0, -2, None), (-1, 1, 1), (None, 0, 0)],
                               "sentiment int, ideology int, political int")
    lm = L.label_map(df, ["sentiment", "ideology", "political"])
    got = sorted(tuple(r) for r in lm.collect())
    # nulls ignored for the max (Q10); negatives ascending get max+1, max+2
    assert got == [("ideology", -2, 2), ("ideology", -1, 3), ("sentiment", -1, 2)]
    enc = L.encode_labels(df, lm)
    rows = [tuple(r) for r in enc.collect()]
    assert rows == [(1, 3, 0), (0, 2, None), (2, 1, 1), (0, 0, 0)]   # N2: null -> 0 where mapped
    back = [tuple(r) for r in L.decode_labels(enc, lm).collect()]
    assert back == [(1, -1, 0), (0, -2, None), (-1, 1, 1), (0, 0, 0)]


def test_filters_follow_pandas_null_rules(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (None, None)], "opinion int, factual_claim int")
    assert L.require_differs(df).count() == 3          # null compares unequal, as in pandas
    asks = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (0, 0, None)], "a int, b int, c int")
    assert L.at_most_one(asks, ("a", "b", "c")).count() == 2
    op = L.derive_opinion(spark.createDataFrame([(0,), (1,), (None,)], "factual_claim int"))
    assert [r.opinion for r in op.collect()] == [1, 0, 0]   # null is truthy -> 0 (P5)


def test_exactly_one_drops_any_null_row(spark):
    df = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (0, 1, None), (0, 0, "z")], "p1 int, p2 int, t string")
    assert [r.t for r in L.require_exactly_one(df, ("p1", "p2")).collect()] == ["x"]


def test_array_functions(spark):
    df = spark.createDataFrame([([5, 7, 7, 1],), ([],)], "a array<int>")
    r = df.select(pad_or_truncate("a", 3).alias("p"), pad_or_truncate("a", 6).alias("q"),
                  argmax("a").alias("m"), attention_mask(pad_or_truncate("a", 6)).alias("k")).collect()
    assert r[0].p == [5, 7, 7] and r[0].q == [5, 7, 7, 1, 0, 0] and r[0].m == 1
    assert r[0].k == [1, 1, 1, 1, 0, 0] and r[1].q == [0] * 6
    oh = spark.createDataFrame([(0, 1, 1), (0, 0, 0)], "a int, b int, c int")
    assert [x[0] for x in oh.select(one_hot_decode(["a", "b", "c"])).collect()] == [1, None]
