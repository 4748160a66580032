from pyspark.sql import functions as F

from threadline.operators.audit import audit_shape


def test_digest_counts_equal_distinct_rows(spark):
    schema = "a string, b string, c double, d long, e binary, f array<string>, g timestamp"
    base = [("x", "yz", 0.0, 1, b"\x00", ["p", None], None), ("xy", "z", -0.0, 1, b"\x00", ["p", None], None),
            ("xy", "z", 0.0, 1, b"\x00", ["p", None], None), (None, "-", 1.5, None, None, [], None), ("-", None, 1.5, None, None, None, None),
            ("1:x", "", float("nan"), 2, b"", ["p,q"], None), ("1:x", "", float("nan"), 2, b"", ["p", "q"], None)]
    df = spark.createDataFrame(base + base[:3], schema).withColumn("g", F.when(F.col("d") > 1, F.lit("2020-01-01 00:00:00.123456").cast("timestamp")))
    whole = df.where(" and ".join(f"{c} is not null" for c in df.columns)).distinct().count()
    row = audit_shape(df).first()
    assert (row.n_rows, row.n_distinct, row.n_complete) == (10, df.distinct().count(), whole) == (10, 6, 2)
    assert tuple(audit_shape(df.limit(0)).first()) in ((0, 0, 0), (None, 0, 0))


def test_no_column_is_shuffled(spark):
    df = spark.range(100).select("id", F.concat(F.lit("text "), "id").alias("full_text"))
    plan = audit_shape(df)._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange" in line or "keys=[" in line]
    assert shuffled and not any("full_text" in line.split("functions")[0] for line in shuffled if "keys=[" in line)
    assert "hashpartitioning(__digest" in plan
