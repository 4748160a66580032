import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadline.operators import ranking as R
from threadline.operators import sampling as S


def test_split_sizes_match_reference_rounding():
    for n in (1, 5, 15, 99, 1000, 1234):
        held = math.ceil(0.2 * n)
        assert R.split_sizes(n) == (n - held, held - math.ceil(0.5 * held), math.ceil(0.5 * held))


def test_split_exact_disjoint_cover_sizes(spark):
    df = spark.range(0, 1234).withColumnRenamed("id", "k")
    s = R.split_exact(df, "k", 42)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert (counts["train"], counts["validation"], counts["test"]) == R.split_sizes(1234)
    assert s.select("k").distinct().count() == 1234


def test_global_rank_equals_row_number(spark):
    df = spark.range(0, 3000).withColumnRenamed("id", "k")
    got = R.global_rank(df, "k", seed=7)
    ref = df.withColumn("sk", R.md5_key(7, "k")).withColumn(
        "rank", F.row_number().over(Window.orderBy("sk", "k"))).drop("sk")
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0
    plain = R.global_rank(df, "k")
    assert plain.where(F.col("rank") != F.col("k") + 1).count() == 0


def test_within_key_rank(spark):
    df = spark.createDataFrame([("a", i * 70_000) for i in range(5)] + [("b", 3)], "h string, id long")
    got = sorted((r.h, r.id, r.rank) for r in R.within_key_rank(df, "h", "id").collect())
    assert got == [("a", i * 70_000, i + 1) for i in range(5)] + [("b", 3, 1)]


def test_sample_is_exact_and_never_overlaps(spark):
    pool = spark.range(0, 500).select(F.col("id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    prior = pool.where(F.col("id") % 3 == 0).withColumn("sample_name", F.lit("b1"))
    fresh = S.exclude_sampled(pool, prior)
    smp = S.sample_exact(fresh, 50, 42)
    assert smp.count() == 50 and smp.join(prior, "id", "left_semi").count() == 0
    assert [r.n_failed for r in S.check_exclusion(fresh, prior).collect()] == [0]
    try:
        S.sample_exact(fresh, 10_000, 42)
        raise AssertionError("expected an error")
    except ValueError:
        pass


def test_hot_key_is_ranked_by_many_ranges(spark):
    """Platform-sized ids, one handle with two thirds of the rows."""
    base = 1_500_000_000_000_000_000
    df = spark.range(0, 6000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("h"), F.col("id") % 50)).alias("handle"),
        (F.lit(base) + F.col("id") * 4_194_304_007).alias("id"))
    got = R.within_key_rank(df, "handle", "id")
    w = Window.partitionBy("handle").orderBy("id")
    ref = df.withColumn("rank", F.row_number().over(w).cast("long"))
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0
    dealt = df.repartitionByRange(8, "handle", "id").withColumn("r", F.spark_partition_id())
    sizes = [r["count"] for r in dealt.where("handle = 'hot'").groupBy("r").count().collect()]
    assert len(sizes) > 3 and max(sizes) < 2000


def test_uneven_keys_give_even_batches(spark):
    early, late = spark.range(0, 2000), spark.range(10 ** 15, 10 ** 15 + 2000)
    got = R.batch_number(early.union(late), "id", 32)
    assert got.where("rank != batch * 32 + (rank - 1) % 32 + 1").count() == 0
    assert got.agg(F.max("rank")).first()[0] == 4000 and got.agg(F.max("batch")).first()[0] == 124


def test_null_keys_are_kept(spark):
    df = spark.range(0, 90).select(F.col("id").alias("k")).union(spark.range(10).select(F.lit(None).cast("long")))
    sizes = {r.split: r["count"] for r in R.split_exact(df, "k").groupBy("split").count().collect()}
    assert sizes == {"train": 80, "validation": 10, "test": 10}
    assert R.take_first(df, "k", 97, 1).count() == 97 and R.shuffle_order(df, "k").count() == 100
    assert sorted(r.rank for r in R.global_rank(df, "k").collect()) == list(range(1, 101))


def test_cuts_need_no_join(spark):
    df = spark.range(0, 3000).select("id", F.col("id").cast("string").alias("text"))
    for cut in (R.take_first(df, "id", 100, 5), R.split_exact(df, "id")):
        plan = cut._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan
    assert R.split_exact(df.limit(0), "id").count() == 0 and R.take_first(df.limit(0), "id", 0, 5).count() == 0


def row_numbers(df, part, order):
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order)).cast("long"))


def test_a_rank_is_a_position(spark):
    """One shuffle of the rows, no window; keys of several columns, nulls, a key
    over many ranges and batches of any size."""
    df = spark.range(0, 5000).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).when(F.col("id") % 10 == 8, F.concat(F.lit("k"), F.col("id") % 300)).alias("a"),
        (F.col("id") % 2).alias("b"), (F.col("id") * 7919 % 5003).alias("o"), F.col("id").cast("string").alias("text"))
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        for n in (1, 3, 16):
            for part in (["a"], ["a", "b"]):
                got, want = R.ranked(df, [F.col("o")], part, ranges=n), row_numbers(df, part, ["o"])
                assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == 5000
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = R.ranked(df, [F.col("o")], ranges=16)
    assert got.exceptAll(row_numbers(df, [], ["o"]).select(*got.columns)).count() == 0
    for plan in (got, R.ranked(df, [F.col("o")], ["a"])):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in text and "Exchange" not in text and "Join" not in text
    assert R.ranked(df.limit(0), [F.col("o")]).count() == R.ranked(df.limit(0), [F.col("o")], ["a"]).count() == 0


def test_the_cut_bucket_is_refined(spark, monkeypatch):
    df = spark.range(0, 3000).withColumnRenamed("id", "k")
    want = {r.k: r.split for r in R.split_exact(df, "k", 42).collect()}
    first = sorted(R.take_first(df, "k", 700, 5).toPandas()["k"])
    monkeypatch.setattr(R, "BUCKET_HEX", 1)                # 16 buckets of about 190 rows
    rounds, prefix = [], R._prefix
    monkeypatch.setattr(R, "_prefix", lambda b: rounds.append(len(b)) or prefix(b))
    assert {r.k: r.split for r in R.split_exact(df, "k", 42).collect()} == want and set(rounds) == {1}
    monkeypatch.setattr(R, "CUT_ROWS", 20)
    rounds.clear()
    assert {r.k: r.split for r in R.split_exact(df, "k", 42).collect()} == want and set(rounds) == {2}
    monkeypatch.setattr(R, "SUMMARY_ROWS", 0)
    assert sorted(R.take_first(df, "k", 700, 5).toPandas()["k"]) == first
    same = spark.range(0, 500).select((F.col("id") % 2).alias("k"), "id")      # two keys: no digit tells their rows apart
    sizes = sorted(r["count"] for r in R.split_exact(same, "k").groupBy("split").count().collect())
    assert sizes == [50, 50, 400]


def test_a_sample_evaluates_the_pool_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    pool = spark.range(0, 20_000, 1, 40).withColumnRenamed("id", "k")
    keyed = R._keyed(pool, "k", 9)
    assert keyed.count() == 20_000
    got = R.take_first(pool.mapInArrow(count, pool.schema), "k", 300, 9)
    want = [r.k for r in keyed.orderBy("__sk", "k").limit(300).collect()]
    assert sorted(r.k for r in got.collect()) == sorted(want) and seen.value == 20_000
    nulls = pool.where("k < 3").union(spark.range(2).select(F.lit(None).cast("long")))
    assert R.take_first(nulls, "k", 5, 1).count() == 5 and R.take_first(pool, "k", 0, 1).count() == 0
