import tempfile

from pyspark.sql import functions as F

from threadline.operators import accounts as A
from threadline.operators.refresh import refresh_metrics
from threadline.sources import posts as P


def test_cursor_worked_example(spark):
    # since_id 4 and posts up to 300: everything from 5 to 300, oldest first
    posts = spark.createDataFrame([("h", i) for i in range(1, 301)], "handle string, id long")
    cur = spark.createDataFrame([("h", 4)], "handle string, since_id long")
    handles = spark.createDataFrame([("h",)], "handle string")
    got = [r.id for r in A.chronological(A.pull_new_posts(posts, handles, cur)).collect()]
    assert got == list(range(5, 301))


def test_cursor_rules(spark):
    posts = spark.createDataFrame([("a", 10), ("a", 12)], "handle string, id long")
    handles = spark.createDataFrame([("a",), ("b",), ("c",)], "handle string")
    prev = spark.createDataFrame([("b", 7)], "handle string, since_id long")
    nxt = {r.handle: r.since_id for r in A.advance_cursors(posts, handles, prev).collect()}
    assert nxt == {"a": 12, "b": 7, "c": 1}       # K2 keeps an old cursor (Q23)
    plain = {r.handle: r.since_id for r in A.latest_cursor(posts, handles).collect()}
    assert plain == {"a": 12, "b": 1, "c": 1}


def test_handles_and_status(spark):
    lst = spark.createDataFrame([("x", "y"), ("y", None), (" ", " "), (None, "z")],
                                "`Twitter Handle` string, `Twitter Handle 2` string")
    assert sorted(r.handle for r in A.pending_handles(lst).collect()) == [" ", "x", "y", "z"]
    assert [tuple(r) for r in A.repeated_handles(lst).collect()] == [("y", 2)]
    posts = spark.createDataFrame([("p", 5), ("q", 6)], "handle string, id long")
    status = spark.createDataFrame([("p", "protected"), ("q", "active")], "handle string, status string")
    h = spark.createDataFrame([("p",), ("q",)], "handle string")
    assert [r.handle for r in A.pull_new_posts(posts, h, None, status).collect()] == ["q"]


def test_refresh_last_update_wins(spark):
    posts = spark.createDataFrame([(1, "h", "t1", "x", 5, 5), (2, "h", None, "y", 1, 1), (3, "h", "t3", "z", 0, 0)],
                                  "id long, handle string, created_at string, full_text string, "
                                  "retweet_count long, favorite_count long")
    upd = spark.createDataFrame([(1, 10, 11, 1), (1, 20, 21, 2), (9, 0, 0, 1)],
                                "id long, retweets long, favorites long, seq int")
    got = sorted((r.id, r.retweets, r.favorites) for r in refresh_metrics(posts, upd).collect())
    assert got == [(1, 20, 21), (3, 0, 0)]


LOW = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
       "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
       "spark.sql.adaptive.coalescePartitions.enabled": "false",
       "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
       "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}


def test_hot_handle_is_split(spark):
    """One handle with two thirds of the posts: the pull's join is a skew join
    and the append writes the handle in several files."""
    old = {k: spark.conf.get(k, None) for k in LOW}
    try:
        for k, v in LOW.items():
            spark.conf.set(k, v)
        posts = spark.range(0, 60_000, 1, 8).select(
            F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("h"), F.col("id") % 97)).alias("handle"),
            (F.col("id") * 4_194_304_007 + 10 ** 18).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("full_text"))
        handles = posts.select("handle").distinct()
        cursors = handles.select("handle", F.lit(10 ** 18).cast("long").alias("since_id"))
        pulled = A.pull_new_posts(posts, handles, cursors)
        assert len(pulled.collect()) == 59_999
        assert "skew=true" in pulled._jdf.queryExecution().executedPlan().toString()
        path = tempfile.mkdtemp(prefix="threadline-append-") + "/posts"
        P.append_posts(posts, path)
        hot = spark.read.parquet(path).where("handle = 'hot'").select(F.input_file_name().alias("f")).distinct()
        assert hot.count() > 1
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_latest_update_is_a_hash_aggregate(spark):
    upd = spark.createDataFrame([(1, 10, 11, 1)], "id long, retweets long, favorites long, seq int")
    posts = spark.createDataFrame([(1, "t", 0, 0)], "id long, created_at string, retweet_count long, favorite_count long")
    plan = refresh_metrics(posts, upd)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
