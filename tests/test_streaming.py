import tempfile

import pytest
from pyspark.sql import functions as F

from threadline.plans.q_streaming import collect_rounds
from threadline.streaming.collect import collect_increment, cursors_before


def test_batch_replay_is_idempotent_and_cursor_exclusive(spark):
    root = tempfile.mkdtemp(prefix="threadline-k2-")
    run = collect_increment(spark, f"{root}/posts", f"{root}/cursors")
    b0 = spark.createDataFrame([("a", 3), ("a", 5), ("b", 2)], "handle string, id long")
    b1 = spark.createDataFrame([("a", 4), ("a", 9), ("c", 7)], "handle string, id long")
    run(b0, 0)
    run(b1, 1)
    first = sorted(tuple(r) for r in spark.read.parquet(f"{root}/posts").collect())
    run(b1, 1)                                        # replay after a failure
    again = sorted(tuple(r) for r in spark.read.parquet(f"{root}/posts").collect())
    assert first == again
    # id 4 of 'a' arrives below the cursor (5) and is left out, as the exclusive cursor does
    assert [(h, i) for h, i, _ in first] == [("a", 3), ("a", 5), ("a", 9), ("b", 2), ("c", 7)]
    cur = {r.handle: r.since_id for r in cursors_before(spark, f"{root}/cursors", 2).collect()}
    assert cur == {"a": 9, "b": 2, "c": 7}
    with pytest.raises(FileNotFoundError):
        cursors_before(spark, f"{root}/cursors", 7)


def test_late_handles_and_redelivered_posts(spark):
    """A handle listed late keeps its whole back-file, older than anything
    collected so far; posts delivered again are collected once."""
    root = tempfile.mkdtemp(prefix="threadline-late-")
    posts = spark.range(1, 41).select(
        F.when(F.col("id") < 9, "late").otherwise("early").alias("handle"), "id",
        F.lit("Wed Oct 10 20:19:24 +0000 2018").alias("created_at"), F.lit("x").alias("full_text"),
        F.lit(1).cast("long").alias("retweet_count"), F.lit(2).cast("long").alias("favorite_count"))
    early = posts.where("handle = 'early'")
    out = collect_rounds(spark, [early, posts.where("handle = 'late' or id % 2 = 0"), posts], root)
    got = sorted((r.handle, r.id) for r in out.collect())
    assert got == sorted([("late", i) for i in range(2, 9)] + [("early", i) for i in range(9, 41)])


def test_listed_handles_only(spark):
    root = tempfile.mkdtemp(prefix="threadline-list-")
    handles = spark.createDataFrame([("a",), ("quiet",)], "handle string")
    run = collect_increment(spark, f"{root}/posts", f"{root}/cursors", handles)
    run(spark.createDataFrame([("a", 3), ("a", 3), ("b", 5)], "handle string, id long"), 0)
    assert [(r.handle, r.id) for r in spark.read.parquet(f"{root}/posts").collect()] == [("a", 3)]
    assert {r.handle: r.since_id for r in cursors_before(spark, f"{root}/cursors", 1).collect()} == {"a": 3, "quiet": 1}


def rows_of(spark, path):
    return spark.read.parquet(path).count()


def test_cursor_log_follows_the_handles_met(spark):
    """Many known handles, batches that meet few: a batch writes only these; a
    snapshot every three batches, older versions go; any batch can be replayed."""
    import os
    root = tempfile.mkdtemp(prefix="threadline-log-")
    run = collect_increment(spark, f"{root}/posts", f"{root}/cursors", every=3)
    run(spark.createDataFrame([(f"h{i}", 10) for i in range(200)], "handle string, id long"), 0)
    want = {f"h{i}": 10 for i in range(200)}
    for n in range(1, 11):
        batch = spark.createDataFrame([(f"h{n}", 10 * n + 10), (f"h{n}", 10 * n + 5), (f"h{n}", 10 * n + 10), ("h0", 3)],
                                      "handle string, id long")
        run(batch, n)
        want[f"h{n}"] = 10 * n + 10
        assert rows_of(spark, f"{root}/cursors/changes/batch_id={n}") == 1
        assert rows_of(spark, f"{root}/posts/batch_id={n}") == 2
        first = {r.handle: r.since_id for r in cursors_before(spark, f"{root}/cursors", n + 1, 3).collect()}
        run(batch, n)                                     # replay
        again = {r.handle: r.since_id for r in cursors_before(spark, f"{root}/cursors", n + 1, 3).collect()}
        assert first == again == want
    assert sorted(os.listdir(f"{root}/cursors/snapshots")) == ["batch_id=5", "batch_id=8"]
    assert sorted(os.listdir(f"{root}/cursors/changes"), key=lambda x: int(x[9:])) == [f"batch_id={n}" for n in range(6, 11)]
