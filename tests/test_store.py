"""The stored collection: pruned pulls (S4) and refresh in place."""
import os

from pyspark.sql import functions as F

from threadline.operators.accounts import pull_new_posts
from threadline.sources.store import PostStore


def posts(spark, n=4000):
    return spark.range(n).select(
        F.concat(F.lit("u"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40)).alias("handle"),
        F.when(F.col("id") % 50 != 0, F.lit("2020")).alias("created_at"), F.col("id").alias("favorite_count"),
        F.concat(F.lit("t"), "id").alias("full_text"), "id", (F.col("id") * 2).alias("retweet_count"))


def files_of(df):
    return df.select("_metadata.file_path").distinct().count()


def tree(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names
            if f.endswith(".parquet")}


def test_files_read_fall_with_the_cursors(spark, tmp_path):
    store = PostStore(str(tmp_path / "posts"), buckets=8, span=500)
    store.append(posts(spark))
    handles = store.read(spark).select("handle").distinct()
    whole = files_of(store.read(spark))
    counts = []
    for since in (0, 1000, 2000, 3900):
        cursors = handles.withColumn("since_id", F.lit(since).cast("long"))
        new = store.newer(spark, cursors.withColumnRenamed("since_id", "__since"))
        counts.append(files_of(new))
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "id_range" in plan.split("PartitionFilters: [")[1].split("]")[0]
        got, want = store.pull(handles, cursors), pull_new_posts(posts(spark), handles, cursors)
        assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()
    assert counts[0] == whole and counts == sorted(counts, reverse=True) and counts[-1] <= whole / 6
    one = handles.where("handle = 'u1'").withColumn("__since", F.lit(1).cast("long"))
    assert files_of(store.newer(spark, one)) <= whole / 6          # other buckets are not read
    assert store.newer(spark, one.limit(0)).count() == 0
    assert store.pull(handles.limit(0)).count() == 0


def test_repeated_appends_and_late_cursors(spark, tmp_path):
    store = PostStore(str(tmp_path / "posts"), buckets=4, span=500)
    p = posts(spark)
    store.append(p.where("id < 2000"))
    store.append(p.where("id >= 2000"))
    handles = p.select("handle").distinct()
    cursors = handles.where("handle <> 'u7'").withColumn("since_id", F.lit(3000).cast("long"))
    got, want = store.pull(handles, cursors), pull_new_posts(p, handles, cursors)
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()


def test_refresh_rewrites_touched_folders_only(spark, tmp_path):
    path = str(tmp_path / "posts")
    store = PostStore(path, buckets=4, span=500)
    store.append(posts(spark))
    before = tree(path)
    updates = spark.createDataFrame([(1201, 5, 6, 1), (1201, 7, 8, 2), (1210, 1, None, 1), (10 ** 9, 0, 0, 1), (None, 1, 1, 1)],
                                    "id long, retweets long, favorites long, seq int")
    folders = store.read(spark).where("id in (1201, 1210)").select("handle_bucket", "id_range").distinct().count()
    assert store.refresh(updates) == folders
    after = tree(path)
    kept = before.keys() & after.keys()
    gone = {os.path.dirname(f) for f in before.keys() - kept}
    assert len(gone) == folders and {os.path.dirname(f) for f in after.keys() - kept} == gone
    assert all(before[f] == after[f] for f in kept)
    got = {r.id: (r.retweet_count, r.favorite_count, r.full_text) for r in store.read(spark).collect()}
    want = {i: (2 * i, i, f"t{i}") for i in range(4000)} | {1201: (7, 8, "t1201"), 1210: (1, 1210, "t1210")}
    assert got == want
    again = tree(path)
    assert store.refresh(updates.where("id = 1000000000")) == 0 and tree(path) == again


def test_folders_do_not_grow_with_the_posts(spark, tmp_path):
    """Ranges widen with the ids; whatever they are, a pull is that of the plain join."""
    for n, (factor, first) in enumerate([(1, 0), (1000, -7), (10 ** 12, 5)]):
        rows = posts(spark).withColumn("id", F.col("id") * factor + first)
        store = PostStore.fitting(str(tmp_path / f"posts{n}"), rows, buckets=4, ranges=8, least=10)
        store.append(rows)
        assert store.read(spark).select("id_range").distinct().count() <= 8
        handles = rows.select("handle").distinct()
        cursors = rows.groupBy("handle").agg(F.floor(F.avg("id")).alias("since_id"))
        got = store.pull(handles, cursors).select("handle", "id")
        want = pull_new_posts(rows, handles, cursors).select("handle", "id")
        assert sorted(got.collect()) == sorted(want.collect())
    empty = posts(spark, 0)
    assert PostStore.fitting(str(tmp_path / "none"), empty, least=10).span == 10
