"""Incremental collection with Structured Streaming (K1, K2) and its batch
form (K3).

K1: landed JSON records are read as a stream and projected to the wanted tags
(P1 + X8).

K2: every micro-batch (`foreachBatch`) keeps posts above the per-handle cursor,
drops repeats among them, writes them, and logs the cursors that moved.  A post
delivered again in a later batch lies at or below its handle's cursor, so no state
store and no watermark is needed: a handle that is listed late has no cursor yet
and gets its whole back-file, however old.  Both outputs go to a directory named by
the batch id and are overwritten on a retry, so replaying a batch is idempotent:
batch n reads the cursors of batch n - 1, never its own.

The cursor log: a batch writes the cursors of the handles it met, and every
SNAPSHOT_EVERY batches a snapshot of all.  The cursors before batch n are the last
snapshot and the changes since, at most SNAPSHOT_EVERY small tables; their names
follow from n, so nothing is listed.  Cursors only rise, so the greatest one of a
handle is its last.  A snapshot removes what lies before the snapshot before it;
a replay never goes back that far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.operators.accounts import drop_unknown_accounts, latest_cursor, pull_new_posts
from threadline.schemas import CURSOR_SCHEMA
from threadline.sources.posts import clustered, parse_posts, read_cursors, write_cursors


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


SNAPSHOT_EVERY = 16


def _changes(root: str, batch_id: int) -> str:
    return f"{root}/changes/batch_id={batch_id}"


def _snapshot(root: str, batch_id: int) -> str:
    return f"{root}/snapshots/batch_id={batch_id}"


def _newest(cursors: DataFrame) -> DataFrame:
    return cursors.groupBy("handle").agg(F.max("since_id").alias("since_id"))


def logged_cursors(spark: SparkSession, root: str, batch_id: int, every: int = SNAPSHOT_EVERY) -> DataFrame | None:
    """The log that batch n starts from, a handle up to once per version."""
    if batch_id == 0:
        return None
    if not _exists(spark, f"{_changes(root, batch_id - 1)}/_SUCCESS"):
        raise FileNotFoundError(f"no committed cursors of batch {batch_id - 1} under {root}")
    last = batch_id // every * every - 1                     # -1: no snapshot yet
    paths = [_changes(root, b) for b in range(last + 1, batch_id)] + [_snapshot(root, last)] * (last >= 0)
    return read_cursors(spark, paths)


def cursors_before(spark: SparkSession, root: str, batch_id: int, every: int = SNAPSHOT_EVERY) -> DataFrame | None:
    """The cursors that batch n starts from: those after batch n - 1."""
    log = logged_cursors(spark, root, batch_id, every)
    return None if log is None else _newest(log)


def log_cursors(spark: SparkSession, root: str, batch_id: int, moved: DataFrame, every: int = SNAPSHOT_EVERY) -> None:
    """The moved cursors of a batch, and a snapshot where one is due."""
    write_cursors(moved, _changes(root, batch_id))
    if (batch_id + 1) % every:
        return
    before = cursors_before(spark, root, batch_id, every)
    after = read_cursors(spark, _changes(root, batch_id))
    write_cursors(after if before is None else _newest(before.unionByName(after)), _snapshot(root, batch_id))
    for b in range(max(0, batch_id - 2 * every + 1), batch_id - every + 1):
        _delete(spark, _changes(root, b))
    if batch_id >= 2 * every:
        _delete(spark, _snapshot(root, batch_id - 2 * every))


def stream_posts(spark: SparkSession, landing: str, tags, files_per_trigger: int | None = None) -> DataFrame:
    """K1: stream of projected posts, as delivered."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_posts(reader.load(landing), tags=tags)


def above_cursor(posts: DataFrame, log: DataFrame) -> DataFrame:
    """Posts above every logged cursor of their handle, or above 1.  The log is
    joined as it is stored, so both sides are plain shuffles and AQE can split a
    hot handle."""
    at = log.select(F.col("handle").alias("__handle"), "since_id")
    return posts.where(F.col("id") > 1).join(
        at, (F.col("handle") == F.col("__handle")) & (F.col("id") <= F.col("since_id")), "left_anti")


def collect_increment(spark: SparkSession, posts_root: str, cursor_root: str,
                      handles: DataFrame | None = None, status: DataFrame | None = None,
                      every: int = SNAPSHOT_EVERY):
    """K2 as a foreachBatch function; without a handle list every handle met is
    wanted.  Repeats are dropped by (handle, id), after the cursor has taken out
    what was collected before, so a hot handle's posts spread over all tasks."""
    def run(batch_df: DataFrame, batch_id: int) -> None:
        previous = logged_cursors(spark, cursor_root, batch_id, every)
        known = spark.createDataFrame([], CURSOR_SCHEMA) if previous is None else previous
        fresh = above_cursor(batch_df, known)
        wanted = None if handles is None else drop_unknown_accounts(handles.select("handle").distinct(), status)
        if wanted is not None:
            fresh = fresh.join(wanted, "handle", "left_semi")
        out = f"{posts_root}/batch_id={batch_id}"
        fresh.repartition("handle", "id").dropDuplicates(["handle", "id"]).sortWithinPartitions("handle", "id") \
            .write.mode("overwrite").parquet(out)
        moved = spark.read.schema(fresh.schema).parquet(out).groupBy("handle").agg(F.max("id").alias("since_id"))
        if wanted is not None:                               # listed, but never met
            new = wanted.join(known, "handle", "left_anti").withColumn("since_id", F.lit(1).cast("long"))
            moved = _newest(moved.unionByName(new))
        log_cursors(spark, cursor_root, batch_id, moved, every)
    return run


def run_collection(spark: SparkSession, landing: str, out_root: str, tags,
                   handles: DataFrame | None = None, files_per_trigger: int | None = None,
                   status: DataFrame | None = None) -> tuple[str, str]:
    """K1 + K2 with an availableNow trigger: processes everything landed since
    the last call, then stops.  Returns (posts root, cursor root)."""
    posts_root, cursor_root = f"{out_root}/posts", f"{out_root}/cursors"
    stream = stream_posts(spark, landing, tags, files_per_trigger)
    q = stream.writeStream.foreachBatch(collect_increment(spark, posts_root, cursor_root, handles, status)) \
        .option("checkpointLocation", f"{out_root}/_checkpoint") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    return posts_root, cursor_root


def collect_full(spark: SparkSession, landing: DataFrame, handles: DataFrame, out: str,
                 cursor_out: str, status: DataFrame | None = None) -> None:
    """K3: the batch form the reference runs -- every handle from since_id = 1
    (Q18), earlier output truncated (overwrite), then the cursors."""
    clustered(pull_new_posts(landing, handles, None, status)).write.mode("overwrite").parquet(out)
    write_cursors(latest_cursor(spark.read.parquet(out), handles), cursor_out)
