"""A stored post collection that is read and rewritten in parts.

Posts lie in folders by handle bucket and id range (`handle_bucket`, `id_range`),
so a file holds few handles' posts of one stretch of ids.

* A pull takes the least cursor of each bucket (at most `buckets` numbers) into a
  filter on the two folder columns: folders of buckets that no wanted handle is in,
  and id ranges below the bucket's least cursor, are pruned when the scan is
  planned.  What a pull reads follows what is new, not what was collected.
* A refresh rewrites only the folders that hold an updated post.  They are read,
  joined to the latest update of an id and written back by a dynamic partition
  overwrite: the new files are staged and replace the old ones when the job
  commits, so a lost executor or a failed job leaves the old ones in place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.operators.accounts import handle_cursors
from threadline.operators.refresh import latest_per_key
from threadline.session import materialize

PLACE = ["handle_bucket", "id_range"]
NEVER = 2 ** 62


@dataclass(frozen=True)
class PostStore:
    """path, number of handle buckets, and ids per range."""
    path: str
    buckets: int = 32
    span: int = 1 << 48

    @classmethod
    def fitting(cls, path: str, posts: DataFrame, buckets: int = 32, ranges: int = 64, least: int = 1) -> PostStore:
        """A store whose first batch takes at most `ranges` id ranges a bucket, so
        that the folders don't grow with the posts: a range spans at least `least`
        ids and a share of the batch's ids otherwise."""
        low, high = posts.agg(F.min("id"), F.max("id")).first()
        share = 0 if low is None else -(-(high - low + 1) // (ranges - 1))       # a range is cut at both ends
        return cls(path, buckets, max(least, share))

    def bucket(self, handle: str = "handle") -> Column:
        return F.pmod(F.xxhash64(handle), F.lit(self.buckets)).cast("int")

    def id_range(self, post_id: str = "id") -> Column:
        return F.call_function("div", F.col(post_id), F.lit(self.span))

    def append(self, posts: DataFrame) -> None:
        """One batch of posts.  A rebalance: AQE cuts a hot folder into several
        files and joins small ones."""
        placed = posts.withColumns({"handle_bucket": self.bucket(), "id_range": self.id_range()})
        placed.hint("rebalance", *map(F.col, PLACE)).sortWithinPartitions(*PLACE, "handle", "id") \
            .write.mode("append").partitionBy(*PLACE).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        """All posts, with the two folder columns."""
        return spark.read.parquet(self.path)

    def newer(self, spark: SparkSession, since: DataFrame) -> DataFrame:
        """The posts of the folders that may hold something above the cursors.
        since: (handle, __since)."""
        least = since.groupBy(self.bucket().alias("b")).agg(F.min("__since").alias("s")).collect()   # at most `buckets`
        first = np.full(self.buckets, NEVER, dtype=np.int64)
        for r in least:
            first[r["b"]] = r["s"] // self.span
        return self.read(spark).where(F.col("id_range") >= F.get(F.lit(first), F.col("handle_bucket")))

    def pull(self, handles: DataFrame, cursors: DataFrame | None = None, status: DataFrame | None = None,
             default_since: int = 1) -> DataFrame:
        """S4 + J4 on the store: for every wanted, reachable handle its posts
        above its cursor."""
        since = materialize(handle_cursors(handles, cursors, status, default_since), "handle-cursors")
        return self.newer(handles.sparkSession, since).drop(*PLACE).join(since, "handle") \
            .where(F.col("id") > F.col("__since")).drop("__since")

    def refresh(self, updates: DataFrame, order: str = "seq") -> int:
        """J1 in place: counters of stored posts replaced by the latest update of
        their id; updates of unknown ids vanish.  Returns the folders rewritten."""
        spark = updates.sparkSession
        latest = materialize(latest_per_key(updates, "id", order, ["retweets", "favorites"]), "updates")
        ranges = self.read(spark).select("id_range").distinct()
        wanted = [r[0] for r in latest.select(self.id_range().alias("id_range")).distinct()
                  .join(ranges, "id_range", "left_semi").collect()]         # folders of the store at most
        near = self.read(spark).where(F.col("id_range").isin(wanted))
        folder = F.concat_ws("/", *PLACE)
        hit = [r[0] for r in near.join(latest, "id", "left_semi").select(folder).distinct().collect()]
        if not hit:
            return 0
        posts = near.where(folder.isin(hit))
        new = latest.select("id", F.col("retweets").alias("__rt"), F.col("favorites").alias("__fav"))
        done = posts.join(new, "id", "left").withColumns({
            "retweet_count": F.coalesce("__rt", "retweet_count").cast("long"),
            "favorite_count": F.coalesce("__fav", "favorite_count").cast("long")}).select(*posts.columns)
        done.hint("rebalance", *map(F.col, PLACE)).sortWithinPartitions(*PLACE, "handle", "id") \
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(self.path)
        return len(hit)
