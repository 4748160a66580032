"""Engagement refresh.

Updates are first reduced to the latest one per id (a partial aggregate, so
repeats collapse map-side), then left-joined to the posts on the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def updates_projection(df: DataFrame) -> DataFrame:
    """Id and the two counters, by name (Q5)."""
    return df.select("id", F.col("retweet_count").alias("retweets"),
                     F.col("favorite_count").alias("favorites"))


def latest_per_key(df: DataFrame, key: str, order: str, values) -> DataFrame:
    """The values of the row with the greatest `order` per key, which must
    be unique within a key.  One max_by per value keeps fixed-width buffers, so
    this is a hash aggregate: no window and no sort."""
    return df.groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values])


def refresh_metrics(posts: DataFrame, updates: DataFrame, order: str = "seq") -> DataFrame:
    """Counters replaced by the latest update of the same id; posts
    without an update keep theirs; updates without a post vanish; rows with
    null created_at vanish (N6).  The id keeps its type (Q7)."""
    latest = latest_per_key(updates, "id", order, ["retweets", "favorites"])
    latest = latest.select("id", F.col("retweets").alias("__rt"), F.col("favorites").alias("__fav"))
    joined = posts.dropna(subset=["created_at"]).join(latest, "id", "left")
    rest = [c for c in posts.columns if c not in ("id", "retweet_count", "favorite_count")]
    return joined.select(
        "id", *rest,
        F.coalesce(F.col("__rt"), F.col("retweet_count")).cast("long").alias("retweets"),
        F.coalesce(F.col("__fav"), F.col("favorite_count")).cast("long").alias("favorites"),
    )
