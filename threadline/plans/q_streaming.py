"""The streaming collector (K1 + K2) checked against the batch pull."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadline.functions.text import post_time
from threadline.plans import fixtures as fx
from threadline.plans.catalog import register
from threadline.schemas import DEFAULT_TAGS
from threadline.session import scratch_path
from threadline.streaming.collect import run_collection

PLATFORM_FMT = "EEE MMM dd HH:mm:ss '+0000' yyyy"
ROUNDS = 3


def records(posts):
    rec = F.to_json(F.struct("id", "created_at", "full_text", "retweet_count", "favorite_count",
                             F.struct(F.col("handle").alias("screen_name")).alias("user")))
    return posts.select(rec.alias("value"))


def collect_rounds(spark, deliveries, root):
    """Land each delivery as JSON lines and collect what is new after it."""
    for i, posts in enumerate(deliveries):
        records(posts).write.mode("overwrite").text(f"{root}/landing/delivery_{i}")
        posts_root, _ = run_collection(spark, f"{root}/landing/delivery_*", f"{root}/out", DEFAULT_TAGS)
    out = spark.read.parquet(posts_root)
    return out.select("handle", "created_at", "favorite_count", "full_text", "id", "retweet_count")


@register("stream_collect", sql=fx.with_ctes(fx.SQL_POSTS) + "SELECT * FROM posts WHERE id > 1")
def q_stream_collect(spark, sf):
    """K1 + K2: deliveries in id order, every tenth earlier post delivered
    again with the next one; what is collected equals the batch pull over
    everything (each post once)."""
    p = fx.posts(spark, sf)
    lo, hi = p.agg(F.min("id"), F.max("id")).first()
    width = (hi - lo) // ROUNDS + 1
    part = F.floor((F.col("id") - lo) / width)
    deliveries = [p.where((part == i) | ((part == i - 1) & (F.col("id") % 10 == 0))) for i in range(ROUNDS)]
    return collect_rounds(spark, deliveries, scratch_path(spark, "stream"))


@register("stream_backfill", sql=fx.with_ctes(fx.SQL_POSTS) + """
SELECT p.handle, strftime(e.ts, '%a %b %d %H:%M:%S +0000 %Y') AS created_at, p.favorite_count, p.full_text, p.id,
       p.retweet_count, strftime(date_trunc('second', e.ts), '%Y-%m-%d %H:%M:%S') AS posted_at
FROM posts p JOIN events e ON e.event_id = p.id WHERE p.id > 1""")
def q_stream_backfill(spark, sf):
    """Accounts listed late land after the others with their whole, older
    back-file, mixed with posts delivered again; times in the platform's form."""
    p = fx.posts(spark, sf).withColumn("created_at", F.date_format(F.to_timestamp("created_at"), PLATFORM_FMT))
    late = F.pmod(F.xxhash64("handle"), F.lit(3)) == 0
    deliveries = [p.where(~late), p.where(late | (F.col("id") % 10 == 0))]
    out = collect_rounds(spark, deliveries, scratch_path(spark, "backfill"))
    return out.withColumn("posted_at", F.date_format(post_time("created_at"), "yyyy-MM-dd HH:mm:ss"))
