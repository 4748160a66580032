"""Queries over text: clean_text, posts per source, JSON projection, durations,
printed score parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadline.functions.text import clean_text, format_duration
from threadline.operators import audit, labels
from threadline.plans import fixtures as fx
from threadline.plans.catalog import register
from threadline.plans.sql_text import sql_clean_text
from threadline.session import spread, table


@register("clean_text", sql=f"SELECT doc_id, {sql_clean_text('text')} AS cleaned_text FROM documents")
def q_clean_text(spark, sf):
    d = spread(table(spark, sf, "documents"))
    return d.select("doc_id", clean_text("text").alias("cleaned_text"))


@register("clean_text_conversations",
          sql=f"SELECT conv_id, turn, {sql_clean_text('text')} AS cleaned_text FROM conversations")
def q_clean_text_conversations(spark, sf):
    c = spread(table(spark, sf, "conversations"))
    return c.select("conv_id", "turn", clean_text("text").alias("cleaned_text"))


def posts_by_source(spark, sf):
    """Flagship: documents -> clean_text -> drop null -> distinct -> per source.

    Distinct texts are told apart by their digest, so no text is shuffled.  The
    null rows are not filtered before the distinct: a filter on the cleaned
    text would be pushed below the projection and evaluate the cleaning twice.
    The digest of a null is null, and count() skips it."""
    d = spread(table(spark, sf, "documents")).select(F.col("source").alias("handle"),
                                                     F.sha2(clean_text("text"), 256).alias("digest"))
    distinct = labels.drop_exact_duplicates(d)
    return distinct.groupBy(F.col("handle").alias("source")) \
        .agg(F.count("digest").alias("n_posts")).where(F.col("n_posts") > 0)


register("posts_by_source", sql=f"""
SELECT source, count(*) AS n_posts FROM (
  SELECT DISTINCT source, cleaned_text FROM (
    SELECT source, {sql_clean_text('text')} AS cleaned_text FROM documents)
  WHERE cleaned_text IS NOT NULL)
GROUP BY source""")(posts_by_source)


@register("format_duration", sql="""
SELECT user_id, round(s, 6) AS span_seconds, r AS rounded,
       CASE WHEN d = 0 THEN printf('%d:%02d:%02d', rest // 3600, rest % 3600 // 60, rest % 60)
            ELSE printf('%d day%s, %d:%02d:%02d', d, CASE WHEN abs(d) = 1 THEN '' ELSE 's' END,
                        rest // 3600, rest % 3600 // 60, rest % 60) END AS duration
FROM (SELECT user_id, s, r, d, r - d * 86400 AS rest FROM (
        SELECT user_id, s, r, CAST(floor(r / 86400) AS BIGINT) AS d FROM (
          SELECT user_id, s, CAST(round_even(s, 0) AS BIGINT) AS r FROM (
            SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS s
            FROM events GROUP BY user_id))))""")
def q_format_duration(spark, sf):
    """X9 over the active span of every user in `events` (one partial
    aggregate per user, then a scalar render)."""
    e = table(spark, sf, "events")
    # `ts` has no time zone: read its wall clock as UTC whatever the session
    # zone is (to_utc_timestamp undoes the session-zone cast), so spans never
    # gain or lose a daylight-saving hour.
    tz = spark.conf.get("spark.sql.session.timeZone")

    def micros(c):
        return F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), tz))

    span = e.groupBy("user_id").agg(
        ((micros(F.max("ts")) - micros(F.min("ts"))) / F.lit(1e6)).alias("s"))
    return span.select("user_id", F.round("s", 6).alias("span_seconds"),
                       F.bround("s", 0).cast("long").alias("rounded"),
                       format_duration("s").alias("duration"))


@register("project_posts", sql="""
SELECT source AS handle, n_chars AS favorite_count,
       CASE WHEN doc_id % 5 = 0 THEN 'RT @' || lang || ': ' || text ELSE text END AS full_text,
       doc_id AS id, lang
FROM documents""")
def q_project_posts(spark, sf):
    from threadline.sources.posts import parse_posts
    raw = fx.raw_posts(spark, sf)
    return parse_posts(raw, tags=["id", "favorite_count", "lang", "no_such_tag"],
                       handle_from="user.screen_name")
