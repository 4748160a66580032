"""Queries over posts, handles and cursors: pull, cursors, handle lists,
duplicate audit, sparse rows, metric refresh, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadline.operators import accounts as A
from threadline.operators import audit
from threadline.operators import labels as L
from threadline.operators import ranking as R
from threadline.operators.refresh import refresh_metrics, updates_projection
from threadline.plans import fixtures as fx
from threadline.plans.catalog import register
from threadline.session import scratch_path
from threadline.sources.store import PostStore

QUOTA_AT_SMALL_SF = 80      # the audit quota used on the driver tables (FIXTURES)
SPAN_AT_SMALL_SF = 1000     # ids per range of the stored posts, at least

_P = fx.with_ctes
_POSTS_COLS = "handle, created_at, favorite_count, full_text, id, retweet_count"


_PULL = _P(fx.SQL_POSTS, fx.SQL_POST_HANDLES, fx.SQL_CURSORS, fx.SQL_ACCOUNT_STATUS) + f"""
SELECT {", ".join("p." + c for c in _POSTS_COLS.split(", "))} FROM posts p
JOIN post_handles h ON h.handle = p.handle
LEFT JOIN cursors c ON c.handle = p.handle
WHERE p.handle NOT IN (SELECT handle FROM account_status WHERE status IN ('protected', 'error'))
  AND p.id > coalesce(c.since_id, 1)"""


@register("pull_new_posts", sql=_PULL)
def q_pull_new_posts(spark, sf):
    return A.pull_new_posts(fx.posts(spark, sf), fx.post_handles(spark, sf),
                            fx.cursors(spark, sf), fx.account_status(spark, sf))


@register("pull_landed", sql=_PULL)
def q_pull_landed(spark, sf):
    """S5 + S4 on a stored collection: posts are landed by handle bucket and id
    range, and the pull reads only the folders that its cursors leave.  Ranges
    widen with the ids, so the folders stay at most 8 x 64."""
    posts = fx.posts(spark, sf)
    store = PostStore.fitting(scratch_path(spark, "landed"), posts, buckets=8, least=SPAN_AT_SMALL_SF)
    store.append(posts)
    return store.pull(fx.post_handles(spark, sf), fx.cursors(spark, sf), fx.account_status(spark, sf))


@register("latest_cursor", sql=_P(fx.SQL_POSTS, fx.SQL_POST_HANDLES) + """
SELECT h.handle, CAST(coalesce(max(p.id), 1) AS BIGINT) AS since_id
FROM post_handles h LEFT JOIN posts p ON p.handle = h.handle GROUP BY h.handle""")
def q_latest_cursor(spark, sf):
    return A.latest_cursor(fx.posts(spark, sf), fx.post_handles(spark, sf))


@register("advance_cursors", sql=_P(fx.SQL_POSTS, fx.SQL_POST_HANDLES, fx.SQL_CURSORS) + """
, pulled AS (SELECT p.* FROM posts p LEFT JOIN cursors c USING (handle) WHERE p.id > coalesce(c.since_id, 1))
SELECT h.handle, CAST(coalesce(greatest(m.mx, c.since_id), m.mx, c.since_id, 1) AS BIGINT) AS since_id
FROM (SELECT handle FROM post_handles UNION SELECT handle FROM cursors) h
LEFT JOIN (SELECT handle, max(id) AS mx FROM pulled GROUP BY handle) m USING (handle)
LEFT JOIN cursors c USING (handle)""")
def q_advance_cursors(spark, sf):
    """K2's cursor rule on the batch data: newest pulled id, else the old cursor."""
    posts, handles, cur = fx.posts(spark, sf), fx.post_handles(spark, sf), fx.cursors(spark, sf)
    pulled = A.pull_new_posts(posts, handles, cur)
    return A.advance_cursors(pulled, handles, cur)


_HL = _P(fx.SQL_HANDLE_LIST) + """, stacked AS (
  SELECT "Twitter Handle" AS handle FROM handle_list WHERE "Twitter Handle" IS NOT NULL
  UNION ALL SELECT "Twitter Handle 2" FROM handle_list WHERE "Twitter Handle 2" IS NOT NULL)
"""


@register("pending_handles", sql=_HL + "SELECT DISTINCT handle FROM stacked")
def q_pending_handles(spark, sf):
    return A.pending_handles(fx.handle_list(spark, sf))


@register("repeated_handles", sql=_HL + """
SELECT handle, count(*) AS n_seen FROM stacked WHERE handle <> ' ' GROUP BY handle HAVING count(*) > 1""")
def q_repeated_handles(spark, sf):
    return A.repeated_handles(fx.handle_list(spark, sf))


_DUP = _P(fx.SQL_POSTS, fx.SQL_POSTS_DUP)
_OVER = f"over AS (SELECT handle, count(*) AS n_posts FROM posts_dup GROUP BY handle HAVING count(*) > {QUOTA_AT_SMALL_SF})"


@register("over_quota_handles", sql=_DUP + f", {_OVER} SELECT * FROM over")
def q_over_quota(spark, sf):
    return audit.over_quota_handles(fx.posts_dup(spark, sf), QUOTA_AT_SMALL_SF)


@register("duplicate_profile", sql=_DUP + f""", {_OVER}
SELECT handle, created_at, count(*) AS n_rows FROM posts_dup
WHERE handle IN (SELECT handle FROM over) GROUP BY handle, created_at""")
def q_duplicate_profile(spark, sf):
    p = fx.posts_dup(spark, sf)
    return audit.duplicate_profile(p, audit.over_quota_handles(p, QUOTA_AT_SMALL_SF))


@register("distinct_counts", sql=_DUP + f""", {_OVER}
SELECT handle, count(*) AS n_distinct FROM (SELECT DISTINCT * FROM posts_dup
WHERE handle IN (SELECT handle FROM over)) GROUP BY handle""")
def q_distinct_counts(spark, sf):
    p = fx.posts_dup(spark, sf)
    return audit.distinct_counts(p, audit.over_quota_handles(p, QUOTA_AT_SMALL_SF))


@register("audit_shape", sql=_DUP + """
SELECT (SELECT count(*) FROM posts_dup) AS n_rows,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM posts_dup)) AS n_distinct,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM posts_dup) WHERE handle IS NOT NULL
          AND created_at IS NOT NULL AND favorite_count IS NOT NULL AND full_text IS NOT NULL
          AND id IS NOT NULL AND retweet_count IS NOT NULL) AS n_complete""")
def q_audit_shape(spark, sf):
    return audit.audit_shape(fx.posts_dup(spark, sf))


@register("audit_shape_sparse", sql=_P(fx.SQL_POSTS, fx.SQL_POSTS_SPARSE) + """
, d AS (SELECT * FROM posts_sparse UNION ALL SELECT * FROM posts_sparse WHERE id % 4 = 0)
SELECT (SELECT count(*) FROM d) AS n_rows,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS n_distinct,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM d) WHERE handle IS NOT NULL
          AND created_at IS NOT NULL AND favorite_count IS NOT NULL AND full_text IS NOT NULL
          AND id IS NOT NULL AND retweet_count IS NOT NULL) AS n_complete""")
def q_audit_shape_sparse(spark, sf):
    """A8 where distinct and complete counts differ (duplicated sparse rows)."""
    p = fx.posts_sparse(spark, sf)
    return audit.audit_shape(p.unionAll(p.where(F.col("id") % 4 == 0)))


@register("require_min_values", sql=_P(fx.SQL_POSTS, fx.SQL_POSTS_SPARSE) + """
SELECT * FROM posts_sparse WHERE (CAST(handle IS NOT NULL AS INTEGER) + CAST(created_at IS NOT NULL AS INTEGER)
  + CAST(favorite_count IS NOT NULL AS INTEGER) + CAST(full_text IS NOT NULL AS INTEGER)
  + CAST(id IS NOT NULL AS INTEGER) + CAST(retweet_count IS NOT NULL AS INTEGER)) >= 4""")
def q_require_min_values(spark, sf):
    return L.require_min_values(fx.posts_sparse(spark, sf), 4)


@register("drop_incomplete_subset", sql=_P(fx.SQL_POSTS, fx.SQL_POSTS_SPARSE) + """
SELECT * FROM posts_sparse WHERE created_at IS NOT NULL AND full_text IS NOT NULL""")
def q_drop_incomplete_subset(spark, sf):
    """N6 on the sparse rows."""
    return L.drop_incomplete(fx.posts_sparse(spark, sf), subset=["created_at", "full_text"])


@register("refresh_metrics", sql=_P(fx.SQL_POSTS, fx.SQL_UPDATES, fx.SQL_POSTS_FOR_REFRESH) + """
, u AS (SELECT id, retweets, favorites FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, retweets DESC, favorites DESC) AS rn
    FROM updates) WHERE rn = 1)
SELECT p.id, p.handle, p.created_at, p.full_text,
       CAST(coalesce(u.retweets, p.retweet_count) AS BIGINT) AS retweets,
       CAST(coalesce(u.favorites, p.favorite_count) AS BIGINT) AS favorites
FROM posts_for_refresh p LEFT JOIN u ON u.id = p.id WHERE p.created_at IS NOT NULL""")
def q_refresh_metrics(spark, sf):
    return refresh_metrics(fx.posts_for_refresh(spark, sf), fx.updates(spark, sf))


@register("refresh_from_pull", sql=_P(fx.SQL_POSTS, fx.SQL_POSTS_FOR_REFRESH) + """
SELECT id, handle, created_at, full_text,
       CAST(CASE WHEN id % 3 = 0 THEN retweet_count + 5 ELSE retweet_count END AS BIGINT) AS retweets,
       CAST(CASE WHEN id % 3 = 0 THEN favorite_count + 7 ELSE favorite_count END AS BIGINT) AS favorites
FROM posts_for_refresh WHERE created_at IS NOT NULL""")
def q_refresh_from_pull(spark, sf):
    """The refresh as it is run: posts pulled anew -> P9 -> J1, written back into
    the stored collection (only folders that hold an updated post) and read."""
    again = fx.posts(spark, sf).where(F.col("id") % 3 == 0) \
        .withColumn("retweet_count", F.col("retweet_count") + 5) \
        .withColumn("favorite_count", F.col("favorite_count") + 7)
    updates = updates_projection(again).withColumn("seq", F.lit(1))
    posts = fx.posts_for_refresh(spark, sf)
    store = PostStore.fitting(scratch_path(spark, "collection"), posts, buckets=2, least=10 * SPAN_AT_SMALL_SF)
    store.append(posts)
    store.refresh(updates)
    return store.read(spark).dropna(subset=["created_at"]).select(
        "id", "handle", "created_at", "full_text", F.col("retweet_count").alias("retweets"),
        F.col("favorite_count").alias("favorites"))


@register("chronological", sql=_P(fx.SQL_POSTS) + """
SELECT handle, id, CAST(row_number() OVER (PARTITION BY handle ORDER BY id) AS BIGINT) AS rank FROM posts""")
def q_chronological(spark, sf):
    """O1 as a rank column: position of each post in its handle's timeline."""
    return R.within_key_rank(fx.posts(spark, sf).select("handle", "id"), "handle", "id")


@register("preview_last", sql=_P(fx.SQL_POSTS) + "SELECT id, full_text FROM posts ORDER BY id DESC LIMIT 10")
def q_preview_last(spark, sf):
    return R.preview_last(fx.posts(spark, sf).select("id", "full_text"), "id", 10)
