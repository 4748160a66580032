"""Round-trip queries through the sources and sinks: everything is written to
the shared checkpoint folder and read back, and the read-back rows are what
the oracle checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadline.operators import audit
from threadline.operators import ranking as R
from threadline.operators.accounts import latest_cursor, pull_new_posts
from threadline.plans import fixtures as fx
from threadline.plans.catalog import register
from threadline.plans.q_labels import MERGED, SQL_MERGED, _cols, merged
from threadline.schemas import POSTS_SCHEMA, coded_schema
from threadline.session import scratch_path, table
from threadline.sources import posts as S
from threadline.streaming.collect import collect_full

_P = fx.with_ctes
POST_NAMES = ["handle"] + sorted(["id", "created_at", "full_text", "retweet_count", "favorite_count"])


@register("export_clean_posts", sql=_P(fx.SQL_POSTS, fx.SQL_POSTS_DUP) + """
SELECT DISTINCT * FROM posts_dup WHERE handle IS NOT NULL AND created_at IS NOT NULL
  AND favorite_count IS NOT NULL AND full_text IS NOT NULL AND id IS NOT NULL AND retweet_count IS NOT NULL""")
def q_export_clean_posts(spark, sf):
    """S9 (dedup + complete rows, CSV) then S3 (read back with given names)."""
    path = scratch_path(spark, "clean-posts")
    S.write_csv(audit.clean_export(fx.posts_dup(spark, sf)), path)
    return S.read_posts(spark, path, names=POST_NAMES, fmt="csv")


def _landing_json(spark, sf):
    """posts as landed JSON records (one per line)."""
    p = fx.posts(spark, sf)
    rec = F.struct("id", "created_at", "full_text", "retweet_count", "favorite_count",
                   F.struct(F.col("handle").alias("screen_name")).alias("user"))
    return p.select(F.to_json(rec).alias("value"), "id")


@register("collect_full", sql=_P(fx.SQL_POSTS) + "SELECT * FROM posts WHERE id > 1")
def q_collect_full(spark, sf):
    """K3: landed JSON -> parse (P1, X8, P2) -> pull every handle from
    since_id 1 -> overwrite the collection -> cursors; the collection is
    read back (S3)."""
    root = scratch_path(spark, "collect-full")
    _landing_json(spark, sf).select("value").write.mode("overwrite").text(f"{root}/landing")
    landing = S.parse_posts(S.read_landing(spark, f"{root}/landing"))
    collect_full(spark, landing, fx.post_handles(spark, sf), f"{root}/posts", f"{root}/cursors")
    return S.read_posts(spark, f"{root}/posts").select(*POST_NAMES)


@register("collect_full_cursors", sql=_P(fx.SQL_POSTS, fx.SQL_POST_HANDLES) + """
SELECT h.handle, CAST(coalesce(max(p.id), 1) AS BIGINT) AS since_id
FROM post_handles h LEFT JOIN posts p ON p.handle = h.handle AND p.id > 1 GROUP BY h.handle""")
def q_collect_full_cursors(spark, sf):
    """K3's cursor file (S6), read back."""
    root = scratch_path(spark, "collect-full")
    landing = S.parse_posts(_landing_json(spark, sf).select("value"))
    collect_full(spark, landing, fx.post_handles(spark, sf), f"{root}/posts", f"{root}/cursors")
    return S.read_cursors(spark, f"{root}/cursors")


@register("append_pulls", sql=_P(fx.SQL_POSTS, fx.SQL_POST_HANDLES) + "SELECT * FROM posts WHERE id > 1")
def q_append_pulls(spark, sf):
    """S4 -> S5 -> S6 twice in a row: the posts landed first, then all of them;
    the second pull starts from the recorded cursors, so each post is appended
    once."""
    root = scratch_path(spark, "append-pulls")
    posts, handles = fx.posts(spark, sf), fx.post_handles(spark, sf)
    middle = posts.agg(F.floor((F.min("id") + F.max("id")) / 2)).first()[0]
    cursors = None
    for step, landed in enumerate((posts.where(F.col("id") <= middle), posts)):
        S.append_posts(pull_new_posts(landed, handles, cursors), f"{root}/posts")
        collected = spark.read.parquet(f"{root}/posts")
        S.write_cursors(latest_cursor(collected, handles), f"{root}/cursors-{step}")
        cursors = S.read_cursors(spark, f"{root}/cursors-{step}")
    return S.read_posts(spark, f"{root}/posts").select(*POST_NAMES)


@register("write_splits", sql=f"""
WITH r AS (SELECT doc_id, n_chars, text, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rk,
                  count(*) OVER () AS n FROM documents),
s AS (SELECT doc_id, n_chars, text, rk, n - CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT) AS c1,
             CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT) AS h FROM r)
SELECT doc_id, n_chars, text, CASE WHEN rk <= c1 THEN 'train'
                    WHEN rk <= c1 + h - CAST(ceil(CAST(0.5 AS DOUBLE) * h) AS BIGINT) THEN 'validation'
                    ELSE 'test' END AS split FROM s""")
def q_write_splits(spark, sf):
    """O5 + S7 on whole texts: one Parquet table partitioned by split, read back."""
    path = scratch_path(spark, "splits")
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "text")
    S.write_splits(R.split_exact(d, "doc_id", 42), path)
    return spark.read.parquet(path).select("doc_id", "n_chars", "text", "split")


@register("read_csv_inputs", sql=_P(fx.SQL_CODED_BASE, fx.SQL_CODED_OLD, fx.SQL_CODED_NEW, SQL_MERGED)
          + f"SELECT {_cols(MERGED)} FROM merged")
def q_read_csv_inputs(spark, sf):
    """Coded posts written as CSV the way columns with gaps are (`1.0`,
    `-1.0`, empty cells; texts hold newlines and quotes), read back with an
    explicit schema."""
    path = scratch_path(spark, "coded-csv")
    rows = merged(spark, sf)
    S.write_csv(rows.select(*[F.col(c) if c == "text" else F.col(c).cast("double").alias(c) for c in MERGED]), path)
    (back,) = S.read_coded(spark, [path], coded_schema(MERGED))
    return back


@register("read_handle_list", sql=_P(fx.SQL_HANDLE_LIST) + """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, "Twitter Handle", "Twitter Handle 2" FROM handle_list""")
def q_read_handle_list(spark, sf):
    """The wide account list written as CSV and read back (strings)."""
    path = scratch_path(spark, "handles-csv")
    S.write_csv(fx.handle_list(spark, sf), path)
    return S.read_handle_list(spark, path)


assert POSTS_SCHEMA.names == POST_NAMES
