"""Queries for samples, splits and orders (md5-keyed, reproducible)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadline.operators import ranking as R
from threadline.operators import sampling as S
from threadline.plans import fixtures as fx
from threadline.plans.catalog import register
from threadline.schemas import CODING_TEMPLATE
from threadline.session import scratch_path, table

SEED = 42
SAMPLE_SIZE = 100

_P = fx.with_ctes
_POOL = _P(fx.SQL_POOL, fx.SQL_PRIOR)


@register("exclude_sampled", sql=_POOL + "SELECT id, text FROM pool WHERE id NOT IN (SELECT id FROM prior_samples)")
def q_exclude_sampled(spark, sf):
    return S.exclude_sampled(fx.pool(spark, sf), fx.prior_samples(spark, sf))


@register("check_exclusion", sql=_POOL + """
, fresh AS (SELECT * FROM pool WHERE id NOT IN (SELECT id FROM prior_samples))
SELECT s.sample_name, CAST(count(f.id) AS BIGINT) AS n_failed
FROM prior_samples s LEFT JOIN fresh f ON f.id = s.id GROUP BY s.sample_name""")
def q_check_exclusion(spark, sf):
    pool, prior = fx.pool(spark, sf), fx.prior_samples(spark, sf)
    return S.check_exclusion(S.exclude_sampled(pool, prior), prior)


@register("check_exclusion_unfiltered", sql=_POOL + """
SELECT s.sample_name, CAST(count(p.id) AS BIGINT) AS n_failed
FROM prior_samples s LEFT JOIN pool p ON p.id = s.id GROUP BY s.sample_name""")
def q_check_exclusion_unfiltered(spark, sf):
    """J3 on a pool that still holds the earlier samples: every id is a hit."""
    return S.check_exclusion(fx.pool(spark, sf), fx.prior_samples(spark, sf))


@register("sample_exact", sql=_POOL + f"""
SELECT id, text FROM pool WHERE id NOT IN (SELECT id FROM prior_samples)
ORDER BY md5('{SEED}:' || CAST(id AS VARCHAR)), id LIMIT {SAMPLE_SIZE}""")
def q_sample_exact(spark, sf):
    pool, prior = fx.pool(spark, sf), fx.prior_samples(spark, sf)
    return S.sample_exact(S.exclude_sampled(pool, prior), SAMPLE_SIZE, SEED)


_TEMPLATE_SQL = ", ".join(
    (f'"{c}"' if c in ("id", "text") else f'CAST(NULL AS DOUBLE) AS "{c}"')
    for c in sorted(set(CODING_TEMPLATE) | {"id", "text"}))


@register("draw_coding_sample", sql=_POOL + f"""
, s AS (SELECT CAST(id AS VARCHAR) AS id, text FROM pool WHERE id NOT IN (SELECT id FROM prior_samples)
        ORDER BY md5('{SEED}:' || CAST(id AS VARCHAR)), id LIMIT {SAMPLE_SIZE})
SELECT {_TEMPLATE_SQL} FROM s""")
def q_draw_coding_sample(spark, sf):
    """O4 end to end: the sample is appended to a sample table in the shared
    folder, read back, and checked against the earlier samples."""
    store = scratch_path(spark, "samples")
    sample, check = S.draw_coding_sample(spark, fx.pool(spark, sf), fx.prior_samples(spark, sf),
                                         SAMPLE_SIZE, "batch3", SEED, store=store)
    failed = check.agg(F.sum("n_failed")).first()[0]
    if failed:
        raise AssertionError(f"{failed} earlier-sampled ids in the new sample")
    return sample


@register("split_hash", sql=f"""
SELECT doc_id, CASE WHEN ('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 80 THEN 'train'
                    WHEN ('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 90 THEN 'validation'
                    ELSE 'test' END AS split
FROM documents""")
def q_split_hash(spark, sf):
    return R.split_hash(table(spark, sf, "documents").select("doc_id"), "doc_id", SEED)


@register("split_exact", sql=f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) AS rk,
                  count(*) OVER () AS n FROM documents),
s AS (SELECT doc_id, rk, n - CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT) AS c1,
             CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT) AS h FROM r)
SELECT doc_id, CASE WHEN rk <= c1 THEN 'train'
                    WHEN rk <= c1 + h - CAST(ceil(CAST(0.5 AS DOUBLE) * h) AS BIGINT) THEN 'validation'
                    ELSE 'test' END AS split FROM s""")
def q_split_exact(spark, sf):
    return R.split_exact(table(spark, sf, "documents").select("doc_id"), "doc_id", SEED)


@register("shuffle_order", sql=f"""
SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('{SEED}:0:' || CAST(doc_id AS VARCHAR)), doc_id) AS BIGINT)
       AS shuffle_rank FROM documents""")
def q_shuffle_order(spark, sf):
    return R.shuffle_order(table(spark, sf, "documents").select("doc_id"), "doc_id", SEED, epoch=0)


@register("batch_number", sql="""
SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS rank,
       CAST((row_number() OVER (ORDER BY event_id) - 1) // 32 AS BIGINT) AS batch FROM events""")
def q_batch_number(spark, sf):
    """Sequential batches of 32 in id order over all events."""
    return R.batch_number(table(spark, sf, "events").select("event_id"), "event_id", 32)
