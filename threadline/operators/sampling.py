"""Coding samples: exclusion of earlier samples, exact-size draw, template,
store and self-check (J2, J3, U5, P10, P11, O3, O4, S10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.operators.ranking import take_first
from threadline.schemas import CODING_TEMPLATE


def union_samples(prior: DataFrame) -> DataFrame:
    """Every id drawn before, once."""
    return prior.select("id").distinct()


def exclude_sampled(pool: DataFrame, prior: DataFrame) -> DataFrame:
    """One anti join against all earlier samples at once."""
    return pool.join(union_samples(prior), "id", "left_anti")


def check_exclusion(pool: DataFrame, prior: DataFrame) -> DataFrame:
    """Per earlier sample, how many of its ids are still in the pool
    (must be 0 everywhere; Q8)."""
    names = prior.select("sample_name").distinct()
    hits = prior.join(pool.select("id").distinct(), "id", "left_semi") \
        .groupBy("sample_name").agg(F.count(F.lit(1)).alias("n_failed"))
    return names.join(hits, "sample_name", "left") \
        .select("sample_name", F.coalesce("n_failed", F.lit(0)).cast("long").alias("n_failed"))


def sample_exact(pool: DataFrame, n: int, seed, key: str = "id") -> DataFrame:
    """O3: n rows without replacement, seeded (md5 order)."""
    return take_first(pool, key, n, seed)


def id_as_string(df: DataFrame, col: str = "id") -> DataFrame:
    """P10."""
    return df.withColumn(col, F.col(col).cast("string"))


def coding_template(df: DataFrame, cols=tuple(CODING_TEMPLATE)) -> DataFrame:
    """Add the empty hand-coding columns; all columns in lexical order."""
    missing = {c: F.lit(None).cast("double") for c in cols if c not in df.columns}
    out = df.withColumns(missing) if missing else df
    return out.select(*sorted(out.columns))


def write_sample(df: DataFrame, path: str, sample_name: str) -> None:
    """Append the sample under its name (one partition per sample)."""
    df.withColumn("sample_name", F.lit(sample_name)) \
        .write.mode("append").partitionBy("sample_name").parquet(path)


def draw_coding_sample(spark: SparkSession, pool: DataFrame, prior: DataFrame, n: int,
                       sample_name: str, seed, store: str | None = None):
    """J2 -> O3 -> P11 -> P10 -> S10 -> J3.

    Returns (sample, exclusion check).  With `store`, the sample is appended to
    the sample table there and read back, and the check runs against the
    written table (as the self-check of the reference does)."""
    fresh = exclude_sampled(pool, prior)
    sample = id_as_string(coding_template(sample_exact(fresh, n, seed)))
    if store is None:
        return sample, check_exclusion(fresh, prior)
    write_sample(sample, store, sample_name)
    stored = spark.read.parquet(store)
    drawn = stored.where(F.col("sample_name") == sample_name).drop("sample_name")
    # earlier samples must not reappear in the new one
    prior_ids = prior.select(F.col("id").cast("string").alias("id"), "sample_name")
    check = check_exclusion(drawn.select("id"), prior_ids)
    return drawn.select(*sorted(drawn.columns)), check
