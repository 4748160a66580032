"""Duplicate-pull audit of collected posts (A4-A8) and the clean export.

All counts are grouped aggregates with map-side partial aggregation; the
suspicious-handle set is applied with a semi join (Spark broadcasts it only
when its measured size is under the broadcast threshold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Posts per handle above which the handle is taken as pulled twice.
QUOTA = 3248


def posts_per_handle(df: DataFrame, key: str = "handle") -> DataFrame:
    """A4: rows per handle (sort descending only when presenting)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_posts"))


def over_quota_handles(df: DataFrame, limit: int = QUOTA, key: str = "handle") -> DataFrame:
    """A5: handles with more than `limit` rows (HAVING)."""
    return posts_per_handle(df, key).where(F.col("n_posts") > limit)


def duplicate_profile(df: DataFrame, handles: DataFrame, key: str = "handle") -> DataFrame:
    """For the suspicious handles, rows per (handle, created_at)."""
    return df.join(handles.select(key), key, "left_semi") \
        .groupBy(key, "created_at").agg(F.count(F.lit(1)).alias("n_rows"))


def distinct_counts(df: DataFrame, handles: DataFrame, key: str = "handle") -> DataFrame:
    """Rows per suspicious handle after exact de-duplication."""
    return df.join(handles.select(key), key, "left_semi").dropDuplicates() \
        .groupBy(key).agg(F.count(F.lit(1)).alias("n_distinct"))


def row_digest(df: DataFrame) -> Column:
    """128 bits that tell rows apart over all columns, null equal to null.  Every
    value is written with its length, so no two rows spell alike; values that
    compare equal (0.0 and -0.0) are made one first."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)
        text = F.hex(c) if isinstance(f.dataType, T.BinaryType) else \
            F.to_json(F.struct(c)) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else c.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.md5(F.concat(*parts)))


def audit_shape(df: DataFrame) -> DataFrame:
    """One row with the raw, distinct and distinct-and-complete counts.

    Rows are told apart by their digest: 16 bytes and a flag a row are shuffled
    once, and no column of the table.  (Two different rows of one digest would
    count as one; at 10^12 rows that has a chance of about 10^-15.)"""
    complete = F.lit(True)
    for c in df.columns:
        complete = complete & F.col(f"`{c}`").isNotNull()
    grouped = df.select(row_digest(df).alias("__digest"), complete.alias("__complete")) \
        .groupBy("__digest", "__complete").agg(F.count(F.lit(1)).alias("__n"))
    return grouped.agg(
        F.sum("__n").cast("long").alias("n_rows"),
        F.count(F.lit(1)).cast("long").alias("n_distinct"),
        F.count(F.when(F.col("__complete"), 1)).cast("long").alias("n_complete"),
    )


def clean_export(df: DataFrame) -> DataFrame:
    """S9 body: deduplicated and null-free."""
    return df.dropDuplicates().dropna(how="any")
