"""Sources and sinks for posts, cursors, handle lists and coded CSV files.

Landed post records are JSON (one record per line, or a string column); they
are parsed with an explicit schema (never inferred) and projected to the wanted
tags at plan time, so Parquet/JSON scans read only what the plan needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadline.functions.text import post_text
from threadline.schemas import (CURSOR_SCHEMA, DEFAULT_TAGS, KNOWN_TAGS, POSTS_SCHEMA,
                                RAW_POST_SCHEMA)


def project_tags(tags=DEFAULT_TAGS, extended: bool = True) -> list[str]:
    """P1 (plan time): wanted tags intersected with the known ones, plus `id`
    and `full_text` (extended) or `text`; sorted by name."""
    keep = set(KNOWN_TAGS).intersection(tags)
    keep.add("full_text" if extended else "text")
    keep.add("id")
    return sorted(keep)


def handle_first(df: DataFrame, key: str = "handle") -> DataFrame:
    """`handle`, then the other columns sorted by name."""
    return df.select(key, *sorted(c for c in df.columns if c != key))


def _tag_column(rec, tag: str, extended: bool):
    if tag == "full_text":
        return post_text(rec).alias(tag)          # X8: only full_text is rewritten
    return rec.getField(tag).alias(tag)


def parse_posts(raw: DataFrame, tags=DEFAULT_TAGS, extended: bool = True,
                handle_from: str | None = "user.screen_name", value_col: str = "value",
                handle_col: str | None = None) -> DataFrame:
    """Landed JSON records -> posts (P1 + X8 + P2). A tag missing from a record
    is null (Q3).  The handle comes from a column of the landing table
    (`handle_col`) or from a path inside the record (`handle_from`)."""
    rec = F.from_json(F.col(value_col), RAW_POST_SCHEMA)
    df = raw.select(*([F.col(handle_col).alias("__handle")] if handle_col else []),
                    rec.alias("__rec"))
    cols = [_tag_column(F.col("__rec"), t, extended) for t in project_tags(tags, extended)]
    if handle_col:
        handle = F.col("__handle")
    else:
        handle = F.col("__rec")
        for part in handle_from.split("."):
            handle = handle.getField(part)
    return handle_first(df.select(handle.alias("handle"), *cols))


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines landing zone as raw text records (parsed by `parse_posts`)."""
    return spark.read.text(path)


def read_posts(spark: SparkSession, path: str, names=None, fmt: str = "parquet") -> DataFrame:
    """S3: collected posts with caller-supplied column names (header line is
    consumed, Q2)."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
        return df.toDF(*names) if names else df
    schema = POSTS_SCHEMA if names is None else T.StructType(
        [T.StructField(n, POSTS_SCHEMA[n].dataType if n in POSTS_SCHEMA.names else T.StringType())
         for n in names])
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def clustered(df: DataFrame) -> DataFrame:
    """Posts dealt by handle and sorted.  A rebalance, not a repartition: AQE
    cuts the partition of a hot handle into several and joins small ones."""
    return df.hint("rebalance", F.col("handle")).sortWithinPartitions("handle", "id")


def append_posts(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append a batch of posts; rows are clustered by handle and ordered by
    id inside each file (no global sort)."""
    clustered(df).write.mode("append").format(fmt).save(path)


def write_cursors(df: DataFrame, path: str) -> None:
    """Cursors are written to a new directory (never over their own input)."""
    df.select(F.col("handle").cast("string"), F.col("since_id").cast("long")) \
        .write.mode("overwrite").parquet(path)


def read_cursors(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(CURSOR_SCHEMA).parquet(*([path] if isinstance(path, str) else path))


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions stored by target."""
    df.write.mode("overwrite").partitionBy("target").parquet(path)


def read_predictions(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """Stored predictions, of one target by partition pruning."""
    df = spark.read.parquet(path)
    return df if target is None else df.where(F.col("target") == target)


def write_splits(df: DataFrame, path: str) -> None:
    """Rows with their inputs, masks and labels, one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_handle_list(spark: SparkSession, path: str) -> DataFrame:
    """The wide account list; every column a string (no inference)."""
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def read_coded(spark: SparkSession, paths, schema: T.StructType) -> list[DataFrame]:
    """One DataFrame per path, explicit schema; `paths` must be a list (Q1).

    Columns with gaps were written as decimals (`1.0`, `-1.0`), so whole-number
    columns are read as text and converted; anything else in them raises."""
    if isinstance(paths, str):
        raise TypeError("paths must be a list of paths, not one string")
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    return [spark.read.schema(text).csv(p, header=True, multiLine=True, quote='"', escape='"')
            .select(*[_typed(f) for f in schema]) for p in paths]


def _typed(field: T.StructField):
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return c.alias(field.name)
    s = F.trim(c)
    number = s.try_cast("decimal(38,6)")
    return (F.when(c.isNull() | (s == ""), F.lit(None).cast(field.dataType))
            .when(number == F.floor(number), number.cast(field.dataType))
            .otherwise(F.raise_error(F.concat(F.lit(f"column {field.name} holds no whole number: "), c))
                       .cast(field.dataType)).alias(field.name))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
