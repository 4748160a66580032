"""Account lists, per-handle cursors and the incremental pull (U2, U3, N10,
S4/J4, A9, K3).

The pull is one join of landed posts to the table of wanted handles and their
cursors: equal `handle`, residual `id > since_id`.  Posts are skewed by handle
(one handle may hold a third of all rows).  The handle side is written and read
back first, so both sides of the join are plain shuffles and AQE can split the
skewed partitions of the post side (it can't behind an aggregate).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.schemas import HANDLE_COLUMN_MARKER
from threadline.session import materialize

INACTIVE = ("protected", "error")


def _handle_columns(list_df: DataFrame, marker: str) -> list[str]:
    return [c for c in list_df.columns if marker in c]


def stacked_handles(list_df: DataFrame, marker: str = HANDLE_COLUMN_MARKER) -> DataFrame:
    """Every handle cell of the matching columns, nulls dropped (with repeats)."""
    cols = _handle_columns(list_df, marker)
    return list_df.select(*[F.col(c).cast("string").alias(c) for c in cols]) \
        .unpivot([], cols, "source_column", "handle") \
        .where(F.col("handle").isNotNull())


def pending_handles(list_df: DataFrame, marker: str = HANDLE_COLUMN_MARKER) -> DataFrame:
    """All handles of the list, each once."""
    return stacked_handles(list_df, marker).select("handle").distinct()


def repeated_handles(list_df: DataFrame, marker: str = HANDLE_COLUMN_MARKER) -> DataFrame:
    """Handles met more than once anywhere in the list, ignoring ' ' (Q13)."""
    return stacked_handles(list_df, marker).where(F.col("handle") != " ") \
        .groupBy("handle").agg(F.count(F.lit(1)).alias("n_seen")) \
        .where(F.col("n_seen") > 1)


def drop_unknown_accounts(handles: DataFrame, status: DataFrame | None) -> DataFrame:
    """Protected / failing accounts return no posts (and do not fail)."""
    if status is None:
        return handles
    bad = status.where(F.col("status").isin(*INACTIVE)).select("handle")
    return handles.join(bad, "handle", "left_anti")


def handle_cursors(handles: DataFrame, cursors: DataFrame | None = None, status: DataFrame | None = None,
                   default_since: int = 1) -> DataFrame:
    """(handle, __since): every wanted, reachable handle with its cursor."""
    wanted = drop_unknown_accounts(handles.select("handle").distinct(), status)
    if cursors is None:
        return wanted.withColumn("__since", F.lit(default_since).cast("long"))
    cur = cursors.groupBy("handle").agg(F.max("since_id").alias("__since"))
    return wanted.join(cur, "handle", "left").withColumn(
        "__since", F.coalesce("__since", F.lit(default_since)).cast("long"))


def pull_new_posts(landing: DataFrame, handles: DataFrame, cursors: DataFrame | None = None,
                   status: DataFrame | None = None, default_since: int = 1) -> DataFrame:
    """S4 + J4: for every wanted, reachable handle, its posts with
    id > since_id (exclusive; no cursor -> `default_since`)."""
    since = materialize(handle_cursors(handles, cursors, status, default_since), "handle-cursors")
    return landing.join(since, "handle").where(F.col("id") > F.col("__since")).drop("__since")


def latest_cursor(posts: DataFrame, handles: DataFrame) -> DataFrame:
    """Newest id per handle; a handle without posts gets 1 (Q23 as run)."""
    newest = posts.groupBy("handle").agg(F.max("id").alias("__max"))
    return handles.select("handle").distinct().join(newest, "handle", "left") \
        .select("handle", F.coalesce(F.col("__max"), F.lit(1)).cast("long").alias("since_id"))


def advance_cursors(pulled: DataFrame, handles: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Cursor for the next pull (K2 form): newest pulled id, else the old
    cursor, else 1 -- a handle with no new posts keeps its cursor."""
    newest = pulled.groupBy("handle").agg(F.max("id").alias("__max"))
    base = handles.select("handle").distinct()
    if previous is not None:
        base = base.unionByName(previous.select("handle")).distinct()
        base = base.join(previous.select("handle", F.col("since_id").alias("__old")), "handle", "left")
    else:
        base = base.withColumn("__old", F.lit(None).cast("long"))
    return base.join(newest, "handle", "left").select(
        "handle",
        F.coalesce(F.greatest("__max", "__old"), F.lit(1)).cast("long").alias("since_id"))


def chronological(df: DataFrame) -> DataFrame:
    """O1: ascending id inside each handle (a total order for presentation;
    writers use sortWithinPartitions instead of a global sort)."""
    return df.orderBy("handle", "id")
