"""Coded-post label handling: merge, clean, label maps and the M4 composition.

Everything is a DataFrame -> DataFrame transformation.  The label map (A2)
is an aggregate over (column, label) pairs whose size is bounded by the label
domain, not by the number of rows; it is computed distributed (unpivot +
partial aggregation) and only its few rows are turned into a literal CASE
expression, after a size check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadline.functions.arrays import one_hot_decode as _one_hot
from threadline.schemas import (ASK_LIST, LEGACY_COLUMNS, NEW_COLUMNS, POLICY_LIST,
                                RENAME_TO_OLD, Y_COLS)

# A target with more distinct negative labels than this is no label column.
MAX_LITERAL_MAP = 10_000


# ---- projections ------------------------------------------------------------

def drop_columns(df: DataFrame, cols=tuple(LEGACY_COLUMNS)) -> DataFrame:
    """P3."""
    return df.drop(*cols)


def to_canonical(df: DataFrame, cols=tuple(NEW_COLUMNS), rename_map=None) -> DataFrame:
    """Select the new-format columns, then rename to the old names (Q4)."""
    rename_map = RENAME_TO_OLD if rename_map is None else rename_map
    return df.select(*cols).withColumnsRenamed({k: v for k, v in rename_map.items() if k in cols})


def derive_opinion(df: DataFrame, source: str = "factual_claim", name: str = "opinion") -> DataFrame:
    """P5: 1 when the claim flag is falsy (0); null is truthy, so null -> 0."""
    return df.withColumn(name, F.when(F.col(source) == 0, 1).otherwise(0).cast("int"))


def derive_no_ask(df: DataFrame, cols=("asks_for_donation", "ask_to_etc", "ask_misc")) -> DataFrame:
    """1 when all three ask flags are 0."""
    cond = reduce(lambda a, b: a & b, [F.col(c) == 0 for c in cols])
    return df.withColumn("no_ask", F.when(cond, 1).otherwise(0).cast("int"))


def decode_one_hot(df: DataFrame, policy_cols=tuple(POLICY_LIST), ask_cols=tuple(ASK_LIST)) -> DataFrame:
    """P7 for both groups: `policies`, `ask_requests`."""
    return df.withColumns({"policies": _one_hot(list(policy_cols)),
                           "ask_requests": _one_hot(list(ask_cols))})


def cast_labels(df: DataFrame, y_cols=tuple(Y_COLS)) -> DataFrame:
    """Every present target to int."""
    return df.withColumns({c: F.col(c).cast("int") for c in y_cols if c in df.columns})


# ---- filters / null handling -------------------------------------------------

def fill_index(df: DataFrame, col: str = "index") -> DataFrame:
    """N1."""
    return df.fillna({col: 0})


def fill_labels(df: DataFrame, cols) -> DataFrame:
    """Null -> 0 in the given label columns."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in cols})


def drop_incomplete(df: DataFrame, subset=None) -> DataFrame:
    """N5 (any null in any column) / N6 (any null in `subset`)."""
    return df.dropna(how="any", subset=subset)


def require_exactly_one(df: DataFrame, cols=tuple(POLICY_LIST)) -> DataFrame:
    """Flags sum to exactly 1 (a null flag fails), then N5 (Q6)."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in cols])
    return drop_incomplete(df.where(total == 1))


def require_any(df: DataFrame, cols=tuple(POLICY_LIST)) -> DataFrame:
    """Notebook variant, flags sum to anything but 0, then N5."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in cols])
    return drop_incomplete(df.where(total != 0))


def require_min_values(df: DataFrame, k: int = 4) -> DataFrame:
    """Rows with at least k non-null values."""
    return df.dropna(thresh=k)


def require_differs(df: DataFrame, a: str = "opinion", b: str = "factual_claim") -> DataFrame:
    """Keep a != b; like pandas, a null on either side compares unequal."""
    return df.where((F.col(a) != F.col(b)) | F.col(a).isNull() | F.col(b).isNull())


def at_most_one(df: DataFrame, cols=("asks_for_donation", "ask_to_etc", "ask_misc")) -> DataFrame:
    """Drop rows where two or more of the flags equal 1."""
    ones = reduce(lambda x, y: x + y, [F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)) for c in cols])
    return df.where(ones <= 1)


# ---- aggregations -------------------------------------------------------------

def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """A1: distinct over all columns (null equals null)."""
    return df.dropDuplicates()


def _targets(df: DataFrame, cols) -> list[str]:
    cols = Y_COLS if cols is None else cols
    return [c for c in cols if c in df.columns]


def label_map(df: DataFrame, cols=None) -> DataFrame:
    """A2: per target, each distinct negative label (ascending) is encoded as
    max + 1, max + 2, ... where max is the largest non-null label (Q10).

    One pass for all targets: unpivot to (column, label), distinct pairs with a
    map-side partial aggregate, then a window per column over the few pairs.
    Output: (target, original_label, encoded_label) for negative labels only.
    """
    cols = _targets(df, cols)
    long = df.select(*[F.col(c).cast("int").alias(c) for c in cols]) \
        .unpivot([], cols, "target", "label") \
        .where(F.col("label").isNotNull()) \
        .distinct()
    by_col = Window.partitionBy("target")
    ranked = long.withColumn("max_label", F.max("label").over(by_col)) \
        .where(F.col("label") < 0) \
        .withColumn("rank", F.row_number().over(by_col.orderBy("label")))
    return ranked.select("target", F.col("label").alias("original_label"),
                         (F.col("max_label") + F.col("rank")).cast("int").alias("encoded_label"))


def _collect_map(label_map_df: DataFrame):
    rows = label_map_df.limit(MAX_LITERAL_MAP + 1).collect()
    if len(rows) > MAX_LITERAL_MAP:
        raise ValueError(f"more than {MAX_LITERAL_MAP} negative labels")
    out: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        out.setdefault(r["target"], []).append((r["original_label"], r["encoded_label"]))
    return out


def _apply_map(df: DataFrame, label_map_df: DataFrame, src: str, fill_null: bool) -> DataFrame:
    exprs = {}
    for c, pairs in _collect_map(label_map_df).items():
        if c not in df.columns:
            continue
        base: Column = F.col(c)
        if fill_null:
            base = F.coalesce(base, F.lit(0))
        e = None
        for frm, to in sorted(pairs):
            a, b = (frm, to) if src == "original_label" else (to, frm)
            e = (F.when(base == a, F.lit(b)) if e is None else e.when(base == a, F.lit(b)))
        exprs[c] = e.otherwise(base).cast("int")
    return df.withColumns(exprs) if exprs else df


def encode_labels(df: DataFrame, label_map_df: DataFrame) -> DataFrame:
    """A3 (+ N2): nulls in a column with negative labels become 0, then each
    negative label becomes its encoded value."""
    return _apply_map(df, label_map_df, "original_label", fill_null=True)


def decode_labels(df: DataFrame, label_map_df: DataFrame) -> DataFrame:
    """Encoded values back to the original negative labels (Q9)."""
    return _apply_map(df, label_map_df, "encoded_label", fill_null=False)


# ---- set operation and the whole step ---------------------------------------

def merge_coded(prev: DataFrame, new: DataFrame) -> DataFrame:
    """Legacy columns dropped from prev, new conformed to the old names with
    `opinion` derived, stacked by name (UNION ALL, missing columns null)."""
    prev = drop_columns(prev, [c for c in LEGACY_COLUMNS if c in prev.columns])
    new = derive_opinion(to_canonical(new))
    return prev.unionByName(new, allowMissingColumns=True)


def prepare_training_set(prev: DataFrame, new: DataFrame | None = None,
                         policy_rule: str = "exactly_one", label_map_df: DataFrame | None = None):
    """M4: U1 -> A1 -> N1 -> A2/A3 -> N3 (or N4) -> N5 -> N8 -> N9 -> P6 -> P7.

    Returns (training rows, label map)."""
    df = merge_coded(prev, new) if new is not None else prev
    # duplicates don't change the set of labels: the map reads label columns only
    lm = label_map(df) if label_map_df is None else label_map_df
    df = encode_labels(fill_index(drop_exact_duplicates(df)), lm)
    df = require_exactly_one(df) if policy_rule == "exactly_one" else require_any(df)
    df = at_most_one(require_differs(df))
    df = decode_one_hot(derive_no_ask(df))
    return df, lm
