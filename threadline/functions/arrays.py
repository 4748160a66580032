"""Array functions (Column -> Column): padding, masks, argmax, one-hot decode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad_or_truncate(arr, n: int = 64, value: int = 0,
                    padding: str = "post", truncating: str = "post") -> Column:
    """Fixed length n. 'post' pads/cuts at the end, 'pre' at the start."""
    a = _col(arr)
    fill = F.array_repeat(F.lit(value).cast("int"), F.greatest(F.lit(n) - F.size(a), F.lit(0)))
    if truncating == "post":
        cut = F.slice(a, 1, n)
    else:  # keep the last n
        cut = F.when(F.size(a) > n, F.slice(a, -n, n)).otherwise(a)
    return F.concat(cut, fill) if padding == "post" else F.concat(fill, cut)


def attention_mask(arr) -> Column:
    """R2: 1 where the token id is > 0."""
    return F.transform(_col(arr), lambda x: (x > 0).cast("int"))


def argmax(arr) -> Column:
    """0-based index of the first maximum; null for an empty/null array."""
    a = _col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def one_hot_decode(cols: list[str]) -> Column:
    """0-based index of the first column equal to 1, null if none."""
    pos = F.array_position(F.array(*[F.col(c) for c in cols]), 1)
    return F.when(pos > 0, (pos - 1).cast("int"))
