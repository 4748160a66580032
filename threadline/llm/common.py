"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.session import materialize, table  # noqa: F401  (general helpers)

FOLDS = 5


def held_out(doc_id: str | Column) -> Column:
    """True for the rows no classifier may learn from."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str)
                   else doc_id.cast("string")) % FOLDS == 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def semi_join_filter(spark: SparkSession):
    """Jobs inside let Spark filter the large side of a selective shuffle join
    by a Bloom filter of the other side (2 MB of bits) before it is
    shuffled, whatever the sizes; the join itself stays exact."""
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1g",
              "expectedNumItems": "1500000", "numBits": "16777216"}
    old = {k: spark.conf.get(prefix + k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(prefix + k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(prefix + k) if v is None else spark.conf.set(prefix + k, v)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The text column with null read as the empty text."""
    return [t or "" for t in columns(batch, name)[0]]


def chunks(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut a sequence of sizes into index ranges of about `limit` in total."""
    lo, total, hi = 0, 0, 0
    for hi, n in enumerate(sizes, 1):
        total += n
        if total >= limit:
            yield lo, hi
            lo, total = hi, 0
    if lo < hi:
        yield lo, hi


def clean_labels(labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """(id, y): one row per labelled id; null ids and labels go, and an id that
    is labelled both ways takes the larger label."""
    return (labels.select(F.col(id_col).alias("id"), F.col(column).cast("int").alias("y"))
            .where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
            .groupBy("id").agg(F.max("y").alias("y")))


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit hashes (every output bit depends on all
    input bits)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def give_back() -> None:
    """Return freed memory of this worker to the system: workers live on between
    stages, and what they keep counts against the executor."""
    import ctypes
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):                    # another C library: it keeps what it keeps
        pass


def slices(batches, rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a worker holds few texts as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    give_back()


def sized(batches, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller batches of about `limit` bytes of a text column (one row at
    least), however long the texts are."""
    for b in batches:
        at = b.schema.get_field_index(column)
        lengths = pa.compute.fill_null(pa.compute.binary_length(b.column(at)), 0).to_pylist()
        for lo, hi in chunks(lengths, limit):
            yield b.slice(lo, hi - lo)
        give_back()
