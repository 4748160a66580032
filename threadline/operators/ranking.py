"""Ranking without a single-task window.

A window without `partitionBy` pulls the whole table into one task.  A rank is a
position instead:

1. rows are dealt by range of the sort order, so Spark's own sampling cuts even
   ranges whatever the keys look like, sorted inside their range and written with
   their position there (`monotonically_increasing_id` is range and position);
2. rows per range are counted (one row per range) and summed up to each range's
   offset;
3. `rank = offset + position`, an expression on the written rows.

So the rows are shuffled once, sorted once and written once; no window runs, and
a later read of the rank repeats none of it.  For a rank inside keys the sorted
rows are counted from the last change of the key; a key that a range boundary cuts
goes on from the ranges before, and there are fewer of these than ranges.

A cut (sample size, split sizes) needs no rank.  A small sample is a bottom-k
summary: each task keeps its n rows with the least md5 keys, and these are merged
in a tree, so the pool is evaluated once.  For large samples and splits, rows are
counted by the leading hex digits of their md5 key; the counts (at most
`16 ** BUCKET_HEX` rows) tell which bucket holds the cut, and a bucket of more than
`CUT_ROWS` rows is counted again by its next digits.  Only the last bucket's rows
are numbered, all others are decided by a literal comparison where they lie.

A null key sorts first and counts as the empty text in md5 order.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadline.session import materialize

BUCKET_HEX = 4                  # 65,536 buckets of the md5 order, a round
CUT_ROWS = 100_000              # rows of the last bucket, which one task sorts
SUMMARY_ROWS = 10_000           # samples up to this size are kept in tasks
FAN_IN = 16
POSITION_BITS = 33              # of monotonically_increasing_id


def md5_key(seed, key: str | Column) -> Column:
    """Sort key shared with the SQL oracle: md5('{seed}:{key}') as hex."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(k.cast("string"), F.lit(""))))


def ranked(df: DataFrame, order: list[Column], partition_cols: list[str] | None = None,
           rank_col: str = "rank", ranges: int | None = None) -> DataFrame:
    """Dense 1-based row numbers in `order` (within `partition_cols`)."""
    part = list(partition_cols or [])
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(c).asc() for c in part], *order]
    dealt = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    if part:
        return _ranked_in_keys(dealt, part, rank_col)
    dealt = materialize(dealt, "ranks")
    position = F.col("__at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    at = F.shiftright("__at", POSITION_BITS).cast("int")
    sizes = {r["r"]: r["n"] for r in dealt.groupBy(at.alias("r")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return dealt.withColumn(rank_col, _offset(_running(sizes), at) + position + 1).drop("__at")


def _running(sizes: dict[int, int]) -> list[int]:
    """Rows before each range, by its number."""
    return np.cumsum([0, *[sizes.get(r, 0) for r in range(max(sizes, default=0) + 1)]]).tolist()


def _offset(offsets: list[int], at: Column) -> Column:
    return F.get(F.lit(np.array(offsets, dtype=np.int64)), at)


def run_positions(batches, keys: list[str]):
    """Arrow batches of sorted rows with two columns more: the row's 0-based
    position since the key last changed, and if it is in the first run."""
    import pyarrow as pa
    import pyarrow.compute as pc
    last, length, runs = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, dtype=bool)
        for k in keys:
            c = b.column(b.schema.get_field_index(k))
            x, y = c.slice(1), c.slice(0, b.num_rows - 1)
            same = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y)))
            change[1:] |= ~same.to_numpy(zero_copy_only=False)
        ends = [[b.column(b.schema.get_field_index(k))[i].as_py() for k in keys] for i in (0, b.num_rows - 1)]
        change[0] = last is not None and ends[0] != last
        number = np.cumsum(change)                       # 0: goes on with the run of the batch before
        row = np.arange(b.num_rows)
        start = np.maximum.accumulate(np.where(change, row, 0))
        position = row - start + np.where(number == 0, length, 0)
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(position, pa.int64()), pa.array(number + runs == 0)],
            names=[*b.schema.names, "__in", "__lead"])
        last, length, runs = ends[1], int(position[-1]) + 1, runs + int(number[-1])


def _ranked_in_keys(dealt: DataFrame, part: list[str], rank_col: str) -> DataFrame:
    schema = T.StructType([*dealt.schema.fields, T.StructField("__in", T.LongType()), T.StructField("__lead", T.BooleanType())])
    runs = materialize(dealt.mapInArrow(lambda batches: run_positions(batches, part), schema), "ranks")
    at = F.shiftright("__at", POSITION_BITS).cast("int")
    key = F.struct(*part)
    ends = runs.groupBy(at.alias("r")).agg(                     # one row per range
        F.count(F.lit(1)).alias("n"), F.sum(F.col("__lead").cast("long")).alias("lead"),
        F.min_by(key, "__at").alias("first"), F.max_by(key, "__at").alias("last"),
        (F.max_by("__in", "__at") + 1).alias("tail")).collect()
    offsets: dict[int, int] = {}
    before = None
    for r in sorted(ends, key=lambda r: r["r"]):
        goes_on = before is not None and before["last"] == r["first"]
        offsets[r["r"]] = 0 if not goes_on else before["tail"] + (
            offsets[before["r"]] if before["lead"] == before["n"] else 0)
        before = r
    values = [offsets.get(r, 0) for r in range(max(offsets, default=0) + 1)]
    carried = F.when(F.col("__lead"), _offset(values, at)).otherwise(0)
    return runs.withColumn(rank_col, (F.col("__in") + carried + 1).cast("long")).drop("__at", "__in", "__lead")


def global_rank(df: DataFrame, key: str, seed=None, rank_col: str = "rank") -> DataFrame:
    """Global row number in md5(seed:key) order (seeded shuffle order), or
    in `key` order when no seed is given."""
    if seed is None:
        return ranked(df, [F.col(key)], rank_col=rank_col)
    return ranked(df.withColumn("__sk", md5_key(seed, key)), [F.col("__sk"), F.col(key)],
                  rank_col=rank_col).drop("__sk")


def batch_number(df: DataFrame, key: str, batch_size: int, rank_col: str = "rank",
                 group: list[str] | None = None) -> DataFrame:
    """Sequential fixed-size batches in `key` order (0-based batch id), in
    each group on its own."""
    r = ranked(df, [F.col(key)], group, rank_col)
    return r.withColumn("batch", F.floor((F.col(rank_col) - 1) / F.lit(batch_size)).cast("long"))


def within_key_rank(df: DataFrame, key: str, order: str, rank_col: str = "rank") -> DataFrame:
    """Row number of `order` inside each `key` (O1 as a column).  A hot key
    spans many ranges, so many tasks rank it."""
    return ranked(df, [F.col(order)], [key], rank_col)


def _cut_points(keyed: DataFrame, cuts) -> tuple[int, list[tuple[str, int]]]:
    """(rows, [(md5 prefix, rows before it)]): the bucket that each cut falls
    into.  `cuts` makes the cut ranks from the number of rows.  A bucket above
    CUT_ROWS is refined by its next digits."""
    def histogram(rows: DataFrame, digits: int) -> list:                   # at most 16 ** BUCKET_HEX rows
        return sorted(rows.groupBy(F.substring("__sk", 1, digits).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())

    def find(counts: list, cut: int, before: int):
        for bucket, n in counts:
            if before + n >= cut:
                return bucket, before, n
            before += n
        return None

    first = histogram(keyed, BUCKET_HEX)
    total, out = sum(n for _, n in first), []
    for cut in cuts(total):
        found, digits = find(first, cut, 0), BUCKET_HEX
        while found and found[2] > CUT_ROWS and digits < 32:
            digits = min(32, digits + BUCKET_HEX)
            found = find(histogram(keyed.where(F.col("__sk").startswith(found[0])), digits), cut, found[1])
        if found:
            out.append(found[:2])
    return total, out


def _prefix(bucket: str) -> Column:
    return F.substring("__sk", 1, len(bucket))


def _keyed(df: DataFrame, key: str, seed) -> DataFrame:
    return df.withColumn("__sk", md5_key(seed, key))


def least_rows(keyed: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the least (__sk, key): each task keeps its own n, FAN_IN of
    these are merged at a time."""
    def keep(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        held = None
        for b in batches:
            held = pa.table(b) if held is None else pa.concat_tables([held, pa.table(b)])
            order = pc.sort_indices(held, sort_keys=[("__sk", "ascending"), (key, "ascending")], null_placement="at_start")
            held = held.take(order[:n]).combine_chunks()
        if held is not None:
            yield from held.to_batches()
    out = keyed.mapInArrow(keep, keyed.schema)
    tasks = max(FAN_IN, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        out = out.repartition(tasks).mapInArrow(keep, keyed.schema)
    return out


def take_first(df: DataFrame, key: str, n: int, seed) -> DataFrame:
    """O3 core: the n rows with the smallest md5(seed:key) (exactly n, or an
    error when the pool is smaller).  Up to SUMMARY_ROWS the pool is evaluated
    once, as a bottom-k summary, and the sample written; beyond, buckets before
    the cut are taken whole where they lie and only the one with the cut is
    sorted."""
    keyed = _keyed(df, key, seed)
    if n <= SUMMARY_ROWS:
        sample = materialize(least_rows(keyed, key, n).drop("__sk"), "sample")
        total = sample.count()
        if total < n:
            raise ValueError(f"sample of {n} requested from a pool of {total}")
        return sample
    total, points = _cut_points(keyed, lambda _: [n])
    if n > total:
        raise ValueError(f"sample of {n} requested from a pool of {total}")
    (bucket, before), = points
    inside = keyed.where(_prefix(bucket) < bucket)
    cut = keyed.where(_prefix(bucket) == bucket).orderBy("__sk", key).limit(n - before)
    return inside.unionByName(cut).drop("__sk")


def split_sizes(n: int, test_size: float = 0.2) -> tuple[int, int, int]:
    """Q12: held out = ceil(test_size * n) (float product, as the reference's
    splitter computes it); validation = floor(h / 2), test = ceil(h / 2)."""
    held = math.ceil(test_size * n)
    val = held - math.ceil(0.5 * held)
    return n - held, val, held - val


def split_exact(df: DataFrame, key: str, seed=42, test_size: float = 0.2) -> DataFrame:
    """O5 exact mode: train / validation / test of the Q12 sizes, membership
    by md5(seed:key) order.  Rows outside the (at most two) buckets that hold a
    cut are labelled where they lie; only those buckets are row-numbered."""
    keyed = _keyed(df, key, seed)

    def cuts(n: int) -> list[int]:
        n_train, n_val, _ = split_sizes(n, test_size)
        return [n_train, n_train + n_val]
    total, points = _cut_points(keyed, cuts)
    if not total:
        return df.withColumn("split", F.lit(None).cast("string"))
    c1, c2 = cuts(total)
    if c1 == 0:                                             # one row: held out
        points = [(points[0][0], 0)] * 2
    (b1, before1), (b2, before2) = points
    at1, at2 = _prefix(b1), _prefix(b2)
    in_cut = (at1 == b1) | (at2 == b2)
    plain = keyed.where(~in_cut).withColumn(
        "split", F.when(at1 < b1, "train").when(at2 < b2, "validation").otherwise("test"))
    first = at1 == b1
    before = F.when(first, before1).otherwise(before2)
    rank = before + F.row_number().over(Window.partitionBy(first).orderBy("__sk", key))
    cut = keyed.where(in_cut).withColumn("__rank", rank).withColumn(
        "split", F.when(F.col("__rank") <= c1, "train").when(F.col("__rank") <= c2, "validation")
        .otherwise("test")).drop("__rank")
    return plain.unionByName(cut).drop("__sk")


def split_hash(df: DataFrame, key: str, seed=42, train: int = 80, validation: int = 10) -> DataFrame:
    """O5 hash mode: no count, no ranking -- a pure per-row function of
    md5(seed:key); proportions are met in expectation."""
    pct = F.conv(F.substring(md5_key(seed, key), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("split", F.when(pct < train, "train")
                         .when(pct < train + validation, "validation").otherwise("test"))


def shuffle_order(df: DataFrame, key: str, seed=42, epoch: int = 0, rank_col: str = "shuffle_rank") -> DataFrame:
    """A reproducible random order (per epoch) as a rank column."""
    return global_rank(df, key, seed=f"{seed}:{epoch}", rank_col=rank_col)


def preview_last(df: DataFrame, order: str, n: int = 10) -> DataFrame:
    """O2: the last n rows in `order` (top-k: per-partition top n, then merge)."""
    return df.orderBy(F.col(order).desc()).limit(n)
