"""Operator 7: exact top-k search by distributed histogram selection.

Every component becomes floor(1024 * x); the score is the integer inner
product.  All rows are scored against the stated query set, in blocks.  Candidates
lie in blocks of about `PACKET` bytes that are dealt to salts by their number;
queries lie in groups of at most `GROUP` rows and `GROUP_BYTES` bytes.  A query goes
to every salt and a candidate block to every group, each as a row of its own: the
rows of a salt and group meet in one task, which holds the queries and lets the
candidates pass, `CANDIDATE_BLOCK` by `QUERY_BLOCK` scores at a time.  No row holds
a pair, and nothing is broadcast but what Spark finds small by its size.

Selection, round by round: each task scores its blocks and counts scores per
(query, bin) of the query's current range.  It counts only its own k best
scores, since the global k-th value can't lie lower than their least: at most k
rows per query and task.  Spark sums the histograms, walks them from the top
and narrows every query's range to the bin that holds its k-th value, until
bins are one value wide.  A last pass keeps the scores that reach the k-th
value; ties go to the smaller vec_id, and a task reports at most k rows a query.

Scores are 64-bit integers.  Before anything is scored, the largest |score| that
the vectors allow (the squared length of the longest, by Cauchy-Schwarz) is
held against 2^62; vectors too long for it raise an OverflowError, and nothing is
left out or wrapped.

A vector that is null or has a null or non-finite component takes no part; nor
has a row with a null vec_id.  Vectors of unlike length don't meet.  Repeated
rows (same vec_id) stay separate candidates, but a query is not its own
candidate under any copy; a query id that occurs twice is asked once, with the
smallest vector.  Fewer than k candidates: all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadline.llm.common import materialize, partitions, table

K = 10
EVERY = 100
SCALE = 1024
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
CELLS = 1 << 22                  # numbers of a matrix to multiply, where vectors are long
PACKET = 4096                    # bytes of a row of candidates; Spark hands a task 10,000 rows at once
GROUP, GROUP_BYTES = 32_768, 32 << 20
BINS = 4096
NONE = np.iinfo(np.int64).min    # below every score


def valid_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): integer vectors that may take part."""
    x = F.col(vec_col).cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    # a component that no long holds stands as the largest one, which no score fits either
    limit = 2.0 ** 62
    whole = lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-limit)), F.lit(limit)))
    return (rows.select(F.col(id_col).alias("vec_id"), vec_col)
            .where(F.col("vec_id").isNotNull() & F.col(vec_col).isNotNull() & good)
            .select("vec_id", F.transform(x, whole).alias("v")))


def score_bound(candidates: DataFrame) -> float:
    """A bound of |score|: the longest vector's squared length (with room for the
    rounding of this sum).  Raises where it doesn't fit 62 bits."""
    most = candidates.agg(F.max("square").alias("m")).first().m or 0.0
    if most >= 2.0 ** 62:
        raise OverflowError(f"vectors of squared length {most:.3g}: inner products don't fit 64-bit integers")
    return most * 1.000001 + 1


def narrowest(m: np.ndarray) -> np.ndarray:
    """The same whole numbers in 2, 4 or 8 bytes."""
    lo, hi = int(m.min(initial=0)), int(m.max(initial=0))
    kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max)
    return m.astype(kind)


def squares(m: np.ndarray) -> np.ndarray:
    """Squared lengths, rounded."""
    x = m.astype(np.float64)
    return np.einsum("ij,ij->i", x, x)


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """One row per block of at most `size` vectors of one dimension and about
    `PACKET` bytes: (block, first_id, dim, square, ids, matrix), square = the largest
    squared length."""
    packet = PACKET

    def fn(batches):
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            col = b.column(1)
            dims = col.value_lengths().to_numpy(zero_copy_only=False)
            flat = col.flatten().to_numpy(zero_copy_only=False)
            start = np.cumsum(dims) - dims
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                m = narrowest(flat[start[at][:, None] + np.arange(d)])
                step = max(1, min(size, packet // max(1, int(d) * m.itemsize)))
                cuts = range(0, len(at), step)
                square = np.maximum.reduceat(squares(m), np.array(cuts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(number, number + len(cuts))), pa.array(ids[at][::step]),
                     pa.array(np.full(len(cuts), d, np.int32)), pa.array(square),
                     pa.array([ids[at[lo:lo + step]].tobytes() for lo in cuts], pa.binary()),
                     pa.array([m[lo:lo + step].tobytes() for lo in cuts], pa.binary())],
                    names=["block", "first_id", "dim", "square", "ids", "matrix"])
                number += len(cuts)
    return vectors.mapInArrow(fn, "block long, first_id long, dim int, square double, ids binary, matrix binary")


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, bytes) of a binary column."""
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    ends = np.frombuffer(col.buffers()[1], kind)[col.offset:col.offset + len(col) + 1]
    held = col.buffers()[2]
    return np.diff(ends), np.frombuffer(held, np.uint8)[ends[0]:ends[-1]] if held else np.zeros(0, np.uint8)


def unpacked(ids: pa.Array, matrices: pa.Array, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of each stretch of blocks whose numbers have one width."""
    (sizes, i), (spans, m) = bytes_of(ids), bytes_of(matrices)
    width = spans // (sizes // 8)                              # bytes of a vector
    cuts = [0, *(np.flatnonzero(np.diff(width)) + 1), len(width)]
    at, n = np.append(0, np.cumsum(spans)), np.append(0, np.cumsum(sizes))
    for lo, hi in zip(cuts, cuts[1:]):
        part = i[n[lo]:n[hi]].view(np.int64)
        kind = f"i{width[lo] // dim}" if dim else np.int16
        yield part, m[at[lo]:at[hi]].view(kind).reshape(len(part), dim)


def entries(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of what is marked, row by row."""
    return np.divmod(np.flatnonzero(marked), marked.shape[1])


def longest(m: np.ndarray) -> float:
    """A bound of the vectors' lengths."""
    return float(np.sqrt(squares(m).max(initial=0))) * 1.000001


class Room:
    """Arrays that are written again and again: fresh memory costs more than the sums."""

    def __init__(self):
        self.kept: dict = {}

    def __call__(self, shape: tuple, kind) -> np.ndarray:
        n, kind = shape[0] * shape[1], np.dtype(kind)
        if kind not in self.kept or len(self.kept[kind]) < n:
            self.kept[kind] = np.empty(n, kind)
        return self.kept[kind][:n].reshape(shape)


def products(q: np.ndarray, c: np.ndarray, big: float, room: Room) -> np.ndarray:
    """Exact integer inner products, as floats only where these are exact: every
    sum of some of the terms is at most `big`, the product of the lengths."""
    kind = np.float32 if big < 2 ** 24 else np.float64 if big < 2 ** 53 else np.int64
    return np.matmul(q.astype(kind), c.astype(kind).T, out=room((len(q), len(c)), kind))


def whole(s: np.ndarray) -> np.ndarray:
    """Scores as integers."""
    return s if s.dtype == np.int64 else np.where(np.isfinite(s), s, np.nan_to_num(s, neginf=NONE)).astype(np.int64)


class Asked:
    """The queries of a salt, group and dimension, by id."""

    def __init__(self, parts: list[tuple]):
        ids, mats, lo, width = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(ids)
        self.ids, self.matrix, self.lo, self.width = ids[order], mats[order], lo[order], width[order]
        self.room, self.length = Room(), longest(mats)

    def scored(self, ids: np.ndarray, matrix: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(from, to, scores) for a block of queries at a time; a query's own copies
        score below every range."""
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        own = np.flatnonzero(self.ids[at] == ids)
        big = self.length * longest(matrix)
        for lo in range(0, len(self.ids), size):
            hi = min(lo + size, len(self.ids))
            s = products(self.matrix[lo:hi], matrix, big, self.room)
            mine = own[(at[own] >= lo) & (at[own] < hi)]
            s[at[mine] - lo, mine] = NONE if s.dtype == np.int64 else -np.inf
            yield lo, hi, s


class Histogram:
    """Scores per bin among each query's k best of the task, from its range up;
    bin `bins` = above the range."""

    def __init__(self, asked: Asked, k: int, bins: int):
        self.asked, self.k, self.bins = asked, k, bins
        self.held = np.repeat((asked.lo - 1)[:, None], k, axis=1)      # below the range: no score yet
        self.least = asked.lo - 1

    def add(self, lo: int, hi: int, s: np.ndarray, ids: np.ndarray) -> None:
        k, held = self.k, self.held[lo:hi]
        # a bound that s's type doesn't hold lies beyond all scores of s, also when rounded
        over = np.greater(s, self.least[lo:hi, None].astype(s.dtype), out=self.asked.room(s.shape, bool))
        n = np.count_nonzero(over)
        if not n:
            return
        if n > over.size // 32:
            rows = np.arange(hi - lo)
            new = whole(np.partition(s, -k, axis=1)[:, -k:] if s.shape[1] > k else s)
        else:
            r, c = entries(over)
            rows, first, count = np.unique(r, return_index=True, return_counts=True)
            new = np.full((len(rows), count.max()), NONE)
            new[np.repeat(np.arange(len(rows)), count), np.arange(n) - np.repeat(first, count)] = whole(s[r, c])
        held[rows] = np.partition(np.concatenate([held[rows], new], axis=1), -k, axis=1)[:, -k:]
        self.least[lo + rows] = held[rows].min(axis=1)

    def found(self) -> list[np.ndarray]:
        lo, width = self.asked.lo, self.asked.width
        r, c = entries(self.held >= lo[:, None])
        at = np.minimum((self.held[r, c] - lo[r]) // width[r], self.bins)
        key, n = np.unique(r * (self.bins + 1) + at, return_counts=True)
        return [self.asked.ids[key // (self.bins + 1)], key % (self.bins + 1), n.astype(np.int64)]


class Best:
    """Each query's k best rows of the task among those that reach its k-th value."""

    def __init__(self, asked: Asked, k: int):
        self.asked, self.k, self.pending = asked, k, 0
        self.rows = [(np.zeros(0, np.int64),) * 3]

    def add(self, lo: int, hi: int, s: np.ndarray, ids: np.ndarray) -> None:
        least = self.asked.lo[lo:hi, None].astype(s.dtype)
        reach = np.greater_equal(s, least, out=self.asked.room(s.shape, bool))
        many = np.flatnonzero(np.count_nonzero(reach, axis=1) > 8 * self.k)
        if len(many):                              # of equal scores the smaller ids, which come first
            tie = s[many] == least[many]
            reach[many] &= ~tie | (np.cumsum(tie, axis=1, dtype=np.int32) <= self.k)
        r, c = entries(reach)
        self.rows.append((r + lo, whole(s[r, c]), ids[c]))
        self.pending += len(r)
        if self.pending > CELLS // 4:
            self.merge()

    def merge(self) -> None:
        rows = q, v, i = [np.concatenate(x) for x in zip(*self.rows)]
        order = np.lexsort((i, -v, q))
        q = q[order]
        order = order[np.arange(len(q)) - np.searchsorted(q, q) < self.k]
        self.rows, self.pending = [(rows[0][order], rows[1][order], rows[2][order])], 0

    def found(self) -> list[np.ndarray]:
        self.merge()
        q, v, i = self.rows[0]
        return [self.asked.ids[q], i, v]


def runs(batches) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """((salt, grp, dim), asks, rows): stretches of a task's sorted rows."""
    for b in batches:
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
        cuts = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
            if lo < hi:
                yield tuple(keys[:3, lo].tolist()), int(keys[3, lo]), b.slice(lo, hi - lo)


def meet(rows: DataFrame, fold, schema: str) -> DataFrame:
    """What `fold` (Histogram or Best) finds for the queries of each salt, group and dimension."""
    sizes = QUERY_BLOCK, CANDIDATE_BLOCK
    names = [c.split()[0] for c in schema.split(", ")]

    def fn(batches):
        for (_, _, dim), parts in groupby(runs(batches), key=lambda r: r[0]):
            at_once, limit = (max(1, min(size, CELLS // max(1, dim))) for size in sizes)
            asking, asked, state, held, n = [], None, None, [], 0

            def score():
                ids, m = (np.concatenate(x) for x in zip(*held))
                order = np.argsort(ids)
                for lo in range(0, n, limit):
                    part = order[lo:lo + limit]
                    for found in asked.scored(ids[part], m[part], at_once):
                        state.add(*found, ids[part])
                held.clear()
            for _, asks, b in parts:
                if asks == 0:
                    ids, mats = (np.concatenate(x) for x in zip(*unpacked(b.column(4), b.column(5), dim)))
                    asking.append((ids, mats, b.column(6).to_numpy(), b.column(7).to_numpy()))
                elif asking:
                    if state is None:
                        asked = Asked(asking)
                        state = fold(asked)
                    for ids, m in unpacked(b.column(4), b.column(5), dim):
                        held.append((ids, m))
                        n += len(ids)
                        if n >= limit:
                            score()
                            n = 0
            if n:
                score()
            if state is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in state.found()], names=names)
    return rows.mapInArrow(fn, schema)


def histogram(rows: DataFrame, k: int, bins: int) -> DataFrame:
    """(query_id, bin, n) with n = scores in the bin; bin `bins` = above the range."""
    return (meet(rows, lambda asked: Histogram(asked, k, bins), "query_id long, bin long, n long")
            .groupBy("query_id", "bin").agg(F.sum("n").alias("n")))


def best(rows: DataFrame, k: int) -> DataFrame:
    """Each task's k best rows of a query among those that reach its k-th value."""
    return meet(rows, lambda asked: Best(asked, k), "query_id long, vec_id long, score long")


def narrow(ranges: DataFrame, hist: DataFrame, k: int, bins: int) -> DataFrame:
    """The range of each query after a round: the bin with its k-th value, or,
    with fewer than k candidates, the whole range down to the lowest bin."""
    w = Window.partitionBy("query_id").orderBy(F.col("bin").desc())
    walked = (hist.withColumn("above", F.sum("n").over(w) - F.col("n"))
              .where(F.col("above") < k).groupBy("query_id").agg(F.min("bin").alias("bin")))
    lo, width = F.col("lo"), F.col("width")
    return (ranges.join(walked, "query_id", "left")
            .select("query_id", "dim",
                    F.when(F.col("bin").isNull(), lo).otherwise(lo + F.col("bin") * width).alias("lo"),
                    F.greatest(F.lit(1), F.ceil(width / bins)).cast("long").alias("width")))


def ask(queries: DataFrame, ranges: DataFrame, candidates: DataFrame, salts: int, groups: int) -> DataFrame:
    """(salt, grp, dim, asks, ids, matrix, lo, width): queries with their current
    ranges (asks 0) for every salt, candidate blocks (asks 1) for every group; what
    shares a salt and group lies in one task, by dimension, queries first."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = (queries.join(ranges.drop("dim"), "query_id")
         .select(every(salts).alias("salt"), F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("grp"),
                 "dim", F.lit(0).alias("asks"), "ids", "matrix", "lo", "width"))
    c = candidates.select(F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), every(groups).alias("grp"),
                          "dim", F.lit(1).alias("asks"), "ids", "matrix",
                          F.lit(0).cast("long").alias("lo"), F.lit(1).cast("long").alias("width"))
    tasks = min(salts * groups, partitions(queries.sparkSession))
    return (q.union(c).repartition(tasks, "salt", "grp").sortWithinPartitions("salt", "grp", "dim", "asks"))


def spread_over(parts: int, candidates: DataFrame, queries: DataFrame) -> tuple[int, int]:
    """(salts, groups): as many salts as there are tasks, but not so many that
    the queries' copies outnumber those of the candidates."""
    vectors = lambda: F.coalesce(F.sum(F.octet_length("ids") / 8), F.lit(0)).cast("long").alias("n")
    n = candidates.agg(vectors()).first().n
    q = queries.agg(vectors(), F.coalesce(F.sum(F.octet_length("matrix")), F.lit(0)).alias("size")).first()
    groups = max(1, -(-q.n // GROUP), -(-q.size // GROUP_BYTES))
    return max(1, min(parts, max(16, groups * n // max(1, q.n)), -(-n // 256))), groups


def top_k(vectors: DataFrame, query_ids, k: int = K, bins: int = BINS) -> DataFrame:
    """query_id, rank, vec_id, score; `query_ids` is a condition on vec_id."""
    candidates = materialize(blocks(vectors, CANDIDATE_BLOCK).drop("first_id"), "op7-candidates")
    most = score_bound(candidates)
    asked = vectors.where(query_ids).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = materialize(blocks(asked, 1).drop("block", "square").withColumnRenamed("first_id", "query_id"), "op7-queries")
    over = spread_over(partitions(vectors.sparkSession), candidates, queries)
    bound = F.lit(int(most)).cast("long")
    ranges = queries.select("query_id", "dim", (-bound).alias("lo"),
                            F.ceil((2 * bound + 1) / bins).cast("long").alias("width"))
    span = ranges.agg(F.max("width").alias("w")).first()
    width = (span.w if span else 1) or 1
    while True:
        ranges = materialize(narrow(ranges, histogram(ask(queries, ranges, candidates, *over), k, bins), k, bins),
                             "op7-ranges")
        if width <= 1:
            break
        width = max(1, -(-width // bins))
    final = best(ask(queries, ranges, candidates, *over), k)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (final.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(valid_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % EVERY == 0)


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= {K}
"""
