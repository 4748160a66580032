"""Joint mini-batch training of all target heads.

The reference trains one classifier per target: epochs over shuffled batches of
32, the gradient's norm cut at 1, a step size that falls linearly to 0, and the
average loss of an epoch's batches.  Here all heads read the same rows, so one
pass an epoch trains them all:

1. O6: an epoch's order is that of md5(seed:epoch:key).  It is cut into shards of
   about `shard_rows` consecutive rows by the leading digits of the md5, which are
   even; the cut depends on nothing but the keys, so a lost task is repeated as it
   was.  This is the one shuffle of an epoch (ids and labels, no text).
2. A task takes a shard's batches in order, all heads at once: softmax regression
   on counts of the token ids, AdaGrad steps.  It starts from the epoch's weights,
   a broadcast of `width` x classes numbers whatever the corpus.
3. The shards' changes, weighted by their rows, are summed feature by feature:
   partial sums in each task, then one row per feature met.  Their mean is the
   next epoch's start (local steps, averaged once an epoch).  Up to `shard_rows`
   rows there is one shard, and training is that of the reference: batch after
   batch over all rows.

A row without a label for a head counts nothing there.  Rows that repeat a key stay
side by side.  Without rows, or without labels for a head, weights stay 0 and the
head's loss is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.operators.ranking import md5_key
from threadline.operators.tokens import give_back

EPOCHS, BATCH = 4, 32            # as the reference trains
CLIP = 1.0
RATE = 0.5
TINY = 1e-8
WIDTH = 1 << 16
SHARD_ROWS = 1 << 15
SENT = 1 << 12                   # features whose changes a task sends at a time


@dataclass
class JointModel:
    """Weights (width + 1, classes): one column block per head, the last row its
    bias.  losses: (target, epoch, average loss of its batches)."""
    targets: list[str]
    classes: list[int]
    width: int
    weights: np.ndarray
    squares: np.ndarray
    losses: list[tuple[str, int, float | None]] = field(default_factory=list)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum([0, *self.classes])[:-1]


def class_counts(df: DataFrame, targets: list[str]) -> tuple[int, list[int]]:
    """(rows, classes per target): labels are 0 .. classes - 1; one pass."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.max(F.col(t).cast("int")).alias(t) for t in targets]).first()
    return row["n"], [1 + max(row[t] or 0, 0) for t in targets]


def design(ids: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(features met, counts): a row per text, a column per feature met.  Padding
    (id 0) is no feature; the last feature is the bias."""
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    flat = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
    at = np.repeat(np.arange(len(ids)), sizes)[flat > 0]
    met, column = np.unique(flat[flat > 0] % width, return_inverse=True)
    x = np.bincount(at * len(met) + column, minlength=len(ids) * len(met)).reshape(len(ids), len(met))
    return np.append(met, width), np.hstack([x, np.ones((len(ids), 1))]).astype(np.float64)


def probabilities(z: np.ndarray, starts: np.ndarray, classes: list[int]) -> np.ndarray:
    """Softmax of each head's block."""
    e = np.exp(z - np.repeat(np.maximum.reduceat(z, starts, axis=1), classes, axis=1))
    return e / np.repeat(np.add.reduceat(e, starts, axis=1), classes, axis=1)


def step(weights: np.ndarray, squares: np.ndarray, ids: list[np.ndarray], labels: np.ndarray, starts: np.ndarray,
         classes: list[int], width: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One batch in place: (features met, loss per head, heads that have labels).
    labels: rows x heads, -1 where there is none."""
    met, x = design(ids, width)
    p = probabilities(x @ weights[met], starts, classes)
    row, head = np.nonzero(labels >= 0)
    known = np.bincount(head, minlength=len(classes))
    at = starts[head] + labels[row, head]
    loss = np.bincount(head, -np.log(np.maximum(p[row, at], 1e-300)), minlength=len(classes))
    p[row, at] -= 1
    share = np.where(labels >= 0, 1 / np.maximum(known, 1), 0.0)
    g = x.T @ (p * np.repeat(share, classes, axis=1))
    norm = np.sqrt(np.add.reduceat((g * g).sum(axis=0), starts))
    g *= np.repeat(np.minimum(1.0, CLIP / np.maximum(norm, TINY)), classes)
    squares[met] += g * g
    weights[met] -= rate * g / (np.sqrt(squares[met]) + TINY)
    return met, loss / np.maximum(known, 1), known > 0


def train_shard(model: JointModel, flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, epoch: int, epochs: int,
                batch_size: int, rate: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A shard's batches in order, from the model's weights: (features met, change of
    weights, change of squares), some features at a time; feature -1 has the loss
    sums and the numbers of batches with labels.  flat, sizes: the rows' ids.

    Only the features met are copied: numbered in order from 1, the bias last."""
    met = np.unique(flat[flat > 0] % model.width)
    at = np.append(met, model.width)
    weights, squares = (np.concatenate([x[:1], x[at]]) for x in (model.weights, model.squares))
    place = np.where(flat > 0, np.searchsorted(met, flat % model.width) + 1, 0).astype(np.int32)
    ids = np.split(place, np.cumsum(sizes)[:-1])
    starts, rows = model.starts, len(sizes)
    losses, counted = np.zeros(len(model.classes)), np.zeros(len(model.classes))
    batches = -(-rows // batch_size)
    for i in range(batches):
        part = slice(i * batch_size, (i + 1) * batch_size)
        falling = rate * (1 - (epoch * batches + i) / (epochs * batches))
        _, loss, known = step(weights, squares, ids[part], labels[part], starts, model.classes, len(at), falling)
        losses += np.where(known, loss, 0)
        counted += known
    for lo in range(0, len(at), SENT):
        own = at[lo:lo + SENT]
        yield own, weights[1 + lo:1 + lo + SENT] - model.weights[own], squares[1 + lo:1 + lo + SENT] - model.squares[own]
    yield np.array([-1]), losses[None, :], counted[None, :]


def epoch_order(rows: DataFrame, key: str, seed, epoch: int, shards: int) -> DataFrame:
    """O6 by shards: (shard, order, key, ids, labels) sorted within tasks."""
    order = md5_key(f"{seed}:{epoch}", key)
    place = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    dealt = rows.withColumn("order", order).withColumn("shard", F.shiftright(place * shards, 32).cast("int"))
    tasks = min(shards, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(tasks, "shard").sortWithinPartitions("shard", "order", key) \
        .select("shard", "ids", "labels")


def shard_changes(ordered: DataFrame, shared, epoch: int, epochs: int, batch_size: int, rate: float) -> DataFrame:
    """(feature, w, g): a shard's changes times its rows; feature -1 holds its
    loss sums and batch counts.  A worker holds a shard's ids and labels as arrays
    and sends some features at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def lists(x: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    def fn(batches):
        model, now, parts = shared.value, None, []

        def send():
            flat, sizes, labels = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            for feature, w, g in train_shard(model, flat, sizes, labels, epoch, epochs, batch_size, rate):
                if feature[0] >= 0:
                    w, g = w * len(sizes), g * len(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(feature, pa.int32()), lists(w), lists(g)],
                                                 names=["feature", "w", "g"])
            del flat, sizes, labels
            give_back()
        for b in batches:
            shard = b.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(shard)]):
                if lo == hi:
                    continue
                if shard[lo] != now:
                    if parts:
                        yield from send()
                    now = shard[lo]
                ids, labels = b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo)
                parts.append((ids.flatten().to_numpy(zero_copy_only=False).copy(),
                              pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False),
                              pc.fill_null(labels.flatten(), -1).to_numpy(zero_copy_only=False).reshape(hi - lo, -1).astype(np.int16)))
        if parts:
            yield from send()
    return ordered.mapInArrow(fn, "feature int, w array<double>, g array<double>")


def train_joint(df: DataFrame, targets, key: str = "row_key", ids_col: str = "padded", epochs: int = EPOCHS,
                batch_size: int = BATCH, seed=42, rate: float = RATE, width: int = WIDTH,
                shard_rows: int = SHARD_ROWS, classes: list[int] | None = None) -> JointModel:
    """M1: all heads in one pass over the rows an epoch.  `classes` may be given
    (A10 counts them over all splits); labels are 0 .. classes - 1."""
    targets = list(targets)
    n, found = class_counts(df, targets)
    classes = classes or found
    total = sum(classes)
    model = JointModel(targets, classes, width, np.zeros((width + 1, total)), np.zeros((width + 1, total)))
    rows = df.select(key, F.col(ids_col).alias("ids"), F.array(*[F.col(t).cast("int") for t in targets]).alias("labels"))
    shards = max(1, -(-n // shard_rows))
    columns = [f"{c}{i}" for c in "wg" for i in range(total)]
    sums = [F.sum(F.get(c[0], F.lit(int(c[1:])))).alias(c) for c in columns]
    for epoch in range(epochs):
        shared = df.sparkSession.sparkContext.broadcast(model)
        changes = shard_changes(epoch_order(rows, key, seed, epoch, shards), shared, epoch, epochs, batch_size, rate)
        got = changes.groupBy("feature").agg(*sums).toArrow()      # at most width + 2 rows
        shared.destroy()
        feature = got.column("feature").to_numpy()
        values = np.stack([got.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1)
        weight, at = values[feature >= 0], feature[feature >= 0]
        weights, squares = model.weights.copy(), model.squares.copy()
        if n:
            weights[at] += weight[:, :total] / n
            squares[at] += weight[:, total:] / n
        loss = values[feature < 0].reshape(-1)
        losses = [(t, epoch, float(loss[i] / loss[total + i]) if len(loss) and loss[total + i] else None)
                  for i, t in enumerate(targets)]
        model = JointModel(targets, classes, width, weights, squares, model.losses + losses)
    return model


def score_joint(df: DataFrame, model: JointModel, keys: list[str], ids_col: str = "padded") -> DataFrame:
    """M2: (keys, target, scores, pred) for every row and target, in one pass;
    pred is the first maximum of the class scores (R3)."""
    import pyarrow as pa
    shared = df.sparkSession.sparkContext.broadcast(replace(model, squares=model.squares[:0]))
    src = df.select(*keys, F.col(ids_col).alias("__ids"))
    rows_at_once = 64                                    # a dense block of 64 x features met

    def fn(batches):
        m = shared.value
        starts, heads = m.starts, len(m.targets)
        for whole in batches:
            for lo in range(0, whole.num_rows, rows_at_once):
                b = whole.slice(lo, rows_at_once)
                met, x = design([np.array(i or [], dtype=np.int64) for i in b.column(len(keys)).to_pylist()], m.width)
                p = probabilities(x @ m.weights[met], starts, m.classes)
                scores = [p[:, s:s + c] for s, c in zip(starts, m.classes)]
                at = pa.array(np.repeat(np.arange(b.num_rows), heads))
                yield pa.RecordBatch.from_arrays(
                    [b.column(i).take(at) for i in range(len(keys))]
                    + [pa.array(m.targets * b.num_rows, pa.string()),
                       pa.array([s[r] for r in range(b.num_rows) for s in scores], pa.list_(pa.float64())),
                       pa.array(np.stack([s.argmax(axis=1) for s in scores], axis=1).ravel(), pa.int32())],
                    names=[*keys, "target", "scores", "pred"])
            give_back()
    kinds = dict(src.dtypes)
    return src.mapInArrow(fn, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", target string, scores array<double>, pred int")
