"""Joint training of all heads (M1, M2, A15) and evaluation."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadline.operators import labels as L
from threadline.operators import models as M
from threadline.operators import trainer as TR


@pytest.fixture(scope="module")
def run(spark):
    rows = [(f"r{i:03d}", [2, 4 + i % 3, 7 + i % 2, 3, 0], i % 3, i % 2) for i in range(90)]
    feats = spark.createDataFrame(rows, "row_key string, padded array<int>, a int, b int").cache()
    model = TR.train_joint(feats, ["a", "b"], epochs=10, batch_size=8, width=64)
    yield feats, model, TR.score_joint(feats, model, ["row_key"])
    feats.unpersist()


def test_every_row_and_target_is_scored(run):
    feats, _, scored = run
    got = {(r.row_key, r.target): r for r in scored.collect()}
    assert len(got) == 180 and all(abs(sum(r.scores) - 1) < 1e-9 for r in got.values())
    assert all(r.pred == int(r.row_key[1:]) % (3 if r.target == "a" else 2) for r in got.values())


def test_losses_fall_and_are_per_epoch(run):
    for t in ("a", "b"):
        v = [x for name, _, x in run[1].losses if name == t]
        assert len(v) == 10 and v[-1] < v[0] / 4


def plain_training(rows, targets, classes, epochs, batch, rate, width, shard_rows, seed):
    """The same job for one head after another, dense, row by row."""
    n = len(rows)
    shards = max(1, -(-n // shard_rows))
    out, losses = {}, {}
    for t, c in zip(targets, classes):
        w, g2 = np.zeros((width + 1, c)), np.zeros((width + 1, c))
        for epoch in range(epochs):
            dealt = [[] for _ in range(shards)]
            for r in rows:
                h = hashlib.md5(f"{seed}:{epoch}:{r['row_key']}".encode()).hexdigest()
                dealt[int(h[:8], 16) * shards >> 32].append((h, r["row_key"], r))
            dw, dg, total, count = np.zeros_like(w), np.zeros_like(w), 0.0, 0
            for part in dealt:
                part = [r for _, _, r in sorted(part, key=lambda x: x[:2])]
                sw, sg = w.copy(), g2.copy()
                batches = -(-len(part) // batch)
                for i in range(batches):
                    grad, loss, known = np.zeros_like(w), 0.0, 0
                    for r in part[i * batch:(i + 1) * batch]:
                        if r[t] is None:
                            continue
                        x = np.zeros(width + 1)
                        for f in r["padded"]:
                            if f > 0:
                                x[f % width] += 1
                        x[width] = 1
                        z = np.exp(x @ sw - (x @ sw).max())
                        p = z / z.sum()
                        loss -= np.log(p[r[t]])
                        p[r[t]] -= 1
                        grad += np.outer(x, p)
                        known += 1
                    if not known:
                        continue
                    total, count = total + loss / known, count + 1
                    grad /= known
                    grad *= min(1.0, TR.CLIP / max(np.sqrt((grad ** 2).sum()), TR.TINY))
                    sg += grad ** 2
                    step = rate * (1 - (epoch * batches + i) / (epochs * batches))
                    sw -= np.where(grad != 0, step * grad / (np.sqrt(sg) + TR.TINY), 0)
                dw += (sw - w) * len(part) / n
                dg += (sg - g2) * len(part) / n
            w, g2 = w + dw, g2 + dg
            losses[t, epoch] = total / count if count else None
        out[t] = w
    return out, losses


@pytest.mark.parametrize("shard_rows", [TR.SHARD_ROWS, 40])
def test_weights_equal_a_plain_run(spark, shard_rows):
    """On the training inputs of the smallest tables, by one shard and by many."""
    from threadline.plans.q_models import training_inputs
    targets = ["opinion", "sentiment", "policies"]
    rows = training_inputs(spark, "/root/testdata/sf0.001")[0].where("split = 'train'").select("row_key", "padded", *targets)
    rows = rows.withColumn("opinion", F.when(F.crc32("row_key") % 5 != 0, F.col("opinion")))
    _, classes = TR.class_counts(rows, targets)
    model = TR.train_joint(rows, targets, epochs=2, width=512, shard_rows=shard_rows, seed=7)
    want, losses = plain_training([r.asDict() for r in rows.collect()], targets, classes, 2, TR.BATCH, TR.RATE, 512, shard_rows, 7)
    for t, s, c in zip(targets, model.starts, classes):
        assert np.allclose(model.weights[:, s:s + c], want[t], rtol=1e-8, atol=1e-10)
    got = {(t, e): x for t, e, x in model.losses}
    assert got.keys() == losses.keys() and all(abs(got[k] - losses[k]) < 1e-9 for k in losses)


def test_rows_are_read_once_an_epoch(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    rows = spark.createDataFrame([(f"r{i}", [4 + i % 5], i % 2) for i in range(200)], "row_key string, padded array<int>, a int")
    TR.train_joint(rows.mapInArrow(count, rows.schema), ["a"], epochs=3, width=16, shard_rows=50)
    assert seen.value == 200 * (3 + 1)          # and once for the number of rows and classes


def test_no_rows_and_no_labels(spark):
    schema = "row_key string, padded array<int>, a int, b int"
    empty = TR.train_joint(spark.createDataFrame([], schema), ["a", "b"], epochs=2, width=8)
    assert not empty.weights.any() and [x for _, _, x in empty.losses] == [None] * 4
    rows = spark.createDataFrame([("x", [4, 0], 1, None), ("y", None, 0, None), (None, [], 1, None)], schema)
    model = TR.train_joint(rows, ["a", "b"], epochs=2, width=8)
    assert [x is None for _, _, x in model.losses] == [False, True] * 2
    assert TR.score_joint(rows, model, ["row_key"]).count() == 6


def test_report_recomputed_from_stored_predictions(spark, run):
    feats, _, scored = run
    wrong = scored.withColumn("pred", F.when(F.col("row_key") < "r010", F.lit(0)).otherwise(F.col("pred")))
    lm = spark.createDataFrame([("a", -1, 2)], "target string, original_label int, encoded_label int")
    report = {(r.target, r.label): r for r in M.evaluate(M.paired(wrong, feats, "row_key", ["a", "b"]), "row_key", lm).collect()}
    truth = [(i % 3, 0 if i < 10 else i % 3) for i in range(90)]
    for label, name in ((0, "0"), (1, "1"), (2, "-1")):
        tp = sum(t == p == label for t, p in truth)
        r = report["a", name]
        assert r.support == 30 and abs(r.precision - tp / sum(p == label for _, p in truth)) < 1e-12
        assert abs(r.recall - tp / 30) < 1e-12

    def f1(batch):
        total = 0
        for c in {x for pair in batch for x in pair}:
            n_pred, n_truth = sum(p == c for _, p in batch), sum(t == c for t, _ in batch)
            total += n_pred * 2 * sum(t == p == c for t, p in batch) / (n_pred + n_truth)
        return total / len(batch)
    batches = [truth[i:i + 32] for i in range(0, 90, 32)]
    r = report["a", "mean batch f1"]
    assert r.support == 3 and abs(r.f1 - sum(map(f1, batches)) / 3) < 1e-12


def test_every_training_query_trains(spark, monkeypatch):
    from threadline.plans import q_models
    calls, train = [], TR.train_joint
    monkeypatch.setattr(TR, "train_joint", lambda *a, **k: calls.append(1) or train(*a, **k))
    for query in (q_models.q_loss_history, q_models.q_prediction_support, q_models.q_loss_history):
        assert query(spark, "/root/testdata/sf0.001").count()
    assert len(calls) == 3
    history = q_models.q_loss_history(spark, "/root/testdata/sf0.001")
    assert history.count() == 20 * TR.EPOCHS


def test_large_label_maps_are_refused(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LITERAL_MAP", 2)
    df = spark.createDataFrame([(-i,) for i in range(1, 5)], "sentiment int")
    with pytest.raises(ValueError):
        L.encode_labels(df, L.label_map(df, ["sentiment"]))


def test_no_cached_frame_is_left(spark):
    from threadline.plans.q_models import training_inputs
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    rows, _ = training_inputs(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_a_shard_takes_little_beside_the_model(monkeypatch):
    """Only met features are copied, and their changes leave a few at a time."""
    import tracemalloc
    classes, width = [3] * 20, 1 << 16
    model = TR.JointModel([str(i) for i in range(20)], classes, width, *(np.zeros((width + 1, 60)) for _ in range(2)))
    rng = np.random.default_rng(5)
    flat, sizes = rng.integers(0, 1_000, 4_000), np.full(400, 10)
    labels = rng.integers(-1, 3, (400, 20))

    def run():
        return list(TR.train_shard(model, flat, sizes, labels, 0, 4, 32, 0.5))
    tracemalloc.start()
    whole = run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < model.weights.nbytes / 4
    monkeypatch.setattr(TR, "SENT", 64)
    parts = run()
    assert max(len(f) for f, _, _ in parts) == 64 and len(parts) > 10
    for k in range(3):
        assert np.array_equal(np.concatenate([x[k] for x in whole[:-1]]), np.concatenate([x[k] for x in parts[:-1]]))
        assert np.array_equal(whole[-1][k], parts[-1][k])
