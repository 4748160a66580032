"""Classifiers (6, 9) and the corpus pipeline."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadline.llm import op6_quality as op6
from threadline.llm import op9_toxicity as op9

from .test_pairs import cut, gram_set
from .conftest import roots

TOXIC = ["idiot", "scum", "worthless"]


def labelled(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i is not None],
                                   "doc_id long, quality int, toxic int")
    return docs, labels


@pytest.fixture(scope="module")
def marked():
    rng = random.Random(12)
    rows = []
    for i in range(500):
        w = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(10, 60))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(TOXIC).capitalize() + rng.choice(["", ",", "!"])
        if not good:
            w = [x.upper() + "!!" for x in w[:6]] * 5
            toxic = False if not any(t.upper() + "!!" in w for t in TOXIC) else toxic
        rows.append((i, " ".join(w), int(good), int(toxic)))
    return rows


def test_op9_held_out_accuracy(spark, marked):
    docs, labels = labelled(spark, marked)
    got = {r.doc_id: r for r in op9.toxicity(docs, labels).collect()}
    held = [(got[i], x) for i, t, _, x in marked if got[i].held_out and any(w in t.lower() for w in TOXIC) == bool(x)]
    assert len(held) > 60 and sum(r.predicted == x for r, x in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_op9_counterfactual_term_keeps_neutral_mentions_clean(spark):
    """A group term that goes with toxic words in the sample: without the term
    its mere mention scores high."""
    rng = random.Random(3)
    rows = []
    for i in range(600):
        w = [f"w{rng.randrange(30)}" for _ in range(12)]
        toxic = rng.random() < 0.4
        w[0] = "women" if rng.random() < (0.9 if toxic else 0.05) else "men" if rng.random() < 0.3 else w[0]
        if toxic and rng.random() < 0.9:
            w[1] = rng.choice(TOXIC)
        rows.append((i, " ".join(w), 1, int(toxic)))
    docs, labels = labelled(spark, rows)
    gap = {}
    for strength in (0.0, 20.0):
        model = op9.fit(docs, labels, counterfactual=strength)
        probe = spark.createDataFrame([(0, "the women w3 w4"), (1, "the men w3 w4")], "k int, text string")
        s = {r.k: r.score for r in op9.score(probe, model).collect()}
        gap[strength] = s[0] - s[1]
    assert gap[0.0] > 0.3 and abs(gap[20.0]) < 0.5 * gap[0.0]


@pytest.mark.parametrize("run", [op9.toxicity, op6.quality])
def test_classifiers_edge_rows(spark, marked, documents, texts, no_documents, run):
    _, labels = labelled(spark, marked)
    messy = labels.union(labels.limit(50)).union(spark.createDataFrame(
        [(None, 1, 0), (3, None, None), (4, 0, 1), (4, 1, 0)], labels.schema))
    got = run(documents, messy).collect()
    assert len(got) == len(texts) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert run(no_documents, messy).count() == 0
    assert len(run(documents, messy.limit(0)).collect()) == len(texts)


def test_op6_held_out_accuracy(spark, marked):
    docs, labels = labelled(spark, marked)
    got = {r.doc_id: r for r in op6.quality(docs, labels).collect()}
    held = [(got[i], q) for i, _, q, _ in marked if got[i].held_out]
    assert len(held) > 60 and sum(r.predicted == q for r, q in held) >= 0.97 * len(held)


def test_op6_density_equals_the_formula():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, 5))
    stats = {y: (float(n), rng.standard_normal(5), np.cov(rng.standard_normal((50, 5)).T)) for y, n in ((0, 30), (1, 70))}
    model = op6.discriminant(stats)
    want = {}
    pooled = (30 * stats[0][2] + 70 * stats[1][2]) / 100
    for y in (0, 1):
        c = (1 - op6.SHRINK_POOLED) * stats[y][2] + op6.SHRINK_POOLED * pooled
        c = (1 - op6.SHRINK_DIAGONAL) * c + op6.SHRINK_DIAGONAL * np.diag(np.diag(c)) + op6.RIDGE * np.eye(5)
        d = x - stats[y][1]
        want[y] = np.log(stats[y][0] / 100) - 0.5 * np.log(np.linalg.det(c)) - 0.5 * np.sum(d @ np.linalg.inv(c) * d, axis=1)
    assert np.allclose(op6.posterior(x, model), 1 / (1 + np.exp(want[0] - want[1])))


def test_pipeline_stages_take_effect(spark, tmp_path, documents, texts, no_documents):
    base = str(tmp_path)
    toxic = [(i, t, 1, int(any(w in t for w in ("w7 ", "w9 ")))) for i, t in texts if t and i is not None and i < 40]
    _, labels = labelled(spark, toxic)
    labels.write.parquet(f"{base}/labels.parquet")
    documents.write.parquet(f"{base}/documents.parquet")
    docs = spark.read.parquet(f"{base}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages",
                                                      "personal_data", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, base)
        out.write.parquet(f"{base}/{k}")
        docs, old = spark.read.parquet(f"{base}/{k}"), docs
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == old.columns
            assert all(r.n_chars == len(r.text or "") for r in rows) or name in ("toxicity", "near_duplicates")
        if name == "near_duplicates":
            sets = [gram_set(t, 5) for _, t in before]
            links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
                     and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
            root, least = roots(len(sets), links), {}
            for i, r in enumerate(root):
                if before[i][0] is not None:
                    least[r] = min(least.get(r, before[i][0]), before[i][0])
            gone = {before[i][0] for i in range(len(sets)) if sets[i] and before[i][0] is not None
                    and before[i][0] != least[root[i]]}
            assert gone and sorted(str(r.doc_id) for r in rows) == sorted(
                str(i) for i, _ in before if i is None or i not in gone)
        if name == "repeated_passages":
            want = cut([(t or "").encode() for _, t in before])
            assert sorted(str((r.doc_id, r.text)) for r in rows) == sorted(
                str((i, None if t is None else w[4].decode("utf-8", "ignore"))) for (i, t), w in zip(before, want))
    assert corpus_pipeline.run(spark, base).count() == docs.count()
    assert no_documents.count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_documents, base).count() == 0


def test_registered_queries_and_sql():
    import duckdb

    import __spark_entry__ as entry
    names = entry.queries()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in names)] == [] and "pipeline" in names
    assert duckdb.__version__


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_embeddings", "op7_topk", "op10_ngram_join", "op13_divergence"])
def test_query_matches_sql(spark, name):
    import duckdb

    from threadline.llm.queries import ORACLE, QUERIES
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    want = con.sql(ORACLE[name])
    order = [df.columns.index(c) for c in want.columns]
    assert sorted(tuple(r[i] for i in order) for r in df.collect()) == sorted(want.fetchall())
