"""Operator 9: counterfactual-regularised toxicity classifier.

A logistic regression over word presence.  Besides the log loss and an L2
term it pays for every change of score when an identity term of a labelled
sentence is swapped for another term of the same group, so that a neutral
mention of a group does not raise the score.  All terms of a group that has a
term in the sample take part: one with fewer than `MIN_DOCS` rows of its own has
the weight 0 and keeps it, so that a swap into it costs the whole weight of the
frequent term instead of giving that weight to both.

* Fit: on at most `SAMPLE_ROWS` labelled rows outside the held-out fold, those
  with the smallest hash of their id (a documented bound).  Only this bounded
  list of ids is broadcast; word counts by class are taken by Spark, the
  `VOCABULARY` most telling words are kept.
* Score: one scan over all rows and whole texts, no shuffle.

Null or empty text: no word, so its score is the model's base rate.  Rows with
a null id are scored (held_out null is given as false).  Repeated rows are
scored alike.  Labels of one class only: every score is that class (0 or 1).  No
labelled row: every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.llm.common import clean_labels, columns, held_out, materialize, slices, table, texts_of

SAMPLE_ROWS = 30_000
VOCABULARY = 1_024
MIN_DOCS = 5
L2 = 1e-3
COUNTERFACTUAL = 1.0
STEPS = 300
CERTAIN = float("inf")           # a bias whose score is 1

# Groups of identity terms that may stand for one another (lower case).
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"),
    ("deaf", "blind", "disabled"), ("old", "young"),
    ("femmes", "hommes"), ("frauen", "männer"), ("mujeres", "hombres"),
    ("musulmans", "chrétiens", "juifs"), ("muslime", "christen", "juden"),
    ("musulmanes", "cristianos", "judíos"),
)

WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def count_words(sample: DataFrame) -> DataFrame:
    """(word, n0, n1): labelled rows of each class that hold the word."""
    def fn(batches):
        for b in slices(batches):
            seen = {0: Counter(), 1: Counter()}
            for t, y in zip(texts_of(b, "text"), columns(b, "y")[0]):
                seen[y].update(words(t))
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([seen[0][k] for k in keys], pa.int64()),
                 pa.array([seen[1][k] for k in keys], pa.int64())], names=["word", "n0", "n1"])
    return (sample.mapInArrow(fn, "word string, n0 long, n1 long")
            .groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def presence(sample: DataFrame, vocab: list[str]) -> DataFrame:
    """(y, idx): the vocabulary words of each labelled row."""
    index = {w: i for i, w in enumerate(vocab)}

    def fn(batches):
        for b in batches:
            idx = [sorted(index[w] for w in words(t) if w in index) for t in texts_of(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns(b, "y")[0], pa.int32()), pa.array(idx, pa.list_(pa.int32()))],
                names=["y", "idx"])
    return sample.mapInArrow(fn, "y int, idx array<int>")


def swaps(rows: list[list[int]], vocab: list[str], groups) -> list[tuple[int, int, int]]:
    """(a, b, n): term a of a labelled row swapped for term b, n times."""
    index = {w: i for i, w in enumerate(vocab)}
    others: dict[int, list[int]] = {}
    for g in groups:
        own = [index[w] for w in g if w in index]
        for a in own:
            others.setdefault(a, []).extend(x for x in own if x != a)
    n: Counter = Counter()
    for r in rows:
        have = set(r)
        for a in have & others.keys():
            n.update((a, x) for x in others[a] if x not in have)
    return [(a, b, k) for (a, b), k in sorted(n.items())]


def fit_weights(y: np.ndarray, rows: list[list[int]], n_words: int,
                pairs: list[tuple[int, int, int]], l2: float = L2,
                counterfactual: float = COUNTERFACTUAL, steps: int = STEPS,
                fixed: list[int] = ()) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on class-weighted log loss + l2 |w|^2 +
    counterfactual * mean (score change under a swap)^2.  The words of `fixed`
    keep the weight 0."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((i for r in rows for i in r), dtype=np.int64, count=len(at))
    pos = max(y.sum(), 1)
    weight = np.where(y == 1, 0.5 / pos, 0.5 / max(len(y) - pos, 1))
    a, b, k = (np.array([p[i] for p in pairs], dtype=np.int64) for i in range(3))
    k = k / max(k.sum(), 1)
    freq = np.bincount(col, minlength=n_words) / max(len(y), 1)
    scale = 1 / np.sqrt(np.maximum(freq, 1e-4))       # rare words may move as fast as common ones
    w, bias, vw, vb = np.zeros(n_words), 0.0, np.zeros(n_words), 0.0
    pull = np.bincount(a, k, n_words) + np.bincount(b, k, n_words) if len(pairs) else np.zeros(n_words)
    scale[list(fixed)] = 0
    rate = scale / (2 + 4 * counterfactual * pull * scale)      # a term's swaps slow down that term alone
    for step in range(steps):
        m = step / (step + 3)
        lw, lb = w + m * vw, bias + m * vb
        z = np.bincount(at, lw[col], minlength=len(y)) + lb
        e = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.bincount(col, e[at], minlength=n_words) + l2 * lw
        if len(pairs):
            d = 2 * counterfactual * k * (lw[a] - lw[b])
            g += np.bincount(a, d, minlength=n_words) - np.bincount(b, d, minlength=n_words)
        nw, nb = lw - rate * g, lb - e.sum() / 2
        vw, vb, w, bias = nw - w, nb - bias, nw, nb
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY,
        min_docs: int = MIN_DOCS, counterfactual: float = COUNTERFACTUAL,
        groups=IDENTITY_GROUPS) -> tuple[dict[str, float], float]:
    """Word weights and bias; no weights where a class has no labelled row."""
    chosen = (clean_labels(labels, label_col).where(~held_out("id"))
              .orderBy(F.xxhash64("id"), "id").limit(sample_rows))
    sample = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "id").select("y", "text"), "op9-sample")
    n = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return {}, CERTAIN if n.get(1) else -CERTAIN
    identity = sorted({w for g in groups for w in g})
    p0, p1 = (F.col("n0") + 0.5) / (n[0] + 1), (F.col("n1") + 0.5) / (n[1] + 1)
    gap = F.abs(p1 - p0) / F.sqrt(p0 * (1 - p0) / n[0] + p1 * (1 - p1) / n[1])
    counts = count_words(sample)
    seen = {r.word: r.n for r in counts.where(F.col("word").isin(identity))
            .select("word", (F.col("n0") + F.col("n1")).alias("n")).collect()}
    known = {w for g in groups if any(w in seen for w in g) for w in g}
    counted = counts.where(F.col("n0") + F.col("n1") >= min_docs)
    top = counted.orderBy(gap.desc(), "word").limit(vocabulary).select("word").collect()
    vocab = sorted({r.word for r in top} | known)
    fixed = [i for i, v in enumerate(vocab) if v in known and seen.get(v, 0) < min_docs]
    rows = sorted((r.idx, r.y) for r in presence(sample, vocab).collect())     # at most sample_rows
    idx = [i for i, _ in rows]
    w, bias = fit_weights(np.array([y for _, y in rows]), idx, len(vocab),
                          swaps(idx, vocab, groups), counterfactual=counterfactual, fixed=fixed)
    return {v: float(x) for v, x in zip(vocab, w) if x}, bias


def score(docs: DataFrame, model: tuple[dict[str, float], float], text_col: str = "text",
          out: str = "score") -> DataFrame:
    """All columns of docs and the score of the whole text."""
    weights, bias = model

    def fn(batches):
        known = weights.keys()
        for b in slices(batches):
            z = [bias + sum(sorted(weights[w] for w in words(t) & known)) for t in texts_of(b, text_col)]
            with np.errstate(over="ignore"):
                s = 1 / (1 + np.exp(-np.array(z, dtype=float)))
            yield b.append_column(out, pa.array(s, pa.float64()))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(fn, f"{schema}, `{out}` double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
