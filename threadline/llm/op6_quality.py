"""Operator 6: quality classifier by regularised quadratic discriminant.

Each text becomes a vector of transformed document statistics.  Class means
and covariances are sums that Spark takes over all labelled rows outside the
held-out fold; every covariance is shrunk towards the pooled one and towards
its diagonal.  The score is the posterior of class 1 from the difference of
two Gaussian log densities, each a Mahalanobis distance solved with a Cholesky
factor that is computed once and kept.

Null or empty text: the statistics of an empty text, scored like any other.
A repeated row is scored like its twin.  Without labelled rows of both classes
every score is the share of class 1 (0.5 without any label).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.llm.common import clean_labels, held_out, materialize, table, texts_of

SHRINK_POOLED = 0.05      # weight of the pooled covariance
SHRINK_DIAGONAL = 0.05    # weight of the diagonal
RIDGE = 1e-4
NAMES = ("log_chars", "log_words", "word_length", "upper", "digit", "symbol", "exclaim",
         "symbol_words", "distinct_words", "repeat_next", "repeat_lines", "top_word",
         "short_lines", "sentence_words")

SYMBOL = re.compile(r"[^\w\s.,;:'\"()\-]")
END = re.compile(r"[.!?]+(?:\s|$)")


def logit(x: float) -> float:
    return float(np.log((x + 0.005) / (1.005 - x)))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text, in the order of NAMES."""
    n = len(text)
    words = text.split()
    m = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, text))
    alpha = sum(map(str.isalpha, text))
    digits = sum(map(str.isdigit, text))
    odd = len(SYMBOL.findall(text))
    low = [w.lower() for w in words]
    counts: dict[str, int] = {}
    for w in low:
        counts[w] = counts.get(w, 0) + 1
    same = sum(a == b for a, b in zip(low, low[1:]))
    odd_words = sum(not w[-1].isalnum() and w[-1] not in ".,;:'\")" for w in words)
    return [
        float(np.log1p(n)), float(np.log1p(m)),
        float(np.log1p((n - m) / max(m, 1))),
        logit(upper / max(alpha, 1)), logit(digits / max(n, 1)), logit(odd / max(n, 1)),
        logit(text.count("!") / max(n, 1)), logit(odd_words / max(m, 1)),
        logit(len(counts) / max(m, 1)), logit(same / max(m - 1, 1)),
        logit(1 - len(set(lines)) / max(len(lines), 1)),
        logit(max(counts.values(), default=0) / max(m, 1)),
        logit(sum(len(x) < 30 for x in lines) / max(len(lines), 1)),
        float(np.log1p(m / max(len(END.findall(text)), 1))),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f): one vector for every row; whole texts, no shuffle."""
    def fn(batches):
        for b in batches:
            f = [statistics(t) for t in texts_of(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.list_(pa.float64()))],
                                             names=["id", "f"])
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(fn, f"id {dict(src.dtypes)['id']}, f array<double>")


def moments(labelled: DataFrame, d: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class: rows, mean and covariance, from one aggregate over all rows."""
    cells = [(i, j) for i in range(d) for j in range(i, d)]
    rows = labelled.groupBy("y").agg(
        F.count("*").alias("n"), *[F.sum(F.col("f")[i]).alias(f"s{i}") for i in range(d)],
        *[F.sum(F.col("f")[i] * F.col("f")[j]).alias(f"q{i}_{j}") for i, j in cells]).collect()
    out = {}
    for r in rows:
        mean = np.array([r[f"s{i}"] for i in range(d)]) / r.n
        q = np.zeros((d, d))
        for i, j in cells:
            q[i, j] = q[j, i] = r[f"q{i}_{j}"] / r.n
        out[r.y] = (float(r.n), mean, q - np.outer(mean, mean))
    return out


def discriminant(stats: dict) -> dict | None:
    """Shrunken class Gaussians as Cholesky factors."""
    if len(stats) < 2:
        return None
    total = sum(n for n, _, _ in stats.values())
    d = len(next(iter(stats.values()))[1])
    pooled = sum(n * c for n, _, c in stats.values()) / total
    model = {}
    for y, (n, mean, c) in stats.items():
        c = (1 - SHRINK_POOLED) * c + SHRINK_POOLED * pooled
        c = (1 - SHRINK_DIAGONAL) * c + SHRINK_DIAGONAL * np.diag(np.diag(c))
        c += RIDGE * np.eye(d)
        factor = np.linalg.cholesky(c)
        model[y] = (mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()), float(np.log(n / total)))
    return model


def posterior(x: np.ndarray, model: dict) -> np.ndarray:
    density = {}
    for y, (mean, inverse, half_log_det, prior) in model.items():
        z = (x - mean) @ inverse.T
        density[y] = prior - half_log_det - 0.5 * np.einsum("ij,ij->i", z, z)
    return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(feats: DataFrame, labels: DataFrame, label_col: str = "quality"):
    """(model or None, share of class 1), learnt outside the held-out fold."""
    known = clean_labels(labels, label_col).where(~held_out("id"))
    stats = moments(feats.join(known, "id"), len(NAMES))
    n = sum(s[0] for s in stats.values())
    return discriminant(stats), (stats[1][0] / n if 1 in stats else 0.0) if n else 0.5


def score(feats: DataFrame, fitted) -> DataFrame:
    model, share = fitted
    if model is None:
        return feats.select("id", F.lit(float(share)).alias("score"))

    def fn(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(posterior(x, model))],
                                             names=["id", "score"])
    return feats.mapInArrow(fn, f"id {dict(feats.dtypes)['id']}, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    feats = materialize(features(docs), "op6-features")
    return score(feats, fit(feats, labels)).select(
        F.col("id").alias("doc_id"), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
