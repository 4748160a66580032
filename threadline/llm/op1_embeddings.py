"""Operator 1: near-duplicate embeddings.

Random-hyperplane sign hashing: in each of `TABLES` tables a vector's key is
the signs of its products with `BITS` fixed random directions.  Vectors that
share a key in any table are compared by exact cosine in double precision, and
links of at least the threshold are joined to components.

With the angle arccos(0.98) two vectors agree in one sign with probability
0.936, in a key of 16 with 0.348, and in none of the 28 tables with
(1 - 0.348)**28 = 6e-6: that is the share of links at the threshold that may be
missed; closer pairs are missed far more rarely.

* Equal vectors (same label and components) are one class with a size before
  hashing, so a group of copies costs one row.
* Only buckets of two or more classes go on, as ids.  A bucket is cut into
  chunks of about `CHUNK` members by hash, and each pair of chunks is a block
  of its own, so no task holds a whole hot bucket and no pair becomes a row: a
  block adds up links per vector and reports a spanning forest of its links.
* A pair is counted in the first table where its keys agree, so it counts once.

No link: vectors that are null, empty or zero, or hold null or non-finite
components; null labels; unlike lengths; unlike labels; rows with a null vec_id
(n_links 0, component_id null, kept false).  Every row is a vector and one row of
the result: rows that repeat a vec_id, with the same vector or another, are
vectors of their own, each linked by its own components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.llm.common import materialize, partitions, table
from threadline.llm.components import components

THRESHOLD = 0.98
BITS = 16
TABLES = 28
CHUNK = 1024
SEED = 20240607


def directions(dim: int, bits: int = BITS, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def classes(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v, ok) for every row."""
    every = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
                        F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return every.withColumn("ok", F.coalesce(F.col("label").isNotNull() & finite & some, F.lit(False))
                            & F.col("vec_id").isNotNull())


def signs(vectors: DataFrame) -> DataFrame:
    """(cls, label, dim, codes): the key of each table."""
    weights = 1 << np.arange(BITS, dtype=np.int64)

    def fn(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            col = b.column(2)
            dims = col.value_lengths().to_numpy(zero_copy_only=False)
            flat = col.flatten().to_numpy(zero_copy_only=False)
            start = np.cumsum(dims) - dims
            codes = np.zeros((len(dims), TABLES), dtype=np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                d = int(d)
                planes.setdefault(d, directions(d))
                m = flat[start[at][:, None] + np.arange(d)]
                m = m / np.abs(m).max(axis=1, keepdims=True)
                codes[at] = ((m @ planes[d]).reshape(len(at), TABLES, BITS) > 0) @ weights
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(dims, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(dims) + 1) * TABLES, pa.int32()),
                                          pa.array(codes.ravel().astype(np.int32)))],
                names=["cls", "label", "dim", "codes"])
    src = vectors.select("cls", "label", "v")
    k = dict(src.dtypes)
    return src.mapInArrow(fn, f"cls {k['cls']}, label {k['label']}, dim int, codes array<int>")


def link_block(left: dict, right: dict | None, t: int, threshold: float):
    """Links within a block, or between two: (row, row) index arrays."""
    a = left
    b = a if right is None else right
    dot = a["v"] @ b["v"].T
    hit = dot >= threshold * a["norm"][:, None] * b["norm"][None, :]
    if right is None:
        hit = np.triu(hit, 1)
    i, j = np.nonzero(hit)
    if t:                                        # pairs that met in an earlier table count there
        first = (a["codes"][i, :t] == b["codes"][j, :t]).any(axis=1) if len(i) < 1_000_000 else np.concatenate(
            [(a["codes"][x, :t] == b["codes"][y, :t]).any(axis=1)
             for x, y in zip(np.array_split(i, 64), np.array_split(j, 64))])
        i, j = i[~first], j[~first]
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (i, j) over n rows."""
    label = np.arange(n)
    while True:                                  # least label over neighbours, to a fixed point
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(x, int(r)) for x, r in enumerate(label) if x != r]


def compare(members: DataFrame, threshold: float) -> DataFrame:
    """Per block: (kind 0) partial link counts of a class, (kind 1) edges.

    members: (key, t, lo, hi, side, cls, size, v, codes), sorted by block inside
    a partition; a block is held in memory while it is read, nothing else."""
    def flush(rows, t, lo, hi, out):
        def side(s):
            own = [r for r in rows if r[0] == s]
            v = np.array([r[3] for r in own], dtype=float)
            return {"cls": [r[1] for r in own], "size": np.array([r[2] for r in own]), "v": v,
                    "norm": np.sqrt(np.einsum("ij,ij->i", v, v)) if len(own) else v,
                    "codes": np.array([r[4] for r in own])} if own else None
        a, b = side(0), None if lo == hi else side(1)
        if a is None or (lo != hi and b is None):
            return
        i, j = link_block(a, b, t, threshold)
        if not len(i):
            return
        other = a if b is None else b
        na = len(a["cls"])
        ids = a["cls"] + ([] if b is None else b["cls"])
        shift = 0 if b is None else na
        links = np.bincount(i, other["size"][j], len(ids)) + np.bincount(j + shift, a["size"][i], len(ids))
        for x in np.flatnonzero(links):
            out.append((0, ids[x], int(links[x])))
        for x, r in forest(len(ids), i, j + shift):
            out.append((1, ids[x], ids[r]))

    def fn(batches):
        rows, now, out = [], None, []
        names = ("key", "t", "lo", "hi", "side", "cls", "size", "v", "codes")
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)) for c in names]
            v = cols[7].flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(cols[7].value_lengths().to_numpy(zero_copy_only=False))])
            codes = cols[8].flatten().to_numpy(zero_copy_only=False).reshape(-1, TABLES)
            plain = [c.to_pylist() for c in cols[:7]]
            for k, (key, t, lo, hi, side, cls, size) in enumerate(zip(*plain)):
                if (key, t, lo, hi) != now:
                    if rows:
                        flush(rows, *now[1:], out)
                    rows, now = [], (key, t, lo, hi)
                rows.append((side, cls, size, v[at[k]:at[k + 1]], codes[k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)],
                                                 names=["kind", "a", "b"])
                out = []
        if rows:
            flush(rows, *now[1:], out)
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)],
                                         names=["kind", "a", "b"])
    return members.mapInArrow(fn, "kind long, a long, b long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id",
                    vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector."""
    spark = rows.sparkSession
    every = materialize(classes(rows, id_col, vec_col, label_col), "op1-vectors")
    groups = materialize(
        every.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("size"))
        .withColumn("cls", F.monotonically_increasing_id()), "op1-classes")          # written, so a class keeps its number
    hashed = materialize(signs(groups), "op1-signs")
    keyed = hashed.select("cls", F.posexplode("codes").alias("t", "code"),
                          "label", "dim").select("cls", "t", F.xxhash64("label", "dim", "t", "code").alias("key"))
    crowded = keyed.groupBy("key", "t").agg(F.count("*").alias("n")).where("n > 1")
    chunk = F.pmod(F.xxhash64("cls", F.lit(7)), F.col("chunks")).cast("int")
    members = (keyed.join(crowded, ["key", "t"])
               .withColumn("chunks", F.ceil(F.col("n") / CHUNK))
               .withColumn("own", chunk)
               .select("key", "t", "cls", "own",
                       F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)).alias("other"))
               .select("key", "t", "cls", F.least("own", "other").alias("lo"),
                       F.greatest("own", "other").alias("hi"),
                       (F.col("own") > F.col("other")).cast("int").alias("side")))
    vectors = groups.select("cls", "size", "v").join(hashed.select("cls", "codes"), "cls")
    blocks = (members.join(vectors, "cls")
              .repartition(partitions(spark), "key", "t", "lo", "hi")
              .sortWithinPartitions("key", "t", "lo", "hi"))
    found = materialize(compare(blocks, threshold), "op1-links")
    links = found.where("kind = 0").groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("links"))
    roots = components(found.where("kind = 1").select("a", "b"), "op1-components")
    placed = groups.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    per_class = (placed.join(links, "cls", "left").join(least, "root")
                 .select("label", "v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    alone = every.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                             F.col("vec_id").alias("component_id"))
    linked = every.where("ok").join(per_class, ["label", "v"]).select("vec_id", "n_links", "component_id")
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
