"""Operator 10: n-gram Jaccard join by vertical partitioning.

A document is the set of its distinct word n-grams, each a 64-bit hash.  The
hash order is the global n-gram order, cut into fragments; every count below is
taken per fragment and summed per document or pair.

1. Documents with equal sets are one class (fingerprint of the sorted set), so
   copies cost nothing further on.
2. Unshared counts.  A set of n grams that links with another lacks at most
   n - ceil(t * n) of its grams there.  The lowest share `REACH` of the order
   (the whole order for small sets) goes to fragments as packed arrays; a
   fragment counts per class the grams no other class has, and the sum over
   fragments rules out every class above that bound.  Nothing that can link is
   lost.  What is left are sets made almost wholly of shared grams.
3. First links.  Among classes that share a gram of their prefix (the first
   n - ceil(t * n) + 1 of their grams; linked sets always do), each is compared
   with the two most shared-with classes it meets most often: at most two pairs
   a class.  Pairs are decided by vertical partitioning: the overlaps of their
   segments are counted fragment by fragment and summed per pair.  Components
   of these links follow.
4. All other links.  Prefix grams whose classes are still in several components
   are compared in blocks of about `CHUNK` by size and by the distance of their
   fragment histograms, both exact bounds; what passes is decided as in 3.
   Pairs inside one component need no test, so a group of near copies doesn't
   become all its pairs.

Null or empty texts, or texts of white space alone, have the empty set and link
with nothing.  Rows with a null id take part and share the component of their
class if that has an id.  Repeated rows are copies of one another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadline.llm.common import (chunks, give_back, materialize, mix64, partitions, powers, semi_join_filter, sized, table,
                                   texts_of)
from threadline.llm.components import components

WORDS, SHARE = 4, 85             # n-gram length; least Jaccard similarity in per cent
SMALL = 64                       # sets up to this size send all grams in step 2
FRAGMENT_GRAMS = 500_000         # grams a fragment task holds
SEGMENTS = 8                     # fragments of the pair counts
BINS = 256                       # fragments of the histograms
CHUNK = 1024
EARLIER = 4
PIVOTS = 2

BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def reach(share: int) -> float:
    return min(1.0, 2 * (1 - share / 100))


def gram_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text (unsigned)."""
    out: list[np.ndarray] = []
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    values = np.random.default_rng(10).integers(1, 2 ** 63, 256, dtype=np.uint64)
    values[65:91] = values[97:123]                                    # A-Z count as a-z
    factor = np.random.default_rng(11).integers(1, 2 ** 63, words + 1, dtype=np.uint64) | np.uint64(1)
    power = inverse = np.ones(1, dtype=np.uint64)
    for lo, hi in chunks(map(len, raw), 1 << 20):
        part = raw[lo:hi]
        data = np.frombuffer(b" " + b" ".join(part) + b" ", dtype=np.uint8)
        if len(power) < len(data) + 1:
            power = powers(BASE, len(data) + 1)
            inverse = powers(pow(BASE, -1, 2 ** 64), len(data) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * power[:len(data)], dtype=np.uint64)])
        space = SPACE[data]
        start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        end = np.flatnonzero(~space[:-1] & space[1:]) + 1
        h = mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * factor[-1])
        first = 1 + np.concatenate([[0], np.cumsum([len(x) + 1 for x in part])])
        edge = np.searchsorted(start, first)
        grams = np.zeros(max(len(h) - words + 1, 0), dtype=np.uint64)
        for k in range(words):
            grams += h[k:k + len(grams)] * factor[k]
        grams = mix64(grams)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(grams[a:b - words + 1]))
            elif b > a:
                with np.errstate(over="ignore"):
                    whole = (h[a:b] * factor[:b - a]).sum(dtype=np.uint64) ^ (factor[-1] * np.uint64(b - a))
                out.append(mix64(np.array([whole], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - 2 ** 63


def sizes(docs: DataFrame, words: int) -> DataFrame:
    """(id, cls, n) for every row."""
    def fn(batches):
        for b in sized(batches, "text", 4 << 20):
            sets = gram_sets(texts_of(b, "text"), words)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([fingerprint(s) for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64())], names=["id", "cls", "n"])
    return docs.mapInArrow(fn, f"id {dict(docs.dtypes)['id']}, cls long, n long")


def unshared(docs: DataFrame, words: int, share: int, fragments: int) -> DataFrame:
    """(cls, unshared): grams of the lowest part of the order, or of all of it
    for small sets, that no other class has."""
    low = np.uint64(min(2 ** 64 - 1, int(reach(share) * 2 ** 64)))
    reaches = SMALL * 100 // share + 1          # a partner of a small set sends all its grams too

    def deal(batches):
        for b in sized(batches, "text", 8 << 20):
            own = {fingerprint(s): s for s in gram_sets(texts_of(b, "text"), words) if len(s)}
            sent = [s if len(s) <= reaches else s[:np.searchsorted(s, low)] for s in own.values()]
            if not sent:
                continue
            cls = np.fromiter(own.keys(), np.int64, len(own))
            n = np.fromiter(map(len, own.values()), np.int32, len(own))
            grams = np.concatenate(sent)
            at = np.repeat(np.arange(len(sent), dtype=np.int32), [len(s) for s in sent])
            to = (grams % np.uint64(fragments)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(fragments + 1))
            rows = []
            for f in np.flatnonzero(np.diff(cut)):
                pick = order[cut[f]:cut[f + 1]]
                who, local = np.unique(at[pick], return_inverse=True)
                rows.append((int(f), grams[pick].tobytes(), local.astype(np.uint32).tobytes(),
                             cls[who].tobytes(), n[who].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32())]
                + [pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5)],
                names=["fragment", "grams", "at", "cls", "n"])

    def count(found: pa.Table) -> pa.Table:
        held = {c: found.column(c).to_pylist() for c in ("grams", "at", "cls", "n")}
        grams, cls, n = (np.concatenate([np.frombuffer(x, t) for x in held[c]])
                         for c, t in (("grams", np.uint64), ("cls", np.int64), ("n", np.int32)))
        shift = np.concatenate([[0], np.cumsum([len(x) // 8 for x in held["cls"]])])
        at = np.concatenate([np.frombuffer(x, np.uint32) + shift[i] for i, x in enumerate(held.pop("at"))])
        held.clear()
        names, one, number = np.unique(cls, return_index=True, return_inverse=True)
        who = number[at]
        order = np.lexsort((who, grams))
        g, w = grams[order], who[order]
        new = np.ones(len(g), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])               # a class dealt by several tasks
        g, w = g[new], w[new]
        alone = np.ones(len(g), dtype=bool)
        alone[1:] &= g[1:] != g[:-1]
        alone[:-1] &= g[1:] != g[:-1]
        counted = alone & ((g < low) | (n[one][w] <= SMALL))
        counts = np.bincount(w[counted], minlength=len(names))
        bucket = names % buckets
        keep = np.flatnonzero(counts)
        keep = keep[np.argsort(bucket[keep], kind="stable")]
        cut = np.flatnonzero(np.diff(bucket[keep], prepend=-1, append=-1)) if len(keep) else []
        parts = [(int(bucket[keep[a]]), names[keep[a:b]].tobytes(), counts[keep[a:b]].astype(np.int32).tobytes())
                 for a, b in zip(cut[:-1], cut[1:])]
        return pa.table([pa.array([p[i] for p in parts], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))],
                        names=["bucket", "cls", "alone"])

    def total(parts: pa.Table) -> pa.Table:
        give_back()
        cls, number = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in parts.column("cls").to_pylist()]),
                                return_inverse=True)
        return pa.table({"cls": cls, "unshared": np.bincount(number, np.concatenate(
            [np.frombuffer(x, np.int32) for x in parts.column("alone").to_pylist()])).astype(np.int64)})

    buckets = fragments
    dealt = docs.select("text").mapInArrow(deal, "fragment int, grams binary, at binary, cls binary, n binary")
    counted = dealt.groupBy("fragment").applyInArrow(count, "bucket long, cls binary, alone binary")
    return counted.groupBy("bucket").applyInArrow(total, "cls long, unshared long")


def segments(docs: DataFrame, chosen: DataFrame, words: int, repeated: bool) -> DataFrame:
    """(cls, n, parts, hist): the segments of the chosen classes and their gram
    counts in BINS fragments (up to 255, which keeps the distance of two
    histograms a lower bound).  chosen: (id, cls), one id a class."""
    def fn(batches):
        for b in batches:
            cls, parts, hist, n = [], [], [], []
            for want, s in zip(b.column(0).to_pylist(), gram_sets(texts_of(b, "text"), words)):
                if fingerprint(s) != want:              # another text under the same id
                    continue
                cut = np.searchsorted(s >> np.uint64(61), np.arange(SEGMENTS + 1, dtype=np.uint64))
                cls.append(want)
                n.append(len(s))
                parts.append([s[x:y].view(np.int64) for x, y in zip(cut[:-1], cut[1:])])
                bins = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=BINS)
                hist.append(np.minimum(bins, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls, pa.int64()), pa.array(n, pa.int64()),
                 pa.array(parts, pa.list_(pa.list_(pa.int64()))), pa.array(hist, pa.binary())],
                names=["cls", "n", "parts", "hist"])
    out = docs.join(chosen, "id").select("cls", "text").mapInArrow(
        fn, "cls long, n long, parts array<array<long>>, hist binary")
    return out.dropDuplicates(["cls"]) if repeated else out


def decide(pairs: DataFrame, segs: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) that link: overlaps counted segment by segment, summed
    by pair."""
    left = segs.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("parts").alias("x"))
    right = segs.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("parts").alias("y"))
    common = F.aggregate(F.zip_with("x", "y", lambda x, y: F.size(F.array_intersect(x, y))),
                         F.lit(0), lambda total, k: total + k)
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", common.alias("common"))
    return both.where(100 * F.col("common") >= share * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def prefixes(segs: DataFrame, classes: DataFrame, share: int) -> DataFrame:
    """(gram, cls, n, unshared, before): prefix grams with up to EARLIER prefix
    grams that precede them, in the (unsigned) order."""
    length = F.col("n") - F.ceil(F.col("n") * share / F.lit(100)) + 1
    return (segs.select("cls", "n", F.slice(F.flatten("parts"), F.lit(1), length.cast("int")).alias("g"))
            .join(classes.select("cls", "unshared"), "cls")
            .select("cls", "n", "unshared", "g", F.posexplode("g").alias("at", "gram"))
            .select("gram", "cls", "n", "unshared", F.slice(
                "g", F.greatest(F.lit(1), F.col("at") + 1 - EARLIER), F.least(F.col("at"), F.lit(EARLIER))
            ).alias("before")))


def close_pairs(members: DataFrame, share: int) -> DataFrame:
    """Pairs of a block that may link: other component, sizes and histograms
    close enough, no earlier common prefix gram known."""
    def flush(rows, alone, out):
        def side(s):
            own = [r for r in rows if r[0] == s]
            return (np.array([r[1] for r in own]), np.array([r[2] for r in own]), np.array([r[3] for r in own]),
                    np.frombuffer(b"".join(r[4] for r in own), np.uint8).reshape(-1, BINS).astype(np.int16),
                    np.array([r[5] for r in own]))
        a = side(0)
        b = a if alone else side(1)
        if not len(a[0]) or not len(b[0]):
            return
        for i in range(len(a[0])):
            n, m = a[1][i], b[1]
            ok = (b[2] != a[2][i]) & (100 * np.minimum(n, m) >= share * np.maximum(n, m))
            if alone:
                ok[:i + 1] = False
            j = np.flatnonzero(ok)
            if len(j):
                gap = np.abs(b[3][j] - a[3][i]).sum(axis=1, dtype=np.int64)
                j = j[gap * (100 + share) <= (100 - share) * (n + m[j])]
            if len(j):
                mine = a[4][i][a[4][i] != 0]
                j = j[~np.isin(b[4][j], mine).any(axis=1)]
            out.extend((min(x, y), max(x, y)) for x, y in zip([int(a[0][i])] * len(j), b[0][j].tolist()))

    def fn(batches):
        rows, now, res = [], None, []
        for b in batches:
            cols = {c: b.column(b.schema.get_field_index(c)) for c in b.schema.names}
            hist = cols["hist"].to_pylist()
            before = [x + [0] * (EARLIER - len(x)) for x in cols["before"].to_pylist()]
            keys = zip(*(cols[c].to_pylist() for c in ("gram", "lo", "hi", "side", "cls", "n", "root")))
            for k, (gram, lo, hi, s, cls, n, root) in enumerate(keys):
                if (gram, lo, hi) != now:
                    if rows:
                        flush(rows, now[1] == now[2], res)
                    rows, now = [], (gram, lo, hi)
                rows.append((s, cls, n, root, hist[k], before[k]))
            pairs = sorted(set(res))
            res = []
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in range(2)],
                                             names=["a", "b"])
        if rows:
            flush(rows, now[1] == now[2], res)
        pairs = sorted(set(res))
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in range(2)],
                                         names=["a", "b"])
    return members.mapInArrow(fn, "a long, b long")


def join_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
              share: int = SHARE) -> DataFrame:
    """(id, n_shingles, component_id) for every row."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialize(sizes(src, words), "op10-sizes")
    grams = rows.agg(F.sum("n").alias("n")).first().n or 0
    fragments = max(partitions(spark), int(grams * reach(share)) // FRAGMENT_GRAMS + 1)
    lonely = unshared(src, words, share, fragments)
    every = materialize(
        rows.where("n > 0").groupBy("cls").agg(F.min("id").alias("id"), F.first("n").alias("n"))
        .join(lonely, "cls", "left").withColumn("unshared", F.coalesce("unshared", F.lit(0))), "op10-classes")
    classes = every.where(F.col("unshared") <= F.col("n") - F.ceil(F.col("n") * share / F.lit(100))).where(
        F.col("id").isNotNull())
    # a table that repeats ids may bring a class's text several times
    repeated = bool(rows.where("id is not null").groupBy("id").agg(F.count("*").alias("k")).where("k > 1").head(1))
    with semi_join_filter(spark):
        segs = materialize(segments(src, classes.select("id", "cls"), words, repeated), "op10-segments")
    index = prefixes(segs, classes, share)
    index = materialize(index.join(
        index.groupBy("gram").agg(
            F.count("*").alias("met"),
            F.min(F.struct((F.col("unshared") / F.col("n")).alias("u"), "cls")).alias("pivot")).where("met > 1"),
        "gram"), "op10-index")

    votes = (index.where(F.col("cls") != F.col("pivot.cls")).groupBy("cls", F.col("pivot.cls").alias("other"))
             .agg(F.count("*").alias("votes")))
    most = Window.partitionBy("cls").orderBy(F.col("votes").desc(), "other")
    first = (votes.withColumn("k", F.row_number().over(most)).where(F.col("k") <= PIVOTS)
             .select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct())
    links = materialize(decide(first, segs, share), "op10-links")

    roots = components(links, "op10-components").toDF("cls", "root")
    known = index.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    apart = known.groupBy("gram").agg(F.count("*").alias("met"), F.min("root").alias("r0"),
                                      F.max("root").alias("r1")).where("r0 <> r1").drop("r0", "r1")
    number = F.ceil(F.col("met") / CHUNK).cast("int")
    members = (known.drop("met", "pivot").join(apart, "gram").withColumn("chunks", number)
               .withColumn("own", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
               .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
               .withColumn("side", (F.col("own") > F.col("other")).cast("int"))
               .select("gram", "lo", "hi", "side", "cls", "n", "root", "before")
               .join(segs.select("cls", "hist"), "cls"))
    blocks = (members.repartition(partitions(spark), "gram", "lo", "hi")
              .sortWithinPartitions("gram", "lo", "hi"))
    rest = close_pairs(blocks, share).distinct()
    links = links.union(materialize(decide(rest, segs, share), "op10-more-links"))

    roots = components(links, "op10-components").toDF("cls", "root")
    placed = rows.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = placed.where("n > 0").groupBy("root").agg(F.min("id").alias("component_id"))
    linked = placed.where("n > 0").join(least, "root").select("id", "n", "component_id")
    empty = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.union(empty).withColumnRenamed("n", "n_shingles")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_sets(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i+{WORDS - 1}], ' ')) END) AS g
  FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {SHARE} * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, s.g
"""
