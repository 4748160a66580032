"""Operators on pairs and searches against brute force: 1, 4, 7, 10."""
import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadline.llm import op1_embeddings as op1
from threadline.llm import op4_suffix as op4
from threadline.llm import op7_topk as op7
from threadline.llm import op10_ngram_join as op10
from threadline.llm.components import components

from .conftest import roots

VECTORS = "vec_id long, embedding array<float>, label int, cls long, size int, dim int"


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(3)
    out = []
    for i in range(160):
        if i % 4 and out:
            v = [x + rng.gauss(0, 0.04) for x in rng.choice(out[-8:])[1]]
        else:
            v = [rng.gauss(0, 1) for _ in range(16)]
        out.append((i, v, i // 40))
    out += [(200 + i, out[3][1], out[3][2]) for i in range(5)] + [(210, out[3][1], None)]
    out += [(220, None, 1), (221, [0.0] * 16, 1), (222, [float("nan")] * 16, 1), (223, [None] + [1.0] * 15, 1),
            (224, [float("inf")] * 16, 1), (225, [], 1), (226, [1.0] * 8, 1), (227, [1.0] * 8, 1)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS)


def valid(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_op1_equals_brute_force(spark, vectors, monkeypatch):
    """One row per vector: rows that repeat an id, with the same vector or
    another, and rows without an id."""
    monkeypatch.setattr(op1, "CHUNK", 4)                       # several blocks a bucket
    rows = vectors + [vectors[3], (3, vectors[90][1], vectors[90][2]), (5, None, 1), (5, vectors[41][1], vectors[41][2]),
                      (None, vectors[3][1], vectors[3][2]), (None, None, None)]
    got = collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept)
                              for r in op1.near_duplicates(frame(spark, rows)).collect())
    links = []
    for i, (p, v, a) in enumerate(rows):
        for j, (q, w, b) in enumerate(rows[:i]):
            if None not in (a, p, q) and a == b and valid(v) and valid(w) and len(v) == len(w):
                x, y = np.float32(v).astype(float), np.float32(w).astype(float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                    links.append((i, j))
    n = collections.Counter(x for link in links for x in link)
    root = roots(len(rows), links)
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None)
             for i, r in enumerate(root) if rows[i][0] is not None}
    want = collections.Counter((x, n[i], least.get(root[i]), x is not None and x == least[root[i]])
                               for i, (x, _, _) in enumerate(rows))
    assert len(links) > 30 and got == want


def covered_bytes(texts, length):
    """Removed flags per text by plain counting of all strings."""
    seen = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        flags = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                flags[i:i + length] = [True] * length
        out.append(flags)
    return out


@pytest.mark.parametrize("hot,piece", [(op4.HOT, op4.PIECE), (50, 300)])
def test_op4_runs_of_one_byte(spark, monkeypatch, hot, piece):
    """Runs around the length where they count as long, with the same and with
    other surroundings, at the ends of a text and alone; texts hashed in pieces."""
    monkeypatch.setattr(op4, "HOT", hot)
    monkeypatch.setattr(op4, "PIECE", piece)
    rng = random.Random(44)
    side = [words_of(rng, 40) for _ in range(3)]
    rows = [side[0] + "x" * 900 + side[1], side[0][-150:] + "x" * 1500 + side[1][:150], "x" * 199 + side[2], side[2][:80] + "x" * 200,
            "y" * 700, "y" * 650 + "z", "z" * 200, "z" * 600, "q" * 199, "ab" * 500, "head " + "x" * 601, "x" * 599 + " tail"]
    rows += [side[0] + words_of(rng, 300), words_of(rng, 90) + side[0] + side[2], words_of(rng, 100) + side[2][-230:]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in op4.repeated_bytes(df).collect()}
    data = [t.encode() for t in rows]
    for i, flags in enumerate(covered_bytes(data, op4.LENGTH)):
        kept = bytes(b for b, f in zip(data[i], flags) if not f)
        spans = sum(f and not (j and flags[j - 1]) for j, f in enumerate(flags))
        assert got[i] == (sum(flags), spans, hashlib.sha256(kept).hexdigest())


def words_of(rng, n):
    return " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))


def test_op4_long_padding(spark):
    rows = [(1, "head of a text " + "x" * 20_000_000 + " and its tail"), (2, "nothing here " * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in op4.repeated_bytes(df).collect()}
    assert got == {1: (20_000_000, 1), 2: (0, 0)}


def test_op1_empty(spark):
    assert op1.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.range(0, 40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.node: r.root for r in components(edges.union(edges)).collect()}
    assert got == dict.fromkeys(range(41), 0)


def test_op7_equals_brute_force(spark, vectors, monkeypatch):
    monkeypatch.setattr(op7, "QUERY_BLOCK", 3)
    monkeypatch.setattr(op7, "CANDIDATE_BLOCK", 16)
    rows = vectors + [vectors[20]]
    got = collections.defaultdict(list)
    for r in op7.top_k(op7.valid_vectors(frame(spark, rows)), F.col("vec_id") % 20 == 0, k=10, bins=8).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ok = [(i, np.floor(1024 * np.float32(v).astype(float)).astype(np.int64)) for i, v, _ in rows
          if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, qv in dict((i, v) for i, v in reversed(ok)).items():
        if q % 20 == 0:
            s = sorted((-int(qv @ v), i) for i, v in ok if i != q and len(v) == len(qv))[:10]
            assert sorted(got[q]) == [(k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert op7.top_k(op7.valid_vectors(frame(spark, [])), F.col("vec_id") % 20 == 0).count() == 0


def test_op7_large_values(spark):
    """Scores beyond the exact range of doubles are exact; vectors whose scores
    may not fit 64 bits raise, and none is left out."""
    rng = random.Random(77)
    rows = [(i, [float(np.float32(rng.uniform(-2e5, 2e5))) for _ in range(64)], 1) for i in range(60)]
    rows += [(60 + i, [x * (1 if i else -1) for x in rows[0][1]], 1) for i in range(3)]
    got = collections.defaultdict(list)
    for r in op7.top_k(op7.valid_vectors(frame(spark, rows)), F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    vs = {i: [int(np.floor(1024 * x)) for x in v] for i, v, _ in rows}
    largest = 0
    for q in (0, 20, 40, 60):
        s = sorted((-sum(a * b for a, b in zip(vs[q], vs[i])), i) for i in vs if i != q)[:10]
        assert sorted(got[q]) == [(k + 1, i, -x) for k, (x, i) in enumerate(s)]
        largest = max(largest, -s[0][0])
    assert largest > 2 ** 53
    for big in (1e6, 1e12, 3e38):
        with pytest.raises(OverflowError):
            op7.top_k(op7.valid_vectors(frame(spark, [(0, [big] * 64, 1), (1, [big] * 64, 1), (3, [-big] * 64, 1)])),
                      F.col("vec_id") == 0)


def test_op7_sends_no_copies_of_queries_through_the_driver(spark):
    """Many parts, candidates too large to broadcast, queries small enough: what
    the tasks hand to the driver stays small."""
    rng = np.random.default_rng(7)
    m = rng.integers(-500, 500, (6_000, 64))
    rows = [(i, (x / 1024).tolist(), 1) for i, x in enumerate(m)]
    conf = spark.sparkContext._jsc.sc().conf()
    old = conf.get("spark.driver.maxResultSize", "1g")
    ours = {"spark.sql.shuffle.partitions": "100", "spark.sql.autoBroadcastJoinThreshold": "512k"}
    before = {c: spark.conf.get(c) for c in ours}
    for c, v in ours.items():
        spark.conf.set(c, v)
    conf.set("spark.driver.maxResultSize", "4m")
    try:
        got = collections.defaultdict(list)
        for r in op7.top_k(op7.valid_vectors(frame(spark, rows)), F.col("vec_id") % 10 == 0, k=3).collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
    finally:
        conf.set("spark.driver.maxResultSize", old)
        for c, v in before.items():
            spark.conf.set(c, v)
    scores = m[::10] @ m.T
    assert sorted(got) == list(range(0, 6_000, 10))
    for q in got:
        s = scores[q // 10].copy()
        s[q] = -(1 << 40)
        first = np.lexsort((np.arange(6_000), -s))[:3].tolist()
        assert sorted(got[q]) == [(n + 1, i, s[i]) for n, i in enumerate(first)]


@pytest.mark.parametrize("group", [op7.GROUP, 5])
def test_op7_equal_scores_and_groups_of_queries(spark, monkeypatch, group):
    """Copies of one vector: of equal scores the smaller ids, in every group of queries."""
    monkeypatch.setattr(op7, "GROUP", group)
    rng = random.Random(70)
    some = [[rng.choice((-0.5, 0.0, 0.25)) for _ in range(4)] for _ in range(3)] + [[0.0] * 4, [2e5] * 4, []]
    rows = [(i, some[i % 6], 1) for i in rng.sample(range(900), 900)] + [(900, [1.0] * 7, 1)]
    got = collections.defaultdict(list)
    for r in op7.top_k(op7.valid_vectors(frame(spark, rows)), F.col("vec_id") % 30 < 12, k=4).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    vs = {i: [int(np.floor(1024 * x)) for x in v] for i, v, _ in rows}
    for q in vs:
        if q % 30 < 12 and q < 900:
            s = sorted((-sum(a * b for a, b in zip(vs[q], vs[i])), i) for i in vs if i != q and len(vs[i]) == len(vs[q]))
            assert sorted(got.pop(q)) == [(n + 1, i, -x) for n, (x, i) in enumerate(s[:4])]
    assert not got


def gram_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize("n,share", [(4, 85), (5, 80)])
def test_op10_equals_brute_force(documents, texts, n, share, monkeypatch):
    monkeypatch.setattr(op10, "CHUNK", 3)
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in op10.join_sets(documents, words=n, share=share).collect()),
                 key=str)
    sets = [gram_set(t, n) for _, t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j])]
    root = roots(len(sets), links)
    least = {}
    for i, r in enumerate(root):
        if texts[i][0] is not None:
            least[r] = min(least.get(r, texts[i][0]), texts[i][0])
    want = [(i, len(sets[k]), least.get(root[k])) if sets[k] else (i, 0, i) for k, (i, _) in enumerate(texts)]
    assert got == sorted(want, key=str) and len(links) > 20


def test_op10_links_across_pivots(spark, monkeypatch):
    """Many near copies of one text that mostly don't link with one another."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.id: r.component_id for r in op10.join_sets(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    sets = [gram_set(t, 4) for _, t in rows]
    links = [(i, j) for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert got == dict(enumerate(roots(60, links)))


def test_op10_empty(no_documents):
    assert op10.join_sets(no_documents).count() == 0


def cut(all_bytes, length=200):
    count = collections.Counter(b[p:p + length] for b in all_bytes for p in range(len(b) - length + 1))
    out = []
    for b in all_bytes:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - length + 1):
            if count[b[p:p + length]] > 1:
                gone[p:p + length] = True
        keep = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]),
                    hashlib.sha256(keep).hexdigest(), keep))
    return out


@pytest.mark.parametrize("hot", [50_000, 3])
def test_op4_equals_brute_force(documents, texts, hot, monkeypatch):
    monkeypatch.setattr(op4, "HOT", hot)                       # 3: most groups are counted by windows
    monkeypatch.setattr(op4, "RUN", 40)                        # many runs to merge
    got = sorted(map(tuple, op4.repeated_bytes(documents).collect()), key=str)
    want = cut([(t or "").encode() for _, t in texts])
    assert got == sorted(((i, *w[:4]) for (i, _), w in zip(texts, want)), key=str)
    assert sum(w[1] > 0 for w in want) > 15


def test_op4_many_contexts_of_one_passage(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(230))
    rows = []
    for i in range(60):
        near, cutoff = rng.randrange(0, 60), rng.randrange(150, 230)
        rows.append((i, "".join(rng.choice("xyz") for _ in range(rng.randrange(300))) + passage[near:cutoff + 20]
                     + "".join(rng.choice("xyz") for _ in range(rng.randrange(300)))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, op4.repeated_bytes(df).collect()))
    assert got == [(i, *w[:4]) for (i, _), w in zip(rows, cut([t.encode() for _, t in rows]))]


def test_op4_remove_keeps_columns(documents, texts, no_documents):
    out = op4.remove(documents)
    assert out.columns == documents.columns
    want = cut([(t or "").encode() for _, t in texts])
    expect = [(i, None if t is None else w[4].decode("utf-8", "ignore")) for (i, t), w in zip(texts, want)]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(expect, key=str)
    assert op4.repeated_bytes(no_documents).count() == 0 and op4.remove(no_documents).count() == 0


def test_merge_orders_and_measures_prefixes():
    rng = random.Random(1)
    runs = [sorted(("".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))).encode(), b"", i, i)
                   for i in range(40)) for _ in range(5)]
    merged = list(op4.merge([op4.decode(type("Run", (), op4.front_code(r))) for r in runs]))
    strings = [m[1] for m in merged]
    assert strings == sorted(x[0] for r in runs for x in r)
    for a, b in zip(merged, merged[1:]):
        assert b[0] == op4.extend(a[1], b[1], 0)
