"""Operator 4: suffix-array de-duplication by a common-prefix-aware merge sort.

Every byte covered by a `LENGTH`-byte string that also starts anywhere else is
removed; strings are judged on the input and matches never cross documents.

1. Equal texts are one class: from LENGTH bytes on, a class of two or more is
   covered wholly, and only one copy of it goes on.
2. Anchors.  A `GRAM`-byte string is an anchor where its hash is least in a
   window; the window is chosen so that every LENGTH-byte string has an anchor
   inside it, at the same place in every copy.  Anchors whose gram occurs twice
   or more are kept: about one position in seventy of the repeated text.
3. Suffixes.  Tasks sort the suffixes at their anchors (up to LENGTH bytes, with
   the bytes to the left as a payload) into runs, front-code them (common prefix
   with the one before, and the rest) and exchange the runs by gram.  A loser
   tree merges the runs of a part: its nodes carry the common prefix with the
   last suffix put out, so known prefixes are never compared again, and the
   merge yields the common-prefix array with the suffix array.
4. Neighbours with GRAM bytes in common form a group.  An anchor is covered from
   L bytes before to R bytes after it if another suffix of the group agrees on
   that much and L + R >= LENGTH; groups are compared by distinct context.
   Grams with more than `HOT` anchors don't become a group: their windows of
   LENGTH bytes are counted by hash in Spark instead, which is as exact and
   spreads over all tasks.
   A run of one byte makes every place in it an anchor.  A run of `LONG_RUN` bytes is
   covered wholly (its LENGTH-byte strings are all the same), so only anchors within
   LENGTH bytes of its ends go on: those that a string beyond the run can hold.
5. Covered ranges are gathered per class and cut out of its text.

The texts are shuffled once (an exchange that the plan uses again).  Null text
counts as empty.  Rows with null or repeated ids are handled each on its own,
and repeated rows are copies of each other.  Classes are told apart by a 64-bit
hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.llm.common import chunks, fresh, give_back, mix64, partitions, powers, sized, table

LENGTH = 200
GRAM = 64
REACH = LENGTH - GRAM                # bytes to the left of an anchor that matter
HOT = 50_000
RUN = 100_000                        # suffixes a run is sorted from
FRAGMENT_ANCHORS = 500_000
CHUNK = 1 << 18                      # bytes hashed at once: some 80 bytes of arrays a byte
SLICE = 2 << 20                      # bytes of texts held as Python objects
LONG_RUN = 3 * LENGTH
PIECE = 1 << 20                      # a longer text is hashed in pieces
DEALT = 200_000                      # anchors, or windows, sent at once
BASE = 0x9E3779B97F4A7C15 | 1


def sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every window of w elements."""
    n = len(x)
    size = -(-n // w) * w
    pad = np.full(size, x[-1], dtype=x.dtype)
    pad[:n] = x
    block = pad.reshape(-1, w)
    front = op.accumulate(block, axis=1).ravel()
    back = op.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n - w + 1], front[w - 1:n])


def long_runs(text: bytes) -> np.ndarray:
    """(start, end) of the runs of one byte of at least LONG_RUN bytes."""
    data = np.frombuffer(text, dtype=np.uint8)
    edge = np.flatnonzero(np.concatenate([[True], data[1:] != data[:-1], [True]]))
    long = np.flatnonzero(np.diff(edge) >= LONG_RUN)
    return np.stack([edge[long], edge[long + 1]], axis=1).astype(np.int32)


class Anchors:
    """Anchor positions of texts, with the hash of the gram at each."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, dtype=np.uint64)
        self.values = np.random.default_rng(4).integers(1, 2 ** 63, 256, dtype=np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the text, position, gram hash); texts of LENGTH bytes at least."""
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        n, w = len(data), LENGTH - GRAM + 1
        if len(self.power) < n + 1:
            self.power = powers(BASE, n + 1)
            self.inverse = powers(pow(BASE, -1, 2 ** 64), n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.power[:n], out=total[1:])
        h = mix64((total[GRAM:] - total[:-GRAM]) * self.inverse[:n - GRAM + 1]) | np.uint64(1)
        least = sliding(h, w, np.minimum)                       # by window start
        end = np.cumsum([len(t) for t in texts])
        for e in end[:-1].tolist():                             # windows that cross texts
            least[max(0, e - LENGTH + 1):e] = 0
        pad = np.zeros(w - 1, dtype=np.uint64)
        most = sliding(np.concatenate([pad, least, pad]), w, np.maximum)
        at = np.flatnonzero(most == h)
        text = np.searchsorted(end, at, side="right")
        return text, at - (end - [len(t) for t in texts])[text], h[at]


def pieces(cls: int, text: bytes) -> Iterator[tuple[int, bytes, int, int, int]]:
    """(cls, bytes, their place, [first, stop) of their own anchors): a long text in
    overlapping pieces.  A place is an anchor by the LENGTH bytes around it."""
    if len(text) <= PIECE:
        yield cls, text, 0, 0, len(text)
        return
    for at in range(0, len(text), PIECE):
        lo = max(0, at - 2 * LENGTH)
        yield cls, text[lo:at + PIECE + 2 * LENGTH], lo, at, min(at + PIECE, len(text))


def distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(cls, text) dealt by class; a task sends a class once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.xxhash64(text).alias("cls"), text.alias("text")).where(F.octet_length("text") >= LENGTH)

    def once(batches):
        seen: set[int] = set()
        for b in batches:
            keep = []
            for i, c in enumerate(b.column(0).to_pylist()):
                if c not in seen:
                    seen.add(c)
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))
    return src.mapInArrow(once, "cls long, text string").repartition(partitions(docs.sparkSession), "cls")


def unseen(batches, column: str) -> Iterator[dict]:
    """Rows of a partition, one per class (all copies lie in one partition)."""
    seen: set[int] = set()
    for b in sized(batches, "text", SLICE):
        for row in zip(b.column(0).to_pylist(), b.column(b.schema.get_field_index("text")).to_pylist(),
                       b.column(b.schema.get_field_index(column)).to_pylist()):
            if row[0] not in seen:
                seen.add(row[0])
                yield row[0], row[1].encode("utf-8", "surrogatepass"), row[2]


def repeated_anchors(texts: DataFrame, fragments: int) -> DataFrame:
    """(cls, pos, hot, end): anchors whose gram occurs twice or more, and long runs
    from pos to end (hot is null)."""
    def send(held: list[tuple]) -> pa.RecordBatch:
        cls, pos, h = (np.concatenate(x) for x in zip(*held))
        to = (h >> np.uint64(8)) % np.uint64(fragments)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(fragments + 1, dtype=np.uint64))
        rows = [(int(f), *(x[order[cut[f]:cut[f + 1]]].tobytes() for x in (h, cls, pos)))
                for f in np.flatnonzero(np.diff(cut))]
        return packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32())]
            + [pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 4)],
            names=["fragment", "grams", "cls", "pos"])

    def deal(batches):
        find = Anchors()
        seen: set[int] = set()
        held: list[tuple] = []
        for b in sized(batches, "text", SLICE):
            rows = []
            for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if c not in seen:
                    seen.add(c)
                    rows.append((c, t.encode("utf-8", "surrogatepass")))
            runs = {c: r for c, r in ((c, long_runs(t)) for c, t in rows) if len(r)}
            if runs:                                       # fragments of their own kind: no grams
                yield packed([(-1 - c % fragments, b"", np.full(len(r), c, dtype=np.int64).tobytes(), r.tobytes())
                              for c, r in runs.items()])
            parts = [x for c, t in rows for x in pieces(c, t)]
            for lo, hi in chunks((len(t) for _, t, *_ in parts), CHUNK):
                text, pos, h = find([t for _, t, *_ in parts[lo:hi]])
                cls, shift, first, stop = (np.array([x[i] for x in parts[lo:hi]], dtype=np.int64)[text] for i in (0, 2, 3, 4))
                pos = pos + shift
                good = (pos >= first) & (pos < stop)
                for c in runs.keys() & set(cls.tolist()):
                    own = np.flatnonzero(cls == c)
                    k = np.searchsorted(runs[c][:, 0], pos[own], side="right") - 1
                    start, end = runs[c][k, 0], runs[c][k, 1]
                    good[own] &= ~((k >= 0) & (pos[own] >= start + LENGTH) & (pos[own] + GRAM <= end - LENGTH))
                held.append((cls[good], pos[good].astype(np.int32), h[good]))
                if sum(len(x) for x, _, _ in held) >= DEALT:
                    yield send(held)
                    held = []
        if held:
            yield send(held)

    def count(found: pa.Table) -> pa.Table:
        if found.column("fragment")[0].as_py() < 0:
            bounds = np.frombuffer(b"".join(found.column("pos").to_pylist()), np.int32).reshape(-1, 2)
            return pa.table({"cls": np.frombuffer(b"".join(found.column("cls").to_pylist()), np.int64), "pos": bounds[:, 0],
                             "hot": pa.nulls(len(bounds), pa.bool_()), "end": bounds[:, 1]})
        h, cls, pos = (np.concatenate([np.frombuffer(x, t) for x in found.column(c).to_pylist()])
                       for c, t in (("grams", np.uint64), ("cls", np.int64), ("pos", np.int32)))
        order = np.argsort(h, kind="stable")
        h = h[order]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.repeat(np.diff(np.append(edge, len(h))), np.diff(np.append(edge, len(h))))
        keep = size > 1
        return pa.table({"cls": cls[order][keep], "pos": pos[order][keep], "hot": size[keep] > HOT,
                         "end": pa.nulls(int(keep.sum()), pa.int32())})
    return (texts.mapInArrow(deal, "fragment int, grams binary, cls binary, pos binary")
            .groupBy("fragment").applyInArrow(count, "cls long, pos int, hot boolean, end int"))


def front_code(records: list[tuple[bytes, bytes, int, int]]) -> dict:
    """A sorted run: each suffix as its common prefix with the one before and
    its rest."""
    wide = np.zeros((len(records), LENGTH), dtype=np.uint8)
    size = np.array([len(r[0]) for r in records])
    flat = np.frombuffer(b"".join(r[0] for r in records), dtype=np.uint8)
    wide[np.arange(LENGTH)[None, :] < size[:, None]] = flat
    differ = wide[1:] != wide[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    common = np.concatenate([[0], np.minimum(common, np.minimum(size[1:], size[:-1]))]).astype(np.uint8)
    return {"common": common.tobytes(), "sizes": size.astype(np.uint8).tobytes(),
            "rests": b"".join(r[0][c:] for r, c in zip(records, common.tolist())),
            "left_sizes": bytes(len(r[1]) for r in records), "lefts": b"".join(r[1] for r in records),
            "cls": np.array([r[2] for r in records], dtype=np.int64).tobytes(),
            "pos": np.array([r[3] for r in records], dtype=np.int32).tobytes()}


RUN_SCHEMA = ("part int, common binary, sizes binary, rests binary, left_sizes binary, lefts binary, "
              "cls binary, pos binary")


def decode(run) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """(common prefix with the one before, suffix, left, cls, pos) of a run."""
    cls, pos = np.frombuffer(run.cls, np.int64).tolist(), np.frombuffer(run.pos, np.int32).tolist()
    suffix, at, left_at = b"", 0, 0
    for i, (common, size, left) in enumerate(zip(run.common, run.sizes, run.left_sizes)):
        suffix = suffix[:common] + run.rests[at:at + size - common]
        at += size - common
        yield common, suffix, run.lefts[left_at:left_at + left], cls[i], pos[i]
        left_at += left


def extend(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix of a and b, of which h bytes are known."""
    n = min(len(a), len(b))
    while h + 16 <= n and a[h:h + 16] == b[h:h + 16]:
        h += 16
    while h < n and a[h] == b[h]:
        h += 1
    return h


def merge(runs: list[Iterator]) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """Sorted runs as one, each suffix with its common prefix with the one
    before it, by a loser tree over common prefixes."""
    n = 1
    while n < len(runs):
        n *= 2
    head: list = [next(r, None) for r in runs] + [None] * (n - len(runs))
    known = [0 if x is not None else -1 for x in head]        # common prefix with the last one put out
    loser = [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser).  Both follow the last output: the one that shares
        more with it is smaller; only a tie needs bytes beyond the known ones."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if known[a] < 0:
            return a, b
        x, y = head[a][1], head[b][1]
        h = extend(x, y, known[a])
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    winner = [0] * n + list(range(n))
    for node in range(n - 1, 0, -1):
        winner[node], loser[node] = play(winner[2 * node], winner[2 * node + 1])
    top = winner[1] if n > 1 else 0
    while known[top] >= 0:
        yield (known[top], *head[top][1:])
        head[top] = next(runs[top], None)
        known[top] = head[top][0] if head[top] is not None else -1
        node = (top + n) // 2
        while node:
            top, loser[node] = play(top, loser[node])
            node //= 2


def common_suffix(a: bytes, b: bytes) -> int:
    return extend(a[::-1], b[::-1], 0)


def covered(group: list[tuple[bytes, bytes, int, int]]) -> list[tuple[int, int, int]]:
    """(cls, start, end) of a group: suffixes with their left bytes that share a
    gram."""
    contexts: dict[tuple[bytes, bytes], set] = {}
    for suffix, left, cls, pos in group:
        contexts.setdefault((suffix, left), set()).add((cls, pos))
    out = [(cls, pos - len(left), pos + len(suffix))
           for (suffix, left), places in contexts.items() if len(places) > 1 for cls, pos in places]
    if len(contexts) < 2:
        return out
    keys = list(contexts)
    lone = [len(contexts[k]) == 1 for k in keys]
    if len(keys) <= 24:
        before, after = [0] * len(keys), [0] * len(keys)
        for i in range(len(keys)):
            for j in range(i):
                if lone[i] or lone[j]:
                    right = extend(keys[i][0], keys[j][0], GRAM)
                    left = common_suffix(keys[i][1], keys[j][1])
                    if left + right >= LENGTH:
                        for x in (i, j):
                            before[x], after[x] = max(before[x], left), max(after[x], right)
    else:
        before, after = spread(keys)
    for i, k in enumerate(keys):
        if lone[i] and after[i]:
            cls, pos = next(iter(contexts[k]))
            out.append((cls, pos - before[i], pos + after[i]))
    return out


def spread(keys: list[tuple[bytes, bytes]]) -> tuple[list[int], list[int]]:
    """Reach to the left and right of many contexts: for each offset of a
    window, contexts with an equal window share the hashes of both its parts."""
    d = len(keys)
    right, left = (np.zeros((d, w), dtype=np.uint8) for w in (LENGTH, REACH))
    rn, ln = (np.array([len(k[i]) for k in keys]) for i in (0, 1))
    right[np.arange(LENGTH)[None, :] < rn[:, None]] = np.frombuffer(b"".join(k[0] for k in keys), np.uint8)
    left[np.arange(REACH)[None, :] < ln[:, None]] = np.frombuffer(b"".join(k[1][::-1] for k in keys), np.uint8)
    base, back = np.uint64(BASE), np.uint64(pow(BASE, -1, 2 ** 64))
    r, l = np.zeros(d, np.uint64), np.zeros(d, np.uint64)
    for i in range(LENGTH):
        r = r * base + right[:, i] + np.uint64(1)
    before, after = np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64)
    for o in range(REACH + 1):                       # a window that starts o bytes before the anchor
        ok = np.flatnonzero((ln >= o) & (rn >= LENGTH - o))
        key = mix64(mix64(l[ok]) + r[ok])
        order = np.argsort(key)
        k = key[order]
        same = np.zeros(len(k), dtype=bool)
        same[1:] |= k[1:] == k[:-1]
        same[:-1] |= k[1:] == k[:-1]
        hit = ok[order[same]]
        before[hit] = o                              # offsets grow
        after[hit] = np.maximum(after[hit], LENGTH - o)
        if o < REACH:
            l = l * base + left[:, o] + np.uint64(1)
            r = (r - right[:, LENGTH - 1 - o] - np.uint64(1)) * back
    return before.tolist(), after.tolist()


def merged_ranges(texts: DataFrame, anchors: DataFrame, parts: int) -> DataFrame:
    """(cls, start, end) by the merge sort of front-coded runs."""
    fields = RUN_SCHEMA.split(", ")

    def flush(held: dict) -> pa.RecordBatch:
        rows = []
        for part, records in held.items():
            records.sort()
            rows.append({"part": part, **front_code(records)})
        return pa.RecordBatch.from_arrays(
            [pa.array([r[f.split()[0]] for r in rows], pa.int32() if i == 0 else pa.binary())
             for i, f in enumerate(fields)], names=[f.split()[0] for f in fields])

    def sort_runs(batches):
        held, n = {}, 0
        for cls, text, positions in unseen(batches, "positions"):
            for s in positions:
                suffix = text[s:s + LENGTH]
                part = xxhash.xxh3_64_intdigest(suffix[:GRAM]) % parts
                held.setdefault(part, []).append((suffix, text[max(0, s - REACH):s], cls, s))
            n += len(positions)
            if n >= RUN:
                yield flush(held)
                held, n = {}, 0
        if held:
            yield flush(held)

    def merge_runs(runs: pa.Table) -> pa.Table:
        give_back()
        out, group = [], []
        for common, *record in merge([decode(SimpleNamespace(**r)) for r in runs.to_pylist()]):
            if common < GRAM:
                if len(group) > 1:
                    out += covered(group)
                group = []
            group.append(tuple(record))
        if len(group) > 1:
            out += covered(group)
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))],
                        names=["cls", "start", "end"])

    at = anchors.where(~F.col("hot")).groupBy("cls").agg(F.collect_set("pos").alias("positions"))
    return (texts.join(at, "cls").mapInArrow(sort_runs, RUN_SCHEMA)
            .groupBy("part").applyInArrow(merge_runs, "cls long, start int, end int"))


def hot_ranges(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """(cls, start, end) of grams with very many anchors: their windows, counted
    by hash."""
    def windows(batches):
        for cls, text, positions in unseen(batches, "positions"):
            near = union_ranges([(max(0, s - REACH), min(s, len(text) - LENGTH) + 1) for s in positions])
            for lo, hi in [(x, min(x + DEALT, b)) for a, b in near for x in range(a, b, DEALT)]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_64_intdigest(text[p:p + LENGTH]) - 2 ** 63 for p in range(lo, hi)], pa.int64()),
                     pa.array([cls] * (hi - lo), pa.int64()), pa.array(np.arange(lo, hi, dtype=np.int32))],
                    names=["key", "cls", "start"])
    at = anchors.where("hot").groupBy("cls").agg(F.collect_set("pos").alias("positions"))
    found = texts.join(at, "cls").mapInArrow(windows, "key long, cls long, start int")
    twice = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(twice, "key").select("cls", "start", (F.col("start") + LENGTH).cast("int").alias("end"))


def union_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def covered_classes(docs: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(cls, text) of the distinct texts and (cls, ranges) of those that lose
    bytes by matches, both dealt by class."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0
    fragments = max(partitions(spark), 2 * total // (LENGTH - GRAM) // FRAGMENT_ANCHORS + 1)
    texts = distinct_texts(docs, text_col)
    anchors = repeated_anchors(texts, fragments)
    runs = anchors.where(F.col("hot").isNull()).select("cls", F.col("pos").alias("start"), "end")
    ranges = merged_ranges(texts, anchors, fragments).union(hot_ranges(texts, anchors)).union(runs)
    return texts, ranges.groupBy("cls").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def keep(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for s, e in spans:
        parts.append(text[at:s])
        at = e
    return b"".join([*parts, text[at:]])


def cut_classes(docs: DataFrame, text_col: str) -> DataFrame:
    """(cls, n_removed, n_spans, kept_sha256) of the classes that lose bytes by
    matches."""
    texts, spans = covered_classes(docs, text_col)

    def cut(batches):
        for cls, text, ranges in unseen(batches, "ranges"):
            spans = union_ranges([(r["start"], r["end"]) for r in ranges])
            yield pa.RecordBatch.from_arrays(
                [pa.array([cls], pa.int64()), pa.array([sum(e - s for s, e in spans)], pa.int64()),
                 pa.array([len(spans)], pa.int64()), pa.array([hashlib.sha256(keep(text, spans)).hexdigest()])],
                names=["cls", "n_removed", "n_spans", "kept"])
    return texts.join(spans, "cls").mapInArrow(cut, "cls long, n_removed long, n_spans long, kept string")


def copies(docs: DataFrame, text_col: str) -> DataFrame:
    """(cls, copies) of texts that occur twice or more and are long enough."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (docs.where(F.octet_length(text) >= LENGTH).groupBy(F.xxhash64(text).alias("cls"))
            .agg(F.count("*").alias("copies")).where("copies > 1"))


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("cls"),
                       F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    cut = cut_classes(docs, text_col)
    twice = F.col("copies").isNotNull()
    none = hashlib.sha256(b"").hexdigest()
    return (rows.join(copies(docs, text_col), "cls", "left").join(cut, "cls", "left").select(
        "doc_id", "n_bytes",
        F.when(twice, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(twice, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(twice, F.lit(none)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256")))


def remove(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes cut out of the text.  A cut inside a
    character drops the rest of that character; null texts stay null.

    Texts too short to lose anything pass, copies become empty, and a text that
    occurs once meets its other columns where the texts already lie by class, so
    they are not shuffled again."""
    cls, n, rest = fresh(docs, "_cls"), fresh(docs, "_n"), fresh(docs, "_rest")
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    other = [c for c in docs.columns if c != text_col]
    short = docs.where(size < LENGTH)
    slim = docs.where(size >= LENGTH).select(F.xxhash64(text_col).alias(cls), F.struct(
        F.lit(0).alias(fresh(docs, "_none")), *other).alias(rest))
    once = slim.groupBy(cls).agg(F.count("*").alias(n), F.first(rest).alias(rest)).where(F.col(n) == 1).drop(n)
    more = slim.groupBy(cls).agg(F.count("*").alias(n)).where(F.col(n) > 1).drop(n)
    texts, spans = covered_classes(docs, text_col)

    def cut(batches):
        seen: set[int] = set()
        for b in sized(batches, "text", SLICE):
            at, out = [], []
            for i, (c, text, ranges) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)))):
                if c in seen:
                    continue
                seen.add(c)
                at.append(i)
                if ranges:
                    data = keep(text.encode("utf-8", "surrogatepass"),
                                union_ranges([(r["start"], r["end"]) for r in ranges]))
                    text = data.decode("utf-8", "ignore")
                out.append(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.string()), b.column(3).take(pa.array(at, pa.int64()))], names=["text", "rest"])
    whole = (texts.join(spans, "cls", "left").join(once.select(F.col(cls).alias("cls"), F.col(rest).alias("rest")), "cls")
             .select("cls", "text", "ranges", "rest"))
    kind = dict(whole.dtypes)["rest"]
    done = whole.mapInArrow(cut, f"text string, rest {kind}").select(
        *[F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns])
    copied = slim.join(more, cls, "left_semi").select(
        *[F.lit("").alias(c) if c == text_col else F.col(rest).getField(c).alias(c) for c in docs.columns])
    return short.unionByName(done).unionByName(copied)


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))
