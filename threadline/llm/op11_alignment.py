"""Operator 11: cross-tokenizer alignment with minimal perfect hashing.

A text, with one space in front, is encoded by a byte-level BPE (A) and a piece
BPE with byte fallback (B).  Byte offsets where tokens of both end cut it into
groups; a link is an occurrence of an A and a B token whose byte ranges overlap.

Both encoders work on units: a text is cut before each single space that a
character other than white space follows and none but a space precedes.  A's own
word split and B's pieces never cross such a place (checked when the model is
read), so the ids of a text are those of its units in a row.  A stretch of texts is
split into units, each distinct unit is encoded and aligned once, and the texts look
their units up; ends of tokens are merged as sorted arrays.

1. Documents are dealt into chunks of about `CHUNK_BYTES` by hash.  First pass: a
   task adds up the links of a stretch of a chunk per id pair and sends them as packed
   arrays, one row per stretch and shard (`SHARDS` shards by B id).
2. The distinct pairs of a shard meet in a tree (`FAN` chunks a node).  A minimal
   perfect hash numbers them: levels of bits, each keeping the keys that are alone
   at their place; a pair's number is its bit's rank.  A shard has at most
   32,000 / SHARDS x 50,257 pairs, whatever the corpus.
3. Every node of a second tree adds its chunks to one dense count vector, indexed
   by the hash; the nodes' vectors are summed up to the shard's root.  The keys
   are stored in hash order, so each look-up verifies its key.
4. A B id's pairs lie in one shard: its highest count is found there.
5. Chunk rows meet the hash, keys and counts of their shard, node by node, and
   take the corpus-wide counts of their own pairs back to their chunk.
6. Second pass: chunks are dealt again, each behind the counts of its pairs; the
   documents stream past them, are aligned anew and look their links up.

A task holds the pairs of one chunk and the units of one stretch of `STRETCH` bytes
(or one text); no table of all pairs goes to the driver or into one task.

Texts that are null or empty, or whose tokens' bytes don't make up the text with
its space (texts that hold B's space mark), have no tokens: zeros and ''.
Special tokens' strings are plain text.  Each row counts on its own, whatever its
id; repeated rows count repeatedly.  An empty table gives no row.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.llm.common import chunks, materialize, mix64, partitions, sized, table

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k", "piece_bpe_32k.model"
CHUNK_BYTES = 8 << 20
STRETCH = 8 << 20
ENCODED = 1 << 16                # characters encoded at once
SHARDS = 128
FAN = 32
LEVEL_SPACE = 1.5                # places per key of a hash level
MARK = "▁"

CLINGS = re.compile(r" (?=\s|\Z)")               # a space that starts no unit of its own, nor the next
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
PLAIN = re.compile(r"\S")
# white space as A's word split has it; a run longer than the split's stack is cut out before it
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG = 10_000
LONG_RUN = re.compile(f"[{BLANK}]{{{LONG},}}")


def units(text: str) -> list[str]:
    """The units of a text that has a space in front, each without its own
    first space."""
    if CLINGS.search(text) is None:
        return text.split(" ")[1:]
    cuts = [m.start() for m in CUT.finditer(text)]
    return [text[a + 1:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]


class Aligner:
    """Both encoders and the bytes of their tokens."""

    def __init__(self, a: str = TOKENIZER_A, b: str = TOKENIZER_B):
        import public_tokenizers as files
        import sentencepiece
        import tiktoken
        with open(files.path(a + ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
        self.model_a = tiktoken.Encoding(a, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.bytes_a[v] = k
        sp = sentencepiece.SentencePieceProcessor(model_file=files.path(b))
        self.encode_b = sp.encode
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses a unit boundary of this model")
        if len(self.bytes_a) > 1 << 16 or len(pieces) > 1 << 15:
            raise ValueError("a pair of ids doesn't fit 31 bits")
        self.size_a, self.size_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.names = list(map(str, range(max(len(pieces), len(self.bytes_a)))))

    def encode_a(self, text: str) -> list[int]:
        """A's ids.  A run of white space is one word of A, but for its last
        character where another word follows."""
        out, at = [], 0
        if len(text) >= LONG:
            for m in LONG_RUN.finditer(text):
                end = m.end() - (m.end() < len(text))
                out += self.model_a.encode_ordinary(text[at:m.start()])
                out += self.model_a._encode_single_piece(text[m.start():end])
                at = end
        return out + self.model_a.encode_ordinary(text[at:] if at else text)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids of A, ids of B) of a text that has a space in front; None if their
        bytes aren't its own."""
        raw = text.encode()
        a, b = self.encode_a(text), self.encode_b(text[1:])
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    def encoded(self, keys: list[str]) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray] | None]]:
        """(numbers of units, their ids in a row): units side by side where that is
        their own text again, others alone; None for a unit that fails."""
        def joined(part: list[int]):
            both = self.encode(" " + " ".join([keys[i] for i in part]))
            if both is not None or len(part) == 1:
                yield np.array(part), both
            else:                                        # find the unit that fails
                yield from joined(part[:len(part) // 2])
                yield from joined(part[len(part) // 2:])
        alone = [i for i, k in enumerate(keys) if len(k) >= LONG or not PLAIN.match(k) or k[-1] == " " or MARK in k]
        for i in alone:
            yield from joined([i])
        rest = sorted(set(range(len(keys))).difference(alone))
        for lo, hi in chunks((len(keys[i]) for i in rest), ENCODED):
            yield from joined(rest[lo:hi])


class Units:
    """Distinct units of a stretch, encoded and aligned: token and link counts per
    unit, the pair key of every link with its unit, and which units fail."""

    def __init__(self, align: Aligner, keys: list[str], with_groups: bool):
        n = len(keys)
        self.counts = np.zeros((4, n), dtype=np.int64)               # n_a, n_b, n_groups, n_links
        self.broken = np.zeros(n, dtype=bool)
        self.groups: list[str] = [""] * n if with_groups else []
        links, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part, both in align.encoded(keys):
            if both is None:
                self.broken[part] = True
                continue
            a, b = both
            end_a, end_b = np.cumsum(align.size_a[a]), np.cumsum(align.size_b[b])
            unit_end = np.cumsum([len(keys[i].encode()) + 1 for i in part.tolist()])
            ends = np.union1d(end_a, end_b)                          # every link ends at one of them
            at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
            both_end = (end_a[at_a] == ends) & (end_b[at_b] == ends)
            unit = lambda x: np.searchsorted(unit_end, x)
            for row, x in enumerate((end_a, end_b, ends[both_end], ends)):
                self.counts[row, part] = np.bincount(unit(x), minlength=len(part))
            links.append(b[at_b] << 16 | a[at_a])
            owners.append(part[unit(ends)])
            if with_groups:
                shown = self.shown(align, a, b, at_a[both_end] + 1, at_b[both_end] + 1)
                cut = np.cumsum([0, *self.counts[2, part].tolist()]).tolist()
                for i, x, y in zip(part.tolist(), cut[:-1], cut[1:]):
                    self.groups[i] = ";".join(shown[x:y])
        self.links, self.owners = np.concatenate(links), np.concatenate(owners)

    @staticmethod
    def shown(align: Aligner, a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> list[str]:
        """`a1,a2|b1` of each group."""
        name = align.names.__getitem__
        x, y = list(map(name, a.tolist())), list(map(name, b.tolist()))
        out, i, j = [], 0, 0
        for k, m in zip(stop_a.tolist(), stop_b.tolist()):
            out.append(f"{x[i]}|{y[j]}" if k - i == 1 == m - j else f"{','.join(x[i:k])}|{','.join(y[j:m])}")
            i, j = k, m
        return out

    def per_unit(self, values: np.ndarray) -> np.ndarray:
        """Sums of link values by unit."""
        out = np.zeros(len(self.broken), dtype=np.int64)
        np.add.at(out, self.owners, values)
        return out


class Stretch:
    """Texts of a stretch by their distinct units."""

    def __init__(self, align: Aligner, texts: pa.Array, with_groups: bool = False):
        whole = texts.to_pylist()
        clings = np.array([CLINGS.search(" " + t) is not None for t in whole], dtype=bool)
        filled = np.array([bool(t) for t in whole], dtype=bool)
        plain, odd = np.flatnonzero(filled & ~clings), np.flatnonzero(filled & clings)
        split = pc.split_pattern(texts.take(pa.array(plain)), " ")
        more = [units(" " + whole[i]) for i in odd.tolist()]
        flat = pa.concat_arrays([split.flatten(), pa.array([u for x in more for u in x], texts.type)])
        found = flat.dictionary_encode()
        self.docs = np.concatenate([plain, odd])                     # texts, in the order of their units
        self.sizes = np.concatenate([pc.list_value_length(split).to_numpy(zero_copy_only=False),
                                     np.array([len(x) for x in more], dtype=np.int64)]).astype(np.int64)
        self.at = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.units = Units(align, found.dictionary.to_pylist(), with_groups)
        self.starts = np.cumsum(self.sizes) - self.sizes
        good = ~np.logical_or.reduceat(self.units.broken[self.at], self.starts) if len(self.at) else np.zeros(0, bool)
        self.docs, self.starts, self.sizes = self.docs[good], self.starts[good], self.sizes[good]

    def times(self) -> np.ndarray:
        """Occurrences of each unit in texts that have tokens."""
        step = np.zeros(len(self.at) + 1, dtype=np.int64)
        np.add.at(step, self.starts, 1)
        np.add.at(step, self.starts + self.sizes, -1)
        return np.bincount(self.at[np.cumsum(step[:-1]) > 0], minlength=len(self.units.broken))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of unit values by text, for the texts that have tokens."""
        total = np.concatenate([[0], np.cumsum(values[self.at])])
        return total[self.starts + self.sizes] - total[self.starts]


class PerfectHash:
    """Minimal perfect hash of distinct unsigned 31-bit keys, by levels: a key
    stays on the first level where no other is at its place."""

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        sums = np.cumsum([0, *[int(x.sum()) for x in bits]])
        self.ranks = [np.cumsum(x) - 1 + base for x, base in zip(bits, sums)]

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = mix64(np.array([level + 1], dtype=np.uint64))
        return (mix64(keys.astype(np.uint64) ^ seed) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        bits, rest = [], keys
        while len(rest):
            size = 64 + int(len(rest) * LEVEL_SPACE)
            at = cls.place(rest, len(bits), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            rest = rest[~alone[at]]
        return cls(bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; any number, or -1, for a key of no set."""
        out = np.full(len(keys), -1, dtype=np.int64)
        rest = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks)):
            at = self.place(keys[rest], level, len(bits))
            hit = bits[at]
            out[rest[hit]] = ranks[at[hit]]
            rest = rest[~hit]
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.bits), *map(len, self.bits)], dtype=np.int64)
        return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.bits)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        at, bits = 8 * (n + 1), []
        for size in np.frombuffer(data, np.int64, n, 8).tolist():
            packed = -(-size // 8)
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, packed, at), count=size).astype(bool))
            at += packed
        return cls(bits)


def verified(number: PerfectHash, ordered: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The numbers of keys, each checked against the stored key."""
    at = number(keys)
    if len(keys) and ((at < 0).any() or (ordered[at] != keys).any()):
        raise ValueError("a pair is not in the hash of its shard")
    return at


def rows_of(x: pa.Table, *names: str):
    return zip(*[x.column(n).to_pylist() for n in names])


def keys_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint32)


def added(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sum of their weights."""
    order = np.argsort(keys, kind="stable")
    k, w = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(w, first) if len(k) else w


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk, rows) of at most about STRETCH bytes, each within one chunk."""
    for b in sized(batches, "text", STRETCH):
        chunk = b.column(b.schema.get_field_index("chunk")).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.diff(chunk)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(chunk)]):
            if lo < hi:
                yield int(chunk[lo]), b.slice(lo, hi - lo)


def dealt(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text) and the number of chunks."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = src.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    number = total // CHUNK_BYTES + 1
    return src.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(number)).alias("chunk"), "doc_id", "text"), number


def chunk_links(docs: DataFrame) -> DataFrame:
    """(chunk, shard, keys, counts): the links of each stretch of a chunk by pair."""
    def fn(batches):
        align = Aligner()
        for chunk, b in stretches(batches):
            texts = Stretch(align, b.column(1))
            keys, counts = added(texts.units.links, texts.times()[texts.units.owners])
            keys, counts = keys[counts > 0].astype(np.uint32), counts[counts > 0]
            shard = (keys >> np.uint32(16)) % np.uint32(SHARDS)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(SHARDS + 1)).tolist()
            rows = [(s, keys[order[x:y]].tobytes(), counts[order[x:y]].tobytes())
                    for s, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if x < y]
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()),
                 pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                names=["chunk", "shard", "keys", "counts"])
    spark = docs.sparkSession
    return (docs.select("chunk", "text").repartition(partitions(spark), "chunk").sortWithinPartitions("chunk")
            .mapInArrow(fn, "chunk long, shard int, keys binary, counts binary"))


def tree(rows: DataFrame, nodes: int, join) -> DataFrame:
    """rows (shard, node, ...) merged FAN nodes at a time, until a shard is one
    row; join: pa.Table of a node -> pa.Table."""
    while True:
        nodes = -(-nodes // FAN)
        up = rows.withColumn("node", F.floor(F.col("node") / FAN).cast("long"))
        rows = up.groupBy("shard", "node").applyInArrow(join, rows.schema)
        if nodes <= 1:
            return rows


def hashes(blocks: DataFrame, chunks: int) -> DataFrame:
    """(shard, hash, keys): the perfect hash of each shard's distinct pairs and
    the pairs in hash order."""
    def union(x: pa.Table) -> pa.Table:
        (shard, node), = set(rows_of(x, "shard", "node"))
        keys = np.unique(np.concatenate([keys_of(k) for k, in rows_of(x, "keys")]))
        return pa.table({"shard": pa.array([shard], pa.int32()), "node": pa.array([node], pa.int64()),
                         "keys": pa.array([keys.tobytes()], pa.binary())})

    def build(batches):
        for b in batches:
            shards, out, ordered = b.column(0).to_pylist(), [], []
            for data in b.column(1).to_pylist():
                keys = keys_of(data)
                number = PerfectHash.of(keys)
                at = np.empty_like(keys)
                at[number(keys)] = keys
                out.append(number.dump())
                ordered.append(at.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(out, pa.binary()),
                                              pa.array(ordered, pa.binary())], names=["shard", "hash", "keys"])
    roots = tree(blocks.select("shard", F.col("chunk").alias("node"), "keys"), chunks, union)
    return roots.select("shard", "keys").mapInArrow(build, "shard int, hash binary, keys binary")


def by_node(shards: DataFrame, chunks: int) -> DataFrame:
    """Rows of a shard once per node of FAN chunks."""
    return shards.withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((chunks - 1) // FAN).cast("long"))))


def with_node(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("node", F.floor(F.col("chunk") / FAN).cast("long"))


def pair_totals(blocks: DataFrame, numbers: DataFrame, chunks: int) -> DataFrame:
    """(shard, hash, keys, counts, best): dense count vectors in hash order, and
    if a pair's count is the highest of its B id."""
    def dense(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(rows_of(left, "keys", "counts"))
        out = {"shard": [], "node": [], "counts": []}
        if rows:
            (number, ordered), = rows_of(right, "hash", "keys")
            number, ordered = PerfectHash.load(number), keys_of(ordered)
            total = np.zeros(len(ordered), dtype=np.int64)
            for keys, counts in rows:
                total[verified(number, ordered, keys_of(keys))] += np.frombuffer(counts, np.int64)
            out = {"shard": right.column("shard").to_pylist(), "node": right.column("node").to_pylist(),
                   "counts": [total.tobytes()]}
        return pa.table(out, schema=pa.schema([("shard", pa.int32()), ("node", pa.int64()), ("counts", pa.binary())]))

    def add(x: pa.Table) -> pa.Table:
        (shard, node), = set(rows_of(x, "shard", "node"))
        total = sum(np.frombuffer(c, np.int64) for c, in rows_of(x, "counts"))
        return pa.table({"shard": pa.array([shard], pa.int32()), "node": pa.array([node], pa.int64()),
                         "counts": pa.array([total.tobytes()], pa.binary())})

    def mark(batches):
        for b in batches:
            best = []
            for keys, counts in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                _, own = np.unique(keys_of(keys) >> np.uint32(16), return_inverse=True)
                counts = np.frombuffer(counts, np.int64)
                most = np.zeros(own.max() + 1, dtype=np.int64)
                np.maximum.at(most, own, counts)
                best.append((counts == most[own]).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.binary())],
                                             names=["shard", "hash", "keys", "counts", "best"])
    parts = with_node(blocks).groupBy("shard", "node").cogroup(by_node(numbers, chunks).groupBy("shard", "node")) \
        .applyInArrow(dense, "shard int, node long, counts binary")
    roots = tree(parts, (chunks - 1) // FAN + 1, add).select("shard", "counts")
    return numbers.join(roots, "shard").select("shard", "hash", "keys", "counts").mapInArrow(
        mark, "shard int, hash binary, keys binary, counts binary, best binary")


def chunk_totals(blocks: DataFrame, totals: DataFrame, chunks: int) -> DataFrame:
    """(chunk, keys, counts, best): what the pairs of each chunk count in the
    whole corpus."""
    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(rows_of(left, "chunk", "keys"))
        out = {"chunk": [], "keys": [], "counts": [], "best": []}
        if rows:
            (number, ordered, counts, best), = rows_of(right, "hash", "keys", "counts", "best")
            number, ordered = PerfectHash.load(number), keys_of(ordered)
            counts, best = np.frombuffer(counts, np.int64), np.frombuffer(best, bool)
            for chunk, keys in rows:
                at = verified(number, ordered, keys_of(keys))
                out["chunk"].append(chunk)
                out["keys"].append(keys)
                out["counts"].append(counts[at].tobytes())
                out["best"].append(best[at].tobytes())
        return pa.table(out, schema=pa.schema([("chunk", pa.int64()), *[(c, pa.binary()) for c in ("keys", "counts", "best")]]))
    return with_node(blocks.drop("counts")).groupBy("shard", "node") \
        .cogroup(by_node(totals, chunks).groupBy("shard", "node")) \
        .applyInArrow(look_up, "chunk long, keys binary, counts binary, best binary")


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def documents(chunks: DataFrame, looked_up: DataFrame, with_groups: bool) -> DataFrame:
    """The second pass: one row per document."""
    kind = dict(chunks.dtypes)["doc_id"]
    none = F.lit(None).cast("binary")
    first = looked_up.select("chunk", F.lit(0).alias("turn"), F.lit(None).cast(kind).alias("doc_id"),
                             F.lit(None).cast("string").alias("text"), "keys", "counts", "best")
    rows = first.union(chunks.select("chunk", F.lit(1).alias("turn"), "doc_id", "text", none, none, none))
    spark = chunks.sparkSession

    def fn(batches):
        align, now = Aligner(), None
        packed: list[tuple] = []                          # look-up rows of the chunk
        keys = counts = best = None
        for chunk, b in stretches(batches):
            if chunk != now:
                packed, now, keys = [], chunk, None
            ahead = b.filter(pc.equal(b.column(1), 0))
            packed += zip(*[ahead.column(i).to_pylist() for i in (4, 5, 6)])
            b = b.filter(pc.equal(b.column(1), 1))
            if not b.num_rows:
                continue
            if packed:                                    # all lie before the chunk's first document
                keys, at = np.unique(np.concatenate([keys_of(p[0]) for p in packed]), return_index=True)
                counts = np.concatenate([np.frombuffer(p[1], np.int64) for p in packed])[at]
                best = np.concatenate([np.frombuffer(p[2], bool) for p in packed])[at]
                packed = []
            texts = Stretch(align, b.column(3), True)
            per = [*texts.units.counts, *np.zeros((2, len(texts.units.broken)), np.int64)]
            if keys is not None:                          # else no text of the chunk has tokens
                at = np.minimum(np.searchsorted(keys, texts.units.links), len(keys) - 1)
                own = keys[at] == texts.units.links       # links of units in failing texts only may have no count
                per[4:] = [texts.units.per_unit(np.where(own, x[at], 0).astype(np.int64)) for x in (best, counts)]
            out = np.zeros((len(COUNTS), b.num_rows), dtype=np.int64)
            out[:, texts.docs] = [texts.sums(x) for x in per]
            shown, group = [""] * b.num_rows, texts.units.groups.__getitem__
            for i, x, n in zip(texts.docs.tolist(), texts.starts.tolist(), texts.sizes.tolist()):
                shown[i] = ";".join(map(group, texts.at[x:x + n].tolist()))
            cols = [b.column(2), *map(pa.array, out),
                    pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in shown], pa.string())]
            if with_groups:
                cols.append(pa.array(shown, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *COUNTS, "groups_sha256", *["groups"] * with_groups])
    return rows.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "turn").mapInArrow(
        fn, f"doc_id {kind}, {', '.join(c + ' long' for c in COUNTS)}, groups_sha256 string" + ", groups string" * with_groups)


def pair_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a_id, b_id, links, best): every pair of ids that is linked anywhere."""
    chunks, number = dealt(docs, id_col, text_col)
    blocks = materialize(chunk_links(chunks), "op11-links")
    totals = pair_totals(blocks, materialize(hashes(blocks, number), "op11-hashes"), number)

    def unpack(batches):
        for b in batches:
            for keys, counts, best in zip(*[b.column(i).to_pylist() for i in range(3)]):
                k = keys_of(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((k & np.uint32(0xFFFF)).astype(np.int32)), pa.array((k >> np.uint32(16)).astype(np.int32)),
                     pa.array(np.frombuffer(counts, np.int64)), pa.array(np.frombuffer(best, bool))],
                    names=["a_id", "b_id", "links", "best"])
    return totals.select("keys", "counts", "best").mapInArrow(unpack, "a_id int, b_id int, links long, best boolean")


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Counts and digest of the groups for every row; with_groups adds the groups
    themselves."""
    chunks, number = dealt(docs, id_col, text_col)
    blocks = materialize(chunk_links(chunks), "op11-links")
    numbers = materialize(hashes(blocks, number), "op11-hashes")
    totals = materialize(pair_totals(blocks, numbers, number), "op11-totals")
    return documents(chunks, chunk_totals(blocks, totals, number), with_groups)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
