"""Operator 8: packing by shortest-pack-first over the length histogram.

1. One scan tokenises every whole text, appends the end id and cuts the ids
   into full windows and one rest: a row per piece.
2. Spark counts pieces by length.  The histogram has at most `width` rows,
   whatever the input, and goes to the driver.
3. `spf_patterns` places lengths longest first, each into the open pattern that
   is shortest so far, and only updates pattern counts.  A length adds at most
   three patterns (one split, two new) and a pattern holds at most
   sqrt(2 * width) different lengths: that bounds the slot table, which is
   broadcast, whatever the input.
4. Pieces get a rank within their length (two levels: counts by hash bucket,
   then a row number inside a bucket of about `BUCKET_ROWS`) and join the slot
   that holds their rank.

Null text counts as empty: one piece of the end id alone.  Rows with a null or
repeated doc_id are packed like any other, each on its own.  An empty table
gives no row.  The join to the slots is total, so no piece is lost.
"""

from __future__ import annotations

import array
import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadline.llm.common import materialize, slices, table, texts_of

WIDTH = 1024
END_ID = 0
BUCKET_ROWS = 200_000
CACHED_WORDS = 200_000

# The tokenizer's own word split, with the letters and numbers below U+0100
# written out; other texts take the library's split.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", " \t\n\r\x0b\x0c\x85\xa0"
SPLIT = (f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+"
         f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
SIMPLE = "[\x00-\x1b\x20-\xff]*"


class Encoder:
    """text -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, name: str):
        import public_tokenizers as files
        import tiktoken
        with open(files.path(name + ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks,
                                        special_tokens={}).encode_ordinary
        self.json = files.path(name + ".json")
        self.split, self.simple = re.compile(SPLIT).findall, re.compile(SIMPLE).fullmatch
        self.full = None
        self.words: dict[str, bytes] = {}

    def word(self, w: str) -> bytes:
        ids = self.words.get(w)
        if ids is None:
            ids = array.array("I", self.encode(w)).tobytes()
            if len(self.words) < CACHED_WORDS and len(w) < 40:
                self.words[w] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if "<|endoftext|>" in text:          # a special token that only the full tokenizer maps
            if self.full is None:
                from tokenizers import Tokenizer
                self.full = Tokenizer.from_file(self.json)
            return array.array("I", self.full.encode(text, add_special_tokens=False).ids).tobytes()
        if self.simple(text):
            return b"".join(map(self.word, self.split(text)))
        return array.array("I", self.encode(text)).tobytes()


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
           tokenizer: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) for every piece."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    step = 4 * width

    def fn(batches):
        encode, end = Encoder(tokenizer), array.array("I", [END_ID]).tobytes()      # goes with the task
        for b in slices(batches):
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, t in enumerate(texts_of(b, "text")):
                data = encode(t) + end
                for at in range(0, len(data), step):
                    part = data[at:at + step]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(data) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            long = pa.int64()
            arrays = [b.column(0).take(pa.array(row, long)), pa.array(start, long), pa.array(length, long),
                      pa.array(crc, long), pa.array(total, long)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    return src.mapInArrow(fn, f"doc_id {dict(src.dtypes)['doc_id']}, start long, length long, "
                              "ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def spf_patterns(histogram: dict[int, int], width: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(pattern, packs)], a pattern being ((length, times), ...).

    Longest lengths first; each goes to the shortest open pattern that has
    room, as often as it fits there, before the next shortest."""
    open_: dict[int, list] = {}                      # used tokens -> [pattern, packs]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for used in sorted(u for u in open_ if u + length <= width):
            while left and open_[used]:
                pattern, packs = open_[used].pop()
                times = min((width - used) // length, max(1, left // packs))
                take = min(packs, left // times)
                if take < packs:
                    open_[used].append((pattern, packs - take))
                open_.setdefault(used + length * times, []).append((pattern + ((length, times),), take))
                left -= take * times
            if not left:
                break
        if left:
            times = min(width // length, left)
            packs, rest = divmod(left, times)
            open_.setdefault(length * times, []).append((((length, times),), packs))
            if rest:
                open_.setdefault(length * rest, []).append((((length, rest),), 1))
    return [(p, n) for used in sorted(open_, reverse=True) for p, n in open_[used] if n]


def slots(patterns) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, times, first sequence, offset): rank r of a
    length is copy (r - first) % times in pack (r - first) // times."""
    out, sequence, rank = [], 0, {}
    for pattern, packs in patterns:
        offset = 0
        for length, times in pattern:
            lo = rank.get(length, 0)
            out.append((length, lo, packs * times, times, sequence, offset))
            rank[length] = lo + packs * times
            offset += length * times
        sequence += packs
    return out


def pack(parts: DataFrame, width: int = WIDTH) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces."""
    spark = parts.sparkSession
    total = parts.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    key = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = key.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(
        Window.partitionBy("length").orderBy("_bucket")) - F.col("_n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = spark.createDataFrame(
        slots(spf_patterns(histogram, width)),
        "_length long, _lo long, _ranks long, _times long, _sequence long, _offset long")
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (key.withColumn("_row", F.row_number().over(inside))
              .join(before.select("length", "_bucket", "_before"), ["length", "_bucket"])
              .withColumn("_rank", F.col("_before") + F.col("_row") - 1))
    at = F.col("_rank") - F.col("_lo")
    return (ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (at >= 0)
                        & (at < F.col("_ranks")))
            .withColumn("sequence_id", F.col("_sequence") + F.floor(at / F.col("_times")))
            .withColumn("offset", F.col("_offset") + at % F.col("_times") * F.col("length"))
            .select(*parts.columns, "sequence_id", "offset"))


def packing(docs: DataFrame, width: int = WIDTH, **options) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return pack(materialize(pieces(docs, width=width, **options), "op8-pieces"), width)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing(table(spark, sf_dir, "documents"))
