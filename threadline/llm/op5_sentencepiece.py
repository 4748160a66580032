"""Operator 5: SentencePiece encoding and decoding over a relational lattice.

A text becomes units: its spaces are written as the model's space mark, one is
put in front, and it is cut before each run of marks and around line ends.  No
piece of the model crosses such a cut (checked when the model is read), so the
ids of a text are the ids of its units in a row.

1. Lexicon: Spark counts the distinct units of all whole texts.  The `FREQUENT`
   commonest (a bound of rows, of at most `LONG` characters; units of one count all
   or none) are encoded once and sent to the tasks as a dictionary; it saves work
   and decides no id.
2. Lattice: a task cuts its texts into stretches of about `STRETCH` bytes.  The
   distinct units of a stretch that the dictionary lacks are cut once more, before
   marks like commas (again where no piece of the model crosses), and the parts that
   it lacks exploded into their substrings of two characters up to the longest piece's length, each as a
   hash, and equi-joined to the piece table (bounded by the model file, broadcast).  A substring
   that no piece can equal, by a bit table of the pieces' hashes (a Bloom filter of one hash), is not
   sent, so the join sees little but edges; their number follows the length of the texts.  A hash
   that several strings share gives edges too many; they are compared character by
   character and go.  Neither the explosion nor the join moves a row, so this
   shuffles nothing and writes nothing.
3. Fold: behind the edges of some units (`CHUNK` characters) comes one row that
   holds the units, and behind those of a stretch one for every `PIECE` bytes of its
   texts, with their units by number.  The task folds the edges of all units of a chunk into their best paths,
   a position or a merge of every unit at a time.  `viterbi` keeps the best score and last edge
   for every position: the rule of unigram models.  `merges` is the rule of BPE
   models: from single characters, take the best-scored edge that spans exactly
   two neighbours, leftmost first, until none is left.  A BPE model's scores are
   merge ranks and not log probabilities, so Viterbi over them gives other ids than
   the library (on 70 % of the distinct words measured); the model's own type decides.
   Characters without a piece become their UTF-8 bytes.
4. Documents: the ids of a text are those of its units in a row, put together where
   the text lies.

Decoding turns the ids of a whole document back into text: ids to pieces, byte
pieces to characters, marks to spaces, and one leading space goes.  A document
survives (`round_trip`) if that is its own text; one that holds the mark itself
does not, as in the library.  The two are compared by their SHA-256.  Units longer
than `LONG` characters are merged by a heap (the same rule; a lattice of theirs
would be quadratic).
Null or empty text: no unit, no id.  Repeated rows and null ids: each row on its
own.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.llm.common import chunks, columns, give_back, materialize, mix64, sized, slices, table, texts_of

MODEL = "piece_bpe_32k.model"
FREQUENT = 131_072
LONG = 64
STRETCH = 4 << 20               # bytes of text whose distinct units are encoded once
PIECE = 1 << 19                 # bytes of text cut into units, held as one row and put together at a time
CHUNK = 1 << 16                 # characters of units folded side by side
MARK = "▁"
# an edge is one number: the unit's number in its task, the substring's place in it, the piece's id
ID_BITS, POS_BITS = 20, 11
SIEVE_BITS = 21                 # the bit table of the pieces' hashes goes by so many bits
UNIT = f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n"


class Model:
    """Piece table of a SentencePiece file."""

    def __init__(self, name: str = MODEL):
        import public_tokenizers as files
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=files.path(name))
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in plain]
        self.longest = max(len(p) for p, _, _ in self.pieces)
        if self.longest * LONG >= 1 << POS_BITS or max(ids) >= 1 << ID_BITS:
            raise ValueError("an edge of this model doesn't fit a number")
        self.first_byte = next(i for i in ids if sp.is_byte(i) and sp.id_to_piece(i) == "<0x00>")
        ranks = sorted(s for _, _, s in self.pieces)
        # merge ranks are whole numbers, log probabilities are not
        self.merges = all(s == round(s) for s in ranks)
        if any(MARK in p.lstrip(MARK) or "\n" in p for p, _, _ in self.pieces):
            raise ValueError("a piece crosses a unit boundary of this model")

    def table(self, spark: SparkSession) -> DataFrame:
        """(key, id) of the pieces of two characters and more."""
        many = [(p, i) for p, i, _ in self.pieces if len(p) > 1]
        keys = self.keys([p for p, _ in many]).view(np.int64) >> POS_BITS
        # an Arrow table goes to the JVM as it is; rows would keep Python workers of their own on the executors
        return spark.createDataFrame(pa.table({"key": keys, "id": pa.array([i for _, i in many], pa.int32())}))

    def keys(self, pieces: list[str]) -> np.ndarray:
        """The hash of each piece of two characters and more."""
        size = np.array([len(p) for p in pieces])
        return hashes(code_points(pieces), self.longest)[np.cumsum(size) - size, size - 2]

    def marks(self) -> str:
        """Marks that no piece has behind a letter or digit, as inside a regular expression's []."""
        marks = set(string.punctuation)
        for p, _, _ in self.pieces:
            marks -= {b for a, b in zip(p, p[1:]) if a.isalnum()}
        return re.escape("".join(sorted(marks)))

    def closers(self) -> re.Pattern:
        """Matches between a letter or digit and such a mark."""
        return re.compile(f"(?<=[^\\W_])(?=[{self.marks()}])" if self.marks() else "(?!)")


def marked(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.when(t == "", t).otherwise(F.concat(F.lit(MARK), F.replace(t, F.lit(" "), F.lit(MARK))))


def key_of(unit: str) -> str:
    """A unit's short name: without its first mark; one that has none stands behind
    a line end."""
    return unit[1:] if unit[0] == MARK else unit if unit == "\n" else "\n" + unit


def unit_of(key: str) -> str:
    return MARK + key if key[:1] != "\n" else key[1:] or key


def units_of(keys: pa.Array) -> pa.Array:
    """`unit_of` of each."""
    behind = pc.starts_with(keys, "\n")
    return pc.if_else(pc.and_(behind, pc.not_equal(keys, "\n")), pc.utf8_slice_codeunits(keys, 1),
                      pc.if_else(behind, keys, pc.binary_join_element_wise(MARK, keys, "")))


def strings(texts: pa.Array) -> list[str]:
    """The Python texts of an array without nulls, cut from one."""
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "")[0].as_py()
    ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64).tolist()
    return [whole[lo:hi] for lo, hi in zip([0, *ends], ends)]


def keys_of(text: str) -> list[str]:
    """The units of a text by short names."""
    return list(map(key_of, re.findall(UNIT, MARK + text.replace(" ", MARK)))) if text else []


def keys_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(short names of all units, numbers of units, place of each text among them):
    texts with single spaces between words, nearly all, are split at those, and the
    others come behind them."""
    texts = pc.fill_null(texts, "")
    odd = pc.equal(texts, "")
    for test, what in ((pc.starts_with, " "), (pc.ends_with, " "), (pc.match_substring, "  "), (pc.match_substring, " \n"),
                       (pc.match_substring, MARK), (pc.match_substring, "\0")):
        odd = pc.or_(odd, test(texts, what))
    lists = pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n \0"), " ")
    words = lists.flatten()
    keep = pc.not_equal(words, "\0")                      # a line that is empty or begins with a space
    words = pc.replace_substring(words.filter(keep), "\0", "\n")
    kept = np.append(0, np.cumsum(keep.to_numpy(zero_copy_only=False)))
    ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    others = [keys_of(t) for t in texts.filter(odd).to_pylist()]
    found = pa.concat_arrays([words, pa.array([k for o in others for k in o], pa.string())])
    odd = odd.to_numpy(zero_copy_only=False)
    return found, np.append(np.diff(kept[ends]), [len(o) for o in others]).astype(np.int64), np.argsort(
        np.argsort(odd, kind="stable"), kind="stable")


def parts_of(keys: pa.Array, marks: str) -> tuple[pa.Array, np.ndarray]:
    """(short names of the parts of all units, numbers of parts): units cut where
    `Model.closers` matches.  A part with such a mark in front stands behind no space."""
    if marks:
        keys = pc.replace_substring_regex(keys, f"([\\pL\\p{{Nd}}])([{marks}])", "\\1 \n\\2")
    cuts = pc.split_pattern(keys, " ")
    return cuts.flatten(), pc.list_value_length(cuts).to_numpy(zero_copy_only=False)


def lexicon(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(unit, n) over all whole texts; a task counts a stretch before it sends."""
    def count(batches):
        for b in sized(batches, "text", STRETCH):
            found = keys_in(b.column(0))[0].value_counts()
            yield pa.RecordBatch.from_arrays([units_of(found.field(0)), found.field(1)], names=["unit", "n"])
    return (docs.select(F.col(text_col).alias("text")).mapInArrow(count, "unit string, n long")
            .groupBy("unit").agg(F.sum("n").alias("n")))


def code_points(units: list[str]) -> np.ndarray:
    return np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")


def hashes(codes: np.ndarray, longest: int) -> np.ndarray:
    """[at, size - 2]: hash of the `size` characters from `at` on, two at least."""
    out = np.zeros((len(codes), longest - 1), dtype=np.uint64)
    one, h = codes.astype(np.uint64) + np.uint64(1), np.zeros(len(codes), dtype=np.uint64)
    for k in range(min(longest, len(codes))):
        h = h[:len(codes) - k] * np.uint64(0x9E3779B97F4A7C15) + one[k:]
        if k:
            # the upper bits, which are used, depend on every character
            out[:len(h), k - 1] = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return out


def inside(sizes: np.ndarray, longest: int) -> np.ndarray:
    """[at, size - 2]: does that substring end inside its unit?"""
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())
    return np.arange(1, longest) < left[:, None]


def sieve(keys: np.ndarray) -> np.ndarray:
    """A bit table of the pieces' hashes."""
    bits = np.zeros(1 << SIEVE_BITS, dtype=bool)
    bits[keys >> np.uint64(64 - SIEVE_BITS)] = True
    return bits


def stretch_rows(units: list[str], first: int, longest: int, bits: np.ndarray, held, behind=()) -> Iterator[pa.RecordBatch]:
    """A stretch's distinct units by chunks, numbered from `first`: their substrings
    that may be pieces, as (upper bits of the hash, place among the unit's), and behind
    them the row that holds the units.  The last holds `held` as well, and behind it comes
    a row for each of `behind`: whatever the stretch needs after the fold."""
    cuts = list(chunks(map(len, units), CHUNK)) or [(0, 0)]
    for lo, hi in cuts:
        own = units[lo:hi]
        short = [i for i, u in enumerate(own) if len(u) <= LONG]
        sizes = np.array([len(own[i]) for i in short], dtype=np.int64)
        fits = inside(sizes, longest)
        keys = hashes(code_points([own[i] for i in short]), longest)[fits]
        ends = np.cumsum(np.append(0, fits.sum(axis=1)))[np.append(0, np.cumsum(sizes))]
        at = np.flatnonzero(bits[keys >> np.uint64(64 - SIEVE_BITS)])
        places = at - np.repeat(ends[:-1], np.diff(found := np.searchsorted(at, ends)))
        keys = (keys[at].view(np.int64) >> POS_BITS << POS_BITS) + places
        substrings = pa.ListArray.from_arrays(pa.array(np.append(found, found[-1]), pa.int32()), pa.array(keys))
        rest = pickle.dumps((first + lo, own, (held,) if hi == cuts[-1][1] else None), protocol=5)
        yield pa.RecordBatch.from_arrays(
            [pa.array([first + lo + i for i in short] + [None], pa.int64()), substrings,
             pa.array([None] * len(short) + [rest], pa.binary())], names=["number", "substrings", "held"])
    for x in behind:
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.int64())),
             pa.array([pickle.dumps((None, None, (x,)), protocol=5)], pa.binary())], names=["number", "substrings", "held"])


STRETCHES = "number long, substrings array<long>, held binary"


def lattice(stretches: DataFrame, model: Model) -> DataFrame:
    """(edge, held): all pieces inside each unit, and the held rows, in the order of
    the stretches.  stretches: see `stretch_rows`.  Nothing leaves its task."""
    subs = stretches.select("number", "held", F.explode_outer("substrings").alias("substring")).withColumn(
        "key", F.shiftright("substring", POS_BITS))
    found = subs.join(F.broadcast(model.table(stretches.sparkSession)), "key", "left").where(
        F.col("id").isNotNull() | F.col("held").isNotNull())
    place = F.col("substring").bitwiseAND(F.lit((1 << POS_BITS) - 1))
    return found.select((F.shiftleft("number", POS_BITS + ID_BITS) + F.shiftleft(place, ID_BITS)
                         + F.col("id")).alias("edge"), "held")


class Lattice:
    """The edges of some units as a table: row = character, column = size."""

    def __init__(self, units: list[str], first: int, edges: np.ndarray, model: Fold):
        self.units, self.model, self.beyond = units, model, model.longest + 1
        self.sizes = np.array([len(u) if len(u) <= LONG else 0 for u in units], dtype=np.int64)
        self.base = np.cumsum(self.sizes) - self.sizes
        number = (edges >> (ID_BITS + POS_BITS)) - first
        if len(edges) and not (0 <= number.min() and number.max() < len(units)):
            raise RuntimeError("an edge came behind the units it belongs to")
        fits = inside(self.sizes, model.longest)
        begin = np.append(0, np.cumsum(fits.sum(axis=1)))[self.base]        # of a unit's substrings
        where = np.flatnonzero(fits)[begin[number] + (edges >> ID_BITS & ((1 << POS_BITS) - 1))]
        row, size, ids = where // (model.longest - 1), where % (model.longest - 1) + 2, edges & ((1 << ID_BITS) - 1)
        codes = code_points([u for u in units if len(u) <= LONG])
        same = model.sizes[ids] == size
        at = np.flatnonzero(same)
        for k in range(model.longest):                    # the hash's word is not taken for it
            at = at[size[at] > k]
            same[at] &= codes[row[at] + k] == model.codes[ids[at], k]
        self.ids = np.full((len(codes), self.beyond + 1), -1, dtype=np.int32)
        self.ids[row[same], size[same]] = ids[same]
        one = np.minimum(np.searchsorted(model.one, codes), len(model.one) - 1)
        self.ids[:, 1] = np.where(model.one[one] == codes, model.one_ids[one], -1)

    def cost(self, row: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.model.costs[self.ids[row, np.minimum(size, self.beyond)]]

    def merges(self) -> tuple[np.ndarray, np.ndarray]:
        """(unit, row) of the symbols left when no pair of neighbours is a piece.
        Every round merges the best pair of each unit, leftmost first."""
        unit = np.repeat(np.arange(len(self.units)), self.sizes)
        row = np.arange(len(unit))
        done = []
        while len(row):
            end = (self.base + self.sizes)[unit]
            nxt = np.append(row[1:], -1)
            nxt = np.where(np.append(unit[1:], -1) == unit, nxt, end)     # where the symbol ends
            last = nxt == end
            stop = np.where(last, end, np.append(nxt[1:], 0))             # where its neighbour ends
            cost = np.where(last, np.inf, self.cost(row, stop - row))
            heads = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            best = np.minimum.reduceat(cost, heads)
            counts = np.diff(np.append(heads, len(row)))
            going = np.repeat(np.isfinite(best), counts)
            done.append((unit[~going], row[~going]))
            hit = np.flatnonzero((cost == np.repeat(best, counts)) & going)
            hit = hit[np.append(True, unit[hit][1:] != unit[hit][:-1])[:len(hit)]]
            going[hit + 1] = False                                        # swallowed by its neighbour
            unit, row = unit[going], row[going]
        unit, row = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*done)) if done else (row, row)
        order = np.argsort(row)
        return unit[order], row[order]

    def viterbi(self) -> tuple[np.ndarray, np.ndarray]:
        """(unit, row) of the symbols of the path of least cost; unknown characters
        cost more than any path; ties go to the longer last piece."""
        n, most = len(self.units), int(self.sizes.max(initial=0))
        best = np.full((n, most + 1), np.inf)
        best[:, 0] = 0
        back = np.zeros((n, most + 1), dtype=np.int64)
        for end in range(1, most + 1):
            on = np.flatnonzero(self.sizes >= end)
            for size in range(min(end, self.model.longest), 0, -1):
                row = self.base[on] + end - size
                edge = self.cost(row, np.full(len(row), size))
                way = best[on, end - size] + (np.minimum(edge, 1e6) if size == 1 else edge)
                better = way < best[on, end]
                best[on[better], end], back[on[better], end] = way[better], size
        unit, row, at = [], [], self.sizes.copy()
        while (on := np.flatnonzero(at > 0)).size:
            at[on] -= back[on, at[on]]
            unit.append(on)
            row.append(self.base[on] + at[on])
        unit, row = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (unit, row))
        order = np.argsort(row)
        return unit[order], row[order]

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids): the ids of all units in a row."""
        model = self.model
        unit, row = self.merges() if model.merges else self.viterbi()
        end = np.where(np.append(unit[1:], -1) == unit, np.append(row[1:], 0), (self.base + self.sizes)[unit])
        ids = self.ids[row, end - row]
        counts = np.bincount(unit, minlength=len(self.units))
        odd = {u for u in unit[ids < 0].tolist()} | {i for i, u in enumerate(self.units) if len(u) > LONG}
        if not odd:
            return ids, counts
        ends = np.cumsum(counts)
        parts, lo = [], 0
        for u in sorted(odd):                             # with bytes, or too long for the lattice
            own = slice(ends[u] - counts[u], ends[u])
            parts.append(ids[lo:own.start])
            if len(self.units[u]) > LONG:
                got = model.long(self.units[u])
            else:
                got = []
                for r, i in zip(row[own] - self.base[u], ids[own]):
                    got += [i] if i >= 0 else spelled(self.units[u][r], model.first_byte)
            parts.append(np.array(got, dtype=np.int32))
            lo, counts[u] = own.stop, len(got)
        return np.concatenate([*parts, ids[lo:]]), counts


class Fold:
    """What tasks need of a model."""

    def __init__(self, model: Model):
        self.longest, self.merges, self.first_byte = model.longest, model.merges, model.first_byte
        self.keys = model.keys([p for p, _, _ in model.pieces if len(p) > 1])
        self.pieces = {p: (i, s) for p, i, s in model.pieces}
        # the last one is that of no piece, -1
        self.costs = np.full(2 + max(i for _, i, _ in model.pieces), np.inf)
        for _, i, score in model.pieces:
            self.costs[i] = -score
        self.codes = np.zeros((len(self.costs), self.longest), dtype=np.uint32)
        self.sizes = np.zeros(len(self.costs), dtype=np.int64)
        for p, i, _ in model.pieces:
            self.codes[i, :len(p)] = code_points([p])
            self.sizes[i] = len(p)
        single = sorted((ord(p), i) for p, i, _ in model.pieces if len(p) == 1)
        self.one, self.one_ids = (np.array([x[k] for x in single] or [-1], dtype=np.int64) for k in range(2))

    def long(self, unit: str) -> list[int]:
        return heap_merge(unit, self.pieces, self.first_byte) if self.merges else viterbi_long(
            unit, self.pieces, self.longest, self.first_byte)

    def stretches(self, batches) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, object]]:
        """(units, their ids in a row, numbers of ids, what was held) a stretch, and
        behind it (None, None, None, what was held) for each row behind it."""
        edges: list[np.ndarray] = []
        names, parts, numbers = [], [], []
        for b in batches:
            edge, held = b.column(0), b.column(1)
            lo = 0
            for i in np.flatnonzero(held.is_valid().to_numpy(zero_copy_only=False)).tolist():
                edges.append(edge.slice(lo, i - lo).to_numpy(zero_copy_only=False))
                first, units, rest = pickle.loads(memoryview(held[i].as_buffer()))
                if units is None:
                    if any(map(len, edges)):
                        raise RuntimeError("an edge came behind the units it belongs to")
                    yield None, None, None, rest[0]
                    edges, lo = [], i + 1
                    continue
                ids, counts = Lattice(units, first, np.concatenate(edges).astype(np.int64), self).paths()
                names, parts, numbers = names + units, [*parts, ids], [*numbers, counts]
                edges, lo = [], i + 1
                if rest:
                    yield names, np.concatenate(parts), np.concatenate(numbers), rest[0]
                    names, parts, numbers = [], [], []
                    give_back()
            edges.append(edge.slice(lo).to_numpy(zero_copy_only=False).copy())
        if any(map(len, edges)) or parts:
            raise RuntimeError("an edge came behind the units it belongs to")


def spelled(char: str, first_byte: int) -> list[int]:
    return [first_byte + b for b in char.encode("utf-8", "surrogatepass")]


def heap_merge(unit: str, pieces: dict[str, tuple[int, float]], first_byte: int) -> list[int]:
    """The merge rule for one long unit in n log n steps."""
    n = len(unit)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end, alive, heap = list(range(1, n + 1)), [True] * n, []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            got = pieces.get(unit[i:end[j]])
            if got:
                heapq.heappush(heap, (-got[1], i, end[i], end[j]))
    for i in range(n):
        offer(i)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or end[i] != mid or j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        got = pieces.get(unit[i:end[i]])
        out += [got[0]] if got else spelled(unit[i:end[i]], first_byte)
        i = after[i]
    return out


def viterbi_long(u: str, pieces: dict[str, tuple[int, float]], longest: int, first_byte: int) -> list[int]:
    """The path of least cost of one long unit under a unigram model."""
    best, back = [0.0], [(0, None)]
    for end in range(1, len(u) + 1):
        ways = [(best[end - 1] + 1e6, end - 1, None)]
        for start in range(max(0, end - longest), end):
            got = pieces.get(u[start:end])
            if got:
                ways.append((best[start] - got[1], start, got[0]))
        cost, start, piece = min(ways, key=lambda w: (w[0], w[1], w[2] is None))
        best.append(cost)
        back.append((start, piece))
    out, end = [], len(u)
    while end:
        start, piece = back[end]
        out.append([piece] if piece is not None else spelled(u[start:end], first_byte))
        end = start
    return [i for part in reversed(out) for i in part]


def lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))


def encode_units(units: DataFrame, model: Model) -> DataFrame:
    """(unit, ids) for distinct units."""
    fold = Fold(model)

    def cut(batches):
        first, bits = 0, sieve(fold.keys)
        for b in slices(batches, 20_000):
            own = columns(b, "unit")[0]
            yield from stretch_rows(own, first, fold.longest, bits, None)
            first += len(own)

    def ids(batches):
        for own, flat, counts, _ in fold.stretches(batches):
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), lists(flat, counts)], names=["unit", "ids"])
    return lattice(units.select("unit").mapInArrow(cut, STRETCHES), model).mapInArrow(ids, "unit string, ids array<int>")


def decode_units(encoded: DataFrame, model: Model) -> DataFrame:
    """(unit, ids, decoded): the ids of each unit joined back to their pieces."""
    spark = encoded.sparkSession
    rows = ([(i, p.encode("utf-8").hex()) for p, i, _ in model.pieces]
            + [(model.first_byte + b, f"{b:02x}") for b in range(256)])
    names = F.broadcast(spark.createDataFrame(rows, "id int, hex string"))
    raw = F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), ""))
    return (encoded.select("unit", F.posexplode("ids").alias("at", "id")).join(names, "id", "left")
            .groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("at", "id", "hex"))).alias("parts"))
            .select("unit", F.transform("parts", lambda p: p["id"]).alias("ids"),
                    F.decode(raw, "UTF-8").alias("decoded")))


def occurrence(at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A hash for unit number `at` of a text having the ids with hash `key`."""
    return mix64(mix64(at.astype(np.uint64) + np.uint64(1)) + key.astype(np.int64).view(np.uint64))


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, at, unit, ids): the ids of every unit of every text."""
    units = encode_units(lexicon(docs, text_col), model)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                       F.col(text_col).alias("text"))
    src = rows.select("row", "doc_id", F.posexplode(
        F.regexp_extract_all(marked(F.col("text")), F.lit(UNIT), F.lit(0))).alias("at", "unit"))
    return src.join(units, "unit").select("row", "doc_id", "at", "unit", "ids")


def digests(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_units, n_ids, ids_hash, round_trip for every row.

    ids_hash is the xor over the units of a hash of (number of the unit, ids).
    round_trip is that of the marked units; see `documents` for that of the text."""
    counted = materialize(lexicon(docs, text_col), "op5-lexicon")
    encoded = materialize(encode_units(counted, model), "op5-encoded")
    words = materialize(
        counted.join(decode_units(encoded, model), "unit")
        .select("unit", "n", F.size("ids").alias("n_ids"), F.xxhash64("ids").alias("key"),
                (F.col("unit") == F.col("decoded")).alias("same")), "op5-words")
    top = (words.where(F.length("unit") <= LONG).orderBy(F.col("n").desc(), "unit").limit(FREQUENT)
           .select("unit", "n_ids", "key", "same").toArrow().to_pydict())
    known = dict(zip(top["unit"], zip(top["n_ids"], top["key"], top["same"])))
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def look_up(batches):
        find = re.compile(UNIT).findall
        for b in batches:
            sums, rare = [], []
            for t in texts_of(b, "text"):
                units = find(MARK + t.replace(" ", MARK)) if t else []
                hit = [known.get(u) for u in units]
                at = [i for i, h in enumerate(hit) if h]
                got = [h for h in hit if h]
                x = occurrence(np.array(at, dtype=np.int64), np.array([h[1] for h in got], dtype=np.int64))
                sums.append((len(units), sum(h[0] for h in got), int(np.bitwise_xor.reduce(x).view(np.int64))
                             if len(x) else 0, all(h[2] for h in got)))
                rare.append([{"at": i, "unit": units[i]} for i, h in enumerate(hit) if not h])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64()),
                 pa.array([s[2] for s in sums], pa.int64()), pa.array([s[3] for s in sums], pa.bool_()),
                 pa.array(rare, pa.list_(pa.struct([("at", pa.int64()), ("unit", pa.string())])))],
                names=["doc_id", "n_units", "n", "hash", "same", "rare"])

    def hashed(batches):
        for b in batches:
            at, key = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 3))
            yield b.set_column(3, "key", pa.array(occurrence(at, key).view(np.int64)))
    found = materialize(src.mapInArrow(
        look_up, f"doc_id {dict(src.dtypes)['doc_id']}, n_units long, n long, hash long, same boolean, "
                 "rare array<struct<at:long,unit:string>>").withColumn("row", F.monotonically_increasing_id()),
        "op5-found")
    rest = (found.select("row", F.explode("rare").alias("r")).select("row", "r.at", "r.unit")
            .join(words, "unit").select("row", "at", F.col("n_ids").cast("long").alias("n_ids"), "key", "same")
            .mapInArrow(hashed, "row long, at long, n_ids long, key long, same boolean")
            .groupBy("row").agg(F.sum("n_ids").alias("more"), F.bit_xor("key").alias("x"),
                                F.bool_and("same").alias("all")))
    return (found.drop("rare").join(rest, "row", "left").select(
        "doc_id", "n_units", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_ids"),
        F.col("hash").bitwiseXOR(F.coalesce("x", F.lit(0))).alias("ids_hash"),
        (F.col("same") & F.coalesce("all", F.lit(True))).alias("round_trip")))


def text_hashes(texts: pa.Array) -> list[bytes]:
    """SHA-256 of each text, null read as the empty text; nothing becomes a Python text."""
    found = pc.fill_null(texts, "").cast(pa.large_string())
    places = np.frombuffer(found.buffers()[1], np.int64)[found.offset:][:len(found) + 1].tolist()
    spelled = memoryview(found.buffers()[2] or b"")
    return [hashlib.sha256(spelled[lo:hi]).digest() for lo, hi in zip(places, places[1:])]


def decoder(model: Model):
    """(ids of some texts in a row, where each text ends) -> the texts."""
    raw = {i: p.encode("utf-8") for p, i, _ in model.pieces} | {model.first_byte + b: bytes([b]) for b in range(256)}
    table = pa.array([raw.get(i, b"") for i in range(max(raw) + 1)], pa.large_binary())

    def decode(ids: np.ndarray, ends: np.ndarray) -> Iterator[str]:
        found = table.take(pa.array(ids))
        places = np.frombuffer(found.buffers()[1], np.int64)[found.offset:][np.append(0, ends)].tolist()
        spelled = memoryview(found.buffers()[2] or b"")
        for lo, hi in zip(places, places[1:]):
            text = str(spelled[lo:hi], "utf-8", "replace").replace(MARK, " ")
            yield text[1:] if text.startswith(" ") else text
    return decode


def ragged(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, .. counts[i] numbers of each, in a row."""
    ends = np.cumsum(counts)
    return np.repeat(start - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded, n_units, n_ids, round_trip for every row: all ids of
    the text in order, the text they decode to, and if that is the row's own."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(src.dtypes)["doc_id"]
    # a unit that occurs once gains nothing by being known beforehand
    counted = materialize(lexicon(src).where((F.length("unit") <= LONG) & (F.col("n") > 1)), "op5-lexicon")
    room, least = FREQUENT, None
    for n, size in sorted(counted.groupBy("n").agg(F.count("*")).collect(), reverse=True):
        room -= size
        if room < 0:
            break
        least = n
    top = counted.where(F.col("n") >= F.lit(least).cast("long")).select("unit")
    known = encode_units(top, model).toArrow().combine_chunks()
    known_ids = known.column("ids").to_pylist()
    sc = src.sparkSession.sparkContext
    names = sc.broadcast(pa.array(map(key_of, known.column("unit").to_pylist()), pa.string()))
    dictionary = sc.broadcast((np.array([i for ids in known_ids for i in ids], dtype=np.int32),
                               np.array([len(i) for i in known_ids], dtype=np.int64)))
    fold, decode = Fold(model), decoder(model)
    marks, piece_keys, longest = model.marks(), fold.keys, fold.longest         # no more of them goes to the cutting tasks

    def numbered(b: pa.RecordBatch, seen: int) -> tuple[tuple, pa.Array]:
        """((ids, units of the texts by number, numbers of units, hashes), units that the dictionary
        lacks): those are numbered behind it as they occur, the first is number `seen` of its stretch."""
        keys, n_units, order = keys_in(b.column(1))
        at = pc.index_in(keys, value_set=names.value)
        rare = keys.filter(at.is_null())
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).copy()
        at[at < 0] = len(names.value) + seen + np.arange(len(rare))
        at = at[ragged((np.cumsum(n_units) - n_units)[order], n_units[order])]
        return (pa.concat_arrays([b.column(0)]), at, n_units[order], text_hashes(b.column(1))), rare

    def cut(batches):
        first, bits = 0, sieve(piece_keys)
        for b in sized(batches, "text", STRETCH):
            texts, rare, seen = [], [], 0
            for piece in sized([b], "text", PIECE):
                found, more = numbered(piece, seen)
                texts.append(found)
                rare.append(more)
                seen += len(more)
            rare = pa.concat_arrays(rare).dictionary_encode()
            indices = rare.indices.to_numpy(zero_copy_only=False)
            for _, at, _, _ in texts:
                behind = at >= len(names.value)
                at[behind] = len(names.value) + indices[at[behind] - len(names.value)]
            parts, counts = parts_of(rare.dictionary, marks)
            parts = parts.dictionary_encode()
            of_part = pc.index_in(parts.dictionary, value_set=names.value)
            missing = strings(units_of(parts.dictionary.filter(of_part.is_null())))
            of_part = pc.fill_null(of_part, -1).to_numpy(zero_copy_only=False).copy()
            of_part[of_part < 0] = len(names.value) + np.arange(len(missing))
            numbers = of_part[parts.indices.to_numpy(zero_copy_only=False)]
            del rare, parts, indices, of_part
            yield from stretch_rows(missing, first, longest, bits, (numbers, counts), texts)
            first += len(missing)

    def join(batches):
        flat, counts = dictionary.value
        for _, more, n_more, held in fold.stretches(batches):
            if more is not None:                          # the ids of a stretch's units, by number
                numbers, n_parts = held
                ids, sizes = np.concatenate([flat, more]), np.concatenate([counts, n_more])
                more = ids[ragged((np.cumsum(sizes) - sizes)[numbers], sizes[numbers])]
                ends = np.append(0, np.cumsum(sizes[numbers]))[np.append(0, np.cumsum(n_parts))]
                unit_ids, sizes = np.concatenate([flat, more]), np.concatenate([counts, np.diff(ends)])
                starts = np.cumsum(sizes) - sizes
                continue
            doc_ids, at, n_units, own = held
            ids = unit_ids[ragged(starts[at], sizes[at])]
            ends = np.append(0, np.cumsum(sizes[at]))[np.append(0, np.cumsum(n_units))]
            decoded = pa.array(decode(ids, ends[1:]), pa.string())
            yield pa.RecordBatch.from_arrays(
                [doc_ids, lists(ids, np.diff(ends)), decoded, pa.array(n_units), pa.array(np.diff(ends)),
                 pa.array([d == o for d, o in zip(text_hashes(decoded), own)], pa.bool_())],
                names=["doc_id", "ids", "decoded", "n_units", "n_ids", "round_trip"])
    return lattice(src.mapInArrow(cut, STRETCHES), model).mapInArrow(
        join, f"doc_id {kind}, ids array<int>, decoded string, n_units long, n_ids long, round_trip boolean")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(table(spark, sf_dir, "documents"), Model())
