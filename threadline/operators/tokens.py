"""Vocabulary, token ids, padding and masks.

The reference downloads a pretrained vocabulary; here it is counted from the
corpus (or supplied as a table), whole by default.

Ids are looked up where the row lies: the most frequent words are a dictionary of
a bounded size, broadcast, and one vectorised look-up turns a row's words into its
ids.  Words beyond it leave holes and are listed beside the ids.  Only those are
exploded, joined to the rest of the vocabulary and sent back to their row; a row
without holes is never shuffled.  Sub-words need no join at all, since their vocabulary is bounded.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.functions.arrays import attention_mask, pad_or_truncate
from threadline.functions.text import clean_text
from threadline.session import materialize

# ---- fixed values: special token ids -----------------------------------------
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3
FIRST_WORD_ID = 4
# ------------------------------------------------------------------------------


BROADCAST_WORDS = 65_536        # words of the dictionary, always, of at most LONG_WORD letters
LONG_WORD = 40
HOLE = -1                       # an id that the dictionary doesn't hold
HELD_TOKENS = 50_000            # distinct tokens a task keeps the pieces of
STRETCH = 1 << 18               # words or tokens that a task works on at a time


def words_of(cleaned) -> Column:
    """Whole words of a cleaned text (cleaned text only holds ' ' as space)."""
    c = F.col(cleaned) if isinstance(cleaned, str) else cleaned
    return F.filter(F.split(c, " "), lambda w: w != F.lit(""))


def build_vocab(df: DataFrame, words_col: str = "words", size: int | None = None,
                min_count: int = 1) -> DataFrame:
    """(token, id, n).  Order: count desc, token asc; ids from 4.

    Word counts are a partial aggregate; ids come from the two-level rank, so no
    single task sorts the whole vocabulary.  By default every word has an id;
    `size` keeps the first ids only."""
    from threadline.operators.ranking import ranked
    counts = df.select(F.explode(words_col).alias("token")).groupBy("token") \
        .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    vocab = ranked(counts, [F.col("n").desc(), F.col("token").asc()], rank_col="__rank") \
        .select("token", (F.col("__rank") + FIRST_WORD_ID - 1).cast("int").alias("id"), "n")
    return vocab if size is None else vocab.where(F.col("id") < FIRST_WORD_ID + size)


def list_of(values: pa.Array, sizes: pa.Array) -> pa.ListArray:
    """Flat values as lists of the given sizes (a null list is empty)."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def give_back() -> None:
    """Return freed memory of this worker to the system: workers live on between
    stages, and what they keep counts against the executor."""
    import ctypes
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):                    # another C library: it keeps what it keeps
        pass


def stretches(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """A batch of lists in stretches of about STRETCH values (one list at least),
    so that what a worker holds beside a batch doesn't follow its size."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(lists):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STRETCH, side="right")))
        yield lists.slice(lo, hi - lo)
        lo = hi
    give_back()


def dictionary_ids(words: Column, dictionary) -> Column:
    """(ids, missing): the id of each word by a broadcast (words, ids), else HOLE,
    and the words at the holes in order; null for a null list."""
    @F.arrow_udf("struct<ids:array<int>,missing:array<string>>")
    def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, ids = dictionary.value
        for batch in batches:
            parts = []
            for words in stretches(batch):
                flat, sizes = words.flatten(), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
                found = pc.fill_null(ids.take(pc.index_in(flat, value_set=known)), HOLE)
                hole = pc.equal(found, HOLE)
                row = np.repeat(np.arange(len(words)), sizes)[hole.to_numpy(zero_copy_only=False)]
                holes = pa.array(np.bincount(row, minlength=len(words)), pa.int64())
                parts.append(pa.StructArray.from_arrays(
                    [list_of(found, pa.array(sizes)), list_of(flat.filter(hole), holes)],
                    names=["ids", "missing"], mask=words.is_null()))
            yield pa.concat_arrays(parts)
    return look_up(words)


def filled(ids: Column, found: Column) -> Column:
    """ids with its holes filled in order."""
    @F.arrow_udf("array<int>")
    def fill(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch, values in batches:
            flat = batch.flatten().to_numpy(zero_copy_only=False).copy()
            flat[flat == HOLE] = values.flatten().to_numpy(zero_copy_only=False)
            yield list_of(pa.array(flat, pa.int32()), pc.list_value_length(batch))
            give_back()
    return fill(ids, found)


def encode(df: DataFrame, vocab: DataFrame, words_col: str = "words", out: str = "input_ids",
           max_words: int | None = None) -> DataFrame:
    """[CLS] + ids + [SEP] beside all other columns, unknown -> [UNK]; no
    truncation unless `max_words` (then only the first max_words words are
    looked up -- what a later truncation keeps).  Rows with no words keep
    [CLS, SEP]; rows that repeat a key are encoded each on its own."""
    frequent = (F.col("id") < FIRST_WORD_ID + BROADCAST_WORDS) & (F.length("token") <= LONG_WORD)
    known = vocab.where(frequent).select("token", F.col("id").cast("int").alias("id")).toArrow().combine_chunks()
    dictionary = df.sparkSession.sparkContext.broadcast(tuple(
        pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in known.columns))
    words = F.col(words_col) if max_words is None else F.slice(words_col, 1, max_words)
    rows = df.withColumn("__at", dictionary_ids(words, dictionary)).drop(words_col) \
        .withColumns({"__ids": F.col("__at.ids"), "__missing": F.col("__at.missing")}).drop("__at")
    rest = vocab.where(~frequent)
    if rest.isEmpty():
        rows = rows.drop("__missing").withColumn(
            "__ids", F.transform("__ids", lambda i: F.when(i == HOLE, UNK_ID).otherwise(i)))
    else:
        # written, so that a row keeps its number; only the words at holes go with it
        rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "encoded")
        has_hole = F.size("__missing") > 0
        holes = rows.where(has_hole).select("__row", F.posexplode("__missing").alias("pos", "token"))
        found = holes.join(rest.select("token", "id"), "token", "left").groupBy("__row").agg(
            F.sort_array(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(UNK_ID)).cast("int").alias("id")))).alias("s"))
        mended = rows.where(has_hole).join(found.select("__row", F.col("s.id").alias("__found")), "__row") \
            .withColumn("__ids", filled(F.col("__ids"), F.col("__found")))
        whole = rows.where(F.coalesce(~has_hole, F.lit(True)))
        rows = whole.unionByName(mended.drop("__found")).drop("__row", "__missing")
    body = F.coalesce("__ids", F.array().cast("array<int>"))
    return rows.withColumn(out, F.concat(F.array(F.lit(CLS_ID)), body, F.array(F.lit(SEP_ID)))).drop("__ids")


def max_token_length(df: DataFrame, col: str = "input_ids") -> DataFrame:
    """A11."""
    return df.agg(F.max(F.size(col)).cast("long").alias("max_len"))


def convert_text(df: DataFrame, text_col: str, vocab: DataFrame, max_len: int = 64,
                 cleaned: bool = False) -> DataFrame:
    """T4: X7 -> N5 -> T2 -> R1 -> R2.  All columns stay; a row with a null in
    any of them goes.  Adds cleaned_text, padded and mask.

    Truncation is post, so only the first max_len - 1 words can survive; only
    those are looked up.  With `cleaned` the input already holds cleaned_text
    (e.g. a written table shared with the vocabulary job), so X7 runs once."""
    rows = df if cleaned else df.withColumn("cleaned_text", clean_text(text_col))
    rows = rows.dropna().withColumn("words", words_of("cleaned_text"))
    enc = encode(rows, vocab, max_words=max_len - 1)
    return enc.withColumn("padded", pad_or_truncate("input_ids", max_len, PAD_ID)) \
        .withColumn("mask", attention_mask("padded")).drop("input_ids")


# ---- T3: greedy longest-match sub-words -------------------------------------------

def basic_tokens(text) -> Column:
    """Lower-cased words and single punctuation marks."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s])"), 1)


def build_wordpiece_vocab(df: DataFrame, tokens_col: str, size: int) -> DataFrame:
    """Sub-word vocabulary counted from the corpus: the `size` most frequent
    tokens plus every single character, bare and as a '##' continuation, so
    every token can be decomposed.  (token, id).  At most size rows and two per
    character of the script, whatever the corpus."""
    toks = df.select(F.explode(tokens_col).alias("token"))
    words = toks.groupBy("token").agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.col("n").desc(), "token").limit(size).select("token")
    chars = toks.select(F.explode(F.split("token", "")).alias("c")).where(F.col("c") != "").distinct()
    pieces = words.unionByName(chars.select(F.col("c").alias("token"))) \
        .unionByName(chars.select(F.concat(F.lit("##"), "c").alias("token"))).distinct()
    from threadline.operators.ranking import ranked
    return ranked(pieces, [F.col("token")], rank_col="__rank") \
        .select("token", (F.col("__rank") + FIRST_WORD_ID - 1).cast("int").alias("id"))


MAX_CHARS = 100                 # longer words are unknown, as in the published algorithm


def wordpiece_split(word: str, vocab: dict) -> list[int]:
    """Greedy longest-match-first sub-words of one word (ids); [UNK] when some
    part cannot be matched or the word is too long."""
    if len(word) > MAX_CHARS:
        return [UNK_ID]
    out, start = [], 0
    while start < len(word):
        end, found = len(word), None
        while start < end:
            piece = word[start:end] if start == 0 else "##" + word[start:end]
            if piece in vocab:
                found = vocab[piece]
                break
            end -= 1
        if found is None:
            return [UNK_ID]
        out.append(found)
        start = end
    return out


class PieceTrie:
    """Greedy longest match in one pass over a word (LinMaxMatch, Song et al.,
    2021): a trie of the pieces whose failure links lead, where a word can't go
    on, to the node of what is left after the pieces that are sure by then."""

    def __init__(self, vocab: dict):
        self.vocab = vocab
        self.next: list[dict] = [{}, {}]                 # node 0: word starts, node 1: behind a piece
        self.piece: list[int | None] = [None, None]
        self.link: list[int] = [-1, -1]
        self.sure: list[tuple] = [(), ()]
        for token, number in vocab.items():
            node, rest = (1, token[2:]) if token.startswith("##") else (0, token)
            for c in rest:
                child = self.next[node].get(c)
                if child is None:
                    child = self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.piece.append(None)
                    self.link.append(-1)
                    self.sure.append(())
                node = child
            if rest:
                self.piece[node] = number
        queue = [0, 1]
        for node in queue:                               # breadth first
            for c, child in self.next[node].items():
                if self.piece[child] is not None:
                    self.link[child], self.sure[child] = 1, (self.piece[child],)
                else:
                    at, sure = self.link[node], self.sure[node]
                    while at >= 0 and c not in self.next[at]:
                        sure, at = sure + self.sure[at], self.link[at]
                    if at >= 0:
                        self.link[child], self.sure[child] = self.next[at][c], sure
                queue.append(child)

    def __call__(self, word: str) -> list[int]:
        if len(word) > MAX_CHARS:
            return [UNK_ID]
        if "#" in word:                                  # might spell the mark of a continuation
            return wordpiece_split(word, self.vocab)
        follow, link, sure = self.next, self.link, self.sure
        out: list[int] = []
        node = 0
        for c in word:
            while (child := follow[node].get(c)) is None:
                if link[node] < 0:
                    return [UNK_ID]
                out += sure[node]
                node = link[node]
            node = child
        while link[node] >= 0:
            out += sure[node]
            node = link[node]
        return out if node < 2 else [UNK_ID]


def wordpiece(df: DataFrame, tokens_col: str, vocab: DataFrame, out: str = "input_ids") -> DataFrame:
    """[CLS] + sub-word ids + [SEP] for every row, where it lies.  The
    vocabulary is bounded (its size, and two pieces a character of the script), so
    its trie is broadcast; a batch matches each distinct token once."""
    trie = df.sparkSession.sparkContext.broadcast(PieceTrie({r["token"]: r["id"] for r in vocab.select("token", "id").collect()}))

    @F.arrow_udf("array<int>")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        split, held = trie.value, {}
        for batch in batches:
            parts = []
            for lists in stretches(batch):
                tokens = lists.flatten().dictionary_encode()
                if len(held) > HELD_TOKENS:
                    held = {}
                own = []
                for t in tokens.dictionary.to_pylist():
                    if t not in held:
                        held[t] = array("i", split(t))
                    own.append(held[t])
                of_token = list_of(pa.array(np.concatenate([*own, np.zeros(0, np.int32)]), pa.int32()),
                                   pa.array([len(x) for x in own], pa.int64())).take(tokens.indices)
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(of_token).to_numpy(zero_copy_only=False))])
                at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
                parts.append(pa.ListArray.from_arrays(pa.array(ends[at], pa.int32()), of_token.flatten()))
            yield pa.concat_arrays(parts)
    return df.withColumn(out, F.concat(F.array(F.lit(CLS_ID)), pieces(F.col(tokens_col)), F.array(F.lit(SEP_ID))))
