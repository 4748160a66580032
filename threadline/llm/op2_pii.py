"""Operator 2: personal data by bootstrapped contextual extraction.

* Base: four fixed patterns give the seed entities of every whole text.
* Bootstrapping: a seed's neighbouring words are lexical patterns.  Spark keeps
  the graph pattern - instance (an identifier-like string, which may be written
  with spaces: a run of digit groups, or an address with "at" and "dot" as
  words, is one instance) and scores it for
  `ROUNDS` rounds: a pattern's confidence for a kind is the mean confidence of
  all its distinct instances, an instance's is the noisy-or over its trusted
  patterns; seeds stay at 1.  A pattern is trusted from `MIN_SEEDS` distinct
  seeds and `PATTERN_MIN` on.
* Instances that reach `INSTANCE_MIN` are unseen identifiers of that kind, and
  every occurrence becomes a span.  Base spans all stay.

A text is read once; the table of what was found in it (no text) is written to
the shared folder and is all that later steps shuffle.  Null text counts as
empty (no span).  Rows with null or repeated ids are handled each on its own.
Matches that fail their check are dropped without retry.  Every scan is linear
in the text, also in very long runs without white space.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.llm.common import columns, fresh, materialize, slices, table, texts_of

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SEEDS = 5
PATTERN_MIN = 0.8
INSTANCE_MIN = 0.8
CONTEXT = 60                     # characters looked at on either side for neighbouring words
LONG_WORD = 30                   # neighbours longer than this count as one word class

# The base kinds.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"\S++")
GROUP = r"[+(\[]*+[A-Z]{0,4}[0-9](?:[./()\[\]-]*[0-9A-Z)\]])*+"
RUN = re.compile(rf"(?<!\S){GROUP}(?:[ \t\xa0]{{1,3}}(?:[-/–][ \t\xa0]{{1,3}}|[A-Z]{{2,4}}[ \t\xa0]{{1,3}})?{GROUP})++(?![\w@])")
AT = re.compile(r"[ \t\xa0]{1,3}at[ \t\xa0]{1,3}|[ \t\xa0]{0,3}(?:@|[\[({<]at[\])}>])[ \t\xa0]{0,3}", re.I)
HOST = re.compile(r"(?=[0-9-]*+[a-z])[a-z0-9-]++(?:(?:[ \t\xa0]{1,3}dot[ \t\xa0]{1,3}|"
                  r"[ \t\xa0]{0,3}[\[({<]dot[\])}>][ \t\xa0]{0,3}|\.)[a-z][a-z0-9-]*+)++", re.I)
RUN_LETTERS = 34                 # letters and digits of the longest spaced identifier (IBAN)
GROUP_WIDTH = 14                 # a longer word in a run is an identifier by itself
EDGE = ".,;:!?()[]{}<>\"'`#$%&*=|~^/\\"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every base match, sorted."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        if at >= done:
            left = at
            while left > done and text[left - 1] in LOCAL:
                left -= 1
            m = DOMAIN.match(text, at + 1) if left < at else None
            if m:
                out.append((left, 0, m.end()))
                done = m.end()
        at = text.find("@", at + 1)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if 14 <= m.end() - m.start():
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def normal(word: str) -> str:
    return "<long>" if len(word) > LONG_WORD else DIGIT.sub("0", word.lower())


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: the word before, the two words before,
    and the words on both sides."""
    left = [normal(w) for w in text[max(0, start - CONTEXT):start].split()[-2:]]
    right = [normal(w) for w in text[end:end + CONTEXT].split()[:1]]
    out = []
    if left:
        out.append("l " + left[-1])
    if len(left) == 2:
        out.append("ll " + " ".join(left))
    if left and right:
        out.append(f"lr {left[-1]} _ {right[0]}")
    return out


def spelled(text: str) -> list[tuple[int, int]]:
    """Addresses with spaces, or with "at" and "dot" as words."""
    out, done = [], 0
    for m in AT.finditer(text):
        host = HOST.match(text, m.end()) if m.start() >= done else None
        if host:
            left = m.start()
            while left > done and text[left - 1] in LOCAL:
                left -= 1
            if left < m.start():
                out.append((left, host.end()))
                done = host.end()
    return out


def grouped(text: str, at: int, end: int) -> list[tuple[int, int]]:
    """Runs of digit groups in text[at:end] that may be one identifier."""
    out = []
    for m in RUN.finditer(text, at, end):
        word = m[0].strip(EDGE)
        start = m.start() + m[0].find(word)
        if start > m.start() and text[start - 1] in "([" and word.count(")") + word.count("]") > word.count("(") + word.count("["):
            start, word = start - 1, text[start - 1] + word          # (555) 010-9999
        if (len(word) >= 4 and len(DIGIT.findall(word)) >= 3 and sum(c.isalnum() for c in word) <= RUN_LETTERS
                and max(map(len, word.split())) <= GROUP_WIDTH):
            out.append((start, start + len(word)))
    return out


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like strings outside the base spans: spelled addresses, runs of
    digit groups, and other words that hold an @ or three digits."""
    digits = DIGIT.search(text)
    taken = sorted((s, e) for s, _, e in spans)
    out = without(spelled(text), taken)
    taken = sorted(taken + out)
    if digits:
        at, runs = 0, []
        for s, e in taken + [(len(text), len(text))]:
            if at < s:
                runs += grouped(text, at, s)
            at = max(at, e)
        out += runs
        taken = sorted(taken + runs)
    if digits or "@" in text:
        words = []
        for m in TOKEN.finditer(text):
            if "@" not in m[0] and len(DIGIT.findall(m[0])) < 3:
                continue
            word = m[0].strip(EDGE)
            start = m.start() + m[0].find(word) if word else m.start()
            if len(word) >= 4:
                words.append((start, start + len(word)))
        out += without(words, taken)
    return sorted(out)


def without(found: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of `found` that meet none of `taken`, both sorted."""
    out, k = [], 0
    for start, end in found:
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if not any(s < end and e > start for s, e in taken[k:k + 4]):
            out.append((start, end))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, base, found): `found` lists seeds (kind >= 0) and unknown
    identifiers (kind -1) with the hash of their string and their patterns."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def key(s: str) -> str:
        return hashlib.md5(s.encode("utf-8", "surrogatepass")).hexdigest()

    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    item = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                      ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])

    def fn(batches):
        for b in slices(batches):
            base, found = [], []
            for t in texts_of(b, "text"):
                spans = base_spans(t)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                found.append([{"kind": k, "start": s, "end": e, "instance": key(t[s:e]),
                               "patterns": patterns(t, s, e)}
                              for s, e, k in [(s, e, k) for s, k, e in spans]
                              + [(s, e, -1) for s, e in candidates(t, spans)]])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(item))],
                names=["doc_id", "base", "found"])
    return src.mapInArrow(
        fn, f"doc_id {dict(src.dtypes)['doc_id']}, base array<struct<start:int,kind:int,end:int>>, "
            "found array<struct<kind:int,start:int,end:int,instance:string,patterns:array<string>>>"
    ).withColumn("row", F.monotonically_increasing_id())


def bootstrap(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind): the unseen identifiers that trusted patterns discover."""
    item = found.select(F.explode("found").alias("f"))
    edges = materialize(
        item.select(F.explode("f.patterns").alias("pattern"), "f.instance", "f.kind").distinct(), "op2-edges")
    size = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("instances"))
    seeds = (edges.where("kind >= 0").groupBy("pattern", "kind")
             .agg(F.countDistinct("instance").alias("seeds")).where(F.col("seeds") >= MIN_SEEDS))
    trusted = materialize(seeds.join(size, "pattern"), "op2-patterns")     # patterns with enough seeds
    graph = materialize(edges.where("kind < 0").join(trusted.select("pattern").distinct(), "pattern", "left_semi")
                        .select("pattern", "instance").distinct(), "op2-graph")
    believed = None
    for _ in range(rounds):
        if believed is None:
            gain = trusted.select("pattern", "kind", F.lit(0.0).alias("gain")).limit(0)
        else:
            gain = (graph.join(believed, "instance").groupBy("pattern", "kind")
                    .agg(F.sum("confidence").alias("gain")))
        scored = (trusted.join(gain, ["pattern", "kind"], "left")
                  .withColumn("confidence", (F.col("seeds") + F.coalesce("gain", F.lit(0.0))) / F.col("instances"))
                  .where(F.col("confidence") >= PATTERN_MIN))
        # noisy-or; a certainty of 1 would leave a logarithm of 0
        believed = materialize(
            graph.join(scored.select("pattern", "kind", "confidence"), "pattern").groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.99)))))).alias("confidence")),
            "op2-instances")
    return (believed.where(F.col("confidence") >= INSTANCE_MIN)
            .groupBy("instance").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind")))


def joined(spans) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def discovered(found: DataFrame, key: str) -> DataFrame:
    """(key, more): spans of unseen identifiers, for the rows that have any."""
    return (found.select(key, F.explode("found").alias("f")).where("f.kind < 0")
            .select(key, "f.start", "f.end", "f.instance").join(bootstrap(found), "instance")
            .groupBy(key).agg(F.collect_set(F.struct("start", "kind", "end")).alias("more")))


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, base, all): base spans and all spans of every row, sorted."""
    found = materialize(find(docs, id_col, text_col), "op2-found")
    return (found.drop("found").join(discovered(found, "row"), "row", "left")
            .withColumn("all", F.when(F.col("more").isNull(), F.col("base"))
                        .otherwise(F.sort_array(F.concat("base", "more")))).drop("more"))


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets.

    Spans depend on the text alone: base spans are found again where the text
    lies, and only texts with discovered identifiers have a row to join, by the
    hash of the text."""
    key, more = fresh(docs, "_text_hash"), fresh(docs, "_more")
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    found = materialize(find(docs.select(hashed.alias("_key"), F.col(text_col).alias("_text")), "_key", "_text"),
                        "op2-found")
    extra = materialize(discovered(found.withColumnRenamed("doc_id", "key"), "key"), "op2-more")
    marked = (docs.withColumn(key, hashed)
              .join(extra.select(F.col("key").alias(key), F.col("more").alias(more)), key, "left").drop(key))

    def fn(batches):
        for b in slices(batches):
            out = []
            for t, spans in zip(*columns(b, text_col, more)):
                if t:
                    parts, at = [], 0
                    for s, k, e in sorted(base_spans(t) + [(x["start"], x["kind"], x["end"]) for x in spans or ()]):
                        if s >= at:
                            parts += [t[at:s], f"[{KINDS[k].upper()}]"]
                        at = max(at, e)
                    t = "".join(parts) + t[at:]
                out.append(t)
            i = b.schema.get_field_index(text_col)
            yield b.set_column(i, text_col, pa.array(out, pa.string())).drop_columns([more])
    schema = ", ".join(f"`{c}` {t}" for c, t in marked.drop(more).dtypes)
    return marked.mapInArrow(fn, schema).select(*docs.columns)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts, digest of the base spans and all spans."""
    rows = spans_of(docs, id_col, text_col)

    def of_kind(k: int):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", *[of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
