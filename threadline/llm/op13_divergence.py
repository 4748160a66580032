"""Operator 13: source divergence audit with a translate-table tokenizer.

1. Tokens.  `bytes.translate` lowers A-Z and blanks every separator in one pass,
   `bytes.split` cuts the terms, and a Counter per document gives its term
   frequencies: they add to the occurrences of the document's (lang, source)
   group, their keys to its document counts.  A task sends these sums, at most
   `HELD` terms at a time, so a hot source is added up before anything moves.
2. Counts.  Spark sums by (lang, term, source), dealt by (lang, term); a window
   over the same dealing gives each term's document count in its language, which
   decides if it is kept.  Only kept terms are written.
3. Shares.  p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)), in decimals of 38
   digits: exact for any count that fits a long.
4. Pairs, sparse.  With p0 the share of a term that a group lacks, a pair's sum
   over all V terms is V * f(p0, q0), plus what each of the two groups' own terms
   change (one row per distinct count of a group: terms with one count have one
   share), plus a correction for the terms that both hold.  Every part is a whole
   number, so the order of the sums doesn't matter.  A pair of sources is an
   output row by definition; terms that a group lacks cost nothing.
5. Terms.  A group's terms above the share of its language, best ten by value.

Null text, lang or source counts as ''.  Groups without terms take part with
count 0 everywhere; a language without kept terms has value 0 for every pair.
Rows that repeat, with or without an id, are documents of their own.  Ties go to
the item that is smaller in UTF-8.  An empty table gives no row.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadline.llm.common import materialize, partitions, slices, table

MIN_DOCS = 10                    # documents of its language that a kept term is in
UNIT = 1_000_000_000
TOP_TERMS = 10
HELD = 300_000                   # terms a task holds before it sends its sums

# One byte to one byte: separators to blanks, A-Z to a-z, all others as they are.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text."""
    return text.translate(LOWER).split()


def group_columns(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                         for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): partial sums of occurrences and documents of
    every task.  docs: (lang, source, text)."""
    def send(held: dict) -> pa.RecordBatch:
        lang, source, term, n, d = [], [], [], [], []
        for (g_lang, g_source), (total, seen) in held.items():
            lang += [g_lang] * len(total)
            source += [g_source] * len(total)
            term += total.keys()
            n += total.values()
            d += map(seen.__getitem__, total)
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()),
             pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "d"])

    def count(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        room = HELD
        for b in slices(batches):
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
                                          b.column(2).cast(pa.binary()).to_pylist()):
                own = Counter(tokens(text))
                total, seen = held.setdefault((lang, source), (Counter(), Counter()))
                room += len(total)
                total.update(own)
                seen.update(own.keys())
                room -= len(total)
                if room <= 0:
                    yield send(held)
                    held, room = {}, HELD
        if held:
            yield send(held)
    return docs.mapInArrow(count, "lang string, source string, term string, n long, d long")


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, source, n, lang_n) of the terms in at least min_docs
    documents of their language; a source's row only where it holds the term."""
    spark = docs.sparkSession
    dealt = term_counts(docs).repartition(partitions(spark), "lang", "term")
    counts = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    whole = Window.partitionBy("lang", "term")
    return (counts.withColumn("lang_n", F.sum("n").over(whole)).withColumn("lang_d", F.sum("d").over(whole))
            .where(F.col("lang_d") >= min_docs).drop("d", "lang_d"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count, N and V, exactly."""
    wide = "decimal(38,0)"
    over = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count.cast("decimal(20,0)") + F.lit(2).cast("decimal(1,0)")),
                           (total.cast("decimal(20,0)") + F.lit(2).cast("decimal(1,0)") * terms.cast("decimal(20,0)")).cast(wide))
    return F.when(terms > 0, over.cast("long") + 1)


def gap(p: Column, q: Column) -> Column:
    """f of two shares: at most 10^18 before the division."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, terms, lang_total, p0): every occurring group."""
    langs = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    return (docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
            .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total")])
            .withColumn("p0", share(zero, F.col("total"), F.col("terms"))))


def pair_values(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) for the pairs of sources a < b of a language.
    shares: (lang, term, source, n, p, p0)."""
    side = lambda x: groups.select("lang", F.col("source").alias(x), "terms", F.col("p0").alias(f"{x}0"))
    none = side("a").join(side("b").drop("terms"), "lang").where(F.col("a") < F.col("b")).select(
        "lang", "a", "b", F.coalesce(F.col("terms") * gap(F.col("a0"), F.col("b0")), F.lit(0)).alias("v"))
    # terms of one group, by count
    hist = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    own = hist.join(other, "lang").where(F.col("source") != F.col("other")).select(
        "lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"),
        (F.col("k") * (gap(F.col("p"), F.col("q0")) - gap(F.col("p0"), F.col("q0")))).alias("v"))
    # terms of both
    term = lambda x: shares.select("lang", "term", F.col("source").alias(x), F.col("p").alias(f"{x}p"),
                                   F.col("p0").alias(f"{x}0"))
    ap, a0, bp, b0 = (F.col(c) for c in ("ap", "a0", "bp", "b0"))
    both = term("a").join(term("b"), ["lang", "term"]).where(F.col("a") < F.col("b")).select(
        "lang", "a", "b", (gap(ap, bp) - gap(ap, b0) - gap(a0, bp) + gap(a0, b0)).alias("v"))
    parts = [x.groupBy("lang", "a", "b").agg(F.sum("v").alias("v")) for x in (own, both)]
    return none.union(parts[0]).union(parts[1]).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
               min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    src = group_columns(docs, text_col, lang_col, source_col)
    kept = materialize(kept_terms(src, min_docs), "op13-terms")
    groups = materialize(groups_of(src, kept), "op13-groups")
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    half = pair_values(shares.select("lang", "term", "source", "n", "p", "p0"), groups)
    pairs = half.select("lang", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value").select(
        "lang", "s.source", "s.item", "value")
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    terms = (shares.withColumn("q", q).where(F.col("p") > F.col("q"))
             .select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))
    ranked = pairs.withColumn("rank", F.row_number().over(best))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.withColumn("part", F.lit("pair")).select(*out).union(
        terms.withColumn("part", F.lit("term")).select(*out))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def sql_share(count: str, total: str, terms: str) -> str:
    return f"(1 + (CAST({UNIT} AS HUGEINT) * ({count} + 2)) // ({total} + 2 * {terms}))"


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, CAST(sum(lang_n) AS HUGEINT) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang)
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS n FROM x GROUP BY lang, source),
p AS (SELECT x.lang, x.source, x.term, x.n, {sql_share('x.n', 's.n', 'l.v')} AS p, {sql_share('x.lang_n', 'l.n', 'l.v')} AS q
      FROM x JOIN s ON s.lang = x.lang AND s.source = x.source JOIN l ON l.lang = x.lang),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
