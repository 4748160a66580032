"""Token queries: vocabulary, ids, padding, masks, T4, sub-words."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadline.functions.arrays import attention_mask, pad_or_truncate
from threadline.functions.text import clean_text
from threadline.operators import tokens as TK
from threadline.plans.catalog import register
from threadline.plans.sql_text import sql_clean_text
from threadline.session import materialize, spread, table

MAX_LEN = 64
WORDPIECE_SIZE = 30_522         # the size of the published sub-word vocabulary


def _cleaned(spark, sf):
    """X7 over all documents, written once to the shared folder: the
    vocabulary and the encoding both read it (the cleaning never runs twice,
    and a lost executor recomputes nothing upstream)."""
    d = spread(table(spark, sf, "documents"))
    return materialize(d.select("doc_id", clean_text("text").alias("cleaned_text")), "cleaned-docs")


def _words(spark, sf, cleaned=None):
    c = (cleaned if cleaned is not None else _cleaned(spark, sf)).where(F.col("cleaned_text").isNotNull())
    return c.withColumn("words", TK.words_of("cleaned_text"))


_SQL_WORDS = f"""WITH c AS (SELECT doc_id, {sql_clean_text('text')} AS cleaned_text FROM documents),
w AS (SELECT doc_id, cleaned_text, list_filter(string_split(cleaned_text, ' '), lambda x: x <> '') AS words
      FROM c WHERE cleaned_text IS NOT NULL),
cnt AS (SELECT token, count(*) AS n FROM (SELECT unnest(words) AS token FROM w) GROUP BY token),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER) AS id, n FROM cnt),
e AS (SELECT doc_id, unnest(words) AS tok, generate_subscripts(words, 1) AS pos FROM w),
ids AS (SELECT e.doc_id, list(coalesce(v.id, 1) ORDER BY e.pos) AS body
        FROM e LEFT JOIN vocab v ON v.token = e.tok GROUP BY e.doc_id),
enc AS (SELECT w.doc_id, w.cleaned_text, [2] || ids.body || [3] AS input_ids FROM w JOIN ids USING (doc_id)),
pad AS (SELECT doc_id, cleaned_text, input_ids,
               CASE WHEN len(input_ids) >= {MAX_LEN} THEN input_ids[1:{MAX_LEN}]
                    ELSE input_ids || list_transform(range({MAX_LEN} - len(input_ids)), lambda i: 0) END AS padded
        FROM enc)
"""


@register("build_vocab", sql=_SQL_WORDS + "SELECT token, id, n FROM vocab")
def q_build_vocab(spark, sf):
    return TK.build_vocab(_words(spark, sf))


@register("encode_words", sql=_SQL_WORDS + """
SELECT doc_id, array_to_string(input_ids, ' ') AS input_ids, CAST(len(input_ids) AS INTEGER) AS n_ids FROM enc""")
def q_encode_words(spark, sf):
    w = _words(spark, sf).select("doc_id", "words")
    enc = TK.encode(w, TK.build_vocab(w))
    return enc.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"),
                      F.size("input_ids").alias("n_ids"))


_PAD_OUT = """SELECT doc_id, array_to_string(padded, ' ') AS padded,
       array_to_string(list_transform(padded, lambda x: CAST(x > 0 AS INTEGER)), ' ') AS mask FROM pad"""


@register("pad_and_mask", sql=_SQL_WORDS + _PAD_OUT)
def q_pad_and_mask(spark, sf):
    w = _words(spark, sf).select("doc_id", "words")
    enc = TK.encode(w, TK.build_vocab(w))
    padded = enc.select("doc_id", pad_or_truncate("input_ids", MAX_LEN, TK.PAD_ID).alias("padded"))
    return padded.select("doc_id", F.array_join("padded", " ").alias("padded"),
                         F.array_join(attention_mask("padded"), " ").alias("mask"))


@register("max_token_length", sql=_SQL_WORDS + "SELECT CAST(max(len(input_ids)) AS BIGINT) AS max_len FROM enc")
def q_max_token_length(spark, sf):
    w = _words(spark, sf).select("words")
    return TK.max_token_length(TK.encode(w, TK.build_vocab(w)))


@register("convert_text", sql=_SQL_WORDS + """
SELECT doc_id, cleaned_text, array_to_string(padded, ' ') AS padded,
       array_to_string(list_transform(padded, lambda x: CAST(x > 0 AS INTEGER)), ' ') AS mask FROM pad""")
def q_convert_text(spark, sf):
    """T4 with the bounded explode (only words that survive truncation)."""
    cleaned = _cleaned(spark, sf)
    vocab = TK.build_vocab(_words(spark, sf, cleaned))
    out = TK.convert_text(cleaned, "text", vocab, MAX_LEN, cleaned=True)
    return out.select("doc_id", "cleaned_text", F.array_join("padded", " ").alias("padded"),
                      F.array_join("mask", " ").alias("mask"))


@register("convert_text_labelled", sql=_SQL_WORDS + """
, d AS (SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, quality, NULL FROM labels
        UNION ALL SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 3 = 0)
SELECT doc_id, quality, toxic, array_to_string(padded, ' ') AS padded,
       array_to_string(list_transform(padded, lambda x: CAST(x > 0 AS INTEGER)), ' ') AS mask
FROM d JOIN pad USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def q_convert_text_labelled(spark, sf):
    """T4 on a frame with label columns: they stay, a null in any column drops
    the row, and rows that repeat a key are encoded each on its own."""
    cleaned = _cleaned(spark, sf)
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    rows = lab.unionByName(lab.withColumn("toxic", F.lit(None).cast("int"))) \
        .unionByName(lab.where(F.col("doc_id") % 3 == 0)).join(cleaned, "doc_id")
    out = TK.convert_text(rows, "text", TK.build_vocab(_words(spark, sf, cleaned)), MAX_LEN, cleaned=True)
    return out.select("doc_id", "quality", "toxic", F.array_join("padded", " ").alias("padded"),
                      F.array_join("mask", " ").alias("mask"))


_BASIC = "[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\s]"


@register("wordpiece", sql=f"""
WITH c AS (SELECT doc_id, {sql_clean_text('text')} AS cleaned_text FROM documents),
tk AS (SELECT doc_id, regexp_extract_all(lower(cleaned_text), '{_BASIC}') AS tokens
       FROM c WHERE cleaned_text IS NOT NULL),
occ AS (SELECT doc_id, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS pos FROM tk),
wc AS (SELECT tok, count(*) AS n FROM occ GROUP BY tok),
top AS (SELECT tok FROM wc ORDER BY n DESC, tok LIMIT {WORDPIECE_SIZE}),
ch AS (SELECT DISTINCT unnest(string_split(tok, '')) AS c FROM wc),
pv AS (SELECT token, CAST(row_number() OVER (ORDER BY token) + 3 AS INTEGER) AS id FROM
       (SELECT tok AS token FROM top UNION SELECT c FROM ch UNION SELECT '##' || c FROM ch)),
fits AS (SELECT tok, max(l) AS l FROM (SELECT tok, unnest(range(1, len(tok) + 1)) AS l FROM wc WHERE len(tok) <= 100) p
         WHERE EXISTS (SELECT 1 FROM pv WHERE pv.token = substr(p.tok, 1, p.l)) GROUP BY tok),
step AS (SELECT tok, 0 AS i, substr(tok, 1, l) AS piece FROM fits
         UNION ALL SELECT tok, i, '##' || substr(tok, i, 1) FROM
           (SELECT tok, unnest(range(l + 1, len(tok) + 1)) AS i FROM fits)
         UNION ALL SELECT tok, 0, NULL FROM wc WHERE len(tok) > 100),
pieces AS (SELECT s.tok, list(coalesce(pv.id, 1) ORDER BY s.i) AS ids FROM step s LEFT JOIN pv ON pv.token = s.piece
           GROUP BY s.tok),
enc AS (SELECT o.doc_id, flatten(list(p.ids ORDER BY o.pos)) AS body FROM occ o JOIN pieces p USING (tok) GROUP BY o.doc_id)
SELECT tk.doc_id, CAST(len(tk.tokens) AS INTEGER) AS n_tokens, CAST(len(enc.body) + 2 AS INTEGER) AS n_ids,
       array_to_string([2] || enc.body || [3], ' ') AS input_ids FROM tk JOIN enc USING (doc_id)""")
def q_wordpiece(spark, sf):
    """T3 on the cleaned text: lower-cased basic tokens -> greedy longest-match
    sub-word ids against a corpus-counted vocabulary; every id of every row."""
    toks = _cleaned(spark, sf).where(F.col("cleaned_text").isNotNull()) \
        .select("doc_id", TK.basic_tokens("cleaned_text").alias("tokens"))
    vocab = TK.build_wordpiece_vocab(toks, "tokens", WORDPIECE_SIZE)
    out = TK.wordpiece(toks, "tokens", vocab)
    return out.select("doc_id", F.size("tokens").alias("n_tokens"), F.size("input_ids").alias("n_ids"),
                      F.array_join("input_ids", " ").alias("input_ids"))
