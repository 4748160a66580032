"""Extraction, tokens and packing: operators 2, 3, 5, 8."""
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadline.llm import op2_pii as op2
from threadline.llm import op3_html as op3
from threadline.llm import op5_sentencepiece as op5
from threadline.llm import op8_packing as op8


def plain_spans(t):
    """The base kinds by their patterns, as given."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10))
                                      for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_op2_base_equals_plain_patterns():
    rng = random.Random(4)
    pieces = ["a@b.c", "x.y+z@d-e.co.uk", "@", "1.2.3.4", "256.1.1.1", "4785380592391139", "4785-3805 9239 1139", "+1 (555) 010-9999",
              "+49 30 1234567", ".", " ", "-", "é", "\n", "7", "00.1.002.3", "_", "a@b", "1234567890123456789012", "٣"]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert op2.base_spans(t) == plain_spans(t), t
    assert op2.base_spans("9" * 300_000) == [] and op2.base_spans("a" * 300_000 + "@") == []
    assert op2.base_spans("1." * 50_000) == plain_spans("1." * 50_000)


def test_op2_discovers_identifiers_by_context(spark):
    rng = random.Random(6)
    rows = [(i, f"please ring +1 555 01{i:02d} {rng.randrange(1000, 9999)} tomorrow") for i in range(20)]
    rows += [(100, "please ring 0049/30/555-77 tomorrow"), (101, "invoice 2023/11/0455 was paid"), (102, None), (103, ""),
             (100, "please ring 0049/30/555-77 tomorrow"), (None, "mail me at joe@example.org")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).repartition(3)
    got = op2.personal_data(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[100].n_phone == 0
    start = rows[20][1].index("0049")
    assert by[100].spans == f"phone:{start}:{start + 14}" and by[100].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[101].spans == "" and by[102].spans == "" and by[103].spans == ""
    assert by[None].n_email == 1 and by[3].n_phone == 1
    masked = {r.doc_id: r.text for r in op2.mask(df).collect()}
    assert masked[100] == "please ring [PHONE] tomorrow"
    assert masked[None] == "mail me at [EMAIL]" and masked[102] is None
    assert op2.mask(df).columns == df.columns


def test_op2_documents_and_empty(documents, texts, no_documents):
    assert op2.personal_data(documents).count() == len(texts)
    assert op2.personal_data(no_documents).count() == 0 and op2.mask(no_documents).count() == 0


ARTICLE = ("<h1>A title</h1><p>First &amp; <b>bold</b>\n  words.</p><p>Be.</p><ul><li>point</li></ul>"
           "<aside>not this</aside><p>x &lt; y, caf&eacute;</p>")
WANT = "A title\nFirst & bold words.\nBe.\npoint\nx < y, café"


@pytest.mark.parametrize("page,want", [
    (f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a>menu</a></nav><div class=\"ad\">buy</div>"
     f"<article>{ARTICLE}<div class='comments'><p>reader</p></div></article><footer>&copy; us</footer></body></html>", WANT),
    (f"<header>site</header><nav><ul><li>a<li>b</ul></nav><div id=content>{ARTICLE}</div><script>var t='</p><p>no';</script>"
     f"<form><input><p>mail</p></form><div class=\"site-footer\">imprint</div>", WANT),
    (f"<body><nav>never closed<article>{ARTICLE}", WANT),
    ("<article><header><h1>In</h1></header><p>a <!-- <p>no</p> --> b</p></article>", "In\na b"),
    ("plain text only", "plain text only"), ("", ""), ("<p></p><br>", ""), ("a < b and <3", "a < b and <3"),
    ("<article><p>cut off <b", "cut off"),
])
def test_op3_pages(page, want):
    assert op3.main_text(page) == want


def test_op3_surge_and_dive():
    assert op3.surges([0, 0, 0, 0, 5, 0, 0, 7, 0, 0, 0, 0], 3) == [(2, 8)]
    assert op3.surges([1, 0, 0, 0, 1], 3) == [(0, 1), (2, 5)]
    long = "<article>" + "<p>word</p>" * 30_000 + "</article>"
    assert op3.main_text(long) == "\n".join(["word"] * 30_000)


def test_op3_query(spark):
    rows = [(1, "u", "<article><p>x</p></article>", 1), (2, None, None, 2), (None, "u", "", 3), (1, "u", "<article><p>x</p></article>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in op3.extract(df).collect())
    assert got == [("1", "x", 1), ("1", "x", 1), ("2", "", 0), ("None", "", 0)]
    assert op3.extract(df.limit(0)).count() == 0


def library():
    import public_tokenizers as files
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=files.path(op5.MODEL))


def test_op5_equals_the_library(spark, documents, texts, no_documents):
    sp, model = library(), op5.Model()
    extra = ["Hello  world", " a\n b\tc", "é ﬁ 中文 😀x", "a▁b\n\n c", "unbelievably antidisestablishmentarianism", "ab" * 90 + " x"]
    df = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string").union(
        documents.select("doc_id", "text"))
    whole = {}
    for r in op5.encode(df.where("doc_id is not null"), model).collect():
        whole.setdefault(r.row, []).append((r["at"], r.doc_id, r.ids))
    seen = sorted((v[0][1], [i for _, _, ids in sorted(v) for i in ids]) for v in whole.values())
    pairs = [(1000 + i, t) for i, t in enumerate(extra)] + texts
    assert seen == sorted((i, sp.encode(t)) for i, t in pairs if t and i is not None)
    got = sorted(((r.doc_id, r.n_ids, r.round_trip) for r in op5.digests(df, model).collect()), key=str)
    assert got == sorted(((i, len(sp.encode(t or "")), True) for i, t in pairs), key=str)
    assert op5.digests(no_documents, model).count() == 0


def test_op5_rare_units_by_shuffle_give_the_same_hash(documents, monkeypatch):
    want = sorted(map(str, op5.digests(documents, op5.Model()).collect()))
    monkeypatch.setattr(op5, "FREQUENT", 3)
    assert sorted(map(str, op5.digests(documents, op5.Model()).collect())) == want


def test_op5_viterbi_equals_dynamic_programme(spark):
    model = op5.Model()
    model.merges = False
    rng = random.Random(9)
    model.pieces = [(p, i, -rng.random() * 10) for p, i, _ in model.pieces]
    table = {p: (i, s) for p, i, s in model.pieces}
    units = ["▁" + "".join(rng.choice("etaonis") for _ in range(rng.randrange(1, 14))) for _ in range(60)] + ["▁" + "on" * 50]
    df = spark.createDataFrame([(u,) for u in sorted(set(units))], "unit string")
    for r in op5.encode_units(df, model).collect():
        best = [0.0]
        for end in range(1, len(r.unit) + 1):
            best.append(max(best[s] + table[r.unit[s:end]][1] for s in range(max(0, end - 16), end)
                            if r.unit[s:end] in table))
        names = {i: p for p, i, _ in model.pieces}
        assert "".join(names[i] for i in r.ids) == r.unit
        assert abs(sum(table[names[i]][1] for i in r.ids) - best[-1]) < 1e-9


def test_op8_pieces_and_packs(documents, texts, no_documents):
    import public_tokenizers as files
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    rows = op8.packing(documents, with_ids=True).collect()
    want = sorted((str(i), zlib.crc32(np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()))
                  for i, t in texts)
    by, packs = {}, {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, r.ids))
        packs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    got = []
    for (i, n), parts in by.items():
        ids = [x for _, p in sorted(parts) for x in p]
        assert len(ids) % n == 0
        if len(ids) == n:
            got.append((i, zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert set(got) <= set(want) and sum(r.length for r in rows) == sum(
        len(tk.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    for parts in packs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= op8.WIDTH
    assert op8.packing(no_documents).count() == 0


def test_op8_buckets_give_unique_places(documents, monkeypatch):
    monkeypatch.setattr(op8, "BUCKET_ROWS", 7)
    rows = op8.packing(documents, width=64).collect()
    places = {(r.sequence_id, r.offset) for r in rows}
    assert len(places) == len(rows)


def test_op8_encoder_special_strings():
    from tokenizers import Tokenizer
    encode = op8.Encoder("byte_bpe_50k")
    tk = Tokenizer.from_file(encode.json)
    rng = random.Random(7)
    alphabet = ["a", "Ab", "é", "ß", " ", "  ", "\n", "\t", "'s", "'ll", "1", "²", "½", "·", "!?", "\xa0", "\x85", "\x1c", "中", "😀",
                "<|endoftext|>", "_", "ÿ", "×"]
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(14)))
        assert np.frombuffer(encode(t), "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids, repr(t)


def test_op8_patterns_hold_the_histogram():
    rng = random.Random(1)
    for _ in range(30):
        hist = {rng.randrange(1, 65): rng.randrange(1, 500) for _ in range(rng.randrange(1, 40))}
        patterns = op8.spf_patterns(hist, 64)
        used = {}
        for p, n in patterns:
            assert sum(a * k for a, k in p) <= 64
            for a, k in p:
                used[a] = used.get(a, 0) + k * n
        assert used == hist and len(patterns) <= 3 * 64


def test_entities_are_those_of_the_library():
    assert op3.main_text("<p>&nbsp;a&#8212;b &am</p>") == " ".join(html.unescape("&nbsp;a&#8212;b &am").split())
