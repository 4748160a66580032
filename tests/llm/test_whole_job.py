"""The whole job: results that a shorter way would leave out."""
import random

import pytest
from pyspark.sql import functions as F

from threadline.llm import op2_pii as op2
from threadline.llm import op3_html as op3
from threadline.llm import op5_sentencepiece as op5
from threadline.llm import op9_toxicity as op9


@pytest.mark.parametrize("frequent", [op5.FREQUENT, 3])
def test_op5_documents_hold_ids_and_decoded_text(spark, documents, texts, monkeypatch, frequent):
    import public_tokenizers as files
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=files.path(op5.MODEL))
    monkeypatch.setattr(op5, "FREQUENT", frequent)
    extra = ["Hello  world", " two  leading", "  x ", "a▁b", "▁", "\n a\n", "é 中文 😀x", "ab" * 90 + " x"]
    pairs = [(1000 + i, t) for i, t in enumerate(extra)] + texts
    df = spark.createDataFrame(pairs[:len(extra)], "doc_id long, text string").union(documents.select("doc_id", "text"))
    got = op5.documents(df, op5.Model()).collect()
    want = [(i, sp.encode(t or ""), sp.decode(sp.encode(t or "")), len(sp.encode(t or "")),
             sp.decode(sp.encode(t or "")) == (t or "")) for i, t in pairs]
    assert sorted(((r.doc_id, r.ids, r.decoded, r.n_ids, r.round_trip) for r in got), key=str) == sorted(want, key=str)
    assert not {r.doc_id: r.round_trip for r in got}[1003]


@pytest.mark.parametrize("page,want", [
    ('<article><p class="ad">x<p>Real one</p><p>Real two</p></article>', "Real one\nReal two"),
    ('<article><p class="ad">x<div>Real one</div><p>Real two</p></article>', "Real one\nReal two"),
    ('<div><div class="ad">x<p>y</div><p>Real one</p><p>Real two</p>', "Real one\nReal two"),
    ('<div><nav>menu<p>y</div><p>Real one</p><p>Real two</p>', "Real one\nReal two"),
    ('<article><ul><li><span class="ad">x<li>Real one<li>Real two</ul></article>', "Real one\nReal two"),
    ('<article><table><tr><td><p class="ad">x<td>Real one<tr><td>Real two</table></article>', "Real one\nReal two"),
    ('<article><p>Real one</p><section class="related"><article>card</article></section><p>Real two</p></article>',
     "Real one\nReal two"),
    ("<head><meta charset=x><body><p>Real one<p>Real two", "Real one\nReal two"),
    ("<div><article><p>Real one</p></div><p>Real two</p></article><p>after</p>", "Real one\nReal two"),
    ('<article><div class="ad"><p>x<ul><li>y<li>z</ul><div>w</div></div><p>Real one</p><p>Real two</article>',
     "Real one\nReal two"),
])
def test_op3_open_elements(page, want):
    assert op3.main_text(page) == want


LONG_PART = "<p>" + "many words of the middle part " * 20 + "</p>"
LONG_LINE = ("many words of the middle part " * 20).strip()


@pytest.mark.parametrize("page,want", [
    (f'<body><div id="content"><p>Short.</p><div class="ad">buy</div>{LONG_PART}<aside>x</aside><p>End.</p></div>',
     f"Short.\n{LONG_LINE}\nEnd."),
    (f"<body><p>Short.</p><form>mail</form><aside>x</aside>{LONG_PART}<aside>x</aside><p>End.</p>",
     f"Short.\n{LONG_LINE}\nEnd."),
    (f'<div id="c"><div><p>Short.</p></div><aside>x</aside><div>{LONG_PART}</div></div>', f"Short.\n{LONG_LINE}"),
    (f'<div id="page"><div>Site</div><nav>x</nav><div id="c">{LONG_PART}</div><form>x</form><div>(c) us</div></div>', LONG_LINE),
    ('<article><section id="related-work"><p>a</p></section><section id="binary-search"><p>b</p></section>'
     '<div class="article-header"><h1>c</h1></div><div class="header"><h1>d</h1></div><div class="ads wide">no</div>'
     '<div class="ad-banner">no</div><div id="comments">no</div><div role="navigation">no</div></article>', "a\nb\nc\nd"),
])
def test_op3_parts_of_the_article_stay(page, want):
    assert op3.main_text(page) == want


@pytest.mark.parametrize("counterparts", [0, 2])
def test_op9_swaps_into_terms_the_sample_lacks(spark, counterparts):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        w = [f"w{rng.randrange(30)}" for _ in range(12)]
        toxic = rng.random() < 0.4
        if rng.random() < (0.9 if toxic else 0.05):
            w[0] = "muslims"
        if toxic and rng.random() < 0.9:
            w[1] = rng.choice(["idiot", "scum"])
        rows.append((i, " ".join(w), int(toxic)))
    rows += [(600 + i, "christians w1 w2", 0) for i in range(counterparts)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    plain, fair = (op9.fit(docs, labels, counterfactual=c)[0] for c in (0.0, 1.0))
    assert plain["muslims"] > 1 and 0 <= fair["muslims"] < 0.5 * plain["muslims"]
    assert "christians" not in fair and fair["idiot"] > 1
    weak = op9.fit(docs, labels, counterfactual=20.0)
    probe = spark.createDataFrame([("muslims w3 w4",), ("christians w3 w4",)], "text string")
    a, b = (r.score for r in op9.score(probe, weak).collect())
    assert abs(a - b) < 0.05


def test_op2_identifiers_written_with_spaces(spark):
    rng = random.Random(6)
    rows = [(i, f"please ring +1 555 01{i:02d} {rng.randrange(1000, 9999)} tomorrow") for i in range(60)]
    rows += [(100 + i, f"then mail u{i}@example.org today") for i in range(60)]
    rows += [(200 + i, f"their card {n} expires") for i, n in enumerate(
        ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "6011 0000 0000 0004", "4012 8888 8888 1881",
         "4222 2222 2222 2220", "5555 5555 5555 4444", "5105 1051 0510 5100", "4000 0566 5566 5556", "4242 4242 4242 4242"])]
    cases = {300: ("please ring (555) 010-9999 tomorrow", "please ring [PHONE] tomorrow"),
             301: ("please ring 030 123 4567 tomorrow", "please ring [PHONE] tomorrow"),
             302: ("please ring 030 - 123 45, tomorrow", "please ring [PHONE], tomorrow"),
             303: ("then mail joe at example dot org today", "then mail [EMAIL] today"),
             304: ("then mail joe.b [at] example [dot] co.uk today", "then mail [EMAIL] today"),
             305: ("their card DE89 3704 0044 0532 0130 00 expires", "their card [CARD] expires"),
             306: ("they sold 031 123 4567 units", "they sold 031 123 4567 units"),
             307: ("look at me", "look at me")}
    df = spark.createDataFrame(rows + [(i, t) for i, (t, _) in cases.items()], "doc_id long, text string").repartition(3)
    masked = {r.doc_id: r.text for r in op2.mask(df).collect()}
    assert {i: masked[i] for i in cases} == {i: want for i, (_, want) in cases.items()}
    spans = {r.doc_id: r.spans for r in op2.personal_data(df).collect()}
    assert spans[300] == "phone:12:26" and spans[306] == ""


def test_op2_candidates():
    def found(text):
        return [text[s:e] for s, e in op2.candidates(text, op2.base_spans(text))]
    assert found("tel (555) 010-9999.") == ["(555) 010-9999"]
    assert found("in 2019, 2020 and 5 men") == ["2019", "2020"]
    assert found("net 10.0.0.1 8080 9090 x") == ["8080 9090"]
    assert found("DE89 3704 0044 0532 0130 00") == ["DE89 3704 0044 0532 0130 00"]
    assert found("write to joe @ example.org or a@b dot org, not at 10.30") == ["joe @ example.org", "a@b dot org", "10.30"]
    assert found(" ".join(["123456"] * 9)) == ["123456"] * 9
    assert found("7536784127813051 4845168114407320") == ["7536784127813051", "4845168114407320"]
    for text in ("1 " * 200_000, "(" * 200_000, "1(" * 200_000, " " * 200_000 + "at", "a at " * 100_000, "a at a dot " * 50_000):
        found(text)


PART = "<p>" + "many words of the middle part " * 20 + "</p>"
LINE = ("many words of the middle part " * 20).strip()


@pytest.mark.parametrize("page,want", [
    (f"<body><form id=aspnetForm><div>{PART}<p>End.</p></div></form>", LINE + "\nEnd."),
    (f"<form><form><div class='x-sidebar'>{PART}</div></form>", LINE),
    (f"<div>{PART}<form><p>mail us</p></form></div>", LINE),
    (f'<div class="page-with-sidebar">{PART}</div>', LINE), (f'<div class="has-header content">{PART}</div>', LINE),
    (f'<div>{PART}<section class="side-effects"><p>Side.</p></section><div class="search-results"><p>Found.</p></div></div>',
     LINE + "\nSide.\nFound."),
    (f'<div id="c">{PART}<div class="left-sidebar"><p>menu</p></div><div class="site-header"><p>x</p></div></div>', LINE),
    (f'<div>{PART}<div class="post-comments">{PART * 5}</div></div>', LINE),
    ("<article><canvas><p>a</p></article><canvas>", "a"), ("<body><canvas><article><p>a</p><p>b</p></article>", "a\nb"),
    ("<article><canvas id=x>no</canvas><svg/><p>a</p></article>", "a"), ("<p>a <svg><text>no</text></svg>b</p>", "a b"),
    (f"<article><p>x</p><div><canvas></div>{PART}</article>", "x\n" + LINE),
    ("<p>\u0130\u0130\u0130</p><SCRIPT>x</Script><p>Hello world this</p>", "\u0130\u0130\u0130\nHello world this"),
])
def test_op3_keeps_the_page(page, want):
    assert op3.main_text(page) == want


def test_op3_many_wrappers():
    assert op3.main_text("<form>" * 3000 + "<p>x</p>") == "x"


def test_pipeline_removes_rows_not_ids(spark):
    """Two documents under one id: the copy of another goes, the unique one
    stays; rows without an id all stay."""
    import corpus_pipeline
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text), (2, "quite another text of its own that nothing else is like"), (None, text), (3, text + " w60")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[3]], key=str)


def test_op9_with_labels_of_one_class(spark):
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(20)], "doc_id long, text string")
    for y in (0, 1):
        labels = spark.createDataFrame([(i, y) for i in range(20)], "doc_id long, toxic int")
        got = op9.toxicity(docs, labels).collect()
        assert len(got) == 20 and all(r.predicted == y and abs(r.score - y) < 1e-9 for r in got)
    assert [r.score for r in op9.toxicity(docs, labels.limit(0)).limit(2).collect()] == [0.0, 0.0]


def test_op5_shuffles_no_text_and_no_ids(documents):
    plan = op5.documents(documents, op5.Model())._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Generate" in plan
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_op5_names_of_units():
    import re

    import pyarrow as pa
    rng = random.Random(3)
    texts = ["".join(rng.choice([" ", "\n", "ab", "c", "▁", "\0"][:rng.choice([4, 6])]) for _ in range(rng.randrange(9)))
             for _ in range(3000)] + [None]
    names, sizes, order = op5.keys_in(pa.array(texts, pa.string()))
    names, ends = names.to_pylist(), sizes.cumsum()
    for t, i in zip(texts, order):
        units = re.findall(op5.UNIT, op5.MARK + t.replace(" ", op5.MARK)) if t else []
        assert [op5.unit_of(k) for k in names[ends[i] - sizes[i]:ends[i]]] == units


def test_op5_edges_of_another_string_go():
    """Two strings of one hash: the edge is there, its characters are others."""
    import numpy as np
    model = op5.Model()
    fold = op5.Fold(model)
    ids = {p: i for p, i, _ in model.pieces}
    true = [(0, ids["th"]), (1, ids["the"])]                       # places: th, the, he
    false = [(1, ids["ing"]), (2, ids["th"]), (0, ids["the"])]
    edges = [np.array([(place << op5.ID_BITS) + i for place, i in e]) for e in (true, true + false)]
    tables = [op5.Lattice(["the"], 0, e, fold).ids for e in edges]
    assert (tables[0] == tables[1]).all() and tables[0][0, 2] == ids["th"] and tables[0][0, 3] == ids["the"]


@pytest.mark.parametrize("text", ["word. word, word; a.b,c (d) e-mail: 3.14 5,000! x_y z\"", "été, 中文。 ½. x²,y"])
def test_op5_cuts_before_marks(spark, text):
    import public_tokenizers as files
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=files.path(op5.MODEL))
    assert op5.Model().closers().split("▁word,") == ["▁word", ","]
    row = op5.documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), op5.Model()).first()
    assert row.ids == sp.encode(text) and row.round_trip


def test_op5_join_sees_little_but_edges(spark):
    """Rows of the join: no more than the pieces inside the units and a few, and twice the units make twice the rows."""
    model = op5.Model()
    rng, pieces = random.Random(4), {p for p, _, _ in model.pieces}
    words = sorted({"".join(rng.choice("etaonisrhl") for _ in range(12)) for _ in range(2000)})
    made = []
    for units in (words[:len(words) // 2], words):
        bits, rows = op5.sieve(model.keys([p for p in pieces if len(p) > 1])), 0
        for b in op5.stretch_rows(units, 0, model.longest, bits, None):
            rows += len(b.column(1).flatten())
        edges = sum(u[i:j] in pieces for u in units for i in range(len(u)) for j in range(i + 2, len(u) + 1))
        assert edges <= rows <= 1.1 * edges
        made.append(rows)
    assert made[1] <= 2.2 * made[0]


def test_op5_held_rows_are_small(spark, monkeypatch):
    """What a stretch of texts needs after the fold goes through the lattice in small rows, whatever the
    stretch holds, and the piece table needs no Python on the executors."""
    rng, seen = random.Random(8), []
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(20_000)) for _ in range(80)]          # 3.2 MB
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    lattice = op5.lattice
    monkeypatch.setattr(op5, "lattice", lambda stretches, model: seen.append(stretches) or lattice(stretches, model))
    op5.documents(df, op5.Model())
    held = [len(r.held) for r in seen[-1].where("held is not null").collect()]
    assert len(held) >= 7 and max(held) < 3 * op5.PIECE             # a unit has two bytes here
    assert "ExistingRDD" not in op5.Model().table(spark)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("piece", [1, 300])
def test_op5_pieces_of_a_stretch_give_the_same_rows(spark, monkeypatch, piece):
    import public_tokenizers as files
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=files.path(op5.MODEL))
    rng = random.Random(9)
    texts = [rng.choice(["", " "]).join(rng.choice(["the", "word,", " two", "\n", "été", "½中", "a.b", "rare" + str(i % 7)])
                                        for _ in range(rng.randrange(60))) for i in range(60)]
    rows = [(f"d{i}", t) for i, t in enumerate(texts + [None, "", "x y " * 400, "marks \u2581 here"])] + [(None, "two"), ("d1", texts[1])]
    df = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    monkeypatch.setattr(op5, "PIECE", piece)
    got = op5.documents(df, op5.Model()).collect()
    want = [(i, sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for i, t in rows]
    assert [(r.doc_id, r.ids, r.decoded) for r in got] == want
    assert [(r.n_ids, r.round_trip) for r in got] == [(len(x), d == (t or "")) for (_, t), (_, x, d) in zip(rows, want)]


def test_op5_texts_of_arrow_arrays():
    import hashlib

    import pyarrow as pa
    texts = ["", "é", "中😀 x", "\n", "\0a", "", "▁word,"]
    for lo, hi in ((0, 7), (2, 5), (3, 3)):
        part = pa.array([None, *texts])[1 + lo:1 + hi]
        assert op5.strings(part) == texts[lo:hi]
        assert op5.text_hashes(part) == [hashlib.sha256(t.encode()).digest() for t in texts[lo:hi]]
    assert op5.text_hashes(pa.array([None, "x"])) == [hashlib.sha256(t).digest() for t in (b"", b"x")]


def test_op5_pieces_have_keys_of_their_own(spark):
    keys = [r.key for r in op5.Model().table(spark).collect()]
    assert len(set(keys)) == len(keys)


def test_op5_parts_of_units():
    import pyarrow as pa
    model, rng = op5.Model(), random.Random(6)
    keys = ["\n", "word,", "a.b,c", "e-mail:"] + [rng.choice(["", "\n"]) + "".join(
        rng.choice("ab1,.é_-▁x!\"]\\^中") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    parts, counts = op5.parts_of(pa.array(keys), model.marks())
    units, ends, between = op5.units_of(parts).to_pylist(), counts.cumsum(), model.closers()
    for k, n, end in zip(keys, counts, ends):
        assert units[end - n:end] == between.split(op5.unit_of(k))
