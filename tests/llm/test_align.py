"""Cross-tokenizer alignment (11) against the libraries' own encoders."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from threadline.llm import op11_alignment as op11

ODD = ["", None, "a▁b", "▁", " ", "  ", " x", "x ", "a  b   c", "\n", "a\n b", "a \n b", "a \n  b\t c ", "é 中文 😀x", "İ y  z",
       "<|endoftext|> <s> </s> <unk> <0x0A>", "don't it's I'll", "a\x00b", "a\x1c b \x1d c", "x" * 3000, " " * 2000, "ab " * 2000,
       "ﬁ Ａ ①", "́ é", "1234 56,78 9.", "\r\n\r\n  end",
       "a" + " " * 120 + "b", "a" + "\n" * 120, " \n" * 70 + "b\t" + "\u3000" * 110 + "c", "a " + "\n" * 110 + "b c" + "\x1c" * 60]


@pytest.fixture(scope="module")
def plain():
    """text -> (A ids, B ids, groups, links) from the files' own libraries."""
    import public_tokenizers as files
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=files.path(op11.TOKENIZER_B))
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    byte = {chr(c): b for b, c in [*[(b, b) for b in keep], *[(b, 256 + i) for i, b in enumerate(rest)]]}

    def spans(parts):
        out, at = [], 0
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    def encode(text):
        if not text:
            return [], [], [], []
        raw = (" " + text).encode()
        a = t.encode(" " + text, add_special_tokens=False).ids
        b = sp.encode(text)
        xs = [bytes(byte[c] for c in t.id_to_token(i)) for i in a]
        ys = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(xs) != raw or b"".join(ys) != raw:
            return [], [], [], []
        sa, sb = spans(xs), spans(ys)
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, lo = [], 0
        for e in ends:
            groups.append(",".join(str(i) for i, s in zip(a, sa) if lo <= s[0] < e) + "|"
                          + ",".join(str(i) for i, s in zip(b, sb) if lo <= s[0] < e))
            lo = e
        if len(a) * len(b) < 200_000:
            links = [(i, j) for i, x in zip(a, sa) for j, y in zip(b, sb) if x[0] < y[1] and y[0] < x[1]]
        else:
            owner = [j for j, y in enumerate(sb) for _ in range(y[0], y[1])]
            links = [(i, b[j]) for i, x in zip(a, sa) for j in sorted(set(owner[x[0]:x[1]]))]
        return a, b, groups, links
    return encode


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = ["the", "The", "naïve", "x1", "'s", "...", "\n", "\t", " ", " ", " ", "  ", "中", " ", "Ünï", "--", "7", "token", "ization", "\x1f"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("long", [op11.LONG, 20])
def test_units_encode_as_the_whole_text(plain, monkeypatch, long):
    """Ids, groups and links of texts by their units, encoded side by side."""
    monkeypatch.setattr(op11, "LONG", long)
    monkeypatch.setattr(op11, "LONG_RUN", re.compile(f"[{op11.BLANK}]{{{long},}}"))
    align = op11.Aligner()
    texts = ODD + random_texts(1500, 1)
    names = sorted({u for t in texts if t for u in op11.units(" " + t)})
    found = op11.Units(align, names, True)
    number = {u: i for i, u in enumerate(names)}
    links = {i: [] for i in range(len(names))}
    for key, unit in zip(found.links.tolist(), found.owners.tolist()):
        links[unit].append((key & 0xFFFF, key >> 16))
    for text in filter(None, texts):
        own = [number[u] for u in op11.units(" " + text)]
        assert "".join(" " + names[i] for i in own) == " " + text
        a, b, groups, pairs = plain(text)
        if found.broken[own].any():
            assert not a
            continue
        assert ";".join(found.groups[i] for i in own) == ";".join(groups)
        assert found.counts[:, own].sum(axis=1).tolist() == [len(a), len(b), len(groups), len(pairs)]
        assert Counter(x for i in own for x in links[i]) == Counter(pairs)


def test_runs_of_white_space_of_any_length():
    align = op11.Aligner()
    for text in (" " * 3_000_000, "a" + " \n" * 1_000_000 + "b", "x" * 300_000):
        unit, = op11.units(" " + text)
        a, b = align.encode(" " + unit)
        assert b"".join(align.bytes_a[i] for i in a) == b"".join(align.bytes_b[i] for i in b) == b" " + text.encode()
        found = op11.Units(align, [unit], False)
        n_a, n_b, n_groups, n_links = found.counts[:, 0].tolist()
        assert (n_a, n_b, n_links) == (len(a), len(b), n_a + n_b - n_groups) and len(found.links) == n_links


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2 ** 31, n, dtype=np.uint32))
    number = op11.PerfectHash.load(op11.PerfectHash.of(keys).dump())
    assert sorted(number(keys).tolist()) == list(range(len(keys)))
    if n > 1:
        ordered = np.empty_like(keys)
        ordered[number(keys)] = keys
        assert (ordered[op11.verified(number, ordered, keys)] == keys).all()
        with pytest.raises(ValueError):
            op11.verified(number, ordered, np.array([k for k in range(n + 1) if k not in set(keys.tolist())][:1], np.uint32))


@pytest.mark.parametrize("chunk,stretch,encoded,fan", [(op11.CHUNK_BYTES, op11.STRETCH, op11.ENCODED, op11.FAN), (4000, 900, 50, 2)])
def test_op11_equals_brute_force(spark, tmp_path, texts, plain, monkeypatch, chunk, stretch, encoded, fan):
    monkeypatch.setattr(op11, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(op11, "STRETCH", stretch)
    monkeypatch.setattr(op11, "ENCODED", encoded)
    monkeypatch.setattr(op11, "FAN", fan)
    rows = [(i, t) for i, t in texts if len(t or "") < 10_000] + [(1000 + i, t) for i, t in enumerate(ODD + random_texts(40, 2))]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (None, None)] + [(5000 + i, "copy of a text") for i in range(30)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, chunk string")
    df.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    found = [(i, plain(t)) for i, t in rows]
    total = Counter(x for _, r in found for x in r[3])
    most = Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    want = [(i, len(a), len(b), len(g), len(x), sum(total[y] == most[y[1]] for y in x), sum(total[y] for y in x),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, (a, b, g, x) in found]
    got = [tuple(r) for r in op11.op11_alignment(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    if fan > 2:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        pairs = {(r.a_id, r.b_id): (r.links, r.best) for r in op11.pair_counts(docs).collect()}
        assert pairs == {k: (n, n == most[k[1]]) for k, n in total.items()}
        shown = [(r.doc_id, r.groups) for r in op11.aligned(docs, with_groups=True).collect()]
        assert sorted(shown, key=str) == sorted([(i, ";".join(g)) for i, (_, _, g, _) in found], key=str)


def test_op11_empty_tables(spark, tmp_path):
    for name, rows in (("none", []), ("blank", [(1, None), (2, ""), (3, "▁")])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = sorted(tuple(r) for r in op11.op11_alignment(spark, f"{tmp_path}/{name}").collect())
        assert got == [(i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows]
