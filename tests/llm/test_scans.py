"""Licence scan (12) and source divergence (13) against plain versions."""
import random
import re
from collections import Counter

import pytest

from threadline.llm import op12_license as op12
from threadline.llm import op13_divergence as op13

# ---- 12 ------------------------------------------------------------------------
TEXTS = ["", None, "CC BY cc-by, CC/BY", "cc by " * 3000, "the General\nPublic (License) all rights RESERVED.", "cc byé", "ccby cc  by",
         "GNU General Public License, version 3.", "é中 all rights\treserved cc", "x" * 70_000 + " all rights reserved",
         "All rights all rights reserved reserved", "Licensed under CC BY-NC 4.0.", "a.b,c;d", "İ K all rights reserved"]


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places, labels = [], set()
    for phrase, label in op12.BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def test_op12_base_places_equal_brute_force(spark, tmp_path):
    rng = random.Random(12)
    parts = ["cc", "by", "BY", "general", "public", "license", "all", "rights", "reserved", "x", "é"]
    rows = TEXTS + ["".join(rng.choice(parts) + rng.choice([" ", "-", "\n", ", ", "_"]) for _ in range(rng.randrange(60)))
                    for _ in range(300)]
    df = spark.createDataFrame([(i if i % 7 else None, t, 1, "x") for i, t in enumerate(rows)],
                               "doc_id long, text string, n_words int, score string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))
           for r in op12.op12_license(spark, str(tmp_path)).collect()]
    want = [(i if i % 7 else None, plain(t)) for i, t in enumerate(rows)]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("text,labels,score", [
    ("", "", 0.0), ("nothing here", "", 0.0), ("Released under the MIT License.", "mit", 0.1),
    ("/* SPDX-License-Identifier: MIT OR Apache-2.0 */", "mit", 0.1),
    ("// SPDX-License-Identifier: MIT AND GPL-3.0-only", "gpl-3.0-only,mit", 0.6),
    ("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0", "gpl-2.0 with classpath-exception-2.0", 0.3),
    ("SPDX-License-Identifier: MIT OR GPL-3.0 AND AGPL-3.0", "mit", 0.1),
    ("SPDX-License-Identifier: (MIT OR GPL-3.0) AND AGPL-3.0", "agpl-3.0,mit", 0.7),
    ("SPDX-License-Identifier: ((MIT", "mit", 0.1), ("SPDX-License-Identifier: MIT OR", "mit", 0.1),
    ("SPDX-License-Identifier: MIT OR (", "mit", 0.1), ("SPDX-License-Identifier: ) MIT", "", 0.0),
    ("SPDX-License-Identifier: MIT) OR GPL-3.0", "mit", 0.1), ("SPDX-License-Identifier: Foo-1.0", "other", 0.5),
    ("License: see the file", "", 0.0), ("license = \"BSD-3-Clause\"", "bsd-3-clause", 0.1),
    ("License: MIT\nOR GPL-3.0", "mit", 0.1), ("SPDX-License-Identifier:", "", 0.0),
    ("SPDX-License-Identifier: MIT OR BSD-2-Clause", "bsd-2-clause,mit", 0.1),
    ("CC BY-NC-SA 4.0", "cc-by,cc-by-nc,cc-by-nc-sa", 0.85), ("All rights reserved. CC0", "cc0,reserved", 1.0),
])
def test_op12_labels_and_score(text, labels, score):
    got = op12.Scanner()(text.encode())
    assert ",".join(sorted(got[3])) == labels and got[5] == pytest.approx(score)


def test_op12_deep_and_long_expressions():
    scan = op12.Scanner()
    deep = "SPDX-License-Identifier: " + "(" * 50_000 + "MIT" + ")" * 50_000 + " AND GPL-3.0"
    assert scan(deep.encode())[3] == {"mit", "gpl-3.0"}
    wide = "SPDX-License-Identifier: " + " OR ".join(["GPL-3.0"] * 50_000 + ["MIT"])
    assert scan(wide.encode())[3] == {"mit"}


def test_op12_shunting_yard_equals_python():
    """Random expressions: `or` as minimum and `and` as maximum of the grades."""
    rng = random.Random(3)
    ids = ["mit", "apache-2.0", "mpl-2.0", "gpl-3.0", "agpl-3.0", "cc0"]

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            x = rng.choice(ids)
            return x, op12.grade(x)
        left, right = make(depth - 1), make(depth - 1)
        if rng.random() < 0.5:
            return f"({left[0]} OR {right[0]})", min(left[1], right[1])
        return f"({left[0]} AND {right[0]})", max(left[1], right[1])
    for _ in range(300):
        text, want = make(5)
        assert op12.Scanner.__call__(SCANNER, f"License: {text}".encode())[5] == want


SCANNER = op12.Scanner()


def test_op12_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op12.op12_license(spark, str(tmp_path)).count() == 0


# ---- 13 ------------------------------------------------------------------------
def divergence(rows, min_docs, top=10):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+",
             re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in seen.items() if n >= min_docs]
        v = len(kept)

        def shares(words):
            c = Counter(words)
            n = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // (n + 2 * v) for t in kept}, c
        groups = {s: shares([t for d in own if d[1] == s for t in d[2]]) for s in {d[1] for d in own}}
        q, _ = shares([t for d in own for t in d[2]])

        def f(a, b):
            return (a - b) ** 2 // (a + b)
        for s, (p, c) in groups.items():
            pairs = [(o, sum(f(p[t], groups[o][0][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, f(p[t], q[t])) for t in kept if c[t] and p[t] > q[t]]
            for part, items, k in (("pair", pairs, None), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:k], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def divergence_rows():
    rng = random.Random(13)
    words = ["The", "the", "Über", "naïve", "中文", "a1b", "x_y", "Z", "ÀB"] + [f"w{'abcdefghij'[i % 10]}{'klm'[i // 10]}" for i in range(30)]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["hot"] * 8 + ["s1", "s2", "S3", None, "中"]),
             " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(25)))) for _ in range(400)]
    return rows + [("en", "s9", None), ("fr", "a", "one two"), ("fr", "b", "one"), ("en", "s9", ""), ("es", "only", "x"),
                   ("en", "s8", "42 !"), ("en", "s8", "the " * 30_000)] + rows[:40]


@pytest.mark.parametrize("held", [op13.HELD, 7])
def test_op13_equals_brute_force(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(op13, "HELD", held)
    rows = divergence_rows()
    df = spark.createDataFrame([(None if i % 5 else 1, *r, i, 0) for i, r in enumerate(rows)],
                               "doc_id long, lang string, source string, text string, n long, term int")
    df.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in op13.op13_divergence(spark, str(tmp_path)).collect())
    assert got == divergence(rows, op13.MIN_DOCS)


def test_op13_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F
    cases = [(10 ** 14, 3 * 10 ** 15, 50_000), (0, 1, 1), (10 ** 18, 10 ** 18, 1), (7, 11, 0)]
    df = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", op13.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert [r.p for r in df.collect()] == [1 + 10 ** 9 * (c + 2) // (n + 2 * v) if v else None for c, n, v in cases]


def test_op13_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op13.op13_divergence(spark, str(tmp_path)).count() == 0
