"""Operator 12: licence scan with an Aho-Corasick automaton and expressions
evaluated by a shunting-yard parser.

1. Words.  A text's bytes are lowered (A-Z only) and its separators blanked by a
   translate table; its words are joined by single blanks.
2. Notice phrases.  One automaton over all phrases (blank on both sides) reads
   the words once and yields every place of every phrase, overlaps included; the
   word number of a place is the blanks before it, counted on from the last.
   `BASE` phrases are those the counts go by, `NOTICES` add labels.
3. Identifier tags.  A second automaton reads the lowered text itself, where the
   punctuation of tags and expressions still stands.
4. Expressions.  After a tag, operands (licence ids), brackets and the operators
   `or` < `and` < `with` are put into postfix order by a shunting yard with an
   explicit stack, so no depth of brackets is too deep, and evaluated: `and` joins
   the labels and takes the stricter grade, `or` takes the freer operand (both
   labels on a tie), `with` eases the grade of a licence by its exception.
   Reading stops at the first token that doesn't fit; open brackets are closed
   there and an operator without a right operand goes.  Behind the plain tags
   (`license:`), an expression counts only if its ids are known; behind an
   SPDX tag unknown ids are labelled `other`.

score: 0 where nothing is found or all is free, up to 1 for all rights reserved:
the strictest grade of all notices and expressions of the document.

Null text counts as empty: no words, no labels ('' and ''), score 0, first_word
and last_word null.  Every row is scanned on its own, whatever its id; repeated
rows give repeated results.  Rows are never shuffled.  An empty table gives no
row.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.llm.common import slices, table

# One byte to one byte: A-Z to a-z, 0-9, a-z and all bytes from 0x80 on as they are, others to blanks.
WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
              for b in range(256))
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

# ---- fixed values: the phrases that counts go by, and their labels ------------
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# --------------------------------------------------------------------------------

NOTICES = {
    "mit license": "mit", "permission is hereby granted free of charge to any person": "mit",
    "apache license": "apache", "apache software license": "apache", "apache license version 2 0": "apache-2.0",
    "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd", "isc license": "isc",
    "general public license version 2": "gpl-2.0", "general public license version 3": "gpl-3.0",
    "lesser general public license": "lgpl", "affero general public license": "agpl",
    "free documentation license": "gfdl", "mozilla public license": "mpl", "eclipse public license": "epl",
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd", "creative commons attribution": "cc-by", "cc0": "cc0",
    "creative commons zero": "cc0", "public domain": "public-domain", "unlicense": "unlicense",
    "proprietary and confidential": "proprietary", "no part of this work may be reproduced": "proprietary",
}

# Grade of a label, by its longest family name: 0 free to 1 all rights reserved.
GRADES = {
    "public-domain": 0.0, "cc0": 0.0, "unlicense": 0.0, "0bsd": 0.0, "mit": 0.1, "bsd": 0.1, "isc": 0.1, "zlib": 0.1,
    "x11": 0.1, "apache": 0.15, "python": 0.15, "psf": 0.15, "artistic": 0.2, "cc-by": 0.2, "ofl": 0.25, "mpl": 0.4, "epl": 0.4,
    "cddl": 0.4, "lgpl": 0.45, "eupl": 0.5, "cc-by-sa": 0.5, "gfdl": 0.55, "gpl": 0.6, "osl": 0.6, "agpl": 0.7, "sspl": 0.8,
    "cc-by-nd": 0.8, "cc-by-nc": 0.8, "cc-by-nc-sa": 0.85, "cc-by-nc-nd": 0.9, "busl": 0.8, "licenseref": 0.9,
    "proprietary": 1.0, "reserved": 1.0,
}
OTHER, OTHER_GRADE = "other", 0.5
EASED = 0.5                      # what an exception leaves of its licence's grade

TAGS = {"spdx-license-identifier": True, "license-expression": True, "license": False, "licence": False}   # True: any id
AFTER_TAG = re.compile(rb"[\x20\t]*[:=][\x20\t\"']*")
TOKEN = re.compile(rb"[\x20\t]*([()]|[a-z0-9][a-z0-9.+-]*)")
RANK = {b"or": 1, b"and": 2, b"with": 3}


def grade(label: str) -> float | None:
    """Grade of a licence id, None if its family is unknown."""
    parts = re.split(r"[-.+]", label)
    for k in range(len(parts), 0, -1):
        if (family := "-".join(parts[:k])) in GRADES:
            return GRADES[family]
    return None


def postfix(text: bytes, at: int) -> list[bytes]:
    """The expression that starts at `at`, in postfix order (lowered text)."""
    out: list[bytes] = []
    stack: list[bytes] = []
    operand = True                                   # what may come next
    while m := TOKEN.match(text, at):
        token, at = m.group(1), m.end()
        if operand:
            if token == b"(":
                stack.append(token)
            elif token == b")" or token in RANK:
                break
            else:
                out.append(token)
                operand = False
        elif token in RANK:
            while stack and stack[-1] != b"(" and RANK[stack[-1]] >= RANK[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        elif token == b")" and b"(" in stack:
            while stack[-1] != b"(":
                out.append(stack.pop())
            stack.pop()
        else:
            break
    if operand:                                      # operators and brackets without an operand to their right
        while stack and stack[-1] == b"(":
            stack.pop()
        if stack:
            stack.pop()
    return out + [t for t in reversed(stack) if t != b"("]


def evaluate(tokens: list[bytes], any_id: bool) -> tuple[frozenset[str], float] | None:
    """(labels, grade) of a postfix expression; None if it holds nothing that
    counts."""
    stack: list[tuple[frozenset[str], float]] = []
    for i, token in enumerate(tokens):
        if token not in RANK:
            label = token.decode()
            g = grade(label)
            if tokens[i + 1:i + 2] == [b"with"]:     # an exception, not a licence
                stack.append((frozenset([label]), EASED))
                continue
            if g is None and not any_id:
                return None
            stack.append((frozenset([label if g is not None else OTHER]), OTHER_GRADE if g is None else g))
            continue
        (right, gr), (left, gl) = stack.pop(), stack.pop()
        if token == b"with":
            stack.append((frozenset(f"{a} with {b}" for a in left for b in right), gl * gr))
        elif token == b"and":
            stack.append((left | right, max(gl, gr)))
        elif gl == gr:
            stack.append((left | right, gl))
        else:
            stack.append((left, gl) if gl < gr else (right, gr))
    return stack[-1] if stack else None


class Scanner:
    """Both automata, built once a task."""

    def __init__(self):
        import ahocorasick
        self.words, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for phrase in BASE.keys() | NOTICES.keys():
            key = f" {phrase} "
            self.words.add_word(self.native(key), (len(key), BASE.get(phrase), NOTICES.get(phrase)))
        for tag, any_id in TAGS.items():
            self.tags.add_word(self.native(tag), any_id)
        self.words.make_automaton()
        self.tags.make_automaton()

    @staticmethod
    def native(x: bytes | str):
        """A key or a text in the form the library's build takes."""
        import ahocorasick
        if isinstance(x, str):
            x = x.encode()
        return x.decode("latin-1") if ahocorasick.unicode else x

    def places(self, words: list[bytes]):
        """(word number, base label, label) of every phrase, by its end."""
        line = b" " + b" ".join(words) + b" "
        blanks, done = 0, 0                          # blanks in line[:done]
        for end, (size, base, label) in self.words.iter(self.native(line)):
            last = line.count(b" ", done, end + 1) + blanks
            blanks, done = last, end + 1
            start = end + 1 - size
            yield last - 1 - line.count(b" ", start + 1, end + 1), base, label

    def expressions(self, text: bytes):
        """(postfix tokens, labels, grade) behind every tag that counts."""
        for end, any_id in self.tags.iter(self.native(text)):
            m = AFTER_TAG.match(text, end + 1)
            if m and (tokens := postfix(text, m.end())) and (found := evaluate(tokens, any_id)):
                yield tokens, *found

    def __call__(self, text: bytes):
        """(n_words, base places, base labels, labels, expressions, score)."""
        words = text.translate(WORDS).split()
        places, base, labels, shown, score = [], set(), set(), set(), 0.0
        for at, base_label, label in self.places(words):
            if base_label:
                places.append(at)
                base.add(base_label)
            for x in (base_label, label):
                if x:
                    labels.add(x)
                    score = max(score, grade(x))
        lowered = text.translate(LOWER)
        for tokens, own, g in self.expressions(lowered):
            labels |= own
            score = max(score, g)
            shown.add(b" ".join(tokens).decode())
        return len(words), places, base, labels, shown, score


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places (word numbers of the base phrases), base_labels,
    labels, expressions (postfix) as arrays, and score, for every row."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def fn(batches):
        find = Scanner()
        text_list, long_list = pa.list_(pa.string()), pa.list_(pa.int64())
        for b in slices(batches):
            rows = [find(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], long_list),
                 *[pa.array([sorted(r[i]) for r in rows], text_list) for i in (2, 3, 4)],
                 pa.array([r[5] for r in rows], pa.float64())],
                names=["doc_id", "n_words", "places", "base_labels", "labels", "expressions", "score"])
    return src.mapInArrow(fn, f"doc_id {dict(src.dtypes)['doc_id']}, n_words long, places array<long>, base_labels array<string>, "
                              "labels array<string>, expressions array<string>, score double")


def op12_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score", F.array_join("expressions", "; ").alias("expressions"))
