"""Scalar text functions (Column -> Column), all native Spark expressions.

``clean_text`` is linear in the text length and runs entirely inside the JVM:
words are separated by a marker, all words of a text are rewritten at once by
built-in string expressions, and contraction suffixes are glued back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
# Python's str.split() whitespace set (Java's \s is ASCII only).
WHITESPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
# UTF-8 punctuation read back as Mac Roman, and what it stands for.
MOJIBAKE = [
    ("‚Äù", '"'),
    ("‚Äú", '"'),
    ("‚Ä¶", "..."),
    ("‚Äô", "'"),
    ("‚Äò", "'"),
    ("‚Äì", "-"),
    ("‚Äî", "-"),
]
CONTRACTION_SUFFIXES = ["t", "s", "d", "ll", "ve", "re", "m"]
BROKEN_TRIPLE = "[^Ä]?Ä.?"       # any other sequence around the marker letter
LINK = "htt[^\x01]*"             # from the first 'htt' to the end of the word
AMPERSAND = ("&amp;", "and")
# Runs of characters the cleaner drops (markers stay).  \w is [a-zA-Z_0-9], a table
# look-up; written as ranges the class costs twenty times as much.
NOT_BASIC = r"[^\w.,:'\x01\x02]+"
TRASH_RESULTS = ["", "..."]
# ---- end of fixed values -----------------------------------------------------

_SEP = "\x01"      # word separator
_SUF = "\x02"      # marks a word that is a contraction suffix
_GLUE = "\x03"     # separates a word from its glued suffixes


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_words(text) -> Column:
    """X1 on a whole text: its words (split on Unicode whitespace, no empty
    tokens), separated by one marker.  Marker letters of the text itself become
    another letter that the cleaner drops."""
    own = F.regexp_replace(_col(text), f"[{_SEP}{_SUF}{_GLUE}]", "-")
    return F.btrim(F.regexp_replace(own, WHITESPACE, _SEP), F.lit(_SEP))


def fix_mojibake(word, separator: str = "") -> Column:
    """The seven known triples to punctuation, any other triple around the
    marker letter to one space (always terminates, see SURVEY Q14).  With a
    separator for all words of a text at once."""
    w = _col(word)
    for bad, good in MOJIBAKE:
        w = F.replace(w, F.lit(bad), F.lit(good))
    triple = f"[^Ä{separator}]?Ä[^{separator}]?" if separator else BROKEN_TRIPLE
    return F.regexp_replace(w, triple, " ")


def strip_links(words) -> Column:
    """X4, in each of the separated words."""
    return F.regexp_replace(_col(words), LINK, " ")


def decode_amp(word) -> Column:
    """X5."""
    return F.replace(_col(word), F.lit(AMPERSAND[0]), F.lit(AMPERSAND[1]))


def keep_basic_chars(words) -> Column:
    """X6, in each of the separated words: runs outside the basic set become one
    space."""
    return F.regexp_replace(_col(words), NOT_BASIC, " ")


def _once(value: Column, use) -> Column:
    """use(value), with `value` evaluated once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _clean_words(marked: Column) -> Column:
    """X2, then a contraction suffix gets its marker, any other word X4-X6; all
    words of a text at once, since no pattern crosses a separator.

    X2 never yields a suffix, so the suffix test may read its result; X2 runs only
    on texts holding the letter.  X6 leaves at most one space at the ends of a
    word, which goes beside the separator.
    """
    decoded = _once(marked, lambda t: F.when(F.instr(t, "Ä") > 0, fix_mojibake(t, _SEP)).otherwise(t))
    suffixes = F.regexp_replace(
        decoded, f"(\\A|{_SEP})({'|'.join(CONTRACTION_SUFFIXES)})(?={_SEP}|\\z)", f"$1{_SUF}$2")
    basic = keep_basic_chars(decode_amp(strip_links(suffixes)))
    return F.trim(F.replace(F.replace(basic, F.lit(f" {_SEP}"), F.lit(_SEP)), F.lit(f"{_SEP} "), F.lit(_SEP)))


def _glue_piece(piece: Column) -> Column:
    parts = F.split(piece, _GLUE)
    return F.concat(F.repeat(F.lit(" "), F.size(parts) - 1), F.array_join(parts, "'"))


def merge_contractions(words: Column) -> Column:
    """X3 on cleaned, separated words whose suffixes carry the marker: glue
    each suffix to the previous word with an apostrophe; every absorbed slot
    stays as an empty word (one extra space before the merged word)."""
    joined = F.replace(words, F.lit(_SEP + _SUF), F.lit(_GLUE))
    text = _once(joined, lambda t: F.when(
        F.instr(t, _GLUE) > 0, F.array_join(F.transform(F.split(t, _SEP), _glue_piece), " "))
        .otherwise(F.replace(t, F.lit(_SEP), F.lit(" "))))
    # a suffix in first position has nothing before it: an ordinary word (Q15);
    # its marker is the only one left (word content never holds a marker)
    return F.replace(text, F.lit(_SUF), F.lit(""))


def _null_if_trash(out: Column) -> Column:
    # '' and '...' -> null, referencing `out` once (a CASE would evaluate the
    # whole cleaning expression twice)
    return F.try_element_at(F.filter(F.array(out), lambda s: ~s.isin(*TRASH_RESULTS)), F.lit(1))


def clean_text(text) -> Column:
    """X1-X6, join by one space, trim; '' and '...' become null. Case kept.

    One native expression, linear in the text: words separated by a marker,
    rewritten by passes over the whole text, contraction suffixes glued.
    """
    return _null_if_trash(F.trim(merge_contractions(_clean_words(split_words(text)))))


def post_text(record) -> Column:
    """A repost becomes 'RT @{author}: {original text}' (null if either part
    is), else the text."""
    r = _col(record)
    rt = r.getField("retweeted_status")
    return F.when(
        rt.isNotNull(),
        F.concat(F.lit("RT @"), rt.getField("user").getField("screen_name"), F.lit(": "),
                 rt.getField("full_text")),
    ).otherwise(r.getField("full_text"))


def post_time(created_at) -> Column:
    """The time of a post: the platform's form ('Wed Oct 10 20:19:24 +0000 2018')
    or an ISO one; anything else is null."""
    c = _col(created_at)
    return F.coalesce(F.try_to_timestamp(F.substring(c, 5, 64), F.lit("MMM dd HH:mm:ss Z yyyy")),
                      F.try_to_timestamp(c))


def format_duration(seconds) -> Column:
    """Seconds rounded half-to-even, rendered 'H:MM:SS' or
    'N day[s], H:MM:SS' (days may be negative, as for a negative span)."""
    total = F.bround(_col(seconds).cast("double"), 0).cast("long")
    days = F.floor(total / F.lit(86400)).cast("long")
    rest = total - days * F.lit(86400)
    clock = F.format_string("%d:%02d:%02d", (rest / 3600).cast("long"),
                            ((rest % 3600) / 60).cast("long"), rest % 60)
    day_txt = F.format_string("%d day%s, ", days, F.when(F.abs(days) == 1, "").otherwise("s"))
    return F.when(total.isNull(), F.lit(None).cast("string")) \
        .when(days == 0, clock).otherwise(F.concat(day_txt, clock))


def parse_scores(text) -> Column:
    """A printed block '[a b c]\\n[d e f]' back to an array of rows
    (array<array<double>>), one row per bracketed line; a cell that is no number
    is null."""
    rows = F.split(F.trim(_col(text)), r"\]\s*\n")
    return F.transform(
        rows,
        lambda r: F.transform(
            F.filter(F.split(F.trim(F.regexp_replace(r, r"[\[\]]", "")), r"\s+"),
                     lambda x: x != F.lit("")),
            lambda x: x.try_cast("double")),
    )
