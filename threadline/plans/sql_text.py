"""DuckDB (RE2) forms of the native text functions, used by the oracle SQL.

They are written independently of the Spark expressions: same rules, a
different engine, so the value check compares two implementations.
"""

from __future__ import annotations

from threadline.functions.text import (CONTRACTION_SUFFIXES, MOJIBAKE)

_WS_RE2 = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_clean_text(expr: str) -> str:
    """SQL expression: clean_text(expr) in DuckDB."""
    fix = "w"
    for bad, good in MOJIBAKE:
        fix = f"replace({fix}, {_q(bad)}, {_q(good)})"
    fix = f"regexp_replace({fix}, '[^Ä]?Ä.?', ' ', 'g')"
    suffixes = ", ".join(_q(s) for s in CONTRACTION_SUFFIXES)
    word = (f"CASE WHEN d IN ({suffixes}) THEN chr(2) || d ELSE "
            f"trim(regexp_replace(replace(regexp_replace(d, 'htt.*', ' '), '&amp;', 'and'), "
            f"'[^a-zA-Z0-9_.,:'']+', ' ', 'g')) END")
    words = (f"list_transform(list_transform(list_filter(string_split_regex({expr}, '{_WS_RE2}'), "
             f"lambda w: w <> ''), lambda w: {fix}), lambda d: {word})")
    pieces = f"string_split(replace(array_to_string({words}, chr(1)), chr(1) || chr(2), chr(3)), chr(1))"
    glued = (f"array_to_string(list_transform({pieces}, lambda p: repeat(' ', len(string_split(p, chr(3))) - 1)"
             f" || array_to_string(string_split(p, chr(3)), '''')), ' ')")
    out = f"trim(replace({glued}, chr(2), ''))"
    return f"nullif(nullif({out}, ''), '...')"
