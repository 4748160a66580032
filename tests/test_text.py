import datetime

from pyspark.sql import functions as F

from threadline.functions.text import MOJIBAKE, clean_text, fix_mojibake, format_duration, parse_scores, post_text, post_time

LITERAL = [  # FIXTURES.md literal rows
    ("I don t  know http://x.y/z &amp; @bob #tag it s fine", "I  don't know  and bob tag  it's fine"),
    ("I d ve gone", "I'd've gone"),
    ("it‚Äôs ok‚Ä¶", "it's ok..."),
    ("...", None),
    ("http://a", None),
    ("Äpfel BÄR", "fel"),
    ("s hello", "s hello"),
    ("a b\u0085c d", "a b  c'd"),
    (None, None),
    ("  t d", "t'd"),             # leading suffix is an ordinary word (Q15)
    ("a !!! t", "a  't"),         # glued to an empty slot
    ("x‚Äùy z", 'x y z'),          # decoded quote is dropped by the basic-char rule
]


def test_clean_text_literal_rows(spark):
    df = spark.createDataFrame([(a,) for a, _ in LITERAL], "t string")
    got = [r[0] for r in df.select(clean_text("t")).collect()]
    assert got == [b for _, b in LITERAL]


def test_format_duration_matches_timedelta(spark):
    secs = [0.0, 0.5, 1.5, 2.5, 59.4, 3599.6, 86399.5, 86400.0, 90061.0, 172805.0, -5.0]
    df = spark.createDataFrame([(s,) for s in secs], "s double")
    got = [r[0] for r in df.select(format_duration("s")).collect()]
    assert got == [str(datetime.timedelta(seconds=int(round(s)))) for s in secs]


def test_parse_scores(spark):
    df = spark.createDataFrame([("[1 2 3]\n[4.5 -1 0]",), ("[ 0.1  0.9 ]",)], "t string")
    got = [r[0] for r in df.select(parse_scores("t")).collect()]
    assert got == [[[1.0, 2.0, 3.0], [4.5, -1.0, 0.0]], [[0.1, 0.9]]]


def test_post_text_repost(spark):
    df = spark.createDataFrame(
        [({"full_text": "mine", "retweeted_status": None},),
         ({"full_text": "RT trunc", "retweeted_status": {"full_text": "orig", "user": {"screen_name": "bob"}}},)],
        "r struct<full_text:string, retweeted_status:struct<full_text:string, user:struct<screen_name:string>>>")
    assert [x[0] for x in df.select(post_text("r")).collect()] == ["mine", "RT @bob: orig"]


def test_post_text_with_a_null_part_is_null(spark):
    df = spark.createDataFrame(
        [({"full_text": "x", "retweeted_status": {"full_text": None, "user": {"screen_name": "bob"}}},),
         ({"full_text": "x", "retweeted_status": {"full_text": "y", "user": None}},)],
        "r struct<full_text:string, retweeted_status:struct<full_text:string, user:struct<screen_name:string>>>")
    assert [x[0] for x in df.select(post_text("r")).collect()] == [None, None]


def test_marker_letters_left_to_right(spark):
    """The rule word by word: known triples, then any one around a marker letter."""
    import random
    rng = random.Random(3)

    def rule(w):
        for bad, good in MOJIBAKE:
            w = w.replace(bad, good)
        out, i = "", 0
        while i < len(w):
            if w[i] == "\u00c4":
                out, i = out + " ", i + 2
            elif i + 1 < len(w) and w[i + 1] == "\u00c4":
                out, i = out + " ", i + 3
            else:
                out, i = out + w[i], i + 1
        return out
    words = ["".join(rng.choice("ab\u00c4\u201a\u00f4") for _ in range(rng.randrange(1, 9))) for _ in range(2000)]
    df = spark.createDataFrame([(w,) for w in words], "w string").coalesce(1)
    assert [r[0] for r in df.select(fix_mojibake("w")).collect()] == [rule(w) for w in words]


def test_post_time_forms(spark):
    df = spark.createDataFrame([("Wed Oct 10 20:19:24 +0000 2018",), ("2018-10-10 20:19:24",), ("soon",), (None,)], "t string")
    t = datetime.datetime(2018, 10, 10, 20, 19, 24)
    assert [r[0] for r in df.select(post_time("t")).collect()] == [t, t, None, None]


def test_parse_scores_of_bad_cells(spark):
    df = spark.createDataFrame([("[1.5 x -2e1]\n[nan 3]",), (None,)], "t string")
    rows = [r[0] for r in df.select(parse_scores("t")).collect()]
    assert rows[0][0] == [1.5, None, -20.0] and rows[0][1][1] == 3.0 and rows[1] is None


def test_cleaning_has_no_pattern_per_word(spark):
    """All words of a text are rewritten at once; only pieces with a glued suffix
    are looked at one by one."""
    plan = spark.createDataFrame([("a",)], "t string").select(clean_text("t"))._jdf.queryExecution().analyzed().toString()
    assert " IN (t" not in plan


def test_marker_letters_of_the_text_itself(spark):
    rows = [("a\x01b \x02t x\x03s", "a b t x s"), ("a\x01 t", "a't"), ("\x02 s", "'s"), ("I t s\x01 d", "I't  s'd"), ("\x01", None)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "t string").coalesce(1)
    got = [r[0] for r in df.select(clean_text("t")).collect()]
    assert [g.strip() if g else g for g in got] == [b for _, b in rows]
