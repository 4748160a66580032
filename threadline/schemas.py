"""Column groups, rename map and explicit schemas of the coded-post data model.

Fixed values: the column names, their grouping and the rename map below must
equal the ones the coded spreadsheets use, so they are stated as data.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values (names of the hand-coding spreadsheets) -----------------
NEW_COLUMNS = [
    "text", "factual_claim", "sentiment", "ideology", "political",
    "immigration", "macroeconomics", "national_security",
    "crime_law_enforcement", "civil_rights", "environment",
    "education", "healthcare", "no_policy_content",
    "asks_for_donation", "ask_to_watch_read_share_follow_s",
    "ask_misc", "governance", "id",
]

RENAME_TO_OLD = {
    "ask_to_watch_read_share_follow_s": "ask_to_etc",
    "macroeconomics": "macroeconomic",
    "crime_law_enforcement": "crime",
    "healthcare": "health_care",
    "id": "index",
}

GENERAL_LIST = ["sentiment", "ideology", "political", "factual_claim"]
POLICY_LIST = [
    "immigration", "macroeconomic", "national_security", "crime",
    "civil_rights", "environment", "education", "health_care",
    "governance", "no_policy_content",
]
ASK_LIST = ["no_ask", "asks_for_donation", "ask_to_etc", "ask_misc"]
ORDINAL_LIST = ["policies", "ask_requests"]
Y_COLS = GENERAL_LIST + ORDINAL_LIST + POLICY_LIST + ASK_LIST

LEGACY_COLUMNS = ["state", "Unnamed: 21"]

# Empty hand-coding columns added to a drawn sample (sample sheet template).
CODING_TEMPLATE = [
    "id", "text", "sentiment", "political", "ideology", "macroeconomics",
    "immigration", "national_security", "crime_law_enforcement",
    "civil_rights", "environment", "education", "healthcare", "governance",
    "no_policy_content", "asks_for_donation",
    "ask_to_watch_read_share_follow_something", "ask_etc",
    "factual_claim", "opinion",
]

# Top-level tags a post record may carry; extraction intersects with these.
KNOWN_TAGS = [
    "contributors", "coordinates", "created_at", "entities",
    "favorite_count", "favorited", "full_text", "geo", "id",
    "id_str", "in_reply_to_screen_name", "in_reply_to_status_id",
    "in_reply_to_status_id_str", "in_reply_to_user_id",
    "in_reply_to_user_id_str", "is_quote_status", "lang",
    "place", "possibly_sensitive", "retweet_count",
    "retweeted", "retweeted_status", "source", "text",
    "truncated", "user",
]
DEFAULT_TAGS = ["id", "created_at", "full_text", "retweet_count", "favorite_count"]
HANDLE_COLUMN_MARKER = "Twitter Handle"
# ---- end of fixed values ---------------------------------------------------

OLD_COLUMNS = [RENAME_TO_OLD.get(c, c) for c in NEW_COLUMNS]

POSTS_SCHEMA = T.StructType([
    T.StructField("handle", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("favorite_count", T.LongType()),
    T.StructField("full_text", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("retweet_count", T.LongType()),
])

CURSOR_SCHEMA = T.StructType([
    T.StructField("handle", T.StringType()),
    T.StructField("since_id", T.LongType()),
])

_USER = T.StructType([T.StructField("screen_name", T.StringType())])

# JSON schema of one landed post record (only tags we may project are typed;
# everything else is carried as raw JSON text by from_json when asked for).
RAW_POST_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("id_str", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("full_text", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("retweet_count", T.LongType()),
    T.StructField("favorite_count", T.LongType()),
    T.StructField("favorited", T.BooleanType()),
    T.StructField("retweeted", T.BooleanType()),
    T.StructField("truncated", T.BooleanType()),
    T.StructField("is_quote_status", T.BooleanType()),
    T.StructField("possibly_sensitive", T.BooleanType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("in_reply_to_screen_name", T.StringType()),
    T.StructField("in_reply_to_status_id", T.LongType()),
    T.StructField("in_reply_to_status_id_str", T.StringType()),
    T.StructField("in_reply_to_user_id", T.LongType()),
    T.StructField("in_reply_to_user_id_str", T.StringType()),
    T.StructField("contributors", T.StringType()),
    T.StructField("coordinates", T.StringType()),
    T.StructField("entities", T.StringType()),
    T.StructField("geo", T.StringType()),
    T.StructField("place", T.StringType()),
    T.StructField("user", _USER),
    T.StructField("retweeted_status", T.StructType([
        T.StructField("full_text", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("user", _USER),
    ])),
])


def coded_schema(columns: list[str], text_cols=("text",), id_cols=("id", "index")) -> T.StructType:
    """Explicit schema of coded posts: text columns are strings, ids bigint,
    every label an int (never inferred)."""
    fields = []
    for c in columns:
        if c in text_cols or c in ("state", "Unnamed: 21"):
            fields.append(T.StructField(c, T.StringType()))
        elif c in id_cols:
            fields.append(T.StructField(c, T.LongType()))
        else:
            fields.append(T.StructField(c, T.IntegerType()))
    return T.StructType(fields)
