"""Queries over coded posts: merge, label maps, the M4 training set, decodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadline.functions.arrays import one_hot_decode
from threadline.operators import labels as L
from threadline.plans import fixtures as fx
from threadline.plans.catalog import register
from threadline.schemas import ASK_LIST, POLICY_LIST, Y_COLS

# Column order of a merged coded frame (old naming).
MERGED = ["index", "text", "factual_claim", "sentiment", "ideology", "political", *POLICY_LIST,
          "asks_for_donation", "ask_to_etc", "ask_misc", "opinion"]
OLD_Y = [c for c in Y_COLS if c in MERGED]


def _q(c: str) -> str:
    return f'"{c}"'


def _cols(cols) -> str:
    return ", ".join(_q(c) for c in cols)


SQL_MERGED = (
    "merged AS (SELECT " + _cols(MERGED) + " FROM coded_old UNION ALL SELECT "
    + ", ".join(("id AS \"index\"" if c == "index" else
                 "CAST(CASE WHEN factual_claim = 0 THEN 1 ELSE 0 END AS INTEGER) AS opinion"
                 if c == "opinion" else _q(c)) for c in MERGED)
    + " FROM (SELECT text, factual_claim, sentiment, ideology, political, immigration, "
      "macroeconomics AS macroeconomic, national_security, crime_law_enforcement AS crime, "
      "civil_rights, environment, education, healthcare AS health_care, governance, "
      "no_policy_content, asks_for_donation, ask_to_watch_read_share_follow_s AS ask_to_etc, "
      "ask_misc, id FROM coded_new))")


def sql_label_map(src: str, name: str = "lm") -> str:
    ys = _cols(OLD_Y)
    return f"""{name}_long AS (
  SELECT target, label FROM (UNPIVOT (SELECT {ys} FROM {src}) ON {ys} INTO NAME target VALUE label)
  WHERE label IS NOT NULL),
{name}_pairs AS (SELECT DISTINCT target, CAST(label AS INTEGER) AS label FROM {name}_long),
{name}_max AS (SELECT target, max(label) AS m FROM {name}_pairs GROUP BY target),
{name} AS (
  SELECT p.target, p.label AS original_label,
         CAST(x.m + row_number() OVER (PARTITION BY p.target ORDER BY p.label) AS INTEGER) AS encoded_label
  FROM {name}_pairs p JOIN {name}_max x USING (target) WHERE p.label < 0)"""


def _sql_encode(c: str, lm: str) -> str:
    base = (f"CASE WHEN t.{_q(c)} IS NULL AND EXISTS (SELECT 1 FROM {lm} WHERE target = '{c}') "
            f"THEN 0 ELSE t.{_q(c)} END")
    return (f"CAST(coalesce((SELECT encoded_label FROM {lm} WHERE target = '{c}' AND original_label = "
            f"{base}), {base}) AS INTEGER) AS {_q(c)}")


def _sql_decode(c: str, lm: str) -> str:
    return (f"CAST(coalesce((SELECT original_label FROM {lm} WHERE target = '{c}' AND encoded_label = "
            f"t.{_q(c)}), t.{_q(c)}) AS INTEGER) AS {_q(c)}")


def sql_select_mapped(cols, src: str, lm: str, fn) -> str:
    parts = [fn(c, lm) if c in OLD_Y else f"t.{_q(c)}" for c in cols]
    return f"SELECT {', '.join(parts)} FROM {src} t"


_MERGED_CTES = (fx.SQL_CODED_BASE, fx.SQL_CODED_OLD, fx.SQL_CODED_NEW, SQL_MERGED)


def merged(spark, sf):
    return L.merge_coded(fx.coded_old(spark, sf), fx.coded_new(spark, sf)).select(*MERGED)


@register("merge_coded", sql=fx.with_ctes(fx.SQL_CODED_BASE, fx.SQL_CODED_OLD, fx.SQL_CODED_NEW,
                                          SQL_MERGED) + "SELECT * FROM merged")
def q_merge_coded(spark, sf):
    return L.merge_coded(fx.coded_old(spark, sf), fx.coded_new(spark, sf))


@register("label_map", sql=fx.with_ctes(*_MERGED_CTES, sql_label_map("merged")) + "SELECT * FROM lm")
def q_label_map(spark, sf):
    return L.label_map(merged(spark, sf))


@register("encode_labels", sql=fx.with_ctes(*_MERGED_CTES, sql_label_map("merged"))
          + sql_select_mapped(MERGED, "merged", "lm", _sql_encode))
def q_encode_labels(spark, sf):
    rows = merged(spark, sf)
    return L.encode_labels(rows, L.label_map(rows))


@register("decode_labels", sql=fx.with_ctes(
    *_MERGED_CTES, sql_label_map("merged"),
    "enc AS (" + sql_select_mapped(MERGED, "merged", "lm", _sql_encode) + ")")
    + sql_select_mapped(MERGED, "enc", "lm", _sql_decode))
def q_decode_labels(spark, sf):
    """A2 -> A3 -> J5: the round trip gives the input back (nulls of mapped
    columns stay 0, as N2 made them)."""
    rows = merged(spark, sf)
    lm = L.label_map(rows)
    return L.decode_labels(L.encode_labels(rows, lm), lm)


FIXED_LABELS = ["sentiment", "political", "ideology"]


@register("fill_labels", sql=fx.with_ctes(*_MERGED_CTES) + "SELECT * REPLACE (" + ", ".join(
    f"coalesce({c}, 0) AS {c}" for c in FIXED_LABELS) + ") FROM merged")
def q_fill_labels(spark, sf):
    """N2 in its fixed form: three label columns, null -> 0."""
    return L.fill_labels(merged(spark, sf), FIXED_LABELS)


def _sql_m4(policy_rule: str) -> str:
    pol_sum = " + ".join(_q(c) for c in POLICY_LIST)
    keep = f"{pol_sum} = 1" if policy_rule == "exactly_one" else f"{pol_sum} <> 0"
    not_null = " AND ".join(f"{_q(c)} IS NOT NULL" for c in MERGED)
    ones = " + ".join(f"coalesce(CAST({c} = 1 AS INTEGER), 0)"
                      for c in ("asks_for_donation", "ask_to_etc", "ask_misc"))
    pol_arr = "[" + ", ".join(_q(c) for c in POLICY_LIST) + "]"
    no_ask = ("CAST(CASE WHEN asks_for_donation = 0 AND ask_to_etc = 0 AND ask_misc = 0 "
              "THEN 1 ELSE 0 END AS INTEGER)")
    ask_arr = "[" + ", ".join(["no_ask"] + [_q(c) for c in ASK_LIST[1:]]) + "]"
    return fx.with_ctes(
        fx.SQL_CODED_BASE, fx.SQL_CODED_OLD, fx.SQL_CODED_NEW, SQL_MERGED,
        "dedup AS (SELECT DISTINCT * FROM merged)",
        "filled AS (SELECT * REPLACE (coalesce(\"index\", 0) AS \"index\") FROM dedup)",
        sql_label_map("filled"),
        "enc AS (" + sql_select_mapped(MERGED, "filled", "lm", _sql_encode) + ")",
        f"f AS (SELECT * FROM enc WHERE ({keep}) AND {not_null}"
        f" AND (opinion <> factual_claim OR opinion IS NULL OR factual_claim IS NULL)"
        f" AND {ones} <= 1)",
        f"g AS (SELECT *, {no_ask} AS no_ask FROM f)",
    ) + (f"SELECT *, CAST(nullif(list_position({pol_arr}, 1), 0) - 1 AS INTEGER) AS policies, "
         f"CAST(nullif(list_position({ask_arr}, 1), 0) - 1 AS INTEGER) AS ask_requests FROM g")


@register("prepare_training_set", sql=_sql_m4("exactly_one"))
def q_prepare_training_set(spark, sf):
    df, _ = L.prepare_training_set(fx.coded_old(spark, sf), fx.coded_new(spark, sf))
    return df


@register("prepare_any_policy", sql=_sql_m4("any"))
def q_prepare_any_policy(spark, sf):
    df, _ = L.prepare_training_set(fx.coded_old(spark, sf), fx.coded_new(spark, sf), policy_rule="any")
    return df


@register("one_hot_decode", sql=fx.with_ctes(*_MERGED_CTES) + (
    "SELECT \"index\", CAST(nullif(list_position([" + _cols(POLICY_LIST) + "], 1), 0) - 1 AS INTEGER) "
    "AS policies, CAST(nullif(list_position([CASE WHEN asks_for_donation = 0 AND ask_to_etc = 0 AND "
    "ask_misc = 0 THEN 1 ELSE 0 END, asks_for_donation, ask_to_etc, ask_misc], 1), 0) - 1 AS INTEGER) "
    "AS ask_requests FROM merged"))
def q_one_hot_decode(spark, sf):
    rows = L.derive_no_ask(merged(spark, sf))
    return rows.select("index", one_hot_decode(POLICY_LIST).alias("policies"),
                       one_hot_decode(ASK_LIST).alias("ask_requests"))


def sql_m4(policy_rule: str = "exactly_one") -> str:
    return _sql_m4(policy_rule)
