"""Input shapes the reference expects, as deterministic views over the driver
tables (see FIXTURES.md).  Each view exists twice: as a Spark DataFrame
builder and as a DuckDB CTE used by the oracle SQL.  All of them scale with
the driver tables; nothing is made up or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.schemas import NEW_COLUMNS, POLICY_LIST, RENAME_TO_OLD
from threadline.session import table

TS_FMT_SPARK = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_FMT_DUCK = "%Y-%m-%d %H:%M:%S.%f"


# ---- Spark -------------------------------------------------------------------

def posts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("handle"),
        F.date_format("ts", TS_FMT_SPARK).alias("created_at"),
        F.floor("value").cast("long").alias("favorite_count"),
        F.concat_ws(" ", "event_type", "props").alias("full_text"),
        F.col("event_id").alias("id"),
        F.get_json_object("props", "$.k").cast("long").alias("retweet_count"),
    )


def posts_dup(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf)
    return p.unionAll(p.where(F.col("id") % 7 == 0))


def posts_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """posts with holes: text, time and the two counters go missing on a rule."""
    p = posts(spark, sf)
    return p.select(
        "handle",
        F.when(F.col("id") % 3 != 0, F.col("created_at")).alias("created_at"),
        F.when(F.col("id") % 5 != 0, F.col("favorite_count")).alias("favorite_count"),
        F.when(F.col("id") % 2 != 0, F.col("full_text")).alias("full_text"),
        "id",
        F.when(F.col("id") % 7 != 0, F.col("retweet_count")).alias("retweet_count"),
    )


def raw_posts(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON record per document, a repost for every fifth id."""
    d = table(spark, sf, "documents")
    rt = F.when(F.col("doc_id") % 5 == 0, F.struct(
        F.struct(F.col("lang").alias("screen_name")).alias("user"),
        F.col("text").alias("full_text")))
    rec = F.struct(
        F.col("doc_id").alias("id"),
        F.col("text").alias("full_text"),
        F.col("n_chars").alias("favorite_count"),
        F.col("lang").alias("lang"),
        F.struct(F.col("source").alias("screen_name")).alias("user"),
        rt.alias("retweeted_status"),
    )
    return d.select(F.to_json(rec).alias("value"))


def handle_list(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        "c_custkey",
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("c_name")).alias("Twitter Handle"),
        F.when(k % 3 == 0, F.col("c_name"))
         .when(k % 3 == 1, F.concat(F.col("c_name"), F.lit("b"))).alias("Twitter Handle 2"),
    )


def post_handles(spark: SparkSession, sf: str) -> DataFrame:
    """Handles to pull: every handle with a post, plus one without any."""
    p = posts(spark, sf).select("handle").distinct()
    return p.unionByName(spark.range(1).select(F.lit("nobody").alias("handle")))


def cursors(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf)
    return p.groupBy("handle").agg(F.min("id").alias("lo"), F.max("id").alias("hi")) \
        .where(F.col("lo") % 7 != 0) \
        .select("handle", F.floor((F.col("lo") + F.col("hi")) / 2).cast("long").alias("since_id"))


def account_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status per handle to pull: every 13th user is protected, 'nobody' errors."""
    h = post_handles(spark, sf)
    uid = F.regexp_extract("handle", r"^u(\d+)$", 1)
    return h.select("handle", F.when(F.col("handle") == "nobody", "error")
                    .when((uid != "") & (uid.cast("long") % 13 == 0), "protected")
                    .otherwise("active").alias("status"))


def coded_base(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    j = d.join(e, "doc_id").join(lab, "doc_id", "left")
    i = F.col("doc_id")
    policy = {}
    for n, name in enumerate(POLICY_LIST):
        cond = F.col("label") == n
        if n == 3:
            cond = cond | (i % 13 == 0)
        policy[name] = F.when(cond, 1).otherwise(0).cast("int")
    return j.select(
        i.alias("id"), "text",
        F.col("quality").alias("factual_claim"),
        (i % 3 - 1).cast("int").alias("sentiment"),
        (i % 4 - 2).cast("int").alias("ideology"),
        F.col("toxic").alias("political"),
        *[v.alias(k) for k, v in policy.items()],
        F.when(i % 4 == 1, 1).otherwise(0).cast("int").alias("asks_for_donation"),
        F.when((i % 4 == 2) | (i % 20 == 1), 1).otherwise(0).cast("int").alias("ask_to_etc"),
        F.when(i % 4 == 3, 1).otherwise(0).cast("int").alias("ask_misc"),
    )


_OLD_ORDER = ["text", "factual_claim", "sentiment", "ideology", "political", *POLICY_LIST,
              "asks_for_donation", "ask_to_etc", "ask_misc"]


def coded_old(spark: SparkSession, sf: str) -> DataFrame:
    b = coded_base(spark, sf).where(F.col("id") % 2 == 0)
    i = F.col("id")
    old = b.select(
        F.when(i % 10 == 0, F.lit(None)).otherwise(i).cast("long").alias("index"),
        *_OLD_ORDER,
        F.when(i % 17 == 0, F.col("factual_claim")).otherwise(1 - F.col("factual_claim"))
         .cast("int").alias("opinion"),
        F.lit("CA").alias("state"),
        F.lit(None).cast("string").alias("Unnamed: 21"),
        i.alias("__id"),
    )
    return old.unionAll(old.where(F.col("__id") % 6 == 0)).drop("__id")


def _base_name(new_col: str) -> str:
    return new_col if new_col == "id" else RENAME_TO_OLD.get(new_col, new_col)


def coded_new(spark: SparkSession, sf: str) -> DataFrame:
    b = coded_base(spark, sf).where(F.col("id") % 2 == 1)
    return b.select(*[F.col(_base_name(c)).alias(c) for c in NEW_COLUMNS])


def updates(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf)
    a = p.where(F.col("id") % 3 == 0).select(
        "id", (F.col("retweet_count") + 10).alias("retweets"),
        (F.col("favorite_count") + 1).alias("favorites"), F.lit(1).alias("seq"))
    b = p.where(F.col("id") % 9 == 0).select(
        "id", (F.col("retweet_count") + 20).alias("retweets"),
        (F.col("favorite_count") + 2).alias("favorites"), F.lit(2).alias("seq"))
    c = p.where(F.col("id") % 100 == 0).select(
        (F.col("id") + 100000000).alias("id"), F.lit(0).cast("long").alias("retweets"),
        F.lit(0).cast("long").alias("favorites"), F.lit(1).alias("seq"))
    return a.unionAll(b).unionAll(c)


def posts_for_refresh(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf)
    return p.withColumn("created_at", F.when(F.col("id") % 50 != 0, F.col("created_at")))


def pool(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def prior_samples(spark: SparkSession, sf: str) -> DataFrame:
    p = pool(spark, sf)
    return p.where(F.col("id") % 10 == 3).withColumn("sample_name", F.lit("batch1")) \
        .unionAll(p.where(F.col("id") % 10 == 7).withColumn("sample_name", F.lit("batch2")))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    # every element counts: class c sums the elements with index mod 10 = c
    logits = [sum((F.get("embedding", F.lit(i)).cast("double") for i in range(c + 10, 64, 10)),
                  F.get("embedding", F.lit(c)).cast("double")) for c in range(10)]
    return e.select(F.col("vec_id").alias("row_id"), F.array(*logits).alias("logits"),
                    F.col("label").alias("truth"))


# ---- DuckDB CTEs ------------------------------------------------------------------

SQL_POSTS = f"""posts AS (
  SELECT 'u' || CAST(user_id AS VARCHAR) AS handle,
         strftime(ts, '{TS_FMT_DUCK}') AS created_at,
         CAST(floor(value) AS BIGINT) AS favorite_count,
         event_type || ' ' || props AS full_text,
         event_id AS id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS retweet_count
  FROM events)"""

SQL_POSTS_DUP = "posts_dup AS (SELECT * FROM posts UNION ALL SELECT * FROM posts WHERE id % 7 = 0)"

SQL_POSTS_SPARSE = """posts_sparse AS (
  SELECT handle,
         CASE WHEN id % 3 <> 0 THEN created_at END AS created_at,
         CASE WHEN id % 5 <> 0 THEN favorite_count END AS favorite_count,
         CASE WHEN id % 2 <> 0 THEN full_text END AS full_text,
         id,
         CASE WHEN id % 7 <> 0 THEN retweet_count END AS retweet_count
  FROM posts)"""

SQL_HANDLE_LIST = """handle_list AS (
  SELECT c_custkey,
         CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS "Twitter Handle",
         CASE WHEN c_custkey % 3 = 0 THEN c_name
              WHEN c_custkey % 3 = 1 THEN c_name || 'b' END AS "Twitter Handle 2"
  FROM customer)"""

SQL_POST_HANDLES = "post_handles AS (SELECT DISTINCT handle FROM posts UNION ALL SELECT 'nobody')"

SQL_CURSORS = """cursors AS (
  SELECT handle, CAST(floor((min(id) + max(id)) / 2) AS BIGINT) AS since_id
  FROM posts GROUP BY handle HAVING min(id) % 7 <> 0)"""

SQL_ACCOUNT_STATUS = """account_status AS (
  SELECT handle,
         CASE WHEN handle = 'nobody' THEN 'error'
              WHEN regexp_full_match(handle, 'u[0-9]+')
                   AND CAST(substr(handle, 2) AS BIGINT) % 13 = 0 THEN 'protected'
              ELSE 'active' END AS status
  FROM post_handles)"""


def _sql_policy() -> str:
    out = []
    for n, name in enumerate(POLICY_LIST):
        cond = f"e.label = {n}" + (" OR d.doc_id % 13 = 0" if n == 3 else "")
        out.append(f"CAST(CASE WHEN {cond} THEN 1 ELSE 0 END AS INTEGER) AS {name}")
    return ",\n         ".join(out)


SQL_CODED_BASE = f"""coded_base AS (
  SELECT d.doc_id AS id, d.text, l.quality AS factual_claim,
         CAST(d.doc_id % 3 - 1 AS INTEGER) AS sentiment,
         CAST(d.doc_id % 4 - 2 AS INTEGER) AS ideology,
         l.toxic AS political,
         {_sql_policy()},
         CAST(CASE WHEN d.doc_id % 4 = 1 THEN 1 ELSE 0 END AS INTEGER) AS asks_for_donation,
         CAST(CASE WHEN d.doc_id % 4 = 2 OR d.doc_id % 20 = 1 THEN 1 ELSE 0 END AS INTEGER) AS ask_to_etc,
         CAST(CASE WHEN d.doc_id % 4 = 3 THEN 1 ELSE 0 END AS INTEGER) AS ask_misc
  FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id
  LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

_OLD_SQL_COLS = ", ".join(f'"{c}"' for c in _OLD_ORDER)

SQL_CODED_OLD = f"""coded_old_1 AS (
  SELECT CAST(CASE WHEN id % 10 = 0 THEN NULL ELSE id END AS BIGINT) AS "index", {_OLD_SQL_COLS},
         CAST(CASE WHEN id % 17 = 0 THEN factual_claim ELSE 1 - factual_claim END AS INTEGER) AS opinion,
         'CA' AS state, CAST(NULL AS VARCHAR) AS "Unnamed: 21", id AS __id
  FROM coded_base WHERE id % 2 = 0),
coded_old AS (
  SELECT * EXCLUDE (__id) FROM coded_old_1
  UNION ALL SELECT * EXCLUDE (__id) FROM coded_old_1 WHERE __id % 6 = 0)"""

SQL_CODED_NEW = "coded_new AS (SELECT " + ", ".join(
    f'"{_base_name(c)}" AS "{c}"' for c in NEW_COLUMNS) + " FROM coded_base WHERE id % 2 = 1)"

SQL_UPDATES = """updates AS (
  SELECT id, retweet_count + 10 AS retweets, favorite_count + 1 AS favorites, 1 AS seq
  FROM posts WHERE id % 3 = 0
  UNION ALL SELECT id, retweet_count + 20, favorite_count + 2, 2 FROM posts WHERE id % 9 = 0
  UNION ALL SELECT id + 100000000, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 1 FROM posts WHERE id % 100 = 0)"""

SQL_POSTS_FOR_REFRESH = """posts_for_refresh AS (
  SELECT handle, CASE WHEN id % 50 <> 0 THEN created_at END AS created_at,
         favorite_count, full_text, id, retweet_count FROM posts)"""

SQL_POOL = "pool AS (SELECT doc_id AS id, text FROM documents)"
SQL_PRIOR = """prior_samples AS (
  SELECT id, text, 'batch1' AS sample_name FROM pool WHERE id % 10 = 3
  UNION ALL SELECT id, text, 'batch2' FROM pool WHERE id % 10 = 7)"""

SQL_SCORES = "scores AS (SELECT vec_id AS row_id, [" + ", ".join(
    " + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(c, 64, 10)) for c in range(10)
) + "] AS logits, label AS truth FROM embeddings)"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
