"""Domain tables derived from the given tables, as Spark DataFrames and as SQL of the same shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webtables.functions.text import title_key
from webtables.session import spread

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries by name with their equivalent SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return keep


SPREAD = {"pages", "documents", "conversations", "lineitem"}  # much work per row or many rows


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(scan) if name in SPREAD else scan


def _site_url(key: str) -> Column:
    return F.concat(F.lit("https://s"), F.col(key).cast("string"), F.lit(".example.com"))


TIE = ("run_id", "line", "source_url", "book_url")


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Site offers work: line items with the part as the work and the supplier as the site.

    The title key is computed once per work, before the join multiplies it.
    """
    item = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    part = table(spark, sf, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", title_key("p_name").alias("key")
    )
    site = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    # titles last: they are not dealt out again for the sites
    joined = item.join(site, item.l_suppkey == site.s_suppkey).join(part, item.l_partkey == part.p_partkey)
    source = _site_url("l_suppkey")
    return joined.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("arrival"),
        source.alias("source_url"), F.col("s_name").alias("source_name"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("author"), F.col("p_type").alias("kind"),
        F.col("p_size").cast("string").alias("word_count"),
        F.concat(source, F.lit("/b/"), F.col("l_partkey").cast("string")).alias("book_url"), "key",
    )


HITS = """hits AS (
  SELECT l_orderkey AS run_id, l_linenumber AS line, l_shipdate AS arrival,
         'https://s' || l_suppkey || '.example.com' AS source_url, s_name AS source_name, p_name AS name,
         p_brand AS author, p_type AS kind, CAST(p_size AS VARCHAR) AS word_count,
         'https://s' || l_suppkey || '.example.com/b/' || l_partkey AS book_url,
         regexp_replace(lower(p_name), '[^\\p{L}\\p{Nd}]', '', 'g') AS key
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)"""


def attempts(events: DataFrame) -> DataFrame:
    """Attempt log: one row per event, the user as the site."""
    kind = F.col("event_type")
    failure = (
        F.when(kind != "error", None)
        .when(F.col("value") < 10, "java.net.ConnectException")
        .when(F.col("value") < 20, "javax.net.ssl.SSLException")
        .when(F.col("value") < 30, "java.net.SocketTimeoutException")
        .otherwise("java.net.UnknownHostException")
    )
    return events.select(
        F.floor(F.col("event_id") / 50).cast("long").alias("run_id"),
        _site_url("user_id").alias("source_url"),
        F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit(".example.com")).alias("host"),
        "ts", F.col("event_id").alias("seq"), (kind != "error").alias("reachable"),
        (kind == "purchase").alias("had_results"), F.col("value").cast("long").alias("ms"),
        failure.alias("error_class"),
    )


ATTEMPTS = """attempts AS (
  SELECT CAST(floor(event_id / 50) AS BIGINT) AS run_id, 'https://s' || user_id || '.example.com' AS source_url,
         's' || user_id || '.example.com' AS host, ts, event_id AS seq, event_type <> 'error' AS reachable,
         event_type = 'purchase' AS had_results, CAST(trunc(value) AS BIGINT) AS ms,
         CASE WHEN event_type <> 'error' THEN NULL WHEN value < 10 THEN 'java.net.ConnectException'
              WHEN value < 20 THEN 'javax.net.ssl.SSLException' WHEN value < 30 THEN 'java.net.SocketTimeoutException'
              ELSE 'java.net.UnknownHostException' END AS error_class
  FROM events)"""


def reads(events: DataFrame) -> DataFrame:
    """Read outcomes: a view found chapters, a click did not."""
    opened = events.filter(F.col("event_type").isin("view", "click"))
    return opened.select(_site_url("user_id").alias("source_url"), (F.col("event_type") == "view").alias("chapters"))


READS = """reads AS (
  SELECT 'https://s' || user_id || '.example.com' AS source_url, event_type = 'view' AS chapters
  FROM events WHERE event_type IN ('view', 'click'))"""


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Sites: suppliers with a type, a switch and search rules."""
    s = table(spark, sf, "supplier")
    return s.select(
        _site_url("s_suppkey").alias("source_url"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("pos"),
        F.when(F.col("s_nationkey") < 18, 0).when(F.col("s_nationkey") < 21, 1).when(F.col("s_nationkey") < 23, 2)
        .otherwise(3).alias("type"),
        (F.col("s_acctbal") >= 0).alias("enabled"),
        F.when(F.col("s_acctbal") < 8000, F.lit("/search?q={{key}}&p={{page}}")).otherwise("").alias("search_url"),
        F.when(F.col("s_acctbal") < 7000, F.lit("class.list@tag.li")).otherwise("").alias("list_rule"),
    )


REGISTRY = """registry AS (
  SELECT 'https://s' || s_suppkey || '.example.com' AS source_url, s_name AS name, s_suppkey AS pos,
         CASE WHEN s_nationkey < 18 THEN 0 WHEN s_nationkey < 21 THEN 1 WHEN s_nationkey < 23 THEN 2 ELSE 3 END AS type,
         s_acctbal >= 0 AS enabled,
         CASE WHEN s_acctbal < 8000 THEN '/search?q={{key}}&p={{page}}' ELSE '' END AS search_url,
         CASE WHEN s_acctbal < 7000 THEN 'class.list@tag.li' ELSE '' END AS list_rule
  FROM supplier)"""

HEALTH = (
    ATTEMPTS
    + """, health AS (
  SELECT source_url, count(*) FILTER (reachable AND had_results) AS ok, count(*) FILTER (NOT reachable) AS fail,
         max(ts) FILTER (reachable AND had_results) AS last_ok, max(ts) AS last_try,
         coalesce(list_reduce(list(ms ORDER BY ts, seq) FILTER (reachable AND had_results),
           lambda a, m: CASE WHEN a <= 0 THEN m ELSE (3 * a + m) // 4 END), 0) AS avg_ms
  FROM attempts GROUP BY source_url), """
    + READS
    + """, readings AS (
  SELECT source_url, count(*) FILTER (chapters) AS read_ok, count(*) FILTER (NOT chapters) AS read_fail
  FROM reads GROUP BY source_url), ranks AS (
  SELECT r.source_url,
         CASE WHEN coalesce(ok, 0) > 0 THEN 0 WHEN coalesce(fail, 0) >= 2 THEN 2 ELSE 1 END AS search_rank,
         CASE WHEN coalesce(read_ok, 0) > 0 THEN 0
              WHEN coalesce(read_fail, 0) > 0 AND read_fail >= coalesce(read_ok, 0) + 2 THEN 4
              WHEN coalesce(ok, 0) > 0 THEN 1 WHEN coalesce(fail, 0) >= 2 THEN 3 ELSE 2 END AS reading_rank
  FROM registry r LEFT JOIN health USING (source_url) LEFT JOIN readings USING (source_url))"""
)


def entities_sql(expr: str) -> str:
    """Decode the named references in one pass equivalent: the ampersand last."""
    pairs = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
    for ref, char in pairs:
        expr = f"replace({expr}, '{ref}', '{char}')"
    return expr


BLANKS = "\\x00-\\x20\u00a0\u3000"


def clean_sql(expr: str) -> str:
    """SQL of the markup-to-text cleaning."""
    t = f"replace(replace({expr}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    t = f"regexp_replace({t}, '(?i)</?(?:div|p|br|hr|h[1-6]|article|dd|dl)(?:[\\s/][^>]*)?>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<!--.*?-->', '', 'gs')"
    t = f"regexp_replace({t}, '<[^>]+>', '', 'g')"
    t = f"string_split(replace({entities_sql(t)}, chr(160), ' '), chr(10))"
    t = f"list_transform({t}, lambda x: regexp_replace(x, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g'))"
    return f"array_to_string(list_filter({t}, lambda x: x <> ''), chr(10))"


def collapse_sql(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '[ \\t\\r\\n\u00a0]+', ' ', 'g'))"
