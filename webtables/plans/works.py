"""Queries over hits and positions: merging, ranking, fall-back, progress, and the flagship query."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from webtables.functions.text import title_key
from webtables.functions.urls import host_of
from webtables.operators import joins as J
from webtables.operators import merge as M
from webtables.operators.extract import Field, extract_records
from webtables.operators.health import fold_health, fold_reads, health_ranks
from webtables.operators.nodes import Step
from webtables.session import settle
from webtables.operators.scan import ordinal, time_bucket
from webtables.plans.proxies import (
    ATTEMPTS, HEALTH, HITS, REGISTRY, TIE, Catalog, attempts, hits, reads, registry, table,
)

catalog = Catalog()
KEYWORD = "Red-Widget"
_TIE_SQL = "run_id, line, source_url, book_url"
_ORDER = f"arrival, {_TIE_SQL}"


def _ranks(spark, sf):
    """Classes of the sites, stored: a table of known size joins without a shuffle of the hits while it is small."""
    events = table(spark, sf, "events")
    return settle(health_ranks(registry(spark, sf), fold_health(attempts(events)), fold_reads(reads(events))))


_BASE = f"WITH {HITS}, {REGISTRY}, {HEALTH}"
_GROUPS = f"""grp AS (
  SELECT key, arg_min(name, (arrival, name)) AS name, count(*) AS offers, min(arrival) AS first_arrival FROM hits GROUP BY key)"""
_BEST = """best AS (SELECT key, min(coalesce(reading_rank, 2)) AS best_rank FROM hits LEFT JOIN ranks USING (source_url) GROUP BY key)"""
_CURRENT = f"""cur AS (SELECT key, arg_max(source_url, (arrival, {_TIE_SQL})) AS cur FROM hits GROUP BY key)"""
_RANKED = f"""ranked AS (
  SELECT h.*, coalesce(reading_rank, 2) AS rank, row_number() OVER (PARTITION BY h.key ORDER BY coalesce(reading_rank, 2),
    CASE WHEN h.source_url = cur THEN 0 ELSE 1 END, {_ORDER.replace('source_url', 'h.source_url')}) AS place
  FROM hits h JOIN cur ON cur.key = h.key LEFT JOIN ranks r ON r.source_url = h.source_url)"""


def _current(found):
    """The site in use for each work: here the one that arrived last; stored, as the classes are."""
    return settle(found.groupBy("key").agg(F.max_by("source_url", F.struct("arrival", *TIE)).alias("source_url")))


def _keyed(spark, sf):
    """Hits, stored once for the several uses of a query."""
    used = ["run_id", "line", "arrival", "source_url", "name", "book_url", "key"]
    return settle(hits(spark, sf).select(*used))



@catalog.add("x14_r03_nav_links_ranked", """
WITH nav AS (SELECT page_id, url, regexp_extract(html, '(?s)<nav>(.*?)(?:</nav>|$)', 1) AS seg FROM pages), l AS (
  SELECT page_id, url, regexp_extract_all(seg, '<a href="([^"]*)">([^<]*)', 1) AS h,
         regexp_extract_all(seg, '<a href="([^"]*)">([^<]*)', 2) AS t FROM nav), f AS (
  SELECT page_id, url, unnest(range(len(h))) AS pos, unnest(h) AS href, unnest(t) AS name FROM l), k AS (
  SELECT *, lower(regexp_extract(url, '^https?://([^/:]*)', 1)) AS host, regexp_extract(url, '^(.*?://[^/]*)', 1) || href AS book_url,
         regexp_replace(lower(name), '[^\\p{L}\\p{Nd}]', '', 'g') AS key FROM f), g AS (
  SELECT key, arg_min(name, (page_id, pos)) AS name, count(*) AS offers, count(DISTINCT host) AS hosts FROM k WHERE key <> '' GROUP BY key)
SELECT *, row_number() OVER (ORDER BY hosts DESC, offers DESC, name, key) AS pos FROM g ORDER BY pos LIMIT 20""")
def nav_links_ranked(spark, sf):
    """Flagship: pages to nav link records, merged by title over hosts, the 20 best spread works."""
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    records = extract_records(
        pages, [Step("nav"), Step("li")], Step("a"), {"name": Field("text"), "book_url": Field("href")}, ["book_url"]
    )
    found = records.withColumn("host", host_of("book_url")).withColumn("key", title_key("name")).filter("key <> ''")
    # a title on very many pages shrinks to one row per host before it meets in one place
    by_host = found.groupBy("key", "host").agg(
        F.min(F.struct("page_id", "pos", "name")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    groups = by_host.groupBy("key").agg(
        F.min("first")["name"].alias("name"), F.sum("n").alias("offers"), F.count(F.lit(1)).alias("hosts")
    )
    order = [F.col("hosts").desc(), F.col("offers").desc(), F.col("name"), F.col("key")]
    top = groups.orderBy(*order).limit(20)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long"))  # 20 rows


@catalog.add("a01_merge_hits", f"WITH {HITS}, {_GROUPS} SELECT * FROM grp")
def merge_hits(spark, sf):
    return M.merge_hits(hits(spark, sf))


@catalog.add("a01_ordered_members", f"""
WITH {HITS} SELECT key, run_id, line, source_url, book_url, row_number() OVER (PARTITION BY key ORDER BY {_ORDER}) AS member FROM hits""")
def ordered_members(spark, sf):
    used = hits(spark, sf).select("key", "run_id", "line", "arrival", "source_url", "book_url")  # nothing else is put in order
    return M.offers(used, tie=TIE, name="key").select("key", "run_id", "line", "source_url", "book_url", "member")


@catalog.add("a01_one_title", f"""
WITH {HITS} SELECT run_id, line, source_url, row_number() OVER (ORDER BY run_id, line, source_url) AS member FROM hits""")
def one_title(spark, sf):
    """All hits under one title and one arrival: a single hot key whose order is all ties."""
    same = hits(spark, sf).withColumn("name", F.lit("one title")).withColumn("key", F.lit("one title")).withColumn("arrival", F.lit("2024-01-01").cast("timestamp"))
    return M.offers(same, tie=("run_id", "line", "source_url")).select("run_id", "line", "source_url", "member")


_OUTCOME = """o AS (SELECT run_id, source_url, min(CASE WHEN had_results THEN 0 WHEN error_class LIKE '%SSL%' THEN 2
  WHEN NOT reachable THEN 3 ELSE 1 END) AS best FROM attempts GROUP BY 1, 2)"""


@catalog.add("a02_search_accounting", f"""
WITH {HITS}, {ATTEMPTS}, {_OUTCOME}, s AS (
  SELECT run_id, count(*) AS sites, count(*) FILTER (best = 0) AS done, count(*) FILTER (best = 1) AS no_result,
         count(*) FILTER (best = 2) AS timed_out, count(*) FILTER (best = 3) AS skipped FROM o GROUP BY run_id), h AS (
  SELECT run_id, count(*) AS hits, count(DISTINCT key) AS works FROM hits GROUP BY run_id)
SELECT s.*, coalesce(hits, 0) AS hits, coalesce(works, 0) AS works FROM s LEFT JOIN h USING (run_id)""")
def search_accounting(spark, sf):
    outcome = (
        F.when(F.col("had_results"), "done").when(F.contains("error_class", F.lit("SSL")), "timed out")
        .when(~F.col("reachable"), "skipped").otherwise("empty")
    )
    log = attempts(table(spark, sf, "events")).withColumn("outcome", outcome)
    return M.search_summary(log, hits(spark, sf))


@catalog.add("a06_best_rank", f"{_BASE}, {_BEST} SELECT * FROM best")
def best_rank(spark, sf):
    return M.best_rank(_keyed(spark, sf), _ranks(spark, sf))


@catalog.add("r02_rank_offers", f"""
{_BASE}, {_CURRENT}, {_RANKED} SELECT key, run_id, line, source_url, book_url, rank AS reading_rank, place FROM ranked""")
def rank_offers(spark, sf):
    found = _keyed(spark, sf)
    ranked = M.rank_offers(found, _ranks(spark, sf), _current(found), tie=TIE)
    return ranked.select("key", "run_id", "line", "source_url", "book_url", "reading_rank", "place")


@catalog.add("r04_primary_offer", f"""
{_BASE}, {_CURRENT}, {_RANKED} SELECT key, source_url, book_url, rank AS reading_rank FROM ranked WHERE place = 1""")
def primary_offer(spark, sf):
    found = _keyed(spark, sf)
    return M.primary_offer(found, _ranks(spark, sf), _current(found), tie=TIE)


_RESULTS = f"""{_BASE}, {_GROUPS}, {_BEST}, res AS (
  SELECT row_number() OVER (ORDER BY key = 'redwidget' DESC, best_rank, offers DESC, name, key) AS pos, key, name,
         key = 'redwidget' AS exact, best_rank, offers FROM grp JOIN best USING (key))"""


@catalog.add("r03_result_order", f"{_RESULTS} SELECT * FROM res")
def result_order(spark, sf):
    found = _keyed(spark, sf)
    return M.rank_results(M.merge_hits(found), M.best_rank(found, _ranks(spark, sf)), KEYWORD)


@catalog.add("r05_top_results", f"""
{_RESULTS}, {_CURRENT}, {_RANKED} SELECT res.key, res.name, offers, exact, best_rank, ranked.source_url, ranked.book_url
FROM res JOIN ranked ON ranked.key = res.key AND place = 1 WHERE pos <= 6""")
def top_results(spark, sf):
    found, ranks = _keyed(spark, sf), _ranks(spark, sf)
    groups, best = M.merge_hits(found), M.best_rank(found, ranks)
    top = M.top_results(groups, best, found, ranks, KEYWORD, current=_current(found), tie=TIE)
    return top.select("key", "name", "offers", "exact", "best_rank", "source_url", "book_url")


@catalog.add("j04_next_alternative", f"""
{_BASE}, {_CURRENT}, {_RANKED}, fail AS (SELECT key, source_url AS fs, book_url AS fu FROM ranked WHERE place = 1), alt AS (
  SELECT h.key, h.source_url, h.book_url, coalesce(reading_rank, 2) AS reading_rank,
         row_number() OVER (PARTITION BY h.key ORDER BY coalesce(reading_rank, 2), {_ORDER.replace('source_url', 'h.source_url')}) AS n
  FROM hits h JOIN fail ON fail.key = h.key AND h.source_url <> fs AND h.book_url <> fu
  JOIN (SELECT source_url FROM registry WHERE enabled) e ON e.source_url = h.source_url LEFT JOIN ranks r ON r.source_url = h.source_url)
SELECT key, source_url, book_url, reading_rank FROM alt WHERE n = 1""")
def next_alternative(spark, sf):
    found, ranks = _keyed(spark, sf), _ranks(spark, sf)
    failed = settle(M.primary_offer(found, ranks, _current(found), tie=TIE))
    return M.next_alternative(found, ranks, failed, registry(spark, sf).filter("enabled"), tie=TIE)


def _books(found):
    """Chapters of a book: its hits in arrival order; returned items stand for empty bodies."""
    sliced = found.withColumn("_b", time_bucket("arrival", 86400))
    placed = ordinal(sliced, ["source_url", "book_url"], ["_b"], ["arrival", *TIE], "n")
    return placed.withColumn("idx", F.col("n") - 1).drop("_b", "n")


_FALLBACK = f"""{_BASE[5:]}, {_CURRENT}, {_RANKED}, fl AS (SELECT key, source_url AS fs, book_url AS fb FROM ranked WHERE place = 1), d AS (
  SELECT h.key, h.source_url, h.book_url, coalesce(min(reading_rank), 2) AS rank, min((arrival, {_TIE_SQL.replace('source_url', 'h.source_url')})) AS o
  FROM hits h JOIN (SELECT source_url FROM registry WHERE enabled) e ON e.source_url = h.source_url LEFT JOIN ranks r ON r.source_url = h.source_url GROUP BY 1, 2, 3), tr AS (
  SELECT d.key, d.source_url, d.book_url, row_number() OVER (PARTITION BY d.key ORDER BY rank, o) AS try FROM d JOIN fl ON fl.key = d.key
   AND d.source_url <> fs AND d.book_url <> fb), ch AS (
  SELECT *, row_number() OVER (PARTITION BY source_url, book_url ORDER BY {_ORDER}) - 1 AS idx FROM hits), tc AS (
  SELECT source_url, book_url, count(*) AS m FROM ch GROUP BY 1, 2), at3 AS (
  SELECT key, tr.source_url, tr.book_url, try, greatest(least(CAST(floor(2.5 / 7 * m) AS BIGINT), m - 1), 0) AS idx
  FROM tr JOIN tc ON tc.source_url = tr.source_url AND tc.book_url = tr.book_url WHERE try <= 3), ok AS (
  SELECT a.*, CASE WHEN run_id % 2 = 0 THEN '' ELSE 'body ' || run_id END AS content,
  FROM at3 a JOIN ch ON ch.source_url = a.source_url AND ch.book_url = a.book_url AND ch.idx = a.idx)"""


@catalog.add("j05_fallback_body", f"""
WITH {_FALLBACK} SELECT key, CAST(2 AS INT) AS chapter_index, arg_min(source_url, try) AS source_url, arg_min(book_url, try) AS book_url,
  CAST(arg_min(idx, try) AS INT) AS idx, CAST(min(try) AS INT) AS try, arg_min(content, try) AS content
FROM ok WHERE content <> '' GROUP BY key""")
def fallback_body(spark, sf):
    found = _keyed(spark, sf)
    ranks = _ranks(spark, sf)
    failed = settle(M.primary_offer(found, ranks, _current(found), tie=TIE).select("key", "source_url", "book_url", F.lit(2).alias("chapter_index"), F.lit(7).alias("n_chapters")))
    tried = settle(M.fallback_offers(found, ranks, failed, registry(spark, sf).filter("enabled"), tie=TIE))
    # chapters are numbered inside a book, so only the books of the tried offers are put in order
    wanted = found.join(tried.select("source_url", "book_url").distinct(), ["source_url", "book_url"], "left_semi")
    chapters = _books(wanted)
    toc = wanted.groupBy("source_url", "book_url").agg(F.count(F.lit(1)).alias("n_chapters"))
    text = F.when(F.col("run_id") % 2 == 0, "").otherwise(F.concat(F.lit("body "), F.col("run_id").cast("string")))
    bodies = chapters.select("source_url", "book_url", "idx", text.alias("content"))
    out = J.fallback_body(tried, toc, bodies)
    return out.withColumn("idx", F.col("idx").cast("int"))


_TOCS = """a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events WHERE event_type = 'view'), b AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_id FROM events WHERE event_type = 'click')"""


def _toc(spark, sf, kind):
    found = table(spark, sf, "events").filter(F.col("event_type") == kind).withColumn("_b", time_bucket("ts", 86400))
    placed = ordinal(found, ["user_id"], ["_b"], ["ts", "event_id"], "n")
    return placed.select("user_id", (F.col("n") - 1).cast("int").alias("idx"), "event_id")


@catalog.add("j06_map_position", f"""
WITH {_TOCS}, na AS (SELECT user_id, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT user_id, count(*) AS m FROM b GROUP BY 1), p AS (
  SELECT a.user_id, idx AS chapter_index, CAST(greatest(least(floor((idx + 0.5) / n * m), m - 1), 0) AS INT) AS mapped
  FROM a JOIN na USING (user_id) JOIN nb USING (user_id))
SELECT p.user_id, CAST(chapter_index AS INT) AS chapter_index, mapped, event_id FROM p JOIN b ON b.user_id = p.user_id AND b.idx = mapped""")
def map_position(spark, sf):
    a, b = _toc(spark, sf, "view"), _toc(spark, sf, "click")
    progress = a.select("user_id", F.col("idx").alias("chapter_index"))
    return J.map_position(progress, a, b, ["user_id"]).select("user_id", "chapter_index", "mapped", "event_id")


def progress_log(orders):
    return orders.select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("item"),
        F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("chapter_index"),
        (F.col("o_orderstatus") != "P").alias("shelf"),
    )


RECENT = {"user": "user_id", "item": ["item"], "updated": "updated_at"}
RECENT_SQL = """WITH l AS (
  SELECT o_custkey AS user_id, o_orderpriority AS item, o_orderdate AS updated_at, o_orderkey AS chapter_index, o_orderstatus <> 'P' AS shelf,
         row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders), r AS (
  SELECT * EXCLUDE n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, item) AS INT) AS place FROM l WHERE n = 1)
SELECT * FROM r WHERE place <= 3"""


@catalog.add("r06_recent_items", RECENT_SQL)
def recent_items(spark, sf):
    return J.recent_items(progress_log(table(spark, sf, "orders")), 3, **RECENT)


@catalog.add("r06_shelf_items", RECENT_SQL + " AND shelf")
def shelf_items(spark, sf):
    return J.recent_items(progress_log(table(spark, sf, "orders")), 3, shelf="shelf", **RECENT)
