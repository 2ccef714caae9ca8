"""Queries over registries and attempt logs: upsert, health, dead hosts, lint, funnel."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.functions.urls import parse_headers
from webtables.operators import health as H
from webtables.operators import lint as L
from webtables.operators.joins import request_frontier
from webtables.plans.proxies import (
    ATTEMPTS, HEALTH, HITS, READS, REGISTRY, Catalog, attempts, hits, reads, registry, table,
)
from webtables.session import new_folder
from webtables.sources import files as SF
from webtables.sources import registry as S

catalog = Catalog()
RULES = [
    "//div[last()]/a", "class.list@tag.li.0@text##x|y##z", "$.data.list[?(@.a)]", "@js:java.get(cookie)", ".item:eq(2)",
    "{ruleless}", "//ul/following-sibling::p", "$.items.length()", "@js:cache.get('k')", "id.toc@tag.a@href",
]


def _attempts(spark, sf):
    return attempts(table(spark, sf, "events"))


def _ranks(spark, sf):
    events = table(spark, sf, "events")
    health, opened = H.fold_health(attempts(events)), H.fold_reads(reads(events))
    return H.health_ranks(registry(spark, sf), health, opened)


def _flat_rows(spark, sf):
    """Registry rows of the flat dialect, one per supplier."""
    s = table(spark, sf, "supplier")
    n = F.col("s_suppkey").cast("string")
    values = {
        "bookSourceName": F.when(F.col("s_nationkey") > 3, F.col("s_name")).otherwise(F.lit(" ")),
        "bookSourceUrl": F.concat(F.lit(" https://s"), n, F.lit(".example.com ")),
        "bookSourceType": F.when(F.col("s_nationkey") < 5, "AUDIO").otherwise(""),
        "serialNumber": F.col("s_nationkey"),
        "httpUserAgent": F.concat(F.lit("agent/"), n),
        "ruleSearchUrl": F.concat(F.lit("/so?k=searchKey&p=searchPage+1&s="), n, F.lit("|charset=gbk")),
        "ruleFindUrl": F.concat(F.lit("/a?p=<searchPage>&&/b@key=searchKey&n="), n),
        "ruleSearchList": F.concat(F.lit("-class.c"), n, F.lit("|tag.li#a|b")),
        "ruleSearchName": F.lit("tag.a@text&tag.b@text"),
        "ruleBookContent": F.concat(F.lit("$x"), n),
    }
    fields = [f.strip().split(" ", 1) for f in _top_level(S.RAW_SCHEMA)]
    return s.select(*[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])


def _top_level(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


_FLAT = """flat AS (SELECT 'https://s' || s_suppkey || '.example.com' AS source_url,
  CASE WHEN s_nationkey > 3 THEN s_name ELSE 'https://s' || s_suppkey || '.example.com' END AS name,
  CASE WHEN s_nationkey < 5 THEN 1 ELSE 0 END AS type, s_nationkey AS "order", 'User-Agent@agent/' || s_suppkey AS header,
  '/so?k={{key}}&p={{page+1}}&s=' || s_suppkey || ',{"charset":"gbk"}' AS search_url,
  '/a?p={{page}}' || chr(10) || '/b,{"method":"POST","body":"key={{key}}&n=' || s_suppkey || '"}' AS explore_url,
  '-class.c' || s_suppkey || '||tag.li##a|b' AS list_rule, 'tag.a@text&&tag.b@text' AS name_rule,
  'x' || s_suppkey AS content_rule FROM supplier)"""


@catalog.add("s01_s04_upgrade_flat_registry", f"WITH {_FLAT} SELECT * FROM flat")
def upgrade_flat_registry(spark, sf):
    rows = S.parse_registry(_flat_rows(spark, sf))
    return rows.select(
        "source_url", "name", "type", "order", "header", "search_url", "explore_url",
        F.col("ruleSearch.bookList").alias("list_rule"), F.col("ruleSearch.name").alias("name_rule"),
        F.col("ruleContent.content").alias("content_rule"),
    )


@catalog.add("s02_source_types", """
SELECT CASE WHEN s_nationkey < 8 THEN s_nationkey % 4 WHEN s_nationkey < 14 THEN 1 WHEN s_nationkey < 20 THEN 2 ELSE 0 END AS type,
       count(*) AS sites FROM supplier GROUP BY 1""")
def source_types(spark, sf):
    n = F.col("s_nationkey")
    raw = (
        F.when(n < 8, (n % 4).cast("string")).when(n < 11, "AudioBook").when(n < 14, "听书")
        .when(n < 20, " 图片 ").otherwise("text")
    )
    return table(spark, sf, "supplier").groupBy(S.source_type(raw).alias("type")).agg(F.count(F.lit(1)).alias("sites"))


@catalog.add("s03_parse_headers", """
SELECT s_suppkey, s_name AS agent, 'b@' || s_suppkey AS cookie, CAST(2 AS BIGINT) AS names FROM supplier""")
def headers(spark, sf):
    n = F.col("s_suppkey").cast("string")
    block = F.concat(F.lit("Cookie@a\\nUser-Agent @ "), "s_name", F.lit("\n\n@no\nnone\nCookie@b@"), n)
    parsed = table(spark, sf, "supplier").select("s_suppkey", parse_headers(block).alias("h"))
    return parsed.select("s_suppkey", F.col("h")["User-Agent"].alias("agent"), F.col("h")["Cookie"].alias("cookie"),
                         F.size("h").cast("long").alias("names"))


@catalog.add("s05_rewrite_rules", """
SELECT s_suppkey, '+class.a||id.b' || s_suppkey || '##x|y' AS css, '//a|//b#' || s_suppkey AS path,
       '/a&b' || s_suppkey AS rooted, 'a&&b' || s_suppkey AS pair FROM supplier""")
def rewrite_rules(spark, sf):
    n = F.col("s_suppkey").cast("string")
    rule = lambda *parts: S.rewrite_rule(F.concat(*parts))
    return table(spark, sf, "supplier").select(
        "s_suppkey", rule(F.lit(" +class.a|id.b"), n, F.lit("#x|y ")).alias("css"),
        rule(F.lit("//a|//b#"), n).alias("path"), rule(F.lit("/a&b"), n).alias("rooted"),
        rule(F.lit("a&b"), n).alias("pair"),
    )


@catalog.add("s06_rewrite_urls", """
SELECT s_suppkey, 'https://h/s?q={{key}}&p={{page-1}}&x=<' || s_suppkey || '>,{"headers":{"A":"' || s_suppkey || '"},"charset":"gbk"}' AS get,
       '/s,{"method":"POST","body":"k={{key}}&p={{(page-1)*20}}&n=' || s_suppkey || '"}' AS post FROM supplier""")
def rewrite_urls(spark, sf):
    n = F.col("s_suppkey").cast("string")
    get = F.concat(F.lit("https://h/s?q=searchKey&p=searchPage-1&x={"), n, F.lit("}@Header:{A:\""), n, F.lit('"}|charset=gbk'))
    post = F.concat(F.lit("/s@k=searchKey&p={{(searchPage-1)*20}}&n="), n)
    return table(spark, sf, "supplier").select("s_suppkey", S.rewrite_url(get).alias("get"), S.rewrite_url(post).alias("post"))


def _two_batches(spark, sf):
    reg = registry(spark, sf).select("source_url", "pos", "name", "type")
    current = reg.filter(F.col("type") != 1)
    renamed = reg.filter(F.col("type") != 2).withColumn("name", F.concat("name", F.lit("*")))
    again = renamed.withColumn("name", F.concat("name", F.lit("*"))).withColumn("pos", F.col("pos") + 100_000_000)
    blank = reg.filter(F.col("type") == 3).withColumn("source_url", F.lit(""))
    return current, renamed.unionByName(again).unionByName(blank)


_UPSERT = f"""WITH {REGISTRY}, cur AS (SELECT * FROM registry WHERE type <> 1), b AS (
  SELECT source_url, name || '**' AS name, type, pos FROM registry WHERE type <> 2)
"""


@catalog.add("s07_upsert_registry", _UPSERT + """
SELECT source_url, name, type, row_number() OVER (ORDER BY fresh, pos) - 1 AS pos FROM (
  SELECT source_url, coalesce(b.name, cur.name) AS name, coalesce(b.type, cur.type) AS type,
         CASE WHEN cur.source_url IS NULL THEN 1 ELSE 0 END AS fresh, coalesce(cur.pos, b.pos) AS pos
  FROM cur FULL JOIN b USING (source_url))""")
def upsert_registry(spark, sf):
    current, batch = _two_batches(spark, sf)
    return S.upsert_registry(current, batch)[0]


@catalog.add("s07_upsert_counts", _UPSERT + """
SELECT (SELECT count(*) FROM b WHERE type = 1) AS added, 2 * (SELECT count(*) FROM b) - (SELECT count(*) FROM b WHERE type = 1) AS updated,
       (SELECT count(*) FROM registry WHERE type = 3) AS failed""")
def upsert_counts(spark, sf):
    current, batch = _two_batches(spark, sf)
    return S.upsert_registry(current, batch)[1]


@catalog.add("s08_export_registry", f"""
WITH {_FLAT} SELECT source_url, name, list_rule, explore_url AS explore, CAST(NULL AS VARCHAR) AS pattern FROM flat""")
def export_registry(spark, sf):
    lines = S.registry_json(S.parse_registry(_flat_rows(spark, sf)))
    get = lambda p: F.get_json_object("value", p)
    return lines.select(
        get("$.bookSourceUrl").alias("source_url"), get("$.bookSourceName").alias("name"),
        get("$.ruleSearch.bookList").alias("list_rule"), get("$.exploreUrl").alias("explore"),
        get("$.bookUrlPattern").alias("pattern"),
    )


@catalog.add("s08_round_trip", catalog.sql["s01_s04_upgrade_flat_registry"])
def registry_round_trip(spark, sf):
    """Exported as lines and read again, in parallel, by the reader."""
    folder = new_folder(spark, "registry")
    S.export_registry(S.parse_registry(_flat_rows(spark, sf)), folder)
    return S.read_registry_lines(spark, folder).select(
        "source_url", "name", "type", "order", "header", "search_url", "explore_url", F.col("ruleSearch.bookList").alias("list_rule"),
        F.col("ruleSearch.name").alias("name_rule"), F.col("ruleContent.content").alias("content_rule"))


@catalog.add("s09_eligible_sites", f"""
WITH {REGISTRY} SELECT source_url, name FROM registry WHERE enabled AND type = 0 AND search_url <> '' AND list_rule <> ''""")
def eligible_sites(spark, sf):
    return S.eligible(registry(spark, sf))[0].select("source_url", "name")


@catalog.add("s09_reject_reasons", f"""
WITH {REGISTRY} SELECT CASE WHEN NOT enabled THEN 'disabled' WHEN type <> 0 THEN 'not text'
  WHEN search_url = '' OR list_rule = '' THEN 'no search rules' ELSE 'kept' END AS reason, count(*) AS sites FROM registry GROUP BY 1""")
def reject_reasons(spark, sf):
    return S.eligible(registry(spark, sf))[1]


@catalog.add("s12_host_listing", f"""
WITH {ATTEMPTS}, s AS (SELECT DISTINCT host, source_url FROM attempts)
SELECT host, 'site of ' || host AS name, source_url, count(*) OVER (PARTITION BY host) AS sites FROM s""")
def host_listing(spark, sf):
    sites = _attempts(spark, sf).select("host", "source_url").distinct()
    return SF.host_listing(sites.withColumn("name", F.concat(F.lit("site of "), "host")))


@catalog.add("s12_report", f"""
WITH {ATTEMPTS}, s AS (SELECT DISTINCT host, source_url FROM attempts)
SELECT host, 'site of ' || host AS name, source_url, CAST(count(*) OVER (PARTITION BY host) AS VARCHAR) AS sites FROM s""")
def report(spark, sf):
    folder = new_folder(spark, "report")
    SF.write_report(host_listing(spark, sf), folder)
    return spark.read.option("sep", "\t").option("header", True).csv(folder).select("host", "name", "source_url", "sites")


@catalog.add("s13_parse_log", """
SELECT 'attempted' AS field, count(*) AS matches, 0 AS positive, CAST(NULL AS DOUBLE) AS total, CAST(NULL AS DOUBLE) AS largest FROM events
UNION ALL SELECT 'parsed', count(*), count(*) FILTER (k > 0), sum(k), max(k) FROM (
  SELECT CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS k FROM events)
UNION ALL SELECT 'finished', count(*), 0, NULL, NULL FROM events WHERE event_type = 'purchase'""")
def parse_log(spark, sf):
    k = F.get_json_object("props", "$.k")
    lines = table(spark, sf, "events").select(
        F.concat(F.lit("01-01 I/App: engine.search s url=http://x -> "), k, F.lit(" books "),
                 F.when(F.col("event_type") == "purchase", "search done: ok").otherwise("")).alias("value")
    )
    patterns = {"attempted": r"engine\.search .*url=", "parsed": r"engine\.search .*-> (\d+) books", "finished": "search done:"}
    return SF.log_summary(SF.parse_log(lines, patterns))


# ------------------------------------------------------------------ health


@catalog.add("a03_fold_health", f"WITH {REGISTRY}, {HEALTH} SELECT source_url, ok, fail, last_ok, last_try, avg_ms FROM health")
def fold_health(spark, sf):
    return H.fold_health(_attempts(spark, sf))


@catalog.add("a04_fold_reads", f"""
WITH {READS} SELECT source_url, count(*) FILTER (chapters) AS read_ok, count(*) FILTER (NOT chapters) AS read_fail
FROM reads GROUP BY source_url""")
def fold_reads(spark, sf):
    return H.fold_reads(reads(table(spark, sf, "events")))


@catalog.add("a05_health_classes", f"WITH {REGISTRY}, {HEALTH} SELECT * FROM ranks")
def health_classes(spark, sf):
    return _ranks(spark, sf)


@catalog.add("a05_known_good", f"""
WITH {REGISTRY}, {HEALTH} SELECT count(*) FILTER (ok > 0) AS known_good, count(*) AS sites FROM health""")
def known_good(spark, sf):
    return H.known_good(H.fold_health(_attempts(spark, sf)))


@catalog.add("a08_type_census", f"WITH {REGISTRY} SELECT type, count(*) AS sites FROM registry GROUP BY type")
def type_census(spark, sf):
    return L.type_census(registry(spark, sf))


@catalog.add("r01_site_order", f"""
WITH {REGISTRY}, {HEALTH} SELECT source_url, name, search_rank, last_ok,
  row_number() OVER (ORDER BY search_rank, last_ok DESC NULLS LAST, name, source_url) AS pos
FROM registry LEFT JOIN health USING (source_url) JOIN ranks USING (source_url)""")
def site_order(spark, sf):
    return H.order_sites(registry(spark, sf), H.fold_health(_attempts(spark, sf)))


@catalog.add("r07_prune_health", f"""
WITH {REGISTRY}, {HEALTH} SELECT source_url, last_try FROM health ORDER BY last_try DESC, source_url LIMIT 40""")
def prune_health(spark, sf):
    return H.prune_health(H.fold_health(_attempts(spark, sf)), 40).select("source_url", "last_try")


_FLAGS = """EXISTS (SELECT 1 FROM attempts b WHERE b.host = a.host AND (b.ts, b.seq) < (a.ts, a.seq)
  AND ({cls}) AND b.ts + INTERVAL {ttl} SECOND > a.ts)"""
DEAD_SQL = ATTEMPTS + ", flagged AS (SELECT *, " + _FLAGS.format(
    cls="b.error_class LIKE '%ConnectException' OR b.error_class LIKE '%SocketTimeoutException'", ttl=21600
) + " AS dead, " + _FLAGS.format(cls="b.error_class LIKE '%SSL%'", ttl=43200) + " AS plain_http FROM attempts a)"


@catalog.add("j07_dead_intervals", f"WITH {DEAD_SQL} SELECT seq, host, dead, plain_http FROM flagged")
def dead_intervals(spark, sf):
    return H.flag_dead(_attempts(spark, sf), ttl=21600, https_ttl=43200).select("seq", "host", "dead", "plain_http")


@catalog.add("j07_dead_by_message_and_cause", f"WITH {DEAD_SQL} SELECT seq, host, dead, plain_http FROM flagged")
def dead_by_message(spark, sf):
    """The same failures told by message (handshakes) and by the wrapped failure (refused and unresolved hosts)."""
    cls = F.coalesce("error_class", F.lit(""))
    wrapped = cls.rlike("ConnectException|UnknownHost")
    told = _attempts(spark, sf).select(
        "*", F.when(F.contains(cls, F.lit("SSL")), "Certificate expired").alias("message"), F.when(wrapped, F.col("error_class")).alias("cause")).withColumn(
        "error_class", F.when(wrapped | F.contains(cls, F.lit("SSL")), "java.io.IOException").otherwise(F.col("error_class")))
    return H.flag_dead(told, ttl=21600, https_ttl=43200, message="message", cause="cause").select("seq", "host", "dead", "plain_http")


@catalog.add("r08_defer_dead_hosts", f"""
WITH {ATTEMPTS}, dead AS (SELECT DISTINCT host FROM attempts WHERE error_class LIKE '%UnknownHost%')
SELECT run_id, seq, CAST(host IN (FROM dead) AS INT) AS deferred,
       row_number() OVER (PARTITION BY run_id ORDER BY host IN (FROM dead), seq) AS place FROM attempts""")
def defer_dead_hosts(spark, sf):
    log = _attempts(spark, sf)
    dead = log.filter(F.contains("error_class", F.lit("UnknownHost"))).select("host")
    return H.defer_dead(log.select("run_id", "seq", "host"), dead, pos="seq").select("run_id", "seq", "deferred", "place")


@catalog.add("t04_search_deadline", f"""
WITH {ATTEMPTS} SELECT run_id, seq, CASE WHEN ts > min(ts) OVER (PARTITION BY run_id) + INTERVAL 7200 SECOND
  THEN 'timed out' ELSE 'run' END AS outcome FROM attempts""")
def search_deadline(spark, sf):
    return H.apply_deadline(_attempts(spark, sf), 7200).select("run_id", "seq", "outcome")


@catalog.add("a13_probe_summary", f"""
WITH {ATTEMPTS}, r AS (SELECT source_url, reachable, coalesce(error_class, '') AS reason, count(*) AS n FROM attempts GROUP BY 1, 2, 3), f AS (
  SELECT source_url, reason, row_number() OVER (PARTITION BY source_url ORDER BY n DESC, reason) AS k FROM r WHERE NOT reachable)
SELECT source_url, CAST(sum(n) AS BIGINT) AS tries, CAST(coalesce(sum(n) FILTER (reachable), 0) AS BIGINT) AS ok,
       CAST(coalesce(sum(n) FILTER (NOT reachable), 0) AS BIGINT) AS failed, max(f.reason) AS top_reason
FROM r LEFT JOIN (SELECT * FROM f WHERE k = 1) f USING (source_url) GROUP BY source_url""")
def probe_summary(spark, sf):
    log = _attempts(spark, sf).select("source_url", "reachable", F.coalesce("error_class", F.lit("")).alias("reason"))
    return H.probe_summary(log, "source_url", "reachable", "reason").withColumnRenamed("reachable", "ok")


@catalog.add("a13_probe_totals", f"""
WITH {ATTEMPTS} SELECT count(*) FILTER (reachable) AS ok, count(*) FILTER (NOT reachable) AS fail, count(*) AS total FROM attempts""")
def probe_totals(spark, sf):
    return H.probe_totals(_attempts(spark, sf), "reachable")


@catalog.add("a14_failure_classes", """
SELECT CASE WHEN event_type = 'error' THEN 'unreachable' WHEN event_type = 'signup' OR event_id % 7 = 0 THEN 'page' ELSE 'ok' END AS class,
       count(*) AS fetches FROM events GROUP BY 1""")
def failure_classes(spark, sf):
    events = table(spark, sf, "events")
    log = attempts(events).withColumn("code", F.when(F.col("seq") >= 0, 200))
    kinds = log.join(events.select(F.col("event_id").alias("seq"), "event_type"), "seq")
    code = F.when(F.col("event_type") == "signup", 404).otherwise(200)
    body = F.when(F.col("seq") % 7 != 0, F.lit("body"))
    cls = H.classify_failure(F.when(~F.col("reachable"), F.col("error_class")), "error_class", code, body)
    return kinds.groupBy(cls.alias("class")).agg(F.count(F.lit(1)).alias("fetches"))


# ------------------------------------------------------------------ lint and funnel


def _rules(spark, sf):
    """One rule per event: the event's number picks the rule text, the user is the site."""
    events = table(spark, sf, "events")
    texts = F.array(*[F.lit(r) for r in RULES])
    pick = (F.col("event_id") % F.lit(len(RULES))).cast("int")
    return events.select(F.col("user_id").alias("source_url"), "event_id", F.element_at(texts, pick + 1).alias("rule"))


_EXPECTED = """lint AS (SELECT user_id AS source_url, event_id, CASE event_id % 10 WHEN 0 THEN 'XPath function'
  WHEN 2 THEN 'JSONPath filter' WHEN 4 THEN 'CSS index pseudo-class' WHEN 6 THEN 'XPath axis' WHEN 7 THEN 'JSONPath function'
  WHEN 8 THEN 'script cache object not provided' END AS reason FROM events)"""


@catalog.add("a09_lint_rules", f"WITH {_EXPECTED} SELECT event_id, reason FROM lint")
def lint_rules(spark, sf):
    return L.lint_rules(_rules(spark, sf)).select("event_id", "reason")


@catalog.add("a10_site_verdicts", f"""
WITH {_EXPECTED}, t AS (SELECT user_id AS source_url, CAST(min(event_id) % 3 AS INT) AS type FROM events GROUP BY 1)
SELECT source_url, t.type, count(*) AS rules, count(reason) AS unsupported,
       CASE WHEN t.type = 0 AND count(reason) = 0 THEN 'COMPATIBLE' ELSE 'PARTIAL' END AS verdict
FROM lint JOIN t USING (source_url) GROUP BY source_url, t.type""")
def site_verdicts(spark, sf):
    types = table(spark, sf, "events").groupBy(F.col("user_id").alias("source_url")).agg(
        (F.min("event_id") % 3).cast("int").alias("type"))
    return L.site_verdicts(L.lint_rules(_rules(spark, sf)), types)


@catalog.add("a10_verdict_summary", f"""
WITH {REGISTRY}, v AS (SELECT *, type = 0 AND search_url <> '' AS good FROM registry)
SELECT count(*) AS sites, count(*) FILTER (good) AS compatible, round(count(*) FILTER (good) * 100.0 / count(*), 1) AS percent FROM v""")
def verdict_summary(spark, sf):
    reg = registry(spark, sf)
    rule = F.when(F.col("search_url") == "", F.lit("$.a[?(@.b)]")).otherwise(F.col("list_rule"))
    lint = L.lint_rules(reg.select("source_url", rule.alias("rule")).filter("rule <> ''"))
    return L.verdict_summary(L.site_verdicts(lint, reg))


@catalog.add("a11_construct_histogram", """
SELECT label, count(*) AS occurrences, count(DISTINCT user_id) AS sites FROM (
  SELECT user_id, unnest(CASE event_id % 10 WHEN 0 THEN ['XPath function'] WHEN 2 THEN ['JSONPath filter']
    WHEN 3 THEN ['JS Java access', 'JS host object'] WHEN 4 THEN ['CSS pseudo-class'] WHEN 6 THEN ['XPath axis']
    WHEN 7 THEN ['JSONPath function'] WHEN 8 THEN ['JS host object'] ELSE [] END) AS label FROM events) GROUP BY label""")
def construct_histogram(spark, sf):
    return L.construct_histogram(L.lint_rules(_rules(spark, sf)))


_SITES = f"""WITH {REGISTRY}, {ATTEMPTS}, r AS (SELECT DISTINCT host FROM attempts WHERE had_results), s AS (
  SELECT source_url, regexp_extract(source_url, '//([^/]*)', 1) AS host, type, 3 AS rules, CASE WHEN enabled THEN 0 ELSE 2 END AS bad,
         search_url <> '' AS has_entry, list_rule <> '' AS has_toc, pos % 5 <> 0 AS has_content FROM registry), f AS (
  SELECT *, host IN (FROM r) AS reachable, type = 0 AS text, type = 0 AND bad = 0 AND rules > 0 AS clean FROM s), g AS (
  SELECT *, clean AND has_entry AND has_toc AND has_content AS complete FROM f), u AS (
  SELECT *, complete AND reachable AS usable, text AND bad > 0 AND reachable AS fixable FROM g)"""


def _usability(spark, sf):
    sites = registry(spark, sf).select(
        "source_url", F.regexp_extract("source_url", "//([^/]*)", 1).alias("host"), "type", F.lit(3).alias("rules"),
        F.when(F.col("enabled"), 0).otherwise(2).alias("bad"), (F.col("search_url") != "").alias("has_entry"),
        (F.col("list_rule") != "").alias("has_toc"), (F.col("pos") % 5 != 0).alias("has_content"),
    )
    return L.usability(sites, _attempts(spark, sf).filter("had_results").select("host"))


@catalog.add("a12_usability_funnel", _SITES + """
SELECT count(*) AS sites, count(*) FILTER (text) AS text, count(*) FILTER (text AND bad > 0) AS unsupported,
  count(*) FILTER (text AND rules = 0) AS without_rules, count(*) FILTER (clean) AS clean, count(*) FILTER (complete) AS complete,
  count(*) FILTER (usable) AS usable, count(*) FILTER (fixable) AS fixable, count(DISTINCT host) AS hosts,
  count(DISTINCT host) FILTER (reachable) AS reachable_hosts FROM u""")
def usability_funnel(spark, sf):
    return L.usability_funnel(_usability(spark, sf))


@catalog.add("a12_usable_per_host", _SITES + """
SELECT host, count(*) AS sites FROM u WHERE usable GROUP BY host ORDER BY sites DESC, host LIMIT 30""")
def usable_per_host(spark, sf):
    return L.usable_per_host(_usability(spark, sf))


@catalog.add("a12_fixable_sites", _SITES + " SELECT source_url, host FROM u WHERE fixable")
def fixable_sites(spark, sf):
    return _usability(spark, sf).filter("fixable").select("source_url", "host")


@catalog.add("a15_quality_gate", """
WITH toc AS (SELECT source, count(*) AS chapters FROM documents GROUP BY source), b AS (
  SELECT source, CAST(max(n_chars) AS INT) AS chars FROM documents GROUP BY source), p AS (
  SELECT source, count(*) AS pages FROM documents WHERE lang = 'fr' GROUP BY source)
SELECT source AS source_url, chapters, chars, coalesce(pages, 0) AS pages,
       CASE WHEN chapters >= 45 AND chars >= 9000 AND coalesce(pages, 0) >= 2 THEN 'pass' ELSE 'fail' END AS result
FROM toc JOIN b USING (source) LEFT JOIN p USING (source)""")
def quality_gate(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("source_url"), F.col("text").alias("content"), "lang")
    limits = docs.select("source_url").distinct().select(
        "source_url", F.lit(45).alias("min_chapters"), F.lit(9000).alias("min_chars"))
    return L.qa_gate(docs, docs, docs.filter("lang = 'fr'"), limits)


@catalog.add("j01_request_frontier", f"""
WITH {REGISTRY} SELECT source_url, k AS keyword, CAST(p AS INT) AS page, source_url || '/search?q=' || replace(k, ' ', '+') || '&p=' || p AS request_url
FROM registry, (VALUES ('red widget'), ('gear')) AS w(k), range(1, 4) AS r(p) WHERE search_url <> ''""")
def frontier(spark, sf):
    sites = registry(spark, sf).filter("search_url <> ''")
    return request_frontier(sites, ["red widget", "gear"], 3).select("source_url", "keyword", "page", "request_url")


@catalog.add("j02_hits_with_registry", f"""
WITH {HITS}, {REGISTRY} SELECT type, enabled, count(*) AS hits FROM hits JOIN registry USING (source_url) GROUP BY 1, 2""")
def hits_with_registry(spark, sf):
    from webtables.operators.joins import join_registry

    reg = registry(spark, sf).select("source_url", "type", "enabled")
    return join_registry(hits(spark, sf).select("source_url"), reg).groupBy("type", "enabled").agg(
        F.count(F.lit(1)).alias("hits"))
