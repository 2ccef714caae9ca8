"""Queries over the page table: shredding, selection, records, urls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtables.functions import text as T
from webtables.functions import urls as U
from webtables.operators import extract as E
from webtables.operators import lint as L
from webtables.operators import nodes as N
from webtables.operators import records as R
from webtables.operators.joins import reachable_hosts, usable
from webtables.operators.walk import assemble_bodies, walk_pages
from webtables.session import settle, spread
from webtables.plans.proxies import Catalog, clean_sql, collapse_sql, entities_sql, table

catalog = Catalog()
NAV = [N.Step("nav"), N.Step("li"), N.Step("a")]

_NAV_SQL = """nav AS (
  SELECT page_id, url, regexp_extract(html, '(?s)<nav>(.*?)(?:</nav>|$)', 1) AS seg FROM pages), links AS (
  SELECT page_id, url, regexp_extract_all(seg, '<a href="([^"]*)">([^<]*)', 1) AS h,
         regexp_extract_all(seg, '<a href="([^"]*)">([^<]*)', 2) AS t FROM nav), flat AS (
  SELECT page_id, url, unnest(range(len(h))) AS pos, unnest(h) AS href, unnest(t) AS label FROM links)"""
_LABEL = collapse_sql(entities_sql("label"))
_ORIGIN = "regexp_extract(url, '^(.*?://[^/]*)', 1)"
_HOST = "lower(regexp_extract(url, '^https?://([^/:]*)', 1))"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("pos", F.row_number().over(Window.partitionBy("page_id").orderBy(*order)).cast("long") - 1)


@catalog.add("x01_shred_tag_counts", """
SELECT tag, count(*) AS nodes, count(DISTINCT page_id) AS pages FROM (
  SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<([a-z][a-z0-9]*)[^<>]*>', 1)) AS tag
  FROM pages) GROUP BY tag""")
def shred_tag_counts(spark, sf):
    per_page = N.shred(_pages(spark, sf)).groupBy("tag", "page_id").agg(F.count(F.lit(1)).alias("n"))
    return per_page.groupBy("tag").agg(F.sum("n").alias("nodes"), F.count(F.lit(1)).alias("pages"))


@catalog.add("x02_select_nav_links", f"WITH {_NAV_SQL} SELECT page_id, pos, href, {_LABEL} AS label FROM flat")
def select_nav_links(spark, sf):
    links = N.select(N.shred(_pages(spark, sf), text_for=["a"]), NAV)
    return _numbered(links, "pre").select(
        "page_id", "pos", N.value_of("href").alias("href"), N.value_of("text").alias("label")
    )


@catalog.add("x03_select_union", """
SELECT page_id, len(regexp_extract_all(html, '<h1>')) AS headings, len(regexp_extract_all(html, '<p>')) AS paragraphs
FROM pages WHERE len(regexp_extract_all(html, '<h1>|<p>')) > 0""")
def select_union(spark, sf):
    nodes = N.shred(_pages(spark, sf))
    found = N.select_any(nodes, [[N.Step("article"), N.Step("h1", child=True)], [N.Step("article"), N.Step("p")],
                                 [N.Step("p")]])
    return found.groupBy("page_id").agg(
        F.count_if(F.col("tag") == "h1").alias("headings"), F.count_if(F.col("tag") == "p").alias("paragraphs")
    )


@catalog.add("x04_pick_by_index", f"""
WITH {_NAV_SQL} SELECT page_id, h[1] AS first_href, h[-1] AS last_href FROM links WHERE len(h) > 0""")
def pick_by_index(spark, sf):
    links = settle(N.select(N.shred(_pages(spark, sf)), NAV).select("page_id", "pre", "attrs"))
    first = N.nth(links, 0).select("page_id", N.value_of("href").alias("first_href"))
    last = N.nth(links, -1).select("page_id", N.value_of("href").alias("last_href"))
    return first.join(last, "page_id")


@catalog.add("x05_exclude_by_index", f"WITH {_NAV_SQL} SELECT page_id, pos, href FROM flat WHERE pos NOT IN (0, 2)")
def exclude_by_index(spark, sf):
    links = N.select(N.shred(_pages(spark, sf)), NAV)
    placed = _numbered(links, "pre")
    return N.exclude(placed, [0, 2]).select("page_id", "pos", N.value_of("href").alias("href"))


@catalog.add("x06_rows_of_containers", f"WITH {_NAV_SQL} SELECT page_id, pos, {_LABEL} AS label FROM flat")
def rows_of_containers(spark, sf):
    found = N.rows(N.shred(_pages(spark, sf), text_for=["li"]), [N.Step("nav"), N.Step("ul", child=True)], N.Step("li"))
    return _numbered(found, "scope_pre", "pre").select("page_id", "pos", N.value_of("text").alias("label"))


@catalog.add("x07_extract_values", f"""
SELECT page_id, {collapse_sql("regexp_extract(html, '(?s)<title>(.*?)(?:</title|$)', 1)")} AS title,
       {collapse_sql(entities_sql("regexp_extract(html, '(?s)<h1>(.*?)(?:<|$)', 1)"))} AS heading,
       regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang
FROM pages WHERE html LIKE '%<h1>%'""")
def extract_values(spark, sf):
    nodes = N.shred(_pages(spark, sf), text_for=["title", "h1"]).filter(F.col("tag").isin("title", "h1", "html"))
    pick = lambda tag, kind: F.max(F.when(F.col("tag") == tag, N.value_of(kind)))
    wide = nodes.groupBy("page_id").agg(
        pick("title", "text").alias("title"), pick("h1", "ownText").alias("heading"), pick("html", "lang").alias("lang")
    )
    return wide.filter("heading is not null")


@catalog.add("x07_extract_markup", """
SELECT page_id, '<ul>' || string_agg('<li><a href="' || href || '">' || label || '</a></li>', '' ORDER BY pos) || '</ul>' AS outer_html
FROM (""" + f"WITH {_NAV_SQL} SELECT * FROM flat" + ") GROUP BY page_id")
def extract_markup(spark, sf):
    lists = N.select(N.shred(_pages(spark, sf), html_for=["ul"]), [N.Step("nav"), N.Step("ul")])
    return lists.select("page_id", N.value_of("outerHtml").alias("outer_html"))


@catalog.add("x08_join_all_matches", f"""
WITH {_NAV_SQL} SELECT page_id, string_agg({_LABEL}, chr(10) ORDER BY pos) AS labels FROM flat
WHERE {_LABEL} <> '' GROUP BY page_id""")
def join_all_matches(spark, sf):
    links = N.select(N.shred(_pages(spark, sf), text_for=["a"]), NAV)
    return N.extract_joined(links, "text", name="labels")


@catalog.add("x09_path_select", f"""
WITH {_NAV_SQL} SELECT page_id, href, {_LABEL} AS label FROM flat WHERE pos = 1""")
def path_select(spark, sf):
    steps = [N.PathStep("nav"), N.PathStep("li", n=2), N.PathStep("a", deep=False, attr="href")]
    found = N.path_select(N.shred(_pages(spark, sf), text_for=["a"]), steps, first=True)
    return found.select("page_id", N.value_of("href").alias("href"), N.value_of("text").alias("label"))


@catalog.add("x10_json_path_values", """
SELECT event_id, CAST(0 AS BIGINT) AS pos, regexp_extract(props, '"k": *([0-9]+)', 1) AS item,
       regexp_extract(props, '"k": *([0-9]+)', 1) AS first FROM events""")
def json_path_values(spark, sf):
    nested = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit('{"d":{"l":['), "props", F.lit(',{"k":null},{"x":[1]}]}}')).alias("body")
    )
    listed = E.json_rows(nested, "body", ["d", "l", "*", "k"])
    return listed.select("event_id", F.col("pos").cast("long").alias("pos"), "item",
                         E.json_first("body", ["d", "l", -3, "k"]).alias("first"))


@catalog.add("x11_json_descend", """
SELECT event_id, CAST(p AS BIGINT) AS pos, regexp_extract(props, '"k": *([0-9]+)', 1) AS item
FROM events, (VALUES (0), (1)) AS v(p)""")
def json_descend(spark, sf):
    nested = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit('[{"a":{"b":'), "props", F.lit('}},{"c":['), "props", F.lit("]}]")).alias("body")
    )
    return E.json_descend(nested, "body", "k").select("event_id", F.col("pos").cast("long").alias("pos"), "item")


@catalog.add("x12_regex_rows", """
WITH m AS (SELECT page_id, regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 1) AS h,
                  regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 2) AS t FROM pages), f AS (
  SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS href, unnest(t) AS label FROM m)
SELECT page_id, pos, href, label, label || ' -> ' || href AS filled FROM f""")
def regex_rows(spark, sf):
    found = E.regex_rows(_pages(spark, sf).select("page_id", "html"), "html", '<a href="(/[^"]*)">([^<]*)</a>', 2)
    return found.select(
        "page_id", F.col("pos").cast("long").alias("pos"), F.col("groups")[1].alias("href"),
        F.col("groups")[2].alias("label"), E.fill_groups("$2 -> $1", "groups", 2).alias("filled"),
    )


@catalog.add("x13_body_kind", """
SELECT kind, count(*) AS bodies FROM (SELECT 'html' AS kind FROM pages UNION ALL SELECT 'json' FROM events) GROUP BY kind""")
def body_kind(spark, sf):
    bodies = _pages(spark, sf).select(F.concat(F.lit(" \n"), "html").alias("body")).unionByName(
        table(spark, sf, "events").select(F.col("props").alias("body"))
    )
    return bodies.groupBy(E.body_kind("body").alias("kind")).agg(F.count(F.lit(1)).alias("bodies"))


_RECORDS = f"""WITH {_NAV_SQL} SELECT page_id, pos, {_LABEL} AS name, {_ORIGIN} || href AS url FROM flat"""


def nav_records(spark, sf):
    return E.extract_records(
        _pages(spark, sf), [N.Step("nav")], N.Step("li"),
        {"name": E.Field("text", (N.Step("a"),)), "url": E.Field("href", (N.Step("a"),))}, ["url"],
    )


@catalog.add("x14_extract_records", _RECORDS)
def extract_records(spark, sf):
    return nav_records(spark, sf).select("page_id", F.col("pos").cast("long").alias("pos"), "name", "url")


@catalog.add("x15_extract_many_sites", f"""
WITH {_NAV_SQL}, h AS (SELECT *, {_HOST} AS site FROM flat), p AS (SELECT page_id, html, {_HOST} AS site FROM pages)
SELECT page_id, site, {_LABEL} AS name, href AS url FROM h WHERE site LIKE '%.com'
UNION ALL
SELECT page_id, site, {collapse_sql(entities_sql("regexp_extract(html, '(?s)<h1>(.*?)(?:<|$)', 1)"))} AS name, '' AS url
FROM p WHERE site NOT LIKE '%.com' AND html LIKE '%<h1>%'""")
def extract_many_sites(spark, sf):
    pages = _pages(spark, sf)
    sites = pages.select(U.host_of("url").alias("site")).distinct()
    shape = "field string, step int, child boolean, tag string, cls string, attr string, op string, value string, kind string"
    listed = spark.createDataFrame(
        [("row", 0, False, "nav", None, None, None, None, None), ("row", 1, False, "li", None, None, None, None, None),
         ("name", 0, False, "li", None, None, None, None, None), ("name", 1, True, "a", None, None, None, None, "text"),
         ("url", 0, False, "a", None, "href", "^=", "/", "href")], shape)
    single = spark.createDataFrame(
        [("row", 0, False, "article", None, None, None, None, None), ("row", 1, True, "h1", None, None, None, None, None),
         ("name", 0, False, "h1", None, None, None, None, "text")], shape)
    com = F.col("site").endswith(".com")
    rules = sites.join(listed.withColumn("com", F.lit(True)).unionByName(single.withColumn("com", F.lit(False))),
                       com == F.col("com")).drop("com")
    return E.extract_many(pages, rules, ["name", "url"], text_for=["a", "h1"]).select("page_id", "site", "name", "url")


def _lines(items: str) -> str:
    return f"array_to_string(list_filter({items}, lambda x: x <> ''), chr(10))"


_CLEAN = collapse_sql(entities_sql("x"))


@catalog.add("x15_positions_and_urls", f"""
WITH {_NAV_SQL}, h AS (SELECT *, {_HOST} AS site FROM flat),
l AS (SELECT page_id, {_ORIGIN} AS origin, {_HOST} AS site, h, list_transform(t, lambda x: {_CLEAN}) AS t FROM links
      JOIN (SELECT page_id, seg FROM nav) USING (page_id) WHERE seg LIKE '%<ul>%')
SELECT page_id, site, {_LABEL} AS name, {_ORIGIN} || href AS url FROM h WHERE site LIKE '%.com' AND pos NOT IN (0, 2)
UNION ALL
SELECT page_id, site, coalesce(t[-1], ''), coalesce(origin || h[1], '') FROM l WHERE site NOT LIKE '%.com'""")
def positions_and_urls(spark, sf):
    pages = _pages(spark, sf)
    sites = pages.select(U.host_of("url").alias("site")).distinct()
    shape = "com boolean, field string, step int, child boolean, tag string, kind string, nth int, skip array<int>, absolute boolean"
    rules = spark.createDataFrame([
        (True, "row", 0, False, "nav", None, None, None, None), (True, "row", 1, False, "li", None, None, [0, 2], None),
        (True, "name", 0, False, "a", "text", None, None, None), (True, "url", 0, False, "a", "href", None, None, True),
        (False, "row", 0, False, "nav", None, None, None, None), (False, "row", 1, True, "ul", None, None, None, None),
        (False, "name", 0, False, "a", "text", -1, None, None), (False, "url", 0, False, "a", "href", 0, None, True)], shape)
    rules = sites.join(rules, F.col("site").endswith(".com") == F.col("com")).drop("com")
    return E.extract_many(pages, rules, ["name", "url"]).select("page_id", "site", "name", "url")


@catalog.add("x16_extract_toc", f"""
WITH {_NAV_SQL}, n AS (SELECT page_id, pos, {_LABEL} AS name, {_ORIGIN} || href AS url FROM flat)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos DESC) - 1 AS idx, name, url, false AS vip
FROM n WHERE name <> '' AND url <> ''""")
def extract_toc(spark, sf):
    toc = E.extract_toc(_pages(spark, sf), [N.Step("nav"), N.Step("ul", child=True)], N.Step("a"), reverse=True)
    return toc.select("page_id", F.col("idx").cast("long").alias("idx"), "name", "url", "vip")


@catalog.add("x13_routed_records", f"""
WITH {_NAV_SQL}
SELECT page_id, 'html' AS kind, pos::BIGINT AS pos, {_LABEL} AS name, {_ORIGIN} || href AS url FROM flat
UNION ALL
SELECT -event_id - 1, 'json', i, CASE i WHEN 0 THEN event_type || ' ' || event_id ELSE 'none ' || event_id END, 'http://e.example.org/e/' || event_id || '/' || i
FROM events, range(2) AS r(i) WHERE event_id % 2 = 0
UNION ALL
SELECT -event_id - 1, 'pattern', i, event_type || '-' || (event_id + i), 'http://e.example.org/t/' || (event_id + i)
FROM events, range(3) AS r(i) WHERE event_id % 2 = 1""")
def routed_records(spark, sf):
    events = spread(table(spark, sf, "events").select("event_id", "event_type")).filter("event_type IS NOT NULL")
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.col("event_type"), F.lit("#"), (F.col("event_id") + i).cast("string"), F.lit(";\n"))), "")
    listed = F.to_json(F.struct(F.struct(F.array(
        F.struct(F.col("event_id").alias("id"), F.lit(0).alias("n"), F.struct(F.array("event_type").alias("names")).alias("kind")),
        F.struct(F.col("event_id").alias("id"), F.lit(1).alias("n"), F.lit(None).cast("struct<names:array<string>>").alias("kind"))).alias("list")).alias("data")))
    made = events.select(
        (-F.col("event_id") - 1).alias("page_id"), F.lit("http://e.example.org/x").alias("url"), F.when(F.col("event_id") % 2 == 0, listed).otherwise(text).alias("html"))
    bodies = _pages(spark, sf).select("page_id", "url", "html").unionByName(made)
    kind = R.AnyOf((R.Json(("kind", "names", 0)), R.Literal("none")))
    return R.read_records(
        bodies,
        html=R.Branch(R.HtmlRows((N.Step("nav"),), N.Step("a")), {"name": R.Css(), "url": R.Css(kind="href")}),
        json=R.Branch(R.JsonRows(("data", "list")), {"name": R.Concat((kind, R.Literal(" "), R.Json(("id",)))), "url": R.Fill("/e/{$.id}/{$.n}")}),
        pattern=R.Branch(R.PatternRows("([a-z_]+)#(\\d+);", 2), {"name": R.Fill("$1-$2"), "url": R.Fill("/t/$2")}),
        url_fields=["url"], name_fields=["name"])


@catalog.add("x14_field_forms", f"""
WITH {_NAV_SQL}, l AS (SELECT page_id, h, list_transform(t, lambda x: {_CLEAN}) AS t FROM links JOIN (SELECT page_id, seg FROM nav) USING (page_id) WHERE seg LIKE '%<ul>%')
SELECT page_id, 0::BIGINT AS pos, coalesce(t[1], '') AS first, coalesce(h[-1], '') AS last_href,
  {_lines("list_where(t, [i NOT IN (0, 2) FOR i IN range(len(t))])")} AS others,
  coalesce(nullif(t[2], ''), t[1], '') AS second_or_first, array_to_string(list_filter(t, lambda x: x <> ''), '/') AS joined,
  coalesce(t[1], '') || ' | ' || coalesce(t[-1], '') AS ends, regexp_replace({_lines("t")}, '[aeiou]+', '-', 'g') AS tail FROM l""")
def field_forms(spark, sf):
    a = (N.Step("li"), N.Step("a", child=True))
    branch = R.Branch(R.HtmlRows((N.Step("nav"), N.Step("ul", child=True))), {
        "first": R.Css(a, index=0), "last_href": R.Css(a, "href", index=-1), "others": R.Css(a, skip=(0, 2)),
        "second_or_first": R.AnyOf((R.Css((N.Step("em"),)), R.Css(a, index=1), R.Css(a, index=0))), "joined": R.Joined(R.Css(a), "/"),
        "ends": R.Concat((R.Css(a, index=0), R.Literal(" | "), R.Css(a, index=-1))), "tail": R.Replaced(R.Css(a), "[aeiou]+", "-")})
    return R.read_records(_pages(spark, sf), html=branch).drop("kind")


@catalog.add("x16_contents_over_pages", f"""
WITH {_NAV_SQL}
SELECT page_id % 3 AS root, row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id, pos) - 1 AS idx, page_id, false AS truncated,
       {_LABEL} AS name, 'http://list.example.org' || href AS url FROM flat WHERE {_LABEL} <> '' AND href <> ''""")
def contents_over_pages(spark, sf):
    link = F.concat(F.lit('<body><a class="next" href="/p/'), (F.col("page_id") + 3).cast("string"), F.lit('">next</a>'))
    pages = _pages(spark, sf).select(
        "page_id", F.concat(F.lit("http://list.example.org/p/"), F.col("page_id").cast("string")).alias("url"), F.replace(F.col("html"), F.lit("<body>"), link).alias("html"))
    branch = R.Branch(R.HtmlRows((N.Step("nav"),), N.Step("a")), {"name": R.Css(), "url": R.Css(kind="href")})
    return R.extract_contents(pages, pages.filter("page_id < 3").select("page_id"), branch, [N.Step("a", classes=("next",))])


@catalog.add("x17_walk_pages", "SELECT page_id % 3 AS root, page_id // 3 AS visit, page_id, false AS truncated FROM pages")
def walk(spark, sf):
    pages = _pages(spark, sf).select("page_id")
    nexts = pages.select(F.col("page_id"), (F.col("page_id") + 3).alias("next_page_id"), F.lit(0).alias("pos"))
    links = nexts.join(pages.select(F.col("page_id").alias("next_page_id")), "next_page_id")
    return walk_pages(pages.join(links.select(F.col("next_page_id").alias("page_id")), "page_id", "left_anti"), links)


@catalog.add("x18_assemble_bodies", f"""
WITH b AS (SELECT conv_id, count(*) AS pages, string_agg(text, chr(10) ORDER BY turn) FILTER (text <> '') AS body
           FROM conversations GROUP BY conv_id)
SELECT conv_id * 1000 AS root, pages, false AS truncated, {clean_sql("coalesce(body, '')")} AS content,
       CASE WHEN {clean_sql("coalesce(body, '')")} = '' THEN 'empty body' END AS error FROM b""")
def assemble(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("page_id", F.col("conv_id") * 1000 + F.col("turn"))
    bodies = turns.select("page_id", F.col("text").alias("content"), F.lit(None).cast("string").alias("error"))
    follow = turns.filter("turn > 0").select(
        (F.col("page_id") - 1).alias("page_id"), F.col("page_id").alias("next_page_id"), F.lit(0).alias("pos")
    )
    out = assemble_bodies(turns.filter("turn = 0").select("page_id"), follow, bodies)
    return out.select("root", F.col("pages").cast("long").alias("pages"), "content", "error", "truncated")


_TRAILING = """regexp_extract(regexp_extract(regexp_replace(regexp_replace(url, '[/?#]+$', ''), '(?s)^(.+)\\.html.*$', '\\1'),
 '([^/]*)$', 1), '([0-9]+)', 1)"""


@catalog.add("x19_resolve_toc_url", f"""
SELECT page_id, {_ORIGIN} || '/book/' || {_TRAILING} || '/' AS by_id, url AS by_default,
       regexp_extract(url, '(?s)^(.*/)', 1) || 'list' || page_id AS by_page FROM pages""")
def resolve_toc_url(spark, sf):
    df = _pages(spark, sf).select(
        "page_id", "url", F.lit("/book/{$.bookId}/").alias("r1"), F.lit("").alias("r2"),
        F.lit("class.more@href").alias("r3"), F.concat(F.lit("list"), F.col("page_id").cast("string")).alias("seen"),
    )
    df = E.resolve_toc_url(df, "r1", "url", name="by_id")
    df = E.resolve_toc_url(df, "r2", "url", name="by_default")
    df = E.resolve_toc_url(df, "r3", "url", found="seen", name="by_page")
    return df.select("page_id", "by_id", "by_default", "by_page")


_SQUASH = "trim(regexp_replace(x, '[ \\t\u00a0\u3000\\v]+', ' ', 'g'))"
_BLOCK = "(?:p|div|br|h[1-6]|li|ul|ol|tr|td|th|table|section|article|blockquote|pre|hr|dd|dt|dl|figure|figcaption|header|footer)"


def _flat_sql() -> str:
    t = "regexp_extract(html, '(?s)<body>(.*)$', 1)"
    t = f"regexp_replace({t}, '<nav>.*?(?:</nav>|$)|<!--.*?(?:-->|$)', '', 'gs')"
    t = f"regexp_replace({t}, '</?{_BLOCK}(?:\\s[^>]*)?>', chr(10) || chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    lines = f"list_transform(string_split({entities_sql(t)}, chr(10)), lambda x: {_SQUASH})"
    joined = f"regexp_replace(array_to_string({lines}, chr(10)), '\\n\\n+', chr(10) || chr(10), 'g')"
    return f"regexp_replace({joined}, '^\\n+|\\n+$', '', 'g')"


def _short(pattern: str) -> str:
    value = entities_sql(f"regexp_extract(html, '{pattern}', 1)")
    return f"(SELECT CASE WHEN length(x) BETWEEN 1 AND 60 THEN x END FROM (SELECT {_SQUASH} AS x FROM (SELECT {value} AS x)))"


@catalog.add("x20_flatten_pages", f"""
SELECT page_id, coalesce({_short('(?s)<h1>(.*?)(?:<|$)')}, {_short('(?s)<title>(.*?)(?:</title|$)')}, '') AS heading,
       {_flat_sql()} AS text FROM pages""")
def flatten_pages(spark, sf):
    return N.flatten(_pages(spark, sf))


@catalog.add("x21_order_sections", """
SELECT conv_id AS book_id, 100 - turn AS pos, 'OEBPS/t ' || turn || '.xhtml' AS path, text, length(text) < 20 AS short
FROM conversations""")
def order_sections(spark, sf):
    turns = table(spark, sf, "conversations")
    entries = turns.select(
        F.col("conv_id").alias("book_id"),
        F.concat(F.lit("OEBPS/t "), F.col("turn").cast("string"), F.lit(".xhtml")).alias("path"), "text",
    )
    manifest = turns.select(
        F.col("conv_id").alias("book_id"), F.concat(F.lit("i"), F.col("turn").cast("string")).alias("item_id"),
        F.concat(F.lit("OEBPS/t%20"), F.col("turn").cast("string"), F.lit(".xhtml")).alias("href"),
        F.lit("application/xhtml+xml").alias("media_type"),
    )
    spine = turns.select(
        F.col("conv_id").alias("book_id"), (100 - F.col("turn")).alias("pos"),
        F.concat(F.lit("i"), F.col("turn").cast("string")).alias("item_id"),
    )
    return E.order_sections(entries, manifest, spine)


# ------------------------------------------------------------------ url columns


@catalog.add("p01_host_and_scheme", f"""
SELECT {_HOST} AS host, regexp_extract(url, '^(https?)://', 1) AS scheme, count(*) AS pages FROM pages GROUP BY 1, 2""")
def host_and_scheme(spark, sf):
    loud = _pages(spark, sf).select(
        F.concat(F.lit("\ufeff"), F.regexp_replace("url", "^(https?)://([^/]*)", "$1://$2:8080")).alias("u")
    )
    return loud.groupBy(U.host_of("u").alias("host"), U.scheme_of("u").alias("scheme")).agg(
        F.count(F.lit(1)).alias("pages")
    )


_SITE = "CASE WHEN contains(regexp_extract(h, '^[^.]*\\.(.+)$', 1), '.') THEN regexp_extract(h, '^[^.]*\\.(.+)$', 1) ELSE h END"


@catalog.add("p02_site_of_host", f"""
SELECT site, count(*) AS pages, count(DISTINCT h) AS hosts FROM (
  SELECT h, {_SITE} AS site FROM (SELECT {_HOST} AS h FROM pages)) GROUP BY site""")
def site_of_host(spark, sf):
    hosts = _pages(spark, sf).groupBy(U.host_of("url").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return hosts.groupBy(U.site_of("h").alias("site")).agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("hosts"))


@catalog.add("p03_absolute_url", f"""
SELECT page_id, {_ORIGIN} || '/k/' || page_id AS rooted, regexp_extract(url, '(?s)^(.*/)', 1) || 'k' || page_id AS relative,
       regexp_extract(url, '^(https?)', 1) || '://cdn.example.net/k' AS protocol, 'https://a.b/c' AS absolute FROM pages""")
def absolute_url(spark, sf):
    n = F.col("page_id").cast("string")
    return _pages(spark, sf).select(
        "page_id",
        U.abs_url("url", F.concat(F.lit("\n /k/"), n, F.lit("\nnext"))).alias("rooted"),
        U.abs_url("url", F.concat(F.lit("k"), n)).alias("relative"),
        U.abs_url("url", F.lit("//cdn.example.net/k")).alias("protocol"),
        U.abs_url("url", F.lit("https://a.b/c")).alias("absolute"),
    )


@catalog.add("p04_doubled_host", f"""
SELECT page_id, {_ORIGIN} || '/x/' || page_id AS same_host, url AS untouched FROM pages""")
def doubled_host(spark, sf):
    origin = F.regexp_extract("url", "^(.*?://[^/]*)", 1)
    return _pages(spark, sf).select(
        "page_id",
        U.collapse_doubled_host(
            F.concat(origin, F.lit("/"), U.host_of("url"), F.lit("/x/"), F.col("page_id").cast("string"))
        ).alias("same_host"),
        U.collapse_doubled_host("url").alias("untouched"),
    )


@catalog.add("p05_expand_template", """
SELECT page_id, '/s?q=a+b%26' || page_id || '&p=' || page_id || '&n=' || (page_id + 1) || '&o=' || (page_id - 2) AS request FROM pages""")
def expand_template(spark, sf):
    key = F.concat(F.lit("a b&"), F.col("page_id").cast("string"))
    template = F.lit("/s?q={{key}}&p={{page}}&n={{ page+1 }}&o={{page-2}}")
    return _pages(spark, sf).select("page_id", U.expand_template(template, key, "page_id").alias("request"))


@catalog.add("p06_fill_fields", """
SELECT event_id, '/list/' || regexp_extract(props, '"k": *([0-9]+)', 1) || '/x' AS url FROM events""")
def fill_fields(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", U.fill_fields(F.lit("/list/{$.k}/x{$.none}"), "props", ["$.k", "$.none"]).alias("url")
    )


@catalog.add("p07_split_options", """
SELECT page_id, url || '?a=1,2' AS url, 'POST' AS method, 'k=' || page_id AS body, 'gbk' AS charset, 'x' AS agent FROM pages""")
def split_options(spark, sf):
    n = F.col("page_id").cast("string")
    tail = F.concat(
        F.lit(',{"method":"post","body":"k='), n, F.lit('","charset":"gbk","headers":{"User-Agent":"x"}}')
    )
    split = _pages(spark, sf).select("page_id", U.split_options(F.concat("url", F.lit("?a=1,2"), tail)).alias("o"))
    return split.select("page_id", "o.url", "o.method", "o.body", "o.charset", F.col("o.headers")["User-Agent"].alias("agent"))


@catalog.add("p08_trailing_id", f"SELECT page_id, {_TRAILING} AS id FROM pages")
def trailing_id(spark, sf):
    return _pages(spark, sf).select("page_id", U.trailing_id("url").alias("id"))


@catalog.add("p10_clean_text", f"SELECT page_id, {clean_sql('html')} AS text FROM pages")
def clean_text(spark, sf):
    return _pages(spark, sf).select("page_id", T.clean_text("html").alias("text"))


# ------------------------------------------------------------------ hosts


@catalog.add("a07_host_census", f"""
SELECT {_HOST} AS host, count(*) AS sites, arg_min(regexp_extract(url, '^(https?)', 1), page_id) AS scheme,
       arg_min('page ' || page_id, page_id) AS sample FROM pages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40""")
def host_census(spark, sf):
    listed = _pages(spark, sf).select(
        F.col("url").alias("source_url"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("name"),
        F.col("page_id").alias("pos"),
    )
    return L.host_census(listed)


@catalog.add("j03_reachable_hosts", f"""
SELECT page_id, url AS source_url FROM pages WHERE {_HOST} IN
  (SELECT {_HOST} FROM pages WHERE html LIKE '%</html>%' GROUP BY 1)""")
def reachable(spark, sf):
    pages = _pages(spark, sf)
    whole = pages.filter(F.contains("html", F.lit("</html>"))).select(F.col("url").alias("host"))
    return usable(pages.select("page_id", F.col("url").alias("source_url")), whole)


@catalog.add("u04_host_intersection", f"""
SELECT {_HOST} AS host FROM pages INTERSECT SELECT {_HOST} FROM pages WHERE html NOT LIKE '%</html>%'""")
def host_intersection(spark, sf):
    pages = _pages(spark, sf)
    broken = pages.filter(~F.contains("html", F.lit("</html>"))).select(F.col("url").alias("host"))
    return reachable_hosts(pages.select(F.col("url").alias("source_url")), broken)
