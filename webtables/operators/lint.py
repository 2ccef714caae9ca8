"""Registry analytics: unsupported constructs, verdicts, censuses, usability funnel, quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.functions._cols import ColumnLike, as_col, trim_control
from webtables.functions.urls import host_of, scheme_of

# --- fixed values: constructs counted by label ---
CONSTRUCTS = [
    ("XPath axis", "following-sibling|preceding-sibling|ancestor::|descendant-or-self"),
    ("XPath function", "position\\(\\)|last\\(\\)|normalize-space|substring\\(|concat\\("),
    ("JSONPath filter", "\\?\\("),
    ("JSONPath function", "\\.length\\(\\)"),
    ("CSS pseudo-class", ":eq\\(|:gt\\(|:lt\\(|:contains\\(|:not\\("),
    ("JS Java access", "\\bjava\\.|Packages\\.|importClass|importPackage"),
    ("JS host object", "\\bcookie\\b|\\bcache\\."),
]
# --- fixed values: first matching reason within the rule's language family ---
FAMILIES = [
    ("^(?:@js:|<js>|\\{\\{js)", [
        ("webView", "script needs a web view"),
        ("cache\\.", "script cache object not provided"),
        ("getLoginInfo|getCookie", "script login or cookie access not provided"),
        ("queryTTF|replaceFont", "script font decoding not provided"),
    ]),
    ("^/", [
        ("following-sibling|preceding-sibling|ancestor|descendant-or-self", "XPath axis"),
        ("position\\(\\)|last\\(\\)|normalize-space|string\\(|substring|concat\\(", "XPath function"),
        ("\\|", "XPath union"),
    ]),
    ("^\\$", [("\\?\\(", "JSONPath filter"), ("length\\(\\)", "JSONPath function")]),
    ("^(?:class\\.|id\\.|tag\\.|\\.|#)", [
        (":eq\\(|:gt\\(|:lt\\(", "CSS index pseudo-class"),
        (":contains\\(", "CSS contains"),
        (":not\\(", "CSS not"),
    ]),
]
# --- fixed values: marks that open a replacement tail, in order of precedence ---
REPLACE_MARKS = ["##", "#@#", "#&#", "$$"]


def strip_replace(rule: ColumnLike) -> Column:
    """The rule without its replacement tail (a mark at the very start is not a tail)."""
    r = as_col(rule)
    cut = F.lit(None).cast("int")
    for mark in reversed(REPLACE_MARKS):
        at = F.locate(mark, r, 2)
        cut = F.when(at > 0, at).otherwise(cut)
    return F.when(cut.isNotNull(), r.substr(F.lit(1), cut - 1)).otherwise(r)


def unsupported_reason(rule: ColumnLike) -> Column:
    """Why a rule cannot run, null when it can."""
    r = strip_replace(trim_control(as_col(rule)))
    reason = F.lit(None).cast("string")
    for family, tests in reversed(FAMILIES):
        inner = F.lit(None).cast("string")
        for pattern, label in reversed(tests):
            inner = F.when(r.rlike(pattern), label).otherwise(inner)
        reason = F.when(r.rlike(family), inner).otherwise(reason)
    web_view = F.contains(as_col(rule), F.lit(",{")) & as_col(rule).rlike('"webView"\\s*:\\s*true')
    return F.coalesce(reason, F.when(web_view, "request needs a web view"))


def constructs(rule: ColumnLike) -> Column:
    """Labels of the unsupported constructs inside a rule."""
    r = strip_replace(as_col(rule))
    return F.array_compact(F.array(*[F.when(r.rlike(p), F.lit(label)) for label, p in CONSTRUCTS]))


def lint_rules(rules: DataFrame) -> DataFrame:
    """Add ``reason`` and ``labels`` to one row per rule."""
    return rules.withColumn("reason", unsupported_reason("rule")).withColumn("labels", constructs("rule"))


def site_verdicts(lint: DataFrame, types: DataFrame, source: str = "source_url") -> DataFrame:
    """Rules and unsupported rules per site with a verdict; sites without rules count too."""
    counts = lint.groupBy(source).agg(
        F.count(F.lit(1)).alias("rules"), F.count_if(F.col("reason").isNotNull()).alias("unsupported")
    )
    joined = types.select(source, "type").join(counts, source, "left").fillna(0, ["rules", "unsupported"])
    good = (F.col("type") == 0) & (F.col("unsupported") == 0)
    return joined.withColumn("verdict", F.when(good, "COMPATIBLE").otherwise("PARTIAL"))


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    """Share of fully compatible sites."""
    good = F.count_if(F.col("verdict") == "COMPATIBLE")
    return verdicts.agg(
        F.count(F.lit(1)).alias("sites"), good.alias("compatible"),
        F.round(good * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("percent"),
    )


def construct_histogram(lint: DataFrame, source: str = "source_url") -> DataFrame:
    """Occurrences and distinct sites per construct; pairs are reduced before the distinct count."""
    pairs = lint.select(source, F.explode("labels").alias("label")).groupBy("label", source).agg(
        F.count(F.lit(1)).alias("n")
    )
    return pairs.groupBy("label").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("sites"))


def host_census(registry: DataFrame, url: str = "source_url", name: str = "name", pos: str = "pos", k: int = 40) -> DataFrame:
    """Sites per host with the first scheme and name, the ``k`` largest hosts."""
    named = registry.select(host_of(url).alias("_h"), scheme_of(url).alias("_s"), F.col(name).alias("_n"), pos)
    label = F.when(F.col("_h") == "", "<no url>").otherwise(F.col("_h"))
    counted = named.groupBy(label.alias("host")).agg(
        F.count(F.lit(1)).alias("sites"), F.min_by("_s", pos).alias("scheme"), F.min_by("_n", pos).alias("sample")
    )
    return counted.orderBy(F.col("sites").desc(), "host").limit(k)


def type_census(registry: DataFrame, type_: str = "type") -> DataFrame:
    """Sites per type."""
    return registry.groupBy(type_).agg(F.count(F.lit(1)).alias("sites"))


def usability(sites: DataFrame, hosts: DataFrame) -> DataFrame:
    """Flags of every site: text, clean, complete, reachable, usable, fixable.

    ``sites(source_url, host, type, rules, bad, has_entry, has_toc, has_content)``, ``hosts(host)``.
    """
    known = hosts.select(host_of("host").alias("host")).distinct().withColumn("_r", F.lit(True))
    joined = sites.join(known, "host", "left").withColumn("reachable", F.coalesce("_r", F.lit(False))).drop("_r")
    text = F.col("type") == 0
    clean = text & (F.col("bad") == 0) & (F.col("rules") > 0)
    complete = clean & F.col("has_entry") & F.col("has_toc") & F.col("has_content")
    return (
        joined.withColumn("text", text).withColumn("clean", clean).withColumn("complete", complete)
        .withColumn("usable", complete & F.col("reachable"))
        .withColumn("fixable", text & (F.col("bad") > 0) & F.col("reachable"))
    )


def usability_funnel(flags: DataFrame) -> DataFrame:
    """The funnel in one row."""
    on = lambda c: F.count_if(F.col(c))
    text = F.col("text")
    return flags.agg(
        F.count(F.lit(1)).alias("sites"), on("text").alias("text"),
        F.count_if(text & (F.col("bad") > 0)).alias("unsupported"),
        F.count_if(text & (F.col("rules") == 0)).alias("without_rules"),
        on("clean").alias("clean"), on("complete").alias("complete"), on("usable").alias("usable"),
        on("fixable").alias("fixable"),
        F.countDistinct(F.when(F.col("host") != "", F.col("host"))).alias("hosts"),
        F.countDistinct(F.when(F.col("reachable"), F.col("host"))).alias("reachable_hosts"),
    )


def usable_per_host(flags: DataFrame, k: int = 30) -> DataFrame:
    """Hosts with the most usable sites."""
    counted = flags.filter("usable").groupBy("host").agg(F.count(F.lit(1)).alias("sites"))
    return counted.orderBy(F.col("sites").desc(), "host").limit(k)


def qa_gate(toc: DataFrame, bodies: DataFrame, pages: DataFrame, thresholds: DataFrame, source: str = "source_url") -> DataFrame:
    """Pass or fail per site: enough chapters, enough body text, at least two pages.

    ``thresholds(source_url, min_chapters, min_chars)``.
    """
    chapters = toc.groupBy(source).agg(F.count(F.lit(1)).alias("chapters"))
    chars = bodies.groupBy(source).agg(F.coalesce(F.max(F.length("content")), F.lit(0)).alias("chars"))
    paged = pages.groupBy(source).agg(F.count(F.lit(1)).alias("pages"))
    joined = thresholds
    for part in (chapters, chars, paged):
        joined = joined.join(part, source, "left")
    joined = joined.fillna(0, ["chapters", "chars", "pages"])
    good = (
        (F.col("chapters") >= F.col("min_chapters")) & (F.col("chars") >= F.col("min_chars")) & (F.col("pages") >= 2)
    )
    return joined.select(source, "chapters", "chars", "pages", F.when(good, "pass").otherwise("fail").alias("result"))
