"""Registries of sites: scan, upgrade of flat rows, rule and url dialects, upsert, export, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webtables.functions._cols import ColumnLike, as_col, trim_control
from webtables.operators.scan import ordinal

# --- fixed values: rule fields and groups of a registry row ---
RULE_FIELDS = [
    "bookList", "name", "author", "kind", "intro", "wordCount", "lastChapter", "coverUrl", "bookUrl", "tocUrl",
    "chapterList", "chapterName", "chapterUrl", "isVip", "nextTocUrl", "content", "nextContentUrl",
]
RULE_GROUPS = ["ruleSearch", "ruleBookInfo", "ruleToc", "ruleContent", "ruleExplore"]
MODERN_TEXT = [
    "bookSourceName", "bookSourceUrl", "bookSourceGroup", "bookSourceComment", "bookUrlPattern", "header",
    "searchUrl", "exploreUrl",
]
# --- fixed values: where the fields of a flat row go ---
FLAT_RULES = {
    "ruleSearch": {
        "bookList": "ruleSearchList", "name": "ruleSearchName", "author": "ruleSearchAuthor",
        "kind": "ruleSearchKind", "intro": "ruleSearchIntroduce", "coverUrl": "ruleSearchCoverUrl",
        "lastChapter": "ruleSearchLastChapter", "bookUrl": "ruleSearchNoteUrl",
    },
    "ruleExplore": {
        "bookList": "ruleFindList", "name": "ruleFindName", "author": "ruleFindAuthor", "kind": "ruleFindKind",
        "intro": "ruleFindIntroduce", "coverUrl": "ruleFindCoverUrl", "lastChapter": "ruleFindLastChapter",
        "bookUrl": "ruleFindNoteUrl",
    },
    "ruleBookInfo": {
        "name": "ruleBookName", "author": "ruleBookAuthor", "kind": "ruleBookKind", "intro": "ruleIntroduce",
        "coverUrl": "ruleCoverUrl", "lastChapter": "ruleBookLastChapter", "tocUrl": "ruleChapterUrl",
    },
    "ruleToc": {
        "chapterList": "ruleChapterList", "chapterName": "ruleChapterName", "chapterUrl": "ruleContentUrl",
        "nextTocUrl": "ruleChapterUrlNext",
    },
    "ruleContent": {"content": "ruleBookContent", "nextContentUrl": "ruleContentUrlNext"},
}
FLAT_OTHER = ["ruleSearchUrl", "ruleFindUrl", "httpUserAgent", "ruleBookUrlPattern", "loginUrl"]
FLAT_MARKS = ["ruleSearchUrl", "ruleSearchList", "ruleChapterList", "ruleBookContent", "ruleSearchNoteUrl"]

_FLAT_COLUMNS = sorted({c for m in FLAT_RULES.values() for c in m.values()} | set(FLAT_OTHER))
_GROUP = "struct<" + ",".join(f"{f}:string" for f in RULE_FIELDS) + ">"
RAW_SCHEMA = ", ".join(
    [f"{c} string" for c in MODERN_TEXT]
    + ["bookSourceType string", "enabled boolean", "enable boolean", "customOrder int", "serialNumber int"]
    + [f"{g} {_GROUP}" for g in RULE_GROUPS]
    + [f"{c} string" for c in _FLAT_COLUMNS]
)


def source_type(col: ColumnLike) -> Column:
    """0 text, 1 audio, 2 image, 3 file from a number or a name; anything else is text."""
    v = F.lower(F.trim(F.coalesce(as_col(col), F.lit(""))))
    has = lambda *words: F.greatest(*[F.contains(v, F.lit(w)) for w in words])
    number = v.try_cast("int")
    return (
        F.when(number.isNotNull(), number)
        .when(has("audio", "听"), 1).when(has("image", "图片"), 2).when(has("file", "文件"), 3)
        .otherwise(0)
    )


def flat_type(col: ColumnLike) -> Column:
    """Type of a flat row: only audio is told apart."""
    v = F.trim(F.coalesce(as_col(col), F.lit("")))
    audio = (F.upper(v) == "AUDIO") | F.contains(v, F.lit("听"))
    return F.coalesce(v.try_cast("int"), F.when(audio, 1).otherwise(0))


def rewrite_rule(col: ColumnLike) -> Column:
    """Single ``#``, ``|`` and ``&`` of the flat dialect doubled; explicit-mode and script rules untouched."""
    r = trim_control(F.coalesce(as_col(col), F.lit("")))
    sign = F.regexp_extract(r, "^([-+])", 1)
    body = F.regexp_replace(r, "^[-+]", "")
    plain = ~body.rlike("^(?:@CSS:|@XPath:|//|##|:)|@js:|<js>")

    def doubled(c: Column, mark: str, also: Column | None = None) -> Column:
        single = F.contains(c, F.lit(mark)) & ~F.contains(c, F.lit(mark * 2))
        single = single if also is None else single & also
        return F.when(single, F.replace(c, F.lit(mark), F.lit(mark * 2))).otherwise(c)

    hashed = doubled(body, "#")
    head, tail = F.regexp_extract(hashed, "(?s)^(.*?)(?:##.*)?$", 1), F.regexp_extract(hashed, "(?s)(##.*)$", 1)
    piped = F.concat(doubled(head, "|"), tail)
    joined = doubled(piped, "&", ~F.contains(piped, F.lit("http")) & ~piped.startswith("/"))
    return F.concat(sign, F.when(plain, joined).otherwise(body))


def _json_text(col: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(col)), "^\\[|\\]$", "")


def rewrite_url(col: ColumnLike) -> Column:
    """Flat-dialect request to a template: search words, page numbers, headers, charset and body."""
    url = trim_control(F.coalesce(as_col(col), F.lit("")))
    scripted = F.replace(
        F.replace(url, F.lit("=searchKey"), F.lit("={{key}}")), F.lit("=searchPage"), F.lit("={{page}}")
    )
    block = F.regexp_extract(url, "@Header:(\\{.+?\\})", 1)
    bare = F.when(block != "", F.replace(url, F.concat(F.lit("@Header:"), block), F.lit(""))).otherwise(url)
    fixed = F.regexp_replace(block, "([{,]\\s*)([A-Za-z_][A-Za-z0-9_\\-]*)(\\s*:)", '$1"$2"$3')
    headers = F.coalesce(
        F.to_json(F.try_parse_json(block)), F.to_json(F.try_parse_json(fixed)), _json_text(F.trim(block))
    )
    charset = F.trim(F.regexp_extract(bare, "(?s)^[^|]+\\|\\s*charset=(.*)$", 1))
    bare = F.when(charset != "", F.substring_index(bare, "|", 1)).otherwise(bare)

    def piece(p: Column) -> Column:
        inside = F.replace(F.replace(p, F.lit("searchKey"), F.lit("key")), F.lit("searchPage"), F.lit("page"))
        outside = F.replace(F.translate(p, "{}", "<>"), F.lit("searchKey"), F.lit("{{key}}"))
        outside = F.regexp_replace(outside, "<searchPage([+-]1)?>|searchPage([+-]1)?", "{{page$1$2}}")
        return F.when(p.rlike("^\\{\\{.+\\}\\}$"), inside).otherwise(outside)

    script = "\\{\\{.+?\\}\\}"
    pieces = F.regexp_extract_all(bare, F.lit(f"(?s){script}|(?:(?!{script}).)++"), F.lit(0))
    filled = F.array_join(F.transform(pieces, piece), "")
    shape = "(?s)^([^@]+)@(.+)$"
    body = F.regexp_extract(filled, shape, 2)
    target = F.when(body != "", F.regexp_extract(filled, shape, 1)).otherwise(filled)
    options = F.concat_ws(
        ",",
        F.when(block != "", F.concat(F.lit('"headers":'), headers)),
        F.when(charset != "", F.concat(F.lit('"charset":'), _json_text(charset))),
        F.when(body != "", F.concat(F.lit('"method":"POST","body":'), _json_text(body))),
    )
    whole = F.when(options != "", F.concat(target, F.lit(",{"), options, F.lit("}"))).otherwise(target)
    return F.when(url.startswith("<js>"), scripted).otherwise(whole)


def rewrite_urls(col: ColumnLike) -> Column:
    """Several requests separated by ``&&`` or line breaks, one per line afterwards; scripts untouched."""
    v = trim_control(F.coalesce(as_col(col), F.lit("")))
    parts = F.filter(F.transform(F.split(v, "(?:&&|\\r?\\n)+"), trim_control), lambda p: p != "")
    return F.when(v.rlike("^(?:@js:|<js>)"), v).otherwise(F.array_join(F.transform(parts, rewrite_url), "\n"))


def is_flat() -> Column:
    marks = F.coalesce(*[F.col(c) for c in FLAT_MARKS]).isNotNull()
    return F.col("ruleToc").isNull() & marks


def upgrade_flat(df: DataFrame) -> DataFrame:
    """Flat and modern rows to one modern shape in a single projection."""
    old_rules = [(g, f, c) for g, m in FLAT_RULES.items() for f, c in m.items()]
    place = {(g, f): i for i, (g, f, _) in enumerate(old_rules)}
    # all old rules go through one lambda, which keeps the plan small
    olds = F.array(*[F.coalesce(F.col(c), F.lit("")) for _, _, c in old_rules])
    df = df.withColumn("_flat", is_flat()).withColumn("_rewritten", F.transform(olds, rewrite_rule))
    flat = F.col("_flat")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    agent = F.when(text("httpUserAgent") != "", F.concat(F.lit("User-Agent@"), "httpUserAgent")).otherwise(F.lit(""))

    def group(g: str) -> Column:
        fields = []
        for f in RULE_FIELDS:
            modern = F.coalesce(F.col(g)[f], F.lit(""))
            at = place.get((g, f))
            converted = F.lit("") if at is None else F.col("_rewritten")[at]
            if (g, f) == ("ruleContent", "content"):
                # a leading dollar that opens no path is dropped
                converted = F.regexp_replace(converted, "^\\$(?![.\\[])", "")
            fields.append(F.when(flat, converted).otherwise(modern).alias(f))
        return F.struct(*fields).alias(g)

    pick = lambda a, b, n: F.when(flat, a).otherwise(b).alias(n)
    keep = [c for c in df.columns if c == "pos"]
    return df.select(
        *keep,
        F.trim(text("bookSourceName")).alias("name"),
        F.trim(text("bookSourceUrl")).alias("source_url"),
        F.trim(text("bookSourceGroup")).alias("group"),
        pick(F.coalesce("enable", F.lit(True)), F.coalesce("enabled", F.lit(True)), "enabled"),
        pick(F.coalesce("serialNumber", "customOrder", F.lit(0)), F.coalesce("customOrder", F.lit(0)), "order"),
        pick(flat_type("bookSourceType"), source_type("bookSourceType"), "type"),
        text("bookSourceComment").alias("comment"),
        pick(text("ruleBookUrlPattern"), F.trim(text("bookUrlPattern")), "url_pattern"),
        pick(agent, text("header"), "header"),
        pick(rewrite_url("ruleSearchUrl"), F.trim(text("searchUrl")), "search_url"),
        pick(rewrite_urls("ruleFindUrl"), F.trim(text("exploreUrl")), "explore_url"),
        *[group(g) for g in RULE_GROUPS],
        flat.alias("was_flat"),
    )


def parse_registry(raw: DataFrame) -> DataFrame:
    """Upgrade, require a url, default the name to it."""
    rows = upgrade_flat(raw).filter("source_url <> ''")
    return rows.withColumn("name", F.when(F.col("name") == "", F.col("source_url")).otherwise(F.col("name")))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry files holding one object or an array; elements that are no site are dropped.

    Elements are cut out as text first, so a bad one cannot spoil its neighbours.
    """
    body = F.regexp_replace("value", "^[\\s\ufeff]+", "")
    listed = F.when(body.startswith("{"), F.array(body)).otherwise(F.from_json(body, "array<string>"))
    elements = spark.read.text(path, wholetext=True).select(F.explode_outer(listed).alias("element"))
    return parse_registry(elements.select(F.from_json("element", RAW_SCHEMA).alias("r")).select("r.*"))


def read_registry_lines(spark: SparkSession, path: str) -> DataFrame:
    """A registry written by :func:`export_registry`: one object per line, read in parallel."""
    return parse_registry(spark.read.schema(RAW_SCHEMA).json(path))


def upsert_registry(current: DataFrame, batch: DataFrame, pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """Merge a batch into a registry by url: the last occurrence wins, known sites keep their place.

    New sites follow in order of first occurrence. Returns the registry and one row of counts
    (added, updated, failed). Both come from aggregates, so a url repeated many times is reduced first.
    """
    values = [c for c in current.columns if c not in ("source_url", pos)]
    tagged = current.select("source_url", F.lit(0).alias("_new"), pos, *values).unionByName(
        batch.select("source_url", F.lit(1).alias("_new"), pos, *values)
    )
    usable = F.coalesce(F.col("source_url"), F.lit("")) != ""
    merged = tagged.filter(usable).groupBy("source_url").agg(
        F.max_by(F.struct(*values), F.struct("_new", pos)).alias("_v"),
        F.min(F.struct("_new", pos)).alias("_at"),
        F.count_if(F.col("_new") == 1).alias("_seen"),
    )
    flat = merged.select(
        "source_url", "_v.*", F.col("_at._new").alias("_new"), F.col(f"_at.{pos}").alias("_first"), "_seen"
    ).withColumn("_slice", F.floor(F.col("_first") / 100_000))
    placed = ordinal(flat, [], ["_new", "_slice"], ["_first", "source_url"], "_place")
    registry = placed.select("source_url", (F.col("_place") - 1).alias(pos), *values)
    failed = batch.agg(F.count_if(~usable).alias("failed"))
    sums = flat.agg(
        F.coalesce(F.sum("_new"), F.lit(0)).alias("added"),
        F.coalesce(F.sum(F.col("_seen") - F.col("_new")), F.lit(0)).alias("updated"),
    )
    # two single-row aggregates side by side
    counts = sums.withColumn("_k", F.lit(1)).join(failed.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return registry, counts


def registry_json(df: DataFrame) -> DataFrame:
    """One JSON object per site: empty rules left out, the explore group only with its url."""
    blank = lambda c: F.nullif(c, F.lit(""))
    rules = lambda g: F.struct(*[blank(F.col(g)[f]).alias(f) for f in RULE_FIELDS])
    row = F.struct(
        F.col("name").alias("bookSourceName"), F.col("source_url").alias("bookSourceUrl"),
        F.col("group").alias("bookSourceGroup"), "enabled", F.col("order").alias("customOrder"),
        F.col("type").alias("bookSourceType"), F.col("comment").alias("bookSourceComment"),
        blank(F.col("url_pattern")).alias("bookUrlPattern"), blank(F.col("header")).alias("header"),
        blank(F.col("explore_url")).alias("exploreUrl"),
        F.when(F.col("explore_url") != "", rules("ruleExplore")).alias("ruleExplore"),
        F.col("search_url").alias("searchUrl"),
        *[rules(g).alias(g) for g in RULE_GROUPS if g != "ruleExplore"],
    )
    return df.select(F.to_json(row).alias("value"))


def export_registry(df: DataFrame, path: str) -> None:
    """Write the registry as JSON lines; :func:`read_registry_lines` reads them in parallel."""
    registry_json(df).write.mode("overwrite").text(path)


def reject_reason() -> Column:
    """Why a site takes no part in a search; null when it does."""
    no_rules = (F.coalesce("search_url", F.lit("")) == "") | (F.coalesce("list_rule", F.lit("")) == "")
    return F.when(~F.col("enabled"), "disabled").when(F.col("type") != 0, "not text").when(no_rules, "no search rules")


def eligible(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sites that can be searched, and the number of sites per reject reason.

    ``df(source_url, enabled, type, search_url, list_rule)``.
    """
    judged = df.withColumn("reason", reject_reason())
    kept = judged.filter("reason is null").drop("reason")
    return kept, judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("sites"))


def rules_long(df: DataFrame) -> DataFrame:
    """One row per rule of every site: source_url, grp, field, rule."""
    entries = [
        F.struct(F.lit(g).alias("grp"), F.lit(f).alias("field"), F.col(g)[f].alias("rule"))
        for g in RULE_GROUPS for f in RULE_FIELDS
    ]
    entries += [
        F.struct(F.lit("url").alias("grp"), F.lit(n).alias("field"), F.col(c).alias("rule"))
        for n, c in (("searchUrl", "search_url"), ("exploreUrl", "explore_url"))
    ]
    return df.select("source_url", F.inline(F.array(*entries))).filter("trim(rule) <> ''")
