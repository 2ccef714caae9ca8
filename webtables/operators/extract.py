"""Records out of pages and JSON bodies: rows, fields, tables of contents, package sections."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtables.functions._cols import ColumnLike, as_col
from webtables.functions.text import collapse_ws, title_key
from webtables.functions.urls import abs_url, fill_fields, host_of, trailing_id
from webtables.operators.nodes import (
    Step, any_of, chain, enclosing, extract_joined, rows, select, shred, value_of, within,
)
from webtables.session import settle

# --------------------------------------------------------------------------- JSON bodies

VARIANT_LIST = "array<variant>"


def _present(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & ~F.is_variant_null(v))


def _elements(v: Column) -> Column:
    """Elements of an array, else null."""
    return F.try_variant_get(v, "$", VARIANT_LIST)


def _step(values: Column, step: str | int) -> Column:
    """Apply one path step to every current value."""
    if isinstance(step, int):
        picked = F.transform(values, lambda v: _at(_elements(v), step))
    elif step == "*":
        members = lambda v: F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
        none = F.expr(f"cast(array() as {VARIANT_LIST})")
        picked = F.flatten(F.transform(values, lambda v: F.coalesce(_elements(v), members(v), none)))
    else:
        path = "$['" + step.replace("'", "\\'") + "']" if not step.isidentifier() else f"$.{step}"
        field = lambda v: F.try_variant_get(v, path, "variant")
        spread = F.flatten(F.transform(values, lambda v: F.coalesce(_elements(v), F.array(v))))
        picked = F.transform(spread, field)
    return _present(picked)


def _at(values: Column, index: int) -> Column:
    return F.try_element_at(values, F.lit(index + 1 if index >= 0 else index))


def json_values(body: ColumnLike, path: Sequence[str | int]) -> Column:
    """Values of a path (member names, positions, negative from the end, ``*``) as an array of variants.

    A member step maps over the elements of an array; arrays left at the end are expanded once.
    """
    return variant_values(F.try_parse_json(as_col(body)), path)


def variant_values(root: Column, path: Sequence[str | int]) -> Column:
    """The same for a value that is parsed already."""
    values = F.filter(F.array(root), lambda v: v.isNotNull())
    for step in path:
        values = _step(values, step)
    spread = F.transform(values, lambda v: F.coalesce(_elements(v), F.array(v)))
    return _present(F.flatten(spread))


def _scalar(v: Column) -> Column:
    """A scalar as text; objects and arrays give null."""
    nested = F.try_variant_get(v, "$", "map<string,variant>").isNotNull() | _elements(v).isNotNull()
    return F.when(~nested, F.try_variant_get(v, "$", "string"))


def json_rows(df: DataFrame, body: str, path: Sequence[str | int], name: str = "item") -> DataFrame:
    """One row per value of a path, numbered by ``pos``; ``item`` is JSON text for nested values."""
    values = F.transform(json_values(body, path), lambda v: F.coalesce(_scalar(v), F.to_json(v)))
    return df.select("*", F.posexplode_outer(values).alias("pos", name)).filter("pos is not null")


def json_first(body: ColumnLike, path: Sequence[str | int]) -> Column:
    """The first scalar of a path as text, else an empty string."""
    scalars = F.filter(F.transform(json_values(body, path), _scalar), lambda s: s.isNotNull())
    return F.coalesce(F.try_element_at(scalars, F.lit(1)), F.lit(""))


def json_strings(body: ColumnLike, path: Sequence[str | int]) -> Column:
    """All scalars of a path as text."""
    return variant_scalars(F.try_parse_json(as_col(body)), path)


def variant_scalars(root: Column, path: Sequence[str | int]) -> Column:
    """The same for a value that is parsed already."""
    return F.filter(F.transform(variant_values(root, path), _scalar), lambda s: s.isNotNull())


def variant_member(root: Column, path: str) -> Column:
    """The member ``$.a.b`` of a value that is parsed already, as :func:`get_json_object` gives it from its text."""
    text = F.get_json_object(F.to_json(root), path)
    if not re.fullmatch("\\$(?:\\.[A-Za-z_][A-Za-z_0-9]*)+", path):
        return text
    # other kinds have more than one notation as text; a missing member, too, is looked for in the text
    plain = F.schema_of_variant(F.try_variant_get(root, path, "variant")).isin("STRING", "BIGINT", "BOOLEAN")
    return F.when(plain, F.try_variant_get(root, path, "string")).otherwise(text)


def json_descend(df: DataFrame, body: str, name: str, depth: int | None = None, value: str = "item") -> DataFrame:
    """Every member called ``name`` at any nesting, in document order, one row each.

    As many levels are searched as the body has brackets open at once, counted outside of strings; ``depth`` limits
    them.
    """
    where = "array<int>"
    frontier_type = f"array<struct<at:{where},v:variant>>"
    root = F.try_parse_json(as_col(body))
    start = F.struct(
        F.array(F.struct(F.expr(f"cast(array() as {where})").alias("at"), root.alias("v"))).alias("front"),
        F.expr(f"cast(array() as {frontier_type})").alias("found"),
    )

    def children(x: Column) -> Column:
        members = F.map_values(F.try_variant_get(x["v"], "$", "map<string,variant>"))
        kids = F.coalesce(_elements(x["v"]), members, F.expr(f"cast(array() as {VARIANT_LIST})"))
        return F.transform(kids, lambda k, i: F.struct(F.concat(x["at"], F.array(i)).alias("at"), k.alias("v")))

    def level(acc: Column, _: Column) -> Column:
        hits = F.transform(
            acc["front"],
            lambda x: F.struct(
                x["at"].alias("at"), F.try_variant_get(x["v"], f"$['{name}']", "variant").alias("v")
            ),
        )
        kept = F.filter(hits, lambda x: x["v"].isNotNull() & ~F.is_variant_null(x["v"]))
        return F.struct(
            F.flatten(F.transform(acc["front"], children)).alias("front"),
            F.concat(acc["found"], kept).alias("found"),
        )

    marks = F.regexp_extract_all(F.regexp_replace(as_col(body), '"(?:[^"\\\\]|\\\\.)*+"', ""), F.lit("[\\[\\]{}]"), F.lit(0))

    def nested(acc: Column, mark: Column) -> Column:
        now = acc["now"] + F.when(mark.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    deepest = F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), nested)["most"]
    levels = F.coalesce(deepest, F.lit(0)) if depth is None else F.lit(depth)
    folded = F.aggregate(F.sequence(F.lit(0), levels), start, level)
    listed = F.transform(
        folded["found"],
        lambda x: F.struct(x["at"].alias("at"), F.coalesce(_scalar(x["v"]), F.to_json(x["v"])).alias(value)),
    )
    exploded = df.select("*", F.posexplode_outer(F.array_sort(listed)).alias("pos", "_hit"))
    return exploded.filter("pos is not null").select(*df.columns, "pos", F.col(f"_hit.{value}").alias(value))


# --------------------------------------------------------------------------- regex rows


def regex_rows(df: DataFrame, text: str, pattern: str, groups: int, limit: int | None = None) -> DataFrame:
    """Every match of a pattern (dot matches line breaks) as a row with its groups; group 0 is the match.

    A group that took no part is an empty string. ``limit`` keeps the first matches of a row.
    """
    every = [F.regexp_extract_all(F.col(text), F.lit("(?s)" + pattern), F.lit(g)) for g in range(groups + 1)]
    zipped = F.arrays_zip(*[e.alias(f"g{g}") for g, e in enumerate(every)])
    if limit is not None:
        zipped = F.slice(zipped, 1, limit)
    listed = F.transform(zipped, lambda x: F.array(*[x[f"g{g}"] for g in range(groups + 1)]))
    return df.select("*", F.posexplode_outer(listed).alias("pos", "groups")).filter("pos is not null")


def fill_groups(template: str, groups: ColumnLike, count: int) -> Column:
    """``$n`` in a template replaced by group ``n``; numbers beyond the groups stay as written.

    The template is taken apart once, while the plan is built.
    """
    listed = as_col(groups)

    def fill(piece: str) -> Column:
        number = int(piece[1:]) if re.fullmatch("\\$[0-9]+", piece) else None
        return F.lit(piece) if number is None or number > count else F.try_element_at(listed, F.lit(number + 1))

    return F.concat_ws("", *[fill(piece) for piece in re.findall("\\$[0-9]{1,2}|\\$|[^$]+", template)])


def body_kind(body: ColumnLike) -> Column:
    """``json`` or ``html`` from the first character of a body that is not blank."""
    return F.when(as_col(body).rlike("^[ \\t\\r\\n\ufeff]*+[{\\[]"), F.lit("json")).otherwise(F.lit("html"))


# --------------------------------------------------------------------------- records


@dataclass(frozen=True)
class Field:
    """A value of a record: ``kind`` read from the row itself or from the nodes ``steps`` match inside it."""

    kind: str = "text"
    steps: tuple[Step, ...] = ()


def extract_records(
    pages: DataFrame,
    container: Sequence[Step],
    child: Step,
    fields: Mapping[str, Field],
    url_fields: Sequence[str] = (),
    page_id: str = "page_id",
    html: str = "html",
    url: str = "url",
) -> DataFrame:
    """One record per row node with its fields; names collapsed, urls made absolute against the page.

    Fields of the row itself need no join. Fields found inside a row come back in one aggregate.
    """
    inner = {n: f for n, f in fields.items() if f.steps}
    tags = {child.tag or "*"} | {s.tag or "*" for f in inner.values() for s in f.steps}
    kinds = {f.kind.lower() for f in fields.values()}
    texts = sorted(tags) if "text" in kinds else ()
    markup = sorted(tags) if kinds & {"html", "innerhtml", "outerhtml"} else ()
    nodes = shred(pages, page_id, html, text_for=texts, html_for=markup, keep=[url])
    tests = [child.test(), *[s.test() for s in container]]
    tests += [s.test() for f in inner.values() for s in f.steps]
    nodes = settle(nodes.filter(any_of(tests)))
    found = rows(nodes, container, child, settled=True)
    own = [value_of(f.kind).alias(n) for n, f in fields.items() if not f.steps]
    out = found.select("page_id", F.col("scope_pre"), F.col("pre").alias("row_pre"), F.col("post").alias("row_post"),
                       F.col(url).alias("_url"), *own)
    if inner:
        listed = None
        for name, field in inner.items():
            inside = within(found.drop("scope_pre"), nodes, any_of([s.test() for s in field.steps]))
            hits = extract_joined(select(inside, field.steps, ("scope_pre",)), field.kind, ("page_id", "scope_pre"))
            part = hits.select("page_id", F.col("scope_pre").alias("row_pre"), F.lit(name).alias("field"), "value")
            listed = part if listed is None else listed.unionByName(part)
        wide = listed.groupBy("page_id", "row_pre").agg(
            *[F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in inner]
        )
        out = out.join(wide, ["page_id", "row_pre"], "left")
    for name in fields:
        value = F.coalesce(F.col(name), F.lit(""))
        out = out.withColumn(name, abs_url("_url", value) if name in url_fields else value)
    if "name" in fields:
        out = out.withColumn("name", collapse_ws("name"))
    spot = F.row_number().over(Window.partitionBy("page_id").orderBy("scope_pre", "row_pre")) - 1
    return out.withColumn("pos", spot).select("page_id", "pos", *fields)


#: Columns of a rule step and their types; those a rules table lacks are null.
RULE_COLUMNS = {
    "site": "string", "field": "string", "step": "int", "child": "boolean", "tag": "string", "cls": "string", "id": "string", "attr": "string",
    "op": "string", "value": "string", "kind": "string", "nth": "int", "skip": "array<int>", "absolute": "boolean",
}


def site_rules(rules: DataFrame) -> DataFrame:
    """One row per site: its steps, and an index from what a step asks of a node (id, else class, else tag, else anything) to steps."""
    have = rules.select(*[(F.col(c) if c in rules.columns else F.lit(None)).cast(t).alias(c) for c, t in RULE_COLUMNS.items()])
    longest = have.groupBy("site", "field").agg(F.max("step").alias("last_step"))
    key = F.coalesce(
        F.concat(F.lit("#"), "id"), F.concat(F.lit("."), F.lower("cls")), F.when(F.col("tag") != "*", F.concat(F.lit("t"), F.lower("tag"))), F.lit("*"))
    parts = [c for c in RULE_COLUMNS if c != "site"]
    steps = F.array_sort(F.collect_list(F.struct(*parts, "last_step", key.alias("key"))))
    listed = have.join(longest, ["site", "field"]).groupBy("site").agg(steps.alias("_steps"))
    keys = F.array_distinct(F.col("_steps.key"))
    places = F.transform(F.col("_keys"), lambda k: F.filter(F.transform("_steps", lambda s, i: F.when(s["key"] == k, i)), lambda i: i.isNotNull()))
    return listed.withColumn("_keys", keys).select("site", "_steps", F.map_from_arrays("_keys", places).alias("_index"))


def _matching_steps() -> Column:
    """The steps of a node's site that the node passes: looked up by its id, classes and tag, then tested in full."""
    keys = F.concat(
        F.array(F.lit("*"), F.concat(F.lit("t"), "tag")), F.array_compact(F.array(F.concat(F.lit("#"), "id"))),
        F.transform(F.array_distinct("classes"), lambda c: F.concat(F.lit("."), F.lower(c))))
    found = F.flatten(F.transform(F.array_distinct(keys), lambda k: F.coalesce(F.try_element_at("_index", k), F.array().cast("array<int>"))))

    def fits(s: Column) -> Column:
        value = F.try_element_at("attrs", F.lower(F.coalesce(s["attr"], F.lit(""))))
        attr = (
            F.when(s["attr"].isNull(), True)
            .when(s["op"].isNull(), value.isNotNull())
            .when(s["op"] == "=", value == s["value"])
            .when(s["op"] == "*=", F.contains(value, s["value"]))
            .when(s["op"] == "^=", F.startswith(value, s["value"]))
            .when(s["op"] == "$=", F.endswith(value, s["value"]))
        )
        tag = s["tag"].isNull() | (s["tag"] == "*") | (F.lower(s["tag"]) == F.col("tag"))
        cls = s["cls"].isNull() | F.exists("classes", lambda c: F.lower(c) == F.lower(s["cls"]))
        return tag & cls & (s["id"].isNull() | F.coalesce(s["id"] == F.col("id"), F.lit(False))) & F.coalesce(attr, F.lit(False))

    return F.filter(F.transform(found, lambda i: F.get("_steps", i)), fits)


def _picked(rows: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Rows left by ``nth`` (negative from the end) and ``skip`` of their rule, by position inside the scope."""
    group = Window.partitionBy(*scope)
    placed = rows.withColumn("_at", F.row_number().over(group.orderBy("pre")) - 1).withColumn("_of", F.count(F.lit(1)).over(group))
    wanted = F.when(F.col("nth").isNotNull(), F.col("_at") == F.when(F.col("nth") < 0, F.col("nth") + F.col("_of")).otherwise(F.col("nth")))
    return placed.filter(wanted.otherwise(~F.coalesce(F.array_contains("skip", F.col("_at")), F.lit(False)))).drop("_at", "_of")


def extract_many(
    pages: DataFrame,
    rules: DataFrame,
    fields: Sequence[str],
    site: ColumnLike | None = None,
    text_for: Sequence[str] | None = None,
    page_id: str = "page_id",
    html: str = "html",
    url: str = "url",
) -> DataFrame:
    """Records of many sites, each with its own rules, in one job.

    ``rules`` holds one row per step (``RULE_COLUMNS``). The field ``row`` selects the record nodes; the others are read inside each record (or
    from the record itself), all values a line each. ``nth`` and ``skip`` of a field's last step pick by position: of rows in the page, of values in
    the record. ``absolute`` values are made absolute against the page's url.

    Pages meet the rules once, by site, before they are parsed; every node looks its steps up in the index of its page's row, so no
    join of nodes with steps takes place, and nodes that pass no step are gone before the first shuffle. The number of rounds is the
    length of the longest selector, whatever the number of sites. Subtree texts are kept for the tags that some rule reads the text
    of (``text_for`` sets them).
    """
    rules = settle(rules)  # a stored table has a true size: Spark broadcasts it below its threshold only
    if text_for is None:  # the distinct tags of all rules
        read = rules.filter("lower(kind) = 'text'").select(F.lower(F.coalesce("tag", F.lit("*"))).alias("t")).distinct()
        text_for = sorted(r["t"] for r in read.collect())
    routed = pages.withColumn("site", host_of(url) if site is None else as_col(site)).join(site_rules(rules), "site")
    nodes = shred(routed, page_id, html, text_for=text_for, keep=["site", url, "_steps", "_index"])
    own = [c for c in nodes.columns if c not in ("_steps", "_index")]
    roles = nodes.select(*own, F.explode(_matching_steps()).alias("_role")).select(
        *[F.col(c).alias("url_of_page" if c == url else c) for c in own], *[F.col(f"_role.{c}").alias(c) for c in ("field", "step", "last_step", "child", "kind", "nth", "skip", "absolute")])
    rounds = rules.agg(F.max("step")).first()[0] or 0
    done = chain(roles, ["page_id", "field"], rounds, [F.coalesce("child", F.lit(False))] * (rounds + 1))
    final = done.filter(F.col("_hit") & (F.col("step") == F.col("last_step")))
    parts = F.transform("own_text_parts", lambda p: p["txt"])
    value = (
        F.when(F.lower("kind") == "text", collapse_ws("text"))
        .when(F.lower("kind") == "owntext", collapse_ws(F.array_join(parts, "")))
        .otherwise(F.coalesce(F.try_element_at("attrs", F.lower("kind")), F.lit("")))
    )
    value = F.when(F.coalesce("absolute", F.lit(False)) & (value != ""), abs_url("url_of_page", value)).otherwise(value)
    final = settle(final.select("page_id", "site", "field", "pre", "post", "nth", "skip", value.alias("v")))
    records = _picked(final.filter("field = 'row'"), ["page_id"]).select("page_id", "site", F.col("pre").alias("row_pre"), F.col("post").alias("row_post"))
    inside = enclosing(
        final.filter("field <> 'row'").select("page_id", "field", "pre", "nth", "skip", "v"), records, ["site", "row_pre"], "row_pre", "row_post", itself=True)
    inside = _picked(inside, ["page_id", "row_pre", "field"]).filter("v <> ''")
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("pre", "v"))), lambda x: x["v"]), "\n"
    )
    wide = inside.groupBy("page_id", "site", "row_pre").pivot("field", list(fields)).agg(joined)
    return records.drop("row_post").join(wide, ["page_id", "site", "row_pre"], "left").fillna("", list(fields))


def extract_toc(
    pages: DataFrame,
    container: Sequence[Step],
    child: Step,
    name: Field = Field("text"),
    url: Field = Field("href"),
    vip: Field | None = None,
    reverse: bool = False,
    **columns: str,
) -> DataFrame:
    """Chapters of each page: name, absolute url, vip flag and a gap-free index; blanks are dropped."""
    fields = {"name": name, "url": url} | ({"vip": vip} if vip else {})
    found = extract_records(pages, container, child, fields, url_fields=["url"], **columns)
    kept = found.filter("name <> '' and url <> ''")
    order = F.col("pos").desc() if reverse else F.col("pos")
    index = F.row_number().over(Window.partitionBy("page_id").orderBy(order)) - 1
    flag = F.col("vip") != "" if vip else F.lit(False)
    return kept.select("page_id", index.alias("idx"), "name", "url", flag.alias("vip"))


def resolve_toc_url(
    df: DataFrame, rule: str, record_url: str, json: str | None = None, paths: Sequence[str] = (),
    found: str | None = None, name: str = "toc_url",
) -> DataFrame:
    """Url of the table of contents from a rule column.

    Empty rule: the record url. ``{$.path}`` fields: filled from ``json``, or ``{$.bookId}`` from the
    trailing number of the record url. Absolute or rooted: resolved. Otherwise the value ``found`` on the
    detail page, falling back to the record url.
    """
    r, base = F.trim(F.coalesce(as_col(rule), F.lit(""))), F.col(record_url)
    filled = r
    if json is not None:
        has_json = F.col(json).isNotNull()
        filled = F.when(has_json, fill_fields(r, json, paths)).otherwise(r)
    filled = F.when(
        trailing_id(base) != "", F.replace(filled, F.lit("{$.bookId}"), trailing_id(base))
    ).otherwise(filled)
    value = F.coalesce(F.col(found), F.lit("")) if found else F.lit("")
    resolved = (
        F.when(r == "", base)
        .when(F.contains(r, F.lit("{")) & (filled != r) & (filled != ""), abs_url(base, filled))
        .when(r.rlike("^(?:https?://|/)"), abs_url(base, r))
        .when(value != "", abs_url(base, value))
        .otherwise(base)
    )
    return df.withColumn(name, resolved)


def fill_missing(
    records: DataFrame, search: DataFrame, fields: Sequence[str], key: Sequence[str], name: str = "name", pos: str = "pos"
) -> DataFrame:
    """Blank fields filled from the search row with the same title key, else from the first search row.

    Both candidates are reduced to one row before the join, so nothing multiplies. The search rows are read once:
    the first row of all is the first among the titles' first rows.
    """
    values = F.struct(*fields)
    keyed = search.withColumn("_tk", title_key(name))
    titles = settle(keyed.groupBy(*key, "_tk").agg(F.min_by(values, F.col(pos)).alias("_exact"), F.min(pos).alias("_at")))
    exact = titles.drop("_at")
    first = titles.groupBy(*key).agg(F.min_by("_exact", "_at").alias("_first"))
    out = records.withColumn("_tk", title_key(name)).join(exact, [*key, "_tk"], "left").join(first, [*key], "left")
    pick = F.coalesce("_exact", "_first")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.nullif(F.col(f), F.lit("")), pick[f], F.lit("")))
    return out.select(*records.columns)


def order_sections(entries: DataFrame, manifest: DataFrame, spine: DataFrame, min_chars: int = 20) -> DataFrame:
    """Sections of packages in reading order.

    ``entries(book_id, path, text)``, ``manifest(book_id, item_id, href, media_type)``,
    ``spine(book_id, pos, item_id)``. A reference is matched by exact path, percent-decoded path, base
    name, then without case. Books without a spine take their markup entries by path. Sections under
    ``min_chars`` are flagged ``short``.
    """
    base = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(F.col("href"), F.lit("+"), F.lit("%2B"))), F.col("href"))
    usable = F.col("media_type").isNull() | F.contains(F.col("media_type"), F.lit("html"))
    refs = spine.join(manifest.filter(usable), ["book_id", "item_id"]).select(
        "book_id", "pos", "href", decoded.alias("path1")
    )
    ways = F.array(
        F.struct(F.lit(0).alias("way"), F.col("href").alias("k")),
        F.struct(F.lit(1).alias("way"), F.col("path1").alias("k")),
        F.struct(F.lit(2).alias("way"), base(F.col("path1")).alias("k")),
        F.struct(F.lit(3).alias("way"), F.lower("path1").alias("k")),
        F.struct(F.lit(4).alias("way"), F.lower(base(F.col("path1"))).alias("k")),
    )
    names = F.array(
        F.struct(F.lit(0).alias("way"), F.col("path").alias("k")),
        F.struct(F.lit(1).alias("way"), F.col("path").alias("k")),
        F.struct(F.lit(2).alias("way"), base(F.col("path")).alias("k")),
        F.struct(F.lit(3).alias("way"), F.lower("path").alias("k")),
        F.struct(F.lit(4).alias("way"), F.lower(base(F.col("path"))).alias("k")),
    )
    left = refs.select("book_id", "pos", F.inline(ways))
    right = entries.select("book_id", "path", F.inline(names))  # paths only: texts join once, when the path is known
    hit = left.join(right, ["book_id", "way", "k"]).groupBy("book_id", "pos").agg(F.min(F.struct("way", "path"))["path"].alias("path"))
    texts = entries.select("book_id", "path", "text").dropDuplicates(["book_id", "path"])
    listed = hit.join(texts, ["book_id", "path"]).select("book_id", F.col("pos").cast("long").alias("pos"), "path", "text")
    markup = F.lower("path").rlike("\\.(?:x?html?)$")
    plain = entries.join(refs.select("book_id").distinct(), "book_id", "left_anti").filter(markup)
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy(F.lower("path"), "path"))
    plain = plain.select("book_id", rank.cast("long").alias("pos"), "path", "text")
    return listed.unionByName(plain).withColumn("short", F.coalesce(F.length("text"), F.lit(0)) < min_chars)
