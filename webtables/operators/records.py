"""Records out of HTML, JSON and plain bodies: each body takes the branch of its kind, all fields come out of one pass.

Fields are expressions: leaves read the values of one selector, path or template inside a row; alternatives, concatenation,
joining and replacement work on their values as columns. All leaves of all fields are followed side by side over
one pass of the nodes inside the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtables.functions._cols import once
from webtables.functions.text import collapse_ws, concat_all, first_of, join_list, replace_tail
from webtables.functions.urls import abs_url
from webtables.operators.extract import body_kind, fill_groups, regex_rows, variant_member, variant_scalars, variant_values
from webtables.operators.nodes import Step, any_of, chain, exclude, nth, rows, select, shred, value_of, within
from webtables.operators.scan import ordinal
from webtables.operators.walk import walk_pages
from webtables.session import settle

# --------------------------------------------------------------------------- expressions


@dataclass(frozen=True)
class Css:
    """Values of the nodes ``steps`` match inside a row, or of the row itself without steps.

    ``index`` picks one of the matches (negative from the end), ``skip`` drops some by position; positions count
    all matches, also those without a value. As text: all values, a line each.
    """

    steps: tuple[Step, ...] = ()
    kind: str = "text"
    index: int | None = None
    skip: tuple[int, ...] = ()


@dataclass(frozen=True)
class Json:
    """Scalars of a path inside a JSON row; as text the first of them."""

    path: tuple[str | int, ...]


@dataclass(frozen=True)
class Fill:
    """A template: ``$n`` is a group of a pattern row, ``{$.a.b}`` a member of a JSON row."""

    template: str


@dataclass(frozen=True)
class Literal:
    value: str


@dataclass(frozen=True)
class AnyOf:
    """The first part that is not blank."""

    parts: tuple[Expression, ...]


@dataclass(frozen=True)
class Concat:
    parts: tuple[Expression, ...]


@dataclass(frozen=True)
class Joined:
    """The values of one leaf with a separator between them."""

    part: Css | Json
    separator: str


@dataclass(frozen=True)
class Replaced:
    """Every match of a pattern in the text of a part replaced; an invalid pattern changes nothing."""

    part: Expression
    pattern: str
    by: str = ""


Expression = Css | Json | Fill | Literal | AnyOf | Concat | Joined | Replaced


def leaves(expression: Expression) -> Iterator[Expression]:
    """The leaves of an expression that read a row."""
    if isinstance(expression, AnyOf | Concat):
        for part in expression.parts:
            yield from leaves(part)
    elif isinstance(expression, Joined | Replaced):
        yield from leaves(expression.part)
    elif not isinstance(expression, Literal):
        yield expression


def as_text(expression: Expression, values: Mapping[Expression, Column]) -> Column:
    """Text of an expression; ``values`` has an array of strings for Css and Json leaves, a string for Fill."""
    match expression:
        case Literal(value):
            return F.lit(value)
        case AnyOf(parts):
            return first_of(*[as_text(p, values) for p in parts])
        case Concat(parts):
            return concat_all(*[as_text(p, values) for p in parts])
        case Joined(part, separator):
            return F.coalesce(join_list(values[part], separator), F.lit(""))
        case Replaced(part, pattern, by):
            return replace_tail(as_text(part, values), pattern, by)
        case Css():
            return F.coalesce(F.array_join(values[expression], "\n"), F.lit(""))
        case Json():
            return F.coalesce(F.try_element_at(values[expression], F.lit(1)), F.lit(""))
    return F.coalesce(values[expression], F.lit(""))


# --------------------------------------------------------------------------- rows of each kind


@dataclass(frozen=True)
class HtmlRows:
    """Rows of a page: nodes ``child`` inside the containers, or the containers; ``index`` counts inside a container, ``skip`` in the page's list."""

    container: tuple[Step, ...]
    child: Step | None = None
    index: int | None = None
    skip: tuple[int, ...] = ()

    def tests(self) -> list[Column]:
        return [s.test() for s in self.container] + ([self.child.test()] if self.child else [])


@dataclass(frozen=True)
class JsonRows:
    """Rows of a JSON body: the values of a path, arrays spread."""

    path: tuple[str | int, ...]


@dataclass(frozen=True)
class PatternRows:
    """Rows of any body: the matches of a pattern with ``groups`` groups."""

    pattern: str
    groups: int


@dataclass(frozen=True)
class Branch:
    """How to read one kind of body: its rows, and an expression for each field."""

    rows: HtmlRows | JsonRows | PatternRows
    fields: Mapping[str, Expression]


def _css(fields: Mapping[str, Expression]) -> list[Css]:
    return list(dict.fromkeys(x for e in fields.values() for x in leaves(e) if isinstance(x, Css)))


def tags_for(steps: Sequence[Step]) -> list[str]:
    return sorted({s.tag or "*" for s in steps})


def page_nodes(pages: DataFrame, branch: Branch, more: Sequence[Step] = (), page_id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """The nodes that the rows and fields of a branch (and ``more`` steps) can match, parsed once and stored."""
    used, found = _css(branch.fields), branch.rows
    last = [x.steps[-1] if x.steps else (found.child or found.container[-1]) for x in used]
    text_for = tags_for([s for s, x in zip(last, used, strict=True) if x.kind.lower() == "text"])
    html_for = tags_for([s for s, x in zip(last, used, strict=True) if x.kind.lower() in ("html", "innerhtml", "outerhtml")])
    tests = found.tests() + [s.test() for x in used for s in x.steps] + [s.test() for s in more]
    return settle(shred(pages, page_id, html, text_for=text_for, html_for=html_for, keep=[url]).filter(any_of(tests)))


def html_records(nodes: DataFrame, branch: Branch, url: str = "url") -> DataFrame:
    """page_id, pos, the page's url and the fields of every row, from stored nodes.

    The rows are found once. Every leaf with steps is a role of the nodes inside them: one structural join, one chain of
    windows, one numbering for index and skipped positions and one aggregate serve all fields.
    """
    spec = branch.rows
    found = rows(nodes, spec.container, spec.child, settled=True) if spec.child else select(nodes, spec.container).withColumn("scope_pre", F.col("pre"))
    if spec.index is not None:
        found = nth(found, spec.index, ("page_id", "scope_pre"))
    if spec.skip:
        found = exclude(found, spec.skip, ("scope_pre", "pre"))
    used = _css(branch.fields)
    own = [x for x in used if not x.steps]
    inner = [x for x in used if x.steps]
    spot = F.row_number().over(Window.partitionBy("page_id").orderBy("scope_pre", "pre")) - 1
    # a row that lies in two containers is two rows, and both have its fields
    out = settle(found.select("page_id", spot.cast("long").alias("pos"), "pre", "post", F.col(url).alias("_url"), *[value_of(x.kind).alias(f"own{i}") for i, x in enumerate(own)]))
    values: dict[Expression, Column] = {x: F.filter(F.array(f"own{i}"), lambda v: v != "") for i, x in enumerate(own)}
    if inner:
        listed = _inner_values(out.select("page_id", "pre", "post").distinct(), nodes, inner)
        out = out.join(listed, (out["page_id"] == listed["in_page"]) & (out["pre"] == listed["in_pre"]), "left")
        values |= {x: F.col(f"v{i}") for i, x in enumerate(inner)}
    return out.select("page_id", "pos", F.col("_url").alias("url_of_page"), *[as_text(e, values).alias(n) for n, e in branch.fields.items()])


def _inner_values(scopes: DataFrame, nodes: DataFrame, picks: Sequence[Css]) -> DataFrame:
    """in_page, in_pre and, per pick, v0, v1, ...: its values inside each scope in document order."""
    roles = [
        F.when(step.test(), F.struct(F.lit(i).alias("leaf"), F.lit(j).alias("step"), F.lit(step.child).alias("_child"), F.lit(len(x.steps) - 1).alias("_last")))
        for i, x in enumerate(picks) for j, step in enumerate(x.steps)]
    inside = within(scopes, nodes, any_of([s.test() for x in picks for s in x.steps])).drop("scope_post")
    spread = inside.withColumn("_role", F.explode(F.array_compact(F.array(*roles)))).select(*inside.columns, "_role.*")
    longest = max(len(x.steps) for x in picks)
    hits = chain(spread, ["page_id", "scope_pre", "leaf"], longest - 1, [F.col("_child")] * longest).filter(F.col("_hit") & (F.col("step") == F.col("_last")))
    group = Window.partitionBy("page_id", "scope_pre", "leaf")
    counted = hits.withColumn("_at", F.row_number().over(group.orderBy("pre")) - 1).withColumn("_of", F.count(F.lit(1)).over(group))
    keep, value = F.lit(True), F.lit("")
    for i, x in enumerate(picks):
        wanted = F.lit(True)
        if x.index is not None:
            wanted = F.col("_at") == (F.lit(x.index) if x.index >= 0 else F.col("_of") + x.index)
        elif x.skip:
            wanted = ~F.col("_at").isin(*[k for k in x.skip])
        keep = F.when(F.col("leaf") == i, wanted).otherwise(keep)
        value = F.when(F.col("leaf") == i, value_of(x.kind)).otherwise(value)
    read = counted.filter(keep).select("page_id", "scope_pre", "leaf", "pre", value.alias("v")).filter("v <> ''")
    one = lambda i: F.transform(F.array_sort(F.collect_list(F.when(F.col("leaf") == i, F.struct("pre", "v")))), lambda x: x["v"])
    return read.groupBy(F.col("page_id").alias("in_page"), F.col("scope_pre").alias("in_pre")).agg(*[one(i).alias(f"v{i}") for i in range(len(picks))])


def json_records(bodies: DataFrame, branch: Branch, page_id: str = "page_id", body: str = "html", url: str = "url") -> DataFrame:
    """page_id, pos, url_of_page and the fields of every value of the path; a body that is no JSON has none.

    A body is parsed once and its values stay variants; every leaf of the fields is read once for a row; there is no shuffle.
    """
    items = bodies.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url_of_page"),
        F.posexplode(variant_values(F.try_parse_json(F.col(body)), branch.rows.path)).alias("pos", "item"))
    used = list(dict.fromkeys(x for e in branch.fields.values() for x in leaves(e)))
    if used:
        read = {f"leaf{i}": variant_scalars(F.col("item"), x.path) if isinstance(x, Json) else _filled(x.template) for i, x in enumerate(used)}
        items = items.select("page_id", "pos", "url_of_page", once(**read))
    values = {x: F.col(f"leaf{i}") for i, x in enumerate(used)}
    return items.select("page_id", F.col("pos").cast("long").alias("pos"), "url_of_page", *[as_text(e, values).alias(n) for n, e in branch.fields.items()])


def _filled(template: str) -> Column:
    """Members named by ``{$.a.b}`` put into a template."""
    out = F.lit(template)
    for path in [part.split("}")[0] for part in template.split("{")[1:] if part.startswith("$") and "}" in part]:
        out = F.replace(out, F.lit("{" + path + "}"), F.coalesce(variant_member(F.col("item"), path), F.lit("")))
    return out


def pattern_records(bodies: DataFrame, branch: Branch, page_id: str = "page_id", body: str = "html", url: str = "url") -> DataFrame:
    """page_id, pos, url_of_page and the filled templates of every match."""
    found = regex_rows(bodies.select(F.col(page_id).alias("page_id"), F.col(url).alias("url_of_page"), F.col(body).alias("_body")), "_body", branch.rows.pattern, branch.rows.groups)
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "url_of_page", *[
        as_text(e, {x: fill_groups(x.template, "groups", branch.rows.groups) for x in leaves(e)}).alias(n) for n, e in branch.fields.items()])


def read_records(
    bodies: DataFrame, html: Branch | None = None, json: Branch | None = None, pattern: Branch | None = None, url_fields: Sequence[str] = (),
    name_fields: Sequence[str] = (), page_id: str = "page_id", body: str = "html", url: str = "url",
) -> DataFrame:
    """page_id, kind, pos and the fields of the records of all bodies, each read by the branch of its kind.

    A body that looks like JSON takes the JSON branch, another with a mark the HTML branch, one without a mark the pattern branch; without a
    branch of its kind a body takes the pattern branch, if there is one, and has no records otherwise. Blank and null bodies have none. ``url_fields`` are made absolute
    against the page's url, ``name_fields`` put on one line. Branches give the same fields.
    """
    # made once a row: each branch would build a derived body again for every use in its filter
    bodies = bodies.select(page_id, url, once(**{body: F.col(body)}))
    kind = body_kind(body)
    marked = bodies.withColumn("_kind", F.when((kind == "html") & ~F.contains(F.col(body), F.lit("<")), "text").otherwise(kind))
    taken = [(k, b) for k, b in (("json", json), ("html", html)) if b]
    parts = []
    for kind, branch in taken:
        own = marked.filter(F.col("_kind") == kind)
        found = json_records(own, branch, page_id, body, url) if kind == "json" else html_records(page_nodes(own, branch, (), page_id, body, url), branch, url)
        parts.append(found.withColumn("kind", F.lit(kind)))
    if pattern:
        rest = marked.filter(~F.col("_kind").isin([k for k, _ in taken])) if taken else marked
        parts.append(pattern_records(rest, pattern, page_id, body, url).withColumn("kind", F.lit("pattern")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    names = list((html or json or pattern).fields)
    for n in url_fields:
        out = out.withColumn(n, abs_url("url_of_page", F.col(n)))
    for n in name_fields:
        out = out.withColumn(n, collapse_ws(n))
    return out.select("page_id", "kind", "pos", *names)


# --------------------------------------------------------------------------- contents over several pages


def next_links(nodes: DataFrame, steps: Sequence[Step], urls: DataFrame, url: str = "url", kind: str = "href") -> DataFrame:
    """page_id, next_page_id, pos of the links that ``steps`` match, as far as ``urls(page_id, url)`` knows the page; no links to itself."""
    found = select(nodes, steps).select("page_id", F.col("pre").alias("pos"), abs_url(url, value_of(kind)).alias("to"))
    known = urls.select(F.col("page_id").alias("next_page_id"), F.col("url").alias("to"))
    return found.join(known, "to").filter("next_page_id <> page_id").select("page_id", "next_page_id", "pos")


def extract_contents(
    pages: DataFrame, starts: DataFrame, branch: Branch, next_steps: Sequence[Step], reverse: bool = False, max_pages: int | None = None,
    page_id: str = "page_id", html: str = "html", url: str = "url",
) -> DataFrame:
    """root, idx, page_id, truncated and the fields of the contents of each start page over all its next pages.

    ``branch`` has the fields name and url, and maybe vip. Rows of a page keep their order, or with ``reverse`` are taken from the end; pages come in
    visit order; rows without name or url are dropped; idx runs without gaps over the whole walk. ``truncated`` tells the walks that
    ``max_pages`` cut. Pages are parsed once for rows and next links. A walk of any length is numbered by ranges, so
    one with a third of all rows spans many tasks.
    """
    nodes = page_nodes(pages, branch, next_steps, page_id, html, url)
    found = html_records(nodes, branch, url)
    found = found.withColumn("url", abs_url("url_of_page", F.col("url"))).withColumn("name", collapse_ws("name")).filter("name <> '' AND url <> ''")
    links = next_links(nodes, next_steps, pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")), url)
    walked = walk_pages(starts, links, max_pages)
    listed = walked.join(found, "page_id").withColumn("_at", -F.col("pos") if reverse else F.col("pos"))
    numbered = ordinal(listed.select("root", "visit", "_at", "page_id", "truncated", *branch.fields), ["root"], [], ["visit", "_at"])
    return numbered.select("root", (F.col("pos") - 1).alias("idx"), "page_id", "truncated", *branch.fields)
