"""Shred pages into a relational node table, select nodes with structural joins, read their values.

Every node of a page is numbered by its token position: ``pre`` is the position of the opening mark,
``post`` the last position inside the node. A node ``d`` lies inside ``a`` iff
``a.pre < d.pre and d.pre <= a.post``. The intervals nest, so "has a selected ancestor" is a running
maximum of ``post`` in document order: one window pass per step, no pairs of nodes.

Tokenising, attribute parsing, predicates and values are JVM expressions. Only the pairing of opening
and closing marks, a stack, runs in Python: it sees one short code per token and no page text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtables.functions._cols import bind, once
from webtables.functions.text import collapse_ws, decode_entities, squash_line, tidy
from webtables.operators import _pairing
from webtables.operators._pairing import PAIR_FIELDS, PAIRS_TYPE, pair_batches
from webtables.session import settle

cloudpickle.register_pickle_by_value(_pairing)  # executors need no copy of this package

# --- fixed values: tags without a closing mark, tags with raw text content ---
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
]
RAW_TAGS = "script|style|textarea|title"
# --- fixed values: tags that break lines in flattened text, and subtrees left out of it ---
FLATTEN_BLOCKS = (
    "p|div|br|h1|h2|h3|h4|h5|h6|li|ul|ol|tr|td|th|table|section|article|blockquote|pre|hr|dd|dt|dl|"
    "figure|figcaption|header|footer"
)
FLATTEN_SKIPPED = ["script", "style", "head", "svg", "nav", "title"]

# Possessive repeats: linear time and constant stack on any page.
_ATTRS = "(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+"
_RAW = f"(?i:<({RAW_TAGS})(?=[\\s/>]){_ATTRS}(?<!/)>((?s:.*?))(?:</\\1[^>]*+>?|\\z))"
TOKEN = f"<!--(?s:.*?)(?:-->|\\z)|<[!?][^>]*+>?|</[^>]*+>?|{_RAW}|<{_ATTRS}>|<(?s:.*+)|[^<]++"
_OPEN = f"^<\\s*([^\\s/>]*){_ATTRS}>"
_ATTRIBUTE = "([^\\s=]*)\\s*=\\s*(\"[^\"]*\"?|'[^']*'?|\\S*)|([^\\s=]+)"

def _codes(tokens: Column) -> Column:
    def opening(tok: Column, name: Column) -> Column:
        leaf = name.isin(VOID_TAGS) | tok.endswith("/>")
        raw = name.isin(RAW_TAGS.split("|")) & tok.rlike(f"^(?:{_RAW})")
        mark = F.when(raw, "!").when(leaf, ".").otherwise("<")
        return F.when(name == "", name).otherwise(F.concat(mark, name))

    def code(tok: Column) -> Column:
        closed = F.regexp_extract(F.lower(F.trim(F.regexp_extract(tok, "^</([^>]*)>$", 1))), "^([^ ]*)", 1)
        return (
            F.when(~tok.startswith("<"), F.lit("t"))
            .when(tok.startswith("</"), bind(closed, lambda c: F.when(c == "", c).otherwise(F.concat(F.lit("/"), c))))
            .when(tok.startswith("<!") | tok.startswith("<?"), F.lit(""))
            .when(~tok.rlike(_OPEN), F.lit("t"))
            .otherwise(bind(F.lower(F.regexp_extract(tok, "^<\\s*([^\\s/>]*)", 1)), lambda n: opening(tok, n)))
        )

    return F.transform(tokens, code)


def _texts(tokens: Column, codes: Column) -> Column:
    """The text each token carries: decoded for text, untouched for raw elements, empty otherwise."""
    return F.transform(
        F.arrays_zip(tokens.alias("tok"), codes.alias("code")),
        lambda x: F.when(x["code"] == "t", decode_entities(x["tok"]))
        .when(x["code"].startswith("!"), F.regexp_extract(x["tok"], f"^{_RAW}", 2))
        .otherwise(F.lit("")),
    )


def _attributes(token: Column) -> Column:
    """Attributes of an opening mark in document order as an array of (name, value)."""
    body = F.regexp_replace(F.regexp_extract(token, f"^<\\s*[^\\s/>]*({_ATTRS})>", 1), "/$", "")

    def pair(piece: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, "^([^\\s=]*)", 1))
        value = F.regexp_extract(piece, "(?s)^[^=]*=\\s*(.*)$", 1)
        bare = F.regexp_replace(value, "(?s)^\"([^\"]*)\"?$|^'([^']*)'?$", "$1$2")
        return F.struct(name.alias("name"), bare.alias("raw"), decode_entities(bare).alias("value"))

    pieces = F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(0))
    return F.filter(F.transform(pieces, pair), lambda a: a["name"] != "")


def _first_of_name(attrs: Column) -> Column:
    names = F.transform(attrs, lambda a: a["name"])
    kept = F.filter(attrs, lambda a, i: F.array_position(names, a["name"]) == i + 1)
    return F.map_from_entries(F.transform(kept, lambda a: F.struct(a["name"].alias("key"), a["value"].alias("value"))))


def parse_pages(pages: DataFrame, page_id: str = "page_id", html: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """One row per page: its tokens, their texts and the paired nodes as arrays. No shuffle."""
    tokens = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(TOKEN), F.lit(0))
    staged = pages.select(F.col(page_id).alias("page_id"), *keep, tokens.alias("tokens"))
    staged = staged.withColumn("codes", _codes(F.col("tokens")))
    staged = staged.withColumn("texts", _texts(F.col("tokens"), F.col("codes")))
    arrays = {c: F.col(c) for c in ("tokens", "codes", "texts")}
    staged = staged.select("page_id", *keep, once(**arrays))
    return staged.withColumn("pairs", F.arrow_udf(pair_batches, PAIRS_TYPE)(F.col("codes")))


def _span(values: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(values, first, F.greatest(last - first + 1, F.lit(0))), "")


def _markup(tokens: Column, codes: Column, texts: Column, closers: Column) -> Column:
    """The serialised form of each token followed by the closing marks due there."""
    escape = lambda t: F.replace(
        F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")
    )

    def one(x: Column) -> Column:
        attrs = F.array_join(
            F.transform(
                _attributes(x["tok"]), lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), a["value"], F.lit('"'))
            ),
            "",
        )
        opening = F.concat(F.lit("<"), F.substring(x["code"], F.lit(2), F.length(x["code"])), attrs, F.lit(">"))
        opened = F.when(x["code"].rlike("^[<.!]"), opening).otherwise(F.lit(""))
        return F.concat(opened, escape(x["txt"]), x["end"])

    zipped = F.arrays_zip(
        tokens.alias("tok"), codes.alias("code"), texts.alias("txt"), closers.alias("end")
    )
    return F.transform(zipped, one)


def shred(
    pages: DataFrame,
    page_id: str = "page_id",
    html: str = "html",
    text_for: Sequence[str] = (),
    html_for: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Page table to node table.

    ``text_for`` and ``html_for`` list the tags (``*`` for all) whose subtree text or markup is wanted; it
    is cut from the page while the page is at hand, so no later join has to bring it back. ``keep`` carries
    further page columns along.
    """
    parsed = parse_pages(pages, page_id, html, keep)
    pairs = F.col("pairs")
    if html_for:
        parsed = parsed.withColumn(
            "marked", _markup(F.col("tokens"), F.col("codes"), F.col("texts"), pairs["closers"])
        )

    def wanted(tag: Column, tags: Sequence[str], value: Column) -> Column:
        if not tags:
            return F.lit(None).cast("string")
        return value if "*" in tags else F.when(tag.isin(list(tags)), value)

    def node(e: Column) -> Column:
        tag = F.substring(F.element_at(F.col("codes"), e["pre"]), F.lit(2), F.length(F.element_at(F.col("codes"), e["pre"])))
        fields = [
            e["pre"].alias("pre"), e["post"].alias("post"), e["parent"].alias("parent"),
            e["depth"].alias("depth"), e["sib"].alias("sib"), tag.alias("tag"),
            F.element_at(F.col("tokens"), e["pre"]).alias("mark"),
            F.transform(
                e["own"], lambda p: F.struct(p.alias("pos"), F.element_at(F.col("texts"), p).alias("txt"))
            ).alias("own_text_parts"),
            wanted(tag, text_for, _span(F.col("texts"), e["pre"], e["post"])).alias("text"),
        ]
        if html_for:
            whole = _span(F.col("marked"), e["pre"], e["post"])
            whole = F.substring(whole, F.lit(1), F.length(whole) - e["tail"])
            fields.append(wanted(tag, html_for, whole).alias("markup"))
        return F.struct(*fields)

    zipped = F.arrays_zip(*[pairs[f].alias(f) for f in PAIR_FIELDS[:-1]])
    nodes = parsed.select("page_id", *keep, F.transform(zipped, node).alias("nodes"))
    # outer: a plain inline would evaluate the whole array a second time to filter out empty ones
    nodes = nodes.select("page_id", *keep, F.inline_outer("nodes")).filter("pre is not null")
    nodes = nodes.withColumn("_attrs", _attributes(_mark_only(F.col("mark"))))
    attrs = F.col("_attrs")
    ids = F.filter(attrs, lambda a: a["name"] == "id")
    classes = F.filter(attrs, lambda a: a["name"] == "class")
    words = F.filter(F.split(F.array_join(F.transform(classes, lambda a: a["raw"]), " "), "\\s+"), lambda w: w != "")
    out = [
        "page_id", *keep, "pre", "post", "parent", "depth", "sib", "tag",
        F.when(F.size(ids) > 0, F.element_at(ids, -1)["raw"]).alias("id"),
        words.alias("classes"),
        _first_of_name(attrs).alias("attrs"),
        "own_text_parts",
        "text",
    ]
    if html_for:
        opening = F.concat(
            F.lit("<"), F.col("tag"),
            F.array_join(
                F.transform(attrs, lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), a["value"], F.lit('"'))), ""
            ),
            F.lit(">"),
        )
        out += [
            F.expr("substring(markup, length(opening) + 1)").alias("html"),
            F.concat(F.col("markup"), F.lit("</"), F.col("tag"), F.lit(">")).alias("outer_html"),
        ]
        nodes = nodes.withColumn("opening", opening)
    return nodes.select(*out)


def _mark_only(mark: Column) -> Column:
    """The opening mark itself: a raw element's token also carries its text."""
    return F.regexp_extract(mark, f"^(<{_ATTRS}>)", 1)


@dataclass(frozen=True)
class Step:
    """One selector step: tag, id, classes and an attribute test; ``child`` for a direct child."""

    tag: str | None = None
    id: str | None = None
    classes: tuple[str, ...] = ()
    attr: str | None = None
    op: str | None = None  # None: present; =, *=, ^=, $=
    value: str | None = None
    child: bool = False

    def test(self) -> Column:
        cond = F.lit(True)
        if self.tag and self.tag != "*":
            cond = cond & (F.col("tag") == self.tag.lower())
        if self.id is not None:
            cond = cond & (F.col("id") == self.id)
        for name in self.classes:
            cond = cond & has_class(name)
        if self.attr is not None:
            cond = cond & attribute_test(F.col("attrs")[self.attr.lower()], self.op, self.value)
        return cond


def has_class(name: str) -> Column:
    return F.exists("classes", lambda c: F.lower(c) == F.lit(name.lower()))


def attribute_test(found: Column, op: str | None, value: str | None) -> Column:
    if op is None:
        return found.isNotNull()
    tests = {
        "=": found == value,
        "*=": F.contains(found, F.lit(value)),
        "^=": found.startswith(value),
        "$=": found.endswith(value),
    }
    return F.coalesce(tests[op], F.lit(False))


def any_of(tests: Sequence[Column]) -> Column:
    some = tests[0]
    for t in tests[1:]:
        some = some | t
    return some


def chain(roles: DataFrame, keys: Sequence[str], rounds: int, child: Sequence[Column | bool]) -> DataFrame:
    """Follow selector steps over rows of (node, step): keep a row iff its chain of steps holds.

    A descendant step needs an earlier hit whose interval reaches this node (running maximum, strictly
    earlier nodes); a child step needs its own parent among the hits (parent and children share a group).
    """
    out = roles.withColumn("_hit", F.col("step") == 0)
    before = Window.partitionBy(*keys).orderBy("pre").rangeBetween(Window.unboundedPreceding, -1)
    for i in range(1, rounds + 1):
        above = F.col("_hit") & (F.col("step") == i - 1)
        wants_child = child[i] if isinstance(child[i], Column) else F.lit(child[i])
        fixed = isinstance(child[i], bool)
        now = F.lit(False)
        if not fixed or not child[i]:
            reach = F.max(F.when(above, F.col("post"))).over(before)
            now = F.coalesce(reach >= F.col("pre"), F.lit(False))
        if not fixed or child[i]:
            group = F.when(F.col("step") == i - 1, F.col("pre")).otherwise(F.col("parent"))
            parent = F.max(F.when(above, F.lit(1))).over(Window.partitionBy(*keys, group))
            now = F.when(wants_child, F.coalesce(parent == 1, F.lit(False))).otherwise(now)
        out = out.withColumn("_now", now).withColumn(
            "_hit", F.when(F.col("step") == i, F.col("_now")).otherwise(F.col("_hit"))
        ).drop("_now")
    return out


def select(nodes: DataFrame, steps: Sequence[Step], scope: Sequence[str] = ()) -> DataFrame:
    """Nodes matched by a chain of steps, in document order within ``page_id`` (and ``scope``).

    Only nodes that pass some step reach the shuffle. All descendant steps share one sort.
    """
    tests = [s.test() for s in steps]
    if len(steps) == 1:
        return nodes.filter(tests[0])
    passed = F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]))
    roles = nodes.filter(any_of(tests)).withColumn("step", F.explode(passed))
    done = chain(roles, ["page_id", *scope], len(steps) - 1, [s.child for s in steps])
    return done.filter(F.col("_hit") & (F.col("step") == len(steps) - 1)).select(*nodes.columns)


def select_any(nodes: DataFrame, alternatives: Sequence[Sequence[Step]]) -> DataFrame:
    """Union of selectors without duplicates; ``alt`` is the first alternative that matched.

    All alternatives are followed side by side over one pass of the nodes; a node that passes some step of one of
    them is a row per such step, so pages are parsed once.
    """
    longest = max(len(steps) for steps in alternatives)
    tests = [(i, j, step) for i, steps in enumerate(alternatives) for j, step in enumerate(steps)]
    role = lambda i, j, step: F.struct(
        F.lit(i).alias("alt"), F.lit(j).alias("step"), F.lit(step.child).alias("_child"), F.lit(len(alternatives[i]) - 1).alias("_last"))
    passed = F.array_compact(F.array(*[F.when(step.test(), role(i, j, step)) for i, j, step in tests]))
    kept = nodes.filter(any_of([step.test() for _, _, step in tests])).withColumn("_role", F.explode(passed))
    roles = kept.select(*nodes.columns, "_role.alt", "_role.step", "_role._child", "_role._last")
    done = chain(roles, ["page_id", "alt"], longest - 1, [F.col("_child")] * longest)
    hits = done.filter(F.col("_hit") & (F.col("step") == F.col("_last")))
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy("page_id", "pre").orderBy("alt")))
    return first.filter("_n = 1").select(*nodes.columns, "alt")


def nth(selected: DataFrame, index: int, scope: Sequence[str] = ("page_id",), order: Sequence[str] = ("pre",)) -> DataFrame:
    """Pick by position (0-based, negative from the end); out of range gives nothing."""
    by = [F.col(c) if index >= 0 else F.col(c).desc() for c in order]
    wanted = index + 1 if index >= 0 else -index
    ranked = selected.withColumn("_n", F.row_number().over(Window.partitionBy(*scope).orderBy(*by)))
    return ranked.filter(F.col("_n") == wanted).drop("_n")


def exclude(selected: DataFrame, indexes: Sequence[int] | None, order: Sequence[str] = ("pre",)) -> DataFrame:
    """Drop positions of the page's whole list; an empty or malformed list drops nothing."""
    if not indexes or not all(isinstance(i, int) for i in indexes):
        return selected
    spot = F.row_number().over(Window.partitionBy("page_id").orderBy(*order)) - 1
    return selected.withColumn("_n", spot).filter(~F.col("_n").isin(list(indexes))).drop("_n")


def enclosing(nodes: DataFrame, scopes: DataFrame, carry: Sequence[str], pre: str = "pre", post: str = "post", itself: bool = False) -> DataFrame:
    """``nodes`` with the ``carry`` columns of every scope around them, one row per node and scope; no pairs are formed.

    Scopes open at ``pre`` and close at ``post``; intervals nest, so at most one scope is open per level. In document
    order a running sum gives the number of open scopes at a node, and the scope of a level is the one that opened
    last at it. Work grows with the rows in and out. ``itself`` counts a scope as around its own node.
    """
    inner = F.struct(*nodes.columns)
    opened = scopes.select("page_id", F.struct(*carry).alias("_scope"), F.col(pre).alias("_from"), F.col(post).alias("_to"))
    at_open, at_node = (0, 1) if itself else (1, 0)
    edges = opened.select("page_id", "_scope", F.inline(F.array(
        F.struct(F.col("_from").alias("_at"), F.lit(at_open).alias("_turn"), F.lit(1).alias("_by")),
        F.struct(F.col("_to").alias("_at"), F.lit(2).alias("_turn"), F.lit(-1).alias("_by")))))
    events = nodes.select("page_id", F.col("pre").alias("_at"), F.lit(at_node).alias("_turn"), F.lit(0).alias("_by"), inner.alias("_node")).unionByName(
        edges, allowMissingColumns=True)
    order = Window.partitionBy("page_id").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    deep = events.withColumn("_open", F.sum("_by").over(order))
    levels = F.when(F.col("_node").isNull(), F.array("_open")).when(F.col("_open") > 0, F.sequence(F.lit(1).cast("long"), F.col("_open")))
    spread = deep.filter("_by >= 0").select("page_id", "_at", "_turn", "_node", "_scope", F.explode(levels).alias("_level"))
    last = Window.partitionBy("page_id", "_level").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    found = spread.withColumn("_scope", F.last("_scope", ignorenulls=True).over(last)).filter("_node IS NOT NULL")
    return found.select("_node.*", "_scope.*")


def within(scopes: DataFrame, nodes: DataFrame, test: Column | None = None) -> DataFrame:
    """Structural join: nodes lying inside each scope node, with ``scope_pre`` and ``scope_post`` added."""
    inner = nodes if test is None else nodes.filter(test)
    marked = scopes.select("page_id", F.col("pre").alias("scope_pre"), F.col("post").alias("scope_post"))
    return enclosing(inner, marked, ["scope_pre", "scope_post"], "scope_pre", "scope_post")


def rows(nodes: DataFrame, container: Sequence[Step], child: Step, settled: bool = False) -> DataFrame:
    """Children inside each container; a container without one counts itself if its tag fits.

    The nodes that can matter are settled first: pages are parsed once for both sides of the join.
    """
    if not settled:
        nodes = settle(nodes.filter(any_of([child.test(), *[s.test() for s in container]])))
    boxes = select(nodes, container)
    kids = within(boxes, nodes, child.test()).drop("scope_post")
    alone = boxes.filter(F.col("tag") == (child.tag or "").lower()).join(
        kids.select("page_id", F.col("scope_pre").alias("pre")), ["page_id", "pre"], "left_anti"
    )
    return kids.unionByName(alone.withColumn("scope_pre", F.col("pre")))


def value_of(kind: str) -> Column:
    """Value of a node: text, ownText, textNodes, html, outerHtml or any attribute."""
    parts = F.transform("own_text_parts", lambda p: p["txt"])
    key = kind.strip().lower()
    if key == "text":
        return collapse_ws("text")
    if key == "owntext":
        return collapse_ws(F.array_join(parts, ""))
    if key == "textnodes":
        trimmed = F.transform(parts, lambda t: F.regexp_replace(t, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", ""))
        return F.array_join(F.filter(trimmed, lambda t: t != ""), "\n")
    if key in ("html", "innerhtml"):
        return F.col("html")
    if key == "outerhtml":
        return F.col("outer_html")
    return F.coalesce(F.col("attrs")[key], F.lit(""))


def extract(selected: DataFrame, kind: str, name: str = "value") -> DataFrame:
    """Add the value of each selected node."""
    return selected.withColumn(name, value_of(kind))


def extract_joined(
    selected: DataFrame, kind: str, keys: Sequence[str] = ("page_id",), name: str = "value", order: str = "pre"
) -> DataFrame:
    """All non-empty values of a page joined by line breaks in document order."""
    found = selected.select(*keys, order, value_of(kind).alias("_v")).filter("_v <> ''")
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_v").alias("v"))))
    return found.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["v"]), "\n").alias(name))


@dataclass(frozen=True)
class PathStep:
    """One path step: ``deep`` for ``//``; tests on attributes and text; ``n`` is a 1-based position."""

    tag: str = "*"
    deep: bool = True
    attr: str | None = None
    equals: str | None = None
    contains: str | None = None
    text: str | None = None
    n: int | None = None

    def test(self) -> Column:
        cond = F.lit(True) if self.tag == "*" else F.col("tag") == self.tag.lower()
        if self.text is not None:
            cond = cond & F.contains(collapse_ws("text"), F.lit(self.text))
        if self.attr is None:
            return cond
        found = F.col("attrs")[self.attr.lower()]
        if self.equals is not None and self.attr.lower() == "class":
            for word in self.equals.split():
                cond = cond & has_class(word)
            return cond & found.isNotNull()
        if self.equals is not None:
            return cond & F.coalesce(found == self.equals, F.lit(False))
        if self.contains is not None:
            return cond & F.coalesce(F.contains(found, F.lit(self.contains)), F.lit(False))
        return cond & found.isNotNull()


def path_select(nodes: DataFrame, steps: Sequence[PathStep], first: bool = False) -> DataFrame:
    """Path steps from the page root; ``[n]`` counts the pooled matches of each base node.

    The first step is searched at any depth. ``ord`` numbers a page's results; ``first`` keeps one.
    """
    nodes = settle(nodes.filter(any_of([s.test() for s in steps]))) if len(steps) > 1 else nodes
    current = None
    for step in steps:
        pool = nodes.filter(step.test())
        if current is None:
            hits, base = pool.withColumn("ord", F.array(F.col("pre"))), ["page_id"]
        else:
            bases = current.select(
                "page_id", F.col("ord").alias("_base"), F.col("pre").alias("_pre"), F.col("post").alias("_post")
            )
            if step.deep:
                hits = enclosing(pool, bases, ["_base"], "_pre", "_post")
            else:
                hits = pool.join(bases.withColumnRenamed("_pre", "parent"), ["page_id", "parent"])
            hits = hits.withColumn("ord", F.concat("_base", F.array(F.col("pre")))).select(
                *nodes.columns, "ord", "_base"
            )
            base = ["page_id", "_base"]
        if step.n is not None:
            hits = nth(hits, step.n - 1, base) if step.n >= 1 else hits.limit(0)
        current = hits.select(*nodes.columns, "ord")
    return nth(current, 0, ("page_id",), ("ord",)) if first else current


def flatten(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Body text with block breaks and the first usable heading of each page. No shuffle."""
    parsed = parse_pages(pages, page_id, html)
    pairs = F.col("pairs")
    zipped = F.arrays_zip(*[pairs[f].alias(f) for f in ("pre", "post", "tail")])
    tagged = F.transform(
        zipped,
        lambda e: F.struct(
            e["pre"].alias("pre"), e["post"].alias("post"), e["tail"].alias("tail"),
            F.substring(F.element_at(F.col("codes"), e["pre"]), F.lit(2), F.length(F.element_at(F.col("codes"), e["pre"]))).alias("tag"),
        ),
    )
    of_interest = ["body", "h1", "h2", "h3", "h4", "h5", "h6", *FLATTEN_SKIPPED]
    marks = F.filter(tagged, lambda e: e["tag"].isin(of_interest))
    base = parsed.select("page_id", once(codes=F.col("codes"), texts=F.col("texts"), closers=pairs["closers"], marks=marks))
    base = base.select("page_id", once(
        codes=F.col("codes"), texts=F.col("texts"), closers=F.col("closers"), marks=F.col("marks"),
        skips=F.filter("marks", lambda e: e["tag"].isin(FLATTEN_SKIPPED)),
    ))
    breaks = f"</(?:{FLATTEN_BLOCKS})>"
    count = lambda c: F.size(F.regexp_extract_all(c, F.lit(breaks), F.lit(0)))
    ends = lambda c: F.when(c == "", c).otherwise(F.repeat(F.lit("\n"), count(c)))
    opens = lambda c: F.when(c.rlike(f"^[<.](?:{FLATTEN_BLOCKS})$"), F.lit("\n")).otherwise(F.lit(""))

    def emit(x: Column, at: Column) -> Column:
        whole = F.concat(opens(x["code"]), x["txt"], ends(x["end"]))
        covers = F.filter("skips", lambda s: (s["pre"] <= at + 1) & (at + 1 <= s["post"]))

        def shown(cover: Column) -> Column:
            # at the end of a skipped subtree only the marks of its ancestors still count
            beyond = cover["tail"] - F.length(cover["tag"]) - 3
            rest = F.when(cover["post"] == at + 1, ends(F.right(x["end"], beyond))).otherwise(F.lit(""))
            return F.when(cover.isNull(), whole).otherwise(rest)

        return bind(F.try_element_at(covers, F.lit(1)), shown)

    zipped = F.arrays_zip(F.col("codes").alias("code"), F.col("texts").alias("txt"), F.col("closers").alias("end"))
    base = base.withColumn("parts", F.transform(zipped, emit))
    bodies = F.filter("marks", lambda e: e["tag"] == "body")
    body = F.try_element_at(bodies, F.lit(1))
    start = F.coalesce(body["pre"], F.lit(1))
    stop = F.coalesce(body["post"], F.size("parts"))
    inline = lambda e: squash_line(F.translate(_span(F.col("parts"), e["pre"], e["post"]), "\n", " "))

    def heading(tag: str) -> Column:
        found = F.try_element_at(F.filter("marks", lambda e: e["tag"] == tag), F.lit(1))
        value = inline(found)
        if tag == "title":
            value = squash_line(F.translate(decode_entities(F.element_at("texts", found["pre"])), "\n", " "))
        return F.when(F.length(value).between(1, 60), value)

    names = ["h1", "h2", "h3", "h4", "h5", "h6", "title"]
    return base.select(
        "page_id",
        F.coalesce(*[heading(t) for t in names], F.lit("")).alias("heading"),
        tidy(_span(F.col("parts"), start, stop)).alias("text"),
    )
