"""Literal pages and brute force for shredding, selection and records."""

import random
import re

import pytest
from pyspark.sql import functions as F

from webtables.operators import extract as E
from webtables.operators import nodes as N

PAGES = {
    1: '<div class="r x">a<span>b</span>c</div>',
    2: "<section>x<br>y</section>",
    3: "<p><b>x<p>y</i>",
    4: '</i><ul><li><a href="/q?a&amp;b" id=z>k</a><li>m</ul>t<script>if (a<b) "</p>"</script><h1>T</h1>',
    5: '<dl><dd>0</dd><dd>1</dd><dd>2</dd><dd>3</dd><dd>4</dd></dl>',
    6: '<div class="k">a</div><div class="K j">b</div><DIV class=k>c',
    7: '<body><a href="/q">1</a><a href="/qq">2</a><a title=x href="/r.html">3</a></body>',
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(list(PAGES.items()), "page_id long, html string")


@pytest.fixture(scope="module")
def nodes(pages):
    return N.shred(pages, text_for=["*"], html_for=["*"]).cache()


def values(df, page=None):
    rows = df.filter(F.col("page_id") == page) if page else df
    return [r["value"] for r in rows.orderBy("page_id", "pre").collect()]


def test_text_kinds(nodes):
    div = nodes.filter("page_id = 1 and tag = 'div'")
    assert values(N.extract(div, "ownText")) == ["ac"]
    assert values(N.extract(div, "text")) == ["abc"]
    assert values(N.extract(nodes.filter("tag = 'section'"), "textNodes")) == ["x\ny"]


def test_unclosed_and_stray_marks(nodes):
    got = {r["pre"]: (r["tag"], r["parent"]) for r in nodes.filter("page_id = 3").collect()}
    assert got == {1: ("p", 0), 2: ("b", 1), 4: ("p", 2)}


def test_intervals_nest(nodes):
    for page in PAGES:
        rows = nodes.filter(F.col("page_id") == page).orderBy("pre").collect()
        spans = {r["pre"]: r["post"] for r in rows}
        for r in rows:
            assert r["pre"] <= r["post"]
            if r["parent"]:
                assert r["parent"] < r["pre"] and r["post"] <= spans[r["parent"]]


def test_raw_and_markup(nodes):
    script = nodes.filter("tag = 'script'")
    assert values(N.extract(script, "text")) == ['if (a<b) "</p>"']
    section = nodes.filter("tag = 'section'")
    assert values(N.extract(section, "html")) == ["x<br></br>y"]
    assert values(N.extract(section, "outerHtml")) == ["<section>x<br></br>y</section>"]
    link = nodes.filter("page_id = 4 and tag = 'a'")
    assert values(N.extract(link, "href")) == ["/q?a&b"]
    assert link.first()["id"] == "z"


def test_join_and_index(nodes):
    ks = N.select(nodes, [N.Step(classes=("k",))])
    assert N.extract_joined(ks, "text").first()["value"] == "a\nb\nc"
    assert values(N.extract(N.nth(ks, -1), "text")) == ["c"]
    links = N.select(nodes, [N.Step("a")]).filter("page_id = 7")
    assert values(N.extract(N.nth(links, 0), "text")) == ["1"]
    assert N.nth(links, 9).count() == 0


def test_exclude(nodes):
    dds = N.rows(nodes, [N.Step("dl")], N.Step("dd"))
    assert dds.count() == 5
    assert N.exclude(dds, [0, 1]).count() == 3
    assert N.exclude(dds, [0, 1, 2, 3, 4]).count() == 0
    assert N.exclude(dds, ["x"]).count() == 5
    alone = N.rows(nodes.filter("page_id = 5"), [N.Step("dd")], N.Step("dd"))
    assert alone.count() == 5


def test_attribute_tests(nodes):
    pick = lambda op, v: [r["pre"] for r in N.select(nodes, [N.Step("a", attr="href", op=op, value=v)])
                          .filter("page_id = 7").orderBy("pre").collect()]
    assert len(pick("=", "/q")) == 1 and len(pick("*=", "q")) == 2
    assert len(pick("^=", "/q")) == 2 and len(pick("$=", ".html")) == 1
    assert N.select(nodes, [N.Step("a", attr="title")]).count() == 1
    assert N.select(nodes, [N.Step(id="z")]).count() == 1


def test_paths(spark):
    page = "<html><body><div class='w v'><p>1</p><p>2</p></div><div><p>3</p></div><span class='w'>s</span></body></html>"
    nodes = N.shred(spark.createDataFrame([(1, page)], "page_id long, html string"), text_for=["*"])
    text = lambda steps, **k: values(N.extract(N.path_select(nodes, steps, **k), "text"))
    assert text([N.PathStep("span", attr="class", equals="w")]) == ["s"]
    assert text([N.PathStep("html"), N.PathStep("p")]) == ["1", "2", "3"]
    assert text([N.PathStep("p", n=2)]) == ["2"]
    assert text([N.PathStep("div"), N.PathStep("p", deep=False, n=1)]) == ["1", "3"]
    assert text([N.PathStep("*", attr="class", equals="v w")]) == ["12"]
    assert text([N.PathStep("p", text="3")], first=True) == ["3"]
    assert text([N.PathStep("div", attr="class", contains="v"), N.PathStep("p")]) == ["1", "2"]


def brute_tree(html):
    """A plain reading of the pairing rule: nodes as (tag, parent index)."""
    out, stack = [], []
    for close, tag in re.findall(r"<(/?)([a-z]+)>", html):
        if close:
            if tag in [out[i][0] for i in stack]:
                while out[stack.pop()][0] != tag:
                    pass
        else:
            out.append((tag, stack[-1] if stack else None))
            if tag != "br":
                stack.append(len(out) - 1)
    return out


def brute_select(tree, steps):
    def ok(i, k):
        tag, child = steps[k]
        if tree[i][0] != tag:
            return False
        if k == 0:
            return True
        up = tree[i][1]
        while up is not None:
            if ok(up, k - 1):
                return True
            if child:
                return False
            up = tree[up][1]
        return False

    return sum(ok(i, len(steps) - 1) for i in range(len(tree)))


def test_selection_brute_force(spark):
    rng = random.Random(7)
    html = ["".join(rng.choice(["<a>", "</a>", "<b>", "</b>", "<c>", "</c>", "<br>", "t"]) for _ in range(60)) for _ in range(40)]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    nodes = N.shred(pages).cache()
    trees = [brute_tree(h) for h in html]
    assert nodes.count() == sum(map(len, trees))
    for steps in ([("a", False), ("b", False)], [("a", False), ("a", True)], [("b", False), ("c", True), ("a", False)],
                  [("a", False), ("a", False), ("a", False)], [("c", False), ("b", False), ("a", True)]):
        found = N.select(nodes, [N.Step(t, child=c) for t, c in steps])
        assert found.count() == sum(brute_select(t, steps) for t in trees), steps


def test_json(spark):
    df = spark.createDataFrame([(1, '{"d":{"l":[{"n":"p","t":["u","v"]},{"n":null},{"n":{"n":2}}]}}')], "row_id long, body string")
    one = lambda c: df.select(c.alias("v")).first()["v"]
    assert one(E.json_first("body", ["d", "l", 0, "n"])) == "p"
    assert one(F.array_join(E.json_strings("body", ["d", "l", "*", "t"]), "/")) == "u/v"
    assert one(E.json_first("body", ["d", "l", -3, "t", 1])) == "v"
    assert [r["item"] for r in E.json_rows(df, "body", ["d", "l"]).orderBy("pos").collect()][0] == '{"n":"p","t":["u","v"]}'
    found = [r["item"] for r in E.json_descend(df, "body", "n").orderBy("pos").collect()]
    assert found == ["p", '{"n":2}', "2"]
    bad = spark.createDataFrame([(1, "{oops")], "row_id long, body string")
    assert E.json_rows(bad, "body", ["d"]).count() == 0 and E.json_descend(bad, "body", "n").count() == 0


def test_regex_rows(spark):
    df = spark.createDataFrame([('<a href="1">x</a>\n<a href="2" vip="v">y</a>',)], "html string")
    rows = E.regex_rows(df, "html", '<a href="(\\d)"(?: vip="(\\w)")?>(\\w)</a>', 3)
    got = rows.select("groups", E.fill_groups("$3/$1/$2/$9", "groups", 3).alias("f")).collect()
    assert [r["groups"][1:] for r in got] == [["1", "", "x"], ["2", "v", "y"]]
    assert [r["f"] for r in got] == ["x/1//$9", "y/2/v/$9"]
    assert E.regex_rows(df, "html", "<a", 0, limit=1).count() == 1


def test_sections(spark):
    long = "x" * 30
    entries = spark.createDataFrame(
        [(1, "o/a b.xhtml", long + "a"), (1, "o/c.xhtml", long + "c"), (1, "o/short.xhtml", "hi"), (2, "z.html", long), (2, "B.html", long)],
        "book_id long, path string, text string")
    manifest = spark.createDataFrame(
        [(1, "i1", "o/a%20b.xhtml", None), (1, "i2", "x/C.xhtml", "application/xhtml+xml"), (1, "i3", "o/short.xhtml", None),
         (1, "i4", "o/c.xhtml", "image/png")], "book_id long, item_id string, href string, media_type string")
    spine = spark.createDataFrame([(1, 0, "i2"), (1, 1, "i1"), (1, 2, "i3"), (1, 3, "i4")], "book_id long, pos int, item_id string")
    got = E.order_sections(entries, manifest, spine).orderBy("book_id", "pos").collect()
    assert [(r["book_id"], r["path"], r["short"]) for r in got] == [
        (1, "o/c.xhtml", False), (1, "o/a b.xhtml", False), (1, "o/short.xhtml", True), (2, "B.html", False), (2, "z.html", False)]


def test_deep_members_long_tags_and_late_openings(spark):
    deep = '{"a":' * 20 + '{"n":1,"s":"[{{\\\"["}' + "}" * 20
    df = spark.createDataFrame([(1, deep)], "i int, body string")
    assert [r["item"] for r in E.json_descend(df, "body", "n").collect()] == ["1"] and E.json_descend(df, "body", "n", depth=5).count() == 0
    assert spark.range(1).select(E.body_kind(F.lit(" " * 100 + "[1]"))).first()[0] == "json"
    tags = ["x" * 70 + "a", "x" * 70 + "b"]
    pages = spark.createDataFrame([(1, f"<{tags[0]}>p</{tags[0]}><{tags[1]}>q</{tags[1]}>")], "page_id long, html string")
    assert {r["tag"] for r in N.shred(pages).collect()} >= set(tags)


def test_flatten_skips_and_headings(spark):
    html = "<head><title>T &amp; U</title></head><body><nav><p>n</div>y</nav><h2>Head<br>two</h2><p>one  two<p>three</body>"
    row = N.flatten(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert row["heading"] == "Head two"
    assert row["text"] == "Head\n\ntwo\n\none two\nthree"


def test_records_of_odd_bodies(spark):
    from webtables.operators import records as R

    step = lambda tag, **k: N.Step(tag, **k)
    bodies = spark.createDataFrame([
        (1, "http://a.b/x/", '<div><p class="t">one <b>two</b></p><p>three</p></div><div><p></p></div>'), (2, "http://a.b/", ' \n{"list": [{"n": "x", "u": ["/1", "/2"]}, null, {"n": null}, "plain"]}'),
        (3, "http://a.b/", "{not json"), (4, "http://a.b/", ""), (5, "http://a.b/", None), (6, "http://a.b/", "k=1;k=22;k="), (7, None, "<div><div><p>deep</p></div></div>"),
    ], "page_id long, url string, html string")
    p = (step("p"),)
    html = R.Branch(R.HtmlRows((step("div"),)), {
        "name": R.AnyOf((R.Css(p, index=5), R.Css((step("i"),)), R.Css(p, index=-1))), "url": R.Concat((R.Literal("n"), R.Replaced(R.Joined(R.Css(p), "+"), "[", "bad pattern")))})
    json = R.Branch(R.JsonRows(("list",)), {"name": R.Json(("n",)), "url": R.Joined(R.Json(("u",)), "|")})
    pattern = R.Branch(R.PatternRows("k=(\\d+)", 1), {"name": R.Fill("$1/$2"), "url": R.Fill("$0")})
    got = sorted((r["page_id"], r["pos"], r["name"], r["url"]) for r in R.read_records(bodies, html, json, pattern).collect())
    assert got == [
        (1, 0, "three", "none two+three"), (1, 1, "", "n"), (2, 0, "x", "/1|/2"), (2, 1, "", ""), (2, 2, "", ""),
        (6, 0, "1/$2", "k=1"), (6, 1, "22/$2", "k=22"), (7, 0, "deep", "ndeep"), (7, 1, "deep", "ndeep")]
    assert R.read_records(bodies.limit(0), html, json, pattern).count() == 0


def test_pairing_keeps_few_pages_as_objects(monkeypatch):
    import pyarrow as pa

    from webtables.operators import _pairing as P

    pages = [["<ul", "<li", "t", "/ul"], None, [], ["<p", "t"] * 5, [".br", "/x", "", "!script"]] * 40
    want = [dict(zip(P.PAIR_FIELDS, P.pair_page(p), strict=True)) for p in pages]
    sizes = []
    for limit in (1, 20, 20_000):
        monkeypatch.setattr(P, "SLICE_TOKENS", limit)
        assert P.pair_marks(pa.array(pages, pa.list_(pa.string()))).to_pylist() == want
        sizes.append(max(b - a for a, b in P._slices([len(p or ()) for p in pages])))
    assert sizes[0] <= 2 and sizes[1] <= 9 and sizes[2] == 200
    assert len(P.pair_marks(pa.array([], pa.list_(pa.string())))) == 0


def test_pairing_hands_on_slices(monkeypatch):
    import pyarrow as pa

    from webtables.operators import _pairing as P

    monkeypatch.setattr(P, "SLICE_TOKENS", 20)
    pages = [["<ul", "<li", "t", "/ul"], None, [], ["<p", "t"] * 5] * 40
    asked = []

    def batches():
        for i in range(3):
            asked.append(i)
            yield pa.array(pages[:0] if i == 1 else pages, pa.list_(pa.string()))

    made = P.pair_batches(batches())
    first = next(made)
    assert asked == [0] and len(first) < 10  # the rest of the batch is not paired yet
    want = [dict(zip(P.PAIR_FIELDS, P.pair_page(p), strict=True)) for p in pages]
    assert first.to_pylist() + [page for piece in made for page in piece.to_pylist()] == want * 2


def test_members_of_a_row_as_their_text_gives_them(spark):
    rows = ['{"a":"x\\"y\\u00e9\\n","b":{"c":7}}', '{"a":1.50,"b":{"c":1e2}}', '{"a":true,"b":[{"c":1}]}', '{"a":null,"b":{"c":{"d":[1,"2"]}}}',
            '{"a":[1],"b":{}}', '{"a":123456789012345678901234567890}', '{"a":"","a b":3}', '[{"a":1}]', '5', '"s"', "{}"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string").select("i", F.parse_json("r").alias("item"))
    paths = ["$.a", "$.b.c", "$.b", "$.b[0].c", "$['a b']", "$.none"]
    text = df.select(*[F.get_json_object(F.to_json("item"), p).alias(f"w{n}") for n, p in enumerate(paths)],
                     *[E.variant_member(F.col("item"), p).alias(f"g{n}") for n, p in enumerate(paths)])
    for r in text.collect():
        assert [r[f"g{n}"] for n in range(len(paths))] == [r[f"w{n}"] for n in range(len(paths))]
    assert [r["g0"] for r in text.collect()][:3] == ['x"yé\n', "1.5", "true"]


def test_templates_keep_what_names_no_group(spark):
    df = spark.createDataFrame([(["all", "x", None],), (None,)], "g array<string>")
    want = {"$1$2-$3": ["x-$3", "-$3"], "$$1$": ["$x$", "$$"], "": ["", ""], "a\n$012": ["a\nx2", "a\n2"], "$0/$123/$9": ["all/$123/$9", "/$123/$9"]}
    for template, texts in want.items():
        assert [r["f"] for r in df.select(E.fill_groups(template, "g", 2).alias("f")).collect()] == texts


def test_leaves_and_bodies_are_read_once(spark):
    from webtables.operators import records as R

    bodies = spark.range(4).select(
        F.col("id").alias("page_id"), F.lit("http://h/").alias("url"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit('{"list":[{"deep":{"n":"'), F.repeat("id", 2), F.lit('"}}]}'))).otherwise(F.concat(F.lit("k="), F.repeat("id", 2))).alias("html"))
    json = R.Branch(R.JsonRows(("list",)), {"name": R.AnyOf((R.Json(("deep", "n")), R.Literal("-"))), "url": R.Fill("/{$.deep.n}")})
    pattern = R.Branch(R.PatternRows("k=(\\d+)", 1), {"name": R.Fill("$1!"), "url": R.Fill("/$1")})
    found = R.read_records(bodies, json=json, pattern=pattern)
    assert sorted((r["page_id"], r["name"], r["url"]) for r in found.collect()) == [(0, "00", "/00"), (1, "11!", "/11"), (2, "22", "/22"), (3, "33!", "/33")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.n, VariantType") == 1  # once for the field, however often its alternatives look at it
    assert plan.count("repeat(") == 4  # both forms of a body, once for each branch
    assert "try_cast" not in plan and plan.count("regexp_extract(") == 0  # templates are taken apart before
