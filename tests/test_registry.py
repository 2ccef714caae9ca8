"""Registry files, dialects, upsert, export and lint with literal rows."""

import json

from pyspark.sql import functions as F

from webtables.operators import lint as L
from webtables.sources import registry as S

FLAT = {
    "bookSourceName": "Old", "bookSourceUrl": "https://old.com", "enable": False, "serialNumber": 7, "httpUserAgent": "UA",
    "ruleSearchUrl": "https://old.com/s@k=searchKey@Header:{A:'b'}", "ruleSearchList": "class.l|tag.li#x",
    "ruleSearchName": "@js:a|b", "ruleChapterList": "-.c", "ruleBookContent": "$text", "ruleFindUrl": "a::/x?p=searchPage&&b::/y",
}
MODERN = {
    "bookSourceUrl": " https://new.com ", "bookSourceType": 2, "customOrder": 3, "searchUrl": "/s?q={{key}}",
    "ruleSearch": {"bookList": "$.l", "name": "$.n"}, "ruleToc": {"chapterList": "//a[last()]"},
}


def load(spark, tmp_path, name, value):
    (tmp_path / name).write_text(json.dumps(value), encoding="utf-8")
    return S.read_registry(spark, str(tmp_path / name))


def test_read_and_upgrade(spark, tmp_path):
    got = {r["source_url"]: r for r in load(spark, tmp_path, "a.json", [FLAT, MODERN, {"bookSourceName": "no url"}, "junk"]).collect()}
    assert set(got) == {"https://old.com", "https://new.com"}
    old, new = got["https://old.com"], got["https://new.com"]
    assert (old["enabled"], old["order"], old["type"], old["header"], old["was_flat"]) == (False, 7, 0, "User-Agent@UA", True)
    assert old["ruleSearch"]["bookList"] == "class.l||tag.li##x" and old["ruleSearch"]["name"] == "@js:a|b"
    assert old["ruleToc"]["chapterList"] == "-.c" and old["ruleContent"]["content"] == "text"
    assert old["search_url"].startswith("https://old.com/s,{") and '"method":"POST"' in old["search_url"]
    assert old["explore_url"] == "a::/x?p={{page}}\nb::/y"
    assert (new["name"], new["type"], new["order"], new["enabled"], new["was_flat"]) == ("https://new.com", 2, 3, True, False)
    single = load(spark, tmp_path, "b.json", MODERN)
    assert single.count() == 1


def test_rule_dialect(spark):
    cases = {"a|b#c|d": "a||b##c|d", "a||b": "a||b", "a&b": "a&&b", "/a&b": "/a&b", "x&http://y": "x&http://y", "-a|b": "-a||b",
             "+a#b": "+a##b", "@CSS:a|b": "@CSS:a|b", "//a|//b": "//a|//b", ":re(a|b)": ":re(a|b)", "x@js:a|b": "x@js:a|b", "  ": "",
             "a##b|c": "a##b|c", "$.a|$.b": "$.a||$.b"}
    df = spark.createDataFrame(list(cases.items()), "old string, want string")
    for r in df.select("old", "want", S.rewrite_rule("old").alias("got")).collect():
        assert r["got"] == r["want"], r["old"]


def test_url_dialect(spark):
    cases = {
        "/s?q=searchKey&p=searchPage": "/s?q={{key}}&p={{page}}",
        "/s?p={searchPage-1}": "/s?p={{page-1}}",
        "/s?q=searchKey|charset=gbk": '/s?q={{key}},{"charset":"gbk"}',
        "/s@q=searchKey": '/s,{"method":"POST","body":"q={{key}}"}',
        '/s@Header:{"A":"b"}': '/s,{"headers":{"A":"b"}}',
        "<js>=searchKey": "<js>={{key}}",
        "/s?{{searchPage*2}}": "/s?{{page*2}}",
    }
    df = spark.createDataFrame(list(cases.items()), "old string, want string")
    for r in df.select("old", "want", S.rewrite_url("old").alias("got")).collect():
        assert r["got"] == r["want"], r["old"]


def test_upsert(spark):
    schema = "source_url string, pos long, name string"
    cur = spark.createDataFrame([("a", 0, "A"), ("b", 1, "B")], schema)
    batch = spark.createDataFrame([("n", 0, "N1"), ("b", 1, "B2"), ("n", 2, "N2"), ("", 3, "x"), (None, 4, "y")], schema)
    reg, counts = S.upsert_registry(cur, batch)
    assert [tuple(r) for r in reg.orderBy("pos").collect()] == [("a", 0, "A"), ("b", 1, "B2"), ("n", 2, "N2")]
    assert counts.first().asDict() == {"added": 1, "updated": 2, "failed": 2}


def test_export_round_trip(spark, tmp_path):
    reg = load(spark, tmp_path, "a.json", [FLAT, MODERN])
    S.export_registry(reg, str(tmp_path / "out"))
    back = S.read_registry_lines(spark, str(tmp_path / "out"))
    keep = [c for c in reg.columns if c not in ("was_flat", "ruleExplore")]
    key = lambda df: sorted(df.select(*keep).collect())
    assert key(back) == key(reg)
    line = json.loads(spark.read.text(str(tmp_path / "out")).filter(F.contains("value", F.lit("new.com"))).first()["value"])
    assert line["ruleSearch"] == {"bookList": "$.l", "name": "$.n"} and "ruleExplore" not in line and "header" not in line


def test_rules_long_and_lint(spark, tmp_path):
    reg = load(spark, tmp_path, "a.json", [FLAT, MODERN])
    lint = L.lint_rules(S.rules_long(reg)).cache()
    new = {(r["grp"], r["field"]): r["reason"] for r in lint.filter("source_url = 'https://new.com'").collect()}
    assert new == {("ruleSearch", "bookList"): None, ("ruleSearch", "name"): None, ("ruleToc", "chapterList"): "XPath function",
                   ("url", "searchUrl"): None}
    verdicts = {r["source_url"]: (r["rules"], r["unsupported"], r["verdict"]) for r in L.site_verdicts(lint, reg).collect()}
    assert verdicts["https://new.com"] == (4, 1, "PARTIAL") and verdicts["https://old.com"][2] == "COMPATIBLE"


def test_reasons(spark):
    cases = {
        "@js:java.webView()": "script needs a web view", "<js>cache.get('a')": "script cache object not provided",
        "@js:java.getCookie()": "script login or cookie access not provided", "@js:queryTTF": "script font decoding not provided",
        "//a/ancestor::p": "XPath axis", "//a[position()=1]": "XPath function", "//a|//b": "XPath union",
        "$.a[?(@.b)]": "JSONPath filter", "$.a.length()": "JSONPath function", ".a:eq(1)": "CSS index pseudo-class",
        "class.a:contains(x)": "CSS contains", "#a:not(b)": "CSS not", "class.a@text": None, "//a##b|c": None,
        '/s,{"webView":true}': "request needs a web view",
    }
    df = spark.createDataFrame(list(cases.items()), "rule string, want string")
    for r in df.select("rule", "want", L.unsupported_reason("rule").alias("got")).collect():
        assert r["got"] == r["want"], r["rule"]


def test_eligibility(spark):
    rows = [("a", True, 0, "/s", "l"), ("b", False, 0, "/s", "l"), ("c", True, 1, "/s", "l"), ("d", True, 0, "", "l"), ("e", True, 0, "/s", None)]
    kept, reasons = S.eligible(spark.createDataFrame(rows, "source_url string, enabled boolean, type int, search_url string, list_rule string"))
    assert [r["source_url"] for r in kept.collect()] == ["a"]
    assert {r["reason"]: r["sites"] for r in reasons.collect()} == {"kept": 1, "disabled": 1, "not text": 1, "no search rules": 2}
