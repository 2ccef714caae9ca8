"""Literal cases of the column functions."""

from pyspark.sql import functions as F

from webtables.functions import text as T
from webtables.functions import urls as U


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("o")).first()["o"]


def test_entities(spark):
    text = "&lt;b&gt; &amp;amp; &#20013;&#x4e2d; &NBSP;| &bogus; & &; &#0; &#x110000; a&hellip;"
    assert one(spark, T.decode_entities("v"), text) == "<b> &amp; 中中 \u00a0| &bogus; & &; &#0; &#x110000; a…"
    assert one(spark, T.decode_entities("v"), "plain") == "plain"


def test_clean_text(spark):
    for text in ("<p>a</p><p>b</p>", "a<br>b", "\u3000\u3000a\r\n\u00a0 b \n\n", "<div class=x>a<!-- <p>no</p>\n --></div>b<i>"):
        assert one(spark, T.clean_text("v"), text) == "a\nb"
    assert one(spark, T.clean_text("v"), "<pre>a</pre><brx>b") == "ab"


def test_whitespace(spark):
    assert one(spark, T.collapse_ws("v"), " a \t\n\u00a0b ") == "a b"
    assert one(spark, T.tidy("v"), "\n a\u3000 b\n\n\n\nc\nd\r\n") == "a b\n\nc\nd"
    assert one(spark, T.normalize_newlines("v"), "\ufeffa\r\nb\rc\n") == "a\nb\nc\n"


def test_paragraphs(spark):
    page = lambda body, title, book=None: one(
        spark, T.format_paragraphs(F.lit(body), F.lit(title), None if book is None else F.lit(book)))
    assert page("第1章 x\n\n a \n\u3000b", "第1章 x") == "第1章 x\n\u3000\u3000a\n\u3000\u3000b"
    assert page("《Book》第1章 a", "第1章", "Book") == "第1章\n\u3000\u3000a"
    assert page("引子里的秘密", "引子") == "引子\n\u3000\u3000引子里的秘密"
    assert page("a.b a*b (x)\nz", "a*b (x)", "a.b") == "a*b (x)\n\u3000\u3000z"
    assert page("\\E x\ny", "\\E") == "\\E\n\u3000\u3000x\n\u3000\u3000y"
    assert page("a\n\nb", "") == "\u3000\u3000a\n\u3000\u3000b"


def test_file_names(spark):
    def named(v):
        return tuple(one(spark, T.split_title_author("v"), v))

    assert named("《T》-Ann.txt") == ("T", "Ann")
    assert named("My_Book（完）[x] — 作者：Bo(1).txt") == ("My Book（完）[x] — 作者：Bo", "")  # digits in the tail
    assert named("My_Book（完）[x] — 作者：Bo(a).txt") == ("My Book", "Bo")
    assert named("A-B-a very long tail here.txt") == ("A-B-a very long tail here", "")
    assert named("(x).txt") == ("(x)", "")


def test_absolute_urls(spark):
    cases = {"//k/1": "https://k/1", "/1": "https://h/1", "1": "https://h/x/1", "\n u1 \nu2": "https://h/x/u1", "": "",
             "http://z": "http://z"}
    for value, want in cases.items():
        assert one(spark, U.abs_url(F.lit("https://h/x/"), "v"), value) == want


def test_hosts(spark):
    for value, want in {"HTTPS://A.b:80/x": "a.b", "\ufeffa.B/x": "a.b", "//c.d/": "c.d", " http://e": "e", "": ""}.items():
        assert one(spark, U.host_of("v"), value) == want
    for value, want in {"www.a.com": "a.com", "a.com": "a.com", "x.y.a.com": "y.a.com", "a": "a"}.items():
        assert one(spark, U.site_of("v"), value) == want
    fix = lambda v: one(spark, U.collapse_doubled_host("v"), v)
    assert fix("https://www.a.com/m.a.com/s?x") == "https://www.a.com/s?x"
    assert fix("https://www.a.com/a.com") == "https://www.a.com/"
    assert fix("https://www.a.com/b.com/s") == "https://www.a.com/b.com/s"
    assert fix("https://www.a.com/www.A.com") == "https://www.a.com/"


def test_templates(spark):
    fill = lambda v: one(spark, U.expand_template("v", F.lit("a b中"), F.lit(2)), v)
    assert fill("?p={{page+1}}&k={{key}}&{x}&{{ page - 1 }}{{other}}") == "?p=3&k=a+b%E4%B8%AD&{x}&1"
    assert fill("{{key") == "{{key"


def test_options(spark):
    split = lambda v: one(spark, U.split_options("v"), v)
    got = split('http://h/s?a={1},2,{"method":"post","body":"k={{key}},x","charset":"gbk","headers":{"A":"b"}}')
    assert (got["url"], got["method"], got["body"], got["charset"]) == ("http://h/s?a={1},2", "POST", "k={{key}},x", "gbk")
    assert got["headers"] == {"A": "b"} and got["tail"].startswith(',{"method"')
    plain = split("http://h/a,b,{c")
    assert (plain["url"], plain["tail"], plain["method"], plain["headers"]) == ("http://h/a,b,{c", "", "GET", {})
    assert split('u,{"headers":"A@1\\nB@2","webView":true}')["headers"] == {"A": "1", "B": "2"}


def test_trailing_id(spark):
    for value, want in {"http://h/12/": "12", "http://h/b/a34x5.html?x": "34", "http://h/x": "", "http://h/9?page=2": "9"}.items():
        assert one(spark, U.trailing_id("v"), value) == want


def test_titles(spark):
    assert one(spark, T.title_key("v"), "《Red》 Hat-２ ①中") == "redhat２中"
    assert one(spark, T.title_matches("v", F.lit("RED hat")), "red-hat!") is True
    assert one(spark, T.title_matches("v", F.lit("!")), "?") is False
    assert one(spark, T.replace_tail("v", "a.b", ""), "xa\nby") == "xy"
    assert one(spark, T.replace_tail("v", "([", ""), "x") == "x"
