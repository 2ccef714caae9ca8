"""Page walks against a plain queue, bodies with errors."""

import random

from webtables.operators.walk import assemble_bodies, walk_pages


def plain_walk(start, links, limit):
    seen, pending, cur = [], [], start
    while cur is not None and len(seen) < limit:
        seen.append(cur)
        fresh = []
        for n in links.get(cur, []):
            if n != cur and n not in seen and n not in pending and n not in fresh:
                fresh.append(n)
        queue = fresh[:1] + pending + fresh[1:]
        cur, pending = (queue[0], queue[1:]) if queue else (None, [])
    return seen


def test_walk_matches_queue(spark):
    rng = random.Random(3)
    links = {p: [rng.randrange(40) for _ in range(rng.randrange(4))] for p in range(40)}
    rows = [(p, n, i) for p, ns in links.items() for i, n in enumerate(ns)]
    table = spark.createDataFrame(rows, "page_id long, next_page_id long, pos int")
    starts = spark.createDataFrame([(p,) for p in range(40)], "page_id long")
    for limit in (5, 20, None):
        got, cut = {}, {}
        for r in walk_pages(starts, table, limit).orderBy("root", "visit").collect():
            got.setdefault(r["root"], []).append(r["page_id"])
            cut[r["root"]] = r["truncated"]
        assert got == {p: plain_walk(p, links, limit or 1000) for p in range(40)}
        assert cut == {p: len(plain_walk(p, links, 1000)) > (limit or 1000) for p in range(40)}


def test_long_bodies(spark):
    chain = spark.range(12).selectExpr("id AS page_id", "id + 1 AS next_page_id", "0 AS pos")
    bodies = spark.range(13).selectExpr("id AS page_id", "concat('p', id) AS content", "CAST(NULL AS STRING) AS error")
    starts = spark.range(1).withColumnRenamed("id", "page_id")
    row = assemble_bodies(starts, chain, bodies).first()
    assert (row["pages"], row["truncated"], row["content"].split()) == (13, False, [f"p{i}" for i in range(13)])
    cut = assemble_bodies(starts, chain, bodies, 8).first()
    assert (cut["pages"], cut["truncated"]) == (8, True)


def test_bodies(spark):
    bodies = spark.createDataFrame(
        [(1, "<p>a</p>", None), (2, "b<br>c", None), (3, None, "HTTP 404"), (10, "", None), (20, None, "timeout")],
        "page_id long, content string, error string")
    links = spark.createDataFrame([(1, 2, 0), (2, 3, 0), (3, 4, 0)], "page_id long, next_page_id long, pos int")
    starts = spark.createDataFrame([(1,), (10,), (20,)], "page_id long")
    got = {r["root"]: (r["content"], r["error"]) for r in assemble_bodies(starts, links, bodies).collect()}
    assert got == {1: ("a\nb\nc", None), 10: ("", "empty body"), 20: ("", "timeout")}


def test_chains_circles_and_forks(spark):
    links = [(i, i + 1, 0) for i in range(1, 1184)] + [(2000, 2001, 0), (2001, 2002, 0), (2002, 2001, 0), (3000, 3001, 1), (3001, 3002, 0), (3001, 3003, 1), (3002, 3003, 0), (3003, 3000, 0)]
    table = spark.createDataFrame(links, "page_id long, next_page_id long, pos int")
    starts = spark.createDataFrame([(1,), (1100,), (2000,), (3000,), (9,), (9,), (7777,)], "page_id long")
    by_page = {}
    for p, n, _ in links:
        by_page.setdefault(p, []).append(n)
    for limit in (3, 200, None):
        got, cut = {}, {}
        for r in walk_pages(starts, table, limit).orderBy("root", "visit").collect():
            got.setdefault(r["root"], []).append(r["page_id"])
            cut[r["root"]] = r["truncated"]
        assert got == {p: plain_walk(p, by_page, limit or 5000) for p in (1, 1100, 2000, 3000, 9, 7777)}
        assert cut == {p: len(plain_walk(p, by_page, 5000)) > (limit or 5000) for p in got}
