"""Walks over next-page links and assembly of multi-page bodies."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtables.functions.text import clean_text
from webtables.session import cut_lineage, settle


def follow_chains(starts: DataFrame, nexts: DataFrame, max_pages: int | None = None) -> DataFrame:
    """root, visit, page_id of walks along single links, until a page has no next one or was visited.

    ``starts(root, page_id)``; ``nexts(page_id, next_page_id)`` with one row per page. Pointer doubling: round k knows the page
    2^k links further on from every page, and every walk of 2^k pages doubles by one join. A chain of n pages takes
    log2 n rounds; a walk that ends or closes a circle leaves the rounds. With ``max_pages`` walks may be longer by
    then, but the rounds end once it is passed.
    """
    jump = settle(nexts.select(F.col("page_id").alias("at"), F.col("next_page_id").alias("to")))
    going = settle(starts.select("root", F.lit(0).cast("long").alias("visit"), "page_id"))
    done, reach = [], 1
    while True:
        further = going.join(jump, going["page_id"] == jump["at"]).select("root", (F.col("visit") + reach).alias("visit"), F.col("to").alias("page_id"))
        # in a circle pages come again: the first visit counts, and visits still have no gap
        grown = settle(going.unionByName(further).groupBy("root", "page_id").agg(F.min("visit").alias("visit")).select("root", "visit", "page_id"))
        reach *= 2
        open_walks = settle(grown.filter(F.col("visit") == reach - 1).select(F.col("root").alias("r")))
        if (max_pages is not None and reach > max_pages) or open_walks.isEmpty():
            done.append(grown)
            break
        done.append(grown.join(open_walks, grown["root"] == open_walks["r"], "left_anti"))
        going = grown.join(open_walks, grown["root"] == open_walks["r"], "left_semi")
        after = jump.select(F.col("at").alias("mid"), F.col("to").alias("end"))
        jump = settle(jump.join(after, jump["to"] == after["mid"]).select("at", F.col("end").alias("to")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def walk_pages(
    starts: DataFrame, links: DataFrame, max_pages: int | None = None, rounds_per_checkpoint: int = 10
) -> DataFrame:
    """Pages reached from each start in visit order: ``(root, visit, page_id, truncated)``.

    ``starts(page_id)``; ``links(page_id, next_page_id, pos)``. The first new link is followed next, the
    others wait in order; no page is visited twice. Every walk goes on until no page is left, unless ``max_pages``
    is given: then ``truncated`` tells the walks that had pages left.

    As far as pages have one next link walks take log2 rounds (``follow_chains``). Walks that come to a page with several go on
    from there page by page: each round is one equi-join of the open walks with the links, one row per page.
    """
    listed = F.array_sort(F.collect_list(F.struct("pos", F.col("next_page_id").alias("n"))))
    nexts = settle(
        links.filter("next_page_id is not null and next_page_id <> page_id")
        .groupBy("page_id")
        .agg(F.array_distinct(F.transform(listed, lambda x: x["n"])).alias("nexts"))
        .withColumnRenamed("page_id", "cur")
    )
    single = nexts.filter(F.size("nexts") == 1).select(F.col("cur").alias("page_id"), F.col("nexts")[0].alias("next_page_id"))
    heads = starts.select("page_id").distinct()
    chains = settle(follow_chains(heads.select(F.col("page_id").alias("root"), "page_id"), single, max_pages))
    ends = chains.groupBy(F.col("root").alias("r")).agg(F.max_by("page_id", "visit").alias("last"), (F.max("visit") + 1).alias("pages"))
    forks = nexts.filter(F.size("nexts") > 1).select(F.col("cur").alias("fork"))
    split = settle(ends.join(forks, ends["last"] == forks["fork"], "left_semi").filter(F.lit(True) if max_pages is None else F.col("pages") <= max_pages))
    cut = F.lit(False) if max_pages is None else F.col("pages") > max_pages
    plain = chains.join(ends.select("r", cut.alias("truncated")), chains["root"] == F.col("r")).drop("r")
    if max_pages is not None:
        plain = plain.filter(F.col("visit") < max_pages)
    if split.isEmpty():
        return plain.select("root", "visit", "page_id", "truncated")
    plain = plain.join(split.select("r"), plain["root"] == F.col("r"), "left_anti")
    before = chains.join(split.select("r"), chains["root"] == F.col("r")).groupBy("root").agg(
        F.max_by("page_id", "visit").alias("cur"), F.transform(F.array_sort(F.collect_list(F.struct("visit", "page_id"))), lambda x: x["page_id"]).alias("seen"))
    branching = _walk_on(before, nexts, starts.schema["page_id"].dataType.simpleString(), max_pages, rounds_per_checkpoint)
    return plain.select("root", "visit", "page_id", "truncated").unionByName(branching.select("root", F.col("visit").cast("long").alias("visit"), "page_id", "truncated"))


def _walk_on(before: DataFrame, nexts: DataFrame, kind: str, max_pages: int | None, rounds_per_checkpoint: int) -> DataFrame:
    """Walks (root, cur, seen) that go on from a page with several next links, a page a round."""
    none = F.expr(f"cast(array() as array<{kind}>)")
    state = before.select("root", "cur", "seen", none.alias("pending"), F.lit(True).alias("open"))
    closed = None
    for turn in count(1):
        fresh = F.filter(F.coalesce("nexts", none), lambda n: ~F.array_contains("seen", n) & ~F.array_contains("pending", n))
        queue = F.when(
            F.size(fresh) > 0, F.concat(F.slice(fresh, 1, 1), "pending", F.slice(fresh, 2, 2147483647))
        ).otherwise(F.col("pending"))
        # a walk at its last allowed page only tells whether it had a page left
        last = F.lit(False) if max_pages is None else F.size("seen") >= max_pages
        stepped = state.join(nexts, "cur", "left").withColumn("queue", queue).withColumn("last", last)
        following = F.try_element_at("queue", F.lit(1))
        goes = following.isNotNull() & ~F.col("last")
        state = stepped.select(
            # a finished walk keeps its last page, whose links are all seen: no null keys, no skew
            "root", F.when(goes, following).otherwise(F.col("cur")).alias("cur"),
            F.when(goes, F.concat("seen", F.array(following))).otherwise(F.col("seen")).alias("seen"),
            F.when(goes, F.slice("queue", 2, 2147483647)).otherwise(F.col("pending")).alias("pending"),
            goes.alias("open"), (following.isNotNull() & F.col("last")).alias("truncated"),
        )
        if turn % rounds_per_checkpoint == 0:
            state = cut_lineage(state)
            done = state.filter("not open")
            closed = done if closed is None else closed.unionByName(done)
            state = state.filter("open")
            if state.isEmpty():
                break
    return closed.select("root", "truncated", F.posexplode("seen").alias("visit", "page_id")).select("root", "visit", "page_id", "truncated")


def assemble_bodies(
    starts: DataFrame, links: DataFrame, bodies: DataFrame, max_pages: int | None = None, empty: str = "empty body"
) -> DataFrame:
    """Text of the pages of each walk joined in order and cleaned; ``error`` tells why it is empty.

    ``bodies(page_id, content, error)``: a page with an error ends its walk there. ``truncated``: the walk was cut
    by ``max_pages``.
    """
    walked = walk_pages(starts, links, max_pages)
    pages = walked.join(bodies, "page_id", "left").select(
        "root", "visit", "truncated", F.coalesce("content", F.lit("")).alias("content"),
        F.when(F.col("content").isNull() & F.col("error").isNull(), F.lit("not fetched")).otherwise(F.col("error"))
        .alias("error"),
    )
    listed = pages.groupBy("root").agg(
        F.array_sort(F.collect_list(F.struct("visit", "content", "error"))).alias("p"),
        F.min(F.when(F.col("error").isNotNull(), F.col("visit"))).alias("stop"), F.first("truncated").alias("truncated"),
    )
    kept = F.filter("p", lambda x: F.col("stop").isNull() | (x["visit"] < F.col("stop")))
    pieces = F.filter(F.transform(kept, lambda x: x["content"]), lambda c: c != "")
    content = clean_text(F.array_join(pieces, "\n"))
    reason = F.element_at(F.transform(F.filter("p", lambda x: x["error"].isNotNull()), lambda x: x["error"]), 1)
    reason = F.when(F.col("stop").isNotNull(), reason).otherwise(F.lit(empty))
    return listed.select(
        "root", F.size(kept).alias("pages"), content.alias("content"),
        F.when(content == "", reason).alias("error"), "truncated",
    )
