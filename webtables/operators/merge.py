"""Merge the same work reported by many sites; order works and offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webtables.functions.text import title_key
from webtables.operators.scan import ordinal, time_bucket
from webtables.session import settle


def _valid_hits(hits: DataFrame, name: str, url: str) -> DataFrame:
    """Hits with a name, a url and a usable title key (a ``key`` column computed earlier is kept)."""
    usable = (F.coalesce(F.col(name), F.lit("")) != "") & (F.coalesce(F.col(url), F.lit("")) != "")
    keyed = hits if "key" in hits.columns else hits.withColumn("key", title_key(name))
    return keyed.filter(usable).filter("key <> ''")


def merge_hits(
    hits: DataFrame, arrival: str = "arrival", name: str = "name", url: str = "book_url", by: tuple[str, ...] = ()
) -> DataFrame:
    """One row per work: key, name of the first arrival, number of offers, first arrival.

    Counts and first arrivals per spelling come first: they fit hash aggregation with map-side combine, so
    a work with a third of all hits shrinks to its spellings before the shuffle. Equal arrivals: the
    smaller name. The members stay in rows, see :func:`offers`.
    """
    spellings = _valid_hits(hits, name, url).groupBy(*by, "key", F.col(name).alias("_name")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(arrival).alias("_at")
    )
    return spellings.groupBy(*by, "key").agg(
        F.min_by("_name", F.struct("_at", "_name")).alias("name"),
        F.sum("_n").alias("offers"),
        F.min("_at").alias("first_arrival"),
    )


def offers(
    hits: DataFrame, arrival: str = "arrival", tie: tuple[str, ...] = (), name: str = "name", url: str = "book_url",
    seconds: int = 86400,
) -> DataFrame:
    """The ordered members of every work, one row each with its 1-based position by arrival."""
    staged = _valid_hits(hits, name, url).withColumn("_b", time_bucket(arrival, seconds))
    return ordinal(staged, ["key"], ["_b"], [arrival, *tie], "member").drop("_b")


def search_summary(attempts: DataFrame, hits: DataFrame, run: str = "run_id", site: str = "source_url") -> DataFrame:
    """Per run: sites, each counted exactly once as done, without result, timed out or skipped; hits; works.

    ``attempts(run_id, source_url, outcome)`` with outcome done / empty / timed out / skipped. A site seen
    several times counts with its best outcome.
    """
    rank = F.when(F.col("outcome") == "done", 0).when(F.col("outcome") == "empty", 1).when(
        F.col("outcome") == "timed out", 2).otherwise(3)
    best = attempts.groupBy(run, site).agg(F.min(rank).alias("best"))
    sites = best.groupBy(run).agg(
        F.count(F.lit(1)).alias("sites"),
        F.count_if(F.col("best") == 0).alias("done"),
        F.count_if(F.col("best") == 1).alias("no_result"),
        F.count_if(F.col("best") == 2).alias("timed_out"),
        F.count_if(F.col("best") == 3).alias("skipped"),
    )
    keyed = hits if "key" in hits.columns else hits.withColumn("key", title_key("name"))
    works = keyed.groupBy(run, "key").agg(F.count(F.lit(1)).alias("n"))
    found = works.groupBy(run).agg(
        F.sum("n").alias("hits"), F.count_if(F.col("key") != "").alias("works")
    )
    return sites.join(found, run, "left").fillna(0, ["hits", "works"])


def best_rank(members: DataFrame, ranks: DataFrame, source: str = "source_url") -> DataFrame:
    """Smallest reading class over the offers of a work."""
    pairs = members.groupBy("key", source).agg(F.lit(1).alias("_one"))
    joined = pairs.join(ranks.select(source, "reading_rank"), source, "left")
    return joined.groupBy("key").agg(F.least(F.min(F.coalesce("reading_rank", F.lit(2))), F.lit(99)).alias("best_rank"))


def _ranked(members: DataFrame, ranks: DataFrame, current: DataFrame | None, source: str) -> DataFrame:
    out = members.join(ranks.select(source, "reading_rank"), source, "left")
    out = out.withColumn("reading_rank", F.coalesce("reading_rank", F.lit(2)))
    if current is None:
        return out.withColumn("other", F.lit(1))
    chosen = current.select("key", F.col(source).alias("_cur"))
    out = out.join(chosen, "key", "left")
    is_current = F.coalesce(F.col("_cur") == F.col(source), F.lit(False))
    return out.withColumn("other", F.when(is_current, 0).otherwise(1)).drop("_cur")


def rank_offers(
    members: DataFrame, ranks: DataFrame, current: DataFrame | None = None, source: str = "source_url",
    arrival: str = "arrival", tie: tuple[str, ...] = (), seconds: int = 86400,
) -> DataFrame:
    """Position of each offer inside its work: reading class, current site first, arrival."""
    staged = _ranked(members, ranks, current, source).withColumn("_b", time_bucket(arrival, seconds))
    placed = ordinal(staged, ["key"], ["reading_rank", "other", "_b"], [arrival, *tie], "place")
    return placed.drop("_b", "other")


def best_offers(
    members: DataFrame, ranks: DataFrame, source: str = "source_url", url: str = "book_url", arrival: str = "arrival", tie: tuple[str, ...] = (),
) -> DataFrame:
    """Each (key, site, url) once, with its reading class and ``order``: class, first arrival, tie.

    The first arrival is a minimum with map-side combine, so a title with a third of all offers is down to its
    sites and urls before anything is joined.
    """
    own = [t for t in tie if t not in (source, url)]  # the others are the same in a whole group
    first = members.groupBy("key", source, url).agg(F.min(F.struct(arrival, *own)).alias("_first"))
    ranked = _classed(first, ranks, source)
    placed = F.struct("reading_rank", F.struct(*[F.col(t) if t in (source, url) else F.col("_first")[t] for t in (arrival, *tie)]))
    return ranked.select("key", source, url, "reading_rank", placed.alias("order"))


def _classed(members: DataFrame, ranks: DataFrame, source: str) -> DataFrame:
    return members.join(ranks.select(source, "reading_rank"), source, "left").withColumn("reading_rank", F.coalesce("reading_rank", F.lit(2)))


def _ordered(members: DataFrame, ranks: DataFrame, source: str, arrival: str, tie: tuple[str, ...]) -> DataFrame:
    """Offers with their class and the ``order`` of :func:`best_offers`, each as often as it arrived: a minimum needs no distinct offers."""
    return _classed(members, ranks, source).withColumn("order", F.struct("reading_rank", F.struct(arrival, *tie)))


def short_lists(offers: DataFrame, k: int, source: str = "source_url", url: str = "book_url") -> DataFrame:
    """Of each work enough of :func:`best_offers` for the first ``k`` that avoid any one site and any one url: 3k + 2 at most.

    Of one site, and then of one url, k + 1 are enough: the excluded url, or site, is that of at most one of them. What is
    left has at most k + 1 offers on either excluded side, so 3k + 2 of them hold k others. Each limit is a rank below a
    constant, which Spark applies inside every task before the shuffle, so no task sees all offers of a title.
    """
    for by, most in ((("key", source), k + 1), (("key", url), k + 1), (("key",), 3 * k + 2)):
        at = F.row_number().over(Window.partitionBy(*by).orderBy("order"))
        offers = offers.withColumn("_at", at).filter(F.col("_at") <= most).drop("_at")
    return offers


def _avoiding(short: DataFrame, failed: DataFrame, source: str, url: str, *columns: str) -> DataFrame:
    """The offers of the short lists beside the failed site and url of their work."""
    gone = failed.select("key", F.col(source).alias("_fs"), F.col(url).alias("_fu"), *columns)
    return short.join(gone, "key").filter((F.col(source) != F.col("_fs")) & (F.col(url) != F.col("_fu"))).drop("_fs", "_fu")


def primary_offer(
    members: DataFrame, ranks: DataFrame, current: DataFrame | None = None, source: str = "source_url",
    arrival: str = "arrival", tie: tuple[str, ...] = (), url: str = "book_url",
) -> DataFrame:
    """The first offer of each work by the order of :func:`rank_offers`.

    That is the best offer of all, or the best of the current site where its class is as good. ``current`` is joined by
    work and site, never by the work alone.
    """
    offers = _ordered(members, ranks, source, arrival, tie)
    values = F.struct(source, url, "reading_rank")
    best = offers.groupBy("key").agg(F.min_by(values, "order").alias("o"))
    if current is None:
        return best.select("key", "o.*")
    own = offers.join(current.select("key", source), ["key", source]).groupBy(F.col("key").alias("_k")).agg(F.min_by(values, "order").alias("c"))
    joined = best.join(own, F.col("key") == F.col("_k"), "left")
    return joined.select("key", F.when(F.col("c.reading_rank") == F.col("o.reading_rank"), F.col("c")).otherwise(F.col("o")).alias("p")).select("key", "p.*")


def rank_results(groups: DataFrame, best: DataFrame, keyword: str) -> DataFrame:
    """Works in result order: exact title first, then best class, more offers first, name."""
    joined = groups.join(best, "key", "left").withColumn("best_rank", F.coalesce("best_rank", F.lit(99)))
    wanted = title_key(F.lit(keyword))
    joined = joined.withColumn("exact", (F.col("key") == wanted) & (wanted != ""))
    joined = joined.withColumn("_not", (~F.col("exact")).cast("int"))
    # buckets keep the order and split the numbering: most works share a class and a size, so the name helps
    joined = joined.withColumn("_size", -F.col("offers")).withColumn("_head", F.substring("name", 1, 3))
    placed = ordinal(joined, [], ["_not", "best_rank", "_size", "_head"], ["name", "key"])
    return placed.select("pos", "key", "name", "exact", "best_rank", "offers")


def top_results(
    groups: DataFrame, best: DataFrame, members: DataFrame, ranks: DataFrame, keyword: str, k: int = 6, current: DataFrame | None = None, **offer,
) -> DataFrame:
    """The first ``k`` works with their primary offer, which is looked for among the offers of these works only (``offer``: see :func:`primary_offer`)."""
    joined = groups.join(best, "key", "left")
    exact = F.col("key") == title_key(F.lit(keyword))
    head = settle(joined.withColumn("exact", exact).orderBy(
        F.col("exact").desc(), F.coalesce("best_rank", F.lit(99)), F.col("offers").desc(), "name", "key"
    ).limit(k))
    few = members.join(head.select("key"), "key", "left_semi")
    return head.join(primary_offer(few, ranks, current, **offer).drop("reading_rank"), "key", "left")


def next_alternative(
    members: DataFrame, ranks: DataFrame, failed: DataFrame, registry: DataFrame, source: str = "source_url",
    url: str = "book_url", arrival: str = "arrival", tie: tuple[str, ...] = (),
) -> DataFrame:
    """The next offer to try for each failed work: not the failed site or url, still registered.

    ``failed(key, source_url, book_url)``. Class 4 comes last, whatever its order otherwise. The first of the offers that are left is
    a minimum per work with map-side combine: no offer is shuffled where sites and failures are small enough to be broadcast.
    """
    known = members.join(registry.select(source).distinct(), source, "left_semi")
    left = _avoiding(_ordered(known, ranks, source, arrival, tie), failed, source, url)
    picked = left.groupBy("key").agg(F.min_by(F.struct(source, url, "reading_rank"), "order").alias("o"))
    return picked.select("key", "o.*")


def fallback_offers(
    members: DataFrame, ranks: DataFrame, failed: DataFrame, registry: DataFrame, tries: int = 3, source: str = "source_url",
    url: str = "book_url", arrival: str = "arrival", tie: tuple[str, ...] = (),
) -> DataFrame:
    """The first ``tries`` registered offers of each failed work beside the failed site and url, with ``try`` from 1.

    ``failed(key, source_url, book_url, chapter_index, n_chapters)``; the last two go with the offers.
    """
    known = members.join(registry.select(source).distinct(), source, "left_semi")
    short = short_lists(best_offers(known, ranks, source, url, arrival, tie), tries, source, url)
    left = _avoiding(short, failed, source, url, "chapter_index", "n_chapters")
    place = F.row_number().over(Window.partitionBy("key", "chapter_index").orderBy("order"))
    return left.withColumn("try", place).filter(F.col("try") <= tries).drop("order")
