"""Joins around the registry: request frontier, lookups, positions, fall-back, latest positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.functions.urls import abs_url, collapse_doubled_host, expand_template, host_of
from webtables.operators.scan import top_k


def request_frontier(
    sites: DataFrame, keywords: Sequence[str], pages: int = 1, url: str = "source_url", template: str = "search_url"
) -> DataFrame:
    """One request per site, keyword and page. The keywords are a parameter, so this is a plain expansion."""
    words = F.explode(F.array(*[F.lit(k) for k in keywords])).alias("keyword")
    spread = sites.select("*", words).select("*", F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page"))
    request = collapse_doubled_host(abs_url(url, expand_template(template, "keyword", "page")))
    return spread.withColumn("request_url", request)


def join_registry(hits: DataFrame, registry: DataFrame, source: str = "source_url") -> DataFrame:
    """Hits of registered sites with the registry columns; others drop out."""
    return hits.join(registry, source)


def usable(registry: DataFrame, hosts: DataFrame, url: str = "source_url", host: str = "host") -> DataFrame:
    """Registry rows whose host is reachable."""
    known = hosts.select(host_of(host).alias("_h")).distinct()
    return registry.withColumn("_h", host_of(url)).join(known, "_h", "left_semi").drop("_h")


def reachable_hosts(registry: DataFrame, hosts: DataFrame, url: str = "source_url", host: str = "host") -> DataFrame:
    """Hosts both registered and reachable."""
    return registry.select(host_of(url).alias("host")).intersect(hosts.select(host_of(host).alias("host")))


def position_of(index: Column, here: Column, there: Column) -> Column:
    """The chapter at the same share of another table of contents."""
    at = F.floor((index + 0.5) / here * there)
    return F.greatest(F.least(at, there - 1), F.lit(0)).cast("int")


def map_position(
    progress: DataFrame, toc_a: DataFrame, toc_b: DataFrame, key: Sequence[str], index: str = "chapter_index"
) -> DataFrame:
    """Carry a reading position from one table of contents to another; ``mapped`` joins to ``toc_b``."""
    a = toc_a.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    b = toc_b.groupBy(*key).agg(F.count(F.lit(1)).alias("_m"))
    joined = progress.join(a, [*key]).join(b, [*key])
    placed = joined.withColumn("mapped", position_of(F.col(index), F.col("_n"), F.col("_m"))).drop("_n", "_m")
    target = toc_b.withColumnRenamed("idx", "mapped")
    return placed.join(target, [*key, "mapped"], "left")


def fallback_body(tried: DataFrame, toc: DataFrame, bodies: DataFrame) -> DataFrame:
    """First of the tried offers that has a table of contents and a body at the mapped position.

    ``tried`` as :func:`webtables.operators.merge.fallback_offers` gives it, ``toc(source_url, book_url, n_chapters)``,
    ``bodies(source_url, book_url, idx, content)``. Only the tried offers, a few per work, meet contents and bodies.
    """
    listed = tried.join(toc.withColumnRenamed("n_chapters", "_m"), ["source_url", "book_url"]).filter("_m > 0")
    placed = listed.withColumn("idx", position_of(F.col("chapter_index"), F.col("n_chapters"), F.col("_m")))
    found = placed.join(bodies.filter("content <> ''"), ["source_url", "book_url", "idx"])
    best = found.groupBy("key", "chapter_index").agg(
        F.min_by(F.struct("source_url", "book_url", "idx", "try", "content"), F.col("try")).alias("o")
    )
    return best.select("key", "chapter_index", "o.*")


def recent_items(
    progress: DataFrame, k: int = 200, user: str = "user_id", item: Sequence[str] = ("source_url", "book_url"),
    updated: str = "updated_at", shelf: str | None = None,
) -> DataFrame:
    """Latest entry of each (user, item), the ``k`` newest per user; ``shelf`` keeps flagged entries only."""
    others = [c for c in progress.columns if c not in (user, *item)]
    latest = progress.groupBy(user, *item).agg(F.max_by(F.struct(*others), F.struct(updated, *others)).alias("o"))
    flat = latest.select(user, *item, "o.*")
    kept = top_k(flat, [user], [F.col(updated).desc(), *[F.col(c) for c in item]], k, list(item), name="place")
    return kept.filter(F.col(shelf)) if shelf else kept
