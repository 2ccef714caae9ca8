"""Attempt logs: failure classes, health of sites, dead intervals, deadlines, site order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.functions._cols import ColumnLike, as_col
from webtables.operators.scan import last_before, ordinal, time_bucket

# --- fixed values ---
BAD_AFTER = 2  # failures before a site counts as bad
DEAD_TTL = 300  # seconds a refused, unreachable or slow host is skipped
HTTPS_BROKEN_TTL = 1800  # seconds plain http is used after a failed handshake
UNREACHABLE = "UnknownHostException|ConnectException|SocketTimeoutException|SSL|NoRouteToHost|SocketException"

# avg(a, ms) = ms on the first success, else (3a + ms) div 4 on whole numbers
_STEP = "if({a} <= 0, {m}, ({a} * 3 + {m}) div 4)"
_PREFIX = 96  # steps after which the start value no longer matters, up to a few neighbours
_SPREAD = 64


def classify_failure(error: ColumnLike, error_class: ColumnLike, code: ColumnLike, body: ColumnLike | None = None) -> Column:
    """``ok``, ``unreachable`` (says something about the site) or ``page``. With ``body`` a fetch without one is not ok."""
    failed = as_col(error).isNotNull()
    network = failed & F.coalesce(as_col(error_class).rlike(UNREACHABLE), F.lit(False))
    usable = ~failed & (as_col(code) > 0) & (as_col(code) < 400)
    if body is not None:
        usable = usable & as_col(body).isNotNull()
    return F.when(network, "unreachable").when(F.coalesce(usable, F.lit(False)), "ok").otherwise("page")


def probe_summary(fetches: DataFrame, url: str = "url", ok: str = "ok", reason: str = "reason") -> DataFrame:
    """Tries, usable answers and failures per url with the share of each; ``top_reason`` is the commonest failure."""
    by_reason = fetches.groupBy(url, ok, reason).agg(F.count(F.lit(1)).alias("n"))
    failed = ~F.col(ok)
    return by_reason.groupBy(url).agg(
        F.sum("n").alias("tries"),
        F.coalesce(F.sum(F.when(F.col(ok), F.col("n"))), F.lit(0)).alias("ok"),
        F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("failed"),
        F.min_by(F.when(failed, F.col(reason)), F.when(failed, F.struct(-F.col("n"), F.col(reason)))).alias("top_reason"),
    )


def probe_totals(fetches: DataFrame, ok: str = "ok") -> DataFrame:
    """One row over all urls: usable answers, failures and tries."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return fetches.agg(F.count_if(good).alias("ok"), F.count_if(~good).alias("fail"), F.count(F.lit(1)).alias("total"))


def fold_health(
    attempts: DataFrame, initial: DataFrame | None = None, source: str = "source_url", seconds: int = 3600,
    slice_rows: int = 100_000,
) -> DataFrame:
    """Counts, last times and the whole-number moving average of each site.

    ``attempts(source_url, ts, seq, reachable, had_results, ms)``. The average depends on every earlier
    success in order, so each (site, time slice) is reduced to its effect on any incoming average: a
    short run of steps kept as they are, then a table from the few averages still possible to the result.
    Slices holding more than ``slice_rows`` successes are divided evenly in time, so a busy site is worked
    on by as many tasks as it needs; only the effects of its slices meet.
    """
    reachable, good = F.col("reachable"), F.col("reachable") & F.col("had_results")
    counts = attempts.groupBy(source).agg(
        F.count_if(good).alias("ok"),
        F.count_if(~reachable).alias("fail"),
        F.max(F.when(good, F.col("ts"))).alias("last_ok"),
        F.max("ts").alias("last_try"),
        F.greatest(F.max(F.when(good, F.col("ms"))), F.lit(0)).alias("_hi"),
        F.least(F.min(F.when(good, F.col("ms"))), F.lit(0)).alias("_lo"),
    )
    if initial is not None:
        prior = initial.select(
            source, F.col("ok").alias("_ok"), F.col("fail").alias("_fail"), F.col("last_ok").alias("_last_ok"),
            F.col("last_try").alias("_last_try"), F.col("avg_ms").alias("_avg"),
        )
        counts = counts.join(prior, source, "full_outer")
        counts = counts.select(
            source,
            *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("ok", "fail")],
            *[F.greatest(c, f"_{c}").alias(c) for c in ("last_ok", "last_try")],
            F.greatest("_hi", "_avg", F.lit(0)).alias("_hi"), F.least("_lo", "_avg", F.lit(0)).alias("_lo"),
            F.coalesce("_avg", F.lit(0)).cast("long").alias("_avg"),
        )
    else:
        counts = counts.withColumn("_avg", F.lit(0).cast("long"))
    steps = attempts.filter(good).select(source, "ts", "seq", "ms", time_bucket("ts", seconds).alias("_t"))
    parts = steps.groupBy(source, "_t").agg(F.ceil(F.count(F.lit(1)) / slice_rows).alias("_parts"))
    width = seconds * 1_000_000
    share = (F.unix_micros(F.col("ts").cast("timestamp")) - F.col("_t") * width) / F.lit(width)
    steps = steps.join(parts, [source, "_t"]).withColumn(
        "_b", F.struct("_t", F.floor(share * F.col("_parts")).alias("p"))
    )
    slices = steps.groupBy(source, "_b").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ts", "seq", F.col("ms").cast("long").alias("ms")))), lambda x: x["ms"]
        ).alias("_ms")
    )
    slices = slices.join(counts.select(source, "_hi", "_lo"), source)
    low = "if(h.lo <= 0, least(m, if(h.hi > 0, (3 + m) div 4, m)), (h.lo * 3 + m) div 4)"
    high = "if(h.lo <= 0, greatest(m, if(h.hi > 0, (h.hi * 3 + m) div 4, m)), (h.hi * 3 + m) div 4)"
    slices = slices.withColumn("_p", F.slice("_ms", 1, _PREFIX)).withColumn(
        "_hull",
        F.expr(
            "aggregate(_p, named_struct('lo', cast(_lo as bigint), 'hi', cast(_hi as bigint)), "
            f"(h, m) -> named_struct('lo', {low}, 'hi', {high}))"
        ),
    )
    short = f"(size(_ms) <= {_PREFIX} or _hull.hi - _hull.lo > {_SPREAD})"
    fold = f"aggregate(slice(_ms, {_PREFIX} + 1, size(_ms)), s, (a, m) -> {_STEP.format(a='a', m='m')})"
    effect = slices.select(
        source, "_b",
        F.expr(f"if({short}, _ms, _p)").alias("steps"),
        F.expr(f"if({short}, cast(0 as bigint), _hull.lo)").alias("base"),
        F.expr(f"if({short}, cast(null as array<bigint>), transform(sequence(_hull.lo, _hull.hi), s -> {fold}))").alias(
            "after"
        ),
    )
    chains = effect.groupBy(source).agg(
        F.array_sort(F.collect_list(F.struct("_b", "steps", "base", "after"))).alias("_chain")
    )
    inner = f"aggregate(g.steps, x, (a, m) -> {_STEP.format(a='a', m='m')})"
    chained = F.expr(
        f"aggregate(_chain, _avg, (x, g) -> if(g.after is null, {inner}, "
        f"element_at(g.after, cast({inner} - g.base as int) + 1)))"
    )
    joined = counts.join(chains, source, "left")
    return joined.select(
        source, "ok", "fail", "last_ok", "last_try", F.coalesce(chained, "_avg").cast("long").alias("avg_ms")
    )


def fold_reads(reads: DataFrame, source: str = "source_url") -> DataFrame:
    """Opened with chapters or without, per site."""
    return reads.groupBy(source).agg(
        F.count_if("chapters").alias("read_ok"), F.count_if(~F.col("chapters")).alias("read_fail")
    )


def search_rank(ok: ColumnLike, fail: ColumnLike) -> Column:
    """0 known good, 2 known bad, 1 otherwise."""
    return F.when(as_col(ok) > 0, 0).when(as_col(fail) >= BAD_AFTER, 2).otherwise(1)


def reading_rank(ok: ColumnLike, fail: ColumnLike, read_ok: ColumnLike, read_fail: ColumnLike) -> Column:
    """0 opened before, 1 search works, 2 unknown, 3 search fails, 4 opened but always empty."""
    zero = lambda c: F.coalesce(as_col(c), F.lit(0))
    return (
        F.when(zero(read_ok) > 0, 0)
        .when((zero(read_fail) > 0) & (zero(read_fail) >= zero(read_ok) + BAD_AFTER), 4)
        .when(zero(ok) > 0, 1)
        .when(zero(fail) >= BAD_AFTER, 3)
        .otherwise(2)
    )


def health_ranks(registry: DataFrame, health: DataFrame, reads: DataFrame, source: str = "source_url") -> DataFrame:
    """Search and reading class of every registered site; unknown sites are 1 and 2."""
    joined = registry.select(source).join(health, source, "left").join(reads, source, "left")
    return joined.select(
        source,
        search_rank(F.coalesce("ok", F.lit(0)), F.coalesce("fail", F.lit(0))).alias("search_rank"),
        reading_rank("ok", "fail", "read_ok", "read_fail").alias("reading_rank"),
    )


def known_good(health: DataFrame) -> DataFrame:
    """How many sites ever answered with results."""
    return health.agg(F.count_if(F.col("ok") > 0).alias("known_good"), F.count(F.lit(1)).alias("sites"))


def order_sites(registry: DataFrame, health: DataFrame, source: str = "source_url", name: str = "name") -> DataFrame:
    """Sites in search order with their position: class, latest success first, name."""
    joined = registry.join(health.select(source, "ok", "fail", "last_ok"), source, "left")
    joined = joined.withColumn(
        "search_rank", search_rank(F.coalesce("ok", F.lit(0)), F.coalesce("fail", F.lit(0)))
    ).withColumn("_late", -F.coalesce(time_bucket("last_ok", 86400), F.lit(0)))
    joined = joined.withColumn("_head", F.when(F.col("last_ok").isNull(), F.substring(name, 1, 3)).otherwise(F.lit("")))
    placed = ordinal(joined, [], ["search_rank", "_late", "_head"], [F.col("last_ok").desc_nulls_last(), name, source])
    return placed.select(source, name, "search_rank", "last_ok", "pos")


def prune_health(health: DataFrame, keep: int = 3000, source: str = "source_url") -> DataFrame:
    """The most recently tried sites."""
    return health.orderBy(F.col("last_try").desc(), F.col(source)).limit(keep)


def flag_dead(
    attempts: DataFrame, host: str = "host", ts: str = "ts", seq: str = "seq", error_class: str = "error_class",
    ttl: int = DEAD_TTL, https_ttl: int = HTTPS_BROKEN_TTL, initial: DataFrame | None = None, message: str | None = None, cause: str | None = None,
) -> DataFrame:
    """Flag attempts made while an earlier failure of the host still counts.

    Refused, unreachable and slow hosts are ``dead`` for ``ttl`` seconds (expiry exclusive); a failed
    handshake only sets ``plain_http`` for ``https_ttl``. Unresolved hosts are never remembered. ``message`` may name a
    handshake or certificate that the class does not; ``cause`` is the class of the wrapped failure, which tells unresolved and
    refused hosts.
    ``initial(host, ts, seq, opens_dead, opens_http)``, the failures of earlier batches as :func:`open_windows` gives
    them, count like rows of this one: for later attempts only, up to their expiry.
    """
    cls = F.coalesce(F.col(error_class), F.lit(""))
    inner, said = (F.coalesce(F.col(c), F.lit("")) if c else F.lit("") for c in (cause, message))
    unresolved = F.contains(cls, F.lit("UnknownHost")) | F.contains(inner, F.lit("UnknownHost"))
    down = ~unresolved & (cls.rlike("ConnectException|NoRouteToHost|SocketException") | F.contains(inner, F.lit("ConnectException")))
    tls = ~unresolved & ~down & (F.contains(cls, F.lit("SSL")) | said.rlike("SSL|Certificate"))
    slow = ~unresolved & ~down & ~tls & F.contains(cls, F.lit("SocketTimeout"))
    until = lambda cond, s: F.when(cond, F.col(ts) + F.expr(f"interval {int(s)} seconds"))
    width = max(ttl, https_ttl)
    staged = attempts.withColumn("_dead", until(down | slow, ttl)).withColumn("_http", until(tls, https_ttl)).withColumn("_old", F.lit(False))
    if initial is not None:
        staged = staged.unionByName(initial.select(
            host, ts, seq, F.col("opens_dead").alias("_dead"), F.col("opens_http").alias("_http"), F.lit(True).alias("_old")), allowMissingColumns=True)
    out = last_before(staged, [host], ts, [ts, seq], F.col("_dead"), width, "dead_until")
    out = last_before(out, [host], ts, [ts, seq], F.col("_http"), width, "http_until")
    live = lambda c: F.coalesce(F.col(c) > F.col(ts), F.lit(False))
    return out.filter(~F.col("_old")).withColumn("dead", live("dead_until")).withColumn("plain_http", live("http_until")).select(
        *attempts.columns, "dead", "plain_http", F.col("_dead").alias("opens_dead"), F.col("_http").alias("opens_http")
    )


def open_windows(flagged: DataFrame, host: str = "host", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """The failures that open a window, with its start and its ends."""
    return flagged.filter("opens_dead IS NOT NULL OR opens_http IS NOT NULL").select(host, ts, seq, "opens_dead", "opens_http")


def defer_dead(queue: DataFrame, dead: DataFrame, run: str = "run_id", host: str = "host", pos: str = "pos") -> DataFrame:
    """Items of dead hosts move to the tail of their run; the order is kept otherwise. ``place`` is 1-based."""
    marked = queue.join(dead.select(host).distinct().withColumn("_dead", F.lit(1)), host, "left")
    marked = marked.withColumn("deferred", F.coalesce("_dead", F.lit(0))).drop("_dead")
    marked = marked.withColumn("_slice", F.floor(F.col(pos) / 100_000))
    return ordinal(marked, [run], ["deferred", "_slice"], [pos], "place").drop("_slice")


def apply_deadline(attempts: DataFrame, budget: int = 60, run: str = "run_id", ts: str = "ts",
                   starts: DataFrame | None = None) -> DataFrame:
    """Attempts starting after run start plus budget are reported as timed out, never dropped."""
    begun = starts if starts is not None else attempts.groupBy(run).agg(F.min(ts).alias("started"))
    late = F.col(ts) > F.col("started") + F.expr(f"interval {int(budget)} seconds")
    return attempts.join(begun, run).withColumn("outcome", F.when(late, "timed out").otherwise("run"))
