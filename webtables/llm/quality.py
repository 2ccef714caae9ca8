"""Quality rules: minimum-covariance-determinant estimates per language and source, Mahalanobis verdicts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtables.functions._cols import once
from webtables.llm._tables import Scratch
from webtables.llm.mixing import SPACE_RUN, SPACES

#: Transformed statistics in thousandths, and the spread below which a dimension is not told apart.
DIMS = ("length", "word_length", "symbols", "dup_lines", "repeats")
SPREAD = (0.3, 0.1, 0.06, 0.15, 0.1)
SCALE = 1000
WINDOW = 5
STEPS = 6
CORE = 0.75
MIN_ROWS = 200
#: Tail probability of a clean vector beyond the cutoff, were the core normal.
TAIL = 1e-12
BINS = 32


def chi2_cdf(x: float, p: int) -> float:
    """Chi-square distribution by the series of the incomplete gamma function."""
    a, x = p / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return high


def statistics(docs: DataFrame) -> DataFrame:
    """Columns of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, row by row.

    A repeated window is found by its neighbours in the sorted window hashes of the text: n log n for n words,
    and only in texts whose hashes are not all distinct.
    """
    inner = F.btrim("text", F.lit(SPACES))
    words = F.when(F.length(inner) > 0, F.split(inner, SPACE_RUN)).otherwise(F.array().cast("array<string>"))
    told = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    cols = docs.columns
    split = docs.select(*cols, once(_words=words, _told=told))
    hashed = split.select(
        *cols, F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("_told") - F.size(F.array_distinct("_told"))).cast("long").alias("n_dup_lines"),
        once(_h=F.transform("_words", lambda w: F.xxhash64(w))))
    stats = [*cols, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    windows = hashed.select(*stats, once(_w=F.transform(
        F.slice("_h", 1, F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get("_h", i + j) for j in range(1, WINDOW)]))))
    again = F.size(F.array_distinct("_w")) < F.size("_w")
    ordered = windows.select(*stats, once(_s=F.when(again, F.array_sort(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))))
    twice = F.filter(F.transform("_s", lambda x, k: F.when((F.get("_s", k - 1)["h"] == x["h"]) | (F.get("_s", k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())
    found = ordered.select(*stats, once(_p=F.array_sort(twice)))
    covered = F.aggregate(F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return found.select(*stats, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def vector() -> list[Column]:
    """The transformed statistics as whole thousandths: sums over them are exact, whatever the order."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    out = [F.log(n), F.log(F.col("word_chars") / n + 1), F.sqrt(F.least(F.lit(1.0), F.col("n_symbols") / chars)),
           F.sqrt(F.least(F.lit(1.0), F.col("n_dup_lines") * 5 / n)), F.sqrt(F.col("n_repeat_words") / n)]
    return [F.round(x * SCALE).cast("long").alias(f"x{i}") for i, x in enumerate(out)]


def _groups(rows: DataFrame) -> DataFrame:
    """l, s, g and feeds: the group that judges a language and source, and all groups whose estimates they enter.

    Small ones share the rest of the language; where that is small too, they are judged by the whole language, by the
    rest of all or, in the end, by all documents, if these are enough.
    """
    sizes = rows.filter("NOT base_failed").groupBy("l", "s").agg(F.count(F.lit(1)).alias("n"))
    in_language, in_all = Window.partitionBy("l"), Window.partitionBy(F.lit(1))
    whole, corpus = F.concat_ws("\x01", F.lit("whole"), "l"), F.lit("corpus")
    own = sizes.withColumn("g", F.when(F.col("n") >= MIN_ROWS, F.concat_ws("\x01", F.lit("source"), "l", "s")))
    left = F.sum(F.when(F.col("g").isNull(), F.col("n")))
    rest = own.select("*", left.over(in_language).alias("left"), F.sum("n").over(in_language).alias("language")).withColumn("g", F.coalesce("g", F.when(
        F.col("left") >= MIN_ROWS, F.concat_ws("\x01", F.lit("language"), "l")).when(F.col("language") >= MIN_ROWS, whole)))
    named = rest.withColumn("left", left.over(in_all)).withColumn("g", F.coalesce("g", F.when(F.col("left") >= MIN_ROWS, F.lit("all")), corpus))
    wider = [F.when(F.max(F.col("g") == x).over(w), x) for x, w in ((whole, in_language), (F.lit("corpus"), in_all))]
    return named.select("l", "s", "g", F.array_distinct(F.array_compact(F.array("g", *wider))).alias("feeds"))


def _whitened(estimate: DataFrame) -> DataFrame:
    """g, m_i and w_ij: means and the inverse of the Cholesky factor of the covariance c_ij."""
    p = len(DIMS)
    out = estimate
    for i in range(p):
        for j in range(i + 1):
            inner = F.col(f"c{i}{j}")
            for k in range(j):
                inner = inner - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(inner) if i == j else inner / F.col(f"l{j}{j}"))
    for i in range(p):
        for j in range(i + 1):
            if i == j:
                value = 1 / F.col(f"l{i}{i}")
            else:
                value = F.lit(0.0)
                for k in range(j, i):
                    value = value - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
                value = value / F.col(f"l{i}{i}")
            out = out.withColumn(f"w{i}{j}", value)
    return out.select(F.col("g").alias("eg"), *[f"m{i}" for i in range(p)], *[f"w{i}{j}" for i in range(p) for j in range(i + 1)])


def _distance() -> Column:
    """Squared Mahalanobis distance under the joined estimate."""
    total = F.lit(0.0)
    for i in range(len(DIMS)):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"w{i}{j}") * (F.col(f"x{j}") / SCALE - F.col(f"m{j}"))
        total = total + z * z
    return total


def _start(rows: DataFrame) -> DataFrame:
    """Medians and interquartile ranges per group, as an estimate with a diagonal covariance."""
    p = range(len(DIMS))
    cut = rows.groupBy("g").agg(*[F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in p])
    cols = [(F.col(f"q{i}")[1] / SCALE).alias(f"m{i}") for i in p]
    for i in p:
        for j in range(i + 1):
            spread = (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / SCALE / 1.349
            cols.append((spread * spread + SPREAD[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}"))
    return cut.select("g", *cols)


def _step(rows: DataFrame, estimate: DataFrame, factor: float) -> DataFrame:
    """One concentration step: mean and covariance of the ``CORE`` of each group that lies nearest.

    Rows are summed by group and distance bin (a few thousand bins at most), so the core is found without a
    sort; the bin in which the core ends is taken whole.
    """
    p = range(len(DIMS))
    placed = rows.join(estimate, rows["g"] == estimate["eg"]).select(
        "g", *[f"x{i}" for i in p], F.floor(F.log2(_distance() + 1e-6) * BINS).alias("bin"))
    pairs = [(i, j) for i in p for j in range(i + 1)]
    sums = placed.groupBy("g", "bin").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in p], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in pairs])
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("bin"))
    core = sums.select("*", (upto - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("g")).alias("all")).filter(F.col("before") < F.ceil(F.col("all") * CORE))
    total = core.groupBy("g").agg(*[F.sum(c).cast("double").alias(c) for c in ["n", *[f"s{i}" for i in p], *[f"s{i}{j}" for i, j in pairs]]])
    means = [(F.col(f"s{i}") / F.col("n") / SCALE).alias(f"m{i}") for i in p]
    cov = [((F.col(f"s{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n")) / SCALE ** 2 * factor
            + (SPREAD[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in pairs]
    return total.select("g", *means, *cov)


def verdicts(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """doc_id, th (hash of the text), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    distance (squared, null where there is no estimate) and kept of every row.

    base_failed: under 10 words, or over 20 % of the words in repeated 5-word windows. The others are judged by
    the Mahalanobis distance of their transformed statistics from the centre of their language and source. Centre
    and covariance come from all documents that pass the base: medians to begin with, then ``STEPS``
    concentration steps towards the 75 % of a group with the smallest covariance determinant. Each dimension has
    a least spread, so a group whose core agrees in a statistic still has an inverse. Languages and sources with
    under ``MIN_ROWS`` such documents are judged with the rest of their language; where the rest is that small too, by
    all documents of the language, else by the rest of all languages, else by all documents, however few these are.

    Null texts have no words; null languages and sources are groups of their own; repeated rows count as often as
    they come. An empty table gives an empty result; columns but doc_id, text, lang and source are not read.
    """
    scratch = Scratch(docs.sparkSession)
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("\x00")).alias("l"),
        F.coalesce(F.col("source").cast("string"), F.lit("\x00")).alias("s"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th"),
        F.col("text").cast("string").alias("text"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = scratch.keep("rows", statistics(named).drop("text").withColumn("base_failed", failed).select("*", *vector()))
    groups = scratch.keep("groups", _groups(rows)).select(F.col("l").alias("gl"), F.col("s").alias("gs"), "g", "feeds")
    grouped = rows.join(groups, (rows["l"] == groups["gl"]) & (rows["s"] == groups["gs"]), "left").drop("gl", "gs")
    clean = grouped.filter("NOT base_failed").withColumn("g", F.explode("feeds"))
    p = len(DIMS)
    core = chi2_quantile(CORE, p)
    factor = CORE / chi2_cdf(core, p + 2)
    estimate = scratch.keep("start", _whitened(_start(clean)))
    for step in range(STEPS):
        estimate = scratch.keep(f"step{step}", _whitened(_step(clean, estimate, factor)))
    judged = grouped.join(estimate, grouped["g"] == estimate["eg"], "left").withColumn("distance", _distance())
    return judged.select(
        "doc_id", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi2_quantile(1 - tail, p))).alias("kept"))
