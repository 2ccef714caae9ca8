"""Mixing sources to target weights: hash-threshold histograms, refined only where a budget ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtables.llm._tables import Scratch

#: The characters that part words, and the same as a pattern.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
HASH_BITS, DIGIT_BITS = 60, 12


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(inner) > 0, F.size(F.split(inner, SPACE_RUN))).otherwise(0).cast("long")


def place(doc_id: Column) -> Column:
    """60 hash bits of a doc_id, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: list[int], most: int) -> DataFrame:
    """source, source_size, target from source, source_size: water filling with ceilings.

    Sources in order of code points, null last, weigh ``weights`` in turn and share the sum of all sizes; none gets
    more than ``most`` times its size, and what that leaves is shared by weight among the others. In order of
    ceiling by weight the capped sources come first, so running sums give the level at which the rest stand.
    """
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1))
    weighed = sizes.select("source", "source_size", turn.cast("long").alias("w"), (most * F.col("source_size")).alias("cap"))
    order = [F.col("cap").cast("double") / F.col("w"), F.col("source").asc_nulls_last()]
    before, rest = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    steps = weighed.select(
        "source", "source_size", "w", "cap", F.row_number().over(Window.orderBy(*order)).alias("i"),
        ((F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .cast("double") / F.sum("w").over(rest)).alias("level"))
    stand = F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct("i", "level"))).over(
        Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["level"]
    return steps.select("source", "source_size", F.least(F.col("cap").cast("double"), stand * F.col("w")).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame, scratch: Scratch) -> DataFrame:
    """source, last: the documents of a source with ``place <= last`` come nearest to its ``need``.

    Sizes are summed by source and hash bucket; the bucket in which the budget ends is the only one that the next
    round reads, split by its next digits, until it holds one hash value. That value is taken if this comes
    nearer. Budgets of one table are nested: a larger one keeps all that a smaller one takes.
    """
    shift, done = HASH_BITS - DIGIT_BITS, []
    open_ = budgets.filter("need > 0").select("source", "need", F.lit(0).cast("long").alias("held"), F.lit(0).cast("long").alias("prefix"))
    while True:
        bucket = F.shiftright("place", shift)
        if shift == HASH_BITS - DIGIT_BITS:
            inside = rows.select("source", "size", "place", bucket.alias("bucket"))
        else:
            at = open_.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
            inside = rows.join(at, rows["source"].eqNullSafe(at["s"]) & (F.shiftright("place", shift + DIGIT_BITS) == at["p"])).select(
                "source", "size", "place", bucket.alias("bucket"))
        histogram = inside.groupBy(F.col("source").alias("s"), "bucket").agg(F.sum("size").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("s").orderBy("bucket"))
        summed = histogram.select("*", (upto - F.col("n")).alias("before"))
        found = summed.join(open_, summed["s"].eqNullSafe(open_["source"])).select(
            "source", "need", (F.col("held") + F.col("before")).alias("held"), "n", "low", "high", F.col("bucket").alias("prefix")).filter(
            "held < need AND need <= held + n")
        found = scratch.keep(f"round{shift}", found)
        one = found.filter("low = high")
        done.append(one.select("source", F.when(F.col("held") + F.col("n") - F.col("need") <= F.col("need") - F.col("held"), F.col("low")).otherwise(F.col("low") - 1).alias("last")))
        open_ = found.filter("low < high").select("source", "need", "held", "prefix")
        shift -= DIGIT_BITS
        if shift < 0 or open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document.

    size: words of the text, 0 for null. taken: words the mix takes of the document, repeats counted; every
    document of a source is taken whole as often as the target holds the source's size, and once more if its hash
    is below the source's threshold, so never over ``most`` times. Null is a source of its own. Rows that repeat a
    doc_id in one source are taken alike. A source without words has target 0 and nothing taken. An empty table
    gives an empty result; further columns are not read. Reruns agree: only the doc_id decides.

    Nothing is sorted but a source's buckets (4,096 at most); rows of a hot source are summed per task before they
    are shuffled, and each further round reads one bucket per source.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep("rows", docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"), place(F.col("doc_id")).alias("place")))
    budgets = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budgets = scratch.keep("budgets", budgets.select("*", whole.alias("whole")).select("*", (F.col("target") - F.col("whole") * F.col("source_size")).alias("need")))
    last = thresholds(rows, budgets, scratch).select(F.col("source").alias("l"), "last")
    plan = budgets.join(last, budgets["source"].eqNullSafe(last["l"]), "left").select(
        F.col("source").alias("s"), "source_size", "target", "whole", F.coalesce("last", F.lit(-1)).alias("last"))
    return rows.join(plan, rows["source"].eqNullSafe(plan["s"])).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * (F.col("whole") + F.when(F.col("place") <= F.col("last"), 1).otherwise(0))).alias("taken"))
