"""Ordering work split so that one hot key never lands in one task.

A window partitioned by a key alone sorts all rows of that key in one task. The helpers below split the key by
order-preserving ranges or buckets: rows are numbered or scanned inside one of them, and a small summary per range,
pre-aggregated on the map side, carries the state from one to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtables.session import settle


def time_bucket(ts: str, seconds: int) -> Column:
    """Number of the time slice a timestamp falls in."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def ordinal(df: DataFrame, keys: Sequence[str], buckets: Sequence[str], order: Sequence[Column | str], name: str = "pos") -> DataFrame:
    """Exact 1-based position inside ``keys`` ordered by ``buckets`` then ``order``.

    One plan for every size: rows are dealt by ranges of (keys, buckets, order), numbered inside a range, and
    shifted by the rows of their key in the ranges before. A hot key, or all rows where there are no keys, spans
    as many ranges as its rows need. Shuffles below are read twice, for the sample of the ranges and for the rows. Only the first
    key of a range can go on from ranges before, so the shifts are one row per range, and only they are seen as a whole.
    """
    tag = "_"
    while any(c.startswith(tag) for c in df.columns):  # the helper columns below clash with none of the given ones
        tag += "_"
    part, row, n, first, last, upto, at, off, goes_on = (tag + c for c in ("part", "row", "n", "first", "last", "upto", "at", "off", "goes_on"))
    # stored, because the ranges are drawn from a sample and must not be drawn again
    ranged = settle(df.repartitionByRange(*keys, *buckets, *order).withColumn(part, F.spark_partition_id()))
    whole = F.struct(F.lit(0).alias(tag), *keys)
    counts = ranged.groupBy(part, *keys).agg(F.count(F.lit(1)).alias(n))
    ends = counts.groupBy(part).agg(F.min(whole).alias(first), F.max(F.struct(whole.alias("key"), n)).alias(last))
    ends = ends.withColumn(upto, F.sum(F.col(last)[n]).over(Window.partitionBy(F.col(last)["key"]).orderBy(part)))
    line = Window.orderBy(part)
    same = F.lag(F.col(last)["key"]).over(line) == F.col(first)
    # stored: a table of known size joins without a shuffle of the rows
    shifts = settle(ends.select(F.col(part).alias(at), first, F.lag(upto).over(line).alias(off), same.alias(goes_on)).filter(F.col(goes_on)))
    numbered = ranged.withColumn(row, F.row_number().over(Window.partitionBy(part, *keys).orderBy(*buckets, *order)))
    joined = numbered.join(shifts, numbered[part] == shifts[at], "left")
    before = F.when(whole == F.col(first), F.col(off))
    return joined.withColumn(name, (F.col(row) + F.coalesce(before, F.lit(0))).cast("long")).select(*df.columns, name)


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salt_by: Sequence[str], salts: int = 32,
    name: str = "pos",
) -> DataFrame:
    """The first ``k`` rows per key: ``k`` per (key, salt) first, so the final sort sees at most k x salts rows."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    some = salted.withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= k).drop("_r", "_salt")
    final = Window.partitionBy(*keys).orderBy(*order)
    return some.withColumn(name, F.row_number().over(final)).filter(F.col(name) <= k)


def last_before(
    df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[Column | str], value: Column, seconds: int, name: str
) -> DataFrame:
    """Running maximum of ``value`` over the strictly earlier rows of each key.

    Exact for values that cannot reach past the next time bucket (a failure window no longer than
    ``seconds``): the carry comes from the bucket before only.
    """
    staged = df.withColumn("_v", value).withColumn("_b", time_bucket(ts, seconds))
    carry = (
        staged.filter("_v is not null").groupBy(*keys, "_b").agg(F.max("_v").alias("_carry"))
        .withColumn("_b", F.col("_b") + 1)
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = staged.join(carry, [*keys, "_b"], "left")
    best = F.greatest(F.max("_v").over(inside), F.col("_carry"))
    return joined.withColumn(name, best).drop("_v", "_b", "_carry")
