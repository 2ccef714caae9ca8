"""Sharding by a k-d tree: split at weighted medians along the widest metadata dimension."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtables.llm._tables import Scratch

DIMENSION_BITS, TIE_BITS = 12, 16
TOP = 1 << DIMENSION_BITS
ROW_BYTES = 16
SLOT_ROWS = 100_000


@dataclass
class Node:
    """Shards ``first`` to ``first + n - 1``; split at ``cut`` of dimension ``dim`` into two nodes."""

    first: int
    n: int
    dim: int = 0
    cut: int = 0
    low: Node | None = None
    high: Node | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.low is None else [*self.low.leaves(), *self.high.leaves()]

    def column(self) -> Column:
        """First shard of the leaf a unit falls in."""
        if self.low is None:
            return F.lit(self.first)
        return F.when(F.col(f"k{self.dim}") < self.cut, self.low.column()).otherwise(self.high.column())


def _code(name: str) -> Column:
    """A category as a place on a fixed scale."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(TOP))


def _units(rows: DataFrame, shards: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Equal texts as one point with the sum of their bytes; a point above a shard's share is cut in pieces."""
    points = scratch.keep("points", rows.groupBy("h", "size").agg(
        F.sum("size").alias("weight"), F.min("doc_id").alias("doc_id"), F.min("lang").alias("lang"), F.min("source").alias("source")))
    total, low, high = points.agg(F.sum("weight"), F.min("doc_id"), F.max("doc_id")).first()
    share = (total or 0) / shards
    pieces = F.when(F.col("weight") > share, F.ceil(F.col("weight") / (share / 4 or 1))).otherwise(1).cast("int")
    span = max(1, (high or 0) - (low or 0))
    dims = [F.least(F.lit(TOP - 1), F.floor(F.log2("size") * (TOP / 40))), _code("lang"), _code("source"),
            F.coalesce(F.floor((F.col("doc_id") - F.lit(low or 0)) / F.lit(span) * (TOP - 1)), F.lit(TOP - 1))]
    units = points.select("h", "size", "weight", pieces.alias("pieces"), *[d.cast("long").alias(f"d{i}") for i, d in enumerate(dims)]).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    # heavy points come first on every axis, so that a cut falls among light ones
    light = F.when(F.col("weight") / F.col("pieces") > share / 16, 0).otherwise(TOP)
    tie = F.pmod(F.xxhash64("h", "piece"), F.lit(1 << TIE_BITS))
    keys = [((light + F.col(f"d{i}")) * (1 << TIE_BITS) + tie).alias(f"k{i}") for i in range(len(dims))]
    return scratch.keep("units", units.select(
        "h", "size", "piece", "pieces", (F.col("weight") / F.col("pieces")).alias("weight"), *[f"d{i}" for i in range(len(dims))], *keys)), len(dims)


def _split(units: DataFrame, tree: Node, dims: int) -> None:
    """Split every leaf of more than one shard once: three passes over the units for all leaves together."""
    leaves = {x.first: x for x in tree.leaves() if x.n > 1}
    here = units.withColumn("node", tree.column()).filter(F.col("node").isin(list(leaves)))
    wide = here.groupBy("node").agg(F.sum("weight").alias("weight"), *[(F.max(f"d{i}") - F.min(f"d{i}")).alias(f"w{i}") for i in range(dims)]).collect()
    want, dim = {}, {}
    for row in wide:
        node = leaves[row["node"]]
        dim[node.first] = max(range(dims), key=lambda i: (row[f"w{i}"], -i))
        want[node.first] = row["weight"] * (node.n // 2) / node.n

    def per_node(values: dict, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for first, value in values.items():
            out = F.when(F.col("node") == first, F.lit(value)).otherwise(out)
        return out

    key = F.lit(None).cast("long")
    for first, d in dim.items():
        key = F.when(F.col("node") == first, F.col(f"k{d}")).otherwise(key)

    def boundary(bins: DataFrame, held: dict) -> dict:
        upto = F.sum("weight").over(Window.partitionBy("node").orderBy("bin"))
        found = bins.withColumn("upto", upto + per_node(held, "double")).withColumn("before", F.col("upto") - F.col("weight"))
        ends = found.filter((F.col("before") < per_node(want, "double")) & (F.col("upto") >= per_node(want, "double") * (1 - 1e-12)))
        return {r["node"]: r["x"] for r in ends.groupBy("node").agg(F.min(F.struct("bin", "before", "upto")).alias("x")).collect()}

    keyed = here.select("node", "weight", key.alias("key"))
    coarse = boundary(keyed.groupBy("node", F.floor(F.col("key") / (1 << TIE_BITS)).alias("bin")).agg(F.sum("weight").alias("weight")), dict.fromkeys(leaves, 0.0))
    bins = per_node({n: x["bin"] for n, x in coarse.items()}, "long")
    inside = keyed.filter(F.floor(F.col("key") / (1 << TIE_BITS)) == bins)
    fine = boundary(inside.groupBy("node", F.col("key").alias("bin")).agg(F.sum("weight").alias("weight")), {n: x["before"] for n, x in coarse.items()})
    for first, node in leaves.items():
        half, cut = node.n // 2, 0
        if first in fine:
            x = fine[first]
            cut = x["bin"] + (x["upto"] - want[first] <= want[first] - x["before"])
        node.dim, node.cut = dim.get(first, 0), cut
        node.low, node.high = Node(first, half), Node(first + half, node.n - half)


def kd_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null) of every row.

    Law ``bytes``: sizes (UTF-8 bytes of the text plus 16) of the shards are near equal. Points of the tree are
    the distinct texts, weighted with the bytes of their copies, so copies share a shard; only a text whose copies
    exceed a shard's share is cut in pieces by doc_id. Dimensions: log of the size, language, source, place of
    the doc_id. A node of n shards is cut along its widest dimension where its bytes stand as n // 2 to the rest;
    ties of a dimension are in order of a hash.

    A null text has no bytes; null languages, sources and ids are values of their own. Rows that repeat a doc_id
    and a text are separate rows of one shard. An empty table gives an empty result; columns but doc_id, text,
    lang and source are not read, and the last two may be missing.

    Medians come from histograms summed per task; the driver sees a few rows per node. Slots number buckets of a
    shard apart and shift them, so no task sorts a whole shard.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.col("text").cast("string")
    other = [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")]
    rows = scratch.keep("rows", docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), *other))
    units, dims = _units(rows, shards, scratch)
    tree = Node(0, shards)
    for _ in range(math.ceil(math.log2(max(1, shards)))):
        _split(units, tree, dims)
    of_text = units.select("h", "size", "pieces", "piece", tree.column().alias("shard")).groupBy("h", "size").agg(
        F.array_sort(F.collect_list(F.struct("piece", "shard"))).alias("at")).select(F.col("h").alias("uh"), F.col("size").alias("us"), "at")
    dealt = rows.join(of_text, (rows["h"] == of_text["uh"]) & (rows["size"] == of_text["us"])).select(
        "doc_id", "size", "text_crc32", "h",
        F.element_at("at", (F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.size("at")) + 1).cast("int"))["shard"].cast("int").alias("shard"))
    dealt = scratch.keep("dealt", dealt)
    buckets = max(1, dealt.count() // (shards * SLOT_ROWS))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)))
    sizes = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    shifts = sizes.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), (
        F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("shift"))
    numbered = dealt.withColumn("at", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "h")) - 1)
    return numbered.join(shifts, (numbered["shard"] == shifts["s"]) & (numbered["bucket"] == shifts["b"])).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("shift")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
