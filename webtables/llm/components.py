"""Connected components of a graph of integer nodes: contraction inside tasks, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtables.llm._tables import Scratch


#: Edges that one task contracts.
TASK_EDGES = 50_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as edges from every node to the smallest it reaches by them."""
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not held:
        return
    u, v = (np.concatenate([x[k] for x in held]) for k in (0, 1))
    names, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, up = places[: len(u)], places[len(u) :], np.arange(len(names))
    while True:
        high, low = np.maximum(up[a], up[b]), np.minimum(up[a], up[b])
        if (high == low).all():
            break
        np.minimum.at(up, high, low)
        while not np.array_equal(up, up[up]):
            up = up[up]
    moved = np.flatnonzero(up != np.arange(len(up)))
    yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[up[moved]])], ["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every node's neighbours are linked to the smallest of them and itself.

    The large star moves the larger neighbours, the small star the smaller ones and the node itself.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v < u")
    least = near.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.col("c")).alias("m"))
    moved = near.join(least, near["u"] == least["c"])
    if large:
        out = moved.filter("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """node and root (smallest reachable node) of every node that has an edge; edges are longs u, v.

    Tasks contract about ``TASK_EDGES`` edges each to stars; where one task saw all, these are the components. Else rounds of stars follow
    and end when one changes nothing: then every edge goes from a node to its root. Edges never outnumber the
    given ones, a hot node is a skewed join key that Spark may split, and every round is a written table.
    """
    now = scratch.keep(name, edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    tasks = -(-now.count() // TASK_EDGES)
    if tasks:
        now = _following(now.repartition(tasks).mapInArrow(_contract, "u long, v long"), scratch, name)
    before = None
    while tasks > 1:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = _following(_star(_star(now, True), False), scratch, name)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _following(step: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``step`` written in the place of the table it is made from."""
    following = scratch.keep(f"{name}-next", step)
    scratch.drop(name)
    scratch.paths[name] = scratch.paths.pop(f"{name}-next")
    return following
