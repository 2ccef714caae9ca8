"""Merkle dataset manifest: every aligned block keeps each level of its tree as one hex string, cut by fixed widths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtables.llm._tables import Scratch

HEX = 64
#: Levels of the tree inside one block.
DEPTH = 4


def _item(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of a row; every value carries its length, so no two rows share an input."""
    return F.sha2(F.concat(*map(_item, values)), 256)


def _numbered(rows: DataFrame, order: Sequence[str], scratch: Scratch, name: str) -> DataFrame:
    """``idx`` (0-based place inside ``key`` by ``order``) and ``n`` (rows of the key).

    Rows are dealt by ranges of (key, order); a hot key spans as many ranges as it needs, and the only window over a
    whole key sees one row per range.
    """
    ranged = scratch.keep(name, rows.repartitionByRange("key", *order).withColumn("part", F.spark_partition_id()))
    per_part = ranged.groupBy("key", "part").agg(F.count(F.lit(1)).alias("m"))
    whole = Window.partitionBy("key")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_part.select(
        F.col("key").alias("k"), F.col("part").alias("p"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("off"), F.sum("m").over(whole).alias("n"))
    inside = Window.partitionBy("part", "key").orderBy(*order)
    placed = ranged.withColumn("row", F.row_number().over(inside))
    return placed.join(shifts, (placed["part"] == shifts["p"]) & (placed["key"] == shifts["k"])).select(
        *rows.columns, (F.col("row") - 1 + F.col("off")).alias("idx"), "n")


def _parents(level: Column, fan: int) -> Column:
    """The next level's string: each run of ``fan`` digests, the last one maybe shorter, becomes the digest of its text."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / (HEX * fan)).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * (HEX * fan) + 1, F.lit(HEX * fan)).cast("binary"), 256)), "")


def _blocks(nodes: DataFrame, fan: int, scratch: Scratch, name: str) -> DataFrame:
    """One row per block of ``fan ** DEPTH`` nodes: levels l0, l1, ... as strings, ``lv`` of them used, and the node on top."""
    width = fan**DEPTH
    member = F.struct(*[c for c in nodes.columns if c not in ("key", "n")])
    grouped = nodes.groupBy("key", "n", F.floor(F.col("idx") / width).cast("long").alias("blk")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    lv = sum((F.when(F.col("n") > fan**j, 1).otherwise(0) for j in range(DEPTH)), F.lit(0))
    out = grouped.withColumn("lv", lv).withColumn("l0", F.array_join(F.col("members.node"), ""))
    for j in range(DEPTH):
        out = out.withColumn(f"l{j + 1}", F.when(F.col("lv") > j, _parents(F.col(f"l{j}"), fan)).otherwise(F.col(f"l{j}")))
    return scratch.keep(name, out.withColumnRenamed(f"l{DEPTH}", "top"))


def _path(i: Column, fan: int) -> Column:
    """Flanking segments of a member's place on each used level, from the leaf upwards."""
    steps = []
    for j in range(DEPTH):
        at = F.floor(i / fan**j).cast("int")
        own, level = at % fan, F.col(f"l{j}")
        steps.append(F.struct(
            F.substring(level, (at - own) * HEX + 1, own * HEX).alias("before"),
            F.substring(level, (at + 1) * HEX + 1, (fan - 1 - own) * HEX).alias("after")))
    return F.slice(F.array(*steps), F.lit(1), F.col("lv"))


class _Tree:
    """All rounds of blocks over numbered nodes (key, idx, n, node, ...), until every key has one node left."""

    def __init__(self, nodes: DataFrame, fan: int, scratch: Scratch, name: str):
        self.fan, self.width, self.rounds = fan, fan**DEPTH, []
        most = nodes.agg(F.max("n")).first()[0] or 0
        while True:
            self.rounds.append(_blocks(nodes, fan, scratch, f"{name}{len(self.rounds)}"))
            if most <= self.width:
                break
            most = -(-most // self.width)
            nodes = self.rounds[-1].select("key", F.ceil(F.col("n") / self.width).cast("long").alias("n"), F.col("blk").alias("idx"), F.col("top").alias("node"))

    def roots(self) -> DataFrame:
        return self.rounds[-1].select("key", F.col("top").alias("node"))

    def first_blocks(self, above: DataFrame) -> DataFrame:
        """The blocks of the first round with the columns of ``above`` (key, path, ...), path being what lies over the block."""
        given = [c for c in above.columns if c not in ("key", "path")]
        up = above.select(F.col("key").alias("k"), F.lit(0).cast("long").alias("b"), "path", *given)
        for blocks in reversed(self.rounds[1:]):
            joined = self._under(blocks, up)
            width = self.width
            steps = F.transform("members", lambda m: F.struct(m["idx"].alias("b"), _path((m["idx"] % width).cast("int"), self.fan).alias("own")))
            up = joined.select(F.col("key").alias("k"), "path", *given, F.explode(steps).alias("s")).select(
                "k", F.col("s.b").alias("b"), F.concat("s.own", "path").alias("path"), *given)
        return self._under(self.rounds[0], up)

    @staticmethod
    def _under(blocks: DataFrame, up: DataFrame) -> DataFrame:
        return blocks.join(up.hint("merge"), (blocks["key"] == up["k"]) & (blocks["blk"] == up["b"])).drop("k", "b")


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id",
             now: Mapping[str, Column] | None = None, fan: int = 3) -> DataFrame:
    """``order``, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Leaves are digests of ``columns``. Inside each ``group`` they ascend by ``order``, and every ``fan`` neighbours
    become their digest until one node, the subroot, is left; subroots, by group, likewise give the root.
    proof_sha256 is the digest of all siblings from the leaf to the root. ``now`` holds columns as they are found at
    the time of checking, in terms of the columns of ``docs``: the leaf of those is folded with the siblings of the manifest,
    and ``verified`` says whether the root comes out.

    A null in a column is ``-`` in its leaf; null groups are one group and come first, null orders come first. Rows
    of one order stand by leaf, so equal rows are interchangeable and each has its own place. Empty texts and texts of any length
    are hashed as they are. An empty table gives an empty result; further columns are not read, whatever their names.

    Texts are hashed where they are read and never shuffled. A block is ``fan ** DEPTH`` leaves of a group, so a hot
    group is many blocks; a round writes one row per block and shrinks the nodes by that factor, the roots of groups
    recurse in the same way, and the siblings above a block reach it by a merge join on its number.
    """
    scratch = Scratch(docs.sparkSession)
    own = {c: docs[c] for c in columns}
    rows = docs.select(
        F.coalesce(F.concat(F.lit("1"), docs[group].cast("string")), F.lit("0")).alias("key"), docs[order].alias("at"),
        leaf_digest(list(own.values())).alias("node"), leaf_digest([(now or {}).get(c, own[c]) for c in columns]).alias("found"))
    leaves = _numbered(scratch.keep("leaves", rows), ["at", "node"], scratch, "ranged")
    members = leaves.select("key", "n", "idx", "node", "at", "found")
    tree = _Tree(members, fan, scratch, "blocks")
    subroots = _numbered(tree.roots().select(F.lit("").alias("key"), F.col("key").alias("name"), "node"), ["name"], scratch, "subroots")
    over = _Tree(subroots.select("key", "n", "idx", "node", "name"), fan, scratch, "over")
    none = F.array().cast("array<struct<before:string,after:string>>")
    inner = over.first_blocks(over.roots().select("key", none.alias("path"), F.col("node").alias("root")))
    per_group = inner.select("root", "path", F.explode(F.transform("members", lambda m: F.struct(
        m["name"].alias("key"), m["node"].alias("subroot"), _path((m["idx"] % over.width).cast("int"), fan).alias("own")))).alias("s")).select(
        "s.key", "s.subroot", "root", F.concat("s.own", "path").alias("path"))
    found = tree.first_blocks(per_group)

    def proved(m: Column) -> Column:
        path = F.concat(_path((m["idx"] % tree.width).cast("int"), fan), F.col("path"))
        return F.struct(m["at"].alias("at"), m["node"].alias("leaf"), F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256).alias("proof"),
                        F.aggregate(path, m["found"], lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]).cast("binary"), 256)).alias("folded"))

    each = found.select("subroot", "root", F.explode(F.transform("members", proved)).alias("m"))
    return each.select(
        F.col("m.at").alias(order), F.col("m.leaf").alias("leaf"), "subroot", "root", F.col("m.proof").alias("proof_sha256"), F.col("m.folded").alias("folded_root"),
        (F.col("m.folded") == F.col("root")).alias("verified"))
