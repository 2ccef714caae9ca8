"""Exact dedup: 128-bit content hashes name the groups, bytes decide inside them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtables.llm._tables import Scratch, pieces, raw_texts

ROW = ["doc_id", "h", "text_sha256"]


def _hashed(hash_bits: int, with_text: bool):
    size = (hash_bits + 7) // 8
    spare = size * 8 - hash_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [t.lower() for t in raw_texts(batch)]  # bytes.lower() changes A-Z only
            keys = [xxhash.xxh3_128_digest(t)[:size] for t in texts]
            if spare:
                keys = [k[:-1] + bytes([k[-1] >> spare << spare]) for k in keys]
            out = [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
            names = list(ROW)
            if with_text:
                out, names = [*out, pa.array(texts, pa.binary())], [*names, "norm"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def exact_groups(docs: DataFrame, keep: str = "smallest", hash_bits: int = 128) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Documents meet by a
    128-bit hash of the normalised text; inside a hash group every text is compared, byte for byte, with that of
    the row that stays, and what differs forms groups of its own in a further round. ``hash_bits`` shortens the
    hash to test that.

    Rows that repeat a doc_id with an equal text are one document and come out once. A doc_id with several texts
    is several documents. A null doc_id never stays unless all ids of its group are null. An empty table gives
    an empty result; further columns of ``docs`` are not read.

    Groups are counted with partial sums, so a hot text reaches the shuffle as one row per task. Only rows of
    groups with two or more rows bring their text to a join, whose hot keys Spark may split.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    pick = F.min if keep == "smallest" else F.max
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_sha256"))
    nameless = F.min(F.struct("doc_id", "text_sha256"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep("rows", docs.mapInArrow(_hashed(hash_bits, False), "doc_id long, h binary, text_sha256 string").distinct())
    texts = docs.mapInArrow(_hashed(hash_bits, True), "doc_id long, h binary, text_sha256 string, norm binary")

    def same(a: DataFrame, b: DataFrame):
        return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h"] == b["h"]) & (a["text_sha256"] == b["text_sha256"])

    settled, rest, turn = [], rows, 0
    while True:
        groups = rest.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.coalesce(pick(named), nameless).alias("first"))
        shared = groups.filter("n > 1").select(F.col("h").alias("gh"), "first")
        suspects = rest.join(shared, rest["h"] == shared["gh"]).select(
            *ROW, F.struct("doc_id", "text_sha256").eqNullSafe(F.col("first")).alias("stays"))
        found = texts.join(suspects, same(texts, suspects)).select(*[suspects[c] for c in (*ROW, "stays")], texts["norm"])
        found = scratch.keep(f"texts{turn}", found)
        first = found.filter("stays").dropDuplicates(["h"]).select(F.col("h").alias("fh"), F.col("norm").alias("first_norm"))
        other = scratch.keep(f"other{turn}", found.join(first, found["h"] == first["fh"]).filter("norm != first_norm").select(*ROW).distinct())
        scratch.drop(f"texts{turn}")
        if other.isEmpty():
            settled.append(rest.withColumn("turn", F.lit(turn)))
            break
        settled.append(rest.join(other, same(rest, other), "left_anti").withColumn("turn", F.lit(turn)))
        rest, turn = other, turn + 1

    rows = settled[0]
    for more in settled[1:]:
        rows = rows.unionByName(more)
    groups = rows.groupBy(F.col("h").alias("gh"), F.col("turn").alias("gturn")).agg(
        F.count(F.lit(1)).alias("group_size"), pick("doc_id").alias("keep_id"))
    return rows.join(groups, (rows["h"] == groups["gh"]) & (rows["turn"] == groups["gturn"])).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
