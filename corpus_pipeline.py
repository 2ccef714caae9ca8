"""A corpus pipeline of five stages: quality, line dedup, near dedup, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtables.llm import bpe, line_runs, mixing, quality, simhash
from webtables.llm._tables import Scratch
from webtables.llm.metric_join import Similarity
from webtables.llm.queries import tokenizer

#: Shingles of five words, of which near copies share 80 %. On 20,517 pairs of random texts with a similarity of 0.80 to 0.85 the
#: fingerprints differ in 21 of 64 and 49 of 192 bits at most; what these bounds propose is held against the texts.
NEAR = {"width": 5, "radius": 22, "most": 54, "similarity": Similarity(8, 10)}


# Tables of decisions grow with the corpus, so they meet the texts by a merge join at every size.


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, unchanged.

    Documents are known by doc_id and text. Null, empty and blank texts have under ten words and go. Null ids, languages
    and sources are values like others; rows that repeat a doc_id and a text stay or go together, also where their
    language or source differs. Texts of any length are read whole. Ties cannot arise: a verdict is a threshold. An empty table gives an
    empty result; other columns pass as they are, whatever their names.
    """
    out = quality.verdicts(docs).filter("kept").select(F.col("doc_id").alias("v_id"), F.col("th").alias("v_th")).distinct().hint("merge")
    th = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(out, docs["doc_id"].eqNullSafe(out["v_id"]) & (th == out["v_th"]), "left_semi")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; the later copies of repeated line runs and long lines are gone from their texts, n_chars is that of the text left.

    Null texts stay null, with a null n_chars; empty and blank ones have no line to lose. Of equal runs the one in the smallest doc_id stays
    (null ids last; of one id, the text with the smaller hash; inside a text, the first). Rows that repeat a doc_id and a text are one document
    and keep the same lines. A text may end up empty and stays a row. An empty table gives an empty result; other
    columns pass as they are, whatever their names.
    """
    return line_runs.drop_repeated_runs(docs, min_lines=2, long_words=20).drop("_lines").withColumn("n_chars", F.length("text").cast("long"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id, unchanged; of one doc_id, one text.

    Documents are known by doc_id and text, so another text under the same or no doc_id is a document of its own. Null,
    empty and blank texts are copies of each other. Rows that repeat a doc_id and a text stay or go together. An empty
    table gives an empty result; other columns pass as they are, whatever their names.
    """
    stay = simhash.near_copies(docs, **NEAR).filter("stays").select(F.col("doc_id").alias("v_id"), F.col("th").alias("v_th")).distinct().hint("merge")
    th = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["v_id"]) & (th == stay["v_th"]), "left_semi")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it.

    Null texts have size 0; documents of size 0 are never taken. Null sources are one source, the last. Documents of one place in the order of hashes are
    taken together. Rows that repeat a doc_id and source are each taken as often as the mix says. Texts of any length count whole. An empty
    table gives an empty result; other columns pass as they are, whatever their names.
    """
    taken = mixing.mix(docs).filter("taken > 0").select(
        F.col("doc_id").alias("v_id"), F.col("source").alias("v_source"), F.expr("taken div size").cast("int").alias("v_times")).distinct().hint("merge")
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no name of theirs clashes
    doc_id, source = (own[f"c{docs.columns.index(c)}"] for c in ("doc_id", "source"))
    joined = own.join(taken, doc_id.eqNullSafe(taken["v_id"]) & source.eqNullSafe(taken["v_source"]))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), "v_times"))).select(*own.columns).toDF(*docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes; one row per document taken.

    Null and empty texts have no tokens; ids may be null or repeat and come out as often as they come in; texts of any length are encoded
    whole; of two merges of one rank the left one is first. An empty table gives an empty result; other columns are not read.
    """
    return bpe.round_trip(docs, tokenizer())


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("mix", mix_stage), ("encode", encode_stage)]

#: The covariance steps and the fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
