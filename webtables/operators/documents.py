"""Documents: decode, score, cut into chapters, number, index and look up positions.

A document is one row, so decoding, scoring and cutting stay inside the row (JVM expressions, no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtables.functions._cols import ColumnLike, as_col, once, trim_control
from webtables.functions.text import one_line
from webtables.session import enable_decoders

# --- fixed value: a line that opens a chapter ---
HEADING = (
    "[\\s　]*("
    "(?:正文[\\s　]*)?第[\\s　]*[0-9０-９零一二三四五六七八九十百千万两〇]{1,10}"
    "[\\s　]*[章节節回卷集部篇话幕折]"
    "|[Cc]hapter[\\s　]+[0-9]{1,4}"
    "|(?:楔子|序章|序言|序曲|引子|前言|后记|尾声|终章|完本感言)"
    "|番外[\\s　]*[0-9一二三四五六七八九十]{0,4}"
    ")[\\s　]*[^\\n]{0,25}[\\s　]*"
)
PREFACE_NAME = "开始"


def decode_corpus(
    df: DataFrame, data: str = "content", hint: str | None = None, text: str = "text", encoding: str = "encoding"
) -> DataFrame:
    """Bytes to text: declared charset, else byte-order mark, else valid UTF-8, else GBK.

    A byte-order mark is not part of the text. Malformed input becomes U+FFFD.
    """
    enable_decoders(df.sparkSession)
    raw = F.col(data)
    declared = F.lower(F.trim(F.coalesce(F.col(hint), F.lit("")))) if hint else F.lit("")
    head = F.hex(F.substring(raw, 1, 3))
    mark = (
        F.when(head == "EFBBBF", "UTF-8-BOM")
        .when(head.startswith("FFFE"), "UTF-16LE")
        .when(head.startswith("FEFF"), "UTF-16BE")
    )
    kind = (
        F.when(declared.startswith("gb"), F.lit("GBK"))
        .when(declared.startswith("utf-16") | declared.startswith("utf16"), F.coalesce(mark, F.lit("UTF-16LE")))
        .when(declared.startswith("utf"), F.coalesce(F.when(mark == "UTF-8-BOM", mark), F.lit("UTF-8")))
        .when(mark.isNotNull(), mark)
        .when(F.is_valid_utf8(raw.cast("string")), F.lit("UTF-8"))
        .otherwise(F.lit("GBK"))
    )
    out = df.withColumn(encoding, kind)
    enc = F.col(encoding)
    decoded = (
        F.when(enc == "UTF-8", F.make_valid_utf8(raw.cast("string")))
        .when(enc == "UTF-8-BOM", F.make_valid_utf8(F.substring(raw, 4, 2147483647).cast("string")))
        .when(enc == "UTF-16LE", F.decode(_without_mark(raw, "FFFE"), "UTF-16LE"))
        .when(enc == "UTF-16BE", F.decode(_without_mark(raw, "FEFF"), "UTF-16BE"))
        .otherwise(F.decode(raw, "GBK"))
    )
    return out.withColumn(text, decoded)


def _without_mark(raw: Column, mark: str) -> Column:
    return F.when(F.hex(F.substring(raw, 1, 2)) == mark, F.substring(raw, 3, 2147483647)).otherwise(raw)


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))


def quality_score(col: ColumnLike) -> Column:
    """How plausible a decoded text is: weights per character class, null for empty text."""
    t = as_col(col)
    good = (
        2 * _count_of(t, "\\n\\r\\t") + _count_of(t, " -~")
        + 3 * _count_of(t, "\\x{4E00}-\\x{9FA5}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}")
    )
    bad = (
        30 * _count_of(t, "\\x{FFFD}") + 12 * _count_of(t, "\\x{3400}-\\x{4DBF}\\x{E000}-\\x{F8FF}")
        + 4 * _count_of(t, "\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F")
    )
    return F.when(F.length(t) > 0, (good - bad).cast("long"))


def decode_quality(df: DataFrame, text: str = "text", by: str = "source") -> DataFrame:
    """Score and replacement count aggregated per source."""
    scored = df.select(by, quality_score(text).alias("score"), _count_of(F.col(text), "\\x{FFFD}").alias("bad"))
    return scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum("score").alias("score"),
        F.min("score").alias("worst"),
        F.sum("bad").cast("long").alias("replacements"),
        F.count_if(F.col("bad") > 0).alias("damaged"),
    )


_BLOCK = 256


def _fold(sizes: Column, first: Column) -> Column:
    """Start offsets of consecutive pieces, beginning at ``first``, and the end of the last one."""
    return F.aggregate(sizes, F.array(first), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def _starts(sizes: str) -> Column:
    """Running start offsets of an array of sizes, folded block by block so that long arrays stay cheap."""
    zero = F.lit(0).cast("long")
    count = F.ceil(F.size(sizes) / _BLOCK).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda b: F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK))
    )
    before = _fold(F.transform(blocks, lambda blk: F.aggregate(blk, zero, lambda a, n: a + n)), zero)
    return F.flatten(
        F.transform(
            F.arrays_zip(blocks.alias("blk"), F.slice(before, 1, F.size(blocks)).alias("at")),
            lambda x: F.slice(_fold(x["blk"], x["at"]), 1, F.size(x["blk"])),
        )
    )


def _pieces(df: DataFrame, keep: tuple[str, ...], pieces: str) -> DataFrame:
    """One row per piece with its character range and its byte range in UTF-8, all inside the row."""
    chars = F.transform(pieces, lambda p: F.length(p).cast("long"))
    octets = F.transform(pieces, lambda p: F.octet_length(p).cast("long"))
    sized = df.select(*keep, once(_p=F.col(pieces), _n=chars, _o=octets))
    zipped = F.arrays_zip(
        F.col("_p").alias("text"), _starts("_n").alias("start"), F.col("_n").alias("n"),
        _starts("_o").alias("byte_offset"), F.col("_o").alias("byte_length"),
    )
    rows = sized.select(*keep, F.posexplode_outer(zipped).alias("idx", "x")).filter("idx is not null")
    end = F.col("x.start") + F.col("x.n")
    return rows.select(*keep, "idx", "x.text", "x.start", end.alias("end"), "x.byte_offset", "x.byte_length")


_RANGE = ["start", "end", "byte_offset", "byte_length", "text"]


def heading_pieces(text: ColumnLike, heading: str = HEADING) -> Column:
    """The text cut in front of every heading line; the first piece may be text before any heading."""
    pattern = f"(?m)(?:^{heading}$|\\A)(?s:.*?)(?=^{heading}$|\\z)"
    return F.regexp_extract_all(as_col(text), F.lit(pattern), F.lit(0))


def split_by_heading(
    df: DataFrame, text: str = "text", heading: str = HEADING, min_preface: int | None = None, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Chapters by heading lines: ``idx, name, start, end, byte_offset, byte_length, text``.

    Text before the first heading is a chapter of its own; ``min_preface`` drops it up to that length.
    Documents without a heading give no rows.
    """
    staged = df.select(*keep, once(_p=heading_pieces(text, heading)))
    opens = f"(?m)\\A({heading})$"
    headed = staged.filter((F.size("_p") > 1) | F.element_at("_p", 1).rlike(opens))
    head = F.element_at("_p", 1)
    short = F.lit(False) if min_preface is None else ~head.rlike(opens) & (F.length(head) <= min_preface)
    skipped = F.when(short, F.octet_length(head)).otherwise(0)
    marked = headed.select(*keep, "_p", short.cast("int").alias("_drop"), skipped.alias("_skip"))
    rows = _pieces(marked, (*keep, "_drop", "_skip"), "_p")
    kept = rows.filter("idx >= _drop").withColumn("_h", F.regexp_extract("text", opens, 1))
    name = F.when(F.col("_h") == "", F.lit(PREFACE_NAME)).otherwise(trim_control(F.col("_h")))
    return _placed(kept, keep, name)


def _placed(rows: DataFrame, keep: tuple[str, ...], name: Column, *more: str) -> DataFrame:
    """Positions and byte offsets counted from the first piece that was kept."""
    return rows.select(
        *keep, *more, (F.col("idx") - F.col("_drop")).alias("idx"), name.alias("name"), "start", "end",
        (F.col("byte_offset") - F.col("_skip")).alias("byte_offset"), "byte_length", "text",
    )


def chunk_pieces(text: ColumnLike, size: int = 6000, slack: int = 1500) -> Column:
    """Consecutive pieces of ``size`` characters, each extended through a line break less than ``slack`` away."""
    pattern = f"(?s).{{{size}}}(?:[^\\n]{{0,{slack - 1}}}+\\n)?|.+"
    return F.regexp_extract_all(as_col(text), F.lit(pattern), F.lit(0))


def split_by_chunk(
    df: DataFrame, text: str = "text", size: int = 6000, slack: int = 1500, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Fixed chunks with empty names; the slices concatenate to the text."""
    staged = df.select(*keep, once(_c=chunk_pieces(text, size, slack)))
    cut = _pieces(staged, keep, "_c")
    return cut.select(*keep, "idx", F.lit("").alias("name"), *_RANGE)


def split_documents(
    df: DataFrame, text: str = "text", heading: str = HEADING, min_preface: int | None = None, size: int = 6000,
    slack: int = 1500, whole_up_to: int | None = None, keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Headings when they give at least two pieces, else chunks; one pass, decided inside the row.

    ``whole_up_to`` leaves shorter texts (archive sections) uncut.
    """
    opens = f"(?m)\\A({heading})$"
    staged = df.select(*keep, once(_t=F.col(text), _h=heading_pieces(text, heading))).withColumnRenamed("_h", "_p")
    head = F.element_at("_p", 1)
    drop = F.lit(False) if min_preface is None else ~head.rlike(opens) & (F.length(head) <= min_preface)
    staged = staged.filter(F.length("_t") > 0).withColumn("_short", drop.cast("int"))
    by_heading = F.size("_p") - F.col("_short") >= 2
    whole = F.lit(False) if whole_up_to is None else F.length("_t") <= whole_up_to
    mode = F.when(whole, "whole").when(by_heading, "heading").otherwise("chunk")
    staged = staged.withColumn("mode", mode)
    chosen = (
        F.when(F.col("mode") == "whole", F.array("_t"))
        .when(F.col("mode") == "heading", F.col("_p"))
        .otherwise(chunk_pieces("_t", size, slack))
    )
    dropped = F.when(F.col("mode") == "heading", F.col("_short")).otherwise(0)
    skipped = F.when(dropped == 1, F.octet_length(head)).otherwise(0)
    marked = staged.select(*keep, "mode", once(_drop=dropped, _skip=skipped, _c=chosen))
    rows = _pieces(marked, (*keep, "mode", "_drop", "_skip"), "_c").filter("idx >= _drop")
    found = F.regexp_extract("text", opens, 1)
    label = F.when(found == "", F.lit(PREFACE_NAME)).otherwise(trim_control(found))
    name = F.when(F.col("mode") == "heading", label).otherwise(F.lit(""))
    return _placed(rows, keep, name, "mode")


def number_chapters(df: DataFrame, doc: str = "doc_id", idx: str = "idx", name: str = "name") -> DataFrame:
    """Unnamed chapters get running numbers over the whole document; named ones keep their name."""
    order = Window.partitionBy(doc).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    clean = one_line(F.coalesce(F.col(name), F.lit("")))
    number = F.sum(F.when(clean == "", 1).otherwise(0)).over(order)
    label = F.concat(F.lit("第 "), number.cast("string"), F.lit(" 节"))
    return df.withColumn(name, F.when(clean == "", label).otherwise(clean))


def index_chapters(df: DataFrame, doc: str = "doc_id", idx: str = "idx", text: str = "text") -> DataFrame:
    """Running UTF-8 byte offset and length of every chapter; empty chapters are left out.

    For chapters from elsewhere: the splitters of this module already give byte ranges without a shuffle.
    """
    before = Window.partitionBy(doc).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    sized = df.filter(F.length(text) > 0).withColumn("byte_length", F.octet_length(text).cast("long"))
    return sized.withColumn("byte_offset", F.coalesce(F.sum("byte_length").over(before), F.lit(0).cast("long")))


def locate(offsets: DataFrame, segments: DataFrame, doc: str = "doc_id", offset: str = "offset") -> DataFrame:
    """The segment with the greatest start not beyond each offset, else the first segment.

    Starts and offsets of a document are put in one order; each offset takes the last start before it. One sort,
    whatever the number of offsets, and no copy of the starts.
    """
    starts = segments.select(F.col(doc), F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.struct("start", "idx").alias("_s"))
    asked = offsets.select("*", F.col(offset).alias("_at"), F.lit(1).alias("_kind"))
    both = asked.unionByName(starts, allowMissingColumns=True)
    whole = Window.partitionBy(doc)
    upto = whole.orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_hit", F.coalesce(F.last("_s", ignorenulls=True).over(upto), F.min("_s").over(whole)))
    kept = found.filter("_kind = 1 AND _hit IS NOT NULL")
    return kept.select(*offsets.columns, F.col("_hit.idx").alias("idx"), F.col("_hit.start").alias("start"))


def slice_segments(documents: DataFrame, segments: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Text of each segment from its start to the next start (or the end), its lines and the document's maximum.

    The segments of a document come to its text, which is cut inside that row and leaves it in pieces.
    """
    listed = segments.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("start", F.struct(*segments.columns).alias("own")))).alias("_s"))
    joined = documents.select(doc, F.col(text).alias("_t")).join(listed, doc)

    def piece(x: Column, i: Column) -> Column:
        end = F.least(F.coalesce(F.get("_s", i + 1)["start"], F.length("_t")), F.length("_t"))
        begin = F.greatest(x["start"], F.lit(0))
        part = F.when(end > begin, F.substring(F.col("_t"), (begin + 1).cast("int"), (end - begin).cast("int"))).otherwise(F.lit(""))
        return F.struct(x["own"].alias("own"), part.alias("segment"))

    def sized(x: Column) -> Column:
        lines = F.when(x["segment"] == "", 0).otherwise(F.size(F.split(F.regexp_replace(x["segment"], "\n$", ""), "\n", -1)))
        return F.struct(x["own"].alias("own"), x["segment"].alias("segment"), lines.alias("lines"))

    cut = joined.select(once(_p=F.transform("_s", piece))).select(once(_p=F.transform("_p", sized)))
    rows = cut.select(F.array_max(F.transform("_p", lambda x: x["lines"])).alias("max_lines"), F.explode("_p").alias("_x"))
    return rows.select("_x.own.*", "_x.segment", "_x.lines", "max_lines")
