"""Queries over documents and titles: decoding, cutting, normalising."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.functions import text as T
from webtables.operators import documents as D
from webtables.operators.extract import fill_missing
from webtables.plans.proxies import HITS, Catalog, hits, table
from webtables.session import new_folder, settle
from webtables.sources.files import read_documents, write_chapters

catalog = Catalog()
HEADING = "[A-Z][^\\n]{0,40}"  # short capitalised lines stand in for chapter headings

_CHUNKS = """WITH RECURSIVE cut AS (
  SELECT doc_id, text, 0 AS idx, 0 AS s, {first} AS e FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, idx + 1, e, {next} FROM cut WHERE e < length(text))"""


def _cut_sql(start: str) -> str:
    end = f"({start} + 6000)"
    near = f"strpos(substr(text, {end} + 1, 1500), chr(10))"
    return f"CASE WHEN {end} >= length(text) THEN length(text) ELSE {end} + {near} END"


CHUNKS = _CHUNKS.format(first=_cut_sql("0"), next=_cut_sql("e"))

HEADED = """WITH RECURSIVE l AS (
  SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line, len(x) AS lines
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE length(text) > 0)), f AS (
  SELECT *, CAST(regexp_full_match(line, '[A-Z][^\\n]{0,40}') AS INT) AS flag,
         coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs
  FROM l), g AS (
  SELECT *, sum(flag) OVER (PARTITION BY doc_id ORDER BY i) AS chap FROM f), pieces AS (
  SELECT doc_id, chap, CAST(min(ofs) AS BIGINT) AS start, arg_min(line, i) AS head,
         string_agg(line, chr(10) ORDER BY i) || CASE WHEN max(i) + 1 < max(lines) THEN chr(10) ELSE '' END AS text
  FROM g GROUP BY doc_id, chap), headed AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chap) - 1 AS idx,
         CASE WHEN chap = 0 THEN '开始' ELSE trim(head) END AS name, start, start + length(text) AS "end", text
  FROM pieces WHERE doc_id IN (SELECT doc_id FROM pieces WHERE chap > 0))"""

_BOTH = HEADED + CHUNKS.replace("WITH RECURSIVE", ",") + """, many AS (
  SELECT doc_id FROM headed GROUP BY doc_id HAVING count(*) >= 2), split AS (
  SELECT doc_id, 'heading' AS mode, idx, name, start, "end", text FROM headed WHERE doc_id IN (SELECT doc_id FROM many)
  UNION ALL SELECT doc_id, 'chunk', idx, '', s, e, substr(text, s + 1, e - s) FROM cut
  WHERE doc_id NOT IN (SELECT doc_id FROM many))"""


def _documents(spark, sf, *columns):
    return table(spark, sf, "documents").select(*columns)


def _longs(df, *names):
    for n in names:
        df = df.withColumn(n, F.col(n).cast("long"))
    return df


@catalog.add("d01_decode_corpus", """
SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'UTF-8-BOM' ELSE 'UTF-16LE' END AS encoding FROM documents""")
def decode_corpus(spark, sf):
    kind = F.col("doc_id") % 3
    utf8 = F.encode("text", "UTF-8")
    data = (
        F.when(kind == 0, utf8)
        .when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8))
        .otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
    )
    files = _documents(spark, sf, "doc_id", data.alias("content"))
    return D.decode_corpus(files).select("doc_id", "text", "encoding")


def _n(chars: str) -> str:
    return f"(length(text) - length(regexp_replace(text, '[{chars}]', '', 'g')))"


_GOOD = f"2 * {_n(chr(92)+'n'+chr(92)+'r'+chr(92)+'t')} + {_n(' -~')} + 3 * {_n('\\x{4E00}-\\x{9FA5}')} + 3 * {_n('\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}')}"
_BAD = f"30 * {_n('\\x{FFFD}')} + 12 * {_n('\\x{3400}-\\x{4DBF}\\x{E000}-\\x{F8FF}')} + 4 * {_n('\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F')}"


@catalog.add("d02_decode_quality", f"""
SELECT source, count(*) AS docs, CAST(sum(score) AS BIGINT) AS score, CAST(min(score) AS BIGINT) AS worst,
       CAST(sum(bad) AS BIGINT) AS replacements, count(*) FILTER (bad > 0) AS damaged FROM (
  SELECT source, CASE WHEN length(text) > 0 THEN {_GOOD} - ({_BAD}) END AS score, {_n('\\x{FFFD}')} AS bad FROM documents)
GROUP BY source""")
def decode_quality(spark, sf):
    return D.decode_quality(_documents(spark, sf, "source", "text"))


@catalog.add("d03_split_by_heading", HEADED + ' SELECT doc_id, idx, name, start, "end", text FROM headed')
def split_by_heading(spark, sf):
    cut = D.split_by_heading(_documents(spark, sf, "doc_id", "text"), heading=HEADING)
    return _longs(cut, "idx").drop("byte_offset", "byte_length")


@catalog.add("d04_split_by_chunk", CHUNKS + """
SELECT doc_id, CAST(idx AS BIGINT) AS idx, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", substr(text, s + 1, e - s) AS text FROM cut""")
def split_by_chunk(spark, sf):
    return _longs(D.split_by_chunk(_documents(spark, sf, "doc_id", "text")), "idx").drop("name", "byte_offset", "byte_length")


@catalog.add("d05_split_documents", _BOTH + """
SELECT doc_id, mode, CAST(idx AS BIGINT) AS idx, name, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM split""")
def split_documents(spark, sf):
    cut = D.split_documents(_documents(spark, sf, "doc_id", "text"), heading=HEADING)
    return _longs(cut, "idx").drop("text", "byte_offset", "byte_length")


@catalog.add("d06_number_chapters", _BOTH + """
SELECT doc_id, CAST(idx AS BIGINT) AS idx, CASE WHEN name <> '' THEN name ELSE '第 ' ||
  sum(CASE WHEN name = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) || ' 节' END AS name FROM split""")
def number_chapters(spark, sf):
    cut = D.split_documents(_documents(spark, sf, "doc_id", "text"), heading=HEADING)
    return _longs(D.number_chapters(cut.select("doc_id", "idx", "name")), "idx")


@catalog.add("d07_locate_positions", CHUNKS + """
SELECT d.doc_id, n_chars // 2 AS "offset", CAST(max(s) AS BIGINT) AS start, CAST(max(idx) AS BIGINT) AS idx
FROM documents d JOIN cut c ON c.doc_id = d.doc_id AND c.s <= n_chars // 2 GROUP BY 1, 2""")
def locate_positions(spark, sf):
    docs = _documents(spark, sf, "doc_id", "text", F.floor(F.col("n_chars") / 2).cast("long").alias("offset"))
    segments = D.split_by_chunk(docs).select("doc_id", "idx", "start")
    return _longs(D.locate(docs.select("doc_id", "offset"), segments), "idx")


@catalog.add("d08_segment_lines", CHUNKS + """, seg AS (
SELECT doc_id, idx, substr(text, s + 1, e - s) AS t FROM cut), n AS (
SELECT doc_id, idx, length(t) AS chars, len(string_split(regexp_replace(t, '\\n$', ''), chr(10))) AS lines FROM seg)
SELECT doc_id, CAST(idx AS BIGINT) AS idx, CAST(chars AS BIGINT) AS chars, CAST(lines AS BIGINT) AS lines,
       CAST(max(lines) OVER (PARTITION BY doc_id) AS BIGINT) AS max_lines FROM n""")
def segment_lines(spark, sf):
    docs = _documents(spark, sf, "doc_id", "text")
    segments = D.split_by_chunk(docs).select("doc_id", "idx", "start")
    out = D.slice_segments(docs, segments).select("doc_id", "idx", F.length("segment").alias("chars"), "lines", "max_lines")
    return _longs(out, "idx", "chars", "lines", "max_lines")


@catalog.add("s11_chapter_byte_index", CHUNKS + """, seg AS (SELECT doc_id, idx, strlen(substr(text, s + 1, e - s)) AS n FROM cut)
SELECT doc_id, CAST(idx AS BIGINT) AS idx, CAST(n AS BIGINT) AS byte_length,
  CAST(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM seg""")
def chapter_byte_index(spark, sf):
    chapters = D.split_by_chunk(_documents(spark, sf, "doc_id", "text"))
    return _longs(chapters.select("doc_id", "idx", "byte_length", "byte_offset"), "idx")


@catalog.add("s11_write_read", catalog.sql["s11_chapter_byte_index"])
def chapters_written_and_read(spark, sf):
    folder = new_folder(spark, "chapters")
    write_chapters(D.split_by_chunk(_documents(spark, sf, "doc_id", "text")), folder)
    return _longs(spark.read.parquet(folder).select("doc_id", "idx", "byte_length", "byte_offset"), "idx")


@catalog.add("s10_read_documents", """
SELECT 'txt' AS format, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents
WHERE text IS NOT NULL""")
def documents_from_files(spark, sf):
    folder = new_folder(spark, "texts")
    _documents(spark, sf, "text").filter("text IS NOT NULL").write.text(folder)
    files = read_documents(spark, folder)
    lines = F.size(F.split(F.col("content").cast("string"), "\n", -1)) - 1  # the writer ends every text with a line break
    return files.groupBy("format").agg(F.sum(lines).cast("long").alias("lines"), F.sum("length").cast("long").alias("bytes"))


@catalog.add("s11_headed_byte_index", HEADED + """
SELECT doc_id, idx, CAST(strlen(text) AS BIGINT) AS byte_length, CAST(coalesce(sum(strlen(text)) OVER (
  PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM headed""")
def headed_byte_index(spark, sf):
    cut = D.split_by_heading(_documents(spark, sf, "doc_id", "text"), heading=HEADING)
    again = D.index_chapters(cut.select("doc_id", "idx", "text")).select("doc_id", "idx", "byte_offset")
    both = cut.select("doc_id", "idx", "byte_length", "byte_offset").join(again, ["doc_id", "idx", "byte_offset"])
    return _longs(both, "idx")


# ------------------------------------------------------------------ text columns

_SQUASH = "trim(regexp_replace(x, '[ \\t\u00a0\u3000\\v]+', ' ', 'g'))"
_TIDY = (
    f"regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: {_SQUASH}), chr(10)), "
    "'\\n\\n+', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')"
)


@catalog.add("p11_whitespace", f"""
SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n\u00a0]+', ' ', 'g')) AS collapsed, {_TIDY} AS tidied, text AS unified FROM documents""")
def whitespace(spark, sf):
    loud = F.concat(F.lit("\ufeff"), F.regexp_replace("text", "\n", "\r\n"))
    return _documents(spark, sf, "doc_id", T.collapse_ws("text").alias("collapsed"), T.tidy("text").alias("tidied"),
                      T.normalize_newlines(loud).alias("unified"))


_LINES = (
    "list_filter(list_transform(string_split(regexp_replace(text, '^\\s*\\S+[\\s\u3000\u00a0]+', ''), chr(10)), "
    "lambda x: regexp_replace(x, '^[\\x00-\\x20\u00a0\u3000]+|[\\x00-\\x20\u00a0\u3000]+$', '', 'g')), lambda x: x <> '')"
)


@catalog.add("p12_format_paragraphs", f"""
SELECT doc_id, array_to_string(list_concat([regexp_extract(text, '\\S+')], list_transform({_LINES}, lambda x: '\u3000\u3000' || x)), chr(10)) AS page
FROM documents WHERE regexp_matches(text, '\\S')""")
def format_paragraphs(spark, sf):
    docs = table(spark, sf, "documents").filter(F.col("text").rlike("\\S"))
    return docs.select("doc_id", T.format_paragraphs("text", F.regexp_extract("text", "\\S+", 0)).alias("page"))


@catalog.add("p13_title_and_author", """
SELECT p_partkey, p_name AS title, 'Ann' AS author, trim(p_name || ' - ' || p_brand) AS numbered FROM part""")
def title_and_author(spark, sf):
    part = table(spark, sf, "part")
    named = T.split_title_author(F.concat(F.lit("《"), "p_name", F.lit("》 (v2)[x] - 作者：Ann(t).txt")))
    numbered = T.split_title_author(F.concat("p_name", F.lit(" - "), "p_brand", F.lit(".txt")))
    return part.select("p_partkey", named["title"].alias("title"), named["author"].alias("author"),
                       numbered["title"].alias("numbered"))


@catalog.add("p14_replace_tail", """
SELECT doc_id, regexp_replace(text, '([aeiou])[ \\n]+', '\\1_', 'g') AS joined, text AS kept FROM documents""")
def replace_tail(spark, sf):
    return _documents(spark, sf, "doc_id", T.replace_tail("text", "([aeiou])[ \\n]+", "$1_").alias("joined"),
                      T.replace_tail("text", "([", "x").alias("kept"))


_KEY = "regexp_replace(lower(p_name), '[^\\p{L}\\p{Nd}]', '', 'g')"


@catalog.add("p09_title_key", f"""
SELECT {_KEY} AS key, count(*) AS works, count(*) FILTER ({_KEY} = 'redwidget') AS exact FROM part GROUP BY 1""")
def title_key(spark, sf):
    loud = F.concat(F.lit("《"), F.upper("p_name"), F.lit("》!"))
    part = table(spark, sf, "part")
    return part.groupBy(T.title_key(loud).alias("key")).agg(
        F.count(F.lit(1)).alias("works"), F.count_if(T.title_matches("p_name", F.lit("Red-Widget"))).alias("exact")
    )


@catalog.add("p15_subtitle", """
SELECT p_partkey, concat_ws('  |  ', p_brand, p_type, p_size || '字') AS subtitle FROM part""")
def subtitle(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", T.subtitle("p_brand", "p_type", F.col("p_size").cast("string"), F.lit("")).alias("subtitle")
    )


@catalog.add("p16_combinators", """
SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE p_name END AS first, p_name || p_brand AS everything,
       p_name || '/' || p_brand || '/' || p_type AS listed FROM part""")
def combinators(spark, sf):
    large = F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(F.lit(" "))
    return table(spark, sf, "part").select(
        "p_partkey", T.first_of(large, "p_name").alias("first"),
        T.concat_all("p_name", F.lit(None).cast("string"), "p_brand").alias("everything"),
        T.join_list(F.array("p_name", "p_brand", "p_type"), "/").alias("listed"),
    )


@catalog.add("p17_fill_missing", f"""
WITH {HITS}, s AS (SELECT *, lpad(CAST(line AS VARCHAR), 9, '0') || book_url AS pos FROM hits), r AS (
  SELECT run_id, max(name) AS name FROM s WHERE line > 1 GROUP BY run_id), k AS (
  SELECT run_id, name, regexp_replace(lower(name), '[^\\p{{L}}\\p{{Nd}}]', '', 'g') AS key FROM r), e AS (
  SELECT run_id, key, arg_min(author, pos) AS author, arg_min(kind, pos) AS kind FROM s GROUP BY 1, 2), f AS (
  SELECT run_id, arg_min(author, pos) AS author, arg_min(kind, pos) AS kind FROM s GROUP BY 1)
SELECT k.run_id, k.name, coalesce(e.author, f.author) AS author, CASE WHEN k.run_id % 2 = 0 THEN 'own' ELSE coalesce(e.kind, f.kind) END AS kind
FROM k LEFT JOIN e USING (run_id, key) LEFT JOIN f USING (run_id)""")
def fill_blanks(spark, sf):
    found = settle(hits(spark, sf))
    search = found.withColumn("pos", F.concat(F.lpad(F.col("line").cast("string"), 9, "0"), "book_url"))
    records = found.filter("line > 1").groupBy("run_id").agg(F.max("name").alias("name")).select(
        "run_id", "name", F.lit("").alias("author"),
        F.when(F.col("run_id") % 2 == 0, "own").otherwise("").alias("kind"),
    )
    return fill_missing(records, search, ["author", "kind"], ["run_id"])
