"""The corpus operators over the whole given tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtables.llm import bpe, chat, exact, kd_shards, line_runs, merkle, metric_join, mixing, ngram_lm, periodic, quality, simhash, suffix_tree

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer(name: str = VOCABULARY) -> bpe.Tokenizer:
    import public_tokenizers

    return bpe.Tokenizer.from_file(public_tokenizers.path(name), public_tokenizers.PATTERN)


def op1_mcd_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.verdicts(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op2_chat_parts(spark: SparkSession, sf: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    formatted = chat.format_turns(turns.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    return chat.digests(formatted).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


SQL_2 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)),
f AS (
  SELECT *, row_number() OVER w AS p,
    CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 4
      ELSE 20 + length(regexp_replace(role, '([\\<\[])', '\\\1', 'g')) END
    + length(regexp_replace(text, '([\\<\[])', '\\\1', 'g')) AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY p)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY p) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf, "documents"), keep="largest")


SQL_3 = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS n FROM documents),
g AS (SELECT n, max(doc_id) AS keep_id, count(*) AS group_size, sha256(n) AS text_sha256 FROM t GROUP BY n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (n)
"""


def op4_suffix_trees(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_tree.remove_repeats(table(spark, sf, "documents"), window=20).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL_4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 19], ' ')) AS h FROM w),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM k) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM c),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, len(d.ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op5_hash_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), weights=(1, 2, 3), most=3).drop("source")


SQL_5 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
o AS (
  SELECT *, row_number() OVER q AS i,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW q AS (ORDER BY cap::DOUBLE / w, source NULLS LAST)),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT min_by(level, i) FROM o WHERE cap >= level * w) * w) AS target FROM o),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
h AS (
  SELECT b.source, place, target - whole * source_size AS need, sum(size) AS n,
    sum(sum(size)) OVER (PARTITION BY b.source ORDER BY place) AS upto
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source GROUP BY b.source, place, target, whole, source_size),
c AS (
  SELECT source, max(place) AS last FROM h
  WHERE need > 0 AND (upto < need OR (upto - n < need AND upto - need <= need - (upto - n))) GROUP BY source)
SELECT d.doc_id, size, source_size, target, size * (whole + CASE WHEN place <= coalesce(last, -1) THEN 1 ELSE 0 END) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""


def op6_simhash_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf, "documents"), radius=4, width=4)


def op7_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"), tokenizer())


def op8_line_runs(spark: SparkSession, sf: str) -> DataFrame:
    return line_runs.drop_repeated_runs(table(spark, sf, "documents"), min_lines=2, long_words=20).select(
        "doc_id", "_lines.n_lines", "_lines.n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL_8 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS s FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
p AS (SELECT doc_id, s, line, lead(line) OVER (PARTITION BY doc_id ORDER BY s) AS following FROM c),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY line, following ORDER BY doc_id, s) AS n FROM p WHERE following IS NOT NULL),
o AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY line ORDER BY doc_id, s) AS n FROM c
  WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 20),
gone AS (SELECT DISTINCT doc_id, unnest([s, s + 1]) AS s FROM r WHERE n > 1 UNION SELECT doc_id, s FROM o WHERE n > 1),
lost AS (SELECT doc_id, i FROM c JOIN gone USING (doc_id, s)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n FROM l ANTI JOIN lost USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(ls)::BIGINT AS n_lines, len(ls) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op9_kd_shards(spark: SparkSession, sf: str) -> DataFrame:
    return kd_shards.kd_shards(table(spark, sf, "documents"), shards=40)


def op10_ngram_lm(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_lm.score_documents(table(spark, sf, "documents"))


def op11_metric_join(spark: SparkSession, sf: str) -> DataFrame:
    return metric_join.jaccard_groups(table(spark, sf, "documents"), width=3, similarity=metric_join.Similarity(90, 100))


SQL_11 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i : i + 2], ' ') FOR i IN range(1, len(ws) - 1)] END) AS hs FROM w),
u AS (SELECT doc_id, len(hs) AS n, unnest(hs) AS h FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM reach r JOIN p ON r.y = p.x)
SELECT s.doc_id, len(hs)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(y), s.doc_id)) AS component_id
FROM s LEFT JOIN reach ON x = s.doc_id GROUP BY s.doc_id, hs
"""


#: Unsigned crc32 of the doc_id as text: a step per bit.
CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[ord(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR b IN string_split(coalesce(doc_id::VARCHAR, ''), '') IF b <> ''])), "
    "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"
)


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return periodic.summary(periodic.periodic_runs(docs.select("doc_id", periodic.planted(docs["doc_id"], docs["text"]).alias("text"))))


SQL_12 = rf"""
WITH a AS (SELECT *, row_number() OVER () AS r, {CRC} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT r, doc_id, ws, h, len(ws) AS n, h // 10 AS g FROM a),
c AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS s FROM b),
e AS (SELECT *, CASE WHEN n > 0 THEN 1 + (n - s) // (3 + g % 8) END AS p FROM c),
d AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [ws[CASE WHEN i < s THEN i ELSE s + (i - s) % p END + 1] FOR i IN range(n)] ELSE ws END AS ws FROM e),
w AS (SELECT r, n, unnest(ws) AS word, unnest(range(n)) AS i FROM d),
o AS (SELECT * FROM w QUALIFY count(*) OVER (PARTITION BY r, word) >= 4),
m AS (SELECT x.r, y.i - x.i AS q, x.i FROM o x JOIN o y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
k AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m),
t AS (SELECT r, min(i) AS start, count(*) + q AS length, q FROM k GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
f AS (SELECT r, start, length, min(q) AS period FROM t GROUP BY r, start, length),
best AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) = 1),
said AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM f GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM f),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (r) LEFT JOIN said USING (r) LEFT JOIN kept USING (r)
"""


def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    tampered = F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))) % 2 == 0
    return merkle.manifest(docs, now={"text": F.when(tampered, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])})


def _item(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _leaf(*columns: str) -> str:
    return f"sha256({' || '.join(map(_item, columns))})"


SQL_13 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_leaf("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
    CASE WHEN {CRC} % 2 = 0 THEN {_leaf("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')")}
      ELSE {_leaf("doc_id", "source", "lang", "n_chars", "text")} END AS found
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
up AS (
  SELECT source, 0 AS lvl, i, n, leaf AS node FROM placed
  UNION ALL
  SELECT source, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY source, lvl, i // 3, n),
subs AS (
  SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
high AS (
  SELECT 0 AS lvl, i, n, node FROM subs
  UNION ALL
  SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY lvl, i // 3, n),
side AS (
  SELECT *, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
    coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a
  FROM up WHERE n > 1 WINDOW w AS (PARTITION BY source, lvl, i // 3 ORDER BY i)),
over AS (
  SELECT *, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
    coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a
  FROM high WHERE n > 1 WINDOW w AS (PARTITION BY lvl, i // 3 ORDER BY i)),
steps AS (
  SELECT p.source, p.i, s.lvl, s.b, s.a FROM placed p JOIN side s ON s.source IS NOT DISTINCT FROM p.source AND s.i = p.i // (3 ** s.lvl)::BIGINT
  UNION ALL
  SELECT p.source, p.i, 1000 + o.lvl, o.b, o.a FROM placed p JOIN subs ON subs.source IS NOT DISTINCT FROM p.source
    JOIN over o ON o.i = subs.i // (3 ** o.lvl)::BIGINT),
paths AS (
  SELECT source, i, sha256(string_agg(b || a, '' ORDER BY lvl)) AS proof, list({{'b': b, 'a': a}} ORDER BY lvl) AS path FROM steps GROUP BY source, i),
fold AS (
  SELECT p.source, p.i, 0 AS k, p.found AS cur, path FROM placed p LEFT JOIN paths q ON q.source IS NOT DISTINCT FROM p.source AND q.i = p.i
  UNION ALL
  SELECT source, i, k + 1, sha256(path[k + 1].b || cur || path[k + 1].a), path FROM fold WHERE k < len(path)),
folded AS (SELECT source, i, cur FROM fold WHERE k = coalesce(len(path), 0)),
root AS (SELECT node FROM high WHERE n = 1)
SELECT p.doc_id, p.leaf, subs.node AS subroot, root.node AS root, coalesce(q.proof, sha256('')) AS proof_sha256, f.cur AS folded_root, f.cur = root.node AS verified
FROM placed p JOIN subs ON subs.source IS NOT DISTINCT FROM p.source CROSS JOIN root
  JOIN folded f ON f.source IS NOT DISTINCT FROM p.source AND f.i = p.i
  LEFT JOIN paths q ON q.source IS NOT DISTINCT FROM p.source AND q.i = p.i
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mcd_quality": op1_mcd_quality,
    "op2_chat_parts": op2_chat_parts,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_suffix_trees": op4_suffix_trees,
    "op5_hash_mix": op5_hash_mix,
    "op6_simhash_tiles": op6_simhash_tiles,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_line_runs": op8_line_runs,
    "op9_kd_shards": op9_kd_shards,
    "op10_ngram_lm": op10_ngram_lm,
    "op11_metric_join": op11_metric_join,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}
SQL: dict[str, str] = {
    "op2_chat_parts": SQL_2, "op3_exact_dedup": SQL_3, "op4_suffix_trees": SQL_4, "op5_hash_mix": SQL_5, "op8_line_runs": SQL_8,
    "op11_metric_join": SQL_11, "op12_periodic_runs": SQL_12, "op13_merkle_manifest": SQL_13,
}
