"""Documents: encodings, headings, chunks, numbering, byte ranges, lookups, files."""

import random

from pyspark.sql import functions as F

from webtables.operators import documents as D
from webtables.sources import files as SF

BODY = "第一章 起\n正文一\n第二章 承\n正文二二\n"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_decode(spark):
    raw = [
        (0, BODY.encode(), None), (1, b"\xef\xbb\xbf" + BODY.encode(), None), (2, b"\xff\xfe" + BODY.encode("utf-16-le"), None),
        (3, BODY.encode("gbk"), None), (4, b"\xfe\xff" + BODY.encode("utf-16-be"), None), (5, BODY.encode("gbk"), "GB2312"),
        (6, b"ok\xff", "utf-8"), (7, b"", None),
    ]
    df = spark.createDataFrame([(i, bytearray(b), h) for i, b, h in raw], "doc_id long, content binary, hint string")
    got = {r["doc_id"]: (r["text"], r["encoding"]) for r in D.decode_corpus(df, hint="hint").collect()}
    assert all(got[i][0] == BODY for i in range(6))
    assert [got[i][1] for i in range(8)] == ["UTF-8", "UTF-8-BOM", "UTF-16LE", "GBK", "UTF-16BE", "GBK", "UTF-8", "UTF-8"]
    assert got[6][0] == "ok\ufffd" and got[7][0] == ""


def test_quality(spark):
    df = docs(spark, "ab\n中。", "\ufffd\x01", "")
    assert [r[0] for r in df.select(D.quality_score("text")).collect()] == [2 + 2 + 3 + 3, -34, None]


def test_headings(spark):
    short, long = "序" * 150 + "\n", "序" * 250 + "\n"
    got = D.split_by_heading(docs(spark, BODY, short + BODY, long + BODY, "none\n", "\n\n" + BODY), min_preface=200).orderBy("doc_id", "idx").collect()
    by = lambda d: [(r["idx"], r["name"], r["start"], r["end"]) for r in got if r["doc_id"] == d]
    one = [(0, "第一章 起", 0, 10), (1, "第二章 承", 10, len(BODY))]
    assert by(0) == one
    assert by(1) == [(i, n, s + 151, e + 151) for i, n, s, e in one]
    assert by(2) == [(0, "开始", 0, 251)] + [(i + 1, n, s + 251, e + 251) for i, n, s, e in one]
    assert by(3) == []
    assert [r[1] for r in by(4)] == ["第一章 起", "第二章 承"] and by(4)[0][2] == 0


def test_split_policy(spark):
    got = D.split_documents(docs(spark, BODY, "第一章 起\nx\n", "x" * 7000, "")).orderBy("doc_id", "idx").collect()
    assert [(r["doc_id"], r["mode"], r["idx"]) for r in got] == [
        (0, "heading", 0), (0, "heading", 1), (1, "chunk", 0), (2, "chunk", 0), (2, "chunk", 1)]
    whole = D.split_documents(docs(spark, BODY), whole_up_to=20000).collect()
    assert [(r["mode"], r["text"]) for r in whole] == [("whole", BODY)]


def test_chunks(spark):
    text = "a" * 6200 + "\n" + "b" * 7799
    got = D.split_by_chunk(docs(spark, text)).orderBy("idx").collect()
    assert [(r["start"], r["end"]) for r in got] == [(0, 6201), (6201, 12201), (12201, 14000)]
    assert "".join(r["text"] for r in got) == text


def plain_chunks(text, n, slack):
    pos, out = 0, []
    while pos < len(text):
        end = pos + n
        if end >= len(text):
            end = len(text)
        else:
            nl = text.find("\n", end)
            if nl >= 0 and nl - end < slack:
                end = nl + 1
        out.append(text[pos:end])
        pos = end
    return out


def test_chunks_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab中\n" if rng.random() < 0.1 else "xyz") for _ in range(rng.randrange(400))) for _ in range(60)]
    got = D.split_by_chunk(docs(spark, *texts), size=20, slack=7).orderBy("doc_id", "idx").collect()
    for i, text in enumerate(texts):
        assert [r["text"] for r in got if r["doc_id"] == i] == plain_chunks(text, 20, 7)


def test_very_many_pieces(spark):
    text = "".join(f"第{i}章 x\n正文{i}\n" for i in range(1500))
    got = D.split_by_heading(docs(spark, text)).orderBy("idx").collect()
    assert len(got) == 1500 and "".join(r["text"] for r in got) == text
    assert all(text[r["start"]:r["end"]] == r["text"] for r in got)
    raw = text.encode()
    assert all(raw[r["byte_offset"]:r["byte_offset"] + r["byte_length"]].decode() == r["text"] for r in got)


def test_numbers_and_bytes(spark, tmp_path):
    rows = [(1, 0, "", "中a"), (1, 1, " named\n", "b"), (1, 2, None, "中"), (1, 3, "", ""), (2, 0, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, idx int, name string, text string")
    assert [r["name"] for r in D.number_chapters(df).orderBy("doc_id", "idx").collect()] == ["第 1 节", "named", "第 2 节", "第 3 节", "第 1 节"]
    got = D.index_chapters(df).orderBy("doc_id", "idx").collect()
    assert [(r["byte_offset"], r["byte_length"]) for r in got] == [(0, 4), (4, 1), (5, 3), (0, 1)]
    SF.write_chapters(df, str(tmp_path / "c"), buckets=4)
    hit = SF.read_chapter(spark, str(tmp_path / "c"), 1, 2, buckets=4).collect()
    assert [(r["text"], r["byte_offset"]) for r in hit] == [("中", 5)]


def test_lookup_and_slices(spark):
    seg = spark.createDataFrame([(1, 0, 5), (1, 1, 9), (1, 2, 12)], "doc_id long, idx int, start long")
    offs = spark.createDataFrame([(1, 0), (1, 9), (1, 11), (1, 99)], "doc_id long, offset long")
    assert {r["offset"]: r["idx"] for r in D.locate(offs, seg).collect()} == {0: 0, 9: 1, 11: 1, 99: 2}
    doc = docs(spark, "", "01234ab\nc\nxy")
    got = D.slice_segments(doc, seg).orderBy("idx").collect()
    assert [(r["segment"], r["lines"], r["max_lines"]) for r in got] == [("ab\nc", 2, 2), ("\nxy", 2, 2), ("", 0, 2)]


def test_document_files(spark, tmp_path):
    folder = tmp_path / "in" / "sub"
    folder.mkdir(parents=True)
    for name, data in {"A-Bo.txt": b"x", "b.HTML": b"<p>", "c.pdf": b"y", "empty.txt": b"", "big.txt": b"z" * 50}.items():
        (folder / name).write_bytes(data)
    got = SF.read_documents(spark, str(tmp_path / "in"), max_bytes=40).orderBy("title").collect()
    assert [(r["title"], r["author"], r["format"], r["content"] and bytes(r["content"]), r["reason"]) for r in got] == [
        ("A", "Bo", "txt", b"x", None), ("b", "", "html", b"<p>", None), ("big", "", "txt", None, "too large")]
    assert {bytes(r["content"]) for r in SF.read_documents(spark, str(tmp_path / "in")).collect()} == {b"x", b"<p>", b"z" * 50}


def test_reports(spark, tmp_path):
    lines = spark.createDataFrame([("VERDICT", "a", 1)], "kind string, site string, n int")
    SF.write_report(lines, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).orderBy(F.desc("value")).first()["value"] == "kind\tsite\tn"
    log = tmp_path / "log.txt"
    log.write_text("engine.search url=1\nengine.search -> 3 books\nengine.search -> 0 books\nnoise\nsearch done: x OVERFLOW\n")
    fields = SF.parse_log(SF.read_log(spark, str(log)), {"try": r"url=", "hits": r"-> (\d+) books", "over": "OVERFLOW"})
    got = {r["field"]: (r["matches"], r["positive"], r["total"]) for r in SF.log_summary(fields).collect()}
    assert got == {"try": (1, 0, None), "hits": (2, 1, 3.0), "over": (1, 0, None)}
