import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, f long, row string, starts string, th string, did string, size string, place string, k string, g string, node string, part int, v_id int, lines string"


def corpus() -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, repeated rows, shared passages and lines."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdeéñß") for _ in range(r.randrange(1, 8))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", ",", "."]) for _ in range(n))
    passage, lines, base = say(60), "\n".join(say(6) for _ in range(3)), say(300)
    texts = [say(r.randrange(1, 120)) for _ in range(40)]
    texts += [f"{say(30)} {passage} {say(20)}" for _ in range(6)] + [f"{say(5)}\n{lines}\n{say(7)}" for _ in range(6)]
    texts += [base, base.upper(), base, base + " end", base.replace(",", "", 1)]
    texts += [None, "", "   \n\t ", None, "", say(30000), f"{passage} {passage} {passage}", "x\n\n\nx\ny\nx\ny", "### $$$ &&& " * 40]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", "é", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[40], (None, base, "en", "a", 5), (None, None, None, None, None), (12, "another text of one id", "en", "b", 3)]
    return [row + (1, 2) + ("x",) * 9 + (3, 4, "z") for row in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
