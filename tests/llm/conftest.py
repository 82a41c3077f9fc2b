import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, words: list[str]) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Rows of documents with copies, near copies, shared passages, nulls, empties, a very long text, repeated rows."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    passage = prose(rng, 70, words)
    rows = []
    for i in range(60):
        text = prose(rng, rng.randint(5, 200), words)
        if i % 7 == 0:
            text += "\n" + passage + " " + prose(rng, 20, words)
        if i % 9 == 0:
            text = text.upper() + "!!\t£ é x"
        rows.append((i, text, ("en", "fr", None)[i % 3], "s", len(text)))
    for i in range(60, 75):
        part = rows[i - 60][1].split(" ")
        if i % 2:
            part[len(part) // 2] = "changed"
        rows.append((i, " ".join(part), "en", "t", 1))
    rows += [(75, None, None, None, None), (76, "", "en", "s", 0), (77, " \n\t ", "en", "s", 0), (78, "one", "en", "s", 3), (79, "line\nline\nline", "en", "s", 3), (None, rows[3][1], "en", "s", 3), (None, None, None, None, None)]
    rows += [rows[5], rows[5], (80, prose(rng, 30_000, words), "en", "s", 1), (81, "a" * 50_000, "en", "s", 1), (82, rows[10][1], "en", "s", 1), (5, "another text of the same id", "en", "s", 1)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus over several partitions, with columns whose names operators use inside."""
    df = spark.createDataFrame(corpus, COLUMNS).repartition(3, "doc_id")
    return df.selectExpr("*", "1 AS k1_", "'x' AS f_", "2 AS id_", "3 AS text_", "4 AS spans_", "5 AS hit_words_")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
