import random

import pytest

CLASHING = ["bit", "a", "b", "node", "rep", "lost", "size", "target", "score", "words", "g", "f", "marks", "label", "n", "n_dropped", "key", "component_id", "copies", "k"]


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefgimnorstu") for _ in range(rng.randint(2, 8))) for _ in range(600)]


@pytest.fixture(scope="session")
def odd_rows(vocabulary):
    """(doc_id, text, lang, source): nulls, empty and very long texts, ties, repeated rows, copies, shared lines and passages."""
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = text(120), text(60)
    edited = base.split()
    edited[60] = "changed"
    rows = [
        (1, base, "en", "s1"), (2, base, "en", "s1"), (2, base, "en", "s1"), (3, " ".join(edited), "en", None), (4, None, None, "s2"), (5, "", "fr", "s2"), (6, " \n\t ", "fr", "s2"),
        (7, "one two", "fr", "s3"), (8, "One  TWO", "fr", "s3"), (9, text(20) + " " + passage + " " + text(20), "de", "s3"), (10, passage + "\n" + text(30), "de", "s1"),
        (11, text(20000), "de", "s1"), (12, "x" * 50000, None, None), (None, base, None, None), (None, None, None, None), (13, "é ü　ñ 日本", "fr", "s9"), (14, "12 34 !!", None, "s9"),
    ]
    for i in range(20, 40):
        rows.append((i, text(30) + f"\nUpdated on day {i} by the editor of this page\n" + text(10) + f"\nThis was written by {rng.choice(vocabulary)}{rng.choice(vocabulary)} for the daily review", "en", "s1"))
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in odd_rows]
    df = spark.createDataFrame(rows, schema)
    for c in CLASHING:
        df = df.selectExpr("*", f"'x' AS {c}")
    return df.repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
