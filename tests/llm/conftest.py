"""Small awkward inputs shared by the tests of the training-data operators."""

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, taken long, row string, parts string, "
          "fingerprint string, spans string, uid long, text_key long, failed long, score double")


def prose(seed, n):
    rng = random.Random(seed)
    parts = ["the", "tion", "an", "er", "ing", "ha", "ble", "or", "es", "ed", "é", "ß"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", "\n", ". ", "\t", " \x0b"]) for w in words)


def awkward_rows():
    """(doc_id, text, source): nulls, blanks, copies, near copies, ties, repeated rows, a long text."""
    shared = prose(1, 60)
    rows = [(1, None, "b"), (2, "", "a"), (3, " \n\t ", None), (4, "word", "b"), (5, "a b c d e", "B"), (None, "no id here at all", "a"),
            (None, None, None), (7, shared, "é"), (8, shared, "z"), (8, shared, "z"), (9, shared + " more", "z"), (10, prose(2, 40) + shared, "a"),
            (11, "same same same same same same same same same same same same", "a"), (8, "another text of the same id", "z"),
            (12, prose(3, 6000), "a"), (13, "x" * 5000, None), (14, shared.upper(), "b"), (-5, prose(4, 30), "a"),
            (15, "<|endoftext|> and  two  spaces   \x1c end ", "b"), (16, "ab\r\ncd ef", "b")]
    return rows + [(20 + i, prose(100 + i % 17, 5 + i * 3), f"s{i % 4}") for i in range(60)]


def as_documents(spark, rows):
    full = [(i, t, "en", s, None if t is None else len(t), 7, 7, "r", "p", "f", "s", 7, 7, 7, 0.5) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    as_documents(spark, rows).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "empty.parquet")
    docs.limit(0).write.parquet(path)
    return spark.read.parquet(path)


def ordered(frame_or_rows):
    found = frame_or_rows.collect() if hasattr(frame_or_rows, "collect") else frame_or_rows
    return sorted((tuple(r) for r in found), key=repr)
