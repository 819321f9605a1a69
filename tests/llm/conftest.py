import pytest

#: Names that operators use inside; a table may have them too.
CLASHES = {"row": 1, "tid": "x", "n": 2, "labels": "y", "of": 3, "hash": 4, "size": 5, "words": 6, "threshold": 7, "plan_source": "z", "o": 8, "media": "m", "report": "r", "root": "q", "other": 9, "copies": 1, "base": 2, "start": 3, "score": 0.5, "payload": "p", "digest": "d", "first": 1}
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)] + str((seed * 31 + i) % 97) for i in range(n))


EDGE = [
    (0, prose(1, 80), "en", "a", 10),
    (1, prose(1, 80), "en", "a", 10),
    (2, prose(1, 79) + " changed", None, "b", None),
    (3, None, "en", "b", 5),
    (4, "", "en", None, 0),
    (5, "   \n\t ", "en", None, 0),
    (6, "two words", "en", "c", 9),
    (7, prose(2, 30_000), "en", "c", 1),
    (8, "日本語 のテキスト é ß 🙂 <|endoftext|> don't", "ja", "c", 1),
    (None, prose(3, 60), "en", "a", 1),
    (9, prose(4, 60), "en", "é", 1),
    (9, prose(4, 60), "en", "é", 1),
    (9, prose(5, 60), "en", "é", 1),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    df = df.withColumns({k: F.lit(v) for k, v in CLASHES.items()})
    path = "/tmp/braidql-test-docs.parquet"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
