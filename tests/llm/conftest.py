"""Small documents with every odd case: NULLs in any column, empty, blank and long texts, ties, repeated rows, clashing names."""

import pytest
from pyspark.sql import functions as F

PROSE = [f"w{i * 7 % 61}x{i * i % 17}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, doc long, n int, label int, id string, row long, shard int, __kept int"


def odd_rows() -> list[tuple]:
    base = " ".join(PROSE[:120])
    near = " ".join([*PROSE[:119], "changed"])
    far = " ".join([*PROSE[:60], *(f"z{i}" for i in range(60))])
    texts = [
        (1, base, "s1"), (2, base, "s1"), (3, near, "s2"), (4, far, None), (5, None, "s2"), (6, "", "s1"), (7, " \n\t", ""),
        (8, "one two", "s3"), (9, "One TWO", "s3"), (10, "\x1ca b\xa0c", "s3"), (11, "Ünïcode ÉCOLE 日本 語 <|endoftext|> it's 12", "s2"),
        (12, " ".join(PROSE * 60), "s1"), (None, "a lonely text without an id", "s1"), (None, base, "s2"), (4, far, None), (13, "x" * 5000, "s4"),
        (14, "one two\none two\n\none two\n" + "# * $ % & | < > " * 3, "s1"),
    ]
    return [(i, t, None if k % 3 else "en", s, None, "k", 1, 2, 3, 4, "x", 5, 6, 7) for k, (i, t, s) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("id", F.lit(0))
