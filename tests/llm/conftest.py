"""A table with every odd case, and the plain documents."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

EXTRA = ["key", "__key", "__chain", "h", "row", "__score", "__rid", "__fp", "__tokens", "__probability", "node", "a", "tokens", "probability", "id", "label", "media", "ids"]


def odd_texts():
    rng = random.Random(7)
    words = ["lorem", "ipsum", "Straße", "don't", "naïve", "42", "漢字", "текст", "e=mc²"]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    return [
        (1, "the same text stands here in full"), (2, "the same text stands here in full"), (2, "the same text stands here in full"), (None, "the same text stands here in full"), (3, None), (4, None),
        (5, ""), (6, ""), (7, "   \n\t "), (8, long), (9, long), (10, long + "x"), (11, "!!! ... ---"), (12, "ünïcödé 漢字 текст"), (None, None), (13, "x" * 50_000), (14, "a"), (15, "0"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, [None, "en", "de"][n % 3], [None, "s1"][n % 2], None if t is None else len(t)) for n, (i, t) in enumerate(odd_texts())]
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df.withColumns({c: F.lit(None).cast("string") if n % 2 else F.lit(n).cast("long") for n, c in enumerate(EXTRA)}).cache()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
