import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    from tessera.llm.common import workers_find_package

    workers_find_package(spark)

    def docs(rows, schema=DOCS):
        full = [(*r, *([None] * (len(schema.split(",")) - len(r)))) for r in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return docs


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty, blank and very long texts, ties, repeated rows, and columns with names that operators use."""
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two three four"), (4, "one two three four"), (5, "one two  three four"), (None, "one two three four"), (6, "word " * 60_000), (7, "x" * 300_000), (8, "ÉTÉ 漢字 🎉 !!! ###")]
    d = make([(*r, "en" if r[0] != 2 else None, "s" if r[0] != 3 else None) for r in rows])
    return d.withColumns({c: F.lit("clash") for c in ("score", "predicted", "digest", "maybe", "block", "slot", "component_id", "n_tokens", "held_out", "verdict", "_gone", "row")})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


def sentences(seed, n, words=80, vocabulary=4000):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words)) for _ in range(n)]
