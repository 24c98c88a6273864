"""Every registered query of the engine against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from tessera.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows):
    return sorted(repr([round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert got.collect()
        return
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert normal(got.select(*[f"`{c}`" for c in columns]).collect()) == normal(want.query("q", f"SELECT {quoted} FROM q").fetchall())
