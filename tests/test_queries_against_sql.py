"""Each registered query of the engine's own operators against its DuckDB twin, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tessella.plans import registry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the input tables are not here")


def _text(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(_text, x)) + "]"
    return str(x)


def _sorted(rows) -> list[str]:
    return sorted("|".join(map(_text, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, str(SF))
    columns = sorted(got.columns)
    want = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert _sorted(got.select(*[f"`{c}`" for c in columns]).collect()) == _sorted([r[i] for i in order] for r in want.fetchall())


def test_each_sql_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
