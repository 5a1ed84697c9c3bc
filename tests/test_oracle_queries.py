"""Every registered query with a SQL twin equals DuckDB on the smallest test scale."""

import pytest

from conftest import SF_SMALL
from emberline.plans import catalog as C
from oracle import compare, duck

import __spark_entry__ as ENTRY  # noqa: F401  (registers all queries)


TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
            "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(C.ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = C.QUERIES[name](spark, SF_SMALL)
    ok, msg = compare(df, con, C.ORACLES[name])
    assert ok, msg
    rel = con.sql(C.ORACLES[name])
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in df.schema.fields:
        want = TYPE_MAP.get(f.dataType.simpleString(), f.dataType.simpleString())
        assert duck_types[f.name] == want, (f.name, f.dataType.simpleString(), duck_types[f.name])


def test_every_query_has_a_callable():
    qs = ENTRY.queries()
    assert set(ENTRY.oracle_sql()) <= set(qs)
    assert len(qs) >= 60
