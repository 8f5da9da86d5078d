"""Queries of the llm subpackage against their DuckDB SQL, on the smallest tables."""

import pytest

from conftest import SF_SMALL, as_bag, duck
from provenance_spark.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = duck(SF_SMALL).execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert as_bag(df.columns, rows) == as_bag(cols, cur.fetchall())
