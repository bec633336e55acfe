"""Every registered query with an oracle equals DuckDB on the same tables
(columns sorted by name, order-insensitive rows) - the driver's gate, run
here on sf0.001."""

from collections import Counter

import pytest

import __spark_entry__ as E
from tools.oracle_check import norm

SQL = E.oracle_sql()
QUERIES = E.queries()


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    from conftest import SF_SMALL
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _rows(df.columns, srows) == _rows(dcols, drows)


def test_every_query_has_ids_and_runs_entry(spark):
    from outagelens.plans.registry import load_all
    reg = load_all()
    assert all(q.ids for q in reg.values())
    df = E.entry(spark)
    assert df.count() > 0
    assert "siteid_sitio_afectado" in df.columns


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_query_runs(spark, name):
    """Queries without an oracle (MLlib fits, MLlib KS test) run on the whole
    small tables and return rows."""
    from conftest import SF_SMALL
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() > 0
