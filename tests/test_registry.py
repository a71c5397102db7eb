"""Registered queries against their SQL on the smallest test tables."""

import math
import os

import pytest

from framewise import registry

TABLES = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TABLES}/{name}.parquet'")
    return con


def plain(rows, order):
    """Rows as sortable tuples, numbers rounded and without a negative zero."""
    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{round(x, 6) + 0.0:.6f}"
        return x if isinstance(x, bool) or not isinstance(x, int) else f"{float(x):.6f}"

    return sorted(repr([value(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, TABLES)
    result = duck.execute(registry.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = plain(result.fetchall(), [names.index(c) for c in order])
    assert plain([tuple(r) for r in df.collect()], [df.columns.index(c) for c in order]) == want


@pytest.mark.parametrize("name", ["random_shift_null", "event_summary"])
def test_null_model_of_spans_over_whole_videos(spark, tmp_path, name):
    """With many events labels and spans cover videos to the end, and shifted spans wrap around it."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"""COPY (SELECT row_number() OVER () * 7 + 6 AS event_id, TIMESTAMP '2024-01-01' + to_seconds(600 * f + 1) AS ts, u AS user_id, k AS event_type, 0.0::DOUBLE AS value, '' AS props
      FROM range(0, 4320, 7) t(f), range(10) v(u), unnest(['error', 'click', 'view']) w(k) WHERE k = 'view' OR u < 5 OR f BETWEEN u * 10 AND 4200 OR f > 4310) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    result = con.execute(registry.SQL[name])
    names = [d[0] for d in result.description]
    want = plain(result.fetchall(), range(len(names)))
    assert plain([tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).select(*names).collect()], range(len(names))) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    """Few spans exist at this size; the operators behind these queries are tested against loops elsewhere."""
    df = registry.QUERIES[name](spark, TABLES)
    assert all(set(r.asDict()) == set(df.columns) for r in df.collect())
