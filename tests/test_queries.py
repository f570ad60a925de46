"""Every registered graph query that has SQL gives what DuckDB gives."""

import math

import duckdb
import pytest

from arcloom import queries as graph

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return f"{v:.9g}"
    return repr(list(v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(graph.queries()))
def test_query(spark, con, name):
    df = graph.queries()[name](spark, SF)
    rows = df.collect()
    sql = graph.oracle_sql().get(name)
    if sql is None:
        assert rows is not None
        return
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    expected = sorted(tuple(cell(dict(zip(names, r))[c]) for c in order) for r in want.fetchall())
    assert sorted(tuple(cell(r[c]) for c in order) for r in rows) == expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10 and set(entry.oracle_sql()) <= set(entry.queries())


def test_schema_and_search_queries_cover_all_labels(spark, con):
    from arcloom.sources.tables import table_graph

    run = {x: graph.queries()[x](spark, SF).collect() for x in ("explore_keyword_search", "introspect_types", "enum_values")}
    assert len({r["type"] for r in run["explore_keyword_search"]}) > 3
    assert {r["label"] for r in run["introspect_types"]} == set(table_graph(spark, SF).nodes)
    assert {"Customer", "Event", "Order", "Part", "Turn"} <= {r["label"] for r in run["enum_values"]}
