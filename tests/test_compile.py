"""The compiler against a naive matcher on random graphs, and the rules of results."""

import random

import pytest
from pyspark.sql import functions as F

from arcloom.errors import FieldTypeError, LoweringError
from arcloom.plans.compile import Engine
from arcloom.plans.dsl import Settings
from arcloom.plans.text import TextIndex
from arcloom.sources.catalog import GraphCatalog
from arcloom.sources.tables import table_graph

N = 7


def random_graph(spark, seed):
    r = random.Random(seed)
    edges = {"R": [(i, r.randrange(N), r.randrange(N)) for i in range(10)], "S": [(i, r.randrange(N), r.randrange(N)) for i in range(6)]}
    g = GraphCatalog(spark)
    g.add_node("A", spark.createDataFrame([(i, f"n{i}", i % 3 if i else None) for i in range(N)], "k long, name string, v int"), "k")
    for rel, rows in edges.items():
        g.add_edge(rel, "A", "A", spark.createDataFrame([(e, s, d, e * 10) for e, s, d in rows], "e long, s long, d long, w int"), "s", "d", key="e")
    return g, edges


def steps(edges, rel, direction, node):
    out = []
    for name in rel.split("|"):
        for e, s, d in edges[name]:
            if direction in ("out", "both") and s == node:
                out.append(((name, e), d))
            if direction in ("in", "both") and d == node and not (direction == "both" and s == d):
                out.append(((name, e), s))
    return out


def walk(edges, rel, direction, node, low, high, used):
    found, frontier = [], [(node, frozenset())]
    for k in range(1, high + 1):
        frontier = [(t, path | {e}) for at, path in frontier for e, t in steps(edges, rel, direction, at) if e not in path and e not in used]
        if k >= low:
            found += frontier
    return found


def naive(edges, start_nodes, hops):
    """Rows of nodes for a list of (source position, rel, direction, low, high), one pattern per chain."""
    rows = [((n,), frozenset()) for n in start_nodes]
    last = 0
    for i, (src, rel, direction, low, high) in enumerate(hops):
        fresh = src != last
        rows = [((*ns, t), (frozenset() if fresh else used) | path) for ns, used in rows for t, path in walk(edges, rel, direction, ns[src], low, high, frozenset() if fresh else used)]
        last = i + 1
    return sorted(ns for ns, _ in rows)


SHAPES = [
    [(0, "R", "out", 1, 1)], [(0, "R", "both", 1, 1)], [(0, "R|S", "in", 1, 1)], [(0, "R", "out", 1, 1), (1, "R", "out", 1, 1)], [(0, "R", "both", 1, 1), (1, "R", "both", 1, 1)],
    [(0, "R", "out", 1, 1), (0, "R", "out", 1, 1)], [(0, "R", "out", 1, 3)], [(0, "R|S", "both", 2, 3)], [(0, "R", "out", 1, 2), (1, "R", "in", 1, 2)], [(0, "S", "out", 1, 1), (1, "R", "both", 1, 2), (0, "R", "out", 1, 1)],
]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("shape", SHAPES, ids=str)
def test_against_naive_matcher(spark, seed, shape):
    g, edges = random_graph(spark, seed)
    hops = []
    for i, (src, rel, direction, low, high) in enumerate(shape):
        h = {"from": f"x{src}", "edge": {"label": rel, "direction": direction}, "target": {"label": "A", "alias": f"x{i + 1}"}}
        hops.append(h | ({"depth": {"min": low, "max": high}} if (low, high) != (1, 1) else {}))
    doc = {"start": {"label": "A", "alias": "x0"}, "traversals": hops, "return": [{"field": f"x{i}.k", "alias": f"c{i}"} for i in range(len(shape) + 1)]}
    got = sorted(tuple(r) for r in Engine(g, Settings(max_limit=None)).plan(doc).collect())
    assert got == naive(edges, range(N), shape)


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(random_graph(spark, 1)[0])


def plan(engine, **doc):
    return engine.plan({"start": {"label": "A", "alias": "a"}, "return": [{"field": "a.name"}]} | doc)


HOP = {"edge": {"label": "R", "alias": "r", "direction": "out"}, "target": {"label": "A", "alias": "b"}}


def test_names_of_columns(engine):
    df = plan(engine, **{"return": [{"field": "a.name"}, {"field": "a.v", "aggregate": "sum"}, {"field": "a", "aggregate": "count"}], "group_by": ["a.name", {"field": "a.v"}]})
    assert df.columns == ["a.name", "sum(a.v)", "count(a)", "a_v"]
    assert plan(engine, **{"return": [{"field": "a"}]}).schema["a"].dataType.names == ["nid", "label", "k", "name", "v"]


def test_lowering_errors(engine):
    for doc in (
        {"filters": [{"field": "z.x", "op": "eq", "value": 1}]}, {"traversals": [HOP | {"from": "z"}]}, {"return": [{"field": "a.name"}, {"field": "a", "aggregate": "count"}]},
        {"traversals": [HOP | {"depth": {"min": 1, "max": 7}}]}, {"filters": [{"field": "a.name", "op": "like", "value": 1}]}, {"start": {"label": "Zzz", "alias": "a"}},
        {"traversals": [HOP | {"depth": {"min": 1, "max": 2}}], "return": [{"field": "r.w"}]}, {"distinct": True, "sort": [{"field": "a.v"}]},
    ):
        with pytest.raises(LoweringError):
            plan(engine, **doc)
    with pytest.raises(FieldTypeError):
        plan(engine, filters=[{"field": "a.name", "op": "eq", "value": {"x": 1}}])
    with pytest.raises(FieldTypeError):
        plan(engine, filters=[{"field": "a.name", "op": "search", "value": "x", "type": "Keyword"}])


def test_values_are_literals(engine):
    assert plan(engine, filters=[{"field": "a.name", "op": "eq", "value": "n1' OR '1'='1"}]).count() == 0


def test_nulls_sort_last_and_limits(engine):
    up = [r[0] for r in plan(engine, **{"return": [{"field": "a.v", "alias": "v"}], "sort": [{"field": "v"}]}).collect()]
    down = [r[0] for r in plan(engine, **{"return": [{"field": "a.v", "alias": "v"}], "sort": [{"field": "v", "order": "desc"}]}).collect()]
    assert up[-1] is None and down[-1] is None and up[0] == 0 and down[0] == 2
    assert engine.plan({"start": {"label": "A", "alias": "a"}, "return": [{"field": "a.k"}], "limit": 100}, max_limit=3).count() == 3


def test_empty_edge_types(engine):
    none = HOP | {"edge": {"label": "NONE", "direction": "out"}}
    assert plan(engine, traversals=[none]).count() == 0
    assert plan(engine, traversals=[none | {"optional": True}], **{"return": [{"field": "a.k"}, {"field": "b.name"}]}).count() == N


def test_date_parts_of_text(spark):
    g = GraphCatalog(spark).add_node("D", spark.createDataFrame([("2024-05-06T07:08:09Z",), ("2024-05-06",), ("2024",), ("x",), (None,)], "t string"), "t")
    df = Engine(g).plan({"start": {"label": "D", "alias": "d"}, "return": [{"field": "d.t", "alias": "t"}] + [{"field": "d.t", "date_part": p, "alias": p} for p in ("year", "quarter", "month", "day", "hour")]})
    got = {r["t"]: tuple(r)[1:] for r in df.collect()}
    assert got["2024-05-06T07:08:09Z"] == (2024, 2, 5, 6, 7) and got["2024-05-06"] == (2024, 2, 5, 6, None) and got["2024"] == (2024, None, None, None, None) and got["x"] == (None,) * 5


def test_day_filters_on_text_dates(spark):
    g = GraphCatalog(spark).add_node("D", spark.createDataFrame([(i, t) for i, t in enumerate(["2024-05-06T00:00:00Z", "2024-05-06 23:59:59", "2024-05-07", "2024-05-05T10:00:00+02:00", "junk", None])], "i int, t string"), "i")
    run = lambda op, v: sorted(r[0] for r in Engine(g).plan({"start": {"label": "D", "alias": "d"}, "filters": [{"field": "d.t", "op": op, "value": v, "type": "Date"}], "return": [{"field": "d.i"}]}).collect())
    assert run("eq", "2024-05-06") == [0, 1] and run("neq", "2024-05-06") == [2, 3] and run("gt", "2024-05-06") == [2] and run("lte", "2024-05-06") == [0, 1, 3]
    assert run("eq", "2024-05-06T23:59:59Z") == [1] and run("lt", "2024-05-06T00:00:00") == [3]


def test_text_filters_fold(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, "blue car"), (4, None)], "k long, text string")
    g = GraphCatalog(spark).add_node("T", docs, "k")
    e = Engine(g, Settings(grounding=True), indexes={"T": TextIndex(docs, "k", "text")})
    run = lambda *fs, **kw: [r[0] for r in e.plan({"start": {"label": "T", "alias": "t"}, "filters": [{"field": "t.text", "op": o, "value": v, "type": "Text"} | kw for o, v in fs], "return": [{"field": "t.k"}]}).collect()]
    assert run(("eq", "apple pie")) == [1]
    assert run(("contains", "apple"), ("contains", "pie")) == [1, 2]
    assert sorted(run(("neq", "apple"), cardinality="many")) == [1, 2]  # not negated
    assert sorted(run(("in", ["car", "pie"]))) == [1, 3]
    assert run(("contains", "zebra")) == []
    assert len(run(("search", "apple pie"), cardinality="one")) == 1


def test_sources_collapse_parallel_edges(spark):
    g = GraphCatalog(spark)
    g.add_node("P", spark.createDataFrame([(1, "p"), (2, "q")], "k long, name string"), "k").add_node("Source", spark.createDataFrame([("s1",), ("s2",)], "name string"), "name")
    g.add_edge("mention", "P", "Source", spark.createDataFrame([(1, "s1"), (1, "s2")], "a long, b string"), "a", "b")
    g.add_edge("R", "P", "P", spark.createDataFrame([(1, 1, 2), (2, 1, 2)], "e long, a long, b long"), "a", "b", key="e")
    doc = {"start": {"label": "P", "alias": "a"}, "traversals": [{"edge": {"label": "R", "alias": "r"}, "target": {"label": "P", "alias": "b"}}], "return": [{"field": "a.k", "alias": "a"}, {"field": "b.k", "alias": "b"}]}
    got = Engine(g, Settings(auto_sources=True)).plan(doc).collect()
    assert [tuple(r) for r in got] == [(1, 2, ["s1", "s2"])]
    assert Engine(g).plan(doc).count() == 1 and Engine(g, Settings(auto_sources=False)).plan(doc).count() == 2
    doc["return"].append({"field": "r.eid", "alias": "e"})
    assert Engine(g, Settings(auto_sources=True)).plan(doc).count() == 2


def test_embedded_edges_need_no_extra_join(spark, sf_dir):
    e = Engine(table_graph(spark, sf_dir))
    doc = {"start": {"label": "Nation", "alias": "n"}, "traversals": [{"edge": {"label": "FROM_NATION", "direction": "in"}, "target": {"label": "Customer", "alias": "c"}}, {"from": "c", "edge": {"label": "PLACED"}, "target": {"label": "Order", "alias": "o"}}], "filters": [{"field": "o.o_orderstatus", "op": "eq", "value": "F"}], "return": [{"field": "n.n_name", "alias": "n"}, {"field": "o", "aggregate": "count", "alias": "c"}], "group_by": ["n.n_name"]}
    text = e.plan(doc)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Join") == 2 and text.count("FileScan") == 3 and "EqualTo(o_orderstatus,F)" in text


def test_a_new_field_type_plugs_in(spark, engine):
    from arcloom.functions.types import Capability, Contribution, Registry

    class Near:
        """Values nearest to a number first, from a table of hits, within a distance."""

        type_id, capabilities = "Near", Capability.EQUALITY

        def supported_ops(self):
            return ["eq"]

        def contribute(self, c, kind, op, value):
            hits = spark.createDataFrame([(0, 1.0), (3, 0.5), (4, 2.0), (5, 1.0)], "nid long, score double")
            return Contribution(hits, F.abs(c - value) <= 1, (F.abs(c - value),))

    registry = Registry()
    registry.register(Near())
    e = Engine(engine.catalog, registry=registry)
    got = e.plan({"start": {"label": "A", "alias": "a"}, "filters": [{"field": "a.v", "op": "eq", "value": 1, "type": "Near"}], "return": [{"field": "a.k", "alias": "k"}]})
    assert [tuple(r) for r in got.collect()] == [(4, 2.0), (5, 1.0), (3, 0.5)]
    assert "Near" in registry.names()
    n = e.plan({"start": {"label": "A", "alias": "a"}, "filters": [{"field": "a.v", "op": "eq", "value": 1, "type": "Near"}], "return": [{"field": "a", "aggregate": "count", "alias": "n"}]})
    assert n.first()["n"] == 3


def test_variable_length_is_one_join_a_step_on_thin_paths(spark):
    g = GraphCatalog(spark)
    g.add_node("P", spark.range(5).toDF("k"), "k")
    edges = spark.createDataFrame([(i, i, i + 1, 0.5) for i in range(4)], "e long, a long, b long, weight double")
    g.add_edge("R", "P", "P", edges, "a", "b", key="e")
    hop = {"edge": {"label": "R", "alias": "r"}, "target": {"label": "P", "alias": "q"}, "depth": {"min": 1, "max": 6}}
    doc = {"start": {"label": "P", "alias": "p"}, "traversals": [hop], "return": [{"field": "p.k", "alias": "p"}, {"field": "q.k", "alias": "q"}]}
    found = Engine(g).plan(doc)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    steps = [line for line in plan.splitlines() if "Project" in line or "Generate" in line]
    assert plan.count("Join ") == 7 and steps and not any("weight" in line for line in steps)  # paths are ids only
    assert sorted((r["p"], r["q"]) for r in found.collect()) == [(a, b) for a in range(5) for b in range(a + 1, 5)]
    lists = Engine(g).plan(doc | {"return": [{"field": "r", "alias": "r"}]}).collect()
    assert len(lists) == 10 and all("weight" in str(r["r"][0]) for r in lists)  # edges that are returned have their properties
