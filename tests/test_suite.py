"""A small answer suite over a stored graph: typed names, day intervals, counts, collected lists."""

from arcloom.operators.ingest import GraphStore
from arcloom.plans.compile import Engine
from arcloom.plans.suite import run_suite
from arcloom.sources.graph_json import parse_graph

KEY = {"strict": "id"}


def kw(v):
    return {"type": "Keyword", "value": v}


def graph():
    places = [{"id": "p1", "type": "Gate", "primary_key": KEY, "name": kw("West Gate")}, {"id": "p2", "type": "Gate", "primary_key": KEY, "name": kw("Dock")}]
    cams = [{"id": f"k{i}", "type": "Scanner", "primary_key": KEY, "name": kw(f"Scan-{i:02d}"), "edge": {"type": "Bool", "value": "yes" if i % 2 else "no"}} for i in range(5)]
    when = ["2024-03-01T08:00:00Z", "2024-03-01T23:30:00Z", "2024-03-02T00:00:00Z", "2024-03-05T10:00:00+02:00", "2024-03-01"]
    events = [{"id": f"e{i}", "type": "Reading", "primary_key": KEY, "at": {"type": "Datetime", "value": t}, "value": {"type": "Number", "value": f"{i}0%"}} for i, t in enumerate(when)]
    relations = [{"from": f"k{i}", "to": "p1" if i < 3 else "p2", "type": "AT"} for i in range(5)] + [{"from": f"e{i}", "to": f"k{i % 2}", "type": "READ_BY"} for i in range(5)]
    return {"entities": places + cams + events, "relations": relations}


def start(label, alias, *hops, **rest):
    return {"start": {"label": label, "alias": alias}, "traversals": list(hops)} | rest


AT = {"edge": {"label": "AT", "direction": "in"}, "target": {"label": "Scanner", "alias": "s"}}
READ = {"from": "s", "edge": {"label": "READ_BY", "direction": "in"}, "target": {"label": "Reading", "alias": "r"}}
WEST = {"field": "g.name", "op": "eq", "value": "west gate", "type": "Keyword"}

QUESTIONS = [
    {"id": "which", "dsl": start("Gate", "g", AT, filters=[WEST], **{"return": [{"field": "s.name"}]}), "validation": {"row_count": {"exact": 3}, "rows": [{"s.name": "Scan-00"}, {"s.name": "Scan-02"}], "columns": ["s.name"], "contains": ["scan-01"], "not_contains": ["scan-03"]}},
    {"id": "how many", "dsl": start("Gate", "g", AT, filters=[WEST], **{"return": [{"field": "s.id", "aggregate": "count"}]}), "validation": {"row_count": {"exact": 1}, "numbers": [3], "columns": ["count(s)"]}},
    {"id": "of a day", "dsl": start("Scanner", "s", READ, filters=[{"field": "r.at", "op": "eq", "value": "2024-03-01", "type": "Timestamp"}], **{"return": [{"field": "r", "aggregate": "count", "alias": "n"}]}), "validation": {"rows": [{"n": 3}]}},
    {"id": "until a day", "dsl": start("Scanner", "s", READ, filters=[{"field": "r.at", "op": "gte", "value": "2024-03-01", "type": "Timestamp"}, {"field": "r.at", "op": "lte", "value": "2024-03-02", "type": "Timestamp"}], **{"return": [{"field": "s.name", "alias": "s"}, {"field": "r.value", "aggregate": "sum", "alias": "v"}], "group_by": ["s.name"]}), "validation": {"rows": [{"s": "Scan-00", "v": 0.6}, {"s": "Scan-01", "v": 0.1}]}},
    {"id": "collected", "dsl": start("Gate", "g", AT, **{"return": [{"field": "g.name", "alias": "g"}, {"field": "s.name", "aggregate": "collect", "alias": "all"}], "group_by": ["g.name"]}), "validation": {"rows": [{"g": "Dock", "all": ["Scan-03", "Scan-04"]}]}},
    {"id": "two ways", "dsl": start("Gate", "g", AT, READ, filters=[WEST, {"field": "s.edge", "op": "eq", "value": True}], **{"return": [{"field": "r.id", "alias": "r"}], "sort": [{"field": "r.value", "order": "desc"}], "limit": 1}), "validation": {"rows": [{"r": "e3"}], "row_count": {"exact": 1}}},
]


def test_suite(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path))
    s.ingest(parse_graph(graph()))
    engine = Engine(s.catalog())
    assert [(o.id, o.faults) for o in run_suite(QUESTIONS, engine.plan) if not o.ok] == []
    wrong = run_suite([{"id": "bad", "dsl": start("Gate", "g", **{"return": [{"field": "x.y"}]})}], engine.plan)
    assert not wrong[0].ok and "LoweringError" in wrong[0].faults[0]
