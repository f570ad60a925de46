import json

import pytest

from arcloom.errors import FieldTypeError, QueryError
from arcloom.functions.types import Boolean, Date, Keyword, ListType, Number, SemanticText, Timestamp, storage_type
from arcloom.plans import dsl, suite
from arcloom.sources import config

BASE = {"start": {"label": "A", "alias": "a"}, "return": [{"field": "a.x"}]}
HOP = {"edge": {"label": "R", "alias": "r", "direction": "out"}, "target": {"label": "B", "alias": "b"}}


def test_parse_and_describe():
    q = dsl.parse(json.dumps(BASE | {"traversals": [HOP | {"depth": {"min": 1, "max": 3}, "optional": True}], "filters": [{"field": "a.x", "op": "eq", "value": "v"}], "limit": 3, "unknown": 1}))
    assert q.traversals[0].source == "a" and q.traversals[0].depth == (1, 3)
    assert q.describe() == 'from A a; optionally a ->[R x1..3] B b; where a.x eq "v"; return a.x; at most 3'


@pytest.mark.parametrize(
    "change",
    [
        {"return": []}, {"limit": 0}, {"limit": True}, {"start": {"label": "A", "alias": "1a"}}, {"start": {"label": "A b", "alias": "a"}}, {"traversals": [HOP | {"target": {"label": "B", "alias": "a"}}]},
        {"traversals": [HOP | {"depth": {"min": 0, "max": 1}}]}, {"traversals": [HOP | {"depth": {"min": 3, "max": 2}}]}, {"traversals": [HOP | {"edge": {"label": "R|", "direction": "out"}}]},
        {"traversals": [HOP | {"edge": {"label": "R", "direction": "up"}}]}, {"filters": [{"field": "a.b.c", "op": "eq", "value": 1}]}, {"filters": [{"field": "a.x", "op": "e q", "value": 1}]},
        {"filters": [{"op": "eq"}]}, {"return": [{"field": "a.x", "aggregate": "median"}]}, {"return": [{"field": "a.x", "date_part": "week"}]}, {"sort": [{"field": "a.x", "order": "up"}]}, {"start": None},
    ],
)
def test_rejects(change):
    with pytest.raises((QueryError, AttributeError)):
        dsl.parse(BASE | change)
    with pytest.raises(QueryError):
        dsl.parse("{not json")


def test_edge_aliases_are_made_unique():
    q = dsl.parse(BASE | {"traversals": [HOP, {"from": "b", "edge": {"label": "R", "alias": "r"}, "target": {"label": "C", "alias": "c"}}, {"from": "c", "edge": {"label": "R", "alias": "a"}, "target": {"label": "D", "alias": "d"}}]})
    assert [h.edge_alias for h in q.traversals] == ["r", "r_2", "a_2"]


def test_rewrites():
    q = dsl.parse(BASE | {"filters": [{"field": "a.y", "op": "eq", "value": 1}, {"field": "a.z", "op": "eq", "value": 1, "type": "Keyword"}, {"field": "a.entity_id", "op": "eq", "value": 1}]})
    assert [r.field for r in dsl.with_filter_context(q).returns] == ["a.x", "a.y"]
    assert dsl.with_hidden_ids(q).returns[-1] == dsl.Return("a.id", alias="__id_a")


@pytest.mark.parametrize("raw,want", [(" 1,234 ", 1234), ("1_000.5", 1000.5), ("50%", 0.5), ("", 0), (3, 3), (2.5, 2.5), ("-7", -7), ([1, "2"], [1, 2]), (None, None)])
def test_numbers(raw, want):
    assert Number().parse(raw) == want


@pytest.mark.parametrize("h,raw", [(Number(), True), (Number(), "x1"), (Number(), {}), (Number(), float("inf")), (Boolean(), 1), (Boolean(), "maybe"), (Keyword(), {}), (Date(), "2023-02-29"), (Date(), "2023-1-1"), (Timestamp(), "2024-01-01T25:00"), (Timestamp(), "2024-01-01T10:00+99:00"), (SemanticText(), 3)])
def test_rejected_values(h, raw):
    with pytest.raises(FieldTypeError):
        h.parse(raw)


def test_values():
    assert [Boolean().parse(x) for x in ("Yes", " off ", "1", "n", True, None)] == [True, False, True, False, True, None]
    assert Keyword().parse([1, None, True, "x"]) == ["1", "true", "x"] and ListType().parse("a") == ["a"]
    assert Date().parse("2024-02-29T10:00Z") == "2024-02-29" and Date().parse(0) == "1970-01-01"
    assert [Timestamp().parse(x) for x in ("2024-01-02", "2024-01-02 03:04", "2024-01-02T03:04:05+02:00", 60)] == ["2024-01-02T00:00:00Z", "2024-01-02T03:04:00Z", "2024-01-02T03:04:05+02:00", "1970-01-01T00:01:00Z"]
    assert storage_type("SemanticText") == "Text" and storage_type("int") == "Number"
    with pytest.raises(FieldTypeError):
        storage_type("blob")


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('[query]\nmax_depth = 4\n[resolve]\nconflict_properties = ["id"]\n[graph]\nprefix_label = "t1"\nother = 3\n')
    c = config.load(str(f), {"ARCLOOM__QUERY__MAX_LIMIT": "7", "ARCLOOM__QUERY__GROUNDING": "true", "ARCLOOM__RESOLVE__MIN_MARGIN": "0.5", "X": "1"})
    assert (c.query.max_depth, c.query.grounding, c.resolve.conflict_properties, c.resolve.min_margin, c.prefix_label) == (4, True, ("id",), 0.5, "t1")


def test_suite_checks():
    rows = [{"a": 1, "b": "Main Entrance"}, {"a": 2.0, "b": None}]
    assert suite.check(rows, ["a", "b"], {"row_count": {"exact": 2}, "rows": [{"a": 2}, {"a": 1}], "columns": ["a"], "contains": ["main"], "not_contains": ["side"], "numbers": [2]}) == []
    assert len(suite.check(rows, ["a"], {"row_count": {"min": 3}, "rows": [{"a": 1}, {"a": 1}], "columns": ["c"], "contains": ["x"], "not_contains": ["MAIN"], "numbers": [9], "answer_contains": ["z"], "dsl_expect": {"limit": 1}})) == 8
