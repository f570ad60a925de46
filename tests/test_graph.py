"""Ingest, deletion, export, resolution, retrieval, exploration, schema, language, streaming on a small stored graph."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from arcloom.errors import GraphError, IngestError, QueryError, Unsupported
from arcloom.functions import scalars
from arcloom.operators import introspect, resolve, retrieve, vector
from arcloom.operators.explore import Explorer
from arcloom.operators.ingest import GraphStore
from arcloom.plans import language
from arcloom.plans.compile import Engine
from arcloom.plans.dsl import EntityTypeQuery, TraversalQuery
from arcloom.plans.text import TextIndex
from arcloom.sources import ontology as onto
from arcloom.sources.graph_json import GraphBuilder, parse_graph

SITE = {
    "source": "site plan",
    "entities": [
        {"id": "hall", "type": "Place", "primary_key": {"strict": "id"}, "name": {"type": "Keyword", "value": "North Hall"}, "opened": {"type": "date", "value": "2020-01-05"}},
        {"id": "yard", "type": "Place", "primary_key": {"strict": "id"}, "name": {"type": "Keyword", "value": "Yard"}, "label": "ignored"},
        {"id": "s1", "type": "Sensor", "primary_key": {"strict": "id"}, "state": {"type": "Keyword", "value": "up"}, "volts": "1,200", "tags": {"type": "List", "value": ["Door", "Heat"]}, "volts2": {"type": "Number", "value": "1,200"}},
        {"id": "s2", "type": "Sensor", "primary_key": {"strict": "id"}, "state": {"type": "Keyword", "value": "down"}, "volts2": {"type": "Number", "value": 3.5}},
        {"id": "c1", "type": "Chunk", "chunk_id": {"type": "Keyword", "value": "c1"}, "text": "The north hall sensor is hot. It failed twice."},
        {"id": "c2", "type": "Chunk", "chunk_id": {"type": "Keyword", "value": "c2"}, "text": "The yard is quiet and cold."},
    ],
    "relations": [
        {"from": "s1", "to": "hall", "type": "IN", "since": {"type": "Number", "value": "2021"}},
        {"from": "s2", "to": "yard", "type": "IN"},
        {"from": "c1", "to": "hall", "type": "mentions"},
        {"from": "c2", "to": "yard", "type": "mentions"},
    ],
}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = GraphStore(spark, str(tmp_path_factory.mktemp("graph")), prefix_label="t1")
    s.first = s.ingest(parse_graph(SITE))
    return s


def test_ingest_counts_and_is_idempotent(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path))
    a = s.ingest(parse_graph(SITE))
    assert (a.nodes, a.new_nodes, a.edges) == (7, 7, 10)  # 6 entities and the source; 4 relations, 4 mention, 2 part_of
    before = {r["nid"]: r["key"] for r in s.nodes().collect()}
    b = s.ingest(parse_graph(SITE))
    assert (b.new_nodes, b.new_edges) == (0, 0) and {r["nid"]: r["key"] for r in s.nodes().collect()} == before
    s.ingest(parse_graph({"entities": [{"id": "s1", "type": "Sensor", "primary_key": {"strict": "id"}, "state": {"type": "Keyword", "value": "off"}, "scopes": ["table"]}]}))
    r = s.nodes().where("key = 's1'").first()
    assert json.loads(r["props"]["state"]) == "off" and json.loads(r["props"]["volts2"]) == 1200 and "scope_table" in r["labels"]
    s.vacuum(1)
    assert s.nodes().count() == 7


def test_missing_ends_make_no_edge_and_bad_values_stop(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path))
    b = GraphBuilder().entity("a", "T", {"name": "x"}, strict="id").reference("z", "T", "id", "not there").relationship("a", "R", "z")
    got = s.ingest(b.build())
    assert (got.nodes, got.edges) == (1, 0)
    with pytest.raises(IngestError):
        s.ingest(parse_graph({"entities": [{"id": "n", "type": "T", "primary_key": {"strict": "id"}, "n": {"type": "Number", "value": "abc"}}]}))
    for bad in ({"entities": [{"id": "c", "type": "Chunk", "text": "no source"}]}, {"entities": [{"type": "T"}]}, {"entities": [{"id": "a", "type": "T"}], "relations": [{"from": "a", "to": "b", "type": "R"}]}):
        with pytest.raises(IngestError):
            parse_graph(bad)
    assert s.version() == 1


def test_stored_graph_is_queried(store):
    e = Engine(store.catalog(), types={("Place", "name"): "Keyword"})
    doc = {"start": {"label": "Place", "alias": "p"}, "traversals": [{"edge": {"label": "IN", "alias": "i", "direction": "in"}, "target": {"label": "Sensor", "alias": "s"}}], "filters": [{"field": "p.name", "op": "eq", "value": "north hall"}], "return": [{"field": "s.id", "alias": "s"}, {"field": "s.volts2", "alias": "v"}, {"field": "i.since", "alias": "since"}, {"field": "s.tags", "alias": "tags"}], "prefix_label": "t1"}
    assert [tuple(r) for r in e.plan(doc).collect()] == [("s1", 1200.0, 2021, ["Door", "Heat"], ["site plan"])]
    assert e.plan(doc | {"prefix_label": "t2"}).count() == 0
    lists = {"start": {"label": "Sensor", "alias": "s"}, "filters": [{"field": "s.tags", "op": "contains", "value": "HEA", "type": "List"}], "return": [{"field": "s.id", "alias": "s"}]}
    assert [r[0] for r in e.plan(lists).collect()] == ["s1"]
    srcs = e.plan({"start": {"label": "Sensor", "alias": "s"}, "return": [{"field": "s.id", "alias": "s"}]}, auto_sources=True).collect()
    assert {r["s"]: r["sources"] for r in srcs} == {"s1": ["site plan"], "s2": ["site plan"]}


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path))
    s.ingest(parse_graph(SITE))
    other = GraphStore(spark, str(tmp_path))
    base, v = other._begin()
    s.ingest(parse_graph({"entities": [{"id": "new", "type": "T", "primary_key": {"strict": "id"}}]}))
    with pytest.raises(IngestError):
        other._commit(base, v)
    assert s.version() == v + 1 and s.nodes().where("key = 'new'").count() == 1


def test_delete_by_source_keeps_what_others_mention(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path))
    s.ingest(parse_graph(SITE))
    s.ingest(parse_graph({"source": "other", "entities": [{"id": "yard", "type": "Place", "primary_key": {"strict": "id"}}]}))
    vectors = s.nodes().select("nid", F.lit(1.0).alias("v"))
    counts, left = s.delete_by_source("site plan", vectors)
    assert counts == {"source": 1, "chunk": 2, "entity": 3}
    assert {r["key"] for r in s.nodes().collect()} == {"yard", "other"} and left.count() == 2
    assert [r["rel"] for r in s.edges().collect()] == ["mention"]
    assert s.delete_by_source("no such source")[0] == {}


def test_documents_of_a_folder_are_parsed_in_tasks(spark, tmp_path):
    from arcloom.sources.graph_json import read_graphs

    (tmp_path / "docs").mkdir()
    for i in range(3):
        (tmp_path / "docs" / f"{i}.json").write_text(json.dumps(SITE | {"source": f"site {i}"}))
    s = GraphStore(spark, str(tmp_path / "store"))
    got = s.ingest(read_graphs(spark, str(tmp_path / "docs")))
    assert (got.nodes, got.edges) == (9, 4 + 3 * 6)  # entities are the same in all, sources differ


def test_ingest_embeds_what_is_new_and_searches_it(spark, tmp_path, monkeypatch):
    from arcloom.sources.vectors import VectorStore

    v = VectorStore(spark, str(tmp_path / "vectors"))
    s = GraphStore(spark, str(tmp_path / "graph"), vectors=v, text_fields={"Place": ["name"]}, prefix_index="t1")
    s.ingest(parse_graph(SITE))
    assert v.collections() == ["t1___canonical", "t1__name", "t1__text"]
    nid = {r["key"]: r["nid"] for r in s.nodes().collect()}
    assert {r["nid"] for r in v.read("t1__name").collect()} == {nid["hall"], nid["yard"]}
    assert v.search("t1__text", "quiet yard", 1, mode="lexical").first()["nid"] == nid["c2"]
    plan = v.lexical("t1__text", "quiet", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan.replace("isnotnull(part#", "part") or "PartitionFilters: [" in plan and "part#" in plan
    index = TextIndex.stored(v, "t1__text")
    e = Engine(s.catalog(), indexes={("t1", "Chunk"): index})
    doc = {"start": {"label": "Chunk", "alias": "c"}, "filters": [{"field": "c.text", "op": "contains", "value": "quiet", "type": "SemanticText"}], "return": [{"field": "c.chunk_id", "alias": "id"}], "prefix_index": "t1"}
    assert [r["id"] for r in e.plan(doc, grounding=True).collect()] == ["c2"]
    with pytest.raises(GraphError):
        e.plan({k: x for k, x in doc.items() if k != "prefix_index"}, grounding=True)
    embedded = []
    real = vector.HashingEmbedder.column
    monkeypatch.setattr(vector.HashingEmbedder, "column", lambda self, c: embedded.append(c) or real(self, c))
    g = retrieve.retrieval_graph(s, v.embedder)
    assert not embedded and g.chunks.where("vec is null").count() == 0 and g.entities.where("vec is null").count() == 0
    s.delete_by_source("site plan")
    assert v.read("t1__name").count() == 0 and v.read("t1__text").count() == 0


def test_knn_batch_against_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(5)] + [(200, [0.0] * 4), (201, [1.0]), (202, None)]
    v = spark.createDataFrame(rows, "nid long, vec array<double>").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", rng.normal(size=4).tolist()) for i in range(7)] + [("same", [2.0, 0.0, 0.0, 0.0])], "qid string, qvec array<double>")
    pairs = v.where("size(vec) = 4").crossJoin(asked).select("qid", "nid", F.round(scalars.cosine(F.col("vec"), F.col("qvec")), 9).alias("score")).collect()
    for threshold in (None, 0.3):
        want = set()
        for qid in {p["qid"] for p in pairs}:
            mine = sorted((p for p in pairs if p["qid"] == qid and (threshold is None or p["score"] >= threshold)), key=lambda p: (-p["score"], p["nid"]))[:4]
            want |= {(qid, p["nid"], p["score"]) for p in mine}
        assert {(r["qid"], r["nid"], round(r["score"], 9)) for r in vector.knn_batch(asked, v, 4, threshold).collect()} == want


def test_lookups_reach_the_scan(spark, sf_dir):
    from arcloom.sources.tables import table_graph

    x = Explorer(Engine(table_graph(spark, sf_dir)))
    plan = x.neighbors("7", "Customer")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(o_custkey,7)") and plan.count("EqualTo(user_id,7)") and plan.count("EqualTo(c_custkey,7)")
    assert x.neighbors("07", "Customer").count() == 0 and x.neighbors("seven", "Customer").count() == 0 and x.entity("99999999999999999999").count() == 0
    assert x.entity(7, "Customer").count() == x.entity("7", "Customer").count() == 1


def test_export_round_trip(spark, store, tmp_path):
    ids = store.nodes().where("type in ('Place', 'Sensor')").select("nid")
    doc = store.export(ids)
    assert len(doc["entities"]) == 4 and {r["type"] for r in doc["relations"]} == {"IN"}
    again = GraphStore(spark, str(tmp_path))
    assert again.ingest(parse_graph(doc)).edges == 2


# --- resolution --------------------------------------------------------------


class Fixed:
    """Vectors by text, for tests."""

    dim = 2

    def __init__(self, table):
        self.table = table

    def embed(self, texts):
        import numpy as np

        return np.array([self.table.get(t, [0.0, 0.0]) for t in texts], float)

    def column(self, c):
        table = self.table

        @F.pandas_udf("array<double>")
        def run(s: pd.Series) -> pd.Series:
            return pd.Series([[float(x) for x in table.get(t, [0.0, 0.0])] for t in s])

        return run(c)


def near(cos):
    return [cos, (1 - cos * cos) ** 0.5]


def test_gates_one_by_one(spark):
    cfg = resolve.ResolveConfig(review_max_candidates=3)
    C = "type: P\nname: Ann Smith"
    rows = [
        (1, C, {"id": '"1"'}, 10, C, {"id": '"1"'}, 0.99), (2, C, {}, 10, C, {}, 0.955), (3, C, {}, 10, C, {}, 0.99), (3, C, {}, 11, C, {}, 0.97), (4, C, {}, 10, "type: P\nname: Zzqx", {}, 0.99),
        (5, C, {}, 10, C, {}, 0.99), (5, C, {}, 11, C, {}, 0.975), (5, C, {}, 12, C, {}, 0.97), (6, C, {"email": '"a"'}, 10, C, {"email": '"b"'}, 0.99), (7, "type: P", {}, 10, "type: P", {}, 0.99), (8, C, {}, 10, C, {}, 0.5),
        (9, C, {"email": '""'}, 10, C, {"email": '"b"'}, 0.99),
    ]
    df = spark.createDataFrame(rows, "idx long, canonical string, props map<string,string>, hit long, hit_canonical string, hit_props map<string,string>, score double")
    got = {r["idx"]: (r["outcome"], r["reasons"], len(r["runners_up"])) for r in resolve.gates(df, cfg).collect()}
    assert got[1] == ("merge", [], 0) and got[9] == ("merge", [], 0)
    assert got[2] == ("review", ["below_auto_merge_threshold"], 0) and got[3] == ("review", ["insufficient_margin"], 1)
    assert got[4] == ("review", ["insufficient_lexical"], 0) and got[5] == ("review", ["insufficient_margin", "too_many_close_candidates"], 2)
    assert got[6][1] == ["hard_conflict"] and got[7][1] == ["insufficient_lexical", "type_only"] and got[8][0] == "none"


def person(i, name, **more):
    return {"id": i, "type": "Person", "name": {"type": "Text", "value": name}} | more


def test_soft_merge_in_batch_and_with_the_store(spark, tmp_path):
    a, b, c, d = ("type: Person\nname: " + n for n in ("Ann Smith", "Ann Smyth", "Bob Stone", "Ann Smith jr"))
    emb = Fixed({a: near(1.0), b: near(0.985), c: near(0.1), d: [0.955, -near(0.955)[1]]})
    cfg = resolve.ResolveConfig(conflict_properties=("email",))
    s = GraphStore(spark, str(tmp_path))
    first = s.ingest(parse_graph({"entities": [person("1", "Ann Smith"), person("2", "Ann Smyth"), person("3", "Bob Stone")]}), resolve.Resolver(emb, cfg))
    assert first.nodes == 2 and first.merges["collapsed_in_batch"] == 1
    second = s.ingest(parse_graph({"entities": [person("9", "Ann Smyth", age=30), person("10", "Ann Smith jr")]}), resolve.Resolver(emb, cfg))
    assert second.new_nodes == 1 and second.merges["merged_with_stored"] == 1
    assert [(r["place"], r["reasons"]) for r in second.merges["reviews"].collect()] == [("existing", ["below_auto_merge_threshold"])]
    ann = s.nodes().where(F.col("key") == a).first()
    assert json.loads(ann["props"]["age"]) == 30 and json.loads(ann["props"]["_canonical"]) == a
    strict = resolve.Resolver(emb, resolve.ResolveConfig())  # local ids differ, and id is a conflict property
    assert s.ingest(parse_graph({"entities": [person("77", "Ann Smyth")]}), strict).new_nodes == 1
    with pytest.raises(IngestError):
        s.ingest(parse_graph({"entities": [person("5", "x")]}), resolve.Resolver(None))


# --- retrieval ---------------------------------------------------------------


def tables(spark):
    e = lambda i: [1.0 if j == i else 0.0 for j in range(3)]
    return retrieve.RetrievalGraph(
        spark.createDataFrame([(1, "Person", ["Person", "scope_text", "t1"], "ann", e(0)), (2, "City", ["City", "t1"], "rome", e(1)), (3, "Tool", ["Tool", "t1"], "saw", e(2))], "nid long, type string, labels array<string>, text string, vec array<double>"),
        spark.createDataFrame([(10, "c10", "about ann", e(0)), (11, "c11", "ann and rome", [0.6, 0.8, 0.0]), (12, "c12", "none", [0.0, 0.0, 0.0])], "nid long, chunk_id string, text string, vec array<double>"),
        spark.createDataFrame([(10, 1), (11, 1), (11, 2), (12, 3)], "chunk long, entity long"),
        spark.createDataFrame([(10, 90), (11, 90)], "chunk long, source long"), spark.createDataFrame([(90, "book")], "nid long, name string"),
    )


class Words(Fixed):
    dim = 3


def test_traversal_scores(spark):
    emb = Words({"who": [1.0, 0.0, 0.0], "rome": [0.0, 1.0, 0.0]})
    got = retrieve.traversal(tables(spark), TraversalQuery(("rome",), "who", limit=2), emb).collect()
    assert [(r["chunk_id"], round(r["score"], 6), r["source_name"], [x["etext"] for x in r["entities"]]) for r in got] == [("c11", 2.8, "book", ["ann", "rome"]), ("c10", 2.0, "book", ["ann"])]
    only = retrieve.traversal(tables(spark), TraversalQuery(("rome",), "who", entity_types=("City",)), emb).collect()
    assert {r["chunk_id"]: round(r["score"], 6) for r in only} == {"c11": 1.8, "c10": 1.0, "c12": 0.0}
    ranked = retrieve.traversal(tables(spark), TraversalQuery((), "who", rerank=True, limit=1), emb, vector.CosineReranker(Words({"who": [1, 0, 0], "about ann": [0, 1, 0], "ann and rome": [1, 0, 0]}))).collect()
    assert [(r["chunk_id"], r["rerank_score"]) for r in ranked] == [("c11", 1.0)]


def test_entity_types(spark):
    emb = Words({"who": [1.0, 0.0, 0.0], "person: a human": [1.0, 0.0, 0.0]})
    o = onto.Ontology.of({"people": {"entity_types": [{"name": "Person"}, {"name": "Pet", "description": ""}]}})
    got = retrieve.entity_types(tables(spark), EntityTypeQuery("who", include_neighbors=True), emb, o, "t1").collect()
    by = {r["entity_type"]: r for r in got}
    assert by["Person"]["score"] == 1.0 and by["Person"]["domain"] == "people" and by["Person"]["scopes"] == ["text"] and by["Person"]["samples"] == [1]
    assert by["Chunk"]["collections"] == {"text": 1.0} and by["Chunk"]["samples"] == [10, 11] and by["City"]["is_neighbor"] and by["City"]["score"] is None and "Tool" not in by
    assert retrieve.classify(["x", "t1", "scope_table", "y"], None, "t1") == ("x", "y", ["table"]) and retrieve.classify(["people", "Zed"], o) == ("Zed", "people", [])


def test_retrieval_over_a_stored_graph(store):
    emb = vector.HashingEmbedder(256)
    got = retrieve.traversal(retrieve.retrieval_graph(store, emb), TraversalQuery((), "north hall sensor", limit=1), emb).collect()
    assert got[0]["chunk_id"] == "c1" and got[0]["source_name"] == "site plan" and got[0]["entities"]


def test_missing_vectors_are_embedded_once(spark):
    emb = vector.HashingEmbedder(8)
    wanted = spark.createDataFrame([("a", "x y"), ("a", "x y"), ("b", "z"), ("b", None)], "kind string, text string").where("text is not null")
    first = vector.missing_vectors(wanted, spark.createDataFrame([], "vec_id string"), emb, "kind")
    assert first.count() == 2 and vector.missing_vectors(wanted, first, emb, "kind").count() == 0


def test_sentences_names_and_likeness(spark):
    df = spark.createDataFrame([("One. Two!  Three? ",)], "t string")
    assert df.select(scalars.sentences("t")).first()[0] == ["One.", "Two!", "Three?"]
    rows = [("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("", "", 0.0), ("a", "a", 1.0), ("a", "", 0.0), (None, "a", None), ("abcdefgh", "abzzzzzz", 0.6)]
    got = spark.createDataFrame([(a, b) for a, b, _ in rows], "a string, b string").select(scalars.jaro_winkler("a", "b")).collect()
    assert [None if r[0] is None else round(r[0], 6) for r in got] == [w for _, _, w in rows]
    names = [("type: P\nname: Ann", "Ann"), ("type: P\ntitle: X y", "X y"), ("type: P", ""), ("plain", "plain")]
    got = spark.createDataFrame(names, "c string, w string").select(scalars.primary_name(F.col("c")), "w").collect()
    assert all(r[0] == r[1] for r in got)


# --- exploration -------------------------------------------------------------


@pytest.fixture(scope="module")
def explorer(store):
    return Explorer(Engine(store.catalog()), onto.Ontology.of({"site": {"entity_types": [{"name": "Place", "properties": [{"name": "opened", "property_type": "Datetime"}]}]}}))


def test_cards_and_neighbours(explorer, store):
    nid = {r["key"]: r["nid"] for r in store.nodes().collect()}
    card = explorer.entity("hall", "Place").first()
    assert (card["type"], card["name"], len(card["sources"])) == ("Place", "North Hall", 1)
    near = explorer.neighbors(nid["hall"], "Place").collect()
    assert [(r["rel"], r["direction"], r["id"]) for r in near] == [("IN", "in", "s1"), ("mention", "out", str(nid["site plan"])), ("mentions", "in", "c1")]
    assert explorer.neighbors(nid["hall"], "Place", rels=["IN"], direction="out").count() == 0
    assert explorer.neighbors(nid["hall"], "Place", limit=1, offset=1).count() == 1


def test_overview_search_timeline(explorer):
    got = {(r["kind"], r["name"]): r["count"] for r in explorer.overview().collect()}
    assert got[("type", "Place")] == 2 and got[("relation", "IN")] == 2 and got[("total", "type")] == 4 and ("type", "Chunk") not in got
    assert [r["id"] for r in explorer.search("NORTH", mode="keyword").collect()] == ["hall"]
    assert explorer.search("north", mode="keyword", exact=True).count() == 0 and explorer.search("quiet", mode="keyword").count() == 0
    assert [r["id"] for r in explorer.search("quiet", "Chunk", mode="keyword").collect()] == ["c2"]
    page, total = explorer.entities_of_type("Place", limit=1)
    assert total == 2 and page.first()["name"] == "North Hall"
    assert [(r["date"], r["epoch"], r["id"]) for r in explorer.timeline("Place").collect()] == [("2020-01-05T00:00:00Z", 1578182400, "hall")]
    nodes, edges = explorer.subgraph_of_type("Sensor")
    assert nodes.count() == 2 and edges.count() == 0
    assert [r["name"] for r in explorer.sources().collect()] == ["site plan"]


def test_semantic_search_falls_back(store):
    e = Engine(store.catalog())
    e.indexes["Chunk"] = TextIndex(e.catalog.nodes["Chunk"].df, "nid", "text")
    x = Explorer(e)
    assert x.search("quiet yard").first()["id"] == "c2" and x.search("quiet yard", mode="semantic").first()["score"] > 0


def test_ask(store):
    doc = json.dumps({"start": {"label": "Place", "alias": "p"}, "return": [{"field": "p.name", "alias": "name"}], "sort": [{"field": "name"}]})
    said = []

    def model(messages):
        said.append(messages)
        return "Two places." if len(said) == 3 else "no json" if len(said) == 1 else doc

    x = Explorer(Engine(store.catalog()), model=model, prefix_label="t1")
    got = x.ask("which places are there?")
    assert [r["name"] for r in got["rows"]] == ["North Hall", "Yard"] and got["answer"] == "Two places." and got["attempts"] == 2
    assert got["query"].prefix_label == "t1" and got["nodes"].count() == 2 and [r["name"] for r in got["sources"].collect()] == ["site plan"]
    with pytest.raises(GraphError):
        Explorer(Engine(store.catalog())).ask("anything?")


def test_run_query_shows_the_visible_table(explorer):
    doc = {"start": {"label": "Place", "alias": "p"}, "traversals": [{"edge": {"label": "IN", "direction": "in"}, "target": {"label": "Sensor", "alias": "s"}}], "filters": [{"field": "s.state", "op": "eq", "value": "up"}], "return": [{"field": "s.id"}]}
    got = explorer.run_query(doc)
    assert got["table"].columns == ["s.id", "s.state"] and got["nodes"].count() == 2 and got["owners"]["s.state"] == "s" and len(got["trace"]) == 2


# --- schema, ontology, language ----------------------------------------------


def test_introspection(explorer):
    s = introspect.introspect(explorer.g)
    sensor = next(n for n in s.nodes if n.label == "Sensor")
    props = {p.name: p for p in sensor.properties}
    assert props["volts2"].type == "Float" and props["tags"].type == "List" and props["state"].values == ["down", "up"] and props["id"].values == []
    assert any((r.name, r.source, r.target) == ("IN", "Sensor", "Place") for r in s.relations)
    assert [introspect.infer(x) for x in ([1, 2], [1, 2.5], ["2024-01-01"], ["2024-01-01T10:00:00Z"], [1, "a"], [True], [[1]], [None], [{}])] == ["Int", "Float", "Date", "Datetime", "String", "Bool", "List", "String", "String"]
    assert [n.label for n in s.filtered("sens").nodes] == ["Sensor"]
    o = introspect.as_ontology(s)
    assert o.property("Sensor", "state").allowed_values == ["down", "up"] and o.entity("Chunk") is None
    only = introspect.project(s, [onto.Domain.of({"entity_types": [{"name": "Sensor", "properties": [{"name": "state", "allowed_values": ["Off"]}]}]})])
    assert [(p.name, p.values) for n in only.nodes if n.label == "Sensor" for p in n.properties] == [("state", ["down", "off", "up"])]
    assert introspect.narrow(s, "sensor state", vector.HashingEmbedder(256)).nodes


def test_ontology_service(tmp_path):
    s = onto.OntologyService(onto.FileStorage(str(tmp_path / "o.json")))
    d = {"entity_types": [{"name": "A", "properties": [{"name": "x", "property_type": "int"}]}]}
    assert s.create("one", d) == 1 and s.patch("one", {"entity_types": [{"name": "A", "properties": [{"name": "x", "property_type": "text"}, {"name": "y"}]}, {"name": "B"}]}, version=1) == 2
    got, version = s.get("one")
    assert version == 2 and [(p.name, p.type) for p in got.entity("A").properties] == [("x", "Number"), ("y", "Keyword")]
    with pytest.raises(onto.VersionConflict):
        s.replace("one", d, version=1)
    with pytest.raises(GraphError):
        s.create("one", d)
    s.rename("one", "two")
    assert s.import_all({"three": d}) == ["three"] and s.names() == ["three", "two"]
    assert s.refresh(onto.Ontology.of({"two": {"entity_types": [{"name": "B"}]}}), collect_garbage=True) == ["two"]
    assert [t.name for t in s.get("two")[0].entity_types] == ["B"]
    s.delete("two")
    with pytest.raises(Unsupported):
        onto.OntologyService(onto.ReadOnlyStorage({})).create("x", d)
    o = onto.Ontology.of({"cars": {"description": "cars engines"}, "food": {"description": "bread cheese"}})
    assert o.route("bread and cheese", vector.HashingEmbedder(256))[0][0] == "food"


def test_question_to_query_repairs(explorer):
    s = introspect.introspect(explorer.g)
    answers = iter(['I think {"start": {"label": "Sensor", "alias": "s"}, "return": []}', 'So: {"start": {"label": "Sensor", "alias": "s"}, "return": [{"field": "s.id"}], "prefix_label": "evil"} ok'])
    got = language.question_to_query("which sensors?", s, lambda m: next(answers), check=explorer.engine.plan, prefix_label="t1")
    assert got.attempts == 2 and got.query.prefix_label == "t1" and "corrected" in got.messages[3]["content"]
    with pytest.raises(QueryError):
        language.question_to_query("q", s, lambda m: "no idea", max_repairs=0)
    assert "(Sensor)-[IN]->(Place)" in language.system_prompt(s) and language.masked({"v": [0.1] * 20, "w": [1]}) == {"v": "<20 numbers>", "w": [1]}
    assert language.answer("q", [{"a": 1}], lambda m: " one ") == "one" and "Only add" in language.suggest_prompt(s, "t")


def test_streamed_documents(spark, tmp_path):
    from arcloom.streaming.ingest import ingest_stream

    (tmp_path / "in").mkdir()
    s = GraphStore(spark, str(tmp_path / "g"))
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"entities": [{"id": f"n{i}", "type": "T", "primary_key": {"strict": "id"}}, {"id": "same", "type": "T", "primary_key": {"strict": "id"}}], "relations": [{"from": f"n{i}", "to": "same", "type": "R"}]}))
    for _ in range(2):
        ingest_stream(s, str(tmp_path / "in"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert s.nodes().count() == 3 and s.edges().count() == 2
