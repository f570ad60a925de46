"""Command line and vector collections."""

import io
import json

from pyspark.sql import functions as F

from arcloom import cli
from arcloom.operators import vector
from arcloom.operators.explore import Explorer
from arcloom.plans.compile import Engine
from arcloom.sources.tables import table_graph
from arcloom.sources.vectors import VectorStore, collection

DOC = {"start": {"label": "Region", "alias": "r"}, "return": [{"field": "r.r_name", "alias": "name"}], "sort": [{"field": "name"}], "limit": 2}


def test_cli(spark, sf_dir, tmp_path, capsys):
    f = tmp_path / "q.json"
    f.write_text(json.dumps(DOC))
    assert cli.main(["dsl", str(f)]) == 0 and "from Region r" in capsys.readouterr().out
    assert cli.main(["run", str(f), "--tables", sf_dir, "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"columns": ["name"], "rows": [{"name": "AFRICA"}, {"name": "AMERICA"}]}
    assert cli.main(["plan", str(f), "--tables", sf_dir], spark) == 0 and "FileScan" in capsys.readouterr().out
    g = tmp_path / "g.json"
    g.write_text(json.dumps({"source": "s", "entities": [{"id": "a", "type": "T", "primary_key": {"strict": "id"}}, {"id": "c", "type": "Chunk", "chunk_id": "c", "text": "some words"}]}))
    store = str(tmp_path / "store")
    assert cli.main(["ingest", str(g), "--store", store], spark) == 0 and "nodes=3" in capsys.readouterr().out
    assert cli.main(["schema", "--store", store], spark) == 0 and "(T)-[mention]->(Source)" in capsys.readouterr().out
    t = tmp_path / "t.json"
    t.write_text(json.dumps({"goal": "some words"}))
    assert cli.main(["traversal", str(t), "--store", store], spark) == 0 and json.loads(capsys.readouterr().out)["rows"][0]["chunk_id"] == "c"
    assert cli.main(["entity-type-search", "some words", "--store", store], spark) == 0 and "Chunk" in capsys.readouterr().out
    assert cli.main(["delete-by-source", "s", "--store", store], spark) == 0 and json.loads(capsys.readouterr().out) == {"source": 1, "chunk": 1, "entity": 1}


def test_shell(spark, sf_dir):
    out = io.StringIO()
    sh = cli.Shell(Explorer(Engine(table_graph(spark, sf_dir))), out)
    for line in ("open Nation 3", "ls", "go 0", "back", "trail", "table Region", "nonsense"):
        sh.onecmd(line)
    text = out.getvalue()
    assert "FROM_NATION\tin\tCustomer" in text and "Nation 3" in text and "ASIA" in text and sh.onecmd("quit")


def test_shell_asks_filters_shows_and_exports(spark, sf_dir, tmp_path):
    out = io.StringIO()
    answers = iter([json.dumps(DOC), "Africa and America."])
    sh = cli.Shell(Explorer(Engine(table_graph(spark, sf_dir)), model=lambda messages: next(answers)), out)
    for line in ("show table", "ask which regions?", "show nodes", "show trace", f'export "{tmp_path}/x.json"', "filter type Region", "open Nation 3", "ls", "go", "filter edge FROM_NATION", "filter type clear", "ls", "filter clear", "filter what", "format json", "table Region 3", "format xml"):
        sh.onecmd(line)
    text = out.getvalue()
    for part in ("nothing to show", "Africa and America.", "IN_REGION\tout\tRegion", "types: Region\tedges: all", "FROM_NATION\tin\tCustomer", "unknown filter what", '"columns"', "unknown format xml"):
        assert part in text
    assert {n["name"] for n in json.loads((tmp_path / "x.json").read_text())["nodes"]} == {"AFRICA", "AMERICA"}


def test_text_filters_from_the_command_line(spark, tmp_path, capsys):
    g, o, f = tmp_path / "g.json", tmp_path / "o.json", tmp_path / "q.json"
    g.write_text(json.dumps({"source": "s", "entities": [{"id": "a", "type": "Note", "primary_key": {"strict": "id"}, "body": {"type": "Text", "value": "a quiet yard"}}, {"id": "b", "type": "Note", "primary_key": {"strict": "id"}, "body": {"type": "Text", "value": "a loud hall"}}]}))
    o.write_text(json.dumps({"notes": {"entity_types": [{"name": "Note", "properties": [{"name": "body", "property_type": "text"}]}]}}))
    f.write_text(json.dumps({"start": {"label": "Note", "alias": "n"}, "filters": [{"field": "n.body", "op": "search", "value": "quiet yard", "cardinality": "many"}], "return": [{"field": "n.id", "alias": "id"}]}))
    store = str(tmp_path / "store")
    assert cli.main(["ingest", str(g), "--store", store, "--ontology", str(o)], spark) == 0
    assert VectorStore(spark, f"{store}/vectors").collections() == ["_canonical", "body"]
    capsys.readouterr()
    assert cli.main(["run", str(f), "--store", store, "--ontology", str(o), "--json"], spark) == 0
    assert {"id", "score", "sources"} == set(json.loads(capsys.readouterr().out)["columns"])


def test_vector_store(spark, tmp_path):
    s = VectorStore(spark, str(tmp_path), vector.HashingEmbedder(64))
    name = collection("T", "text", "t1")
    rows = spark.createDataFrame([(1, "T", "red apple"), (2, "T", "blue car"), (3, "U", "red car")], "nid long, label string, text string")
    s.upsert(name, rows)
    s.upsert(name, spark.createDataFrame([(2, "T", "green car")], "nid long, label string, text string"))
    assert name == "t1__T__text" and s.collections() == [name] and s.read(name).count() == 3
    assert s.search(name, "green car", 1).first()["nid"] == 2 and s.search(name, "red", 5, mode="lexical").count() == 2
    assert s.search(name, "car", 5, label="U", mode="hybrid").first()["nid"] == 3 and s.search(name, "zzz", 5, threshold=0.99).count() == 0
    s.sweep(spark.createDataFrame([(1,)], "nid long"))
    assert {r["nid"] for r in s.read(name).select("nid").collect()} == {2, 3}


def test_missing_collection_is_empty(spark, tmp_path):
    assert VectorStore(spark, str(tmp_path)).read("none").count() == 0 and VectorStore(spark, str(tmp_path)).collections() == []


def test_batch_searches_agree_with_single_ones(spark):
    docs = spark.createDataFrame([(i, t, [float(i), 1.0]) for i, t in enumerate(["a b c", "b b", "c d", "d"])], "nid long, text string, vec array<double>")
    one = [(r["nid"], round(r["score"], 9)) for r in vector.bm25(docs.select("nid", "text"), "b d", 3).collect()]
    many = vector.bm25_batch(spark.createDataFrame([(7, "b d")], "qid long, qtext string"), docs, 3).orderBy(F.desc("score"), "nid").collect()
    assert [(r["nid"], round(r["score"], 9)) for r in many] == one
    assert vector.bm25(docs.select("nid", "text"), "  ", 3).count() == 0


def test_prompts_mark_field_types_and_schemas_split_by_domain():
    from arcloom.operators.introspect import LiveProperty, LiveSchema, NodeKind, RelKind, project, split
    from arcloom.plans import language
    from arcloom.sources.ontology import Domain

    s = LiveSchema(
        [NodeKind("Firm", [LiveProperty("name", "String"), LiveProperty("since", "String"), LiveProperty("size", "Int")], domain="trade"), NodeKind("Ship", domain="sea"), NodeKind("Note")],
        [RelKind("OWNS", "Firm", "Firm"), RelKind("SAILS", "Ship", "Ship", domain="sea"), RelKind("CROSS", "Firm", "Ship"), RelKind("OF", "Note", "Firm")],
    )
    types = {("Firm", "name"): "Text", ("Firm", "since"): "Datetime", ("Firm", "size"): "Number"}
    text = language.system_prompt(s, types=types)
    assert "name String <SemanticText>" in text and "since String <Timestamp>" in text and "size Int)" in text
    assert len(language.type_hints(s, types)) == 2 and "hybrid_search" in text and "<" not in language.schema_text(s)
    got = split(s)
    assert list(got) == ["sea", "trade"] and [n.label for n in got["trade"].nodes] == ["Firm"]
    assert [r.name for r in got["trade"].relations] == ["OWNS"] and [r.name for r in got["sea"].relations] == ["SAILS"]
    only = project(s, [Domain.of({"entity_types": [{"name": "Ship"}], "relation_types": [{"name": "SAILS"}]})])
    assert only.relations[0].domain == "sea" and split(LiveSchema()) == {}
