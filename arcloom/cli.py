"""Command line: plan and run query documents, ingest and delete, show the schema, explore.

    python -m arcloom.cli run --tables DIR query.json
    python -m arcloom.cli ingest --store DIR graph.json
"""

from __future__ import annotations

import argparse
import cmd
import json
import sys
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import introspect, retrieve, vector
from .operators.explore import Explorer
from .operators.ingest import GraphStore
from .operators.resolve import Resolver
from .plans import dsl, language
from .plans.compile import Engine
from .plans.text import TextIndex
from .sources import config
from .sources.catalog import CHUNK, GraphCatalog
from .sources.graph_json import CANONICAL, parse_graph
from .sources.ontology import Ontology
from .sources.tables import table_graph
from .sources.vectors import VectorStore, collection


def rows_json(df: DataFrame, cap: int | None = None) -> str:
    """Columns and rows of a result, as JSON."""
    rows = (df if cap is None else df.limit(cap)).collect()
    return json.dumps({"columns": df.columns, "rows": [r.asDict(recursive=True) for r in rows]}, ensure_ascii=False, default=str)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="arcloom")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("dsl", "query.json"), ("plan", "query.json"), ("run", "query.json"), ("traversal", "query.json"), ("ingest", "graph.json"), ("delete-by-source", "NAME"), ("entity-type-search", "TEXT"), ("prompt", "QUESTION")):
        s = sub.add_parser(name)
        s.add_argument("input", metavar=what)
        _graph(s)
    for name in ("schema", "explore"):
        _graph(sub.add_parser(name))
    return p


def _graph(s: argparse.ArgumentParser) -> None:
    s.add_argument("--tables", help="folder of Parquet tables")
    s.add_argument("--store", help="folder of a stored graph")
    s.add_argument("--ontology", help="JSON file of the domains, for typed filters")
    s.add_argument("--json", action="store_true")


def text_indexes(store: GraphStore, catalog: GraphCatalog) -> dict[str, TextIndex]:
    """What text filters search: chunks by their text, every other type by its canonical text, with the vectors that ingest has stored."""
    out = {}
    for label, t in catalog.nodes.items():
        name = "text" if label == CHUNK else CANONICAL
        if name not in t.props:
            continue
        at = collection(name, "", store.prefix_index)
        if store.vectors is not None and at in store.vectors.collections():
            out[label] = TextIndex.stored(store.vectors, at) if label == CHUNK else TextIndex(store.vectors.read(at).where(F.col("label") == label), "nid", "text", store.vectors.embedder, vectors="vec")
        else:
            out[label] = TextIndex(t.df, t.key, name)
    return out


class Shell(cmd.Cmd):
    """ask QUESTION, search TEXT, open TYPE ID, ls, go [N], back, trail, types, table TYPE [OFFSET], timeline TYPE, run FILE, filter [type|edge NAMES|clear], show NAME, export FILE, format json|table, quit."""

    prompt = "> "

    def __init__(self, explorer: Explorer, out: Any = sys.stdout, store: GraphStore | None = None):
        super().__init__(stdout=out)
        self.x, self.store, self.trail, self.seen = explorer, store, [], []
        self.types: list[str] | None = None
        self.edges: list[str] | None = None
        self.json, self.last = False, {}

    def _say(self, *parts: Any) -> None:
        print(*parts, sep="\t", file=self.stdout)

    def _show(self, df: DataFrame) -> None:
        if self.json:
            print(rows_json(df), file=self.stdout)
            return
        for i, r in enumerate(df.collect()):
            self._say(i, *[v for v in r if v is not None])

    def do_ask(self, line: str) -> None:
        self.last = self.x.ask(line)
        self._show(self.last["table"])
        self._say(self.last["answer"])

    def do_search(self, line: str) -> None:
        found = self.x.search(_unquoted(line))
        self._show(found.where(F.col("type").isin(self.types)) if self.types else found)

    def do_types(self, line: str) -> None:
        self._show(self.x.overview().orderBy("kind", "name"))

    def do_open(self, line: str) -> None:
        label, _, id_ = line.partition(" ")
        self.trail.append((label, id_))
        self._show(self.x.entity(id_, label))

    def _around(self) -> DataFrame | None:
        if not self.trail:
            return None
        label, id_ = self.trail[-1]
        near = self.x.neighbors(id_, label, rels=self.edges)
        return near.where(F.col("type").isin(self.types)) if self.types else near

    def do_ls(self, line: str) -> None:
        near = self._around()
        if near is not None:
            self.seen = near.collect()
            for i, r in enumerate(self.seen):
                self._say(i, r["rel"], r["direction"], r["type"], r["id"], r["name"])

    def do_go(self, line: str) -> None:
        """To one of those listed; without a number, all that the filters let through."""
        if not line.strip():
            near = self._around()
            if near is not None:
                self._show(near)
            return
        r = self.seen[int(line)]
        self.do_open(f"{r['type']} {r['id']}")

    def do_back(self, line: str) -> None:
        if len(self.trail) > 1:
            self.trail.pop()
            label, id_ = self.trail.pop()
            self.do_open(f"{label} {id_}")

    def do_trail(self, line: str) -> None:
        print(*[" ".join(t) for t in self.trail], sep=" > ", file=self.stdout)

    def do_table(self, line: str) -> None:
        label, _, offset = line.strip().partition(" ")
        self._show(self.x.entities_of_type(label, offset=int(offset) if offset.strip().isdigit() else 0)[0])

    def do_timeline(self, line: str) -> None:
        self._show(self.x.timeline(line, 50))

    def do_run(self, line: str) -> None:
        self.last = self.x.run_query(dsl.parse_file(_unquoted(line)), 50)
        self._show(self.last["table"])

    def do_filter(self, line: str) -> None:
        """What search, ls and go show: filter type A,B; filter edge R; filter type clear; filter clear; alone, what is set."""
        kind, _, rest = line.strip().partition(" ")
        names = [x for x in rest.replace(",", " ").split() if x] or None
        if kind == "clear":
            self.types = self.edges = None
        elif kind in ("type", "edge"):
            value = None if names and names[0].lower() == "clear" else names
            self.types, self.edges = (value, self.edges) if kind == "type" else (self.types, value)
        elif kind:
            self._say(f"unknown filter {kind}")
            return
        self._say(f"types: {', '.join(self.types) if self.types else 'all'}", f"edges: {', '.join(self.edges) if self.edges else 'all'}")

    def do_show(self, line: str) -> None:
        """table, nodes, sources or trace of the last question or query."""
        got = self.last.get(line.strip().lower())
        if isinstance(got, DataFrame):
            self._show(got)
        elif got:
            self._say(*(got if isinstance(got, list) else [got]))
        else:
            self._say("nothing to show")

    def do_export(self, line: str) -> None:
        """The nodes of the last result and the edges among them, as a graph document if they are of a stored graph, else as rows."""
        nodes = self.last.get("nodes")
        if nodes is None:
            self._say("nothing to export")
            return
        if self.store is not None:
            out = self.store.export(nodes.select(F.col("nid").cast("long").alias("nid")))
        else:
            rows, edges = self.x.subgraph(nodes)
            out = {"nodes": [r.asDict() for r in rows.collect()], "edges": [r.asDict() for r in edges.collect()]}
        Path(_unquoted(line)).write_text(json.dumps(out, ensure_ascii=False, default=str), encoding="utf-8")
        self._say(f"written to {_unquoted(line)}")

    def do_format(self, line: str) -> None:
        if line.strip() in ("json", "table"):
            self.json = line.strip() == "json"
        else:
            self._say(f"unknown format {line}")

    def do_quit(self, line: str) -> bool:
        return True


def _unquoted(line: str) -> str:
    line = line.strip()
    return line[1:-1] if len(line) > 1 and line[0] == line[-1] and line[0] in "\"'" else line


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "dsl":
        print(dsl.parse_file(a.input).describe())
        return 0
    cfg = config.load(a.config)
    spark = spark or SparkSession.builder.appName("arcloom").getOrCreate()
    embedder = vector.HashingEmbedder()
    ontology = Ontology.of(json.loads(Path(a.ontology).read_text(encoding="utf-8"))) if a.ontology else None
    types = ontology.field_types() if ontology else {}
    store, folder = None, a.store or cfg.store_path
    if folder:
        texts: dict[str, list[str]] = {}
        for (label, name), kind in types.items():
            if kind == "Text":
                texts.setdefault(label, []).append(name)
        store = GraphStore(spark, folder, cfg.prefix_label, VectorStore(spark, f"{folder}/vectors", embedder), texts)
    if a.command == "ingest":
        print(store.ingest(parse_graph(Path(a.input).read_text(encoding="utf-8")), Resolver(embedder, cfg.resolve)))
        return 0
    if a.command == "delete-by-source":
        print(json.dumps(store.delete_by_source(a.input)[0]))
        return 0
    if a.command == "traversal":
        df = retrieve.traversal(retrieve.retrieval_graph(store, embedder), dsl.parse_traversal(Path(a.input).read_text(encoding="utf-8")), embedder, vector.CosineReranker(embedder))
        print(rows_json(df))
        return 0
    if a.command == "entity-type-search":
        print(rows_json(retrieve.entity_types(retrieve.retrieval_graph(store, embedder), dsl.EntityTypeQuery(a.input), embedder)))
        return 0
    catalog = table_graph(spark, a.tables) if a.tables else store.catalog()
    engine = Engine(catalog, cfg.query, types=types, indexes={} if a.tables else text_indexes(store, catalog))
    if a.command == "plan":
        print(engine.explain(dsl.parse_file(a.input)))
    elif a.command == "run":
        df = engine.plan(dsl.parse_file(a.input))
        print(rows_json(df)) if a.json else df.show(truncate=False)
    elif a.command == "schema":
        print(language.schema_text(introspect.introspect(engine.catalog), types))
    elif a.command == "prompt":
        print(language.system_prompt(introspect.introspect(engine.catalog), types=types, registry=engine.registry), language.query_prompt(a.input), sep="\n\n")
    else:
        Shell(Explorer(engine, ontology, prefix_label=cfg.prefix_label), store=None if a.tables else store).cmdloop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
