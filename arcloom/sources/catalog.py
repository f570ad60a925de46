"""The graph as Spark sees it: node tables by label, edge tables by type.

A node table has one row per node and a column that identifies it among nodes
of its label.  An edge table has a source and a target column with such ids.
Foreign keys make edges too: then the edge row is the row of one of its ends
(`embedded`), and the compiler needs no join to get from the edge to that end,
nor from that end to the edge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges by which a node is traced to its source, and labels that are not entities.
PROVENANCE = ("mention", "part_of")
SOURCE, CHUNK = "Source", "Chunk"


#: A DataFrame, or how to get one: a query then opens only the tables it uses.
Frame = DataFrame | Callable[[], DataFrame]


@dataclass(frozen=True, eq=False)
class NodeTable:
    label: str
    frame: Frame
    key: str
    #: Column of array<string> with the labels of each node, if they vary.
    labels: str | None = None

    @cached_property
    def df(self) -> DataFrame:
        return self.frame() if callable(self.frame) else self.frame

    @cached_property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c != self.labels]


@dataclass(frozen=True, eq=False)
class EdgeTable:
    rel: str
    source_label: str
    target_label: str
    frame: Frame
    source: str
    target: str
    #: Identifies an edge among those of its table.
    key: str | Column | None = None
    #: "source" or "target": the edge row is that node's row.
    embedded: str | None = None
    #: Properties of the edge; None: all columns, but none if it is embedded.
    props: tuple[str, ...] | None = None

    @cached_property
    def df(self) -> DataFrame:
        return self.frame() if callable(self.frame) else self.frame

    @property
    def properties(self) -> list[str]:
        if self.props is not None:
            return list(self.props)
        return [] if self.embedded else [c for c in self.df.columns if c not in (self.source, self.target)]

    def key_column(self) -> Column:
        if self.key is None:
            return F.xxhash64(*[F.col(f"`{c}`") for c in self.df.columns])
        return self.key if isinstance(self.key, Column) else F.col(f"`{self.key}`")


@dataclass
class GraphCatalog:
    spark: SparkSession
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    edges: list[EdgeTable] = field(default_factory=list)

    def add_node(self, label: str, df: Frame, key: str, labels: str | None = None) -> GraphCatalog:
        self.nodes[label] = NodeTable(label, df, key, labels)
        return self

    def add_edge(self, rel: str, source_label: str, target_label: str, df: Frame, source: str, target: str, **kw) -> GraphCatalog:
        self.edges.append(EdgeTable(rel, source_label, target_label, df, source, target, **kw))
        return self

    def part(self, *labels: str) -> GraphCatalog:
        """The graph of some labels and the edges among them."""
        return GraphCatalog(self.spark, {x: self.nodes[x] for x in labels}, [e for e in self.edges if e.source_label in labels and e.target_label in labels])

    def labels(self) -> list[str]:
        return sorted(self.nodes)

    def rels(self) -> list[str]:
        return sorted({e.rel for e in self.edges})

    def find_edges(self, rels: Iterable[str], source_labels: set[str] | None, target_labels: set[str] | None) -> list[EdgeTable]:
        """Edge tables of these types (none: any) between these labels (None: any)."""
        rels = set(rels)
        return [
            e for e in self.edges
            if (not rels or e.rel in rels) and (source_labels is None or e.source_label in source_labels) and (target_labels is None or e.target_label in target_labels)
        ]

    def signatures(self) -> dict[str, set[tuple[str, str]]]:
        """Which labels each edge type joins; what direction correction works on."""
        out: dict[str, set[tuple[str, str]]] = {}
        for e in self.edges:
            out.setdefault(e.rel, set()).add((e.source_label, e.target_label))
        return out
