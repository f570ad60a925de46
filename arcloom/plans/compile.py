"""From a query document to a DataFrame.

Every node alias is a struct column with `nid`, `label` and the properties,
every edge alias one with `eid`, `rel`, `tab`, `src`, `dst` and properties, so
`a.p` is a field of a column; Catalyst removes the structs and prunes and pushes
down through them.  User values enter as literals only.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FieldTypeError, LoweringError
from ..functions.scalars import date_part
from ..functions.types import QUERY_HANDLER, Registry, plain_predicate, storage_type, typed_op
from ..sources.catalog import PROVENANCE, SOURCE, EdgeTable, GraphCatalog, NodeTable
from . import dsl
from .dsl import Filter, GroupKey, Hop, Query, Return, Settings, Sort
from .text import TextIndex, TextPredicate, fold_text

_SORTABLE_NOT = (T.ArrayType, T.MapType)


def _q(name: str) -> str:
    return f"`{name}`"


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


#: Pairs of rows that meet at one node, from which they are spread over tasks.
PAIRS = 4_000_000


class Binding:
    """What is known of an alias while a plan grows."""

    def __init__(self, alias: str, labels: set[str] | None, node: bool = True, many: bool = False):
        self.alias, self.labels, self.node, self.many = alias, labels, node, many
        #: Many rows may hold one node, so a hop from it multiplies them.
        self.shared = False


class Compiler:
    def __init__(self, catalog: GraphCatalog, query: Query, settings: Settings, registry: Registry, types: Mapping[tuple[str, str], str], indexes: Mapping[str | tuple[str, str], TextIndex]):
        self.g, self.q, self.s, self.registry, self.types, self.indexes = catalog, query, settings, registry, types, indexes
        self.bound: dict[str, Binding] = {}
        self.scores: list[str] = []
        self.order: list[Column] = []
        self.df: DataFrame

    # --- names and columns ---------------------------------------------------

    def kind(self, alias: str, prop: str) -> T.DataType | None:
        """Type of a property, None where no such property exists."""
        t = self.df.schema[alias].dataType
        if isinstance(t, T.StructType) and prop in t.names:
            return t[prop].dataType
        if prop == "id" and isinstance(t, T.StructType):
            return t["nid" if self.bound[alias].node else "eid"].dataType
        return None

    def column(self, ref: str) -> tuple[Column, T.DataType]:
        alias, _, prop = ref.partition(".")
        if alias not in self.bound:
            raise LoweringError(f"unknown alias {alias!r}")
        if not prop:
            return F.col(_q(alias)), self.df.schema[alias].dataType
        if self.bound[alias].many:
            raise LoweringError(f"{alias!r} is a list of edges and has no properties")
        kind = self.kind(alias, prop)
        if kind is None:
            return F.lit(None).cast("string"), T.StringType()
        t = self.df.schema[alias].dataType
        name = prop if prop in t.names else "nid" if self.bound[alias].node else "eid"
        return F.col(_q(alias))[name], kind

    def identity(self, alias: str) -> Column:
        b = self.bound[alias]
        return F.col(_q(alias)) if b.many else F.col(_q(alias))["nid" if b.node else "eid"]

    # --- scans ---------------------------------------------------------------

    def labels_of(self, label: str) -> set[str]:
        """Tables that hold nodes of a label: its own, those that list it, all without one."""
        if not label:
            return set(self.g.nodes)
        own = {label} if label in self.g.nodes else set()
        return own or {name for name, t in self.g.nodes.items() if t.labels}

    def node_struct(self, t: NodeTable, alias: str, df: DataFrame | None = None) -> Column:
        fields = [F.col(_q(t.key)).alias("nid"), F.lit(t.label).alias("label")]
        fields += [F.col(_q(p)).alias(p) for p in t.props if p not in ("nid", "label")]
        return F.struct(*fields).alias(alias)

    def scan(self, alias: str, label: str, among: set[str] | None = None) -> DataFrame:
        """One struct column named alias; without a label, of the tables among which it can only lie."""
        names = sorted(self.labels_of(label) & among if among and not label else self.labels_of(label))
        if not names:
            raise LoweringError(f"no nodes of label {label!r}")
        frames = []
        for name in names:
            t = self.g.nodes[name]
            df = t.df
            if t.labels and label and name != label:
                df = df.where(F.array_contains(F.col(_q(t.labels)), label))
            if self.q.prefix_label and t.labels:
                df = df.where(F.array_contains(F.col(_q(t.labels)), self.q.prefix_label))
            frames.append((t, df))
        self.bound[alias] = Binding(alias, set(names))
        if len(frames) == 1:
            t, df = frames[0]
            return df.select(self.node_struct(t, alias))
        # many labels: properties by name, of one type or as text
        kinds: dict[str, set[str]] = {}
        for t, df in frames:
            for p in t.props:
                kinds.setdefault(p, set()).add(df.schema[p].dataType.simpleString())
        ids = {df.schema[t.key].dataType.simpleString() for t, df in frames}
        id_kind = ids.pop() if len(ids) == 1 else "string"
        out = []
        for t, df in frames:
            fields = [F.col(_q(t.key)).cast(id_kind).alias("nid"), F.lit(t.label).alias("label")]
            for p in sorted(kinds):
                if p in ("nid", "label"):
                    continue
                kind = next(iter(kinds[p])) if len(kinds[p]) == 1 else "string"
                fields.append((F.col(_q(p)).cast(kind) if p in t.props else F.lit(None).cast(kind)).alias(p))
            out.append(df.select(F.struct(*fields).alias(alias)))
        return union_all(out)

    # --- hops ----------------------------------------------------------------

    def edge_struct(self, e: EdgeTable, near_far: bool = True) -> Column:
        tab = self.g.edges.index(e)
        key = e.key_column()
        fields = [key.cast("long").alias("eid") if not isinstance(e.key, str) or _integral(e.df, e.key) else F.xxhash64(key).alias("eid")]
        fields += [F.lit(e.rel).alias("rel"), F.lit(tab).alias("tab"), F.col(_q(e.source)).alias("src"), F.col(_q(e.target)).alias("dst")]
        fields += [F.col(_q(p)).alias(p) for p in e.properties]
        return F.struct(*fields)

    def variants(self, hop: Hop, near: set[str] | None, far: set[str] | None) -> list[tuple[EdgeTable, bool]]:
        """(edge table, forward) of every way to go; for both ways self-loops count once."""
        out: list[tuple[EdgeTable, bool]] = []
        if hop.direction in ("out", "both"):
            out += [(e, True) for e in self.g.find_edges(hop.rels, near, far)]
        if hop.direction in ("in", "both"):
            out += [(e, False) for e in self.g.find_edges(hop.rels, far, near)]
        return out

    def edge_rows(self, variants: list[tuple[EdgeTable, bool]], both: bool, id_kind: str | None) -> DataFrame:
        """__near, __near_label, __far, __far_label, __edge of all variants."""
        frames, seen = [], set()
        structs: list[tuple[EdgeTable, bool, DataFrame]] = []
        for e, forward in variants:
            df = e.df
            if both and not forward and id(e) in seen:
                df = df.where(F.col(_q(e.source)) != F.col(_q(e.target))) if e.source_label == e.target_label else df
            seen.add(id(e))
            structs.append((e, forward, df))
        plain = len(structs) == 1
        for e, forward, df in structs:
            near, far = (e.source, e.target) if forward else (e.target, e.source)
            near_label, far_label = (e.source_label, e.target_label) if forward else (e.target_label, e.source_label)
            edge = self.edge_struct(e)
            cols = [
                (F.col(_q(near)).cast(id_kind) if id_kind else F.col(_q(near))).alias("__near"), F.lit(near_label).alias("__near_label"),
                (F.col(_q(far)).cast(id_kind) if id_kind else F.col(_q(far))).alias("__far"), F.lit(far_label).alias("__far_label"),
            ]
            if plain:
                frames.append(df.select(*cols, edge.alias("__edge")))
            else:  # structs of different fields: the common ones, and properties by name as text where types differ
                frames.append(df.select(*cols, *self._loose_edge(e, [x for x, _, _ in structs])))
        out = union_all(frames)
        if not plain:
            names = [c for c in out.columns if c.startswith("__e_")]
            out = out.select("__near", "__near_label", "__far", "__far_label", F.struct(*[F.col(_q(c)).alias(c[4:]) for c in names]).alias("__edge"))
        return out

    def _loose_edge(self, e: EdgeTable, all_: list[EdgeTable]) -> list[Column]:
        kinds: dict[str, set[str]] = {}
        for x in all_:
            for p in x.properties:
                kinds.setdefault(p, set()).add(x.df.schema[p].dataType.simpleString())
        key = e.key_column()
        cols = [
            (key.cast("long") if not isinstance(e.key, str) or _integral(e.df, e.key) else F.xxhash64(key)).alias("__e_eid"),
            F.lit(e.rel).alias("__e_rel"), F.lit(self.g.edges.index(e)).alias("__e_tab"),
            F.col(_q(e.source)).cast("string").alias("__e_src"), F.col(_q(e.target)).cast("string").alias("__e_dst"),
        ]
        for p in sorted(kinds):
            kind = next(iter(kinds[p])) if len(kinds[p]) == 1 else "string"
            cols.append((F.col(_q(p)).cast(kind) if p in e.properties else F.lit(None).cast(kind)).alias(f"__e_{p}"))
        return cols

    def hop(self, hop: Hop, group: list[str], index: int) -> None:
        source = self.bound.get(hop.source)
        if source is None or not source.node:
            raise LoweringError(f"unknown alias {hop.source!r}")
        depth = hop.depth or (1, 1)
        if depth[1] > self.s.max_depth:
            raise LoweringError(f"depth {depth[1]} is over {self.s.max_depth}")
        edge_alias = hop.edge_alias or f"__edge_{index}"
        far = self.labels_of(hop.target.label) if hop.target.label else None
        if depth == (1, 1):
            rows = self._single(hop, source, far, edge_alias, group)
        else:
            rows = self._many(hop, source, far, edge_alias, depth, group)
        self.df = rows
        self.bound[edge_alias] = Binding(edge_alias, None, node=False, many=depth != (1, 1))
        group.append(edge_alias)

    def _single(self, hop: Hop, source: Binding, far: set[str] | None, edge_alias: str, group: list[str]) -> DataFrame:
        variants = self.variants(hop, source.labels, far)
        here = F.col(_q(hop.source))
        how = "left" if hop.optional else "inner"
        target = hop.target.alias
        if not variants:
            return self._nothing(hop, edge_alias, how)
        if len(variants) == 1 and source.labels and len(source.labels) == 1:
            (e, forward) = variants[0]
            near, far_col = (e.source, e.target) if forward else (e.target, e.source)
            far_label = e.target_label if forward else e.source_label
            t = self.g.nodes.get(far_label)
            near_table = self.g.nodes.get(next(iter(source.labels)))
            if t is not None and not t.labels and not self.q.prefix_label:
                if e.embedded == ("source" if forward else "target") and near_table and far_col in near_table.props and not group_overlaps(self, group, [e]):
                    # the edge is in the row we hold: one join, to the target
                    side = t.df.select(F.col(_q(t.key)).alias("__far"), self.node_struct(t, target))
                    joined = self.df.join(side, here[far_col] == F.col("__far"), how)
                    edge = F.struct(
                        here["nid"].cast("long").alias("eid") if _integral(near_table.df, near_table.key) else F.xxhash64(here["nid"]).alias("eid"),
                        F.lit(e.rel).alias("rel"), F.lit(self.g.edges.index(e)).alias("tab"), (here["nid"] if forward else here[far_col]).alias("src"),
                        (here[far_col] if forward else here["nid"]).alias("dst"), *[here[p].alias(p) for p in e.properties],
                    )
                    self.bound[target] = Binding(target, {far_label})
                    self.bound[target].shared = True
                    self._tables = getattr(self, "_tables", {})
                    self._tables[edge_alias] = {self.g.edges.index(e)}
                    return joined.withColumn(edge_alias, F.when(F.col("__far").isNotNull(), edge)).drop("__far")
                if e.embedded == ("target" if forward else "source"):
                    # the edge row is the target's row: one join, to it
                    side = e.df.select(F.col(_q(near)).alias("__near"), self.edge_struct(e).alias(edge_alias), self._struct_of(t, e, target, far_col))
                    if source.shared and how == "inner":
                        joined = self._spread(side, here["nid"], F.col(_q(target))["nid"])
                    else:
                        joined = self.df.join(side, here["nid"] == F.col("__near"), how).drop("__near")
                    source.shared = True
                    self.bound[target] = Binding(target, {far_label})
                    return self._distinct_edges(joined, edge_alias, group, [e], how, [target, edge_alias])
        multi = not (source.labels and len(source.labels) == 1)
        rows = self.edge_rows(variants, hop.direction == "both", None if len(variants) == 1 else self._id_kind(variants))
        ends = {(e.target_label if f else e.source_label) for e, f in variants}
        nodes = self.scan(target, hop.target.label, ends)
        if hop.target.label == "" or len(self.bound[target].labels or ()) > 1:
            there = _same(F.col("__far"), rows.schema["__far"].dataType, F.col(_q(target))["nid"], nodes.schema[target].dataType["nid"].dataType)
            on = there & (F.col("__far_label") == F.col(_q(target))["label"])
        else:
            on = F.col("__far") == F.col(_q(target))["nid"]
        side = rows.join(nodes, on).select(
            F.col("__near").alias("__near"), "__near_label", F.col("__edge").alias(edge_alias), F.col(_q(target))
        )
        self.bound[target].labels = (self.bound[target].labels or set()) & ends if self.bound[target].labels else ends
        match = _same(here["nid"], self.df.schema[hop.source].dataType["nid"].dataType, F.col("__near"), rows.schema["__near"].dataType)
        if multi or len({(e.source_label if f else e.target_label) for e, f in variants}) > 1:
            match = match & (here["label"] == F.col("__near_label"))
        joined = self.df.join(side, match, how).drop("__near", "__near_label")
        return self._distinct_edges(joined, edge_alias, group, [e for e, _ in variants], how, [target, edge_alias])

    def _spread(self, side: DataFrame, near: Column, far: Column) -> DataFrame:
        """The join of the rows held with side on __near where both have many rows of a node.

        All pairs of a node would be made in one task, or those of all nodes where
        the rows came in one part. Nodes with more than PAIRS pairs have their side
        split by its id, each part meeting all rows held; tasks are by node and part,
        and of a fixed number, as their inputs are too small for Spark to tell.
        """
        spark = self.g.spark
        held = self.df.groupBy(near.alias("__hot")).agg(F.count("*").alias("__l"))
        pairs = held.join(side.groupBy("__near").agg(F.count("*").alias("__r")), F.col("__hot") == F.col("__near")).withColumn("__p", F.col("__l") * F.col("__r"))
        hot = F.broadcast(pairs.where(F.col("__p") > PAIRS).select("__hot", F.ceil(F.col("__p") / PAIRS).cast("int").alias("__parts")))
        part, parts = F.col("__part"), F.coalesce("__parts", F.lit(1))
        left = self.df.withColumn("__key", near).join(hot, F.col("__key") == F.col("__hot"), "left")
        left = left.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__hot", "__parts")
        right = side.join(hot, F.col("__near") == F.col("__hot"), "left").withColumn("__side", F.pmod(F.xxhash64(far), parts).cast("int")).drop("__hot", "__parts")
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
        joined = left.repartition(tasks, "__key", "__part").join(right, (F.col("__key") == F.col("__near")) & (part == F.col("__side")))
        return joined.drop("__key", "__part", "__near", "__side")

    def _struct_of(self, t: NodeTable, e: EdgeTable, alias: str, key: str) -> Column:
        fields = [F.col(_q(key)).alias("nid"), F.lit(t.label).alias("label")]
        return F.struct(*fields, *[F.col(_q(p)).alias(p) for p in t.props if p not in ("nid", "label")]).alias(alias)

    def _nothing(self, hop: Hop, edge_alias: str, how: str) -> DataFrame:
        """No such edges: no rows, or rows without a target."""
        nodes = self.scan(hop.target.alias, hop.target.label).schema[hop.target.alias].dataType
        edge = "struct<eid:bigint,rel:string,tab:int,src:string,dst:string>"
        df = self.df if how == "left" else self.df.where(F.lit(False))
        return df.withColumn(edge_alias, F.lit(None).cast(edge)).withColumn(hop.target.alias, F.lit(None).cast(nodes))

    def _id_kind(self, variants: list[tuple[EdgeTable, bool]]) -> str | None:
        kinds = {e.df.schema[c].dataType.simpleString() for e, _ in variants for c in (e.source, e.target)}
        return None if len(kinds) == 1 else "bigint" if kinds <= {"int", "bigint"} else "string"

    def _distinct_edges(self, df: DataFrame, edge: str, group: list[str], tables: list[EdgeTable], how: str, drop: list[str]) -> DataFrame:
        """Within one pattern no edge is used twice."""
        for other in group:
            if not group_overlaps(self, [other], tables):
                continue
            e, o = F.col(_q(edge)), F.col(_q(other))
            if self.bound[other].many:
                same = _holds(o, e["eid"], e["tab"])
            else:
                same = (e["eid"] == o["eid"]) & (e["tab"] == o["tab"])
            df = df.where(~F.coalesce(same, F.lit(False)))
        self._tables = getattr(self, "_tables", {})
        self._tables[edge] = {self.g.edges.index(t) for t in tables}
        return df

    def _many(self, hop: Hop, source: Binding, far: set[str] | None, edge_alias: str, depth: tuple[int, int], group: list[str]) -> DataFrame:
        """Paths of min..max edges, none twice: one join per step, and a last one to the target.

        A path that is long enough goes on in two rows: one stays as it is and
        passes the further joins, the other must find an edge, so no step is
        planned twice. Paths hold edges' numbers only, unless the list of
        edges itself is asked for.
        """
        variants = self.variants(hop, None, None)
        target = hop.target.alias
        if not variants:
            return self._nothing(hop, edge_alias, "left" if hop.optional else "inner")
        labels = {x for e, _ in variants for x in (e.source_label, e.target_label)}
        rows = self.edge_rows(variants, hop.direction == "both", self._id_kind(variants))
        step = F.col("__edge") if self._shown(edge_alias) else F.struct(F.col("__edge.eid").alias("eid"), F.col("__edge.tab").alias("tab"))
        rows = rows.select("__near", "__near_label", "__far", "__far_label", step.alias("__step"))
        here = F.col(_q(hop.source))
        step_kind = rows.schema["__step"].dataType.simpleString()
        one_label = len(labels) == 1
        first = self.df
        if hop.optional:
            first = self.df.select(here["nid"].alias("__from"), here["label"].alias("__from_label")).distinct()
            cur = first.withColumn("__at", F.col("__from")).withColumn("__at_label", F.col("__from_label"))
        else:
            cur = first.withColumn("__at", here["nid"]).withColumn("__at_label", here["label"])
        cur = cur.withColumn(edge_alias, F.array().cast(f"array<{step_kind}>"))
        kind = rows.schema["__near"].dataType.simpleString()
        cur = cur.withColumn("__at", F.col("__at").cast(kind))
        tables = [e for e, _ in variants]
        path, go = F.col(_q(edge_alias)), F.col("__go")
        for k in range(1, depth[1] + 1):
            used = _holds(path, F.col("__step.eid"), F.col("__step.tab"))
            fresh = F.lit(True) if k == 1 else ~used
            if not hop.optional:
                for other in group:
                    if group_overlaps(self, [other], tables):
                        o = F.col(_q(other))
                        same = (
                            _holds(o, F.col("__step.eid"), F.col("__step.tab"))
                            if self.bound[other].many
                            else (o["eid"] == F.col("__step.eid")) & (o["tab"] == F.col("__step.tab"))
                        )
                        fresh = fresh & ~F.coalesce(same, F.lit(False))
            longer = {
                edge_alias: F.concat(path, F.array("__step")), "__at": F.col("__far"), "__at_label": F.col("__far_label"),
            }
            if k - 1 < depth[0]:  # too short to stay
                on = F.col("__at") == F.col("__near")
                if not one_label:
                    on = on & (F.col("__at_label") == F.col("__near_label"))
                nxt = cur.join(rows, on).where(fresh).withColumns(longer)
            else:
                ways = F.when(F.size(path) == k - 1, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
                cur = cur.withColumn("__go", F.explode(ways))
                on = F.when(go, F.col("__at")) == F.col("__near")
                if not one_label:
                    on = on & (F.col("__at_label") == F.col("__near_label"))
                nxt = cur.join(rows, on, "left").where(~go | (F.col("__near").isNotNull() & fresh))
                nxt = nxt.withColumns({c: F.when(go, x).otherwise(F.col(_q(c))) for c, x in longer.items()}).drop("__go")
            cur = nxt.drop("__near", "__near_label", "__far", "__far_label", "__step")
        paths = cur
        nodes = self.scan(target, hop.target.label, labels)
        node = F.col(_q(target))
        on = _same(F.col("__at"), rows.schema["__near"].dataType, node["nid"], nodes.schema[target].dataType["nid"].dataType)
        if not one_label or len(self.bound[target].labels or ()) > 1:
            on = on & (F.col("__at_label") == node["label"])
        done = paths.join(nodes, on).drop("__at", "__at_label")
        self._tables = getattr(self, "_tables", {})
        self._tables[edge_alias] = {self.g.edges.index(t) for t in tables}
        if hop.optional:
            return self.df.join(done, (here["nid"] == F.col("__from")) & (here["label"] == F.col("__from_label")), "left").drop("__from", "__from_label")
        return done

    def _shown(self, edge_alias: str) -> bool:
        """Whether the edges of a path are looked at, beyond being counted."""
        refs = [r.field for r in self.q.returns if r.aggregate != "count"] + [x.field for part in (self.q.filters, self.q.group_by, self.q.sort) for x in part]
        return any(ref.partition(".")[0] == edge_alias for ref in refs)

    # --- filters -------------------------------------------------------------

    def predicate(self, f: Filter) -> Column:
        c, kind = self.column(f.field)
        handler = f.type or self.inferred(f.field)
        if handler is None:
            if f.op not in dsl.PLAIN_OPS:
                raise LoweringError(f"unknown operator {f.op!r}")
            return plain_predicate(c, kind, f.op, f.value)
        h = self.registry.get(handler)
        op = typed_op(f.op) if f.op not in h.supported_ops() else f.op
        if op not in h.supported_ops():
            raise FieldTypeError(f"{h.type_id} has no operator {op!r}")
        return h.predicate(c, kind, op, f.value)

    def apply(self, f: Filter) -> None:
        """One filter of the AND list: a predicate, or what the field's handler contributes."""
        handler = f.type or self.inferred(f.field)
        h = self.registry.get(handler) if handler else None
        contribute = getattr(h, "contribute", None)
        if contribute is None:
            self.df = self.df.where(self.predicate(f))
            return
        c, kind = self.column(f.field)
        got = contribute(c, kind, f.op, f.value)
        if got.hits is not None:
            alias = f.field.partition(".")[0]
            score = f"__score_{len(self.scores)}_{alias}"
            scored = "score" in got.hits.columns
            hits = got.hits.select(F.col("nid").alias("__hit"), *([F.col("score").alias(score)] if scored else []))
            self.df = self.df.join(hits, F.col(_q(alias))["nid"] == F.col("__hit"), "inner").drop("__hit")
            if scored:
                self.scores.append(score)
        if got.predicate is not None:
            self.df = self.df.where(got.predicate)
        self.order += got.order

    def condition(self, tree: Any) -> Column:
        """A tree of filters, with three-valued logic."""
        if isinstance(tree, Filter):
            if tree.field.partition(".")[0] not in self.bound:
                raise LoweringError(f"unknown alias {tree.field.partition('.')[0]!r}")
            return self.predicate(tree)
        if isinstance(tree, dsl.Not):
            return ~self.condition(tree.part)
        parts = [self.condition(p) for p in tree.parts]
        if isinstance(tree, dsl.AllOf):
            return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
        return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)

    def inferred(self, field: str) -> str | None:
        """Handler that the ontology gives to a field, unless the filter names one."""
        alias, _, prop = field.partition(".")
        for label in sorted(self.bound[alias].labels or ()):
            declared = self.types.get((label, prop))
            if declared:
                return QUERY_HANDLER[storage_type(declared)]
        return None

    # --- the whole -----------------------------------------------------------

    def compile(self) -> DataFrame:
        q = self.q
        aliases = q.node_aliases()
        edges = {h.edge_alias for h in q.traversals if h.edge_alias}
        for ref in [f.field for f in q.filters] + [r.field for r in q.returns] + [g.field for g in q.group_by]:
            if ref.partition(".")[0] not in aliases and ref.partition(".")[0] not in edges:
                raise LoweringError(f"unknown alias {ref.partition('.')[0]!r}")
        texts, plain = fold_text(q, self.registry, self.types)
        self.df = self.scan(q.start.alias, q.start.label)
        pins = {t.alias: t for t in texts}
        self._pin(pins, q.start.alias)
        required = [h for h in q.traversals if not h.optional]
        optional = [h for h in q.traversals if h.optional]
        group: list[str] = []
        last = q.start.alias
        for i, h in enumerate(required):
            if h.source != last:
                group = []  # a sibling: another pattern, whose edges may repeat
            self.hop(h, group, i)
            self._pin(pins, h.target.alias)
            last = h.target.alias
        late_aliases = {h.target.alias for h in optional}
        early = [f for f in plain if f.field.partition(".")[0] not in late_aliases and f.field.partition(".")[0] in self.bound]
        for f in early:
            self.apply(f)
        late = [f for f in plain if f not in early]
        for i, h in enumerate(optional):
            before = self.df
            self.hop(h, [], len(required) + i)
            if self.s.strict_optional_where:
                own = [f for f in late if f.field.partition(".")[0] in (h.target.alias, h.edge_alias)]
                if own:
                    self._keep_outer(before, h, own)
                    late = [f for f in late if f not in own]
            self._pin(pins, h.target.alias)
        for f in late:
            self.apply(f)
        if q.where is not None:
            self.df = self.df.where(self.condition(q.where))
        return self._project()

    def _keep_outer(self, before: DataFrame, h: Hop, own: list[Filter]) -> None:
        """The literal reading: filters on an optional target belong to its pattern, and the outer row stays."""
        ok = reduce(lambda a, b: a & b, [F.coalesce(self.predicate(f), F.lit(False)) for f in own])
        known = [a for a in self.bound if self.bound[a].node and a in before.columns]
        ids = [F.col(_q(a))[f].alias(f"__k_{f}_{a}") for a in known for f in ("label", "nid")]
        good = self.df.where(ok)
        keys = good.select(*ids).distinct()
        on = reduce(lambda a, b: a & b, [F.col(_q(a))[f].eqNullSafe(F.col(f"__k_{f}_{a}")) for a in known for f in ("nid", "label")])
        rest = before.join(keys, on, "left_anti")
        self.df = good.unionByName(rest, allowMissingColumns=True)

    def _pin(self, pins: dict[str, TextPredicate], alias: str) -> None:
        """Joins a retrieval's hits to its alias; the score becomes a column."""
        if alias not in pins:
            return
        p = pins[alias]
        labels = sorted(self.bound[alias].labels or ())
        # a tenant's collections are its own
        own = {x: self.indexes.get((self.q.prefix_index, x) if self.q.prefix_index else x) for x in labels}
        indexed = [x for x in labels if own[x] is not None]
        if not indexed:
            raise LoweringError(f"no text index for {', '.join(labels)}")
        name, node = f"__score_{alias}", F.col(_q(alias))
        nid_kind = self.df.schema[alias].dataType["nid"].dataType
        frames = []
        for label in indexed:
            hits = own[label].retrieve(p, self.s)
            nid = F.col("nid") if len(indexed) == 1 else F.col("nid").cast("string")
            frames.append(hits.select(nid.alias("__hit"), F.lit(label).alias("__hit_label"), F.col("score").alias(name)))
        hits = union_all(frames)
        on = _same(node["nid"], nid_kind, F.col("__hit"), hits.schema["__hit"].dataType)
        if len(labels) > 1:
            on = on & (node["label"] == F.col("__hit_label"))
        self.df = self.df.join(hits, on, "inner").drop("__hit", "__hit_label")
        if not self.s.grounding:  # what the fallback finds must still hold word for word where it is asked to be equal
            for f in p.exact:
                c, kind = self.column(f.field)
                self.df = self.df.where(plain_predicate(c, kind, "eq", f.value))
        self.scores.append(name)

    # --- results -------------------------------------------------------------

    def _returned(self, r: Return) -> Column:
        c, kind = self.column(r.field)
        return date_part(c, kind, r.date_part) if r.date_part else c

    def name_of(self, r: Return) -> str:
        if r.alias:
            return r.alias
        if r.aggregate:
            return f"count({r.field.partition('.')[0]})" if r.aggregate == "count" else f"{r.aggregate}({r.field})"
        return r.field.replace(".", "_") + "_" + r.date_part if r.date_part else r.field

    def aggregate(self, r: Return) -> Column:
        if r.aggregate == "count":
            return F.count(self.identity(r.field.partition(".")[0]))
        c, kind = self.column(r.field)
        if r.aggregate == "sum":
            zero = F.lit(0).cast("bigint") if isinstance(kind, T.IntegralType) else F.lit(0.0) if isinstance(kind, T.NumericType) else F.lit(0.0)
            return F.coalesce(F.sum(c), zero)
        if r.aggregate == "collect":
            return F.array_sort(F.collect_list(c)) if not isinstance(kind, (T.MapType,)) else F.collect_list(c)
        return {"avg": F.avg, "min": F.min, "max": F.max}[r.aggregate](c)

    def _project(self) -> DataFrame:
        q = self.q
        grouped = any(r.aggregate for r in q.returns)
        if grouped and not q.group_by and any(not r.aggregate for r in q.returns):
            raise LoweringError("plain fields beside aggregates need group_by")
        out = self._grouped() if grouped else self._found()
        cap = self.s.max_limit
        limit = q.limit if cap is None else min(q.limit or cap, cap)
        return out if limit is None else out.limit(limit)

    def _key(self, s: Sort, c: Column) -> Column:
        return c.asc_nulls_last() if s.order == "asc" else c.desc_nulls_last()

    def _grouped(self) -> DataFrame:
        q = self.q
        keys: dict[str, Column] = {}
        refs: dict[tuple[str, str | None], str] = {}
        taken = {r.alias for r in q.returns if r.alias}
        order: list[str] = []
        for r in q.returns:
            name = self.name_of(r)
            if not r.aggregate:
                keys[name] = self._returned(r)
                refs[(r.field, r.date_part)] = name
            order.append(name)
        for g in q.group_by:
            if (g.field, g.date_part) in refs:
                continue
            name = g.alias or self._fresh(g, taken | set(order))
            keys[name] = self._returned(Return(g.field, date_part=g.date_part))
            refs[(g.field, g.date_part)] = name
            order.append(name)
        aggs = [self.aggregate(r).alias(self.name_of(r)) for r in q.returns if r.aggregate]
        df = self.df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*aggs) if keys else self.df.agg(*aggs)
        sorts = []
        for s in q.sort:
            name = s.field if s.field in order else refs.get((s.field, None))
            if name is None:
                raise LoweringError(f"cannot sort by {s.field!r}")
            sorts.append(self._key(s, F.col(_q(name))))
        df = df.select(*[F.col(_q(n)) for n in order])
        if q.distinct:
            df = df.distinct()
        return df.orderBy(*sorts) if sorts else df

    def _fresh(self, g: GroupKey, taken: set[str]) -> str:
        base = g.field.replace(".", "_") + (f"_{g.date_part}" if g.date_part else "")
        name, n = base, 2
        while name in taken:
            name, n = f"{base}_{n}", n + 1
        return name

    def _found(self) -> DataFrame:
        q = self.q
        names = [self.name_of(r) for r in q.returns]
        cols = [self._returned(r).alias(n) for r, n in zip(q.returns, names)]
        taken = {r.alias for r in q.returns}
        if self.scores and "score" not in taken:
            total = reduce(lambda a, b: a + b, [F.coalesce(F.col(_q(s)), F.lit(0.0)) for s in self.scores])
            cols.append(total.alias("score"))
            names.append("score")
        if self.s.auto_sources and "sources" not in taken:
            self._add_sources()
            if "__sources" in self.df.columns:
                cols.append(F.col("__sources").alias("sources"))
                names.append("sources")
        by_field = {r.field: n for r, n in zip(q.returns, names) if not r.date_part}
        sorts: list[Column] = []
        hidden: list[Column] = []
        for i, s in enumerate(q.sort):
            if s.field in names:
                sorts.append(self._key(s, F.col(_q(s.field))))
                continue
            c, kind = self.column(s.field)
            if isinstance(kind, _SORTABLE_NOT) or self._is_list(s.field):
                continue
            if s.field in by_field:
                sorts.append(self._key(s, F.col(_q(by_field[s.field]))))
                continue
            if q.distinct:
                raise LoweringError(f"a distinct query cannot be sorted by {s.field!r}, which it does not return")
            if isinstance(kind, T.StructType):
                c = c["nid"] if "nid" in kind.names else c["eid"]
            hidden.append(c.alias(f"__sort_{i}"))
            sorts.append(self._key(s, F.col(f"__sort_{i}")))
        if self.scores and "score" in names:
            sorts.append(F.col("score").desc_nulls_last())
        if not q.distinct:
            for i, c in enumerate(self.order):
                hidden.append(c.alias(f"__order_{i}"))
                sorts.append(F.col(f"__order_{i}").asc_nulls_last())
        df = self.df.select(*cols, *hidden)
        if q.distinct:
            df = df.distinct()
        if sorts:
            df = df.orderBy(*sorts)
        return df.select(*[F.col(_q(n)) for n in names]) if hidden else df

    def _is_list(self, field: str) -> bool:
        alias, _, prop = field.partition(".")
        return any(storage_type(self.types[(label, prop)]) == "List" for label in self.bound[alias].labels or () if (label, prop) in self.types)

    def _add_sources(self) -> None:
        """Names of the sources that any bound node is traced to; rows of the same bindings become one."""
        carried: dict[str, Column] = {}
        used = {r.field.partition(".")[0] for r in self.q.returns} | {g.field.partition(".")[0] for g in self.q.group_by} | {s.field.partition(".")[0] for s in self.q.sort}
        keep = [a for a, b in self.bound.items() if b.node or a in used]
        ways = []
        for a in keep:
            b = self.bound[a]
            if not b.node:
                continue
            for e in self.g.find_edges(PROVENANCE, b.labels, {SOURCE}):
                ways.append((a, e))
        if not ways:
            return
        df = self.df
        for a in keep:
            b = self.bound[a]
            node = F.col(_q(a))
            # ids are unique within a label or an edge table only
            carried[a] = (node if b.many else F.struct(node["label"], node["nid"]) if b.node else F.struct(node["tab"], node["eid"])).alias(f"__c_{a}")
        lists = []
        t = self.g.nodes[SOURCE]
        name = "name" if "name" in t.props else t.key
        for i, (a, e) in enumerate(ways):
            pairs = e.df.select(F.col(_q(e.source)).alias(f"__p{i}"), F.col(_q(e.target)).alias("__t"))
            named = pairs.join(t.df.select(F.col(_q(t.key)).alias("__k"), F.col(_q(name)).cast("string").alias("__name")), F.col("__t") == F.col("__k"))
            each = named.groupBy(f"__p{i}").agg(F.collect_set("__name").alias(f"__l{i}"))
            on = _same(F.col(_q(a))["nid"], df.schema[a].dataType["nid"].dataType, F.col(f"__p{i}"), each.schema[f"__p{i}"].dataType)
            if len(self.bound[a].labels or ()) != 1:
                on = on & (F.col(_q(a))["label"] == e.source_label)
            df = df.join(each, on, "left").drop(f"__p{i}")
            lists.append(F.coalesce(F.col(f"__l{i}"), F.array().cast("array<string>")))
        sources = F.array_sort(F.array_distinct(F.concat(*lists)))
        df = df.withColumn("__sources", sources).drop(*[f"__l{i}" for i in range(len(ways))])
        self.df = df.withColumns({f"__c_{a}": c for a, c in carried.items()}).dropDuplicates([f"__c_{a}" for a in carried]).drop(*[f"__c_{a}" for a in carried])


def _integral(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.IntegralType)


def _same(a: Column, a_kind: T.DataType, b: Column, b_kind: T.DataType) -> Column:
    """Equality of two ids, as text only if they are of different sorts."""
    if a_kind == b_kind or isinstance(a_kind, T.IntegralType) and isinstance(b_kind, T.IntegralType):
        return a == b
    return a.cast("string") == b.cast("string")


def _holds(edges: Column, eid: Column, tab: Column) -> Column:
    return F.exists(edges, lambda x: (x["eid"] == eid) & (x["tab"] == tab))


def group_overlaps(c: Compiler, group: list[str], tables: list[EdgeTable]) -> bool:
    """Whether an edge of these tables can be one that the pattern has used."""
    have = getattr(c, "_tables", {})
    mine = {c.g.edges.index(t) for t in tables}
    return any(have.get(a, set()) & mine for a in group)


def correct_directions(q: Query, catalog: GraphCatalog) -> Query:
    """Turns hops that only exist the other way round, and narrows those both ways that exist one way."""
    signatures = catalog.signatures()
    labels = q.node_aliases()
    hops = []
    for h in q.traversals:
        a, b = labels.get(h.source, ""), h.target.label
        joined = signatures.get(h.edge_label)
        if a and b and joined and a in catalog.nodes and b in catalog.nodes:
            out, back = (a, b) in joined, (b, a) in joined
            if out != back:
                right = "out" if out else "in"
                if h.direction != right:
                    h = replace(h, direction=right)
        hops.append(h)
    return replace(q, traversals=tuple(hops))


class Engine:
    """Runs query documents over a catalog."""

    def __init__(self, catalog: GraphCatalog, settings: Settings | None = None, registry: Registry | None = None, types: Mapping[tuple[str, str], str] | None = None, indexes: Mapping[str, TextIndex] | None = None):
        self.catalog, self.settings = catalog, settings or Settings()
        self.registry, self.types, self.indexes = registry or Registry(), dict(types or {}), dict(indexes or {})

    def plan(self, doc: str | Mapping[str, Any] | Query, **settings: Any) -> DataFrame:
        """The lazy DataFrame of a query document."""
        q = doc if isinstance(doc, Query) else dsl.parse(doc)
        q = correct_directions(q, self.catalog)
        s = replace(self.settings, **settings) if settings else self.settings
        return Compiler(self.catalog, q, s, self.registry, self.types, self.indexes).compile()

    def explain(self, doc: str | Mapping[str, Any] | Query) -> str:
        return self.plan(doc)._jdf.queryExecution().toString()
