"""Ingest of graph documents as they arrive in a folder."""

from __future__ import annotations

import zlib
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.types import Registry
from ..operators.ingest import GraphStore
from ..sources.graph_json import ENTITY_SCHEMA, RELATION_SCHEMA, entity_rows, parse_graph, relation_rows


def ingest_stream(store: GraphStore, folder: str, checkpoint: str, resolver: Any = None, once: bool = False) -> StreamingQuery:
    """Starts a query that merges every new file of a folder into a store.

    A batch that is run again after a failure merges the same keys, so it
    changes nothing.
    """
    files = store.spark.readStream.format("text").option("wholetext", True).schema("value string").load(folder)

    def merge(batch: DataFrame, number: int) -> None:
        docs = batch.where(F.col("value").isNotNull())
        if docs.isEmpty():
            return

        def entities(parts):
            import pandas as pd

            for pdf in parts:
                for v in pdf["value"]:
                    d = zlib.crc32(v.encode()) * 1_000_003 + len(v)
                    yield pd.DataFrame([(i, f"{d}#{x}", *r) for i, x, *r in entity_rows(parse_graph(v), Registry())], columns=[c.split()[0] for c in ENTITY_SCHEMA.replace("map<string,string>", "map").split(", ")])

        def relations(parts):
            import pandas as pd

            for pdf in parts:
                for v in pdf["value"]:
                    d = zlib.crc32(v.encode()) * 1_000_003 + len(v)
                    yield pd.DataFrame([(i, rel, f"{d}#{a}", f"{d}#{b}", p) for i, rel, a, b, p in relation_rows(parse_graph(v), Registry())], columns=["idx", "rel", "from_id", "to_id", "props"])

        store.ingest((docs.mapInPandas(entities, ENTITY_SCHEMA), docs.mapInPandas(relations, RELATION_SCHEMA)), resolver)

    writer = files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
