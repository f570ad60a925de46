"""Vector collections as Parquet tables: upsert by id, search, list and delete.

A collection holds its texts, their vectors, and postings by term for lexical
search, all made when a text is stored; a search embeds and tokenises its query only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vector
from ..operators.vector import Embedder

SCHEMA = "nid long, label string, text string, vec array<double>"


def collection(base: str, field: str, prefix: str | None = None) -> str:
    """Name of a collection: tenant, label and field."""
    return "__".join(x for x in (prefix, base, field) if x)


class VectorStore:
    """Collections under a folder. Each write makes a new version; the last complete one is read."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None):
        self.spark, self.path, self.embedder = spark, path.rstrip("/"), embedder or vector.HashingEmbedder()
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def collections(self) -> list[str]:
        return self._names(self.path)

    def _versions(self, name: str) -> list[int]:
        return sorted(int(v[1:]) for v in self._names(f"{self.path}/{name}") if v.startswith("v") and self._fs.exists(self._path(f"{self.path}/{name}/{v}/rows/_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        v = self._versions(name)
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}/v{v[-1]}/rows") if v else self.spark.createDataFrame([], SCHEMA)

    def postings(self, name: str) -> DataFrame:
        v = self._versions(name)
        schema = "term string, nid long, tf long, part int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/v{v[-1]}/postings") if v else self.spark.createDataFrame([], schema)

    def lexical(self, name: str, query: str, k: int) -> DataFrame:
        """(nid, score) by the stored postings."""
        return vector.bm25_stored(self.postings(name), self.read(name).where("text is not null").count(), query, k)

    def _write(self, name: str, kept: DataFrame | None, fresh: DataFrame | None, gone: DataFrame | None = None) -> None:
        """A new version of rows of the last one, whose postings are kept, and fresh rows, which are tokenised; gone: the nids that go, those of fresh rows if not given."""
        v = self._versions(name)
        path = f"{self.path}/{name}/v{(v[-1] if v else 0) + 1}"
        # postings first: a version is in force once its rows are written
        cols = ["nid", "label", "text", "vec"]
        new = self.spark.read.schema(SCHEMA)
        parts, posted = [], []
        if kept is not None:
            kept.select(*cols).write.mode("overwrite").parquet(f"{path}/new/kept")
            parts.append("kept")
        if fresh is not None:
            fresh.select(*cols).write.mode("overwrite").parquet(f"{path}/new/fresh")
            posted.append(vector.postings(new.parquet(f"{path}/new/fresh").where("text is not null").select("nid", "text"), unique=True))
            parts.append("fresh")
        if kept is not None:
            gone = new.parquet(f"{path}/new/fresh").select("nid") if gone is None else gone
            posted.append(self.postings(name).join(gone, "nid", "left_anti").select("term", "nid", "tf", "part"))
        found = posted[0] if len(posted) == 1 else posted[0].unionByName(posted[1])
        # a task sorts a part of bounded size, however large a collection is
        found.hint("rebalance", F.col("part")).sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
        self._fs.mkdirs(self._path(f"{path}/rows"))
        for p in parts:
            self._fs.rename(self._path(f"{path}/new/{p}"), self._path(f"{path}/rows/{p}"))
        self._fs.createNewFile(self._path(f"{path}/rows/_SUCCESS"))

    def upsert(self, name: str, rows: DataFrame) -> None:
        """rows (nid, label, text[, vec]) in place of those of the same nid; only texts that are new to their nid are embedded.

        Of rows of one nid that with the greatest text counts. Such nids are looked
        for first, as texts of others need not be moved.
        """
        have = self.read(name) if self._versions(name) else None
        fields = ["label", "text"] + ["vec"] * ("vec" in rows.columns)
        rows = rows.select("nid", *fields)
        twice = rows.groupBy("nid").count().where("count > 1").select("nid")
        if not twice.isEmpty():
            twice = twice.toDF("__n")
            again = F.col("nid").eqNullSafe(F.col("__n"))
            one = rows.join(twice, again, "left_semi").groupBy("nid").agg(F.max_by(F.struct(*fields), "text").alias("r")).select("nid", "r.*")
            rows = rows.join(twice, again, "left_anti").unionByName(one)
        if have is None:
            self._write(name, None, rows if "vec" in fields else rows.withColumn("vec", self.embedder.column(F.col("text"))))
            return
        kept = have.join(rows.select("nid"), "nid", "left_anti")
        if "vec" in fields:
            self._write(name, kept, rows)
            return
        # a row whose text is known keeps its vector; texts are compared as hashes
        known = have.where("vec is not null").select(F.col("nid").alias("__n"), F.sha2("text", 256).alias("__h"), F.col("vec").alias("__v"))
        both = rows.withColumn("__h2", F.sha2("text", 256)).join(known, (F.col("nid") == F.col("__n")) & (F.col("__h2") == F.col("__h")), "left")
        old = both.where("__v is not null").select("nid", "label", "text", F.col("__v").alias("vec"))
        new = both.where("__v is null").select("nid", "label", "text", self.embedder.column(F.col("text")).alias("vec"))
        self._write(name, kept.unionByName(old), new)

    def delete(self, name: str, nids: DataFrame) -> None:
        if self._versions(name):
            gone = nids.select("nid").distinct()
            self._write(name, self.read(name).join(gone, "nid", "left_anti").select("nid", "label", "text", "vec"), None, gone)

    def sweep(self, nids: DataFrame) -> None:
        """Removes nodes from every collection."""
        for name in self.collections():
            self.delete(name, nids)

    def search(self, name: str, query: str | Sequence[float], k: int, threshold: float | None = None, label: str | None = None, mode: str = "dense") -> DataFrame:
        """(nid, score) of the k nearest, dense, lexical or hybrid."""
        rows = self.read(name) if label is None else self.read(name).where(F.col("label") == label)
        if mode == "lexical":
            return vector.bm25(rows.select("nid", "text"), str(query), k) if label else self.lexical(name, str(query), k)
        vec = self.embedder.embed([query])[0] if isinstance(query, str) else query
        if mode == "hybrid":
            if label:
                return vector.hybrid(rows.select("nid", "text", "vec"), str(query), vec, k)
            return vector.fused(vector.knn(rows.select("nid", "vec"), vec, vector.PREFETCH * k), lambda n: self.lexical(name, str(query), n), str(query), k)
        return vector.knn(rows.select("nid", "vec"), vec, k, threshold)
