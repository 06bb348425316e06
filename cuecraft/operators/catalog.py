"""Collections as Parquet directories under a root: create, list, describe, delete."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuecraft.schema import COLLECTIONS, DIMENSION, ENTITY_POINT, LECTURE_POINT

SCHEMAS = {"lectures": LECTURE_POINT, "entities": ENTITY_POINT}


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def exists(self, name: str) -> bool:
        fs, path = self._fs()
        return fs.exists(path(self.path(name)))

    def create(self, name: str, schema: T.StructType | None = None) -> dict:
        """Make an empty collection if there is none: its name, whether it was made now, and its vectors' size."""
        there = self.exists(name)
        if not there:
            self.spark.createDataFrame([], schema or SCHEMAS[name]).write.parquet(self.path(name))
        return {"collection_name": name, "created": not there, "vector_dimension": DIMENSION}

    def init(self) -> dict:
        return {"collections": [self.create(name) for name in COLLECTIONS]}

    def delete(self, name: str, strict: bool = True) -> bool:
        """Remove a collection; a missing one is an error, or with ``strict`` off nothing."""
        if strict and name not in COLLECTIONS:
            raise ValueError(f"unknown collection {name!r}; one of {', '.join(COLLECTIONS)}")
        fs, path = self._fs()
        if not self.exists(name):
            if strict:
                raise LookupError(name)
            return False
        return fs.delete(path(self.path(name)), True)

    def names(self) -> list[str]:
        fs, path = self._fs()
        root = path(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory() and not s.getPath().getName().startswith(".")) if fs.exists(root) else []

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def require(self, name: str) -> DataFrame:
        """The collection; an error that says how to make it if it is missing."""
        if not self.exists(name):
            raise LookupError(f"collection {name!r} does not exist; init() makes it")
        return self.table(name)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Put ``rows``, which may be read from the collection itself, in its place: written beside it, then moved."""
        fs, path = self._fs()
        new, here = path(f"{self.root}/.{name}.next"), path(self.path(name))
        rows.write.mode("overwrite").parquet(new.toString())
        fs.delete(here, True)
        if not fs.rename(new, here):
            raise OSError(f"could not move {new.toString()} to {here.toString()}")
        self.spark.catalog.refreshByPath(self.path(name))

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path(name))

    def describe(self, name: str) -> dict:
        df = self.table(name)
        vectors = [f.name for f in df.schema if f.name in ("dense", "sparse", "colbert")]
        return {"collection_name": name, "rows": df.count(), "vectors": {v: {"dimension": None if v == "sparse" else DIMENSION, "distance": "dot" if v == "sparse" else "cosine"} for v in vectors}}

    def status(self) -> list[dict]:
        return [{"collection_name": n, "exists": True, "status": "ready", "indexed_vectors_count": self.table(n).count()} if self.exists(n) else {"collection_name": n, "exists": False} for n in COLLECTIONS]

    def counts(self, names: list[str]) -> DataFrame:
        """``collection_name, n``: the rows of each collection."""
        each = [self.table(n).agg(F.lit(n).alias("collection_name"), F.count("*").alias("n")) for n in names]
        return reduce(DataFrame.unionByName, each)

    def scroll(self, name: str, limit: int, label=None, key: str = "id") -> DataFrame:
        """The first page by id, without vectors."""
        df = self.table(name)
        df = df if label is None else df.where(df["label"] == label)
        return df.drop("dense", "sparse", "colbert").orderBy(key).limit(limit)
