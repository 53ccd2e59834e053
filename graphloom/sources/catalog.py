"""Tables as Parquet folders under one root."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.relational import upsert


class Catalog:
    """Tables of one engine.  With read_only set, nothing may be written."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        fs, p = self._fs(self.path(name))
        return fs.exists(p)

    def tables(self) -> list[str]:
        fs, p = self._fs(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith((".", "_"))) if fs.exists(p) else []

    def read(self, name: str, schema: T.StructType | str | None = None) -> DataFrame:
        """The table; a missing one is empty if its schema is given."""
        if not self.exists(name):
            if schema is None:
                raise FileNotFoundError(self.path(name))
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(self.path(name))

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError("the catalog is read-only")

    def overwrite(self, name: str, df: DataFrame) -> None:
        """Writes beside the table and swaps, so df may read the table itself."""
        self._writable()
        stage = f"{self.root}/_stage-{name}-{uuid.uuid4().hex}"
        df.write.parquet(stage)
        fs, new = self._fs(stage)
        _, old = self._fs(self.path(name))
        fs.delete(old, True)
        if not fs.rename(new, old):
            raise OSError(f"can't move {stage}")

    def append(self, name: str, df: DataFrame) -> None:
        self._writable()
        df.write.mode("append").parquet(self.path(name))

    def merge(self, name: str, new: DataFrame, keys: list[str], sequence: Column | str) -> None:
        """Rows of new replace those of equal keys."""
        have = self.read(name, T.StructType([f for f in new.schema if f.name != sequence]))
        self.overwrite(name, upsert(have, new, keys, sequence))

    def register(self, name: str, rows: pd.DataFrame, schema: T.StructType | str | None = None) -> DataFrame:
        """A pandas frame as a table that SQL can name, for this session alone."""
        df = self.spark.createDataFrame(rows, schema)
        df.createOrReplaceTempView(name)
        return df

    def counts(self) -> dict[str, int]:
        return {t: self.read(t).count() for t in self.tables()}
