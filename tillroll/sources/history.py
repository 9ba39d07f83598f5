"""Versioned run history: tables of Parquet folders under one root, and a manifest that says which folders a version has.

* A *version* is one manifest file: rows ``(table, batch, folder, schema)`` of all live folders. Data folders are written
  first and never changed; a version comes into being when its manifest file is renamed into place, so a reader sees all of
  a write or none of it, and older versions stay readable.
* A manifest folder that exists already fails the commit (two writers at once), nothing is overwritten.
* :meth:`History.append` takes a batch name: a batch that is in the history already, as after a replay, adds nothing.
* :meth:`History.delete` rewrites only the folders that hold one of the ids and commits all tables in one version.

Rows lie in ``BUCKETS`` sub-folders by a hash of the dataset id, so that a lookup of one dataset reads one of them and the
number of folders does not grow with the datasets.
"""

from __future__ import annotations

import json
import uuid
from typing import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16
MANIFEST = "version long, table string, batch string, folder string, schema string"


def bucket(key: Column | str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit("")).cast("binary")), F.lit(BUCKETS)).cast("int")


class History:
    def __init__(self, spark: SparkSession, root: str, key: str = "dataset_id"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def manifest(self, version: int | None = None) -> list:
        """Rows of a version (of the latest by default); a version lists its live folders, so it grows with the number of
        batches, not with their rows."""
        try:
            every = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        wanted = every.agg(F.max("version")).first()[0] if version is None else version
        return every.where(F.col("version") == F.lit(wanted)).orderBy("table", "batch", "folder").collect()

    def version(self) -> int:
        rows = self.manifest()
        return rows[0]["version"] if rows else 0

    def _commit(self, version: int, rows: list[tuple]) -> int:
        (self.spark.createDataFrame([(version, *r) for r in rows], MANIFEST).coalesce(1)
         .write.mode("errorifexists").parquet(f"{self.root}/manifest/v{version:012d}"))
        return version

    def _write(self, table: str, df: DataFrame) -> tuple[str, str]:
        folder = f"{self.root}/data/{table}/{uuid.uuid4().hex}"
        df.withColumn("_bucket", bucket(F.col(self.key).cast("string"))).write.partitionBy("_bucket").parquet(folder)
        return folder, df.schema.json()

    def append(self, tables: Mapping[str, DataFrame], batch: str) -> int:
        """Add the rows of one batch to several tables in one version; returns the version that holds the batch."""
        old = self.manifest()
        now = old[0]["version"] if old else 0
        if any(r["batch"] == batch for r in old):
            return now
        rows = [(r["table"], r["batch"], r["folder"], r["schema"]) for r in old]
        rows += [(name, batch, *self._write(name, df)) for name, df in tables.items()]
        return self._commit(now + 1, rows)

    def _folder(self, folder: str, schema: str) -> DataFrame:
        fields = T.StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(T.StructType([*fields.fields, T.StructField("_bucket", T.IntegerType())])).parquet(folder)

    def read(self, table: str, version: int | None = None, dataset: str | None = None) -> DataFrame:
        """A table at a version; ``dataset`` prunes the scan to the bucket of that id."""
        parts = None
        for r in self.manifest(version):
            if r["table"] == table:
                part = self._folder(r["folder"], r["schema"])
                if dataset is not None:
                    part = part.where((F.col("_bucket") == bucket(F.lit(dataset))) & (F.col(self.key).cast("string") == dataset))
                parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
        if parts is None:
            raise KeyError(f"no table {table} in version {version if version is not None else 'latest'} of {self.root}")
        return parts.drop("_bucket")

    def delete(self, ids: DataFrame) -> int:
        """Remove the datasets of ``ids`` (its column ``key``) from every table (cascade), as one new version. Folders without
        any of them are taken over as they are."""
        old = self.manifest()
        if not old:
            return 0
        gone = ids.select(F.col(self.key).cast("string").alias("_gone")).where("_gone IS NOT NULL").distinct()
        rows = []
        for r in old:
            part = self._folder(r["folder"], r["schema"]).drop("_bucket")
            key = F.col(self.key).cast("string") == F.col("_gone")
            if part.join(gone, key, "left_semi").isEmpty():
                rows.append((r["table"], r["batch"], r["folder"], r["schema"]))
            else:
                rows.append((r["table"], r["batch"], *self._write(r["table"], part.join(gone, key, "left_anti"))))
        return self._commit(old[0]["version"] + 1, rows)
