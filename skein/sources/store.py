"""Chunks, parents, the catalogue and prepared pictures as Parquet tables in one folder."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StorageError

TABLES = ("chunks", "parents", "catalogue", "pictures")


class Store:
    """Each table is a folder of versions; a write makes a new version and moves the pointer, so readers see whole ones."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self, table: str) -> str:
        return f"{self.root}/{table}/_current"

    def read(self, table: str) -> DataFrame | None:
        try:
            versions = self.spark.read.text(self._pointer(table))
            at = versions.orderBy(F.desc("value")).first()
        except AnalysisException:
            return None
        return self.spark.read.parquet(f"{self.root}/{table}/{at['value'].split(' ')[1]}") if at else None

    def _write(self, table: str, df: DataFrame) -> None:
        try:
            n = 1 + max([0, *(int(r["value"].split(" ")[0]) for r in self.spark.read.text(self._pointer(table)).collect())])
        except AnalysisException:
            n = 1
        version = f"v-{uuid.uuid4().hex}"
        try:
            df.write.parquet(f"{self.root}/{table}/{version}")
            self.spark.range(1).select(F.lit(f"{n:012d} {version}")).coalesce(1).write.mode("append").text(self._pointer(table))
        except Exception as e:
            raise StorageError(f"{table} could not be written: {e}") from e

    def upsert(self, table: str, rows: DataFrame, key: str) -> None:
        """Rows replace those of equal key; the others stay."""
        old = self.read(table)
        self._write(table, rows if old is None else old.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True))

    def delete(self, table: str, key: str, value) -> bool:
        """Whether there was anything to delete."""
        old = self.read(table)
        if old is None or old.where(F.col(key) == value).isEmpty():
            return False
        self._write(table, old.where(~F.col(key).eqNullSafe(F.lit(value))))
        return True

    def delete_document(self, document_id) -> None:
        for table in ("chunks", "parents", "pictures"):
            self.delete(table, "document_id", document_id)

    def get(self, table: str, key: str, value) -> DataFrame | None:
        old = self.read(table)
        return None if old is None else old.where(F.col(key) == value)

    def create(self, table: str, schema: str) -> None:
        """An empty table, unless there is one."""
        if self.read(table) is None:
            self._write(table, self.spark.createDataFrame([], schema))

    def info(self, table: str) -> dict:
        """Name, number of rows and whether the table is there."""
        there = self.read(table)
        return {"name": table, "rows": 0 if there is None else there.count(), "status": "absent" if there is None else "ready"}

    def tables(self) -> list[str]:
        return [t for t in TABLES if self.read(t) is not None]

    def count(self, table: str) -> int:
        old = self.read(table)
        return 0 if old is None else old.count()

    def healthy(self) -> bool:
        try:
            return self.spark.sql("SELECT 1").count() == 1
        except Exception:  # a health check reports, whatever went wrong
            return False
