"""Trees, and other tables that belong together, on storage: whole or not there, and only for the policy they were built by."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.storage import exists, remove


class TreeStore:
    """Named sets of tables under ``root``, for this session and later ones.

    A set is written beside the one that is there; a row in ``saved`` then names it, so that a reader finds the old set or the new one, each whole. Tables are sorted by their keys.
    A set that another policy built counts as not there: it is built anew, not mixed. One without a policy is any policy's.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _saved(self) -> DataFrame:
        return self.spark.read.schema("name string, policy string, folder string, no long, tables array<string>").json(f"{self.root}/saved")

    def _latest(self, name: str):
        if not exists(self.spark, f"{self.root}/saved"):
            return None
        return self._saved().where(F.col("name") == name).groupBy("name").agg(F.max_by(F.struct("policy", "folder", "no", "tables"), "no").alias("s")).select("s.*").first()

    def save(self, name: str, policy: str, tables: dict[str, tuple[DataFrame, list[str]]]) -> None:
        """``tables``: of each name its rows and the columns they are sorted by. The set before goes once the new one is named."""
        before = self._latest(name)
        folder = f"{name}-{uuid.uuid4().hex}"
        for table, (rows, keys) in tables.items():
            rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{self.root}/{folder}/{table}")
        row = self.spark.range(1).select(F.lit(name).alias("name"), F.lit(policy).alias("policy"), F.lit(folder).alias("folder"), F.lit(before["no"] + 1 if before else 1).cast("long").alias("no"), F.array(*[F.lit(t) for t in tables]).alias("tables"))
        row.coalesce(1).write.mode("append").json(f"{self.root}/saved")
        if before:
            remove(self.spark, f"{self.root}/{before['folder']}")

    def open(self, name: str, policy: str) -> dict[str, DataFrame] | None:
        """The tables of a set, or nothing where there is none for the policy. Tables that were named and can't be read are an error."""
        found = self._latest(name)
        if found is None or found["policy"] not in ("", None, policy):
            return None
        return {t: self.spark.read.parquet(f"{self.root}/{found['folder']}/{t}") for t in found["tables"]}

    def export_json(self, name: str, policy: str, table: str, keys: list[str], path: str) -> None:
        """A table as lines of JSON in the order of its keys: the same rows give the same lines, whenever they are written."""
        rows = self.open(name, policy)[table]
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
