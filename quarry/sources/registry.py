"""The catalogue of knowledge bases: which exist, under which names, and how much each holds."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "place int, base_id string, name string, created_at timestamp, n_docs long, n_chunks long"


class Registry:
    """A table with a row a base. Names are typed by people, so that the table is small: the driver holds it while it changes it.

    Every change writes the whole table as a new version; one without ``_SUCCESS`` does not count, so that a writer that dies leaves the version
    before. Two writers at once are not arbitrated beyond the refusal to write over a version that is there.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self, complete: bool) -> list[str]:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        store = root.getFileSystem(conf)
        if not store.exists(root):
            return []
        names = sorted(s.getPath().getName() for s in store.listStatus(root))
        done = lambda n: store.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        return [n for n in names if n.startswith("v") and (not complete or done(n))]

    def table(self) -> DataFrame:
        """The bases in the order in which they were made."""
        found = self._versions(complete=True)
        if not found:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{found[-1]}").orderBy("place")

    def _rows(self) -> list[dict]:
        return [r.asDict() for r in self.table().collect()]

    def _save(self, rows: list[dict]) -> None:
        begun = self._versions(complete=False)
        number = int(begun[-1][1:]) + 1 if begun else 0
        numbered = [r | {"place": k} for k, r in enumerate(rows)]
        self.spark.createDataFrame(numbered, SCHEMA).coalesce(1).write.mode("error").parquet(f"{self.path}/v{number:08d}")

    @staticmethod
    def _free_name(rows: list[dict], name: str, own: str | None = None) -> str:
        name = name.strip()
        if not name:
            raise ValueError("a base needs a name")
        if any(r["name"].casefold() == name.casefold() and r["base_id"] != own for r in rows):
            raise ValueError(f"there is a base named {name!r}")
        return name

    @staticmethod
    def _at(rows: list[dict], base_id: str) -> dict:
        for r in rows:
            if r["base_id"] == base_id:
                return r
        raise KeyError(f"no base {base_id!r}")

    def resolve(self, base_id: str = "") -> dict:
        """The base of that id, and without one the first."""
        rows = self._rows()
        if base_id:
            return self._at(rows, base_id)
        if not rows:
            raise KeyError("there is no base")
        return rows[0]

    def create(self, name: str) -> dict:
        rows = self._rows()
        made = {"place": len(rows), "base_id": uuid.uuid4().hex, "name": self._free_name(rows, name), "created_at": datetime.now(UTC), "n_docs": 0, "n_chunks": 0}
        self._save([*rows, made])
        return made

    def rename(self, base_id: str, name: str) -> None:
        rows = self._rows()
        name = self._free_name(rows, name, base_id)
        self._at(rows, base_id)["name"] = name
        self._save(rows)

    def remove(self, base_id: str) -> None:
        """Takes a base off the list; its index stays where it is. The last one stays: whoever names none gets the first."""
        rows = self._rows()
        gone = self._at(rows, base_id)
        if len(rows) == 1:
            raise ValueError("the last base stays")
        self._save([r for r in rows if r is not gone])

    def set_counts(self, base_id: str, n_docs: int, n_chunks: int) -> None:
        rows = self._rows()
        base = self._at(rows, base_id)
        if (base["n_docs"], base["n_chunks"]) != (n_docs, n_chunks):
            base.update(n_docs=n_docs, n_chunks=n_chunks)
            self._save(rows)
