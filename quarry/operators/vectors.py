"""A stored approximate vector index: an inverted file of cells around coarse centroids.

The centroids are fitted on at most ``SAMPLE`` vectors, the first by a hash of their keys, in one task; how many cells a question has to visit for
``TARGET`` of its neighbours is measured on the same sample. Every vector is scaled to length one, assigned to its nearest centroid and stored by cell, so that
a search reads only the folders of the cells that its questions visit. Batches come and go as in the text index: a batch replaces what is there of its keys,
removing marks keys, no batch is rewritten. An index is bound to the name and width of what made its vectors; another width or name is refused.

The exact way stays: :func:`nearest` brings an index that holds fewer vectors than the store up to date, and scans the store where there is no
index or the questions have another width.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.index import best_of_blocks, dense, packed, top_k
from quarry.storage import broadcast_if_small, exists, written

#: Vectors on which centroids are fitted, most cells, rounds, questions of the measurement, their neighbours, and the share of those that has to be found.
SAMPLE, CELLS, ROUNDS, ASKED, NEIGHBOURS, TARGET = 20_000, 1024, 10, 200, 10, 0.97


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(size > 0, size, 1)


def fit_cells(m: np.ndarray, cells: int, rounds: int = ROUNDS, target: float = TARGET) -> tuple[np.ndarray, int]:
    """Centroids (rows of length one) of the rows of ``m``, and how many cells hold ``target`` of a row's nearest rows."""
    x = _unit(np.asarray(m, np.float64))
    cells = max(1, min(cells, len(x)))
    centroids = x[np.linspace(0, len(x) - 1, cells).astype(int)]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        there = np.bincount(own, minlength=cells) > 0
        centroids = np.where(there[:, None], _unit(sums), centroids)
    own = (x @ centroids.T).argmax(1)
    asked = x[np.linspace(0, len(x) - 1, min(ASKED, len(x))).astype(int)]
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :NEIGHBOURS]
    visited = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(np.take_along_axis(visited, own[near], axis=1), axis=None) + 1
    return centroids, int(needed[int(np.ceil(target * len(needed))) - 1])


class VectorIndex:
    """``key, embedding`` under ``root``, of one width and name."""

    def __init__(self, spark: SparkSession, root: str, name: str, width: int, key: str = "pos") -> None:
        self.spark, self.root, self.name, self.width, self.key = spark, root.rstrip("/"), name, width, key
        if self.fitted:
            about = self._about()
            if (about["name"], about["width"]) != (name, width):
                raise ValueError(f"the index holds vectors of {about['name']} of width {about['width']}, not of {name} of width {width}")

    # ------------------------------------------------------------------ reading

    @property
    def fitted(self) -> bool:
        return exists(self.spark, f"{self.root}/about")

    def _about(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/about").first()[0])

    def _live(self) -> DataFrame:
        """``key, unit, cell`` of every vector that no later batch has replaced or removed; ``cell`` is the folder."""
        rows = self.spark.read.schema(f"key {self._about()['key']}, unit array<float>, batch int, cell int").parquet(f"{self.root}/vectors")
        gone = self._removed().groupBy(F.col("key").alias("gone")).agg(F.max("before").alias("before"))
        return rows.join(gone, (F.col("key") == F.col("gone")) & (F.col("batch") < F.col("before")), "left_anti").select("key", "unit", "cell")

    def _removed(self) -> DataFrame:
        return self.spark.read.schema(f"key {self._about()['key']}, before int").parquet(f"{self.root}/removed")

    @property
    def vectors(self) -> DataFrame:
        return self._live().select(F.col("key").alias(self.key), F.col("unit").alias("embedding"))

    def count(self) -> int:
        return self._live().count() if exists(self.spark, f"{self.root}/vectors") else 0

    # ------------------------------------------------------------------ writing

    def fit(self, vectors: DataFrame, cells: int | None = None) -> None:
        """Centroids for ``vectors`` (``key, embedding``); by default about the square root of their number of cells."""
        rows = vectors.where(F.size("embedding") == self.width).select("embedding", F.xxhash64(self.key).alias("h"))
        n = rows.count()
        cells = cells or max(1, min(CELLS, round(n**0.5)))
        few = rows.where(F.col("h") / 2.0**64 + 0.5 <= min(1.0, 2 * SAMPLE / max(n, 1))).orderBy("h").limit(SAMPLE)
        sample = written(few, "vector-sample")
        width = self.width

        def run(batches):
            found = [np.stack([np.asarray(v.values, np.float64) for v in b.column(0)]) for b in batches if b.num_rows]
            centroids, probes = fit_cells(np.concatenate(found), cells) if found else (np.zeros((1, width)), 1)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(centroids)), pa.int32()), pa.array(list(centroids.astype(np.float32)), pa.list_(pa.float32())), pa.array([probes] * len(centroids), pa.int32())], ["cell", "centroid", "probes"])

        made = written(sample.select("embedding", "h").repartition(1).sortWithinPartitions("h").mapInArrow(run, "cell int, centroid array<float>, probes int"), "centroids")
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/centroids")
        about = {"name": self.name, "width": self.width, "probes": made.first()["probes"], "key": vectors.schema[self.key].dataType.simpleString()}
        self.spark.range(1).select(F.lit(json.dumps(about))).write.mode("overwrite").text(f"{self.root}/about")

    def _centroids(self) -> np.ndarray:
        """At most ``CELLS`` rows."""
        rows = self.spark.read.parquet(f"{self.root}/centroids").orderBy("cell").select("centroid").collect()
        return np.array([r["centroid"] for r in rows], np.float64)

    def _check_width(self, vectors: DataFrame) -> None:
        other = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") != self.width)).select(F.size("embedding").alias("n")).first()
        if other:
            raise ValueError(f"a vector of width {other['n']} for an index of width {self.width}")

    def _assigned(self, vectors: DataFrame, key: str, n_cells: int) -> DataFrame:
        """``key, unit, cell``: vectors at their nearest centroids, the nearest first; null and zero vectors are left out."""
        centroids, width = self._centroids(), self.width

        def run(batches):
            for b in batches:
                keys, v = b.column(0), b.column(1)
                m = np.asarray(v.flatten(), np.float64).reshape(-1, width)
                size = np.sqrt((m * m).sum(1))
                at = np.flatnonzero(size > 0)
                unit = m[at] / size[at, None]
                near = np.argsort(-(unit @ centroids.T), axis=1, kind="stable")[:, :n_cells]
                k = near.shape[1] if len(at) else 1
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(at, k))), pa.array(list(np.repeat(unit, k, axis=0).astype(np.float32)), pa.list_(pa.float32())), pa.array(near.ravel().astype(np.int32))], ["key", "unit", "cell"])

        kind = vectors.schema[key].dataType.simpleString()
        rows = vectors.where(F.size("embedding") == width).select(F.col(key).alias("key"), F.transform("embedding", lambda x: x.cast("float")).alias("v"))
        return rows.mapInArrow(run, f"key {kind}, unit array<float>, cell int")

    def _next(self) -> int:
        if not exists(self.spark, f"{self.root}/removed"):
            return 1
        return self._removed().agg(F.max("before")).first()[0] + 1

    def _mark(self, keys: DataFrame, batch: int) -> None:
        """Marks what earlier batches hold of keys; a row without a key numbers the batch."""
        marks = keys.select(F.col(self.key).alias("key"))
        none = self.spark.range(1).select(F.lit(None).cast(marks.schema["key"].dataType).alias("key"))
        marks.unionByName(none).withColumn("before", F.lit(batch)).write.mode("overwrite").parquet(f"{self.root}/removed/at={batch}")

    def upsert(self, vectors: DataFrame) -> None:
        """Puts vectors (``key, embedding``) in, in place of what is there of their keys; of repeated keys any one counts. A null vector takes its key out."""
        self._check_width(vectors)
        if not self.fitted:
            self.fit(vectors)
        batch = self._next()
        rows = written(vectors.select(self.key, "embedding").dropDuplicates([self.key]), "upserted")
        assigned = self._assigned(rows, self.key, 1).hint("rebalance", "cell")
        assigned.write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/vectors/batch={batch}")
        self._mark(rows, batch)

    def delete(self, keys: DataFrame) -> None:
        self._mark(keys.select(self.key).distinct(), self._next())

    # ------------------------------------------------------------------ searching

    def search(self, queries: DataFrame, k: int, probes: int | None = None, scope: DataFrame | None = None) -> DataFrame:
        """``query_id, key, rank, score``: of each question (``query_id, query_vector``) the ``k`` nearest of the cells it visits.

        ``scope`` (``key``): the only vectors that count; they are sifted before the best are taken.
        """
        self._check_width(queries.withColumnRenamed("query_vector", "embedding"))
        visits = written(self._assigned(queries.withColumnRenamed("query_vector", "embedding"), "query_id", probes or self._about()["probes"]), "visits")
        cells = [r["cell"] for r in visits.select("cell").distinct().collect()]  # at most CELLS
        rows = self._live().where(F.col("cell").isin(cells))
        if scope is not None:
            rows = rows.join(scope.select(F.col(self.key).alias("key")), "key", "left_semi")
        q = packed(visits.repartition("cell").sortWithinPartitions("cell"), "key", "unit", "cell").withColumnsRenamed({"keys": "query_keys", "unit": "query_unit"}).drop("width")
        met = packed(rows, "key", "unit", "cell").join(broadcast_if_small(written(q, "question-blocks")), "cell")
        found = best_of_blocks(met, k, rows.schema["key"].dataType).withColumnRenamed("key", self.key)
        return top_k(found, k, [F.desc(F.round("score", 9)), F.col(self.key)])


def nearest(index: VectorIndex, store: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The index's answer, of an index that holds all of the store (``key, embedding``); where it has none, the exact one."""
    widths = queries.select(F.size("query_vector").alias("n")).distinct().collect()
    if any(w["n"] != index.width for w in widths) or store.where(F.size("embedding") != index.width).limit(1).count():
        exact = dense(store, queries, k, index.key)
        return top_k(exact, k, [F.desc(F.round("score", 9)), F.col(index.key)])
    reseed(index, store)
    return index.search(queries, k)


def reseed(index: VectorIndex, store: DataFrame) -> int:
    """Puts in what an index lacks of a store if it holds fewer vectors, and returns how many it put in."""
    embedded = store.where(F.col("embedding").isNotNull() & (F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) > 0))
    had = index.count()
    if had >= embedded.count():
        return 0
    lacking = embedded if had == 0 else embedded.join(index.vectors.select(index.key), index.key, "left_anti")
    if not index.fitted:
        index.fit(embedded)
    index.upsert(lacking)
    return index.count() - had
