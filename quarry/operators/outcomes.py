"""Batches that carry their faults: every input has an outcome, in order, and a fault stays with its input.

An input that cannot be worked on becomes a row with an error instead of a failed job. Inputs go in groups of bounded size; between groups a batch can be
cancelled, and then the rest is marked so. A running group is cancelled by its tag. Counts are observed as the rows pass, without another job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.operators.prefix import numbered
from quarry.storage import written

CANCELLED = "cancelled"


def attempted(rows: DataFrame, key: str, value: str, work: Callable[[object], object], kind: str) -> DataFrame:
    """``key, result, error``: ``work`` on each value; what it raises is the row's error, ``type: message``, and its result is null."""
    key_kind = rows.schema[key].dataType.simpleString()

    def one(x: object) -> tuple[object, str | None]:
        try:
            return work(x), None
        except Exception as fault:  # whatever an input does to its reader stays with the input
            return None, f"{type(fault).__name__}: {fault}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [one(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r for r, _ in made], out), pa.array([e for _, e in made], pa.string())], ["key", "result", "error"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_type(_parse_datatype_string(kind))
    return rows.select(F.col(key).alias("key"), F.col(value).alias("value")).mapInArrow(run, f"key {key_kind}, result {kind}, error string").withColumnRenamed("key", key)


def outcomes(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The inputs in their order (``key, at``) with ``result, error``; one without a row in ``done`` was cancelled."""
    met = inputs.join(done, key, "left").withColumn("_there", F.col("_done").isNotNull())
    return met.select(*inputs.columns, "result", F.when(~F.col("_there"), F.lit(CANCELLED)).otherwise(F.col("error")).alias("error"))


def run_batch(inputs: DataFrame, key: str, order: str, value: str, work: Callable[[object], object], kind: str, group: int = 10_000, tag: str = "batch", stop: Callable[[dict], bool] = lambda seen: False) -> tuple[DataFrame, dict]:
    """``key, order, at, result, error`` of every input, and the counts ``{"done", "failed"}``.

    Groups of ``group`` inputs are worked on one after another, each a job of many tasks under the tag ``tag``; ``stop`` gets the counts so far before each and ends the batch. A group whose
    tag was cancelled counts as not begun.
    """
    spark: SparkSession = inputs.sparkSession
    placed = written(numbered(inputs.select(key, order, value), [order, key]).withColumnRenamed("_n", "at"), "batch-inputs")
    n, seen, parts = placed.count(), {"done": 0, "failed": 0}, []
    for begin in range(0, n, group):
        if stop(dict(seen)):
            break
        counts = Observation()
        some = placed.where(F.col("at").between(begin + 1, begin + group))
        made = attempted(some, key, value, work, kind).observe(counts, F.count("*").alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed"))
        spark.sparkContext.addJobTag(tag)
        try:
            parts.append(written(made, "batch-part"))
        except PySparkException as ended:
            if "cancelled" not in str(ended).lower():
                raise
            break
        finally:
            spark.sparkContext.removeJobTag(tag)
        got = counts.get
        seen = {name: seen[name] + got[name] for name in seen}
    empty = spark.createDataFrame([], attempted(placed, key, value, work, kind).schema)
    done = empty
    for part in parts:
        done = done.unionByName(part)
    return outcomes(placed.select(key, order, "at"), done.withColumn("_done", F.lit(1)), key), seen


def cancel(spark: SparkSession, tag: str = "batch") -> None:
    """Ends what runs under a tag, from another thread."""
    spark.sparkContext.cancelJobsWithTag(tag)
