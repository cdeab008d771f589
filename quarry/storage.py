"""Tables of the engine on storage that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table is broadcast on our own demand only if its rows, measured, fit into so many bytes.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, qualified; a local session without one, which is one machine, gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: driver and executors have no folder in common")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        found = spark.sparkContext.getCheckpointDir()
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/(?!/)", "file:///", full).rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder under :func:`shared_dir`, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def remove(spark: SparkSession, path: str) -> None:
    try:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    except (Py4JError, OSError, AttributeError, TypeError):  # the session has ended and its JVM with it
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and a lost executor loses none of it."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes_of(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value in a row: eight for anything of fixed size, and what the rest takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
        return F.coalesce(F.aggregate(c, F.lit(24).cast("long"), lambda a, x: a + _bytes_of(x, kind.elementType)), F.lit(24))
    if isinstance(kind, T.ArrayType):
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * 8 + 24
    if isinstance(kind, T.StructType):
        out = F.lit(16)
        for f in kind.fields:
            out = out + _bytes_of(c[f.name], f.dataType)
        return out
    return F.lit(8)


def _row_bytes(df: DataFrame) -> Column:
    row = F.lit(16)
    for f in df.schema.fields:
        row = row + _bytes_of(F.col(f"`{f.name}`"), f.dataType)
    return row.cast("long")


def measured_bytes(df: DataFrame) -> int:
    """What all rows of a written table take in memory."""
    return df.agg(F.sum(_row_bytes(df)).alias("n")).first()["n"] or 0


def broadcast_if_small(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if its rows, measured, fit; else as it is, and the join shuffles."""
    return F.broadcast(df) if measured_bytes(df) <= most_bytes else df


def split_to_broadcast(df: DataFrame, by: str, most_bytes: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """A written table in two: the rows with the largest counts ``by`` that fit together, measured, marked for broadcast, and the others, if there are any.

    Counts that differ are few beside the rows: the driver sees one number for each.
    """
    room, least = BROADCAST_BYTES if most_bytes is None else most_bytes, None
    held = df.groupBy(by).agg(F.sum(_row_bytes(df)).alias("n")).orderBy(F.desc(by)).collect()
    for r in held:
        room -= r["n"]
        if room < 0:
            break
        least = r[by]
    if held and least == held[-1][by]:
        return F.broadcast(df), None
    often = F.col(by) >= least if least is not None else F.lit(False)
    return F.broadcast(df.where(often)), df.where(~often) if held else None


def spread(df: DataFrame, key: str) -> DataFrame:
    """A written table, dealt out by a key if, measured, a few tasks would read most of its rows, as of a file with few row groups; else as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    sizes = df.select(key).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if not sizes["all"] or sizes["most"] * n <= 2 * sizes["all"]:
        return df
    return df.repartition(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)
