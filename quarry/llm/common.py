"""What the training-data operators share: tables, shared storage, samples, hashing and Arrow plumbing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table is broadcast on our own demand only if its rows, measured, fit into so many bytes.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme that Spark's default file system gives it, as other libraries need it too."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub(r"^file:/(?!/)", "file:///", full).rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset a local session, which
    is one machine, gets a folder of our own; a cluster gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: driver and executors have no folder in common")
        found = tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(found)
    return qualified(spark, found)


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder under :func:`shared_dir`, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except (Py4JError, OSError, AttributeError, TypeError):  # the session has ended and its JVM with it
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and a lost executor loses none of it."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of :func:`written` that nothing reads any more."""
    for t in tables:
        if t is not None and (path := getattr(t, "_written_to", None)):
            _remove(t.sparkSession, path)


def _bytes_of(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value in a row: eight for anything of fixed size, and what the rest takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * 8 + 24
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(24).cast("long"), lambda a, x: a + _bytes_of(x, kind.elementType)), F.lit(24))
    if isinstance(kind, T.StructType):
        out = F.lit(16)
        for f in kind.fields:
            out = out + _bytes_of(c[f.name], f.dataType)
        return out
    return F.lit(8)


def broadcast_if_small(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if all its rows take ``most_bytes`` at most in memory; else as it is, and
    the join shuffles. Its rows are measured, not estimated."""
    row = F.lit(16)
    for f in df.schema.fields:
        row = row + _bytes_of(F.col(f"`{f.name}`"), f.dataType)
    size = df.agg(F.sum(row.cast("long")).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= most_bytes else df


def text_of(name: str = "text") -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def crc_fold(key: str, modulus: int) -> Column:
    """crc32 of the decimal text of a key, modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % modulus


def sampled(docs: DataFrame, key: str, text: str, salt: str, most_rows: int, most_chars: int, group: Column | None = None, groups: DataFrame | None = None) -> DataFrame:
    """``h, g, t``: of every group at most ``most_rows`` different rows with ``most_chars`` characters in all, the first by ``h``.

    A row's group is ``group``, or what the table ``groups`` (``group_key, g``) has for its key; rows without one are not drawn. ``h`` is a hash of
    key and text, so that every run draws alike and repeated rows count once. Rows longer than a twentieth of ``most_chars`` are not
    drawn. Only hashes and lengths are joined and counted; rows that cannot be among the first are left out before anything is
    sorted, so that a group of any size costs a count and a sort of a few times ``most_rows``; and texts follow for those chosen.
    """
    own = F.col("key").alias("g") if group is None else group.alias("g")
    rows = docs.withColumns({"key": F.col(key)}) if key != "key" else docs
    h = F.xxhash64(F.col("key"), F.col("key").isNull(), F.lit(salt), text_of(text)).alias("h")
    light = rows.select(h, "key", own, F.length(text_of(text)).alias("n")).where(F.col("n") <= most_chars // 20)
    if groups is not None:
        light = light.drop("g").join(broadcast_if_small(written(groups, "groups")), F.col("key") == F.col("group_key"))
    light = written(light.where(F.col("g").isNotNull()).select("h", "g", "n"), "drawn")
    counts = broadcast_if_small(written(light.groupBy("g").agg(F.count("*").alias("of")), "counts"))
    place = (F.col("h") / 2.0**64 + 0.5) * F.col("of")
    first = light.join(counts, "g").where(place <= 4 * most_rows + 200).groupBy("g", "h").agg(F.max("n").alias("n"))
    by = Window.partitionBy("g").orderBy("h")
    ranked = first.withColumns({"rank": F.row_number().over(by), "chars": F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0))})
    chosen = written(ranked.where((F.col("rank") <= most_rows) & (F.col("chars") <= most_chars)).select("h", "g"), "sample")
    return rows.select(h, text_of(text).alias("t")).join(broadcast_if_small(chosen), "h").select("h", "g", "t").dropDuplicates(["h", "g"])


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """``mapInArrow`` with state made once a task: ``make()`` returns the function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows and (out := each(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def in_one_task(rows: DataFrame, order: str, make: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``make(table)`` over all rows, sorted by a column, in one task of an executor: for samples of a documented bound only.

    The rows are written first, so that the task is repeated from there if its executor is lost.
    """
    given = written(rows, "one-task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if found:
            yield make(pa.Table.from_batches(found).sort_by(order))

    return given.repartition(1).mapInArrow(run, schema)
