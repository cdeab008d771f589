"""The manifest of indexed documents and incremental indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(manifest: DataFrame) -> DataFrame:
    """The newest record of each document; ties go to the least md5."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("indexed_at"), "md5")
    return manifest.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("doc_id", "md5", "indexed_at", "pipeline", "chunk_count")


def metadata_view(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """``doc_id, indexed_at`` of every document with chunks; an unknown time is the empty text."""
    times = newest(manifest).select("doc_id", F.date_format("indexed_at", "yyyy-MM-dd HH:mm:ss").alias("indexed_at"))
    return chunks.select("doc_id").distinct().join(times, "doc_id", "left").withColumn("indexed_at", F.coalesce("indexed_at", F.lit("")))


def skip_decisions(incoming: DataFrame, manifest: DataFrame, live: DataFrame) -> DataFrame:
    """``decision`` of each incoming ``doc_id, md5, pipeline``: skip, new, or why it is stale."""
    known = newest(manifest).select("doc_id", F.col("md5").alias("old_md5"), F.col("pipeline").alias("old_pipeline"), "chunk_count")
    there = live.groupBy("doc_id").agg(F.count("*").alias("live_chunks"))
    rows = incoming.join(known, "doc_id", "left").join(there, "doc_id", "left")
    decision = F.when(F.col("old_md5").isNull(), "new").when(F.col("old_md5") != F.col("md5"), "content changed").when(F.col("old_pipeline") != F.col("pipeline"), "pipeline changed").when(F.coalesce("live_chunks", F.lit(0)) < F.col("chunk_count"), "chunks missing").otherwise("skip")
    return rows.select("doc_id", decision.alias("decision"))


def replace_documents(existing: DataFrame, arriving: DataFrame, key: str = "doc_id") -> DataFrame:
    """What is there without the documents that arrive anew, and those."""
    return existing.join(arriving.select(key).distinct(), key, "left_anti").unionByName(arriving)


def remove_documents(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def listing(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Records with the chunks that each document has now."""
    live = chunks.groupBy("doc_id").agg(F.count("*").alias("live_chunks"))
    return manifest.join(live, "doc_id", "left").withColumn("live_chunks", F.coalesce("live_chunks", F.lit(0)))


def recordable(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """Records of documents that have chunks."""
    return records.join(chunks.select("doc_id").distinct(), "doc_id", "left_semi")


def forget(manifest: DataFrame, values: DataFrame) -> DataFrame:
    """``doc_id`` of every document that a value names, by its id or by the md5 of any of its records."""
    named = values.select(F.col("value").alias("doc_id")).join(manifest.select("doc_id"), "doc_id", "left_semi")
    hashed = manifest.join(values.select(F.col("value").alias("md5")), "md5", "left_semi").select("doc_id")
    return named.unionByName(hashed).distinct()


def corpus_status(chunks: DataFrame) -> DataFrame:
    """One row: chunks, chunks with a vector (null ``embedding``: none), documents."""
    return chunks.agg(F.count("*").alias("chunks"), F.count("embedding").alias("vectors"), F.countDistinct("doc_id").alias("documents"))
