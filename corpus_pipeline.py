"""A corpus pipeline of five stages, each of which works on what the stage before has kept.

Every stage is written as Parquet and read again before the next. All but the last return the columns of ``documents``.

Edge cases, in every stage: other columns are carried along whatever their names, nulls in them too; an empty table stays empty. A null or
empty text is rejected by the quality rules; where it comes to a later stage it keeps its row, has no lines, is a group of its own, holds no
window and has no ids. Rows that repeat both key and text lose the same lines and are one document afterwards; rows with the same key and other
texts are documents of their own; a null key is kept. Texts of any length are read whole. A table without benchmark items or labels takes nothing away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    from quarry.llm.common import table
    from quarry.llm.quality import quality_filter

    return quality_filter(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, and documents of which no line is left; ``n_chars`` follows the text."""
    from quarry.llm.line_dedup import without_repeats

    out = without_repeats(docs).where((F.col("n_gone") == 0) | (F.coalesce("text", F.lit("")) != ""))
    own = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_gone") > 0, F.length("text")).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[c.alias(name) for name, c in own.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the first document stays."""
    from quarry.llm.dart_minhash import first_of_each_group

    return first_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item stands go."""
    from quarry.llm.common import table
    from quarry.llm.decontaminate import without_contamination

    return without_contamination(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every document that is left, and the digest of the text decoded from them."""
    import public_tokenizers

    from quarry.llm.bpe import bpe_round_trip

    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.common import table, written

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Encoding by a given vocabulary and learned thresholds are beyond SQL.
ORACLE_SQL = None
