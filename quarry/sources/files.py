"""Readers of documents and pages, and the parse cache."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import strip
from quarry.operators.prefix import numbered
from quarry.storage import exists, remove, written

TEXT_SUFFIXES, WORD_SUFFIXES = (".txt", ".md", ".markdown"), (".docx",)


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """``source_file, suffix, content, md5``; suffixes without a reader are an error that names them."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]*$", 0).alias("source_file"), F.lower(F.regexp_extract("path", r"\.[^./]*$", 0)).alias("suffix"), "content", F.md5("content").alias("md5"))
    known = F.when(F.col("suffix").isin(*TEXT_SUFFIXES, *WORD_SUFFIXES), F.col("suffix")).otherwise(F.raise_error(F.concat(F.lit("no reader for "), F.col("source_file"))))
    return files.withColumn("suffix", known)


@F.pandas_udf(T.StringType())
def decode(content: pd.Series) -> pd.Series:
    """UTF-8, UTF-16, GB 18030 or Latin-1, the first that fits, in this order."""

    def one(b: bytes) -> str | None:
        if b is None:
            return None
        for kind in ("utf-8", "utf-16", "gb18030"):
            try:
                return b.decode(kind)
            except UnicodeDecodeError:
                continue
        return b.decode("latin-1")

    return content.map(one)


def no_box() -> Column:
    """The box of a block that has no place on a page."""
    return F.array(*[F.lit(0.0)] * 4).alias("bbox")


def clean(text: Column) -> Column:
    text = F.replace(F.replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(text, "[ \\t]+", " "))


def text_blocks(texts: DataFrame, most: int = 1200) -> DataFrame:
    """Blocks between blank lines of ``doc_id, suffix, text``. In Markdown a block that begins with # is one title, whole; other long ones are cut at lines."""
    parts = texts.select("doc_id", "suffix", F.posexplode(F.split("text", r"\n\s*\n")).alias("b", "t")).withColumn("t", clean(F.col("t"))).where("t <> ''")
    marks = F.length(F.regexp_extract("t", "^(#*)", 1))
    heading = strip(F.regexp_replace("t", "^#+", ""))
    title = (marks > 0) & F.col("suffix").isin(".md", ".markdown") & (heading != "")
    parts = parts.select("doc_id", "b", title.alias("title"), F.when(title, marks).alias("level"), F.when(title, heading).otherwise(F.col("t")).alias("t"))
    lines = F.when(~F.col("title") & (F.length("t") > most), F.split("t", "\n")).otherwise(F.array("t"))
    parts = parts.select("doc_id", "b", "title", "level", F.posexplode(lines).alias("l", "t")).withColumn("t", clean(F.col("t"))).where("t <> ''")
    return parts.select("doc_id", (F.col("b") * 100_000 + F.col("l")).alias("pos"), F.lit(1).alias("page_num"), F.when(F.col("title"), "Title").otherwise("Text").alias("block_type"), F.col("t").alias("text"), "level", F.lit(0.0).alias("font_size"), no_box())


def html_blocks(pages: DataFrame) -> DataFrame:
    """Headings, paragraphs and list items of ``page_id, html`` in order."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<(?:h[1-6]|p|li)\b[^>]*>.*?</(?:h[1-6]|p|li)>"), F.lit(0))
    rows = pages.select(F.col("page_id").cast("string").alias("doc_id"), F.posexplode(found).alias("pos", "tag"))
    text = F.trim(F.regexp_replace(F.regexp_replace("tag", "<[^>]*>", " "), r"\s+", " "))
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(c))
    heading = F.regexp_extract("tag", r"(?i)^<h([1-6])", 1)
    return rows.select("doc_id", "pos", F.lit(1).alias("page_num"), F.when(heading != "", "Title").otherwise("Text").alias("block_type"), text.alias("text"), F.when(heading != "", heading.cast("int")).alias("level"), F.lit(0.0).alias("font_size"), no_box()).where("text <> ''")


def parse_key(version: str, path: Column, size: Column, mtime: Column, options: str = "") -> Column:
    return F.sha2(F.concat_ws("|", F.lit(version), path, size.cast("string"), mtime.cast("string"), F.lit(options)), 256)


def evict(cache: DataFrame, most_bytes: int) -> DataFrame:
    """What stays of a cache (``key, size, used_at``): the most recently used up to a number of bytes. The running sum is taken over ranges, in no single task."""
    summed = numbered(cache, [F.desc("used_at"), F.col("key")], {"_total": F.col("size")})
    return summed.where(F.col("_total") <= most_bytes).drop("_n", "_total")


class ParseCache:
    """Parsed inputs by :func:`parse_key` under ``root``: what was parsed before is read, the rest is parsed and put in.

    Every call is a batch of its own: its new entries and the keys it used. An eviction writes the entries that stay as a new generation and then names that, so that a reader finds
    the old one or the new one whole. An entry is used whenever a call asks for it.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _generation(self) -> int:
        """The latest one that is complete: its name is written behind its rows."""
        if not exists(self.spark, f"{self.root}/generations"):
            return 0
        return self.spark.read.text(f"{self.root}/generations").agg(F.max(F.col("value").cast("int"))).first()[0]

    def _path(self, part: str) -> str:
        return f"{self.root}/{part}-{self._generation()}"

    @property
    def entries(self) -> DataFrame | None:
        """``key, value``: each key once."""
        if not exists(self.spark, self._path("entries")):
            return None
        return self.spark.read.parquet(self._path("entries")).dropDuplicates(["key"])

    @property
    def uses(self) -> DataFrame:
        """``key, used_at``: the last call that used each key."""
        return self.spark.read.parquet(self._path("uses")).groupBy("key").agg(F.max("used_at").alias("used_at"))

    def read_through(self, inputs: DataFrame, parse: Callable[[DataFrame], DataFrame], used_at: int) -> DataFrame:
        """``key, value, hit`` of ``inputs`` (``key`` and what ``parse`` needs): ``parse`` returns ``key, value`` and sees the inputs that the cache lacks, each once."""
        asked = written(inputs, "cache-inputs")
        held = self.entries
        new = (asked if held is None else asked.join(held.select("key"), "key", "left_anti")).dropDuplicates(["key"])
        parsed = written(parse(new).select("key", "value"), "parsed")
        known = None if held is None else written(held.join(asked.select("key").distinct(), "key", "left_semi").select("key", "value"), "held")
        parsed.write.mode("append").parquet(self._path("entries"))
        asked.select("key", F.lit(used_at).cast("long").alias("used_at")).distinct().write.mode("append").parquet(self._path("uses"))
        out = parsed.withColumn("hit", F.lit(False))
        return out if known is None else out.unionByName(known.withColumn("hit", F.lit(True)))

    def trim(self, most_bytes: int) -> int:
        """Leaves the most recently used entries of ``most_bytes`` in all, by the bytes of their values, and returns how many there are."""
        sized = self.entries.join(self.uses, "key").select("key", "value", F.octet_length("value").cast("long").alias("size"), "used_at")
        kept = written(evict(sized, most_bytes), "kept")
        n, old = self._generation() + 1, [self._path(part) for part in ("entries", "uses")]
        kept.select("key", "value").write.parquet(f"{self.root}/entries-{n}")
        kept.select("key", "used_at").write.parquet(f"{self.root}/uses-{n}")
        self.spark.range(1).select(F.lit(str(n))).coalesce(1).write.mode("append").text(f"{self.root}/generations")
        for path in old:
            remove(self.spark, path)
        return kept.count()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def vector_from_base64(text: pd.Series) -> pd.Series:
    """Vectors stored as base64 of little-endian 32-bit floats; null where the length does not fit."""
    import base64

    import numpy as np

    def one(t: str) -> list[float] | None:
        if t is None:
            return None
        b = base64.b64decode(t)
        return np.frombuffer(b, "<f4").tolist() if len(b) % 4 == 0 else None

    return text.map(one)
