"""Operator 13: fill-in-middle transformation.

A text is cut into units (``[A-Za-z]+|[^A-Za-z]``) by the tokenizers library's Split pre-tokenizer, whose isolated matches come with offsets
in code points; nothing is trained. The length of the offset array is the number of units, and the offsets at two ranks are the ends
of prefix and middle. A space is always a unit of its own, so that the library sees every different run between spaces once
(bounded cache) and the array of a text is put together from theirs. Slicing, rendering and restoring are DataFrame functions.

Ranks and forms come from the SHA-256 of a seed and the decimal key, so that every run transforms alike.

Edge cases: a null text is empty and stays plain, as does a text that holds a sentinel; a null key counts as the empty string; rows with the same
key and text are transformed alike, rows with the same key and other texts by the same draws; an empty table gives an empty result; texts of any
length, of one unit too, are cut whole; other columns are carried along, and the operator's are named ``fim`` and packed in one structure, which
replaces a column of that name.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, pre_tokenizers

from quarry.llm.common import table, text_of

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are transformed, and of those the percent with the suffix first.
RATE, SPM_RATE = 90, 20


class UnitOffsets(dict):
    """Starts of the units of a text, in code points; itself the starts within runs between spaces, the space behind included."""

    def __init__(self, most: int = 200_000, longest: int = 64) -> None:
        self.most, self.longest = most, longest
        self.cut = pre_tokenizers.Split(Regex(UNIT), behavior="isolated")

    def __missing__(self, run: str) -> np.ndarray:
        starts = np.array([start for _, (start, _) in self.cut.pre_tokenize_str(run + " ")], np.int64)
        if len(run) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[run] = starts
        return starts

    def of(self, text: str) -> np.ndarray:
        runs = text.split(" ")
        starts = [self[r] for r in runs]
        lengths = np.fromiter(map(len, runs), np.int64, len(runs)) + 1
        units = np.fromiter(map(len, starts), np.int64, len(starts))
        return (np.concatenate(starts) + np.repeat(np.cumsum(lengths) - lengths, units))[:-1]


@lru_cache(maxsize=1)
def _offsets() -> UnitOffsets:
    """One cache a worker process."""
    return UnitOffsets()


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "first", "second")]))
def _cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    """Units of each text, and the places (code points) where prefix and middle end: behind the smaller and the larger of two draws modulo n + 1."""
    own = _offsets()
    n, ends = np.zeros(len(text), np.int64), np.zeros((2, len(text)), np.int64)
    for k, (t, a, b) in enumerate(zip(text, one.to_numpy(), two.to_numpy(), strict=True)):
        t = t.as_py()
        starts = own.of(t)
        n[k] = len(starts)
        ends[:, k] = [starts[r] if r < len(starts) else len(t) for r in sorted((a % (len(starts) + 1), b % (len(starts) + 1)))]
    return pa.StructArray.from_arrays([pa.array(n), pa.array(ends[0]), pa.array(ends[1])], ["n", "first", "second"])


def draws(key: str, seed: int = 1) -> list[Column]:
    """Four draws of 32 bits: the first groups of eight digits of the hexadecimal SHA-256 of seed, colon and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made. No part holds a sentinel, so that cutting at sentinels gives the three parts in their order."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """The rows of ``docs`` with ``fim struct<n, form, prefix, middle, suffix, output>``; the parts are null if the form is plain."""
    h = draws(key, seed)
    t = text_of(text)
    plain = (t == "") | t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE) | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    rows = docs.select(F.struct("*").alias("row"), t.alias("t"), form.alias("form"), _cuts(t, h[0], h[1]).alias("cut"))
    whole = F.col("form") == "plain"
    first, second = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    part = lambda start, length: F.when(~whole, F.substring(F.col("t"), start + 1, length))
    rows = rows.select("row", "t", "form", F.col("cut.n").alias("n"), part(F.lit(0), first).alias("p"), part(first, second - first).alias("m"), part(second, F.length("t") - second).alias("s"))
    output = F.when(whole, F.col("t")).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "s", F.lit(PREFIX), "p", F.lit(MIDDLE), "m")).otherwise(F.concat(F.lit(PREFIX), "p", F.lit(SUFFIX), "s", F.lit(MIDDLE), "m"))
    fim = F.struct("n", "form", F.col("p").alias("prefix"), F.col("m").alias("middle"), F.col("s").alias("suffix"), output.alias("output"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "fim"], fim.alias("fim"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("fim.output"), F.col("fim.form"))
    chars = [F.length(f"fim.{p}").cast("long").alias(f"{p}_chars") for p in ("prefix", "middle")]
    return made.select("doc_id", F.col("fim.n").alias("n"), F.col("fim.form").alias("form"), *chars, F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


SQL_OP13 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), h AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT doc_id, text, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM p
"""
