"""Operator 1: line deduplication over deletion neighbourhoods.

A line goes if an earlier line (by document key, then position) is equal to it or one edit away: one character inserted,
deleted or replaced. An edit counts only if it is at most ``edit_share`` of the longer line, so that lines of fewer than ten characters,
of which one edit makes other words and numbers, go only if they are equal. All lines that are not blank take part.

Equal lines meet by hash. Of the different lines, only those go on that share an exact half with another line of the same
length or one more: one edit cannot touch both halves. Of these, only those go on that share all but one of ``PIECES`` pieces, again
because one edit touches one piece; so nothing is lost, and few lines are left. Those emit their deletion variants, for the characters of
the piece in question, as hashed keys: the line itself, the line without one character, and the same again with the place of the missing character.
Lines that are equal without the character of the same place differ by a replacement at most; a line that equals another without
some character is one deletion away. So within each key it is enough to compare with the earliest line of the
other kind (or of the same place): keys are grouped with a minimum, and no pairs are formed within a group. The edit distance of
each line and the one it would yield to is computed at the end.

Edge cases: null and empty texts have no lines and stay as they are; blank lines (of U+0020 and U+0009 to U+000D alone) always stay; line breaks
are ``\n``; lines of any length are compared whole (a line of n characters emits at most n / 8 variants for each piece in question); rows that repeat both key
and text count as one document and keep the same lines; null keys come last; a text that loses lines is the rest joined by ``\n``, the
empty text if none is left; an empty table gives an empty result; other columns are carried along, whatever their names, but for a column that is
named as the count of lines asked for, which is replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, broadcast_if_small, table, text_of, written

EDIT_SHARE = 0.1
PIECES = 8
U64 = np.uint64
#: An odd multiplier and its inverse modulo 2**64: hashes of a line without a character come from running sums.
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Fixed: a character that is not blank.
SHOWN = r"[^\x20\x09-\x0D]"


def least_edited(edit_share: float) -> int:
    """The length from which on a line may differ by an edit."""
    return math.ceil(1 / edit_share)


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``pos struct<none, k, f, no>, h, g, line``: lines that take part; ``h, g``: 96 bits of hash."""
    d = docs.select(F.col(key).alias("k"), text_of(text).alias("t"))
    d = d.select("k", F.xxhash64("t").alias("f"), F.posexplode(F.split("t", "\n")).alias("no", "line")).where(F.col("line").rlike(SHOWN))
    return d.select(F.struct(F.col("k").isNull().alias("none"), "k", "f", "no").alias("pos"), F.xxhash64("line").alias("h"), F.hash("line").alias("g"), "line")


def _halves(line: Column) -> Column:
    """Keys of the halves of a line, as one of its own length and as one of a character less."""
    out = []
    for length in (F.length(line), F.length(line) - 1):
        half = F.floor(length / 2).cast("int")
        out += [F.xxhash64(length, F.lit(0), F.left(line, half)), F.xxhash64(length, F.lit(1), F.right(line, length - half))]
    return F.array_distinct(F.array(*out))


def variant_keys(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the line (first) and of the line without each character, and the latter with the place mixed in."""
    c = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        c = (c + U64(1)) * U64(0xBF58476D1CE4E5B9)
        c = (c ^ (c >> U64(29))) * U64(0x94D049BB133111EB)
        c ^= c >> U64(32)
        power = np.cumprod(np.concatenate([[U64(1)], np.full(len(c) - 1, BASE, np.uint64)])) if len(c) else c
        upto = np.concatenate([[U64(0)], np.cumsum(c * power, dtype=np.uint64)])
        without = upto[:-1] + (upto[-1] - upto[1:]) * INVERSE
        shorter = without + U64(len(c) - 1) * U64(0xD6E8FEB86659FD93)
        whole = upto[-1:] + U64(len(c)) * U64(0xD6E8FEB86659FD93)
        place = (np.arange(1, len(c) + 1, dtype=np.uint64) * U64(0xA0761D6478BD642F)) ^ (without + U64(len(c)) * U64(0xE7037ED1A0B428DB))
        place = (place ^ (place >> U64(31))) * BASE
    return np.concatenate([whole, shorter]), place


def _pieces(line: Column) -> Column:
    """For the line as one of its own length and as one of a character less: a key of all but one piece, for each piece."""
    out = []
    for less in (0, 1):
        length = F.length(line) - less
        for k in range(PIECES):
            a, b = (F.floor(length * j / PIECES).cast("int") for j in (k, k + 1))
            key = F.xxhash64(length, F.lit(k), F.left(line, a), F.lit("|"), F.right(line, length - b))
            out.append(F.struct(key.alias("key"), F.lit(less).alias("less"), F.lit(k).alias("piece")))
    return F.array(*out)


def _variants(asked: DataFrame, least: int) -> DataFrame:
    """``key, kind, own``: kind 0 the line itself, 1 without a character, 2 without the character of a certain place.

    ``asked``: ``own, line, less, piece``; a line as one of its own length gives itself and kind 2, else kind 1. A line of fewer
    than ``least`` characters gives itself alone: it can only be what a longer one is without a character.
    """

    def make():
        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            keys, kinds, sizes = [], [], []
            for line, less, k in zip(*(b.column(c).to_pylist() for c in ("line", "less", "piece")), strict=True):
                all_keys, placed = variant_keys(line)
                n = len(placed) - less
                a, e = n * k // PIECES, n * (k + 1) // PIECES + less
                if len(placed) < least:
                    own = all_keys[: 0 if less else 1]
                else:
                    own = all_keys[1 + a : 1 + e] if less else np.concatenate([all_keys[:1], placed[a:e]])
                kind = np.full(len(own), 1 if less else 2, np.int8)
                if not less:
                    kind[0] = 0
                keys.append(own)
                kinds.append(kind)
                sizes.append(len(own))
            of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(kinds)), b.column("own").take(of)], schema=pa.schema([("key", pa.int64()), ("kind", pa.int8()), b.schema.field("own")]))

        return each

    return arrow_map(asked.select("own", "line", "less", "piece"), make, f"key long, kind byte, own {asked.schema['own'].dataType.simpleString()}")


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edit_share: float = EDIT_SHARE) -> DataFrame:
    """``k, f, no``: the lines that go."""
    lines, least = _lines(docs, key, text), least_edited(edit_share)
    halves = F.when(F.length("line") >= least - 1, _halves(F.col("line"))).alias("halves")
    distinct = written(lines.select("pos", "h", "g", halves).groupBy("h", "g").agg(F.min("pos").alias("pos"), F.count("*").alias("n"), F.first("halves").alias("halves")), "lines")
    halves = distinct.select("h", "g", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min(F.struct("h", "g")).alias("low"), F.max(F.struct("h", "g")).alias("high")).where(F.col("low") != F.col("high")).select("half")
    close = written(halves.join(shared, "half", "left_semi").select("h", "g").distinct().join(distinct.drop("halves", "n"), ["h", "g"]), "close")
    texts = written(lines.select("h", "g", "pos", "line").join(broadcast_if_small(close), ["h", "g", "pos"], "left_semi").dropDuplicates(["h", "g"]), "close-lines")
    own = F.struct("pos", "h", "g")
    placed = texts.select("h", "g", F.explode(_pieces(F.col("line"))).alias("p")).select("h", "g", "p.key", "p.less", "p.piece")
    several = placed.groupBy("key").agg(F.min(F.struct("h", "g")).alias("low"), F.max(F.struct("h", "g")).alias("high")).where(F.col("low") != F.col("high")).select("key")
    asked = placed.join(several, "key", "left_semi").select("h", "g", "less", "piece").distinct().join(texts, ["h", "g"]).select(own.alias("own"), "line", "less", "piece")
    met = written(_variants(asked, least), "variants")
    first = met.groupBy("key").agg(F.min(F.when(F.col("kind") == 0, F.col("own"))).alias("whole"), F.min(F.when(F.col("kind") == 1, F.col("own"))).alias("cut"), F.min(F.when(F.col("kind") == 2, F.col("own"))).alias("placed"), F.count("*").alias("n")).where("n > 1").drop("n")
    partner = F.when(F.col("kind") == 0, F.col("cut")).when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("placed"))
    pairs = met.join(first, "key").select("own", partner.alias("earlier")).where(F.col("earlier.pos") < F.col("own.pos")).select("own.h", "own.g", F.col("earlier.h").alias("h1"), F.col("earlier.g").alias("g1")).distinct()
    near = pairs.join(texts.select("h", "g", "line"), ["h", "g"]).join(texts.select(F.col("h").alias("h1"), F.col("g").alias("g1"), F.col("line").alias("earlier")), ["h1", "g1"])
    near = written(near.where(F.levenshtein("line", "earlier", 1).between(0, 1)).select("h", "g").distinct().withColumn("near", F.lit(True)), "near-lines")
    gone = written(distinct.select("h", "g", F.col("pos").alias("first"), "n").join(near, ["h", "g"], "left").where((F.col("n") > 1) | F.col("near")).select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near")), "gone")
    out = lines.select("pos", "h", "g").join(broadcast_if_small(gone), ["h", "g"]).where(F.col("near") | (F.col("pos") > F.col("first")))
    return out.select("pos.k", "pos.f", "pos.no").distinct()


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", edit_share: float = EDIT_SHARE) -> DataFrame:
    """``row, text, n_gone`` of every row: the row as it was, its text without the lines that go, and their number."""
    gone = repeated_lines(docs, key, text, edit_share).groupBy(F.col("k").alias("gone_k"), F.col("f").alias("gone_f")).agg(F.collect_list("no").alias("gone_no"))
    whole = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.xxhash64(text_of(text)).alias("f"), F.col(text).alias("text"))
    lines = F.split("text", "\n")
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone_no")))
    rest = F.transform(F.array(F.struct(lines.alias("all"), left.alias("left"))), lambda x: F.array_join(F.transform(x["left"], lambda i: x["all"][i]), "\n"))[0]
    out = whole.join(gone, F.col("k").eqNullSafe(F.col("gone_k")) & (F.col("f") == F.col("gone_f")), "left")
    return out.select("row", F.when(F.col("gone_no").isNull(), F.col("text")).otherwise(rest).alias("text"), F.coalesce(F.size("gone_no"), F.lit(0)).alias("n_gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edit_share: float = EDIT_SHARE, count: str = "lines_gone") -> DataFrame:
    """All rows with their columns, the text without the lines that go, and in ``count`` their number."""
    out = without_repeats(docs, key, text, edit_share)
    kept = [F.col("text").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c != count]
    return out.select(*kept, F.col("n_gone").alias(count))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n_lines", F.when(text_of() == "", 0).otherwise(F.size(F.split(text_of(), "\n"))).cast("long"))
    return dedup_lines(docs).select("doc_id", "n_lines", F.col("lines_gone").cast("long").alias("n_gone"), F.sha2(text_of(), 256).alias("text_sha256"))


SQL_OP1 = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text <> ''
), d AS (
  SELECT line, min((doc_id, no)) AS pos FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line
), v AS (
  SELECT line, pos, left(line, i - 1) || substr(line, i + 1) AS cut, i FROM (SELECT line, pos, unnest(range(1, length(line) + 1)) AS i FROM d WHERE length(line) >= 10)
), near AS (
  SELECT DISTINCT b.line FROM v a JOIN v b ON a.cut = b.cut AND a.i = b.i WHERE a.pos < b.pos
  UNION SELECT DISTINCT b.line FROM d a JOIN v b ON a.line = b.cut WHERE a.pos < b.pos
  UNION SELECT DISTINCT b.line FROM v a JOIN d b ON a.cut = b.line WHERE a.pos < b.pos
), k AS (
  SELECT l.doc_id, l.no, l.line, coalesce((l.doc_id, l.no) > d.pos OR near.line IS NOT NULL, false) AS gone
  FROM l LEFT JOIN d ON l.line = d.line LEFT JOIN near ON l.line = near.line
), r AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_gone, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '') AS rest FROM k GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_gone, 0)::BIGINT AS n_gone, sha256(coalesce(rest, '')) AS text_sha256
FROM documents d LEFT JOIN r USING (doc_id)
"""
