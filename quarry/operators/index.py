"""Chunks, postings and rankings: BM25, exact vector similarity and their fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions.text import terms
from quarry.storage import BROADCAST_BYTES, measured_bytes, written

K1, B, RRF = 1.2, 0.75, 60
#: Cosines that are held at a time when blocks of vectors meet.
SCORES = 1 << 19


def chunks_of_documents(docs: DataFrame) -> DataFrame:
    """Every document as one chunk: ``pos`` is its place in stored order."""
    return docs.where(F.trim("text") != "").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("doc_id"), F.lit("c00000").alias("chunk_id"), "text", "lang", "source")


def first_wins(df: DataFrame, key: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def postings(chunks: DataFrame, key: str = "pos") -> DataFrame:
    return chunks.select(key, F.explode(terms(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def lengths(chunks: DataFrame, key: str = "pos") -> DataFrame:
    return chunks.select(key, F.size(terms(F.col("text"))).cast("long").alias("dl"))


def corpus_stats(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).withColumn("avgdl", F.col("total") / F.greatest("n", F.lit(1)))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, qtf`` of ``query_id, query``."""
    return queries.select("query_id", F.explode(terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_contributions(chunks: DataFrame, queries: DataFrame, key: str = "pos") -> DataFrame:
    """``query_id, key, term, part``: only postings of the queries' terms are ever grouped or joined.

    Statistics are of the whole of ``chunks``; a scope belongs behind this.
    """
    q = query_terms(queries)
    tokens = chunks.select(key, terms(F.col("text")).alias("t"))
    wanted = tokens.select(key, F.size("t").cast("long").alias("dl"), F.explode("t").alias("term")).join(q.select("term").distinct(), "term", "left_semi")
    tf = wanted.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    stats = corpus_stats(tokens.select(F.size("t").cast("long").alias("dl")))
    rows = tf.join(df, "term").join(q, "term").crossJoin(F.broadcast(stats))
    norm = K1 * (1 - B + B * F.col("dl") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0))
    return rows.select("query_id", key, "term", (F.col("qtf") * idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("part"))


def bm25(chunks: DataFrame, queries: DataFrame, key: str = "pos") -> DataFrame:
    return bm25_contributions(chunks, queries, key).groupBy("query_id", key).agg(F.sum("part").alias("score")).where("score > 0")


def top_k(ranked: DataFrame, k: int, by: list[Column], partition: str = "query_id", name: str = "rank") -> DataFrame:
    return ranked.withColumn(name, F.row_number().over(Window.partitionBy(partition).orderBy(*by))).where(F.col(name) <= k)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero or widths differ; summed in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def packed(vectors: DataFrame, key: str, vector: str, cell: str | None = None, rows: int = 4096) -> DataFrame:
    """``keys array, width, unit binary`` (and ``cell``): unit vectors in blocks of ``rows`` of one width and cell; vectors that are null or zero are left out."""
    names = ["keys", "width", "unit"] + ["cell"] * bool(cell)

    def run(batches):
        for b in batches:
            widths = np.array([len(v) if v.is_valid else 0 for v in b.column(1)], np.int64)
            cells = b.column(2).to_numpy(zero_copy_only=False) if cell else np.zeros(len(widths), np.int64)
            for width, own in sorted({(int(w), int(c)) for w, c in zip(widths, cells, strict=True) if w}):
                at = np.flatnonzero((widths == width) & (cells == own))
                m = np.asarray(b.column(1).take(pa.array(at)).flatten(), np.float64).reshape(-1, width)
                norm = np.sqrt((m * m).sum(1))
                at, m, norm = at[norm > 0], m[norm > 0], norm[norm > 0]
                for k in range(0, len(at), rows):
                    some = at[k : k + rows]
                    columns = [pa.ListArray.from_arrays([0, len(some)], b.column(0).take(pa.array(some))), pa.array([width], pa.int32()), pa.array([(m[k : k + rows] / norm[k : k + rows, None]).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array([own], pa.int32())] * bool(cell), names)

    simple = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, vector, *([cell] if cell else [])).mapInArrow(run, f"keys array<{simple}>, width int, unit binary" + ", cell int" * bool(cell))


def best_of_blocks(met: DataFrame, most: int, kind: T.DataType) -> DataFrame:
    """``query_id, key, score``: for blocks of vectors next to blocks of questions (``query_keys, query_unit``), of every block each question's ``most``
    rows of largest positive cosine; ties go to the smaller key."""
    arrow = to_arrow_type(kind)

    def run(batches):
        for b in batches:
            asked, found, scores = [], [], []
            for keys, width, unit, qk, qu in zip(*(b.column(c) for c in ("keys", "width", "unit", "query_keys", "query_unit")), strict=True):
                keys, qk = keys.values, qk.values.to_pylist()
                order = np.asarray(pc.sort_indices(keys))
                own = np.frombuffer(unit.as_py()).reshape(-1, width.as_py())[order].T
                q = np.frombuffer(qu.as_py()).reshape(-1, width.as_py())
                for k in range(0, len(q), step := max(1, SCORES // max(len(order), 1))):
                    score = np.round(q[k : k + step] @ own, 12)
                    best = np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, :most]
                    value = np.take_along_axis(score, best, axis=1)
                    asked += [a for a, n in zip(qk[k : k + step], (value > 0).sum(1), strict=True) for _ in range(n)]
                    found.append(keys.take(pa.array(order[best][value > 0])))
                    scores.append(value[value > 0])
            columns = [pa.array(asked, pa.string()), pa.concat_arrays([f.cast(arrow) for f in found]) if found else pa.array([], arrow), pa.array(np.concatenate(scores) if scores else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "key", "score"])

    return met.select("keys", "width", "unit", "query_keys", "query_unit").mapInArrow(run, f"query_id string, key {kind.simpleString()}, score double")


def dense(vectors: DataFrame, queries: DataFrame, most: int, key: str = "pos", rows: int = 4096) -> DataFrame:
    """``query_id, key, score``: for every query (``query_id, query_vector``) the ``most`` rows of largest positive cosine, and more.

    Vectors and questions come in blocks of unit vectors, every two of which are one product of matrices. The blocks of questions go to every task if
    they are small, by measurement; else they are numbered and every block of vectors is dealt to each number, so that no task gets more than one number's share.
    """
    q = written(packed(queries, "query_id", "query_vector", rows=rows).withColumnsRenamed({"keys": "query_keys", "unit": "query_unit", "width": "query_width"}), "question-blocks")
    v = packed(vectors, key, "embedding", rows=rows)
    if measured_bytes(q) <= BROADCAST_BYTES:
        met = v.join(F.broadcast(q), F.col("width") == F.col("query_width"))
    else:
        n = q.count()
        q = q.withColumn("no", F.pmod(F.xxhash64("query_keys"), F.lit(n)).cast("int"))
        dealt = v.withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        met = dealt.join(q, "no").where(F.col("width") == F.col("query_width"))
    return best_of_blocks(met, most, vectors.schema[key].dataType).withColumnRenamed("key", key)


def fuse(keyword: DataFrame, vector: DataFrame, key: str = "pos") -> DataFrame:
    """Reciprocal rank fusion of two ranked legs (``query_id, key, rank``) with the sources of each hit."""
    legs = keyword.select("query_id", key, "rank", F.lit("keyword").alias("leg")).unionByName(vector.select("query_id", key, "rank", F.lit("dense").alias("leg")))
    rank_in = lambda leg: F.min(F.when(F.col("leg") == leg, F.col("rank")))
    return legs.groupBy("query_id", key).agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("score"), rank_in("keyword").alias("keyword_rank"), rank_in("dense").alias("dense_rank"))


def hybrid(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int = 10, key: str = "pos", scores: DataFrame | None = None) -> DataFrame:
    """Both legs to a pool of ``max(4 * limit, 30)``, fused and cut; texts join only what is left. ``scores``: of a stored index, else all texts are cut."""
    pool = max(4 * limit, 30)
    words = top_k(scores if scores is not None else bm25(chunks, queries.select("query_id", "query"), key), pool, [F.desc(F.round("score", 9)), F.col(key)])
    near = top_k(dense(vectors.join(chunks.select(key), key, "left_semi"), queries.select("query_id", "query_vector"), pool, key), pool, [F.desc(F.round("score", 9)), F.col(key)])
    fused = fuse(words, near, key)
    return top_k(fused, limit, [F.desc(F.round("score", 12)), F.col("keyword_rank").asc_nulls_last(), F.col("dense_rank").asc_nulls_last()])
