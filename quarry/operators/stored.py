"""A stored text index: chunks, postings and statistics as tables that grow and shrink by batches.

Every text is cut into terms once, when it is added. A batch adds its chunks, its postings (``pos, term, tf, dl``) and frequencies, both in folders by
a hash of the term, so that a search reads the folders of its terms alone, and its share of the statistics. Removing documents adds what they take away from the
statistics and marks them; a marked document's rows of earlier batches are left out of every read. No batch is ever rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import terms
from quarry.operators.index import B, K1, idf, query_terms
from quarry.storage import broadcast_if_small, exists, spread, written

PARTS = ("chunks", "postings", "df", "stats", "removed")
REMOVED = "doc_id string, before int"
#: Folders of the terms' postings, and different terms of questions up to which the terms themselves are given to the scan.
BUCKETS, TERMS_IN_SCAN = 64, 2000


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class TextIndex:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # ------------------------------------------------------------------ reading

    def _exists(self, part: str) -> bool:
        return exists(self.spark, f"{self.root}/{part}")

    def _read(self, part: str) -> DataFrame:
        kinds = self.spark.read.text(f"{self.root}/schema-{part}").first()[0]
        return self.spark.read.schema(kinds).parquet(f"{self.root}/{part}")

    def _live(self, rows: DataFrame) -> DataFrame:
        if not self._exists("removed"):
            return rows
        gone = self._read("removed").groupBy("doc_id").agg(F.max("before").alias("before")).withColumnRenamed("doc_id", "gone_id")
        return rows.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.col("batch") < F.col("before")), "left_anti")

    @property
    def chunks(self) -> DataFrame:
        return self._live(self._read("chunks")).drop("batch")

    @property
    def postings(self) -> DataFrame:
        return self._live(self._read("postings")).drop("batch", "bucket")

    def of_terms(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Postings and ``term, df`` of the terms asked for (``term``), by scans of their folders alone.

        Up to ``TERMS_IN_SCAN`` different terms are named in the scan, which also rules out row groups; for more, all folders are read.
        """
        found = asked.select("term").distinct().limit(TERMS_IN_SCAN + 1).select("term", bucket(F.col("term")).alias("b")).collect()
        if len(found) <= TERMS_IN_SCAN:
            those = F.col("bucket").isin(sorted({r["b"] for r in found})) & F.col("term").isin([r["term"] for r in found])
        else:
            those = F.lit(True)
        postings = self._live(self._read("postings").where(those)).drop("batch", "bucket")
        return postings, self._read("df").where(those).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    @property
    def df(self) -> DataFrame:
        """``term, df``: the sum of what all batches added and took away."""
        return self._read("df").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    @property
    def stats(self) -> DataFrame:
        """One row: ``n, total, avgdl``."""
        sums = self._read("stats").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
        return sums.withColumn("avgdl", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0))

    # ------------------------------------------------------------------ writing

    def _next(self) -> int:
        return (self._read("stats").agg(F.max("batch")).first()[0] + 1) if self._exists("stats") else 1

    def _put(self, part: str, rows: DataFrame, batch: int, by: str | None = None) -> None:
        """A batch of a part; ``by`` a folder each: rows are sorted by term there, and a folder of many rows is written by several tasks."""
        path = f"{self.root}/{part}/batch={batch}"
        if not self._exists(f"schema-{part}"):  # a batch without rows, which has no files, can be read by it
            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", batch int"
            self.spark.range(1).select(F.lit(kinds)).coalesce(1).write.text(f"{self.root}/schema-{part}")
        if by:
            rows.hint("rebalance", by).sortWithinPartitions(by, "term").write.mode("overwrite").partitionBy(by).parquet(path)
        else:
            rows.write.mode("overwrite").parquet(path)

    def add(self, chunks: DataFrame) -> int:
        """Adds chunks (``pos, doc_id, chunk_id, text`` and more) that are not there yet; of equal keys the first counts, blank texts do not.

        Returns how many were added.
        """
        batch = self._next()
        fresh = chunks.where(F.col("text").rlike(r"\S"))
        if batch > 1:
            fresh = fresh.join(self.chunks.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_anti")
        # Only chunks whose key comes more than once are brought together.
        several = written(fresh.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "chunk_id"), "repeated")
        if not several.isEmpty():
            several = broadcast_if_small(several)
            first = F.row_number().over(Window.partitionBy("doc_id", "chunk_id").orderBy("pos"))
            once = fresh.join(several, ["doc_id", "chunk_id"], "left_semi").withColumn("_n", first).where("_n = 1").drop("_n")
            fresh = fresh.join(several, ["doc_id", "chunk_id"], "left_anti").unionByName(once)
        self._put("chunks", fresh, batch)
        added = self._read("chunks").where(F.col("batch") == batch)
        self._put("postings", term_counts(spread(added, "pos")).withColumn("bucket", bucket(F.col("term"))), batch, by="bucket")
        own = self._read("postings").where(F.col("batch") == batch)
        self._put("df", own.groupBy("bucket", "term").agg(F.count("*").alias("df")), batch, by="bucket")
        total = own.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
        self._put("stats", added.agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)), batch)  # one row each
        return self._read("stats").where(F.col("batch") == batch).first()["n"]

    def remove(self, doc_ids: DataFrame) -> None:
        """Takes documents (``doc_id``) out: their chunks, postings and share of the statistics."""
        batch, ids = self._next(), doc_ids.select("doc_id").distinct()
        chunks, postings = self.chunks.join(ids, "doc_id", "left_semi"), self.postings.join(ids, "doc_id", "left_semi")
        sizes = chunks.select("pos").join(postings.groupBy("pos").agg(F.first("dl").alias("dl")), "pos", "left")
        less = written(sizes.agg((-F.count("*")).alias("n"), (-F.coalesce(F.sum("dl"), F.lit(0))).alias("total")), "less")
        less_df = written(postings.groupBy(bucket(F.col("term")).alias("bucket"), "term").agg((-F.count("*")).alias("df")), "less-df")
        gone = written(ids.select("doc_id", F.lit(batch).alias("before")), "gone")
        self._put("df", less_df, batch, by="bucket")
        self._put("removed", gone, batch)
        self._put("stats", less, batch)

    def replace(self, chunks: DataFrame) -> int:
        """A changed document: what is there of it goes, then its chunks come."""
        self.remove(chunks.select("doc_id"))
        return self.add(chunks)


def term_counts(chunks: DataFrame) -> DataFrame:
    """``pos, doc_id, dl, term, tf``: the different terms of each chunk (``pos, doc_id, text``) with their counts and that of all. Runs of equal terms are counted in the sorted terms of a chunk, without a shuffle.

    A chunk's array of terms ends before its rows begin, as every row would get a copy of it. ``explode_outer``, since for ``explode`` Spark infers a filter that cuts all texts once more.
    """
    rows = chunks.select("pos", "doc_id", F.sort_array(terms(F.col("text"))).alias("s"))
    new = lambda x, i: (i == 0) | (x != F.get("s", i - 1))
    starts = F.filter(F.transform("s", lambda x, i: F.when(new(x, i), i)), lambda i: i.isNotNull())
    rows = rows.select("pos", "doc_id", "s", starts.alias("starts"))
    runs = F.transform("starts", lambda a, k: F.struct(F.get("s", a).alias("term"), (F.coalesce(F.get("starts", k + 1), F.size("s")) - a).cast("long").alias("tf")))
    rows = rows.select("pos", "doc_id", F.size("s").cast("long").alias("dl"), runs.alias("runs"))
    return rows.select("pos", "doc_id", "dl", F.explode_outer("runs").alias("r")).where("r IS NOT NULL").select("pos", "doc_id", "dl", "r.term", "r.tf")


#: Contributions of a partition in which the scores of a document are summed.
PARTS_IN_TASK = 4_000_000


def contributions(index: TextIndex, queries: DataFrame, key: str = "pos") -> DataFrame:
    """``query_id, key, term, part`` of BM25: only postings of the queries' terms are read. Statistics are of the whole index; a scope belongs behind this.

    The postings are brought together by document before each meets all queries that ask for its term: they are far fewer than the contributions, which need no shuffle of their own
    to be summed. There are as many partitions as contributions, counted by the terms' frequencies, ask for.
    """
    q = written(query_terms(queries), "query-terms")
    postings, df = index.of_terms(q)
    weighed = written(q.join(df, "term"), "query-df")
    n_parts = (weighed.agg(F.sum("df")).first()[0] or 0) // PARTS_IN_TASK + 1
    weighed = broadcast_if_small(weighed)
    asked = broadcast_if_small(written(q.select("term").distinct(), "asked-terms"))
    own = postings.join(asked, "term", "left_semi").select(key, "term", "tf", "dl")
    spark = index.spark
    own = own.repartition(max(n_parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)
    rows = own.join(weighed, "term").crossJoin(F.broadcast(index.stats))
    norm = K1 * (1 - B + B * F.col("dl") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0))
    part: Column = F.col("qtf") * idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return rows.select("query_id", key, "term", part.alias("part"))


def bm25(index: TextIndex, queries: DataFrame, key: str = "pos") -> DataFrame:
    return contributions(index, queries, key).groupBy("query_id", key).agg(F.sum("part").alias("score")).where("score > 0")
