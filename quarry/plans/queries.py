"""The engine's queries over the given tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import answers, chunking, directory_tree, evaluate, evidence, filters, index, manifest, patterns, routing, section_tree, stored
from quarry.sources import files
from quarry.storage import broadcast_if_small, fresh_dir, written
from quarry.streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return index.chunks_of_documents(read(spark, d, "documents"))


_INDEXES: dict[tuple[str, str], stored.TextIndex] = {}


def text_index(spark: SparkSession, d: str) -> stored.TextIndex:
    """The stored index of a folder's documents, built once a session: every text is cut once."""
    name = spark.sparkContext.applicationId, d
    if name not in _INDEXES:
        made = stored.TextIndex(spark, fresh_dir(spark, "text-index"))
        made.add(chunks(spark, d))
        _INDEXES[name] = made
    return _INDEXES[name]


QUESTIONS = [("q1", "the heon shou"), ("q2", "und erkeit"), ("q3", "les oument eant the"), ("q4", "ties ties the")]


def questions(spark: SparkSession) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(q).alias("query")) for i, q in QUESTIONS]))
    return spark.range(1).select(rows.alias("r")).select("r.*")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# Shared SQL. The given tables hold no Han text, so that terms are runs of letters and digits of two bytes or more.
T = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{Nd}]+'), lambda x: strlen(x) >= 2)"
CHUNKS = f"c AS (SELECT doc_id AS pos, doc_id::VARCHAR AS doc_id, text, lang, source, {T} AS t FROM documents WHERE trim(text) <> '')"
TOKENS = f"{CHUNKS}, tok AS (SELECT pos, unnest(t) AS term FROM c), tf AS (SELECT pos, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), st AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM c)"
ASKED = "q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(string_split(query, ' ')) AS term FROM (VALUES " + ", ".join(f"('{i}', '{q}')" for i, q in QUESTIONS) + ") v(query_id, query)) GROUP BY ALL)"
PARTS = f"{TOKENS}, {ASKED}, parts AS (SELECT query_id, tf.pos, tf.term, qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(c.t) / avgdl)) AS part FROM tf JOIN df USING (term) JOIN q USING (term) JOIN c USING (pos), st), bm AS (SELECT query_id, pos, sum(part) AS score FROM parts GROUP BY ALL)"


def scored(asked: str) -> str:
    """BM25 scores ``bm`` of the questions in ``asked``, which defines ``q`` (``query_id, term, qtf``)."""
    return PARTS.replace(ASKED, asked)


# ---------------------------------------------------------------- statistics


@query(f"WITH {TOKENS} SELECT pos, count(*)::BIGINT AS n_terms, sum(tf)::BIGINT AS n_tokens FROM tf GROUP BY pos")
def term_freq(spark, d):
    return text_index(spark, d).postings.groupBy("pos").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"))


@query(f"WITH {TOKENS} SELECT term, df::BIGINT AS df FROM df")
def doc_freq(spark, d):
    return text_index(spark, d).df


@query(f"WITH {CHUNKS} SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS total, round(sum(len(t)) / count(*), 6) AS avgdl FROM c")
def corpus_stats(spark, d):
    return text_index(spark, d).stats.select("n", "total", r6(F.col("avgdl"), "avgdl"))


@query(f"WITH {TOKENS} SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st")
def term_idf(spark, d):
    own = text_index(spark, d)
    return own.df.crossJoin(F.broadcast(own.stats)).select("term", r6(index.idf(F.col("n"), F.col("df")), "idf"))


@query("SELECT doc_id::VARCHAR AS doc_id, md5(text) AS md5, length(text)::BIGINT AS n FROM documents")
def fingerprints(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.md5("text").alias("md5"), F.length("text").cast("long").alias("n"))


# ---------------------------------------------------------------- ranking


@query(f"WITH {PARTS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM bm) SELECT query_id, pos, rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def bm25_topk(spark, d):
    ranked = stored.bm25(text_index(spark, d), questions(spark))
    return index.top_k(ranked, 10, [F.desc("score"), F.col("pos")]).select("query_id", "pos", F.col("rank").cast("long").alias("rank"), r6(F.col("score"), "score"))


@query(f"WITH {PARTS}, r AS (SELECT bm.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM bm JOIN c USING (pos) WHERE source IN ('src1', 'src2')) SELECT query_id, pos, rank, round(score, 6) AS score FROM r WHERE rank <= 5")
def bm25_scoped(spark, d):
    c = chunks(spark, d)
    inside = c.where(F.col("source").isin("src1", "src2")).select("pos")
    ranked = stored.bm25(text_index(spark, d), questions(spark)).join(inside, "pos", "left_semi")
    return index.top_k(ranked, 5, [F.desc("score"), F.col("pos")]).select("query_id", "pos", F.col("rank").cast("long").alias("rank"), r6(F.col("score"), "score"))


@query(f"WITH {PARTS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, pos ORDER BY round(part, 9) DESC, term) AS n FROM parts) SELECT query_id, pos, term, round(part, 6) AS part, n FROM r WHERE n <= 3")
def bm25_attribution(spark, d):
    parts = stored.contributions(text_index(spark, d), questions(spark))
    n = F.row_number().over(Window.partitionBy("query_id", "pos").orderBy(F.desc(F.round("part", 9)), "term"))
    return parts.withColumn("n", n.cast("long")).where("n <= 3").select("query_id", "pos", "term", r6(F.col("part"), "part"), "n")


def vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), "embedding", "label")


def vector_questions(spark, d):
    """Every vector whose id is divisible by a hundred."""
    asked = vectors(spark, d).where("pos % 100 = 0")
    return asked.select(F.concat(F.lit("q"), (F.col("pos") / 100 + 1).cast("long").cast("string")).alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("wanted"))


COS = "list_cosine_similarity(e.embedding::DOUBLE[], g.embedding::DOUBLE[])"
DENSE = f"de AS (SELECT 'q' || (g.vec_id // 100 + 1)::BIGINT AS query_id, e.vec_id AS pos, {COS} AS score, e.label AS label, g.label AS wanted FROM embeddings e, embeddings g WHERE g.vec_id % 100 = 0 AND {COS} > 0)"


@query(f"WITH {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS rank FROM de) SELECT query_id, pos, rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def dense_topk(spark, d):
    near = index.dense(vectors(spark, d), vector_questions(spark, d), 10)
    return index.top_k(near, 10, [F.desc(F.round("score", 9)), F.col("pos")]).select("query_id", "pos", F.col("rank").cast("long").alias("rank"), r6(F.col("score"), "score"))


@query(f"WITH {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS rank FROM de) SELECT query_id, count(*)::BIGINT AS n, count(*) FILTER (label = wanted)::BIGINT AS n_label FROM r WHERE rank <= 20 GROUP BY query_id")
def dense_knn_label_recall(spark, d):
    asked = vector_questions(spark, d)
    top = index.top_k(index.dense(vectors(spark, d), asked, 20), 20, [F.desc(F.round("score", 9)), F.col("pos")])
    return top.join(vectors(spark, d).select("pos", "label"), "pos").join(asked.select("query_id", "wanted"), "query_id").groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("wanted")).alias("n_label"))


# ---------------------------------------------------------------- grep, listings, scopes


@query("WITH l AS (SELECT doc_id AS pos, generate_subscripts(string_split(text, chr(10)), 1) AS no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE trim(text) <> ''), h AS (SELECT *, len(regexp_extract_all(line, '(?i)license')) AS n FROM l) SELECT pos, sum(n)::BIGINT AS count, trim(arg_min(line, no)) AS line FROM h WHERE n > 0 GROUP BY pos")
def grep_literal(spark, d):
    return filters.grep(chunks(spark, d), "license")


@query("WITH l AS (SELECT doc_id AS pos, generate_subscripts(string_split(text, chr(10)), 1) AS no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE trim(text) <> ''), h AS (SELECT *, len(regexp_extract_all(line, '[0-9]+\\.[0-9]+')) AS n FROM l) SELECT pos, sum(n)::BIGINT AS count, trim(arg_min(line, no)) AS line FROM h WHERE n > 0 GROUP BY pos")
def grep_regex(spark, d):
    return filters.grep(chunks(spark, d), r"[0-9]+\.[0-9]+", regex=True)


@query("SELECT doc_id AS pos, source FROM documents WHERE trim(text) <> '' ORDER BY doc_id LIMIT 10 OFFSET 20")
def list_page(spark, d):
    return filters.page_of(chunks(spark, d), 20, 10).select("pos", "source")


@query("SELECT doc_id::VARCHAR AS doc_id, min(doc_id) AS first_pos, count(*)::BIGINT AS n_chunks FROM documents WHERE trim(text) <> '' GROUP BY 1")
def documents_distinct(spark, d):
    return filters.documents_in_order(chunks(spark, d))


# ---------------------------------------------------------------- metadata


def records(spark, d):
    """A manifest: each document indexed at times made from its key, every third one twice."""
    docs = read(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"))
    at = F.timestamp_seconds(F.lit(1_758_000_000) + F.col("doc_id") * 3600)
    one = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "md5", at.alias("indexed_at"), F.lit("v1").alias("pipeline"), F.lit(1).alias("chunk_count"))
    again = docs.where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("doc_id"), F.md5(F.concat("md5", F.lit("2"))).alias("md5"), (at + F.expr("INTERVAL 1 DAY")).alias("indexed_at"), F.lit("v2").alias("pipeline"), F.lit(1).alias("chunk_count"))
    return one.unionByName(again)


NEWEST = "v AS (SELECT doc_id::VARCHAR AS doc_id, strftime(make_timestamp((1758000000 + doc_id * 3600 + CASE WHEN doc_id % 3 = 0 THEN 86400 ELSE 0 END) * 1000000), '%Y-%m-%d %H:%M:%S') AS indexed_at, CASE WHEN doc_id % 3 = 0 THEN md5(md5(text) || '2') ELSE md5(text) END AS md5, CASE WHEN doc_id % 3 = 0 THEN 'v2' ELSE 'v1' END AS pipeline FROM documents WHERE trim(text) <> '')"


@query(f"WITH {NEWEST} SELECT doc_id, md5, indexed_at, pipeline FROM v")
def manifest_newest(spark, d):
    return manifest.newest(records(spark, d)).select("doc_id", "md5", F.date_format("indexed_at", "yyyy-MM-dd HH:mm:ss").alias("indexed_at"), "pipeline")


def _meta(name: str, conditions: list[tuple], sql: str, logic: str = "and") -> None:
    def run(spark, d):
        return filters.metadata_filter(manifest.metadata_view(chunks(spark, d), records(spark, d)), conditions, logic).select("doc_id", "indexed_at")

    run.__name__ = name
    query(f"WITH {NEWEST} SELECT doc_id, indexed_at FROM v WHERE {sql}")(run)


_meta("meta_eq", [("doc_id", "=", "17")], "doc_id = '17'")
_meta("meta_ne", [("doc_id", "≠", "17")], "doc_id <> '17'")
_meta("meta_gt", [("indexed_at", ">", "2025-09-20 00:00:00")], "indexed_at > '2025-09-20 00:00:00'")
_meta("meta_lt", [("doc_id", "<", "30")], "doc_id::DOUBLE < 30")
_meta("meta_ge", [("indexed_at", "≥", "2025-09-20")], "indexed_at >= '2025-09-20'")
_meta("meta_le", [("doc_id", "≤", "30")], "doc_id::DOUBLE <= 30")
_meta("meta_in", [("doc_id", "in", ["1", "5", "x"])], "doc_id IN ('1', '5', 'x')")
_meta("meta_not_in", [("doc_id", "not in", ["1", "5", "x"])], "doc_id NOT IN ('1', '5', 'x')")
_meta("meta_contains", [("doc_id", "contains", "7")], "contains(doc_id, '7')")
_meta("meta_not_contains", [("doc_id", "not contains", "7")], "NOT contains(doc_id, '7')")
_meta("meta_start_with", [("indexed_at", "start with", "2025-09-2")], "starts_with(indexed_at, '2025-09-2')")
_meta("meta_end_with", [("doc_id", "end with", "9")], "ends_with(doc_id, '9')")
_meta("meta_empty", [("indexed_at", "empty")], "indexed_at = ''")
_meta("meta_not_empty", [("indexed_at", "not empty")], "indexed_at <> ''")
_meta("meta_and", [("doc_id", ">", "50"), ("indexed_at", "<", "2025-09-22")], "doc_id::DOUBLE > 50 AND indexed_at < '2025-09-22'")
_meta("meta_or", [("doc_id", "=", "3"), ("indexed_at", ">", "2025-09-23")], "doc_id = '3' OR indexed_at > '2025-09-23'", "or")


def long_metadata(spark, d):
    docs = read(spark, d, "documents")
    return docs.select(F.explode(F.array(F.struct(F.lit("lang").alias("field"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("field"), F.col("source").alias("value")))).alias("f"), "doc_id").select("f.field", "f.value", "doc_id")


LONG = "m AS (SELECT 'lang' AS field, lang AS value, doc_id FROM documents UNION ALL SELECT 'source', source, doc_id FROM documents)"


@query(f"WITH {LONG}, h AS (SELECT field, value, count(DISTINCT doc_id)::BIGINT AS n_docs FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n_docs DESC, value) AS rank FROM h) SELECT field, value, n_docs, rank FROM r WHERE rank <= 5")
def meta_histogram(spark, d):
    return filters.metadata_histogram(long_metadata(spark, d), 5).select("field", "value", "n_docs", F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src3')")
def meta_inverted_and(spark, d):
    return filters.inverted_filter(long_metadata(spark, d), [("lang", F.col("value") == "en"), ("source", F.col("value").isin("src1", "src3"))])


@query("SELECT DISTINCT doc_id FROM documents WHERE lang = 'es' OR source = 'src3'")
def meta_inverted_or(spark, d):
    return filters.inverted_filter(long_metadata(spark, d), [("lang", F.col("value") == "es"), ("source", F.col("value") == "src3")], "or")


DECIDE = f"""WITH {NEWEST}, i AS (SELECT doc_id::VARCHAR AS doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || 'x' WHEN doc_id % 3 = 0 THEN md5(text) || '2' ELSE text END) AS md5, CASE WHEN doc_id % 7 = 0 THEN 'v3' WHEN doc_id % 3 = 0 THEN 'v2' ELSE 'v1' END AS pipeline FROM documents WHERE trim(text) <> '')
SELECT i.doc_id, CASE WHEN i.md5 <> v.md5 THEN 'content changed' WHEN i.pipeline <> v.pipeline THEN 'pipeline changed' ELSE 'skip' END AS decision FROM i JOIN v USING (doc_id)"""


@query(DECIDE)
def manifest_skip(spark, d):
    docs = read(spark, d, "documents")
    content = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).when(F.col("doc_id") % 3 == 0, F.concat(F.md5("text"), F.lit("2"))).otherwise(F.col("text"))
    pipeline = F.when(F.col("doc_id") % 7 == 0, "v3").when(F.col("doc_id") % 3 == 0, "v2").otherwise("v1")
    incoming = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.md5(content).alias("md5"), pipeline.alias("pipeline"))
    return manifest.skip_decisions(incoming, records(spark, d), chunks(spark, d).select("doc_id"))


@query(f"WITH {CHUNKS}, k AS (SELECT * FROM c WHERE pos % 10 <> 0), tok AS (SELECT DISTINCT pos, unnest(t) AS term FROM k) SELECT term, count(*)::BIGINT AS df FROM tok GROUP BY term")
def remove_doc_stats(spark, d):
    own = stored.TextIndex(spark, fresh_dir(spark, "text-index"))
    own.add(chunks(spark, d))
    own.remove(own.chunks.where("pos % 10 = 0").select("doc_id"))
    return own.df


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_first_wins(spark, d):
    return index.first_wins(read(spark, d, "documents").select("doc_id", F.md5("text").alias("h")), ["h"], ["doc_id"]).select("doc_id")


@query("SELECT md5(text) AS md5, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_copies_md5(spark, d):
    return read(spark, d, "documents").groupBy(F.md5("text").alias("md5")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


# ---------------------------------------------------------------- pages, blocks, chunks


TEXT = "regexp_replace(regexp_replace(tag, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')"
for _name, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    TEXT = f"replace({TEXT if TEXT.startswith('replace') else f'trim({TEXT})'}, '{_name}', '{_sign}')"
PAGES = f"""tg AS (SELECT page_id::VARCHAR AS doc_id, regexp_extract_all(html, '(?is)<(?:h[1-6]|p|li)\\b[^>]*>.*?</(?:h[1-6]|p|li)>') AS t FROM pages),
tb AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS tag FROM tg),
blk AS (SELECT * FROM (SELECT doc_id, pos::INTEGER AS pos, CASE WHEN regexp_matches(tag, '(?i)^<h[1-6]') THEN 'Title' ELSE 'Text' END AS block_type, {TEXT} AS text, try_cast(regexp_extract(tag, '(?i)^<h([1-6])', 1) AS INTEGER) AS level FROM tb) WHERE text <> '')"""


def page_blocks(spark, d):
    return files.html_blocks(read(spark, d, "pages"))


@query(f"WITH {PAGES} SELECT doc_id, pos, block_type, text, coalesce(level, 0) AS level FROM blk")
def html_blocks(spark, d):
    return page_blocks(spark, d).select("doc_id", "pos", "block_type", "text", F.coalesce("level", F.lit(0)).alias("level"))


@query(f"WITH {PAGES} SELECT doc_id, pos, CASE WHEN block_type = 'Title' THEN '' ELSE coalesce(last_value(CASE WHEN block_type = 'Title' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') END AS section FROM blk")
def section_assign(spark, d):
    return chunking.assign_sections(page_blocks(spark, d)).select("doc_id", "pos", "section")


@query(f"WITH {PAGES}, n AS (SELECT *, block_type <> 'Title' AS plain, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) < 20 AS short FROM blk), c AS (SELECT *, count(*) FILTER (plain AND short) OVER (PARTITION BY doc_id, norm) AS times FROM n) SELECT doc_id, pos, text FROM c WHERE NOT regexp_full_match(text, '[0-9\\s•·—–_=*\\-]+') AND NOT (plain AND times >= 3)")
def noise_repeat(spark, d):
    return chunking.without_noise(page_blocks(spark, d)).select("doc_id", "pos", "text")


@query()
def chunk_merge(spark, d):
    return chunking.to_chunks(page_blocks(spark, d))


@query(f"WITH {PAGES}, t AS (SELECT * FROM blk WHERE block_type = 'Title'), k AS (SELECT doc_id, count(DISTINCT level) AS d FROM t GROUP BY doc_id) SELECT doc_id, pos, text, least(CASE WHEN d >= 2 THEN dense_rank() OVER (PARTITION BY doc_id ORDER BY level) ELSE 1 END, 6)::INTEGER AS tree_level, CASE WHEN d >= 2 THEN 'declared' ELSE 'flat' END AS source FROM t JOIN k USING (doc_id)")
def tree_levels(spark, d):
    return chunking.heading_levels(page_blocks(spark, d))


def page_chunks(spark, d):
    made = chunking.to_chunks(page_blocks(spark, d))
    return written(made.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id")).cast("long").alias("pos"), "chunk_id", "block_type", "text", "level", F.lit(0.0).alias("font_size")), "page-chunks")


@query()
def section_tree_build(spark, d):
    c = page_chunks(spark, d)
    return section_tree.nodes(section_tree.anchors(c), c).select("doc_id", "nid", "parent", "level", "title", F.size("path").alias("steps"))


@query()
def section_tree_search(spark, d):
    c = page_chunks(spark, d).withColumn("key", F.concat_ws("|", "doc_id", "chunk_id"))
    at = F.split("key", r"\|")
    scores = index.bm25(c, questions(spark), "key").select("query_id", at[0].alias("doc_id"), at[1].alias("chunk_id"), "score", F.col("key").alias("pos"))
    return section_tree.search(c, questions(spark), written(scores, "passages")).select("query_id", "rank", "doc_id", "chunk_id", "source", F.size("path").alias("steps"))


def documents_in_tree(spark, d):
    own = text_index(spark, d)
    docs = own.chunks.select("doc_id", F.concat_ws("/", "source", F.concat("doc_id", F.lit(".txt"))).alias("path"))
    return directory_tree.build(docs, own.postings.select("doc_id", "term", "tf"), leaf=200)


@query()
def dirtree_build(spark, d):
    nodes, leaves = documents_in_tree(spark, d)
    return nodes.join(directory_tree.subtree(nodes, leaves).groupBy("nid").agg(F.countDistinct("doc_id").alias("n_docs")), "nid").select("nid", "parent", "level", "name", "origin", "n_docs")


@query()
def snippet_windows(spark, d):
    shown = answers.snippets(F.col("text"), F.array(F.lit("license"), F.lit("the")))
    return read(spark, d, "documents").select("doc_id", shown.alias("s")).select("doc_id", "s.snippet", "s.truncated")


@query("SELECT doc_id, CASE WHEN regexp_matches(t, '[㐀-䶿一-鿿豈-﫿]') THEN length(t) < 40 ELSE len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) < 20 END AS short FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)")
def is_short(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.is_short(F.col("text")).alias("short"))


@query("WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS no, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, no::BIGINT AS no, line FROM l WHERE NOT regexp_full_match(line, '[0-9\\s•·—–_=*\\-]+')")
def page_decor(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.where(~F.col("line").rlike(chunking.DECORATION)).select("doc_id", (F.col("no") + 1).cast("long").alias("no"), "line")


@query("WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？；.!?\\n]*[。！？；.!?\\n]|[^。！？；.!?\\n]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents) SELECT doc_id, (generate_subscripts(s, 1) - 1)::INTEGER AS no, unnest(s) AS sentence FROM p")
def sentence_split(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("no", "sentence"))


@query("WITH x AS (SELECT n_regionkey AS table_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, n_nationkey, n_name FROM nation) SELECT table_id::BIGINT AS table_id, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY r) AS markdown FROM x GROUP BY table_id")
def table_markdown(spark, d):
    n = read(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("table_id"), F.col("n_nationkey").alias("k"), "n_name")
    body = n.withColumn("row", F.row_number().over(Window.partitionBy("table_id").orderBy("k"))).select("table_id", "row", F.posexplode(F.array(F.col("k").cast("string"), F.col("n_name"))).alias("col", "text"))
    head = n.select("table_id").distinct().select("table_id", F.lit(0).alias("row"), F.posexplode(F.array(F.lit("key"), F.lit("name"))).alias("col", "text"))
    return chunking.table_markdown(body.unionByName(head))


# ---------------------------------------------------------------- directory tree


@query("SELECT source AS nid, 1::BIGINT AS level, '' AS parent, count(*)::BIGINT AS n_docs FROM documents GROUP BY source UNION ALL SELECT '', 0, NULL, count(*) FROM documents")
def dirtree_subtree_counts(spark, d):
    paths = read(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return routing.path_nodes(paths).select("nid", F.col("level").cast("long").alias("level"), "parent", "n_docs")


@query(f"WITH {TOKENS}, g AS (SELECT source AS nid, term, sum(tf) AS tf FROM tf JOIN c USING (pos) GROUP BY ALL), w AS (SELECT nid, term, tf, df, row_number() OVER (PARTITION BY nid ORDER BY round(tf * ln(1 + (n - df + 0.5) / (df + 0.5)), 9) DESC, term) AS rank FROM g JOIN df USING (term), st) SELECT nid, term, tf::BIGINT AS tf, df::BIGINT AS df, rank FROM w WHERE rank <= 12")
def dirtree_keywords(spark, d):
    own = text_index(spark, d)
    groups = own.postings.join(own.chunks.select("pos", F.col("source").alias("nid")), "pos").groupBy("nid", "term").agg(F.sum("tf").alias("tf")).join(own.df, "term").crossJoin(F.broadcast(own.stats))
    return routing.keywords(groups, "nid", F.col("n")).select("nid", "term", "tf", "df", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {PARTS}, s AS (SELECT source AS nid, query_id, pos, score FROM bm JOIN c USING (pos)) SELECT query_id, nid, round(max(score), 6) AS score, arg_min(pos, (-round(score, 9), pos))::VARCHAR AS best_doc FROM s GROUP BY query_id, nid")
def dirtree_node_scores(spark, d):
    own = text_index(spark, d)
    scores = stored.bm25(own, questions(spark)).select("query_id", F.col("pos").alias("doc_id"), "score")
    out = routing.node_scores(own.chunks.select(F.col("pos").alias("doc_id"), F.col("source").alias("nid")), scores)
    return out.select("query_id", "nid", r6(F.col("score"), "score"), F.col("best_doc").cast("string").alias("best_doc"))


# ---------------------------------------------------------------- evidence


@query("WITH a AS (SELECT conv_id, turn, text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t, conv_id * 100000 + turn AS arrival FROM conversations) SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, t ORDER BY arrival) AS n FROM a) WHERE n = 1")
def pool_dedup(spark, d):
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_id"), "text", (F.col("conv_id") * 100_000 + F.col("turn")).alias("arrival"))
    return evidence.pool(rows).select(F.col("doc_id").alias("conv_id"), F.col("chunk_id").alias("turn"))


def asked_passages(spark, d):
    """Benchmark items as questions, the top three documents of the keyword leg as their passages."""
    items = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    own = text_index(spark, d)
    top = index.top_k(stored.bm25(own, items), 3, [F.desc(F.round("score", 9)), F.col("pos")])
    return items, own.chunks.select("pos", "doc_id", "text").join(broadcast_if_small(written(top, "top")), "pos")


ITEMS = f"it AS (SELECT item_id::VARCHAR AS query_id, {T} AS qt FROM benchmark), q2 AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(qt) AS term FROM it) GROUP BY ALL), b2 AS (SELECT query_id, tf.pos, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(c.t) / avgdl))) AS score FROM tf JOIN df USING (term) JOIN q2 USING (term) JOIN c USING (pos), st GROUP BY ALL), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS rank FROM b2) WHERE rank <= 3)"


@query(f"WITH {TOKENS}, {ITEMS}, w AS (SELECT DISTINCT query_id, unnest(qt) AS term FROM it), p AS (SELECT DISTINCT query_id, term FROM top JOIN tf USING (pos)), x AS (SELECT query_id, count(*) AS n_terms, count(p.term) AS n_found FROM w LEFT JOIN p USING (query_id, term) GROUP BY query_id) SELECT query_id, n_terms::BIGINT AS n_terms, n_found::BIGINT AS n_found, CASE WHEN n_found / n_terms >= 0.6 THEN 'sufficient' ELSE 'insufficient' END AS verdict FROM x")
def coverage_terms(spark, d):
    items, passages = asked_passages(spark, d)
    return evidence.coverage(items, passages)


@query(f"WITH {TOKENS}, {ITEMS}, w AS (SELECT query_id, term, min(place) AS place FROM (SELECT query_id, generate_subscripts(qt, 1) AS place, unnest(qt) AS term FROM it) GROUP BY ALL), p AS (SELECT DISTINCT query_id, term FROM top JOIN tf USING (pos)), x AS (SELECT w.query_id, w.term, row_number() OVER (PARTITION BY w.query_id ORDER BY w.place) AS n FROM w LEFT JOIN p USING (query_id, term) WHERE p.term IS NULL) SELECT query_id, term, n FROM x WHERE n <= 8")
def missing_terms(spark, d):
    items, passages = asked_passages(spark, d)
    return evidence.missing_terms(items, passages).withColumn("n", F.col("n").cast("long"))


@query("WITH x AS (SELECT doc_id, text, left(text, 240) AS head, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents), y AS (SELECT *, regexp_extract(head, '(?s)^.*[.!?;。！？；]', 0) AS s, regexp_extract(head, '(?s)^(.*)[ \\t]', 1) AS w FROM x) SELECT doc_id, md5(CASE WHEN rank <= 4 OR length(text) < 480 THEN text ELSE rtrim(CASE WHEN length(s) >= 145 THEN s WHEN length(w) >= 144 THEN w ELSE head END, ' ' || chr(9)) || ' […]' END) AS kept FROM y")
def compress_plan(spark, d):
    """Ranks are taken without the texts, and of each source only the first few are told apart: the rest is compressed whatever its rank."""
    docs = read(spark, d, "documents")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    first = docs.select("doc_id", "source").withColumn("rank", rank).where("rank <= 4").select("doc_id", "rank")
    rows = docs.select("doc_id", "text").join(first, "doc_id", "left")
    return rows.select("doc_id", F.md5(evidence.compression_plan(F.coalesce("rank", F.lit(5)), F.col("text"))).alias("kept"))


INTER = "l AS (SELECT lang AS query_id, source AS list_no, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rank, md5(text) AS doc_id FROM documents)"


def ranked_lists(spark, d):
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("n_chars"), "doc_id"))
    return read(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("source").alias("list_no"), rank.alias("rank"), F.md5("text").alias("doc_id"))


@query(f"WITH {INTER}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, list_no) AS place FROM l) SELECT query_id, list_no, doc_id, place FROM p WHERE place <= 12")
def interleave_branches(spark, d):
    return evidence.interleave(ranked_lists(spark, d), 12, distinct=False).select("query_id", "list_no", "doc_id", F.col("place").cast("long").alias("place"))


@query(f"WITH {INTER}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank, list_no) AS n FROM l) WHERE n = 1), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, list_no) AS place FROM f) SELECT query_id, list_no, doc_id, place FROM p WHERE place <= 12")
def interleave_dedup(spark, d):
    return evidence.interleave(ranked_lists(spark, d), 12).select("query_id", "list_no", "doc_id", F.col("place").cast("long").alias("place"))


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS s FROM embeddings), x AS (SELECT vec_id, list_transform(s, lambda v: exp(v - list_max(s))) AS e FROM e), p AS (SELECT vec_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM x) SELECT vec_id, round(p[1], 6) AS p0, round(1 + list_sum(list_transform(p, lambda v: v * ln(v))) / ln(len(p)), 6) AS confidence FROM p")
def softmax_confidence(spark, d):
    s = F.transform("embedding", lambda v: v.cast("double"))
    rows = read(spark, d, "embeddings").select("vec_id", evidence.decision(s).alias("x"))
    return rows.select("vec_id", r6(F.col("x.probs")[0], "p0"), r6(F.col("x.confidence"), "confidence"))


# ---------------------------------------------------------------- evaluation and routing


@query("WITH g AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))) AS gram FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark) WHERE len(w) >= 5), d AS (SELECT DISTINCT unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))) AS gram FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents) WHERE len(w) >= 5), x AS (SELECT item_id, count(*) AS n_grams, count(d.gram) AS n_found FROM g LEFT JOIN d USING (gram) GROUP BY item_id) SELECT item_id, coalesce(n_grams, 0)::BIGINT AS n_grams, coalesce(n_found, 0)::BIGINT AS n_found FROM benchmark LEFT JOIN x USING (item_id)")
def gram_coverage(spark, d):
    return evaluate.gram_coverage(read(spark, d, "benchmark"), read(spark, d, "documents"))


GOLD = "gold AS (SELECT item_id::VARCHAR AS query_id, doc_id AS pos FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)))"


@query(f"WITH {TOKENS}, {ITEMS.replace('WHERE rank <= 3', 'WHERE rank <= 20')}, {GOLD}, cuts AS (SELECT unnest([5, 10, 20]) AS cut) SELECT query_id, cut, round(count(*) FILTER (rank <= cut) / count(*), 6) AS recall FROM gold LEFT JOIN top USING (query_id, pos), cuts GROUP BY ALL")
def doc_recall_at_k(spark, d):
    """Gold documents of a benchmark item are those in which it stands, whatever the ranking."""
    items = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    own = text_index(spark, d)
    ranked = index.top_k(stored.bm25(own, items), 20, [F.desc(F.round("score", 9)), F.col("pos")]).select("query_id", F.col("pos").alias("doc_id"), "rank")
    gold = patterns.occurrences(items, read(spark, d, "documents"), "query_id", "query").select("query_id", "doc_id")
    return evaluate.recall_at(ranked, gold, [5, 10, 20]).select("query_id", "cut", r6(F.col("recall"), "recall"))


@query("SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY doc_id) <= ceil(count(*) OVER (PARTITION BY quality) * 0.3) THEN 'dev' ELSE 'test' END AS split FROM labels")
def stratified_split(spark, d):
    return evaluate.stratified_split(read(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id", 0.3)


@query("SELECT turn, round(count(*) FILTER (regexp_matches(text, '" + evaluate.REFUSAL + "')) / count(*), 6) AS rate, count(*)::BIGINT AS n FROM conversations WHERE role = 'assistant' GROUP BY turn")
def refusal_rate(spark, d):
    answers = read(spark, d, "conversations").where("role = 'assistant'")
    return evaluate.refusal_rate(answers, by=("turn",)).select("turn", r6(F.col("rate"), "rate"), "n")


@query("SELECT conv_id, turn, CASE WHEN length(text) - length(regexp_replace(text, '[?？]', '', 'g')) >= 2 OR regexp_matches(lower(text), '" + "|".join(routing.CUES) + "') OR length(text) > 40 THEN 'complex' ELSE 'simple' END AS route FROM conversations WHERE role = 'user'")
def route_heuristic(spark, d):
    return read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", routing.route(F.col("text")).alias("route"))


@query("SELECT conv_id, turn, length(trim(text)) > 0 AND length(text) <= 200 AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) <= 24 AND NOT (" + " OR ".join(f"contains(lower(text), '{m}')" for m in routing.ANSWER_MARKERS) + ") AS ok FROM conversations")
def query_guard(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", routing.query_guard(F.col("text")).alias("ok"))


# ---------------------------------------------------------------- streams, as batches


@query()
def coalesce_fragments(spark, d):
    rows = read(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_type").alias("text"))
    return stream.coalesce_fragments(rows, 86_400_000)


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id")
def conversation_turns(spark, d):
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"), F.count("*").alias("n"))
    return rows.select("conv_id", F.array_join("t.role", ",").alias("roles"), "n")


# ---------------------------------------------------------------- small reports


@query("SELECT length, n, sum(n) OVER ()::BIGINT AS n_answers, (sum(n) OVER () >= 4 AND length >= 3000 AND 2 * n >= sum(n) OVER ()) AS extractive FROM (SELECT length(coalesce(text, ''))::BIGINT AS length, count(*)::BIGINT AS n FROM conversations WHERE role = 'assistant' GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n DESC, length) = 1")
def modal_answer_length(spark, d):
    return evaluate.modal_length(read(spark, d, "conversations").where("role = 'assistant'")).withColumn("length", F.col("length").cast("long"))


@query("SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR || ':17'), doc_id)::INT AS place FROM labels QUALIFY place <= 20")
def balanced_sample(spark, d):
    return evaluate.balanced_sample(read(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id", 20, 17)


@query("SELECT event_type AS tool, count(*)::BIGINT AS n_calls, count(*) FILTER (value < 1)::BIGINT AS n_errors, coalesce(sum(round(value * 1000)::BIGINT), 0)::BIGINT AS total_ms FROM events GROUP BY event_type")
def tool_calls(spark, d):
    calls = read(spark, d, "events").select(F.col("event_type").alias("tool"), (F.col("value") < 1).alias("failed"), F.round(F.col("value") * 1000).cast("long").alias("ms"))
    return evaluate.tool_calls(calls)


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS chunk_index FROM conversations")
def chunk_positions(spark, d):
    return filters.chunk_index(read(spark, d, "conversations").select("conv_id", "turn"), "conv_id", ("turn",))


@query("SELECT conv_id, turn, list_reduce(list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT), lambda a, c: (xor(a, c) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM conversations WHERE text <> ''")
def rune_hashes(spark, d):
    return read(spark, d, "conversations").where("text <> ''").select("conv_id", "turn", tx.rune_hash(F.col("text")).alias("h"))


@query("SELECT conv_id, turn, array_to_string(list_filter(string_split(text, ' '), lambda t: length(t) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in tx.UNGREPPABLE) + "], lower(t))), ' ') AS terms FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations)")
def greppable_terms(spark, d):
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(tx.greppable(words), " ").alias("terms"))
