"""Queries on what a model is given: markup, prompts, catalogues; typed arguments; trees stored, explained and searched by parts; with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import arguments, directory_tree, evaluate, index, markup, patterns, stored
from quarry.operators.stored_trees import TreeStore
from quarry.plans.queries import ORACLE_SQL, PAGES, TOKENS, asked_passages, page_blocks, query, questions, read, text_index
from quarry.plans.retrieval import FOLDERS, SCORED_FOLDERS, SENTENCES, block_sql, document_scores, folder_tree, item_parts, searched_sql
from quarry.storage import fresh_dir, written


def esc(c: str) -> str:
    for sign, name in markup.ESCAPES:
        c = f"replace({c}, '{sign.replace(chr(39), chr(39) * 2)}', '{name}')"
    return c


# ---------------------------------------------------------------- markup


@query(f"""WITH {PAGES}, s AS (SELECT doc_id, pos, '<chunk chunk_id="' || doc_id || '-' || pos || '" doc_id="' || doc_id || '" page_num="1" chunk_index="' || pos || '" dataset_id="pages" doc_name="' || {esc('url')} || '">' || chr(10) || '<content>' || {esc('text')} || '</content>' || chr(10) || '</chunk>' || chr(10) AS shown FROM blk JOIN (SELECT page_id::VARCHAR AS doc_id, url FROM pages) USING (doc_id))
SELECT doc_id, count(*)::BIGINT AS n, '<chunks doc_id="' || doc_id || '" fetched="' || count(*) || '">' || chr(10) || string_agg(shown, '' ORDER BY pos) || '</chunks>' AS markup FROM s GROUP BY doc_id""")
def page_markup(spark, d):
    """Every page's blocks as a reader of the whole page is given them."""
    names = read(spark, d, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.col("url").alias("doc_name"))
    rows = page_blocks(spark, d).join(names, "doc_id").withColumns({"chunk_id": F.concat_ws("-", "doc_id", "pos"), "chunk_index": F.col("pos"), "dataset_id": F.lit("pages")})
    return markup.passage_markup(rows)


@query(f"""WITH f AS (SELECT item_id, b.text AS query, doc_id, d.source AS source, d.text AS text, strpos(lower(d.text), lower(b.text)) AS place FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))),
t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank, substring(text, greatest(place - 40, 1), least(place - 1, 40) + length(query) + 40) AS snippet FROM f QUALIFY rank <= 20),
s AS (SELECT item_id, rank, length(snippet) < length(text) AS cut, '<chunk rank="' || rank || '" chunk_id="' || doc_id || '" doc_id="' || doc_id || '" page_num="1" chunk_index="0" dataset_id="' || {esc('source')} || '" doc_name="' || doc_id || '.txt" score="0.000" chunk_runes="' || length(text) || '"' || CASE WHEN length(snippet) < length(text) THEN ' truncated="true"' ELSE '' END || '>' || chr(10) || '<match_snippet>' || {esc('snippet')} || '</match_snippet>' || chr(10) || '</chunk>' || chr(10) AS shown FROM t),
g AS (SELECT item_id, count(*) AS n, count(*) FILTER (cut) AS k, string_agg(shown, '' ORDER BY rank) AS shown FROM s GROUP BY item_id)
SELECT item_id::VARCHAR AS query_id, '<search_results count="' || coalesce(n, 0) || '" query="' || {esc('text')} || '">' || chr(10) || coalesce(shown, '') || CASE WHEN k > 0 THEN '<snippet_note>' || {esc("replace(replace('" + markup.CUT + "', '{truncated}', k::VARCHAR), '{unmatched}', '0')")} || '</snippet_note>' || chr(10) ELSE '' END || CASE WHEN n IS NULL THEN '<hint>{markup.EMPTY}</hint>' || chr(10) ELSE '' END || '</search_results>' AS markup FROM benchmark LEFT JOIN g USING (item_id)""")
def match_markup(spark, d):
    """The first twenty documents that hold an item, each with what stands around it; items that no document holds come with a hint."""
    asked = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    docs = read(spark, d, "documents").select("doc_id", "text", "source")
    found = patterns.occurrences(asked, docs, "query_id", "query").select("query_id", "doc_id", "first")
    first = written(found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))).where("rank <= 20"), "first-matches")
    rows = first.join(docs, "doc_id").join(asked, "query_id")
    begin = F.greatest(F.col("first") - 40, F.lit(0))
    rows = rows.withColumn("snippet", F.substring("text", (begin + 1).cast("int"), (F.col("first") - begin + F.length("query") + 40).cast("int")))
    hits = rows.select("query_id", "rank", F.col("doc_id").alias("chunk_id"), "doc_id", F.lit(1).alias("page_num"), F.lit(0).alias("chunk_index"), F.col("source").alias("dataset_id"), F.concat("doc_id", F.lit(".txt")).alias("doc_name"), F.lit(0.0).alias("score"), F.length("text").alias("n_chars"), "snippet", (F.length("snippet") < F.length("text")).alias("truncated"), F.lit(False).alias("unmatched"))
    return markup.search_markup(asked, hits)


PARTED = f"'{markup.ORIGINAL}' || text || chr(10) || chr(10) || CASE WHEN len({SENTENCES}) > 0 THEN '{markup.PARTS.strip()}' || chr(10) || array_to_string(list_transform({SENTENCES}[1:4], lambda x, i: i || '. ' || x || chr(10)), '') || chr(10) ELSE '' END || 'Evidence:' || chr(10)"


@query(block_sql(PARTED))
def synthesis_prompts(spark, d):
    """The prompt of every item: its parts, and the passages that fit."""
    asked, passages = asked_passages(spark, d)
    parts = item_parts(spark, d).select(F.col("question_id").cast("string").alias("query_id"), "part", F.col("query").alias("text"))
    return markup.synthesis_prompt(asked, passages, 3000, parts).select("query_id", "n_shown", "n_omitted", F.md5("block").alias("block"))


FIELDS = ["lang", "source", "n_chars"]
COUNTED = "v AS (SELECT 1 AS no, 'lang' AS field, lang AS value FROM documents UNION ALL SELECT 2, 'source', source FROM documents UNION ALL SELECT 3, 'n_chars', n_chars::VARCHAR FROM documents), s AS (SELECT * FROM (SELECT no, field, value, count(*) AS n FROM v WHERE value <> '' GROUP BY no, field, value) QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 12), l AS (SELECT no, field, string_agg('\"' || value || '\" (' || n || ' doc(s))', ', ' ORDER BY n DESC, value) AS shown FROM s GROUP BY ALL)"


@query(f"WITH {COUNTED} SELECT 'catalogue' AS kind, 'AVAILABLE METADATA (the only fields metadata_search can filter on):' || chr(10) || string_agg('- ' || field || CASE WHEN field = 'n_chars' THEN ' (characters)' ELSE '' END || '; values: ' || shown || chr(10), '' ORDER BY no) || (SELECT count(*) FROM documents) || ' document(s) are indexed. Values NOT listed here do not exist — never invent one.' AS said FROM l UNION ALL SELECT 'availability', string_agg(field || ' = ' || shown, '; ' ORDER BY no) || '; ' || (SELECT count(*) FROM documents) || ' document(s) indexed' FROM l")
def field_catalogue(spark, d):
    """What filters on documents can ask for, for planning and after a filter that found nothing."""
    docs = read(spark, d, "documents")
    samples, n = written(markup.field_samples(docs, FIELDS), "field-samples"), docs.agg(F.count("*").alias("n"))
    both = markup.catalogue(samples, n, FIELDS, {"n_chars": "characters"}).select(F.lit("catalogue").alias("kind"), "said")
    return both.unionByName(markup.availability(samples, n, FIELDS).select(F.lit("availability").alias("kind"), "said"))


# ---------------------------------------------------------------- arguments


@query("SELECT event_type, count(*) FILTER (json_type(props, '$.k') IN ('UBIGINT', 'BIGINT'))::BIGINT AS n_numbers, coalesce(sum((props->>'$.k')::BIGINT) FILTER (json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')), 0)::BIGINT AS total, count(*) FILTER (json_type(props, '$.k') = 'VARCHAR')::BIGINT AS n_texts, count(*) FILTER (json_type(props, '$.k') = 'BOOLEAN')::BIGINT AS n_flags, count(*) FILTER (json_extract(props, '$.absent') IS NOT NULL)::BIGINT AS n_absent FROM events GROUP BY event_type")
def typed_arguments(spark, d):
    """The argument ``k`` of every event read as each type."""
    given = F.try_parse_json("props")
    rows = read(spark, d, "events").select("event_type", arguments.int_argument(given, "k").alias("number"), arguments.text_argument(given, "k").alias("text"), arguments.flag_argument(given, "k").alias("flag"), arguments.int_argument(given, "absent").alias("absent"))
    return rows.groupBy("event_type").agg(F.count("number").alias("n_numbers"), F.coalesce(F.sum("number"), F.lit(0)).alias("total"), F.count("text").alias("n_texts"), F.count("flag").alias("n_flags"), F.count("absent").alias("n_absent"))


# ---------------------------------------------------------------- trees


@query(ORACLE_SQL["dirtree_folders"])
def dirtree_reopened(spark, d):
    """The tree of folders, saved and opened again; asked for by another policy it is not there."""
    nodes, leaves = folder_tree(spark, d)
    store = TreeStore(spark, fresh_dir(spark, "trees"))
    for _ in range(2):  # the second takes the first one's place
        store.save("folders", "folders-1", {"nodes": (nodes, ["nid"]), "leaves": (leaves, ["nid", "doc_id"])})
    if store.open("folders", "folders-2") is not None:
        raise RuntimeError("a tree of another policy was opened")
    own = store.open("folders", "folders-1")
    sizes = directory_tree.subtree(own["nodes"], own["leaves"]).groupBy("nid").agg(F.countDistinct("doc_id").alias("n_docs"))
    return own["nodes"].join(sizes, "nid").select("nid", "parent", "level", "name", "n_docs")


@query(f"""WITH h AS ({ORACLE_SQL['dirtree_search']}), s AS (SELECT CASE WHEN query_id IN ('q1', 'q2') THEN 'a' ELSE 'b' END AS question_id, query_id, rank, doc_id FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY rank, query_id) AS first FROM s)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY rank, query_id)::INTEGER AS rank, doc_id, query_id FROM o WHERE first = 1 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rank, query_id) <= 8""")
def dirtree_fanout(spark, d):
    """Two questions of two parts each, every part searched for with the whole limit."""
    nodes, leaves = folder_tree(spark, d)
    hits = written(directory_tree.search(nodes, leaves, document_scores(spark, d), limit=8, branches=4), "hits")
    slots = questions(spark).select(F.when(F.col("query_id").isin("q1", "q2"), "a").otherwise("b").alias("question_id"), F.col("query_id").alias("slot"), "query_id")
    return directory_tree.fan_out(hits, slots, 8)


@query(f"""WITH {SCORED_FOLDERS}, op AS (SELECT b1.query_id, branch, 1 AS turn, leaf FROM b1 JOIN b2 USING (query_id, nid) WHERE branch <= 2 AND way = 1), h AS (SELECT * FROM ({'WITH ' + searched_sql('op', 'nth, branch')})),
nq AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id), mt AS (SELECT query_id, pos::VARCHAR AS doc_id, count(*) AS k, string_agg(term, '、' ORDER BY round(part, 9) DESC, term) AS terms, sum(part) AS score FROM parts GROUP BY ALL),
sk AS (SELECT query_id, '未开启的分支：' || string_agg(lang || ' (BM25 ' || printf('%.1f', s) || ')', '；' ORDER BY string_split(nid, '.')[-1]::INTEGER) AS skipped FROM b1 JOIN l1 USING (nid) WHERE branch > 2 GROUP BY query_id),
hw AS (SELECT h.*, CASE WHEN h.source = 'keyword' THEN '关键词兜底网' ELSE '第 ' || op.branch || ' 个分支' END AS how, CASE WHEN h.source = 'keyword' THEN '' ELSE '；目录 ' || p.lang || ' › ' || p.source END AS place FROM h JOIN (SELECT doc_id::VARCHAR AS doc_id, lang, source FROM p) p USING (doc_id) JOIN m USING (doc_id) LEFT JOIN op ON op.query_id = h.query_id AND op.leaf = m.leaf)
SELECT query_id, rank, doc_id, '由' || how || '召回；' || CASE WHEN k > 0 THEN '命中 ' || k || '/' || n || ' 个查询词（' || terms || '），BM25 ' || printf('%.1f', score) || place ELSE '未命中任何查询词（BM25 0）' END AS why, skipped FROM hw JOIN nq USING (query_id) LEFT JOIN mt USING (query_id, doc_id) LEFT JOIN sk USING (query_id)""")
def dirtree_explained(spark, d):
    """Why each document was found, where it stands, and which branches were left alone."""
    nodes, leaves = folder_tree(spark, d)
    own = text_index(spark, d)
    parts = written(stored.contributions(own, questions(spark)).join(own.chunks.select("pos", "doc_id"), "pos").select("query_id", "doc_id", "term", "part"), "contributions")
    scores = parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score")).where("score > 0")
    hits = written(directory_tree.search(nodes, leaves, scores, limit=8, branches=2, tell_branch=True), "hits")
    skipped = directory_tree.skipped_branches(nodes, directory_tree.best_of_nodes(nodes, leaves, scores), questions(spark), 2)
    told = directory_tree.explained(hits, parts, questions(spark), directory_tree.document_paths(nodes, leaves).join(hits.select("doc_id").distinct(), "doc_id", "left_semi"))
    return told.join(skipped, "query_id", "left").select("query_id", "rank", "doc_id", "why", "skipped")


IDF = "ln(1 + ({n} - {df} + 0.5) / ({df} + 0.5))"


@query(f"""WITH {TOKENS}, {FOLDERS}, own AS (SELECT nid, 'd0' AS parent, doc_id FROM p JOIN l1 USING (lang) UNION ALL SELECT leaf, nid, doc_id FROM p JOIN l2 USING (lang, source)),
g AS (SELECT nid, count(*) AS n FROM own GROUP BY nid), tn AS (SELECT nid, parent, doc_id, term, tf.tf AS tf FROM own JOIN tf ON tf.pos = own.doc_id), gd AS (SELECT nid, term, count(*) AS gdf FROM tn GROUP BY ALL),
sc AS (SELECT nid, doc_id, sum(tf * {IDF.format(n='st.n', df='df')} * {IDF.format(n='g.n', df='gdf')}) AS s FROM tn JOIN df USING (term) JOIN gd USING (nid, term) JOIN g USING (nid), st GROUP BY ALL),
rp AS (SELECT nid, doc_id, row_number() OVER (PARTITION BY nid ORDER BY round(s, 9) DESC, doc_id::VARCHAR) AS place FROM sc QUALIFY place <= 2),
tt AS (SELECT nid, string_agg(lang || ' report ' || doc_id % 2, ' / ' ORDER BY place) AS titles FROM rp JOIN p USING (doc_id) WHERE lang <> 'de' GROUP BY nid),
ts AS (SELECT parent, nid, term, sum(tf) AS tf FROM tn GROUP BY ALL), sp AS (SELECT parent, term, count(*) AS sdf FROM ts GROUP BY ALL), sb AS (SELECT parent, count(DISTINCT nid) AS k FROM own GROUP BY parent),
tw AS (SELECT nid, term, row_number() OVER (PARTITION BY nid ORDER BY round(tf * {IDF.format(n='k', df='sdf')}, 9) DESC, term) AS place FROM ts JOIN sp USING (parent, term) JOIN sb USING (parent) QUALIFY place <= 3),
wd AS (SELECT nid, string_agg(term, '·' ORDER BY place) AS terms FROM tw GROUP BY nid),
al AS (SELECT DISTINCT nid, parent, string_split(nid, '.')[-1]::INTEGER AS no FROM own), nm AS (SELECT al.*, titles, terms, coalesce(titles, nullif(terms, ''), '组' || no) AS name FROM al LEFT JOIN tt USING (nid) LEFT JOIN wd USING (nid))
SELECT nid, titles, terms, CASE WHEN row_number() OVER (PARTITION BY parent, name ORDER BY no) > 1 THEN name || '(' || no || ')' ELSE name END AS name FROM nm""")
def dirtree_names(spark, d):
    """Every folder named by what sets it apart; documents in one of the languages have no title."""
    nodes, leaves = folder_tree(spark, d)
    own = text_index(spark, d)
    worth = own.df.select("term", index.idf(F.lit(own.chunks.count()), F.col("df")).alias("idf"))
    titles = own.chunks.where("lang <> 'de'").select("doc_id", F.concat("lang", F.lit(" report "), (F.col("pos") % 2).cast("string")).alias("name"))
    return directory_tree.sibling_names(nodes, leaves, own.postings, titles, worth=worth)


# ---------------------------------------------------------------- answers


@query("SELECT doc_id AS id, doc_id || ': answered at length from an empty pool' AS violation FROM documents WHERE length(text) > 200 AND doc_id NOT IN (SELECT doc_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)))")
def pool_violations(spark, d):
    """Documents as answers, and as their pool the items that stand in them."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("answer"))
    held = patterns.occurrences(read(spark, d, "benchmark"), read(spark, d, "documents"), "item_id", "text")
    pools = held.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n_contexts"))
    return evaluate.violations(docs.join(pools, "id", "left"))
