"""Queries on vectors of texts, retrieval in rounds, patterns, trees searched and walked, caches and batches, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import directory_tree, embed, evidence, evaluate, index, patterns, replies, rounds, routing, stored, vectors
from quarry.operators.section_tree import walked
from quarry.plans.queries import ASKED, DENSE, ITEMS, QUESTIONS, TOKENS, T, asked_passages, query, questions, r6, read, scored, text_index, vector_questions
from quarry.plans.queries import vectors as given_vectors
from quarry.sources import files
from quarry.storage import fresh_dir, written

_VECTORS: dict[tuple[str, str], object] = {}
EMBEDDER = embed.HashedTerms(256)


def items(spark, d):
    """Every item of the benchmark as a question."""
    return read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


def text_vectors(spark, d):
    """The vectors of all documents, embedded once a session."""
    name = spark.sparkContext.applicationId, d
    if name not in _VECTORS:
        _VECTORS[name] = written(EMBEDDER.embedded(text_index(spark, d).chunks.select("pos", "text")).select("pos", "embedding"), "text-vectors")
    return _VECTORS[name]


# ---------------------------------------------------------------- vectors of texts

OF_ITEMS = f"q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id::VARCHAR AS query_id, unnest({T}) AS term FROM benchmark) GROUP BY ALL)"


def hashed(rows: str, key: str, n: str) -> str:
    """Unit vectors (``key, b, w``) of term counts, by the embedder's rule."""
    places = f"SELECT {key}, ('0x' || md5(term)[1:8])::BIGINT % {EMBEDDER.width} AS b, sum((1 - 2 * (('0x' || md5(term)[9:9])::INTEGER % 2)) * (1 + ln({n}))) AS w FROM {rows} GROUP BY ALL"
    return f"(SELECT {key}, b, (w / n)::FLOAT::DOUBLE AS w FROM ({places}) JOIN (SELECT {key}, sqrt(sum(w * w)) AS n FROM ({places}) GROUP BY ALL) USING ({key}) WHERE n > 0)"


def hybrid_sql(asked: str) -> str:
    return f"""WITH {scored(asked)}, u AS {hashed("tf", "pos", "tf")}, a AS {hashed("q", "query_id", "qtf")},
un AS (SELECT pos, sqrt(sum(w * w)) AS n FROM u GROUP BY pos), an AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM a GROUP BY query_id),
de AS (SELECT query_id, pos, sum(u.w * a.w) / any_value(un.n) / any_value(an.n) AS score FROM u JOIN a USING (b) JOIN un USING (pos) JOIN an USING (query_id) GROUP BY ALL HAVING score > 1e-12),
k AS (SELECT * FROM (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS rank FROM bm) WHERE rank <= 40),
v AS (SELECT * FROM (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS rank FROM de) WHERE rank <= 40),
f AS (SELECT query_id, pos, sum(1.0::DOUBLE / (60 + rank)) AS score, min(CASE WHEN leg = 'k' THEN rank END) AS kr, min(CASE WHEN leg = 'd' THEN rank END) AS dr FROM (SELECT *, 'k' AS leg FROM k UNION ALL SELECT *, 'd' AS leg FROM v) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, kr NULLS LAST, dr NULLS LAST) AS rank FROM f)
SELECT query_id, pos, rank, round(score, 6) AS score, concat_ws('+', CASE WHEN kr IS NOT NULL THEN 'keyword' END, CASE WHEN dr IS NOT NULL THEN 'dense' END) AS sources FROM r WHERE rank <= 10"""


def hybrid(spark, d, asked):
    own = text_index(spark, d)
    asked = EMBEDDER.embedded(asked, "query", "query_vector")
    found = index.hybrid(own.chunks, text_vectors(spark, d), asked, scores=stored.bm25(own, asked.select("query_id", "query")))
    sources = F.concat_ws("+", F.when(F.col("keyword_rank").isNotNull(), "keyword"), F.when(F.col("dense_rank").isNotNull(), "dense"))
    return found.select("query_id", "pos", F.col("rank").cast("long").alias("rank"), r6(F.col("score"), "score"), sources.alias("sources"))


@query(hybrid_sql(OF_ITEMS))
def hybrid_rrf(spark, d):
    return hybrid(spark, d, items(spark, d))


@query(hybrid_sql(ASKED))
def embedded_hybrid(spark, d):
    return hybrid(spark, d, questions(spark))


def vector_index(spark, d, store):
    """An index of the given vectors, of which every seventh is missing at first."""
    own = vectors.VectorIndex(spark, fresh_dir(spark, "vector-index"), "given", 64)
    own.fit(store)
    own.upsert(store.where("pos % 7 <> 0"))
    return own


@query()
def ann_topk(spark, d):
    """Ten nearest of every hundredth vector by the index, and the share of the ten truly nearest among them."""
    store, asked = given_vectors(spark, d).select("pos", "embedding"), vector_questions(spark, d).select("query_id", "query_vector")
    found = written(vectors.nearest(vector_index(spark, d, store), store, asked, 10), "approximate")
    exact = index.top_k(index.dense(store, asked, 10), 10, [F.desc(F.round("score", 9)), F.col("pos")]).select("query_id", "pos")
    recall = exact.join(found.select("query_id", "pos", F.lit(1).alias("met")), ["query_id", "pos"], "left").groupBy("query_id").agg((F.count("met") / F.count("*")).alias("recall"))
    return found.join(recall, "query_id").select("query_id", "pos", F.col("rank").cast("long").alias("rank"), r6(F.col("score"), "score"), r6(F.col("recall"), "recall"))


@query("SELECT label, count(*)::BIGINT AS n, count(*) FILTER (vec_id % 7 <> 0)::BIGINT AS n_before, count(*) FILTER (vec_id % 11 <> 0)::BIGINT AS n_after FROM embeddings GROUP BY label")
def ann_reseed(spark, d):
    """Vectors of each label in an index that lacks some, after it was brought up to date, and after some were deleted."""
    store = given_vectors(spark, d)
    own = vector_index(spark, d, store.select("pos", "embedding"))
    states = []
    for name, change in (("n_before", lambda: None), ("n", lambda: vectors.reseed(own, store.select("pos", "embedding"))), ("n_after", lambda: own.delete(store.where("pos % 11 = 0")))):
        change()
        states.append(written(own.vectors.join(store.select("pos", "label"), "pos").groupBy("label").agg(F.count("*").alias(name)), name))
    before, now, after = states
    return now.join(before, "label", "left").join(after, "label", "left").select("label", "n", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))


# ---------------------------------------------------------------- retrieval in rounds


def rounds_sql(asked: str, n: int = 3, found: int = 3, probed: int = 3) -> str:
    """``p{n}`` pools, ``k{n}`` calls and ``done``: the rounds unrolled, for ``qs`` (``query_id, query``)."""
    t = lambda c: T.replace("coalesce(text, '')", c)
    out = [TOKENS, asked, f"qt AS (SELECT query_id, term, min(place) AS place FROM (SELECT query_id, generate_subscripts(t, 1) AS place, unnest(t) AS term FROM (SELECT query_id, {t('query')} AS t FROM qs)) GROUP BY ALL)"]
    out += ["p0 AS (SELECT query_id, 0::BIGINT AS pos FROM qs WHERE false)", "k0 AS (SELECT query_id, '' AS tool, '' AS argument FROM qs WHERE false)", "a1 AS (SELECT query_id, query AS search, []::VARCHAR[] AS missing FROM qs)"]
    for r in range(1, n + 1):
        out += [
            f"t{r} AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({t('search')}) AS term FROM a{r}) GROUP BY ALL)",
            f"s{r} AS (SELECT query_id, pos FROM (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS rank FROM (SELECT query_id, tf.pos AS pos, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(c.t) / avgdl))) AS score FROM tf JOIN df USING (term) JOIN t{r} USING (term) JOIN c USING (pos), st GROUP BY ALL)) WHERE rank <= {found})",
            f"g{r} AS (SELECT query_id, pos FROM (SELECT query_id, c.pos AS pos, row_number() OVER (PARTITION BY query_id, m ORDER BY c.pos) AS nth FROM (SELECT query_id, unnest(missing[1:2]) AS m FROM a{r}) JOIN c ON contains(lower(c.text), m)) WHERE nth <= {probed})",
            f"k{r} AS (SELECT * FROM k{r - 1} UNION SELECT query_id, 'search', trim(search) FROM a{r} UNION SELECT query_id, 'grep', unnest(missing[1:2]) FROM a{r})",
            f"p{r} AS (SELECT * FROM p{r - 1} UNION SELECT * FROM s{r} UNION SELECT * FROM g{r})",
            f"h{r} AS (SELECT DISTINCT query_id, term FROM p{r} JOIN tf USING (pos))",
            f"z{r} AS (SELECT query_id, count(*) AS n_pool FROM p{r} GROUP BY query_id)",
            f"w{r} AS (SELECT a.query_id AS query_id, coalesce(any_value(z.n_pool), 0) AS n_pool, count(qt.term) AS n, count(h.term) AS n_held, coalesce(list(qt.term ORDER BY qt.place) FILTER (qt.term IS NOT NULL AND h.term IS NULL), []) AS m FROM a{r} a LEFT JOIN qt ON qt.query_id = a.query_id LEFT JOIN h{r} h ON h.query_id = a.query_id AND h.term = qt.term LEFT JOIN z{r} z ON z.query_id = a.query_id GROUP BY a.query_id)",
            f"v{r} AS (SELECT query_id, n_pool, CASE WHEN n_pool = 0 THEN 'insufficient' WHEN n = 0 THEN 'unknown' WHEN n_held / n >= 0.6 THEN 'sufficient' ELSE 'insufficient' END AS verdict, CASE WHEN n_pool = 0 THEN m ELSE m[1:8] END AS missing FROM w{r})",
            f"a{r + 1} AS (SELECT query_id, query || ' ' || array_to_string(missing, ' ') AS search, missing FROM v{r} JOIN qs USING (query_id) WHERE verdict <> 'sufficient' AND len(missing) > 0)",
        ]
    ends = [f"SELECT query_id, {r} AS rounds, verdict, missing, n_pool FROM v{r}" + (" WHERE verdict = 'sufficient' OR len(missing) = 0" if r < n else "") for r in range(1, n + 1)]
    return ", ".join([*out, f"done AS ({' UNION ALL '.join(ends)})"])


@query(f"WITH {rounds_sql('qs AS (SELECT item_id::VARCHAR AS query_id, text AS query FROM benchmark)')}, pd AS (SELECT query_id, md5(string_agg(pos::VARCHAR, ',' ORDER BY pos)) AS pool FROM p3 GROUP BY query_id), kd AS (SELECT query_id, count(*) AS n_calls FROM k3 GROUP BY query_id) SELECT query_id, rounds, verdict, n_pool::BIGINT AS n_pool, len(missing)::BIGINT AS n_missing, n_calls::BIGINT AS n_calls, coalesce(pool, md5('')) AS pool FROM done LEFT JOIN pd USING (query_id) LEFT JOIN kd USING (query_id)")
def retrieval_rounds(spark, d):
    state, pool, calls = rounds.retrieve(text_index(spark, d), items(spark, d), found=3, probed=3)
    pools = pool.groupBy("query_id").agg(F.array_sort(F.collect_list("pos")).alias("p")).select("query_id", F.md5(F.array_join("p", ",")).alias("pool"))
    n_calls = calls.groupBy("query_id").agg(F.count("*").alias("n_calls"))
    return state.join(pools, "query_id", "left").join(n_calls, "query_id", "left").select("query_id", "rounds", "verdict", "n_pool", F.size("missing").cast("long").alias("n_missing"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("pool", F.md5(F.lit(""))).alias("pool"))


SENTENCES = "list_filter(list_transform(regexp_extract_all(text, '[^。！？；.!?\\n]*[。！？；.!?\\n]|[^。！？；.!?\\n]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


def item_parts(spark, d):
    """The first four sentences of each item, as the parts of a question."""
    cut = read(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.posexplode(F.slice(tx.sentences(F.col("text")), 1, 4)).alias("part", "query"))
    return cut.select("question_id", "part", F.concat_ws("-", "question_id", "part").alias("query_id"), "query")


PART_QUESTIONS = "qs AS (SELECT question_id || '-' || part AS query_id, query FROM parts)"


@query(f"WITH sp AS (SELECT item_id AS question_id, {SENTENCES}[1:4] AS s FROM benchmark), parts AS (SELECT question_id, generate_subscripts(s, 1) - 1 AS part, unnest(s) AS query FROM sp), {rounds_sql(PART_QUESTIONS, 2)}, j AS (SELECT parts.*, question_id || '-' || part AS query_id FROM parts), mp AS (SELECT question_id, count(DISTINCT pos) AS n_pool FROM j JOIN p2 USING (query_id) GROUP BY 1) SELECT question_id, max(rounds)::INTEGER AS rounds, count(*)::BIGINT AS n_parts, count(*) FILTER (verdict = 'sufficient')::BIGINT AS n_sufficient, coalesce(string_agg(part::VARCHAR, ',' ORDER BY part) FILTER (verdict <> 'sufficient'), '') AS open_parts, coalesce(any_value(n_pool), 0)::BIGINT AS n_pool FROM j JOIN (SELECT query_id, rounds, verdict FROM done) USING (query_id) LEFT JOIN mp USING (question_id) GROUP BY question_id")
def fanout_merge(spark, d):
    own, parts = text_index(spark, d), written(item_parts(spark, d), "parts")
    state, pool, _ = rounds.retrieve(own, parts.select("query_id", "query"), rounds=2, found=3, probed=3)
    out, _ = rounds.merged(parts, state, pool, own)
    return out.select("question_id", F.col("rounds").cast("int").alias("rounds"), "n_parts", "n_sufficient", F.array_join("open_parts", ",").alias("open_parts"), "n_pool")


# ---------------------------------------------------------------- patterns


@query("WITH p AS (SELECT item_id, doc_id, lower(d.text) AS low, string_split(lower(d.text), lower(b.text)) AS s FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))) SELECT item_id, doc_id, (len(s) - 1)::BIGINT AS n, length(s[1])::BIGINT AS first, (length(low) - length(s[-1]))::BIGINT AS last FROM p")
def term_spans(spark, d):
    return patterns.occurrences(read(spark, d, "benchmark"), read(spark, d, "documents"), "item_id", "text")


@query("WITH m AS (SELECT text AS name, min(item_id) * 7 AS declared FROM benchmark GROUP BY text), f AS (SELECT name, declared, doc_id AS passage, strpos(lower(d.text), lower(name)) - 1 AS first FROM m JOIN documents d ON contains(lower(d.text), lower(name))) SELECT md5(name) AS name, passage, first::BIGINT AS first FROM f QUALIFY row_number() OVER (PARTITION BY name ORDER BY declared <> passage, passage) = 1")
def member_anchors(spark, d):
    """Items as members of an enumeration, each with a declared document of which most are wrong, at the document that they stand in."""
    members = read(spark, d, "benchmark").groupBy(F.col("text").alias("name")).agg((F.min("item_id") * 7).alias("declared"))
    found = patterns.anchors(members, read(spark, d, "documents").select(F.col("doc_id").alias("passage"), "text"))
    return found.select(F.md5("name").alias("name"), "passage", "first")


# ---------------------------------------------------------------- evidence


def block_sql(opening: str) -> str:
    """Evidence blocks of the items, behind an ``opening`` of the item's ``text``."""
    return f"""WITH {TOKENS}, {ITEMS}, x AS (SELECT query_id, rank, pos, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, '[' || rank || '] (' || pos || ' p.1) ' AS header FROM top JOIN c USING (pos)),
o AS (SELECT item_id::VARCHAR AS query_id, {opening} AS opening FROM benchmark),
y AS (SELECT x.*, opening, 3000 - strlen(opening) - coalesce(sum(strlen(header) + strlen(text) + 1) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - strlen(header) - 1 AS room FROM x JOIN o USING (query_id)),
z AS (SELECT *, coalesce(max(CASE WHEN room < 120 OR strlen(text) > room THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM y),
k AS (SELECT query_id, rank, header || CASE WHEN strlen(text) <= room THEN text ELSE left(text, room::BIGINT) || '…' END || chr(10) AS shown FROM z WHERE room >= 120 AND stopped = 0),
n AS (SELECT query_id, count(*) AS n FROM x GROUP BY query_id), s AS (SELECT query_id, count(*) AS n_shown, string_agg(shown, '' ORDER BY rank) AS shown FROM k GROUP BY query_id)
SELECT query_id, coalesce(n_shown, 0)::BIGINT AS n_shown, (coalesce(n, 0) - coalesce(n_shown, 0))::BIGINT AS n_omitted, md5(opening || coalesce(shown, '') || CASE WHEN coalesce(n_shown, 0) < coalesce(n, 0) THEN chr(10) || '(' || (n - coalesce(n_shown, 0)) || ' of ' || n || ' passage(s) omitted to fit the context window.)' || chr(10) ELSE '' END) AS block FROM o LEFT JOIN n USING (query_id) LEFT JOIN s USING (query_id)"""


@query(block_sql("'Question: ' || text || chr(10) || chr(10) || 'Evidence:' || chr(10)"))
def evidence_budget(spark, d):
    asked, passages = asked_passages(spark, d)
    return evidence.evidence_block(asked, passages, 3000).select("query_id", "n_shown", "n_omitted", F.md5("block").alias("block"))


# ---------------------------------------------------------------- directory tree by folders

FOLDERS = """p AS (SELECT doc_id, lang, source FROM documents WHERE trim(text) <> ''), l1 AS (SELECT lang, 'd0.' || row_number() OVER (ORDER BY lang) AS nid FROM (SELECT DISTINCT lang FROM p)),
l2 AS (SELECT lang, source, nid || '.' || row_number() OVER (PARTITION BY lang ORDER BY source) AS leaf, nid FROM (SELECT DISTINCT lang, source FROM p) JOIN l1 USING (lang))"""


_TREES: dict[tuple[str, str], tuple] = {}


def folder_tree(spark, d):
    """Documents by source within language, built once a session; a leaf is a folder, however large."""
    name = spark.sparkContext.applicationId, d
    if name not in _TREES:
        own = text_index(spark, d)
        docs = own.chunks.select("doc_id", F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))).alias("path"))
        _TREES[name] = directory_tree.build(docs, own.postings.select("doc_id", "term", "tf"), leaf=1 << 40)
    return _TREES[name]


@query(f"WITH {FOLDERS} SELECT 'd0' AS nid, NULL AS parent, 0 AS level, '' AS name, count(*)::BIGINT AS n_docs FROM p UNION ALL SELECT nid, 'd0', 1, lang, count(*) FROM p JOIN l1 USING (lang) GROUP BY ALL UNION ALL SELECT leaf, nid, 2, source, count(*) FROM p JOIN l2 USING (lang, source) GROUP BY ALL")
def dirtree_folders(spark, d):
    nodes, leaves = folder_tree(spark, d)
    sizes = directory_tree.subtree(nodes, leaves).groupBy("nid").agg(F.countDistinct("doc_id").alias("n_docs"))
    return nodes.join(sizes, "nid").select("nid", "parent", "level", "name", "n_docs")


def searched_sql(opened: str, order: str) -> str:
    """Routed documents and net, for ``opened`` (``query_id, branch, turn, leaf``), ``sc`` and ``m`` (``leaf, doc_id``)."""
    return f"""there AS (SELECT o.query_id, branch, turn, m.doc_id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY o.query_id, branch, turn ORDER BY round(coalesce(score, 0), 9) DESC, m.doc_id) AS nth FROM {opened} o JOIN m USING (leaf) LEFT JOIN sc ON sc.query_id = o.query_id AND sc.doc_id = m.doc_id),
rt AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS place FROM there WHERE nth <= 8),
ex AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM sc WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM there)) WHERE place <= 3),
nx AS (SELECT query_id, count(*) AS n FROM ex GROUP BY query_id),
al AS (SELECT rt.query_id, 0 AS late, place, doc_id, 'route' AS source FROM rt LEFT JOIN nx USING (query_id) WHERE place <= 8 - coalesce(n, 0) UNION ALL SELECT query_id, 1, place, doc_id, 'keyword' FROM ex)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY late, place)::INTEGER AS rank, doc_id, source FROM al QUALIFY rank <= 8"""


SCORED_FOLDERS = f"{scored(ASKED)}, sc AS (SELECT query_id, pos::VARCHAR AS doc_id, score FROM bm), {FOLDERS}, m AS (SELECT leaf, nid, doc_id::VARCHAR AS doc_id FROM p JOIN l2 USING (lang, source)), s1 AS (SELECT q.query_id, l1.nid, coalesce(max(score), 0) AS s FROM (SELECT DISTINCT query_id FROM sc) q CROSS JOIN l1 LEFT JOIN m ON m.nid = l1.nid LEFT JOIN sc ON sc.query_id = q.query_id AND sc.doc_id = m.doc_id GROUP BY ALL), s2 AS (SELECT q.query_id, l2.nid, l2.leaf, coalesce(max(score), 0) AS s FROM (SELECT DISTINCT query_id FROM sc) q CROSS JOIN l2 LEFT JOIN m ON m.leaf = l2.leaf LEFT JOIN sc ON sc.query_id = q.query_id AND sc.doc_id = m.doc_id GROUP BY ALL), b1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, string_split(nid, '.')[-1]::INTEGER) AS branch FROM s1), b2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, nid ORDER BY round(s, 9) DESC, string_split(leaf, '.')[-1]::INTEGER) AS way FROM s2)"


def document_scores(spark, d):
    own = text_index(spark, d)
    return written(stored.bm25(own, questions(spark)).join(own.chunks.select("pos", "doc_id"), "pos").select("query_id", "doc_id", "score"), "scores")


@query(f"WITH {SCORED_FOLDERS}, op AS (SELECT b1.query_id, branch, 1 AS turn, leaf FROM b1 JOIN b2 USING (query_id, nid) WHERE branch <= 4 AND way = 1), {searched_sql('op', 'nth, branch')}")
def dirtree_search(spark, d):
    """Four branches, each walked to a leaf of its own, taking turns."""
    nodes, leaves = folder_tree(spark, d)
    return directory_tree.search(nodes, leaves, document_scores(spark, d), limit=8, branches=4)


@query(f"WITH {SCORED_FOLDERS}, sz AS (SELECT leaf, count(*) AS n FROM m GROUP BY leaf), w AS (SELECT b1.query_id, leaf, n, branch, way, row_number() OVER (PARTITION BY b1.query_id ORDER BY branch, way) AS turn, dense_rank() OVER (PARTITION BY b1.query_id ORDER BY branch) + 1 AS taken, coalesce(sum(n) OVER (PARTITION BY b1.query_id ORDER BY branch, way ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM b1 JOIN b2 USING (query_id, nid) JOIN sz USING (leaf) WHERE branch <= 2 AND way <= 2), op AS (SELECT query_id, 1 AS branch, turn, leaf FROM w WHERE taken < 8 AND held < 8), {searched_sql('op', 'turn, nth')}")
def dirtree_best_first(spark, d):
    """Two directions a level, the first choice down to its leaf before the second."""
    nodes, leaves = folder_tree(spark, d)
    return directory_tree.search(nodes, leaves, document_scores(spark, d), limit=8, beam=2)


@query(f"""WITH {FOLDERS}, g AS (SELECT item_id::VARCHAR AS query_id, leaf, count(*) AS held FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) JOIN l2 USING (lang, source) GROUP BY ALL), z AS (SELECT leaf, count(*) AS size FROM p JOIN l2 USING (lang, source) GROUP BY leaf),
o AS (SELECT query_id, leaf, held, size FROM g JOIN z USING (leaf)), bud AS (SELECT count(*) / 5 AS most FROM p),
c1 AS (SELECT query_id, leaf AS last, held, size FROM o), c2 AS (SELECT c.query_id, o.leaf AS last, c.held + o.held AS held, c.size + o.size AS size FROM c1 c JOIN o ON o.query_id = c.query_id AND o.leaf > c.last),
c3 AS (SELECT c.query_id, o.leaf AS last, c.held + o.held AS held, c.size + o.size AS size FROM c2 c JOIN o ON o.query_id = c.query_id AND o.leaf > c.last), c4 AS (SELECT c.query_id, o.leaf AS last, c.held + o.held AS held, c.size + o.size AS size FROM c3 c JOIN o ON o.query_id = c.query_id AND o.leaf > c.last),
b AS (SELECT query_id, coalesce(max(held) FILTER (m <= 1), 0) AS b1, coalesce(max(held) FILTER (m <= 2), 0) AS b2, coalesce(max(held) FILTER (m <= 4), 0) AS b4 FROM (SELECT *, 1 AS m FROM c1 UNION ALL SELECT *, 2 FROM c2 UNION ALL SELECT *, 3 FROM c3 UNION ALL SELECT *, 4 FROM c4), bud WHERE size <= floor(most) GROUP BY query_id)
SELECT query_id, coalesce(b1, 0)::BIGINT AS leaves_1, coalesce(b2, 0)::BIGINT AS leaves_2, coalesce(b4, 0)::BIGINT AS leaves_4 FROM (SELECT DISTINCT query_id FROM g) LEFT JOIN b USING (query_id)""")
def oracle_capacity(spark, d):
    """The most documents that hold an item within one, two and four folders of a fifth of the corpus together."""
    _, leaves = folder_tree(spark, d)
    gold = patterns.occurrences(items(spark, d), text_index(spark, d).chunks.select("doc_id", "text"), "query_id", "query").select("query_id", "doc_id")
    gold, budget = written(gold, "gold"), leaves.count() // 5
    best = [directory_tree.best_coverage(gold, leaves, m, budget).withColumnRenamed("best", f"leaves_{m}") for m in (1, 2, 4)]
    return best[0].join(best[1], "query_id").join(best[2], "query_id")


# ---------------------------------------------------------------- walks over hierarchies

HIERARCHY = "n AS (SELECT source || '/' || lang AS nid, source AS parent, lang AS name FROM documents GROUP BY ALL UNION ALL SELECT source, '', source FROM documents GROUP BY source UNION ALL SELECT '', NULL, ''), w AS (SELECT nid, 0 AS depth, [name] AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.nid, w.depth + 1, list_append(w.path, n.name) FROM n JOIN w ON n.parent = w.nid)"


def hierarchy(spark, d):
    """Folders of sources and languages, ``nid, parent, name``."""
    paths = read(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return routing.path_nodes(paths).select("nid", "parent", F.element_at(F.split("nid", "/"), -1).alias("name"), "n_docs")


@query(f"WITH RECURSIVE {HIERARCHY} SELECT nid, depth, array_to_string(path, ' > ') AS path, row_number() OVER (ORDER BY path)::BIGINT AS place FROM w")
def tree_walk(spark, d):
    """Every folder with its depth, the names on the way to it, and its place in depth-first order."""
    nodes = hierarchy(spark, d).select("nid", "parent", "name")
    return walked(nodes).select("nid", "depth", F.array_join("path", " > ").alias("path"), "place")


@query(f"WITH RECURSIVE {HIERARCHY}, nd AS (SELECT source || '/' || lang AS nid, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT source, count(*) FROM documents GROUP BY source) SELECT path[2] AS root, string_agg(repeat('  ', depth - 1) || path[-1] || ' (' || n || ')', chr(10) ORDER BY path) AS shown FROM w JOIN nd USING (nid) WHERE depth BETWEEN 1 AND 2 GROUP BY path[2]")
def tree_render(spark, d):
    """Each source with its languages, indented, and the number of documents of both."""
    nodes = hierarchy(spark, d)
    at = walked(nodes.select("nid", "parent", "name")).where("depth BETWEEN 1 AND 2").join(nodes.select("nid", "n_docs"), "nid")
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.element_at("path", -1), F.lit(" ("), F.col("n_docs").cast("string"), F.lit(")"))
    lines = at.groupBy(F.get("path", F.lit(1)).alias("root")).agg(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))).alias("l"))
    return lines.select("root", F.array_join("l.line", "\n").alias("shown"))


# ---------------------------------------------------------------- caches and samples in order


@query("SELECT doc_id FROM (SELECT doc_id, sum(strlen(text)) OVER (ORDER BY n_chars DESC, sha256(doc_id::VARCHAR || '|' || strlen(text)) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM documents), (SELECT sum(strlen(text)) // 3 AS most FROM documents) WHERE total <= most")
def cache_evict(spark, d):
    """Documents as entries of a cache, the longest as if used last, down to a third of their bytes."""
    docs = read(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), F.col("n_chars").alias("used_at"))
    entries = docs.withColumn("key", F.sha2(F.concat_ws("|", "doc_id", "size"), 256))
    most = entries.agg(F.sum("size")).first()[0] or 0
    return files.evict(entries, most // 3).select("doc_id")


@query("WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n, count(*) OVER () AS total FROM documents) SELECT doc_id FROM n WHERE n IN (SELECT (i * total) // 37 FROM (SELECT unnest(range(37)) AS i), (SELECT count(*) AS total FROM documents))")
def evenly_spaced(spark, d):
    return evaluate.every_so_often(read(spark, d, "documents").select("doc_id"), "doc_id", 37)


# ---------------------------------------------------------------- replies and metadata of any shape


def props_of_events(spark, d):
    """The fields of the events' JSON and their kind as a field, ``event_id, field, value``."""
    events = read(spark, d, "events")
    own = replies.long_values(events, "event_id", "props").select("event_id", "field", "value")
    return own.unionByName(events.select("event_id", F.lit("event_type").alias("field"), F.col("event_type").alias("value")))


@query("""WITH f AS (SELECT event_type, unnest(json_keys(props)) AS field, props FROM events), t AS (SELECT event_type, field, count(*)::BIGINT AS n, bool_and(json_type(props, '$.' || field) IN ('UBIGINT', 'BIGINT')) AS whole FROM f GROUP BY ALL)
SELECT event_type, field, n, '{"type":"object","properties":{"' || field || '":{"type":"' || CASE WHEN whole THEN 'integer' ELSE 'string' END || '"}},"additionalProperties":false}' AS schema FROM t""")
def props_schema(spark, d):
    """The fields that the events of each kind hold, and the JSON Schema that declares them."""
    long = replies.long_values(read(spark, d, "events").select("event_id", "props", "event_type"), "event_id", "props").join(read(spark, d, "events").select("event_id", "event_type"), "event_id")
    kinds = long.groupBy("event_type", "field").agg(F.count("*").alias("n"), F.min(F.col("kind") == "BIGINT").alias("whole"))
    fields = kinds.select("event_type", F.lit(0).alias("at"), F.col("field").alias("key"), F.when(F.col("whole"), "integer").otherwise("string").alias("type"), F.lit("").alias("description"), F.array().cast("array<string>").alias("enum"))
    return kinds.select("event_type", "field", "n").join(replies.json_schema(fields, "event_type"), "event_type")


#: Filters as they come, in all spellings of their parts, each with what it means in SQL; ``k`` is the events' own field.
FILTERS = [
    ('{"conditions": [{"name": "k", "comparison_operator": "is", "value": 17}]}', "k = 17"),
    ('{"conditions": [{"key": "k", "operator": "==", "value": "17"}], "logic": "or"}', "k = 17"),
    ('{"conditions": [{"name": "k", "operator": "not is", "value": 17}]}', "k <> 17"),
    ('{"conditions": [{"name": "k", "comparison_operator": "!=", "value": "17"}]}', "k <> 17"),
    ('{"conditions": [{"name": "k", "comparison_operator": ">=", "value": 90}, {"key": "event_type", "operator": "=", "value": "CLICK"}], "logic": "and"}', "k >= 90 AND event_type = 'click'"),
    ('{"conditions": [{"name": "k", "comparison_operator": "<=", "value": 5}, {"key": "event_type", "operator": "start with", "value": "Vi"}], "logic": "or"}', "k <= 5 OR event_type LIKE 'vi%'"),
    ('{"conditions": [{"name": "k", "comparison_operator": ">", "value": 9}]}', "k > 9"),
    ('{"conditions": [{"name": "k", "comparison_operator": "<", "value": 9.5}]}', "k < 9.5"),
    ('{"conditions": [{"name": "event_type", "comparison_operator": "in", "value": ["click", "View"]}]}', "event_type = 'click'"),
    ('{"conditions": [{"name": "event_type", "comparison_operator": "not in", "value": ["Click", "view"]}]}', "event_type NOT IN ('click', 'view')"),
    ('{"conditions": [{"name": "k", "comparison_operator": "contains", "value": 7}, {"name": "k", "comparison_operator": "not contains", "value": "1"}, {"name": "k", "operator": "end with", "value": "7"}]}', "k::VARCHAR LIKE '%7' AND k::VARCHAR NOT LIKE '%1%'"),
    ('{"conditions": [{"name": "k", "operator": "not empty"}, {"name": "none", "operator": "=", "value": 1}], "logic": "or"}', "true"),
    ('{"conditions": [{"name": "k", "operator": "not empty"}, {"name": "none", "operator": "=", "value": 1}]}', "false"),
    ('{"conditions": [{"name": "k", "operator": ">", "value": "9999-99-99"}]}', "false"),
    ('{"conditions": [{"name": "k", "operator": "!=", "value": "9999-99-99"}, {"operator": "=", "value": 1}]}', "true"),
]


@query("WITH e AS (SELECT event_id, event_type, (props->>'$.k')::BIGINT AS k FROM events), r AS (" + " UNION ALL ".join(f"SELECT {n} AS filter_id, event_id FROM e WHERE {sql}" for n, (_, sql) in enumerate(FILTERS)) + ") SELECT filter_id, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids FROM r GROUP BY filter_id")
def props_filter(spark, d):
    given = spark.createDataFrame([(n, c) for n, (c, _) in enumerate(FILTERS)], "filter_id int, condition string")
    found = replies.filtered(props_of_events(spark, d), replies.conditions(given), "event_id")
    return found.groupBy("filter_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(f"""WITH s AS (SELECT item_id, list_transform({SENTENCES}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS s FROM benchmark), x AS (SELECT item_id, generate_subscripts(s, 1) AS place, unnest(s) AS q FROM s), g AS (SELECT item_id, q, min(place) AS place FROM x WHERE length(q) <= 200 AND len(string_split(q, ' ')) <= 24 GROUP BY item_id, lower(q), q QUALIFY row_number() OVER (PARTITION BY item_id, lower(q) ORDER BY min(place)) = 1),
r AS (SELECT item_id, list(q ORDER BY place)[1:3] AS q FROM g GROUP BY item_id) SELECT item_id, coalesce(array_to_string(q, chr(10)), '') AS queries FROM benchmark LEFT JOIN r USING (item_id)""")
def reply_queries(spark, d):
    """The sentences of each item as a model might send them as queries: as JSON in a fence, as a bare array of objects, or as a list behind a line of prose."""
    s = read(spark, d, "benchmark").select("item_id", F.transform(tx.sentences(F.col("text")), tx.collapse).alias("s"))
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("s").alias("queries"))), F.lit("\n```"))
    bare = F.to_json(F.transform("s", lambda x: F.struct(x.alias("question"))))
    listed = F.concat(F.lit("Here are the queries:\n"), F.array_join(F.transform("s", lambda x, i: F.concat((i + 1).cast("string"), F.lit('. "'), x, F.lit('",'))), "\n"))
    reply = F.when(F.col("item_id") % 3 == 0, fenced).when(F.col("item_id") % 3 == 1, bare).otherwise(listed)
    return s.select("item_id", F.array_join(replies.reply_queries(reply), "\n").alias("queries"))
