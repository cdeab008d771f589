"""The section tree of each document: built from headings, described, and searched by descent beside the keyword ranking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import first_sentence, heading_title, strip, terms, truncate
from quarry.operators.chunking import heading_levels
from quarry.operators.index import B, K1, RRF, idf, query_terms
from quarry.operators.prefix import numbered
from quarry.operators.sequential import in_order
from quarry.storage import written

#: Defaults of a search: hits, documents that are descended into, children followed, passages of a document, levels; what a parent's score is worth one level down.
LIMIT, DOCS, BEAM, ANCHORS, DEPTH, DISCOUNT = 20, 8, 2, 6, 8, 0.6
SUMMARY = 160

ANCHOR = "doc_id string, pos long, chunk_id string, nid string, aid string, heading boolean, level int, parent string, path array<string>"


def anchors(chunks: DataFrame) -> DataFrame:
    """``ANCHOR``: for every chunk (``doc_id, pos, chunk_id, block_type, text, level, font_size``) with a text the node that holds it.

    A heading opens a node under the last open one of a smaller level, at most one level below it; the root is ``n0``. One pass over a document's
    chunks in order, as each level depends on those above.
    """
    levels = heading_levels(chunks).select("doc_id", "pos", "tree_level")
    rows = chunks.where(strip(F.col("text")) != "").join(levels, ["doc_id", "pos"], "left").select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk_id", "tree_level")

    def run(doc_id: str, found: list[dict]) -> list[dict]:
        chain, nodes, out = [("n0", 0)], 0, []
        for k, r in enumerate(found):
            heading = r["tree_level"] is not None
            if heading:
                chain = chain[:1] + [n for n in chain[1:] if n[1] < r["tree_level"]]
                nodes += 1
                chain = [*chain, (f"n{nodes}", min(r["tree_level"], chain[-1][1] + 1))]
            nid, level = chain[-1]
            at = {"doc_id": doc_id, "pos": r["pos"], "chunk_id": r["chunk_id"], "nid": nid, "aid": f"a{k + 1:04d}"}
            out.append(at | {"heading": heading, "level": level, "parent": chain[-2][0] if len(chain) > 1 else None, "path": [n for n, _ in chain]})
        return out

    return in_order(rows, "doc_id", "pos", run, ANCHOR)


def nodes(anchored: DataFrame, chunks: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``doc_id, nid, parent, level, path, title, at``: the sections, and for each document its root, named by ``names`` (``doc_id, title``) or its id."""
    text = chunks.select("doc_id", "chunk_id", "block_type", "text")
    sections = anchored.where("heading").join(text, ["doc_id", "chunk_id"]).select("doc_id", "nid", "parent", "level", "path", heading_title(F.col("text"), F.col("block_type")).alias("title"), F.col("pos").alias("at"))
    docs = anchored.select("doc_id").distinct()
    docs = docs.join(names, "doc_id", "left").select("doc_id", F.coalesce("title", "doc_id").alias("title")) if names is not None else docs.select("doc_id", F.col("doc_id").alias("title"))
    roots = docs.select("doc_id", F.lit("n0").alias("nid"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level"), F.array(F.lit("n0")).alias("path"), "title", F.lit(-1).cast("long").alias("at"))
    return sections.unionByName(roots)


def node_texts(tree: DataFrame, anchored: DataFrame, chunks: DataFrame) -> DataFrame:
    """``doc_id, nid, text``: a node's title, those of its children and its own passages; what lies deeper belongs to the children."""
    own = tree.select("doc_id", "nid", F.lit(0).alias("part"), "at", F.col("title").alias("t"))
    of_children = tree.where("parent IS NOT NULL").select("doc_id", F.col("parent").alias("nid"), F.lit(1).alias("part"), "at", F.col("title").alias("t"))
    passages = anchored.join(chunks.select("doc_id", "chunk_id", "text"), ["doc_id", "chunk_id"]).select("doc_id", "nid", F.lit(2).alias("part"), F.col("pos").alias("at"), F.col("text").alias("t"))
    parts = own.unionByName(of_children).unionByName(passages).groupBy("doc_id", "nid").agg(F.array_sort(F.collect_list(F.struct("part", "at", "t"))).alias("p"))
    return parts.select("doc_id", "nid", F.array_join("p.t", "\n").alias("text"))


def summaries(tree: DataFrame, anchored: DataFrame, chunks: DataFrame) -> DataFrame:
    """``doc_id, nid, summary``: the title and the beginning of the first passage; without one, what the node holds."""
    first = anchored.groupBy("doc_id", "nid").agg(F.min_by("chunk_id", "pos").alias("chunk_id")).join(chunks.select("doc_id", "chunk_id", "text"), ["doc_id", "chunk_id"]).select("doc_id", "nid", "text")
    held = tree.where("parent IS NOT NULL").groupBy("doc_id", F.col("parent").alias("nid")).agg(F.array_sort(F.collect_list(F.struct("at", "title"))).alias("c")).select("doc_id", "nid", F.array_join("c.title", "、").alias("held"))
    rows = tree.select("doc_id", "nid", "title").join(first, ["doc_id", "nid"], "left").join(held, ["doc_id", "nid"], "left")
    body = strip(F.coalesce("text", F.lit("")))
    body = first_sentence(strip(F.when(F.startswith(body, F.col("title")), F.substr(body, F.length("title") + 1)).otherwise(body)), SUMMARY)
    rest = F.when(body != "", body).when(F.col("held").isNotNull(), F.concat(F.lit("含："), F.col("held")))
    return rows.select("doc_id", "nid", truncate(F.concat_ws(" — ", "title", rest), 2 * SUMMARY, "…").alias("summary"))


def node_scores(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, doc_id, nid, score``: BM25 of nodes, with the statistics of each document's nodes."""
    cut = texts.select("doc_id", "nid", terms(F.col("text")).alias("t"))
    sizes = cut.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    tf = cut.select("doc_id", "nid", F.size("t").alias("dl"), F.explode_outer("t").alias("term")).where(F.col("term").isNotNull()).groupBy("doc_id", "nid", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    q = query_terms(queries)
    tf = tf.join(q.select("term").distinct(), "term", "left_semi")
    df = tf.groupBy("doc_id", "term").agg(F.count("*").alias("df"))
    rows = tf.join(df, ["doc_id", "term"]).join(sizes, "doc_id").join(q, "term")
    norm = K1 * (1 - B + B * F.col("dl") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0))
    part = F.col("qtf") * idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return rows.groupBy("query_id", "doc_id", "nid").agg(F.sum(part).alias("score"))


def node_keywords(texts: DataFrame, most: int = 12) -> DataFrame:
    """``doc_id, nid, keywords``: the terms that say most about a node among those of its document."""
    cut = texts.select("doc_id", "nid", F.explode(terms(F.col("text"))).alias("term")).groupBy("doc_id", "nid", "term").agg(F.count("*").alias("tf"))
    sizes = texts.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = cut.join(cut.groupBy("doc_id", "term").agg(F.count("*").alias("df")), ["doc_id", "term"]).join(sizes, "doc_id").withColumn("w", F.col("tf") * idf(F.col("n"), F.col("df")))
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "nid").orderBy(F.desc(F.round("w", 9)), "term"))).where(F.col("r") <= most)
    return top.groupBy("doc_id", "nid").agg(F.array_sort(F.collect_list(F.struct("r", "term"))).alias("k")).select("doc_id", "nid", F.col("k.term").alias("keywords"))


def candidates(tree: DataFrame, scored: DataFrame, passages: DataFrame, most: int = DOCS) -> DataFrame:
    """``query_id, doc_id, tree_key, bm25_key, reason``: documents by the best of their top sections (or of the root where there is none) or of
    their passages (``query_id, doc_id, score``), each in proportion to the best of all."""
    tops = tree.where("parent = 'n0'").select("doc_id", "nid")
    flat = tree.where("nid = 'n0'").select("doc_id", "nid").join(tops.select("doc_id").distinct(), "doc_id", "left_anti")
    by_tree = scored.join(tops.unionByName(flat), ["doc_id", "nid"], "left_semi").groupBy("query_id", "doc_id").agg(F.max("score").alias("tree"))
    by_term = passages.join(tree.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("query_id", "doc_id").agg(F.max("score").alias("bm25"))
    rows = by_tree.join(by_term, ["query_id", "doc_id"], "full")
    all_of = Window.partitionBy("query_id")
    keyed = [F.coalesce(F.col(c) / F.max(c).over(all_of), F.lit(0.0)).alias(f"{c}_key") for c in ("tree", "bm25")]
    rows = rows.select("query_id", "doc_id", *keyed).where((F.col("tree_key") > 0) | (F.col("bm25_key") > 0))
    reason = F.when((F.col("tree_key") > 0) & (F.col("bm25_key") > 0), "both").when(F.col("tree_key") > 0, "tree").otherwise("bm25")
    order = all_of.orderBy(F.desc(F.greatest("tree_key", "bm25_key")), "doc_id")
    return rows.withColumns({"reason": reason, "place": F.row_number().over(order)}).where(F.col("place") <= most)


def descend(children: dict[str, list[tuple[str, float]]], held: set[str], beam: int = BEAM, depth: int = DEPTH) -> list[tuple[str, float]]:
    """Nodes that a descent from the root reaches, with their scores: at each node the best children, of which only the first may score nothing.

    ``children``: of each node its children with their scores. Leaves are reached, and on the way nodes that hold passages (``held``).
    """
    level, reached = [("n0", 0.0)], []
    for _ in range(depth):
        following = []
        for nid, score in level:
            ranked = sorted(children.get(nid, ()), key=lambda c: (-c[1], c[0]))[:beam]
            if not ranked or nid in held:
                reached.append((nid, score))
            following += [(child, score * DISCOUNT + own) for k, (child, own) in enumerate(ranked) if k == 0 or own > 0]
        level = following
    return reached


def pick(reached: list[tuple[str, float]], own: dict[str, list[tuple[str, float]]], most: int = ANCHORS) -> list[str]:
    """Passages of reached nodes: the best of each node in turn, then the best of what is left. ``own``: passages of a node with their scores, in order."""
    first = [max(own[nid], key=lambda a: a[1])[0] for nid, _ in reached if own.get(nid)]
    rest = sorted({a for nid, _ in reached for a in own.get(nid, ()) if a[0] not in first}, key=lambda a: (-a[1], a[0]))
    return [*dict.fromkeys(first), *(a for a, _ in rest)][:most]


def route(picked: DataFrame, tree: DataFrame, anchored: DataFrame, scored: DataFrame, passages: DataFrame, beam: int = BEAM, most: int = ANCHORS, depth: int = DEPTH) -> DataFrame:
    """``query_id, doc_id, aid, nid, chunk_id, place``: passages that the descent into each picked document contributes, in its order."""
    asked = picked.select("query_id", "doc_id", F.col("place").alias("doc_place"))
    of_nodes = asked.join(tree.select("doc_id", "nid", "parent"), "doc_id").join(scored, ["query_id", "doc_id", "nid"], "left").select("query_id", "doc_id", "doc_place", "nid", "parent", F.lit(None).cast("string").alias("aid"), F.lit(None).cast("string").alias("chunk_id"), F.coalesce("score", F.lit(0.0)).alias("score"))
    of_anchors = asked.join(anchored.select("doc_id", "nid", "aid", "chunk_id"), "doc_id").join(passages, ["query_id", "doc_id", "chunk_id"], "left").select("query_id", "doc_id", "doc_place", "nid", F.lit(None).cast("string").alias("parent"), "aid", "chunk_id", F.coalesce("score", F.lit(0.0)).alias("score"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        children: dict[str, list] = {}
        own: dict[str, list] = {}
        chunk_of, node_of = {}, {}
        for r in pdf.sort_values("aid", na_position="first").itertuples(index=False):
            if r.aid is None:
                children.setdefault(r.parent, []).append((r.nid, r.score))
            else:
                own.setdefault(r.nid, []).append((r.aid, r.score))
                chunk_of[r.aid], node_of[r.aid] = r.chunk_id, r.nid
        found = pick(descend(children, set(own), beam, depth), own, most)
        return pd.DataFrame([(*key, int(pdf["doc_place"].iloc[0]) * 1000 + k, node_of[a], a, chunk_of[a]) for k, a in enumerate(found)], columns=["query_id", "doc_id", "place", "nid", "aid", "chunk_id"])

    return of_nodes.unionByName(of_anchors).groupBy("query_id", "doc_id").applyInPandas(run, "query_id string, doc_id string, place long, nid string, aid string, chunk_id string")


def fuse(routed: DataFrame, passages: DataFrame, tree: DataFrame, limit: int = LIMIT, fallback: bool = True) -> DataFrame:
    """``query_id, rank, doc_id, chunk_id, score, source, nid, path``: both rankings by reciprocal rank. Only passages that match a term at all
    (``passages``: ``query_id, doc_id, chunk_id, score, pos``) are hits; only those that the descent reached have a path."""
    by = Window.partitionBy("query_id")
    words = passages.withColumn("r", F.row_number().over(by.orderBy(F.desc("score"), "pos"))).select("query_id", "doc_id", "chunk_id", "r", F.lit("bm25").alias("leg"))
    reached = routed.withColumn("r", F.row_number().over(by.orderBy("place"))).select("query_id", "doc_id", "chunk_id", "r", F.lit("tree").alias("leg"))
    reached = reached.join(passages.select("query_id", "doc_id", "chunk_id"), ["query_id", "doc_id", "chunk_id"], "left_semi")
    legs = words.unionByName(reached) if fallback else reached
    merged = legs.groupBy("query_id", "doc_id", "chunk_id").agg(F.sum(1.0 / (RRF + F.col("r"))).alias("score"), F.min(F.when(F.col("leg") == "bm25", F.col("r"))).alias("bm25_rank"), F.array_sort(F.collect_set("leg")).alias("legs"))
    steps = tree.select("doc_id", F.col("nid").alias("of"), F.posexplode("path").alias("step", "nid")).join(tree.select("doc_id", "nid", "title"), ["doc_id", "nid"])
    paths = steps.groupBy("doc_id", F.col("of").alias("nid")).agg(F.array_sort(F.collect_list(F.struct("step", "title"))).alias("p")).select("doc_id", "nid", F.col("p.title").alias("path"))
    placed = routed.select("query_id", "doc_id", "chunk_id", "nid").join(paths, ["doc_id", "nid"])
    order = by.orderBy(F.desc(F.round("score", 12)), F.col("bm25_rank").asc_nulls_last(), "doc_id", "chunk_id")
    out = merged.join(placed, ["query_id", "doc_id", "chunk_id"], "left").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    source: Column = F.when(F.size("legs") > 1, "both").otherwise(F.col("legs")[0])
    return out.select("query_id", "rank", "doc_id", "chunk_id", "score", source.alias("source"), "nid", "path")


def search(chunks: DataFrame, queries: DataFrame, passages: DataFrame, names: DataFrame | None = None, limit: int = LIMIT, fallback: bool = True) -> DataFrame:
    """The whole channel over chunks of all documents. ``passages``: keyword scores of the chunks that match, as in :func:`fuse`."""
    anchored = written(anchors(chunks), "anchors")  # each document's tree is built once, whatever reads it
    tree = written(nodes(anchored, chunks, names), "tree")
    scored = written(node_scores(node_texts(tree, anchored, chunks), queries), "node-scores")
    keyed = passages.select("query_id", "doc_id", "chunk_id", "score")
    routed = route(candidates(tree, scored, keyed), tree, anchored, scored, keyed)
    return fuse(routed, passages, tree, limit, fallback)


def walked(nodes: DataFrame, most_depth: int = 16) -> DataFrame:
    """``nid, depth, path array<string>, place``: nodes (``nid, parent, name``) from those without a parent down, by recursion; ``path`` holds the names on the way.

    ``place`` counts in depth-first order, siblings by name. What no root leads to is not reached; a way of more than ``most_depth`` steps, as of a cycle, is an error.
    """
    found = nodes.sparkSession.sql(
        f"""WITH RECURSIVE w(nid, depth, path) MAX RECURSION LEVEL {most_depth + 1} AS (
            SELECT nid, 0, array(name) FROM {{nodes}} WHERE parent IS NULL
            UNION ALL SELECT n.nid, w.depth + 1, array_append(w.path, n.name) FROM {{nodes}} n JOIN w ON n.parent = w.nid
        ) SELECT nid, depth, path FROM w""",
        nodes=nodes,
    )
    return numbered(found, ["path", "nid"]).select("nid", "depth", "path", F.col("_n").cast("long").alias("place"))
