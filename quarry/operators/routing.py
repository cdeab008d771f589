"""Question routing and the directory tree over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases that mark a question of several parts.
CUES = [
    "以及", "并且", "分别", "对比", "比较", "哪些", "哪几", "几篇", "几项", "都有谁", "各自", "介绍一下这几", "详细", "列表",
    " vs ", " versus ", "compare", "difference between", "differences between", "list all", "each of", "respectively",
]


def route(question: Column) -> Column:
    """``complex`` for two question marks, a cue or more than forty characters, else ``simple``."""
    marks = F.length(question) - F.length(F.regexp_replace(question, "[?？]", ""))
    cue = F.lit(False)
    for c in CUES:
        cue = cue | F.contains(F.lower(question), F.lit(c))
    return F.when((marks >= 2) | cue | (F.length(question) > 40), "complex").otherwise("simple")


#: What an answer holds and a query does not.
ANSWER_MARKERS = ["http://", "https://", "**", "sources:", "source:", "references:", "citation", "according to"]


def query_guard(query: Column) -> Column:
    """Whether a text is shaped like a query: neither blank nor long, and without a mark of an answer."""
    words = F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))
    marked = F.lit(False)
    for m in ANSWER_MARKERS:
        marked = marked | F.contains(F.lower(query), F.lit(m))
    return (F.length(F.trim(query)) > 0) & (F.length(query) <= 200) & (words <= 24) & ~marked


def path_nodes(docs: DataFrame) -> DataFrame:
    """Folders of ``doc_id, path``: for each folder its parent, level, and the documents below it."""
    parts = docs.select("doc_id", F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1).alias("p"))
    below = parts.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("p")), lambda i: F.slice("p", 1, i))).alias("folder"))
    node = below.select("doc_id", F.array_join("folder", "/").alias("nid"), F.size("folder").alias("level"), F.when(F.size("folder") > 0, F.array_join(F.slice("folder", 1, F.size("folder") - 1), "/")).alias("parent"))
    return node.groupBy("nid", "level", "parent").agg(F.countDistinct("doc_id").alias("n_docs"))


def keywords(term_counts: DataFrame, group: str, n_docs: int | Column, most: int = 12) -> DataFrame:
    """The terms of each group with the most weight, ``group, term, tf, df``."""
    weight = F.col("tf") * F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rows = term_counts.withColumn("weight", weight)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round("weight", 9)), "term"))).where(F.col("rank") <= most)


def node_scores(members: DataFrame, scores: DataFrame) -> DataFrame:
    """A node scores as its best document; which one that is comes along."""
    best = F.min_by("doc_id", F.struct(-F.round("score", 9), "doc_id")).alias("best_doc")
    return members.join(scores, "doc_id").groupBy("query_id", "nid").agg(F.max("score").alias("score"), best)
