"""Evidence pools, coverage, budgets, compression and citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import collapse, gist, normalize, terms
from quarry.operators.patterns import anchors


def pool(arrivals: DataFrame) -> DataFrame:
    """Arrivals (``arrival, doc_id, chunk_id, text``) without repeats: first by identity, then by equal text within a document."""
    identity = F.row_number().over(Window.partitionBy("doc_id", "chunk_id").orderBy("arrival"))
    once = arrivals.withColumn("_i", identity).where("_i = 1").drop("_i")
    content = F.row_number().over(Window.partitionBy("doc_id", normalize(F.col("text"))).orderBy("arrival"))
    return once.withColumn("_c", content).where("_c = 1").drop("_c")


def coverage(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """Share of a question's different terms that its passages hold, and the verdict: ``sufficient`` from six tenths."""
    q = questions.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    p = passages.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct().withColumn("there", F.lit(1))
    found = q.join(p, ["query_id", "term"], "left").groupBy("query_id").agg(F.count("*").alias("n_terms"), F.count("there").alias("n_found"))
    rows = questions.select("query_id").join(found, "query_id", "left")
    share = F.col("n_found") / F.col("n_terms")
    return rows.select("query_id", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("n_found", F.lit(0)).alias("n_found"), F.when(F.col("n_terms").isNull(), "unknown").when(share >= 0.6, "sufficient").otherwise("insufficient").alias("verdict"))


def missing_terms(questions: DataFrame, passages: DataFrame, most: int = 8) -> DataFrame:
    q = questions.select("query_id", F.posexplode(F.array_distinct(terms(F.col("query")))).alias("at", "term"))
    p = passages.select("query_id", F.explode(terms(F.col("text"))).alias("term")).distinct()
    left = q.join(p, ["query_id", "term"], "left_anti")
    return left.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).where(F.col("n") <= most).select("query_id", "term", "n")


def anchor_members(members: DataFrame, passages: DataFrame) -> DataFrame:
    """Members (``name, declared``) at a passage (``passage, text``) that names them: the declared one if it does, else the first that does."""
    return anchors(members, passages).select("name", "passage")


def within_budget(ranked: DataFrame, budget: int, least_room: int = 120, group: str = "query_id", header: Column | None = None, used: int | Column = 0) -> DataFrame:
    """``shown, used, no`` of the passages that fit, in rank order, each behind its ``header`` and with a line feed: until fewer than ``least_room`` bytes are left.

    The passage that does not fit is cut to the bytes left, at a whole character, with an ellipsis, and is the last. ``used``: bytes gone before the first. A budget of 0 sets no limit.
    """
    own = Window.partitionBy(group).orderBy("rank")
    head = F.octet_length(header) if header is not None else F.lit(0)
    rows = ranked.withColumns({"head": head.cast("long"), "size": F.octet_length("text").cast("long"), "no": F.row_number().over(own)})
    before = F.coalesce(F.sum(F.col("head") + F.col("size") + 1).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.lit(budget) - used - before - F.col("head") - 1
    rows = rows.withColumn("room", room if budget > 0 else F.lit(1 << 40))
    # Behind a passage that was cut, and behind the first without room, nothing follows.
    stopped = F.max((F.col("room") < least_room) | (F.col("size") > F.col("room"))).over(own.rowsBetween(Window.unboundedPreceding, -1))
    kept = rows.withColumn("stopped", F.coalesce(stopped, F.lit(False))).where((F.col("room") >= least_room) & ~F.col("stopped")).drop("stopped")
    shown = F.when(F.col("size") <= F.col("room"), F.col("text")).otherwise(F.concat(cut_bytes(F.col("text"), F.col("room")), F.lit("…")))
    return kept.withColumn("shown", shown).withColumn("used", F.octet_length("shown").cast("long")).drop("room", "head", "size")


def cut_bytes(text: Column, most: Column) -> Column:
    """The first characters of a text, ``most`` at most (a character counts one here, whatever its bytes)."""
    return F.left(text, most.cast("int"))


def evidence_block(questions: DataFrame, ranked: DataFrame, budget: int, record: Column | None = None, opening: Column | None = None) -> DataFrame:
    """``query_id, block, n_shown, n_omitted``: question, enumeration record, numbered passages (``query_id, rank, doc_id, text`` and ``page_num``) within the budget, and how many were left out. ``opening``: all
    that stands before the passages, in other words."""
    opening = opening if opening is not None else F.concat(F.lit("Question: "), "query", F.lit("\n\n"), F.coalesce(F.concat(record, F.lit("\n")), F.lit("")) if record is not None else F.lit(""), F.lit("Evidence:\n"))
    asked = questions.select("query_id", opening.alias("opening"))
    page = F.col("page_num") if "page_num" in ranked.columns else F.lit(1)
    header = F.format_string("[%d] (%s p.%d) ", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")), F.col("doc_id").cast("string"), page)
    rows = ranked.join(asked, "query_id").withColumns({"header": header, "text": collapse(F.col("text"))})
    fit = within_budget(rows, budget, header=F.col("header"), used=F.octet_length("opening"))
    told = fit.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("no", F.concat("header", "shown", F.lit("\n")).alias("t")))).alias("p"))
    counts = ranked.groupBy("query_id").agg(F.count("*").alias("n"))
    out = asked.join(counts, "query_id", "left").join(told, "query_id", "left")
    shown, n = F.coalesce(F.size("p"), F.lit(0)), F.coalesce("n", F.lit(0))
    shown = F.greatest(shown, F.lit(0))
    note = F.when(shown < n, F.format_string("\n(%d of %d passage(s) omitted to fit the context window.)\n", n - shown, n)).otherwise(F.lit(""))
    block = F.concat("opening", F.coalesce(F.array_join("p.t", ""), F.lit("")), note)
    return out.select("query_id", block.alias("block"), shown.cast("long").alias("n_shown"), (n - shown).cast("long").alias("n_omitted"))


def prompt_budget(context_tokens: int = 8192, reserved: int = 1280, chars_a_token: int = 3, least: int = 512) -> int:
    """Characters of evidence that fit into a context window beside prompt and answer."""
    return max((context_tokens if context_tokens > 0 else 8192) - reserved, least) * chars_a_token


def compression_plan(rank: Column, text: Column, whole: int = 4, chars: int = 240) -> Column:
    """The first passages and short ones whole, of the others the gist."""
    return F.when((rank <= whole) | (F.length(text) < 2 * chars), text).otherwise(gist(text, chars))


def interleave(lists: DataFrame, limit: int, distinct: bool = True) -> DataFrame:
    """Round robin over ``query_id, list_no, rank, doc_id``; with ``distinct`` a document counts where it comes first."""
    if distinct:
        first = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank", "list_no"))
        lists = lists.withColumn("_f", first).where("_f = 1").drop("_f")
    return lists.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "list_no"))).where(F.col("place") <= limit)


def best_passages(hits: DataFrame) -> DataFrame:
    """Of each document the passage with the most different query terms, the first of them."""
    n = F.size(F.array_intersect(F.array_distinct(terms(F.col("text"))), F.array_distinct(terms(F.col("query")))))
    rows = hits.withColumn("n_terms", n).where("n_terms > 0")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("n_terms"), "pos"))).where("_n = 1").drop("_n")


def handles(cited: DataFrame) -> DataFrame:
    """A number for each id in the order of its first citation (``answer_id, at, id``), from zero."""
    first = cited.groupBy("answer_id", "id").agg(F.min("at").alias("at"))
    return first.withColumn("handle", F.row_number().over(Window.partitionBy("answer_id").orderBy("at", "id")) - 1)


def cited_ids(answer: Column) -> Column:
    """Ids in markers like ``[ID:3]`` or ``[ID:1, ID:2]``, first seen first."""
    marks = F.regexp_extract_all(answer, F.lit(r"\[ID:\s*\d+(?:\s*,\s*(?:ID:)?\s*\d+)*\]"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(marks, lambda m: F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0)))))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def decision(scores: Column, temperature: float = 1.0) -> Column:
    """``probs array<double>, confidence``: softmax, and one less its entropy over that of even odds."""
    shifted = _with(F.array_max(scores), lambda top: F.transform(scores, lambda s: F.exp((s - top) / temperature)))
    probs = _with(shifted, lambda e: _with(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total)))

    def judged(p: Column) -> Column:
        entropy = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0))
        return F.struct(p.alias("probs"), F.when(F.size(p) > 1, 1 - entropy / F.log(F.size(p).cast("double"))).otherwise(1.0).alias("confidence"))

    return _with(probs, judged)
