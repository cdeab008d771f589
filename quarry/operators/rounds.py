"""Retrieval in rounds for all questions at once.

The state is tables: the open questions with what to search for next, the calls made, and the pool of passages. A round plans calls (the search, and literal
probes for the first missing terms), leaves out those already made, keeps to each question's budget, executes all calls of all questions together, and
measures how many of a question's terms its pool holds. Questions whose pool suffices leave; the others ask again with what is missing, until none is open or the rounds are
over. The driver's loop is over rounds, of which there are few; questions are rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import normalize, terms
from quarry.operators.index import top_k
from quarry.operators.patterns import holding, occurrences
from quarry.operators.stored import TextIndex, bm25
from quarry.storage import broadcast_if_small, written

#: Rounds, calls a question and round, passages a search and a probe, probes a round, share of terms that suffices, missing terms that are named.
ROUNDS, BUDGET, FOUND, PROBED, PROBES, ENOUGH, NAMED = 3, 12, 10, 10, 2, 0.6, 8


def planned_calls(open_questions: DataFrame, probes: int = PROBES) -> DataFrame:
    """``query_id, turn, tool, argument``: a search, and a literal probe for each of the first missing terms (``query_id, search, missing``); blank ones are left out."""
    probe = F.transform(F.slice("missing", 1, probes), lambda t, i: F.struct((i + 1).alias("turn"), F.lit("grep").alias("tool"), F.trim(t).alias("argument")))
    calls = F.concat(F.array(F.struct(F.lit(0).alias("turn"), F.lit("search").alias("tool"), F.trim("search").alias("argument"))), probe)
    rows = open_questions.select("query_id", F.explode(calls).alias("c")).select("query_id", "c.*").where("argument <> ''")
    return rows.groupBy("query_id", "tool", "argument").agg(F.min("turn").alias("turn"))


def not_made(calls: DataFrame, made: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Calls that were not made before (same tool and argument), in turn, up to the budget; a repeat takes nothing from it."""
    fresh = calls.join(made.select("query_id", "tool", "argument"), ["query_id", "tool", "argument"], "left_anti")
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "tool", "argument"))).where(F.col("_n") <= budget).drop("_n")


def inside(rows: DataFrame, scope: DataFrame | None) -> DataFrame:
    """Rows (``query_id, pos``) within the scope (``query_id, pos``) of their question; a question without a scope is not narrowed."""
    if scope is None:
        return rows
    scoped = scope.select("query_id").distinct().withColumn("_scoped", F.lit(True))
    marked = rows.join(scoped, "query_id", "left").join(scope.select("query_id", "pos").distinct().withColumn("_in", F.lit(True)), ["query_id", "pos"], "left")
    return marked.where(F.col("_scoped").isNull() | F.col("_in").isNotNull()).drop("_scoped", "_in")


def changed_scope(scope: DataFrame, found: DataFrame, cleared: DataFrame) -> DataFrame:
    """Scopes after a filter: a question that has set a new one (``query_id, pos``) has that instead of the old, one that has cleared it (``query_id``) none."""
    kept = scope.join(found.select("query_id").distinct(), "query_id", "left_anti").join(cleared.select("query_id").distinct(), "query_id", "left_anti")
    return kept.unionByName(found.join(cleared.select("query_id").distinct(), "query_id", "left_anti").distinct())


def holders(index: TextIndex, arguments: DataFrame, most: int | None = None) -> DataFrame:
    """``argument, pos``: the passages in which arguments stand, whatever the case; of each argument the first ``most`` in stored order, or all.

    An argument that is one index term stands in a text just where it stands in one of the text's terms, so that the stored vocabulary is searched and not the texts; of every term
    that holds it the first passages are enough. Other arguments are looked for in the texts.
    """
    cut = arguments.select("argument", F.lower("argument").alias("low"), terms(F.col("argument")).alias("t"))
    cut = written(cut.select("argument", "low", ((F.size("t") == 1) & (F.get("t", F.lit(0)) == F.col("low"))).alias("one")), "arguments")
    found = []
    single, other = cut.where("one"), cut.where("NOT one").select("argument")
    if not single.isEmpty():
        met = written(holding(single.select(F.col("argument").alias("id"), F.col("low").alias("part")), index.df.select(F.col("term").alias("word"))).withColumnsRenamed({"id": "argument", "word": "term"}), "terms-met")
        of_met = written(met.select("term").distinct(), "terms-holding")
        postings = index.of_terms(of_met)[0].select("term", "pos").join(broadcast_if_small(of_met), "term", "left_semi")
        if most is not None:
            postings = first_of(postings, "term", most)
        found.append(postings.join(broadcast_if_small(met), "term").select("argument", "pos").distinct())
    if not other.isEmpty():
        found.append(occurrences(other, index.chunks.select("pos", "text"), "argument", "argument", "pos", "text").select("argument", "pos"))
    if not found:
        return cut.limit(0).select("argument", F.lit(0).cast("long").alias("pos"))
    out = reduce(DataFrame.unionByName, found)
    return out if most is None else first_of(out, "argument", most)


def first_of(rows: DataFrame, by: str, most: int) -> DataFrame:
    return top_k(rows, most, [F.col("pos")], by, "_n").drop("_n")


def executed(index: TextIndex, calls: DataFrame, scope: DataFrame | None = None, found: int = FOUND, probed: int = PROBED) -> DataFrame:
    """``query_id, turn, place, pos``: what calls return. Searches are ranked within the scope; probes come in stored order."""
    searches = calls.where("tool = 'search'").select("query_id", F.col("argument").alias("query"))
    ranked = top_k(inside(bm25(index, searches), scope), found, [F.desc(F.round("score", 9)), F.col("pos")])
    out = ranked.select("query_id", F.lit(0).alias("turn"), F.col("rank").alias("place"), "pos")
    probes = written(calls.where("tool = 'grep'"), "probes")
    if probes.isEmpty():
        return out
    held = holders(index, probes.select("argument").distinct(), probed if scope is None else None)
    rows = inside(probes.join(held, "argument"), scope)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "argument").orderBy("pos"))).where(F.col("place") <= probed)
    return out.unionByName(rows.select("query_id", "turn", "place", "pos"))


def pooled(pool: DataFrame, index: TextIndex) -> DataFrame:
    """Each passage of a question's pool once, and one of equal texts of a document: the first to arrive (``query_id, arrival, pos``)."""
    once = broadcast_if_small(written(pool.groupBy("query_id", "pos").agg(F.min("arrival").alias("arrival")), "pooled-once"))
    # Only texts of the pool are normalized.
    text = index.chunks.select("pos", "doc_id", "text").join(once.select("pos"), "pos", "left_semi").select("pos", "doc_id", F.md5(normalize(F.col("text"))).alias("_t"))
    first = text.join(once, "pos").withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "doc_id", "_t").orderBy("arrival")))
    return first.where("_n = 1").select("query_id", "arrival", "pos")


def judged(questions: DataFrame, pool: DataFrame, index: TextIndex, enough: float = ENOUGH, named: int = NAMED) -> DataFrame:
    """``query_id, verdict, missing, n_pool``: how far pools hold their questions' terms. An empty pool never suffices, and all terms are missing then."""
    asked = questions.select("query_id", F.posexplode(F.array_distinct(terms(F.col("query")))).alias("at", "term"))
    asked = written(asked, "asked-terms")
    postings, _ = index.of_terms(asked)
    pool = written(pool.select("query_id", "pos"), "pool-judged")
    held = postings.select("term", "pos").join(broadcast_if_small(pool), "pos").select("query_id", "term").distinct().withColumn("there", F.lit(1))
    of_terms = asked.join(held, ["query_id", "term"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("there").alias("n_held"), F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.struct("at", "term")))).alias("m"))
    size = pool.groupBy("query_id").agg(F.count("*").alias("n_pool"))
    rows = questions.select("query_id").join(of_terms, "query_id", "left").join(size, "query_id", "left").withColumn("n_pool", F.coalesce("n_pool", F.lit(0)))
    verdict = F.when(F.col("n_pool") == 0, "insufficient").when(F.col("n").isNull(), "unknown").when(F.col("n_held") / F.col("n") >= enough, "sufficient").otherwise("insufficient")
    missing = F.coalesce(F.col("m.term"), F.array().cast("array<string>"))
    return rows.select("query_id", verdict.alias("verdict"), F.when(F.col("n_pool") == 0, missing).otherwise(F.slice(missing, 1, named)).alias("missing"), F.col("n_pool").cast("long").alias("n_pool"))


def retrieve(index: TextIndex, questions: DataFrame, rounds: int = ROUNDS, budget: int = BUDGET, scope: DataFrame | None = None, found: int = FOUND, probed: int = PROBED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``query_id, rounds, verdict, missing, n_pool``; the pools, ``query_id, arrival, pos``; and the calls, ``query_id, round, turn, tool, argument``.

    ``questions``: ``query_id, query``; ``scope``: ``query_id, pos``, the only passages that count for those questions.
    """
    spark = index.spark
    still = written(questions.select("query_id", "query", F.col("query").alias("search"), F.array().cast("array<string>").alias("missing")), "open")
    made = spark.createDataFrame([], "query_id string, round int, turn int, tool string, argument string")
    pool = index.chunks.limit(0).select(F.lit("").alias("query_id"), F.lit(0).cast("long").alias("arrival"), "pos")
    done: DataFrame | None = None
    for n in range(1, rounds + 1):
        calls = written(not_made(planned_calls(still), made, budget).select("query_id", F.lit(n).alias("round"), "turn", "tool", "argument"), "calls")
        made = written(made.unionByName(calls), "calls-made")
        arriving = executed(index, calls, scope, found, probed).select("query_id", (F.lit(n * 1_000_000) + F.col("turn") * 1000 + F.col("place")).cast("long").alias("arrival"), "pos")
        pool = written(pooled(pool.unionByName(arriving), index), "pool")
        state = written(judged(still.select("query_id", "query"), pool.join(still.select("query_id"), "query_id", "left_semi"), index), "state")
        ended = (F.col("verdict") == "sufficient") | (F.size("missing") == 0) if n < rounds else F.lit(True)
        leaving = state.where(ended).select("query_id", F.lit(n).alias("rounds"), "verdict", "missing", "n_pool")
        done = leaving if done is None else done.unionByName(leaving)
        again = F.concat_ws(" ", "query", F.array_join("missing", " "))
        still = written(still.select("query_id", "query").join(state.where(~ended), "query_id").select("query_id", "query", again.alias("search"), "missing"), "open")
        if n < rounds and still.isEmpty():
            break
    return written(done, "answers-state"), pool, made


def merged(parts: DataFrame, state: DataFrame, pool: DataFrame, index: TextIndex) -> tuple[DataFrame, DataFrame]:
    """What the parts of questions (``question_id, part, query_id``) found, by question: ``question_id, rounds, n_parts, n_sufficient, open_parts, n_pool``, and the merged pools.

    Rounds are those of the part that took the most; parts that don't suffice are named in order; a passage counts once.
    """
    rows = parts.join(state, "query_id", "left")
    order = F.array_sort(F.collect_list(F.when(F.coalesce(F.col("verdict") != "sufficient", F.lit(True)), F.col("part"))))
    of = rows.groupBy("question_id").agg(F.coalesce(F.max("rounds"), F.lit(0)).alias("rounds"), F.count("*").alias("n_parts"), F.count_if(F.col("verdict") == "sufficient").alias("n_sufficient"), order.alias("open_parts"))
    together = pool.join(parts.select("query_id", "question_id", "part"), "query_id").select(F.col("question_id").alias("query_id"), (F.col("part").cast("long") * 1_000_000_000 + F.col("arrival")).alias("arrival"), "pos")
    together = written(pooled(together, index), "merged-pool")
    size = together.groupBy(F.col("query_id").alias("question_id")).agg(F.count("*").alias("n_pool"))
    out = of.join(size, "question_id", "left").withColumn("n_pool", F.coalesce("n_pool", F.lit(0)))
    return out, together.withColumnRenamed("query_id", "question_id")
