"""How good retrieval is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.prefix import numbered

from quarry.functions.text import content_tokens, grams, normalize

#: Words that carry no fact, and the phrases of a refusal.
STOP_WORDS = ["the", "and", "for", "that", "with", "from", "this", "have", "has", "was", "were", "are", "not", "but", "its", "their", "they", "which", "while", "into", "than", "then", "over", "about", "after", "before", "been", "other"]
REFUSAL = r"(?i)(no information|not (?:mentioned|stated|found|available|enough)|does not (?:say|mention|contain)|cannot (?:be )?(?:answer|determin)|insufficient|没有(?:相关)?(?:信息|内容|提及)|无法(?:回答|确定)|未(?:提及|说明)|不足以)"


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, one blank between."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def fact_found(fact: Column, passage: Column, share: float = 0.8) -> Column:
    """The passage holds the fact word for word, or eight tenths of its content words."""
    words = content_tokens(fact, STOP_WORDS)
    covered = F.size(F.array_intersect(words, F.split(plain_words(passage), " "))) / F.size(words)
    return (plain_words(fact) != "") & (F.contains(plain_words(passage), plain_words(fact)) | ((F.size(words) > 0) & (covered >= share)))


def joined_passages(hits: DataFrame) -> DataFrame:
    """``query_id, doc_id, text``: every passage, and all passages of a document one after the other, so that a fact outlives a chunk's end."""
    whole = hits.groupBy("query_id", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", plain_words(F.col("text")).alias("t")))), lambda x: x["t"]), " ").alias("text"))
    return hits.select("query_id", "doc_id", "text").unionByName(whole)


def refusal_rate(answers: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """Share of answers that refuse."""
    return answers.groupBy(*by).agg((F.count_if(F.col(text).rlike(REFUSAL)) / F.count("*")).alias("rate"), F.count("*").alias("n"))


def recall_summary(rows: DataFrame) -> DataFrame:
    """Of ``type, cut, recall, seconds``: by cut and type, and over all types (type null), mean recall, questions found whole and missed, median time."""
    return rows.rollup("cut", "type").agg(F.avg("recall").alias("recall"), F.count_if(F.col("recall") >= 1).alias("complete"), F.count_if(F.col("recall") <= 0).alias("missed"), F.percentile("seconds", 0.5).alias("median_s")).where(F.col("cut").isNotNull())


def channel_difference(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """``query_id, only_a, only_b``: how many documents one channel's first ``k`` (``query_id, doc_id, rank``) has and the other's has not."""
    in_a, in_b = (x.where(F.col("rank") <= k).select("query_id", "doc_id").distinct() for x in (a, b))
    rows = in_a.exceptAll(in_b).withColumn("side", F.lit("a")).unionByName(in_b.exceptAll(in_a).withColumn("side", F.lit("b")))
    return rows.groupBy("query_id").agg(F.count_if(F.col("side") == "a").alias("only_a"), F.count_if(F.col("side") == "b").alias("only_b"))


def acceptance(pairs: DataFrame, noise: float, least_null: int = 5) -> DataFrame:
    """``verdict`` of each candidate scorecard beside its baseline: ``quality, base_quality, lost, base_lost, failed, refusal, base_refusal, n_null,
    violations, base_violations``. What was not measured on the same questions is not decided."""
    new = F.size(F.array_except("violations", "base_violations")) > 0
    verdict = (
        F.when(F.col("failed") > 0, "unusable")
        .when(F.col("lost") > F.greatest("base_lost", F.lit(1)), "incomplete")
        .when(F.col("quality").isNull() | F.col("base_quality").isNull(), "not measured")
        .when(F.col("quality") < F.col("base_quality") + noise, "within noise")
        .when((F.col("n_null") >= least_null) & (F.col("refusal") < F.col("base_refusal")), "refuses less")
        .when(new, "new violations")
        .otherwise("accepted")
    )
    return pairs.withColumn("verdict", verdict)


def recall_at(ranked: DataFrame, gold: DataFrame, cuts: list[int]) -> DataFrame:
    """``query_id, cut, recall`` of ranked documents (``query_id, doc_id, rank``) against gold ones."""
    best = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    rows = gold.join(best, ["query_id", "doc_id"], "left").select("query_id", "rank", F.explode(F.array(*map(F.lit, cuts))).alias("cut"))
    return rows.groupBy("query_id", "cut").agg((F.count_if(F.col("rank") <= F.col("cut")) / F.count("*")).alias("recall"))


def gram_coverage(evidence: DataFrame, corpus: DataFrame, n: int = 5) -> DataFrame:
    """Share of the different ``n``-grams of each evidence text that stand in the corpus."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("tokens")
    distinct_grams = F.explode(F.array_distinct(grams(F.col("tokens"), n))).alias("gram")
    # Tokens are a column of their own: inside the gram's expression they would be cut anew for every gram.
    asked = evidence.select("item_id", tokens).select("item_id", distinct_grams)
    wanted = asked.select("gram").distinct()
    there = corpus.select(tokens).select(distinct_grams).join(wanted, "gram", "left_semi").distinct().withColumn("there", F.lit(1))
    found = asked.join(there, "gram", "left").groupBy("item_id").agg(F.count("*").alias("n_grams"), F.count("there").alias("n_found"))
    return evidence.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("n_grams", F.lit(0)).alias("n_grams"), F.coalesce("n_found", F.lit(0)).alias("n_found"))


def failure_class(in_corpus: Column, retrieved: Column, floor: float = 0.15) -> Column:
    return F.when(in_corpus < floor, "not in corpus").when(retrieved < floor, "not retrieved").otherwise("answerable")


def stratified_split(rows: DataFrame, stratum: str, key: str, share: float = 0.5) -> DataFrame:
    """The first part of each stratum by key goes to ``dev``, the rest to ``test``."""
    n = F.count("*").over(Window.partitionBy(stratum))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(key))
    return rows.withColumn("split", F.when(place <= F.ceil(n * share), "dev").otherwise("test"))


def every_so_often(rows: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` rows at even distances in a given order."""
    counted = numbered(rows, [order])
    total = counted.agg(F.count("*").alias("_total"))
    wanted = total.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("_total") / n) + 1)).alias("_n")).distinct()
    return counted.join(F.broadcast(wanted), "_n").drop("_n")  # n rows


def metric_means(rows: DataFrame, *metrics: str) -> DataFrame:
    """One row: of each metric its mean and ``<metric>_missing``, how many are null or no number (which count as missing), and ``quality_macro``, the mean of the means, null if one is."""
    value = {m: F.when(~F.isnan(m), F.col(m)) for m in metrics}
    out = rows.agg(*[F.avg(c).alias(m) for m, c in value.items()], *[F.count_if(c.isNull()).alias(f"{m}_missing") for m, c in value.items()])
    return out.withColumn("quality_macro", quality_macro(*[F.col(m) for m in metrics]))


def quality_macro(*metrics: Column) -> Column:
    """The mean of all metrics; null if one is missing or no number."""
    total = F.lit(0.0)
    for m in metrics:
        total = total + F.when(~F.isnan(m), m)
    return F.round(total / len(metrics), 4)


def violations(records: DataFrame, most: int = 200) -> DataFrame:
    """``id, violation``: answers at length (``id, answer, n_contexts``) from an empty pool."""
    empty = (F.coalesce("n_contexts", F.lit(0)) == 0) & (F.length("answer") > most)
    return records.where(empty).select("id", F.concat(F.col("id").cast("string"), F.lit(": answered at length from an empty pool")).alias("violation"))


def modal_length(answers: DataFrame, text: str = "text", least: int = 3000) -> DataFrame:
    """One row ``length, n, n_answers, extractive``: the commonest length of answers (the least of equals; a null one has none) and whether it
    looks like evidence handed on as it was: four answers or more, at least half of them of one length from ``least`` characters."""
    counts = answers.groupBy(F.coalesce(F.length(text), F.lit(0)).alias("length")).agg(F.count("*").alias("n"))
    best = counts.agg(F.max(F.struct("n", -F.col("length"))).alias("top"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_answers"))
    length, n = -F.col("top")["col2"], F.col("top")["n"]
    extractive = (F.col("n_answers") >= 4) & (length >= least) & (2 * n >= F.col("n_answers"))
    return best.select(length.alias("length"), n.alias("n"), "n_answers", F.coalesce(extractive, F.lit(False)).alias("extractive"))


def shown_contexts(contexts: Column, most: int = 0, chars: int = 0) -> Column:
    """The first passages that hold anything, each cut to ``chars`` code points; zero sets no limit."""
    kept = F.filter(contexts, lambda x: x != "")
    kept = F.slice(kept, 1, most) if most > 0 else kept
    return F.transform(kept, lambda x: F.substring(x, 1, chars)) if chars > 0 else kept


def balanced_sample(rows: DataFrame, stratum: str, key: str, per_class: int, seed: int = 0) -> DataFrame:
    """As many rows of each class, the first by a digest of key and seed: the same draw wherever it is made."""
    order = [F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)]
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= per_class)


def tool_calls(calls: DataFrame, tool: str = "tool", failed: str = "failed", ms: str = "ms") -> DataFrame:
    """``tool, n_calls, n_errors, total_ms`` of a log of calls."""
    return calls.groupBy(F.col(tool).alias("tool")).agg(F.count("*").alias("n_calls"), F.count_if(F.col(failed)).alias("n_errors"), F.coalesce(F.sum(ms), F.lit(0)).alias("total_ms"))


def prompt_stats(passages: DataFrame, *by: str) -> DataFrame:
    """Of ``raw, shown`` by ``by``: passages, how many stand whole or compressed, their characters, and how many raw ones a shown one stands for."""
    whole = F.col("raw") == F.col("shown")
    sums = passages.groupBy(*by).agg(F.count("*").alias("passages"), F.count_if(whole).alias("expanded"), F.count_if(~whole).alias("compressed"), F.coalesce(F.sum(F.length("shown")), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.length("raw")), F.lit(0)).alias("chars_raw"))
    return sums.withColumn("ratio", F.when(F.col("chars") > 0, F.col("chars_raw") / F.col("chars")).otherwise(1.0))
