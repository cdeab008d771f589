"""Operator 9: quality rules with risk-controlled thresholds (DataFrame functions only).

Every text is measured once, inside its own row: sorting the text's own word triples takes the place of any shuffle.
The measures feed a family of rule sets of growing strictness. For each stratum the labelled documents are counted
under every level; the strictest level is taken up to which the rate of good documents rejected is, by the exact
binomial bound, at most ``max_false_rejection``. Levels are tested in a fixed sequence from the mildest (the first that
fails ends the sequence, which keeps the error rate without a further correction) and strata are corrected for by
Bonferroni. No rule rejects anything in a stratum without enough labels to prove a level safe.

A trial of the bound is a labelled text, not a row: copies and repeated rows would count the same trial twice. The rules are
given beforehand and not fitted, so that all labelled texts serve as the holdout.

Edge cases: a null or empty text has no words, so the base rules reject it; a null stratum value is a stratum of its own;
labels of unknown documents and null labels count for nothing; a document labelled more than once, or a text under several keys, counts as
good only if no label says otherwise; repeated rows get a row each; texts of any length are measured whole; an empty table gives an empty
result. Columns other than key, text and strata are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, table, text_of, written

#: Fixed: the blanks that end a word, and the characters that count as symbols.
BLANKS = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: The mildest value of each rule's cutoff and the strictest; the levels lie between on a geometric scale.
RULES = {
    "symbol_share": (1.0, 0.02),
    "dup_line_share": (0.9, 0.3),
    "repeat_share": (0.5, 0.2),
    "capital_share": (0.9, 0.3),
}
LEVELS = 10


def cutoff(rule: str, level: int) -> float:
    mild, strict = RULES[rule]
    return mild * (strict / mild) ** (level / (LEVELS - 1))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the array of words."""
    n = F.size(words)
    m = F.greatest(n - 2, F.lit(0))
    windows = F.sort_array(F.arrays_zip(F.slice(words, 1, m).alias("a"), F.slice(words, 2, m).alias("b"), F.slice(words, 3, m).alias("c"), F.sequence(F.lit(0), m - 1).alias("i")))

    def pairs(s: Column) -> Column:
        """Neighbours in sorted order with the same words."""
        zipped = F.arrays_zip(F.slice(s, 1, m - 1).alias("x"), F.slice(s, 2, F.greatest(m - 1, F.lit(0))).alias("y"))
        return F.filter(zipped, lambda p: (p["x"]["a"] == p["y"]["a"]) & (p["x"]["b"] == p["y"]["b"]) & (p["x"]["c"] == p["y"]["c"]))

    def covered(p: Column) -> Column:
        at = F.array_sort(F.array_distinct(F.concat(F.transform(p, lambda q: q["x"]["i"]), F.transform(p, lambda q: q["y"]["i"]))))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(at, start, lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

    return F.when(n >= 4, _let(_let(windows, pairs), covered)).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame, keep: tuple[str, ...], text: str = "text", strata: tuple[str, ...] = ("lang",)) -> DataFrame:
    """The columns ``keep``, the stratum, the base measures and the rules' measures of every whole text."""
    t = docs.select(*keep, *[F.coalesce(F.col(s).cast("string"), F.lit("")).alias(f"stratum_{k}") for k, s in enumerate(strata)], text_of(text).alias("t"))
    trimmed = F.btrim("t", F.lit(BLANKS))
    t = t.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP)))
    t = t.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    measures = [
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.xxhash64("t").alias("fingerprint"),
    ]
    strata_out = [f"stratum_{k}" for k in range(len(strata))]
    out = t.select(*keep, *strata_out, *measures)
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return out.select(
        *keep,
        F.concat_ws("\x1f", *strata_out).alias("stratum"),
        "fingerprint",
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / words).alias("symbol_share"),
        (F.col("n_dup_lines") / lines).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("n_capitals") / chars).alias("capital_share"),
    )


def rejects(level: int) -> Column:
    """Whether the rule set of a level rejects a measured document."""
    out = F.lit(False)
    for rule in RULES:
        out = out | (F.col(rule) > cutoff(rule, level))
    return out


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), to double precision: terms downward from k until they no longer count."""
    if k >= n:
        return 1.0
    mode = min(k, int(n * p))
    total, log_p, log_q = 0.0, math.log(p), math.log1p(-p)
    for way in (range(mode, -1, -1), range(mode + 1, k + 1)):
        for j in way:
            term = math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * log_p + (n - j) * log_q)
            total += term
            if term < 1e-17 * total or term == 0.0:
                break
    return min(total, 1.0)


def choose_levels(counts: list[dict], max_false_rejection: float, error: float) -> dict[str, int]:
    """Stratum -> its strictest proven level. ``counts``: for each stratum ``good`` and ``rejected_0`` .. of the good."""
    share, chosen = error / max(1, len(counts)), {}
    for row in counts:
        for level in range(LEVELS):
            if binomial_tail(row[f"rejected_{level}"], row["good"], max_false_rejection) > share:
                break
            chosen[row["stratum"]] = level
    return chosen


def learn_levels(measured: DataFrame, labels: DataFrame, key: str, label: str, max_false_rejection: float, error: float) -> dict[str, int]:
    """Stratum -> level, from all labelled texts among the measured documents."""
    marked = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("label_key")).agg((F.min(label) == 1).alias("good"))
    trials = measured.where(~F.col("base_failed")).join(marked, F.col(key) == F.col("label_key"))
    trials = trials.groupBy("stratum", "fingerprint").agg(F.min("good").alias("good"), *[F.first(rule).alias(rule) for rule in RULES]).where("good")
    counted = trials.groupBy("stratum").agg(F.count("*").alias("good"), *[F.count_if(rejects(level)).alias(f"rejected_{level}") for level in range(LEVELS)])
    # A stratum with fewer labels cannot prove even a rule set that rejects none of them; the rest is at most so many rows.
    least = math.log(error) / math.log1p(-max_false_rejection)
    return choose_levels([r.asDict() for r in counted.where(F.col("good") >= least).collect()], max_false_rejection, error)


def verdict(levels: dict[str, int]) -> Column:
    """Whether a measured document stays."""
    out = F.lit(False)
    for level in sorted(set(levels.values())):
        out = out | (F.col("stratum").isin([s for s, own in levels.items() if own == level]) & rejects(level))
    return ~F.col("base_failed") & ~out


def quality_verdicts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", strata: tuple[str, ...] = ("lang",), max_false_rejection: float = 0.02, error: float = 0.05) -> DataFrame:
    """Measures of every document, ``base_failed`` and ``kept``.

    ``labels``: ``key`` and ``label`` (1: good). The risk is bounded for each stratum: with probability ``1 - error`` over
    the labelled documents, in no stratum more than ``max_false_rejection`` of the good documents that pass the base
    rules are rejected. Texts are measured once; what is written in between are their few numbers.
    """
    measured = written(measure(docs, (key,), text, strata), "quality")
    return measured.withColumn("kept", verdict(learn_levels(measured, labels, key, label, max_false_rejection, error)))


def quality_filter(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", strata: tuple[str, ...] = ("lang",), max_false_rejection: float = 0.02, error: float = 0.05) -> DataFrame:
    """The documents that stay, with their own columns: levels are learned from the labelled ones, then one pass filters all."""
    marked = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("label_key")).distinct()
    marked = broadcast_if_small(written(marked, "labelled"))
    labelled = docs.select(F.col(key), F.col(text), *strata).join(marked, F.col(key) == F.col("label_key"), "left_semi")
    levels = learn_levels(written(measure(labelled, (key,), text, strata), "quality"), labels, key, label, max_false_rejection, error)
    whole = docs.select(F.struct("*").alias("row"), F.col(text).alias("row_text"), *[F.col(s).alias(f"row_{k}") for k, s in enumerate(strata)])
    measured = measure(whole, ("row",), "row_text", tuple(f"row_{k}" for k in range(len(strata))))
    # A filter would be pushed below the measures and work them out again for each time that the verdict names them.
    return measured.select(F.explode(F.array_repeat("row", F.when(verdict(levels), 1).otherwise(0))).alias("row")).select("row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
