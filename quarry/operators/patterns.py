"""Many literal patterns in many texts, whatever the case, without comparing every pattern with every text.

A pattern that stands in a text brings its inner words along as whole words: runs without white space, with white space on either side in
the pattern itself. So each pattern is joined with the texts by its rarest inner word, and only the texts that hold it are searched. A
pattern without an inner word (one or two words) can begin or end within a word of the text; it is joined with the vocabulary of the texts by the first
three letters of its longest word, and from there with the texts. Which patterns and texts meet depends on these words alone; whether one holds the other
is then tested on the whole text.

Blank patterns match nothing; null texts hold nothing; equal patterns with different ids each have their rows. Case is folded by ``lower``, and places count code points of
the folded text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.storage import broadcast_if_small, written

SPACE = r"\s+"
#: Letters of a word by which patterns without an inner word meet the vocabulary.
GRAM = 3


def _words(low: Column) -> Column:
    return F.filter(F.split(low, SPACE), lambda w: w != "")


def _literal(pattern: Column) -> Column:
    """A regular expression for just these characters."""
    return F.concat(F.lit(r"\Q"), F.replace(pattern, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _grams(word: Column, size: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - (size - 1)), lambda i: F.substring(word, i, F.lit(size))))


def holding(parts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``id, word``: the words of a vocabulary (``word``, each once) that hold a part (``id, part``)."""
    met = []
    for size in range(1, GRAM + 1):
        of_size = parts.where(F.length("part") == size) if size < GRAM else parts.where(F.length("part") >= size)
        by_gram = broadcast_if_small(written(of_size.select("id", "part", F.substring("part", 1, size).alias("gram")), "parts"))
        grams = vocabulary.where(F.length("word") >= size).select("word", F.explode(_grams(F.col("word"), size)).alias("gram"))
        met.append(grams.join(by_gram, "gram").where(F.contains("word", "part")).select("id", "word").distinct())
    return reduce(DataFrame.unionByName, met)


def candidates(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """``id, key``: patterns (``id, low``) and the texts (``key, low``) that can hold them."""
    words = texts.select("key", F.explode(F.array_distinct(_words(F.col("low")))).alias("word"))
    inner = F.array_distinct(_words(F.regexp_extract("low", r"(?s)^\S*\s+(.*)\s\S*$", 1)))
    cut = written(patterns.where(F.trim(F.regexp_replace("low", SPACE, " ")) != "").select("id", inner.alias("inner"), _words(F.col("low")).alias("words")), "patterns")
    placed = cut.select("id", F.explode("inner").alias("word"))
    postings = written(words.join(broadcast_if_small(written(placed.select("word").distinct(), "inner-words")), "word", "left_semi"), "inner-postings")
    counts = postings.groupBy("word").agg(F.count("*").alias("n"))
    whole = placed.select("id").distinct()
    # A pattern with an inner word that no text holds stands nowhere.
    rarest = placed.join(counts, "word", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("rare")).where("rare.n > 0")
    out = postings.join(broadcast_if_small(written(rarest.select("id", F.col("rare.word").alias("word")), "anchors")), "word").select("id", "key")

    longest = F.array_sort(F.transform("words", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    short = written(cut.join(whole, "id", "left_anti").select("id", F.get(longest, F.lit(0))["w"].alias("part")), "short-patterns")
    if not short.isEmpty():
        met = broadcast_if_small(written(holding(short, written(words.select("word").distinct(), "vocabulary")), "short-words"))
        out = out.unionByName(words.join(met, "word").select("id", "key"))
    return out.distinct()


def occurrences(patterns: DataFrame, texts: DataFrame, pattern_id: str = "pattern_id", pattern: str = "pattern", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``pattern_id, key, n, first, last``: how often each pattern stands in each text that holds it (leftmost, not overlapping), the start of its first and the end of its last place."""
    p = patterns.select(F.col(pattern_id).alias("id"), F.lower(pattern).alias("low")).where(F.col("low").isNotNull())
    t = texts.select(F.col(key).alias("key"), F.lower(text).alias("low")).where(F.col("low").isNotNull())
    pairs = written(candidates(p, t), "pattern-candidates")
    wanted = broadcast_if_small(written(pairs.join(p.withColumnRenamed("low", "sought"), "id"), "sought"))
    met = t.join(wanted, "key").where(F.contains("low", "sought"))
    pieces = met.select("id", "key", F.length("low").alias("size"), F.split("low", _literal(F.col("sought")), -1).alias("pieces"))
    first, last = F.length(F.get("pieces", F.lit(0))), F.col("size") - F.length(F.element_at("pieces", -1))
    return pieces.select(F.col("id").alias(pattern_id), F.col("key").alias(key), (F.size("pieces") - 1).cast("long").alias("n"), first.cast("long").alias("first"), last.cast("long").alias("last"))


def spans_of_all(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, n_patterns, first, last``: from the first place of any pattern to the end of the last of any."""
    return found.groupBy(key).agg(F.count("*").alias("n_patterns"), F.min("first").alias("first"), F.max("last").alias("last"))


def regex_span(text: Column, expression: str) -> Column:
    """``struct<first, last>``: from the start of the first match to the end of the last; null without a match."""
    pieces = F.split(text, expression, -1)
    first, last = F.length(F.get(pieces, F.lit(0))), F.length(text) - F.length(F.element_at(pieces, -1))
    return F.when(F.size(pieces) > 1, F.struct(first.alias("first"), last.alias("last")))


def anchors(members: DataFrame, passages: DataFrame) -> DataFrame:
    """``name, passage, first``: members (``name, declared``) at a passage (``passage, text``) that names them: the declared one if it does, else the first; members that none names go."""
    found = occurrences(members.select("name").distinct(), passages, "name", "name", "passage", "text")
    best = F.min(F.struct((F.col("declared") != F.col("passage")).alias("other"), "passage", "first")).alias("b")
    declared = members.select("name", F.coalesce("declared", F.lit(-1)).alias("declared"))
    return found.join(declared, "name").groupBy("name", "declared").agg(best).select("name", F.col("b.passage").alias("passage"), F.col("b.first").alias("first"))
