"""Operator 12: license scans by voting on diagonals (DataFrame functions only).

Every text is cut into words once. The hash of each two words that follow one another, with that of three, is joined with the places where
the templates have it (a bounded table of our own, broadcast). A hit votes for its diagonal: its place in the text less its place in the template.
Diagonals of a text and template that lie close to one another are merged, as words put in or left out move what follows to the next
diagonal. A merged span is verified: the words at its hits are the template's words, they cover a given share of the template,
and the span is not much longer than the template. Phrases are templates of two or three words that have to be covered whole, each place by itself.

Edge cases: null and empty texts have no words and no spans; texts are told apart by key and text, so that repeated keys with different texts each get their own
row and repeated rows equal ones; null keys are kept; an empty table gives an empty result; texts of any length, also those that hold one
line many times, are read whole, and a hit doesn't carry its text. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, table, text_of, written
from quarry.llm.decontaminate import words

# Phrases and texts of licenses, by label. Texts of a template are words as the operator cuts them.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
TEXTS = [
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Words of a text's template that a span has to cover, and words between merged diagonals, as shares of the template.
LEAST_COVER, DRIFT = 0.8, 0.125
#: The place that stands for a text as a whole, once for each, and the template that it meets.
WHOLE = -1


def templates(spark: SparkSession, phrases: list[tuple[str, str]], texts: list[tuple[str, str]]) -> DataFrame:
    """``template, label, phrase, size, drift, k, place, first, next, two, three``: a row for each place where a template has ``k`` words in a row."""
    rows = [(n, label, n < len(phrases), text) for n, (label, text) in enumerate(phrases + texts)]
    t = spark.createDataFrame(rows, "template int, label string, phrase boolean, text string").withColumn("words", words())
    k = F.when(F.col("phrase"), 2).otherwise(3)
    places = t.select("template", "label", "phrase", "words", F.size("words").alias("size"), k.alias("k"), F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("place"))
    drift = F.when(F.col("phrase"), 0).otherwise(F.floor(F.col("size") * DRIFT)).cast("int")
    out = places.select("template", "label", "phrase", "size", drift.alias("drift"), "k", "place", *_gram(F.col("words"), F.col("place")))
    whole = spark.range(1).select(F.lit(WHOLE).alias("template"), F.lit("").alias("label"), F.lit(False).alias("phrase"), F.lit(0).alias("size"), F.lit(0).alias("drift"), F.lit(2).alias("k"), F.lit(WHOLE).alias("place"), *_whole())
    return out.unionByName(whole)


def _gram(w: Column, i: Column) -> list[Column]:
    """The word at a place, the next, and the hashes of two and of three words from there on."""
    first, after, third = (F.coalesce(F.get(w, i + k), F.lit("")) for k in range(3))
    return [first.alias("first"), after.alias("next"), F.xxhash64(first, after).alias("two"), F.xxhash64(first, after, third).alias("three")]


def _whole() -> list[Column]:
    return [F.lit("").alias("first"), F.lit("").alias("next"), F.xxhash64(F.lit(""), F.lit("")).alias("two"), F.xxhash64(F.lit(""), F.lit(""), F.lit("")).alias("three")]


def gram_hits(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``k, f, n_words, at, template, label, phrase, size, drift, gram, place, same``, stored: where texts and templates have words in common.

    ``k``: the key, ``f``: a hash of the text; each text has one row of template ``WHOLE``. ``same``: the words, not their hashes alone, are equal.
    """
    d = docs.select(F.col(key).alias("k"), F.xxhash64(text_of(text)).alias("f"), words(text).alias("w"))
    grams = F.transform("w", lambda _, i: F.struct(i.alias("at"), *_gram(F.col("w"), i)))
    each = d.select("k", "f", F.size("w").cast("long").alias("n_words"), F.explode(F.concat(F.array(F.struct(F.lit(WHOLE).alias("at"), *_whole())), grams)).alias("g"))
    each = each.select("k", "f", "n_words", "g.*")
    t = F.broadcast(known.withColumnsRenamed({c: f"t_{c}" for c in ("first", "next", "two", "three")}))
    met = (F.col("two") == F.col("t_two")) & ((F.col("k_words") == 2) | (F.col("three") == F.col("t_three"))) & ((F.col("at") == WHOLE) == (F.col("place") == WHOLE))
    found = each.join(t.withColumnRenamed("k", "k_words"), met)
    same = (F.col("first") == F.col("t_first")) & (F.col("next") == F.col("t_next"))
    return written(found.select("k", "f", "n_words", "at", "template", "label", "phrase", "size", "drift", F.col("k_words").alias("gram"), "place", same.alias("same")), "license-hits")


def license_spans(hits: DataFrame, least: float = LEAST_COVER) -> DataFrame:
    """``k, f, label, phrase, start, end, cover``: the verified spans of words (end exclusive) and the share of the template that each covers."""
    own = ["k", "f", "template", "label", "phrase", "size", "drift", "gram"]
    votes = hits.where((F.col("template") != WHOLE) & F.col("same")).select(*own, (F.col("at") - F.col("place")).alias("diagonal"), "at", "place").distinct()
    lines = votes.groupBy(*own, "diagonal").agg(F.collect_list("place").alias("places"), F.min("at").alias("start"), (F.max("at") + F.first("gram")).alias("end"))
    by = Window.partitionBy("k", "f", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > F.col("drift"), F.lit(True))
    lines = lines.withColumn("apart", apart.cast("int")).withColumn("group", F.sum("apart").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = lines.groupBy(*own, "group").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("start").alias("start"), F.max("end").alias("end"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("gram") - 1)))))
    merged = merged.withColumn("cover", covered / F.col("size"))
    enough = F.col("cover") >= F.when(F.col("phrase"), 1.0).otherwise(least)
    return merged.where(enough & (F.col("end") - F.col("start") <= F.col("size") + 2 * F.col("drift"))).select("k", "f", "label", "phrase", "start", "end", "cover")


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: list[tuple[str, str]] = PHRASES, texts: list[tuple[str, str]] = TEXTS, least: float = LEAST_COVER) -> DataFrame:
    """``key, n_words, n_phrases, first_word, last_word, phrase_labels, labels, cover`` of every text.

    ``n_phrases``: places of phrases, the first and last of which begin at the given words; ``labels``: of phrases and texts; ``cover``: the greatest share of a template.
    """
    hits = gram_hits(docs, templates(docs.sparkSession, phrases, texts), key, text)
    where = lambda c: F.when(F.col("phrase"), F.col(c))
    found = license_spans(hits, least).groupBy(F.col("k").alias("its_k"), F.col("f").alias("its_f")).agg(
        F.count_if("phrase").alias("n_phrases"), F.min(where("start")).alias("first_word"), F.max(where("start")).alias("last_word"),
        F.array_sort(F.collect_set(where("label"))).alias("phrase_labels"), F.array_sort(F.collect_set("label")).alias("labels"), F.max("cover").alias("cover"))
    out = hits.where(F.col("template") == WHOLE).select("k", "f", "n_words").join(broadcast_if_small(written(found, "licenses")), F.col("k").eqNullSafe(F.col("its_k")) & (F.col("f") == F.col("its_f")), "left")
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    places = [F.col(c).cast("long").alias(c) for c in ("first_word", "last_word")]
    return out.select(F.col("k").alias(key), "n_words", F.coalesce("n_phrases", zero).alias("n_phrases"), *places, F.coalesce("phrase_labels", none).alias("phrase_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("cover", F.lit(0.0)).alias("cover"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(c, ",")
    return found.select("doc_id", "n_words", F.col("n_phrases").alias("n_base"), "first_word", "last_word", joined("phrase_labels").alias("base_labels"), joined("labels").alias("labels"), F.col("cover").alias("score"))


def _values() -> str:
    rows = [f"({n}, '{label}', {n < len(PHRASES)}, '{text}')" for n, (label, text) in enumerate(PHRASES + TEXTS)]
    return ", ".join(rows)


SQL_OP12 = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), tw AS (
  SELECT template, label, phrase, string_split(text, ' ') AS w, CASE WHEN phrase THEN 2 ELSE 3 END AS g FROM (VALUES {_values()}) v(template, label, phrase, text)
), tg AS (
  SELECT template, label, phrase, g, len(w) AS size, CASE WHEN phrase THEN 0 ELSE len(w) // 8 END AS drift, i AS place, array_to_string(w[i:i + g - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - g + 2)) AS i FROM tw)
), dg AS (
  SELECT doc_id, i, g, array_to_string(w[i:i + g - 1], ' ') AS gram FROM (SELECT doc_id, w, g, unnest(range(1, len(w) - g + 2)) AS i FROM dw, (VALUES (2), (3)) s(g))
), hit AS (
  SELECT DISTINCT doc_id, template, label, phrase, size, drift, tg.g AS g, i - place AS diagonal, i, place FROM dg JOIN tg ON dg.g = tg.g AND dg.gram = tg.gram
), line AS (
  SELECT doc_id, template, diagonal, any_value(drift) AS drift FROM hit GROUP BY ALL
), cut AS (
  SELECT doc_id, template, diagonal, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS grp
  FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= drift THEN 0 ELSE 1 END AS apart FROM line)
), word AS (
  SELECT doc_id, template, grp, count(DISTINCT p) AS covered FROM (SELECT doc_id, template, grp, unnest(range(place, place + g)) AS p FROM hit JOIN cut USING (doc_id, template, diagonal)) GROUP BY ALL
), span AS (
  SELECT doc_id, template, label, phrase, grp, size, drift, min(i) - 1 AS start, max(i) - 1 + any_value(g) AS stop FROM hit JOIN cut USING (doc_id, template, diagonal) GROUP BY ALL
), kept AS (
  SELECT doc_id, label, phrase, start, covered / size AS cover FROM span JOIN word USING (doc_id, template, grp)
  WHERE stop - start <= size + 2 * drift AND covered / size >= CASE WHEN phrase THEN 1.0 ELSE {LEAST_COVER} END
), doc AS (
  SELECT doc_id, count(*) FILTER (phrase) AS n, min(start) FILTER (phrase) AS a, max(start) FILTER (phrase) AS b, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) AS l, max(cover) AS cover FROM kept GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word, coalesce(bl, '') AS base_labels, coalesce(l, '') AS labels, coalesce(cover, 0)::DOUBLE AS score
FROM dw LEFT JOIN doc USING (doc_id)
"""
