"""Operator 4: benchmark decontamination over a positional inverted index (DataFrame functions only).

The corpus is cut into words once. A posting is a document, a position and a term; the postings of all terms that occur in the
benchmark are stored as a table, with one posting of the empty term for each document, which carries its length. (No list of any
other term is ever read.) A window is ten words of an item in a row, or a shorter item as a whole. The places where it can stand
are the postings of its rarest term, moved by the term's place in the window; they are intersected with the list of the second rarest term, at its offset,
and what is left with the lists of all others. Proximity matches are places of an item's rarest term near which its next rarest terms all stand.

Edge cases: null and empty texts have no words and no hits; an item without words has no window; items with the same id
count once; a null item id is written as the empty string; documents are told apart by key and text, so that repeated keys with different texts each
get their own row and repeated rows equal ones; null keys are kept; terms that the corpus does not hold end the search for a window and
are left out of proximity; an empty benchmark hits nothing; an empty table gives an empty result; long texts, also of one term alone, are cut whole, and a
posting does not carry its document. Other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, table, text_of, written

#: Fixed: what stands between words, after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: A proximity match holds so many of an item's rarest terms within so many words of the rarest.
NEAR_TERMS, NEAR_WORDS = 4, 20


def _low(text: str) -> Column:
    """A-Z in lower case and nothing else changed; where all is ASCII the plain function does that."""
    t = text_of(text)
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(_low(text), GAP), "")


def benchmark_windows(items: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``window_id, window array<string>, item``: every window of every item; equal windows have one id."""
    w = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(text).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    out = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window")).distinct()
    return out.select(F.sha2(F.array_join("window", " "), 256).alias("window_id"), "window", "item")


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item, term``: the different terms of each item."""
    return items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.explode(F.array_distinct(words(text))).alias("term")).distinct()


def positional_index(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``k, f, n_words, pos, term``, stored: the postings of ``terms`` in all documents; positions count from 1.

    ``k``: the key, ``f``: a hash of the text. Position 0 of every document holds the empty term.
    """
    spark = docs.sparkSession
    wanted = written(terms.select("term").unionAll(spark.range(1).select(F.lit("").alias("term"))).distinct(), "terms")
    d = docs.select(F.col(key).alias("k"), F.xxhash64(text_of(text)).alias("f"), words(text).alias("words"))
    # The words are a column of their own before anything refers to them twice, and no filter is inferred from an outer explode.
    d = d.select("k", "f", F.size("words").cast("long").alias("n_words"), F.concat(F.array(F.lit("")), "words").alias("marked"))
    found = d.select("k", "f", "n_words", F.posexplode_outer("marked").alias("pos", "term"))
    return written(found.join(broadcast_if_small(wanted), "term", "left_semi").select("k", "f", "n_words", "pos", "term"), "postings")


def anchors(windows: DataFrame, postings: DataFrame) -> DataFrame:
    """``window_id, n, terms array<struct<n, place, term>>``, stored: of each window that can occur, its terms from the rarest on."""
    frequency = postings.groupBy("term").agg(F.count("*").alias("n"))
    distinct = windows.select("window_id", "window").dropDuplicates(["window_id"])
    placed = distinct.select("window_id", F.posexplode("window").alias("place", "term")).join(frequency, "term", "left")
    by_rarity = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "term")))
    out = placed.groupBy("window_id").agg(by_rarity.alias("terms"))
    return written(out.where(F.get("terms", F.lit(0))["n"] > 0).select("window_id", F.size("terms").alias("n"), "terms"), "anchors")


def find_windows(postings: DataFrame, windows: DataFrame) -> DataFrame:
    """``k, f, start, n, window_id``: every place (from 0) where a window stands in a document, once."""
    rare = anchors(windows, postings)
    first = rare.select("window_id", "n", F.get("terms", F.lit(0))["term"].alias("term"), F.get("terms", F.lit(0))["place"].alias("place"))
    start = (F.col("pos") - 1 - F.col("place")).alias("start")
    begun = postings.join(broadcast_if_small(written(first, "rarest")), "term").select("k", "f", "n_words", "window_id", "n", start)
    begun = written(begun.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words"))).drop("n_words").distinct(), "places")

    def there(wanted: DataFrame, lists: DataFrame) -> DataFrame:
        """The rows of ``wanted`` (``k, f, window_id, n, start, place, term``) at whose offset the posting is, among those of ``lists``."""
        w = broadcast_if_small(written(wanted.withColumnsRenamed({"k": "wanted_k", "f": "wanted_f", "term": "wanted_term"}), "wanted"))
        same = F.col("k").eqNullSafe(F.col("wanted_k")) & (F.col("f") == F.col("wanted_f")) & (F.col("term") == F.col("wanted_term")) & (F.col("pos") == F.col("start") + F.col("place") + 1)
        return lists.select("k", "f", "pos", "term").join(w, same).select("k", "f", "window_id", "n", "start", "place").distinct()

    terms = rare.select("window_id", "terms")
    second = begun.where("n > 1").join(broadcast_if_small(terms), "window_id").select(begun["*"], F.get("terms", F.lit(1))["place"].alias("place"), F.get("terms", F.lit(1))["term"].alias("term"))
    # Only lists of second terms, and afterwards only those of documents in which two terms are in place, can end in a join's shuffle.
    seconds = written(rare.where("n > 1").select(F.get("terms", F.lit(1))["term"].alias("term")).distinct(), "second-terms")
    two = written(there(second, postings.join(broadcast_if_small(seconds), "term", "left_semi")).drop("place"), "two-terms")
    of_two = written(two.where("n > 2").select(F.col("k").alias("two_k"), F.col("f").alias("two_f")).distinct(), "two-documents")
    in_two = postings.join(broadcast_if_small(of_two), F.col("k").eqNullSafe(F.col("two_k")) & (F.col("f") == F.col("two_f")), "left_semi")
    others = two.where("n > 2").join(broadcast_if_small(terms), "window_id").select(two["*"], F.explode(F.slice("terms", 3, F.greatest(F.size("terms") - 2, F.lit(0)))).alias("t"))
    others = others.select("k", "f", "window_id", "n", "start", F.col("t.place").alias("place"), F.col("t.term").alias("term"))
    all_there = there(others, in_two).groupBy("k", "f", "window_id", "n", "start").agg(F.count("*").alias("met")).where(F.col("met") == F.col("n") - 2).drop("met")
    columns = ["k", "f", "start", "n", "window_id"]
    return begun.where("n = 1").select(*columns).unionAll(two.where("n = 2").select(*columns)).unionAll(all_there.select(*columns))


def near_places(postings: DataFrame, terms: DataFrame, n_terms: int = NEAR_TERMS, within: int = NEAR_WORDS) -> DataFrame:
    """``k, f, item, start``: places (from 0) of each item's rarest term that the next rarest ones all stand near, in any order.

    ``terms``: of :func:`item_terms`. The ``n_terms`` rarest of an item's terms that occur at all count, ties by the term; near is less than ``within`` words away.
    """
    frequency = postings.groupBy("term").agg(F.count("*").alias("n"))
    ranked = terms.join(frequency, "term").groupBy("item").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "term"))), 1, n_terms).alias("t"))
    wanted = written(ranked.select("item", F.size("t").alias("needed"), F.posexplode("t.term").alias("rank", "term")), "near-terms")
    found = postings.join(broadcast_if_small(wanted), "term").select("k", "f", "item", "pos", "rank", "needed")
    around = Window.partitionBy("k", "f", "item").orderBy("pos").rangeBetween(-(within - 1), within - 1)
    met = found.withColumn("met", F.bit_or(F.expr("shiftleft(1, rank)")).over(around))
    return met.where((F.col("rank") == 0) & (F.col("met") == F.expr("shiftleft(1, needed) - 1"))).select("k", "f", "item", (F.col("pos") - 1).alias("start")).distinct()


def _covered(spans: Column) -> Column:
    """Positions inside any of the sorted ``(start, n)``."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(a: Column, s: Column) -> Column:
        end = F.greatest(a["end"], s["start"] + s["n"])
        return F.struct((a["n"] + end - F.greatest(a["end"], F.least(s["start"], end))).alias("n"), end.alias("end"))

    return F.aggregate(spans, zero, add, lambda a: a["n"])


def _named(owners: DataFrame, name: str) -> DataFrame:
    """Sorted different items of each document."""
    return owners.select("k", "f", "item").distinct().groupBy(F.col("k").alias(f"{name}_k"), F.col("f").alias(f"{name}_f")).agg(F.array_sort(F.collect_list("item")).alias(name))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", size: int = WINDOW) -> DataFrame:
    """``key, fingerprint, n_words, n_hit, items array<string>, near_items array<string>`` of every document.

    ``n_hit``: words inside windows; ``items``: those with an occurring window; ``near_items``: those with a proximity match.
    """
    windows = written(benchmark_windows(items, item, size=size), "windows")
    terms = written(item_terms(items, item), "item-terms")
    postings = positional_index(docs, terms, key, text)
    hits = written(find_windows(postings, windows), "hits")
    spans = hits.groupBy(F.col("k").alias("hit_k"), F.col("f").alias("hit_f")).agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"))
    spans = spans.select("hit_k", "hit_f", _covered(F.col("spans")).cast("long").alias("n_hit"))
    owners = hits.select("k", "f", "window_id").distinct().join(windows.select("window_id", "item"), "window_id")
    out = postings.where("term = ''").select("k", "f", "n_words")
    for found in (spans, _named(owners, "items"), _named(near_places(postings, terms), "near_items")):
        its_k, its_f = found.columns[:2]
        out = out.join(found, F.col("k").eqNullSafe(F.col(its_k)) & (F.col("f") == F.col(its_f)), "left").drop(its_k, its_f)
    none = F.array().cast("array<string>")
    return out.select(F.col("k").alias(key), F.col("f").alias("fingerprint"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))


def proximity_matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", n_terms: int = NEAR_TERMS, within: int = NEAR_WORDS) -> DataFrame:
    """``key, item, start``: the places of :func:`near_places`."""
    terms = written(item_terms(items, item, text), "item-terms")
    found = near_places(positional_index(docs, terms, key, text), terms, n_terms, within)
    return found.select(F.col("k").alias(key), "item", F.col("start").cast("long").alias("start"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    return found.select("doc_id", "n_words", "n_hit", *items, F.size("near_items").cast("long").alias("n_near_items"))


def without_contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """The documents in which no window of an item stands, with their own columns."""
    windows = written(benchmark_windows(items, item), "windows")
    postings = positional_index(docs, windows.select(F.explode("window").alias("term")), key, text)
    hit = written(find_windows(postings, windows).select(F.col("k").alias("hit_k"), F.col("f").alias("hit_f")).distinct(), "hits")
    whole = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.xxhash64(text_of(text)).alias("f"))
    kept = whole.join(broadcast_if_small(hit), F.col("k").eqNullSafe(F.col("hit_k")) & (F.col("f") == F.col("hit_f")), "left_anti")
    return kept.select("row.*")


SQL_OP4 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, array_to_string(w[i:i+9], ' ') AS gram, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows
), grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, n, item FROM grams JOIN windows USING (gram, n)
), pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
), occ AS (SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS term FROM dw WHERE len(w) > 0
), it AS (SELECT DISTINCT item, unnest(w) AS term FROM iw
), cnt AS (SELECT term, count(*) AS n FROM occ JOIN (SELECT DISTINCT term FROM it) USING (term) GROUP BY term
), rare AS (SELECT item, term, row_number() OVER (PARTITION BY item ORDER BY n, term) AS rank FROM it JOIN cnt USING (term)
), need AS (SELECT item, least(count(*), 4) AS needed FROM rare GROUP BY item
), spot AS (SELECT doc_id, item, rank, p FROM occ JOIN rare USING (term) WHERE rank <= 4
), near AS (
  SELECT DISTINCT doc_id, item FROM (
    SELECT a.doc_id, a.item, a.p, count(DISTINCT b.rank) AS met FROM spot a JOIN spot b ON a.doc_id = b.doc_id AND a.item = b.item AND abs(a.p - b.p) < 20 WHERE a.rank = 1 GROUP BY ALL
  ) JOIN need USING (item) WHERE met = needed
), nearby AS (SELECT doc_id, count(*) AS n_near FROM near GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near_items
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nearby USING (doc_id)
"""
