"""What a model reads: hits and passages as markup, prompts, and the catalogue of the values that filters can ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import strip
from quarry.operators.evidence import evidence_block

# Escapes, the first first; names of answer languages; openings of prompts.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
LANGUAGES = {"Chinese (简体中文)": ("zh", "cn", "chinese", "中文", "简体中文"), "English": ("en", "english", "英文")}
ORIGINAL, PARTS = "Original question: ", "Parts it was split into (the evidence below was gathered for them):\n"

#: Said to the model where a list of hits is empty, or has parts of passages; in words of our own, and a parameter.
EMPTY = "Nothing was found. The documents may use other forms of these words: try another form, or the rarest word alone."
CUT = "{truncated} snippet(s) show a part of their passage and {unmatched} hold no word of the query. Read a passage whole before you rely on it."

#: Values of a field that a catalogue names.
SAMPLES = 12


def escaped(text: Column) -> Column:
    """Text as it may stand in an attribute or an element; null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for sign, name in ESCAPES:
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def opening_tag(name: str, attributes: dict[str, Column]) -> Column:
    """``<name a="…" b="…">``; an attribute that is null is left out."""
    given = [F.coalesce(F.concat(F.lit(f' {a}="'), F.when(v.isNotNull(), escaped(v)), F.lit('"')), F.lit("")) for a, v in attributes.items()]
    return F.concat(F.lit(f"<{name}"), *given, F.lit(">"))


def _element(name: str, text: Column) -> Column:
    """An element and a line feed, or nothing where there is no text."""
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"<{name}>"), escaped(text), F.lit(f"</{name}>\n"))).otherwise("")


def _ref(rows: DataFrame) -> dict[str, Column]:
    return {"ref": F.col("ref")} if "ref" in rows.columns else {}


def search_markup(queries: DataFrame, hits: DataFrame, empty: str = EMPTY, cut: str = CUT) -> DataFrame:
    """``query_id, markup``: each query (``query_id, query``) with its hits in order, those without any too.

    ``hits``: ``query_id, rank, chunk_id, doc_id, page_num, chunk_index, dataset_id, doc_name, score, n_chars, snippet, truncated, unmatched`` and, where passages have handles, ``ref``;
    as many a query as it was asked for.
    """
    flag = {"truncated": F.when(F.col("truncated"), "true"), "match": F.when(F.col("unmatched"), "none")}
    head = opening_tag("chunk", {"rank": F.col("rank")} | {c: F.col(c) for c in ("chunk_id", "doc_id", "page_num", "chunk_index", "dataset_id", "doc_name")} | {"score": F.format_string("%.3f", F.col("score")), "chunk_runes": F.col("n_chars")} | _ref(hits) | flag)
    shown = F.concat(head, F.lit("\n"), _element("match_snippet", F.col("snippet")), F.lit("</chunk>\n"))
    of = hits.select("query_id", "rank", "truncated", "unmatched", shown.alias("shown")).groupBy("query_id")
    told = of.agg(F.count("*").alias("n"), F.count_if("truncated").alias("n_truncated"), F.count_if("unmatched").alias("n_unmatched"), F.array_sort(F.collect_list(F.struct("rank", "shown"))).alias("s"))
    rows = queries.select("query_id", "query").join(told, "query_id", "left")
    n = F.coalesce("n", F.lit(0))
    note = F.replace(F.replace(F.lit(cut), F.lit("{truncated}"), F.col("n_truncated").cast("string")), F.lit("{unmatched}"), F.col("n_unmatched").cast("string"))
    notes = F.concat(_element("snippet_note", F.when(F.col("n_truncated") + F.col("n_unmatched") > 0, note)), _element("hint", F.when(n == 0, F.lit(empty))))
    return rows.select("query_id", F.concat(opening_tag("search_results", {"count": n, "query": F.col("query")}), F.lit("\n"), F.coalesce(F.array_join("s.shown", ""), F.lit("")), notes, F.lit("</search_results>")).alias("markup"))


def passage_markup(passages: DataFrame, notices: DataFrame | None = None) -> DataFrame:
    """``doc_id, n, markup``: the passages of each document (``doc_id, pos, chunk_id, page_num, chunk_index, dataset_id, doc_name, text`` and ``ref``) in order.

    ``notices`` (``doc_id, notice``): what a reader has to be told about a document, such as a passage asked for that is not there.
    """
    head = opening_tag("chunk", {c: F.col(c) for c in ("chunk_id", "doc_id", "page_num", "chunk_index", "dataset_id", "doc_name")} | _ref(passages))
    shown = F.concat(head, F.lit("\n"), _element("content", F.col("text")), F.lit("</chunk>\n"))
    told = passages.select("doc_id", "pos", shown.alias("shown")).groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "shown"))).alias("s"))
    told = told.join(notices, "doc_id", "left") if notices is not None else told.withColumn("notice", F.lit(None).cast("string"))
    return told.select("doc_id", "n", F.concat(opening_tag("chunks", {"doc_id": F.col("doc_id"), "fetched": F.col("n")}), F.lit("\n"), _element("notice", F.col("notice")), F.array_join("s.shown", ""), F.lit("</chunks>")).alias("markup"))


def synthesis_prompt(questions: DataFrame, ranked: DataFrame, budget: int, parts: DataFrame | None = None, record: Column | None = None) -> DataFrame:
    """``query_id, block, n_shown, n_omitted``: the question, the parts it was split into (``query_id, part, text``), the record of an enumeration, and the evidence that fits."""
    asked = questions.select("query_id", "query")
    listed = F.lit("")
    if parts is not None:
        number = F.row_number().over(Window.partitionBy("query_id").orderBy("part"))
        lines = parts.select("query_id", number.alias("no"), F.concat(number.cast("string"), F.lit(". "), "text", F.lit("\n")).alias("t")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("no", "t"))).alias("p"))
        asked = asked.join(lines.select("query_id", F.array_join("p.t", "").alias("parts")), "query_id", "left")
        listed = F.coalesce(F.concat(F.lit(PARTS), "parts", F.lit("\n")), F.lit(""))
    held = F.coalesce(F.concat(F.when(strip(record) != "", strip(record)), F.lit("\n")), F.lit("")) if record is not None else F.lit("")
    return evidence_block(asked, ranked, budget, opening=F.concat(F.lit(ORIGINAL), "query", F.lit("\n\n"), listed, held, F.lit("Evidence:\n")))


def language_directive(language: Column) -> Column:
    """In which language to answer, or nothing where none is named that is known."""
    asked = F.lower(strip(F.coalesce(language, F.lit(""))))
    said = "\nWrite the answer in {}, even when the evidence is in another language. Leave identifiers, model names, numbers and quoted phrases in their original form."
    out = F.lit("")
    for name, also in LANGUAGES.items():
        out = F.when(asked.isin(*also), said.format(name)).otherwise(out)
    return out


def scope_prefix(scope: Column) -> Column:
    """That a search was confined to part of the corpus, where it was."""
    said = F.concat(F.lit("Search scope: this run was RESTRICTED to a subset of the corpus — "), strip(scope), F.lit(". If the evidence does not answer the question, say it was not found within this scope and name the scope, rather than stating that the documents do not contain it.\n\n"))
    return F.when(strip(F.coalesce(scope, F.lit(""))) != "", said).otherwise("")


def field_samples(docs: DataFrame, fields: list[str], most: int = SAMPLES) -> DataFrame:
    """``field, place, value, n_docs``: of each field the values of most documents, then by value; null and empty ones are none."""
    pairs = docs.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")).select("p.*")
    counted = pairs.where(F.coalesce(F.col("value"), F.lit("")) != "").groupBy("field", "value").agg(F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n_docs"), "value"))
    return counted.withColumn("place", place).where(F.col("place") <= most).select("field", "place", "value", "n_docs")


def _quoted(text: Column) -> Column:
    for sign, name in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return F.concat(F.lit('"'), text, F.lit('"'))


def _field_lines(samples: DataFrame, fields: list[str]) -> DataFrame:
    """``no, field, shown``: of each field its values with their counts; null where it has none."""
    spark = samples.sparkSession
    names = spark.range(1).select(F.posexplode(F.array(*[F.lit(f) for f in fields])).alias("no", "field"))
    one = F.concat(_quoted(F.col("value")), F.lit(" ("), F.col("n_docs").cast("string"), F.lit(" doc(s))"))
    values = samples.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("place", one.alias("t")))).alias("v")).select("field", F.array_join("v.t", ", ").alias("shown"))
    return names.join(values, "field", "left")


def availability(samples: DataFrame, n_docs: DataFrame, fields: list[str]) -> DataFrame:
    """``said``: in one line, which values there are, for a filter that found nothing. ``n_docs``: one row, ``n``."""
    one = F.concat("field", F.coalesce(F.concat(F.lit(" = "), "shown"), F.lit(" has no values")))
    lines = _field_lines(samples, fields).agg(F.array_sort(F.collect_list(F.struct("no", one.alias("t")))).alias("l"))
    return lines.withColumn("one", F.lit(1)).join(n_docs.withColumn("one", F.lit(1)), "one").select(F.concat(F.array_join("l.t", "; "), F.lit("; "), F.col("n").cast("string"), F.lit(" document(s) indexed")).alias("said"))


def catalogue(samples: DataFrame, n_docs: DataFrame, fields: list[str], notes: dict[str, str] | None = None) -> DataFrame:
    """``said``: which fields and values a filter can ask for; empty where there is no document. ``notes``: how the values of a field are to be asked for."""
    extra = F.create_map(*[F.lit(x) for pair in (notes or {"": ""}).items() for x in pair])
    one = F.concat(F.lit("- "), "field", F.coalesce(F.concat(F.lit(" ("), F.try_element_at(extra, F.col("field")), F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit("; values: "), "shown"), F.lit("; no values recorded")), F.lit("\n"))
    lines = _field_lines(samples, fields).agg(F.array_sort(F.collect_list(F.struct("no", one.alias("t")))).alias("l"))
    said = F.concat(F.lit("AVAILABLE METADATA (the only fields metadata_search can filter on):\n"), F.array_join("l.t", ""), F.col("n").cast("string"), F.lit(" document(s) are indexed. Values NOT listed here do not exist — never invent one."))
    return lines.withColumn("one", F.lit(1)).join(n_docs.withColumn("one", F.lit(1)), "one").select(F.when(F.col("n") > 0, said).otherwise("").alias("said"))
