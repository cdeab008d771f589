"""Replies of a model read with tolerance, metadata of any shape, and filters given as data, by the VARIANT type.

A reply that isn't what was asked for is still read where its shape says what it means: JSON in a code fence, a bare array, objects instead of texts, a marked list.
What has no such shape gives nothing; nothing is made up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import collapse, strip
from quarry.operators.filters import ALIASES
from quarry.operators.routing import query_guard

# Names under which a query, and the parts of a slot, are given; what separates texts in one text.
QUERY_KEYS = ("query", "question", "sub_query", "search_query")
TYPE_KEYS, SUBJECT_KEYS, TERM_KEYS = ("type", "kind", "shape"), ("subject", "actor", "who"), ("scan", "terms", "acts", "action_words")
SEPARATORS, COMBINED = "[,，|｜;；]+", "[、,，;；|]+"
MOST_QUERIES, MOST_SLOTS, MOST_TERMS = 3, 4, 10

TEXTS = "array<string>"


def unfenced(reply: Column) -> Column:
    """A reply without the code fence around it and the language named on the fence."""
    inner = F.regexp_replace(F.regexp_replace(strip(reply), r"^```(?:[^\n{\[]*\n)?", ""), r"\s*```\s*$", "")
    return F.when(strip(reply).startswith("```"), strip(inner)).otherwise(strip(reply))


def _json(reply: Column, opening: str) -> Column:
    body = unfenced(reply)
    return F.when(body.rlike(rf"^[{opening}]"), F.try_parse_json(body))


def _is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _text_at(v: Column, *keys: str) -> Column:
    """The first text that isn't blank under any of the keys of an object."""
    found = [F.try_variant_get(v, f"$.{k}", "variant") for k in keys]
    return F.coalesce(*[F.when(_is_text(f) & (strip(f.cast("string")) != ""), f.cast("string")) for f in found])


def _first_of_equals(values: Column) -> Column:
    """Without blank values and those equal, but for case, to one before."""
    kept = F.filter(F.transform(values, strip), lambda x: x != "")
    return F.filter(kept, lambda x, i: F.array_position(F.transform(kept, F.lower), F.lower(x)) == i + 1)


def _listed(reply: Column) -> Column:
    """The items of a list with marks or numbers; other lines are none."""
    lines = F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), strip), lambda x: x.rlike(r"^(?:[-*•]|\d+[.)])"))
    bare = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"^[-*• \t]+", ""), r"^\d+[.)]", ""))
    return F.transform(bare, lambda x: strip(F.regexp_replace(strip(x), r'^[",]+|[",]+$', "")))


def reply_queries(reply: Column, most: int = MOST_QUERIES) -> Column:
    """The search queries of a reply: of a JSON object's ``queries`` or a bare array, texts or objects; failing that, of a list. What isn't shaped like a query goes."""
    v = _json(reply, r"{\[")
    entries = F.coalesce(F.try_variant_get(v, "$.queries", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    strict = F.filter(F.transform(entries, lambda e: F.when(_is_text(e), e.cast("string")).otherwise(_text_at(e, *QUERY_KEYS))), lambda x: x.isNotNull() & (x != ""))
    found = F.when(F.size(strict) > 0, strict).otherwise(_listed(reply))
    return F.slice(_first_of_equals(F.filter(F.transform(found, collapse), query_guard)), 1, most)


def _texts_at(v: Column, key: str) -> Column:
    """The texts under a key: those of an array, or of one text with separators."""
    at = F.try_variant_get(v, f"$.{key}", "variant")
    listed = F.transform(F.filter(F.try_variant_get(v, f"$.{key}", "array<variant>"), _is_text), lambda e: e.cast("string"))
    return F.coalesce(F.when(_is_text(at), F.split(at.cast("string"), SEPARATORS)), listed, F.array().cast(TEXTS))


def reply_slots(reply: Column) -> Column:
    """``array<struct<type, subject, terms>>``: the slots that a reply declares under ``slots``, as objects or as bare types; one that says nothing is none."""
    v = _json(reply, "{")

    def slot(e: Column) -> Column:
        bare = F.struct(strip(e.cast("string")).alias("type"), F.lit("").alias("subject"), F.array().cast(TEXTS).alias("terms"))
        terms = F.slice(_first_of_equals(F.flatten(F.array(*[_texts_at(e, k) for k in TERM_KEYS]))), 1, MOST_TERMS)
        blank = F.lit("")
        own = F.struct(F.coalesce(strip(_text_at(e, *TYPE_KEYS)), blank).alias("type"), F.coalesce(strip(_text_at(e, *SUBJECT_KEYS)), blank).alias("subject"), terms.alias("terms"))
        return F.when(_is_text(e), bare).when(F.schema_of_variant(e).startswith("OBJECT"), own)

    made = F.transform(F.try_variant_get(v, "$.slots", "array<variant>"), slot)
    kept = F.filter(made, lambda s: s.isNotNull() & ((s["type"] != "") | (s["subject"] != "") | (F.size(s["terms"]) > 0)))
    return F.coalesce(F.slice(kept, 1, MOST_SLOTS), F.array().cast("array<struct<type:string,subject:string,terms:array<string>>>"))


# ---------------------------------------------------------------- metadata


def long_values(rows: DataFrame, key: str, json: str) -> DataFrame:
    """``key, field, kind, value``: the fields of each row's JSON object with their values as texts. Values of a list of texts are taken apart at separators, each once; other lists and objects are left out."""
    at = rows.select(F.col(key).alias("_key"), F.try_parse_json(json).alias("_v"))
    pairs = at.sparkSession.sql("SELECT _key, e.key AS field, e.value AS v FROM {at}, LATERAL variant_explode(_v) e WHERE schema_of_variant(_v) LIKE 'OBJECT%'", at=at)
    kind = F.schema_of_variant("v")
    parts = F.array_distinct(F.filter(F.flatten(F.transform(F.col("v").try_cast("array<string>"), lambda x: F.split(strip(x), COMBINED))), lambda x: strip(x) != ""))
    values = F.when(kind == "ARRAY<STRING>", F.transform(parts, strip)).when(~kind.rlike("^(ARRAY|OBJECT|VOID)"), F.array(F.col("v").cast("string")))
    return pairs.select(F.col("_key").alias(key), "field", kind.alias("kind"), F.explode(values).alias("value"))


def json_schema(fields: DataFrame, by: str) -> DataFrame:
    """``by, schema``: the JSON Schema of the fields (``by, at, key, type, description, enum``) of each group: of fields declared twice the first counts, one without a key is none, and values to choose from make a text."""
    named = fields.where(strip(F.coalesce("key", F.lit(""))) != "").withColumn("key", strip(F.col("key")))
    first = named.groupBy(by, "key").agg(F.min_by(F.struct("type", "description", "enum"), "at").alias("f"))
    choice = F.size(F.coalesce("f.enum", F.array().cast(TEXTS))) > 0
    kept = lambda c: F.when(F.col(c) != "", F.col(c))
    body = F.struct(kept("f.description").alias("description"), F.when(choice, F.col("f.enum")).alias("enum"), F.when(choice, F.lit("string")).otherwise(kept("f.type")).alias("type"))
    whole = first.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", body.alias("body"))))).alias("properties"))
    return whole.select(by, F.to_json(F.struct(F.lit("object").alias("type"), "properties", F.lit(False).alias("additionalProperties"))).alias("schema"))


def conditions(filters: DataFrame, key: str = "filter_id", json: str = "condition") -> DataFrame:
    """``key, logic, at, field, operator, value, choices``: filters given as JSON, with either spelling of their parts; a condition without a field is none."""
    v = F.try_parse_json(json)
    each = filters.select(key, F.coalesce(_text_at(v, "logic"), F.lit("and")).alias("logic"), F.posexplode(F.try_variant_get(v, "$.conditions", "array<variant>")).alias("at", "c"))
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    operator = _text_at(F.col("c"), "comparison_operator", "operator")
    value = F.try_variant_get("c", "$.value", "variant")
    scalar = F.when(~F.schema_of_variant(value).rlike("^(ARRAY|OBJECT|VOID)"), value.cast("string"))
    rows = each.select(key, "logic", "at", _text_at(F.col("c"), "name", "key").alias("field"), F.coalesce(F.try_element_at(aliases, operator), operator, F.lit("")).alias("operator"), F.coalesce(scalar, F.lit("")).alias("value"), F.try_variant_get("c", "$.value", "array<string>").alias("choices"))
    return rows.where(F.col("field").isNotNull())


DAY, NUMBER = r"^\d{4}-\d{2}-\d{2}$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def holds(stored: Column, operator: Column, value: Column, choices: Column) -> Column:
    """Whether a stored value meets a condition: by day where the condition names one, else by number where both are, else by text in either case."""
    low, other = F.lower(stored), F.lower(value)
    number = stored.rlike(NUMBER) & value.rlike(NUMBER)
    a, b = stored.try_cast("double"), value.try_cast("double")
    sign = F.when(value.rlike(DAY), F.when(stored.rlike(DAY), F.when(stored < value, -1).when(stored > value, 1).otherwise(0)))
    sign = sign.when(number, F.when(a < b, -1).when(a > b, 1).otherwise(0)).otherwise(F.when(low < other, -1).when(low > other, 1).otherwise(0))
    out = F.when(operator == "in", F.array_contains(choices, stored)).when(operator == "not in", ~F.array_contains(F.transform(choices, F.lower), low))
    for name, met in (("empty", stored == ""), ("not empty", stored != ""), ("contains", F.contains(low, other)), ("not contains", ~F.contains(low, other)), ("start with", F.startswith(low, other)), ("end with", F.endswith(low, other))):
        out = out.when(operator == name, met)
    for name, met in (("=", sign == 0), ("≠", F.coalesce(sign != 0, F.lit(True))), (">", sign > 0), ("<", sign < 0), ("≥", sign >= 0), ("≤", sign <= 0)):
        out = out.when(operator == name, met)
    return F.coalesce(out, F.lit(False))


def filtered(long: DataFrame, given: DataFrame, key: str, filter_key: str = "filter_id") -> DataFrame:
    """``filter_key, key``: the rows of a long table (``key, field, value``) that meet each filter (of :func:`conditions`). Conditions are tested once a different value.

    All conditions have to be met, or any with the logic ``or``; one on a field that no row has is met by none.
    """
    distinct = long.select("field", "value").distinct()
    met = distinct.withColumnRenamed("value", "stored").join(F.broadcast(given), "field").where(holds(F.col("stored"), F.col("operator"), F.col("value"), F.col("choices")))
    rows = long.join(met.select(filter_key, "logic", "at", "field", F.col("stored").alias("value")), ["field", "value"]).select(filter_key, "logic", "at", key).distinct()
    needed = given.groupBy(filter_key).agg(F.countDistinct("at").alias("needed"))
    hits = rows.groupBy(filter_key, "logic", key).agg(F.countDistinct("at").alias("n")).join(F.broadcast(needed), filter_key)
    return hits.where((F.col("logic") == "or") | (F.col("n") == F.col("needed"))).select(filter_key, key)
