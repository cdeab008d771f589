"""Scopes, metadata conditions, grep and listings."""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("doc_id", "indexed_at")
#: The comparison operators.
OPERATORS = ("=", "≠", ">", "<", "≥", "≤", "in", "not in", "contains", "not contains", "start with", "end with", "empty", "not empty")
ALIASES = {"is": "=", "==": "=", "not is": "≠", "!=": "≠", ">=": "≥", "<=": "≤"}
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DATE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2})?$"


def scoped(df: DataFrame, ids: list[str] | None, key: str = "doc_id") -> DataFrame:
    """An empty scope is no restriction."""
    return df.where(F.col(key).isin(list(ids))) if ids else df


LAYOUTS = (("%Y-%m-%d %H:%M:%S", "yyyy-MM-dd HH:mm:ss"), ("%Y-%m-%dT%H:%M:%S", "yyyy-MM-dd'T'HH:mm:ss"), ("%Y-%m-%d", "yyyy-MM-dd"))


def _is_date(value: str) -> bool:
    """Whether a text reads as a day or time that there is."""
    for layout, _ in LAYOUTS if re.match(DATE, value) else ():
        try:
            datetime.strptime(value, layout)
        except ValueError:
            continue
        return True
    return False


def _holds_date(stored: Column) -> Column:
    return stored.rlike(DATE) & F.coalesce(*[F.try_to_timestamp(stored, F.lit(layout)) for _, layout in LAYOUTS]).isNotNull()


def _ordered(stored: Column, value: str, compare) -> Column:
    """By date where the value is one, else by number where both are, else by lower-cased text."""
    if _is_date(value):
        return F.when(_holds_date(stored), compare(stored, F.lit(value))).otherwise(F.lit(False))
    text = compare(F.lower(stored), F.lit(value.lower()))
    if re.match(NUMBER, value):
        return F.when(stored.rlike(NUMBER), compare(stored.try_cast("double"), F.lit(float(value)))).otherwise(text)
    return text


def condition(field: str, operator: str, value=None, fields: tuple[str, ...] = FIELDS) -> Column:
    """One metadata condition; unknown fields and operators are errors that name what there is."""
    operator = ALIASES.get(operator, operator)
    if field not in fields:
        raise ValueError(f"unknown field {field!r}; there are {', '.join(fields)}")
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}; there are {', '.join(OPERATORS)}")
    stored = F.coalesce(F.col(field).cast("string"), F.lit(""))
    if operator == "empty":
        return stored == ""
    if operator == "not empty":
        return stored != ""
    if operator in ("in", "not in"):
        if not isinstance(value, (list, tuple)):
            return F.lit(False)
        return stored.isin([str(v) for v in value]) if operator == "in" else ~F.lower(stored).isin([str(v).lower() for v in value])
    value = "" if value is None else str(value)
    low = F.lower(stored)
    if operator in ("contains", "not contains"):
        hit = F.contains(low, F.lit(value.lower()))
        return hit if operator == "contains" else ~hit
    if operator == "start with":
        return F.startswith(low, F.lit(value.lower()))
    if operator == "end with":
        return F.endswith(low, F.lit(value.lower()))
    is_date = _is_date(value)
    if operator == "≠":
        return ~_ordered(stored, value, lambda a, b: a == b) if not is_date else F.when(_holds_date(stored), stored != value).otherwise(F.lit(True))
    return _ordered(stored, value, {"=": lambda a, b: a == b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, "≥": lambda a, b: a >= b, "≤": lambda a, b: a <= b}[operator])


def metadata_filter(view: DataFrame, conditions: list[tuple], logic: str = "and", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    parts = [condition(*c, fields=fields) if len(c) == 3 else condition(c[0], c[1], fields=fields) for c in conditions]
    return view.where(reduce((lambda a, b: a & b) if logic == "and" else (lambda a, b: a | b), parts)) if parts else view


def grep(chunks: DataFrame, pattern: str, regex: bool = False, key: str = "pos") -> DataFrame:
    """``key, count, line``: non-overlapping hits by line; a literal in either case, a regular expression as given."""
    expression = pattern if regex else "(?i)" + "".join(f"\\x{{{ord(c):x}}}" for c in pattern)
    lines = chunks.select(key, F.posexplode(F.split("text", "\n")).alias("no", "line"))
    hits = lines.withColumn("hits", F.regexp_count("line", F.lit(expression))).where("hits > 0")
    return hits.groupBy(key).agg(F.sum("hits").alias("count"), F.trim(F.min_by("line", "no")).alias("line"))


def page_of(chunks: DataFrame, offset: int, limit: int, order: str = "pos") -> DataFrame:
    return chunks.orderBy(order).offset(offset).limit(limit)


def documents_in_order(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_chunks"))


def metadata_histogram(long: DataFrame, most: int = 20) -> DataFrame:
    """Of ``field, value, doc_id``: documents by value, the most frequent values of each field."""
    from pyspark.sql import Window

    counts = long.groupBy("field", "value").agg(F.countDistinct("doc_id").alias("n_docs"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n_docs"), "value"))).where(F.col("rank") <= most)


def inverted_filter(long: DataFrame, conditions: list[tuple[str, Column]], logic: str = "and") -> DataFrame:
    """Documents by conditions on a long ``field, value, doc_id`` table: intersected or united."""
    sets = [long.where((F.col("field") == field) & predicate).select("doc_id").distinct() for field, predicate in conditions]
    return reduce((lambda a, b: a.intersect(b)) if logic == "and" else (lambda a, b: a.union(b).distinct()), sets)


def bound_scope(bound: list[str], requested: list[str]) -> list[str]:
    """What a request may read: all that is bound to it if it names nothing, what it names if all of that is bound; an error otherwise."""
    if outside := sorted(set(requested) - set(bound)):
        raise ValueError(f"outside the bound scope: {', '.join(outside)}")
    return requested or bound


def chunk_index(chunks: DataFrame, doc: str = "doc_id", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Each chunk's place within its document, from zero."""
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1)


def fetch_chunks(chunks: DataFrame, ids: list[str], doc_id: str, doc: str = "doc_id", key: str = "chunk_id") -> DataFrame:
    """The chunks of one document that are named; a name of another document finds nothing."""
    return chunks.where((F.col(doc) == doc_id) & F.col(key).isin(ids))
