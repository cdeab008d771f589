"""Arguments given as JSON, read by type, and checks against thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _typed(arguments: Column, key: str) -> tuple[Column, Column]:
    """The value under a key of an object (VARIANT) and its type; null where there is none."""
    value = F.try_variant_get(arguments, f"$['{key}']", "variant")
    return value, F.schema_of_variant(value)


def text_argument(arguments: Column, key: str) -> Column:
    """A text; a value of any other type is none."""
    value, kind = _typed(arguments, key)
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))


def int_argument(arguments: Column, key: str) -> Column:
    """A number without its fraction; a text of digits is no number."""
    value, kind = _typed(arguments, key)
    number = F.try_variant_get(value, "$", "double")
    return F.when(kind == "BIGINT", F.try_variant_get(value, "$", "long")).when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("long"))


def flag_argument(arguments: Column, key: str) -> Column:
    value, kind = _typed(arguments, key)
    return F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def is_region(bbox: Column) -> Column:
    """Whether four numbers are a box with an area: neither turned round nor a line."""
    edges = [F.get(bbox, k) for k in range(4)]
    return F.coalesce((F.size(bbox) == 4) & (edges[2] > edges[0]) & (edges[3] > edges[1]), F.lit(False))


def accepted(label: Column, probability: Column, least: float) -> Column:
    """A model's label if it is sure enough of it, else null: the rule that stands in then decides. A label without a probability isn't sure."""
    return F.when(F.coalesce(probability, F.lit(0.0)) >= least, label)


def verdict(sufficient: Column, probability: Column, least: float = 0.6) -> Column:
    """A checker's answer as ``sufficient`` or ``insufficient``, or ``unknown`` where it is missing or not sure enough."""
    return F.when(sufficient.isNull() | (F.coalesce(probability, F.lit(0.0)) < least), "unknown").when(sufficient, "sufficient").otherwise("insufficient")
