"""Typed access to the JSON attribute columns, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _path(key: str) -> str:
    return f"$['{key}']"


def attr_text(column: Column, key: str) -> Column:
    """Scalar attribute as text; NULL when absent or the document is not JSON."""
    return F.get_json_object(column, _path(key))


def _value(column: Column, key: str) -> Column:
    return F.try_variant_get(F.try_parse_json(column), _path(key), "variant")


def attr_kind(column: Column, key: str) -> Column:
    """Variant type name of an attribute (BOOLEAN, BIGINT, STRING, ...)."""
    return F.schema_of_variant(_value(column, key))


def attr_is_true(column: Column, key: str) -> Column:
    """True only for the JSON literal ``true``; the text "true" does not count."""
    mentioned = F.contains(column, F.lit(f'"{key}"'))
    exact = (attr_kind(column, key) == "BOOLEAN") & (attr_text(column, key) == "true")
    return F.coalesce(F.when(mentioned, exact), F.lit(False))


def attr_number(column: Column, key: str) -> Column:
    """Numeric attribute as DOUBLE; NULL when absent or not a JSON number."""
    numeric = attr_kind(column, key).rlike("^(BIGINT|DOUBLE|DECIMAL)")
    return F.when(F.contains(column, F.lit(f'"{key}"')) & numeric,
                  F.try_variant_get(F.try_parse_json(column), _path(key), "double"))


def variant_field(parsed: str, key: str) -> Column:
    """An attribute of a parsed document, as variant."""
    return F.try_variant_get(parsed, _path(key), "variant")


def variant_number(column: Column, parsed: str, key: str) -> Column:
    """``attr_number`` of a document that is parsed already."""
    numeric = F.schema_of_variant(variant_field(parsed, key)).rlike("^(BIGINT|DOUBLE|DECIMAL)")
    return F.when(F.contains(column, F.lit(f'"{key}"')) & numeric, F.try_variant_get(parsed, _path(key), "double"))


def is_json(column: Column) -> Column:
    return F.try_parse_json(column).isNotNull()


def is_json_object(column: Column) -> Column:
    kind = F.schema_of_variant(F.try_parse_json(column))
    # "{}" is the default of every JSON column and needs no parser
    return F.when(column == "{}", F.lit(True)).otherwise(F.coalesce(kind.startswith("OBJECT"), F.lit(False)))


def attr_map(column: Column) -> Column:
    """Attributes as map<string,string> where each value keeps its JSON text."""
    return F.coalesce(F.from_json(column, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))


def canonical_object(column: Column) -> Column:
    """JSON object text with sorted keys and no blanks."""
    entries = F.array_sort(F.transform(
        F.map_entries(attr_map(column)),
        lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2),
                           F.lit(":"), F.coalesce(F.to_json(e["value"]), F.lit("null")))))
    return F.when(column == "{}", F.lit("{}")).otherwise(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")))


def merge_objects(old: Column, new: Column) -> Column:
    """Shallow merge, keys of ``new`` win; canonical text."""
    fresh = attr_map(new)
    kept = F.map_filter(attr_map(old), lambda k, _v: ~F.map_contains_key(fresh, k))
    return canonical_object(F.to_json(F.map_concat(kept, fresh)))
