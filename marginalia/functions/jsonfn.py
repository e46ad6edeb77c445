"""JSON helpers on string columns. Objects are rewritten as maps of VARIANT, which keeps the types of values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_map(data: Column) -> Column:
    """map<string, variant> of a JSON object; an empty map for anything else."""
    return F.coalesce(F.try_parse_json(data).try_cast("map<string,variant>") if hasattr(Column, "try_cast") else F.try_parse_json(data).cast("map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))


def as_json(m: Column) -> Column:
    return F.to_json(F.to_variant_object(m))


def without_keys(m: Column, keys: Iterable[str]) -> Column:
    keys = list(keys)
    return F.map_filter(m, lambda k, v: ~k.isin(*keys)) if keys else m


def only_keys(m: Column, keys: Iterable[str]) -> Column:
    keys = list(keys)
    return F.map_filter(m, lambda k, v: k.isin(*keys) if keys else F.lit(False))


def with_values(m: Column, values: dict[str, Column]) -> Column:
    """Set keys to VARIANT columns, in place of any there."""
    if not values:
        return m
    new = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*values.values()))
    return F.map_concat(without_keys(m, values), new)


def literal(value: object) -> Column:
    import json

    return F.parse_json(F.lit(json.dumps(value)))


def json_get(data: Column, key: str) -> Column:
    """One field as text, null if absent (SQL: json_get)."""
    return F.get_json_object(data, f"$.{key}")


def json_set_json(data: Column, key: str, value: Column) -> Column:
    """Set a key to a JSON text."""
    return as_json(with_values(as_map(data), {key: F.parse_json(value)}))


def json_array_contains(data: Column, key: str, value: Column) -> Column:
    return F.coalesce(F.array_contains(F.from_json(json_get(data, key), "array<string>"), value), F.lit(False))


def class_contains(data: Column, cls: Column) -> Column:
    """Whether data.class, an array or text parted by spaces, has a token."""
    raw = json_get(data, "class")
    tokens = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.split(raw, r"\s+"))
    return F.coalesce(F.array_contains(tokens, cls), F.lit(False))


def same_typed(value: Column, expected: object) -> Column:
    """Whether a VARIANT equals a Python value, type included: 1 is not "1", true or 1.0."""
    import json

    return F.coalesce((F.to_json(value) == F.lit(json.dumps(expected, separators=(",", ":"), sort_keys=True, ensure_ascii=False))), F.lit(False))


def json_object(**fields: Column) -> Column:
    """A JSON object of columns; nulls are written (SQL: json_object)."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"}) if fields else F.lit("{}")
