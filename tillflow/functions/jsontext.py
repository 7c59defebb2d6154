"""JSON text built and read with column expressions.

``params`` objects have no fixed schema, so they travel as JSON text. Objects
are written with their keys in the given order.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(c) -> Column:
    """A string column as a JSON string, or JSON null."""
    # the one-element array without its brackets; they end at the quotes or at null
    return F.btrim(F.to_json(F.array(_col(c))), F.lit("[]"))


def raw(c) -> Column:
    """A number, boolean or JSON text column as JSON, or JSON null."""
    return F.coalesce(_col(c).cast("string"), F.lit("null"))


def json_object(**fields: Column) -> Column:
    parts = []
    for i, (name, value) in enumerate(fields.items()):
        parts += [F.lit(("," if i else "{") + f'"{name}":'), value]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def text_fields(**fields: Column) -> Column:
    """What ``json_object`` gives for quoted strings, up to the closing brace, with one call of the JSON writer for all of them."""
    # a value ends at its quotes or at null, so only the object's brace goes
    return F.rtrim(F.to_json(F.struct(*[_col(c).alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"}), F.lit("}"))


def field(params, name: str) -> Column:
    """A field as text; JSON null and a missing field are both NULL."""
    return F.get_json_object(_col(params), f"$.{name}")


def coerce_long(text) -> Column:
    """Text as a whole number: decimals are cut, anything else is 0."""
    t = F.trim(_col(text))
    return F.coalesce(t.try_cast("bigint"), t.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def text_or(params, name: str, default: str) -> Column:
    return F.coalesce(field(params, name), F.lit(default))


def merge_json(params, **fields: Column) -> Column:
    """Put or replace keys of a JSON object; the other values keep their type."""
    old = F.from_json(_col(params), "map<string,variant>")
    new = F.create_map(*[x for name, value in fields.items()
                         for x in (F.lit(name), F.parse_json(value))])
    return F.to_json(F.map_concat(old, new))


def merge_objects(params, more) -> Column:
    """All keys of two JSON objects; the second wins."""
    objects = [F.from_json(F.coalesce(_col(c), F.lit("{}")), "map<string,variant>") for c in (params, more)]
    return F.to_json(F.map_concat(*objects))
