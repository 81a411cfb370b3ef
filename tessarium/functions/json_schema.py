"""JSON Schema as one native column: a schema is compiled to an expression that gives an array of errors for each JSON text.

Understood are type (one or several), enum, required, properties, additionalProperties (false), items, minItems, maxItems, minLength, maxLength, pattern, minimum
and maximum; other words are ignored. A value of a wrong type has that error alone. An error begins with where it is, as in pages[2].title; for the
whole text that is the word value. Null texts and such that aren't JSON are an error of the whole.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessarium.functions.text import bound

KINDS = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "null": "VOID"}
SHOWN = {"object": "an object", "array": "an array", "string": "a string", "integer": "an integer", "number": "a number", "boolean": "a boolean", "null": "null"}


def _none() -> Column:
    return F.array().cast("array<string>")


def _is(kind: str, found: Column) -> Column:
    if kind == "number":
        return found.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return found.startswith(KINDS[kind])


def _said(where: Column, what: Column | str) -> Column:
    return F.array(F.concat(F.when(where == "", F.lit("value")).otherwise(where), F.lit(" "), F.lit(what) if isinstance(what, str) else what))


def _if(wrong: Column, where: Column, what: Column | str) -> Column:
    return F.when(wrong, _said(where, what)).otherwise(_none())


def _key(where: Column, name: str) -> Column:
    return F.when(where == "", F.lit(name)).otherwise(F.concat(where, F.lit(f".{name}")))


def _property(value: Column, where: Column, name: str, schema: dict) -> Column:
    """Errors of an object's field, if it's there."""
    return bound(F.try_variant_get(value, f"$['{name}']", "variant"), lambda v: F.when(v.isNotNull(), _node(schema, v, _key(where, name))).otherwise(_none()))


def _node(schema: dict, value: Column, where: Column) -> Column:
    """Errors of a variant that is there."""
    found = F.schema_of_variant(value)
    text = F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("null"))
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    errors: list[Column] = []
    if "enum" in schema:
        shown = [x if isinstance(x, str) else json.dumps(x) for x in schema["enum"]]
        errors.append(_if(~text.isin(*shown), where, F.concat(F.lit("is not one of the allowed values: "), text)))
    for word, kind, what, wrong in (
        ("minLength", "string", "is too short", lambda n: F.length(text) < n), ("maxLength", "string", "is too long", lambda n: F.length(text) > n), ("pattern", "string", "doesn't match its pattern", lambda p: ~text.rlike(p)),
        ("minimum", "number", "is too small", lambda n: F.try_variant_get(value, "$", "double") < n), ("maximum", "number", "is too large", lambda n: F.try_variant_get(value, "$", "double") > n),
    ):
        if word in schema:
            errors.append(_if(_is(kind, found) & wrong(schema[word]), where, what))
    inner: list[Column] = []
    for name in schema.get("required", []):
        inner.append(_if(F.try_variant_get(value, f"$['{name}']", "variant").isNull(), _key(where, name), "is missing"))
    inner += [_property(value, where, name, sub) for name, sub in schema.get("properties", {}).items()]
    if schema.get("additionalProperties") is False:
        known = F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")
        more = F.array_sort(F.array_except(F.coalesce(F.json_object_keys(F.to_json(value)), _none()), known))
        inner.append(F.transform(more, lambda k: F.concat(F.when(where == "", k).otherwise(F.concat(where, F.lit("."), k)), F.lit(" is not allowed"))))
    if inner:
        errors.append(F.when(_is("object", found), F.concat(*inner)).otherwise(_none()))
    items: list[Column] = []
    each = F.try_variant_get(value, "$", "array<variant>")
    for word, what, wrong in (("minItems", "has too few items", lambda n: F.size(each) < n), ("maxItems", "has too many items", lambda n: F.size(each) > n)):
        if word in schema:
            items.append(_if(wrong(schema[word]), where, what))
    if "items" in schema:
        items.append(F.flatten(F.transform(each, lambda x, i: _node(schema["items"], x, F.concat(where, F.lit("["), i.cast("string"), F.lit("]"))))))
    if items:
        errors.append(F.when(_is("array", found), F.concat(*items)).otherwise(_none()))
    out = F.concat(*errors) if errors else _none()
    if not kinds:
        return out
    fits = reduce(lambda a, b: a | b, (_is(k, found) for k in kinds))
    return F.when(fits, out).otherwise(_said(where, f"must be {' or '.join(SHOWN[k] for k in kinds)}"))


def errors(text: Column, schema: dict) -> Column:
    """An array of errors, empty for texts that fit."""
    return bound(F.try_parse_json(text), lambda v: F.when(v.isNull(), F.array(F.lit("value must be JSON"))).otherwise(_node(schema, v, F.lit(""))))


def load(spark: SparkSession, default: dict, *overrides: str) -> dict:
    """The schema of the first of some files that exists, else the default. A file that isn't a JSON object is an error."""
    for path in overrides:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            schema = json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))
            if not isinstance(schema, dict):
                raise ValueError(f"{path} holds no JSON object")
            return schema
    return default


def contradictions(keys: tuple[str, str, str]) -> dict:
    """Pages with contradictions whose three fields bear these names."""
    claim = {"type": "object", "required": list(keys), "properties": dict.fromkeys(keys, {"type": "string", "minLength": 1}), "additionalProperties": False}
    page = {"type": "object", "required": ["existing_path"], "properties": {"existing_path": {"type": "string"}, "confidence": {"enum": ["high", "medium", "low"]}, "contradictions": {"type": "array", "items": claim}}}
    return {"type": "object", "required": ["pages_to_update"], "properties": {"pages_to_update": {"type": "array", "items": page}}}


#: The two shapes of a contradiction's fields (fixed values).
SHORT, LONG = contradictions(("existing", "new", "source")), contradictions(("existing_claim", "new_claim", "source_location"))
