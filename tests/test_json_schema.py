"""Compiled schemas against expected errors, kind by kind."""

import json

import pytest
from pyspark.sql import functions as F

from tessarium.functions import json_schema

NESTED = {"type": "object", "required": ["a"], "properties": {"a": {"type": ["string", "null"]}, "l": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 1, "maximum": 5}}}}, "n": {"type": "number"}, "b": {"type": "boolean"}, "e": {"enum": ["u", 2]}, "s": {"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^[a-z]+$"}}}
CASES = [
    ({"a": "x"}, []),
    ({"a": None}, []),
    ({"a": 1}, ["a must be a string or null"]),
    ({}, ["a is missing"]),
    ([], ["value must be an object"]),
    ("text", ["value must be an object"]),
    (None, ["value must be an object"]),
    ({"a": "", "l": [{"x": 1}, {"x": 9}]}, ["l[1].x is too large"]),
    ({"a": "", "l": [{"x": 0}, {}, 3]}, ["l has too many items", "l[0].x is too small", "l[1].x is missing", "l[2] must be an object"]),
    ({"a": "", "l": []}, ["l has too few items"]),
    ({"a": "", "l": {}}, ["l must be an array"]),
    ({"a": "", "l": [{"x": "1"}]}, ["l[0].x must be an integer"]),
    ({"a": "", "n": 1.5, "b": True, "e": 2}, []),
    ({"a": "", "n": 10**30, "b": 0, "e": "w"}, ["b must be a boolean", "e is not one of the allowed values: w"]),
    ({"a": "", "s": "x"}, ["s is too short"]),
    ({"a": "", "s": "WXYZ"}, ["s is too long", "s doesn't match its pattern"]),
    ({"a": "", "more.of": {"$[0]": 1}}, []),
]


def test_errors(spark):
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(CASES)] + [(100, None), (101, ""), (102, '{"a"')], "i int, text string")
    got = {r.i: r.errors for r in rows.select("i", json_schema.errors(F.col("text"), NESTED).alias("errors")).collect()}
    assert {i: sorted(x) for i, x in got.items() if i < 100} == {i: sorted(want) for i, (_, want) in enumerate(CASES)}
    assert got[100] == got[101] == got[102] == ["value must be JSON"]


def test_no_python_worker_is_needed(spark):
    plan = spark.range(1).select(json_schema.errors(F.col("id").cast("string"), NESTED))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_file_overrides_the_default(spark, tmp_path):
    default = {"type": "object"}
    assert json_schema.load(spark, default, f"{tmp_path}/none.json") == default
    (tmp_path / "own.json").write_text('{\n "type":\n "array"}')
    assert json_schema.load(spark, default, f"{tmp_path}/none.json", f"{tmp_path}/own.json") == {"type": "array"}
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(ValueError, match="no JSON object"):
        json_schema.load(spark, default, f"{tmp_path}/bad.json")
