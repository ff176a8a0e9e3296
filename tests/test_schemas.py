"""Nested and row errors of JSON values, with their paths."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators.schemas import config_errors

ITEM = {"type": "object", "required": ["k"], "properties": {"k": {"type": "number", "minimum": 10, "maximum": 90}, "it's": {"type": ["string", "null"]}}}
SCHEMA = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "minItems": 1, "maxItems": 3, "items": ITEM}, "b": {"type": "boolean"}, "c": {"enum": [1, "x", None, True]}, "s": {"type": "string", "maxLength": 2}}, "additionalProperties": {"type": "integer"}}


def errors(spark, values, schema=SCHEMA, kind=""):
    df = spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "i int, j string")
    return [r.e for r in df.select("i", config_errors(F.col("j"), schema, kind, "v").alias("e")).orderBy("i").collect()]


def test_nested_paths_and_numbers(spark):
    got = errors(spark, [
        {"a": [{"k": 10}, {"k": 9.9}, {"k": -5}]}, {"a": [{"k": 200.5}, {"k": "50"}, {"k": 5e1}]}, {"a": []}, {"a": [{"k": 11}] * 4}, {"b": None},
        {"a": [{"k": 11, "it's": 4}, 7]}, {"a": {}, "b": 0, "s": "abc"}, {"a": [{"k": 11}], "z": 1.0, "y": 1.5, "x": "1"},
    ])
    assert got == [
        ["v.a[1].k must be at least 10", "v.a[2].k must be at least 10"], ["v.a[0].k must be at most 90", "v.a[1].k must be a number"], ["v.a must contain at least 1 item(s)"],
        ["v.a must contain at most 3 item(s)"], ["v.a is required", "v.b must be a boolean"], ["v.a[0].it's must be one of: string, null", "v.a[1] must be an object"],
        ["v.a must be an array", "v.b must be a boolean", "v.s must be at most 2 characters"], ["v.x must be an integer", "v.y must be an integer"],
    ]


def test_enum_and_what_is_no_object(spark):
    a = [{"k": 11}]
    got = errors(spark, [{"a": a, "c": c} for c in (1, "x", None, True, "1", 2, False)] + [None, "", "{", "[]", "null", "3"])
    bad = ["v.c must be one of: 1, x, null, true"]
    assert got == [[], [], [], [], bad, bad, bad] + [["v must be an object"]] * 6


@pytest.mark.parametrize("kind", ["table", "plan", "key-value"])
def test_rules_of_kinds(spark, kind):
    values, expected = {
        "table": ([{"columns": [1], "rows": [1] * 100}, {"columns": [], "rows": [1] * 101}, {"rows": 5}], [[], ["v.columns must contain at least 1 item", "v.rows must contain at most 100 items"], ["v.columns must contain at least 1 item", "v.rows must contain at least 1 item"]]),
        "plan": ([{"phases": [{"tasks": [1]}, {}, 5]}, {}], [["v.phases[1].tasks must contain at least 1 item", "v.phases[2].tasks must contain at least 1 item"], ["v.phases must contain at least 1 item"]]),
        "key-value": ([{"items": [{"key": " ", "value": 0}, {"key": "a", "value": ""}, {"key": 5, "value": None}, 3]}, {"items": [{"key": "a", "value": False}] * 49}], [["v.items[0].key is required", "v.items[1].value is required", "v.items[2].value is required", "v.items[3].key is required", "v.items[3].value is required"], ["v.items must contain at most 48 metrics"]]),
    }[kind]
    assert errors(spark, values, {"type": "object"}, kind) == expected
