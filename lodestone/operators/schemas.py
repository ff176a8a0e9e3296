"""JSON values checked against schemas, node by node, with the path of every error.

The schema is walked once, when the plan is made; it becomes one expression over the parsed ``variant``, so a table of any size is checked in
one pass. Each node of a nested object and every item of an array is checked.
"""

from __future__ import annotations

import json as J

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

NONE = "cast(array() as array<string>)"
#: The most rows of a table and the most items of a key-value list.
MAX_ROWS, MAX_ITEMS = 100, 48
_ARTICLE = {"string": "a", "number": "a", "integer": "an", "boolean": "a"}


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is(v: Column, name: str) -> Column:
    """Whether a variant has a JSON type; integers are numbers without a fraction, however written."""
    kind = _kind(v)
    if name in ("number", "integer"):
        real = F.when(F.regexp_like(kind, F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")), F.try_variant_get(v, "$", "double"))
        return F.coalesce((real == F.floor(real)) if name == "integer" else real.isNotNull(), F.lit(False))
    return F.coalesce(F.startswith(kind, F.lit({"string": "STRING", "boolean": "BOOLEAN", "object": "OBJECT<", "array": "ARRAY<", "null": "VOID"}[name])), F.lit(False))


def _field(v: Column, key: str) -> Column:
    """The value of a key; null where there is none (a JSON null is a value)."""
    quote = '"' if "'" in key else "'"
    if quote in key:
        raise ValueError(f"a key with both quotes: {key}")
    return F.try_variant_get(v, f"$[{quote}{key}{quote}]", "variant")


def _items(v: Column) -> Column:
    return F.coalesce(F.when(_is(v, "array"), F.try_variant_get(v, "$", "array<variant>")), F.expr("cast(array() as array<variant>)"))


def _same(v: Column, value: object) -> Column:
    if value is None:
        return _is(v, "null")
    if isinstance(value, bool):
        return _is(v, "boolean") & F.coalesce(F.try_variant_get(v, "$", "boolean") == value, F.lit(False))
    if isinstance(value, (int, float)):
        return _is(v, "number") & F.coalesce(F.try_variant_get(v, "$", "double") == float(value), F.lit(False))
    return _is(v, "string") & F.coalesce(F.try_variant_get(v, "$", "string") == value, F.lit(False))


def _said(bad: Column, path: Column, text: str) -> Column:
    return F.when(bad, F.array(F.concat(path, F.lit(text)))).otherwise(F.expr(NONE))


def node_errors(v: Column, node: dict, path: Column) -> Column:
    """The errors of a variant against a schema node: type (one or several), required, properties, additionalProperties (a schema),
    items, minItems, maxItems, minimum, maximum, minLength, maxLength, enum. Errors below a node of the wrong type are not looked for.

    In order: required keys, properties, other keys by name; items by index. A node without a type is checked as an object if it has
    properties, as an array if it has items.
    """
    kinds = node.get("type")
    kinds = kinds if isinstance(kinds, list) else [kinds or ("object" if "properties" in node else "array" if "items" in node else None)]
    if kinds == ["object"]:
        known = node.get("properties") or {}
        parts = [_said(_field(v, k).isNull(), path, f".{k} is required") for k in node.get("required") or []]
        parts += [F.when(_field(v, k).isNotNull(), node_errors(_field(v, k), child, F.concat(path, F.lit(f".{k}")))).otherwise(F.expr(NONE)) for k, child in known.items()]
        if isinstance(node.get("additionalProperties"), dict):
            others = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
            if known:
                others = F.filter(others, lambda e: ~e["key"].isin(*known))
            others = F.array_sort(F.transform(others, lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value"))))
            child = node["additionalProperties"]
            parts.append(F.flatten(F.transform(others, lambda e: node_errors(F.parse_json(e["value"]), child, F.concat(path, F.lit("."), e["key"])))))
        inner = F.concat(*parts) if parts else F.expr(NONE)
        return F.when(_is(v, "object"), inner).otherwise(F.array(F.concat(path, F.lit(" must be an object"))))
    if kinds == ["array"]:
        n, parts = F.size(_items(v)), []
        if "minItems" in node:
            parts.append(_said(n < node["minItems"], path, f" must contain at least {node['minItems']} item(s)"))
        if "maxItems" in node:
            parts.append(_said(n > node["maxItems"], path, f" must contain at most {node['maxItems']} item(s)"))
        if node.get("items"):
            parts.append(F.flatten(F.transform(_items(v), lambda x, i: node_errors(x, node["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
        inner = F.concat(*parts) if parts else F.expr(NONE)
        return F.when(_is(v, "array"), inner).otherwise(F.array(F.concat(path, F.lit(" must be an array"))))
    if len(kinds) > 1:
        fits = _is(v, kinds[0])
        for k in kinds[1:]:
            fits = fits | _is(v, k)
        return _said(~fits, path, f" must be one of: {', '.join(kinds)}")
    parts = []
    if node.get("enum"):
        allowed = _same(v, node["enum"][0])
        for value in node["enum"][1:]:
            allowed = allowed | _same(v, value)
        parts.append(_said(~allowed, path, f" must be one of: {', '.join(x if isinstance(x, str) else J.dumps(x) for x in node['enum'])}"))
    sizes = {"minimum": ("number", "double", "at least"), "maximum": ("number", "double", "at most"), "minLength": ("string", "string", "at least"), "maxLength": ("string", "string", "at most")}
    for rule, (kind, cast, words) in sizes.items():
        if rule in node:
            value = F.when(_is(v, kind), F.try_variant_get(v, "$", cast))
            value = F.length(value) if kind == "string" else value
            bad = value < node[rule] if words == "at least" else value > node[rule]
            parts.append(_said(F.coalesce(bad, F.lit(False)), path, f" must be {words} {node[rule]}" + (" characters" if kind == "string" else "")))
    inner = F.concat(*parts) if parts else F.expr(NONE)
    if kinds[0] is None:
        return inner
    return F.when(_is(v, kinds[0]), inner).otherwise(F.array(F.concat(path, F.lit(f" must be {_ARTICLE[kinds[0]]} {kinds[0]}"))))


def config_errors(json: Column, schema: dict, kind: str = "", root: str = "config") -> Column:
    """The errors of a JSON text against a schema, then those of its kind: a table has columns and 1 to MAX_ROWS rows; a plan has phases, each
    with tasks; a key-value list has 1 to MAX_ITEMS items, each with a key and a value. No text, and text that is no JSON, is no object."""
    v = F.try_parse_json(F.coalesce(json, F.lit("")))
    at = F.lit(root)
    parts = [F.when(v.isNull(), F.array(F.lit(f"{root} must be an object"))).otherwise(node_errors(v, schema, at))]
    many = lambda name: F.size(_items(_field(v, name)))
    none = lambda name, what: _said(many(name) < 1, at, f".{name} must contain at least 1 {what}")
    each = lambda name, check: F.flatten(F.transform(_items(_field(v, name)), lambda x, i: check(x, F.concat(F.lit(f"{root}.{name}["), i.cast("string"), F.lit("]")))))
    if kind == "table":
        parts += [none("columns", "item"), none("rows", "item"), _said(many("rows") > MAX_ROWS, at, f".rows must contain at most {MAX_ROWS} items")]
    elif kind == "plan":
        parts += [none("phases", "item"), each("phases", lambda x, p: _said(F.size(_items(_field(x, "tasks"))) < 1, p, ".tasks must contain at least 1 item"))]
    elif kind == "key-value":
        text = lambda x, name: F.coalesce(F.try_variant_get(_field(x, name), "$", "string"), F.lit(""))
        unset = lambda x: F.coalesce(_is(_field(x, "value"), "null") | _field(x, "value").isNull() | _same(_field(x, "value"), ""), F.lit(True))
        parts += [none("items", "metric"), _said(many("items") > MAX_ITEMS, at, f".items must contain at most {MAX_ITEMS} metrics")]
        parts.append(each("items", lambda x, p: F.concat(_said(F.trim(text(x, "key")) == "", p, ".key is required"), _said(unset(x), p, ".value is required"))))
    return F.concat(*parts)


# --- queries over the tables ---------------------------------------------------------------------------------------

_CELL = {"type": "object", "required": ["n", "line"], "properties": {"n": {"type": "integer", "minimum": -20, "maximum": 400}, "line": {"type": "string", "minLength": 1}, "tags": {"type": "object", "additionalProperties": {"type": ["string", "boolean"]}}}}
TABLE = {"type": "object", "required": ["columns", "rows", "title"], "properties": {"title": {"type": "string", "enum": ["en", "de", "fr"]}, "columns": {"type": "array", "minItems": 2, "items": {"type": "string"}}, "rows": {"type": "array", "items": _CELL}}}


def line_table_errors(spark: SparkSession, d: str) -> DataFrame:
    """Documents as tables of their lines, with faults that follow from the lines: how many errors, and which.

    A line's row has its length, as text where 5 divides it, below zero and with an exponent where 7 does, with a fraction where 11 does;
    blank lines are left out of it, and its tags are a number where 13 divides it.
    """
    n = lambda x: F.length(x)
    number = lambda x: F.when(n(x) % 5 == 0, F.concat(F.lit('"'), n(x).cast("string"), F.lit('"'))).when(n(x) % 7 == 0, F.concat(F.lit("-"), n(x).cast("string"), F.lit("e0"))).when(n(x) % 11 == 0, F.concat(n(x).cast("string"), F.lit(".5"))).otherwise(n(x).cast("string"))
    line = lambda x: F.when(n(x) > 0, F.concat(F.lit(',"line":'), F.substring(F.to_json(F.array(x)), 2, 1 << 30))).otherwise(F.lit("]"))
    tags = lambda x: F.when(n(x) % 13 == 0, F.lit(',"tags":{"b":1.5,"a":true}')).otherwise(F.lit(',"tags":{"a":"x"}'))
    row = lambda x: F.concat(F.lit('{"n":'), number(x), F.regexp_replace(line(x), r"\]$", ""), tags(x), F.lit("}"))
    body = F.array_join(F.transform(F.split("text", "\n"), row), ",")
    made = F.concat(F.lit('{"title":'), F.coalesce(F.concat(F.lit('"'), F.col("lang"), F.lit('"')), F.lit("null")), F.lit(',"columns":["n"'), F.when(F.col("lang") == "en", F.lit(',"line"')).otherwise(""), F.lit('],"rows":['), body, F.lit("]}"))
    errors = config_errors(F.col("json"), TABLE, "table")
    return table(spark, d, "documents").select("doc_id", made.alias("json")).select("doc_id", errors.alias("e")).select("doc_id", F.size("e").cast("long").alias("errors"), F.sha2(F.array_join("e", "\n"), 256).alias("errors_hash"))


QUERIES = {"line_table_errors": line_table_errors}

ORACLE_SQL = {
    "line_table_errors": """WITH d AS (SELECT doc_id, lang, text, string_split(text, chr(10)) AS l FROM documents),
r AS (SELECT doc_id, i - 1 AS i, length(x) AS n FROM d, unnest(l) WITH ORDINALITY AS u(x, i)),
e AS (SELECT doc_id, 1000000 AS a, 0 AS b, 'config.title must be one of: en, de, fr' AS t FROM d WHERE text IS NOT NULL AND lang NOT IN ('en', 'de', 'fr')
UNION ALL SELECT doc_id, 1000000, 0, 'config.title must be a string' FROM d WHERE text IS NOT NULL AND lang IS NULL
UNION ALL SELECT doc_id, 1000000, 1, 'config.columns must contain at least 2 item(s)' FROM d WHERE text IS NOT NULL AND lang IS DISTINCT FROM 'en'
UNION ALL SELECT doc_id, 2000000 + i, 0, 'config.rows[' || i || '].line is required' FROM r WHERE n = 0
UNION ALL SELECT doc_id, 2000000 + i, 1, 'config.rows[' || i || '].n must be an integer' FROM r WHERE n % 5 = 0 OR (n % 7 <> 0 AND n % 11 = 0)
UNION ALL SELECT doc_id, 2000000 + i, 1, 'config.rows[' || i || '].n must be at least -20' FROM r WHERE n % 5 <> 0 AND n % 7 = 0 AND n > 20
UNION ALL SELECT doc_id, 2000000 + i, 1, 'config.rows[' || i || '].n must be at most 400' FROM r WHERE n % 5 <> 0 AND n % 7 <> 0 AND n % 11 <> 0 AND n > 400
UNION ALL SELECT doc_id, 2000000 + i, 2, 'config.rows[' || i || '].tags.b must be one of: string, boolean' FROM r WHERE n % 13 = 0
UNION ALL SELECT doc_id, 90000000000, 0, 'config.rows must contain at most 100 items' FROM d WHERE len(l) > 100
UNION ALL SELECT doc_id, 0, x, ['config must be an object', 'config.columns must contain at least 1 item', 'config.rows must contain at least 1 item'][x] FROM d, range(1, 4) AS g(x) WHERE text IS NULL)
SELECT d.doc_id, count(e.doc_id) AS errors, sha256(coalesce(string_agg(t, chr(10) ORDER BY a, b), '')) AS errors_hash FROM d LEFT JOIN e USING (doc_id) GROUP BY 1""",
}
