"""JSON texts checked against JSON Schemas: a schema becomes one column expression over a parsed value, without Python per row."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import each

FOUND = "array<struct<path:string,rule:string>>"
ANNOTATIONS = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "format", "definitions", "readOnly", "writeOnly"}
KINDS = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")}


def _when(bad: Column, path: Column, rule: str) -> Column:
    return F.when(bad, F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))).otherwise(F.array().cast(FOUND))


class _Value:
    """A value inside a parsed text: a base column, the steps from there, and the path to show."""

    def __init__(self, base: Column, steps: str, path: Column):
        self.base, self.steps, self.path = base, steps, path

    def get(self, kind: str) -> Column:
        return F.try_variant_get(self.base, f"${self.steps}", kind)

    def child(self, name: str) -> _Value:
        if "'" in name or "\\" in name:
            raise ValueError(f"a property's name may hold neither quotes nor backslashes: {name!r}")
        return _Value(self.base, f"{self.steps}['{name}']", F.concat(self.path, F.lit(f".{name}")))

    @property
    def there(self) -> Column:
        return self.get("variant").isNotNull()

    @property
    def kind(self) -> Column:
        """OBJECT, ARRAY, STRING, BIGINT and so on; VOID for a JSON null."""
        return F.regexp_extract(F.schema_of_variant(self.get("variant")), "^[A-Z]+", 0)

    def is_a(self, name: str) -> Column:
        if name == "integer":
            return self.is_a("number") & (self.get("double") == F.floor(self.get("double")))
        return self.kind.isin(*KINDS[name])


def _equal(v: _Value, wanted: Any) -> Column:
    if wanted is None:
        return v.is_a("null")
    if isinstance(wanted, bool):
        return v.is_a("boolean") & (v.get("boolean") == F.lit(wanted))
    if isinstance(wanted, (int, float)):
        return v.is_a("number") & (v.get("double") == F.lit(float(wanted)))
    if isinstance(wanted, str):
        return v.is_a("string") & (v.get("string") == F.lit(wanted))
    return F.to_json(v.get("variant")) == F.to_json(F.parse_json(F.lit(json.dumps(wanted))))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out |= F.coalesce(c, F.lit(False))
    return out


def _found(v: _Value, schema: dict | bool) -> list[Column]:
    """Arrays of what a value, which is there, has against a schema."""
    if schema is True or schema == {}:
        return []
    if schema is False:
        return [_when(F.lit(True), v.path, "not allowed")]
    known = {"type", "enum", "const", "required", "properties", "additionalProperties", "items", "minItems", "maxItems"}
    sizes = {"minimum": "<", "maximum": ">", "exclusiveMinimum": "<=", "exclusiveMaximum": ">="}
    texts = {"minLength", "maxLength", "pattern"}
    if unknown := set(schema) - known - set(sizes) - texts - ANNOTATIONS:
        raise ValueError(f"schema keywords that are not supported: {sorted(unknown)}")
    out: list[Column] = []
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        out.append(_when(~_any([v.is_a(k) for k in kinds]), v.path, "type"))
    for rule in ("enum", "const"):
        if rule in schema:
            out.append(_when(~_any([_equal(v, x) for x in (schema[rule] if rule == "enum" else [schema[rule]])]), v.path, rule))
    for rule, sign in sizes.items():
        if rule in schema:
            n, most = v.get("double"), F.lit(float(schema[rule]))
            bad = {"<": n < most, ">": n > most, "<=": n <= most, ">=": n >= most}[sign]
            out.append(_when(v.is_a("number") & bad, v.path, rule))
    text = v.get("string")
    for rule, bad in (("minLength", lambda n: F.length(text) < n), ("maxLength", lambda n: F.length(text) > n), ("pattern", lambda rx: ~text.rlike(rx))):
        if rule in schema:
            out.append(_when(v.is_a("string") & bad(schema[rule]), v.path, rule))
    for name in schema.get("required", ()):
        out.append(_when(v.is_a("object") & ~v.child(name).there, v.child(name).path, "required"))
    for name, inner in schema.get("properties", {}).items():
        child = v.child(name)
        for c in _found(child, inner):
            out.append(F.when(v.is_a("object") & child.there, c).otherwise(F.array().cast(FOUND)))
    if (more := schema.get("additionalProperties", True)) is not True and more != {}:
        if more is not False:
            raise ValueError("additionalProperties may be true or false")
        names = F.map_keys(v.get("map<string,variant>"))
        odd = F.filter(names, lambda k: ~k.isin(*schema.get("properties", {})) if schema.get("properties") else F.lit(True))
        told = F.transform(odd, lambda k: F.struct(F.concat(v.path, F.lit("."), k).alias("path"), F.lit("additionalProperties").alias("rule")))
        out.append(F.when(v.is_a("object"), told).otherwise(F.array().cast(FOUND)))
    array = v.get("array<variant>")
    for rule, bad in (("minItems", lambda n: F.size(array) < n), ("maxItems", lambda n: F.size(array) > n)):
        if rule in schema:
            out.append(_when(v.is_a("array") & bad(schema[rule]), v.path, rule))
    items = schema.get("items", True)
    if isinstance(items, list):
        raise ValueError("items may be one schema for all")
    if items is not True and items != {}:
        told = F.transform(array, lambda x, i: F.concat(F.array().cast(FOUND), *_found(_Value(x, "", F.concat(v.path, F.lit("["), i.cast("string"), F.lit("]"))), items)))
        out.append(F.when(v.is_a("array"), F.flatten(told)).otherwise(F.array().cast(FOUND)))
    return out


def broken_rules(value: Column, schema: dict) -> Column:
    """array of (path, rule) of a parsed value (a variant): $ for the whole, $.a.b[2] inside; empty if all is well. A null value is no JSON."""
    found = F.concat(F.array().cast(FOUND), *_found(_Value(value, "", F.lit("$")), schema))
    return F.coalesce(F.when(value.isNull(), F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule")))).otherwise(found), F.array().cast(FOUND))


def check(rows: DataFrame, column: str, schema: dict, out: str = "broken") -> DataFrame:
    """rows with the rules that each JSON text breaks.

    Keywords: type, enum, const, required, properties, additionalProperties (true, false), items, lengths, sizes and bounds;
    annotations count for nothing, any other keyword is refused. A null text, or one that is no JSON, breaks `json`.
    """
    parsed = rows.withColumn("_parsed", F.try_parse_json(F.col(column)))  # by itself, as the rules read it dozens of times
    return parsed.withColumn(out, broken_rules(F.col("_parsed"), schema)).drop("_parsed")


def summary(rows: DataFrame, column: str, schema: dict) -> DataFrame:
    """(path, rule, n): how many texts break each rule at each path; places in arrays are told as [*]."""
    broken = each(check(rows.select(column), column, schema, "_broken"), F.col("_broken"), "b")
    return broken.select(F.regexp_replace("b.path", r"\[\d+\]", "[*]").alias("path"), "b.rule").groupBy("path", "rule").agg(F.count(F.lit(1)).alias("n"))
