"""JSON texts against schemas."""

import json

import pytest

from tessera.sources import contracts

SCHEMA = {
    "type": "object", "required": ["id", "hits"], "title": "hit list", "properties": {
        "id": {"type": "string", "minLength": 2, "pattern": "^h"}, "score": {"type": ["number", "null"], "minimum": 0, "exclusiveMaximum": 1}, "n": {"type": "integer"},
        "hits": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "object", "required": ["rank"], "properties": {"rank": {"type": "integer", "minimum": 1}, "tags": {"type": "array", "items": {"enum": ["a", 1, None, True, {"k": [1]}]}}}}},
        "mode": {"const": "x"}, "free": {},
    },
}
GOOD = {"id": "h1", "hits": [{"rank": 1}]}
CASES = [
    (GOOD, []), ({**GOOD, "score": None, "n": 3.0, "free": [1, {}], "more": 2}, []), ({**GOOD, "score": 1}, [("$.score", "exclusiveMaximum")]), ({**GOOD, "score": "1"}, [("$.score", "type")]),
    ({"id": 5}, [("$.hits", "required"), ("$.id", "type")]), ({**GOOD, "id": "x"}, [("$.id", "minLength"), ("$.id", "pattern")]), ({**GOOD, "n": 1.5}, [("$.n", "type")]), ({**GOOD, "n": True}, [("$.n", "type")]),
    ({"id": "h1", "hits": []}, [("$.hits", "minItems")]), ({"id": "h1", "hits": None}, [("$.hits", "type")]), ({"id": "h1", "hits": [{"rank": 0}, {}, 7]}, [("$.hits", "maxItems"), ("$.hits[0].rank", "minimum"), ("$.hits[1].rank", "required"), ("$.hits[2]", "type")]),
    ({"id": "h1", "hits": [{"rank": 1, "tags": ["a", 1.0, None, True, {"k": [1]}, "b", False]}]}, [("$.hits[0].tags[5]", "enum"), ("$.hits[0].tags[6]", "enum")]), ({**GOOD, "mode": "y"}, [("$.mode", "const")]), ([], [("$", "type")]), (None, [("$", "type")]),
]


def test_rules_by_path(spark):
    rows = [(i, json.dumps(v)) for i, (v, _) in enumerate(CASES)] + [(100, None), (101, "{"), (102, "")]
    got = contracts.check(spark.createDataFrame(rows, "i int, text string"), "text", SCHEMA).collect()
    want = {i: w for i, (_, w) in enumerate(CASES)} | {i: [("$", "json")] for i in (100, 101, 102)}
    assert {r.i: sorted(map(tuple, r.broken)) for r in got} == want


def test_unknown_keywords_are_refused(spark):
    rows = spark.createDataFrame([("{}",)], "text string")
    for schema in ({"oneOf": []}, {"properties": {"a": {"$ref": "#"}}}, {"items": [{}]}, {"properties": {"a'b": {"type": "null"}}}):
        with pytest.raises(ValueError):
            contracts.check(rows, "text", schema)
    assert contracts.summary(rows.limit(0), "text", SCHEMA).count() == 0


def test_a_text_is_parsed_once_a_row(spark):
    from tessera.plans.mentions import EVENT

    rows = spark.createDataFrame([("{}",), ("x",), (None,)], "t string").repartition(1)
    plan = contracts.summary(rows, "t", EVENT)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") == 1 or plan.count("parseJson") == 1, plan[:3000]
