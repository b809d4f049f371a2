"""Schemas: each keyword, references, parts that hold together, defaults in structs."""

import pytest

from rillflow.functions.tables import violations, with_defaults


def problems(rows, schema, documents=None):
    return sorted((r[0], r[1]) for r in violations(rows, schema, "id", documents).collect())


def test_keywords_of_lists_and_alternatives(spark):
    rows = spark.createDataFrame([(1, [1, 2], 4.0), (2, [3, 3, 9], 2.5), (3, None, None), (4, [], 9.0)], "id int, l array<int>, x double")
    schema = {"properties": {"l": {"minItems": 1, "maxItems": 2, "uniqueItems": True, "items": {"maximum": 5}}, "x": {"oneOf": [{"minimum": 3}, {"type": "integer"}], "enum": [4.0, 2.5, 9.0]}}}
    got = problems(rows, schema)
    # 4.0 and 9.0 fit both alternatives, 2.5 none
    assert got == [(1, "x: oneOf"), (2, "l: items"), (2, "l: maxItems"), (2, "l: uniqueItems"), (2, "x: oneOf"), (4, "l: minItems"), (4, "x: oneOf")]


def test_types_const_and_further_columns(spark):
    rows = spark.createDataFrame([(1, "a", True), (2, None, None)], "id int, s string, b boolean")
    schema = {"additionalProperties": False, "properties": {"id": {}, "s": {"type": "integer", "const": "b"}}, "required": ["s"]}
    assert problems(rows, schema) == [(1, "b: additionalProperties"), (1, "s: const"), (1, "s: type"), (2, "s: required")]
    assert problems(rows, {}) == []
    assert problems(rows.limit(0), schema) == []


def test_references_lead_through_documents_and_not_in_circles(spark):
    rows = spark.sql("select 1 id, named_struct('baz', named_struct('qux', cast(null as int))) bar union all select 2, named_struct('baz', null) union all select 3, null")
    top = {"properties": {"bar": {"$ref": "bar"}}}
    docs = {"bar": {"properties": {"baz": {"$ref": "baz"}}, "required": ["baz"]}, "baz": {"properties": {"qux": {"type": "integer", "default": 42}}, "required": ["qux"]}}
    assert problems(rows, top, docs) == [(1, "bar.baz.qux: required"), (2, "bar.baz: required")]
    filled = {r.id: r.bar for r in with_defaults(rows, top, docs).collect()}
    assert filled[1].baz.qux == 42 and filled[2].baz is None and filled[3] is None
    with pytest.raises(ValueError, match="itself"):
        violations(rows, {"$ref": "#/$defs/a", "$defs": {"a": {"$ref": "#/$defs/b"}, "b": {"$ref": "#/$defs/a"}}}, "id")
    with pytest.raises(KeyError):
        violations(rows, {"$ref": "none"}, "id")


def test_first_default_holds_and_struct_defaults_add_up(spark):
    rows = spark.sql("select 1 id, named_struct('a', cast(null as int), 'b', cast(null as string)) foo")
    part = lambda name, value: {"properties": {name: {"default": value}}}
    got = with_defaults(rows, {"properties": {"foo": {"allOf": [part("a", 1), part("b", "x"), part("a", 2), part("c", True)]}, "new": {"default": "n"}}}).first()
    assert (got.foo.a, got.foo.b, got.foo.c, got.new) == (1, "x", True, "n")
