"""Tables as parameters: the codec between rows and paths, and validation of rows against a schema."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import compile_pattern


@dataclass(frozen=True)
class Paramspace:
    """Rows of parameters as paths such as 'alpha~1/beta~2', and back to typed values. Missing values are 'NA'."""

    rows: DataFrame
    filename_params: tuple[str, ...] = ()
    param_sep: str = "~"
    filename_sep: str = "_"

    @property
    def columns(self) -> list[str]:
        unknown = set(self.filename_params) - set(self.rows.columns)
        if unknown:
            raise KeyError(f"no such columns: {sorted(unknown)}")
        if len(set(self.filename_params)) < len(self.filename_params):
            raise ValueError("a column stands twice in filename_params")
        return [c for c in self.rows.columns if c not in self.filename_params] + list(self.filename_params)

    @property
    def wildcard_pattern(self) -> str:
        part = lambda c: f"{c}{self.param_sep}{{{c}}}"
        folders = [part(c) for c in self.columns if c not in self.filename_params]
        name = self.filename_sep.join(part(c) for c in self.filename_params)
        return "/".join([*folders, *([name] if name else [])])

    def instances(self) -> DataFrame:
        """One path for each row."""
        p = compile_pattern(self.wildcard_pattern)
        return self.rows.select(p.fill({c: F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in self.columns}).alias("path"))

    def decode(self, paths: DataFrame, column: str = "path") -> DataFrame:
        """Typed values of every path of the pattern; what can't be read as the column's type is null."""
        p = compile_pattern(self.wildcard_pattern, "[^/]+?")
        kinds = dict(self.rows.dtypes)
        values = p.values(F.col(column))
        return paths.where(p.matches(F.col(column))).select(*(F.nullif(values[c], F.lit("NA")).try_cast(kinds[c]).alias(c) for c in self.columns))


#: The column types that hold each JSON type.
JSON_TYPES = {
    "string": (T.StringType,), "integer": (T.IntegralType,), "number": (T.NumericType,), "boolean": (T.BooleanType,),
    "array": (T.ArrayType,), "object": (T.StructType, T.MapType), "null": (T.NullType,),
}


def _parts(rule: dict, root: dict, documents: dict[str, dict], passed: tuple = ()) -> Iterator[tuple[dict, dict]]:
    """The schemas that hold together with a rule (itself, what $ref names, each of allOf), each with the document it stands in."""
    yield rule, root
    if "$ref" in rule:
        name, _, place = rule["$ref"].partition("#")
        whole = part = documents[name] if name else root
        for step in place.split("/")[1:]:
            part = part[step.replace("~1", "/").replace("~0", "~")]
        if (name, place, id(whole)) in passed:
            raise ValueError(f"a reference leads back to itself: {rule['$ref']}")
        yield from _parts(part, whole, documents, (*passed, (name, place, id(whole))))
    for part in rule.get("allOf", ()):
        yield from _parts(part, root, documents, passed)


def _breaks(kind: T.DataType, rule: dict, root: dict, documents: dict[str, dict]) -> Callable[[Column], Column]:
    """Whether a value breaks any keyword of a rule."""
    return lambda c: reduce(Column.__or__, (F.coalesce(t, F.lit(False)) for _, t in _tests(c, kind, rule, root, documents)), F.lit(False))


def _fits(c: Column, kind: T.DataType, name: str) -> Column:
    """Whether a value is of a JSON type: its column's type says so, but for whole numbers among fractions."""
    if name == "integer" and isinstance(kind, T.FractionalType | T.DecimalType):
        return c % 1 == 0
    return F.lit(isinstance(kind, JSON_TYPES[name]))


def _tests(c: Column, kind: T.DataType, rule: dict, root: dict, documents: dict[str, dict], where: str = "") -> list[tuple[str, Column]]:
    """(problem, column that is true where it exists) for each keyword that applies to values of the column's type."""
    found = []
    inner = f"{where}." if where else ""
    for r, whole in _parts(rule, root, documents):
        add = lambda keyword, broken, at=where, r=r: found.append((f"{at}: {keyword}" if at else keyword, broken)) if keyword in r else None
        if "type" in r:
            names = [r["type"]] if isinstance(r["type"], str) else r["type"]
            add("type", c.isNotNull() & ~reduce(Column.__or__, (_fits(c, kind, n) for n in names)))
        if "enum" in r:
            add("enum", ~c.isin(r["enum"]))
        if "const" in r:
            add("const", c != F.lit(r["const"]))
        if isinstance(kind, T.StringType):
            add("pattern", ~c.rlike(r.get("pattern", "")))
            add("minLength", F.length(c) < r.get("minLength", 0))
            add("maxLength", F.length(c) > r.get("maxLength", 0))
        if isinstance(kind, T.NumericType):
            add("minimum", c < r.get("minimum", 0))
            add("maximum", c > r.get("maximum", 0))
            add("exclusiveMinimum", c <= r.get("exclusiveMinimum", 0))
            add("exclusiveMaximum", c >= r.get("exclusiveMaximum", 0))
            add("multipleOf", c % r.get("multipleOf", 1) != 0)
        if isinstance(kind, T.ArrayType):
            add("minItems", F.size(c) < r.get("minItems", 0))
            add("maxItems", F.size(c) > r.get("maxItems", 0))
            if r.get("uniqueItems"):
                add("uniqueItems", F.size(F.array_distinct(c)) < F.size(c))
            if "items" in r:
                add("items", F.exists(c, _breaks(kind.elementType, r["items"], whole, documents)))
        if isinstance(kind, T.StructType):
            fields = {f.name: f.dataType for f in kind.fields}
            for name, part in r.get("properties", {}).items():
                if name in fields:
                    found += _tests(c[name], fields[name], part, whole, documents, inner + name)
            for name in r.get("required", ()):
                found.append((f"{inner}{name}: required", c.isNotNull() & (c[name].isNull() if name in fields else F.lit(True))))
            if r.get("additionalProperties") is False:
                for name in fields.keys() - r.get("properties", {}).keys():
                    found.append((f"{inner}{name}: additionalProperties", c[name].isNotNull()))
        if "anyOf" in r:
            add("anyOf", reduce(Column.__and__, (_breaks(kind, p, whole, documents)(c) for p in r["anyOf"])))
        if "oneOf" in r:
            add("oneOf", c.isNotNull() & (reduce(Column.__add__, (F.when(_breaks(kind, p, whole, documents)(c), 0).otherwise(1) for p in r["oneOf"])) != 1))
        if "not" in r:
            add("not", c.isNotNull() & ~_breaks(kind, r["not"], whole, documents)(c))
    return found


def violations(rows: DataFrame, schema: dict, key: str, documents: dict[str, dict] | None = None) -> DataFrame:
    """(key, problem) of every rule of the schema that a row breaks, each problem once for a row.

    Keywords: type, enum, const, pattern, minLength, maxLength, minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf,
    minItems, maxItems, uniqueItems, items, properties (of structs too), required, additionalProperties (false), allOf, anyOf,
    oneOf, not, and $ref within the schema or into `documents` (name: schema). A keyword applies to values of its own kind
    only. Nulls count as absent: they break only `required`. A column that isn't there breaks `required` in every row.
    """
    tests = _tests(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), rows.schema, schema, schema, documents or {})
    found = F.array_distinct(F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests)).cast("array<string>")))
    return rows.select(key, F.explode(found).alias("problem"))


def _filled(c: Column, kind: T.StructType, rule: dict, root: dict, documents: dict[str, dict]) -> dict[str, Column]:
    """The fields of a struct that defaults change or add."""
    made: dict[str, Column] = {}
    fields = {f.name: f.dataType for f in kind.fields}
    for r, whole in _parts(rule, root, documents):
        for name, part in r.get("properties", {}).items():
            for p, home in _parts(part, whole, documents):
                now = made.get(name, c[name] if name in fields else None)
                if "default" in p:
                    made[name] = F.lit(p["default"]) if now is None else F.coalesce(now, F.lit(p["default"]).cast(fields[name]) if name in fields else F.lit(p["default"]))
                    now = made[name]
                # what this part says itself; those it refers to come in their turn
                inner = {k: v for k, v in p.items() if k == "properties"}
                if inner and isinstance(fields.get(name), T.StructType):
                    for field, value in _filled(now, fields[name], inner, home, documents).items():
                        made[name] = made.get(name, c[name]).withField(field, value)
    return made


def with_defaults(rows: DataFrame, schema: dict, documents: dict[str, dict] | None = None) -> DataFrame:
    """Nulls replaced by the schema's defaults, in structs too (a null struct stays null); columns and fields that are missing are made of them.

    Where several parts of a schema give a default, the first one holds. References as in violations().
    """
    return rows.withColumns(_filled(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), rows.schema, schema, schema, documents or {}))
