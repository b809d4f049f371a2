"""Algebra of wildcard patterns: names such as 'stats/{sample}.{kind,txt|csv}' over columns and tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.operators.planning import numbered

_WILDCARD = re.compile(r"\{\s*(\w+)\s*(?:,\s*((?:[^{}]|\{\d*,?\d*\})*?)\s*)?\}")


class WildcardError(ValueError):
    """A pattern has a wildcard for which there is no value."""


@dataclass(frozen=True)
class Pattern:
    """A pattern compiled to a Java regular expression; groups gives each wildcard's group number."""

    text: str
    regex: str
    groups: dict[str, int]
    parts: tuple[tuple[str, str | None], ...]  # literal text and the wildcard after it

    @property
    def prefix(self) -> str:
        return self.parts[0][0]

    @property
    def suffix(self) -> str:
        return self.parts[-1][0]

    def values(self, path: Column) -> dict[str, Column]:
        return {name: F.regexp_extract(path, self.regex, group) for name, group in self.groups.items()}

    def matches(self, path: Column) -> Column:
        """Plain prefix and suffix tests come before the expression."""
        return path.startswith(self.prefix) & path.endswith(self.suffix) & path.rlike(self.regex)

    def fill(self, values: dict[str, Column], allow_missing: bool = False) -> Column:
        out = []
        for literal, name in self.parts:
            out.append(F.lit(literal))
            if name is not None:
                if name not in values and not allow_missing:
                    raise WildcardError(f"no value for wildcard {name!r} in {self.text!r}")
                out.append(values[name].cast("string") if name in values else F.lit("{" + name + "}"))
        return F.concat(*out)


def compile_pattern(text: str, default: str = ".+") -> Pattern:
    """A repeated wildcard is a back-reference; a constraint counts where the name stands first."""
    at, group, regex, parts, groups = 0, 0, "^", [], {}
    for k, m in enumerate(_WILDCARD.finditer(text)):
        literal, name, constraint = text[at : m.start()], m[1], m[2]
        regex += re.escape(literal)
        if name in groups:
            if constraint:
                raise ValueError(f"constraint on a later {name!r} in {text!r}")
            regex += rf"\{groups[name]}"
        else:
            constraint = constraint or default
            groups[name] = group + 1
            group += 1 + re.compile(constraint).groups
            regex += f"({constraint})"
        parts.append((literal, name))
        at = m.end()
    return Pattern(text, regex + re.escape(text[at:]) + "$", groups, (*parts, (text[at:], None)))


def expand(pattern: str, tables: dict[str, DataFrame], how: str = "product", allow_missing: bool = False) -> DataFrame:
    """One path for each combination of values. tables: wildcard -> one-column DataFrame of values.

    product crosses the tables (their sizes multiply, as asked for); zip pairs rows in order of value and stops at the shortest.
    """
    p = compile_pattern(pattern)
    used = {k: t for k, t in tables.items() if k in p.groups}
    joined = None
    for k, t in used.items():
        t = t.select(F.col(t.columns[0]).alias(k))
        if how == "zip":
            t = numbered(t, [], [F.col(k)], "__n")
            joined = t if joined is None else joined.join(t, "__n")
        else:
            joined = t if joined is None else joined.crossJoin(t)
    if joined is None:
        raise WildcardError(f"no values for {pattern!r}")
    return joined.select(p.fill({k: F.col(k) for k in used}, allow_missing).alias("path"))


def multiext(prefix: Column, *extensions: str) -> Column:
    return F.explode(F.array(*(F.concat(prefix, F.lit(e)) for e in extensions)))


def glob_wildcards(paths: DataFrame, column: str, pattern: str, restriction: dict[str, str] | None = None) -> DataFrame:
    """The wildcards' values of every path that matches, duplicates kept; restriction fixes some of them."""
    p = compile_pattern(pattern)
    out = paths.where(p.matches(F.col(column))).select(F.col(column).alias("path"), *(v.alias(k) for k, v in p.values(F.col(column)).items()))
    for k, v in (restriction or {}).items():
        out = out.where(F.col(k) == v)
    return out


def limit(pattern: str, **values: list[str]) -> str:
    """The pattern with wildcards held to the given values."""
    return re.sub(r"\{(\w+)\}", lambda m: "{%s,%s}" % (m[1], "|".join(map(re.escape, values[m[1]]))) if m[1] in values else m[0], pattern)


def strip_constraints(pattern: Column) -> Column:
    return F.regexp_replace(pattern, r"\{\s*(\w+)\s*,[^{}]*\}", r"{$1}")


def prefix_lookup(paths: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """paths joined to every key (small table of `prefix`) that they start with: cut to keys' lengths, then an equality join."""
    lengths = sorted(r[0] for r in keys.select(F.length("prefix")).distinct().collect())
    heads = F.explode(F.array(*(F.substring(F.col(column), 1, n) for n in lengths)))
    return paths.withColumn("prefix", heads).distinct().join(keys, "prefix").where(F.col(column).startswith(F.col("prefix")))


def producers(paths: DataFrame, column: str, rules: dict[str, str]) -> DataFrame:
    """(path, rule, wildcard_length) of every rule whose output pattern matches; rank 1 is the best: least text in wildcards, then rule order."""
    found = None
    for k, (rule, pattern) in enumerate(rules.items()):
        p = compile_pattern(pattern)
        size = sum((F.length(v) for v in p.values(F.col(column)).values()), F.lit(0))
        one = paths.where(p.matches(F.col(column))).select(F.col(column).alias("path"), F.lit(rule).alias("rule"), F.lit(k).alias("at"), size.alias("wildcard_length"))
        found = one if found is None else found.unionByName(one)
    best = W.partitionBy("path").orderBy("wildcard_length", "at")
    return found.withColumn("rank", F.row_number().over(best))
