"""Functions over columns of paths, texts and flags, as rules use them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_count(text: Column) -> Column:
    """Lines of a text; a last one without a line end counts."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (ends + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("long")


def exists(paths: DataFrame, inventory: DataFrame, column: str = "path") -> DataFrame:
    """paths with `exists`: whether the path stands in the inventory."""
    known = inventory.select(F.col(column).alias("__known")).distinct()
    return paths.join(known, paths[column] == known["__known"], "left").withColumn("exists", F.col("__known").isNotNull()).drop("__known")


def parse_input(lines: DataFrame, column: str, parser: Callable[[Column], Column], name: str = "value") -> DataFrame:
    """What a parser makes of each line."""
    return lines.withColumn(name, parser(F.col(column)))


def extract_checksum(lines: DataFrame, wanted: DataFrame, column: str = "value", path: str = "path") -> DataFrame:
    """wanted with the checksum that the lines 'checksum  path' state for exactly this path; a leading ./ counts on neither side."""
    bare = lambda c: F.regexp_replace(c, r"^\./", "")
    known = lines.select(bare(F.substring_index(F.col(column), "  ", -1)).alias("__path"), F.split_part(F.col(column), F.lit("  "), F.lit(1)).alias("checksum"))
    return wanted.join(known, bare(wanted[path]) == known["__path"]).drop("__path")


def flag(flags: Column, name: str, value: Column) -> Column:
    """The map of flags with one more, or another value of it."""
    return F.map_concat(remove_flag(flags, name), F.create_map(F.lit(name), value))


def remove_flag(flags: Column, name: str) -> Column:
    return F.map_filter(flags, lambda k, _: k != name)


def is_flagged(flags: Column, name: str) -> Column:
    """Set, and not to 'false'."""
    return F.coalesce(flags[name] != "false", F.lit(False))


def default_flags(flags: Column, defaults: dict[str, str]) -> Column:
    """Flags, and the defaults of those that aren't set."""
    known = F.create_map(*(F.lit(x) for kv in defaults.items() for x in kv))
    return F.map_concat(F.map_filter(known, lambda k, _: ~F.map_contains_key(flags, k)), flags)


def simplify_path(path: Column, base: str) -> Column:
    """An absolute path seen from a folder, unless that leads up two folders or more."""
    start = [x for x in base.split("/") if x]
    parts, common = F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(0)
    for k in range(1, len(start) + 1):
        common = F.when(F.slice(parts, 1, k) == F.array(*map(F.lit, start[:k])), k).otherwise(common)
    up = F.lit(len(start)) - common
    rest = F.array_join(F.slice(parts, common + 1, F.greatest(F.size(parts) - common, F.lit(0))), "/")
    seen = F.concat(F.repeat(F.lit("../"), up), rest)
    return F.when(up >= 2, path).when(seen == "", ".").otherwise(seen)


def shell_quote(text: Column) -> Column:
    """The text as one word of a shell."""
    safe = text.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$")
    return F.when(safe, text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def format_sequence(items: Column, quote: bool = False) -> Column:
    """Items between spaces, each quoted if asked for."""
    return F.array_join(F.transform(items, shell_quote) if quote else items, " ")


def sniffed(text: Column) -> Column:
    """(kind, value) of a setting's text: int, float, bool, str by the first that fits; null if empty."""
    kind = F.when(text.rlike(r"^[+-]?\d+$"), "int").when(text.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+(\.\d*)?[eE][+-]?\d+)$"), "float").when(F.lower(text).isin("true", "false"), "bool").otherwise("str")
    return F.when(text != "", F.struct(kind.alias("kind"), text.alias("value")))


#: Powers of the base for each unit.
UNITS = {"k": 1, "m": 2, "g": 3, "t": 4, "p": 5, "e": 6}


def bytes_to(size: Column, unit: str, base: int = 1024) -> Column:
    return size.cast("double") / F.lit(float(base ** UNITS[unit]))


def parse_uri(uri: Column) -> Column:
    """(scheme, path): 'file' without a scheme; the host belongs to the path."""
    found = F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    return F.struct(F.when(found == "", "file").otherwise(found).alias("scheme"), F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://", "").alias("path"))


def resolve_pathvars(*levels: dict[str, str]) -> dict[str, str]:
    """Values of <name> variables, earlier levels first; values may use other variables. An error for cycles and unknown names."""
    known: dict[str, str] = {}
    for level in levels:
        known = {**level, **known}

    def value(name: str, seen: tuple[str, ...]) -> str:
        if name in seen:
            raise ValueError(f"path variables in a circle: {' > '.join((*seen, name))}")
        if name not in known:
            raise KeyError(f"no path variable {name!r}")
        return re.sub(r"<(\w+)>", lambda m: value(m[1], (*seen, name)), known[name])

    return {k: value(k, ()) for k in known}


def apply_pathvars(path: Column, values: dict[str, str]) -> Column:
    """An error for a name without a value."""
    for k, v in values.items():
        path = F.replace(path, F.lit(f"<{k}>"), F.lit(v))
    return F.when(path.rlike(r"<\w+>"), F.raise_error(F.concat(F.lit("path variable without a value: "), path))).otherwise(path)


def modify_path(path: Column, prefix: str | None = None, replace_prefix: dict[str, str] | None = None) -> Column:
    """A prefix before it, or another one instead of its own; absolute paths and those that lead up stay. An error if two prefixes match."""
    fixed = path.startswith("/") | path.startswith("..")
    if prefix is not None:
        return F.when(fixed, path).otherwise(F.concat(F.lit(prefix), path))
    out, matching = path, F.lit(0)
    for old, new in (replace_prefix or {}).items():
        met = path.startswith(old)
        matching = matching + met.cast("int")
        out = F.when(met, F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(out)
    return F.when(fixed, path).when(matching > 1, F.raise_error(F.concat(F.lit("two prefixes match: "), path))).otherwise(out)


def wildcard_names(pattern: Column) -> Column:
    """Names in the order in which they first stand."""
    return F.array_distinct(F.regexp_extract_all(pattern, F.lit(r"\{\s*(\w+)\s*(?:,[^{}]*)?\}"), 1))


def unresolved(pattern: Column, values: Column) -> Column:
    """Wildcards of the pattern that the map of values lacks."""
    return F.array_except(wildcard_names(pattern), F.map_keys(values))


def constrain_wildcards(pattern: str, own: dict[str, str], general: dict[str, str] | None = None) -> str:
    """The pattern with constraints: one in the pattern counts first, then the rule's own, then general ones."""
    known = {**(general or {}), **own}
    done: set[str] = set()

    def one(m: re.Match) -> str:
        name, inline = m[1], m[2]
        if inline or name in done or name not in known:
            done.add(name)
            return m[0]
        done.add(name)
        return f"{{{name},{known[name]}}}"

    return re.sub(r"\{\s*(\w+)\s*(,[^{}]*(?:\{\d*,?\d*\}[^{}]*)*)?\}", one, pattern)


def format_percentage(done: Column, total: Column, most: int = 8) -> Column:
    """0% and 100% only if that is so; else as many digits as tell it apart from them."""
    share = done / total * 100
    out = F.concat(F.format_string(f"%.{most}f", share), F.lit("%"))
    for digits in range(most - 1, -1, -1):
        text = F.format_string(f"%.{digits}f", share)
        out = F.when(~text.cast("double").isin(0.0, 100.0), F.concat(text, F.lit("%"))).otherwise(out)
    return F.when(done == 0, "0%").when(done == total, "100%").otherwise(out)


def named_item(items: Column, name: str) -> Column:
    """Values of the (name, value) items of that name."""
    return F.transform(F.filter(items, lambda x: x["name"] == name), lambda x: x["value"])
