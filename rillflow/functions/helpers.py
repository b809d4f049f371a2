"""Scalar helpers over columns: parts of paths, units, conditions, nested values, configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ancestor(path: Column, n: int = 1) -> Column:
    """The path without its last n parts; '.' if nothing is left."""
    parts = F.split(path, "/", -1)
    left = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - n, F.lit(0))), "/")
    return F.when(F.size(parts) <= n, F.lit(".")).otherwise(left)


def strip_suffix(path: Column, suffix: str) -> Column:
    """An error where the suffix is absent."""
    return F.when(path.endswith(suffix), F.left(path, F.length(path) - len(suffix))).otherwise(F.raise_error(F.concat(F.lit(f"no suffix {suffix}: "), path)))


def with_suffix(path: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(suffix))


def prepend(prefix: str, paths: Column, space: bool = True) -> Column:
    return F.array_join(F.transform(paths, lambda x: F.concat(F.lit(prefix + " " * space), x)), " ")


#: Factors to megabytes (decimal and binary units) and to minutes.
TO_MB = {"B": 1e-6, "KB": 1e-3, "MB": 1.0, "GB": 1e3, "TB": 1e6, "KIB": 1024 / 1e6, "MIB": 1024**2 / 1e6, "GIB": 1024**3 / 1e6, "TIB": 1024**4 / 1e6}
TO_MINUTES = {"S": 1 / 60, "M": 1.0, "H": 60.0, "D": 1440.0, "W": 10080.0}


def human_units(text: Column, units: dict[str, float]) -> Column:
    """'1.5 GB' as the base unit, rounded up and at least 1; null where there is no such unit."""
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(text, r"([A-Za-z]+)\s*$", 1))
    factor = F.coalesce(*(F.when(unit == k, F.lit(v)) for k, v in units.items()))
    return F.greatest(F.lit(1), F.ceil(F.round(number * factor, 9))).cast("long")


def clock(seconds: Column) -> Column:
    """[D day(s), ]H:MM:SS."""
    s = seconds.cast("long")
    days = F.floor(s / 86400)
    time = F.format_string("%d:%02d:%02d", F.floor(F.pmod(s, F.lit(86400)) / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))
    return F.concat(F.when(days == 0, "").when(days == 1, "1 day, ").otherwise(F.concat(days.cast("string"), F.lit(" days, "))), time)


def default_memory(size_mb: Column) -> Column:
    return F.least(F.greatest(2 * size_mb, F.lit(1000.0)), F.lit(8000.0))


def checksum(text: Column, most: int = 1_000_000) -> Column:
    """'sha256:' and the sum; null beyond `most` bytes, which are not summed (raise it to sum everything)."""
    return F.when(F.octet_length(text) <= most, F.concat(F.lit("sha256:"), F.sha2(text, 256)))


def is_same_checksum(text: Column, known: Column, most: int = 1_000_000) -> Column:
    """Whether a text has a known checksum; false where either is missing or of another algorithm."""
    return F.coalesce(checksum(text, most) == known, F.lit(False))


def branch(condition: Column, cases: dict[object, object], otherwise: object = None) -> Column:
    """The case of the condition's value; falsy keys count like any others."""
    out = None
    for k, v in cases.items():
        out = F.when(condition == F.lit(k), F.lit(v)) if out is None else out.when(condition == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(otherwise))


class LookupFailed(ValueError):
    """lookup() found no rows, or not as many as asked for."""


def lookup(rows: DataFrame, query: str, cols: list[str] | None = None, default: dict[str, object] | None = None) -> DataFrame:
    """The rows for which the SQL condition holds; default is the one row returned if there are none."""
    found = rows.where(query)
    found = found.select(*cols) if cols else found
    if default is None:
        return found
    # the rows are found once and stored, whether there are any or not
    from rillflow.operators.graph import stored

    found = stored(found)
    if not found.isEmpty():
        return found
    return found.sparkSession.range(1).select(*(F.lit(default.get(c)).cast(t).alias(c) for c, t in found.dtypes))


def has_rows(rows: DataFrame, query: str, n: int) -> DataFrame:
    return rows.agg((F.count_if(F.expr(query)) == n).alias("holds"))


def merge_config(base: dict, over: dict) -> dict:
    """over wins; maps are merged level by level, anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
