"""Scalar building blocks as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]"


def strip(x: Column) -> Column:
    """Without white space, tabs and line ends included, at both ends."""
    return F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(x: Column) -> Column:
    """Stripped, and each run of white space as one space."""
    return F.regexp_replace(strip(x), rf"{SPACE}+", " ")


def blank_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def mask(x: Column) -> Column:
    """What can be shown of a secret."""
    return F.when(F.length(x) <= 8, "***").otherwise(F.concat(F.substring(x, 1, 4), F.lit("..."), F.right(x, F.lit(4))))


def clip(x: Column, most: int, keep: int | None = None) -> Column:
    """Cut to ``keep`` characters and an ellipsis where longer than ``most``."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 3 if keep is None else keep), F.lit("..."))).otherwise(x)


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; empty for a name without one or that begins with its only one."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def normalize_path(path: Column) -> Column:
    """Without empty, ``.`` and ``..`` steps."""
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x.isin(".", ""), acc).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def env_name(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(x), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def case_of(x: Column, cases: Iterable[tuple[str, str]], default: str | None) -> Column:
    """The value of the first regular expression that ``x`` matches."""
    out = None
    for pattern, value in cases:
        out = F.when(x.rlike(pattern), value) if out is None else out.when(x.rlike(pattern), value)
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def tokens(x: Column) -> Column:
    """Identifiers and operators of lower-cased code."""
    return F.regexp_extract_all(x, F.lit(r"[a-z_][a-z0-9_]*|[\{\}()\[\];,=<>!+\-*/&|^%]"), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body has it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def gram_set(x: Column) -> Column:
    """Distinct 1-, 2- and 3-grams of the tokens of ``x``."""

    def of(t: Column) -> Column:
        def grams(n: int) -> Column:
            parts = [F.slice(t, F.lit(k + 1), F.greatest(F.size(t) - (n - 1), F.lit(0))) for k in range(n)]
            joined = F.zip_with(parts[0], parts[1], lambda a, b: F.concat_ws(" ", a, b))
            return joined if n == 2 else F.zip_with(joined, parts[2], lambda a, b: F.concat_ws(" ", a, b))

        return F.array_distinct(F.concat(t, grams(2), grams(3)))

    return let(tokens(x), of)


def jaccard_percent(a: Column, b: Column) -> Column:
    share = let(F.size(F.array_intersect(a, b)), lambda both: both * 100.0 / (F.size(a) + F.size(b) - both))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(share)
