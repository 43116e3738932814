"""Column functions on repository-relative POSIX paths. All are built-in expressions and stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_path(path: Column | str) -> Column:
    """The path without leading ``./``; null stays null."""
    p = col(path)
    return F.when(p.startswith("./"), F.regexp_replace(p, r"^(\./)+", "")).otherwise(p)


def base_name(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def dir_name(path: Column | str) -> Column:
    """All before the last slash, '' at the root."""
    p = col(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit(""))


def segments(path: Column | str) -> Column:
    """The directory segments (not the file name) as an array."""
    d = dir_name(path)
    return F.when(d == "", F.array().cast("array<string>")).otherwise(F.split(d, "/", -1))


def stem(path: Column | str) -> Column:
    """The file name up to its last dot; names that begin with their only dot stay whole."""
    b = base_name(path)
    return F.regexp_replace(b, r"(?<=.)\.[^.]*$", "")


def extension(path: Column | str) -> Column:
    """The lower-case extension without its dot, '' without one."""
    b = base_name(path)
    return F.lower(F.when(b.rlike(r".\.[^.]+$"), F.substring_index(b, ".", -1)).otherwise(F.lit("")))


def join_path(base: Column | str, rest: Column | str) -> Column:
    """``base/rest`` with ``.`` and ``..`` resolved; null when it would leave the root."""
    parts = F.split(F.concat_ws("/", col(base), col(rest)), "/", -1)
    step = lambda acc, x: (
        F.when(acc.isNull(), acc)
        .when((x == "") | (x == "."), acc)
        .when((x == "..") & (F.size(acc) == 0), F.lit(None).cast("array<string>"))
        .when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x)))
    )
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def dir_prefixes(path: Column | str) -> Column:
    """Every proper ancestor directory, shallowest first; none for a file at the root."""
    s = segments(path)
    return F.when(F.size(s) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))), lambda i: F.array_join(F.slice(s, F.lit(1), i), "/"))
    )


def shared_depth(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    miss = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), False)
    return F.when(n == 0, F.lit(0)).when(miss == 0, n).otherwise((miss - 1).cast("int"))


def tokens(text: Column | str) -> Column:
    """Words of a name or message: camel humps split, lower case, anything but letters and digits separates."""
    spaced = F.regexp_replace(col(text), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+", -1), lambda x: x != "")


def name_tokens(path: Column | str) -> Column:
    return tokens(stem(path))


def jaccard(a: Column, b: Column) -> Column:
    """Set overlap of two arrays; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def slug(label: Column | str) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(col(label)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(s == "", F.lit("root")).otherwise(s)
