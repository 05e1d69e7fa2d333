"""Path functions as column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column) -> Column:
    """Blanks trimmed, backslashes turned, empty and ``.`` segments dropped, ``..`` resolved; a ``..`` at the root is dropped.

    Null stays null; a path without segments becomes the empty string. Case is kept.
    """
    parts = F.split(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/")
    kept = F.filter(parts, lambda p: ~F.trim(p).isin("", "."))
    climbed = F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(F.when(F.array_contains(kept, ".."), climbed).otherwise(kept), "/")


def dirname(path: Column) -> Column:
    """Everything before the last slash; the empty string for a bare name."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def basename(path: Column) -> Column:
    """Everything after the last slash."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The lower-case extension with its dot, or the empty string; a leading dot alone starts no extension."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def ancestors(path: Column, include_self: bool = False) -> Column:
    """All directory prefixes of a path, shortest first, as an array; null for null."""
    parts = F.split(path, "/")
    n = F.size(parts) - (0 if include_self else 1)
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def is_within(path: Column, directory: Column) -> Column:
    """Whether ``path`` is ``directory`` or lies below it, at a separator boundary."""
    return (path == directory) | path.startswith(F.concat(directory, F.lit("/")))


def relative_path(path: Column, base: Column) -> Column:
    """``path`` as seen from the directory ``base``, with ``..`` for what lies above their common part; ``.`` for the directory itself. Both are normal paths."""
    empty = F.array().cast("array<string>")
    a, b = (F.when(c == "", empty).otherwise(F.split(c, "/")) for c in (path, base))
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    common = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same).cast("long"))
    up = F.array_repeat(F.lit(".."), (F.size(b) - common).cast("int"))
    down = F.when(F.size(a) > common, F.slice(a, (common + 1).cast("int"), F.greatest((F.size(a) - common).cast("int"), F.lit(0)))).otherwise(empty)
    joined = F.array_join(F.concat(up, down), "/")
    return F.when(joined == "", ".").otherwise(joined)


def same_path(a: Column, b: Column) -> Column:
    """Whether two spellings name one path."""
    return normalize_path(a) == normalize_path(b)
