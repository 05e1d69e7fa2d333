"""Splitting oversized items at natural boundaries (problem 3).

Recursive bisection: a range of the text that exceeds the limit minus the overlap is cut at the strongest boundary near its middle, and
both halves are treated alike. The ranges do not overlap and follow each other; a piece is its range with the overlap before it. So
each piece has at most the limit's characters, each after the first starts with the last characters of its predecessor, and the text is
the first piece followed by the others without their overlaps.

Boundaries by strength: the start of a top-level block after a blank line, a blank line, the end of a line back to no indentation, a
line end, the end of a sentence, a blank, and, where none is in reach, any place that splits no character cluster or line break.

Nulls: no text, no pieces; a type without a limit is not split. A text within the limit gives no pieces, as it needs none. Limits must
leave room for progress: the overlap has to be smaller than half the limit. Repeated rows give repeated pieces unless they are made
distinct; the queries do so. Lengths are in Unicode characters.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import map_lists

_LEVELS = [
    re.compile(r"\n[ \t\r]*\n(?=[^\s)\]}])"),
    re.compile(r"\n[ \t\r]*\n"),
    re.compile(r"\n(?=[^\s)\]}])"),
    re.compile(r"\r\n|[\n\r]"),
    re.compile(r"[.!?;][\"')\]]*\s+"),
    re.compile(r"\s+"),
]
_LINE_LEVELS = 4


def _nearest(level: re.Pattern, text: str, low: int, high: int, middle: int) -> int | None:
    """The end of the level's match in (low, high) that lies nearest to the middle."""
    best = None
    for m in level.finditer(text, max(low - 1, 0), high):
        at = m.end()
        if low < at < high and (best is None or abs(at - middle) < abs(best - middle)):
            best = at
        if at > middle:
            break
    return best


def _joined(text: str, at: int) -> bool:
    """Whether a cut here would split a line break, a combined character or a sequence of emoji."""
    before, after = text[at - 1], text[at]
    return before == "\r" and after == "\n" or after in "‍️" or before == "‍" or bool(unicodedata.combining(after)) or "\U0001f3fb" <= after <= "\U0001f3ff"


def cut(text: str, start: int, end: int, left: int, right: int) -> int:
    """Where to cut the range: the halves keep at least ``left`` and ``right`` characters."""
    lowest, highest = start + left, end - right
    middle = min(max((start + end) // 2, lowest), highest)
    reach = max((end - start) // 4, 1)
    near = max(lowest, middle - reach) - 1, min(highest, middle + reach) + 1
    wide = lowest - 1, highest + 1
    for levels, (a, b) in ((_LEVELS[:_LINE_LEVELS], near), (_LEVELS[:_LINE_LEVELS], wide), (_LEVELS[_LINE_LEVELS:], near), (_LEVELS[_LINE_LEVELS:], wide)):
        for level in levels:
            if (at := _nearest(level, text, a, b, middle)) is not None:
                return at
    for at in range(middle, highest + 1):
        if not _joined(text, at):
            return at
    return middle


def ranges(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """The ranges between the cuts, in order. Only the first one may be so short that the next could not begin with a whole overlap, so it is not."""
    if overlap < 0 or limit <= 2 * overlap:
        raise ValueError("the overlap must be smaller than half the limit")
    room = limit - overlap
    least = max(1, min(overlap, room // 4))
    if len(text) <= limit:
        return [(0, len(text))]
    found: list[tuple[int, int]] = []
    stack = [(0, len(text))]
    while stack:
        start, end = stack.pop()
        if end - start <= room:
            found.append((start, end))
        else:
            left = least if start else max(least, overlap)
            at = cut(text, start, end, min(left, end - start - 1), max(1, min(least, end - start - left)))
            stack += [(at, end), (start, at)]
    return found


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Start and end of each piece, and the length of the overlap that it begins with."""
    return [(start - min(overlap, start), end, min(overlap, start)) for start, end in ranges(text, limit, overlap)]


def restore(parts: list[tuple[str, int]]) -> str:
    """The text of its pieces, each with the length of its overlap, in order."""
    return "".join(piece[overlap:] for piece, overlap in parts)


def oversized(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """The rows (entity_type, entity_id, text) over the limit of their type, with the limit. limits has one row per type, a fixed few."""
    few = limits.groupBy("entity_type").agg(F.min("max_chars").alias("max_chars"), F.max("overlap_chars").alias("overlap_chars"))
    return rows.join(F.broadcast(few), "entity_type").filter(F.length("text") > F.col("max_chars"))


def split(rows: DataFrame, limits: DataFrame, with_text: bool = True) -> DataFrame:
    """entity_type, entity_id, piece_no, n_pieces, start, length, overlap, cut_kind and, on demand, the text of each piece.

    cut_kind is ``forced`` where one line, without its break, exceeds the limit, so that no line end can serve; else ``natural``.
    """
    chosen = oversized(rows, limits).select("entity_type", "entity_id", "text", "max_chars", "overlap_chars")

    def make():
        def run(types, ids, texts, limits_, overlaps):
            for kind, i, text, limit, overlap in zip(types, ids, texts, limits_, overlaps):
                found = pieces(text, limit, overlap)
                cut_kind = "forced" if max(len(x.removesuffix("\r")) for x in text.split("\n")) > limit else "natural"
                for number, (start, end, shared) in enumerate(found):
                    row = (kind, i, number, len(found), start, end - start, shared, cut_kind)
                    yield (*row, text[start:end]) if with_text else row

        return run

    schema = "entity_type string, entity_id bigint, piece_no int, n_pieces int, start int, length int, overlap int, cut_kind string"
    return map_lists(chosen, make, schema + ", piece string" * with_text)


def entities(files: DataFrame, definitions: DataFrame) -> DataFrame:
    """Both tables in one form."""
    f = files.select(F.lit("file").alias("entity_type"), F.col("id").alias("entity_id"), F.col("file_content").alias("text"))
    d = definitions.select(F.lit("definition").alias("entity_type"), F.col("id").alias("entity_id"), F.col("source_code").alias("text"))
    return f.unionByName(d)


def split_entities(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """entity_type, entity_id, cut_kind, n_pieces: one row per item that had to be cut, from its pieces."""
    return split(rows, limits, with_text=False).filter("piece_no = 0").select("entity_type", "entity_id", "cut_kind", "n_pieces").distinct()
