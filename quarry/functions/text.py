"""Text and code-text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language names by extension; fixed values.
INGEST_LANGUAGES = {".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python"}
VIEW_LANGUAGES = INGEST_LANGUAGES | {".json": "json", ".md": "markdown", ".css": "css", ".html": "html", ".yml": "yaml", ".yaml": "yaml", ".sql": "sql", ".sh": "bash"}


def _folding() -> dict[str, str]:
    """Each composed small letter and the letter that its canonical decomposition has before the marks, by the rule of Unicode."""
    table = {}
    for code in range(0xC0, 0x2000):
        letter = chr(code)
        first, *marks = unicodedata.normalize("NFD", letter)
        if letter.islower() and marks and all(unicodedata.combining(m) for m in marks):
            table[letter] = first
    return table


_FOLDING = _folding()
_ACCENTED, _FOLDED = "".join(_FOLDING), "".join(_FOLDING.values())


def fold(text: Column) -> Column:
    """Lower case without diacritics, both composed and as combining marks."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{M}", ""), _ACCENTED, _FOLDED)


def tokens(text: Column) -> Column:
    """Full-text tokens: runs of letters and digits of the folded text; ``snake_case`` and paths split, ``camelCase`` does not."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def strip_comments(code: Column) -> Column:
    """Block comments that open with ``/**`` and line comments removed; plain ``/* */`` blocks stay."""
    return F.regexp_replace(F.regexp_replace(code, r"/\*\*[\s\S]*?\*/", ""), r"(?d)//.*", "")


def code_lines(code: Column) -> Column:
    """The trimmed, non-empty lines."""
    return F.filter(F.transform(F.split(code, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def stable_hash(code: Column, name: Column) -> Column:
    """SHA-256 of the code without the definition's name, with trimmed lines and no blank ones; stays the same when the name or layout changes."""
    bare = F.when(F.coalesce(name, F.lit("")) == "", code).otherwise(F.call_function("regexp_replace", code, F.concat(F.lit(r"\b\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E\b")), F.lit("")))
    return F.sha2(F.array_join(code_lines(bare), "\n"), 256)


def word_count(text: Column) -> Column:
    """Words between blanks of any kind."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))


def token_estimate(text: Column) -> Column:
    """Four tokens for three words, rounded down; nothing for nothing."""
    return F.coalesce(F.floor(word_count(text) * 4 / 3), F.lit(0)).cast("long")


def expected_summary_tokens(entity_type: Column) -> Column:
    return F.when(entity_type == "file", 180).otherwise(60)


def input_tokens(content: Column, n_related: Column) -> Column:
    """The tokens of a content and of the summaries of what it builds upon."""
    return token_estimate(content) + F.lit(60) * n_related


def gist_short(text: Column) -> Column:
    """What stands between the first pair of gist tags, null without a pair."""
    return F.when(text.rlike(r"(?s)<gist>.*</gist>"), F.regexp_extract(text, r"(?s)<gist>(.*?)</gist>", 1))


def gist_full(text: Column) -> Column:
    """What stands behind the first closing gist tag, null without a pair."""
    return F.when(text.rlike(r"(?s)<gist>.*</gist>"), F.regexp_extract(text, r"(?s)<gist>.*?</gist>(.*)", 1))


def strict(value: Column, text: Column, message: str) -> Column:
    """``value``, or an error where it is null although the text is not."""
    return F.when(value.isNull() & text.isNotNull(), F.raise_error(F.lit(message))).otherwise(value)


def placeholder_summary(kind: Column, name: Column, content: Column) -> Column:
    """A summary without a model: kind, name and the start of the content in one line; nulls count as empty."""
    head = F.trim(F.regexp_replace(F.substring(F.coalesce(content, F.lit("")), 1, 100), r"[\r\n]+", " "))
    return F.format_string("%s %s: %s", kind, F.coalesce(name, F.lit("")), head)


def symbol_name(symbol: Column) -> Column:
    """The last descriptor of a symbol string: its name, without suffix signs, method brackets, quoting backticks and trailing digits."""
    last = F.regexp_extract(symbol, r"(`(?:[^`]|``)+`|[\w$+\-]+)(?:\(\+?\d*\))?[.#/:!]?$", 1)
    bare = F.regexp_replace(F.replace(F.regexp_replace(last, "^`|`$", ""), F.lit("``"), F.lit("`")), r"\d+$", "")
    return F.when(bare != "", bare)


def container_symbol(symbol: Column) -> Column:
    """The part before the first ``#``, null where there is none."""
    return F.when(F.contains(symbol, F.lit("#")), F.substring_index(symbol, "#", 1))


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, from 1, both included and held within the text."""
    lines = F.split(text, "\n")
    first = F.greatest(start, F.lit(1)).cast("int")
    last = F.least(end, F.size(lines)).cast("int")
    return F.when(last < first, F.lit("")).otherwise(F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n"))


def language_of(extension: Column, names: dict[str, str] = INGEST_LANGUAGES, default: str = "unknown") -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(extension)), F.lit(default))


def citations(text: Column) -> Column:
    """The citation links of a text: label, file id and, where given, definition id."""
    link = r"\[([^\]]+)\]\(file::(\d+)(?::definition::(\d+))?\)"
    found = F.regexp_extract_all(text, F.lit(link), F.lit(0))
    return F.transform(
        found,
        lambda x: F.struct(
            F.regexp_extract(x, link, 1).alias("label"),
            F.regexp_extract(x, link, 2).cast("long").alias("file_id"),
            F.when(F.regexp_extract(x, link, 3) != "", F.regexp_extract(x, link, 3)).cast("long").alias("definition_id"),
        ),
    )


def tag_content(text: Column, tag: str) -> Column:
    """What stands in the first element of a name, trimmed; null without one."""
    return F.when(text.rlike(rf"(?s)<{tag}>.*?</{tag}>"), F.trim(F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)))


def tag_contents(text: Column, tag: str) -> Column:
    """What stands in all elements of a name, trimmed."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), lambda x: F.trim(x))


def preview(text: Column, limit: int = 280) -> Column:
    """Tags removed, cut to ``limit`` characters with an ellipsis."""
    bare = F.trim(F.regexp_replace(text, r"<[^>]*>", ""))
    return F.when(F.length(bare) > limit, F.concat(F.rtrim(F.substring(bare, 1, limit)), F.lit("…"))).otherwise(bare)


def slugify(name: Column) -> Column:
    """Lower case, runs of other signs to one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def valid_slug(slug: Column) -> Column:
    return slug.rlike(r"^[A-Za-z0-9._-]+$")


def repository_name(url: Column) -> Column:
    """The last part of a repository's address without ``.git``."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(url, r"/+$", ""), r"([^/:]+)$", 1), r"\.git$", "")


def glob_regex(pattern: str) -> str:
    """The regular expression of a file-name pattern, in which ``*`` also crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i:end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = end + 1
        else:
            out += "\\" + c if c in "\\.+^$(){}|[]" else c
    return f"^(?s:{out})$"


def similarity_of(distance: Column) -> Column:
    """1 / (1 + distance), 0 for null and for a distance of -1."""
    return F.coalesce(F.try_divide(F.lit(1.0), F.lit(1.0) + distance), F.lit(0.0))
