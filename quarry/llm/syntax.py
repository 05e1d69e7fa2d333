"""Source files that do not parse (problem 2).

Every file goes through the lexer of its extension's language with a pushdown stack. It finds unterminated literals, unbalanced
delimiters, premature ends, conflict markers and what the grammar has no place for. For JavaScript and TypeScript the lexer is driven by
a recogniser of the whole grammar (``ecma``), for JSON it is a complete pushdown automaton (``pyauto.reject_json``); their verdicts stand.
For Python (``pyauto.suspect``) a text that passes is valid; a suspect one, which for few texts is the recogniser's caution, is a candidate
for the exact check that follows, the parser of the standard library. Where a text nests deeper than these can hold, which for
JavaScript and TypeScript is two million calls, literals, delimiters and conflict markers decide.

Nulls and empty contents are no files to check; other extensions are left out. A leading byte-order mark and any line end are
accepted. Repeated rows give one row. Contents of any length are read whole.
"""

from __future__ import annotations

import ast
import re
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import ecma, pyauto
from quarry.llm.arrow import map_lists
from quarry.session import spread

#: Extensions with a grammar, and the language they stand for. Fixed values.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "json": "json"}

_CONFLICT = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?:[ \t]|\r?$)", re.M)
_PYTHON = re.compile(
    r"""\#[^\n]*|(?P<open>[(\[{])|(?P<close>[)\]}])|\\(?:\r\n|[\s\S])
    |(?P<quote>\"{3}|'{3})|(?P<short>\"[^\"\\\n]*+(?:\\(?:\r\n|[\s\S])[^\"\\\n]*+)*+(?P<e1>\")?|'[^'\\\n]*+(?:\\(?:\r\n|[\s\S])[^'\\\n]*+)*+(?P<e2>')?)""",
    re.X,
)
_LONG = {q: re.compile(rf"[^\\{q}]*+(?:(?:\\[\s\S]|{q}(?!{q}{q}))[^\\{q}]*+)*+{q}{q}{q}") for q in "\"'"}
_PAIR = {")": "(", "]": "[", "}": "{"}


def conflict(text: str) -> bool:
    """Whether an opening or closing line of conflict markers stands in the text; rows of equals signs alone underline headings."""
    marks = [m.group()[0] for m in _CONFLICT.finditer(text)]
    return "<" in marks or ">" in marks


def lex_python(text: str) -> str | None:
    """The reason to reject by literals and delimiters alone, or None."""
    stack: list[str] = []
    at = 0
    while m := _PYTHON.search(text, at):
        at = m.end()
        kind = m.lastgroup
        if kind == "open":
            stack.append(m.group())
        elif kind == "close":
            if not stack or stack.pop() != _PAIR[m.group()]:
                return "unbalanced delimiter"
        elif kind == "quote":
            end = _LONG[m.group()[0]].match(text, at)
            if end is None:
                return "unterminated literal"
            at = end.end()
        elif m.group("short") and not (m.group("e1") or m.group("e2")):
            return "unterminated literal"
    if stack:
        return "unbalanced delimiter"
    last = text.rstrip().rpartition("\n")[2].split("#")[0].rstrip()
    return "premature end" if last.endswith((":", "\\", "=", ",", ".", "(")) and not last.lstrip().startswith(('"', "'")) else None


def reject(text: str, extension: str) -> str | None:
    """Why the grammar of ``extension`` rejects the text, or None if it accepts it."""
    text = text.removeprefix("\ufeff")
    if extension in ("js", "jsx", "ts", "tsx"):
        found = ecma.reject(text, extension in ("ts", "tsx"), extension in ("jsx", "tsx"))
        return found and found[0]
    found = pyauto.suspect(text) if extension == "py" else pyauto.reject_json(text)
    if found is None:
        return None
    if extension == "py":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
            return None
        except (RecursionError, MemoryError):
            return lex_python(text)
        except (SyntaxError, ValueError):
            pass
    return "merge conflict" if conflict(text) else found


def check_files(files: DataFrame) -> DataFrame:
    """file_id, repo_slug, language, reason (null if the file parses): one row per file with a grammar and a content."""
    extension = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z]+)$", 1))
    chosen = files.select(F.col("id").alias("file_id"), F.split("file_path", "/")[0].alias("repo_slug"), extension.alias("extension"), F.col("file_content").alias("content"))
    chosen = chosen.filter(F.col("extension").isin(*LANGUAGES) & (F.col("content") != ""))

    def make():
        def run(ids, repos, extensions, contents):
            for i, repo, ext, content in zip(ids, repos, extensions, contents):
                yield i, repo, LANGUAGES[ext], reject(content, ext)

        return run

    return map_lists(spread(chosen), make, "file_id bigint, repo_slug string, language string, reason string")


def broken_files(files: DataFrame) -> DataFrame:
    """file_id, repo_slug, language, reason: the files that do not parse, once each."""
    return check_files(files).filter(F.col("reason").isNotNull()).distinct()


def rates(checked: DataFrame) -> DataFrame:
    """Per repository and language: files checked, files that do not parse, their share and the most frequent reason."""
    by_reason = checked.groupBy("repo_slug", "language", "reason").agg(F.countDistinct("file_id").alias("n"))
    broken = F.when(F.col("reason").isNotNull(), F.col("n"))
    total = by_reason.groupBy("repo_slug", "language").agg(F.sum("n").alias("n_files"), F.coalesce(F.sum(broken), F.lit(0)).alias("n_broken"), F.max(F.when(F.col("reason").isNotNull(), F.struct("n", "reason")))["reason"].alias("main_reason"))
    return total.withColumn("rate", F.col("n_broken") / F.col("n_files"))
