"""Functions paired with their documentation (problem 4).

Island grammars, one per family of languages: only documentation, annotations, signatures and balanced bodies are parsed; the rest
is water that is skipped over. In Python the documentation is the string that opens the body, or the comment lines directly before
the definition; elsewhere, in languages with brackets around parameters and bodies, it is the comment directly before. The source's documentation is only read where docstring is null or blank.

The cleaned description drops, line by line, what describes nothing: parameters and results, marks of pending work, directives to
tools, licences, rulers, commented-out code, and the mere name. A pair needs ``min_words`` words after that.

Nulls: without docstring and source code there is no pair; a null name repeats nothing. Repeated rows give one row. Texts of any
length are read whole. Types other than function and method are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import map_lists
from quarry.session import spread

# -- islands --------------------------------------------------------------------------------------------------------------
_WATER = re.compile(r"\s*+")
_ANNOTATION = re.compile(r"@[\w.$]+")
_PY_DEF = re.compile(r"(?:async\s+)?(?:def|class)\s+[^\W\d]\w*\s*")
_PY_STRING = re.compile(r"[rRuUbB]{0,2}(?:\"{3}([\s\S]*?)(?:\"{3}|\Z)|'{3}([\s\S]*?)(?:'{3}|\Z)|\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)')")
_BALANCE = re.compile(r"\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|\#[^\n]*|[()\[\]{}]")
_PY_HEAD = re.compile(r"(?:\"[^\"\n]*\"|'[^'\n]*'|[^:\n\[{(\"'])*(?:[\[{(]|:)")
_PY_BLANK = re.compile(r"(?:\s|#[^\n]*(?=\n))*")
_PY_GOES_ON = re.compile(r"\s*[+%.\[(]")
#: Strings, templates and comments of languages with braces, and their brackets.
_BRACED = re.compile(r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\[\s\S])*+`|/\*[\s\S]*?(?:\*/|\Z)|(?<![:\\])//[^\n]*|[()\[\]{}]")
#: What can matter in a signature: brackets, an arrow, the quotes around the body of a function in SQL, and the end of a declaration.
_HEAD_SIGN = re.compile(r"=>|\$\$|[(\[{;]|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*")
_OPENS_TYPE = re.compile(r"[:|&=<,]\s*\Z")
_ARROW_OF_TYPE = re.compile(r"\s*[\w$.<>\[\]| ]+\s*=(?![=>])")
_LEADING = re.compile(r"\s*(?:/\*[\s\S]*?(?:\*/|\Z)|(?://|#(?!\[))[^\n]*(?:\n\s*(?://|#(?!\[))[^\n]*)*|--[^\n]*(?:\n\s*--[^\n]*)*)")


def balanced(text: str, at: int) -> int:
    """Behind the bracket that closes the one at ``at``, or the end of the text."""
    depth = 0
    for m in _BALANCE.finditer(text, at):
        c = m.group()
        if c in ("(", "[", "{"):
            depth += 1
        elif c in (")", "]", "}"):
            depth -= 1
            if not depth:
                return m.end()
    return len(text)


def leading_comment(source: str) -> tuple[str | None, int]:
    """The last comment before the first line of code, and where the code begins; annotations may stand between them."""
    at, found = 0, None
    while True:
        at = _WATER.match(source, at).end()
        if m := _LEADING.match(source, at):
            found, at = m.group().strip(), m.end()
        elif m := _ANNOTATION.match(source, at):
            at = _WATER.match(source, m.end()).end()
            if source[at : at + 1] == "(":
                at = balanced(source, at)
        else:
            return found, at


@dataclass
class Island:
    """A definition's documentation in its source, its signature and its body, without the water around them."""

    doc: str | None
    signature: str
    body: str


def python_island(source: str, before: str | None, at: int) -> Island:
    """The documentation is the string that opens the body, else the comment before the definition."""
    start, at = at, _PY_DEF.match(source, at).end()
    if source[at : at + 1] == "[":
        at = _WATER.match(source, balanced(source, at)).end()
    if source[at : at + 1] == "(":
        at = balanced(source, at)
    colon = _PY_HEAD.match(source, at)
    while colon is not None and source[colon.end() - 1] != ":":
        at = balanced(source, colon.end() - 1)
        colon = _PY_HEAD.match(source, at)
    if colon is None:
        return Island(before, source[start:at], "")
    body = _PY_BLANK.match(source, colon.end()).end()
    found = Island(before, source[start : colon.end() - 1].strip(), source[body:])
    if (m := _PY_STRING.match(source, body)) and not _PY_GOES_ON.match(source, m.end()):
        found.doc = next(x for x in m.groups() if x is not None)
        found.body = source[m.end() :].lstrip("\r\n")
    return found


def braced_island(source: str, before: str | None, at: int) -> Island:
    """For languages with brackets around a body: the signature reaches to the first bracket of a body, an arrow's expression, or the end.

    Parameters, types and defaults are balanced brackets within the signature; a brace opens the body if it follows parameters, an arrow
    or the name of a type, and no operator or colon.
    """
    start, params = at, False
    while m := _HEAD_SIGN.search(source, at):
        sign = m.group()
        if sign == "=>":
            body = _WATER.match(source, m.end()).end()
            end = braced_end(source, body) if source[body : body + 1] == "{" else len(source)
            if _ARROW_OF_TYPE.match(source, m.end()) and "=" in source[end:]:
                at = end
                continue
            return Island(before, source[start : m.start()].strip(), source[body:end])
        if sign == "{" and params and not _OPENS_TYPE.search(source, start, m.start()):
            end = braced_end(source, m.start())
            return Island(before, source[start : m.start()].strip(), source[m.start() : end])
        if sign in ("(", "[", "{"):
            params = params or sign == "("
            at = braced_end(source, m.start())
        elif sign in ("$$", ";") and params:
            return Island(before, source[start : m.start()].strip(), source[m.start() :])
        else:
            at = m.end()
    return Island(before, source[start:].strip() if params else "", "")


def braced_end(text: str, at: int) -> int:
    """Behind the bracket that closes the one at ``at``, past strings, templates and comments; or the end of the text."""
    depth = 0
    for m in _BRACED.finditer(text, at):
        c = m.group()
        if c in ("(", "[", "{"):
            depth += 1
        elif c in (")", "]", "}"):
            depth -= 1
            if not depth:
                return m.end()
    return len(text)


def island(source: str) -> Island:
    """The island of a definition's source code."""
    before, at = leading_comment(source)
    return python_island(source, before, at) if _PY_DEF.match(source, at) else braced_island(source, before, at)


# -- descriptions ---------------------------------------------------------------------------------------------------------
# What opens a line that describes nothing.
_MARK = re.compile(r"^(?:todo|fixme|xxx|hack|tbd|wip|tbc|bug|optimi[sz]e|refactor|review|temp(?:orary)?|placeholder|stub|pending|provisional|undone|nocommit)\b(?=\s*[:(\[\-–—!]|\s|$)", re.I)
_MARK_ONLY = re.compile(r"^(?:bug|review|optimi[sz]e|refactor|temp(?:orary)?|pending|provisional|placeholder|stub)\b(?!\s*[:(\[!])", re.I)
_PARAMETER = re.compile(
    r"^(?:[@\\:](?:param(?:eter)?s?|arg(?:ument)?s?|prop(?:erty)?|returns?|rtypes?|type|types|typedef|template|throws?|raises?|exception|yields?|see|since|deprecated|example|author|version|private|public|protected|internal|override|async|class|function|method|memberof|module|default|override|callback|keyword|kwarg|key|var|ivar|cvar|todo|const|readonly|link|inheritdoc)\b"
    r"|(?:args|arguments|params|parameters|returns?|raises|yields|throws|keyword args|other parameters|attributes|results?)\s*:?\s*$)",
    re.I,
)
_SECTION = re.compile(r"^(args|arguments|params|parameters|returns?|raises|yields|throws|keyword args|other parameters|attributes|results?)\s*:\s*$", re.I)
_RESULT = re.compile(r"^(?:returns?|raises|yields|throws|params?|args?)\s*:\s*\S", re.I)
_GOOGLE_PARAM = re.compile(r"^\*{0,2}\w+\s*(?:\([^)]*\))?\s*:\s")
_DIRECTIVE = re.compile(
    r"^(?:\{?@(?:inheritdoc|ts-\w+|formatter|suppress\w*|prettier|format|flow|jsx\w*|generated|nocheck|license|preserve|copyright)\b"
    r"|eslint\b|eslint-\S+|tslint\b|jshint\b|jslint\b|istanbul\b|prettier-ignore|biome-ignore|stylelint|c8 ignore|v8 ignore|webpack\w*:|noinspection|noqa\b|nosec\b|pylint\b|flake8\b|mypy\b|pyright\b|ruff\b|isort\b|yapf\b|fmt\s*:|black\b:?|type\s*:\s*ignore|pragma\b|coverage\b:|sourcery|nolint|lint\b|region\b|endregion\b|@?ts-(?:ignore|expect-error|nocheck)|-\*-|vim?:|!/|#!|sonar|codecov|cspell)",
    re.I,
)
_LICENCE = re.compile(r"copyright\b|\(c\)\s*\d{4}|©|spdx-|all rights reserved|licen[cs]ed? under|\b(?:mit|bsd|apache|gpl|lgpl|mpl|isc)\b.{0,12}\blicen[cs]e|permission is hereby|without warranty|this file is part of|released under", re.I)
_RULER = re.compile(r"^[\W_]*$")
_CODE_LINE = re.compile(
    r"^(?:(?:const|let|var)\s+[\w${\[].*=|(?:export|import)\s+[\w{*'\"].*(?:from|=|\(|;|'|\")|from\s+\S+\s+import\b|(?:async\s+)?(?:def|function)\s+\w+\s*\(|class\s+\w+\s*[({:]|(?:if|for|while|switch|elif)\s*\(.*\)|(?:if|for|while|elif|with)\s.*:$"
    r"|(?:return|await|raise|throw|del|assert|yield|print)\b[^.!?]*[;()\[\]{}=]|return\s+[\w.]+;?$|[\w.$\[\]\"']+\s*(?:=|\+=|-=|:=)\s*\S|[\w.$]+\([^)]*\)\s*[;{.]?\s*$|[})\]];?\s*$|[\w$.]+\([\w\s.,'\"$=]*\)\s*;?$|.*;\s*$|.*[{}]\s*$)"
)
_WORD = re.compile(r"[^\W_]*[^\W\d_][^\W_]*(?:['’\-][^\W_]+)*")
_EDGES = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\*)|//+[/!]?|#+!?|--+|\"{3}|'{3}|;+|<!--)?\s?")
_FILLER = frozenset("the a an this that of for to it its is function method func fn class helper utility util".split())


def unmarked(doc: str) -> list[str]:
    """The lines of a documentation without their comment marks."""
    text = re.sub(r"^\s*[rRuUbB]{0,2}(\"{3}|'{3})([\s\S]*?)\1\s*$", r"\2", doc.replace("\r\n", "\n").replace("\r", "\n"))
    lines = []
    for line in text.split("\n"):
        line = re.sub(r"\s*(?:\*+/|-->|\"{3}|'{3})\s*$", "", line)
        bare = line.strip()
        if not _RULER.match(bare):
            bare = _EDGES.sub("", line, count=1).strip()
        lines.append(bare)
    return lines


def described(doc: str, name: str | None) -> str:
    """The lines of a documentation that describe something, joined by spaces."""
    kept: list[str] = []
    section = parameter = False
    lines = unmarked(doc)
    for i, line in enumerate(lines):
        if not line:
            section = parameter = False
            continue
        if _SECTION.match(line) or i + 1 < len(lines) and re.fullmatch(r"-{3,}|={3,}", lines[i + 1]) and _PARAMETER.match(line):
            section = True
            continue
        if section and (_GOOGLE_PARAM.match(line) or _RULER.match(line) or not kept or lines[i - 1]):
            continue
        if _PARAMETER.match(line) or _RESULT.match(line):
            parameter = True
            continue
        if _RULER.match(line):
            continue
        if _MARK.match(line) and not _MARK_ONLY.match(line) or _DIRECTIVE.match(line) or _LICENCE.search(line):
            parameter = False
            continue
        if parameter and re.match(r"\s{2,}", doc.split("\n")[i] if i < doc.count("\n") + 1 else "") and not kept:
            continue
        if _CODE_LINE.match(line) and not re.search(r"[^\W\d_]{2,} [^\W\d_]{2,} [^\W\d_]{2,}[^;{}=]*\.$", line):
            continue
        kept.append(line)
    return " ".join(kept)


def _parts(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+", name)]


def meaningful(description: str, name: str | None, min_words: int) -> bool:
    """Whether enough words remain, and more than the name's own."""
    words = [w.lower() for w in _WORD.findall(description)]
    if len(words) < min_words:
        return False
    own = set(_parts(name or "")) | {(name or "").lower()}
    stems = {o[:-1] if o.endswith(("e", "y")) and len(o) > 3 else o for o in own if o}
    rest = [w for w in words if w not in _FILLER and w not in own and not any(w.startswith(s) and len(w) <= len(s) + 3 for s in stems if len(s) > 3)]
    return bool(rest)


def pair(docstring: str | None, source: str | None, name: str | None, min_words: int) -> str | None:
    """The description of one definition, or None if it has none with a meaning."""
    doc = docstring if docstring is not None and docstring.strip() else source and island(source).doc
    if not doc:
        return None
    text = described(doc, name)
    return text if meaningful(text, name, min_words) else None


def code_pairs(definitions: DataFrame, min_words: int = 4, with_code: bool = True) -> DataFrame:
    """definition_id, name, description and, on demand, source_code and its signature: functions and methods with a meaningful documentation."""
    chosen = definitions.filter(F.col("definition_type").isin("function", "method"))
    blank = F.coalesce(F.trim(F.translate("docstring", "\t\n\r\f\v", "     ")), F.lit("")) == ""
    needs_code = F.col("source_code") if with_code else F.when(blank, F.col("source_code"))
    columns = chosen.select(F.col("id").alias("definition_id"), "name", "docstring", needs_code.alias("source_code"))

    def make():
        def run(ids, names, docs, codes):
            for i, name, doc, code in zip(ids, names, docs, codes):
                text = pair(doc, code, name, min_words)
                if text is not None:
                    yield (i, name, text, code, code and island(code).signature) if with_code else (i, name, text)

        return run

    schema = "definition_id bigint, name string, description string" + ", source_code string, signature string" * with_code
    return map_lists(spread(columns), make, schema)
