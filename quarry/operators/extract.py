"""Definitions of source files: Python by the standard library's grammar, JavaScript and TypeScript by a scanner of declarations
and of the members of classes, interfaces and objects, with a stack of delimiters.

A definition has a kind, a name, 1-based lines, the trimmed text of its lines and its documentation. One definition per start line, the
first in order; an anonymous one or a plain variable is also left out where it begins inside of one that was taken before.

Files that do not parse give no Python definitions; null contents give none.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import spread

SCHEMA = "file_id bigint, name string, definition_type string, start_line int, end_line int, docstring string, source_code string"
PARSEABLE = ("js", "jsx", "ts", "tsx", "py")

_CONSTANT = re.compile(r"^[A-Z][A-Z0-9_]*$")
_SKIP = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`")
_DOC = re.compile(r"/\*\*(?:(?!\*/)[\s\S])*\*/[ \t]*\r?\n?[ \t]*$")
_START = r"(?:^|(?<=[;{}]))[ \t]*"
_EXPORT = r"(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?"
_FUNCTION_VALUE = r"(?:async\b\s*)?(?:function\b|(?:<[^()=]*>\s*)?\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*(?::[^=;{}]+(?:\{[^{}]*\})?[^=;{}]*)?=>|[\w$]+\s*=>)"
_DECLARATIONS = [
    ("function", re.compile(_START + _EXPORT + r"(?:async[ \t]+)?function\b[ \t]*\*?[ \t]*(?P<name>[\w$]*)", re.M)),
    ("class", re.compile(r"(?:^|(?<=[;{})]))[ \t]*" + _EXPORT + r"(?:abstract[ \t]+)?class\b[ \t]*(?P<name>(?!extends\b|implements\b)[\w$]*)", re.M)),
    ("interface", re.compile(_START + _EXPORT + r"interface[ \t]+(?P<name>[\w$]+)", re.M)),
    ("type_alias", re.compile(_START + _EXPORT + r"type[ \t]+(?P<name>[\w$]+)\s*(?:<[^=;{}]*>)?\s*=", re.M)),
    ("enum", re.compile(_START + _EXPORT + r"(?:const[ \t]+)?enum[ \t]+(?P<name>[\w$]+)", re.M)),
    ("module", re.compile(_START + _EXPORT + r"(?:namespace|module)[ \t]+(?P<name>[\w$.]+)\s*\{", re.M)),
    ("binding", re.compile(_START + _EXPORT + r"(?P<word>const|let|var)[ \t]+(?P<name>[\w$]+)\s*(?::(?:[^=;]|=>)+?)?=(?![=>])\s*(?P<arrow>" + _FUNCTION_VALUE + ")?", re.M)),
    ("assigned", re.compile(_START + r"(?:[\w$]+\.)+(?P<name>[\w$]+)\s*=(?![=>])\s*(?P<arrow>" + _FUNCTION_VALUE + ")", re.M)),
    ("default", re.compile(_START + r"export[ \t]+default[ \t]+(?P<name>)(?P<arrow>" + _FUNCTION_VALUE + ")", re.M)),
]
#: A member of a class, an interface or an object: its modifiers and name, up to what shows whether it is a function.
_MEMBER = re.compile(r"(?:(?:public|private|protected|static|readonly|abstract|override|declare|accessor|async|get|set)\b(?!\s*[(=:;?!<,}])\s*)*(?:\*\s*)?(?P<name>\#?[\w$]+|\[[^\]]*\]|new(?=\s*\())?\s*[?!]?\s*(?P<next>[<(:=;,}\n]|$)")
_VALUE = re.compile(r"\s*" + _FUNCTION_VALUE)
_GAP = re.compile(r"[\s;,]+")
_DECORATOR = re.compile(r"@[\w$.]+\s*")


def _python(text: str) -> Iterator[tuple]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text.removeprefix("﻿"))

    def visit(node: ast.AST, in_class: bool) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                start = min([child.lineno, *[d.lineno for d in child.decorator_list]])
                yield start, child.end_lineno, "class" if is_class else "method" if in_class else "function", child.name, ast.get_docstring(child)
                yield from visit(child, is_class)
            elif isinstance(child, (ast.Assign, ast.AnnAssign)) and child.value is not None:
                targets = child.targets if isinstance(child, ast.Assign) else [child.target]
                for target in targets:
                    if isinstance(target, ast.Name):
                        kind = "function" if isinstance(child.value, ast.Lambda) else "constant" if _CONSTANT.match(target.id) else "variable"
                        yield child.lineno, child.end_lineno, kind, target.id, None
                yield from visit(child, False)
            elif isinstance(child, ast.Lambda):
                yield child.lineno, child.end_lineno, "function", "anonymous", None
                yield from visit(child, False)
            else:
                yield from visit(child, in_class and not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)))

    yield from visit(tree, False)


def _blank(text: str) -> str:
    """The text with strings and comments blanked out, of the same length and lines."""
    return _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _end(bare: str, at: int, braces: bool) -> int:
    """Where a declaration from ``at`` on ends: behind its first block, or at the end of its statement."""
    depth = 0
    for m in re.compile(r"[{}()\[\];\n]").finditer(bare, at):
        c = m.group()
        if c in "{([":
            depth += 1
        elif c in "})]":
            depth -= 1
            if depth < 0:
                return m.start()
            if not depth and c == "}" and braces:
                return m.end()
        elif not depth and (c == ";" or c == "\n" and not braces and not re.match(r"\s*[|&.?:+]", bare[m.end() :]) and not re.search(r"[=|&,(+?:]\s*$", bare[at : m.start()])):
            return m.end() if c == ";" else m.start()
    return len(bare)


def _close(bare: str, at: int, pairs: str = "{}()[]") -> int:
    """Behind the bracket that closes the one at ``at``; the delimiters in between stand on a stack."""
    closing = {pairs[i + 1]: pairs[i] for i in range(0, len(pairs), 2)}
    stack: list[str] = []
    for i in range(at, len(bare)):
        c = bare[i]
        if c in closing.values():
            stack.append(c)
        elif c in closing and not (c == ">" and bare[i - 1] == "="):
            if not stack or stack.pop() != closing[c]:
                return i
            if not stack:
                return i + 1
    return len(bare)


def _skip_to(bare: str, at: int, end: int, stops: str) -> int:
    """The first of some signs from ``at`` on that stands in no bracket."""
    while at < end:
        c = bare[at]
        if c in stops:
            return at
        at = _close(bare, at) if c in "({[" else at + 1
    return end


def _members(bare: str, at: int, kind: str) -> Iterator[tuple[int, int, str]]:
    """Begin, end and name of the functions among the members of the body whose brace stands at ``at``."""
    end = _close(bare, at) - 1
    at += 1
    while at < end:
        if m := _GAP.match(bare, at, end):
            at = m.end()
            continue
        if m := _DECORATOR.match(bare, at, end):
            at = _close(bare, m.end()) if bare[m.end() : m.end() + 1] == "(" else m.end()
            continue
        m = _MEMBER.match(bare, at, end)
        if m is None or not m.group("name") and m.group("next") not in "(<":
            # Not a member: a block, a spread or a call; its brackets are passed as one.
            at = _close(bare, at) if bare[at] in "({[" else at + 1
            continue
        begin, sign, after = at, m.group("next"), m.end() - 1
        name = (m.group("name") or "anonymous").strip("[]# \n")
        if sign == "<":
            after = _close(bare, after, "<>()[]{}")
            after += len(bare[after:end]) - len(bare[after:end].lstrip())
            sign = bare[after : after + 1]
        if sign == "(":
            params = _close(bare, after)
            stop = _skip_signature(bare, params, end)
            if bare[stop : stop + 1] == "{":
                at = _close(bare, stop)
                yield begin, at, name
            else:
                at = stop
                if kind != "object":
                    yield begin, stop, name
        elif sign == "=" or sign == ":" and kind == "object":
            value = after + 1
            stop = _end(bare, value, False) if kind == "class" else _skip_to(bare, value, end, ",")
            if _VALUE.match(bare, value, end):
                yield begin, stop, name
            at = max(stop, value)
        elif sign == ":":
            stop = _skip_to(bare, after, end, ";=,\n" if kind == "interface" else ";=\n")
            if bare[stop : stop + 1] == "=" and bare[stop : stop + 2] != "=>":
                close = _end(bare, stop + 1, False)
                if _VALUE.match(bare, stop + 1, end):
                    yield begin, close, name
                stop = close
            at = max(stop, after + 1)
        else:
            at = max(after, at + 1)


def _skip_signature(bare: str, at: int, end: int) -> int:
    """From behind the parameters to the brace of the body, or to the end of a signature without one."""
    while at < end:
        c = bare[at]
        if c == "{":
            # A brace behind a colon or an operator of types is the type of the result.
            if re.search(r"[:|&<,]\s*$", bare[max(0, at - 40) : at]):
                at = _close(bare, at)
                continue
            return at
        if c in ";,}" or c == "\n" and not re.match(r"\s*[:{|&]", bare[at:end]) and not re.search(r"[:|&,(<]\s*$", bare[max(0, at - 40) : at]):
            return at
        at = _close(bare, at) if c in "([" else at + 1
    return end


def _script(text: str) -> Iterator[tuple]:
    bare = _blank(text)

    def row(begin: int, end: int, kind: str, name: str) -> tuple:
        doc = _DOC.search(text, max(0, begin - 20_000), begin)
        return text.count("\n", 0, begin) + 1, text.count("\n", 0, max(begin, end - 1)) + 1, kind, name or "anonymous", doc.group().strip() if doc else None

    for kind, pattern in _DECLARATIONS:
        for m in pattern.finditer(bare):
            begin = m.end() - len(m.group().lstrip())
            found = kind
            if kind in ("binding", "assigned", "default"):
                arrow = m.group("arrow")
                found = "method" if kind == "assigned" else "function" if arrow else "constant" if m.group("word") == "const" and _CONSTANT.match(m.group("name")) else "variable"
                end = _end(bare, m.end(), False)
                value = m.end() + len(bare[m.end() :]) - len(bare[m.end() :].lstrip())
                yield row(begin, end, found, m.group("name"))
                if kind == "binding" and not arrow and bare[value : value + 1] == "{":
                    for a, b, member in _members(bare, value, "object"):
                        yield row(a, b, "method", member)
            else:
                head = m.end() + len(bare[m.end() :]) - len(bare[m.end() :].lstrip())
                head = _close(bare, head, "<>()[]{}") if bare[head : head + 1] == "<" else m.end()
                end = _end(bare, head - (kind == "module"), kind != "type_alias")
                brace = _skip_to(bare, head, end, "{") if kind in ("class", "interface") else end
                yield row(begin, end, found, m.group("name"))
                if brace < end and bare[brace] == "{":
                    for a, b, member in _members(bare, brace, kind):
                        yield row(a, b, "method", member)


def definitions_of(text: str | None, extension: str) -> list[tuple]:
    """name, kind, start and end line, documentation and text of the definitions of one file."""
    if not text:
        return []
    try:
        found = list(_python(text) if extension == "py" else _script(text))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines = text.split("\n")
    taken: list[tuple] = []
    starts: set[int] = set()
    for start, end, kind, name, doc in found if extension == "py" else sorted(found, key=lambda x: (x[0], -x[1])):
        inside = any(a <= start <= b for a, b, *_ in taken) if name == "anonymous" or kind == "variable" else False
        if start in starts or inside:
            continue
        starts.add(start)
        taken.append((start, end, name, kind, doc, "\n".join(lines[start - 1 : end]).strip()))
    return sorted(taken)


def extract(files: DataFrame) -> DataFrame:
    """SCHEMA of the definitions of files (id, file_path, file_content)."""
    extension = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z]+)$", 1))
    chosen = files.select(F.col("id").alias("file_id"), extension.alias("extension"), F.col("file_content").alias("content")).filter(F.col("extension").isin(*PARSEABLE) & F.col("content").isNotNull())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(i, name, kind, start, end, doc, code) for i, e, text in zip(*[c.to_pylist() for c in batch.columns]) for start, end, name, kind, doc, code in definitions_of(text, e)]
            columns = list(zip(*rows)) if rows else [()] * 7
            types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file_id", "name", "definition_type", "start_line", "end_line", "docstring", "source_code"])

    return spread(chosen).mapInArrow(run, SCHEMA)


def split_parseable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files with a grammar, and the others."""
    has = F.coalesce(F.lower(F.regexp_extract("file_path", r"\.([A-Za-z]+)$", 1)).isin(*PARSEABLE), F.lit(False))
    return files.filter(has), files.filter(~has)
