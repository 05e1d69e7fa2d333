"""A recogniser of Python and one of JSON: language-specific lexers with a pushdown stack.

``suspect`` reads a Python source once. The lexer keeps a stack of open delimiters and one of indentations; it gives logical lines, which
are checked against the grammar of statements and expressions. What it does not know for sure (patterns of ``match``, rare escapes)
it calls suspect rather than good, so that a text it passes is valid, and a suspect one is a candidate for an exact check.

``reject_json`` is a complete pushdown automaton for strict JSON and decides alone. Both read texts of any length, and JSON nests without a
limit; Python lines that nest deeper than ``DEEPEST`` are suspect.
"""

from __future__ import annotations

import re
import unicodedata

DEEPEST = 60

# -- Python: lexer --------------------------------------------------------------------------------------------------------
# The words, operators and literals of the language.
KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_BINARY = frozenset("+ - * / // % @ ** << >> & | ^".split())
_COMPARE = frozenset("== != < > <= >=".split())
_AUGMENTED = frozenset("+= -= *= /= //= %= @= **= <<= >>= &= |= ^=".split())
_CONSTANTS = frozenset(("None", "True", "False", "..."))
_TARGETS = frozenset(("name", "attribute", "item", "several"))
_CLOSES = {")": "(", "]": "[", "}": "{"}

_TOKEN = re.compile(
    r"""(?:[ \t\f]+|\\(?:\r\n|\n|\r))*+
    (?:(?P<newline>(?:\#[^\r\n]*+)?(?:\r\n|\n|\r|\Z))
      |(?P<string>(?P<prefix>[rR]?[bB]|[bB][rR]|[uU]|[rR]?[fF]|[fF][rR]|[rR])?(?P<quote>\"{3}|'{3}|\"|'))
      |(?P<name>[^\W\d]\w*+)
      |(?P<number>(?:0[xX](?:_?[0-9a-fA-F])++|0[oO](?:_?[0-7])++|0[bB](?:_?[01])++
         |(?:(?:[0-9](?:_?[0-9])*+)?\.[0-9](?:_?[0-9])*+|[0-9](?:_?[0-9])*+\.?)(?:[eE][+-]?[0-9](?:_?[0-9])*+)?+[jJ]?))
      |(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|:=|->|==|!=|<=|>=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|\*\*|//|<<|>>|[()\[\]{}.,:;+\-*/%@&|^~<>=]))""",
    re.X,
)
_REST = {
    '"': re.compile(r'[^"\\\r\n]*+(?:\\(?:\r\n|[\s\S])[^"\\\r\n]*+)*+"'), "'": re.compile(r"[^'\\\r\n]*+(?:\\(?:\r\n|[\s\S])[^'\\\r\n]*+)*+'"),
    '"""': re.compile(r'[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+"""'), "'''": re.compile(r"[^'\\]*+(?:(?:\\[\s\S]|'(?!''))[^'\\]*+)*+'''"),
}
_BLANK_LINE = re.compile(r"([ \t\f]*+)(?:(?:\#[^\r\n]*+)?(?:\r\n|\n|\r|\Z))?+")
_ESCAPE = re.compile(r"\\(?:\\|x(?P<x>[0-9a-fA-F]{2})?|u(?P<u>[0-9a-fA-F]{4})?|U(?P<U>00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4})?|N(?:\{(?P<N>[^}]*)\})?)")
_ODD_NUMBER = re.compile(r"0[0_]*[1-9][0-9_]*$")
_FIELD = re.compile(r"\{\{|\}\}|[{}]")
_PLAIN_FIELD = re.compile(r"\s*[^\W\d]\w*(?:\.[^\W\d]\w*|\[(?:\d+|'\w+'|\"\w+\")\]|\(\))*\s*(?:![rsa]\s*)?(?::[^{}'\"\\]*)?\}")


class Reject(Exception):
    """The text is no Python, as far as this recogniser can tell; the argument is the reason."""


def _escapes(body: str, kind: str) -> None:
    for m in _ESCAPE.finditer(body):
        mark = m.group()[1]
        if mark == "\\" or kind == "b" and mark != "x":
            continue
        found = m.group(mark)
        if found is None:
            raise Reject("unterminated literal")
        if mark == "N":
            try:
                unicodedata.lookup(found)
            except KeyError:
                raise Reject("unexpected token") from None


def _fields(body: str, depth: int) -> None:
    """The replacement fields of a formatted string."""
    at = 0
    while m := _FIELD.search(body, at):
        at = m.end()
        if m.group() == "}":
            raise Reject("unbalanced delimiter")
        if m.group() != "{":
            continue
        if plain := _PLAIN_FIELD.match(body, at):
            if any(w in KEYWORDS and w not in _CONSTANTS for w in re.findall(r"[^\W\d]\w*", plain.group().partition("!")[0].partition(":")[0])):
                raise Reject("unexpected token")
            at = plain.end()
            continue
        tokens, kinds, end = _expression_tokens(body, at, depth)
        line = Line(tokens, kinds, depth + 1)
        if tokens[0] == "":
            raise Reject("unexpected token")
        i = line.yields(0) if tokens[0] == "yield" else line.several(0)
        if tokens[i] == "=":
            i += 1
        if tokens[i]:
            raise Reject("unexpected token")
        if body[end] == "!":
            conversion = re.compile(r"!\s*[rsa]\s*").match(body, end)
            if not conversion:
                raise Reject("unexpected token")
            end = conversion.end()
        if body[end : end + 1] == ":":
            level, at = 0, end + 1
            while True:
                m = re.compile(r"[{}]").search(body, at)
                if m is None:
                    raise Reject("unbalanced delimiter")
                if m.group() == "{":
                    close = body.find("}", m.end())
                    inner = body[m.end() : close]
                    if close < 0 or not inner.strip() or "{" in inner or level > 1:
                        raise Reject("unexpected token")
                    _fields("{" + inner + "}", depth + 1)
                    at = close + 1
                else:
                    at = m.end()
                    break
        elif body[end : end + 1] == "}":
            at = end + 1
        else:
            raise Reject("unbalanced delimiter")


def _expression_tokens(body: str, at: int, depth: int) -> tuple[list[str], list[str], int]:
    """The tokens of the field's expression and where it ends: at ``!``, ``:`` or ``}`` outside of its own brackets."""
    if depth > 4:
        raise Reject("unexpected token")
    tokens: list[str] = []
    kinds: list[str] = []
    stack: list[str] = []
    while True:
        m = _TOKEN.match(body, at)
        if m is None:
            if not stack and re.compile(r"\s*!").match(body, at):
                return [*tokens, ""], [*kinds, ""], body.index("!", at)
            raise Reject("unexpected token")
        kind = m.lastgroup
        at = m.end()
        if kind == "newline":
            if at >= len(body):
                raise Reject("unbalanced delimiter")
            continue
        if kind == "string" or m.group("string"):
            end = _REST[m.group("quote")].match(body, at)
            if end is None:
                raise Reject("unterminated literal")
            _literal(m.group("prefix") or "", body[at : end.end() - len(m.group("quote"))], depth + 1)
            at = end.end()
            tokens.append("s")
            kinds.append("bytes" if "b" in (m.group("prefix") or "").lower() else "string")
            continue
        text = m.group(kind)
        if kind == "op":
            if not stack and text in (":", "}"):
                return [*tokens, ""], [*kinds, ""], at - 1
            if text in ("(", "[", "{"):
                stack.append(text)
            elif text in _CLOSES and (not stack or stack.pop() != _CLOSES[text]):
                raise Reject("unbalanced delimiter")
        if kind == "number":
            _number(text, body, at)
        tokens.append(text)
        kinds.append("keyword" if kind == "name" and text in KEYWORDS else kind)


def _literal(prefix: str, body: str, depth: int = 0) -> None:
    prefix = prefix.lower()
    if "b" in prefix and not body.isascii():
        raise Reject("unexpected token")
    if "\\" in body and "r" not in prefix:
        _escapes(body, "b" if "b" in prefix else "s")
    if "f" in prefix and ("{" in body or "}" in body):
        _fields(re.sub(r"\\N\{[^}]*\}", "x", body) if "r" not in prefix else body, depth)


def _number(text: str, source: str, end: int) -> None:
    after = source[end : end + 1]
    if _ODD_NUMBER.match(text) or after and (after.isalnum() or after == "_"):
        raise Reject("unexpected token")


def logical_lines(source: str):
    """Each logical line: its indentation, its tokens and their kinds, both with an empty one at the end."""
    at, n = 0, len(source)
    stack: list[str] = []
    while at < n:
        m = _BLANK_LINE.match(source, at)
        if m.end() > m.end(1) or m.end() == n:
            at = m.end()
            continue
        indent = m.group(1)
        if source[m.end() : m.end() + 1] == "\\":
            raise Reject("unexpected token")
        at = m.end()
        tokens: list[str] = []
        kinds: list[str] = []
        while True:
            m = _TOKEN.match(source, at)
            if m is None:
                rest = source[at : at + 200].lstrip(" \t\f")
                raise Reject("premature end" if rest.startswith("\\") and not rest[1:].strip() else "unexpected token")
            kind = m.lastgroup
            at = m.end()
            if kind == "name":
                text = m.group("name")
                tokens.append(text)
                kinds.append("keyword" if text in KEYWORDS else "name")
            elif kind == "op":
                text = m.group("op")
                if text in "([{":
                    stack.append(text)
                elif text in _CLOSES and (not stack or stack.pop() != _CLOSES[text]):
                    raise Reject("unbalanced delimiter")
                tokens.append(text)
                kinds.append("op")
            elif kind == "newline":
                if not stack:
                    if at >= n and "\\" in source[m.start() : m.start("newline")]:
                        raise Reject("premature end")
                    break
                if at >= n:
                    raise Reject("unbalanced delimiter")
            elif m.group("string"):
                quote = m.group("quote")
                end = _REST[quote].match(source, at)
                if end is None:
                    raise Reject("unterminated literal")
                prefix = m.group("prefix") or ""
                body = source[at : end.end() - len(quote)]
                if prefix or "\\" in body:
                    _literal(prefix, body)
                at = end.end()
                tokens.append("s")
                kinds.append("bytes" if "b" in prefix.lower() else "string")
            else:
                _number(m.group("number"), source, at)
                tokens.append("0")
                kinds.append("number")
        yield indent, [*tokens, ""], [*kinds, ""]


# -- Python: grammar ------------------------------------------------------------------------------------------------------
class Line:
    """The tokens of a logical line, read by the rules of the grammar. Each rule takes a place and gives the place behind what it read."""

    def __init__(self, tokens: list[str], kinds: list[str], depth: int = 0):
        self.t, self.k, self.depth = tokens, kinds, depth
        #: What the last expression is: name, attribute, item, several (targets), or other.
        self.what = "other"

    def need(self, i: int, token: str) -> int:
        if self.t[i] != token or self.k[i] in ("string", "bytes"):
            raise Reject("unexpected token" if self.t[i] else "premature end")
        return i + 1

    def name(self, i: int) -> int:
        if self.k[i] != "name":
            raise Reject("unexpected token" if self.t[i] else "premature end")
        return i + 1

    def primary(self, i: int) -> int:
        """An atom with what follows it."""
        t, k = self.t, self.k
        kind, token = k[i], t[i]
        if kind == "name":
            what = "name"
            i += 1
        elif kind in ("string", "bytes"):
            first = kind
            while k[i] in ("string", "bytes"):
                if k[i] != first:
                    raise Reject("unexpected token")
                i += 1
            what = "other"
        elif kind == "number" or token in _CONSTANTS:
            what = "other"
            i += 1
        elif kind == "op" and token in "([{":
            self.depth += 1
            if self.depth > DEEPEST:
                raise Reject("unbalanced delimiter")
            i = self.group(i + 1) if token == "(" else self.listed(i + 1) if token == "[" else self.braced(i + 1)
            self.depth -= 1
            what = self.what
        else:
            raise Reject("unexpected token" if token else "premature end")
        while k[i] == "op":
            token = t[i]
            if token == ".":
                i = self.name(i + 1)
                what = "attribute"
            elif token == "(" or token == "[":
                self.depth += 1
                if self.depth > DEEPEST:
                    raise Reject("unbalanced delimiter")
                i = self.arguments(i + 1) if token == "(" else self.subscript(i + 1)
                self.depth -= 1
                what = "other" if token == "(" else "item"
            else:
                break
        self.what = what
        return i

    def expression(self, i: int, level: int = 0) -> int:
        """level 0: any expression; 1: without lambda and conditions; 2: without comparisons as well."""
        t = self.t
        at = level
        start = i
        while True:
            token = t[i]
            if self.k[i] == "keyword":
                if token == "lambda" and at == 0:
                    self.what = "other"
                    return self.lambda_(i + 1)
                if token == "not" and at <= 1:
                    at = 1
                    i += 1
                    continue
                if token == "await":
                    i += 1
                    if self.k[i] == "keyword" and t[i] not in _CONSTANTS:
                        raise Reject("unexpected token")
                    i = self.primary(i)
                    self.what = "other"
                else:
                    i = self.primary(i)
            elif token in ("-", "+", "~") and self.k[i] == "op":
                at = 2
                i += 1
                continue
            else:
                first = i
                i = self.primary(i)
                if first != start:
                    self.what = "other"
            token, kind = t[i], self.k[i]
            if kind == "op":
                if token in _BINARY:
                    i += 1
                    at = 2
                    continue
                if token in _COMPARE and level <= 1:
                    i += 1
                    at = 2
                    continue
            elif kind == "keyword" and level <= 1:
                if token in ("and", "or"):
                    i += 1
                    at = 1
                    continue
                if token == "in" or token == "not" and t[i + 1] == "in" or token == "is":
                    i += 2 if token == "not" or token == "is" and t[i + 1] == "not" else 1
                    at = 2
                    continue
                if token == "if" and level == 0:
                    i = self.need(self.expression(i + 1, 1), "else")
                    i = self.expression(i)
                    self.what = "other"
            return i

    def named(self, i: int) -> int:
        if self.k[i] == "name" and self.t[i + 1] == ":=":
            i = self.expression(i + 2)
            self.what = "other"
            return i
        return self.expression(i)

    def starred(self, i: int) -> int:
        """An element of a list: an expression, or a star before one."""
        return self.expression(i + 1, 2) if self.t[i] == "*" and self.k[i] == "op" else self.named(i)

    def several(self, i: int) -> int:
        """One or more expressions with commas between and perhaps behind them, as statements have."""
        targets, n = True, 0
        while True:
            i = self.expression(i + 1, 2) if self.t[i] == "*" and self.k[i] == "op" else self.expression(i)
            targets, n = targets and self.what in _TARGETS, n + 1
            if self.t[i] != "," or self.k[i] != "op":
                break
            i += 1
            n += 1
            if not self.t[i] or self.k[i] == "op" and self.t[i] in ("=", ")", ":", ";", "]", "}"):
                break
        if n > 1:
            self.what = "several" if targets else "other"
        return i

    def yields(self, i: int) -> int:
        i += 1
        if self.t[i] == "from":
            i = self.expression(i + 1)
        elif self.t[i] and self.t[i] not in (")", ";", "]", "}", "="):
            i = self.several(i)
        self.what = "other"
        return i

    def comprehension(self, i: int) -> int:
        while self.t[i] in ("for", "async"):
            if self.t[i] == "async":
                i += 1
            i = self.targets(self.need(i, "for"))
            i = self.expression(self.need(i, "in"), 1)
            while self.t[i] == "if":
                i = self.expression(i + 1, 1)
        self.what = "other"
        return i

    def targets(self, i: int, star: bool = True) -> int:
        """What a loop assigns to, up to a word that ends it."""
        while True:
            if star and self.t[i] == "*":
                i += 1
            i = self.primary(i)
            if self.what not in _TARGETS:
                raise Reject("unexpected token")
            if self.t[i] != ",":
                return i
            i += 1
            if self.t[i] in ("in", "", ";", "=", ":", ")"):
                return i

    def group(self, i: int) -> int:
        t = self.t
        if t[i] == ")":
            self.what = "several"
            return i + 1
        if t[i] == "yield":
            i = self.need(self.yields(i), ")")
            self.what = "other"
            return i
        star = t[i] == "*"
        i = self.starred(i)
        targets, n = self.what in _TARGETS, 0
        if t[i] in ("for", "async"):
            if star:
                raise Reject("unexpected token")
            return self.need(self.comprehension(i), ")")
        while t[i] == ",":
            i += 1
            n += 1
            if t[i] == ")":
                break
            i = self.starred(i)
            targets = targets and self.what in _TARGETS
        i = self.need(i, ")")
        if not n and star:
            raise Reject("unexpected token")
        if n:
            self.what = "several" if targets else "other"
        return i

    def listed(self, i: int) -> int:
        t = self.t
        targets, first = True, True
        while t[i] != "]":
            star = t[i] == "*"
            i = self.starred(i)
            targets = targets and self.what in _TARGETS
            if first and not star and t[i] in ("for", "async"):
                return self.need(self.comprehension(i), "]")
            first = False
            if t[i] != ",":
                break
            i += 1
        i = self.need(i, "]")
        self.what = "several" if targets else "other"
        return i

    def braced(self, i: int) -> int:
        t = self.t
        kind = ""
        first = True
        while t[i] != "}":
            if t[i] == "**":
                i = self.expression(i + 1, 2)
                own = "dict"
            elif t[i] == "*":
                i = self.expression(i + 1, 2)
                own = "set"
            else:
                walrus = t[i + 1] == ":="
                i = self.named(i)
                own = "set"
                if t[i] == ":" and not walrus:
                    i = self.expression(i + 1)
                    own = "dict"
                if first and t[i] in ("for", "async"):
                    return self.need(self.comprehension(i), "}")
            if kind and own != kind:
                raise Reject("unexpected token")
            kind, first = own, False
            if t[i] != ",":
                break
            i += 1
        i = self.need(i, "}")
        self.what = "other"
        return i

    def arguments(self, i: int) -> int:
        """The arguments of a call or a class, up to the bracket that closes them."""
        t = self.t
        keyword = unpacked = False
        n = 0
        while t[i] != ")":
            if t[i] == "**" and self.k[i] == "op":
                i = self.expression(i + 1)
                unpacked = True
            elif t[i] == "*" and self.k[i] == "op":
                if unpacked:
                    raise Reject("unexpected token")
                i = self.expression(i + 1)
            elif self.k[i] == "name" and t[i + 1] == "=":
                i = self.expression(i + 2)
                keyword = True
            else:
                if keyword or unpacked:
                    raise Reject("unexpected token")
                i = self.named(i)
                if t[i] in ("for", "async"):
                    if n:
                        raise Reject("unexpected token")
                    return self.need(self.comprehension(i), ")")
            n += 1
            if t[i] != ",":
                break
            i += 1
        i = self.need(i, ")")
        self.what = "other"
        return i

    def subscript(self, i: int) -> int:
        t = self.t
        if t[i] == "]":
            raise Reject("unexpected token")
        while t[i] != "]":
            if t[i] == ":":
                i = self.slice(i)
            elif t[i] == "*":
                i = self.expression(i + 1, 2)
            else:
                i = self.named(i)
                if t[i] == ":":
                    i = self.slice(i)
            if t[i] != ",":
                break
            i += 1
        return self.need(i, "]")

    def slice(self, i: int) -> int:
        for _ in range(2):
            if self.t[i] != ":":
                break
            i += 1
            if self.t[i] not in (":", ",", "]"):
                i = self.expression(i)
        return i

    def lambda_(self, i: int) -> int:
        i = self.need(self.parameters(i, ":", False), ":")
        i = self.expression(i)
        self.what = "other"
        return i

    def parameters(self, i: int, stop: str, annotated: bool) -> int:
        """The parameters of a function up to ``stop``, which is left."""
        t = self.t
        default = star = bare = slash = False
        n = 0
        while t[i] != stop:
            if t[i] == "/":
                if not n or star or slash:
                    raise Reject("unexpected token")
                slash = True
                i += 1
            elif t[i] == "**":
                i = self.name(i + 1)
                if annotated and t[i] == ":":
                    i = self.expression(i + 1)
                if t[i] == ",":
                    i += 1
                if t[i] != stop or bare:
                    raise Reject("unexpected token" if t[i] else "premature end")
                return i
            elif t[i] == "*":
                if star:
                    raise Reject("unexpected token")
                star = True
                i += 1
                bare = t[i] == ","
                if not bare:
                    i = self.name(i)
                    if annotated and t[i] == ":":
                        i = self.expression(i + 2, 2) if t[i + 1] == "*" else self.expression(i + 1)
            else:
                i = self.name(i)
                bare = False
                if annotated and t[i] == ":":
                    i = self.expression(i + 1)
                if t[i] == "=":
                    default = True
                    i = self.expression(i + 1)
                elif default and not star:
                    raise Reject("unexpected token")
            n += 1
            if t[i] != ",":
                break
            i += 1
        if bare:
            raise Reject("unexpected token")
        if t[i] != stop:
            raise Reject("unexpected token" if t[i] else "premature end")
        return i

    def type_parameters(self, i: int) -> int:
        if self.t[i] == "[":
            i += 1
            if self.t[i] == "]":
                raise Reject("unexpected token")
            while self.t[i] != "]":
                if self.t[i] in ("*", "**"):
                    i += 1
                i = self.name(i)
                if self.t[i] == ":":
                    i = self.expression(i + 1)
                if self.t[i] == "=":
                    raise Reject("unexpected token")
                if self.t[i] != ",":
                    break
                i += 1
            i = self.need(i, "]")
        return i

    # -- statements
    def simple(self, i: int) -> int:
        """One simple statement."""
        t, k = self.t, self.k
        token = t[i]
        if k[i] == "keyword":
            if token in ("pass", "break", "continue"):
                return i + 1
            if token == "return":
                return i + 1 if t[i + 1] in ("", ";") else self.several(i + 1)
            if token == "import":
                while True:
                    i = self.dotted(i + 1)
                    if t[i] == "as":
                        i = self.name(i + 1)
                    if t[i] != ",":
                        return i
            if token == "from":
                return self.from_import(i + 1)
            if token == "raise":
                if t[i + 1] in ("", ";"):
                    return i + 1
                i = self.expression(i + 1)
                return self.expression(i + 1) if t[i] == "from" else i
            if token == "assert":
                i = self.expression(i + 1)
                return self.expression(i + 1) if t[i] == "," else i
            if token in ("global", "nonlocal"):
                i = self.name(i + 1)
                while t[i] == ",":
                    i = self.name(i + 1)
                return i
            if token == "del":
                return self.targets(i + 1, star=False)
            if token == "yield":
                i = self.yields(i)
                if t[i] == "=":
                    raise Reject("unexpected token")
                return i
        if token == "type" and k[i] == "name" and k[i + 1] == "name":
            i = self.need(self.type_parameters(i + 2), "=")
            return self.expression(i)
        single = not (token == "*" and k[i] == "op")
        i = self.several(i)
        what = self.what
        if t[i] == ":" and k[i] == "op":
            if what not in ("name", "attribute", "item") or not single:
                raise Reject("unexpected token")
            i = self.expression(i + 1)
            if t[i] == "=":
                i = self.yields(i + 1) if t[i + 1] == "yield" else self.several(i + 1)
            return i
        if k[i] == "op" and t[i] in _AUGMENTED:
            if what not in ("name", "attribute", "item") or not single:
                raise Reject("unexpected token")
            return self.yields(i + 1) if t[i + 1] == "yield" else self.several(i + 1)
        while t[i] == "=" and k[i] == "op":
            if what not in _TARGETS:
                raise Reject("unexpected token")
            i = self.yields(i + 1) if t[i + 1] == "yield" else self.several(i + 1)
            what = self.what
        return i

    def dotted(self, i: int) -> int:
        i = self.name(i)
        while self.t[i] == ".":
            i = self.name(i + 1)
        return i

    def from_import(self, i: int) -> int:
        t = self.t
        dots = False
        while t[i] in (".", "..."):
            i, dots = i + 1, True
        if t[i] != "import" or not dots:
            i = self.dotted(i)
        i = self.need(i, "import")
        if t[i] == "*":
            return i + 1
        inside = t[i] == "("
        if inside:
            i += 1
        while True:
            i = self.name(i)
            if t[i] == "as":
                i = self.name(i + 1)
            if t[i] != ",":
                break
            i += 1
            if inside and t[i] == ")":
                break
        return self.need(i, ")") if inside else i

    def simples(self, i: int) -> None:
        """The rest of the line: simple statements with semicolons between them."""
        while True:
            i = self.simple(i)
            if self.t[i] == ";" and self.k[i] == "op":
                i += 1
                if not self.t[i]:
                    return
                continue
            if self.t[i]:
                raise Reject("unexpected token")
            return

    def with_items(self, i: int) -> int:
        if self.t[i] == "(":
            # A bracket may hold the items or be part of the first one; it holds them if only the colon follows it.
            depth, j = 0, i
            while True:
                if self.k[j] == "op":
                    depth += (self.t[j] in ("(", "[", "{")) - (self.t[j] in (")", "]", "}"))
                if not depth or not self.t[j]:
                    break
                j += 1
            if self.t[j + 1] == ":":
                k = i + 1
                while self.t[k] != ")":
                    k = self.starred(k)
                    if self.t[k] == "as":
                        k = self.primary(k + 1)
                        if self.what not in _TARGETS:
                            raise Reject("unexpected token")
                    if self.t[k] in ("for", "async") and k > i + 1:
                        k = self.comprehension(k)
                    if self.t[k] != ",":
                        break
                    k += 1
                if k == i + 1 and self.t[k] == ")":
                    return k + 1
                return self.need(k, ")")
        while True:
            i = self.expression(i)
            if self.t[i] == "as":
                if self.t[i + 1] == "*":
                    raise Reject("unexpected token")
                i = self.primary(i + 1)
                if self.what not in _TARGETS:
                    raise Reject("unexpected token")
            if self.t[i] != ",":
                return i
            i += 1


#: Which heads may follow the block of a head at its indentation.
_FOLLOW = {
    "if": ("elif", "else"), "elif": ("elif", "else"), "for": ("else",), "while": ("else",), "try": ("except", "finally"),
    "except": ("except", "else", "finally"), "tried": ("finally",), "else": (), "finally": (),
}


def _head(line: Line) -> tuple[str, int] | None:
    """The kind of a compound statement and the place behind its colon; None for a simple statement."""
    t, k = line.t, line.k
    first, i = t[0], 0
    if k[0] == "name":
        if first == "match" and t[1] not in ("", "=", ".", ",", ";", ")") and ":" in t and t[-2] == ":":
            raise Reject("unexpected token")
        return None
    if k[0] != "keyword":
        if first == "@":
            if line.t[line.named(1)]:
                raise Reject("unexpected token")
            return "decorator", -1
        return None
    if first == "async":
        i = 1
        first = t[1]
        if first not in ("def", "for", "with"):
            raise Reject("unexpected token")
    if first == "def":
        i = line.need(line.type_parameters(line.name(i + 1)), "(")
        i = line.need(line.parameters(i, ")", True), ")")
        if t[i] == "->":
            i = line.expression(i + 1)
    elif first == "class":
        i = line.type_parameters(line.name(i + 1))
        if t[i] == "(":
            i = line.arguments(i + 1)
    elif first in ("if", "elif", "while"):
        i = line.named(i + 1)
    elif first in ("else", "try", "finally"):
        i += 1
    elif first == "for":
        i = line.need(line.targets(i + 1), "in")
        i = line.several(i)
    elif first == "with":
        i = line.with_items(i + 1)
    elif first == "except":
        i += 1
        if t[i] == "*":
            raise Reject("unexpected token")
        if t[i] != ":":
            i = line.expression(i)
            if t[i] == "as":
                i = line.name(i + 1)
    else:
        return None
    return first, line.need(i, ":")


def suspect(source: str) -> str | None:
    """Why the source may be no Python, or None where it is Python for sure."""
    if "\0" in source:
        return "unexpected token"
    #: Per open block: its indentation, the last head at that indentation, whether a decorator waits for its function.
    blocks: list[list] = [["", None, False]]
    opens = False
    try:
        for indent, tokens, kinds in logical_lines(source):
            if "\f" in indent:
                indent = indent[indent.rfind("\f") + 1 :]
            if opens:
                if not (indent.startswith(blocks[-1][0]) and len(indent) > len(blocks[-1][0])):
                    return "premature end"
                blocks.append([indent, None, False])
                opens = False
            else:
                while len(blocks) > 1 and indent != blocks[-1][0] and len(indent) <= len(blocks[-1][0]):
                    _, last, decorated = blocks.pop()
                    if last == "try" or decorated:
                        return "premature end"
                if indent != blocks[-1][0]:
                    return "unexpected token"
            block = blocks[-1]
            line = Line(tokens, kinds)
            found = _head(line)
            head = found and found[0]
            allowed = _FOLLOW.get(block[1], ())
            if head in ("elif", "else", "except", "finally"):
                if head not in allowed:
                    return "unexpected token"
                if head == "else" and block[1] == "except":
                    head = "tried"
            elif block[1] == "try":
                return "unexpected token"
            if block[2] and head not in ("def", "class", "decorator"):
                return "unexpected token"
            block[2] = head == "decorator"
            block[1] = head
            if found is None:
                line.simples(0)
            elif found[1] >= 0:
                if not tokens[found[1]]:
                    opens = True
                else:
                    if head in ("match",):
                        return "unexpected token"
                    rest = Line(tokens[found[1] :], kinds[found[1] :])
                    if rest.t[0] in ("if", "for", "while", "def", "class", "with", "try", "async") and rest.k[0] == "keyword":
                        return "unexpected token"
                    rest.simples(0)
        if opens or blocks[-1][2] or any(b[1] == "try" or b[2] for b in blocks):
            return "premature end"
    except Reject as e:
        return str(e)
    except (IndexError, RecursionError):
        return "unexpected token"
    return None


# -- JSON -----------------------------------------------------------------------------------------------------------------
_JSON = re.compile(
    r"""[ \t\n\r]*+(?:(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")
    |(?P<value>-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?(?![\w.+-])|(?:true|false|null)(?!\w))|(?P<sign>[{}\[\]:,])|(?P<end>\Z))""",
    re.X,
)


def reject_json(text: str) -> str | None:
    """Why the text is no JSON, or None. The stack holds the open brackets; the state is what may come next."""
    stack: list[str] = []
    state, at = "value", 0
    while True:
        m = _JSON.match(text, at)
        if m is None:
            rest = text[at : at + 400].lstrip()
            return "unterminated literal" if rest.startswith('"') and '"' not in re.sub(r"\\.", "", rest[1:]) else "unexpected token"
        at, kind = m.end(), m.lastgroup
        if kind == "end":
            return None if state == "done" else "unbalanced delimiter" if stack else "premature end"
        sign = m.group("sign")
        if state in ("value", "first value"):
            if sign == "[":
                stack.append("[")
                state = "first value"
            elif sign == "{":
                stack.append("{")
                state = "first name"
            elif sign == "]" and state == "first value":
                stack.pop()
                state = "after" if stack else "done"
            elif sign:
                return "unexpected token"
            else:
                state = "after" if stack else "done"
        elif state in ("name", "first name"):
            if kind == "string":
                state = "colon"
            elif sign == "}" and state == "first name":
                stack.pop()
                state = "after" if stack else "done"
            else:
                return "unexpected token"
        elif state == "colon":
            if sign != ":":
                return "unexpected token"
            state = "value"
        elif state == "after":
            if sign == ",":
                state = "value" if stack[-1] == "[" else "name"
            elif sign == ("]" if stack[-1] == "[" else "}"):
                stack.pop()
                state = "after" if stack else "done"
            else:
                return "unbalanced delimiter" if sign in ("]", "}") else "unexpected token"
        else:
            return "unexpected token"
