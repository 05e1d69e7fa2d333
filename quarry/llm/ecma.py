"""A one-pass recogniser for ECMAScript modules and TypeScript, with JSX where the extension allows it.

The lexer is driven by the parser, as only the parser knows whether a ``/`` divides or opens a regular expression, whether a ``}``
ends a block or a template's substitution, and where the raw text of JSX begins. The pushdown stack is explicit for delimiters
(``self.open``), which gives the reason of a rejection, and is the call stack for constructs, whose limit is raised for texts that nest deeper. Expressions are a flat loop
over operands and operators, without a level per precedence, so that the cost is linear in the text.

It accepts a superset of the language in static semantics (redeclared names, assignment targets, ``await`` outside async functions),
which are no matters of the grammar a file's extension selects.
"""

from __future__ import annotations

import re
import sys

_TOKEN = re.compile(
    r"""(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/)*+
    (?:(?P<id>\#?(?:[^\W\d]|[$]|\\u[0-9a-fA-F{]+\}?)[\w$\u200c\u200d]*+(?:\\u[0-9a-fA-F{]+\}?[\w$\u200c\u200d]*+)*+)
      |(?P<num>(?:0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?)
      |(?P<str>"[^"\\\n\r]*+(?:\\(?:\r\n|[\s\S])[^"\\\n\r]*+)*+"|'[^'\\\n\r]*+(?:\\(?:\r\n|[\s\S])[^'\\\n\r]*+)*+')
      |(?P<punct>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.`@])
      |(?P<end>\Z))""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-zA-Z]*")
_TEMPLATE = re.compile(r"[^`\\$]*+(?:(?:\\[\s\S]|\$(?!\{))[^`\\$]*+)*+(`|\$\{)?")
#: Runs of tokens that the parser takes at once: plain import lines, member chains, and literals in arrays.
_IMPORT = re.compile(r"import +(?:[\w$]+|\* as [\w$]+|\{ ?[\w$]+(?:, ?[\w$]+)* ?\}) from ('|\")[^'\"\\\n]*\1;(?=\s)")
_CHAIN = re.compile(r"(?:\.[^\W\d][\w$]*+)++")
_LITERALS = re.compile(r"(?:\s*+(?:-?\d++(?:\.\d++)?|'[^'\\\n]*+'|\"[^\"\\\n]*+\"),)++(?=\s*+[\d'\"\]])")
_JSX_TEXT = re.compile(r"[^<{}>]*+")
_JSX_NAME = re.compile(r"\s*([A-Za-z_$][\w$.:-]*)")
_JSX_STRING = re.compile(r"\s*(?:\"[^\"]*\"|'[^']*')")
_CONFLICT = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?:[ \t]|$)", re.M)
_GENERIC_CALL = re.compile(r"<[\w\s,.|&\[\]{}:;?'\"<>()=]*?>\s*[(`]")
_GENERIC_ARROW = re.compile(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|extends\b|=|>\s*\()")

_MATCH = _TOKEN.match

# Words and operators of the languages.
_BINARY = frozenset("+ - * / % ** == != === !== < > <= >= && || ?? & | ^ << >> >>> = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= in instanceof".split())
_PREFIX = frozenset("+ - ! ~ ++ -- typeof void delete await".split())
_RESERVED = frozenset("break case catch class const continue debugger default do else enum export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false delete".split())
_OPERAND_WORDS = frozenset("this super null true false".split())
_TS_MODIFIERS = frozenset("public private protected readonly abstract override declare".split())
_MEMBER_MODIFIERS = frozenset("static async get set accessor".split()) | _TS_MODIFIERS
_TYPE_PREFIX = frozenset("keyof unique readonly infer asserts".split())
_AFTER_NAME = frozenset("( = ; : ? ! } , <".split()) | {""}
_OPTIONAL = re.compile(r"\s*\?\s*[:,)]")
#: Looks ahead of the current token, in the order of their use.
_P0 = re.compile(r"(?:[\s\ufeff]+|//[^\n\r]*|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/)*+")
_P1 = re.compile(r"\s*(?:[^\w$\[{\s]|in\b|of\b)")
_P2 = re.compile(r"\s*[,:=?)]")
_P3 = re.compile(r"[ \t]+function\b")
_P4 = re.compile(r"\s*[\w$]+\s*:")
_P5 = re.compile(r"\s*[(.]")
_P6 = re.compile(r"\s*(?:,|from\b|=)")
_P7 = re.compile(r"\s*[,}]|\s+as\b")
_P8 = re.compile(r"\s*[{*]")
_P9 = re.compile(r"[ \t]+(?:[\w$]|['\"{])")
_P10 = re.compile(r"\s*\{")
_P11 = re.compile(r"\s+[\w$]+\s*(?:<|=(?!=))")
_P12 = re.compile(r"\s*[(<]")
_P13 = re.compile(r"\s*(?::|in\b)")
_P14 = re.compile(r"\s+[\w$]")
_P15 = re.compile(r"\s*[\w$\[{(\"']")
_P16 = re.compile(r"\s*\??:")
_P17 = re.compile(r"\s*(?:\)|\.\.\.|[{\[]|[\w$]+\s*(?:[?:,]|\)\s*=>))")
_P18 = re.compile(r"[ \t]+(?:function\b|[\w$]+\s*=>)|\s*\(|\s*<")
_P19 = re.compile(r"<\s*[\w$]+\s*>\s*\(")
_P20 = re.compile(r"\s*(?:[\w$#\[*\"'])")
_P21 = re.compile(r"(?:\s+|//[^\n]*|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/)*+")


class Rejected(Exception):
    """The text is not in the language; args: reason, offset."""


class Recogniser:
    """Recognises one text. ``types``: TypeScript; ``jsx``: JSX is allowed."""

    def __init__(self, text: str, types: bool, jsx: bool):
        self.src, self.types, self.jsx = text, types, jsx
        self.open: list[tuple[str, int]] = []
        self.functions = self.blocks = 0
        self.k = self.v = ""
        self.s = self.e = self.prev = 0

    # -- lexer -------------------------------------------------------------------------------------------------------
    def fail(self, reason: str = "unexpected token") -> None:
        if self.k == "end":
            reason = "unbalanced delimiter" if self.open else "premature end"
        elif reason == "unexpected token" and self.v in ")]}" and self.v and (not self.open or self.open[-1][0] != {")": "(", "]": "[", "}": "{"}[self.v]):
            reason = "unbalanced delimiter"
        raise Rejected(reason, self.s)

    def next(self) -> None:
        self.prev = e = self.e
        m = _MATCH(self.src, e)
        if m is None:
            self.broken_literal()
        self.k = k = m.lastgroup
        self.v = m[k]
        self.s, self.e = m.span(k)
        if k == "num" and (c := self.src[self.e : self.e + 1]) and (c.isalnum() or c in "_$"):
            raise Rejected("unexpected token", self.s)

    def broken_literal(self) -> None:
        m = _P0.match(self.src, self.e)
        self.s = m.end()
        rest = self.src[self.s : self.s + 2]
        if rest[:1] in "'\"" or rest == "/*":
            raise Rejected("unterminated literal", self.s)
        raise Rejected("unexpected token", self.s)

    def newline(self) -> bool:
        between = self.src[self.prev : self.s]
        return "\n" in between or "\r" in between

    def expect(self, v: str) -> None:
        if self.v != v or self.k == "str":
            self.fail()
        self.next()

    def enter(self, v: str) -> None:
        if self.v != v:
            self.fail()
        self.open.append((v, self.s))
        self.next()

    def leave(self, v: str, advance: bool = True) -> None:
        if self.v != v or self.k != "punct":
            self.fail()
        self.open.pop()
        if advance:
            self.next()

    def split(self, v: str) -> None:
        """Take the one character ``v`` off the front of a longer operator."""
        if not self.v.startswith(v):
            self.fail()
        self.e = self.s + len(v)
        self.next()

    def semicolon(self) -> None:
        if self.v == ";":
            self.next()
        elif not (self.v == "}" or self.k == "end" or self.newline()):
            self.fail()

    def ident(self) -> None:
        if self.k != "id" or self.v in _RESERVED:
            self.fail()
        self.next()

    # -- statements --------------------------------------------------------------------------------------------------
    def module(self) -> None:
        if self.src.startswith("#!"):
            self.e = len(self.src.split("\n", 1)[0])
        self.next()
        while self.k != "end":
            if self.v == "import" and (m := _IMPORT.match(self.src, self.s)) is not None:
                self.e = m.end()
                self.next()
            else:
                self.statement()

    def block(self) -> None:
        self.enter("{")
        self.blocks += 1
        while self.v != "}" or self.k != "punct":
            if self.k == "end":
                self.fail()
            self.statement()
        self.blocks -= 1
        self.leave("}")

    def parens(self) -> None:
        self.enter("(")
        self.exprs()
        self.leave(")")

    def statement(self) -> None:
        if self.k == "id":
            handler = _STATEMENTS.get(self.v)
            if handler is not None:
                if handler(self) is not False:
                    return
            elif self.types and self.v in _TS_STATEMENTS and self.ts_statement():
                return
        elif self.v == "{":
            return self.block()
        elif self.v == ";":
            return self.next()
        elif self.v == "@":
            return self.decorated()
        simple = self.k == "id" and self.v not in _RESERVED
        start = self.s
        self.exprs()
        if simple and self.v == ":" and re.fullmatch(r"[\w$]+\s*", self.src[start : self.s]):
            self.next()
            return self.statement()
        self.semicolon()

    def decorated(self) -> None:
        while self.v == "@":
            self.next()
            self.operand()
        if self.v in ("export", "abstract", "class", "default"):
            return self.statement()
        self.fail()

    def s_if(self):
        while True:
            self.next()
            self.parens()
            self.statement()
            if self.v != "else" or self.k != "id":
                return
            self.next()
            if self.v != "if" or self.k != "id":
                return self.statement()

    def s_while(self):
        self.next()
        self.parens()
        self.statement()

    def s_do(self):
        self.next()
        self.statement()
        self.expect("while")
        self.parens()
        if self.v == ";":
            self.next()

    def s_for(self):
        self.next()
        if self.v == "await":
            self.next()
        self.enter("(")
        if self.v != ";":
            if self.v in ("const", "let", "var"):
                self.next()
                self.declarators(loop=True)
            else:
                self.exprs(loop=True)
        if self.v in ("of", "in"):
            self.next()
            self.exprs()
        else:
            self.expect(";")
            if self.v != ";":
                self.exprs()
            self.expect(";")
            if self.v != ")":
                self.exprs()
        self.leave(")")
        self.statement()

    def s_declare(self):
        if self.v == "let" and _P1.match(self.src, self.e):
            return False
        self.next()
        if self.v == "enum" and self.types:
            return self.enum()
        self.declarators()
        self.semicolon()
        return None

    def declarators(self, loop: bool = False) -> None:
        while True:
            self.binding()
            if self.v == "!" and self.types:
                self.next()
            if self.v == ":":
                self.annotation()
            if self.v == "=":
                self.next()
                self.expr(loop)
            if self.v != ",":
                return
            self.next()

    def binding(self) -> None:
        if self.v == "{":
            self.object()
        elif self.v == "[":
            self.array()
        else:
            self.ident()

    def annotation(self) -> None:
        """``: type``, which only TypeScript has."""
        if not self.types:
            self.fail("type in JavaScript")
        self.next()
        self.type()

    def s_return(self):
        if not self.functions:
            self.fail()
        self.s_throw(optional=True)

    def s_throw(self, optional: bool = False):
        self.next()
        if self.k == "end" and not optional:
            self.fail()
        if self.newline() or self.v in (";", "}") and self.k == "punct" or self.k == "end":
            if not optional:
                self.fail()
        else:
            self.exprs()
        self.semicolon()

    def s_break(self):
        self.next()
        if self.k == "id" and not self.newline() and self.v not in _RESERVED:
            self.next()
        self.semicolon()

    def s_try(self):
        self.next()
        self.block()
        caught = False
        if self.v == "catch":
            caught = True
            self.next()
            if self.v == "(":
                self.enter("(")
                self.binding()
                if self.v == ":":
                    self.annotation()
                self.leave(")")
            self.block()
        if self.v == "finally":
            caught = True
            self.next()
            self.block()
        if not caught:
            self.fail()

    def s_switch(self):
        self.next()
        self.parens()
        self.enter("{")
        self.blocks += 1
        while self.v != "}":
            if self.v == "case" and self.k == "id":
                self.next()
                self.exprs()
            elif self.v == "default" and self.k == "id":
                self.next()
            else:
                self.fail()
            self.expect(":")
            while not (self.k == "id" and self.v in ("case", "default") or self.k == "punct" and self.v == "}"):
                if self.k == "end":
                    self.fail()
                self.statement()
        self.blocks -= 1
        self.leave("}")

    def s_function(self):
        self.function(named=True)

    def function(self, named: bool) -> None:
        """From the word ``function`` on."""
        self.next()
        if self.v == "*":
            self.next()
        if self.k == "id" and self.v not in _RESERVED:
            self.next()
        elif named:
            self.fail()
        self.rest_of_function(bodiless=self.types and named)

    def rest_of_function(self, bodiless: bool = False) -> None:
        if self.v == "<":
            self.type_parameters()
        self.params()
        if self.v == ":":
            self.annotation()
        if bodiless and self.v != "{":
            return self.semicolon()
        self.functions += 1
        self.block()
        self.functions -= 1

    def params(self) -> None:
        self.enter("(")
        while self.v != ")":
            while self.v == "@":
                self.next()
                self.operand()
            while self.types and self.v in _TS_MODIFIERS and not _P2.match(self.src, self.e):
                self.next()
            if self.v == "...":
                self.next()
            if self.v == "this" and self.types:
                self.next()
            else:
                self.binding()
            if self.v == "?":
                if not self.types:
                    self.fail("type in JavaScript")
                self.next()
            if self.v == ":":
                self.annotation()
            if self.v == "=":
                self.next()
                self.expr()
            if self.v != ",":
                break
            self.next()
        self.leave(")")

    def s_async(self):
        if not _P3.match(self.src, self.e):
            return False
        self.next()
        self.function(named=True)
        return None

    def s_class(self):
        self.next()
        if self.k == "id" and self.v not in _RESERVED and self.v != "implements":
            self.next()
        else:
            self.fail()
        self.class_tail()

    def class_tail(self) -> None:
        if self.v == "<":
            self.type_parameters()
        if self.v == "extends":
            self.next()
            self.operand()
            if self.v == "<" and self.types:
                self.type_arguments()
        if self.v == "implements":
            if not self.types:
                self.fail("type in JavaScript")
            self.next()
            self.type()
            while self.v == ",":
                self.next()
                self.type()
        self.enter("{")
        while self.v != "}" or self.k != "punct":
            self.member()
        self.leave("}")

    def member(self) -> None:
        while self.v == "@":
            self.next()
            self.operand()
        if self.v == ";":
            return self.next()
        named = False
        while self.k == "id" and self.v in _MEMBER_MODIFIERS:
            word = self.v
            self.next()
            if word == "static" and self.v == "{":
                self.functions += 1
                self.block()
                self.functions -= 1
                return None
            if self.k == "punct" and self.v in _AFTER_NAME or self.k == "end" or self.newline() and word not in ("static", "async", "get", "set") and self.k != "id":
                named = True
                break
            if word in _TS_MODIFIERS and not self.types:
                self.fail("type in JavaScript")
        if not named:
            if self.v == "*" and self.k == "punct":
                self.next()
            if self.types and self.v == "[" and _P4.match(self.src, self.e):
                self.index_signature()
                return self.semicolon()
            self.key()
        if self.v in ("?", "!") and self.types:
            self.next()
        if self.v in ("(", "<"):
            return self.rest_of_function(bodiless=self.types)
        if self.v == ":":
            self.annotation()
        if self.v == "=":
            self.next()
            self.functions += 1
            self.expr()
            self.functions -= 1
        return self.semicolon()

    def key(self) -> None:
        if self.v == "[" and self.k == "punct":
            self.enter("[")
            self.expr()
            self.leave("]")
        elif self.k in ("id", "str", "num"):
            self.next()
        else:
            self.fail()

    def s_import(self):
        m = _P5.match(self.src, self.e)
        if m:
            return False
        if self.blocks or self.functions:
            self.fail()
        self.next()
        if self.types and self.v == "type" and not _P6.match(self.src, self.e):
            self.next()
        if self.k == "str":
            self.next()
            self.attributes()
            self.semicolon()
            return None
        if self.k == "id":
            self.ident()
            if self.v == "=" and self.types:
                self.next()
                self.exprs()
                self.semicolon()
                return None
            if self.v == ",":
                self.next()
            elif self.v != "from":
                self.fail()
        if self.v == "*":
            self.next()
            self.expect("as")
            self.ident()
        elif self.v == "{":
            self.specifiers()
        self.source()
        return None

    def attributes(self) -> None:
        if self.v in ("with", "assert") and not self.newline():
            self.next()
            self.object()

    def source(self) -> None:
        self.expect("from")
        if self.k != "str":
            self.fail()
        self.next()
        self.attributes()
        self.semicolon()

    def specifiers(self) -> None:
        self.enter("{")
        while self.v != "}":
            if self.k not in ("id", "str"):
                self.fail()
            if self.types and self.v == "type" and not _P7.match(self.src, self.e):
                self.next()
            self.next()
            if self.v == "as":
                self.next()
                if self.k not in ("id", "str"):
                    self.fail()
                self.next()
            if self.v != ",":
                break
            self.next()
        self.leave("}")

    def s_export(self):
        if self.blocks and not self.types or self.functions:
            self.fail()
        self.next()
        if self.v == "default":
            self.next()
            if self.v in ("function", "class", "abstract", "async", "interface"):
                if self.v == "abstract" and self.types:
                    self.next()
                if self.v == "async" and _P3.match(self.src, self.e):
                    self.next()
                if self.v == "function":
                    return self.function(named=False)
                if self.v == "class":
                    self.next()
                    if self.k == "id" and self.v not in _RESERVED and self.v != "implements":
                        self.next()
                    return self.class_tail()
                if self.v == "interface" and self.types:
                    return self.interface()
            self.expr()
            return self.semicolon()
        if self.types and self.v == "type" and _P8.match(self.src, self.e):
            self.next()
        if self.v == "*":
            self.next()
            if self.v == "as":
                self.next()
                self.next()
            return self.source()
        if self.v == "{":
            self.specifiers()
            return self.source() if self.v == "from" else self.semicolon()
        if self.types and self.v in ("=", "as", "import"):
            self.next()
            if self.v == "namespace":
                self.next()
            self.exprs()
            return self.semicolon()
        if self.k == "id" and (self.v in ("const", "let", "var", "function", "class", "async") or self.types and self.v in _TS_STATEMENTS):
            return self.statement()
        if self.v == "@":
            return self.decorated()
        return self.fail("type in JavaScript" if self.v in _TS_STATEMENTS else "unexpected token")

    # -- TypeScript's statements and types ---------------------------------------------------------------------------
    def ts_statement(self) -> bool:
        word, rest = self.v, _P9.match(self.src, self.e)
        if word == "enum":
            self.enum()
            return True
        if not rest and not (word == "global" and _P10.match(self.src, self.e)):
            return False
        if word == "interface":
            self.interface()
        elif word == "type":
            if not _P11.match(self.src, self.e):
                return False
            self.next()
            self.ident()
            if self.v == "<":
                self.type_parameters()
            self.expect("=")
            self.type()
            self.semicolon()
        elif word in ("declare", "abstract"):
            self.next()
            self.statement()
        elif word in ("namespace", "module", "global"):
            if word != "global":
                self.next()
                while self.k in ("id", "str"):
                    self.next()
                    if self.v == ".":
                        self.next()
            else:
                self.next()
            if self.v == ";":
                self.next()
            else:
                self.block()
        return True

    def enum(self) -> None:
        self.next()
        self.ident()
        self.enter("{")
        while self.v != "}":
            self.key()
            if self.v == "=":
                self.next()
                self.expr()
            if self.v != ",":
                break
            self.next()
        self.leave("}")

    def interface(self) -> None:
        self.next()
        self.ident()
        if self.v == "<":
            self.type_parameters()
        if self.v == "extends":
            self.next()
            self.type()
            while self.v == ",":
                self.next()
                self.type()
        self.type_members()

    def type_members(self) -> None:
        self.enter("{")
        while self.v != "}" or self.k != "punct":
            if self.k == "end":
                self.fail()
            if self.v in ("+", "-"):
                self.next()
            while self.k == "id" and self.v in ("readonly", "get", "set", "static"):
                self.next()
                if self.k == "punct" and self.v in ("?", ":", "(", ";", ","):
                    break
            else:
                if self.v == "[":
                    self.index_signature(annotated=False)
                elif self.v not in ("(", "<") or self.k == "str":
                    if self.v == "new" and _P12.match(self.src, self.e):
                        self.next()
                    else:
                        self.key()
            if self.v in ("+", "-"):
                self.next()
            if self.v == "?":
                self.next()
            if self.v in ("(", "<"):
                if self.v == "<":
                    self.type_parameters()
                self.params()
            if self.v == ":":
                self.next()
                self.type()
            if self.v in (";", ","):
                self.next()
            elif not (self.v == "}" or self.newline()):
                self.fail()
        self.leave("}")

    def index_signature(self, annotated: bool = True) -> None:
        """``[key: T]``, ``[K in T]``, ``[K in T as U]`` or ``[expr]`` with, where ``annotated``, the type after it."""
        self.enter("[")
        if self.k == "id" and _P13.match(self.src, self.e):
            self.next()
            self.next()
            self.type()
            if self.v == "as":
                self.next()
                self.type()
        else:
            self.expr()
        self.leave("]")
        if annotated and self.v == ":":
            self.annotation()

    def type_parameters(self) -> None:
        if not self.types:
            self.fail("type in JavaScript")
        self.enter("<")
        while not self.v.startswith(">"):
            while self.v in ("const", "in", "out") and _P14.match(self.src, self.e):
                self.next()
            self.ident()
            if self.v == "extends":
                self.next()
                self.type()
            if self.v == "=":
                self.next()
                self.type()
            if self.v != ",":
                break
            self.next()
        self.open.pop()
        self.split(">")

    def type_arguments(self) -> None:
        self.open.append(("<", self.s))
        self.split("<")
        while not self.v.startswith(">"):
            self.type()
            if self.v != ",":
                break
            self.next()
        self.open.pop()
        self.split(">")

    def type(self) -> None:
        if self.v in ("|", "&"):
            self.next()
        while True:
            self.type_operand()
            if self.v in ("|", "&"):
                self.next()
                continue
            if self.v == "extends" and not self.newline():
                self.next()
                self.type()
                if self.v == "?":
                    self.next()
                    self.type()
                    self.expect(":")
                    self.type()
            return

    def type_operand(self) -> None:
        while self.k == "id" and (self.v in _TYPE_PREFIX or self.v in ("typeof", "abstract")) and _P15.match(self.src, self.e):
            self.next()
        v, k = self.v, self.k
        if k == "id":
            if v == "new" or v == "import":
                self.next()
                if v == "import":
                    self.parens()
                else:
                    return self.type_operand()
            elif v in _RESERVED and v not in ("this", "void", "null", "true", "false"):
                self.fail()
            else:
                self.next()
            while self.v == ".":
                self.next()
                if self.k != "id":
                    self.fail()
                self.next()
            if self.v == "is" and not self.newline():
                self.next()
                return self.type()
            if self.v.startswith("<") and self.v in ("<", "<<"):
                self.type_arguments()
        elif k in ("str", "num"):
            self.next()
        elif v == "-":
            self.next()
            if self.k != "num":
                self.fail()
            self.next()
        elif v == "`":
            self.template()
        elif v == "{":
            self.type_members()
        elif v == "[":
            self.enter("[")
            while self.v != "]":
                if self.v == "...":
                    self.next()
                if self.k == "id" and _P16.match(self.src, self.e):
                    self.next()
                    if self.v == "?":
                        self.next()
                    self.next()
                self.type()
                if self.v == "?":
                    self.next()
                if self.v != ",":
                    break
                self.next()
            self.leave("]")
        elif v == "<":
            self.type_parameters()
            return self.type_operand()
        elif v == "(":
            if _P17.match(self.src, self.e):
                state = (self.k, self.v, self.s, self.e, self.prev, len(self.open))
                try:
                    self.params()
                    self.expect("=>")
                    return self.type()
                except Rejected:
                    self.k, self.v, self.s, self.e, self.prev = state[:5]
                    del self.open[state[5] :]
            self.enter("(")
            self.type()
            self.leave(")")
            if self.v == "=>":
                self.next()
                return self.type()
        else:
            self.fail()
        while self.v == "[" and not self.newline():
            self.enter("[")
            if self.v != "]":
                self.type()
            self.leave("]")
        return None

    # -- expressions -------------------------------------------------------------------------------------------------
    def exprs(self, loop: bool = False) -> None:
        self.expr(loop)
        while self.v == "," and self.k == "punct":
            self.next()
            self.expr(loop)

    def expr(self, loop: bool = False, ternary: bool = False) -> None:
        while True:
            arrow = self.operand(ternary)
            if arrow:
                return
            k, v = self.k, self.v
            if k == "str" or k == "num" or k == "end":
                return
            if v == "?":
                self.next()
                self.expr(False, True)
                self.expect(":")
                continue
            if v in _BINARY:
                if loop and v == "in":
                    return
                self.next()
                continue
            if self.types and k == "id" and v in ("as", "satisfies") and not self.newline():
                while self.v in ("as", "satisfies"):
                    self.next()
                    if self.v == "const":
                        self.next()
                    else:
                        self.type()
                if self.v == "?":
                    self.next()
                    self.expr(False, True)
                    self.expect(":")
                    continue
                if self.v in _BINARY and self.k != "str":
                    self.next()
                    continue
            return

    def operand(self, ternary: bool = False) -> bool:
        """One operand with its prefix and postfix operators; true if it was an arrow function, after which nothing can follow."""
        while self.v in _PREFIX and self.k != "str":
            self.next()
        k, v = self.k, self.v
        if k == "id":
            if v in _RESERVED and v not in _OPERAND_WORDS:
                if v == "function":
                    self.function(named=False)
                elif v == "class":
                    self.next()
                    if self.k == "id" and self.v not in ("extends", "implements"):
                        self.next()
                    self.class_tail()
                elif v == "new":
                    self.next()
                    if self.v == ".":
                        self.next()
                        self.next()
                    else:
                        return self.operand(ternary)
                elif v == "import":
                    self.next()
                    if self.v == ".":
                        self.next()
                        self.ident()
                    elif self.v == "(":
                        self.arguments()
                    else:
                        self.fail()
                else:
                    self.fail()
            elif v == "async" and _P18.match(self.src, self.e):
                self.next()
                if self.v == "function":
                    self.function(named=False)
                elif self.v == "<" and self.types:
                    self.type_parameters()
                    return self.operand(ternary)
                elif self.v == "(":
                    if self.parenthesised(ternary):
                        return True
                else:
                    return self.operand(ternary)
            elif v == "yield":
                self.next()
                if self.v == "*":
                    self.next()
                if self.newline() or self.k == "end" or self.v in (")", "]", "}", ",", ";", ":"):
                    return False
                return self.operand(ternary)
            else:
                if (m := _CHAIN.match(self.src, self.e)) is not None:
                    self.e = m.end()
                self.next()
                if self.v == "=>":
                    self.arrow_body()
                    return True
        elif k == "num" or k == "str":
            self.next()
        elif v == "(":
            if self.parenthesised(ternary):
                return True
        elif v == "[":
            self.array()
        elif v == "{":
            self.object()
        elif v == "`":
            self.template()
        elif v == "/" or v == "/=":
            m = _REGEX.match(self.src, self.s)
            if m is None:
                raise Rejected("unterminated literal", self.s)
            self.e = m.end()
            self.next()
        elif v == "<":
            if self.jsx and not (self.types and _GENERIC_ARROW.match(self.src, self.s) and not _P19.match(self.src, self.s)):
                self.jsx_element()
                self.next()
            elif self.types:
                self.type_arguments() if not _GENERIC_ARROW.match(self.src, self.s) else self.type_parameters()
                return self.operand(ternary)
            else:
                self.fail("JSX in a file without JSX")
        elif v == "@":
            self.decorated()
        elif v == "...":
            self.fail()
        else:
            self.fail()
        while True:
            v = self.v
            if self.k == "punct":
                if v == ".":
                    self.next()
                    if self.k != "id":
                        self.fail()
                    self.next()
                    continue
                if v == "(":
                    self.arguments()
                    continue
                if v == "[":
                    self.enter("[")
                    self.exprs()
                    self.leave("]")
                    continue
                if v == "?.":
                    self.next()
                    if self.k == "id":
                        self.next()
                    elif self.v not in ("(", "[", "`"):
                        self.fail()
                    continue
                if v == "`":
                    self.template()
                    continue
                if v == "++" or v == "--":
                    if self.newline():
                        return False
                    self.next()
                    continue
                if self.types and v == "!" and not self.newline():
                    self.next()
                    continue
                if self.types and v == "<" and _GENERIC_CALL.match(self.src, self.s):
                    state = (self.k, self.v, self.s, self.e, self.prev, len(self.open))
                    try:
                        self.type_arguments()
                        if self.v in ("(", "`"):
                            continue
                    except Rejected:
                        pass
                    self.k, self.v, self.s, self.e, self.prev = state[:5]
                    del self.open[state[5] :]
            return False

    def arguments(self) -> None:
        self.enter("(")
        while self.v != ")" or self.k == "str":
            if self.v == "..." and self.k == "punct":
                self.next()
            self.expr()
            if self.v != ",":
                break
            self.next()
        self.leave(")")

    def array(self) -> None:
        if (m := _LITERALS.match(self.src, self.e)) is not None:
            self.e = m.end()
        self.enter("[")
        while self.v != "]" or self.k == "str":
            if self.v == "," and self.k == "punct":
                self.next()
                continue
            if self.v == "..." and self.k == "punct":
                self.next()
            self.expr()
            if self.v != ",":
                break
            self.next()
        self.leave("]")

    def object(self) -> None:
        self.enter("{")
        while self.v != "}" or self.k == "str":
            if self.v == "..." and self.k == "punct":
                self.next()
                self.expr()
            else:
                while self.k == "id" and self.v in ("async", "get", "set") and _P20.match(self.src, self.e):
                    self.next()
                if self.v == "*" and self.k == "punct":
                    self.next()
                shorthand = self.k == "id" and self.v not in _RESERVED
                self.key()
                if self.v in ("(", "<") and self.k == "punct":
                    self.rest_of_function()
                elif self.v == ":" and self.k == "punct":
                    self.next()
                    self.expr()
                elif self.v == "=" and shorthand:
                    self.next()
                    self.expr()
                elif not shorthand:
                    self.fail()
            if self.v != "," or self.k == "str":
                break
            self.next()
        self.leave("}")

    def arrow_body(self) -> None:
        if self.newline():
            self.fail()
        self.next()
        self.functions += 1
        if self.v == "{" and self.k == "punct":
            self.block()
        else:
            self.expr()
        self.functions -= 1

    def parenthesised(self, ternary: bool) -> bool:
        """A bracketed expression, or an arrow function, whose parameters look like one until the arrow."""
        self.enter("(")
        only_params = self.v == ")"
        typed = False
        while self.v != ")" or self.k == "str":
            if self.v == "..." and self.k == "punct":
                self.next()
                self.binding()
                only_params = True
            elif self.types and self.k == "id" and _OPTIONAL.match(self.src, self.e):
                self.ident()
            else:
                self.expr()
            if self.types and self.k == "punct" and self.v in (":", "?"):
                typed = only_params = True
                if self.v == "?":
                    self.next()
                if self.v == ":":
                    self.annotation()
                if self.v == "=":
                    self.next()
                    self.expr()
            elif self.v == ":" and self.k == "punct":
                self.fail("type in JavaScript")
            if self.v != ",":
                break
            self.next()
            if self.v == ")":
                only_params = True
        self.leave(")")
        if self.v == "=>" and self.k == "punct":
            self.arrow_body()
            return True
        if self.types and self.v == ":" and (only_params or not ternary):
            state = (self.k, self.v, self.s, self.e, self.prev, len(self.open))
            try:
                self.annotation()
                if self.v == "=>":
                    self.arrow_body()
                    return True
            except Rejected:
                if only_params:
                    raise
            self.k, self.v, self.s, self.e, self.prev = state[:5]
            del self.open[state[5] :]
        if only_params:
            self.fail("type in JavaScript" if typed and not self.types else "unexpected token")
        return False

    def template(self) -> None:
        self.open.append(("`", self.s))
        at = self.s + 1
        while True:
            m = _TEMPLATE.match(self.src, at)
            if m.group(1) is None:
                raise Rejected("unterminated literal", self.open[-1][1])
            self.e = m.end()
            if m.group(1) == "`":
                self.open.pop()
                return self.next()
            self.next()
            self.exprs()
            if self.v != "}":
                self.fail()
            at = self.s + 1

    # -- JSX ---------------------------------------------------------------------------------------------------------
    def jsx_word(self, at: int) -> tuple[str, int]:
        m = _JSX_NAME.match(self.src, at)
        if m is None:
            raise Rejected("unexpected token" if self.src[at:].strip() else "unbalanced delimiter", at)
        return m.group(1), m.end()

    def jsx_skip(self, at: int) -> int:
        return _P21.match(self.src, at).end()

    def jsx_substitution(self, at: int) -> int:
        """From an opening brace at ``at`` to behind its closing one."""
        self.e = at
        self.next()
        self.enter("{")
        if self.v == "...":
            self.next()
        if self.v != "}":
            self.exprs()
        self.leave("}", advance=False)
        return self.e

    def jsx_element(self) -> None:
        """An element whose ``<`` is the current token; the lexer then stands right behind its last ``>``."""
        src, start, at = self.src, self.s, self.s + 1
        self.open.append(("<", start))
        name = ""
        at = self.jsx_skip(at)
        if src[at : at + 1] != ">":
            name, at = self.jsx_word(at)
            if self.types and src[at : at + 1] == "<":
                self.e = at
                self.next()
                self.type_arguments()
                at = self.s
            while True:
                at = self.jsx_skip(at)
                c = src[at : at + 1]
                if c == "{":
                    at = self.jsx_substitution(at)
                elif c == "/":
                    at = self.jsx_skip(at + 1)
                    if src[at : at + 1] != ">":
                        raise Rejected("unexpected token", at)
                    self.open.pop()
                    self.e = at + 1
                    return
                elif c == ">":
                    break
                else:
                    _, at = self.jsx_word(at)
                    at = self.jsx_skip(at)
                    if src[at : at + 1] == "=":
                        at = self.jsx_skip(at + 1)
                        c = src[at : at + 1]
                        if c == "{":
                            at = self.jsx_substitution(at)
                        elif c == "<":
                            self.s = at
                            self.jsx_element()
                            at = self.e
                        else:
                            m = _JSX_STRING.match(src, at)
                            if m is None:
                                raise Rejected("unterminated literal" if c in "'\"" else "unexpected token", at)
                            at = m.end()
        at += 1
        while True:
            at = _JSX_TEXT.match(src, at).end()
            c = src[at : at + 1]
            if c == "{":
                at = self.jsx_substitution(at)
            elif c == "<":
                inner = self.jsx_skip(at + 1)
                if src[inner : inner + 1] == "/":
                    at = self.jsx_skip(inner + 1)
                    closing = ""
                    if src[at : at + 1] != ">":
                        closing, at = self.jsx_word(at)
                        at = self.jsx_skip(at)
                    if closing != name or src[at : at + 1] != ">":
                        raise Rejected("unbalanced delimiter", at)
                    self.open.pop()
                    self.e = at + 1
                    return
                self.s = at
                self.jsx_element()
                at = self.e
            else:
                raise Rejected("unexpected token" if c else "unbalanced delimiter", at)


_R = Recogniser
_STATEMENTS = {
    "if": _R.s_if, "while": _R.s_while, "do": _R.s_do, "for": _R.s_for, "const": _R.s_declare, "let": _R.s_declare, "var": _R.s_declare,
    "return": _R.s_return, "throw": _R.s_throw, "break": _R.s_break, "continue": _R.s_break, "debugger": _R.s_break, "try": _R.s_try,
    "switch": _R.s_switch, "function": _R.s_function, "async": _R.s_async, "class": _R.s_class, "import": _R.s_import, "export": _R.s_export,
}
_TS_STATEMENTS = frozenset("interface type enum declare abstract namespace module global".split())


#: Calls on the stack for a text that nests deeper than Python's usual limit. They lie on the heap, at about 160 bytes each.
DEEPEST = 2_000_000


def lex(text: str, jsx: bool) -> tuple[str, int] | None:
    """Reason and offset to reject by literals, delimiters and conflict markers alone, to the end of the text, or None.

    Without the grammar, the token before a ``/`` tells a regular expression from a division, and a quote without its end is taken
    for text where JSX is allowed.
    """
    stack: list[str] = []
    at = len(text.split("\n", 1)[0]) if text.startswith("#!") else 0
    divides = False
    while True:
        m = _MATCH(text, at)
        if m is None:
            at = _P0.match(text, at).end()
            if not jsx and (text[at] in "'\"" or text.startswith("/*", at)):
                return "unterminated literal", at
            at, divides = at + 1, False
            continue
        k = m.lastgroup
        v, start, at = m[k], m.start(k), m.end()
        if k == "end":
            return ("unbalanced delimiter", start) if stack else None
        template = False
        if k == "punct":
            if v[0] in "<>" and _CONFLICT.match(text, start):
                return "merge conflict", start
            if v == "`" or v == "}" and stack and stack[-1] == "`":
                template = True
                if v == "}":
                    stack.pop()
            elif v in "([{":
                stack.append(v)
            elif v in ")]}":
                if not stack or stack.pop() != {")": "(", "]": "[", "}": "{"}[v]:
                    return "unbalanced delimiter", start
            elif v in ("/", "/=") and not divides and (m := _REGEX.match(text, start)) is not None:
                at, v = m.end(), ")"
        if template:
            m = _TEMPLATE.match(text, at)
            if m.group(1) is None:
                return "unterminated literal", start
            at = m.end()
            if m.group(1) == "${":
                stack.append("`")
            divides = m.group(1) == "`"
        else:
            divides = k in ("num", "str") or k == "id" and (v not in _RESERVED or v in _OPERAND_WORDS) or k == "punct" and v in ")]}"


def _recognised(text: str, types: bool, jsx: bool) -> tuple[str, int] | None:
    try:
        Recogniser(text, types, jsx).module()
    except Rejected as e:
        reason, at = e.args
        if (m := _CONFLICT.search(text)) is not None and m.start() <= at + 1 and at <= text.find("\n", m.start()) + 200:
            return "merge conflict", m.start()
        return reason, at
    return None


def reject(text: str, types: bool, jsx: bool) -> tuple[str, int] | None:
    """Reason and offset if the text is not in the language, else None. Nesting beyond ``DEEPEST`` calls is left to ``lex``."""
    try:
        return _recognised(text, types, jsx)
    except RecursionError:
        pass
    usual = sys.getrecursionlimit()
    try:
        sys.setrecursionlimit(max(usual, DEEPEST))
        return _recognised(text, types, jsx)
    except (RecursionError, MemoryError):
        pass
    finally:
        sys.setrecursionlimit(usual)
    return lex(text, jsx)
