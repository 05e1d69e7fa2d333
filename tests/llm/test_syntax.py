from __future__ import annotations

import ast
import json
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import ecma, pyauto, syntax

VALID = {
    "js": [
        "", "a\nb", "const {a, b: [c] = d} = f(1, ...x);", "x = a ? b : c ? d : e", "for (const [k, v] of Object.entries(o)) { continue }", "const r = /[/\\]}]+/gi.test(s) / 2;",
        "label: for (;;) break label;", "class A extends B { static #x = 1; get y() { return this.#x } async *z() {} ['w']() {} }", "export default async () => { await 1 };", "`a ${`b ${c} }`} {`",
        "if (a) b; else c", "let x = async (a, {b} = {}) => a?.b?.[0]?.(1) ?? 2", "do x++; while (x < 3)", "new Foo.Bar(1)(2)", "import('x').then(y => y); import a, * as b from 'b'; export * as c from 'c'",
        "switch (a) { case 1: { x } default: y }", "var o = {a, 'b': 1, [c]: 2, get d() { return 1 }, async e() {}, ...f}", "#!/usr/bin/env node\nx", "a = b\n++c", "x = y / z / 2", "try { a } catch { b } finally { c }",
        "function* g() { yield; yield* h(); const x = yield 1 }", "(function () {})(), (() => {})()", "throw new Error(`x`)", "a\n;/re/.test(b)", "const a = 1_000n, b = .5e-3, c = 0xFF",
    ],
    "jsx": ["const a = <><B.C d-e='f' {...g}>text, don't {h && <I/>} </B.C></>;", "return_(<a b={c} d=\"e\nf\"/>)", "x = <a>{/* c */}{[1].map((i) => (<li key={i}>{i}</li>))}</a>"],
    "ts": [
        "interface A<T extends B = C> extends D { readonly x?: T; [k: string]: any; (a: number): void; m<T>(x: T): x is Y }", "type A = { [K in keyof T]?: T[K] } | (() => void) | `a${B}`;", "enum X { A = 1, B, 'c' }",
        "abstract class A<T> implements B<T>, C { private constructor(readonly x: number, y?: string) { super() } abstract m(): void; static n?: Map<string, Array<number>> = new Map<string, Array<number>>(); declare z: string }",
        "let f = <T>(x: T): T => x; let g = (a?: number, ...b: string[]): void => {};", "const a = b as unknown as C<D>[]; const e = f!.g satisfies H;", "declare module 'x' { export const y: number }", "namespace A.B { let c = 1 }",
        "function f(this: A, x: number | null = null): asserts x is number {}\nfunction f(x) { return x ? (y) : z }", "import type { A } from 'a'; import { type B } from 'b'; export type { C };", "let x: [a: string, b?: number, ...c: any[]] = y; const z = a < b && c > d;", "f<A, B>(c); new Map<string, () => void>()",
        "type F = new (...a: any[]) => T; type C = A extends infer U ? U : never; let u: unique symbol", "let v = <any>w;",
    ],
    "tsx": ["const f = <T,>(x: T) => <a b={x as string}>{x!}</a>;", "export function A({ b }: any) { const [c, d] = useState<number>(1); return (<p onClick={() => d(c + 1)}>{c > 5 && <B c={b} />}</p>); }"],
    "py": ["", "x = 1\n", "def f():\n    return '''a\n(b'''\n", "match x:\n    case [1, _]:\n        pass\n", "f'{x!r:>{w}}'\n", "type X = int\n", "# only ( a comment\n", "x = (\n  1,  # )\n)\n"],
    "json": ["{}", "[1, 2.5e3, \"a\\n\", null]", "\r\n{\"a\": {}}\n", "3"],
}
INVALID = {
    "js": [
        "const x: number = 1;", "interface A { b: string }", "function f(a: string) {}", "let a = <div/>;", "x = {", "f(1, 2", "a b", "const a = ;", "x = 'abc\n'", "`abc", "/* abc", "x = /abc", "a.", "if (x)", "} ", "f(]", "return 1", "enum X { A }",
        "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n", "This module is responsible for the marker.", "def f():\n    pass", "import a from", "class A { x", "3px", "for (const a of b", "try { a }", "export type A = B;", "x as string", "private x = 1;", "let = 1 +",
        ".a { color: #fff; }", "<!DOCTYPE html>", "{\n  \"a\": 1,\n  \"b\": 2\n}", "class A { private x() {} }",
    ],
    "jsx": ["x = <a>", "x = <a></b>", "x = <a b=></a>", "x = <a>{</a>", "x = <a>}</a>", "const x: A = 1"],
    "ts": ["let a = (<section className=\"x\">b</section>);", "interface A { b: }", "let x: = 1", "type A = ", "x = <T>", "f(a: number)"],
    "tsx": ["const a = <p>{b}", "let x: Array<"],
    "py": ["print 'x'", "def f(:", "x = (", "'abc", "'''abc", "if x:\n", "  x\n y\n", "<<<<<<< HEAD\n", "export function f() {}", "x = 0777"],
    "json": ["", "{a: 1}", "[1,]", "{\"a\": NaN}", "[1] x", "\"abc", "{\"a\": 1", "// c\n{}", "<html></html>", "'a'"],
}


@pytest.mark.parametrize(("extension", "text"), [(e, t) for e, ts in VALID.items() for t in ts])
def test_accepts(extension, text):
    for variant in (text, "﻿" + text, text.replace("\n", "\r\n")):
        if not (variant != text and text.startswith("#!")):
            assert syntax.reject(variant, extension) is None


@pytest.mark.parametrize(("extension", "text"), [(e, t) for e, ts in INVALID.items() for t in ts])
def test_rejects(extension, text):
    assert syntax.reject(text, extension) is not None


def test_reasons():
    assert syntax.reject("x = 'abc", "js") == "unterminated literal"
    assert syntax.reject("f((1)", "ts") == "unbalanced delimiter"
    assert syntax.reject("a\n<<<<<<< HEAD\nb\n=======\nc\n>>>>>>> d\n", "ts") == "merge conflict"
    assert syntax.reject("x = 1 +", "js") == "premature end"
    assert syntax.reject("x = '''a", "py") == "unterminated literal"


def test_truncation_within_a_bracket_is_found():
    text = "export function f(a, b) {\n  const c = a ? `x ${b} {` : /[)}]/.test(b);\n  return { ...c, d: [1, 2] };\n}\n"
    assert ecma.reject(text, False, False) is None
    for end in range(text.index("(") + 1, text.rindex("}")):
        assert ecma.reject(text[:end], False, False) is not None, text[:end]


def test_very_deep_and_very_long():
    assert syntax.reject("(" * 50_000 + ")" * 50_000, "js") in (None, "unexpected token", "unbalanced delimiter")
    assert syntax.reject("x = [" + "1, " * 200_000 + "]", "ts") is None
    assert syntax.reject("[" * 100_000 + "]" * 100_000, "json") is None
    assert syntax.reject("[" * 100_000, "json") == "unbalanced delimiter"


DEEP = {
    "else-ifs": "if (a) { b() }" + " else if (a) { b() }" * 600 + "\n",
    "brackets": "f([" * 400 + "1" + "])" * 400 + ";\n",
    "callbacks": "a(() => {\n" * 400 + "})" * 400 + ";\n",
    "blocks": "if (a) {" * 600 + "}" * 600 + "\n",
}


@pytest.mark.parametrize("extension", ["js", "jsx", "ts", "tsx"])
@pytest.mark.parametrize("deep", DEEP)
def test_errors_behind_deep_nesting_are_found(deep, extension):
    text = DEEP[deep]
    assert syntax.reject(text + "const x = 1;\n", extension) is None
    for end, reason in (("x = {", "unbalanced delimiter"), ("x = 'abc", "unterminated literal"), ("let = = 1;", "unexpected token"), ("<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n", "merge conflict")):
        assert syntax.reject(text + end, extension) == reason
    assert syntax.reject(text[: len(text) * 3 // 4], extension) is not None


def test_beyond_the_deepest_stack_the_lexer_decides(monkeypatch):
    monkeypatch.setattr(ecma, "DEEPEST", 0)
    deep = DEEP["brackets"]
    for extension in ("js", "jsx", "ts", "tsx"):
        assert syntax.reject(deep + "x = a / 2 + `a ${`b ${c} }`} {` + f(/[/)}]/) / 3; // (\n", extension) is None
        for end, reason in (("x = {", "unbalanced delimiter"), ("f(]", "unbalanced delimiter"), ("x = `${a", "unbalanced delimiter"), ("x = `a", "unterminated literal"), ("<<<<<<< HEAD\na\n", "merge conflict")):
            assert syntax.reject(deep + end, extension) == reason
    assert syntax.reject(deep + "x = 'abc", "js") == "unterminated literal"


def test_the_lexer_accepts_what_the_grammar_accepts():
    for extension in ("js", "ts"):
        assert [t for t in VALID[extension] if ecma.lex(t, False)] == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1 (){}[]'\"\\`#/*:;,.=<>\n$", max_size=40))
def test_any_text_ends(text):
    for extension in syntax.LANGUAGES:
        syntax.reject(text, extension)
    try:
        ast.parse(text)
    except (SyntaxError, ValueError):
        assert syntax.reject(text, "py") is not None
    else:
        assert syntax.reject(text, "py") is None


def test_table(spark):
    rows = [(1, "r/a.py", "x = (", "z"), (1, "r/a.py", "x = (", "z"), (2, "r/b.ts", "let a: string", "z"), (3, "r/c.json", "", "z"), (4, "r/d.js", None, "z"), (5, None, "x", "z"), (6, "r/e.md", "(", "z"), (7, "r/f.js", "let a: string", None)]
    files = spark.createDataFrame(rows, "id bigint, file_path string, file_content string, reason string")
    assert {(r.file_id, r.reason) for r in syntax.broken_files(files).collect()} == {(1, "unbalanced delimiter"), (7, "type in JavaScript")}
    rates = {r.language: (r.n_files, r.n_broken, r.rate, r.main_reason) for r in syntax.rates(syntax.check_files(files)).collect()}
    assert rates == {"python": (1, 1, 1.0, "unbalanced delimiter"), "typescript": (1, 0, 0.0, None), "javascript": (1, 1, 1.0, "type in JavaScript")}
    assert syntax.broken_files(files.limit(0)).count() == 0


def _parses(text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError):
        return False
    return True


def _loads(text):
    def constant(name):
        raise ValueError(name)

    try:
        json.loads(text, parse_int=str, parse_float=str, parse_constant=constant)
    except ValueError:
        return False
    return True


PYTHON = """
@cached(size=3)
async def walk(tree: dict[str, int], /, *rest: T, depth: int = 0, **more) -> "Tree | None":
    r'''Text.'''
    with open(tree) as f, (lock):
        for i, (a, *b) in enumerate(x for x in f if x and not x[1:-1, ...]):
            try:
                yield from {**a, 'k': [lambda q, *r: q or r], f"{i!r:>{depth}} {a['x']}": await b}
            except (KeyError, OSError) as e:
                raise Error(f'{e}', *rest, key=1) from e
            else:
                del a.b, c[0]
            finally:
                x: int = 1 if a is not b else -c ** 2; y = z = (n := 3), {1, 2}
    while depth < 3 <= 4: depth += 1
    else:
        return not a in b
class A[T](Base, metaclass=M):
    from .x import (y as z, w)
    import a.b as c, d
    assert isinstance(a, B), 'no' 'text'
    global g
"""
PIECES = ["(", ")", "[", "]", "{", "}", ":", ",", ".", "=", "==", "*", "**", "-", "@", ";", " if ", " else ", " for ", " in ", " not ", " is ", "lambda ", " as ", "def ", "class ", "return ", "'", '"', "f'{", "}'", "\n", "\n    ", "\\", "1", "x", "None", "...", ":=", "->", "import ", "await ", "yield "]


@settings(max_examples=1500, deadline=None)
@given(st.data())
def test_python_that_passes_is_valid(data):
    at = data.draw(st.integers(0, len(PYTHON)))
    until = data.draw(st.integers(at, min(len(PYTHON), at + 12)))
    text = PYTHON[:at] + data.draw(st.sampled_from(["", *PIECES])) + PYTHON[until:]
    assert pyauto.suspect(text) is not None or _parses(text)


def test_python_that_is_plain_passes():
    assert pyauto.suspect(PYTHON) is None and _parses(PYTHON)


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(["{", "}", "[", "]", ",", ":", '"a"', '"\\n"', '"', "\\", "1", "-0.5e3", "01", "true", "null", "NaN", " ", "\n", "\x0b", "ü", "'x'", "1" * 5000]), max_size=12))
def test_json_is_decided_by_the_automaton(pieces):
    text = "".join(pieces)
    assert (pyauto.reject_json(text) is None) == _loads(text)
