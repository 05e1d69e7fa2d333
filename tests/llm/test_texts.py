from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.llm import docs, mixing, origin, quality, tokens

DATA = "/root/testdata/sf0.1"
VOCABULARY = f"{tokens.DEFAULT_FOLDER}/{tokens.DEFAULT_FILE}"

# -- functions and their documentation ------------------------------------------------------------------------------------
LONG = "Returns the proper river for a header."
PAIRS = [
    (LONG, None, "f", LONG),
    (f"/**\n * {LONG}\n * @param x the river\n * @returns it all in full\n */", None, "f", LONG),
    (f"TODO: more of this here now\n{LONG}", None, "f", LONG),
    ("  \n", f'@a(b="(")\ndef f(self, x: dict[str, int] = {{}}) -> str | None:\n    # note\n    """{LONG}\n\n    :param x: a thing of use to us\n    """\n    return x', "f", LONG),
    (None, f"/** {LONG} */\n@dec()\nexport async function f(a: {{b: string}}) {{ return 1; }}", "f", LONG),
    (None, f"// {LONG}\nconst f = (a) => {{}}", "f", LONG),
    (None, f"function f() {{\n  // {LONG}\n}}", "f", None),
    (None, f"def f():\n    x = 1\n    '''{LONG}'''", "f", None),
    (None, "def f():\n    return 1", "f", None),
    ("TODO write a description of this", None, "f", None),
    ("XXX write a description of this", None, "f", None),
    ("Copyright (c) 2015 Example Systems. All rights reserved.", None, "f", None),
    ("Resolve the drawer spectrum view.", None, "resolveDrawerSpectrumView", None),
    ("resolve_drawer_spectrum", None, "resolve_drawer_spectrum", None),
    ("-----------------------", None, "f", None),
    ("eslint-disable-next-line no-console and more words", None, "f", None),
    ("@param {string} a - the scope that is used for the tracker", None, "f", None),
    ("const branch = extract(model.feature, 1);", None, "f", None),
    ("Main function.", None, "f", None),
    ("", "", "f", None),
    (None, None, None, None),
    (LONG * 3000, None, None, LONG * 3000),
]


@pytest.mark.parametrize(("doc", "code", "name", "wanted"), PAIRS)
def test_pairs(doc, code, name, wanted):
    assert docs.pair(doc, code, name, 4) == wanted


ISLANDS = [
    ("/** D */\n@dec({a: 1})\nexport async function f<T>(a: {b: string} = {b: '}'}, c?: number): Promise<Array<T>> {\n  return `${a}}`;\n}\n", "export async function f<T>(a: {b: string} = {b: '}'}, c?: number): Promise<Array<T>>", "{\n  return `${a}}`;\n}"),
    ("const f = (a, {b}) => {\n  // }\n  return a;\n};", "const f = (a, {b})", "{\n  // }\n  return a;\n}"),
    ("static get = async a => a + 1", "static get = async a", "a + 1"),
    ("get x() { return { y: 1 } }", "get x()", "{ return { y: 1 } }"),
    ("run_it() {\n  echo '}'\n}", "run_it()", "{\n  echo '}'\n}"),
    ("func (s *Store) Get(id int) (*Row, error) {\n\treturn nil, nil\n}", "func (s *Store) Get(id int) (*Row, error)", "{\n\treturn nil, nil\n}"),
    ("CREATE FUNCTION f(a int) RETURNS int AS $$ SELECT 1 $$ LANGUAGE sql;", "CREATE FUNCTION f(a int) RETURNS int AS", "$$ SELECT 1 $$ LANGUAGE sql;"),
    ("abstract m(x: { y: number }): void;", "abstract m(x: { y: number }): void", ";"),
    ("@a(b=')')\nasync def f[T](self, x: dict[str, int] = {}) -> 'a: b':\n    '''D'''\n    return x\n", "async def f[T](self, x: dict[str, int] = {}) -> 'a: b'", "    return x\n"),
    ("x", "", ""), ("", "", ""), ("f(" + "(" * 500, "f(" + "(" * 500, ""),
]


@pytest.mark.parametrize(("source", "signature", "body"), ISLANDS)
def test_islands(source, signature, body):
    found = docs.island(source)
    assert (found.signature, found.body) == (signature, body)


def test_pairs_table(spark):
    rows = [(1, "f", "function", LONG, None, "x"), (1, "f", "function", LONG, None, "x"), (2, "C", "class", LONG, None, "x"), (3, None, "method", None, None, "x"), (4, "g", None, LONG, None, "x"), (5, "h", "method", " \n", f"/** {LONG} */\nh() {{}}", "x")]
    d = spark.createDataFrame(rows, "id bigint, name string, definition_type string, docstring string, source_code string, description string")
    assert {(r.definition_id, r.description) for r in docs.code_pairs(d, with_code=False).collect()} == {(1, LONG), (5, LONG)}
    assert {r.source_code for r in docs.code_pairs(d).filter("definition_id = 5").collect()} == {f"/** {LONG} */\nh() {{}}"}
    assert docs.code_pairs(d.limit(0)).count() == 0


# -- origin of files ------------------------------------------------------------------------------------------------------
HAND = "import { a } from 'b';\n\nexport function f(x) {\n  if (!x) {\n    return a(x);\n  }\n  return x.map((y) => y + 1);\n}\n" * 8
BLOB = "QmFzZTY0" * 400
ORIGINS = [
    ("r/src/a.ts", "// Code generated by tool v1. DO NOT EDIT.\n" + HAND, "generated"),
    ("r/src/a.ts", "/* @generated by x from y.schema */\n" + HAND, "generated"),
    ("r/src/a.py", '"""Autogenerated client. Source: a.yaml"""\n', "generated"),
    ("r/src/a.pb.ts", HAND, "generated"),
    ("r/generated/a.ts", HAND, "generated"),
    ("r/src/a.ts", "// ids are generated by the server; do not edit the order below\n" + HAND, None),
    ("r/src/a.ts", "// see the generator of the fence for the other half\n" + HAND, None),
    ("r/src/a.ts", HAND + "// Code generated by tool v1. DO NOT EDIT.\n", None),
    ("r/src/a.ts", "// SPDX-License-Identifier: LicenseRef-Internal\n" + HAND, None),
    ("r/src/a.ts", "// SPDX-License-Identifier: BSD-3-Clause\n" + HAND, "vendored"),
    ("r/src/a.ts", "// Copyright (c) 2020 Own Systems. Internal use.\n" + HAND, None),
    ("r/src/a.js", "/*! lib v1.2 | Copyright the lib contributors | Released under the MIT license */\n" + HAND, "vendored"),
    ("r/node_modules/x/a.js", HAND, "vendored"),
    ("r/vendor/x/a.js", HAND, "vendored"),
    ("r/src/vendor/a.js", HAND, None),
    ("r/src/vendors/a.js", HAND, None),
    ("r/src/codegen/a.js", HAND, None),
    ("r/package-lock.json", "{}", "lock"),
    ("r/x/deps.json", "{\n" + ",\n".join(f'  "a{i}": {{ "version": "1.{i}", "integrity": "sha512-x" }}' for i in range(9)) + "\n}", "lock"),
    ("r/config/a.json", '{\n  "aIntegrity": "sha512-x",\n  "version": "1"\n}', None),
    ("r/src/a.js", "!function(e,t){" + "e.x=function(n){return n?t(n,9):null};" * 60 + "}", "minified"),
    ("r/src/a.js", f"const blob = '{BLOB}';\n" + HAND, None),
    ("r/src/a.js", f"export default 'data:font/bin;base64,{BLOB}';\n", "data"),
    ("r/src/a.py", "TABLE = [\n" + "    1.5, 2.25, 3.125,\n" * 60 + "]\n", "data"),
    ("r/src/a.py", "TABLE = [\n" + "    1.5, 2.25, 3.125,\n" * 14 + "]\n", "data"),
    ("r/src/a.js", "export default 'data:font/bin;base64,AA+//BB/\\*CC" + "//" * 40 + BLOB + "';\n", "data"),
    ("r/src/a.ts", '{\n  "a0": false,\n' + '  "b": "sha512-' + BLOB + '",\n' * 3 + '  "c": 1\n}', None),
    ("r/src/a.py", "# " + "a comment alone\n# " * 60, None),
    ("r/src/a.py", '"""' + "The text that opens a module. " * 40 + '"""\n', None),
    ("r/src/a.py", " \n", None),
    ("r/src/a.py", '"""' + "The text that opens a module. " * 20 + '"""\n\nPAYLOAD = {\n    "guide": 795,\n    "billing": 284,\n    "buffer": 12,\n}\n', None),
    ("r/src/a.py", '"""Text."""\nBLOB = "' + BLOB[:600] + '"\n', "data"),
    ("r/a.md", "| 1 | 2 |\n" * 100, None),
    ("r/src/a.py", "", None),
    (None, HAND, None),
]


@pytest.fixture(scope="module")
def automaton():
    return origin._automaton()


@pytest.mark.parametrize(("path", "text", "kind"), ORIGINS)
def test_origin(automaton, path, text, kind):
    assert origin.kind_of(text, path, automaton) == kind


def test_origin_table(spark):
    rows = [(1, "r/dist/a.js", HAND, "x"), (1, "r/dist/a.js", HAND, "x"), (2, "r/src/a.js", HAND, "x"), (3, "r/dist/b.js", None, "x"), (4, None, "", "x")]
    files = spark.createDataFrame(rows, "id bigint, file_path string, file_content string, kind string")
    assert [(r.file_id, r.kind) for r in origin.foreign_files(files).collect()] == [(1, "generated")]
    assert {(r.repo_slug, r.kind, r.n_files) for r in origin.origin_rates(origin.origins(files)).collect()} == {("r", "generated", 1), ("r", "hand-written", 1), (None, "hand-written", 1)}
    assert origin.foreign_files(files.limit(0)).count() == 0


# -- quality --------------------------------------------------------------------------------------------------------------
PROSE = "The part of the code that reads the table is slow, and it does not keep what is in the list. "


def typed(spark, texts, words=("the", "of", "and", "that", "is", "it", "in", "not", "what", "a")):
    documents = spark.createDataFrame(list(texts), "doc_id bigint, text string, word string")
    return {r.doc_id: r for r in quality.text_types(documents, spark.createDataFrame([(w, "en") for w in words], "word string, lang string")).collect()}


def test_types(spark):
    rows = [(i, PROSE + f"What is in part {i} of the list is not in the table, and that is it.", "x") for i in range(60)]
    rows += [(100, "- one item\n- two item\n- three item\n" * 4, "x"), (101, "| a | b | c |\n|---|---|---|\n" + "| 1 | 2 | x |\n" * 9, "x"), (102, "def f(x):\n    return x.y(1)\n" * 8, "x"), (103, "Zm9vYmFyYmF6Zm9vYmFyYmF6Zm9vYmFyYmF6Zm9v\n" * 9, "x"), (104, PROSE * 12, "x")]
    rows += [(105, "of the is in a the that it not and the in of is a and what the of that in is the a of and it the", "x"), (106, None, "x"), (107, "", "x"), (108, "???", "x"), rows[0], (109, PROSE.lower().replace(".", "").replace(",", "\r\n") * 2 + "and that is what it is in the end of the part", "x")]
    got = typed(spark, rows)
    assert {i: got[i].text_type for i in range(60)} == dict.fromkeys(range(60), "prose")
    assert [got[i].text_type for i in (100, 101, 102)] == ["list", "table", "code"]
    assert {got[i].text_type for i in (103, 104, 105, 108)} == {"junk"} and got[109].text_type == "prose"
    assert got[106].text_type is None and got[107].text_type is None and got[106].word_count == 0
    assert got[100].word_count == 24 and len(got) == len({r[0] for r in rows})


def test_the_model_learns_from_agreement_alone():
    patterns = {0b0000111: 600, 0b0000011: 60, 0b0000001: 5, 0b0001000: 90, 0b0001010: 10, 0b0010000: 60, 0b0100000: 50, 0b1000000: 40, 0b1000100: 5, 0: 3}
    model = quality.learn(patterns)
    rows = {name: (fires, accuracy, coverage) for name, _, fires, accuracy, coverage in model.accuracies()}
    assert rows["sentences"][1] > 0.95 and rows["stops"][2] < rows["sentences"][2] and all(0 < v < 1 for r in rows.values() for v in r)
    assert model.posterior(0b0000111)[0] > 0.99 and max(range(5), key=model.posterior(0b0001010).__getitem__) == quality.TYPES.index("list")
    assert abs(sum(model.priors) - 1) < 1e-9 and quality.learn({}).posterior(0)


def test_types_of_an_empty_table(spark):
    assert typed(spark, []) == {}


def test_statistics():
    s = quality.Meter(frozenset(["one"]))("One two, three.\nfour")
    assert s[0] == 4 and s[1] == 3.75 and s[2] == pytest.approx(2 / 17) and s[3] == 0.5 and s[4] == 0.25


@pytest.mark.skipif(not os.path.exists(DATA), reason="no labelled sample here")
def test_held_out_labels(spark):
    found = {r.doc_id: r.text_type for r in quality.text_types(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{DATA}/common_words.parquet")).collect()}
    labels = duckdb.sql(f"SELECT DISTINCT doc_id, label FROM '{DATA}/quality_labels.parquet'").fetchall()
    pairs = [(label == "prose", found[i] == "prose") for i, label in labels if found.get(i)]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.97


# -- mixing ---------------------------------------------------------------------------------------------------------------
def test_budgets(spark):
    def plan(available, targets, total=None):
        have = spark.createDataFrame(list(available.items()), "source string, available_tokens bigint")
        wanted = spark.createDataFrame([(s, *x) for s, x in targets.items()], "source string, target_share double, max_repeats int")
        return {r.source: (round(r.budget, 6), r.epochs, round(r.rest, 6), r.binding) for r in mixing.budgets(have, wanted, total).collect()}

    assert plan({"a": 100, "b": 10}, {"a": (1.0, 1), "b": (1.0, 3), "c": (2.0, 9)}) == {"a": (30.0, 0, 30.0, False), "b": (30.0, 3, 0.0, True)}
    assert plan({}, {"a": (1.0, 1)}) == {}
    assert plan({"a": 100}, {"a": (0.5, 2)}, total=50) == {"a": (50.0, 0, 50.0, False)}


def test_no_range_of_keys_is_large_whatever_the_weight(spark):
    for weight in (0.1, 1.0):
        rows = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit(weight).alias("weight"))
        assert mixing.keyed(rows, 20).groupBy("range").count().agg(F.max("count")).first()[0] < 0.001 * 200_000


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="the vocabulary file is not here")
def test_mix(spark):
    rows = [(i, f"{PROSE} number {i} of the list", " Big " if i % 2 else "BIG") for i in range(400)] + [(1000 + i, f"{PROSE} small {i}", "small") for i in range(20)]
    rows += [(2000, None, "big"), (2001, "", "small"), (2002, "x", None), rows[0], (2003, PROSE, "other")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.7, 1, 0), ("Small", 0.3, 4, 0), ("absent", 0.5, 2, 0), ("big", 0.7, 1, 0), (None, 0.2, None, 0)], "source string, target_share double, max_repeats int, n_tokens int")
    mix = mixing.Mix(documents, targets, spark.createDataFrame([("the",), ("of",)], "word string"), VOCABULARY)
    shares = {r.source: r for r in mix.shares().collect()}
    assert shares["big"].actual_share == pytest.approx(0.7, abs=0.02) and shares["small"].most_times <= 4 and shares["small"].used_tokens == 4 * shares["small"].available_tokens
    assert shares["absent"].used_tokens == 0 and shares["other"].target_share is None
    chosen = mix.chosen().collect()
    assert len({r.doc_id for r in chosen}) == len(chosen) and not {2000, 2001, 2002, 2003} & {r.doc_id for r in chosen}
    empty = mixing.Mix(documents.limit(0), targets, spark.createDataFrame([("the",)], "word string"), VOCABULARY)
    assert empty.chosen().count() == 0 and empty.shares().count() == 3


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="the vocabulary file is not here")
def test_shares_say_what_is_unused_and_which_source_binds(spark):
    documents = spark.createDataFrame([(i, f"the text of number {i} is not long", "big") for i in range(20)] + [(90, "one short text", "small"), (91, "of no target", "other")], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2), ("missing", 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.Mix(documents, targets, spark.createDataFrame([("the",), ("of",)], "word string"), VOCABULARY)
    shares = {r.source: r for r in mix.shares().collect()}
    in_mix = {r.source: r.n for r in mix.chosen().groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert {s for s, r in shares.items() if r.binding} == {"small"} and shares["small"].most_times == 2
    assert all(r.unused_tokens == r.available_tokens - in_mix.get(s, 0) for s, r in shares.items())
    assert shares["small"].unused_tokens == 0 < shares["big"].unused_tokens and shares["other"].unused_tokens == shares["other"].available_tokens
