from __future__ import annotations

import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import config as M
from quarry.operators import conversation as C
from quarry.operators import delta as D
from quarry.operators import extract as E
from quarry.operators import fold as H
from quarry.operators import graph as G
from quarry.operators import relational as R
from quarry.operators import resolve as V
from quarry.operators import search as S
from quarry.operators.text_index import TextIndex
from quarry.plans import config_queries
from quarry.sources import repository as T
from quarry.sources import scip
from quarry.sources import sinks as K
from quarry.streaming import jobs as J


def one(spark, expression, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'bigint' if isinstance(values[n], int) else 'array<double>' if isinstance(values[n], list) else 'string'}" for n in names))
    return row.select(expression).first()[0]


# -- text -----------------------------------------------------------------------------------------------------------------
GISTS = [
    ("<gist>Short summary</gist>Full summary", "Short summary", "Full summary"), ("<gist></gist>Full summary content", "", "Full summary content"), ("<gist>\nLine 1 of gist\nLine 2 of gist\n</gist>\nFull summary starts here", "\nLine 1 of gist\nLine 2 of gist\n", "\nFull summary starts here"),
    ("<gist>Only gist content</gist>", "Only gist content", ""), ("  <gist>  a  </gist>  b  ", "  a  ", "  b  "), ("no tags", None, None), ("<gist>open", None, None), ("", None, None), (None, None, None),
]


@pytest.mark.parametrize(("text", "short", "full"), GISTS)
def test_gist(spark, text, short, full):
    assert one(spark, X.gist_short(F.col("t")), t=text) == short and one(spark, X.gist_full(F.col("t")), t=text) == full


def test_strict_gist(spark):
    with pytest.raises(Exception, match="no gist"):
        one(spark, X.strict(X.gist_short(F.col("t")), F.col("t"), "no gist"), t="plain")
    assert one(spark, X.strict(X.gist_short(F.col("t")), F.col("t"), "no gist"), t=None) is None


def test_code_text(spark):
    assert one(spark, X.strip_comments(F.col("t")), t="a/** b\n c */d // e\r\nf /* g */") == "ad \nf /* g */"
    h = [one(spark, X.stable_hash(F.col("t"), F.col("n")), t=t, n=n) for t, n in (("function foo() {\n  return 1;\n}", "foo"), ("function bar()  {\n\n return 1;\n}".replace("()  {", "() {"), "bar"), ("function foo() { return 2; }", "foo"), ("x.E\\E", ".\\E"))]
    assert h[0] == h[1] != h[2]
    assert one(spark, X.token_estimate(F.col("t")), t="a b c\n d") == 5 and one(spark, X.token_estimate(F.col("t")), t=None) == 0
    assert one(spark, X.line_slice(F.col("t"), F.lit(2), F.lit(9)), t="a\nb\nc") == "b\nc" and one(spark, X.line_slice(F.col("t"), F.lit(-1), F.lit(1)), t="a\nb") == "a"
    assert one(spark, X.tokens(F.col("t")), t="snake_case/camelCase Été x1") == ["snake", "case", "camelcase", "ete", "x1"]


@pytest.mark.parametrize(
    ("symbol", "name", "container"),
    [("scip-ts npm a 1.0 src/`x.ts`/Foo#bar().", "bar", "scip-ts npm a 1.0 src/`x.ts`/Foo"), ("a `b.py`/Foo#", "Foo", "a `b.py`/Foo"), ("x/`we``ird name`.", "we`ird name", None), ("x/foo(+2).", "foo", None), ("x/value0.", "value", None), ("", None, None)],
)
def test_symbols(spark, symbol, name, container):
    assert one(spark, X.symbol_name(F.col("s")), s=symbol) == name and one(spark, X.container_symbol(F.col("s")), s=symbol) == container


def test_links_tags_and_names(spark):
    found = one(spark, X.citations(F.col("t")), t="see [a](file::1) and [b c](file::2:definition::33), not [d](http://x)")
    assert [tuple(x) for x in found] == [("a", 1, None), ("b c", 2, 33)]
    assert one(spark, X.tag_content(F.col("t"), "message"), t="<message> hi </message><message>no</message>") == "hi"
    assert one(spark, X.tag_contents(F.col("t"), "id"), t="<id>1</id><id> 2 </id>") == ["1", "2"]
    assert len(one(spark, X.preview(F.col("t")), t="<b>" + "x" * 400 + "</b>")) == 281
    assert one(spark, X.slugify(F.col("t")), t="  My Repo!! 2 ") == "my-repo-2" and one(spark, X.repository_name(F.col("t")), t="https://h/o/name.git/") == "name"
    assert [one(spark, F.col("t").rlike(X.glob_regex(p)), t=t) for p, t in (("*.py", "a/b.py"), ("a?c", "abc"), ("[!a]x", "bx"), ("[!a]x", "ax"), ("a.b", "axb"))] == [True, True, True, False, False]
    assert [one(spark, X.similarity_of(F.col("d").cast("double")), d=d) for d in (0, 1, -1, None)] == [1.0, 0.5, 0.0, 0.0]


# -- resolution -----------------------------------------------------------------------------------------------------------
def test_occurrences_to_references(spark):
    occ = spark.createDataFrame(
        [("a.ts", "f#", 1, 0, 0, 0), ("b.ts", "f#", 0, 4, 1, 0), ("b.ts", "f#", 1, 8, 1, 1), ("b.ts", "ext#", 0, 5, 1, 2), ("b.ts", "local 1", 0, 5, 1, 3), ("a.ts", "f#", 0, 1, 0, 4)],
        "file string, symbol string, role_bits int, start_line int, doc_order int, pos int",
    )
    symbols = spark.createDataFrame([("a.ts", "f#")], "file string, symbol string")
    assert [tuple(r) for r in V.symbol_definitions(occ, symbols).collect()] == [("f#", "a.ts", 0)]
    assert [tuple(r) for r in V.symbol_definitions(occ, symbols, last_document=True).collect()] == [("f#", "b.ts", 8)]
    targeted = V.occurrence_targets(occ.filter("role_bits = 0"), V.symbol_definitions(occ, symbols)).withColumn("point_id", F.col("pos")).withColumn("start_line_0", F.col("start_line"))
    assert {(r.symbol, r.is_external, r.is_outgoing) for r in targeted.collect()} == {("f#", False, True), ("ext#", True, False), ("f#", False, False)}
    ranges = spark.createDataFrame([("a.ts", 1, 1, 3), ("b.ts", 2, 1, 9), ("b.ts", 3, 5, 6)], "file string, definition_id bigint, start_line int, end_line int")
    assert {tuple(r) for r in V.references(targeted, ranges).collect()} == {(2, 1), (3, 1)}
    assert [tuple(r) for r in V.file_symbol_edges(targeted).collect()] == [("b.ts", "a.ts", "f#")]


def test_owner_and_unique_symbol(spark):
    paths = spark.createDataFrame([("r/a/b/x.ts",), ("r/ab/x.ts",), ("s/x.ts",), ("x.ts",)], "path string")
    owners = spark.createDataFrame([(1, "r"), (2, "r/a"), (3, "r/a/b"), (4, "r/a/b")], "owner_id bigint, dir string")
    assert {r.path: r.owner_id for r in V.longest_prefix(paths, owners).collect()} == {"r/a/b/x.ts": 3, "r/ab/x.ts": 1, "s/x.ts": None, "x.ts": None}
    root = spark.createDataFrame([(9, ".")], "owner_id bigint, dir string")
    assert {r.owner_id for r in V.longest_prefix(paths, root).collect()} == {9}
    defs = spark.createDataFrame([(1, "a", 1), (2, "a", 5)], "definition_id bigint, file string, start_line int")
    lines = spark.createDataFrame([("a", 0, "s"), ("a", 0, "s"), ("a", 4, "t"), ("a", 4, "u")], "file string, line int, symbol string")
    assert [tuple(r) for r in V.unique_symbol_definitions(defs, lines).collect()] == [(1, "s")]


def test_import_references(spark):
    imports = spark.createDataFrame([(1, "foo", "./b.ts", False), (1, "gone", "b.ts", None), (1, "foo", "b.ts", True)], "file_id bigint, specifier string, resolved_file_path string, is_external boolean")
    files = spark.createDataFrame([(1, "a.ts"), (2, "b.ts")], "id bigint, file_path string")
    defs = spark.createDataFrame([(10, 1, "main", "main() { foo(1) }"), (11, 1, "other", "food()"), (12, 1, None, None), (20, 2, "foo", "foo() {}")], "id bigint, file_id bigint, name string, source_code string")
    assert [tuple(r) for r in V.import_references(imports, files, defs).collect()] == [(10, 20)]


# -- deltas ---------------------------------------------------------------------------------------------------------------
def test_snapshot_fixture(spark):
    old = spark.createDataFrame([("file_a.ts", "1"), ("file_b.ts", "2"), ("file_rem.ts", "3"), ("ren_old.ts", "4"), ("n.md", "9"), ("same.ts", "5")], "path string, content_hash string")
    new = spark.createDataFrame([("file_a.ts", "1b"), ("file_b.ts", "2b"), ("file_c.ts", "6"), ("ren_new.ts", "4"), ("n.md", "8"), ("same.ts", "5")], "path string, content_hash string")
    got = {tuple(r) for r in D.file_changes(old, new).collect()}
    assert got == {("file_a.ts", "modified", None), ("file_b.ts", "modified", None), ("file_c.ts", "added", None), ("file_rem.ts", "deleted", None), ("ren_new.ts", "renamed", "ren_old.ts")}
    assert D.file_changes(old, old).count() == 0 and D.file_changes(old.limit(0), new, None).filter("change <> 'added'").count() == 0


def test_definition_delta(spark):
    cols = "file string, code_hash string, position int"
    old, new = spark.createDataFrame([("a", "x", 1), ("a", "x", 5), ("a", "y", 9)], cols), spark.createDataFrame([("a", "x", 2), ("a", "z", 9)], cols)
    assert sorted((r.code_hash, r.occurrence, r.change) for r in D.definition_changes(old, new).collect()) == [("x", 1, "unchanged"), ("x", 2, "removed"), ("y", 1, "removed"), ("z", 1, "added")]
    assert sorted((r.code_hash, r.change) for r in D.definition_changes(old, new, collapse=True).collect()) == [("x", "unchanged"), ("y", "removed"), ("z", "added")]


def test_modes():
    assert [D.parse_mode(*x) for x in (("a", "a"), ("a", "b"), (None, "b"), ("a", None))] == ["none", "incremental", "full", "full"]
    assert [D.summary_mode(*x) for x in ((None, False), (True, False), (False, False), (False, True))] == ["full", "none", "incremental", "full"]


def test_upsert_is_idempotent(spark):
    table = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0"), (None, "n", "t0")], "id bigint, v string, created string")
    rows = spark.createDataFrame([(2, None, "t1"), (3, "c", "t1"), (3, "c", "t1"), (None, "m", "t1")], "id bigint, v string, created string")
    once = D.upsert(table, rows, ["id"], ["created"])
    want = {(1, "a", "t0"), (2, None, "t0"), (3, "c", "t1"), (None, "m", "t0")}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in D.upsert(once, rows, ["id"], ["created"]).collect()}
    assert {tuple(r) for r in D.insert_ignore(table, rows.filter("id IS NOT NULL"), ["id"]).collect()} == {(1, "a", "t0"), (2, "b", "t0"), (None, "n", "t0"), (3, "c", "t1")}


def test_cascade_and_rename(spark):
    files = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, file_path string")
    defs = spark.createDataFrame([(10, 1), (20, 2), (30, None)], "id bigint, file_id bigint")
    refs = spark.createDataFrame([(10, 20), (20, 10), (30, 20), (30, None)], "source_definition_id bigint, target_definition_id bigint")
    f, d, r = D.delete_files(files, defs, refs, spark.createDataFrame([("b",)], "path string"))
    assert [x.id for x in f.collect()] == [1] and {x.id for x in d.collect()} == {10, 30}
    assert sorted(map(str, (tuple(x) for x in r.collect()))) == ["(10, None)", "(30, None)", "(30, None)"]
    assert {x.file_path for x in D.rename_files(files, spark.createDataFrame([("a", "z"), (None, "q")], "old_path string, path string")).collect()} == {"z", "b"}


def test_schedule_fixture(spark):
    edges, changed = spark.createDataFrame([(1, 2)], "src bigint, dst bigint"), spark.createDataFrame([(2,)], "node bigint")
    plan = D.schedule(changed, G.reverse_closure(edges, changed), G.levels(spark.createDataFrame([(1,), (2,), (3,)], "node bigint"), edges))
    assert {tuple(r) for r in plan.collect()} == {(2, "changed", 0), (1, "ancestor", 1)}


# -- search ---------------------------------------------------------------------------------------------------------------
def test_full_text(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "Quick QUICK fox"), (3, None), (4, ""), (5, "slow fox")], "id bigint, text string")
    ranked = [r.id for r in S.top(S.bm25(docs, "quick fox"), 9, "rank", "id").collect()]
    assert ranked == [2, 1] and all(r.rank <= 0 for r in S.bm25(docs, "quick").collect())
    assert {r.id for r in S.bm25(docs, "fox sl", prefix=True).collect()} == {5} and {r.id for r in S.bm25(docs, "slow quick", match_all=False).collect()} == {1, 2, 5}
    assert S.bm25(docs, "??").count() == 0 and S.bm25(docs.limit(0), "fox").count() == 0
    assert {r.id for r in S.matching(docs, '"quick brown" fo*').collect()} == {1}


QUERIES = [
    ("quick OR slow", {1, 2, 5}), ("fox NOT quick", {5}), ("fox AND NOT_THERE", set()), ("(quick OR slow) NOT brown", {2, 5}), ("NEAR(the brown, 1)", {1}), ("NEAR(the fox, 1)", set()), ("NEAR(fox the)", {1}), ("^quick", {2}), ("quick + brown", {1}), ('"slow fox"', {5}),
    ("brown OR slow quick", {1}), ("brown OR slow fox", {1, 5}), ('"" OR slow', {5}), ("near", set()),
]


@pytest.mark.parametrize(("text", "ids"), QUERIES)
def test_query_grammar(spark, text, ids):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "Quick QUICK fox"), (3, None), (4, ""), (5, "slow fox")], "id bigint, text string")
    assert {r.id for r in S.matching(docs, text).collect()} == ids


@pytest.mark.parametrize("text", ["", "a AND", "OR a", "(a", "a)", '"a', "a-b", "NEAR(a, b)", "*", "a ? b"])
def test_broken_queries(text):
    with pytest.raises(S.QueryError):
        S.parse_query(text)


def test_index_is_kept_up_to_date(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index")
    assert index.bm25("fox").count() == 0
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "Quick QUICK fox"), (3, None), (4, ""), (5, "slow fox"), (5, "slow fox"), (None, "fox")], "id bigint, text string")
    index.upsert(docs)
    index.upsert(spark.createDataFrame([(1, "no more"), (6, "fox fox")], "id bigint, text string"))
    index.delete(spark.createDataFrame([(2,), (99,)], "id bigint"))
    now = spark.createDataFrame([(1, "no more"), (3, None), (4, ""), (5, "slow fox"), (6, "fox fox")], "id bigint, text string")
    for _ in range(2):
        for query, prefix in (("fox", False), ("fox sl", True), ("s", True), ("quick", False)):
            want = {r.id: round(r["rank"], 9) for r in S.bm25(now, query, prefix=prefix).collect()}
            assert {r.id: round(r["rank"], 9) for r in index.bm25(query, prefix=prefix).collect()} == want
        index.compact()
    assert len(index._segments()) == 1


def test_vectors(spark):
    v = spark.createDataFrame([("file", 1, [1.0, 0.0]), ("definition", 2, [0.0, 1.0]), ("file", 3, [1.0, 0.0]), ("file", 4, None)], "entity_type string, entity_id bigint, embedding array<float>")
    assert [r.entity_id for r in S.nearest(v, [1.0, 0.1], 2).collect()] == [1, 3]
    assert [r.entity_id for r in S.nearest(v, [1.0, 0.1], 2, "definition").collect()] == [] and [r.entity_id for r in S.nearest(v, [1.0, 0.1], 2, "definition", post_filter=False).collect()] == [2]
    queries = spark.createDataFrame([(7, [0.0, 1.0], 1), (8, [1.0, 0.0], None), (9, None, 3)], "query_id bigint, vector array<double>, k int")
    assert {(r.query_id, r.entity_id, r.position) for r in S.nearest_batch(v, queries, 2).collect()} == {(7, 2, 1), (8, 1, 1), (8, 3, 2)}
    assert S.nearest_batch(v.limit(0), queries).count() == 0


def test_nearest_of_any_number_of_queries(spark, monkeypatch):
    v = spark.createDataFrame([("file", i, [float(i), 0.0]) for i in range(6)], "entity_type string, entity_id bigint, embedding array<float>")
    many = spark.range(10_050).select(F.col("id").alias("query_id"), F.array(F.col("id") % 6 + 0.25, F.lit(0.0)).alias("vector"), F.lit(1).alias("k"))
    found = S.nearest_batch(v, many).collect()
    assert len(found) == 10_050 and all(r.entity_id == r.query_id % 6 and r.distance == 0.25 and r.position == 1 for r in found)

    rows = [(q, [q * 0.7, 0.1], k) for q in range(8) for k in ([3] if q % 3 else [2, 2])] + [(99, None, 1)]
    queries = spark.createDataFrame(rows, "query_id bigint, vector array<double>, k int")
    whole = sorted(S.nearest_batch(v, queries, 2).collect())
    for block, numbers in ((3, 100), (100, 2), (100, 8)):
        monkeypatch.setattr(S, "BLOCK", block)
        monkeypatch.setattr(S, "BLOCK_NUMBERS", numbers)
        assert [len(b) for b in S._blocks([(1, [0.0, 1.0], 2)] * 5)] == {3: [3, 2], 2: [1] * 5, 8: [4, 1]}[block if block < 9 else numbers]
        assert sorted(S.nearest_batch(v, queries, 2).collect()) == whole
    expected = []
    for q in range(8):
        near = sorted((float(((i - q * 0.7) ** 2 + 0.1**2) ** 0.5), i) for i in range(6) for _ in range(1 if q % 3 else 2))[: 3 if q % 3 else 2]
        expected += [(q, i, round(d, 9), n) for n, (d, i) in enumerate(near, 1)]
    assert [(r.query_id, r.entity_id, round(r.distance, 9), r.position) for r in sorted(whole, key=lambda r: (r.query_id, r.position))] == expected


def test_hybrid_and_shape(spark):
    a = spark.createDataFrame([("file", 1, 0.5), ("file", 2, 0.1)], "entity_type string, entity_id bigint, distance double")
    b = spark.createDataFrame([("file", 1, -3.0), ("definition", 9, -1.0)], "entity_type string, entity_id bigint, distance double")
    assert [(r.entity_id, r.distance) for r in S.hybrid([a, b], 2).collect()] == [(1, -3.0), (9, -1.0)]
    assert S.hybrid_rrf([a, b], 1).first().entity_id == 1
    assert S.dispatch("hybrid", False) == ("definitions", "files") and S.dispatch("semantic", True) == ("vector",)
    for bad in (lambda: S.dispatch("semantic", False), lambda: S.dispatch("x", True), lambda: S.check_request(top_k=0), lambda: S.check_request(limit=51), lambda: S.check_request(offset=-1), lambda: S.check_request(query=""), lambda: S.check_request(searches=6)):
        with pytest.raises(ValueError):
            bad()
    S.check_request()
    assert tuple(S.result_statistics(a.limit(0)).first()) == (0, 0.0, 0.0)


# -- packages and configurations ------------------------------------------------------------------------------------------
def package(name, deps=(), **more):
    return json.dumps({"name": name, "dependencies": dict.fromkeys(deps, "*"), **more})


def test_monorepos(spark):
    rows = [("p", "package.json", package("root", workspaces=["packages/*"])), ("p", "packages/ui/package.json", package("@w/ui")), ("p", "packages/utils/package.json", package("@w/utils", ["@w/ui", "react"], main="lib.js")), ("p", "pnpm-workspace.yaml", ""), ("p", "packages/ui/src/index.ts", "")]
    rows += [("d", "package.json", package("d")), ("d", "core/package.json", package("core", exports={".": {"import": "./c.mjs"}})), ("d", "api/package.json", package("api", exports="./x.js")), ("y", "package.json", package("y", workspaces={"packages": ["a"]})), ("y", "yarn.lock", ""), ("y", "node_modules/z/package.json", package("z")), ("b", "package.json", "{broken")]
    files = spark.createDataFrame(rows, "root string, path string, content string")
    parts = [M.parse_packages(files.filter(F.col("root") == r)).withColumn("root", F.lit(r)) for r in ("p", "d", "y", "b")]
    packages = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).filter("name IS NOT NULL")
    assert {(r.root, r.type) for r in M.workspace_type(files, packages).collect()} == {("p", "pnpm"), ("d", "none"), ("y", "yarn"), ("b", "none")}
    assert {(r.root, r["class"]) for r in M.monorepo_class(packages).collect()} == {("p", "package_based_monorepo"), ("d", "direct_import_monorepo"), ("y", "single_package")}
    assert [tuple(r) for r in M.internal_dependencies(packages).collect()] == [("p", "@w/utils", "@w/ui")]
    entries = {r.path: r.entry_point for r in M.entry_points(packages.filter("root = 'p'"), files.filter("root = 'p'")).collect()}
    assert entries["packages/ui/package.json"] == "src/index.ts" and entries["packages/utils/package.json"] == "lib.js"
    entries = {r.path: r.entry_point for r in M.entry_points(packages.filter("root = 'd'"), files.filter("root = 'd'")).collect()}
    assert entries["core/package.json"] == "./c.mjs" and entries["api/package.json"] == "./x.js"


def test_tsconfigs(spark):
    rows = [
        ("tsconfig.json", '{ // root\n "extends": "./base", "references": [{"path": "./a"}], }'),
        ("base.json", "{}"),
        ("tsconfig.base.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"@x/*": ["x/*"]}}} /* end "quoted // no" */'),
        ("a/tsconfig.json", '{"extends": "../tsconfig.base", "compilerOptions": {"baseUrl": "src", "paths": {"@y/*": ["y/*"], "//z": ["http://q"]}}}'),
        ("b/tsconfig.json", '{"extends": "@tsconfig/node"}'), ("c/tsconfig.json", '{"extends": "./tsconfig.json"}'),
    ]
    configs = M.parse_tsconfigs(spark.createDataFrame(rows, "path string, content string"))
    options = {r.path: (r.base_url, r.paths) for r in M.extended_options(configs).collect()}
    assert options["a/tsconfig.json"] == ("src", {"@y/*": ["y/*"], "//z": ["http://q"]}) and options["b/tsconfig.json"] == (None, None) and options["c/tsconfig.json"] == (None, None)
    mapped = {(r.path, r.alias): r.target for r in M.path_mappings(configs, M.extended_options(configs)).collect()}
    assert mapped["tsconfig.json", "@y/*"] == mapped["a/tsconfig.json", "@y/*"] == "a/src/y/*"
    near = M.nearest_config(spark.createDataFrame([("a/b/x.ts",), ("z/x.ts",)], "path string"), configs.filter("path IN ('tsconfig.json', 'a/tsconfig.json')"))
    assert {tuple(r) for r in near.collect()} == {("a/b/x.ts", "a/tsconfig.json"), ("z/x.ts", "tsconfig.json")}


# -- extraction -----------------------------------------------------------------------------------------------------------
def test_python_definitions():
    text = 'LIMIT = 3\n\n@dec\nclass A(B):\n    """Doc."""\n    x = 1\n\n    async def m(self):\n        y = lambda: 2\n        return y\n\nf = lambda a: a\n\ndef g():\n    """G doc."""\n'
    got = [(s, e, n, k, d) for s, e, n, k, d, _ in E.definitions_of(text, "py")]
    assert got == [(1, 1, "LIMIT", "constant", None), (3, 10, "A", "class", "Doc."), (8, 10, "m", "method", None), (9, 9, "y", "function", None), (12, 12, "f", "function", None), (14, 15, "g", "function", "G doc.")]
    assert E.definitions_of("def (", "py") == E.definitions_of(None, "py") == E.definitions_of("", "ts") == []


def test_script_definitions():
    text = "import x from 'y';\nexport const MAX = 1;\nexport interface I {\n  a: string;\n}\nexport type T = 'a' | 'b';\nenum E { A, B }\n\n/** Doc of f. */\nexport async function f(a: string): Promise<void> {\n  if (a) { return; }\n  const inner = '}';\n}\n\nexport class C extends D {\n  private m(x: number): string {\n    return `${x} {`;\n  }\n}\nexport const g = (a) => {\n  return a;\n};\nlet v = {\n  a: 1,\n};\n"
    got = [(s, e, n, k) for s, e, n, k, _, _ in E.definitions_of(text, "ts")]
    assert got == [(2, 2, "MAX", "constant"), (3, 5, "I", "interface"), (6, 6, "T", "type_alias"), (7, 7, "E", "enum"), (10, 13, "f", "function"), (15, 19, "C", "class"), (16, 18, "m", "method"), (20, 22, "g", "function"), (23, 25, "v", "variable")]
    assert [d for _, _, n, _, d, _ in E.definitions_of(text, "ts") if n == "f"] == ["/** Doc of f. */"]


SCRIPT = """
@Component({a: '{'}) export class A<T extends { x: number }> extends B {
  @Input() readonly name?: string = "x";
  static handler = async (e: Event): Promise<void> => {
    if (e) { call(e); }
  };
  constructor(
    private a: Map<string, () => void>,
    b = { c: 1 },
  ) { super(); }
  @dec(1) async *items<U>(
    x: U,
  ): AsyncGenerator<{ y: U }> {
    for (const i of x) { yield i; }
  }
  abstract size(): { n: number };
  get #p() { return `${'}'}`; }
}
interface I { m(a: string): void; f: (x: number) => void; readonly n: number }
const api = { run(a) { return a; }, stop: () => { }, n: 1, ...other };
Foo.prototype.bar = function (x) { return x; };
export default (a, b) => a + b;
let x = 1; function late() { }
const typed: (a: number) => void = (a) => { };
"""


def test_members_of_classes_interfaces_and_objects():
    got = {(n, k): (s, e) for s, e, n, k, _, _ in E.definitions_of(SCRIPT, "ts")}
    assert got["A", "class"] == (2, 18) and got["handler", "method"] == (4, 6) and got["constructor", "method"] == (7, 10) and got["items", "method"] == (11, 15) and got["size", "method"] == (16, 16) and got["p", "method"] == (17, 17)
    assert got["I", "interface"] == (19, 19) and got["api", "variable"][0] == 20 and got["bar", "method"] == (21, 21) and got["anonymous", "function"] == (22, 22) and got["typed", "function"] == (24, 24)
    assert ("x", "variable") in got or ("late", "function") in got  # one definition a line


def test_symbol_indexes(spark):
    documents = [("a.ts", [("s#", 1, 0, 2, 0, 9), ("local 1", 0, 3, 0, 4, 200)], [("s#", "S"), ("t#", None)]), ("b.ts", [], [])]
    assert list(scip.read_index(scip.write_index(documents))) == documents
    occurrences, symbols = scip.parse_indexes(spark.createDataFrame([("i", bytearray(scip.write_index(documents))), ("empty", None)], "name string, content binary"))
    assert [(r.file, r.symbol, r.role_bits, r.end_char, r.pos) for r in occurrences.orderBy("pos").collect()] == [("a.ts", "s#", 1, 9, 0), ("a.ts", "local 1", 0, 200, 1)]
    assert [(r.symbol, r.display_name) for r in symbols.orderBy("pos").collect()] == [("s#", "S"), ("t#", None)]
    with pytest.raises(ValueError, match="within a field"):
        list(scip.read_index(b"\x12\x05ab"))


def test_index_of_many_documents_is_written_in_proportion():
    documents = [(f"r/{i}.ts", [], [("s" * 200, None)]) for i in range(40_000)]
    began = time.process_time()
    content = scip.write_index(documents)
    assert time.process_time() - began < 5 and list(scip.read_index(content)) == documents


def test_large_index_comes_in_parts(spark):
    o = [(r, f"{r}/{i:03}.ts", f"s{j}#", j % 2, j, 0, j, 200, 0, j) for r, n in (("big", 100), ("small", 1)) for i in range(n) if i % 10 for j in range(40 if i == 55 else 2)] + [("small", "small/x.ts", "s#", 1, 0, 0, 1, 1, 0, 0)]
    s = [(r, f"{r}/{i:03}.ts", f"s{j}#", "S" if j else None, 0, j) for r, n in (("big", 100), ("small", 1)) for i in range(n) for j in range(3)]
    occurrences, symbols = spark.createDataFrame(o, "repo string, " + scip.OCCURRENCES), spark.createDataFrame(s, "repo string, " + scip.SYMBOLS)
    indexes = scip.to_indexes(occurrences, symbols, "repo", part_bytes=400)
    parts = {r: sorted((x.first_document, bytes(x.content)) for x in indexes.collect() if x.name == r) for r in ("big", "small")}
    assert len(parts["big"]) > 10 and parts["small"] and all(len(c) <= 400 or len(list(scip.read_index(c))) == 1 for of in parts.values() for _, c in of)
    for r, of in parts.items():
        paths = sorted({x[1] for x in o + s if x[0] == r})
        want = [(p, [x[2:8] for x in o if x[1] == p], [x[2:4] for x in s if x[1] == p]) for p in paths]
        assert list(scip.read_index(b"".join(c for _, c in of))) == want
        assert [n for n, _ in of] == [sum(len(list(scip.read_index(c))) for _, c in of[:k]) for k in range(len(of))]
    number = {p: k for r in parts for k, p in enumerate(sorted({x[1] for x in o + s if x[0] == r}))}
    got, named = scip.parse_indexes(indexes)
    assert sorted(map(tuple, got.collect())) == sorted((*x[1:8], number[x[1]], x[9]) for x in o)
    assert {tuple(x) for x in named.collect()} == {(*x[1:4], number[x[1]], x[5]) for x in s} and named.count() == len(s)


def test_merged_indexes_are_written_once(spark, tmp_path):
    spark.createDataFrame([(1, "r/a.ts"), (2, "r/b.ts"), (2, "r/b.ts")], "id bigint, file_path string").write.parquet(f"{tmp_path}/files.parquet")
    definitions = [(1, 1, "f", 3, True), (2, 1, "g", 4, None), (3, 1, "f", 300, False), (3, 1, "f", 300, False), (4, 2, "f", 1, True), (5, 1, None, 1, True)]
    spark.createDataFrame(definitions, "id bigint, file_id bigint, name string, start_line int, is_exported boolean").write.parquet(f"{tmp_path}/definitions.parquet")
    merged = config_queries.s7_merged_symbols(spark, str(tmp_path))
    assert "FileScan" not in merged._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in merged.collect()} == {("r/a.ts#g", "g"), ("r/a.ts#f", "f")}


def test_extract_table(spark):
    files = spark.createDataFrame([(1, "a.py", "x = 1", 0), (2, "b.md", "# x", 0), (3, None, "x", 0), (4, "c.js", None, 0)], "id bigint, file_path string, file_content string, name int")
    assert [(r.file_id, r.name) for r in E.extract(files).collect()] == [(1, "x")]
    yes, no = E.split_parseable(files)
    assert {r.id for r in yes.collect()} == {1, 4} and {r.id for r in no.collect()} == {2, 3}


# -- folds ----------------------------------------------------------------------------------------------------------------
def test_fold(spark):
    nodes = spark.createDataFrame([(1, "low", "x"), (2, "mid", None), (3, "top", "y"), (4, "twin", "z"), (5, "twin2", "z")], "node bigint, name string, text string")
    edges = spark.createDataFrame([(2, 1), (3, 2), (3, 1), (4, 5), (5, 4)], "src bigint, dst bigint")
    made = {r.node: (r.level, r.full) for r in H.summarize_levels(nodes, edges, G.levels(nodes, edges)).collect()}
    assert made[1][0] == 0 and made[2] == (1, "mid (1 dependencies): ") and made[3] == (2, "top (2 dependencies): y") and made[4][0] == made[5][0] == 0
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "")], "entity_id bigint, text string")
    got = {r.entity_id: r.embedding for r in H.embed(rows).collect()}
    assert got[1] == got[2] != got[3] and len(got[1]) == 64
    plan = H.batch_plan(nodes, ["node"], size=2, per_second=4.0)
    assert [(r.batch_no, r.position, r.planned_second) for r in plan.orderBy("node").collect()] == [(0, 0, 0.0), (0, 1, 0.0), (1, 0, 0.5), (1, 1, 0.5), (2, 0, 1.0)]


# -- events ---------------------------------------------------------------------------------------------------------------
def at(m):
    return datetime(2024, 1, 1, 0, m)


EVENTS = [("j1", "queued", None, at(0), 1), ("j1", "succeeded", "embeddings", at(1), 2), ("j1", "running", "graph", at(2), 3), ("j2", "running", "parsing", at(1), 4), ("j2", "running", "graph", at(1), 5)]
EVENT_SCHEMA = "job_id string, status string, phase string, ts timestamp, seq bigint"


def test_jobs(spark):
    states = C.job_states(spark.createDataFrame(EVENTS, EVENT_SCHEMA)).withColumn("p", C.job_percent(F.col("phase"), F.col("status")))
    assert {(r.job_id, r.status, r.p) for r in states.collect()} == {("j1", "succeeded", 100), ("j2", "running", 60)}


def test_job_stream_equals_batch(spark, tmp_path):
    batch = spark.createDataFrame(EVENTS, EVENT_SCHEMA)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = J.job_state_stream(spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    assert {tuple(r) for r in J.run_to_memory(stream, "job_states").collect()} == {(r.job_id, r.status, r.updated_at) for r in C.job_states(batch).collect()}


def test_windowed_stream(spark, tmp_path):
    spark.createDataFrame([(at(1), "a", 1.0), (at(2), "a", 2.0), (at(3), "b", 5.0)], "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = J.windowed_counts(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in")))
    assert {(r.event_type, r.n, r.total) for r in J.run_to_memory(stream, "windows").collect()} == {("a", 2, 3.0), ("b", 1, 5.0)}


def test_conversations(spark):
    m = spark.createDataFrame([("c", i, "user", "x" * 30) for i in range(1, 8)] + [("d", 1, "user", None)], "conv_id string, turn bigint, role string, text string")
    assert [r.turn for r in C.recent(m, 2).collect()] == [6, 7, 1]
    points = {(r.conv_id, r.turn): r.included for r in C.compaction_points(m, 100).collect()}
    assert [points["c", i] for i in range(1, 8)] == [False, False, False, True, True, True, True] and points["d", 1]
    ctx = C.context(spark.createDataFrame([("c", "sum")], "conv_id string, summary string"), m, spark.createDataFrame([("c", "now")], "conv_id string, text string"), 2).filter("conv_id = 'c'").orderBy("position").collect()
    assert [(r.position, r.role, r.text[:3]) for r in ctx] == [(1, "system", "sum"), (2, "user", "xxx"), (3, "user", "xxx"), (4, "user", "now")]


def test_streams_and_tools(spark):
    e = spark.createDataFrame([("s", 2, "delta", "b"), ("s", 1, "delta", "a"), ("s", 3, "tool_call", None), ("s", 4, "complete", None), ("s", 5, "delta", "late"), ("t", 1, "delta", "x"), ("u", 1, "error", None)], "session_id string, seq bigint, event_type string, delta string")
    assert {tuple(r) for r in C.stream_texts(e).collect()} == {("s", "ab", 1, "complete"), ("t", "x", 0, "streaming"), ("u", "", 0, "error")}
    t = spark.createDataFrame([("s", "x", "executing"), ("s", "x", "pending"), ("s", "y", "failed")], "session_id string, tool_id string, status string")
    assert {tuple(r) for r in C.tool_status(t).collect()} == {("s", "x", "executing"), ("s", "y", "failed")}
    calls = spark.createDataFrame([("s", 5, 1.0), ("s", 1, 31.0), ("s", 9, 1.0)], "session_id string, seq bigint, seconds double")
    assert [(r.seq, r.over_budget, r.timed_out) for r in C.over_budget(calls).orderBy("seq").collect()] == [(1, False, True), (5, False, False), (9, True, False)]


def test_webhooks(spark):
    rows = [("1", "push", '{"ref": "refs/heads/main", "repository": {"full_name": "o/r"}, "commits": [{"id": "a"}, {"id": "b"}]}'), ("2", "issues", '{"action": "opened", "issue": {"number": 4}}'), ("3", "push", "not json"), ("4", "star", "{}"), ("5", "push", None)]
    p = spark.createDataFrame(rows, "delivery_id string, event string, body string")
    got = {r.delivery_id: (r.detail, r.n_commits, r.valid) for r in C.webhook_records(p).collect()}
    assert got["1"] == ("main", 2, True) and got["2"][0] == "opened#4" and not got["3"][2] and not got["4"][2] and not got["5"][2]
    assert {r.commit_id for r in C.push_commits(p).collect()} == {"a", "b"}


# -- sources and sinks ----------------------------------------------------------------------------------------------------
def test_tree(spark, tmp_path):
    root = tmp_path / "tree"
    for name, body in {"a.py": b"x = 1", "src/b.ts": "é".encode(), "src/bad.ts": b"\xff\xfe\x00", "node_modules/c.js": b"", ".hidden/d.py": b"", "skip/me.log": b"", "x.min.js": b"1", "empty.py": b""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    got = {r.path: (r.content, r.valid) for r in T.read_tree(spark, str(root), gitignore=("# no", "*.log")).collect()}
    assert got == {"a.py": ("x = 1", True), "src/b.ts": ("é", True), "src/bad.ts": (None, False)}
    assert {r.path for r in T.read_tree(spark, str(root), recursive=False).collect()} == {"a.py", "x.min.js"}
    assert T.read_tree(spark, "/").count() == 0 and T.restricted("/")


def test_catalogue(spark):
    spark.createDataFrame([(1, "a")], "id bigint, v string").createOrReplaceTempView("some_view")
    assert T.tables(spark).filter("name = 'some_view'").count() == 1
    assert [(r.name, r.type) for r in T.table_info(spark, "some_view").orderBy("position").collect()] == [("id", "bigint"), ("v", "string")]
    assert T.raw_sql(spark, "SELECT v FROM some_view WHERE v = :v", v="a' OR 1=1 --").count() == 0
    occ = spark.createDataFrame([(1,)], "pos int")
    assert T.concat_indexes([occ, occ.withColumn("extra", F.lit(1))]).count() == 2


def test_sinks(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.createDataFrame([(1,), (2,)], "id bigint")
    for _ in range(2):
        K.write_repository(rows, folder, "a-b")
    K.write_repository(rows, folder, "c")
    assert K.read_repository(spark, folder, "a-b").count() == 2 and K.read_repository(spark, folder).count() == 4
    assert K.delete_repository(spark, folder, "a-b") and not K.delete_repository(spark, folder, "a-b")
    for bad in ("../x", "", "..", "a/b"):
        with pytest.raises(ValueError):
            K.delete_repository(spark, folder, bad)
    K.replace_table(spark.read.parquet(folder + "/repo_slug=c").filter("id = 1"), folder + "/repo_slug=c")
    K.compact(spark, folder + "/repo_slug=c", 1)
    assert spark.read.parquet(folder + "/repo_slug=c").count() == 1


def test_lookups(spark):
    df = spark.createDataFrame([(1, "Ab", None), (2, None, "xaBx"), (3, "", "")], "id bigint, a string, b string")
    assert {r.id for r in df.filter(R.any_contains(["a", "b"], "AB")).collect()} == {1, 2} and [r.id for r in R.present(df, "a").collect()] == [1]
    assert R.first_match(df, F.col("id") > 1, "id").first().id == 2
    with pytest.raises(LookupError):
        R.first_match(df, F.col("id") > 9, "id")
    assert [r.id for r in R.page(df, F.desc("id"), limit=1, offset=1).collect()] == [2]
    assert one(spark, R.integer_average(F.col("a"), F.col("b")), a=7, b=0) == 0 and one(spark, R.integer_average(F.col("a"), F.col("b")), a=7, b=2) == 3
    costs = spark.createDataFrame([(1, 5, 0, 0), (2, 7, 0, 0), (3, 1, 1, 3)], "node bigint, tokens bigint, level int, component bigint")
    totals = {r.level: (r.n_nodes, r.n_components, r.tokens, r.largest) for r in R.level_totals(costs.select("node", "level", "component"), costs.select("node", "tokens")).collect()}
    assert totals == {0: (2, 1, 12, 7), 1: (1, 1, 1, 1)}
