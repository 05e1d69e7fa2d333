"""Sources, catalogue and monorepo configuration: queries over small trees and tables that are given here, where the corpus has none, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions import text as X
from quarry.operators import config as M
from quarry.operators import resolve as V
from quarry.sources import repository as T
from quarry.sources import scip
from quarry.sources import sinks as K
from quarry.sources.tables import table
from quarry.session import checkpoint, shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def values(rows: list[tuple], *names: str) -> str:
    """A table of given rows in SQL."""

    def literal(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({', '.join(names)}))"


# -- trees ----------------------------------------------------------------------------------------------------------------
#: A small working tree: a text, nested directories, bytes that are no UTF-8, ignored and hidden directories.
TREE = {
    "README.md": b"# Title\n", "src/a.py": "x = 'é'\n".encode(), "src/deep/er/b.ts": b"let b\n", "src/bad.js": b"\xff\xfe\x00x", "node_modules/m/i.js": b"no\n", ".git/config": b"no\n", "src/deep/lib.min.js": b"no\n", "notes/keep.txt": b"yes\n", "notes/drop.txt": b"no\n",
}
_LISTED = [("README.md", "# Title\n", True), ("src/a.py", "x = 'é'\n", True), ("src/deep/er/b.ts", "let b\n", True), ("src/bad.js", None, False), ("notes/keep.txt", "yes\n", True)]
_DIRECTORIES = [(p, None, True) for p in ("src/", "src/deep/", "src/deep/er/", "notes/")]


def _tree(spark):
    root = shared_folder(spark, "tree")
    T.write_tree(spark, root, TREE)
    return root


@query(values(_LISTED + _DIRECTORIES, "path", "content", "valid"))
def s1_tree(spark, d):
    return T.read_tree(spark, _tree(spark), gitignore=("drop.txt",), directories=True)


@query(values([("/", True), ("~", True), ("/tmp", False)], "root", "refused"))
def s3_restricted_roots(spark, d):
    return spark.createDataFrame([(r, T.restricted(r.replace("~", T.os.path.expanduser("~")))) for r in ("/", "~", "/tmp")], "root string, refused boolean")


@query(values([("README.md", True)], "path", "valid"))
def s4_one_directory(spark, d):
    return T.read_tree(spark, _tree(spark), recursive=False).select("path", "valid")


@query(values([(v, n) for v, n in ((True, 4), (False, 1))], "valid", "n"))
def s6_undecodable_files(spark, d):
    return T.read_tree(spark, _tree(spark), gitignore=("drop.txt",)).groupBy("valid").agg(F.count("*").alias("n"))


# -- symbol indexes -------------------------------------------------------------------------------------------------------
_INDEXED = "(SELECT DISTINCT d.id, f.file_path AS file, d.name, d.start_line - 1 AS line, d.is_exported, dense_rank() OVER (PARTITION BY f.file_path ORDER BY d.id) - 1 AS pos FROM definitions d JOIN files f ON f.id = d.file_id WHERE d.name IS NOT NULL)"


def _indexed(spark, d):
    """The definitions as occurrences and symbols, written as one index per repository and read again."""
    files = table(spark, d, "files", "id", "file_path").distinct().withColumnsRenamed({"id": "file_id", "file_path": "file"})
    defs = table(spark, d, "definitions", "id", "file_id", "name", "start_line", "is_exported").filter("name IS NOT NULL").dropDuplicates(["id"]).join(files, "file_id")
    w = V.Window.partitionBy("file").orderBy("id")
    # Occurrences and symbols are both made of these rows, and each is read twice to be dealt out by ranges.
    rows = checkpoint(defs.select("file", (F.row_number().over(w) - 1).alias("pos"), F.concat("file", F.lit("#"), "name").alias("symbol"), F.when(F.col("is_exported"), 1).otherwise(0).alias("role_bits"), (F.col("start_line") - 1).alias("line"), F.length("name").alias("n"), "name"))
    occurrences = rows.select("file", "symbol", "role_bits", F.col("line").alias("start_line"), F.lit(0).alias("start_char"), (F.col("line") + F.col("pos") % 2).alias("end_line"), F.col("n").alias("end_char"), F.lit(0).alias("doc_order"), "pos", F.split("file", "/")[0].alias("repo"))
    symbols = rows.select("file", "symbol", F.when(F.col("pos") % 3 > 0, F.col("name")).alias("display_name"), F.lit(0).alias("doc_order"), "pos", F.split("file", "/")[0].alias("repo"))
    return scip.parse_indexes(scip.to_indexes(occurrences, symbols, "repo"))


@query(f"SELECT file, file || '#' || name AS symbol, CASE WHEN is_exported THEN 1 ELSE 0 END AS role_bits, line AS start_line, CAST(line + pos % 2 AS INT) AS end_line, length(name) AS end_char, pos FROM {_INDEXED}")
def s7_index_occurrences(spark, d):
    return _indexed(spark, d)[0].select("file", "symbol", "role_bits", "start_line", "end_line", F.col("end_char").cast("bigint").alias("end_char"), F.col("pos").cast("bigint").alias("pos"))


@query(f"SELECT file, file || '#' || name AS symbol, CASE WHEN pos % 3 > 0 THEN name END AS display_name FROM {_INDEXED}")
def s7_index_symbols(spark, d):
    return _indexed(spark, d)[1].select("file", "symbol", "display_name")


@query(f"SELECT symbol, first(display_name ORDER BY doc_order, pos) AS display_name FROM (SELECT file || '#' || name AS symbol, CASE WHEN pos % 3 > 0 THEN name END AS display_name, pos, 0 AS doc_order FROM {_INDEXED}) WHERE display_name IS NOT NULL GROUP BY ALL")
def s7_merged_symbols(spark, d):
    """Two indexes under one another: the first that names a symbol wins."""
    symbols = _indexed(spark, d)[1]
    merged = T.concat_indexes([symbols, symbols.withColumn("display_name", F.upper("display_name"))])
    ordered = merged.withColumn("doc_order", F.struct("index_no", "doc_order"))
    return V.symbol_names(ordered)


# -- packages and configurations ------------------------------------------------------------------------------------------
#: Monorepos in small: a workspace of pnpm, one of yarn, packages that import each other by path, packages that depend on each other, and one alone.
REPOS = {
    "pnpm-workspace-repo": {
        "package.json": '{"name": "pnpm-workspace-root", "private": true}', "pnpm-workspace.yaml": "packages:\n  - 'packages/*'\n", "packages/ui/package.json": '{"name": "@workspace/ui", "main": "dist/index.js"}', "packages/ui/src/index.ts": "export {}",
        "packages/utils/package.json": '{"name": "@workspace/utils", "dependencies": {"@workspace/ui": "workspace:*", "left": "1"}, "exports": {".": {"import": "./esm.js", "require": "./cjs.js"}}}',
    },
    "yarn-workspace-repo": {
        "package.json": '{"name": "yarn-workspace-root", "workspaces": ["packages/*"]}', "yarn.lock": "", "packages/web/package.json": '{"name": "@company/web", "devDependencies": {"@company/shared": "1"}}', "packages/web/index.js": "", "packages/shared/package.json": '{"name": "@company/shared", "exports": "./out.js", "main": "no.js"}',
    },
    "npm-workspace-repo": {"package.json": '{"name": "npm-root", "workspaces": {"packages": ["apps/*"]}}', "apps/one/package.json": '{"name": "one"}'},
    "direct-imports-repo": {"package.json": '{"name": "direct-imports-monorepo"}', "core/package.json": '{"name": "core"}', "core/index.ts": "", "core/src/index.ts": "", "api/package.json": '{"name": "api", "peerDependencies": {"left": "1"}}', "api/index.jsx": ""},
    "turbo-repo": {"package.json": '{"name": "turbo-root", "workspaces": ["p/*"]}', "turbo.json": "{}", "lerna.json": "{}", "p/a/package.json": '{"name": "a", "optionalDependencies": {"b": "1"}}', "p/b/package.json": '{"name": "b"}', "p/c/package.json": '{"name": "c"', "node_modules/x/package.json": '{"name": "x"}'},
}
CONFIGS = {
    "tsconfig.json": '{\n  // the root "paths"\n  "compilerOptions": {"baseUrl": ".", "strict": true, "outDir": "out", "paths": {"@app/*": ["src/*"], "@x": ["x//*y"],}},\n  /* refs */ "references": [{"path": "./packages/a"}, {"path": "packages/b/tsconfig.lib.json"}],\n}',
    "packages/a/tsconfig.json": '{"extends": "../../tsconfig.base", "compilerOptions": {"baseUrl": "lib", "paths": {"@a/*": ["*"], "@app/*": ["mine/*"]}}, "references": [{"path": "../b/tsconfig.lib.json"}]}',
    "packages/b/tsconfig.lib.json": '{"extends": "@company/base", "compilerOptions": {"outDir": "lib-out", "paths": {"@b": ["b"]}}}',
    "tsconfig.base.json": '{"extends": "./tsconfig.json", "compilerOptions": {"strict": false, "target": "es2022"}}',
    "loop/tsconfig.json": '{"extends": "./tsconfig.other.json"}', "loop/tsconfig.other.json": '{"extends": "./tsconfig.json", "compilerOptions": {"target": "es5"}}',
    "dist/tsconfig.json": "{}", "packages/a/tsconfigs.txt": "", "broken/tsconfig.json": "{",
}


def _files(spark):
    return spark.createDataFrame([(root, path, content) for root, files in REPOS.items() for path, content in files.items()], "root string, path string, content string")


def _packages(spark):
    """The packages of all roots; each root is read on its own, so that its paths are relative to it."""
    parsed = [M.parse_packages(_files(spark).filter(F.col("root") == root).select("path", "content")).withColumn("root", F.lit(root)) for root in REPOS]
    union = parsed[0]
    for p in parsed[1:]:
        union = union.unionByName(p)
    return union


def _configs(spark):
    return M.parse_tsconfigs(spark.createDataFrame(list(CONFIGS.items()), "path string, content string"))


_PACKAGES = [
    ("pnpm-workspace-repo", "", "pnpm-workspace-root", "", ""), ("pnpm-workspace-repo", "packages/ui", "@workspace/ui", "", ""), ("pnpm-workspace-repo", "packages/utils", "@workspace/utils", "", "@workspace/ui left"), ("yarn-workspace-repo", "", "yarn-workspace-root", "packages/*", ""),
    ("yarn-workspace-repo", "packages/web", "@company/web", "", "@company/shared"), ("yarn-workspace-repo", "packages/shared", "@company/shared", "", ""), ("npm-workspace-repo", "", "npm-root", "apps/*", ""), ("npm-workspace-repo", "apps/one", "one", "", ""),
    ("direct-imports-repo", "", "direct-imports-monorepo", "", ""), ("direct-imports-repo", "core", "core", "", ""), ("direct-imports-repo", "api", "api", "", "left"), ("turbo-repo", "", "turbo-root", "p/*", ""), ("turbo-repo", "p/a", "a", "", "b"), ("turbo-repo", "p/b", "b", "", ""),
]


@query(values(_PACKAGES, "root", "dir", "name", "workspaces", "dependencies"))
def s11_packages(spark, d):
    return _packages(spark).select("root", "dir", "name", F.array_join("workspaces", " ").alias("workspaces"), F.array_join("dependencies", " ").alias("dependencies"))


@query(values([("tsconfig.json", '{\n  \n  "compilerOptions": {"baseUrl": ".", "strict": true, "outDir": "out", "paths": {"@app/*": ["src/*"], "@x": ["x//*y"]}},\n   "references": [{"path": "./packages/a"}, {"path": "packages/b/tsconfig.lib.json"}]\n}')], "path", "bare"))
def s12_comments_in_json(spark, d):
    text = M.strip_json_comments(F.col("content"))
    return spark.createDataFrame(list(CONFIGS.items()), "path string, content string").filter("path = 'tsconfig.json'").select("path", text.alias("bare"))


@query(values([(p,) for p in ("tsconfig.json", "packages/a/tsconfig.json", "packages/b/tsconfig.lib.json", "tsconfig.base.json", "loop/tsconfig.json", "loop/tsconfig.other.json", "broken/tsconfig.json")], "path"))
def s13_tsconfigs(spark, d):
    return M.named_files(spark.createDataFrame(list(CONFIGS.items()), "path string, content string"), "tsconfig*.json").select("path")


@query(values([("pnpm-workspace-repo", "pnpm"), ("yarn-workspace-repo", "yarn"), ("npm-workspace-repo", "npm"), ("direct-imports-repo", "none"), ("turbo-repo", "turbo")], "root", "type"))
def m1_workspace_types(spark, d):
    return M.workspace_type(_files(spark), _packages(spark))


@query(values([("pnpm-workspace-repo", "packages/ui/package.json", "dist/index.js"), ("pnpm-workspace-repo", "packages/utils/package.json", "./esm.js"), ("yarn-workspace-repo", "packages/web/package.json", "index.js"), ("yarn-workspace-repo", "packages/shared/package.json", "./out.js"), ("direct-imports-repo", "core/package.json", "index.ts"), ("direct-imports-repo", "api/package.json", "index.jsx")], "root", "path", "entry_point"))
def m2_entry_points(spark, d):
    files, packages = _files(spark), _packages(spark)
    found = [M.entry_points(packages.filter(F.col("root") == r), files.filter(F.col("root") == r)).withColumn("root", F.lit(r)) for r in REPOS]
    union = found[0]
    for f in found[1:]:
        union = union.unionByName(f)
    return union.filter("entry_point IS NOT NULL").select("root", "path", "entry_point")


_OPTIONS = [
    ("tsconfig.json", ".", "out", None, "true"), ("packages/a/tsconfig.json", "lib", "out", "es2022", "false"), ("packages/b/tsconfig.lib.json", None, "lib-out", None, None), ("tsconfig.base.json", ".", "out", "es2022", "false"), ("loop/tsconfig.json", None, None, "es5", None), ("loop/tsconfig.other.json", None, None, "es5", None),
]


@query(values(_OPTIONS, "path", "base_url", "out_dir", "target", "strict"))
def m3_extended_options(spark, d):
    o = M.extended_options(_configs(spark))
    return o.select("path", "base_url", *[F.try_element_at("options", F.lit(k)).alias(a) for k, a in (("outDir", "out_dir"), ("target", "target"), ("strict", "strict"))])


_MAPPINGS = [
    ("tsconfig.json", "@app/*", "src/*"), ("tsconfig.json", "@x", "x/*y"), ("tsconfig.json", "@a/*", "packages/a/lib/*"), ("tsconfig.json", "@b", "packages/b/b"),
    ("packages/a/tsconfig.json", "@a/*", "packages/a/lib/*"), ("packages/a/tsconfig.json", "@app/*", "packages/a/lib/mine/*"), ("packages/a/tsconfig.json", "@b", "packages/b/b"), ("packages/b/tsconfig.lib.json", "@b", "packages/b/b"),
]


@query(values(_MAPPINGS, "path", "alias", "target"))
def m4_path_mappings(spark, d):
    configs = _configs(spark)
    return M.path_mappings(configs, configs.select("path", "base_url", "paths"))


@query(f"""WITH c AS {values([(p, p.rpartition("/")[0]) for p in CONFIGS if p.endswith("tsconfig.json") and not p.startswith("dist")], "config", "dir")}, f AS {values([("packages/a/lib/x.ts",), ("packages/c/y.ts",), ("loop/z.ts",), ("w.ts",), ("packages/b/q/r.ts",)], "path")},
h AS (SELECT f.path, c.config, row_number() OVER (PARTITION BY f.path ORDER BY length(c.dir) DESC) AS n FROM f JOIN c ON c.dir = '' OR starts_with(f.path, c.dir || '/')) SELECT path, config FROM h WHERE n = 1""")
def m5_nearest_config(spark, d):
    files = spark.createDataFrame([("packages/a/lib/x.ts",), ("packages/c/y.ts",), ("loop/z.ts",), ("w.ts",), ("packages/b/q/r.ts",)], "path string")
    return M.nearest_config(files, M.named_files(spark.createDataFrame(list(CONFIGS.items()), "path string, content string"), "tsconfig.json").select("path", P.dirname(F.col("path")).alias("dir")))


@query(values([("pnpm-workspace-repo", "package_based_monorepo"), ("yarn-workspace-repo", "package_based_monorepo"), ("npm-workspace-repo", "single_package"), ("direct-imports-repo", "direct_import_monorepo"), ("turbo-repo", "package_based_monorepo")], "root", "class"))
def m6_monorepo_classes(spark, d):
    return M.monorepo_class(_packages(spark))


@query(values([("pnpm-workspace-repo", "@workspace/utils", "@workspace/ui"), ("yarn-workspace-repo", "@company/web", "@company/shared"), ("turbo-repo", "a", "b")], "root", "src", "dst"))
def j12_internal_dependencies(spark, d):
    return M.internal_dependencies(_packages(spark))


# -- catalogue and sinks --------------------------------------------------------------------------------------------------
@query(values([("quarry_catalogue_a", True), ("quarry_catalogue_b", True)], "name", "temporary"))
def s16_tables(spark, d):
    table(spark, d, "region").createOrReplaceTempView("quarry_catalogue_a")
    table(spark, d, "nation").createOrReplaceTempView("quarry_catalogue_b")
    return T.tables(spark).filter("name LIKE 'quarry_catalogue_%'").select("name", "temporary")


@query(values([(0, "doc_id", "bigint"), (1, "text", "string"), (2, "n", "int")], "position", "name", "type"))
def s16_table_info(spark, d):
    table(spark, d, "documents", "doc_id", "text").withColumn("n", F.length("text")).createOrReplaceTempView("quarry_info")
    return T.table_info(spark, "quarry_info").select("position", "name", "type")


def _by_repository(spark, d):
    """The documents as a table with a partition per repository, in the shared folder."""
    folder = shared_folder(spark, "by-repository")
    table(spark, d, "documents", "doc_id", "repo_slug", "lang").filter("repo_slug IS NOT NULL").write.partitionBy("repo_slug").parquet(folder)
    return folder


@query("SELECT doc_id, lang FROM documents WHERE repo_slug = 'veldt-platform'")
def s17_one_partition(spark, d):
    """Only the partition of the repository is listed and read."""
    return K.read_repository(spark, _by_repository(spark, d), "veldt-platform").select("doc_id", "lang")


@query("SELECT doc_id, repo_slug, CASE WHEN repo_slug = 'veldt-platform' THEN 'new' ELSE lang END AS lang FROM documents WHERE repo_slug IS NOT NULL")
def k1_write_repository(spark, d):
    folder = _by_repository(spark, d)
    rows = table(spark, d, "documents", "doc_id", "repo_slug").filter("repo_slug = 'veldt-platform'").select("doc_id", F.lit("new").alias("lang"))
    K.write_repository(rows, folder, "veldt-platform")
    return K.read_repository(spark, folder).select("doc_id", "repo_slug", "lang")


@query("SELECT doc_id, repo_slug FROM documents WHERE repo_slug <> 'veldt-platform'")
def k9_delete_repository(spark, d):
    folder = _by_repository(spark, d)
    if not K.delete_repository(spark, folder, "veldt-platform") or K.delete_repository(spark, folder, "not-there"):
        raise RuntimeError("the wrong partitions were there")
    return K.read_repository(spark, folder).select("doc_id", "repo_slug")


@query("SELECT CASE WHEN label % 2 = 0 THEN 'file' ELSE 'definition' END AS entity_type, vec_id AS entity_id, CASE WHEN vec_id % 3 = 0 THEN -embedding[1] ELSE embedding[1] END AS first FROM embeddings")
def k4_replaced_vectors(spark, d):
    kind = F.when(F.col("label") % 2 == 0, "file").otherwise("definition").alias("entity_type")
    mirror = table(spark, d, "embeddings", "vec_id", "embedding", "label").select(kind, F.col("vec_id").alias("entity_id"), "embedding")
    new = mirror.filter("entity_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    return K.replace_vectors(mirror, new.unionByName(new)).select("entity_type", "entity_id", F.element_at("embedding", 1).alias("first"))


@query("SELECT 'quarry_nation' AS table_name, 'n_regionkey' AS column_name, count(*) AS n_rows, count(DISTINCT n_regionkey) AS n_distinct, count(*) FILTER (n_regionkey IS NULL) AS n_nulls FROM nation UNION ALL SELECT 'quarry_reset', 'n_regionkey', 0, 0, 0")
def k8_tables_and_statistics(spark, d):
    """Two tables are made, one is emptied again, both are analysed and taken out."""
    folder = shared_folder(spark, "tables")
    for name in ("quarry_nation", "quarry_reset"):
        K.create_table(table(spark, d, "nation", "n_nationkey", "n_regionkey"), name, folder)
    K.reset_table(spark, "quarry_reset", folder)
    found = K.analyze(spark, "quarry_nation").unionByName(K.analyze(spark, "quarry_reset"))
    K.drop_tables(spark, "quarry_nation", "quarry_reset", "quarry_absent")
    return found.filter("column_name = 'n_regionkey'").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_distinct", "n_nulls")})


@query(r"SELECT DISTINCT id, CASE WHEN starts_with(file_path, repo || '/src/') THEN substring(file_path, length(repo) + 6) ELSE '../' || substring(file_path, length(repo) + 2) END AS seen, starts_with(file_path, repo || '/src/') AS inside FROM (SELECT id, file_path, string_split(file_path, '/')[1] AS repo FROM files)")
def x16_relative_paths(spark, d):
    f = table(spark, d, "files", "id", "file_path").withColumn("base", F.concat(F.split("file_path", "/")[0], F.lit("/src")))
    return f.select("id", P.relative_path(F.col("file_path"), F.col("base")).alias("seen"), P.is_within(F.col("file_path"), F.col("base")).alias("inside")).distinct()


@query(r"SELECT doc_id, list_reduce(list_prepend(0, list_transform(regexp_extract_all(text, '\[[^\]]+\]\(file::(\d+)(:definition::\d+)?\)', 1), lambda x: CAST(x AS BIGINT))), lambda a, b: a + b) AS file_sum, len(regexp_extract_all(text, '\[[^\]]+\]\(file::\d+:definition::\d+\)')) AS n_definitions FROM documents WHERE text IS NOT NULL".replace("(:definition", "(?:definition").replace("(?:definition", "(:definition"))
def x12_citation_targets(spark, d):
    c = X.citations(F.col("text"))
    files = F.aggregate(F.transform(c, lambda x: x["file_id"]), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", files.alias("file_sum"), F.size(F.filter(c, lambda x: x["definition_id"].isNotNull())).cast("bigint").alias("n_definitions"))


_XML = [(1, "<answer><message>Hi <b>you</b></message><related_files><file>a.py</file><file> b.ts </file></related_files><related_definitions><definition>f</definition></related_definitions></answer>"), (2, "<message>only</message>"), (3, "no tags"), (4, "<related_files></related_files>"), (5, None)]


@query(values([(1, "Hi <b>you</b>", "a.py|b.ts", "f"), (2, "only", "", ""), (3, None, "", ""), (4, None, "", ""), (5, None, "", "")], "id", "message", "files", "definitions"))
def x13_nested_tags(spark, d):
    rows = spark.createDataFrame(_XML, "id int, text string")
    def inner(outer, tag):
        return F.coalesce(F.array_join(X.tag_contents(X.tag_content(F.col("text"), outer), tag), "|"), F.lit(""))

    return rows.select("id", X.tag_content(F.col("text"), "message").alias("message"), inner("related_files", "file").alias("files"), inner("related_definitions", "definition").alias("definitions"))
