"""The operators bound to the corpus tables, each with the same in SQL. Names begin with the operator's number in the survey."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import paths as P
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
from quarry.sources import repository as T
from quarry.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# -- sources --------------------------------------------------------------------------------------------------------------
@query(r"SELECT DISTINCT id FROM files WHERE regexp_matches(file_path, '(^|/)(node_modules|dist|build)(/|$)') OR regexp_matches(file_path, '\.min\.js$') OR regexp_matches(file_path, '(^|/)[^/]*\.lock\.json$')")
def s2_ignored_files(spark, d):
    return table(spark, d, "files", "id", "file_path").filter(T.ignored(F.col("file_path"), ("node_modules", "dist", "build", "*.min.js"), ("*.lock.json", "# note"))).select("id").distinct()


@query(r"SELECT regexp_matches(lower(file_path), '\.(js|jsx|ts|tsx|py)$') AS parseable, count(DISTINCT id) AS n FROM files GROUP BY ALL")
def s5_parseable_split(spark, d):
    yes, no = E.split_parseable(table(spark, d, "files", "id", "file_path"))
    return yes.select("id", F.lit(True).alias("parseable")).unionByName(no.select("id", F.lit(False).alias("parseable"))).groupBy("parseable").agg(F.countDistinct("id").alias("n"))


@query(r"""SELECT CASE regexp_extract(lower(file_path), '\.([^./]+)$', 1) WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'py' THEN 'python' END AS language, count(*) AS n_files
FROM (SELECT DISTINCT id, file_path FROM files) WHERE NOT regexp_matches(file_path, '(^|/)(node_modules|vendor|dist|build)(/|$)') AND language IS NOT NULL GROUP BY ALL""")
def s9_languages(spark, d):
    return T.languages_of(table(spark, d, "files", "id", "file_path").distinct().withColumnRenamed("file_path", "path"), X.INGEST_LANGUAGES)


@query("SELECT doc_id, source FROM documents WHERE lang = 'de' AND length(text) > 100")
def s15_raw_sql(spark, d):
    table(spark, d, "documents").createOrReplaceTempView("quarry_documents")
    return T.raw_sql(spark, "SELECT doc_id, source FROM quarry_documents WHERE lang = :lang AND length(text) > :n", lang="de", n=100)


@query("SELECT repo_slug, count(*) AS n FROM documents WHERE repo_slug = 'veldt-platform' GROUP BY ALL")
def s17_one_repository(spark, d):
    return table(spark, d, "documents", "repo_slug").filter("repo_slug = 'veldt-platform'").groupBy("repo_slug").agg(F.count("*").alias("n"))


@query(r"SELECT DISTINCT id AS file_id FROM files WHERE regexp_matches(file_path, '[.]json$') AND NOT regexp_matches('/' || regexp_replace(file_path, '/[^/]*$', '') || '/', '/(node_modules|dist|build|coverage|out|vendor|[.][^/]*)/')")
def s10_named_files(spark, d):
    f = table(spark, d, "files", "id", "file_path").select(F.col("id").alias("file_id"), F.col("file_path").alias("path"))
    return M.named_files(f, "*.json").select("file_id").distinct()


# -- filters --------------------------------------------------------------------------------------------------------------
@query("SELECT DISTINCT id, file_path FROM files WHERE language = 'python'")
def f1_equality(spark, d):
    return table(spark, d, "files", "id", "file_path", "language").filter("language = 'python'").select("id", "file_path").distinct()


@query("SELECT DISTINCT d.id, d.name FROM definitions d WHERE d.file_id IN (SELECT id FROM files WHERE package_id IN (SELECT id FROM packages WHERE is_workspace_root))")
def f2_id_list(spark, d):
    roots = table(spark, d, "packages", "id", "is_workspace_root").filter("is_workspace_root").select(F.col("id").alias("package_id"))
    files = table(spark, d, "files", "id", "package_id").join(roots, "package_id", "left_semi").select(F.col("id").alias("file_id"))
    return table(spark, d, "definitions", "id", "name", "file_id").join(files, "file_id", "left_semi").select("id", "name").distinct()


@query("SELECT DISTINCT id, ai_summary FROM files WHERE ai_summary IS NOT NULL AND ai_summary <> ''")
def f3_present(spark, d):
    return R.present(table(spark, d, "files", "id", "ai_summary"), "ai_summary").distinct()


@query("SELECT DISTINCT id, file_path FROM files WHERE file_path LIKE '%/index.js'")
def f4_suffix(spark, d):
    return table(spark, d, "files", "id", "file_path").filter(F.col("file_path").endswith("/index.js")).distinct()


@query("SELECT DISTINCT id, complexity_score FROM definitions WHERE complexity_score & 1 <> 0")
def f6_bit_mask(spark, d):
    return table(spark, d, "definitions", "id", "complexity_score").filter(F.col("complexity_score").bitwiseAND(1) != 0).distinct()


@query("SELECT DISTINCT id, file_path FROM files WHERE starts_with(file_path, 'oxbow-studio/packages/')")
def f7_prefix(spark, d):
    return table(spark, d, "files", "id", "file_path").filter(F.col("file_path").startswith("oxbow-studio/packages/")).distinct()


@query("SELECT DISTINCT id, name FROM packages WHERE coalesce(contains(lower(name), 'core'), false) OR coalesce(contains(lower(readme_content), 'core'), false)")
def f8_any_contains(spark, d):
    return table(spark, d, "packages", "id", "name", "readme_content").filter(R.any_contains(["name", "readme_content"], "Core")).select("id", "name").distinct()


@query("SELECT path IN ('/', '.') AS is_root, count(DISTINCT id) AS n FROM packages GROUP BY ALL")
def f10_root_split(spark, d):
    return table(spark, d, "packages", "id", "path").groupBy(F.col("path").isin("/", ".").alias("is_root")).agg(F.countDistinct("id").alias("n"))


@query("SELECT DISTINCT id, import_type FROM imports WHERE import_type IS NOT NULL AND import_type NOT IN ('default', 'named')")
def f11_invalid_kinds(spark, d):
    return R.invalid_kinds(table(spark, d, "imports", "id", "import_type"), "import_type", ("default", "named")).distinct()


# -- joins ----------------------------------------------------------------------------------------------------------------
_HITS = "(SELECT 'file' AS entity_type, id AS entity_id, CAST(id % 97 AS DOUBLE) AS distance FROM files GROUP BY ALL UNION ALL SELECT 'definition', id, CAST(id % 89 AS DOUBLE) FROM definitions GROUP BY ALL)"


def _hits(spark, d):
    f = table(spark, d, "files", "id").distinct().select(F.lit("file").alias("entity_type"), F.col("id").alias("entity_id"), (F.col("id") % 97).cast("double").alias("distance"))
    g = table(spark, d, "definitions", "id").distinct().select(F.lit("definition").alias("entity_type"), F.col("id").alias("entity_id"), (F.col("id") % 89).cast("double").alias("distance"))
    return f.unionByName(g)


_HYDRATED = f"""SELECT h.entity_type, h.entity_id, coalesce(CASE WHEN h.entity_type = 'file' THEN regexp_extract(f.file_path, '[^/]*$') END, g.name) AS name, coalesce(f.file_path, g.file_path) AS path,
coalesce(f.ai_short_summary, g.ai_short_summary) AS summary, h.distance, 1.0 / (1 + h.distance) AS similarity
FROM {_HITS} h LEFT JOIN (SELECT DISTINCT id, file_path, ai_short_summary FROM files) f ON h.entity_type = 'file' AND f.id = h.entity_id
LEFT JOIN (SELECT DISTINCT d.id, d.name, d.ai_short_summary, f.file_path FROM definitions d LEFT JOIN files f ON f.id = d.file_id) g ON h.entity_type = 'definition' AND g.id = h.entity_id"""


@query(f"SELECT * FROM ({_HYDRATED}) WHERE name IS NOT NULL")
def j2_hydrated_hits(spark, d):
    return S.hydrate(_hits(spark, d), table(spark, d, "files", "id", "file_path", "ai_short_summary"), table(spark, d, "definitions", "id", "file_id", "name", "ai_short_summary"))


def _ranges(spark, d):
    return table(spark, d, "definitions", "id", "file_id", "definition_type", "start_line", "end_line", "name").distinct()


@query("""SELECT DISTINCT m.id AS point_id, c.id AS definition_id FROM definitions m JOIN definitions c ON c.file_id = m.file_id AND m.start_line BETWEEN c.start_line AND c.end_line
WHERE m.definition_type = 'method' AND c.definition_type = 'class'""")
def j4_containing_definitions(spark, d):
    r = _ranges(spark, d)
    points = r.filter("definition_type = 'method'").select(F.col("id").alias("point_id"), F.col("file_id").alias("file"), F.col("start_line").alias("at"))
    ranges = r.filter("definition_type = 'class'").select(F.col("id").alias("definition_id"), F.col("file_id").alias("file"), "start_line", "end_line")
    return V.containing(points, ranges, F.col("at")).select("point_id", "definition_id")


@query("""SELECT point_id, definition_id FROM (SELECT m.id AS point_id, c.id AS definition_id, row_number() OVER (PARTITION BY m.id ORDER BY c.end_line - c.start_line, c.id) AS n
FROM (SELECT DISTINCT id, file_id, start_line FROM definitions) m JOIN (SELECT DISTINCT id, file_id, start_line, end_line FROM definitions) c ON c.file_id = m.file_id AND m.start_line BETWEEN c.start_line AND c.end_line) WHERE n = 1""")
def j5_innermost_definition(spark, d):
    r = _ranges(spark, d)
    points = r.select(F.col("id").alias("point_id"), F.col("file_id").alias("file"), F.col("start_line").alias("at"))
    return V.containing(points, r.select(F.col("id").alias("definition_id"), F.col("file_id").alias("file"), "start_line", "end_line"), F.col("at"), innermost=True).select("point_id", "definition_id")


@query("""WITH s AS (SELECT file_id, start_line - 1 AS line, count(DISTINCT name) AS n, min(name) AS symbol FROM definitions GROUP BY ALL)
SELECT DISTINCT d.id AS definition_id, s.symbol FROM definitions d JOIN s ON s.file_id = d.file_id AND s.line = d.start_line - 1 WHERE s.n = 1""")
def j6_unique_symbols(spark, d):
    r = _ranges(spark, d)
    lines = r.select(F.col("file_id").alias("file"), (F.col("start_line") - 1).alias("line"), F.col("name").alias("symbol"))
    return V.unique_symbol_definitions(r.select(F.col("id").alias("definition_id"), F.col("file_id").alias("file"), "start_line"), lines).distinct()


_OWNERS = "(SELECT DISTINCT p.id AS owner_id, CASE WHEN p.path = '.' THEN r.repo_slug ELSE r.repo_slug || '/' || p.path END AS dir FROM packages p JOIN repositories r ON r.id = p.repository_id)"


@query(f"""WITH m AS (SELECT f.file_path AS path, o.owner_id, row_number() OVER (PARTITION BY f.file_path ORDER BY length(o.dir) DESC, o.owner_id) AS n
FROM (SELECT DISTINCT file_path FROM files) f LEFT JOIN {_OWNERS} o ON starts_with(f.file_path, o.dir || '/')) SELECT path, owner_id FROM m WHERE n = 1""")
def j7_owning_package(spark, d):
    repos = table(spark, d, "repositories", "id", "repo_slug").select(F.col("id").alias("repository_id"), "repo_slug")
    owners = table(spark, d, "packages", "id", "repository_id", "path").distinct().join(repos, "repository_id")
    owners = owners.select(F.col("id").alias("owner_id"), F.when(F.col("path") == ".", F.col("repo_slug")).otherwise(F.concat_ws("/", "repo_slug", "path")).alias("dir"))
    return V.longest_prefix(table(spark, d, "files", "file_path").select(F.col("file_path").alias("path")), owners)


_NORM = r"""ltrim(list_reduce(list_prepend('', list_filter(string_split(replace(trim(i.resolved_file_path), '\', '/'), '/'), lambda p: trim(p) NOT IN ('', '.'))), lambda a, p: CASE WHEN p = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || p END), '/')"""
_EDGES = f"(SELECT DISTINCT i.file_id AS src, f.id AS dst FROM imports i JOIN files f ON f.file_path = {_NORM} WHERE NOT coalesce(i.is_external, false) AND i.file_id <> f.id)"
_REFS = f"""(WITH x AS (SELECT DISTINCT i.id AS point_id, i.file_id AS file, i.id % 40 + 1 AS line, f.id AS target_file FROM imports i JOIN files f ON f.file_path = {_NORM} WHERE NOT coalesce(i.is_external, false) AND i.file_id <> f.id),
r AS (SELECT DISTINCT id, file_id, start_line, end_line FROM definitions), m AS (SELECT file_id, min(start_line) AS line FROM r GROUP BY ALL),
t AS (SELECT m.file_id, min(r.id) AS id FROM m JOIN r ON r.file_id = m.file_id AND m.line BETWEEN r.start_line AND r.end_line GROUP BY ALL)
SELECT DISTINCT r.id AS src, t.id AS dst FROM x JOIN r ON r.file_id = x.file AND x.line BETWEEN r.start_line AND r.end_line JOIN t ON t.file_id = x.target_file WHERE r.id <> t.id)"""


def _edges(spark, d):
    return V.import_edges(table(spark, d, "imports", "file_id", "resolved_file_path", "is_external"), table(spark, d, "files", "id", "file_path"))


def _targets(spark, d):
    """Occurrences: an import uses the symbol of a file at one of the first forty lines; the symbol is defined at the file's first definition."""
    files = table(spark, d, "files", "id", "file_path").distinct()
    inner = table(spark, d, "imports", "id", "file_id", "resolved_file_path", "is_external").filter(~F.coalesce(F.col("is_external"), F.lit(False)) & F.col("resolved_file_path").isNotNull())
    uses = inner.select(P.normalize_path(F.col("resolved_file_path")).alias("symbol"), F.col("file_id").alias("file"), F.lit(0).alias("role_bits"), (F.col("id") % 40).alias("start_line"), F.col("file_id").alias("doc_order"), F.col("id").alias("pos")).distinct()
    first = table(spark, d, "definitions", "file_id", "start_line").groupBy("file_id").agg(F.min("start_line").alias("line"))
    defs = files.join(first, files["id"] == first["file_id"]).select(F.col("file_path").alias("symbol"), F.col("id").alias("file"), F.lit(1).alias("role_bits"), (F.col("line") - 1).alias("start_line"), F.col("id").alias("doc_order"), F.lit(0).cast("bigint").alias("pos"))
    where = V.symbol_definitions(defs, defs.select("file", "symbol"))
    return V.occurrence_targets(uses, where).withColumn("point_id", F.col("pos")).withColumn("start_line_0", F.col("start_line"))


def _references(spark, d):
    ranges = table(spark, d, "definitions", "id", "file_id", "start_line", "end_line").distinct().select(F.col("id").alias("definition_id"), F.col("file_id").alias("file"), "start_line", "end_line")
    return V.references(_targets(spark, d), ranges).select(F.col("source_definition_id").alias("src"), F.col("target_definition_id").alias("dst"))


@query(f"SELECT f.id AS to_file, x.file_id AS from_file, f.file_path AS symbol FROM (SELECT DISTINCT i.id, i.file_id, {_NORM} AS key FROM imports i WHERE NOT coalesce(i.is_external, false) AND i.resolved_file_path IS NOT NULL) x JOIN (SELECT DISTINCT id, file_path FROM files WHERE id IN (SELECT file_id FROM definitions)) f ON f.file_path = x.key WHERE f.id <> x.file_id")
def g14_symbol_edges(spark, d):
    return V.file_symbol_edges(_targets(spark, d))


@query(f"SELECT x.id AS point_id, f.id IS NULL AS is_external FROM (SELECT DISTINCT i.id, {_NORM} AS key FROM imports i WHERE NOT coalesce(i.is_external, false) AND i.resolved_file_path IS NOT NULL) x LEFT JOIN (SELECT DISTINCT id, file_path FROM files WHERE id IN (SELECT file_id FROM definitions)) f ON f.file_path = x.key")
def j3_external_occurrences(spark, d):
    return _targets(spark, d).select("point_id", "is_external")


@query(f"SELECT src, dst FROM {_REFS}")
def g15_references(spark, d):
    return _references(spark, d)


@query(f"SELECT DISTINCT a.file_id AS src, b.file_id AS dst FROM {_REFS} e JOIN definitions a ON a.id = e.src JOIN definitions b ON b.id = e.dst WHERE a.file_id <> b.file_id")
def j8_file_edges_of_references(spark, d):
    return V.file_edges(_references(spark, d), table(spark, d, "definitions", "id", "file_id"))


@query(f"""WITH e AS {_EDGES}, f AS (SELECT DISTINCT id, file_path, language FROM files), n AS (SELECT DISTINCT id, file_id FROM definitions)
SELECT f.id, f.file_path, f.language, (SELECT count(*) FROM n WHERE n.file_id = f.id) AS n_definitions,
coalesce(array_to_string((SELECT list(DISTINCT g.file_path ORDER BY g.file_path) FROM e JOIN f g ON g.id = e.dst WHERE e.src = f.id), ' '), '') AS dependencies,
coalesce(array_to_string((SELECT list(DISTINCT g.file_path ORDER BY g.file_path) FROM e JOIN f g ON g.id = e.src WHERE e.dst = f.id), ' '), '') AS dependents FROM f""")
def j9_file_details(spark, d):
    details = R.file_details(table(spark, d, "files", "id", "file_path", "language"), table(spark, d, "definitions", "id", "file_id", "name", "definition_type", "start_line"), _edges(spark, d))
    return details.select("id", "file_path", "language", F.size("definitions").cast("bigint").alias("n_definitions"), F.array_join("dependencies", " ").alias("dependencies"), F.array_join("dependents", " ").alias("dependents"))


@query(f"""WITH e AS {_REFS}, d AS (SELECT DISTINCT id, name, file_id FROM definitions), f AS (SELECT DISTINCT id, file_path FROM files)
SELECT d.id, d.name, f.file_path, coalesce(array_to_string(o.l, ' '), '') AS dependencies, coalesce(array_to_string(i.l, ' '), '') AS dependents FROM d LEFT JOIN f ON f.id = d.file_id
LEFT JOIN (SELECT e.src, list(DISTINCT g.name ORDER BY g.name) AS l FROM e JOIN d g ON g.id = e.dst GROUP BY ALL) o ON o.src = d.id
LEFT JOIN (SELECT e.dst, list(DISTINCT g.name ORDER BY g.name) AS l FROM e JOIN d g ON g.id = e.src GROUP BY ALL) i ON i.dst = d.id""")
def j10_definition_details(spark, d):
    details = R.definition_details(table(spark, d, "definitions", "id", "name", "file_id"), table(spark, d, "files", "id", "file_path"), _references(spark, d))
    return details.select("id", "name", "file_path", F.array_join("dependencies", " ").alias("dependencies"), F.array_join("dependents", " ").alias("dependents"))


@query("SELECT DISTINCT f.package_id AS src, i.target_package_id AS dst FROM imports i JOIN files f ON f.id = i.file_id WHERE i.target_package_id IN (SELECT id FROM packages) AND f.package_id <> i.target_package_id")
def j12_package_dependencies(spark, d):
    known = table(spark, d, "packages", "id").select(F.col("id").alias("dst")).distinct()
    home = table(spark, d, "files", "id", "package_id").select(F.col("id").alias("file_id"), F.col("package_id").alias("src")).distinct()
    wanted = table(spark, d, "imports", "file_id", "target_package_id").filter("target_package_id IS NOT NULL").select("file_id", F.col("target_package_id").alias("dst")).distinct()
    return wanted.join(known, "dst", "left_semi").join(home, "file_id").filter("src <> dst").select("src", "dst").distinct()


@query("SELECT DISTINCT id FROM files WHERE id NOT IN (SELECT file_id FROM definitions WHERE file_id IS NOT NULL)")
def j14_files_without_definitions(spark, d):
    return table(spark, d, "files", "id").distinct().join(table(spark, d, "definitions", "file_id").select(F.col("file_id").alias("id")), "id", "left_anti")


@query("SELECT DISTINCT d.id, d.name, f.file_path, p.name AS package FROM definitions d LEFT JOIN files f ON f.id = d.file_id LEFT JOIN packages p ON p.id = f.package_id")
def j15_definitions_with_homes(spark, d):
    f = table(spark, d, "files", "id", "file_path", "package_id").distinct().withColumnRenamed("id", "file_id")
    p = table(spark, d, "packages", "id", "name").distinct().select(F.col("id").alias("package_id"), F.col("name").alias("package"))
    return table(spark, d, "definitions", "id", "name", "file_id").distinct().join(f, "file_id", "left").join(p, "package_id", "left").select("id", "name", "file_path", "package")


# -- aggregates -----------------------------------------------------------------------------------------------------------
@query("""SELECT (SELECT count(DISTINCT id) FROM files) AS files, (SELECT count(DISTINCT id) FROM files WHERE ai_summary <> '') AS files_with_summary,
(SELECT count(DISTINCT id) FROM definitions) AS definitions, (SELECT count(DISTINCT id) FROM definitions WHERE ai_summary <> '') AS definitions_with_summary""")
def a1_summary_counts(spark, d):
    return R.summary_statistics(table(spark, d, "files", "id", "ai_summary"), table(spark, d, "definitions", "id", "ai_summary"))


@query("SELECT count(*) AS total, count(*) FILTER (label % 2 = 0) AS files, count(*) FILTER (label % 2 = 1) AS definitions FROM embeddings")
def a2_embedding_counts(spark, d):
    kind = F.when(F.col("label") % 2 == 0, "file").otherwise("definition")
    return R.embedding_statistics(table(spark, d, "embeddings", "label").select(kind.alias("entity_type")))


@query(f"SELECT src, count(*) AS n_targets, min(dst) AS first_target FROM {_EDGES} GROUP BY ALL")
def a4_targets_per_file(spark, d):
    return _edges(spark, d).groupBy("src").agg(F.count("*").alias("n_targets"), F.min("dst").alias("first_target"))


@query("SELECT name AS symbol, arg_min(display, (doc_order, pos)) AS display_name FROM (SELECT DISTINCT name, definition_type || ' ' || name AS display, file_id AS doc_order, start_line AS pos FROM definitions) GROUP BY name")
def a5_first_name(spark, d):
    rows = table(spark, d, "definitions", "name", "definition_type", "file_id", "start_line").distinct()
    return V.symbol_names(rows.select(F.col("name").alias("symbol"), F.concat_ws(" ", "definition_type", "name").alias("display_name"), F.col("file_id").alias("doc_order"), F.col("start_line").alias("pos")))


_OCC = "(SELECT DISTINCT name AS symbol, file_id AS file, start_line - 1 AS start_line, file_id AS doc_order, start_line AS pos, is_exported FROM definitions)"


def _occurrences(spark, d):
    rows = table(spark, d, "definitions", "name", "file_id", "start_line", "is_exported").distinct()
    return rows.select(F.col("name").alias("symbol"), F.col("file_id").alias("file"), F.lit(1).alias("role_bits"), (F.col("start_line") - 1).alias("start_line"), F.col("file_id").alias("doc_order"), F.col("start_line").alias("pos"), "is_exported")


@query(f"""SELECT symbol, file, start_line AS line FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY (CASE WHEN declares THEN 0 ELSE 1 END), doc_order, pos) AS n
FROM (SELECT o.*, EXISTS (SELECT 1 FROM {_OCC} s WHERE s.is_exported AND s.file = o.file AND s.symbol = o.symbol) AS declares FROM {_OCC} o)) WHERE n = 1""")
def a6_symbol_definitions(spark, d):
    occ = _occurrences(spark, d)
    return V.symbol_definitions(occ, occ.filter("is_exported"))


@query(f"SELECT entity_type, entity_id, min(distance) AS distance FROM (SELECT * FROM {_HITS} UNION ALL SELECT entity_type, entity_id, distance + 1 FROM {_HITS}) GROUP BY ALL")
def a7_best_per_entity(spark, d):
    h = _hits(spark, d)
    return S.best_per_entity(h.withColumn("source_order", F.lit(0)).unionByName(h.withColumn("distance", F.col("distance") + 1).withColumn("source_order", F.lit(1)))).drop("source_order")


@query(f"SELECT count(*) AS n_results, max(1.0 / (1 + distance)) AS max_similarity, min(1.0 / (1 + distance)) AS min_similarity FROM {_HITS}")
def a8_result_statistics(spark, d):
    return S.result_statistics(_hits(spark, d))


@query("SELECT file_id, array_to_string(list(name ORDER BY start_line, id), ' ') AS names, count(*) AS n FROM (SELECT DISTINCT id, file_id, name, start_line FROM definitions) GROUP BY ALL")
def a3_names_per_file(spark, d):
    rows = table(spark, d, "definitions", "id", "file_id", "name", "start_line").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("start_line", "id", "name")))
    return rows.groupBy("file_id").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), " ").alias("names"), F.count("*").alias("n"))


@query(f"SELECT DISTINCT i.file_id AS from_file, f.id AS to_file, i.specifier FROM imports i JOIN files f ON f.file_path = {_NORM} WHERE NOT coalesce(i.is_external, false)")
def a9_distinct_targets(spark, d):
    target = table(spark, d, "files", "id", "file_path").select(F.col("id").alias("to_file"), F.col("file_path").alias("key")).distinct()
    inner = table(spark, d, "imports", "file_id", "specifier", "resolved_file_path", "is_external").filter(~F.coalesce(F.col("is_external"), F.lit(False)))
    return inner.select(F.col("file_id").alias("from_file"), "specifier", P.normalize_path(F.col("resolved_file_path")).alias("key")).distinct().join(target, "key").select("from_file", "to_file", "specifier").distinct()


@query("SELECT change, count(*) AS n FROM file_delta GROUP BY ALL")
def a11_delta_rollup(spark, d):
    return D.delta_rollup(table(spark, d, "file_delta", "change"))


_WORDS = r"len(list_filter(regexp_split_to_array(coalesce({0}, ''), '[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x0B]+'), lambda x: x <> ''))"


@query(f"""SELECT f.id AS file_id, coalesce(n.n, 0) AS n_definitions, {_WORDS.format("f.file_content")} * 4 // 3 + 60 * coalesce(n.n, 0) AS input_tokens, 180 AS output_tokens
FROM (SELECT DISTINCT id, file_content FROM files) f LEFT JOIN (SELECT file_id, count(DISTINCT id) AS n FROM definitions GROUP BY ALL) n ON n.file_id = f.id""")
def a13_token_budget(spark, d):
    return R.token_budget(table(spark, d, "files", "id", "file_content"), table(spark, d, "definitions", "id", "file_id"))


@query("""SELECT repository_id, arg_min(id, (CASE WHEN is_workspace_root THEN 0 ELSE 1 END, CASE WHEN path IN ('.', '', '/') THEN 0 ELSE len(string_split(path, '/')) END, path, id)) AS package_id FROM packages GROUP BY ALL""")
def a14_workspace_root(spark, d):
    return R.workspace_root(table(spark, d, "packages", "id", "repository_id", "path", "is_workspace_root"))


# -- order and sets -------------------------------------------------------------------------------------------------------
@query("SELECT id, file_path, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created FROM (SELECT DISTINCT id, file_path, created_at FROM files) ORDER BY created_at DESC, id OFFSET 20 LIMIT 50")
def o3_page_by_time(spark, d):
    paged = R.page(table(spark, d, "files", "id", "file_path", "created_at").distinct(), F.desc("created_at"), "id", limit=50, offset=20)
    return paged.select("id", "file_path", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("SELECT user_id AS conv_id, event_id AS turn, event_type AS role FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 10")
def o6_recent_messages(spark, d):
    m = table(spark, d, "events", "user_id", "event_id", "event_type").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.col("event_type").alias("role"))
    return C.recent(m)


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def o7_latest_per_user(spark, d):
    return C.latest(table(spark, d, "events", "user_id", "event_id", "ts"), "user_id", "ts", "event_id")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def o8_top_k(spark, d):
    return S.top(table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice"), 100, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")


@query("SELECT path FROM (SELECT path FROM file_delta UNION SELECT file_path FROM files)")
def u2_union(spark, d):
    return table(spark, d, "file_delta", "path").union(table(spark, d, "files", "file_path")).distinct()


@query("SELECT file_path AS path FROM files EXCEPT SELECT path FROM file_delta")
def u3_difference(spark, d):
    return table(spark, d, "files", "file_path").select(F.col("file_path").alias("path")).subtract(table(spark, d, "file_delta", "path"))


@query("SELECT file_path AS path FROM files INTERSECT SELECT path FROM file_delta")
def u4_intersection(spark, d):
    return table(spark, d, "files", "file_path").select(F.col("file_path").alias("path")).intersect(table(spark, d, "file_delta", "path"))


# -- graphs ---------------------------------------------------------------------------------------------------------------
@query(f"SELECT count(*) AS n_nodes, (SELECT count(*) FROM {_REFS}) AS n_edges FROM (SELECT src AS n FROM {_REFS} UNION SELECT dst FROM {_REFS})")
def g1_definition_graph(spark, d):
    refs = _references(spark, d).select(F.col("src").alias("source_definition_id"), F.col("dst").alias("target_definition_id"))
    nodes, edges = G.definition_graph(table(spark, d, "definitions", "id", "file_id", "definition_type", "name"), refs, table(spark, d, "files", "id", "file_path"), remove_isolated=True)
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("n_edges"))))


@query(f"SELECT src, dst FROM {_EDGES}")
def g2_file_graph(spark, d):
    return _edges(spark, d)


_SEEDS = "(SELECT DISTINCT id FROM files WHERE file_path IN (SELECT path FROM file_delta WHERE change IN ('added', 'modified', 'renamed')))"


@query(f"SELECT id AS node, 'file' AS kind FROM {_SEEDS} UNION ALL SELECT DISTINCT d.id, 'definition' FROM definitions d JOIN {_SEEDS} s ON s.id = d.file_id")
def g3_seeds(spark, d):
    return G.seeds_from_delta(table(spark, d, "file_delta", "path", "change"), table(spark, d, "files", "id", "file_path"), table(spark, d, "definitions", "id", "file_id"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2),
c AS (SELECT 7 AS node UNION SELECT 12 UNION SELECT e.src FROM e JOIN c ON e.dst = c.node) SELECT node FROM c""")
def g4_reverse_closure(spark, d):
    return G.reverse_closure(_part_edges(spark, d), spark.createDataFrame([(7,), (12,)], "node bigint")).select("node")


@query(f"WITH RECURSIVE e AS MATERIALIZED {_EDGES}, c AS (SELECT id AS node FROM {_SEEDS} UNION SELECT e.src FROM e JOIN c ON e.dst = c.node) SELECT node FROM c")
def g5_file_closure(spark, d):
    seeds = g3_seeds(spark, d).filter("kind = 'file'").select("node")
    return G.reverse_closure(_edges(spark, d), seeds).select("node")


def _part_edges(spark, d):
    p = table(spark, d, "part", "p_partkey")
    halves = p.filter("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    return halves.union(p.filter("p_partkey > 2").select("p_partkey", F.expr("p_partkey div 3"))).distinct()


_STRONG = f"""WITH RECURSIVE e AS MATERIALIZED {_EDGES}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT node AS a, node AS b FROM n UNION SELECT c.a, e.dst FROM c JOIN e ON e.src = c.b),
s AS (SELECT x.a AS node, max(x.b) AS component FROM c x JOIN c y ON y.a = x.b AND y.b = x.a GROUP BY ALL)"""


@query(f"{_STRONG} SELECT node, component FROM s")
def g6_strong_components(spark, d):
    return G.strongly_connected(_edges(spark, d))


@query(f"{_STRONG} SELECT DISTINCT p.component AS src, q.component AS dst FROM e JOIN s p ON p.node = e.src JOIN s q ON q.node = e.dst WHERE p.component <> q.component")
def g7_condensation(spark, d):
    edges = _edges(spark, d)
    return G.condensation(edges, G.strongly_connected(edges))


_PART_LEVELS = """WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2),
l AS (SELECT p_partkey AS node, 0 AS level FROM part UNION SELECT e.src, l.level + 1 FROM e JOIN l ON e.dst = l.node), m AS (SELECT node, max(level) AS level FROM l GROUP BY ALL)"""


@query(_PART_LEVELS + " SELECT node, node AS component, level FROM m")
def g8_levels(spark, d):
    nodes = table(spark, d, "part", "p_partkey").select(F.col("p_partkey").alias("node"))
    return G.levels(nodes, _part_edges(spark, d))


@query(f"""{_STRONG}, k AS MATERIALIZED (SELECT DISTINCT p.component AS src, q.component AS dst FROM e JOIN s p ON p.node = e.src JOIN s q ON q.node = e.dst WHERE p.component <> q.component),
l AS (SELECT component AS node, 0 AS level FROM s UNION SELECT k.src, l.level + 1 FROM k JOIN l ON k.dst = l.node)
SELECT f.id AS node, coalesce(s.component, f.id) AS component, coalesce(max(l.level), 0) AS level FROM (SELECT DISTINCT id FROM files) f LEFT JOIN s ON s.node = f.id LEFT JOIN l ON l.node = s.component GROUP BY ALL""")
def g8_levels_of_files(spark, d):
    return G.levels(table(spark, d, "files", "id").select(F.col("id").alias("node")), _edges(spark, d))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2),
c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst)
SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM e f JOIN c ON c.src = f.dst WHERE f.src = e.src AND c.dst = e.dst)""")
def g9_transitive_reduction(spark, d):
    return G.transitive_reduction(_part_edges(spark, d))


@query(_PART_LEVELS + " SELECT node, node AS component, dense_rank() OVER (ORDER BY level) - 1 AS level FROM m WHERE node IN (SELECT p_partkey FROM part WHERE p_size <= 10)")
def g10_allowed_levels(spark, d):
    nodes = table(spark, d, "part", "p_partkey").select(F.col("p_partkey").alias("node"))
    return G.filter_levels(G.levels(nodes, _part_edges(spark, d)), table(spark, d, "part", "p_partkey", "p_size").filter("p_size <= 10").select(F.col("p_partkey").alias("node")))


@query(_PART_LEVELS + " SELECT level, count(*) AS n_nodes, count(*) AS n_components, CAST(sum(p_size) AS BIGINT) AS tokens, CAST(max(p_size) AS BIGINT) AS largest FROM m JOIN part ON p_partkey = node GROUP BY ALL")
def a10_level_statistics(spark, d):
    parts = table(spark, d, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("bigint").alias("tokens"))
    return R.level_totals(G.levels(parts.select("node"), _part_edges(spark, d)), parts)


@query(f"WITH e AS {_EDGES}, c AS (SELECT DISTINCT id FROM files WHERE language = 'python') SELECT id AS centre, id AS node, 'centre' AS role FROM c UNION SELECT src, dst, 'depends on' FROM e WHERE src IN (SELECT id FROM c) UNION SELECT dst, src, 'is used by' FROM e WHERE dst IN (SELECT id FROM c)")
def g12_neighbours(spark, d):
    return G.neighbours(_edges(spark, d), table(spark, d, "files", "id", "language").filter("language = 'python'").select(F.col("id").alias("node")))


@query(f"WITH e AS {_EDGES}, c AS (SELECT DISTINCT id FROM files) SELECT id AS centre, id AS node, 'centre' AS role FROM c UNION SELECT src, dst, 'depends on' FROM e WHERE src IN (SELECT id FROM c) UNION SELECT dst, src, 'is used by' FROM e WHERE dst IN (SELECT id FROM c)")
def g12_neighbours_of_all_files(spark, d):
    return G.neighbours(_edges(spark, d), table(spark, d, "files", "id").select(F.col("id").alias("node")))


@query("""WITH f AS (SELECT DISTINCT id, file_path, string_split(file_path, '/') AS p FROM files), r AS (SELECT id, p, unnest(range(1, len(p) + 1)) AS depth FROM f)
SELECT array_to_string(p[1:depth], '/') AS path, CASE WHEN depth > 1 THEN array_to_string(p[1:depth - 1], '/') END AS parent, p[depth] AS name, depth, max(CASE WHEN depth = len(p) THEN id END) AS file_id FROM r GROUP BY ALL""")
def g13_file_tree(spark, d):
    return G.file_tree(table(spark, d, "files", "id", "file_path"))


@query("WITH RECURSIVE e AS MATERIALIZED " + _EDGES + ", n AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), c AS (SELECT a AS node, a AS r FROM n UNION SELECT n.b, c.r FROM c JOIN n ON n.a = c.node) SELECT node, min(r) AS component FROM c GROUP BY ALL")
def g_connected_components(spark, d):
    return G.connected_components(_edges(spark, d))


# -- incremental ----------------------------------------------------------------------------------------------------------
_SNAPSHOTS = """f AS (SELECT DISTINCT file_path AS path, sha256(coalesce(file_content, '')) AS h, sha256(coalesce(file_content, '') || '#') AS h0 FROM files),
o AS (SELECT path, min(h) AS h FROM (
  SELECT path, CASE WHEN path IN (SELECT path FROM file_delta WHERE change = 'modified') THEN h0 ELSE h END AS h FROM f WHERE path NOT IN (SELECT path FROM file_delta WHERE change IN ('added', 'renamed'))
  UNION ALL SELECT r.old_path, f.h FROM file_delta r JOIN f ON f.path = r.path WHERE r.change = 'renamed' AND r.old_path NOT IN (SELECT path FROM f)
  UNION ALL SELECT path, sha256(path) FROM file_delta WHERE change = 'deleted' AND path NOT IN (SELECT path FROM f)) GROUP BY ALL)"""


def _snapshots(spark, d):
    """The tree as it is, and as it was before the changes of file_delta."""
    body = F.coalesce("file_content", F.lit(""))
    now = table(spark, d, "files", "file_path", "file_content").select(F.col("file_path").alias("path"), F.sha2(body, 256).alias("content_hash"), F.sha2(F.concat(body, F.lit("#")), 256).alias("other")).distinct()
    delta = table(spark, d, "file_delta", "path", "change", "old_path")
    fresh = delta.filter("change IN ('added', 'renamed')").select("path")
    modified = delta.filter("change = 'modified'").select("path", F.lit(True).alias("_m")).distinct()
    kept = now.join(fresh, "path", "left_anti").join(modified, "path", "left").select("path", F.when(F.col("_m"), F.col("other")).otherwise(F.col("content_hash")).alias("content_hash"))
    moved = delta.filter("change = 'renamed'").join(now, "path").select(F.col("old_path").alias("path"), "content_hash")
    gone = delta.filter("change = 'deleted'").select("path", F.sha2("path", 256).alias("content_hash"))
    before = kept.unionByName(moved.unionByName(gone).join(now.select("path"), "path", "left_anti"))
    return before.groupBy("path").agg(F.min("content_hash").alias("content_hash")), now.select("path", "content_hash")


@query(f"""WITH {_SNAPSHOTS}, g AS (SELECT path, h, row_number() OVER (PARTITION BY h ORDER BY path) AS k FROM o WHERE path NOT IN (SELECT path FROM f)),
a AS (SELECT path, h, row_number() OVER (PARTITION BY h ORDER BY path) AS k FROM f WHERE path NOT IN (SELECT path FROM o)), m AS (SELECT a.path, g.path AS old_path FROM a JOIN g ON g.h = a.h AND g.k = a.k)
SELECT * FROM (SELECT path, 'renamed' AS change, old_path FROM m UNION ALL SELECT f.path, 'modified', NULL FROM f JOIN o ON o.path = f.path WHERE o.h <> f.h
UNION ALL SELECT path, 'added', NULL FROM a WHERE path NOT IN (SELECT path FROM m) UNION ALL SELECT path, 'deleted', NULL FROM g WHERE path NOT IN (SELECT old_path FROM m)) WHERE regexp_matches(lower(path), '[.](js|jsx|ts|tsx|py)$')""")
def i1_file_changes(spark, d):
    return D.file_changes(*_snapshots(spark, d))


_BARE = r"sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(source_code, '\b' || regexp_escape(name) || '\b', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)))"
_NUMBERED = "SELECT file_id AS file, h AS code_hash, row_number() OVER (PARTITION BY file_id, h ORDER BY start_line, id) AS occurrence FROM (SELECT DISTINCT id, file_id, start_line, {0} AS h FROM definitions)"


@query(f"""WITH o AS ({_NUMBERED.format("source_code_hash")}), n AS ({_NUMBERED.format(_BARE)})
SELECT coalesce(o.file, n.file) AS file, coalesce(o.code_hash, n.code_hash) AS code_hash, coalesce(o.occurrence, n.occurrence) AS occurrence, CASE WHEN o.file IS NULL THEN 'added' WHEN n.file IS NULL THEN 'removed' ELSE 'unchanged' END AS change
FROM o FULL JOIN n ON o.file = n.file AND o.code_hash = n.code_hash AND o.occurrence = n.occurrence""")
def i3_definition_changes(spark, d):
    """Stored hashes, some of them stale, against those of the code as it is."""
    rows = table(spark, d, "definitions", "id", "file_id", "name", "source_code", "source_code_hash", "start_line").distinct()
    place = [F.col("file_id").alias("file"), F.struct("start_line", "id").alias("position")]
    stored = rows.select(*place, F.col("source_code_hash").alias("code_hash"))
    return D.definition_changes(stored, rows.select(*place, X.stable_hash(F.col("source_code"), F.col("name")).alias("code_hash")))


@query(f"SELECT DISTINCT d.id AS entity_id FROM definitions d JOIN {_SEEDS} s ON s.id = d.file_id WHERE coalesce(d.ai_summary, '') <> ''")
def i7_ids_to_embed(spark, d):
    seeds = g3_seeds(spark, d).filter("kind = 'definition'").select(F.col("node").alias("id"))
    return R.present(table(spark, d, "definitions", "id", "ai_summary"), "ai_summary").join(seeds, "id", "left_semi").select(F.col("id").alias("entity_id")).distinct()


_LEVELS = f"""{_STRONG}, k AS MATERIALIZED (SELECT DISTINCT p.component AS src, q.component AS dst FROM e JOIN s p ON p.node = e.src JOIN s q ON q.node = e.dst WHERE p.component <> q.component),
l AS (SELECT component AS node, 0 AS level FROM s UNION SELECT k.src, l.level + 1 FROM k JOIN l ON k.dst = l.node),
v AS MATERIALIZED (SELECT f.id AS node, coalesce(s.component, f.id) AS component, coalesce(max(l.level), 0) AS level FROM (SELECT DISTINCT id FROM files) f LEFT JOIN s ON s.node = f.id LEFT JOIN l ON l.node = s.component GROUP BY ALL)"""


@query(f"""{_LEVELS}, h AS (SELECT id AS node FROM {_SEEDS} UNION SELECT e.src FROM e JOIN h ON e.dst = h.node)
SELECT h.node, CASE WHEN h.node IN (SELECT id FROM {_SEEDS}) THEN 'changed' ELSE 'ancestor' END AS phase, v.level FROM h JOIN v ON v.node = h.node""")
def i6_schedule(spark, d):
    edges = _edges(spark, d)
    changed = g3_seeds(spark, d).filter("kind = 'file'").select("node")
    return D.schedule(changed, G.reverse_closure(edges, changed), G.levels(table(spark, d, "files", "id").select(F.col("id").alias("node")), edges))


@query("SELECT o_custkey AS src, min(o_orderkey) AS k FROM orders GROUP BY ALL UNION ALL SELECT s_suppkey, 0 FROM supplier WHERE s_suppkey NOT IN (SELECT o_custkey FROM orders)")
def k2_insert_ignore(spark, d):
    have = table(spark, d, "orders", "o_custkey", "o_orderkey").groupBy(F.col("o_custkey").alias("src")).agg(F.min("o_orderkey").alias("k"))
    return D.insert_ignore(have, table(spark, d, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("src"), F.lit(0).cast("bigint").alias("k")), ["src"])


@query("""SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.name ELSE n.name END AS name, strftime(coalesce(o.created_at, n.created_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created FROM
(SELECT DISTINCT id, name, created_at FROM packages WHERE workspace_type IS NOT NULL) o FULL JOIN (SELECT DISTINCT id, upper(name) AS name, created_at + INTERVAL 1 DAY AS created_at FROM packages WHERE entry_point IS NOT NULL) n ON o.id = n.id""")
def k3_upsert(spark, d):
    p = table(spark, d, "packages", "id", "name", "created_at", "workspace_type", "entry_point").distinct()
    old = p.filter("workspace_type IS NOT NULL").select("id", "name", "created_at")
    return D.upsert(old, p.filter("entry_point IS NOT NULL").select("id", F.upper("name").alias("name"), (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("created_at")), ["id"], ["created_at"]).select("id", "name", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query(f"""WITH gone AS (SELECT path FROM file_delta WHERE change = 'deleted' UNION SELECT file_path FROM files WHERE language IS NULL), f AS (SELECT DISTINCT id FROM files WHERE file_path NOT IN (SELECT path FROM gone)),
d AS (SELECT DISTINCT id FROM definitions WHERE file_id IS NULL OR file_id IN (SELECT id FROM f) OR file_id NOT IN (SELECT id FROM files)), r AS {_REFS}
SELECT r.src AS source_definition_id, CASE WHEN r.dst IN (SELECT id FROM d) THEN r.dst END AS target_definition_id FROM r WHERE r.src IN (SELECT id FROM d)""")
def k5_cascading_delete(spark, d):
    files, defs = table(spark, d, "files", "id", "file_path", "language").distinct(), table(spark, d, "definitions", "id", "file_id").distinct()
    gone = table(spark, d, "file_delta", "path", "change").filter("change = 'deleted'").select("path").union(files.filter("language IS NULL").select("file_path"))
    refs = _references(spark, d).select(F.col("src").alias("source_definition_id"), F.col("dst").alias("target_definition_id"))
    return D.delete_files(files, defs, refs, gone)[2]


@query("SELECT DISTINCT f.id, coalesce(r.path, f.file_path) AS file_path FROM files f LEFT JOIN (SELECT old_path, max(path) AS path FROM file_delta WHERE change = 'renamed' GROUP BY ALL) r ON r.old_path = f.file_path")
def k6_rename(spark, d):
    return D.rename_files(table(spark, d, "files", "id", "file_path").distinct(), table(spark, d, "file_delta", "path", "old_path", "change").filter("change = 'renamed'"))


# -- search ---------------------------------------------------------------------------------------------------------------
_TOKENS = r"regexp_extract_all(lower(strip_accents({0})), '[\p{{L}}\p{{N}}]+')"


def _bm25_sql(base: str, terms: list[str], text: str, prefix: bool = False, k: int = 25) -> str:
    counts = ", ".join(f"len(list_filter(w, lambda x: {'starts_with(x, ' + repr(t) + ')' if prefix and i == len(terms) - 1 else 'x = ' + repr(t)})) AS tf{i}" for i, t in enumerate(terms))
    stats = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean_length))" for i in range(len(terms)))
    return f"""WITH t AS (SELECT id, {_TOKENS.format(text)} AS w FROM {base}), c AS (SELECT id, len(w) AS length, {counts} FROM t), s AS (SELECT count(*) AS n, avg(length) AS mean_length, {stats} FROM c)
SELECT id, round(-({score}), 6) AS rank FROM c, s WHERE {' AND '.join(f'tf{i} > 0' for i in range(len(terms)))} ORDER BY -({score}), id LIMIT {k}"""


def _rounded(ranked, k=25):
    return S.top(ranked, k, "rank", "id").select("id", F.round("rank", 6).alias("rank"))


@query(_bm25_sql("documents_by_id", ["table", "service"], "coalesce(text, '')").replace("documents_by_id", "(SELECT doc_id AS id, text FROM documents)"))
def r3_full_text(spark, d):
    return _rounded(S.bm25(table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text"), "Table service"))


@query(_bm25_sql("(SELECT DISTINCT id, file_path FROM files)", ["src", "index"], "file_path"))
def r4_full_text_paths(spark, d):
    return _rounded(S.bm25(table(spark, d, "files", "id", "file_path").distinct().select("id", F.col("file_path").alias("text")), "src/index"))


@query(_bm25_sql("(SELECT DISTINCT id, name FROM definitions)", ["get", "s"], "name", prefix=True))
def r10_prefix(spark, d):
    return _rounded(S.bm25(table(spark, d, "definitions", "id", "name").distinct().select("id", F.col("name").alias("text")), "get s", prefix=True))


@query("SELECT r.id, n.name, f.file_path, r.rank FROM (" + _bm25_sql("(SELECT DISTINCT id, name FROM definitions)", ["get"], "name") + ") r JOIN (SELECT DISTINCT id, name, file_id FROM definitions) n ON n.id = r.id JOIN (SELECT DISTINCT id, file_path FROM files) f ON f.id = n.file_id")
def j1_hits_with_homes(spark, d):
    names = table(spark, d, "definitions", "id", "name", "file_id").distinct()
    hits = _rounded(S.bm25(names.select("id", F.col("name").alias("text")), "get"))
    return hits.join(names, "id").join(table(spark, d, "files", "id", "file_path").distinct().withColumnRenamed("id", "file_id"), "file_id").select("id", "name", "file_path", "rank")


@query(rf"""SELECT doc_id AS id FROM documents WHERE contains(' ' || array_to_string({_TOKENS.format("coalesce(text, '')")}, ' ') || ' ', ' for the ') AND contains(' ' || array_to_string({_TOKENS.format("coalesce(text, '')")}, ' ') || ' ', ' serv')""")
def r11_phrase_and_prefix(spark, d):
    return S.matching(table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text"), '"for the" AND serv*')


_VECTOR = [round(((i * 37) % 19 - 9) / 30, 4) for i in range(64)]
_NEAREST = f"SELECT CASE WHEN label % 2 = 0 THEN 'file' ELSE 'definition' END AS entity_type, vec_id AS entity_id, list_distance(embedding::DOUBLE[], {_VECTOR}::DOUBLE[]) AS distance FROM embeddings"


def _vectors(spark, d):
    return table(spark, d, "embeddings", "vec_id", "embedding", "label").select(F.when(F.col("label") % 2 == 0, "file").otherwise("definition").alias("entity_type"), F.col("vec_id").alias("entity_id"), "embedding")


@query(f"SELECT entity_type, entity_id, round(distance, 6) AS distance FROM ({_NEAREST}) ORDER BY distance, entity_type, entity_id LIMIT 10")
def r1_nearest(spark, d):
    return S.nearest(_vectors(spark, d), _VECTOR).withColumn("distance", F.round("distance", 6))


@query(f"SELECT entity_type, entity_id, round(distance, 6) AS distance FROM (SELECT * FROM ({_NEAREST}) ORDER BY distance, entity_type, entity_id LIMIT 10) WHERE entity_type = 'file'")
def r2_nearest_of_type(spark, d):
    return S.nearest(_vectors(spark, d), _VECTOR, entity_type="file").withColumn("distance", F.round("distance", 6))


@query("""SELECT query_id, entity_id, round(distance, 5) AS distance, position FROM (SELECT q.vec_id AS query_id, e.vec_id AS entity_id, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), e.vec_id) AS position FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) WHERE position <= 5""")
def r12_nearest_batch(spark, d):
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    queries = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.lit(5).alias("k"))
    return S.nearest_batch(v.select(F.col("vec_id").alias("entity_id"), "embedding"), queries).withColumn("distance", F.round("distance", 5))


def _sources(spark, d):
    near = S.nearest(_vectors(spark, d), _VECTOR, k=30)
    text = S.top(S.bm25(table(spark, d, "definitions", "id", "name").distinct().select("id", F.col("name").alias("text")), "get", prefix=True), 30, "rank", "id")
    return [near, text.select(F.lit("definition").alias("entity_type"), F.col("id").alias("entity_id"), F.col("rank").alias("distance"))]


_SOURCES = f"""v AS (SELECT * FROM ({_NEAREST}) ORDER BY distance, entity_type, entity_id LIMIT 30), t AS (SELECT 'definition' AS entity_type, id AS entity_id, rank AS distance FROM ({_bm25_sql("(SELECT DISTINCT id, name FROM definitions)", ["get"], "name", True, 30)}))"""


@query(f"""WITH {_SOURCES}, u AS (SELECT *, 0 AS source_order FROM v UNION ALL SELECT *, 1 FROM t), m AS (SELECT entity_type, entity_id, min((round(distance, 6), source_order)) AS m FROM u GROUP BY ALL)
SELECT entity_type, entity_id, m[1] AS distance, m[2] AS source_order FROM m ORDER BY m, entity_type, entity_id LIMIT 20""".replace("m[1]", "struct_extract(m, 1)").replace("m[2]", "struct_extract(m, 2)"))
def r5_hybrid(spark, d):
    rounded = [s.withColumn("distance", F.round("distance", 6)) for s in _sources(spark, d)]
    return S.hybrid(rounded, 20)


@query(f"""WITH {_SOURCES}, u AS (SELECT entity_type, entity_id, 1.0 / (60 + row_number() OVER (ORDER BY round(distance, 6), entity_type, entity_id)) AS part FROM v UNION ALL SELECT entity_type, entity_id, 1.0 / (60 + row_number() OVER (ORDER BY round(distance, 6), entity_type, entity_id)) FROM t)
SELECT entity_type, entity_id, round(sum(part), 6) AS score FROM u GROUP BY ALL ORDER BY sum(part) DESC, entity_type, entity_id LIMIT 20""")
def r5_hybrid_by_rank(spark, d):
    rounded = [s.withColumn("distance", F.round("distance", 6)) for s in _sources(spark, d)]
    return S.hybrid_rrf(rounded, 20).withColumn("score", F.round("score", 6))


@query(f"""SELECT entity_type, entity_id, CASE WHEN entity_type = 'file' THEN 'File ' ELSE 'Definition ' END || name || ' (' || format('{{:.1f}}', round(similarity * 100, 1)) || '%) in ' || coalesce(path, '?') || ': ' || coalesce(summary, 'No summary') AS line FROM ({_HYDRATED}) WHERE name IS NOT NULL""")
def r13_rendered(spark, d):
    return S.rendered(j2_hydrated_hits(spark, d))


# -- text -----------------------------------------------------------------------------------------------------------------
@query(r"SELECT DISTINCT id, sha256(regexp_replace(regexp_replace(file_content, '/\*\*(?s:.*?)\*/', '', 'g'), '//[^\n]*', '', 'g')) AS bare FROM files WHERE file_content IS NOT NULL AND language = 'typescript'")
def x1_comments_stripped(spark, d):
    f = table(spark, d, "files", "id", "file_content", "language").filter("file_content IS NOT NULL AND language = 'typescript'")
    return f.select("id", F.sha2(X.strip_comments(F.col("file_content")), 256).alias("bare")).distinct()


@query(r"""SELECT DISTINCT id, sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(source_code, '\b' || regexp_escape(name) || '\b', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))) AS h
FROM definitions""")
def x2_stable_hash(spark, d):
    return table(spark, d, "definitions", "id", "name", "source_code").select("id", X.stable_hash(F.col("source_code"), F.col("name")).alias("h")).distinct()


@query(f"SELECT doc_id, {_WORDS.format('text')} AS words, {_WORDS.format('text')} * 4 // 3 AS tokens FROM documents")
def x3_token_estimate(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.coalesce(X.word_count(F.col("text")), F.lit(0)).cast("bigint").alias("words"), X.token_estimate(F.col("text")).alias("tokens"))


@query(r"SELECT doc_id, regexp_extract(text, '(?s)<gist>(.*?)</gist>', 1) AS short, regexp_extract(text, '(?s)<gist>.*?</gist>(.*)', 1) AS rest FROM documents WHERE regexp_matches(text, '(?s)<gist>.*</gist>')")
def x6_gist(spark, d):
    t = F.col("text")
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", X.gist_short(t).alias("short"), X.gist_full(t).alias("rest")).filter("short IS NOT NULL")


@query(r"SELECT DISTINCT id, 'definition ' || coalesce(name, '') || ': ' || trim(regexp_replace(substring(coalesce(source_code, ''), 1, 100), '[\r\n]+', ' ', 'g')) AS summary FROM definitions")
def x7_placeholder(spark, d):
    return table(spark, d, "definitions", "id", "name", "source_code").select("id", X.placeholder_summary(F.lit("definition"), F.col("name"), F.col("source_code")).alias("summary")).distinct()


@query("SELECT DISTINCT id, name, file_path || '#' AS head FROM (SELECT d.id, regexp_replace(d.name, '[0-9]+$', '') AS name, f.file_path FROM definitions d JOIN files f ON f.id = d.file_id WHERE regexp_matches(d.name, '[^0-9]'))")
def x8_symbols(spark, d):
    f = table(spark, d, "files", "id", "file_path").distinct().withColumnRenamed("id", "file_id")
    symbols = table(spark, d, "definitions", "id", "name", "file_id").distinct().join(f, "file_id").select("id", F.concat("file_path", F.lit("#`"), "name", F.lit("`().")).alias("symbol"))
    return symbols.select("id", X.symbol_name(F.col("symbol")).alias("name"), F.concat(X.container_symbol(F.col("symbol")), F.lit("#")).alias("head")).filter("name IS NOT NULL")


@query("SELECT CASE regexp_extract(lower(file_path), '[.][^./]+$') WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.json' THEN 'json' WHEN '.md' THEN 'markdown' WHEN '.css' THEN 'css' WHEN '.yaml' THEN 'yaml' WHEN '.sql' THEN 'sql' WHEN '.sh' THEN 'bash' ELSE 'unknown' END AS view_language, count(*) AS n FROM (SELECT DISTINCT id, file_path FROM files) GROUP BY ALL")
def x11_view_languages(spark, d):
    f = table(spark, d, "files", "id", "file_path").distinct()
    return f.groupBy(X.language_of(P.extension(F.col("file_path")), X.VIEW_LANGUAGES).alias("view_language")).agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, trim(regexp_extract(text, '(?s)<gist>(.*?)</gist>', 1)) AS message FROM documents WHERE regexp_matches(text, '(?s)<gist>.*?</gist>')")
def x13_tag_contents(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", X.tag_content(F.col("text"), "gist").alias("message")).filter("message IS NOT NULL")


@query("SELECT DISTINCT d.id, md5(array_to_string(string_split(f.file_content, chr(10))[greatest(d.start_line, 1):d.end_line], chr(10))) AS slice FROM definitions d JOIN files f ON f.id = d.file_id WHERE f.file_content IS NOT NULL AND d.start_line <= len(string_split(f.file_content, chr(10)))")
def x10_line_slices(spark, d):
    f = table(spark, d, "files", "id", "file_content").filter("file_content IS NOT NULL").withColumnRenamed("id", "file_id").dropDuplicates(["file_id"])
    defs = table(spark, d, "definitions", "id", "file_id", "start_line", "end_line").distinct()
    joined = defs.join(f, "file_id").filter(F.col("start_line") <= F.size(F.split("file_content", "\n")))
    return joined.select("id", F.md5(X.line_slice(F.col("file_content"), F.col("start_line"), F.col("end_line"))).alias("slice"))


@query(r"""SELECT doc_id, unnest(regexp_extract_all(text, '\[([^\]]+)\]\(file::\d+(?:::definition::\d+)?\)', 1)) AS label FROM documents""".replace("(?:::definition", "(?::definition"))
def x12_citations(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(X.citations(F.col("text"))).alias("c")).select("doc_id", "c.label")


@query(r"SELECT doc_id, CASE WHEN length(b) > 280 THEN rtrim(substring(b, 1, 280)) || '…' ELSE b END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '<[^>]*>', '', 'g')) AS b FROM documents WHERE text IS NOT NULL)")
def x14_preview(spark, d):
    return table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query(r"SELECT DISTINCT id, regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM packages")
def x15_slugs(spark, d):
    return table(spark, d, "packages", "id", "name").select("id", X.slugify(F.col("name")).alias("slug")).distinct()


@query(r"SELECT DISTINCT id, regexp_extract(file_path, '[^/]*$') AS name, regexp_extract(lower(file_path), '[^/]+(\.[^./]+)$', 1) AS extension, CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '' END AS dir FROM files")
def x16_path_parts(spark, d):
    p = F.col("file_path")
    return table(spark, d, "files", "id", "file_path").select("id", P.basename(p).alias("name"), P.extension(p).alias("extension"), P.dirname(p).alias("dir")).distinct()


@query(f"""WITH e AS {_EDGES}, f AS (SELECT DISTINCT id, file_path, '[' || file_path || '](file::' || id || ')' AS c FROM files)
SELECT f.id AS file_id, concat_ws(chr(10), 'File: ' || f.c, 'Definitions: ' || d.l, 'Depends on: ' || o.l, 'Used by: ' || i.l) AS prompt FROM f
LEFT JOIN (SELECT file_id, array_to_string(list(DISTINCT '[' || name || '](file::' || file_id || ':definition::' || id || ')' ORDER BY '[' || name || '](file::' || file_id || ':definition::' || id || ')'), ', ') AS l FROM definitions GROUP BY ALL) d ON d.file_id = f.id
LEFT JOIN (SELECT e.src, array_to_string(list(DISTINCT g.c ORDER BY g.c), ', ') AS l FROM e JOIN f g ON g.id = e.dst GROUP BY ALL) o ON o.src = f.id
LEFT JOIN (SELECT e.dst, array_to_string(list(DISTINCT g.c ORDER BY g.c), ', ') AS l FROM e JOIN f g ON g.id = e.src GROUP BY ALL) i ON i.dst = f.id""")
def x17_prompts(spark, d):
    return H.catalogue(table(spark, d, "files", "id", "file_path"), table(spark, d, "definitions", "id", "file_id", "name"), _edges(spark, d))


@query("SELECT DISTINCT id AS entity_id, concat_ws(' ', ai_summary, name, definition_type) AS text FROM definitions WHERE coalesce(ai_summary, '') <> ''")
def x18_embedding_text(spark, d):
    return H.embedding_text(table(spark, d, "definitions", "id", "ai_summary", "name", "definition_type").distinct())


# -- extraction and folds -------------------------------------------------------------------------------------------------
@query()
def d1_definitions(spark, d):
    return E.extract(table(spark, d, "files", "id", "file_path", "file_content")).distinct()


@query()
def e3_embeddings(spark, d):
    return H.embed(H.embedding_text(table(spark, d, "definitions", "id", "ai_summary", "name", "definition_type").distinct()))


_HEAD = r"trim(regexp_replace(substring(coalesce(f.file_content, ''), 1, 100), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x1C-\x1F]+', ' ', 'g'))"


@query(f"""{_LEVELS}, z AS (SELECT e.src AS node, count(DISTINCT e.dst) AS n FROM e JOIN v p ON p.node = e.src JOIN v q ON q.node = e.dst WHERE p.component <> q.component GROUP BY ALL)
SELECT v.node, v.level, substring(f.file_path || ': ' || {_HEAD}, 1, 120) AS short, f.file_path || ' (' || coalesce(z.n, 0) || ' dependencies): ' || {_HEAD} AS full FROM v JOIN (SELECT DISTINCT id, file_path, file_content FROM files) f ON f.id = v.node LEFT JOIN z ON z.node = v.node""")
def e4_summaries(spark, d):
    edges = _edges(spark, d)
    nodes = table(spark, d, "files", "id", "file_path", "file_content").dropDuplicates(["id"]).select(F.col("id").alias("node"), F.col("file_path").alias("name"), F.col("file_content").alias("text"))
    return H.summarize_levels(nodes, edges, G.levels(nodes, edges))


# -- events and jobs ------------------------------------------------------------------------------------------------------
_JOBS = "(SELECT user_id AS job_id, event_id AS seq, ts, ['queued', 'running', 'succeeded', 'failed'][(event_id % 11) % 4 + 1] AS status, ['cloning', 'parsing', 'graph', 'summaries', 'embeddings'][event_id % 5 + 1] AS phase FROM events)"


def _job_events(spark, d):
    e = table(spark, d, "events", "user_id", "event_id", "ts")
    states, phases = F.array(*[F.lit(s) for s in C.JOB_STATES]), F.array(*[F.lit(p) for p in C.PHASES])
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", F.element_at(states, ((F.col("event_id") % 11) % 4 + 1).cast("int")).alias("status"), F.element_at(phases, (F.col("event_id") % 5 + 1).cast("int")).alias("phase"))


@query(f"""SELECT job_id, status, phase, ts AS updated_at, CASE WHEN status = 'succeeded' THEN 100 ELSE list_position(['cloning', 'parsing', 'graph', 'summaries', 'embeddings'], phase) * 20 END AS percent
FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY (status IN ('succeeded', 'failed')) DESC, ts DESC, seq DESC) AS n FROM {_JOBS}) WHERE n = 1""")
def t1_job_states(spark, d):
    return C.job_states(_job_events(spark, d)).withColumn("percent", C.job_percent(F.col("phase"), F.col("status")))


_STREAM = "(SELECT user_id AS session_id, event_id AS seq, CASE WHEN event_id % 50 = 49 THEN 'complete' WHEN event_id % 9 = 0 THEN 'tool_call' ELSE 'delta' END AS event_type, event_type || ' ' AS delta, value AS seconds FROM events)"


def _stream(spark, d):
    e = table(spark, d, "events", "user_id", "event_id", "event_type", "value")
    kind = F.when(F.col("event_id") % 50 == 49, "complete").when(F.col("event_id") % 9 == 0, "tool_call").otherwise("delta")
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), kind.alias("event_type"), F.concat("event_type", F.lit(" ")).alias("delta"), F.col("value").alias("seconds"))


@query(f"""WITH s AS (SELECT *, max(CASE WHEN event_type = 'complete' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM {_STREAM})
SELECT session_id, coalesce(string_agg(delta, '' ORDER BY seq) FILTER (event_type = 'delta'), '') AS text, count(*) FILTER (event_type = 'tool_call') AS n_tools, coalesce(max(CASE WHEN event_type = 'complete' THEN event_type END), 'streaming') AS state
FROM s WHERE coalesce(ended, 0) = 0 GROUP BY ALL""")
def t3_streamed_texts(spark, d):
    return C.stream_texts(_stream(spark, d))


@query("SELECT session_id, tool_id, ['streaming', 'pending', 'executing', 'completed', 'failed'][max(event_id % 5) + 1] AS status FROM (SELECT user_id AS session_id, event_type AS tool_id, event_id FROM events) GROUP BY ALL")
def t5_tool_states(spark, d):
    names = F.array(*[F.lit(x) for x in ("streaming", "pending", "executing", "completed", "failed")])
    e = table(spark, d, "events", "user_id", "event_type", "event_id").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("tool_id"), F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("status"))
    return C.tool_status(e)


@query(f"SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS call_no, call_no > 2 AS over_budget, seconds > 30 AS timed_out FROM {_STREAM} WHERE event_type = 'tool_call'")
def t6_tool_budget(spark, d):
    return C.over_budget(_stream(spark, d).filter("event_type = 'tool_call'").select("session_id", "seq", "seconds")).drop("seconds")


@query("SELECT id, (row_number() OVER (PARTITION BY file_id ORDER BY id) - 1) % 50 AS position, (row_number() OVER (PARTITION BY file_id ORDER BY id) - 1) // 50 AS batch_no, ((row_number() OVER (PARTITION BY file_id ORDER BY id) - 1) // 50) * (50 / 15.0) AS planned_second FROM (SELECT DISTINCT id, file_id FROM definitions)")
def t7_batches(spark, d):
    return H.batch_plan(table(spark, d, "definitions", "id", "file_id").distinct(), ["id"], keys=["file_id"]).drop("file_id")


_MESSAGES = "(SELECT user_id AS conv_id, event_id AS turn, event_type AS role, props AS text FROM events)"


@query(f"""WITH r AS (SELECT conv_id, turn, CAST(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_chars FROM {_MESSAGES})
SELECT conv_id, turn, running_chars, coalesce(turn >= min(CASE WHEN running_chars >= 120 THEN turn END) OVER (PARTITION BY conv_id), true) AS included FROM r""")
def t9_compaction(spark, d):
    m = table(spark, d, "events", "user_id", "event_id", "props").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.col("props").alias("text"))
    return C.compaction_points(m, 120)


@query("SELECT 'e' || event_id AS delivery_id, 'push' AS event, 'r/' || event_type AS repository, 'b' || user_id AS detail, CAST(json_extract(props, '$.k') AS INT) % 3 AS n_commits, true AS valid FROM events")
def t11_webhooks(spark, d):
    e = table(spark, d, "events", "event_id", "event_type", "user_id", "props")
    n = (F.get_json_object("props", "$.k").cast("int") % 3).cast("int")
    commits = F.array_join(F.array_repeat(F.lit('{"id": "x"}'), n), ",")
    body = F.concat(F.lit('{"ref": "refs/heads/b'), F.col("user_id").cast("string"), F.lit('", "repository": {"full_name": "r/'), "event_type", F.lit('"}, "commits": ['), commits, F.lit("]}"))
    return C.webhook_records(e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("delivery_id"), F.lit("push").alias("event"), body.alias("body")))
