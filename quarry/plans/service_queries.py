"""Search with its grammar and index, nested reads, application tables and request handling, bound to the tables, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import conversation as C
from quarry.operators import delta as D
from quarry.operators import fold as H
from quarry.operators import graph as G
from quarry.operators import relational as R
from quarry.operators import resolve as V
from quarry.operators import search as S
from quarry.operators.text_index import TextIndex
from quarry.plans import corpus_queries as Q
from quarry.plans.config_queries import values
from quarry.session import shared_folder
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


# -- full text ------------------------------------------------------------------------------------------------------------
_W = Q._TOKENS.format("coalesce(text, '')")
_LINE = f"' ' || array_to_string({_W}, ' ') || ' '"


def _documents(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text")


def _has(*words: str) -> list[str]:
    return [f"contains({_LINE}, ' {w} ')" for w in words]


@query(f"SELECT doc_id AS id FROM documents WHERE {' OR '.join(_has('table', 'service'))} OR {' AND '.join(_has('list', 'code'))}")
def r11_or(spark, d):
    return S.matching(_documents(spark, d), "table OR service OR list code")


@query(f"SELECT doc_id AS id FROM documents WHERE {_has('the')[0]} AND NOT {_has('service')[0]} AND ({_has('table')[0]} OR contains({_LINE}, ' serv'))")
def r11_not_and_brackets(spark, d):
    return S.matching(_documents(spark, d), "the NOT service AND (table OR serv*)")


_NEAR = f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM w)
SELECT DISTINCT a.doc_id AS id FROM p a JOIN p b USING (doc_id) WHERE a.word = 'the' AND b.word = 'table' AND greatest(a.i, b.i) - least(a.i, b.i) <= 4"""


@query(_NEAR)
def r11_near(spark, d):
    return S.matching(_documents(spark, d), "NEAR(the table, 3)")


@query(f"SELECT doc_id AS id FROM documents WHERE starts_with({_LINE}, ' the ') OR contains({_LINE}, ' in the ')")
def r11_first_and_joined(spark, d):
    return S.matching(_documents(spark, d), '^the OR in + "the"')


_BROKEN = [("a AND", False), ("a b", True), ('"a', False), ("(a OR b", False), ("NEAR(a b, x)", False), ("OR a", False), ("a-b", False), ("a* NOT \"b c\"", True), ("", False), ("near a", True)]


@query(values([(q, ok) for q, ok in _BROKEN], "query", "ok"))
def r11_broken_queries(spark, d):
    def ok(text):
        try:
            S.parse_query(text)
        except S.QueryError:
            return False
        return True

    return spark.createDataFrame([(q, ok(q)) for q, _ in _BROKEN], "query string, ok boolean")


@query(Q.SQL["r3_full_text"])
def r3_full_text_by_index(spark, d):
    index = TextIndex(spark, shared_folder(spark, "index"))
    index.upsert(_documents(spark, d))
    return Q._rounded(index.bm25("Table service"))


@query(Q._bm25_sql("(SELECT DISTINCT id, name FROM definitions)", ["get", "s"], "name", prefix=True))
def r10_prefix_by_index(spark, d):
    index = TextIndex(spark, shared_folder(spark, "index"))
    index.upsert(table(spark, d, "definitions", "id", "name").distinct().select("id", F.col("name").alias("text")))
    return Q._rounded(index.bm25("get s", prefix=True))


_KEPT = "(SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'table service table' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0)"


def _maintained(spark, d) -> TextIndex:
    """An index that was updated, shortened and merged after it was written."""
    index, documents = TextIndex(spark, shared_folder(spark, "index")), _documents(spark, d)
    index.upsert(documents)
    index.upsert(documents.filter("id % 7 = 0").withColumn("text", F.lit("table service table")))
    index.delete(documents.filter("id % 5 = 0"))
    return index


@query(Q._bm25_sql(_KEPT, ["table", "service"], "coalesce(text, '')", k=60))
def k7_index_after_updates(spark, d):
    return Q._rounded(_maintained(spark, d).bm25("table service"), 60)


@query(Q._bm25_sql(_KEPT, ["table", "service"], "coalesce(text, '')", k=60))
def k7_index_after_merging(spark, d):
    index = _maintained(spark, d)
    index.compact()
    return Q._rounded(index.bm25("table service"), 60)


# -- hits and responses ---------------------------------------------------------------------------------------------------
_PATHS = Q._bm25_sql("(SELECT DISTINCT id, file_path FROM files)", ["src", "index"], "file_path", k=30)


@query(f"""WITH {Q._SOURCES}, p AS (SELECT 'file' AS entity_type, id AS entity_id, rank AS distance FROM ({_PATHS})),
u AS (SELECT *, 0 AS source_order FROM v UNION ALL SELECT *, 1 FROM t UNION ALL SELECT *, 2 FROM p), m AS (SELECT entity_type, entity_id, min((round(distance, 6), source_order)) AS m FROM u GROUP BY ALL)
SELECT entity_type, entity_id, struct_extract(m, 1) AS distance, struct_extract(m, 2) AS source_order FROM m ORDER BY m, entity_type, entity_id LIMIT 60""")
def u1_three_sources(spark, d):
    paths = S.top(S.bm25(table(spark, d, "files", "id", "file_path").distinct().select("id", F.col("file_path").alias("text")), "src/index"), 30, "rank", "id")
    sources = [*Q._sources(spark, d), paths.select(F.lit("file").alias("entity_type"), F.col("id").alias("entity_id"), F.col("rank").alias("distance"))]
    return S.hybrid([s.withColumn("distance", F.round("distance", 6)) for s in sources], 60)


@query("SELECT entity_type, entity_id, 1.0 - 1.0 / (1.0 + distance) AS distance FROM (SELECT entity_type, entity_id, distance FROM " + Q._HITS + ")")
def r15_distance_of_similarity(spark, d):
    return S.one_minus_similarity(Q._hits(spark, d).withColumn("similarity", X.similarity_of(F.col("distance")))).select("entity_type", "entity_id", "distance")


_SHAPED = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS name, CASE WHEN doc_id % 5 > 0 THEN 'd/' || lang END AS path, CASE WHEN doc_id % 2 = 0 THEN created_at END AS created_at, n_chars FROM documents)"


@query(f"SELECT 'file' AS entity_type, doc_id AS entity_id, coalesce(nullif(name, ''), regexp_extract(path, '[^/]*$'), 'unknown') AS name, coalesce(path, '') AS path, strftime(coalesce(created_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created, coalesce(1.0 / nullif(n_chars, 0), 0) AS similarity FROM {_SHAPED}")
def r14_responses(spark, d):
    t = table(spark, d, "documents", "doc_id", "source", "lang", "created_at", "n_chars")
    name = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("source"))
    hits = t.select(F.lit("file").alias("entity_type"), F.col("doc_id").alias("entity_id"), name.alias("name"), F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("d/"), "lang")).alias("path"), F.when(F.col("doc_id") % 2 == 0, F.col("created_at")).alias("created_at"), F.try_divide(F.lit(1.0), "n_chars").alias("similarity"))
    return S.response(hits).withColumn("created", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).drop("created_at")


_MODES = [("semantic", True, "vector"), ("symbol", False, "definitions"), ("path", True, "files"), ("hybrid", True, "vector definitions files"), ("hybrid", False, "definitions files")]


@query(values([*_MODES, ("semantic", False, "error"), ("other", True, "error")], "mode", "has_key", "sources"))
def r6_modes(spark, d):
    def sources(mode, key):
        try:
            return " ".join(S.dispatch(mode, key))
        except ValueError:
            return "error"

    return spark.createDataFrame([(m, k, sources(m, k)) for m, k in [(m, k) for m, k, _ in _MODES] + [("semantic", False), ("other", True)]], "mode string, has_key boolean, sources string")


_REQUESTS = "(SELECT event_id, event_id % 230 AS top_k, user_id % 60 AS \"limit\", event_id % 9 - 1 AS \"offset\", CASE WHEN event_id % 13 > 0 THEN event_type ELSE '' END AS query FROM events)"


@query(f"""SELECT event_id, CASE WHEN top_k NOT BETWEEN 1 AND 200 THEN 'top_k must be 1 to 200' WHEN "limit" NOT BETWEEN 1 AND 50 THEN 'limit must be 1 to 50' WHEN "offset" < 0 THEN 'offset must be 0 or more' WHEN length(coalesce(query, '')) < 1 THEN 'the query is empty' END AS error FROM {_REQUESTS}""")
def f11_request_errors(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    requests = e.select("event_id", (F.col("event_id") % 230).alias("top_k"), (F.col("user_id") % 60).alias("limit"), (F.col("event_id") % 9 - 1).alias("offset"), F.when(F.col("event_id") % 13 > 0, F.col("event_type")).otherwise("").alias("query"))
    return S.request_errors(requests).select("event_id", "error")


# -- nested reads ---------------------------------------------------------------------------------------------------------
_WANTED = "(SELECT DISTINCT src AS id FROM (SELECT f.id AS src FROM files f JOIN file_delta c ON c.path = f.file_path WHERE c.change = 'modified'))"


@query(f"""WITH r AS MATERIALIZED {Q._REFS}, w AS {_WANTED}, d AS (SELECT DISTINCT id, file_id, name, start_line FROM definitions WHERE file_id IN (SELECT id FROM w)), n AS (SELECT DISTINCT id, name FROM definitions),
o AS (SELECT r.src AS id, string_agg(DISTINCT n.name, ',' ORDER BY n.name) AS l FROM r JOIN n ON n.id = r.dst GROUP BY ALL), i AS (SELECT r.dst AS id, string_agg(DISTINCT n.name, ',' ORDER BY n.name) AS l FROM r JOIN n ON n.id = r.src GROUP BY ALL)
SELECT w.id, string_agg(d.name || '>' || coalesce(o.l, '') || '<' || coalesce(i.l, ''), ';' ORDER BY d.start_line, d.id) AS definitions FROM w LEFT JOIN d ON d.file_id = w.id LEFT JOIN o ON o.id = d.id LEFT JOIN i ON i.id = d.id GROUP BY ALL""")
def j9_files_with_references(spark, d):
    files = table(spark, d, "files", "id", "file_path")
    wanted = files.join(table(spark, d, "file_delta", "path", "change").filter("change = 'modified'").select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select("id")
    found = R.files_with_references(wanted, files, table(spark, d, "definitions", "id", "file_id", "name", "definition_type", "start_line"), Q._references(spark, d))
    told = F.transform("definitions", lambda x: F.concat(x["name"], F.lit(">"), F.array_join(x["refers_to"], ","), F.lit("<"), F.array_join(x["referred_by"], ",")))
    return found.select("id", F.array_join(told, ";").alias("definitions"))


@query(f"SELECT src AS definition_id, 'refers to' AS direction, dst AS other_id FROM {Q._REFS} UNION ALL SELECT dst, 'referred by', src FROM {Q._REFS}")
def j9_references_both_ways(spark, d):
    return R.file_references(table(spark, d, "definitions", "id", "file_id", "name"), Q._references(spark, d)).select("definition_id", "direction", "other_id")


@query(f"""WITH h AS ({Q._HYDRATED}), t AS (SELECT * FROM h WHERE name IS NOT NULL ORDER BY similarity DESC, entity_type, entity_id LIMIT 40)
SELECT t.entity_type, t.entity_id, t.name, string_agg(d.name, ',' ORDER BY d.start_line, d.id) AS definitions FROM t LEFT JOIN (SELECT DISTINCT id, file_id, name, start_line FROM definitions) d ON t.entity_type = 'file' AND d.file_id = t.entity_id GROUP BY ALL""")
def j11_hits_with_definitions(spark, d):
    files, definitions = table(spark, d, "files", "id", "file_path", "ai_short_summary"), table(spark, d, "definitions", "id", "file_id", "name", "definition_type", "start_line", "ai_short_summary")
    top = S.by_similarity(S.hydrate(Q._hits(spark, d), files, definitions)).limit(40).select("entity_type", "entity_id", "distance")
    nested = S.hydrate(top, files, definitions, nested=True)
    return S.by_similarity(nested).select("entity_type", "entity_id", "name", F.array_join(F.transform("definitions", lambda x: x["name"]), ",").alias("definitions"))


@query("SELECT language, count(*) AS n, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, CAST(CASE WHEN count(tokens) = 0 THEN 0 ELSE floor(sum(tokens) / count(tokens)) END AS BIGINT) AS average FROM (SELECT DISTINCT id, language, " + Q._WORDS.format("ai_summary") + " * 4 // 3 AS t, ai_summary, CASE WHEN ai_summary IS NOT NULL THEN " + Q._WORDS.format("ai_summary") + " * 4 // 3 END AS tokens FROM files) GROUP BY ALL")
def a12_token_averages(spark, d):
    f = table(spark, d, "files", "id", "language", "ai_summary").distinct().withColumn("tokens", F.when(F.col("ai_summary").isNotNull(), X.token_estimate(F.col("ai_summary"))))
    grouped = f.groupBy("language").agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count("tokens").alias("counted"))
    return grouped.select("language", "n", "tokens", R.integer_average(F.col("tokens"), F.col("counted")).alias("average"))


_COSTS = "(SELECT DISTINCT id AS node, " + Q._WORDS.format("file_content") + " * 4 // 3 AS tokens FROM files)"


@query(f"SELECT node, tokens, tokens / (SELECT sum(tokens) FROM {_COSTS}) AS share FROM {_COSTS} ORDER BY tokens DESC, node LIMIT 10")
def a13_top_consumers(spark, d):
    costs = table(spark, d, "files", "id", "file_content").distinct().select(F.col("id").alias("node"), F.coalesce(X.token_estimate(F.col("file_content")), F.lit(0)).alias("tokens"))
    return R.top_consumers(costs)


@query(Q._PART_LEVELS + " SELECT level, arg_max(node, (p_size, -node)) AS node, CAST(max(p_size) AS BIGINT) AS tokens FROM m JOIN part ON p_partkey = node GROUP BY ALL")
def a13_level_maxima(spark, d):
    parts = table(spark, d, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("bigint").alias("tokens"))
    return R.level_maxima(G.levels(parts.select("node"), Q._part_edges(spark, d)), parts)


@query(f"WITH r AS MATERIALIZED {Q._REFS}, n AS (SELECT src AS node FROM r UNION SELECT dst FROM r) SELECT n.node, d.file_id, d.definition_type, d.name AS label, f.file_path AS title FROM n JOIN (SELECT DISTINCT id, file_id, definition_type, name FROM definitions) d ON d.id = n.node LEFT JOIN (SELECT DISTINCT id, file_path FROM files) f ON f.id = d.file_id")
def g1_graph_nodes(spark, d):
    refs = Q._references(spark, d).select(F.col("src").alias("source_definition_id"), F.col("dst").alias("target_definition_id"))
    return G.definition_graph(table(spark, d, "definitions", "id", "file_id", "definition_type", "name"), refs, table(spark, d, "files", "id", "file_path"), remove_isolated=True)[0]


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS a, p_partkey - p_partkey % 10 + p_partkey % 3 AS b FROM part), n AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c AS (SELECT a AS node, a AS r FROM n UNION SELECT n.b, c.r FROM c JOIN n ON n.a = c.node)
SELECT node + 1152921504606846976 AS node, min(r) + 1152921504606846976 AS component FROM c GROUP BY ALL""")
def g_components_of_large_ids(spark, d):
    """Ids above 2^53, where floating-point numbers would round, by the distributed rounds."""
    base = F.lit(1 << 60)
    p = table(spark, d, "part", "p_partkey")
    return G.connected_components(p.select((F.col("p_partkey") + base).alias("src"), (F.expr("p_partkey - p_partkey % 10 + p_partkey % 3") + base).alias("dst")), small_limit=0)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS a, p_partkey - p_partkey % 10 + p_partkey % 3 AS b FROM part), n AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c AS (SELECT a AS node, a AS r FROM n UNION SELECT n.b, c.r FROM c JOIN n ON n.a = c.node)
SELECT node + 1152921504606846976 AS node, min(r) + 1152921504606846976 AS component FROM c GROUP BY ALL""")
def g_components_of_large_ids_in_one_task(spark, d):
    base = F.lit(1 << 60)
    p = table(spark, d, "part", "p_partkey")
    return G.connected_components(p.select((F.col("p_partkey") + base).alias("src"), (F.expr("p_partkey - p_partkey % 10 + p_partkey % 3") + base).alias("dst")))


@query(f"{Q._STRONG} SELECT node, component FROM s")
def g6_strong_components_in_rounds(spark, d):
    """By the distributed rounds, whatever the size."""
    return G.strongly_connected(Q._edges(spark, d), small_limit=0)


@query(Q._PART_LEVELS + " SELECT node, node AS component, level FROM m")
def g8_levels_in_rounds(spark, d):
    return G.levels(table(spark, d, "part", "p_partkey").select(F.col("p_partkey").alias("node")), Q._part_edges(spark, d), small_limit=0)


@query(Q.SQL["g5_file_closure"])
def g5_file_closure_in_rounds(spark, d):
    seeds = Q.g3_seeds(spark, d).filter("kind = 'file'").select("node")
    return G.reverse_closure(Q._edges(spark, d), seeds, small_limit=0).select("node")


# -- order ----------------------------------------------------------------------------------------------------------------
@query("SELECT id, name FROM (SELECT DISTINCT id, name FROM definitions WHERE starts_with(lower(name), 'get')) ORDER BY id LIMIT 25 OFFSET 10")
def o4_navigation_page(spark, d):
    found = table(spark, d, "definitions", "id", "name").filter(F.startswith(F.lower("name"), F.lit("get"))).distinct()
    return R.page(found, "id", limit=25, offset=10)


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_regionkey DESC, n_nationkey LIMIT 5")
def o5_first_five(spark, d):
    return R.page(table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"), F.desc("n_regionkey"), "n_nationkey", limit=5).drop("n_regionkey")


@query("SELECT id, repo_slug FROM repositories WHERE commit_hash IS NULL ORDER BY id LIMIT 1")
def o10_first_match(spark, d):
    return R.first_match(table(spark, d, "repositories", "id", "repo_slug", "commit_hash"), F.col("commit_hash").isNull(), "id").select("id", "repo_slug")


# -- modes and schedules --------------------------------------------------------------------------------------------------
@query("SELECT id, CASE WHEN commit_hash IS NULL OR commit_hash = '' THEN 'full' WHEN id % 3 = 0 THEN 'none' ELSE 'incremental' END AS mode FROM repositories")
def i2_parse_modes(spark, d):
    r = table(spark, d, "repositories", "id", "commit_hash")
    now = F.when(F.col("id") % 3 == 0, F.col("commit_hash")).otherwise(F.concat(F.col("commit_hash"), F.lit("0")))
    return r.select("id", D.parse_modes(F.col("commit_hash"), now).alias("mode"))


@query("SELECT r.id, CASE WHEN r.id % 7 = 0 OR c.n IS NULL THEN 'full' WHEN c.n = 0 THEN 'none' ELSE 'incremental' END AS mode FROM repositories r LEFT JOIN (SELECT string_split(path, '/')[1] AS repo_slug, count(*) - 1 AS n FROM file_delta GROUP BY ALL) c USING (repo_slug)")
def i5_summary_modes(spark, d):
    n = table(spark, d, "file_delta", "path").groupBy(F.split("path", "/")[0].alias("repo_slug")).agg((F.count("*") - 1).alias("n"))
    return table(spark, d, "repositories", "id", "repo_slug").join(n, "repo_slug", "left").select("id", D.summary_modes(F.col("n"), F.col("id") % 7 == 0).alias("mode"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2),
c AS (SELECT 7 AS node UNION SELECT 12 UNION SELECT e.src FROM e JOIN c ON e.dst = c.node),
l AS (SELECT p_partkey AS node, 0 AS level FROM part UNION SELECT e.src, l.level + 1 FROM e JOIN l ON e.dst = l.node), m AS (SELECT node, max(level) AS level FROM l GROUP BY ALL)
SELECT node, CASE WHEN node IN (7, 12) THEN 'changed' ELSE 'ancestor' END AS phase, level FROM c JOIN m USING (node)""")
def i6_schedule_of_parts(spark, d):
    nodes, edges = table(spark, d, "part", "p_partkey").select(F.col("p_partkey").alias("node")), Q._part_edges(spark, d)
    changed = spark.createDataFrame([(7,), (12,)], "node bigint")
    return D.schedule(changed, G.reverse_closure(edges, changed), G.levels(nodes, edges))


@query("""WITH o AS (SELECT DISTINCT file_path AS path, file_content AS content FROM files WHERE file_content IS NOT NULL), a AS (SELECT 'old/' || path AS old_path, content FROM o),
b AS (SELECT 'new/' || path AS path, CASE WHEN length(content) % 3 = 0 THEN content ELSE content || chr(10) || 'one more line' END AS content FROM o),
x AS (SELECT old_path, unnest(string_split(content, chr(10))) AS line FROM a), y AS (SELECT path, unnest(string_split(content, chr(10))) AS line FROM b),
p AS (SELECT old_path, line, count(*) AS n FROM x GROUP BY ALL), r AS (SELECT path, line, count(*) AS n FROM y GROUP BY ALL),
s AS (SELECT p.old_path, r.path, sum((length(p.line) + 1) * least(p.n, r.n)) AS s FROM p JOIN r ON p.line = r.line GROUP BY ALL)
SELECT s.old_path, s.path, round(s.s / greatest(length(a.content) + 1, length(b.content) + 1), 6) AS similarity FROM s JOIN a USING (old_path) JOIN b USING (path) WHERE s.s >= 0.5 * greatest(length(a.content) + 1, length(b.content) + 1)""")
def i1_similarities(spark, d):
    o = table(spark, d, "files", "id", "file_path", "file_content").filter("file_content IS NOT NULL").select(F.col("file_path").alias("path"), F.col("file_content").alias("content")).distinct()
    edited = F.when(F.length("content") % 3 == 0, F.col("content")).otherwise(F.concat("content", F.lit("\none more line")))
    found = D.similarities(o.withColumn("path", F.concat(F.lit("old/"), "path")), o.select(F.concat(F.lit("new/"), "path").alias("path"), edited.alias("content")), 0.5)
    return found.withColumn("similarity", F.round("similarity", 6))


_MOVED = [("a.py", "one\ntwo\nthree\nfour\n", "b.py", "one\ntwo\nthree\nfive\n", "renamed"), ("c.py", "x = 1\ny = 2\n", "d.py", "nothing\nof the kind\n", None), ("e.py", "same\n", "f.py", "same\n", "renamed"), ("g.py", "kept\n", "g.py", "kept, but not the same\n", "modified")]
_CHANGES = [("b.py", "renamed", "a.py"), ("d.py", "added", None), ("c.py", "deleted", None), ("f.py", "renamed", "e.py"), ("g.py", "modified", None), ("h.py", "added", None)]


@query(values(_CHANGES, "path", "change", "old_path"))
def i1_edited_renames(spark, d):
    def snapshot(rows):
        return spark.createDataFrame(rows, "path string, content string").withColumn("content_hash", F.sha2("content", 256))

    old = snapshot([(a, t) for a, t, *_ in _MOVED])
    new = snapshot([*[(b, t) for _, _, b, t, _ in _MOVED], ("h.py", "same\n")])
    return D.file_changes(old, new, min_similarity=0.5)


# -- application tables ---------------------------------------------------------------------------------------------------
_CONVERSATIONS = "(SELECT c_custkey AS conv_id, c_nationkey AS project_id, c_name AS title FROM customer)"
_CHAT = "(SELECT o_custkey AS conv_id, o_orderkey AS turn, CASE WHEN o_orderkey % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, o_orderpriority AS text FROM orders)"


def _chat(spark, d):
    conversations = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_name").select(F.col("c_custkey").alias("conv_id"), F.col("c_nationkey").alias("project_id"), F.col("c_name").alias("title"))
    messages = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderpriority").select(F.col("o_custkey").alias("conv_id"), F.col("o_orderkey").alias("turn"), F.when(F.col("o_orderkey") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("o_orderpriority").alias("text"))
    return conversations, messages


@query(f"SELECT conv_id, c.title, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM {_CHAT}) m JOIN {_CONVERSATIONS} c USING (conv_id) WHERE n <= 10")
def j16_message_history(spark, d):
    conversations, messages = _chat(spark, d)
    return C.message_history(messages, conversations, 10)


@query(f"SELECT m.conv_id, turn, role FROM {_CHAT} m JOIN {_CONVERSATIONS} c USING (conv_id) WHERE project_id >= 5 UNION ALL SELECT conv_id, turn, role FROM {_CHAT} WHERE conv_id NOT IN (SELECT conv_id FROM {_CONVERSATIONS})")
def k11_deleted_projects(spark, d):
    conversations, messages = _chat(spark, d)
    projects = table(spark, d, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"))
    return C.delete_projects(projects, conversations, messages, projects.filter("project_id < 5"))[2].select("conv_id", "turn", "role")


@query(f"""WITH n AS (SELECT s_suppkey AS conv_id, 'user' AS role, s_name AS text, s_suppkey AS sent FROM supplier), l AS (SELECT conv_id, max(turn) AS last FROM {_CHAT} GROUP BY ALL)
SELECT conv_id, turn, role, text FROM {_CHAT} UNION ALL SELECT n.conv_id, coalesce(l.last, 0) + 1, n.role, n.text FROM n LEFT JOIN l USING (conv_id)""")
def k11_new_messages(spark, d):
    new = table(spark, d, "supplier", "s_suppkey", "s_name").select(F.col("s_suppkey").alias("conv_id"), F.lit("user").alias("role"), F.col("s_name").alias("text"), F.col("s_suppkey").alias("sent"))
    return C.append_messages(_chat(spark, d)[1], new)


@query("SELECT n_nationkey AS project_id, n_name AS name, coalesce(j.job_id, -1) AS job_id FROM nation LEFT JOIN (SELECT user_id AS project_id, arg_max(event_id, (ts, event_id)) AS job_id FROM events GROUP BY ALL) j ON j.project_id = n_nationkey")
def k11_newest_jobs(spark, d):
    projects = table(spark, d, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").cast("bigint").alias("project_id"), F.col("n_name").alias("name"), F.lit(-1).cast("bigint").alias("job_id"))
    return C.update_job(projects, table(spark, d, "events", "user_id", "event_id", "ts").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("job_id"), "ts"))


# -- turns, retries, contexts ---------------------------------------------------------------------------------------------
_TURNS = "(SELECT user_id AS session_id, event_id AS seq, CASE WHEN event_id % 10 = 0 THEN 'user' WHEN event_id % 10 = 9 THEN 'complete' WHEN event_id % 4 = 0 THEN 'tool_call' WHEN event_id % 4 = 1 THEN 'tool_result' ELSE 'delta' END AS event_type, event_type || ' ' AS delta, event_type AS tool_id FROM events)"


@query(f"""WITH t AS (SELECT *, CAST(sum(CASE WHEN event_type = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn FROM {_TURNS}),
l AS (SELECT *, coalesce(max(CASE WHEN event_type = 'complete' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, turn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM t)
SELECT session_id, turn, coalesce(string_agg(delta, '' ORDER BY seq) FILTER (event_type = 'delta'), '') AS text, count(DISTINCT tool_id) FILTER (event_type = 'tool_call') AS n_tools,
len(list_filter(coalesce(list(DISTINCT tool_id) FILTER (event_type = 'tool_call'), []), lambda x: NOT list_contains(coalesce(list(DISTINCT tool_id) FILTER (event_type = 'tool_result'), []), x))) AS n_open_tools,
coalesce(max(CASE WHEN event_type = 'complete' THEN event_type END), 'streaming') AS state FROM l WHERE ended = 0 GROUP BY ALL""")
def t5_message_states(spark, d):
    e = table(spark, d, "events", "user_id", "event_id", "event_type")
    n = F.col("event_id")
    kind = F.when(n % 10 == 0, "user").when(n % 10 == 9, "complete").when(n % 4 == 0, "tool_call").when(n % 4 == 1, "tool_result").otherwise("delta")
    states = C.message_states(e.select(F.col("user_id").alias("session_id"), n.alias("seq"), kind.alias("event_type"), F.concat("event_type", F.lit(" ")).alias("delta"), F.col("event_type").alias("tool_id")))
    return states.withColumns({c: F.col(c).cast("bigint") for c in ("n_tools", "n_open_tools")})


@query("SELECT o_orderkey, n % 100 AS position, n // 100 AS batch_no, n // 100 * (100 / 50.0) AS planned_second, n // 100 % 4 AS slot FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders)")
def t7_batches_in_slots(spark, d):
    planned = H.batch_plan(table(spark, d, "orders", "o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], size=100, per_second=50.0, concurrency=4)
    return planned.select("o_orderkey", "position", "batch_no", "planned_second", "slot")


@query("""SELECT request_id, attempts, CASE WHEN ok THEN 'succeeded' WHEN attempts >= 5 THEN 'failed' ELSE 'waiting' END AS state, CASE WHEN NOT ok AND attempts < 5 THEN least(4.0 * 2 ** (attempts - 1), 120.0) END AS wait_seconds
FROM (SELECT l_orderkey AS request_id, max(l_linenumber) AS attempts, bool_or(l_returnflag = 'R') AS ok FROM lineitem GROUP BY ALL)""")
def t8_retries(spark, d):
    return H.retry_plan(table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("attempt"), (F.col("l_returnflag") == "R").alias("ok")))


@query(f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM {_CHAT}), u AS (SELECT conv_id, 0 AS part, 0 AS turn, 'system' AS role, title AS text FROM {_CONVERSATIONS} UNION ALL SELECT conv_id, 1, turn, role, text FROM m WHERE n <= 10 UNION ALL SELECT conv_id, 2, 0, 'user', 'now ' || title FROM {_CONVERSATIONS})
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, turn) AS position, role, text FROM u""")
def t10_contexts(spark, d):
    conversations, messages = _chat(spark, d)
    return C.context(conversations.select("conv_id", F.col("title").alias("summary")), messages, conversations.select("conv_id", F.concat(F.lit("now "), "title").alias("text")))


@query("WITH r AS (SELECT user_id AS conv_id, event_id AS turn, CAST(sum(200) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_chars FROM events) SELECT conv_id, turn, running_chars, coalesce(turn >= min(CASE WHEN running_chars >= 2000 THEN turn END) OVER (PARTITION BY conv_id), true) AS included FROM r")
def t9_compaction_at_2000(spark, d):
    return C.compaction_points(table(spark, d, "events", "user_id", "event_id").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.repeat(F.lit("x"), F.lit(200)).alias("text")))


@query(r"SELECT n_nationkey AS node, 0 AS level, substring(n_name || ': ' || n_name || ' text', 1, 120) AS short, n_name || ' (0 dependencies): ' || n_name || ' text' AS full FROM nation")
def e2_placeholder_summaries(spark, d):
    nodes = table(spark, d, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").cast("bigint").alias("node"), F.col("n_name").alias("name"), F.concat(F.col("n_name"), F.lit("\n text ")).alias("text"))
    levelled = nodes.select("node", F.col("node").alias("component"), F.lit(0).alias("level"))
    return H.summarize_levels(nodes, spark.createDataFrame([], "src bigint, dst bigint"), levelled, lambda: H.Retrying(H.PlaceholderSummarizer()))


_GONE = "(SELECT path FROM file_delta WHERE change = 'deleted' UNION SELECT file_path FROM files WHERE language IS NULL)"


@query(f"""WITH g AS {_GONE}, f AS (SELECT DISTINCT id FROM files WHERE file_path NOT IN (SELECT path FROM g)) SELECT 'file' AS kind, id FROM f UNION ALL
SELECT DISTINCT 'definition', id FROM definitions WHERE file_id IS NULL OR file_id IN (SELECT id FROM f) OR file_id NOT IN (SELECT id FROM files)""")
def k5_what_stays(spark, d):
    files, defs = table(spark, d, "files", "id", "file_path", "language").distinct(), table(spark, d, "definitions", "id", "file_id").distinct()
    gone = table(spark, d, "file_delta", "path", "change").filter("change = 'deleted'").select("path").union(files.filter("language IS NULL").select("file_path"))
    kept = D.delete_files(files, defs, spark.createDataFrame([], "source_definition_id bigint, target_definition_id bigint"), gone)
    return kept[0].select(F.lit("file").alias("kind"), "id").unionByName(kept[1].select(F.lit("definition").alias("kind"), "id"))


_POINTS = "(SELECT DISTINCT id AS point_id, file_id AS file, start_line + 1 AS line FROM definitions)"


@query(f"SELECT p.point_id, count(*) AS n_around FROM {_POINTS} p JOIN (SELECT DISTINCT id, file_id, start_line, end_line FROM definitions) d ON d.file_id = p.file AND p.line BETWEEN d.start_line AND d.end_line GROUP BY ALL")
def j4_definitions_around_lines(spark, d):
    defs = table(spark, d, "definitions", "id", "file_id", "start_line", "end_line").distinct()
    points = defs.select(F.col("id").alias("point_id"), F.col("file_id").alias("file"), (F.col("start_line") + 1).alias("line")).distinct()
    ranges = defs.select(F.col("file_id").alias("file"), F.col("id").alias("definition_id"), "start_line", "end_line")
    return V.containing(points, ranges, F.col("line")).groupBy("point_id").agg(F.count("*").alias("n_around"))
