"""Keys that very many rows share, and the ways of numbering and pairing that do without one task for them."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import conversation as C
from quarry.operators import delta as D
from quarry.operators import fold as H
from quarry.operators import graph as G
from quarry.operators import relational as R
from quarry.operators import resolve as V
from quarry.operators import search as S
from quarry.session import numbered, settled
from quarry.sources import repository as T
from quarry.sources import sinks as K


def test_numbers_within_a_hot_key(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"), F.hash("id").alias("order"))
    wrong = numbered(rows, "key", "order").withColumn("want", F.expr("row_number() OVER (PARTITION BY key ORDER BY order)")).filter("k <> want")
    assert wrong.count() == 0
    assert numbered(spark.createDataFrame([(None, 2), (None, 1), ("a", None)], "key string, order int"), "key", "order").orderBy("key", "order").select("k").collect() == [(1,), (2,), (1,)]
    assert numbered(rows.limit(0), "key", "order").count() == 0


def test_one_file_of_very_many_definitions(spark):
    ranges = spark.range(50_000).select(F.lit("f").alias("file"), F.col("id").alias("definition_id"), (F.col("id") * 3 + 1).cast("int").alias("start_line"), (F.col("id") * 3 + 3).cast("int").alias("end_line"))
    ranges = ranges.unionByName(spark.createDataFrame([("f", -1, 1, 150_000), ("f", -2, 5, 4), ("f", -3, None, 3), (None, -4, 1, 9)], "file string, definition_id bigint, start_line int, end_line int"))
    points = spark.range(50_000).select(F.lit("f").alias("file"), F.col("id").alias("point_id"), (F.col("id") * 3 + 2).cast("int").alias("line"))
    began = time.time()
    hit = V.containing(points, ranges, F.col("line"))
    assert hit.count() == 100_000 and hit.filter("definition_id >= 0 AND definition_id <> point_id").count() == 0
    assert time.time() - began < 60
    inner = V.containing(points, ranges, F.col("line"), innermost=True)
    assert inner.filter("definition_id <> point_id").count() == 0


def test_one_content_of_very_many_files(spark, monkeypatch):
    monkeypatch.setattr(D, "MANY", 1000)
    old = spark.range(5000).select(F.format_string("old/%05d.py", "id").alias("path"), F.lit("h").alias("content_hash"))
    new = spark.range(4000).select(F.format_string("new/%05d.py", "id").alias("path"), F.lit("h").alias("content_hash"))
    changes = D.file_changes(old, new).cache()
    assert {(r.change, r["count"]) for r in changes.groupBy("change").count().collect()} == {("renamed", 4000), ("deleted", 1000)}
    assert changes.filter("change = 'renamed' AND substring(path, 5) <> substring(old_path, 5)").count() == 0


def similarity(a: str, b: str) -> float:
    def lines(t):
        found: dict[str, int] = {}
        for x in t.split("\n"):
            found[x] = found.get(x, 0) + 1
        return found

    x, y = lines(a), lines(b)
    return sum((len(k) + 1) * min(n, y.get(k, 0)) for k, n in x.items()) / max(len(a) + 1, len(b) + 1)


def test_renames_by_similarity_are_those_of_brute_force(spark):
    rng = random.Random(3)
    pool = ["}", "", "return x", *[f"line {i}" for i in range(30)]]
    old = [(f"o{i}.py", "\n".join(rng.choices(pool, k=rng.randint(1, 12)))) for i in range(40)]
    new = [(f"n{i}.py", "\n".join([*(lines := rng.choice(old)[1].split("\n"))[: rng.randint(1, len(lines))], *rng.choices(pool, k=rng.randint(0, 5))])) for i in range(40)]
    a, b = (spark.createDataFrame(rows, "path string, content string") for rows in (old, new))
    want = {(p, q): similarity(x, y) for p, x in old for q, y in new if similarity(x, y) >= 0.5}
    assert {(r.old_path, r.path): pytest.approx(r.similarity) for r in D.similarities(a, b, 0.5).collect()} == want
    left, taken = dict(want), {}
    while left:
        best = min(left, key=lambda k: (-left[k], k))
        taken[best] = left[best]
        left = {k: v for k, v in left.items() if k[0] != best[0] and k[1] != best[1]}
    assert {(r.old_path, r.path) for r in D.similar_pairs(a, b).collect()} == set(taken)
    assert D.similar_pairs(a.limit(0), b).count() == 0


def test_seeds_and_lone_nodes_are_counted_too(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (None, 3), (5, 5)], "src bigint, dst bigint")
    seeds = spark.range(1000).select(F.col("id").alias("node"))
    for limit in (100, 10_000):
        assert G.reverse_closure(edges, seeds, small_limit=limit).count() == 1000
    loops = spark.range(1000).select(F.col("id").alias("src"), F.col("id").alias("dst"))
    for limit in (100, 10_000):
        assert G.connected_components(loops, small_limit=limit).filter("node = component").count() == 1000
        assert G.strongly_connected(loops, small_limit=limit).filter("node = component").count() == 1000


def test_reduction_and_levels_of_random_graphs(spark):
    rng = random.Random(9)
    for n, m in ((12, 30), (25, 60), (6, 0)):
        pairs = {tuple(sorted(rng.sample(range(n), 2), reverse=True)) for _ in range(m)}
        reach = {p: {b for a, b in pairs if a == p} for p in range(n)}
        for p in range(n):
            for q in sorted(reach[p], reverse=True):
                reach[p] = reach[p] | reach[q]
        want = {(a, b) for a, b in pairs if not any(b in reach[c] for x, c in pairs if x == a and c != b)}
        edges = spark.createDataFrame([(a + (1 << 60), b + (1 << 60)) for a, b in pairs], "src bigint, dst bigint")
        assert {(r.src - (1 << 60), r.dst - (1 << 60)) for r in G.transitive_reduction(edges).collect()} == want


def test_batches_retries_and_calls(spark):
    items = spark.createDataFrame([(i, i % 3) for i in range(23)], "id bigint, k int")
    plan = {r.id: (r.batch_no, r.position, r.slot) for r in H.batch_plan(items, ["id"], size=5, concurrency=2).collect()}
    assert plan == {i: (i // 5, i % 5, i // 5 % 2) for i in range(23)}
    attempts = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 5, False), (3, 3, False), (4, 9, False)], "request_id bigint, attempt int, ok boolean")
    assert {(r.request_id, r.state, r.wait_seconds) for r in H.retry_plan(attempts).collect()} == {(1, "succeeded", None), (2, "failed", None), (3, "waiting", 16.0), (4, "failed", None)}
    waits: list[float] = []

    class Failing:
        calls = 0

        def summarize(self, rows):
            Failing.calls += 1
            if Failing.calls < 4:
                raise OSError("busy")
            return rows

    assert H.Retrying(Failing(), sleep=waits.append).summarize([1]) == [1] and waits == [4.0, 8.0, 16.0]
    Failing.calls = -9
    with pytest.raises(OSError):
        H.Retrying(Failing(), sleep=waits.append).summarize([1])


def test_rrf_and_settled(spark):
    rows = spark.range(50).select(F.lit("file").alias("entity_type"), F.col("id").alias("entity_id"), F.col("id").cast("double").alias("distance"))
    assert [r.entity_id for r in S.hybrid_rrf([rows, rows], 3).collect()] == [0, 1, 2] and S.hybrid_rrf([rows, rows], 99, depth=10).count() == 10
    assert settled(rows, 10).count() == settled(rows, 100).count() == 50


def test_vectors_are_replaced_by_key(spark):
    mirror = spark.createDataFrame([("file", 1, [1.0]), ("file", 2, [2.0])], "entity_type string, entity_id bigint, embedding array<float>")
    new = spark.createDataFrame([("file", 2, [3.0], 1), ("file", 2, [4.0], 2), ("definition", 2, None, 1)], "entity_type string, entity_id bigint, embedding array<float>, updated_at int")
    assert {(r.entity_type, r.entity_id, tuple(r.embedding or ())) for r in K.replace_vectors(mirror, new).collect()} == {("file", 1, (1.0,)), ("file", 2, (4.0,)), ("definition", 2, ())}


def test_links_that_lead_back_are_refused(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.py").write_text("x")
    (tmp_path / "side").symlink_to(tmp_path / "a" / "b")
    assert T.link_loop(str(tmp_path)) is None
    assert {r.path for r in T.read_tree(spark, str(tmp_path), directories=True).collect()} >= {"a/b/x.py", "a/", "a/b/"}
    (tmp_path / "a" / "b" / "up").symlink_to(tmp_path / "a")
    with pytest.raises(ValueError, match="leads back"):
        T.read_tree(spark, str(tmp_path))


def test_references_of_few_files(spark):
    files = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, file_path string")
    defs = spark.createDataFrame([(10, 1, "f", "function", 3), (11, 1, "g", "function", 1), (12, 2, "h", "function", 1)], "id bigint, file_id bigint, name string, definition_type string, start_line int")
    edges = spark.createDataFrame([(10, 12), (12, 11), (10, 12)], "src bigint, dst bigint")
    found = R.files_with_references(files.filter("id = 1"), files, defs, edges).collect()
    assert [[(x.name, x.refers_to, x.referred_by) for x in r.definitions] for r in found] == [[("g", [], ["h"]), ("f", ["h"], [])]]


def test_turns_of_a_conversation(spark):
    rows = [("s", 1, "user", None, None), ("s", 2, "tool_call", None, "t"), ("s", 3, "delta", "b", None), ("s", 4, "delta", "c", None), ("s", 5, "complete", None, None), ("s", 6, "delta", "late", None), ("s", 7, "user", None, None), ("s", 8, "tool_call", None, "t"), ("s", 9, "tool_result", None, "t")]
    e = spark.createDataFrame(rows, "session_id string, seq int, event_type string, delta string, tool_id string")
    assert {(r.turn, r.text, r.n_tools, r.n_open_tools, r.state) for r in C.message_states(e).collect()} == {(1, "bc", 1, 1, "complete"), (2, "", 1, 0, "streaming")}
