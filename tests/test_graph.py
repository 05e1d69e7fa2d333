from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators import small_graph as S


def reach(edges, nodes):
    out = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if not out[b] <= out[a]:
                out[a] |= out[b]
                changed = True
    return out


def brute_levels(edges, nodes):
    r = reach(edges, nodes)
    component = {n: max(m for m in nodes if m in r[n] and n in r[m]) for n in nodes}
    dag = {(component[a], component[b]) for a, b in edges if component[a] != component[b]}
    level = dict.fromkeys(set(component.values()), 0)
    for _ in level:
        for a, b in dag:
            level[a] = max(level[a], level[b] + 1)
    return component, {n: level[component[n]] for n in nodes}


def graph(seed, n=24, m=34):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)}), list(range(n))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=25), st.lists(st.integers(0, 9), max_size=3))
def test_array_functions(edges, seeds):
    import numpy as np

    nodes = list(range(10))
    r = reach(edges, nodes)
    both = reach([*edges, *[(b, a) for a, b in edges]], nodes)
    src, dst = np.array([e[0] for e in edges], dtype=np.int64), np.array([e[1] for e in edges], dtype=np.int64)
    component, level = brute_levels(edges, nodes)
    assert S.strong(10, src, dst).tolist() == [component[n] for n in nodes]
    assert S.components(10, src, dst).tolist() == [min(both[n]) for n in nodes]
    steps = S.closure(10, src, dst, np.array(sorted(set(seeds)), dtype=np.int64))
    assert {n for n in nodes if steps[n] >= 0} == {n for n in nodes if r[n] & set(seeds)}
    dag = [(a, b) for a, b in edges if a > b]
    assert S.levels(10, np.array([a for a, _ in dag], dtype=np.int64), np.array([b for _, b in dag], dtype=np.int64)).tolist() == [brute_levels(dag, nodes)[1][n] for n in nodes]


@pytest.mark.parametrize("limit", [0, S.LIMIT])
def test_both_ways_agree_with_brute_force(spark, limit):
    edges, nodes = graph(3)
    e, n = spark.createDataFrame([*edges, edges[0], (None, 1), (1, None)], "src bigint, dst bigint"), spark.createDataFrame([(x,) for x in nodes], "node bigint")
    linked = sorted({x for edge in edges for x in edge})
    component, level = brute_levels(edges, nodes)
    clean = e.filter("src IS NOT NULL AND dst IS NOT NULL")
    assert {(r.node, r.component) for r in G.strongly_connected(clean, small_limit=limit).collect()} == {(x, component[x]) for x in linked}
    got = {r.node: (r.component, r.level) for r in G.levels(n, clean, small_limit=limit).collect()}
    assert got == {x: (component[x], level[x]) for x in nodes}
    for a, b in edges:
        assert got[a][1] > got[b][1] or component[a] == component[b]
    r = reach(edges, nodes)
    closed = {x.node for x in G.reverse_closure(e, spark.createDataFrame([(5,), (7,), (None,)], "node bigint"), small_limit=limit).collect()}
    assert closed == {x for x in nodes if r[x] & {5, 7}}
    both = reach([*edges, *[(b, a) for a, b in edges]], nodes)
    assert {(x.node, x.component) for x in G.connected_components(e, small_limit=limit).filter("node IS NOT NULL").collect()} == {(x, min(both[x])) for x in linked}


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "src bigint, dst bigint")
    assert {r.component for r in G.connected_components(edges, small_limit=0).collect()} == {0}


def test_level_fixture(spark):
    """Two utilities, two services on them, and an application on both."""
    edges = spark.createDataFrame([(3, 1), (4, 2), (5, 3), (5, 4)], "src bigint, dst bigint")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "node bigint")
    levelled = G.levels(nodes, edges)
    assert {r.node: r.level for r in levelled.collect()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 0}
    kept = G.filter_levels(levelled, spark.createDataFrame([(3,), (5,)], "node bigint"))
    assert {r.node: r.level for r in kept.collect()} == {3: 0, 5: 1}
    around = {(r.node, r.role) for r in G.neighbours(edges, spark.createDataFrame([(3,)], "node bigint")).collect()}
    assert around == {(3, "centre"), (1, "depends on"), (5, "is used by")}


def test_cycle_is_refused_and_empty_graphs_work(spark):
    empty = spark.createDataFrame([], "src bigint, dst bigint")
    nodes = spark.createDataFrame([(1,)], "node bigint")
    assert G.connected_components(empty).count() == G.strongly_connected(empty).count() == 0
    assert [tuple(r) for r in G.levels(nodes, empty).collect()] == [(1, 1, 0)]
    assert G.reverse_closure(empty, nodes).count() == 1
    with pytest.raises(Exception, match="cycle"):
        G.component_levels(nodes, spark.createDataFrame([(1, 2), (2, 1)], "src bigint, dst bigint")).collect()


def test_reduction_and_induced(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (1, 4)], "src bigint, dst bigint")
    assert {tuple(r) for r in G.transitive_reduction(edges).collect()} == {(1, 2), (2, 3), (3, 4)}
    assert {tuple(r) for r in G.induced(edges, spark.createDataFrame([(1,), (3,), (4,)], "node bigint")).collect()} == {(1, 3), (3, 4), (1, 4)}


def test_definition_graph_and_seeds(spark):
    files = spark.createDataFrame([(1, "a.ts"), (2, "b.ts"), (3, "c.ts")], "id bigint, file_path string")
    defs = spark.createDataFrame([(1, 1, "function", "add"), (2, 1, "function", "mul"), (3, 2, "class", "Calc"), (4, 3, "class", "Lone")], "id bigint, file_id bigint, definition_type string, name string")
    refs = spark.createDataFrame([(3, 1), (3, None), (3, 1), (2, None)], "source_definition_id bigint, target_definition_id bigint")
    nodes, edges = G.definition_graph(defs, refs, files, remove_isolated=True)
    assert {r.node: r.title for r in nodes.collect()} == {1: "a.ts", 3: "b.ts"} and [tuple(r) for r in edges.collect()] == [(3, 1)]
    delta = spark.createDataFrame([("b.ts", "modified"), ("c.ts", "deleted"), ("x.ts", "added")], "path string, change string")
    assert {(r.node, r.kind) for r in G.seeds_from_delta(delta, files, defs).collect()} == {(2, "file"), (3, "definition")}


@pytest.mark.parametrize("limit", [0, S.LIMIT])
def test_ids_above_2_to_53_stay_exact(spark, limit):
    first = 2**53 + 1
    far = [first, first + 2, first + 4, 2**62 + 1, 2**62 + 3, -(2**60) - 1]
    pairs = [(far[0], far[1]), (far[1], far[0]), (far[1], far[2]), (far[3], far[4])]
    edges = spark.createDataFrame([*pairs, (far[5], far[5]), (far[5], None)], "src bigint, dst bigint").coalesce(1)
    nodes = spark.createDataFrame([(x,) for x in far], "node bigint")
    component = {r.node: r.component for r in G.connected_components(edges, small_limit=limit).collect()}
    assert {n: c for n, c in component.items() if n != far[5]} == {far[0]: far[0], far[1]: far[0], far[2]: far[0], far[3]: far[3], far[4]: far[3]} and component.get(far[5], far[5]) == far[5]
    strong = {r.node: r.component for r in G.strongly_connected(edges, small_limit=limit).collect()}
    assert {n: c for n, c in strong.items() if n != far[5]} == {far[0]: far[1], far[1]: far[1], far[2]: far[2], far[3]: far[3], far[4]: far[4]} and strong.get(far[5], far[5]) == far[5]
    seeds = nodes.filter(F.col("node").isin(far[2], far[5]))
    assert {(r.node, r.distance) for r in G.reverse_closure(edges, seeds, small_limit=limit).collect()} == {(far[2], 0), (far[1], 1), (far[0], 2), (far[5], 0)}
    level = {r.node: (r.component, r.level) for r in G.levels(nodes, edges, small_limit=limit).collect()}
    assert level == {far[0]: (far[1], 1), far[1]: (far[1], 1), far[2]: (far[2], 0), far[3]: (far[3], 1), far[4]: (far[4], 0), far[5]: (far[5], 0)}


def test_every_file_is_a_centre(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    found = entry.queries()["g12_neighbours_of_all_files"](spark, d)
    files = {r.id for r in spark.read.parquet(f"{d}/files.parquet").select("id").distinct().collect() if r.id is not None}
    assert {r.centre for r in found.filter("role = 'centre'").collect()} == files
    python = entry.queries()["g12_neighbours"](spark, d)
    assert python.exceptAll(found).count() == 0 and python.count() < found.count()
