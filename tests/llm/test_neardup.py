from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from quarry.llm import neardup as N


def brute(records, threshold, width=3, least=30):
    sets = {}
    for i, text in records:
        tokens = N.TOKEN.findall(text or "")
        if len(tokens) >= least:
            sets[i] = {tuple(tokens[k : k + width]) for k in range(len(tokens) - width + 1)}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(seed=5, families=25):
    rng = random.Random(seed)
    records, i = [], 0
    for _ in range(families):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(35, 120))]
        for _ in range(rng.randint(1, 8)):
            copy = base[:]
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(5000)}"
            i += 1
            records.append((i, " ".join(copy)))
    return records


def test_pairs_are_those_of_brute_force(spark):
    records = corpus()
    records += [(900, records[0][1]), (901, records[0][1]), (902, None), (903, ""), (904, "too short"), records[1], (905, "x " * 40), (906, "x  " * 50)]
    near = N.NearDuplicates(spark.createDataFrame(records, "def_id bigint, text string"))
    found = {(r.def_id_a, r.def_id_b) for r in near.expanded().collect()}
    truth = brute(set(records), 0.7)
    assert found - truth == set()
    assert len(truth - found) <= 0.002 * len(truth)
    groups = {r.def_id: (r.class_id, r.group_id) for r in near.groups().collect()}
    assert groups[900] == groups[901] and groups[905] == groups[906]
    for a, b in found:
        assert groups[a][1] == groups[b][1]
    assert not {902, 903, 904} & set(groups)


def test_a_hot_key_is_joined_in_blocks(spark):
    rows = spark.createDataFrame([("k", i) for i in range(300)] + [("j", 1), ("j", 2)], "key string, m bigint")
    sizes = rows.groupBy("key").count().withColumnRenamed("count", "n")
    pairs = [(r.a, r.b) for r in N.pairs_within(rows, sizes, "key", "m", block=40).collect()]
    assert len(pairs) == 300 * 299 // 2 + 1 and len(set(pairs)) == 300 * 299 // 2


def test_estimates(spark):
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    for share in (0.2, 0.5, 0.7, 0.9):
        n = int(2000 * share * 2 / (1 + share))
        a, b = common[:2000], np.concatenate([common[:n], common[2000 : 4000 - n]])
        mins = N.minima(np.concatenate([a, b]), np.array([0, 2000]))
        longs = N.packed(mins).view(np.int64)
        row = spark.createDataFrame([tuple(int(x) for x in longs.reshape(-1))], ", ".join(f"c{i} bigint" for i in range(2 * N.LONGS)))
        got = row.select(N.estimate(N.equal_groups([row[f"c{i}"] for i in range(N.LONGS)], [row[f"c{i + N.LONGS}"] for i in range(N.LONGS)])).alias("e")).first().e
        assert abs(got - share) < 0.2
    assert N.miss_rate(0.7) < 2e-4


def test_empty(spark):
    near = N.NearDuplicates(spark.createDataFrame([], "def_id bigint, text string"))
    assert near.expanded().count() == 0 and near.groups().count() == 0


def test_records_of(spark):
    rows = spark.createDataFrame([(1, "function", "a", 5), (2, "class", "a", 5), (3, "method", None, 5), (4, None, "a", 5)], "id bigint, definition_type string, source_code string, def_id int")
    assert [r.def_id for r in N.records_of(rows).collect()] == [1]


def test_many_copies_of_linked_records(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "MANY", 10)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join([*base[1:], "third"])]
    records = [(100 * t + i, text) for t, text in enumerate(texts) for i in range(20 if t < 2 else 3)]
    near = N.NearDuplicates(spark.createDataFrame(records, "def_id bigint, text string"))
    found = [(r.def_id_a, r.def_id_b) for r in near.expanded().collect()]
    assert len(found) == len(set(found)) and set(found) == brute(records, 0.7)
    assert {r.class_id for r in near.groups().collect()} == {0, 100, 200}
