from __future__ import annotations

from datetime import datetime

from quarry.functions.paths import normalize_path
from quarry.operators import orphans as O

IMPORTS = "id bigint, resolved_file_path string, target_package_id bigint, is_external boolean, resolution_type string, created_at timestamp, path string"
FILES = "id bigint, file_path string, created_at timestamp, key string"
PACKAGES = "id bigint, created_at timestamp, state string"
DELTA = "path string, change string, old_path string, changed_at timestamp"
T0, T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1)


def run(spark, imports, files, packages, delta):
    found = O.orphans(spark.createDataFrame(imports, IMPORTS), spark.createDataFrame(files, FILES), spark.createDataFrame(packages, PACKAGES), spark.createDataFrame(delta, DELTA))
    return found, {(r.import_id, r.ref_field, r.state) for r in found.collect()}


def test_states(spark):
    imports = [
        (1, "r/a.py", None, False, "relative", T1, "x"),
        (1, "r/a.py", None, False, "relative", T1, "x"),
        (2, " ./r//b\\..\\late.py ", 7, None, "alias", T1, "x"),
        (3, "r/gone.py", 8, False, "package", T1, "x"),
        (4, "r/old.py", 9, False, None, T1, "x"),
        (5, "r/nowhere.py", 404, True, "external", T1, "x"),
        (6, "", None, False, "relative", T1, "x"),
        (7, None, None, False, "package", T1, "x"),
        (8, None, None, False, "unknown", T1, "x"),
        (9, "R/a.py", None, False, "unknown", T1, "x"),
        (10, "r/again.py", None, False, "relative", None, "x"),
        (None, None, None, None, None, None, None),
    ]
    files = [(1, "r/a.py", T0, "k"), (2, "r/late.py", T2, "k"), (3, "r/again.py", T2, None), (4, None, None, None)]
    packages = [(7, T2, "p"), (8, None, None), (None, T0, None)]
    delta = [("r/gone.py", "deleted", None, T0), ("r/new.py", "renamed", "r/old.py", T0), ("r/again.py", "deleted", None, T0), (None, None, None, None), ("r/nowhere.py", "added", None, T0)]
    found, states = run(spark, imports, files, packages, delta)
    assert states == {
        (2, "resolved_file_path", "late"),
        (2, "target_package_id", "late"),
        (3, "resolved_file_path", "deleted"),
        (4, "resolved_file_path", "deleted"),
        (4, "target_package_id", "missing"),
        (6, "resolved_file_path", "unset"),
        (7, "target_package_id", "unset"),
        (9, "resolved_file_path", "missing"),
    }
    assert found.count() == len(states)
    months = {(r.parent_table, r.state, r.month): (r.n_references, r.n_keys) for r in O.orphans_by_period(found).collect()}
    assert months["files", "deleted", "2024-02"] == (2, 2)


def test_hot_key_is_whole(spark):
    imports = [(i, "r/hot.py", 5, False, "relative", T1, "") for i in range(500)]
    _, states = run(spark, imports, [], [(5, T0, "")], [])
    assert len(states) == 500 and {s for _, _, s in states} == {"missing"}


def test_empty_tables(spark):
    assert run(spark, [], [], [], [])[1] == set()


def test_normalize_path(spark):
    cases = {" a/b ": "a/b", "a\\b": "a/b", "./a//b/.": "a/b", "a/../b": "b", "../a": "a", "a/b/../../..": "", "/a": "a", "": "", "A/b": "A/b", "x" * 5000 + "/..//y": "y"}
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "p string")
    got = {r.p: r.n for r in rows.select("p", normalize_path(rows.p).alias("n")).collect()}
    assert got == cases | {None: None}
