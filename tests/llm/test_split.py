from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import split as S


def check(text, limit, overlap):
    found = S.pieces(text, limit, overlap)
    parts = [(text[a:b], o) for a, b, o in found]
    assert S.restore(parts) == text
    assert all(len(p) <= limit for p, _ in parts)
    for (before, _), (piece, shared) in zip(parts, parts[1:]):
        assert shared == overlap and piece.startswith(before[len(before) - overlap :]) and len(before) >= overlap
    return parts


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc .\n\ŕ\u200d", max_size=400), st.integers(9, 60), st.integers(0, 4))
def test_round_trip(text, limit, overlap):
    check(text, limit, overlap)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n\r\u0301\u200d", max_size=60), st.integers(0, 6), st.integers(1, 4))
def test_no_piece_exceeds_the_smallest_limits(text, overlap, more):
    check(text, 2 * overlap + more, overlap)


def test_cuts_at_line_ends():
    text = "".join(f"def f{i}():\n    return {i}\n\n" for i in range(200))
    parts = check(text, 500, 50)
    assert all(piece[shared:].startswith("def f") for piece, shared in parts)


def test_one_long_line_is_cut_at_blanks():
    parts = check("word " * 1000, 300, 20)
    assert all(piece[shared - 1] == " " for piece, shared in parts[1:])
    assert len(check("x" * 5000, 300, 20)) > 16


def test_no_split_needed_and_bad_limits():
    assert S.pieces("abc", 3, 1) == [(0, 3, 0)]
    assert S.pieces("", 10, 1) == [(0, 0, 0)]
    with pytest.raises(ValueError):
        S.ranges("abc" * 10, 10, 5)


def test_line_break_and_clusters_stay_whole():
    parts = check("é" * 400, 101, 0)
    assert all(not piece.startswith("́") for piece, _ in parts)


def test_table(spark):
    limits = spark.createDataFrame([("file", 20, 3, "x"), ("definition", 10, 2, "x")], "entity_type string, max_chars int, overlap_chars int, text string")
    rows = spark.createDataFrame(
        [("file", 1, "a line\n" * 5, "x"), ("file", 1, "a line\n" * 5, "x"), ("file", 2, "y" * 30, "x"), ("file", 3, None, "x"), ("file", 4, "", "x"), ("file", 5, "z" * 20, "x"), ("other", 6, "w" * 99, "x"), ("definition", 1, "ab\ncd\nef\ngh\n", "x"), ("definition", 2, "é" * 11, None)],
        "entity_type string, entity_id bigint, text string, piece string",
    )
    found = {(r.entity_type, r.entity_id, r.cut_kind) for r in S.split_entities(rows, limits).collect()}
    assert found == {("file", 1, "natural"), ("file", 2, "forced"), ("definition", 1, "natural"), ("definition", 2, "forced")}
    pieces = S.split(rows, limits).filter("entity_id = 2 AND entity_type = 'file'").orderBy("piece_no").collect()
    assert "".join(r.piece[r.overlap :] for r in pieces) == "y" * 30 and [r.n_pieces for r in pieces] == [len(pieces)] * len(pieces)
    assert S.split(rows.limit(0), limits).count() == 0
    assert S.split(rows, limits.limit(0)).count() == 0
