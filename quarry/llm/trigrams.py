"""Trigram queries derived from regular expressions, and an index of text chunks that answers them.

``required`` walks the parsed expression and keeps what every match must contain: a choice (any of) of conjunctions (all of) of
trigrams in lower case. ``Index`` holds the postings of the wanted trigrams over the chunks of one batch, built from the batch's bytes
with three shifted views of one array, without a loop over positions. Posting lists are intersected per conjunction and united per choice.
"""

from __future__ import annotations

from re import _constants as _c
from re import _parser

import numpy as np

#: A choice with more members than this is weakened to the part around it.
MAX_CHOICE = 400


def _cross(left: list[str], right: list[str]) -> list[str] | None:
    return [a + b for a in left for b in right] if len(left) * len(right) <= MAX_CHOICE else None


def _exact(item) -> list[str] | None:
    """All strings that a parsed item can match, in lower case, if these are few; else None."""
    op, arg = item
    if op is _c.LITERAL:
        return [chr(arg).lower()]
    if op is _c.IN and all(o is _c.LITERAL for o, _ in arg) and len(arg) <= 8:
        return sorted({chr(a).lower() for _, a in arg})
    if op is _c.SUBPATTERN:
        return _exact_sequence(arg[3])
    if op is _c.BRANCH:
        found: list[str] = []
        for branch in arg[1]:
            one = _exact_sequence(branch)
            if one is None:
                return None
            found += one
        return sorted(set(found)) if len(found) <= MAX_CHOICE else None
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT, _c.POSSESSIVE_REPEAT) and arg[1] <= 1:
        one = _exact_sequence(arg[2])
        return None if one is None else one + [""] * (arg[0] == 0)
    if op in (_c.AT, _c.ASSERT, _c.ASSERT_NOT):
        return [""]
    return None


def _exact_sequence(items) -> list[str] | None:
    found: list[str] | None = [""]
    for item in items:
        one = _exact(item)
        found = None if one is None else _cross(found, one)
        if found is None:
            return None
    return found


def _query(words: list[str]) -> list[frozenset[bytes]] | None:
    """A choice of conjunctions for a choice of strings; None if one of them is too short to have a trigram."""
    sets = []
    for word in words:
        raw = word.encode()
        if len(raw) < 3:
            return None
        sets.append(frozenset(raw[i : i + 3] for i in range(len(raw) - 2)))
    return sorted(set(sets), key=sorted)


def _score(query: list[frozenset[bytes]]) -> tuple[int, int]:
    return min(map(len, query)), -len(query)


def _best(items) -> list[frozenset[bytes]] | None:
    """The most selective query that the sequence of items requires."""
    candidates: list[list[frozenset[bytes]]] = []
    run: list[str] = [""]

    def close() -> None:
        if (q := _query(run)) is not None:
            candidates.append(q)

    for item in items:
        one = _exact(item)
        crossed = None if one is None else _cross(run, one)
        if crossed is not None:
            run = crossed
            continue
        close()
        run = one if one is not None else [""]
        if one is None:
            op, arg = item
            inner = None
            if op is _c.SUBPATTERN:
                inner = _best(arg[3])
            elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT, _c.POSSESSIVE_REPEAT) and arg[0] >= 1:
                inner = _best(arg[2])
            elif op is _c.ATOMIC_GROUP:
                inner = _best(arg)
            elif op is _c.BRANCH:
                parts = [_best(branch) for branch in arg[1]]
                if all(p is not None for p in parts) and sum(map(len, parts)) <= MAX_CHOICE:
                    inner = sorted({s for p in parts for s in p}, key=sorted)
            if inner is not None:
                candidates.append(inner)
    close()
    return max(candidates, key=_score, default=None)


def required(pattern: str, flags: int = 0) -> list[frozenset[bytes]]:
    """What each match of the pattern contains: any of these sets, and of the set all trigrams. Raises where nothing is required."""
    found = _best(_parser.parse(pattern, flags))
    if found is None:
        raise ValueError(f"no trigram is required by {pattern!r}")
    return found


class Plan:
    """The queries of several patterns, with a table from each possible trigram to its number among the wanted ones. None stands for a pattern that requires no trigram."""

    def __init__(self, queries: list[list[frozenset[bytes]] | None]):
        wanted = sorted({t for q in queries if q is not None for s in q for t in s})
        self.numbers = {t: i + 1 for i, t in enumerate(wanted)}
        self.queries = [None if q is None else [sorted(self.numbers[t] for t in s) for s in q] for q in queries]
        self.table = np.zeros(1 << 24, dtype=np.uint16)
        for t, i in self.numbers.items():
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = i


class Index:
    """Postings of a plan's trigrams over a list of chunks."""

    def __init__(self, plan: Plan, chunks: list[str]):
        self.size = len(chunks)
        raw = [c.lower().encode("utf-8", "surrogatepass") for c in chunks]
        starts = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum([len(r) + 2 for r in raw], out=starts[1:])
        data = np.frombuffer(b"\0\0".join([*raw, b""]), dtype=np.uint8).astype(np.uint32)
        self.postings: dict[int, np.ndarray] = {}
        self.plan = plan
        if len(data) < 3:
            return
        hits = plan.table[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
        at = np.flatnonzero(hits)
        pairs = np.unique(hits[at].astype(np.int64) << 40 | np.searchsorted(starts, at, side="right") - 1)
        numbers, places = pairs >> 40, pairs & (1 << 40) - 1
        bounds = np.flatnonzero(np.diff(numbers)) + 1
        for part, chunk_ids in zip(np.split(numbers, bounds), np.split(places, bounds)):
            if len(part):
                self.postings[int(part[0])] = chunk_ids

    def candidates(self, query: int) -> np.ndarray:
        """The chunks that may match the pattern of this number: all of them, where the pattern requires no trigram."""
        if self.plan.queries[query] is None:
            return np.arange(self.size)
        none = np.zeros(0, dtype=np.int64)
        found = []
        for conjunction in self.plan.queries[query]:
            lists = sorted((self.postings.get(t, none) for t in conjunction), key=len)
            chunk_ids = lists[0]
            for other in lists[1:]:
                if not len(chunk_ids):
                    break
                chunk_ids = np.intersect1d(chunk_ids, other, assume_unique=True)
            found.append(chunk_ids)
        return np.unique(np.concatenate(found)) if found else none
