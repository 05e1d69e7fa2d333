"""Encoding of a corpus with a public tokenizer's byte-pair vocabulary (problem 8).

For byte-pair encoding, each prefix of a byte string has exactly one valid encoding, and its last token is unique. ``Vocabulary.table``
stores that last token for each prefix: the one token that ends there, whose own predecessor's encoding is stored already, and that
may follow the predecessor's last token. This is the published linear-time way of byte-pair encoding by valid pairs of tokens, with an
automaton over the vocabulary. Whether two tokens may follow each other is decided from the merge table alone, by undoing the merges
along their common border. Going back through the table from any prefix gives that prefix's exact encoding, so bytes can be
appended without looking at what was encoded before, and an edit only re-encodes what comes after it, until the tables meet again.

The vocabulary is read from a file of ranks. One automaton over its tokens finds all that end at a byte, longest first, so that only real
tokens are looked at. The tokenizer first cuts a text into words by a pattern, and merges never cross them, so tables are per word. A
blank before another sign always opens a word, whatever stands around it; between two such blanks a text encodes alike everywhere, and as
these units repeat in a corpus, a bounded cache holds the encodings of frequent ones.

Null and empty texts have no tokens: an empty list. Texts are encoded whole, a word of any length included. A row gives a
row; ``distinct_documents`` leaves one per document where rows repeat, which those of documents do not.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import seldom_collect
from quarry.session import spread

DEFAULT_FILE = "byte_bpe_50k.tiktoken"
DEFAULT_FOLDER = "/opt/tokenizers"
#: Fixed value: the pattern by which this tokenizer cuts a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Numbers in a batch of encodings, beyond which the next text begins another one.
PART = 1_000_000
#: Units, and words, whose encodings a task holds at once.
CACHED_UNITS = 200_000


class Vocabulary:
    """Tokens with their ranks, and what follows from them: how each was merged, and which pairs may stand together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                left, right = self._last_merge(token, rank)
                self.parts[rank] = (left, right)
                self.merges[left, right] = rank
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        if ranks:
            self.automaton.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens that merging below ``rank`` leaves of the token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(rank, 0))
            if best[0] >= rank:
                raise ValueError(f"token {rank} is not made of lower ones")
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def compatible(self, first: int, second: int) -> bool:
        """Whether byte-pair encoding of the two tokens' bytes gives these two tokens."""
        known = self._pairs.get((first, second))
        if known is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            known = self._pairs[first, second] = self._compatible(first, second)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        limit = 1 << 62
        while True:
            merged = self.merges.get((a, b))
            if merged is not None and merged < limit:
                return False
            if a > b:
                limit, parts = a, self.parts.get(a)
                if parts is None:
                    limit, parts = b, self.parts.get(b)
                    if parts is None:
                        return True
                    limit, b = b + 1, parts[0]
                    continue
                a = parts[1]
                if a == limit:
                    return True
            else:
                limit, parts = b + 1, self.parts.get(b)
                if parts is None:
                    limit, parts = a, self.parts.get(a)
                    if parts is None:
                        return True
                    a = parts[1]
                    continue
                b = parts[0]


class Prefixes:
    """The unique valid last token of each prefix of a growing byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Add bytes; what was stored for the old prefixes stays valid. Only tokens that end in the new bytes are looked for."""
        v, last, old = self.vocabulary, self.last, len(self.data)
        self.data += data
        base = max(0, old - v.longest + 1)
        missing, compatible = old + 1, v.compatible
        for at, (token, length) in v.automaton.iter(bytes(self.data[base:]).decode("latin-1")) if data else ():
            # The tokens that end at a byte come longest first; the first one that may stand there is the only one.
            if base + at + 1 == missing and (length == missing or compatible(last[missing - length - 1], token)):
                last.append(token)
                missing += 1
        if len(last) != len(self.data):
            raise ValueError("a byte is missing from the vocabulary")

    def edit(self, start: int, end: int, replacement: bytes) -> int:
        """Replace a range of bytes; gives the number of prefixes that had to be worked out again.

        Where the same token end is reached behind the edit with the same last token and as many bytes of equal history as the longest
        token has, all that follows is as before. What follows is added in growing steps, so the work stays in proportion to what changes.
        """
        v, tail, old = self.vocabulary, bytes(self.data[end:]), self.last[end:]
        del self.data[start:], self.last[start:]
        self.append(replacement)
        first = len(self.last)
        done, same, step = 0, 0, 2 * v.longest
        while done < len(tail):
            self.append(tail[done : done + step])
            for i in range(done, min(done + step, len(tail))):
                same = same + 1 if self.last[first + i] == old[i] else 0
                if same >= v.longest:
                    worked = len(self.last) - start
                    self.data += tail[len(self.last) - first :]
                    self.last += old[len(self.last) - first :]
                    return worked
            done, step = done + step, 2 * step
        return len(self.last) - start

    def encode(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes, of all by default."""
        at, found = len(self.last) if end is None else end, []
        while at:
            found.append(self.last[at - 1])
            at -= len(self.vocabulary.bytes[found[-1]])
        return found[::-1]


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """The vocabulary of a file with a token in base64 and its rank per line."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class Units(dict):
    """The encoding of each unit: a text between two blanks that open words, ``opening`` being the blank before it or nothing."""

    def __init__(self, path: str, opening: str, pattern: str = PATTERN, words: dict[str, list[int]] | None = None):
        super().__init__()
        self.vocabulary, self.cut, self.opening = load(path), regex.compile(pattern).findall, opening
        self.words: dict[str, list[int]] = {} if words is None else words

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        whole = self.vocabulary.ranks.get(raw)
        if len(self.words) >= CACHED_UNITS:
            self.words.clear()
        found = self.words[word] = [whole] if whole is not None else Prefixes(self.vocabulary, raw).encode()
        return found

    def __missing__(self, unit: str) -> list[int]:
        ids: list[int] = []
        for word in self.cut(self.opening + unit):
            ids += self.words.get(word) or self.word(word)
        if len(self) >= CACHED_UNITS:
            self.clear()
        self[unit] = ids
        return ids


@lru_cache(maxsize=4)
def units_of(path: str, pattern: str) -> tuple[Units, Units]:
    """Those that begin a text and those behind a blank; one pair for all tasks that a Python worker works off."""
    first = Units(path, "", pattern)
    return first, Units(path, " ", pattern, first.words)


#: A blank that does not open a word, as no other sign follows it.
_SHUT = regex.compile(r" (?:\s|$)")


def units(text: str) -> list[str]:
    """The text cut before each blank that another sign follows; all but the first come without that blank."""
    parts = text.split(" ")
    if not _SHUT.search(text):
        return parts
    found = parts[:1]
    for part in parts[1:]:
        if part and not part[0].isspace():
            found.append(part)
        else:
            found[-1] += " " + part
    return found


def encoder(path: str, pattern: str = PATTERN) -> Callable[[str | None], list[int]]:
    """A function from a text to its token ids."""
    first, later = units_of(path, pattern)

    def encode(text: str | None) -> list[int]:
        if not text:
            return []
        head, *rest = units(text)
        return [*first[head], *chain.from_iterable([later[unit] for unit in rest])]

    return encode


def counter(path: str) -> Callable[[str | None], int]:
    """A function from a text to its number of tokens."""
    first, later = units_of(path, PATTERN)

    def count(text: str | None) -> int:
        if not text:
            return 0
        head, *rest = units(text)
        return len(first[head]) + sum([len(later[unit]) for unit in rest])

    return count


def encode_documents(documents: DataFrame, path: str = f"{DEFAULT_FOLDER}/{DEFAULT_FILE}") -> DataFrame:
    """doc_id and ids, one row per row of documents. ``path`` has to exist on every executor.

    The ids of a batch are laid out as one array of numbers with offsets, in parts of at most ``PART`` numbers.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        encode = encoder(path)
        seldom_collect()

        def laid(keys, ends, ids):
            values = pa.ListArray.from_arrays(pa.array(np.array([0, *ends], dtype=np.int32)), pa.array(np.array(ids, dtype=np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), values.cast(schema.field("ids").type)], schema=schema)

        for batch in batches:
            keys, ends, ids = [], [], []
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids += encode(text)
                keys.append(key)
                ends.append(len(ids))
                if len(ids) >= PART:
                    yield laid(keys, ends, ids)
                    keys, ends, ids = [], [], []
            if keys:
                yield laid(keys, ends, ids)

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def distinct_documents(encoded: DataFrame) -> DataFrame:
    """One row per document."""
    return encoded.dropDuplicates(["doc_id"]).select(F.col("doc_id"), F.col("ids"))
