"""Symbol indexes in their binary form: occurrences and symbols of documents, read and written without a descriptor file.

An index is a message of documents; a document has a path, occurrences and symbols. Only the fields that the operators use are read; others
are skipped by their wire type, as the format provides. A broken index gives an error that names its file.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import checkpoint, settled

OCCURRENCES = "file string, symbol string, role_bits int, start_line int, start_char int, end_line int, end_char int, doc_order int, pos int"
SYMBOLS = "file string, symbol string, display_name string, doc_order int, pos int"
# Numbers of the format's fields.
_INDEX_DOCUMENT, _PATH, _OCCURRENCE, _SYMBOL = 2, 1, 2, 3
_RANGE, _NAME, _ROLES = 1, 2, 3
_INFO_SYMBOL, _INFO_NAME = 1, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message: a number, or bytes."""
    at, end = 0, len(data)
    while at < end:
        # Most keys and sizes are of one byte.
        key, at = (data[at], at + 1) if data[at] < 128 else _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = (data[at], at + 1) if data[at] < 128 else _varint(data, at)
            if at + size > end:
                raise ValueError("the index ends within a field")
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire type {wire}")
        yield key >> 3, value


def _numbers(data: bytes) -> list[int]:
    if data.isascii():
        return list(data)
    found, at = [], 0
    while at < len(data):
        value, at = _varint(data, at)
        found.append(value)
    return found


def read_index(data: bytes) -> Iterator[tuple[str, list[tuple], list[tuple]]]:
    """Path, occurrences (symbol, roles, range of four) and symbols (symbol, name or None) of each document."""
    for number, document in fields(data):
        if number != _INDEX_DOCUMENT:
            continue
        path, occurrences, symbols = "", [], []
        for part, value in fields(document):
            if part == _PATH:
                path = value.decode()
            elif part == _OCCURRENCE:
                symbol, roles, span = "", 0, []
                for f, v in fields(value):
                    if f == _RANGE:
                        span += _numbers(v) if isinstance(v, bytes) else [v]
                    elif f == _NAME:
                        symbol = v.decode()
                    elif f == _ROLES:
                        roles = v
                # A range of three numbers stays on its line.
                occurrences.append((symbol, roles, *(span if len(span) == 4 else [span[0], span[1], span[0], span[2]])))
            elif part == _SYMBOL:
                symbol, name = "", None
                for f, v in fields(value):
                    if f == _INFO_SYMBOL:
                        symbol = v.decode()
                    elif f == _INFO_NAME:
                        name = v.decode() or None
                symbols.append((symbol, name))
        yield path, occurrences, symbols


_SMALL = [bytes([n]) for n in range(128)]


def _number(value: int) -> bytes:
    if 0 <= value < 128:
        return _SMALL[value]
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    return _number(number << 3 | 2) + _number(len(value)) + value


def write_index(documents: Iterable[tuple[str, list[tuple], list[tuple]]]) -> bytes:
    """The index of documents in the form that ``read_index`` gives."""
    out = bytearray()
    for path, occurrences, symbols in documents:
        body = bytearray(_field(_PATH, path.encode()))
        for symbol, roles, a, b, c, d in occurrences:
            span = [a, b, d] if a == c else [a, b, c, d]
            body += _field(_OCCURRENCE, _field(_RANGE, b"".join(map(_number, span))) + _field(_NAME, symbol.encode()) + (_field(_ROLES, roles) if roles else b""))
        for symbol, name in symbols:
            body += _field(_SYMBOL, _field(_INFO_SYMBOL, symbol.encode()) + (_field(_INFO_NAME, name.encode()) if name else b""))
        out += _field(_INDEX_DOCUMENT, bytes(body))
    return bytes(out)


def parse_indexes(indexes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences and symbols of indexes (name, content). Documents are numbered within their index; ``resolve`` orders them by that.

    A part of an index (``to_indexes``) has in first_document the number of documents in the parts before.
    """
    kinds = {"int": pa.int32(), "string": pa.string()}
    first = F.col("first_document") if "first_document" in indexes.columns else F.lit(0)

    def rows(schema: str, of):
        names = [c.split()[0] for c in schema.split(", ")]
        types = [kinds[c.split()[1]] for c in schema.split(", ")]

        def run(batches):
            for batch in batches:
                for name, first, content in zip(*batch.columns):
                    found = (row for n, document in enumerate(read_index(content.as_py() or b""), first.as_py()) for row in of(n, *document))
                    try:
                        while chunk := list(islice(found, 50_000)):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk), types)], names=names)
                    except (IndexError, ValueError) as e:
                        raise ValueError(f"{name} is no index: {e}") from e

        return indexes.select("name", first.alias("first_document"), "content").mapInArrow(run, schema)

    return (
        rows(OCCURRENCES, lambda n, path, occurrences, symbols: [(path, *o, n, i) for i, o in enumerate(occurrences)]),
        rows(SYMBOLS, lambda n, path, occurrences, symbols: [(path, *s, n, i) for i, s in enumerate(symbols)]),
    )


def read_indexes(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Occurrences and symbols of index files."""
    return parse_indexes(spark.read.format("binaryFile").load(list(paths)).select(F.col("path").alias("name"), "content"))


def _parts(rows: Iterable[tuple], part_bytes: int) -> Iterator[tuple[str, str, int, bytes]]:
    """Index, first path, number of documents and content of each part, from rows (index, path, kind, position, symbol, ...) in this order."""
    for name, of_index in groupby(rows, key=lambda r: r[0]):
        first, n, content = None, 0, bytearray()
        for path, of_document in groupby(of_index, key=lambda r: r[1]):
            occurrences, symbols = [], []
            for _, _, kind, _, symbol, *occurrence, display_name in of_document:
                if kind == _OCCURRENCE:
                    occurrences.append((symbol, *occurrence))
                else:
                    symbols.append((symbol, display_name))
            document = write_index([(path, occurrences, symbols)])
            if n and len(content) + len(document) > part_bytes:
                yield name, first, n, bytes(content)
                n, content = 0, bytearray()
            first, n = first if n else path, n + 1
            content += document
        yield name, first, n, bytes(content)


def to_indexes(occurrences: DataFrame, symbols: DataFrame, by: str = "file", part_bytes: int = 4 << 20) -> DataFrame:
    """name, first_document, content: an index per value of ``by``, of the occurrences (OCCURRENCES) and symbols (SYMBOLS) that have it.

    The documents of an index are in order of their paths. It comes in parts of at most ``part_bytes``, or one document, so that no task
    holds a large index; first_document is the number of documents in the parts before, and the contents in this order, joined, are the index.
    """
    key, numbers = F.col(by).cast("string").alias("name"), ["role_bits", "start_line", "start_char", "end_line", "end_char"]
    rows = occurrences.select(key, "file", F.lit(_OCCURRENCE).alias("kind"), "pos", "symbol", *numbers).unionByName(symbols.select(key, "file", F.lit(_SYMBOL).alias("kind"), "pos", "symbol", "display_name"), allowMissingColumns=True)
    names = ["name", "part", "n_documents", "content"]

    def run(batches):
        held, size = [], 0
        for part in _parts((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))), part_bytes):
            held.append(part)
            size += len(part[3])
            if size >= part_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    types = [pa.string(), pa.string(), pa.int32(), pa.binary()]
    # All rows of a document are in one range, and ranges and the rows in them are in order.
    parts = checkpoint(rows.repartitionByRange("name", "file").sortWithinPartitions(*rows.columns).mapInArrow(run, "name string, part string, n_documents int, content binary"))
    before = F.sum("n_documents").over(Window.partitionBy("name").orderBy("part")) - F.col("n_documents")
    later = settled(parts.select(F.col("name").alias("_name"), F.col("part").alias("_part"), before.cast("int").alias("_before")).filter("_before > 0"))
    joined = parts.join(later, F.col("name").eqNullSafe(F.col("_name")) & (F.col("part") == F.col("_part")), "left")
    return joined.select("name", F.coalesce("_before", F.lit(0)).alias("first_document"), "content")
