"""Full-text, prefix, vector and hybrid search."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import similarity_of, tokens
from quarry.session import shared_folder

#: Queries, and numbers in their vectors, that are sent to the tasks at once: 16 MB.
BLOCK, BLOCK_NUMBERS = 10_000, 2_000_000
#: Queries whose distances to a batch are held at once.
CHUNK = 256
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def check_request(top_k: int = 10, limit: int = 10, offset: int = 0, query: str = "x", searches: int = 1) -> None:
    """Raises ValueError for a request outside the bounds of the service."""
    for name, value, low, high in (("top_k", top_k, 1, 200), ("limit", limit, 1, 50), ("offset", offset, 0, None), ("searches", searches, 1, 5)):
        if value < low or high is not None and value > high:
            raise ValueError(f"{name} must be {low}" + (f" to {high}" if high is not None else " or more"))
    if not query:
        raise ValueError("the query is empty")


#: Bounds of a request's numbers, both ends included; fixed values.
BOUNDS = {"top_k": (1, 200), "limit": (1, 50), "offset": (0, None), "k": (1, 100), "searches": (1, 5)}


def request_errors(requests: DataFrame) -> DataFrame:
    """The requests with ``error``: what is wrong with them first, or null. Looks at those columns of BOUNDS that there are, and at query."""
    checks = []
    for name, (low, high) in BOUNDS.items():
        if name in requests.columns:
            outside = F.col(name) < low if high is None else ~F.col(name).between(low, high)
            checks.append(F.when(outside, F.lit(f"{name} must be {low}" + (f" to {high}" if high is not None else " or more"))))
    if "query" in requests.columns:
        checks.append(F.when(F.coalesce(F.length("query"), F.lit(0)) < 1, F.lit("the query is empty")))
    return requests.withColumn("error", F.coalesce(*checks) if checks else F.lit(None).cast("string"))


def postings(documents: DataFrame) -> DataFrame:
    """id, term, tf, length of the documents (id, text): one row per document and term."""
    words = documents.select("id", tokens(F.coalesce("text", F.lit(""))).alias("words"))
    flat = words.select("id", F.size("words").alias("length"), F.explode("words").alias("term"))
    return flat.groupBy("id", "length", "term").agg(F.count("*").alias("tf"))


def query_terms(spark: SparkSession, query: str) -> list[str]:
    return [t for t in spark.range(1).select(F.array_distinct(tokens(F.lit(query))).alias("t")).first().t]


def bm25(documents: DataFrame, query: str, match_all: bool = True, prefix: bool = False) -> DataFrame:
    """id, rank of the documents (id, text) that match; lower is better, as ranks are negated scores.

    All terms have to occur, or any of them without ``match_all``; with ``prefix`` the last term matches words that begin with it.
    Documents are scanned once: a document's own terms are counted where it lies, and only matching documents reach the ranking.
    """
    spark = documents.sparkSession
    terms = query_terms(spark, query)
    words = documents.select("id", tokens(F.coalesce("text", F.lit(""))).alias("words"))
    if not terms:
        return words.select("id", F.lit(0.0).alias("rank")).limit(0)

    def matches(i: int):
        if prefix and i == len(terms) - 1:
            return lambda w: w.startswith(terms[i])
        return lambda w: w == terms[i]

    counted = words.select("id", F.size("words").alias("length"), *[F.size(F.filter("words", matches(i))).alias(f"tf{i}") for i in range(len(terms))])
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    hit = [F.col(f"tf{i}") > 0 for i in range(len(terms))]
    condition = hit[0]
    for h in hit[1:]:
        condition = condition & h if match_all else condition | h
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(LEAST_IDF))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return counted.filter(condition).crossJoin(F.broadcast(stats)).select("id", (-score).alias("rank"))


#: Words that two phrases of NEAR may have between them, unless the query says otherwise; a fixed value.
NEAR_WORDS = 10
_SIGN = re.compile(r'\s*(?:(?P<text>"(?:[^"]|"")*")|(?P<word>[\w\u0080-\U0010ffff]+)|(?P<sign>[()*+,^]))')


class QueryError(ValueError):
    """A full-text query outside the grammar."""


def parse_query(query: str) -> tuple:
    """The tree of a full-text query.

    Nodes: ("and" | "or" | "not", left, right), ("near", [phrases], n), ("phrase", text, prefix, first). NOT binds closest, then AND, which also
    stands between parts without an operator, then OR; brackets group. A phrase is a word or a quoted text, ``+`` joins phrases, ``*`` behind it
    makes its last word a prefix, ``^`` before it demands the start of the text. NEAR(a b, n) wants its phrases with at most n words between.
    The operators are words in capitals. Anything else is an error.
    """
    signs: list[tuple[str, str]] = []
    at = 0
    while query[at:].strip():
        m = _SIGN.match(query, at)
        if m is None:
            raise QueryError(f"unexpected {query[at:].strip()[0]!r} in the query")
        kind = m.lastgroup
        signs.append((kind, m.group(kind)[1:-1].replace('""', '"') if kind == "text" else m.group(kind)))
        at = m.end()
    signs.append(("end", ""))
    place = 0

    def here(kind: str, text: str | None = None) -> bool:
        return signs[place][0] == kind and (text is None or signs[place][1] == text)

    def need(kind: str, text: str | None = None) -> str:
        nonlocal place
        if not here(kind, text):
            raise QueryError(f"expected {text or kind} before {signs[place][1] or 'the end'!r}")
        place += 1
        return signs[place - 1][1]

    def phrase() -> tuple:
        nonlocal place
        first = here("sign", "^")
        place += first
        words = [need("text") if here("text") else need("word")]
        while here("sign", "+"):
            place += 1
            words.append(need("text") if here("text") else need("word"))
        prefix = here("sign", "*")
        place += prefix
        return "phrase", " ".join(words), prefix, first

    def part() -> tuple:
        nonlocal place
        if here("sign", "("):
            place += 1
            inner = either()
            need("sign", ")")
            return inner
        if here("word", "NEAR") and signs[place + 1] == ("sign", "("):
            place += 2
            phrases = [phrase()]
            while not here("sign", ")") and not here("sign", ","):
                phrases.append(phrase())
            words = NEAR_WORDS
            if here("sign", ","):
                place += 1
                number = need("word")
                if not number.isdecimal():
                    raise QueryError("NEAR needs a number behind its comma")
                words = int(number)
            need("sign", ")")
            return "near", phrases, words
        if here("word") and signs[place][1] in ("AND", "OR", "NOT"):
            raise QueryError(f"{signs[place][1]} has nothing before it")
        return phrase()

    def without() -> tuple:
        nonlocal place
        left = part()
        while here("word", "NOT"):
            place += 1
            left = ("not", left, part())
        return left

    def both() -> tuple:
        nonlocal place
        left = without()
        while not here("end") and not here("sign", ")") and not here("word", "OR"):
            place += here("word", "AND")
            left = ("and", left, without())
        return left

    def either() -> tuple:
        nonlocal place
        left = both()
        while here("word", "OR"):
            place += 1
            left = ("or", left, both())
        return left

    tree = either()
    need("end")
    return tree


def _plain_tokens(text: str) -> list[str]:
    """The tokens of a text on the driver, as ``tokens`` gives them in a plan."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", bare)


def _starts(words: Column, phrase: list[str], prefix: bool) -> Column:
    """The places at which a phrase begins. No function captures the words, which would be worked out again for each of them."""

    def is_word(k: int):
        whole = not (prefix and k == len(phrase) - 1)
        return lambda w: w == phrase[k] if whole else F.startswith(w, F.lit(phrase[k]))

    flags = F.transform(words, is_word(0))
    for k in range(1, len(phrase)):
        behind = F.transform(words, is_word(k))
        flags = F.zip_with(flags, F.slice(behind, F.lit(k + 1), F.greatest(F.size(behind) - k, F.lit(0))), lambda a, b: F.coalesce(a & b, F.lit(False)))
    return F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda x: x.isNotNull())


def _near(words: Column, phrases: list[tuple[list[str], bool]], between: int) -> Column:
    """Whether all phrases stand near each other: one walk over their places in order, with the last place of each."""

    def placed(k: int):
        return lambda at: F.struct(at.alias("at"), F.lit(k).alias("which"))

    places = F.array_sort(F.concat(*[F.transform(_starts(words, p, prefix), placed(k)) for k, (p, prefix) in enumerate(phrases)]))
    nowhere = F.lit(-(1 << 30))
    start = F.struct(F.lit(False).alias("near"), *[nowhere.alias(f"last{k}") for k in range(len(phrases))])

    def step(state: Column, place: Column) -> Column:
        last = [F.when(place["which"] == k, place["at"]).otherwise(state[f"last{k}"]) for k in range(len(phrases))]
        together = F.lit(True)
        for (p, _), at in zip(phrases, last):
            together = together & (place["at"] - at <= len(p) + between)
        return F.struct((state["near"] | together).alias("near"), *[at.alias(f"last{k}") for k, at in enumerate(last)])

    return F.aggregate(places, start, step, lambda state: state["near"])


def match_condition(words: Column, line: Column, tree: tuple) -> Column:
    """Whether a document matches a parsed query; ``words`` are its tokens, ``line`` these with a blank around each."""
    kind = tree[0]
    if kind in ("and", "or", "not"):
        left, right = match_condition(words, line, tree[1]), match_condition(words, line, tree[2])
        return left & right if kind == "and" else left | right if kind == "or" else left & ~right
    if kind == "near":
        phrases = [(_plain_tokens(text), prefix) for _, text, prefix, _ in tree[1]]
        if not all(p for p, _ in phrases):
            return F.lit(False)
        present = F.lit(True)
        for phrase in tree[1]:
            present = present & match_condition(words, line, phrase)
        return F.when(present, _near(words, phrases, tree[2])).otherwise(False)
    _, text, prefix, first = tree
    phrase = _plain_tokens(text)
    if not phrase:
        return F.lit(False)
    wanted = F.lit(" " + " ".join(phrase) + ("" if prefix else " "))
    return F.startswith(line, wanted) if first else F.contains(line, wanted)


def matching(documents: DataFrame, query: str) -> DataFrame:
    """id of the documents (id, text) that match a query of the whole grammar; null texts match nothing. Raises QueryError for a broken query."""
    tree = parse_query(query)
    words = documents.select("id", tokens(F.coalesce("text", F.lit(""))).alias("words"))
    line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    return words.select("id", "words", line.alias("line")).filter(match_condition(F.col("words"), F.col("line"), tree)).select("id")


def one_minus_similarity(hits: DataFrame) -> DataFrame:
    """The hits with 1 - similarity as their distance, as tools that expect a distance want it."""
    return hits.withColumn("distance", F.lit(1.0) - F.col("similarity"))


def top(df: DataFrame, k: int, *order: Column | str, offset: int = 0) -> DataFrame:
    """The first k rows of a total order."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(k)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, query: list[float], k: int = 10, entity_type: str | None = None, post_filter: bool = True) -> DataFrame:
    """entity_type, entity_id, distance: the k nearest vectors by Euclidean distance, exactly.

    A type is filtered after the k nearest were found, so that fewer may come out, or before with ``post_filter`` off.
    """
    rows = vectors if entity_type is None or post_filter else vectors.filter(F.col("entity_type") == entity_type)
    vector = F.array(*[F.lit(float(x)) for x in query])
    found = top(rows.filter("embedding IS NOT NULL").select("entity_type", "entity_id", l2_distance(F.col("embedding"), vector).alias("distance")), k, "distance", "entity_type", "entity_id")
    return found.filter(F.col("entity_type") == entity_type) if entity_type is not None and post_filter else found


def _blocks(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """The queries (id, vector, k) in lists that are small enough to be sent."""
    rows = iter(rows)
    for first in rows:
        size = min(BLOCK, max(1, BLOCK_NUMBERS // max(1, len(first[1]))))
        yield [first, *islice(rows, size - 1)]


def _nearest_of_block(vectors: DataFrame, rows: list[tuple]) -> DataFrame:
    """query_id, entity_id, distance, k: at least the k nearest vectors of each query; each task keeps its own best.

    The block of queries is broadcast. Products of matrices give all distances of a batch at once up to rounding; those that may be among
    the k nearest are then worked out exactly, so that the result does not depend on how rows are batched.
    """
    import numpy as np

    ids, ks = [r[0] for r in rows], [r[2] for r in rows]
    shared = vectors.sparkSession.sparkContext.broadcast(np.array([r[1] for r in rows], dtype=np.float64))

    def best(batches):
        queries = shared.value
        squares = (queries**2).sum(axis=1) if len(ids) else None
        kept: list[list[tuple[float, int]]] = [[] for _ in ids]
        for batch in batches:
            n = batch.num_rows
            if not n or not ids:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat) != n * queries.shape[1]:
                raise ValueError("the vectors and the queries differ in length")
            block, entities = flat.reshape(n, -1), batch.column(0).to_numpy(zero_copy_only=False)
            own = (block**2).sum(axis=1)
            for at in range(0, len(ids), CHUNK):
                part = slice(at, at + CHUNK)
                near = own[:, None] + squares[part] - 2 * (block @ queries[part].T)
                slack = 1e-9 * (own.max() + squares[part].max() + 1)
                for j in range(near.shape[1]):
                    q = at + j
                    edge = np.partition(near[:, j], min(ks[q], n) - 1)[min(ks[q], n) - 1]
                    found = np.flatnonzero(near[:, j] <= edge + slack)
                    exact = np.sqrt(((block[found] - queries[q]) ** 2).sum(axis=1))
                    kept[q] = sorted([*kept[q], *zip(exact.tolist(), entities[found].tolist())])[: ks[q]]
        flat_rows = [(ids[q], int(e), d, ks[q]) for q in range(len(ids)) for d, e in kept[q]]
        columns = list(zip(*flat_rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32()))], names=["query_id", "entity_id", "distance", "k"])

    return vectors.filter("embedding IS NOT NULL").select("entity_id", "embedding").mapInArrow(best, "query_id bigint, entity_id bigint, distance double, k int")


def nearest_batch(vectors: DataFrame, queries: DataFrame, default_k: int = 10) -> DataFrame:
    """query_id, entity_id, distance, position: the nearest vectors of each query (query_id, vector, k), for a stated set of queries.

    The queries, of any number, are sent to the vectors in bounded blocks, one after the other; each task keeps only its own best per
    query before anything is shuffled. Where one block does not hold them all, each block's best are written below the shared folder
    and merged at the end, as the rows of a repeated query may lie in several blocks.
    """
    order = Window.partitionBy("query_id").orderBy("distance", "entity_id")

    def first(partial: DataFrame) -> DataFrame:
        return partial.withColumn("position", F.row_number().over(order)).filter("position <= k")

    found = queries.filter("vector IS NOT NULL").select("query_id", "vector", "k").toLocalIterator()
    blocks = _blocks((r.query_id, [float(x) for x in r.vector], r.k or default_k) for r in found)
    block, second = next(blocks, []), next(blocks, None)
    if second is None:
        return first(_nearest_of_block(vectors, block)).drop("k")
    spark, folder = vectors.sparkSession, shared_folder(vectors.sparkSession, "nearest")
    for rows in chain([block, second], blocks):
        first(_nearest_of_block(vectors, rows)).drop("position").write.mode("append").parquet(folder)
    return first(spark.read.parquet(folder)).drop("k")


def best_per_entity(hits: DataFrame) -> DataFrame:
    """The lowest distance per entity (entity_type, entity_id, distance, source_order); ties go to the earlier source."""
    return hits.groupBy("entity_type", "entity_id").agg(F.min(F.struct("distance", "source_order")).alias("m")).select("entity_type", "entity_id", F.col("m.distance").alias("distance"), F.col("m.source_order").alias("source_order"))


def hybrid(sources: list[DataFrame], k: int) -> DataFrame:
    """entity_type, entity_id, distance, source_order: the union of hits (entity_type, entity_id, distance) of several sources, the lowest distance per entity, the first k."""
    rows = [s.select("entity_type", "entity_id", F.col("distance").cast("double").alias("distance"), F.lit(i).alias("source_order")) for i, s in enumerate(sources)]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    return top(best_per_entity(union), k, "distance", "source_order", "entity_type", "entity_id")


def hybrid_rrf(sources: list[DataFrame], k: int, constant: int = 60, depth: int = 1000) -> DataFrame:
    """entity_type, entity_id, score: reciprocal rank fusion of the sources' own lists of the ``depth`` nearest (entity_type, entity_id, distance), a parameter of the fusion."""
    ranked = []
    for s in sources:
        # A source's own list ends at ``depth``, so its ranks are those of a bounded list, not of all its rows in one task.
        best = top(s.select("entity_type", "entity_id", "distance"), depth, "distance", "entity_type", "entity_id")
        w = Window.orderBy("distance", "entity_type", "entity_id")
        ranked.append(best.select("entity_type", "entity_id", (F.lit(1.0) / (constant + F.row_number().over(w))).alias("part")))
    union = ranked[0]
    for r in ranked[1:]:
        union = union.unionByName(r)
    return top(union.groupBy("entity_type", "entity_id").agg(F.sum("part").alias("score")), k, F.desc("score"), "entity_type", "entity_id")


def dispatch(mode: str, has_key: bool) -> tuple[str, ...]:
    """The sources that a mode of search asks; semantic search needs a key, hybrid search goes without vectors where there is none."""
    table = {"symbol": ("definitions",), "path": ("files",), "hybrid": ("vector", "definitions", "files") if has_key else ("definitions", "files")}
    if mode == "semantic":
        if not has_key:
            raise ValueError("semantic search needs an embedding key")
        return ("vector",)
    if mode not in table:
        raise ValueError(f"unknown mode {mode!r}")
    return table[mode]


def hydrate(hits: DataFrame, files: DataFrame, definitions: DataFrame, nested: bool = False) -> DataFrame:
    """The hits (entity_type, entity_id, distance) with name, path, summary and similarity; hits without a row are dropped.

    ``nested``: file hits also bring their definitions in order (definition_id, name, definition_type, start_line), which is for the few hits
    of a search, and definition hits none.
    """
    f = files.select(F.lit("file").alias("entity_type"), F.col("id").alias("entity_id"), F.col("file_path").alias("f_path"), F.col("ai_short_summary").alias("f_summary")).dropDuplicates(["entity_id"])
    home = files.select(F.col("id").alias("file_id"), F.col("file_path").alias("d_path")).dropDuplicates(["file_id"])
    d = definitions.select(F.lit("definition").alias("entity_type"), F.col("id").alias("entity_id"), "file_id", F.col("name").alias("d_name"), F.col("ai_short_summary").alias("d_summary")).dropDuplicates(["entity_id"]).join(home, "file_id", "left").drop("file_id")
    joined = hits.join(f, ["entity_type", "entity_id"], "left").join(d, ["entity_type", "entity_id"], "left")
    path = F.coalesce("f_path", "d_path")
    name = F.when(F.col("entity_type") == "file", F.substring_index("f_path", "/", -1)).otherwise(F.col("d_name"))
    columns = ["entity_type", "entity_id", "name", path.alias("path"), F.coalesce("f_summary", "d_summary").alias("summary"), "distance", similarity_of(F.col("distance")).alias("similarity")]
    found = joined.withColumn("name", name).filter("name IS NOT NULL").select(*columns)
    if not nested:
        return found
    wanted = hits.filter("entity_type = 'file'").select(F.col("entity_id").alias("file_id")).distinct()
    rows = definitions.select(F.col("id").alias("definition_id"), "file_id", "name", "definition_type", "start_line").dropDuplicates(["definition_id"]).join(wanted, "file_id", "left_semi")
    lists = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start_line", "definition_id", "name", "definition_type"))).alias("definitions"))
    return found.join(lists.select(F.lit("file").alias("entity_type"), F.col("file_id").alias("entity_id"), "definitions"), ["entity_type", "entity_id"], "left")


def by_similarity(hydrated: DataFrame) -> DataFrame:
    """Hits in the order in which they are shown: the most similar first, ties by type and id."""
    return hydrated.orderBy(F.desc("similarity"), "entity_type", "entity_id")


def response(hits: DataFrame) -> DataFrame:
    """The hits with what a response has to have: fallbacks for name, path and time; a hit without type or id is an error."""
    key = F.coalesce(F.concat_ws(":", "entity_type", F.col("entity_id").cast("string")), F.lit(""))
    whole = F.when(F.col("entity_type").isNull() | F.col("entity_id").isNull(), F.raise_error(F.concat(F.lit("a hit lacks its type or id: "), key))).otherwise(F.col("entity_type"))
    name = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.when(F.col("path") != "", F.substring_index("path", "/", -1)), F.lit("unknown"))
    return hits.select(whole.alias("entity_type"), "entity_id", name.alias("name"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("created_at", F.lit("1970-01-01 00:00:00").cast("timestamp")).alias("created_at"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def rendered(hydrated: DataFrame) -> DataFrame:
    """A line per hit for reading: kind, name, percentage with one decimal, path and summary."""
    percent = F.format_string("%.1f", F.round(F.col("similarity") * 100, 1))
    line = F.concat_ws("", F.when(F.col("entity_type") == "file", F.lit("File ")).otherwise(F.lit("Definition ")), F.col("name"), F.lit(" ("), percent, F.lit("%) in "), F.coalesce("path", F.lit("?")), F.lit(": "), F.coalesce("summary", F.lit("No summary")))
    return hydrated.select("entity_type", "entity_id", line.alias("line"))


def result_statistics(hits: DataFrame) -> DataFrame:
    """Number of hits with their highest and lowest similarity, 0 without hits."""
    s = similarity_of(F.col("distance"))
    return hits.agg(F.count("*").alias("n_results"), F.coalesce(F.max(s), F.lit(0.0)).alias("max_similarity"), F.coalesce(F.min(s), F.lit(0.0)).alias("min_similarity"))
