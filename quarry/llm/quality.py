"""Per-document text quality statistics, and the type of text that follows from them (problem 10).

1. ``pair_counts`` counts, over all documents, which frequent words stand next to which: a table bounded by the square of the fixed
   list of common words. It tells word order from words thrown together, in any language of the list.
2. ``statistics`` gives each document its figures: word count, mean word length, symbol ratio, share of lines ending in punctuation,
   share of common words, and the shares of words in lists, tables, code and logs, navigation, noise and repeated sentences.
3. ``VOTES`` are noisy labelling functions, one threshold on one statistic each: it speaks for one type of text or abstains.
   ``learn`` finds their accuracies by expectation-maximization on their agreements. The votes of a document are a bit pattern,
   so the iterations run over counts of patterns (at most 2 to the number of functions, most never occur), not over documents.
   ``vote_accuracies`` reports what was learned.
4. ``text_types`` gives the posterior of each type and the most probable one.

No label is used; the labelled sample serves the tests alone. Nulls: a document with a null or empty text has zero counts, null
ratios and no type; an unknown language needs nothing, as the common words of all languages are looked for. Repeated rows give one
row. Texts are read whole. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import map_lists
from quarry.session import checkpoint, spread

TYPES = ("prose", "list", "table", "code", "junk")
#: The list of common words is fixed; a larger one than this is refused, as its square is sent to every task.
MAX_COMMON_WORDS = 4000

_ALNUM = re.compile(r"[^\W_]")
#: Signs around a word; each counts as a symbol.
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SYMBOL = re.compile(r"[^\w\s]|_")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TAG = re.compile(r"</?gist>")
#: Code named within a sentence is one word of it, whatever signs it has and wherever the line breaks.
_INLINE = re.compile(r"(?<!`)`(?!`)[^`\n]{1,120}(?:\r?\n[^`\n]{1,120})?`(?!`)")
_LETTERS = str.maketrans("0123456789", "ghijklmnop")
_CELL_TAG = re.compile(r"</?t[dhr]\b[^>]*>")
#: A sentence that follows itself at least so often, run by run, is repeated over and over.
LEAST_RUN = 5
#: Mean association of neighbouring common words below which a text has no order; grammatical text lies above 1.5 in every language.
ORDERED = 1.2
_BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u200c\u200d\u202f\u205f\u2060\u3000\ufeff \t"
_TERMINAL = re.compile(r"[.!?…。:;][\"'”’»)\]]*$")
#: What the last character of a line that ends in punctuation can be.
_LAST = frozenset(".!?…。\"'”’»)]")
_STOP = re.compile(r"[.!?…。][\"'”’»)\]]*$")
_BULLET = re.compile(r"^(?:[-*+•·–—‣◦▪o](?:\s+\[[ xX]\])?|\[[ xX]\]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+")
_PATH = re.compile(r"^(?:[\w.-]+/)+[\w.-]+[,;.]?$")
_KEY_VALUE = re.compile(r"^[\w-]+\s*[:=]\s+\S+(?:\s\S+){0,3}$|^[\w-]+\s*:\s*\S+$")
_LOG = re.compile(r"^(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE)\b|at [\w.$<>]+ ?\([^)]*\)|File \"[^\"]+\", line \d+|Traceback \(|[0-9a-f]{6,16}:?\s+(?:[0-9a-f]{2}\s+){3}|\$ |>>> |diff --git|@@ -\d|[+-]{3} [ab]/)")
#: What a line of a log can begin with.
_LOG_FIRST = frozenset("[0123456789abcdefFIWEDT$>@+-")
_CODE = re.compile(
    r"^(?:(?:export |async |public |private |static )*(?:def|function|class|interface|enum)\s+\w+.*[({:]|(?:const|let|var)\s+[\w{\[]|import\s+.+|from\s+\S+\s+import\s|return\b(?:\s+[\w.\[\]()'\"]+)?;?$|return\b.*[;()]|(?:if|for|while|switch|with|elif|except|catch)\b.*[:{)]$|(?:try|else|finally|default)\s*[:{]?$|(?:raise|throw|assert|del|break|continue|pass|case)\b.*[;:()]?$"
    r"|[}\])]+[;,)]*.*$|.*[{;]$|[\w.\[\]\"'?]+\s*(?:=|\+=|-=)\s*\S.*|[\w.?]+\(.*\)[;:]?$|@\w+$|[\w\"']+:\s*[\w.\[{\"'].*,$|(?:logger|console)\.\w+\(|#!|\"{3}|`+;?$|\$\{|<\w+[^>]*>.*|SELECT\s|INSERT\s)"
)
_CODE_SHAPE = re.compile(r"[{}()=;\[\]<>_`$\"'|]|\w\.\w")
#: What a plain sentence has not: signs of tables and navigation, wide blanks, the letter or number of a list item.
_SHAPED = re.compile(r"[\t|<>·»/•;]|\s\s|^.[.)]")
_NAVIGATES = re.compile(r" [|·>»/•] ")
_CELLS = re.compile(r"\s{2,}|\t")

#: Columns of the statistics besides doc_id, in the order of the tuple that ``measure`` gives.
FIELDS = (
    "word_count bigint, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double,"
    " list_share double, table_share double, code_share double, navigation_share double, noise_share double, repeated_share double, sentence_share double, order_score double"
)


class Runs(dict):
    """What is known of a run of characters without blanks, worked out once and looked up after that.

    run: (is a word, its words, their letters, common ones among them, signs, the number of each word among the common ones or 0,
    whether a sentence can end with it, whether it names code, the first three figures in one number, the next two in another).
    A text shorter than ``FIELD`` characters is summed by these two numbers, as no figure outgrows its part.
    """

    FIELD = 1 << 20

    #: Runs that are held at once; a text brings new ones for ever, as numbers and ids do.
    MOST = 300_000

    def __init__(self, common: frozenset[str]):
        super().__init__()
        self.numbers = {w: i + 1 for i, w in enumerate(sorted(common))}

    def __missing__(self, run: str) -> tuple:
        core = run if run.isalpha() else run.strip(_PUNCTUATION)
        stops = run[-1] in _LAST and _STOP.search(run) is not None
        if core.isalpha():
            number = self.numbers.get(core.lower(), 0)
            found = (True, 1, len(core), int(number > 0), len(run) - len(core), (number,), stops, "inlinecode" in run)
        else:
            words = _WORD.findall(run)
            marks = tuple(self.numbers.get(w.lower(), 0) for w in words)
            found = (_ALNUM.search(run) is not None, len(words), sum(map(len, words)), len(marks) - marks.count(0), len(_SYMBOL.findall(run)), marks, stops, "inlinecode" in run)
        if len(self) >= self.MOST:
            self.clear()
        is_word, words, letters, common, signs = found[:5]
        found = self[run] = (*found, is_word + words * self.FIELD + letters * self.FIELD**2, common + signs * self.FIELD)
        return found

    def sums(self, entries: list[tuple], short: bool) -> tuple[int, int, int, int, int]:
        """The first five figures summed over the entries of a text."""
        if not short:
            return tuple(sum(e[i] for e in entries) for i in range(5))
        a, b = sum([e[8] for e in entries]), sum([e[9] for e in entries])
        low = self.FIELD - 1
        return a & low, a // self.FIELD & low, a // self.FIELD**2, b & low, b // self.FIELD


@lru_cache(maxsize=2)
def runs_of(common: frozenset[str]) -> Runs:
    """One for all tasks that a Python worker works off, as these are kept for several."""
    return Runs(common)


def pair_counts(documents: DataFrame, common: frozenset[str]) -> DataFrame:
    """a, b, n over all documents: how often common word number a directly stands before number b; b is 0 for how often a occurs at all.

    A batch is summed as one array of numbers before it leaves its task, so that a task gives each pair once per batch.
    """
    base = len(common) + 1

    def make():
        known = runs_of(common)

        def run(texts):
            codes: list[int] = []
            for text in texts:
                if text:
                    codes.append(0)
                    for r in text.split():
                        codes += known[r][5]
            marks = np.array(codes, dtype=np.int64)
            left, right = marks[:-1], marks[1:]
            both = (left > 0) & (right > 0)
            for values in (left[both] * base + right[both], marks[marks > 0] * base):
                for code, n in zip(*(x.tolist() for x in np.unique(values, return_counts=True))):
                    yield code // base, code % base, n

        return run

    partial = map_lists(spread(documents.select("text")), make, "a int, b int, n bigint")
    return partial.groupBy("a", "b").agg(F.sum("n").alias("n"))


def associations(counts: dict[tuple[int, int], int], size: int) -> np.ndarray:
    """Pointwise mutual information of each pair of common words, within -3 and 3, and -3 for words that never stand together; the row and column 0 mean nothing."""
    found = np.full((size + 1, size + 1), -3.0, dtype=np.float32)
    single = {a: n for (a, b), n in counts.items() if not b}
    total = sum(single.values()) or 1
    pairs = sum(n for (_, b), n in counts.items() if b) or 1
    for (a, b), n in counts.items():
        if b:
            found[a, b] = max(-3.0, min(3.0, math.log((n / pairs) / ((single[a] / total) * (single[b] / total)))))
    return found


def _inline(m: re.Match) -> str:
    """A word of letters in place of code, the same for the same code."""
    return "inlinecode" + f"{zlib.crc32(m.group().encode()):08x}".translate(_LETTERS)


def _clean(line: str) -> str:
    return line.strip(_BLANKS).strip()


def _kind(line: str, n: int, stops: bool) -> str:
    """What a line is by its form; ``n``: its words, ``stops``: whether it ends as a sentence does. ``text`` leaves it to the block it stands in."""
    if line[0] in _LOG_FIRST and _LOG.match(line):
        return "code"
    if n >= 8 and line[0].isupper() and not _SHAPED.search(line) and stops:
        return "text"
    if "<td>" in line or "<tr>" in line or "<th>" in line or line.startswith("|") and line.endswith("|") and line.count("|") > 2:
        return "table"
    if line.count("\t") >= 2 or len(cells := [c for c in _CELLS.split(line) if c]) >= 3 and n <= 3 * len(cells):
        return "table"
    if _NAVIGATES.search(line):
        for mark, least in ((" | ", 1), (" · ", 1), (" > ", 2), (" » ", 1), (" / ", 2), (" • ", 2)):
            if line.count(mark) >= least:
                pieces = [p for p in line.split(mark) if p.strip()]
                if n <= 9 * len(pieces):
                    return "table" if sum(c.isdigit() for c in line) > 0.15 * len(line) else "navigation"
    if not stops:
        for mark, least, words in ((";", 3, 5), (",", 4, 2.2), ("|", 3, 5)):
            pieces = line.count(mark) + 1
            if pieces >= least and n <= words * pieces:
                return "table"
    if _BULLET.match(line):
        return "list" if n <= 10 or not stops and n <= 12 else "text"
    if _PATH.match(line) or _KEY_VALUE.match(line):
        return "list"
    if (shape := len(_CODE_SHAPE.findall(line))) and shape >= 0.15 * n and _CODE.match(line) and not (n > 6 and line[:1].isupper() and stops):
        return "code"
    if line.startswith("#"):
        return "heading"
    return "text"


_KINDS = ("list", "table", "code", "navigation", "noise", "repeated", "sentence", "heading")


def _wordless(line: str) -> bool:
    return not _ALNUM.search(line)


class Meter:
    """Gives each text its figures, in the order of FIELDS; it remembers the runs of characters that it has met."""

    def __init__(self, common: frozenset[str], pmi: np.ndarray | None = None):
        self.known = runs_of(common)
        self.pmi = (associations({}, len(common)) if pmi is None else pmi).tolist()

    def __call__(self, text: str | None) -> tuple:
        if not text:
            return (0, *[None] * 12)
        known = self.known
        stripped = _TAG.sub("\n", text) if "gist>" in text else text
        plain = _INLINE.sub(_inline, stripped) if "`" in stripped else stripped
        shares = dict.fromkeys(_KINDS, 0)
        #: What is known of all runs, as far as the lines have them as they stand in the text.
        every: list[tuple] = []
        exact = plain is stripped
        #: The text lines in a row that belong together, as runs and what is known of them, and the last line of the last block.
        blocks: list[tuple[list[str], list[tuple]]] = []
        last = ""
        lines = punctuated = 0
        fenced = fresh = False
        for raw in plain.splitlines():
            line = _clean(raw)
            if not line:
                exact = exact and not raw.strip()
                fresh = True
                continue
            lines += 1
            runs = line.split()
            entries = [known[r] for r in runs]
            every += entries
            exact = exact and len(line) == len(raw.strip())
            stops = entries[-1][6]
            punctuated += stops
            if line.startswith(("```", "~~~")):
                fenced = not fenced
                continue
            n = sum([known[r][0] for r in _CELL_TAG.sub(" ", line).split()]) if "<t" in line else sum([e[0] for e in entries])
            kind = "code" if fenced else _kind(line, n, stops)
            if kind == "text" and n == 1 and len(line) > 30:
                kind, n = "noise", max(1, len(line) // 8)
            elif not n and _wordless(line):
                kind, n = "noise", max(1, len(line) // 12)
            if kind != "text":
                shares[kind] += n
                fresh = True
                continue
            if not fresh and blocks and len(last) >= 40 and not _TERMINAL.search(last):
                blocks[-1][0].extend(runs)
                blocks[-1][1].extend(entries)
            else:
                blocks.append((runs, entries))
            last, fresh = line, False
        order, in_sentences, repeated = self._sentences(blocks, shares)
        shares["repeated"] = repeated
        shares["noise" if order is not None and order < ORDERED else "sentence"] += in_sentences - repeated
        total = sum(shares.values()) or 1
        if not exact:
            every = [known[r] for r in stripped.split()]
        n_runs, n_words, letters, common, signs = known.sums(every, len(stripped) < known.FIELD)
        visible = len("".join(stripped.split())) if every else 0
        return (
            n_runs,
            letters / n_words if n_words else None,
            signs / visible if visible else None,
            punctuated / lines if lines else None,
            common / n_words if n_words else None,
            *[(shares[k] + shares["heading"] * (k == "list")) / total for k in ("list", "table", "code", "navigation", "noise", "repeated", "sentence")],
            order,
        )

    def _sentences(self, blocks: list[tuple[list[str], list[tuple]]], shares: dict[str, int]) -> tuple[float | None, int, int]:
        """The mean association of neighbouring common words, the words in sentences, and those in sentences that repeat; what is none goes to its share.

        A sentence ends behind a run that ends as one does, or with its block.
        """
        pmi = self.pmi
        sentences: list[tuple[str, int]] = []
        associated, pairs = 0.0, 0
        for runs, entries in blocks:
            short = sum(map(len, runs)) + len(runs) - 1 < 60
            ends = [i for i, e in enumerate(entries, 1) if e[6]]
            if not ends or ends[-1] < len(entries):
                ends.append(len(entries))
            start = 0
            for end in ends:
                part = entries[start:end]
                n = sum([e[0] for e in part])
                stops = part[-1][6]
                if not n:
                    shares["noise"] += 1
                elif n <= 8 and short and (n < 4 or not stops or n <= 7):
                    shares["list"] += n
                else:
                    marks = [m for e in part if e[0] for m in e[5]]
                    found = [pmi[a][b] for a, b in zip(marks, marks[1:]) if a and b]
                    associated, pairs = associated + sum(found), pairs + len(found)
                    if len(marks) - marks.count(0) < 0.08 * n and not (stops and runs[start][:1].isupper() or any([e[7] for e in part])):
                        shares["noise"] += n
                    else:
                        sentences.append((" ".join(runs[start:end]).lower(), n))
                start = end
        in_sentences = repeated = 0
        for (_, n), run in groupby(sentences):
            times = sum(1 for _ in run)
            in_sentences += times * n
            repeated += times * n * (times >= LEAST_RUN)
        return associated / pairs if pairs >= 5 else None, in_sentences, repeated


def common_word_set(common_words: DataFrame) -> frozenset[str]:
    words = [r.word for r in common_words.select(F.lower("word").alias("word")).filter(F.col("word").isNotNull()).distinct().limit(MAX_COMMON_WORDS + 1).collect()]
    if len(words) > MAX_COMMON_WORDS:
        raise ValueError(f"more than {MAX_COMMON_WORDS} common words")
    return frozenset(words)


def statistics(documents: DataFrame, common_words: DataFrame, keep: tuple[str, ...] = (), counter: Callable[[], Callable[[str | None], int]] | None = None) -> DataFrame:
    """doc_id, the columns of ``keep``, the FIELDS and, with ``counter``, n_tokens: one row per row of documents.

    ``counter()`` gives, once per task, a function from a text to its number of tokens, so that one pass over the texts serves both.
    """
    common = common_word_set(common_words)
    # Bounded by the square of the fixed list of common words, whatever the corpus is.
    counts = {(r.a, r.b): r.n for r in pair_counts(documents, common).collect()}
    pmi = documents.sparkSession.sparkContext.broadcast(associations(counts, len(common)))
    kept = documents.select("doc_id", *keep, F.col("text").alias("_text"))

    def make():
        meter, count = Meter(common, pmi.value), counter and counter()

        def run(*columns):
            for *values, text in zip(*columns):
                yield (*values, *meter(text), count(text)) if count else (*values, *meter(text))

        return run

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in kept.drop("_text").dtypes)
    return map_lists(spread(kept), make, f"{kinds}, {FIELDS}" + ", n_tokens bigint" * (counter is not None))


#: Labelling functions: name, the type it speaks for, the condition under which it does; else it abstains. One threshold each, and no two
#: on the same statistic. Votes on the symbol ratio were tried and left out: they depend on the vote for code, which the model takes for
#: independent, and text with many signs then passes for code.
VOTES = [
    ("sentences", "prose", "sentence_share >= 0.5"),
    ("common", "prose", "common_words >= 0.2"),
    ("stops", "prose", "punctuated_lines >= 0.5"),
    ("lists", "list", "list_share + navigation_share > 0.5"),
    ("tables", "table", "table_share > 0.5"),
    ("code", "code", "code_share > 0.5"),
    ("noise", "junk", "noise_share + repeated_share > 0.5"),
]


def votes(stats: DataFrame) -> DataFrame:
    """The statistics of the documents with words or signs, and their votes as a bit pattern."""
    pattern = sum((F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, _, condition) in enumerate(VOTES)), F.lit(0))
    return stats.withColumn("pattern", pattern)


@dataclass
class Model:
    """What expectation-maximization learned: per type its share of all documents, and per type and function how often it fires."""

    priors: list[float]
    rates: list[list[float]]

    def posterior(self, pattern: int) -> list[float]:
        logs = [math.log(self.priors[c]) + sum(math.log(r if pattern >> i & 1 else 1 - r) for i, r in enumerate(self.rates[c])) for c in range(len(TYPES))]
        top = max(logs)
        raw = [math.exp(x - top) for x in logs]
        return [x / sum(raw) for x in raw]

    def accuracies(self) -> list[tuple[str, str, float, float, float]]:
        """Of each function: its name, its type, how often it speaks, how often it is right when it does, and the share of its type that it finds."""
        rows = []
        for i, (name, target, _) in enumerate(VOTES):
            fires = [p * rates[i] for p, rates in zip(self.priors, self.rates)]
            c = TYPES.index(target)
            rows.append((name, target, sum(fires), fires[c] / sum(fires), self.rates[c][i]))
        return rows


def learn(patterns: dict[int, int], iterations: int = 40, strength: float = 0.02) -> Model:
    """The model of the documents' votes, from how often each pattern of votes occurs.

    A document has one type; given it, each function fires independently with a probability of its own. The start says that functions
    fire mostly for the type they speak for; ``strength``, a share of all documents, is the weight of that start as a prior, which
    keeps a rare type's functions from being taken over by a frequent type.
    """
    total = sum(patterns.values()) or 1
    k = len(TYPES)
    start = [[0.85 if TYPES[c] == target else 0.03 for _, target, _ in VOTES] for c in range(k)]
    model = Model([0.6, 0.1, 0.1, 0.1, 0.1], [row[:] for row in start])
    weight = strength * total / k + 1
    for _ in range(iterations):
        mass, fired = [0.0] * k, [[0.0] * len(VOTES) for _ in range(k)]
        for p, n in patterns.items():
            for c, q in enumerate(model.posterior(p)):
                mass[c] += n * q
                for i in range(len(VOTES)):
                    if p >> i & 1:
                        fired[c][i] += n * q
        model = Model(
            [(m + weight) / (total + k * weight) for m in mass],
            [[min(0.999, max(0.001, (fired[c][i] + weight * start[c][i]) / (mass[c] + weight))) for i in range(len(VOTES))] for c in range(k)],
        )
    return model


def voted(documents: DataFrame, common_words: DataFrame, keep: tuple[str, ...] = (), counter: Callable | None = None) -> tuple[DataFrame, dict[int, int]]:
    """The statistics with the pattern of votes, worked out once, and how often each pattern occurs: at most 2 to the number of functions."""
    rows = checkpoint(votes(statistics(documents, common_words, keep, counter)))
    return rows, {r.pattern: r.n for r in rows.filter(F.col("symbol_ratio").isNotNull()).groupBy("pattern").agg(F.count("*").alias("n")).collect()}


def text_types(documents: DataFrame, common_words: DataFrame, keep: tuple[str, ...] = (), counter: Callable | None = None) -> DataFrame:
    """doc_id, the columns of ``keep``, the statistics, the posterior of prose and the most probable type; both null for null and empty texts."""
    rows, counts = voted(documents, common_words, keep, counter)
    model = learn(counts)
    found = [(p, float(q[0]), TYPES[max(range(len(TYPES)), key=q.__getitem__)]) for p in counts for q in [model.posterior(p)]]
    lookup = documents.sparkSession.createDataFrame(found or [(-1, 0.0, "prose")], "pattern int, prose_probability double, text_type string")
    empty = F.col("symbol_ratio").isNull()
    typed = rows.join(F.broadcast(lookup), "pattern", "left").drop("pattern")
    return typed.withColumn("prose_probability", F.when(~empty, F.col("prose_probability"))).withColumn("text_type", F.when(~empty, F.col("text_type"))).dropDuplicates(["doc_id"])


def vote_accuracies(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """vote, text_type, fires, accuracy, coverage: what was learned of each labelling function, without any label."""
    _, counts = voted(documents, common_words)
    return documents.sparkSession.createDataFrame(learn(counts).accuracies(), "vote string, text_type string, fires double, accuracy double, coverage double")
