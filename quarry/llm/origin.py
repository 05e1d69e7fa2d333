"""Generated, minified or vendored source files (problem 7).

One Aho-Corasick automaton holds the phrases of generation notices and of foreign projects' headers. It runs over the comment lines
of a file's header; a hit is verified by the phrase's own condition, as hand-written code speaks of generated ids too. Path
rules follow for vendored directories, lock files and the suffixes of tools. They decide first. What neither can tell, as it bears no
notice and no telling name, is settled by contents, the kinds ``lock``, ``minified`` and ``data`` of ``by_content``: the layout of lock
files, code without line structure, and files that consist of literals alone (data stored as code). Long literals are taken
out before the layout is judged, so that hand-written code with one long literal stays.

Nulls: a file without content is not judged, a null path counts as an unknown name. Empty files are hand-written. Repeated rows
give one row. Contents are read whole; a header ends where the first line of code after the leading imports begins.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import map_lists
from quarry.session import spread

# Phrases in lower case, each with the kind it speaks for and a condition on its line (also lower case).
_TAIL = r"(?:\W*$|\W+(?:this file|manually|by hand|directly)\b|[.!;,])"
NOTICES = [
    ("auto-generated", "generated", r"auto-generated"),
    ("autogenerated", "generated", r"autogenerated"),
    ("automatically generated", "generated", r"\b(?:file|code|client|module|content|class)\w*\b.*automatically generated|^\W*automatically generated"),
    ("automatically created", "generated", r"\b(?:file|code|client|module)\b.*automatically created|^\W*automatically created"),
    ("automatically produced", "generated", r"\b(?:file|code|client|module)\b.*automatically produced|^\W*automatically produced"),
    ("@generated", "generated", r"@generated\b"),
    ("generated by", "generated", r"^\W*(?:(?:this|the)\s+)?(?:code|file|source|module|client)?\s*(?:is|was|has been)?\s*generated by\b"),
    ("generated from", "generated", r"^\W*(?:(?:this|the)\s+)?(?:code|file|source|module|client)?\s*(?:is|was|has been)?\s*generated from\b"),
    ("generated with", "generated", r"^\W*(?:(?:this|the)\s+)?(?:code|file|source|module|client)?\s*(?:is|was|has been)?\s*generated with\b"),
    ("do not edit", "generated", r"(?:generated|created|produced|tool|this file).*do not edit" + _TAIL + r"|^\W*do not edit" + _TAIL),
    ("do not modify", "generated", r"(?:generated|created|produced|tool|this file).*do not modify" + _TAIL + r"|^\W*do not modify" + _TAIL),
    ("changes will be lost", "generated", r"changes will be lost"),
    ("changes will be overwritten", "generated", r"changes will be overwritten"),
    ("will be overwritten", "generated", r"\b(?:file|edits|changes)\b.*will be overwritten"),
    ("rebuild this file", "generated", r"\bto rebuild this file"),
    ("regenerate this file", "generated", r"\bto regenerate this file"),
    ("checksum:", "generated", r"^\W*source: *\S+\s+checksum: *[0-9a-f]{16,}"),
    ("copied from the", "vendored", r"copied from the \S+ project"),
    ("imported unchanged from", "vendored", r"imported unchanged from"),
    ("vendored from", "vendored", r"^\W*vendored from"),
    ("local patches", "vendored", r"local patches *:"),
    ("upstream:", "vendored", r"upstream: *https?://"),
    ("is free software", "vendored", r"is free software"),
    ("released under the", "vendored", r"released under the .*licen[cs]e"),
    ("licensed under the", "vendored", r"licensed under the (?:mit|bsd|apache|gnu|lgpl|gpl|mozilla|isc)\b"),
    ("mit licen", "vendored", r"\bmit licen[cs]e"),
    ("bsd licen", "vendored", r"\bbsd licen[cs]e"),
    ("apache licen", "vendored", r"\bapache licen[cs]e"),
    ("contributors", "vendored", r"(?:copyright|spdx-filecopyrighttext:|\(c\))\W*(?:\d{4}\W+)*(?:by )?the [\w.-]+ contributors"),
    ("spdx-license-identifier:", "vendored", r"spdx-license-identifier: *+(?!licenseref)"),
]
GENERATED_DIRS = ("generated", "__generated__", "dist", "build", "autogen")
VENDORED_DIRS = ("node_modules", "bower_components", "third_party", "third-party", "thirdparty", "_vendored", "_vendor")
#: Directories that hold vendored copies, but are common words too: they count at the root of a package, or above a further directory.
MAYBE_VENDORED_DIRS = ("vendor", "external", "deps")
SOURCE_DIRS = ("src", "lib", "app", "apps", "tests", "test")
LOCK_NAMES = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "poetry.lock", "pipfile.lock", "cargo.lock", "gemfile.lock", "go.sum", "uv.lock", "bun.lock", "deno.lock")

#: What makes values data and not a few constants that someone wrote: so many of them, or so many characters in them.
LEAST_VALUES, LEAST_CHARS = 40, 512
CODE = frozenset("py js jsx ts tsx mjs cjs css sql sh java go rb php c cc cpp h hpp cs rs kt swift".split())
_GENERATED_NAME = re.compile(r"\.(?:generated|g|gen|pb|designer|auto)\.\w+$|_(?:generated|pb2?|pb2_grpc|gen|g)\.\w+$|\.pb\w*\.\w+$")
_MINIFIED_NAME = re.compile(r"\.(?:min|bundle|chunk|prod)\.\w+$")
_LOCK_NAME = re.compile(r"[.-]lock\.(?:json|ya?ml)$|\.lock$")
_LOCK_ENTRY = re.compile(r'"version" *: *"[^"\n]*"[^{}]{0,300}?"integrity" *: *"|"resolved" *: *"http|^\s+integrity sha\d+-|^checksum = "', re.M)
_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|<!--|--|;|\"{3}|'{3}|%)")
_IMPORTING = re.compile(r"^\s*(?:import\b|from\b|export\b.*\bfrom\b|require\b|using\b|package\b|['\"]use strict)")
#: Literals and comments, whichever begins first: a literal may hold what looks like a comment, and a comment a quote.
_WATER = re.compile(
    r"(?P<literal>\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`[^`\\]*+(?:\\.[^`\\]*+)*+`)|/\*[\s\S]*?\*/|(?<![:\"'\w])//[^\n]*|^\s*#[^\n]*", re.M
)
_NUMBER = re.compile(r"(?<![\w.])-?(?:0x[0-9a-fA-F]+|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)(?![\w.])")
#: Comments and the text that open a module.
_OPENING = re.compile(r"\ufeff?(?:\s|#[^\n]*\n)*(?:\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3})?")
_BINDS = re.compile(r"=|\bexport\s+default\b")
_ACTS = re.compile(r"\b(?:def|function|class|return|if|for|while|interface|enum|lambda|SELECT|switch|await|extends|echo)\b|=>|[A-Za-z_]\w*\(")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    by_phrase: dict[str, list] = {}
    for phrase, kind, condition in NOTICES:
        by_phrase.setdefault(phrase, []).append((kind, re.compile(condition)))
    for phrase, found in by_phrase.items():
        a.add_word(phrase, found)
    a.make_automaton()
    return a


def header(text: str) -> str:
    """The lines up to the first line of code behind the leading comments and imports, in lower case; a line of code with a comment before it, as minified files have, goes in by its comment."""
    lines, inside = [], ""
    for line in text.removeprefix("\ufeff").split("\n"):
        stripped = line.strip()
        if inside:
            lines.append(stripped)
            if inside in stripped:
                inside = ""
        elif not stripped or _IMPORTING.match(line):
            continue
        elif _COMMENT.match(line):
            if stripped.startswith("/*") and "*/" in stripped:
                lines.append(stripped[: stripped.index("*/")])
                if stripped.partition("*/")[2].strip():
                    break
            else:
                lines.append(stripped)
                if stripped.startswith("/*"):
                    inside = "*/"
                elif (q := stripped[:3]) in ('"""', "'''") and q not in stripped[3:]:
                    inside = q
        else:
            break
    return "\n".join(lines).lower()


def by_header(text: str, automaton: ahocorasick.Automaton) -> str | None:
    """The kind that a notice in the header speaks for; generated before vendored."""
    head = header(text)
    kinds = set()
    for end, found in automaton.iter(head):
        line = head[head.rfind("\n", 0, end) + 1 : (head.find("\n", end) + 1 or len(head) + 1) - 1]
        kinds.update(kind for kind, condition in found if condition.search(line))
    return min(kinds, default=None)


def by_path(path: str) -> str | None:
    """The kind by directories and name alone."""
    parts = path.lower().split("/")
    name = parts[-1]
    if name in LOCK_NAMES:
        return "lock"
    for i, part in enumerate(parts[:-1]):
        if part in VENDORED_DIRS or part == "lib" and i and parts[i - 1] == "static":
            return "vendored"
        if part in MAYBE_VENDORED_DIRS and i and (i < len(parts) - 2 or not any(p in SOURCE_DIRS for p in parts[:i])):
            return "vendored"
        if part in GENERATED_DIRS and i:
            return "generated"
    if _GENERATED_NAME.search(name):
        return "generated"
    return "minified" if _MINIFIED_NAME.search(name) else None


def _acts(body: str) -> bool:
    """Whether code outside of literals and comments does something more than once; it is read no further than that shows."""
    at = found = 0
    for m in _WATER.finditer(body):
        found += len(_ACTS.findall(body, at, m.start()))
        if found > 1:
            return True
        at = m.end()
    return found + len(_ACTS.findall(body, at)) > 1


def by_content(text: str, path: str) -> str | None:
    """The kind by layout: lock file, minified code, or data stored as code."""
    name = path.lower().rpartition("/")[2]
    extension = name.rpartition(".")[2]
    if extension in ("json", "yaml", "yml", "lock", "toml"):
        entries = len(_LOCK_ENTRY.findall(text))
        lines = text.count("\n") + 1
        if entries >= 3 and (entries * 6 >= lines or _LOCK_NAME.search(name)):
            return "lock"
        return None
    # An object that nothing is made of is configuration under a wrong name, not data that code stores.
    if extension not in CODE or text.lstrip("\ufeff \t\r\n")[:1] in ("{", "["):
        return None
    body = text[_OPENING.match(text).end() :]
    # Most files are settled here: lines of usual length, and code that acts.
    if max(map(len, text.split("\n"))) <= 500 and _acts(body):
        return None
    bare = _WATER.sub(lambda m: "''" if m.lastgroup else "", text)
    bones = re.sub(r"\s+", "", bare)
    if len(bones) >= 300 and extension not in ("sh", "sql"):
        longest = max(map(len, bare.split("\n")))
        on_long = sum(len(x) for x in bare.split("\n") if len(x) > 400)
        if on_long > 0.6 * len(bare) and longest > 500 and bare.count(" ") < 0.1 * len(bare) and len(_ACTS.findall(bare)) >= 5:
            return "minified"
    # Values that are bound to a name or exported; comments, or the text that opens a module, are none.
    literals = [len(m.group()) for m in _WATER.finditer(body) if m.lastgroup]
    bare = _WATER.sub(lambda m: "''" if m.lastgroup else "", body)
    numbers = [len(n) for n in _NUMBER.findall(bare)]
    if len(literals) + len(numbers) < LEAST_VALUES and sum(literals) + sum(numbers) < LEAST_CHARS:
        return None
    bones = len(re.sub(r"\s+", "", bare))
    words = len(re.sub(r"[\W\d]+", "", _NUMBER.sub("", bare)))
    if words < 0.08 * len(body) and len(_ACTS.findall(bare)) <= 1 and _BINDS.search(bare) and sum(numbers) + sum(literals) > 0.4 * (bones + sum(literals)):
        return "data"
    return None


def kind_of(text: str, path: str | None, automaton: ahocorasick.Automaton) -> str | None:
    """generated, vendored, lock, minified or data; None for hand-written files."""
    path = path or ""
    return by_header(text, automaton) or by_path(path) or by_content(text, path)


def origins(files: DataFrame) -> DataFrame:
    """file_id, repo_slug, kind (null for hand-written): one row per row of files with a content."""
    chosen = files.select(F.col("id").alias("file_id"), F.split("file_path", "/")[0].alias("repo_slug"), "file_path", "file_content").filter(F.col("file_content").isNotNull())

    def make():
        automaton = _automaton()

        def run(ids, repos, paths, contents):
            for i, repo, path, content in zip(ids, repos, paths, contents):
                yield i, repo, kind_of(content, path, automaton)

        return run

    return map_lists(spread(chosen), make, "file_id bigint, repo_slug string, kind string")


def foreign_files(files: DataFrame) -> DataFrame:
    """file_id, repo_slug, kind: the files that were not written by hand for their repository, once each."""
    return origins(files).filter(F.col("kind").isNotNull()).distinct()


def origin_rates(judged: DataFrame) -> DataFrame:
    """Files per repository and kind."""
    return judged.groupBy("repo_slug", F.coalesce("kind", F.lit("hand-written")).alias("kind")).agg(F.countDistinct("file_id").alias("n_files"))
