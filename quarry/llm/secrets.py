"""Credentials embedded in source code (problem 5).

Texts are cut into chunks at line ends. Each batch of chunks gets a trigram index; the trigrams that a detector's expression requires
select its candidate chunks by intersected postings, and only these are searched with the expression, with as many lines before and
after them as a match of it can span, so that nothing depends on where a chunk ends. One detector, of random characters behind a short name of any house's own format, requires no
trigram; its candidates are all chunks. What a detector takes for a
value is then judged: placeholders, references, names, digests and the like are no credentials. The index lives within its batch, so
that no posting ever crosses the network, and its size is bounded by the batch's.

Redaction replaces the characters of a value by a mark within the quotes and separators that were there, so that the code still parses.

Nulls: no text, no credential. An empty text has none. A null path is treated as source code, where a value has to be quoted. Repeated
rows give one row. Texts are read whole; a chunk is as long as its longest line.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import trigrams
from quarry.llm.arrow import map_lists
from quarry.session import spread

#: Characters of a chunk where its lines are shorter. A few lines: the finer the postings, the less text is searched.
CHUNK = 240
MARK = "REDACTED"

# -- detectors ------------------------------------------------------------------------------------------------------------
# Words that end the name of a credential, and the shapes of providers' tokens.
_KEY = r"(?:password|passwd|passphrase|passwort|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|service[_-]?key|signing[_-]?key|secret[_-]?key|private[_-]?key|encryption[_-]?key|auth[_-]?key|master[_-]?key|shared[_-]?key|account[_-]?key|deploy[_-]?key|license[_-]?key|bearer|credentials?|authorization)"
_QUOTED = r"(?P<q>[\"'`])(?P<v>(?:(?!(?P=q))[^\\\n]|\\.)*)(?P=q)"
_UNION = r"(?:\s*\|\s*\w+)*"
_TYPE = rf"(?:\s*:\s*(?:[A-Za-z_][\w.]*(?:\[[^\]\n]*\])?{_UNION}|Optional\[\w+\]))?"
DETECTORS: list[tuple[str, str]] = [
    ("provider", r"(?<![A-Za-z0-9_])(?P<v>A(?:KI|SI)A[A-Z0-9]{16})(?![A-Za-z0-9])"),
    ("provider", r"(?<![A-Za-z0-9_])(?P<v>gh[pousr]_[A-Za-z0-9]{30,})"),
    ("provider", r"(?<![A-Za-z0-9_])(?P<v>github_pat_[A-Za-z0-9_]{22,})"),
    ("provider", r"(?<![A-Za-z0-9_])(?P<v>[srp]k_(?:live|test|prod)_[A-Za-z0-9]{14,})"),
    ("provider", r"(?<![A-Za-z0-9_])(?P<v>xox[abeprs]-[A-Za-z0-9-]{10,})"),
    ("provider", r"(?<![A-Za-z0-9_])(?P<v>AIza[A-Za-z0-9_-]{30,})"),
    ("provider", r"(?<![A-Za-z0-9_])(?P<v>glpat-[A-Za-z0-9_-]{18,})"),
    ("provider", r"(?<![A-Za-z0-9_])(?P<v>npm_[A-Za-z0-9]{30,})"),
    ("provider", r"(?<![A-Za-z0-9_])(?P<v>SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,})"),
    ("provider", r"(?<![A-Za-z0-9_])(?P<v>eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,})"),
    ("provider", r"(?<![A-Za-z0-9_])(?P<v>sk-(?:proj|svcacct|admin|ant)-[A-Za-z0-9_-]{20,})"),
    ("provider", r"(?<![A-Za-z0-9_])(?P<v>(?:hf_|dop_v1_|doo_v1_|dor_v1_|dckr_pat_|glsa_|lin_api_|whsec_|figd_|sntrys_|pul-|nvapi-|r8_)[A-Za-z0-9_-]{24,})"),
    ("provider", r"(?<![A-Za-z0-9_])(?P<v>shp(?:at|ca|pa|ss)_[A-Fa-f0-9]{32})"),
    ("provider", r"(?<![A-Za-z0-9_])(?P<v>ya29\.[A-Za-z0-9_-]{20,})"),
    ("provider", r"(?<![A-Za-z0-9_])(?P<v>sq0(?:atp|csp|idp)-[A-Za-z0-9_-]{22,})"),
    ("provider", r"(?<![A-Za-z0-9_])(?P<v>pypi-AgEI[A-Za-z0-9_-]{40,})"),
    ("provider", r"(?<![A-Za-z0-9_])(?P<v>xapp-\d-[A-Za-z0-9-]{20,})"),
    ("provider", r"(?<![A-Za-z0-9_])(?P<v>NRAK-[A-Z0-9]{27})"),
    ("provider", r"(?<![A-Za-z0-9_])(?P<v>ATATT3x[A-Za-z0-9_=-]{40,})"),
    ("webhook", r"hooks\.slack\.com/services/(?P<v>T[A-Za-z0-9]{6,}/B[A-Za-z0-9]{6,}/[A-Za-z0-9]{16,})"),
    ("webhook", r"discord(?:app)?\.com/api/webhooks/\d{10,}/(?P<v>[A-Za-z0-9_-]{40,})"),
    ("opaque", r"(?P<q>[\"'`])(?P<v>[a-z][a-z0-9]{1,7}(?:[._\-][a-z]{1,8})?[._\-](?P<o>[A-Za-z0-9_\-]{18,}))(?P=q)"),
    ("private key", r"(?P<v>-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)"),
    ("assigned", rf"(?i)(?<![\w\-])(?P<k>[\w\-]*{_KEY})[\"']?\]?{_TYPE}\s*(?:=>|:=|[=:](?![=:]))\s*(?:\(\s*)?[rbuf]?{_QUOTED}"),
    ("assigned", r"(?i)(?<![\w\-])(?P<k>[\w\-]*(?:_pass|\bpass|_pw|[a-z](?-i:Pass)))[\"']?\]?\s*(?:=>|:=|[=:](?![=:]))\s*" + _QUOTED),
    ("assigned", r"^[ \t]*(?:export +|set +)?(?P<k>[A-Z0-9_]+_KEY) *= *" + _QUOTED),
    ("plain", rf"(?i)^(?P<l>[ \t]*(?:export +|set +|- +|ENV +)?)(?P<k>[\w.\-]*(?:{_KEY}|_pass|_pw|(?-i:_KEY))) *(?P<s>[=:]) *(?P<v>[^\s\"'#](?:[^\n#]|(?<!\s)#)*?)(?=\s*(?: #[^\n]*)?\r?$)"),
    ("fallback", rf"(?i)(?<!\w)(?P<k>\w*{_KEY})[\"']?\]?\)?\s*(?:\?\?|\|\|)=?\s*{_QUOTED}"),
    ("fallback", rf"(?i)(?:getenv|environ\.get|env\.get|\bget|env)\(\s*[\"'](?P<k>[\w.\-]*{_KEY})[\"']\s*,\s*(?:default\s*=\s*)?{_QUOTED}"),
    ("fallback", rf"(?i)\$\{{(?P<k>\w*{_KEY}):?[-=](?P<v>[^}}\n]+)\}}"),
    ("url password", r"(?i)(?<![a-z0-9])[a-z][a-z0-9+.\-]*://(?P<u>[^\s:/@\"'<>{}$`]*):(?P<v>[^\s/@\"'<>`]+)@(?=[\w.\-\[])"),
    ("url parameter", r"(?i)[?&;](?P<k>sig|signature|token|access_token|auth_token|id_token|refresh_token|api_?key|key|secret|client_secret|password|passwd|pwd|sas|code|auth)=(?P<v>[^\s&\"'`<>#)]+)"),
    ("header", r"(?i)\bbearer\s+(?P<v>[A-Za-z0-9._~+/=\-]{8,})"),
    ("basic", r"(?i)\bbasic\s+(?P<v>[A-Za-z0-9+/=_\-]{8,})"),
    ("header", r"(?i)[\"']?(?:x-api-key|x-auth-token|api-key|authorization)[\"']?\s*[:,]\s*[\"'](?:token +|apikey +)(?P<v>[^\"'\n]+)[\"']"),
    ("statement", r"(?i)\b(?:password|identified\s+by)\s+(?:as\s+)?'(?P<v>(?:[^'\n]|'')+)'"),
    ("pair", rf"(?i)\bname[\"']?\s*:\s*[\"']?(?P<k>[\w.\-]*{_KEY})[\"']?,?\s*\n?\s*[\"']?value[\"']?\s*:\s*(?P<q>[\"']?)(?P<v>[^\"'\n#]+?)(?P=q)(?=\s*(?: #[^\n]*)?(?:[,}}]|\r?$))"),
    ("said", r"(?i)\b(?:password|passwd|passphrase|pass|pwd|secret|token|(?:api |access )?key|credentials?)\b(?:\s+(?:is|was|are|now))?\s*(?::|=)?\s*`(?P<v>[^`\n]+)`"),
    ("commented", r"(?i)(?:^|\s)(?://|#|/\*|\*|--|;|<!--)\s*(?P<k>(?:[\w-]+ ){0,4}(?:password|passwd|passphrase|pass|pwd|secret|token|key|credentials?|login|creds?))\s*(?::|=|->| is )\s*(?P<q>[\"'`]?)(?P<v>[^\s\"'`]{6,})(?P=q)"),
    ("option", r"(?:^|\s)(?:-u|--user|--proxy-user)[ =](?P<q>[\"']?)(?P<k>[\w.@\-]+):(?P<v>[^\s\"':]+)(?P=q)"),
    ("option", rf"(?i)(?<![\w-])--(?P<k>[\w-]*{_KEY})[= ](?P<q>[\"']?)(?P<v>[^\s\"'<>]+)(?P=q)"),
]

#: Extensions in which a value needs no quotes.
PLAIN = frozenset("env ini yaml yml sh bash properties conf cfg toml md txt tf tfvars dockerfile".split())

# -- what is no credential ------------------------------------------------------------------------------------------------
_PLACEHOLDER = re.compile(
    r"^(?:x{3,}|\*{3,}|\.{3,}|-{2,}|_{3,}|#{3,}|0+|1234\d*|<[^>]*>?|\[[^\]]*\]|\{+[^}]*\}*|\$\{?[\w.]+.*|%\(\w+\)[sd]|%[sd]|%\w+%|\$\(.*|@[\w.]+@"
    r"|(?:your|insert|enter|replace|change|fill|provide|dummy|fake|placeholder|redacted|null|none|nil|undefined|true|false|todo|fixme|tbd|xxx|n/a|na|not[-_ ]?set|not[-_ ]?a)(?:[-_ .].*)?"
    r"|(?:my|the|some|any|an?|put|add|set|use|example|sample|mock|test|default|removed|hidden|masked|secret|yes|no|empty|blank|unset|unknown)(?:[-_ .][^\d]*)?"
    r"|.*(?:change[-_ ]?me|replace[-_ ]?me|changeit|placeholder|redacted|your[-_].*(?:key|token|secret|password)|_here|-here|example)\b.*"
    r"|(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[-_ ]?key|key|bearer|credentials?|login|user(?:name)?|access[-_]?token|string|str|text|hash|admin|changeme)s?)$",
    re.I,
)
_REFERENCE = re.compile(
    r"^(?:process\.env\b|os\.(?:environ|getenv)|env[.\[(]|import\.meta|config[.\[(]|settings[.\[(]|secrets?[.\[:/]|vault[:/.]|arn:|ssm:|kms:|gcp:|azure:|op://|keyring|file:|https?://[^:@\s]*$|\{\{|!(?:Ref|Sub|GetAtt|ImportValue|vault|secret|env|include)\b|\$\w|self\.|this\.|\w+\(.*\)$|(?:\./|/|~/)[\w./-]+$|(?:prod|dev|stage|staging|test|secret|secrets|kv|vault|app)(?:/[\w.-]+)+$)",
    re.I,
)
_DIGEST = re.compile(r"^(?:sha(?:1|224|256|384|512)|md5|blake\w*)[-:$]", re.I)
_UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)
_LABEL = re.compile(r"^[A-Za-z]+(?: [A-Za-z]+)*[.:!?]?$")
_WORDLIKE = re.compile(r"^[a-z]+(?:[A-Z][a-z]+)*$|^[A-Z][A-Z_]*$|^[A-Z][a-z]+(?:[A-Z][a-z]+)*$|^[a-z]+(?:[._-][a-z]+)*$")
_TYPE_NAMES = frozenset("string str number bool boolean any unknown null none undefined int float bytes optional required password text secretstr true false object".split())


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def _mixed(value: str) -> bool:
    """Whether a value has digits or signs among letters, as words have not."""
    return bool(re.search(r"\d", value)) and bool(re.search(r"[A-Za-z]", value)) or bool(re.search(r"[A-Za-z0-9][^\w\s.\-][A-Za-z0-9]|[^\w\s.\-/]$", value)) and bool(re.search(r"[A-Za-z]", value))


def credential(kind: str, value: str, key: str | None, plain: bool) -> bool:
    """Whether what a detector took for a value is written out and works."""
    value = value.strip()
    if kind == "opaque":
        # A house's own format: a short name and a run of random characters, which mixes upper and lower case and digits as words, digests and ids do not.
        run = re.search(r"[A-Za-z0-9_\-]{18,}$", value).group()
        return all(re.search(c, run) for c in ("[a-z]", "[A-Z]", "[0-9]")) and entropy(run) >= 3.5 and not _DIGEST.match(value) and not re.search(r"example|x{6,}", value, re.I)
    if kind in ("provider", "private key", "webhook"):
        body = value.rpartition("_")[2]
        return kind == "private key" or len(set(body)) > 4 and not re.search(r"example|x{6,}|0{8,}", value, re.I)
    if len(value) < 4 or _PLACEHOLDER.match(value) or _REFERENCE.match(value) or _DIGEST.match(value):
        return False
    if "${" in value or "{{" in value or "$(" in value or "#{" in value or (value.startswith("{") and value.endswith("}")):
        return False
    if kind == "basic":
        try:
            decoded = base64.b64decode(value + "=" * (-len(value) % 4), validate=True)
        except ValueError:
            return False
        user, colon, word = decoded.partition(b":")
        return bool(colon and word) and decoded.isascii()
    if kind == "url password":
        return not re.fullmatch(r"\d{2,5}|%s|\{.*|\$.*", value)
    if kind == "url parameter":
        return len(value) >= 12 and _mixed(value) and entropy(value) > 2.5
    if kind == "header":
        return len(value) >= 8 and (_mixed(value) or entropy(value) > 3.4)
    if kind == "commented":
        return _mixed(value) and len(value) >= 6 and not _UUID.match(value) and not re.fullmatch(r"[\w.]+\(.*|https?:.*", value)
    if " " in value and kind in ("assigned", "plain", "fallback", "pair", "statement") and not re.search(r"\d", value):
        return False
    if kind == "said":
        return _mixed(value) and not re.search(r"[\s(]", value)
    if kind == "plain":
        if not plain or value.lower().rstrip(",;") in _TYPE_NAMES or re.search(r"[({\[]\S*$|^[|>&*]", value) and not _mixed(value):
            return False
    if kind in ("assigned", "fallback", "plain", "option", "pair"):
        if _LABEL.match(value) and " " in value or re.search(r"[<>]|\\n$", value) and not _mixed(value):
            return False
        if key and re.search(r"(?i)(?:public|pub)[_-]?key$|[_-](?:csrf|next|page|cancel)[_-]?token$", key):
            return False
        if key and key.endswith("_KEY") and not _mixed(value):
            return False
        if _WORDLIKE.match(value) and (len(value) < 16 or entropy(value) < 3.6 or re.search(r"[._-]", value)) and not re.search(r"\d", value):
            return False
        return True
    return True


# -- search ---------------------------------------------------------------------------------------------------------------
_PATTERNS = [(kind, re.compile(p, re.M)) for kind, p in DETECTORS]
_BLANK = re.compile(r"\s*")


def breaks_in(kind: str, pattern: str) -> int:
    """How many gaps with line breaks a match can have at most, besides those at the bars of a union of types."""
    if kind == "plain":  # blanks only in its looks around, which end at the value's line
        return 0
    outside = re.findall(r"\\.|\[(?:\\.|[^\]\\])*\]", pattern.replace(_UNION, "").replace(r"(?:^|\s)", ""))
    return outside.count(r"\s") + outside.count(r"\n")


_BREAKS = [breaks_in(kind, p) for kind, p in DETECTORS]
_JOIN = re.compile(r"\s*\+\s*(?:\\?\n\s*)?[rbuf]?([\"'])((?:(?!\1)[^\\\n]|\\.)+)\1")


def build_plan() -> trigrams.Plan:
    return trigrams.Plan([None if kind == "opaque" else trigrams.required(p, re.M) for kind, p in DETECTORS])


def chunks_of(text: str, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Start and end of the chunks of a text: whole lines, of ``size`` characters where lines are shorter."""
    at = 0
    while at < len(text):
        end = text.find("\n", min(len(text), at + size) - 1)
        end = len(text) if end < 0 else end + 1
        yield at, end
        at = end


def _last(text: str, at: int) -> int:
    """Behind the last character before ``at`` that is not blank."""
    while at and text[at - 1].isspace():
        at -= 1
    return at


def ahead(text: str, end: int, breaks: int) -> int:
    """How far a match with so many gaps can reach that begins before the line at ``end``; lines without a character do not count."""
    stop = end
    while (first := _BLANK.match(text, stop).end()) < len(text):
        if text[first] != "|" and text[_last(text, first) - 1 : _last(text, first)] != "|":
            if not breaks:
                break
            breaks -= 1
        stop = text.find("\n", first)
        if stop < 0:
            return len(text)
    return stop


def behind(text: str, start: int, breaks: int) -> int:
    """Where a match with so many gaps can begin at the earliest that goes on to the line at ``start``."""
    while last := _last(text, start):
        first = _BLANK.match(text, start).end()
        if text[last - 1] != "|" and text[first : first + 1] != "|":
            if not breaks:
                break
            breaks -= 1
        start = text.rfind("\n", 0, last) + 1
    return start


def _private_key_end(text: str, at: int) -> int:
    """Behind the end line of the key that begins at ``at``; behind the last line of key material where that line is missing."""
    m = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----").search(text, at)
    following = text.find("-----BEGIN ", at + 5)
    if m and (following < 0 or m.start() < following):
        return m.end()
    m = re.compile(r"-----BEGIN [A-Z0-9 ]*-----(?:(?:\\n|\r?\n)[ \t]*[A-Za-z0-9+/=:,\- ]{1,80})*").match(text, at)
    return m.end() if m else at


def spans_in(text: str, start: int, end: int, number: int, plain: bool) -> Iterator[tuple[int, int, str]]:
    """Begin, end and kind of the credentials of one detector whose matches begin within whole lines, wherever they end."""
    kind, pattern = _PATTERNS[number]
    stop = ahead(text, end, _BREAKS[number]) if _BREAKS[number] else end
    for m in pattern.finditer(text, start, stop):
        if m.start() >= end:
            return
        value, at = m.group("v"), m.start("v")
        key = m.groupdict().get("k")
        if kind == "private key":
            yield at, _private_key_end(text, at), kind
            continue
        pieces = [(at, m.end("v"))]
        joined = value
        if kind in ("assigned", "fallback") and m.groupdict().get("q"):
            after = m.end()
            while more := _JOIN.match(text, after):
                pieces.append(more.span(2))
                joined += more.group(2)
                after = more.end()
        elif kind == "provider" and text[m.end("v") : m.end("v") + 1] in "\"'":
            after = m.end("v") + 1
            while more := _JOIN.match(text, after):
                pieces.append(more.span(2))
                after = more.end()
        if kind == "assigned" and (inner := re.match(r"(?i)(?:bearer|basic|token|apikey) +", value)):
            joined = joined[inner.end() :]
            pieces[0] = (at + inner.end(), pieces[0][1])
            if value.lower().startswith("basic"):
                kind_of_value = "basic"
                if credential(kind_of_value, joined, key, plain):
                    yield *pieces[0], kind_of_value
                continue
        if credential(kind, joined, key, plain):
            for begin, stop in pieces:
                yield begin, stop, kind


def merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans in order, overlapping ones united."""
    found: list[tuple[int, int, str]] = []
    for begin, end, kind in sorted(spans):
        if found and begin < found[-1][1]:
            if end > found[-1][1]:
                found[-1] = (found[-1][0], end, found[-1][2])
        else:
            found.append((begin, end, kind))
    return found


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each credential's characters replaced; line breaks within it stay, so that lines keep their numbers."""
    parts, at = [], 0
    for begin, end, _ in spans:
        value = text[begin:end]
        parts += [text[at:begin], MARK + "".join(re.findall(r"\\n|\r?\n[ \t]*", value) if "\n" in value else [])]
        at = end
    return "".join([*parts, text[at:]])


def _plain(path: str | None) -> bool:
    return (path or "").lower().rpartition("/")[2].rpartition(".")[2] in PLAIN


def search(texts: list[str | None], paths: list[str | None], plan: trigrams.Plan) -> list[list[tuple[int, int, str]]]:
    """The credentials of each text of a batch, through one index over all of its chunks."""
    places = [(i, a, b) for i, text in enumerate(texts) if text for a, b in chunks_of(text)]
    index = trigrams.Index(plan, [texts[i][a:b] for i, a, b in places])
    spans: list[list] = [[] for _ in texts]
    for number in range(len(DETECTORS)):
        ranges: list[list[int]] = []
        if plan.queries[number] is None:
            ranges = [[i, 0, len(text)] for i, text in enumerate(texts) if text]
        for c in index.candidates(number).tolist() if not ranges else ():
            i, a, b = places[c]
            if breaks := _BREAKS[number]:
                # A match may begin in lines before the chunk that has its trigrams. Ranges that one match can join are searched as one.
                before = ranges[-1] if ranges and ranges[-1][0] == i else None
                if before and before[2] == a or before and behind(texts[i], a, breaks) < ahead(texts[i], before[2], breaks):
                    before[2] = b
                    continue
                a = behind(texts[i], a, breaks)
            ranges.append([i, a, b])
        for i, a, b in ranges:
            spans[i] += spans_in(texts[i], a, b, number, _plain(paths[i]))
    return [merged(s) for s in spans]


def entities(files: DataFrame, definitions: DataFrame) -> DataFrame:
    """entity_type, entity_id, path, text of both tables; a definition has no path, so its values must be quoted."""
    f = files.select(F.lit("file").alias("entity_type"), F.col("id").alias("entity_id"), F.col("file_path").alias("path"), F.col("file_content").alias("text"))
    d = definitions.select(F.lit("definition").alias("entity_type"), F.col("id").alias("entity_id"), F.lit(None).cast("string").alias("path"), F.col("source_code").alias("text"))
    return spread(f.unionByName(d).filter(F.col("text") != ""))


def find(rows: DataFrame) -> DataFrame:
    """entity_type, entity_id, line_no, kind: a row per line on which a credential begins and kind of detector."""

    def make():
        plan = build_plan()

        def run(types, ids, paths, texts):
            for kind_of_entity, i, text, spans in zip(types, ids, texts, search(texts, paths, plan)):
                line, at, last = 1, 0, 0
                for begin, _, kind in spans:
                    line += text.count("\n", at, begin)
                    at = begin
                    if line != last:
                        yield kind_of_entity, i, line, kind
                    last = line

        return run

    return map_lists(rows.select("entity_type", "entity_id", "path", "text"), make, "entity_type string, entity_id bigint, line_no int, kind string")


def redact(rows: DataFrame) -> DataFrame:
    """entity_type, entity_id, n_credentials, redacted: the texts with a credential, without it."""

    def make():
        plan = build_plan()

        def run(types, ids, paths, texts):
            for kind_of_entity, i, text, spans in zip(types, ids, texts, search(texts, paths, plan)):
                if spans:
                    yield kind_of_entity, i, len(spans), redacted(text, spans)

        return run

    return map_lists(rows.select("entity_type", "entity_id", "path", "text"), make, "entity_type string, entity_id bigint, n_credentials int, redacted string")
