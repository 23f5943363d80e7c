"""Secrets in texts, found through an inverted index of trigrams.

Every regular expression is analysed once: which trigrams must a matching text
hold? The answer is a Boolean query of ``and`` and ``or`` over trigrams. Each
segment of texts (a slice of an Arrow batch) gets an inverted index, from the
trigrams that occur in any query to the sorted numbers of the texts that hold
them. A query intersects and unites postings; only the candidates it leaves are
verified with the expression. A rule without mandatory trigrams scans every text.

Segments follow the partitions of the input, as the shards of a search engine do,
so nothing is shuffled and memory is bounded by the segment.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from re import _constants as sre, _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablelearn.functions.columns import quoted
from tablelearn.llm.common import chunks

SEGMENT_ROWS = 512
# Codes looked up at a time, which bounds the index's working memory.
INDEX_BYTES = 1 << 20
# Sets of alternative strings grow by products; larger ones are turned into queries.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the longest leftmost matches of ``pattern`` whose ``group`` is long enough.

    Patterns are read as ASCII: case and classes never reach beyond it.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)

    def spans(self, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
        """Code point spans; a match that is too short is dropped, what it covered stays used."""
        return [m.span() for m in compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


# The kinds every scan has, in the order of their spans.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # A run is matched whole, so asking for 32 is the same as dropping shorter runs.
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)

# A private key is its header with the body up to the footer (no five hyphens in a row between them), or with the base64
# lines that follow if it has none, or alone.
_HEADER, _FOOTER = r"-----BEGIN [A-Z0-9\x20]*PRIVATE KEY(?:\x20BLOCK)?-----", r"-----END [A-Z0-9\x20]*PRIVATE KEY(?:\x20BLOCK)?-----"
_BODY = r"(?:[^-]|-{1,4}[^-])*"
_BREAK = r"""(?:[\s>"',+]|\\[nrt])*"""
_KEY_LINE = r"(?:(?:Proc-Type|DEK-Info|Version|Comment):[^\n\\]*|[A-Za-z0-9/][A-Za-z0-9+/]{19,}={0,2})"
_LAST_LINE = r"(?:\s*\n[\x20\t>]*[A-Za-z0-9+/]+={0,2}\r?(?m:$)|\\n[A-Za-z0-9+/]+={0,2})?"

# Public formats of credentials, found besides the base kinds; their patterns say the same in Python and in SQL.
MORE_RULES = (
    Rule("private", rf"{_HEADER}(?:{_BODY}{_FOOTER}|(?:{_BREAK}{_KEY_LINE})+{_LAST_LINE})?"),
    Rule("code_host", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", r"[a-z]{2,10}://[A-Za-z0-9._-]+:[^\s:@/]{6,}@[A-Za-z0-9.-]{3,}"),
)
RULES = BASE_RULES + MORE_RULES


# --- Boolean queries over trigrams ---------------------------------------------------------

# A query is True (any text), a trigram, or ("and" | "or", queries).
Query = object


def _all(parts: Sequence[Query]) -> Query:
    kept = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def _any(parts: Sequence[Query]) -> Query:
    if any(p is True for p in parts):
        return True
    kept = list(dict.fromkeys(parts))
    return kept[0] if len(kept) == 1 else ("or", tuple(kept))


def _holds(strings: frozenset[str]) -> Query:
    """Query of the texts that may hold one of these strings."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _members(items: list) -> frozenset[str] | None:
    """The lower-cased characters of a class if they are few."""
    found: set[str] = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            found.add(chr(value).lower())
        elif kind is sre.RANGE and value[1] - value[0] < 8:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return frozenset(found) if len(found) <= 8 else None


def _sequence(nodes) -> tuple[frozenset[str] | None, Query]:
    """(all lower-cased strings the nodes match, or None if unknown; query that every match obeys)."""
    run: frozenset[str] = frozenset([""])
    whole, parts = True, []

    def close() -> None:
        nonlocal run
        parts.append(_holds(run))
        run = frozenset([""])

    for node in nodes:
        exact, query = _node(*node)
        if exact is not None and len(run) * len(exact) <= MOST_STRINGS:
            run = frozenset(a + b for a in run for b in exact)
            continue
        whole = False
        close()
        if exact is not None:
            run = exact
        else:
            parts.append(query)
    if whole:
        return run, _holds(run)
    close()
    return None, _all(parts)


def _node(kind, value) -> tuple[frozenset[str] | None, Query]:
    if kind is sre.LITERAL:
        return frozenset([chr(value).lower()]), True
    if kind is sre.IN:
        return _members(value), True
    if kind is sre.AT:
        return frozenset([""]), True
    if kind is sre.SUBPATTERN:
        return _sequence(value[3])
    if kind is sre.BRANCH:
        options = [_sequence(x) for x in value[1]]
        sets = [exact for exact, _ in options]
        strings = frozenset().union(*[s for s in sets if s is not None])
        if all(s is not None for s in sets) and len(strings) <= MOST_STRINGS:
            return strings, _holds(strings)
        return None, _any([query for _, query in options])
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = value
        exact, query = _sequence(inner)
        if exact is not None and least == most and least <= 8 and len(exact) ** least <= MOST_STRINGS:
            return reduce(lambda a, b: frozenset(x + y for x in a for y in b), [exact] * least, frozenset([""])), True
        if exact is not None and (least, most) == (0, 1):
            return exact | {""}, True
        return None, query if least else True
    return None, True


def trigram_query(pattern: str) -> Query:
    """Boolean query over lower-cased trigrams that every text with a match obeys; True if there is none."""
    return _sequence(sre_parser.parse(pattern, re.ASCII))[1]


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*[trigrams(q) for q in query[1]])


# --- index of one segment ------------------------------------------------------------------


@dataclass
class TrigramIndex:
    """Postings of the chosen trigrams over the texts of one segment."""

    postings: dict[str, np.ndarray] = field(default_factory=dict)
    size: int = 0

    @classmethod
    def build(cls, texts: list[str], wanted: Sequence[str], slots: np.ndarray) -> TrigramIndex:
        """``slots``: for each code of three bytes the place of the trigram in ``wanted``, or -1."""
        data = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(d) + 1 for d in data])
        joined = np.frombuffer(b"\x00".join(data), dtype=np.uint8)
        pairs = [np.zeros(0, dtype=np.int64)]
        for start in range(0, max(len(joined) - 2, 0), INDEX_BYTES):
            part = joined[start : start + INDEX_BYTES + 2].astype(np.int32)
            place = slots[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
            hits = np.flatnonzero(place >= 0)
            owner = np.searchsorted(ends, hits + start, side="right")
            pairs.append(np.unique(place[hits].astype(np.int64) * len(texts) + owner))
        found = np.unique(np.concatenate(pairs))
        which, owner = np.divmod(found, max(len(texts), 1))
        cuts = np.searchsorted(which, np.arange(len(wanted) + 1))
        return cls({t: owner[cuts[i] : cuts[i + 1]] for i, t in enumerate(wanted)}, len(texts))

    def candidates(self, query: Query) -> np.ndarray:
        """Sorted numbers of the texts that obey the query."""
        if query is True:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings[query]
        join = np.intersect1d if query[0] == "and" else np.union1d
        return reduce(join, [self.candidates(q) for q in query[1]])


class Scanner:
    """Rules with their queries; finds spans in segments of texts."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = [(rule, rule.compiled(), trigram_query(rule.pattern)) for rule in rules]
        self.wanted = sorted(set().union(*[trigrams(q) for _, _, q in self.rules]))
        self.slots = np.full(1 << 24, -1, dtype=np.int16)
        for i, t in enumerate(self.wanted):
            a, b, c = t.encode("ascii")
            self.slots[(a << 16) | (b << 8) | c] = i

    def find(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text (start, end, number of the rule), by start and then rule."""
        index = TrigramIndex.build(texts, self.wanted, self.slots)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, compiled, query) in enumerate(self.rules):
            for i in index.candidates(query).tolist():
                found[i] += [(start, end, k) for start, end in rule.spans(compiled, texts[i])]
        for spans in found:
            spans.sort(key=lambda s: (s[0], s[2]))
        return found


# --- Spark operators -----------------------------------------------------------------------


def _scan(kinds: Sequence[Rule], key: str, masked: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(kinds)
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            for part in chunks(batch, SEGMENT_ROWS):
                values = part.column("text").to_pylist()
                texts = [v or "" for v in values]
                found = scanner.find(texts)
                if masked:
                    out = [v if v is None else mask(v, [s[:2] for s in spans]) for v, spans in zip(values, found)]
                    yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(out, pa.string()))
                else:
                    rows = [[{"kind": kinds[k].kind, "start": a, "end": b} for a, b, k in spans] for spans in found]
                    yield pa.record_batch([part.column(key), pa.array(rows, pa.list_(span))], names=[key, "spans"])

    return run


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id") -> DataFrame:
    """The spans of every kind in every whole text: key, spans array<struct<kind, start, end>>.

    Spans count code points, end exclusive, and are ordered by start and then by
    the order of the rules. A null text holds none; a null key stays null;
    repeated rows are scanned each; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(quoted(key), quoted("text")).mapInArrow(
        _scan(tuple(rules), key, masked=False), f"`{key}` {kind}, spans array<struct<kind:string,start:int,end:int>>"
    )


def mask(text: str, spans: Sequence[tuple[int, int]], by: str = "[secret]") -> str:
    """Every stretch covered by spans, overlapping ones as one, replaced."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], by]
        at = end
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The same rows and columns with every secret in ``text`` replaced; a null text stays null."""
    return docs.mapInArrow(_scan(tuple(rules), "text", masked=True), docs.schema)


def joined_spans(kinds: Sequence[str] | None = None) -> Column:
    """kind:start:end of the spans (of these kinds), joined by commas."""
    spans = F.col("spans")
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_spans(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
