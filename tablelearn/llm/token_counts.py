"""Token counts that follow edits without counting a document again.

A document's pre-tokens are grouped into leaves of LEAF pieces; a segment tree
over the leaves holds sums of characters and of tokens. An edit is located by
descending the character sums. Only the leaves it touches, with CONTEXT characters
before it, are split and merged again; after it the scan stops at the first leaf
end where a piece ends too, since splitting from a piece's start does not depend
on what came before. Then the sums on the leaves' paths are updated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from tablelearn.functions.columns import quoted
from tablelearn.llm.bpe import RANKS, ByteBpe, int_lists, vocabulary
from tablelearn.llm.common import chunks

LEAF = 64
# Where a piece ends depends on at most this many characters behind it.
CONTEXT = 3
# Edits that are closer than this are encoded in one region.
NEAR = 256

Edit = tuple[int, int, str]

# What a corpus is usually cleaned of; used where no edits are given.
CLEANING = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"),
    (r"[0-9a-f]{32,}", "[key]"),
    (r"[0-9]{9,}", "[number]"),
    (r"([#*$%&|<>])\1{2,}", r"\1"),
)


class TokenTree:
    """Sums over the leaves of one document."""

    def __init__(self, chars: Sequence[int], tokens: Sequence[int]):
        self.leaves = max(len(chars), 1)
        self.width = 1 << (self.leaves - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        self.chars[self.width : self.width + len(chars)] = list(chars)
        self.tokens[self.width : self.width + len(tokens)] = list(tokens)
        for node in range(self.width - 1, 0, -1):
            self._add_up(node)

    def _add_up(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @classmethod
    def of(cls, text: str, bpe: ByteBpe) -> TokenTree:
        pieces = bpe.split(text)
        counts, lengths = bpe.count(pieces), list(map(len, pieces))
        groups = range(0, len(pieces), LEAF)
        return cls([sum(lengths[g : g + LEAF]) for g in groups], [sum(counts[g : g + LEAF]) for g in groups])

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_chars(self) -> list[int]:
        return self.chars[self.width : self.width + self.leaves]

    def leaf_tokens(self) -> list[int]:
        return self.tokens[self.width : self.width + self.leaves]

    def locate(self, place: int) -> tuple[int, int]:
        """(leaf that holds the character, where the leaf starts); the last leaf with text beyond the end."""
        node, start = 1, 0
        place = min(place, self.chars[1] - 1)
        while node < self.width:
            node *= 2
            if place - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        self.chars[node], self.tokens[node] = chars, tokens
        node //= 2
        while node:
            self._add_up(node)
            node //= 2

    def replace(self, text: str, start: int, end: int, new: str, bpe: ByteBpe) -> tuple[str, int]:
        """The text with [start, end) replaced, and how many pieces had to be encoded."""
        edited = text[:start] + new + text[end:]
        if not text:
            other = TokenTree.of(edited, bpe)
            self.__dict__.update(other.__dict__)
            return edited, sum(other.leaf_chars()) and len(bpe.split(edited))
        first, begin = self.locate(max(start - CONTEXT, 0))
        last, last_start = self.locate(end)
        stop = last_start + self.chars[self.width + last]
        shift = len(edited) - len(text)
        while True:
            pieces = bpe.split(edited[begin : stop + shift + CONTEXT])
            ends = list(accumulate(map(len, pieces)))
            if stop == len(text):
                break
            if stop + shift - begin in (0, *ends):
                pieces = [p for p, e in zip(pieces, ends) if e <= stop + shift - begin]
                break
            last += 1
            stop += self.chars[self.width + last]
        counts = bpe.count(pieces)
        if len(pieces) > 4 * LEAF * (last - first + 1):
            # The region has outgrown its leaves: it gets leaves of its own.
            groups = range(0, len(pieces), LEAF)
            chars = [sum(map(len, pieces[g : g + LEAF])) for g in groups]
            tokens = [sum(counts[g : g + LEAF]) for g in groups]
            old_chars, old_tokens = self.leaf_chars(), self.leaf_tokens()
            self.__init__(
                old_chars[:first] + chars + old_chars[last + 1 :], old_tokens[:first] + tokens + old_tokens[last + 1 :]
            )
        else:
            share = -(-len(pieces) // (last - first + 1)) or 1
            for k, leaf in enumerate(range(first, last + 1)):
                own = slice(k * share, (k + 1) * share)
                self.put(leaf, sum(map(len, pieces[own])), sum(counts[own]))
        return edited, len(pieces)

    def apply(self, text: str, edits: Sequence[Edit], bpe: ByteBpe) -> tuple[str, int, int]:
        """(edited text, edits done, pieces encoded). Offsets refer to the text as given.

        Edits are taken by start, insertions at one place as given; one that begins before the end of the one before
        it, or that lies outside of the text, is left out.
        """
        groups: list[list[Edit]] = []
        at = done = 0
        for start, end, new in sorted(edits, key=lambda e: e[:2]):
            if start < at or end < start or end > len(text):
                continue
            if groups and start - at < NEAR:
                groups[-1].append((start, end, new))
            else:
                groups.append([(start, end, new)])
            at, done = end, done + 1
        encoded = 0
        for group in reversed(groups):
            start, end = group[0][0], group[-1][1]
            parts, place = [], start
            for a, b, new in group:
                parts += [text[place:a], new]
                place = b
            text, n = self.replace(text, start, end, "".join(parts), bpe)
            encoded += n
        return text, done, encoded


def edits_by_rules(text: str, rules: Sequence[tuple[re.Pattern, str]]) -> list[Edit]:
    """Replacements of all matches; where two begin before the other ends, the earlier one, then the earlier rule."""
    found = [
        (m.start(), k, m.end(), m.expand(new)) for k, (pattern, new) in enumerate(rules) for m in pattern.finditer(text)
    ]
    out: list[Edit] = []
    for start, _, end, new in sorted(found):
        if end > start and (not out or start >= out[-1][1]):
            out.append((start, end, new))
    return out


_EDIT = "array<struct<start:int,end:int,new:string>>"
_EDITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("new", pa.string())]))


def build_trees(
    docs: DataFrame, rules: Sequence[tuple[str, str]] = (), path: str = RANKS, key: str = "doc_id"
) -> DataFrame:
    """Every whole text with its leaves: key, text, leaf_chars, leaf_tokens, n_tokens, edits.

    ``edits`` are the replacements that the rules (pattern, replacement) ask for;
    without rules the list is empty, to be filled by the caller. A null text counts
    as empty, repeated rows get a tree each, other columns are not read.
    """
    definition, pattern = vocabulary(path)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(definition, pattern)
        compiled = [(re.compile(p, re.ASCII), new) for p, new in rules]
        for batch in batches:
            for part in chunks(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                trees = [TokenTree.of(t, bpe) for t in texts]
                edits = [[dict(zip(("start", "end", "new"), e)) for e in edits_by_rules(t, compiled)] for t in texts]
                yield pa.record_batch(
                    [
                        part.column(key),
                        pa.array(texts, pa.string()),
                        int_lists([t.leaf_chars() for t in trees]),
                        int_lists([t.leaf_tokens() for t in trees]),
                        pa.array([t.total for t in trees], pa.int64()),
                        pa.array(edits, _EDITS),
                    ],
                    names=[key, "text", "leaf_chars", "leaf_tokens", "n_tokens", "edits"],
                )

    return docs.select(quoted(key), quoted("text")).mapInArrow(
        run, f"`{key}` {kind}, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long, edits {_EDIT}"
    )


def edit_trees(trees: DataFrame, path: str = RANKS, key: str = "doc_id") -> DataFrame:
    """Apply ``edits`` and keep the counts: key, text, leaf_chars, leaf_tokens, n_tokens, n_edits, n_encoded.

    ``n_encoded`` is the number of pieces that were encoded again. The result has
    the columns of a tree, so that further edits can follow. Null edits are none.
    """
    definition, pattern = vocabulary(path)
    kind = trees.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(definition, pattern)
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for row in part.drop_columns([key]).to_pylist():
                    tree = TokenTree(row["leaf_chars"], row["leaf_tokens"])
                    edits = [(e["start"], e["end"], e["new"] or "") for e in row["edits"] or []]
                    text, done, encoded = tree.apply(row["text"] or "", edits, bpe)
                    rows.append((text, tree.leaf_chars(), tree.leaf_tokens(), tree.total, done, encoded))
                text, chars, tokens, total, done, encoded = zip(*rows)
                yield pa.record_batch(
                    [
                        part.column(key),
                        pa.array(text, pa.string()),
                        int_lists(chars),
                        int_lists(tokens),
                        *[pa.array(x, pa.int64()) for x in (total, done, encoded)],
                    ],
                    names=[key, "text", "leaf_chars", "leaf_tokens", "n_tokens", "n_edits", "n_encoded"],
                )

    return trees.select(*[quoted(c) for c in (key, "text", "leaf_chars", "leaf_tokens", "edits")]).mapInArrow(
        run,
        f"`{key}` {kind}, text string, leaf_chars array<int>, leaf_tokens array<int>, "
        "n_tokens long, n_edits long, n_encoded long",
    )
