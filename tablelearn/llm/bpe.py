"""Byte-level BPE with the tokenizers library, over Arrow batches.

The vocabulary file is read on the driver, once; tasks get it as part of the
function (about 2 MB, whatever the number of texts). A text is split as the
pattern says, each piece is mapped from bytes to the characters that stand for
them and merged by the library, pieces seen before come from a bounded cache.
Decoding looks up the bytes of each id, so that characters split over several
tokens come back whole.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models, pre_tokenizers

from tablelearn.functions.columns import quoted
from tablelearn.llm.common import chunks

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CACHE_PIECES = 200_000
# Longer pieces are merged each time, so that the cache stays small.
CACHED_LENGTH = 64
# Texts made of code points below this are split with classes that were asked from the library itself.
PLAIN_LIMIT = 0x3000


@lru_cache(1)
def byte_characters() -> tuple[str, ...]:
    """The character that stands for each byte: itself if printable, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return tuple(chr(b) if b in shown else chr(next(rest)) for b in range(256))


def _parts(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """A piece merged by all ranks lower than ``below``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@lru_cache(4)
def vocabulary(path: str = RANKS) -> tuple[str, str]:
    """(the library's JSON for a rank file, pattern that splits plain texts).

    A token's merge is the pair of tokens that the lower ranks leave of it.
    """
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    shown = byte_characters()
    name = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            merges.append(tuple(name[p] for p in _parts(token, ranks, rank)))
    tokenizer = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, [m for m in merges if len(m) == 2]))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return tokenizer.to_str(), _plain_pattern(tokenizer.pre_tokenizer)


def _plain_pattern(splitter) -> str:
    """PATTERN with its classes written out for the code points below the limit.

    Which class a character is in is asked from the splitter: it stays with a
    letter, with a digit, with a sign, or with none of them. So the split is the
    library's, whatever edition of Unicode the regular expressions here follow.
    """
    letters, digits, signs, blanks = [], [], [], []
    for code in range(PLAIN_LIMIT):
        found = blanks
        for sample, kind in (("a", letters), ("1", digits), ("!", signs)):
            if len(splitter.pre_tokenize_str(sample + chr(code))) == 1:
                found = kind
        found.append(code)
    a, n, s = (_ranges(codes) for codes in (letters, digits, blanks))
    return f"'s|'t|'re|'ve|'m|'ll|'d| ?[{a}]+| ?[{n}]+| ?[^{s}{a}{n}]+|[{s}]+(?![^{s}])|[{s}]+"


def _ranges(codes: list[int]) -> str:
    out, start = [], 0
    for i in range(1, len(codes) + 1):
        if i == len(codes) or codes[i] != codes[i - 1] + 1:
            out.append(f"\\u{codes[start]:04x}-\\u{codes[i - 1]:04x}")
            start = i
    return "".join(out)


def token_bytes(definition: str) -> list[bytes]:
    """The bytes of each id."""
    back = {c: b for b, c in enumerate(byte_characters())}
    tokens = json.loads(definition)["model"]["vocab"]
    out = [b""] * (max(tokens.values(), default=-1) + 1)
    for token, i in tokens.items():
        out[i] = bytes(back[c] for c in token)
    return out


class _Cache(dict):
    """Ids of pieces, made by the library when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.make(piece)
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class ByteBpe:
    """Encoder and decoder of one vocabulary; build one per task."""

    def __init__(self, definition: str, pattern: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.splitter = self.tokenizer.pre_tokenizer
        self.plain = re.compile(pattern)
        self.beyond = re.compile(f"[^\\u0000-\\u{PLAIN_LIMIT - 1:04x}]")
        shown = byte_characters()
        self.table = str.maketrans({chr(b): c for b, c in enumerate(shown)})
        self.bytes = token_bytes(definition)
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.ids = _Cache(self._merge)
        self.counts = _Cache(lambda piece: len(self._merge(piece)))

    def _merge(self, piece: str) -> tuple[int, ...]:
        mapped = piece.encode("utf-8").decode("latin-1").translate(self.table)
        return tuple(t.id for t in self.model.tokenize(mapped))

    def split(self, text: str) -> list[str]:
        """The pieces that are merged separately; joined they are the text."""
        if self.beyond.search(text) is None:
            return self.plain.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.ids.__getitem__, self.split(text))))

    def count(self, pieces: list[str]) -> list[int]:
        return list(map(self.counts.__getitem__, pieces))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Code point start and end of each token; a token with part of a character covers all of it."""
        ends = np.cumsum(self.lengths[np.asarray(ids, dtype=np.int64)])
        starts = ends - self.lengths[np.asarray(ids, dtype=np.int64)]
        data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        return character[starts], character[ends - 1] + 1

    def pieces_of(self, ids: list[int]) -> list[str]:
        """Text token by token: a character appears with the token that completes it."""
        import codecs

        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        return [decoder.decode(self.bytes[i]) for i in ids]


def encode(
    docs: DataFrame, path: str = RANKS, offsets: bool = False, decoded: bool = False, key: str = "doc_id"
) -> DataFrame:
    """Ids of every whole text: key, ids array<int>; on request starts and ends (code points) and decoded (binary).

    ``decoded`` are the bytes of the ids, as ``decode`` gives them, in the same pass. No special tokens are added or recognised. A null text counts as empty and
    gives no ids. Repeated rows are encoded each; other columns are not read.
    """
    definition, pattern = vocabulary(path)
    fields = f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(definition, pattern)
        for batch in batches:
            for part in chunks(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = [bpe.encode(t) for t in texts]
                columns, names = [part.column(key), int_lists(ids)], [key, "ids"]
                if offsets:
                    places = [bpe.offsets(t, i) for t, i in zip(texts, ids)]
                    columns += [int_lists([p[0] for p in places]), int_lists([p[1] for p in places])]
                    names += ["starts", "ends"]
                if decoded:
                    columns.append(pa.array([bpe.decode(i) for i in ids], pa.binary()))
                    names.append("decoded")
                yield pa.record_batch(columns, names=names)

    schema = fields + ", starts array<int>, ends array<int>" * offsets + ", decoded binary" * decoded
    return docs.select(quoted(key), quoted("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = RANKS, key: str = "doc_id") -> DataFrame:
    """Bytes of every list of ids: key, ids, decoded binary. Null ids decode to nothing."""
    table = token_bytes(vocabulary(path)[0])
    fields = f"`{key}` {encoded.schema[key].dataType.simpleString()}, ids array<int>, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                lists = part.column("ids")
                out = pa.array([b"".join(map(table.__getitem__, x or ())) for x in lists.to_pylist()], pa.binary())
                yield pa.record_batch([part.column(key), lists, out], names=[key, "ids", "decoded"])

    return encoded.select(quoted(key), quoted("ids")).mapInArrow(run, fields)


def int_lists(rows: list) -> pa.ListArray:
    sizes = np.fromiter((len(r) for r in rows), dtype=np.int32, count=len(rows))
    values = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(sizes.sum()))
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values))
