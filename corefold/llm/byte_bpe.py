"""Byte-level BPE through a sentencepiece model made from the vocabulary.

A rank file (base64 token, rank) becomes a serialised BPE model: each token's
bytes mapped to printable characters, scored by its negative rank, identity
normaliser, no dummy prefix. Text is cut into pre-tokens by the pattern; each is
mapped to characters, encoded by the model and found again by the inverse map.
A pre-token that is itself in the vocabulary is that one token.

Null and empty texts have no tokens. The vocabulary's path is a parameter; it must
be readable on the executors.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corefold.llm import common

#: Entries of a worker's table, some 30 MB; a full one is emptied. Workers are reused by later stages.
CACHE = 1 << 17
CACHED_CHARS = 64


def byte_characters() -> list[str]:
    """Printable character of each byte: itself, or the next free one from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [tokens[i] for i in range(len(tokens))]


def _field(number: int, kind: int, value: bytes) -> bytes:
    return _varint(number << 3 | kind) + value


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _block(number: int, body: bytes) -> bytes:
    return _field(number, 2, _varint(len(body)) + body)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces in rank order, then one unknown piece."""
    chars = byte_characters()
    pieces = [_block(1, "".join(chars[b] for b in token).encode()) + _field(2, 5, struct.pack("<f", -float(rank))) for rank, token in enumerate(tokens)]
    pieces.append(_block(1, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2)))
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(pieces))) + _field(40, 0, _varint(len(tokens)))
    normaliser = _block(1, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5))
    return b"".join(_block(1, p) for p in pieces) + _block(2, trainer) + _block(3, normaliser)


class Codec:
    """The model with its maps and a bounded table of pre-tokens seen."""

    def __init__(self, path: str, pattern: str):
        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.whole = {token: rank for rank, token in enumerate(tokens)}
        chars = byte_characters()
        self.chars = dict(enumerate(chars))
        back = {c: b for b, c in enumerate(chars)}
        self.bytes_of = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(tokens))]
        self.split = regex.compile(pattern).findall  # white space is Unicode's here, as the pattern wants
        self.seen: dict[str, bytes] = {}

    def _learn(self, fresh: list[str]) -> dict[str, bytes]:
        out, open_ = {}, []
        for p in fresh:
            raw = p.encode()
            if raw in self.whole:
                out[p] = struct.pack("<I", self.whole[raw])
            else:
                open_.append((p, raw.decode("latin-1").translate(self.chars)))
        for (p, _), ids in zip(open_, self.model.encode([m for _, m in open_], out_type=int, num_threads=1) if open_ else []):
            out[p] = np.array(ids, "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        parts = [self.split(t) for t in texts]
        fresh = list(set().union(*parts).difference(self.seen))
        self.seen.update(self._learn(fresh))
        out = [b"".join(map(self.seen.__getitem__, p)) for p in parts]
        if len(self.seen) > CACHE:
            self.seen = {}
        else:
            for p in fresh:
                if len(p) > CACHED_CHARS:
                    del self.seen[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One per process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """All columns plus n_tokens and ids (little-endian 32-bit), which take the place of
    the caller's columns of these names."""
    names = [c for c in docs.columns if c not in ("n_tokens", "ids")]

    def run(b: dict[str, list]) -> dict[str, list]:
        ids = codec(path, pattern).encode([t or "" for t in b[text]])
        return {**{c: b[c] for c in names}, "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    return common.scan(rows, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", n_tokens bigint, ids binary", common.FEW_CHARS)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns plus decoded (bytes of the ids)."""
    names = [c for c in encoded.columns if c != "decoded"]

    def run(b: dict[str, list]) -> dict[str, list]:
        own = codec(path, pattern)
        return {**{c: b[c] for c in names}, "decoded": [own.decode(x) for x in b["ids"]]}

    rows = encoded.select(*[F.col(f"`{c}`") for c in names])
    return common.scan(rows, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded binary", common.FEW_CHARS)
