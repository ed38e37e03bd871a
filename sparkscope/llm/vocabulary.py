"""Reading a SentencePiece model file: pieces, scores and kinds."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
#: A model file over this is refused, as its parsed form is sent to every executor.
MAX_MODEL_BYTES = 64_000_000


def _fields(data: bytes):
    """The fields of a protocol-buffers message: (number, value); nested messages and strings as bytes."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 1:
            yield key >> 3, data[at : at + 8]
            at += 8
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        elif kind == 5:
            yield key >> 3, data[at : at + 4]
            at += 4
        else:
            raise ValueError(f"unexpected wire type {kind} in a SentencePiece model")


@dataclass
class Vocabulary:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    dummy_prefix: bool = True

    def normal(self) -> dict[str, float]:
        """Pieces that text can be cut into, with their scores."""
        return {p: s for p, s, k in zip(self.pieces, self.scores, self.kinds) if k in (NORMAL, USER_DEFINED, UNUSED)}

    def ids(self) -> dict[str, int]:
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER_DEFINED, UNUSED)}

    def byte_ids(self) -> list[int]:
        """The id of the fallback piece of each byte."""
        at = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        if len(at) != 256:
            raise ValueError("the model has no byte fallback")
        return [at[b] for b in range(256)]


def parse(data: bytes) -> Vocabulary:
    """Supports models with identity normalisation, kept white space and a full set of byte pieces."""
    out = Vocabulary()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out.pieces.append(piece)
            out.scores.append(score)
            out.kinds.append(kind)
        elif number == 3:
            spec = dict(_fields(value))
            out.dummy_prefix = bool(spec.get(3, 1))
            if spec.get(2) or spec.get(4, 1):
                raise ValueError("only identity normalisation with kept white space is supported")
    if any(k in (USER_DEFINED, UNUSED) for k in out.kinds):
        raise ValueError("user-defined and unused pieces are not supported")
    if any(SPACE in p[1:] and p.strip(SPACE) for p in out.normal()):
        raise ValueError("pieces that join words are not supported")
    if any("\n" in p for p in out.normal()):
        raise ValueError("pieces with line breaks are not supported")
    return out


def load(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        data = f.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    return parse(data)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_path() -> str:
    return public_path("piece_bpe_32k.model")


class WordUnits:
    """Cuts texts into units between which no piece reaches: a run of space markers with the word after it, and what
    starts with a line break.

    ``cut`` returns keys: a unit's key is the unit without its first space marker, or, if it starts with a line break,
    the unit itself. So ``str.split`` gives the keys of ordinary text; texts with other runs of spaces take longer.
    """

    @staticmethod
    def cut(text: str) -> list[str]:
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        keys = text.replace("\n", " \n").split(" ")
        if "" not in keys:
            return keys
        out, pending = [], 0
        for key in keys:
            if not key:
                pending += 1
            elif key[0] == "\n":
                if pending:  # markers of their own; the first of them is the one that a key implies
                    out.append(SPACE * (pending - 1))
                out.append(key)
                pending = 0
            else:
                out.append(SPACE * pending + key)
                pending = 0
        if pending:
            out.append(SPACE * (pending - 1))
        return out

    @staticmethod
    def unit(key: str) -> str:
        return key if key[:1] == "\n" else SPACE + key
