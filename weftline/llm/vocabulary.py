"""Reading a SentencePiece model file: its pieces, scores and settings."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Path of a public vocabulary file; a parameter of the operators that read one.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

# Fixed values of the public model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (b[at] & 127) << shift
            shift += 7
            at += 1
            if b[at - 1] < 128:
                return value

    while at < len(b):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if tag & 7 == 2 else 4 if tag & 7 == 5 else 8
            yield tag >> 3, b[at : at + n]
            at += n


@dataclass
class Vocabulary:
    """Pieces by id; ids of those that text can match; settings. A few MB at most: the file's size is its bound."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    bpe: bool
    prefix: bool
    unknown: int
    bytes_from: int
    matched: np.ndarray = field(init=False)
    longest: int = field(init=False)
    splits: bool = field(init=False)

    def __post_init__(self) -> None:
        self.matched = np.flatnonzero((self.kinds == NORMAL) | (self.kinds == USER))
        own = [self.pieces[i] for i in self.matched]
        self.longest = max(map(len, own), default=1)
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in own)  # no piece reaches over the start of a word

    def normalise(self, text: str | None) -> str:
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    def units(self, text: str, most: int = 1 << 20) -> Iterator[list[str]]:
        """Lists of the pre-tokens of a normalised text: runs of the space mark with what follows them."""
        if not self.splits:
            yield [text] if text else []
            return
        at = 0
        while at < len(text):
            cut = len(text) if len(text) - at <= most else text.find(SPACE, at + most)
            while 0 < cut < len(text) and text[cut - 1] == SPACE:
                cut = text.find(SPACE, cut + 1)
            cut = len(text) if cut <= 0 else cut
            yield _UNIT.findall(text, at, cut)
            at = cut

    def fallback(self, char: str) -> list[int]:
        if self.bytes_from < 0:
            return [self.unknown]
        return [self.bytes_from + b for b in char.encode("utf-8", "surrogatepass")]


_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def read(path: str = PIECES) -> Vocabulary:
    """Reads a model file with the identity normalisation and without white-space removal; others are an error."""
    with open(path, "rb") as f:
        top = list(_fields(f.read()))
    pieces, scores, kinds, model, norm = [], [], [], {}, {}
    for n, v in top:
        if n == 1:
            p = dict(_fields(v))
            pieces.append(p.get(1, b"").decode())
            scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
            kinds.append(p.get(3, NORMAL))
        elif n == 2:
            model = dict(_fields(v))
        elif n == 3:
            norm = dict(_fields(v))
    if norm.get(1, b"identity") != b"identity" or norm.get(4, 1) or model.get(3, UNIGRAM) not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models with identity normalisation that keep white space are read")
    kinds = np.array(kinds)
    at = np.flatnonzero(kinds == BYTE)
    return Vocabulary(pieces, np.array(scores), kinds, model.get(3, UNIGRAM) == BPE, bool(norm.get(3, 1)), int(np.flatnonzero(kinds == UNKNOWN)[0]), int(at[0]) if len(at) == 256 else -1)
