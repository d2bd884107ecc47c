"""Operator 5: token counts by unigram scores over a trie of the distinct pre-tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_texts
from weftline.llm.vocabulary import PIECES, Vocabulary, read

BASE = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)
BITS = 20
#: Units of more characters go one by one: few share more than this, and the trie takes one step for each depth.
LONG = 128


class _Seen(dict):
    """Numbers of the pre-tokens met so far; new ones are noted in `fresh`."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        self.fresh.append(unit)
        return number


class TrieCounter:
    """Counts of the tokens in the best unigram segmentation; each distinct pre-token is worked out once."""

    def __init__(self, vocabulary: Vocabulary, remember: int = 300_000) -> None:
        self.v, self.remember = vocabulary, remember
        own = [vocabulary.pieces[i] for i in vocabulary.matched]
        self.scores = vocabulary.scores[vocabulary.matched]
        self.unknown = float(self.scores.min(initial=0.0)) - 10.0
        self.power = np.array([pow(int(BASE), k, 1 << 64) for k in range(vocabulary.longest + 1)], np.uint64)
        self.hashes = np.zeros(len(own), np.uint64)
        lengths = np.array([len(p) for p in own])
        codes = np.zeros((len(own), vocabulary.longest), np.uint64)
        for i, p in enumerate(own):
            codes[i, : len(p)] = [ord(c) + 1 for c in p]
        for d in range(vocabulary.longest):
            on = lengths > d
            self.hashes[on] = self.hashes[on] * BASE + codes[on, d]
        self.tables, left = [], np.arange(len(own))
        while len(left):  # pieces that fall on a taken slot go to a further table
            slot = (self.hashes[left] * SPREAD) >> np.uint64(64 - BITS)
            _, first = np.unique(slot, return_index=True)
            table = np.full(1 << BITS, -1, np.int32)
            table[slot[first]] = left[first]
            self.tables.append(table)
            left = np.delete(left, first)
        self.clear()

    def clear(self) -> None:
        self.seen, self.counted = _Seen(), np.zeros(0, np.int64)

    def _piece(self, h: np.ndarray) -> np.ndarray:
        slot, out = (h * SPREAD) >> np.uint64(64 - BITS), np.full(len(h), -1, np.int64)
        for table in self.tables:
            p = table[slot]
            out = np.where((p >= 0) & (self.hashes[p] == h), p, out)
        return out

    def _trie(self, units: list[str], width: int) -> np.ndarray:
        """Token counts of sorted distinct units of at most `width` characters.

        A node of the trie is (first unit with the prefix, length of the prefix); forward scores and counts are worked
        out at the node alone, and a unit reads its count at its terminal node. Ties go to the longer last piece.
        """
        sizes = np.array([len(u) for u in units])
        codes = np.frombuffer("".join(u.ljust(width, "\0") for u in units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(units), width).astype(np.uint64) + np.uint64(1)
        same = np.logical_and.accumulate(codes[1:] == codes[:-1], axis=1).sum(axis=1)
        shared = np.minimum(np.concatenate([[0], same]), np.concatenate([[0], sizes[:-1]]))
        rows = np.arange(len(units))
        owner = np.zeros((width + 1, len(units)), np.int32)
        score, count = np.zeros((width + 1, len(units))), np.zeros((width + 1, len(units)), np.int32)
        prefix = np.zeros((width + 1, len(units)), np.uint64)
        for d in range(1, width + 1):
            prefix[d] = prefix[d - 1] * BASE + codes[:, d - 1]
            own = (sizes >= d) & (d > shared)
            owner[d] = np.maximum.accumulate(np.where(own, rows, 0))
            at = np.flatnonzero(own)
            if not len(at):
                continue
            best, tokens = np.full(len(at), -np.inf), np.zeros(len(at), np.int32)
            for k in range(min(d, self.v.longest), 0, -1):
                p = self._piece(prefix[d, at] - prefix[d - k, at] * self.power[k])
                fits = p >= 0
                if k == 1:
                    gain = np.where(fits, self.scores[p], self.unknown)
                    more = np.ones(len(at), np.int32)
                    for i in np.flatnonzero(~fits):
                        more[i] = len(self.v.fallback(units[at[i]][d - 1]))
                elif fits.any():
                    gain, more = np.where(fits, self.scores[p], -np.inf), 1
                else:
                    continue
                before = owner[d - k, at]
                value = score[d - k, before] + gain
                better = value > best
                best = np.where(better, value, best)
                tokens = np.where(better, count[d - k, before] + more, tokens)
            score[d, at], count[d, at] = best, tokens
        return count[sizes, owner[sizes, rows]]

    def _long(self, units: list[str], block: int = 1 << 18) -> list[int]:
        """Token counts of sorted distinct long units, one forward pass each over the places where pieces match.

        The pass starts after the prefix shared with the unit before. Of a unit longer than a block only the scores that
        the next places can reach are held, so that memory does not go with its length.
        """
        reach, out, last = self.v.longest, [], ""
        score, count, base = [0.0], [0], 0
        for unit in units:
            shared = 0 if base else next((i for i, (a, b) in enumerate(zip(last, unit)) if a != b), min(len(last), len(unit)))
            score, count, base = score[: shared + 1] if shared else [0.0], count[: shared + 1] if shared else [0], 0
            for low in range(shared, len(unit), block):
                high, begin = min(low + block, len(unit)), max(0, low - reach + 1)
                codes = np.frombuffer(unit[begin:high].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
                h, found = np.zeros(len(codes), np.uint64), []
                for k in range(1, min(reach, len(codes)) + 1):
                    h = h[: len(codes) - k + 1] * BASE + codes[k - 1 :]
                    p = self._piece(h)
                    at = np.flatnonzero(p >= 0)
                    at = at[at + begin + k > low]
                    found.append((at + begin + k, np.full(len(at), k), self.scores[p[at]]))
                end, size, gain = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((-size, end))
                cuts = np.searchsorted(end[order], np.arange(low + 1, high + 2)).tolist()
                size, gain = size[order].tolist(), gain[order].tolist()
                for e in range(low + 1, high + 1):
                    best, tokens, single = -np.inf, 0, False
                    for i in range(cuts[e - low - 1], cuts[e - low]):
                        k = size[i]
                        value = score[e - k - base] + gain[i]
                        if value > best:
                            best, tokens = value, count[e - k - base] + 1
                        single = single or k == 1
                    if not single and (value := score[e - 1 - base] + self.unknown) > best:
                        best, tokens = value, count[e - 1 - base] + len(self.v.fallback(unit[e - 1]))
                    score.append(best)
                    count.append(tokens)
                if len(unit) > block and (gone := len(score) - reach) > 0:
                    score, count, base = score[gone:], count[gone:], base + gone
            out.append(count[-1])
            last = unit
        return out

    def _count(self, units: list[str]) -> np.ndarray:
        out, order = np.zeros(len(units), np.int64), sorted(range(len(units)), key=units.__getitem__)
        sizes = np.array([len(u) for u in units])
        long = [i for i in order if sizes[i] > LONG]
        out[long] = self._long([units[i] for i in long])
        order = [i for i in order if sizes[i] <= LONG]
        width = 16
        while len(order):
            now = [i for i in order if sizes[i] <= width]
            step = max(1, 1_000_000 // width)
            for at in range(0, len(now), step):
                part = now[at : at + step]
                out[part] = self._trie([units[i] for i in part], width)
            order = [i for i in order if sizes[i] > width]
            width *= 2
        return out

    def count(self, texts: list) -> tuple[list[int], list[int]]:
        """Pre-tokens and tokens of each text."""
        if len(self.seen) > self.remember:
            self.clear()
        index, per_text = [], []
        for t in texts:
            n = 0
            for units in self.v.units(self.v.normalise(t)):
                n += len(units)
                index.append(np.fromiter(map(self.seen.__getitem__, units), np.int64, len(units)))
            per_text.append(n)
        fresh, self.seen.fresh = self.seen.fresh, []
        if fresh:
            self.counted = np.append(self.counted, self._count(fresh))
        at = np.concatenate(index) if index else np.zeros(0, np.int64)
        sums = np.concatenate([[0], np.cumsum(self.counted[at])])
        ends = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)
        return per_text, np.diff(sums[ends]).tolist()


def token_counts(docs: DataFrame, model_file: str = PIECES, id_col: str = "doc_id", text_col: str = "text", piece: int = 1_000_000) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every whole text: the length of the best unigram segmentation into the pieces.

    Scores are those in the model file, whatever its type; characters that no piece has count as their bytes. Null and
    empty texts have no tokens. The vocabulary is broadcast; its size is that of the model file. Every row has a row,
    repeated rows and null ids too; an empty table gives an empty result; other columns are ignored. A text without
    spaces is one unit and is worked out whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read(model_file))

    def start():
        counter = TrieCounter(shared.value)
        return lambda texts: [pa.array(x, pa.int64()) for x in counter.count(texts.to_pylist())]

    rows = map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "n_pretokens bigint, n_tokens bigint", start, piece)
    return rows.drop("text")
