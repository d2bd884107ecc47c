"""Operator 8: SentencePiece encoding and decoding by suffix-array matching."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_texts
from weftline.llm.vocabulary import CONTROL, PIECES, SPACE, UNKNOWN, Vocabulary, read

LETTERS_PER_KEY = 4


class _Known(dict):
    """Numbers of the pre-tokens met so far; new ones are numbered and noted in `fresh`."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        self.fresh.append(unit)
        return number


class Encoder:
    """Encodes batches of distinct pre-tokens and remembers what it has encoded, up to `remember` of them."""

    def __init__(self, vocabulary: Vocabulary, batch: int = 100_000, remember: int = 150_000) -> None:
        self.v, self.batch, self.remember = vocabulary, batch, remember
        own = [vocabulary.pieces[i] for i in vocabulary.matched]
        letters = sorted(set("".join(own)))
        self.letter = np.zeros(0x110000, np.uint16)  # 0: in no piece, and the end of a pre-token
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.keys = -(-vocabulary.longest // LETTERS_PER_KEY)
        self.lengths = np.array([len(p) for p in own])
        self.low = self._piece_keys(own, 0)
        self.high = self._piece_keys(own, 0xFFFF)
        self.clear()

    def clear(self) -> None:
        self.known = _Known()
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _piece_keys(self, pieces: list[str], fill: int) -> np.ndarray:
        x = np.full((len(pieces), self.keys * LETTERS_PER_KEY), fill, np.uint64)
        for i, p in enumerate(pieces):
            x[i, : len(p)] = self.letter[[ord(c) for c in p]]
        return self._packed(x)

    @staticmethod
    def _packed(x: np.ndarray) -> np.ndarray:
        """Four letters to a number, in an order that is the letters' own."""
        x = x.reshape(len(x), -1, LETTERS_PER_KEY)
        return (x[:, :, 0] << np.uint64(48)) | (x[:, :, 1] << np.uint64(32)) | (x[:, :, 2] << np.uint64(16)) | x[:, :, 3]

    def _match(self, codes: np.ndarray) -> np.ndarray:
        """Table of edges by (position, length): the index of the piece that stands there, or -1.

        The suffixes of the batch text are sorted by as many letters as the longest piece has; each piece's range of
        suffixes is found by binary search, all pieces at once.
        """
        n, reach = len(codes), self.keys * LETTERS_PER_KEY
        x = np.zeros(n + reach, np.uint64)
        x[:n] = self.letter[codes]
        one = (x[:-3] << np.uint64(48)) | (x[1:-2] << np.uint64(32)) | (x[2:-1] << np.uint64(16)) | x[3:]
        columns = [one[LETTERS_PER_KEY * k : LETTERS_PER_KEY * k + n] for k in range(self.keys)]
        suffixes = np.lexsort(columns[::-1])
        ordered = [c[suffixes] for c in columns]
        first, last = self._search(ordered, self.low, False), self._search(ordered, self.high, True)
        sizes = last - first
        piece = np.repeat(np.arange(len(sizes)), sizes)
        at = suffixes[np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(len(piece))]
        edges = np.full((n + 1) * (self.v.longest + 1), -1, np.int32)
        edges[at * (self.v.longest + 1) + self.lengths[piece]] = piece  # a slot for each position and length: sorted by position
        return edges.reshape(n + 1, self.v.longest + 1)

    def _search(self, ordered: list[np.ndarray], wanted: np.ndarray, beyond: bool) -> np.ndarray:
        """Places of the wanted rows among the ordered ones: the first not under each, or, with `beyond`, the first over it.

        The first column alone places a piece of up to four letters; others are looked for among the rows that share it.
        """
        low, high = (np.searchsorted(ordered[0], wanted[:, 0], side) for side in ("left", "right"))
        # all rows are at or over zeros, and none is over the greatest number
        short = (wanted[:, 1:] == (np.iinfo(np.uint64).max if beyond else 0)).all(axis=1)
        (low if beyond else high)[short] = (high if beyond else low)[short]
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            less, same = np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for k, column in enumerate(ordered[1:], 1):
                value, want = column[middle], wanted[open_, k]
                less |= same & (value < want)
                same &= value == want
            right = less | (same if beyond else False)
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
        return low

    def _encode(self, units: list[str]) -> None:
        text = "\0".join(units) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = self._match(codes)
        sizes = np.array([len(u) for u in units])
        begins = np.cumsum(sizes + 1) - sizes - 1
        unit = np.repeat(np.arange(len(units)), sizes)
        at = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(len(unit))
        start, length, owner = (self._merge if self.v.bpe else self._relax)(edges, at, unit, sizes, begins)
        piece = edges[start, length]
        ids = np.where(piece >= 0, self.v.matched[np.maximum(piece, 0)], -1).astype(np.int32)
        if (odd := np.flatnonzero(ids < 0)).size:
            spread = [self.v.fallback(text[p]) for p in start[odd].tolist()]
            more = np.ones(len(ids), np.int64)
            more[odd] = [len(x) for x in spread]
            ids, owner = np.repeat(ids, more), np.repeat(owner, more)
            ids[ids < 0] = [i for x in spread for i in x]
        counted = np.bincount(owner, minlength=len(units))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(counted) - counted)
        self.sizes = np.append(self.sizes, counted)
        self.ids = np.append(self.ids, ids)

    def _merge(self, edges: np.ndarray, at: np.ndarray, unit: np.ndarray, sizes: np.ndarray, begins: np.ndarray) -> tuple:
        """Relaxation for BPE models: the edge of the highest score that joins two neighbours goes first, then the leftmost."""
        scores = np.append(self.v.scores[self.v.matched], -np.inf)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in np.flatnonzero(sizes > 64):  # few: one by one with a heap
            s, n = self._merge_long(edges, int(begins[k]), int(sizes[k]), scores)
            done.append((s, n, np.full(len(s), k)))
        short = sizes[unit] <= 64
        start, owner = at[short], unit[short]
        length = np.ones(len(start), np.int64)
        while len(start):
            joined = length[:-1] + length[1:]
            can = (owner[:-1] == owner[1:]) & (joined <= self.v.longest)
            value = np.full(len(start), -np.inf)
            value[:-1][can] = scores[edges[start[:-1][can], joined[can]]]
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.maximum.reduceat(value, heads)
            count = np.diff(np.append(heads, len(start)))
            alive = best > -np.inf
            keep = np.repeat(alive, count)
            if not alive.all():
                done.append((start[~keep], length[~keep], owner[~keep]))
            hit = np.flatnonzero(keep & (value == np.repeat(best, count)))
            hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])] if len(hit) else hit
            length[hit] += length[hit + 1]
            keep[hit + 1] = False
            start, length, owner = start[keep], length[keep], owner[keep]
        start, length, owner = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (start, length, owner)
        order = np.argsort(start, kind="stable")
        return start[order], length[order], owner[order]

    def _merge_long(self, edges: np.ndarray, begin: int, size: int, scores: np.ndarray) -> tuple:
        length, before, after = [1] * size, list(range(-1, size - 1)), list(range(1, size + 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < size and length[i] + length[j] <= self.v.longest and (p := edges[begin + i, length[i] + length[j]]) >= 0:
                heapq.heappush(heap, (-scores[p], i, length[i], length[j]))

        for i in range(size - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if length[i] != a or j >= size or length[j] != b:
                continue
            length[i], length[j] = a + b, 0
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        kept = [i for i in range(size) if length[i]]
        return np.array(kept) + begin, np.array([length[i] for i in kept])

    def _relax(self, edges: np.ndarray, at: np.ndarray, unit: np.ndarray, sizes: np.ndarray, begins: np.ndarray) -> tuple:
        """Relaxation for unigram models: edges by position, all pre-tokens together; ties go to the longer last piece."""
        scores = np.append(self.v.scores[self.v.matched], -np.inf)
        unknown = scores[:-1].min(initial=0.0) - 10.0
        best = np.full(len(edges), -np.inf)
        back = np.ones(len(edges), np.int64)
        best[begins] = 0.0
        for depth in range(1, int(sizes.max(initial=0)) + 1):
            ends = begins[sizes >= depth] + depth
            for n in range(min(depth, self.v.longest), 0, -1):
                p = edges[ends - n, n]
                gain = scores[p] if n > 1 else np.where(p >= 0, scores[p], unknown)
                value = best[ends - n] + gain
                better = value > best[ends]
                best[ends[better]], back[ends[better]] = value[better], n
        lists = []
        live, end = np.arange(len(sizes))[sizes > 0], (begins + sizes)[sizes > 0]
        while len(live):
            n = back[end]
            end = end - n
            lists.append((end, n, live))
            more = end > begins[live]
            live, end = live[more], end[more]
        start, length, owner = (np.concatenate(x) for x in zip(*lists, strict=True)) if lists else (at, at, unit)
        order = np.argsort(start, kind="stable")
        return start[order], length[order], owner[order]

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        if len(self.known) > self.remember:
            self.clear()
        index, per_text = [], []
        for t in texts:
            n = 0
            for units in self.v.units(self.v.normalise(t)):
                n += len(units)
                index += units
            per_text.append(n)
        at = np.fromiter(map(self.known.__getitem__, index), np.int64, len(index))
        part, held = [], 0
        fresh, self.known.fresh = self.known.fresh, []
        for u in fresh:
            part.append(u)
            held += len(u) + 1
            if held >= self.batch:
                self._encode(part)
                part, held = [], 0
        if part:
            self._encode(part)
        sizes = self.sizes[at]
        ids = self.ids[np.repeat(self.starts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)]
        return ids, np.diff(ends)


class Decoder:
    def __init__(self, v: Vocabulary) -> None:
        self.prefix = v.prefix
        self.table = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.encode() for p, k in zip(v.pieces, v.kinds, strict=True)]
        if v.bytes_from >= 0:
            self.table[v.bytes_from : v.bytes_from + 256] = [bytes([b]) for b in range(256)]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


def _ids(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, text_col: str = "text", model_file: str = PIECES, ids_col: str = "ids", piece: int = 1_000_000) -> DataFrame:
    """docs with ids (array<int>), the ids of each whole text, equal to the library's own for the model file.

    Null and empty texts have no ids. The vocabulary is broadcast; its size is that of the model file. Columns of docs
    are passed on as they are; a column that has the name ids_col is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read(model_file))

    def start():
        encoder = Encoder(shared.value)
        return lambda texts: [_ids(*encoder.encode(texts.to_pylist()))]

    return map_texts(docs, text_col, f"{ids_col} array<int>", start, piece)


def decode(rows: DataFrame, ids_col: str = "ids", model_file: str = PIECES, text_col: str = "decoded") -> DataFrame:
    """rows with the text of their ids. Null ids give null; control ids give nothing; an unknown id gives ' ⁇ '."""
    shared = rows.sparkSession.sparkContext.broadcast(read(model_file))

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(shared.value)
        for p in parts:
            yield pd.Series([None if ids is None else decoder.decode(ids.tolist()) for ids in p], dtype=object)

    return rows.withColumn(text_col, run(F.col(ids_col)))


def round_trip(docs: DataFrame, model_file: str = PIECES, piece: int = 1_000_000) -> DataFrame:
    """doc_id, ids, n_tokens, restored of every row: whether decoding gives the text back (its space marks read as spaces).

    The ids are encoded and decoded in one pass, so that they go from Python to Spark once. A null text is an empty one.
    """

    shared = docs.sparkSession.sparkContext.broadcast(read(model_file))

    def start():
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            own = texts.to_pylist()
            ids, sizes = encoder.encode(own)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            same = [decoder.decode(ids[a:b].tolist()) == (t or "").replace(SPACE, " ") for t, a, b in zip(own, ends[:-1], ends[1:], strict=True)]
            return [_ids(ids, sizes), pa.array(sizes.astype(np.int32)), pa.array(same, pa.bool_())]

        return work

    rows = map_texts(docs.select("doc_id", "text"), "text", "ids array<int>, n_tokens int, restored boolean", start, piece)
    return rows.select("doc_id", "ids", "n_tokens", "restored")
