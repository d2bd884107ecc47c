"""Hashed character n-grams of whole texts, in numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from weftline.llm.common import by_size, distinct

MULTIPLIER = np.uint32(0x01000193)
MIX = np.uint32(0x9E3779B1)


def _codes(pieces: list[tuple[int, str, int]], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased pieces, each followed by `gap` zeros; the places where a piece's own n-grams begin; the
    row of each of these. An n-gram that reaches over a text's end has zeros there, whatever text comes next."""
    lowered = [p.lower() for _, p, _ in pieces]
    pad = "\0" * gap
    codes = np.frombuffer((pad.join(lowered) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
    # a few letters change their number when lower-cased: a piece that is cut keeps what its own part has become
    own = [len(x) if len(p) == n else len(p[:n].lower()) for x, (_, p, n) in zip(lowered, pieces, strict=True)]
    starts = np.cumsum([0, *[len(x) + gap for x in lowered[:-1]]])
    places = np.repeat(starts - np.cumsum(own) + own, own) + np.arange(sum(own))
    return codes, places, np.repeat([r for r, _, _ in pieces], own)


def _buckets(codes: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """For each order the bucket of the n-gram at every position of codes but the last few."""
    c = codes * MIX
    c ^= c >> np.uint32(15)
    h = c.copy()
    for n in range(1, max(orders) + 1):
        if n > 1:
            h = h[:-1] * MULTIPLIER + c[n - 1 :]
        if n in orders:
            yield ((h ^ np.uint32(n * 0x5BD1E995 & 0xFFFFFFFF)) * MIX) >> np.uint32(32 - bits)


def present(texts: list, orders: tuple[int, ...], bits: int, table: np.ndarray | None = None, held: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of the texts. Without a table a feature is a bucket; with one it is
    table[bucket] - 1, and buckets where the table has 0 are passed over. Long texts are read whole, in pieces that
    overlap by an n-gram; pairs are merged whenever over `held` new ones have come together, so that memory goes with
    the distinct pairs and not with the text."""
    width = 1 << bits if table is None else int(table.max()) + 1
    merged, keys, new = np.zeros(0, np.int64), [], 0
    for pieces in by_size(texts, 1 << 17, max(orders) - 1):
        codes, places, rows = _codes(pieces, max(orders))
        for at in _buckets(codes, orders, bits):
            if table is None:
                key = rows * width + at[places]
            else:
                feature = table[at[places]].astype(np.int64)
                key = (rows * width + feature - 1)[feature > 0]
            keys.append(distinct(key))
            new += len(keys[-1])
        if new > held:
            merged, keys, new = distinct(np.concatenate([merged, *keys])), [], 0
    key = distinct(np.concatenate([merged, *keys]))
    return key // width, key % width


def counts(texts: list, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Dense (row, bucket) counts; for few buckets and a bounded number of texts."""
    width = 1 << bits
    out = np.zeros((len(texts), width), np.float32)
    flat = out.reshape(-1)
    for pieces in by_size(texts, 1 << 18, max(orders) - 1):
        codes, places, rows = _codes(pieces, max(orders))
        if not len(rows):
            continue
        first, span = rows[0] * width, (rows[-1] - rows[0] + 1) * width
        for at in _buckets(codes, orders, bits):
            flat[first : first + span] += np.bincount(rows * width - first + at[places], minlength=span)
    return out
