"""Cutting many texts into chunks at once, and numbering chunks by hash.

Texts lie end to end in one buffer of UTF-8 bytes; a table of byte classes tells where a chunk ends,
and chunks are hashed eight bytes at a time, so no Python object is made for a chunk met before.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np

#: Byte classes; the last byte is no part of UTF-8 and parts texts.
OTHER, SPACE, BREAK, LETTER, MARK = range(5)
BREAK_BYTE = 0xFF
_WHITE = (*range(9, 14), 32)
_K = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Longer chunks are hashed one by one.
LONG = 256


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    for b in range(33, 127):
        out[b] = LETTER if chr(b).isalpha() else OTHER if chr(b).isdigit() else MARK
    out[list(_WHITE)], out[BREAK_BYTE] = SPACE, BREAK
    return out


def _bounds(marks: bool) -> np.ndarray:
    """Whether a chunk ends between two classes (first * 8 + second): at white space and, if wanted,
    where an ASCII mark follows a letter, as every tokenizer here starts a word there."""
    out = np.zeros(64, bool)
    for a in range(5):
        for b in range(5):
            white = {a, b} & {SPACE, BREAK}
            out[a * 8 + b] = a != b if white else marks and (a, b) == (LETTER, MARK)
    return out


CLASS, AT_MARKS, AT_WHITE = _classes(), _bounds(True), _bounds(False)
#: Second bytes of Latin letters that follow 0xC3.
_LATIN = np.where(np.isin(np.arange(256), [x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]), LETTER, OTHER).astype(np.uint8)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, each followed by the break byte, and where each text starts."""
    buf = np.frombuffer(bytes((BREAK_BYTE,)).join([*texts, bytes((BREAK_BYTE,)) * 8]), np.uint8)
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return buf, np.cumsum(lens) - lens


def segments(buf: np.ndarray, bound: np.ndarray = AT_MARKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, class of the first byte) of runs of white space and of chunks without; no breaks."""
    kinds = CLASS[buf]
    if bound is AT_MARKS:
        after = np.flatnonzero(buf == 0xC3) + 1
        kinds[after] = _LATIN[buf[after]]
    at = np.flatnonzero(bound[(kinds[:-1] << 3) | kinds[1:]]) + 1
    starts = np.concatenate([[0], at])
    ends = np.concatenate([at, [len(buf)]])
    kind = kinds[starts]
    kept = kind != BREAK
    return starts[kept], ends[kept], kind[kept]


def hashed(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, turn: int = 0, many: int = 2) -> list[np.ndarray]:
    """One or two 64-bit hashes of each piece of the buffer; turn chooses a pair of a family."""
    keys = [k + np.uint64(2 * turn) for k in _K[:many]]
    rows = np.lib.stride_tricks.sliding_window_view(buf, 8)
    both = [(lens.astype(np.uint64) + np.uint64(turn)) * k for k in keys]
    todo = None  # all at first, then those with bytes left
    for done in range(0, LONG, 8):
        some = (starts, lens) if todo is None else (starts[todo] + done, lens[todo] - done)
        if not len(some[0]):
            break
        w = rows[some[0]].view(np.uint64)[:, 0] & _MASKS[np.minimum(some[1], 8)]
        for h, k in zip(both, keys):
            x = ((h if todo is None else h[todo]) ^ w) * k
            h[slice(None) if todo is None else todo] = x ^ (x >> np.uint64(29))
        todo = np.flatnonzero((lens > 8) & (lens <= LONG)) if todo is None else todo[some[1] > 8]
    for i in np.flatnonzero(lens > LONG):
        import xxhash

        for j, h in enumerate(both):
            h[i] = xxhash.xxh64_intdigest(buf[starts[i] : starts[i] + lens[i]].tobytes(), 2 * turn + j)
    for h, k in zip(both, keys):
        h *= k
        h ^= h >> np.uint64(32)
    return both


class Growing:
    """Arrays of varying length, end to end, to gather by number."""

    def __init__(self, dtype):
        self.flat, self.ends, self.n = np.empty(1 << 16, dtype), np.zeros(1 << 14, np.int64), 0

    def extend(self, parts: list[np.ndarray]) -> None:
        if len(parts):
            self.append(np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts)))

    def append(self, flat: np.ndarray, lens: np.ndarray) -> None:
        """Add arrays of these lengths that lie end to end in flat."""
        start = self.ends[self.n]
        ends = start + np.cumsum(lens)
        while self.n + len(lens) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while start + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.ends[self.n + 1 : self.n + 1 + len(lens)] = ends
        self.flat[start : start + len(flat)] = flat
        self.n += len(lens)

    def lengths(self, idx: np.ndarray) -> np.ndarray:
        return self.ends[idx + 1] - self.ends[idx]

    def gather(self, idx: np.ndarray) -> np.ndarray:
        lens = self.lengths(idx)
        shift = np.repeat(self.ends[idx] - (np.cumsum(lens) - lens), lens)
        return self.flat[shift + np.arange(len(shift))]


class Clash(Exception):
    """Two chunks of one hash."""


class Numbers:
    """Numbers chunks as they come, told apart by one hash and checked by another."""

    def __init__(self, turn: int = 0):
        self.turn, self.of, self.second, self.n = turn, {}, np.zeros(1 << 14, np.uint64), 0

    def __len__(self) -> int:
        return self.n

    def numbers(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each chunk, and where new chunks, in the order of their numbers, stand first."""
        import pandas as pd

        one, two = hashed(buf, starts, lens, self.turn)
        codes, met = pd.factorize(one)
        keys, before = met.tolist(), self.n
        own = np.fromiter(map(self.of.get, keys, repeat(-1)), np.int64, len(keys))
        fresh = np.flatnonzero(own < 0)
        self.n = before + len(fresh)
        own[fresh] = np.arange(before, self.n)
        self.of.update(zip(met[fresh].tolist(), range(before, self.n)))
        first = np.empty(len(met), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        new = first[fresh]
        while self.n > len(self.second):
            self.second = np.concatenate([self.second, np.zeros_like(self.second)])
        self.second[before : self.n] = two[new]
        numbers = own[codes]
        if (self.second[numbers] != two).any():
            raise Clash
        return numbers, new
