"""Words, lines and hashes of many texts at once, with numpy over the texts' own bytes.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return.  Hashes are 64 bits wide and depend on content alone, so they agree between tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are hashed at once: a worker holds some 60 bytes for each.
CHUNK_BYTES = 2 << 20
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Odd factors that tell the places of a shingle apart.
PLACES = np.array([(0x9FB21C651E98DF25 * (2 * i + 1) ** 3) % (1 << 64) | 1 for i in range(64)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """BASE**i and BASE**-i modulo 2**64, kept for the longest chunk so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                steps = np.full(n, base, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for every span, from one running sum."""
    up, down = _powers.get(len(values) + 1)
    run = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * up[:-1], out=run[1:])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(U64) * PLACES[0])


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string array; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


class Words:
    """The words of a chunk of texts."""

    def __init__(self, texts: pa.Array) -> None:
        self.buf, self.off = raw_bytes(texts)
        self.n = len(self.off) - 1
        buf = self.buf
        self.white = (buf == 32) | ((buf >= 9) & (buf <= 13))
        solid = ~self.white
        fresh = solid.copy()
        fresh[1:] &= self.white[:-1]
        last = solid.copy()
        last[:-1] &= self.white[1:]
        inner = self.off[1:-1]
        inner = inner[(inner > 0) & (inner < len(buf))]
        fresh[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        self.start, self.end = np.flatnonzero(fresh), np.flatnonzero(last) + 1
        #: first word of each text, and one past the last text's
        self.first = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.first)

    def lowered(self) -> np.ndarray:
        """The bytes with A-Z in lower case."""
        upper = (self.buf >= 65) & (self.buf <= 90)
        return np.where(upper, self.buf + 32, self.buf)

    def hashes(self, lower: bool) -> np.ndarray:
        return span_hashes(self.lowered() if lower else self.buf, self.start, self.end)

    def docs(self) -> np.ndarray:
        """Each word's text."""
        return np.repeat(np.arange(self.n), self.count)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of the bytes' flags are set in each text."""
        run = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=run[1:])
        return np.diff(run[self.off])

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every k words in a row that lie within a text, index of its first word)."""
        if k > len(PLACES):
            raise ValueError(f"windows have at most {len(PLACES)} words")
        if len(hashes) < k:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        n = len(hashes) - k + 1
        total = hashes[:n] * PLACES[0]
        for i in range(1, k):
            total = total + hashes[i : i + n] * PLACES[i]
        docs = self.docs()
        at = np.flatnonzero(docs[:n] == docs[k - 1 :])
        return mix(total[at]), at

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text) of every line: texts are split at line feeds only."""
        feeds = np.flatnonzero(self.buf == 10)
        start = np.sort(np.concatenate([self.off[:-1], feeds + 1]))
        end = np.sort(np.concatenate([self.off[1:], feeds]))
        return start, end, np.repeat(np.arange(self.n), self.per_text(self.buf == 10) + 1)
