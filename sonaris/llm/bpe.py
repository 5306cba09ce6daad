"""BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that occurs inside no vocabulary token can never be merged, so a text may be cut
between the two and the fragments encoded independently.  The pair table is read off the
vocabulary; a cut is taken where the pair is forced *and* the pre-tokenizer certainly splits there
too (white space, a change between letters, digits and other signs, two digits), because the
end-of-word mark belongs to the last byte of a pre-token.  Fragments repeat heavily, so each
distinct one of a batch is encoded once and the ids are gathered with numpy.

Edge cases: a null text is an empty one and has no ids; a text that spells a special token is
encoded whole by the library (its special tokens match on the raw text); white space alone gives
no ids.  Rows keep whatever doc_id they have, null and repeated ones included.
"""

from __future__ import annotations

import ctypes
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are cut at once, and fragments that a worker remembers: both bound memory.
CHUNK_BYTES = 3 << 20
CACHE_FRAGMENTS = 500_000
#: Fragments that go to the library in one call, with a special token between them.
CALL_FRAGMENTS = 1000


def _byte_symbols() -> dict[str, int]:
    """The printable sign that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def forced_pairs(vocab: dict[str, int], end_of_word: str = "</w>") -> np.ndarray:
    """256 x 256: True where the pair of bytes occurs inside no token of the vocabulary."""
    symbols = _byte_symbols()
    free = np.ones((256, 256), bool)
    for token in vocab:
        core = token[: -len(end_of_word)] if end_of_word and token.endswith(end_of_word) else token
        raw = [symbols[c] for c in core if c in symbols]
        for a, b in zip(raw, raw[1:]):
            free[a, b] = False
    return free


def _classes() -> np.ndarray:
    """0 for other ASCII signs, 1 letters, 2 digits, 3 white space, 4 bytes of other characters."""
    kind = np.zeros(256, np.uint8)
    kind[[*range(65, 91), *range(97, 123)]] = 1
    kind[48:58] = 2
    kind[[9, 10, 11, 12, 13, 32]] = 3
    kind[128:] = 4
    return kind


class Codec:
    """One tokenizer file: exact ids as the library gives them, in bulk."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.guards = [s.encode() for s in special]
        self.mark, self.mark_id = max(special.items(), key=lambda x: x[1])
        kind = _classes()
        free = forced_pairs(spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or "")
        a, b = kind[:, None], kind[None, :]
        differ = ((a != b) | (a == 2)) & (a < 3) & (b < 3)
        self.cut = (free & differ).reshape(-1)
        self.space = kind == 3
        self.upper = np.zeros(256, bool)
        self.upper[65:91] = True
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.tokens = pa.array([self.tok.id_to_token(i) or "" for i in range(size)], pa.string())
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        calls = [new[i : i + CALL_FRAGMENTS] for i in range(0, len(new), CALL_FRAGMENTS)]
        flat, sizes = [], []
        for got in self.tok.encode_batch_fast([self.mark.join(c) for c in calls], add_special_tokens=False):
            ids = np.asarray(got.ids, np.uint32)
            at = np.flatnonzero(ids == self.mark_id)
            ends = np.append(at, len(ids))
            sizes.append(np.diff(np.concatenate(([-1], ends))) - 1)
            flat.append(np.delete(ids, at))
        sizes_ = np.concatenate(sizes)
        starts = len(self.flat) + np.cumsum(sizes_) - sizes_
        base = len(self.start)
        self.flat = np.concatenate([self.flat, *flat])
        self.start, self.size = np.concatenate([self.start, starts]), np.concatenate([self.size, sizes_])
        self.known.update(zip(new, range(base, base + len(new))))

    def _fragments(self, buf: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes without white space, whether a fragment begins at each, and what was white;
        begins: the texts' first bytes, each of which is a cut."""
        nxt = np.append(buf[1:], np.uint8(0))
        ascii_next = nxt < 128
        # an upper-case letter before a combining mark is left to the library's own normalizer
        low = np.where(self.upper[buf] & ascii_next, buf + 32, buf)
        cut = np.zeros(len(buf), bool)
        cut[1:] = self.cut[(low[:-1].astype(np.uint16) << 8) | low[1:]] & ascii_next[1:]
        white = self.space[buf]
        cut[1:] |= white[:-1]
        cut[begins] = True
        keep = ~white
        return low[keep], cut[keep], white

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        n = len(texts)
        raw_off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        all_ids, counts = [], np.zeros(n, np.int64)
        at = 0
        while at < n:
            to = int(np.searchsorted(raw_off, raw_off[at] + CHUNK_BYTES, "right")) - 1
            to = min(n, max(to, at + 1))
            ids, got = self._chunk(raw[raw_off[at] : raw_off[to]], raw_off[at : to + 1] - raw_off[at])
            all_ids.append(ids)
            counts[at:to] = got
            at = to
        return (np.concatenate(all_ids) if all_ids else np.zeros(0, np.uint32)), counts

    def _chunk(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, whole = len(off) - 1, bytes(buf)
        odd: list[int] = []
        if b"<|" in whole:
            low = whole.lower()
            hits = {m for g in self.guards for m in _finds(low, g.lower())}
            odd = sorted({int(np.searchsorted(off, p, "right")) - 1 for p in hits})
        if odd:  # those texts are blanked here and encoded whole by the library
            buf = buf.copy()
            for i in odd:
                buf[off[i] : off[i + 1]] = 32
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        firsts = off[:-1][np.diff(off) > 0]
        body, cut, white = self._fragments(buf, firsts)
        # bytes kept before each text, to find each text's first fragment
        kept = np.concatenate(([0], np.cumsum(~white)))[off]
        # white space at a text's start may have hidden its cut: put it back
        cut[kept[:-1][np.diff(kept) > 0]] = True
        begins = np.flatnonzero(cut)
        offsets = np.append(begins, len(body)).astype(np.int32)
        frags = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body)))
        coded = frags.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > CACHE_FRAGMENTS:
            self._forget()
        new = [w for w in words if w not in self.known]
        if new:
            self._learn(new)
        place = np.fromiter((self.known[w] for w in words), np.int64, len(words))
        codes = place[coded.indices.to_numpy(zero_copy_only=False)] if len(begins) else np.zeros(0, np.int64)
        sizes = self.size[codes]
        total = int(sizes.sum())
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.start[codes] - (ends - sizes), sizes) + np.arange(total)]
        first = np.searchsorted(begins, kept[:-1], "left")
        upto = np.concatenate(([0], ends))
        last = np.append(first[1:], len(begins))
        counts = upto[last] - upto[first]
        if odd:
            cut = np.cumsum(counts) - counts
            parts, got, prev = [], counts.copy(), 0
            for i in odd:
                mine = np.asarray(self.tok.encode(whole[off[i] : off[i + 1]].decode(), add_special_tokens=False).ids, np.uint32)
                parts += [ids[prev : cut[i]], mine]
                prev, got[i] = cut[i], len(mine)
            return np.concatenate([*parts, ids[prev:]]), got
        return ids, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """As the library's decode with skip_special_tokens=False for a file without a decoder:
        the tokens with a space between them; other files go through the library."""
        offsets = np.concatenate(([0], np.cumsum(counts)))
        if self.tok.decoder is not None:
            return pa.array([self.tok.decode(ids[a:b].tolist(), skip_special_tokens=False) for a, b in zip(offsets, offsets[1:])], pa.large_string())
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), self.tokens.take(pa.array(ids)))
        return pc.binary_join(lists, " ")


def _finds(whole: bytes, what: bytes) -> Iterator[int]:
    at = whole.find(what)
    while at >= 0:
        yield at
        at = whole.find(what, at + 1)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per worker and file."""
    return Codec(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def id_bytes(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Each text's ids as little-endian unsigned 32-bit integers."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int64) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


@lru_cache(maxsize=1)
def _trimmer():
    """glibc's malloc_trim, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda pad: 0


def release_memory() -> None:
    """Give back what a finished batch has freed: workers live on and would keep their largest size."""
    pa.default_memory_pool().release_unused()
    _trimmer()(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text; a longer text stands alone. Memory is released
    after the last."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(run, (run[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
    release_memory()


def bpe_encode(df: DataFrame, tokenizer: str | None = None, *, key: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """(key, n_tokens long, ids binary[, decoded string]) of every row; ids are little-endian
    unsigned 32-bit integers. No shuffle: one pass over the input's own partitions."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for b in slices(whole, "text"):
                ids, counts = c.encode(b.column("text"))
                cols = [b.column("key"), pa.array(counts), id_bytes(ids, counts).cast(pa.binary())]
                if decode:
                    cols.append(c.decode(ids, counts).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["key", "n_tokens", "ids", "decoded"][: len(cols)])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"key {kind}, n_tokens long, ids binary" + ", decoded string" * decode)
    return out.withColumnRenamed("key", key)


def bpe_decode(df: DataFrame, tokenizer: str | None = None, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded string) from ids as bpe_encode gives them; null ids are empty ones."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for b in slices(whole, "ids"):
                raw = [np.frombuffer(x or b"", "<u4") for x in b.column("ids").to_pylist()]
                counts = np.array([len(x) for x in raw], np.int64)
                flat = np.concatenate(raw) if raw else np.zeros(0, np.uint32)
                yield pa.RecordBatch.from_arrays([b.column("key"), c.decode(flat, counts).cast(pa.string())], ["key", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, decoded string").withColumnRenamed("key", key)


def id_array(ids: str = "ids"):
    """A Column builder: the binary ids as array<int>, native."""
    n, hexed = (F.length(F.col(ids)) / 4).cast("int"), F.hex(F.col(ids))
    number = lambda i: F.conv(F.concat(*[F.substring(hexed, i * 8 + 7 - 2 * k, F.lit(2)) for k in range(4)]), 16, 10).cast("int")
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), number))
