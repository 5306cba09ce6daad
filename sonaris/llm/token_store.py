"""Token-id output in binary shards with a minimal perfect hash index.

File format, little-endian throughout, one pair of files for each shard of consecutive documents:

``shard-N.ids``  the raw ids of its documents one after another, unsigned integers of 2 bytes where
                 the vocabulary has at most 65,536 ids and of 4 bytes otherwise, each document
                 closed by the end id.
``shard-N.idx``  "MPHI", version, bytes of an id, number of keys k, levels, then for each level its size
                 in bits and its bit array, then for each slot of the perfect hash a 32-bit fingerprint, the
                 64-bit offset (in ids) and the 64-bit length; then the k keys in ascending order, to go
                 through all of them; then the documents that no key leads to (null keys, and all but the
                 first of equal keys): their number, then for each the 64-bit key, one byte (1: key is null),
                 64-bit offset, 64-bit length.

The perfect hash is a cascade of bit arrays: at level L a key claims bit h_L(key) mod size; bits
claimed once are kept, the keys of contested bits move on to the next level. A key's slot is the
number of set bits before its own, so k keys fill exactly k slots. A lookup costs a few hash
probes, one slot read and a fingerprint test, whatever the number of documents; an unknown key passes that
test with a probability of 2**-32.

Shards are the range partitions of the key order, about ``SHARD_BYTES`` of input each and ``MAX_SHARDS`` at
most, so shards and the offsets within them are in ascending key order, and the global start of a shard is
the sum of the ids of those before it. The manifest holds each shard's first and last key, so that a key's
shard is found by bisection.

Paths: whatever pyarrow.fs opens by URI (local and mounted folders, hdfs, s3, gs; s3a and s3n are read as s3).

Edge cases: null text is an empty document (the end id alone); an empty table gives no shard and no
row; equal keys may span shards, a lookup gives the first of them in the order of the files, and reading
gives all; rows with a null key come first and are only read sequentially.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonaris.llm.bpe import codec, default_tokenizer, id_bytes, slices
from sonaris.llm.common import scratch_path, shuffle_partitions, store

GAMMA = 2.0
#: Input bytes of a shard, about, and shards at most (larger ones beyond), which bounds the manifest.
SHARD_BYTES, MAX_SHARDS = 128 << 20, 500_000
MAX_LEVELS = 64


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 of unsigned 64-bit keys."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys, with fingerprints."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        counts = [int(x.sum()) for x in levels]
        self.base = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        self.rank = [np.cumsum(x, dtype=np.int64) - x for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """The hash of distinct keys; equal ones raise."""
        left, levels = keys.astype(np.uint64), []
        while len(left):
            if len(levels) == MAX_LEVELS:
                raise ValueError("keys must be distinct")
            size = max(8, int(len(left) * GAMMA))
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 for keys that no level holds; any slot for other unknown keys (the fingerprint tells)."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        for k, (bits, rank) in enumerate(zip(self.levels, self.rank)):
            at = (_mix(keys, k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] & (out < 0)
            out[hit] = self.base[k] + rank[at[hit]]
        return out

    @staticmethod
    def prints(keys: np.ndarray) -> np.ndarray:
        """The keys' 32-bit fingerprints."""
        return (_mix(keys.astype(np.uint64), 1 << 20) >> np.uint64(32)).astype(np.uint32)


SLOT = np.dtype([("print", "<u4"), ("offset", "<i8"), ("length", "<i8")])
EXTRA = np.dtype([("key", "<i8"), ("null", "u1"), ("offset", "<i8"), ("length", "<i8")])


def index_bytes(keys: np.ndarray, null: np.ndarray, lengths: np.ndarray, width: int = 4) -> bytes:
    """The .idx file of documents with these keys (any where null) and lengths, in file order."""
    offsets = np.cumsum(lengths) - lengths
    known = np.flatnonzero(~null)
    distinct, firsts = np.unique(keys[known], return_index=True)
    rows = known[firsts]
    own = distinct.astype(np.int64).view(np.uint64)
    mph = PerfectHash.build(own)
    slot = mph.slots(own)
    table = np.zeros(len(own), SLOT)
    table["print"][slot], table["offset"][slot], table["length"][slot] = mph.prints(own), offsets[rows], lengths[rows]
    rest = np.setdiff1d(np.arange(len(keys)), rows)
    extra = np.zeros(len(rest), EXTRA)
    extra["key"], extra["null"], extra["offset"], extra["length"] = np.where(null, 0, keys)[rest], null[rest], offsets[rest], lengths[rest]
    parts = [b"MPHI", struct.pack("<IIQI", 3, width, len(own), len(mph.levels))]
    for bits in mph.levels:
        parts += [struct.pack("<Q", len(bits)), np.packbits(bits).tobytes()]
    return b"".join([*parts, table.tobytes(), own.tobytes(), struct.pack("<Q", len(rest)), extra.tobytes()])


class ShardIndex:
    """An .idx file in memory."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != b"MPHI":
            raise ValueError("not an index file")
        version, self.width, n, levels = struct.unpack_from("<IIQI", raw, 4)
        if version != 3:
            raise ValueError(f"an index file of version {version}")
        at, bits = 24, []
        for _ in range(levels):
            (size,) = struct.unpack_from("<Q", raw, at)
            wide = (size + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(raw, np.uint8, wide, at + 8), count=size).astype(bool))
            at += 8 + wide
        self.mph = PerfectHash(bits)
        self.table = np.frombuffer(raw, SLOT, n, at)
        at += n * SLOT.itemsize
        self.keys = np.frombuffer(raw, "<i8", n, at)
        at += 8 * n
        (rest,) = struct.unpack_from("<Q", raw, at)
        self.extra = np.frombuffer(raw, EXTRA, rest, at + 8)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, offset, length) of each key, by hash, slot and fingerprint."""
        own = np.asarray(keys, np.int64).view(np.uint64)
        slot = self.mph.slots(own)
        if not len(self.table):
            return np.zeros(len(own), bool), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        hit = self.table[np.maximum(slot, 0)]
        return (slot >= 0) & (hit["print"] == self.mph.prints(own)), hit["offset"], hit["length"]

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, null, offset, length) of all documents in file order, and which of them were found by their key."""
        found, offset, length = self.find(self.keys)
        rows = np.zeros(len(self.keys) + len(self.extra), EXTRA)
        own = rows[: len(self.keys)]
        own["key"], own["offset"], own["length"] = self.keys, offset, length
        rows[len(self.keys) :] = self.extra
        order = np.argsort(rows["offset"])
        rows, indexed = rows[order], order < len(self.keys)
        if not found.all() or (rows["offset"] != np.cumsum(rows["length"]) - rows["length"]).any():
            raise ValueError("an index whose documents don't cover its shard")
        return rows, indexed


def _fs(uri: str):
    """(file system, path): any store that pyarrow can reach by the URI, on whatever executor this runs."""
    from pyarrow import fs

    uri = re.sub("^s3[an]:", "s3:", uri)
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


#: Files are written in this folder and renamed when whole, so that a lost or repeated task leaves whole files only.
ATTEMPTS = "_attempts"


class _Shard:
    """The files of one shard while they are written."""

    def __init__(self, path: str, shard: int, width: int) -> None:
        self.fs, self.root = _fs(path)
        self.name, self.width = f"shard-{shard:06d}", width
        self.aside = f"{self.root}/{ATTEMPTS}/{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.root}/{ATTEMPTS}", recursive=True)
        self.out = self.fs.open_output_stream(self.aside)
        self.keys: list[np.ndarray] = []
        self.null: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def add(self, keys: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.keys.append(keys.fill_null(0).to_numpy(zero_copy_only=False))
        self.null.append(keys.is_null().to_numpy(zero_copy_only=False))
        self.lengths.append(lengths)

    def close(self) -> dict:
        """Both files in place; the manifest's columns for them."""
        self.out.close()
        keys, null, lengths = (np.concatenate(x) for x in (self.keys, self.null, self.lengths))
        with self.fs.open_output_stream(f"{self.aside}.idx") as out:
            out.write(index_bytes(keys, null, lengths, self.width))
        self.fs.move(self.aside, f"{self.root}/{self.name}.ids")
        self.fs.move(f"{self.aside}.idx", f"{self.root}/{self.name}.idx")
        known = keys[~null]
        return {"n_docs": len(keys), "n_ids": int(lengths.sum()), "first_key": int(known.min()) if len(known) else None, "last_key": int(known.max()) if len(known) else None}


def shard_count(df: DataFrame, text: str = "text") -> int:
    """Shards of about SHARD_BYTES, by the plan's estimate of df's size or, where it has none, its texts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # Spark's word for an unknown size
        size = df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    return max(1, min(MAX_SHARDS, max(shuffle_partitions(df.sparkSession), -(-size // SHARD_BYTES))))


def write_token_shards(df: DataFrame, path: str, tokenizer: str | None = None, *, end_id: int = 1, key: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Encode every whole text and write the shards below path; returns the manifest, stored: shard int,
    n_docs long, n_ids long, first_key and last_key long (null if all its keys are), start long (ids of all
    shards before), ids_file, idx_file."""
    file, count = tokenizer or default_tokenizer(), shards or shard_count(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, shard, out = codec(file), TaskContext.get().partitionId(), None
        for whole in batches:
            for b in slices(whole, "text"):
                if out is None:
                    out = _Shard(path, shard, 2 if max(len(c.tokens) - 1, end_id) < 1 << 16 else 4)
                ids, counts = c.encode(b.column("text"))
                out.add(b.column("key"), np.insert(ids, np.cumsum(counts), end_id), counts + 1)
        if out is not None:
            row = {"shard": shard} | out.close() | {"ids_file": f"{path}/{out.name}.ids", "idx_file": f"{path}/{out.name}.idx"}
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), _KINDS)], list(row))

    # rows of one key and text are alike, so they may be dealt over shards by their place
    ordered = (df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
               .withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
               .repartitionByRange(count, "key", "tie", "place").sortWithinPartitions("key", "tie").select("key", "text"))
    manifest = store(ordered.mapInArrow(run, "shard int, n_docs long, n_ids long, first_key long, last_key long, ids_file string, idx_file string"), "token-manifest")
    fs, root = _fs(path)
    if fs.get_file_info(f"{root}/{ATTEMPTS}").type.name == "Directory":
        fs.delete_dir(f"{root}/{ATTEMPTS}")  # what lost tasks have left
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each of at most MAX_SHARDS
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


_KINDS = [pa.int32(), *[pa.int64()] * 4, pa.string(), pa.string()]
_DOCUMENT = "key long, shard int, start long, n_tokens long, ids binary"


def _index(uri: str) -> ShardIndex:
    fs, at = _fs(uri)
    with fs.open_input_stream(at) as f:
        return ShardIndex(f.read())


def read_token_shards(manifest: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Every document of the shards: key, shard int, start long (ids of all documents before it),
    n_tokens long, ids binary (little-endian unsigned 32-bit), indexed boolean (its place was found by its
    key; the others are of null and equal keys). A task reads one shard at a time, in blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in (r for b in batches for r in b.to_pylist()):
            index = _index(m["idx_file"])
            documents, indexed = index.documents()
            fs, at = _fs(m["ids_file"])
            with fs.open_input_stream(at) as f:
                step = 0
                ends = documents["offset"] + documents["length"]
                while step < len(ends):
                    begin = int(documents["offset"][step])
                    to = max(step + 1, int(np.searchsorted(ends, begin + (2 << 20), "right")))
                    rows = documents[step:to]
                    ids = np.frombuffer(f.read(index.width * int(ends[to - 1] - begin)), f"<u{index.width}")
                    yield pa.RecordBatch.from_arrays([
                        pa.array(rows["key"], pa.int64(), mask=rows["null"].astype(bool)), pa.array(np.full(to - step, m["shard"], np.int32)),
                        pa.array(m["start"] + rows["offset"]), pa.array(rows["length"]),
                        id_bytes(ids, rows["length"]).cast(pa.binary()), pa.array(indexed[step:to])], ["key", "shard", "start", "n_tokens", "ids", "indexed"])
                    step = to

    dealt = manifest.repartition(shuffle_partitions(manifest.sparkSession), "shard")
    return dealt.mapInArrow(run, f"{_DOCUMENT}, indexed boolean").withColumnRenamed("key", key)


def lookup(manifest: DataFrame, keys: DataFrame | list[int], *, key: str = "doc_id") -> DataFrame:
    """The documents of these keys (a column of a frame, or a list), wherever they are in the store: key, shard
    int, start long, n_tokens long, ids binary. Unknown and null keys give no row, repeated ones one. Each key's
    shard is found by bisection in the manifest; then a task reads that shard's index and the asked spans only."""
    spark = manifest.sparkSession
    if isinstance(keys, list):
        keys = spark.createDataFrame([(k,) for k in keys], f"`{key}` long")
    held = manifest.where("first_key IS NOT NULL").select("first_key", "last_key", "shard", "start", "ids_file", "idx_file")
    ranges = held.select("first_key", "last_key", "shard").orderBy("shard").toArrow()  # MAX_SHARDS rows at most
    shared = spark.sparkContext.broadcast(tuple(ranges.column(c).to_numpy() for c in ("first_key", "last_key", "shard")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, shard = shared.value
        for b in batches:
            own = b.column("key").to_numpy()
            at = np.searchsorted(last, own, "left")  # the first shard that doesn't end before the key
            ok = at < len(last)
            ok[ok] = first[at[ok]] <= own[ok]
            yield pa.RecordBatch.from_arrays([pa.array(own[ok]), pa.array(shard[at[ok]])], ["key", "shard"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = b.column("shard").to_numpy()
            for own in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(shard)) + 1):
                if not len(own):
                    continue
                m, keys = b.slice(int(own[0]), 1).to_pylist()[0], b.column("key").to_numpy()[own]
                index = _index(m["idx_file"])
                ok, offset, length = index.find(keys)
                fs, at = _fs(m["ids_file"])
                with fs.open_input_file(at) as payload:
                    raw = [payload.read_at(index.width * int(n), index.width * int(o)) for o, n in zip(offset[ok], length[ok])]
                ids = [np.frombuffer(x, f"<u{index.width}").astype("<u4").tobytes() for x in raw]
                yield pa.RecordBatch.from_arrays([pa.array(keys[ok]), pa.array(shard[own][ok]), pa.array(m["start"] + offset[ok]), pa.array(length[ok]), pa.array(ids, pa.binary())], ["key", "shard", "start", "n_tokens", "ids"])

    asked = keys.select(F.col(key).cast("long").alias("key")).where("key IS NOT NULL").distinct()
    placed = asked.mapInArrow(place, "key long, shard int").join(held.drop("first_key", "last_key"), "shard")
    dealt = placed.repartition(shuffle_partitions(spark), "shard").sortWithinPartitions("shard", "key")
    return dealt.mapInArrow(read, _DOCUMENT).withColumnRenamed("key", key)


def op3_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write documents as token shards and read every document back from the files."""
    from sonaris.llm.common import table

    manifest = write_token_shards(table(spark, sf_dir, "documents"), scratch_path(spark, "token-shards"))
    return read_token_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "shard", "indexed")
