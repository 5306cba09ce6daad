"""Best-fit packing with Martello-Toth dominance reduction.

All items of one length are alike, so the instance is the histogram of lengths: at most ``capacity``
numbers, whatever the size of the corpus, and the only thing that is collected.  On it the reduction
permanently fixes sets that dominate every other set holding one of their items:

* an item that fits with no other stands alone;
* two items that fill a sequence exactly;
* an item that fits with one other at most takes the longest that fits;
* an item that fits with two others at most takes one that is no shorter than the best two together.

The rest is packed best-fit decreasing, also on counts.  The resulting *plan* says for every length
which ranks go to which run of sequences at which offset.  Ranks are numbered in Spark within
(length, hash part), so that a length that a third of all items share isn't numbered by one task, and
a worker finds the row of a rank in the plan by bisection.

Edge cases: null text is empty and becomes one piece with the end id alone; repeated rows are items of
their own; equal items are ordered by key, piece and checksum; lengths must be 1 to capacity (others
raise); an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonaris.llm.bpe import codec, default_tokenizer, slices
from sonaris.llm.common import shuffle_partitions, store

CAPACITY = 2048
END_ID = 0
#: Runs of a plan at most, as a multiple of the capacity.
MAX_RUNS = 5

Pattern = tuple[tuple[int, int], ...]


def reduce_instance(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Fix dominating sets until no rule applies; takes their items out of counts. Returns patterns
    ((length, how many), ...) with how many sequences each fills."""
    fixed: list[tuple[Pattern, int]] = []

    def fix(pattern: Pattern, times: int) -> None:
        fixed.append((pattern, times))
        for length, n in pattern:
            counts[length] -= n * times

    changed = True
    while changed:
        changed = False
        for s in np.flatnonzero(counts)[::-1].tolist():
            if not counts[s]:
                continue
            other = capacity - s
            if s == capacity:
                pattern: Pattern | None = ((s, 1),)
            elif other == s and counts[s] > 1:
                pattern = ((s, 2),)
            elif other != s and counts[other]:
                pattern = ((s, 1), (other, 1))
            else:
                pattern = _dominant(counts, s, capacity)
            if pattern:
                fix(pattern, min(int(counts[length]) // n for length, n in pattern))
                changed = True
    return fixed


def _dominant(counts: np.ndarray, s: int, capacity: int) -> Pattern | None:
    """The set with one item of length s that dominates all others, where a rule shows one.

    The rules compare the longest item that fits with sums of shorter ones. Taking the set's own items
    away leaves fewer of those, so the set dominates again until one of its lengths is used up."""
    left = capacity - s
    have = counts[: left + 1].copy()  # the others that may join it
    if s <= left:
        have[s] -= 1
    fits = np.flatnonzero(have)
    if not len(fits):
        return ((s, 1),)
    longest = int(fits[-1])
    pair = ((s, 1), (longest, 1)) if longest != s else ((s, 2),)
    least = np.repeat(fits[:3], np.minimum(have[fits[:3]], 3))[:3]
    if len(least) < 2 or least[0] + least[1] > left:
        return pair
    if len(least) < 3 or least.sum() > left:
        below = np.maximum.accumulate(np.where(have > 0, np.arange(left + 1), 0))  # the longest up to each length
        most = np.minimum(fits, left - fits)
        second = np.where((most == fits) & (have[fits] < 2), below[np.maximum(most - 1, 0)], below[most])
        if longest >= (fits + second)[second > 0].max(initial=0):
            return pair
    return None


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing of a histogram: runs of equal sequences are filled together."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    spaces: list[int] = []

    def add(space: int, pattern: Pattern, times: int) -> None:
        if times:
            if space not in open_:
                open_[space] = []
                insort(spaces, space)
            open_[space].append((pattern, times))

    for s in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[s])
        while n:
            at = bisect_left(spaces, s)
            if at < len(spaces):
                space = spaces[at]
                pattern, times = open_[space].pop()
                if not open_[space]:
                    del open_[space], spaces[at]
            else:
                space, pattern, times = capacity, (), -(-n // (capacity // s))
            each = space // s
            full = min(times, n // each)
            rest = min(n - full * each, each - 1) if full < times else 0
            add(space - each * s, (*pattern, (s, each)), full)
            add(space - rest * s, (*pattern, (s, rest)) if rest else pattern, 1 if rest else 0)
            add(space, pattern, times - full - (1 if rest else 0))
            n -= full * each + rest
    return [x for runs in open_.values() for x in runs if x[0]]


def plan_rows(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, how many in each sequence, offset of the first).

    Every fixed set uses a length up (of two equal items all but one), and best fit opens at most three runs
    for each length, so there are at most 5 * capacity runs whatever the number of items."""
    left = counts.astype(np.int64).copy()
    runs = reduce_instance(left, capacity)
    runs += best_fit_decreasing(left, capacity)
    if len(runs) > MAX_RUNS * capacity:
        raise RuntimeError(f"{len(runs)} runs in a plan for sequences of {capacity}")
    used, sequence, rows = np.zeros(len(counts), np.int64), 0, []
    for pattern, times in runs:
        offset = 0
        for length, n in pattern:
            rows.append((length, int(used[length]), int(used[length]) + n * times, sequence, n, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    return rows


class _Plan:
    """plan_rows in order of (length, first rank), as arrays: a worker finds an item's row by bisection."""

    def __init__(self, rows: list[tuple[int, ...]], capacity: int) -> None:
        self.shift = 62 - capacity.bit_length()
        table = np.array(sorted(rows), np.int64).reshape(-1, 6)
        if len(table) and table[:, 2].max() >> self.shift:
            raise ValueError("too many items of one length")
        self.keys = (table[:, 0] << self.shift) + table[:, 1]
        self.first, self.sequence, self.each, self.at = (np.ascontiguousarray(table[:, i]) for i in (1, 3, 4, 5))

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the items of these lengths and ranks."""
        row = np.searchsorted(self.keys, (lengths << self.shift) + ranks, "right") - 1
        own, each = ranks - self.first[row], self.each[row]
        return self.sequence[row] + own // each, self.at[row] + own % each * lengths


def best_fit_pack(df: DataFrame, *, length: str = "length", capacity: int = CAPACITY, order: list[str]) -> DataFrame:
    """df with sequence_id long and offset long. df is read more than once, so pass a stored one; order:
    the columns that tell items of one length apart."""
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    frame = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sizes = frame.groupBy(length, "__part").agg(F.count(F.lit(1)).alias("__n"))
    histogram = sizes.groupBy(length).agg(F.sum("__n").alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        if r[0] is None or not 1 <= r[0] <= capacity:
            raise ValueError(f"a length of {r[0]} cannot be packed into {capacity}")
        counts[r[0]] = r.n
    plan = spark.sparkContext.broadcast(_Plan(plan_rows(counts, capacity), capacity))  # bounded by the capacity alone
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(length).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select(F.col(length).alias("__l"), F.col("__part").alias("__p"), before.alias("__base"))
    own = F.row_number().over(Window.partitionBy(length, "__part").orderBy(*order)) - 1
    ranks = frame.withColumn("__own", own).join(base, (F.col(length) == F.col("__l")) & (F.col("__part") == F.col("__p")))
    ranks = ranks.select(*df.columns, F.col(length).cast("long").alias("__length"), (F.col("__own") + F.col("__base")).cast("long").alias("__rank"))

    made = [*df.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = plan.value.place(*(b.column(c).to_numpy() for c in ("__length", "__rank")))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(sequence), pa.array(offset)], made)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return ranks.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def token_pieces(df: DataFrame, tokenizer: str | None = None, *, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, piece int, start long, length long, ids_crc32 long[, ids binary]) of every row's ids, the
    end id appended, cut only where longer than capacity."""
    path = tokenizer or default_tokenizer()
    names = ["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for b in slices(whole, "text"):
                ids, counts = c.encode(b.column("text"))
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                pieces = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(counts[row] - start, capacity)
                at = (np.cumsum(counts) - counts)[row] + start
                raw = ids.tobytes()
                cuts = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist())]
                cols = [b.column("key").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in cuts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(cuts, pa.binary())] if with_ids else []), names)

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)
    return out.withColumnRenamed("key", key)


def pack_documents(df: DataFrame, tokenizer: str | None = None, *, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """token_pieces of every row, and the sequence_id and offset of each piece."""
    pieces = store(token_pieces(df, tokenizer, capacity=capacity, end_id=end_id, key=key, text=text, with_ids=with_ids), "pieces")
    return best_fit_pack(pieces, capacity=capacity, order=[key, "piece", "ids_crc32"])
