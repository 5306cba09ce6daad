"""Nearest neighbours by shifted space-filling curves.

Several orderings of all vectors are made: each projects them onto a few orthonormal directions (the
first those of greatest variance, the others random ones), shifts them by a random part of their range and
numbers the cells of a Hilbert curve.  A range partitioning sorts each ordering; a query is compared with
the rows whose place in an ordering is within a window of its own, and the orderings' results merge and are
reranked on the original vectors.  That bounds the distance of each query's k-th neighbour.

The first ordering is then cut into blocks of neighbouring keys, and each block keeps the box of its
projected vectors.  A projection onto orthonormal directions lengthens no distance, so a block whose box
is farther from a query than that query's bound holds none of its neighbours: a query meets only the other
blocks, and the result is exact.  Where the data has few dimensions most blocks are left out; where it
has as many as its vectors (uniform directions in 64 dimensions) hardly any is, and the work grows with
queries times rows, in tasks of bounded size.  With ``exact=False`` the windows' result is returned.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, as queries or candidates; ties go to the smaller id; equal vectors
of different ids are candidates of their own, repeated rows are one; a row is never its own neighbour, and rows that share its id aren't either;
fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaris.llm.common import fresh, shuffle_partitions, store

ORDERINGS, DIRECTIONS, BITS, WINDOW = 4, 6, 10, 128
#: Rows of a block with a box, boxes at most (blocks grow beyond), and the directions that a box has.
BOX_ROWS, MAX_BOXES, BOX_DIRECTIONS = 4000, 20_000, 16
#: Queries and rows that one comparison holds, and sampled rows for the ranges.
QUERY_BLOCK, ROW_BLOCK, FIT_ROWS = 2000, 50_000, 5000
SEED = 7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n, d) with so many bits a coordinate; d * bits <= 63.
    After Skilling, Programming the Hilbert curve (2004)."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def main_directions(sample: np.ndarray, n: int) -> np.ndarray:
    """The n orthonormal directions of greatest variance, as columns."""
    _, vectors = np.linalg.eigh(np.cov(sample.T).reshape(sample.shape[1], -1) if len(sample) > 1 else np.eye(sample.shape[1]))
    return vectors[:, ::-1][:, :n]


def _orderings(sample: np.ndarray, n: int, directions: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(projection, low, width) of each ordering; cells are as wide in every direction, the widest range of the
    sample is widened by half, ranges are shifted at random, and points beyond fall into the outermost cells."""
    out = []
    for k in range(n):
        rng = np.random.default_rng(SEED + k)
        directions = min(directions, sample.shape[1])
        axes = np.linalg.qr(rng.standard_normal((sample.shape[1], directions)))[0] if k else main_directions(sample, directions)
        p = sample @ axes
        low, wide = p.min(0), max(float(np.ptp(p, axis=0).max()), 1e-12)
        out.append((axes, low - rng.uniform(0, 0.5, len(low)) * wide, wide * 1.5))
    return out


def distances(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances of one vector to rows, components added in order, in double precision."""
    total = np.zeros(len(rows))
    for i in range(len(q)):
        total += (rows[:, i] - q[i]) ** 2
    return np.sqrt(total)


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k nearest rows of each query, ties to smaller ids, nothing beyond
    within. A matrix product finds those that may count; their distances are then taken exactly."""
    out: list[tuple[np.ndarray, ...]] = []
    q2, r2 = (q**2).sum(1), (rows**2).sum(1)
    for a in range(0, len(q), 256):
        square = q2[a : a + 256, None] + r2 - 2 * (q[a : a + 256] @ rows.T)
        for i, line in enumerate(square, a):
            slack = 1e-9 * (q2[i] + r2.max(initial=0.0) + 1)
            limit = np.inf if within is None else within[i] ** 2 + slack
            own = ids != q_ids[i]
            line = np.where(own, line, np.inf)
            if len(line) > k:
                limit = min(limit, np.partition(line, k - 1)[k - 1] + 2 * slack)
            at = np.flatnonzero(own & (line <= limit))
            exact = distances(q[i], rows[at])
            best = np.lexsort((ids[at], exact))[:k]
            out.append((np.full(len(best), q_ids[i]), ids[at][best], exact[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """Vectors kept as bytes of their own precision, as doubles."""
    values = column.to_pylist()
    kind = f"<f{len(values[0]) // d}" if values else "<f8"
    return np.frombuffer(b"".join(values), kind).reshape(-1, d).astype(np.float64)


def nearest_neighbours(df: DataFrame, queries: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, orderings: int = ORDERINGS, directions: int = DIRECTIONS,
                       window: int = WINDOW, exact: bool = True) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): for each row where queries holds, its k
    nearest rows by Euclidean distance."""
    spark = df.sparkSession
    rows = _usable(df, queries, key, vector)
    size = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], schema)
    d, n = size.d, size.n
    rows = store(rows.where(F.size("vec") == d).mapInArrow(_packer, "id long, query boolean, vec binary").distinct(), "vectors")
    chance = min(1.0, 2 * FIT_ROWS / n)
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) < chance * (1 << 30)).select("vec").limit(FIT_ROWS).collect()
    fit = _matrix(pa.array([bytes(r.vec) for r in sample] or [bytes(8 * d)], pa.binary()), d)
    line = _line(rows, _orderings(fit, orderings, directions), d)
    found = store(_windows(line, d, k, window), "window-neighbours")
    top = Window.partitionBy("query_id").orderBy("score", "vec_id")
    merged = found.distinct().withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    if exact:
        bound = merged.groupBy("query_id").agg(F.max("score").alias("within"), F.count(F.lit(1)).alias("n"))
        bound = bound.select("query_id", F.when(F.col("n") < k, float("inf")).otherwise(F.col("within")).alias("within"))
        met = meetings(line, bound, main_directions(fit, min(BOX_DIRECTIONS, d)), d, n)
        merged = _met_neighbours(line, met, d, n, k).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _usable(df: DataFrame, queries: Column, key: str, vector: str) -> DataFrame:
    """(id, query boolean, vec) of the vectors that take part; floats stay floats, all else becomes doubles."""
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col("vec")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("query"), F.col(vector).cast(kind).alias("vec"))
    return rows.where(v.isNotNull() & F.col("id").isNotNull()).where(fine)


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kind = "<f4" if pa.types.is_float32(b.column("vec").type.value_type) else "<f8"
        vecs = [np.asarray(v, kind).tobytes() for v in b.column("vec").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("query"), pa.array(vecs, pa.binary())], ["id", "query", "vec"])


def _line(rows: DataFrame, orderings: list, d: int) -> DataFrame:
    """(ordering, rank, asked, id, query, vec): every row's place in each ordering, those of an ordering one
    after another, and how many queries come before it."""
    parts = shuffle_partitions(rows.sparkSession)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("vec"), d)
                for o, (axes, low, wide) in enumerate(orderings):
                    cells = ((x @ axes - low) / wide * (1 << BITS)).clip(0, (1 << BITS) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, o, np.int32)), pa.array(hilbert_keys(cells, BITS)), *b.columns], ["ordering", "place", *b.schema.names])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, asked = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            run = np.cumsum(b.column("query").to_numpy(zero_copy_only=False).astype(np.int64))
            before = asked + np.concatenate([[0], run[:-1]])[: b.num_rows]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows)), pa.array(before), *b.columns], ["part", "at", "before", *b.schema.names])
            at, asked = at + b.num_rows, asked + int(run[-1] if len(run) else 0)

    fields = "ordering int, place long, id long, query boolean, vec binary"
    line = rows.mapInArrow(keyed, fields).repartitionByRange(parts, "ordering", "place", "id").sortWithinPartitions("ordering", "place", "id")
    line = store(line.mapInArrow(numbered, f"part int, at long, before long, {fields}"), "curve")
    # where each partition begins: one row for each partition
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = line.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("query").cast("long")).alias("q"))
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"), F.coalesce(F.sum("q").over(upto), F.lit(0)).alias("q_base"))
    return line.join(sizes, "part").select("ordering", (F.col("base") + F.col("at")).alias("rank"), (F.col("q_base") + F.col("before")).alias("asked"), "id", "query", "vec")


def _windows(line: DataFrame, d: int, k: int, window: int) -> DataFrame:
    """(query_id, vec_id, score): each query's k nearest within the windows of every ordering."""
    placed = line.withColumn("block", F.floor(F.col("rank") / window))
    asked = placed.where("query").select("block", "ordering", "rank", "id", "vec")
    near = placed.withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1))).select("block", "ordering", "rank", "id", "vec")
    near = near.join(asked.select("block").distinct(), "block", "left_semi")

    def compare(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return _neighbours([])
        qo, co = q.column("ordering").to_numpy(), c.column("ordering").to_numpy()
        qr, cr = q.column("rank").to_numpy(), c.column("rank").to_numpy()
        qi, ci, qx, cx = q.column("id").to_numpy(), c.column("id").to_numpy(), _matrix(q.column("vec"), d), _matrix(c.column("vec"), d)
        out = []
        for i in range(len(qi)):
            at = (np.abs(cr - qr[i]) <= window) & (co == qo[i])
            out.append(nearest(qi[i : i + 1], qx[i : i + 1], ci[at], cx[at], k))
        return _neighbours(out)

    return fresh(asked).groupBy("block").cogroup(fresh(near).groupBy("block")).applyInArrow(compare, "query_id long, vec_id long, score double")


def _neighbours(found: list) -> pa.Table:
    cols = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})


def _block(n: int) -> Column:
    """The block of a row of the first ordering."""
    return F.floor(F.col("rank") / max(BOX_ROWS, -(-n // MAX_BOXES))).cast("int")


def _boxes(line: DataFrame, axes: np.ndarray, d: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, low, high) of the projected rows of every block, MAX_BOXES at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                block, p = b.column("block").to_numpy(), _matrix(b.column("vec"), d) @ axes
                own, at = np.unique(block, return_inverse=True)
                low, high = np.full((len(own), p.shape[1]), np.inf), np.full((len(own), p.shape[1]), -np.inf)
                np.minimum.at(low, at, p)
                np.maximum.at(high, at, p)
                side = np.tile(np.arange(p.shape[1], dtype=np.int32), len(own))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, p.shape[1])), pa.array(side), pa.array(low.ravel()), pa.array(high.ravel())], ["block", "side", "low", "high"])

    rows = line.where("ordering = 0").select(_block(n).alias("block"), "vec").mapInArrow(run, "block int, side int, low double, high double")
    found = rows.groupBy("block", "side").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    order = np.lexsort((found.column("side").to_numpy(), found.column("block").to_numpy()))
    block, low, high = (found.column(c).to_numpy()[order].reshape(-1, axes.shape[1]) for c in ("block", "low", "high"))
    return block[:, 0], low, high


def meetings(line: DataFrame, bound: DataFrame, axes: np.ndarray, d: int, n: int) -> DataFrame:
    """(block, i, id, vec, within): every query, in groups i of neighbouring keys, with each block whose box is
    within its bound. Stored."""
    boxes = line.sparkSession.sparkContext.broadcast(_boxes(line, axes, d, n))
    asked = line.where("ordering = 0 AND query").join(bound, F.col("id") == F.col("query_id"), "left")
    asked = asked.select(F.floor(F.col("asked") / QUERY_BLOCK).alias("i"), "id", "vec", F.coalesce("within", F.lit(float("inf"))).alias("within"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, low, high = boxes.value
        for whole in batches:
            for b in (whole.slice(at, 128) for at in range(0, whole.num_rows, 128)):
                x = _matrix(b.column("vec"), d)
                p, square = x @ axes, np.zeros((b.num_rows, len(block)))
                for side in range(p.shape[1]):
                    own = p[:, side, None]
                    square += np.maximum(np.maximum(low[:, side] - own, own - high[:, side]), 0) ** 2
                slack = 1e-9 * (1 + (x**2).sum(1))
                q, at = np.nonzero(square <= (b.column("within").to_numpy() ** 2 + slack)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(block[at]), *b.take(pa.array(q)).columns], ["block", *b.schema.names])

    return store(asked.mapInArrow(run, "block int, i long, id long, vec binary, within double"), "meetings")


def _met_neighbours(line: DataFrame, met: DataFrame, d: int, n: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of each query in every block that it meets, one comparison for a
    group of queries and a block, or a part of one where blocks are larger than ROW_BLOCK."""
    parts = -(-max(BOX_ROWS, -(-n // MAX_BOXES)) // ROW_BLOCK)
    pairs = met.select("i", "block").distinct()
    q = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    c = line.where("ordering = 0").select(_block(n).alias("block"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "vec").join(pairs, "block")

    def compare(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return _neighbours([])
        return _neighbours([nearest(q.column("id").to_numpy(), _matrix(q.column("vec"), d), c.column("id").to_numpy(), _matrix(c.column("vec"), d), k, q.column("within").to_numpy())])

    keys = ["i", "block", "part"]
    return fresh(q).groupBy(*keys).cogroup(fresh(c.select(*keys, "id", "vec")).groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double").distinct()
