"""Near-duplicate classes by HyperMinHash.

1. *Sketch.*  Each document's distinct word shingles are hashed to 64 bits.  The top bits choose one
   of 128 buckets; of a bucket's smallest hash only the number of leading zeros and ten mantissa bits
   are stored: a register of 16 bits.  Empty buckets borrow a register in an order fixed per bucket.
   Documents with equal shingle sets become one *class* here, whatever their number.
2. *Bands.*  Four registers side by side are one 64-bit band key, 32 in all: classes of Jaccard
   similarity 0.8 share none with probability (1 - 0.8**4)**32 < 1e-7.
3. *Hubs.*  Within a bucket of equal band keys not all pairs are made: each member is paired with the
   bucket's hub, the class whose band keys are shared most often over all bands (ties: smallest id).
   A register comparison, corrected for accidental collisions, drops pairs that are six standard
   deviations away; all others are compared on full shingle sets.
4. *Rest.*  Members of a hub's buckets that are not yet in the hub's component may still be linked
   with other members, so these are compared with all of them: small groups in one step, large ones
   in blocks of bounded size, where only links that join different components are kept.
5. *Components.*  Links are closed by alternating large-star and small-star steps on DataFrames, and
   every document gets the smallest doc_id of its component.

Nothing that grows with the input is collected or broadcast, no bucket has a cap, and lineage is cut
by tables in the shared folder.  A hub's members are dealt over several tasks, to which what they meet is
copied; joins by bucket, hub or node before that are of two stored tables each, so that adaptive execution
(spark.sql.adaptive.skewJoin) splits the partition of a hot one.

Edge cases: null and empty texts and texts without words have no shingle, stay alone and are kept;
fewer than ``k`` words count as one shingle; repeated rows belong to one class, and rows of equal
doc_id are all kept if that id is the component's; a null doc_id never names a component unless its
component has no other (then component_id is null and it is kept); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaris.llm.bpe import slices
from sonaris.llm.common import discard, fresh, shuffle_partitions, store
from sonaris.llm.words import CHUNK_BYTES, PLACES, U64, Words, mix

REGISTERS, MANTISSA, ROWS = 128, 10, 4
BANDS = REGISTERS // ROWS
BUCKET_BITS = 7
#: Standard deviations of the estimate below the threshold at which a pair is dropped unverified.
SIGMAS = 6.0
#: Groups of a hub up to this size are compared in one step; larger ones in blocks of BLOCK members.
SMALL_GROUP, BLOCK = 64, 500
#: Pairs with one hub that are verified by one task at most.
HUB_PAIRS = 512
#: HyperMinHash's constant for accidental collisions of registers (a fixed value of the paper).
COLLISION = 0.169919487159739093975315012348

_BOUNDS = np.arange(REGISTERS, dtype=U64) << U64(64 - BUCKET_BITS)
_ORDERS = np.array([np.random.default_rng(i).permutation(REGISTERS) for i in range(REGISTERS)])


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    w = Words(texts)
    words = w.hashes(lower=True)
    keys, at = w.windows(words, k)
    upto = np.searchsorted(at, w.first)
    for i in range(w.n):
        n = int(w.count[i])
        if n >= k:
            yield np.unique(keys[upto[i] : upto[i + 1]])
        elif n:
            own = words[w.first[i] : w.first[i] + n]
            yield mix(np.array([np.sum(own * PLACES[:n]) + U64(n)], U64))
        else:
            yield np.zeros(0, U64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The 128 registers of a sorted set that isn't empty."""
    at = np.searchsorted(shingles, _BOUNDS)
    least = shingles[np.minimum(at, len(shingles) - 1)]
    full = (at < len(shingles)) & ((least >> U64(64 - BUCKET_BITS)) == np.arange(REGISTERS, dtype=U64))
    rest = least & U64((1 << (64 - BUCKET_BITS)) - 1)
    part, power = np.frexp(rest.astype(np.float64))
    zeros = np.minimum(64 - BUCKET_BITS - power, 63)
    out = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | ((part - 0.5) * 2 * (1 << MANTISSA)).clip(0, (1 << MANTISSA) - 1).astype(np.uint16)
    if not full.all():
        empty = np.flatnonzero(~full)
        out[empty] = out[_ORDERS[empty, full[_ORDERS[empty]].argmax(1)]]
    return out


def estimates(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, less the accidental collisions expected for sizes n and m."""
    ratio = np.minimum(n, m) / np.maximum(np.maximum(n, m), 1)
    accidents = COLLISION * REGISTERS / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return ((a == b).sum(-1) - accidents) / (REGISTERS - accidents)


def floor_of(threshold: float, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Estimates below this aren't verified; small sets have so few registers that none is."""
    return threshold - SIGMAS * np.sqrt(threshold * (1 - threshold) / np.minimum(REGISTERS, np.minimum(n, m)))


def _linked(inter: int, n: int, m: int, threshold: int) -> bool:
    return 100 * inter >= threshold * (n + m - inter)


def _sketches(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, n_shingles, class binary(16), registers binary): class and registers null if empty."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", CHUNK_BYTES):
                sizes, names, regs = [], [], []
                for s in shingle_sets(b.column("text"), k):
                    sizes.append(len(s))
                    names.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                    regs.append(sketch(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(regs, pa.binary())], ["key", "n_shingles", "class", "registers"])

    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, n_shingles long, class binary, registers binary")


def _band_rows(classes: DataFrame) -> DataFrame:
    """(class, band, code) of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = np.frombuffer(b"".join(b.column("registers").to_pylist()), "<i8")
                at = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([b.column("class").take(at), pa.array(np.tile(np.arange(BANDS, dtype=np.int8), b.num_rows)), pa.array(codes)], ["class", "band", "code"])

    return classes.select("class", "registers").mapInArrow(run, "class binary, band byte, code long")


def _hub_pairs(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((class, hub, part): each member of a bucket with the bucket's hub, (hub, size, parts)), both stored. A hub's
    members are dealt over parts of about HUB_PAIRS; what is joined to them by hub is copied to each part.

    Whatever is joined to all members of a bucket or hub is stored before: the join then has two plain shuffles,
    of which adaptive execution splits the large partitions, also those of one key."""
    rows = _band_rows(classes)
    shared = store(rows.groupBy("band", "code").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shared-bands")
    held = store(rows.join(shared, ["band", "code"]), "band-members")
    scores = held.groupBy("class").agg(F.sum("members").alias("score"))
    scored = held.join(scores, "class")
    # the greatest score, then the smallest class: one value that max() can take with partial sums
    hubs = scored.groupBy("band", "code").agg(F.max(F.struct("score", F.expr("decode(translate(hex(class), '0123456789ABCDEF', 'FEDCBA9876543210'), 'UTF-8')").alias("rank"), F.col("class").alias("hub"))).alias("best"))
    hubs = store(hubs.select("band", "code", F.col("best.hub").alias("hub")), "hubs")
    pairs = store(held.join(hubs, ["band", "code"]).where("class != hub").select("class", "hub").distinct(), "hub-members")
    discard(shared, held, hubs)
    return _dealt(pairs)


def _dealt(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored pairs (class, hub), discarded here, with part, and (hub, size, parts)."""
    sizes = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("size"))
    sizes = store(sizes.withColumn("parts", F.ceil(F.col("size") / HUB_PAIRS).cast("int")), "hub-sizes")
    part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part")
    dealt = store(pairs.join(sizes, "hub").select("class", "hub", part), "hub-pairs")
    discard(pairs)
    return dealt, sizes


def _to_parts(hubs: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row of hubs for each part of the hub."""
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    return hubs.join(sizes.select("hub", "parts"), "hub").select(*hubs.columns, parts)


def _pruned(pairs: DataFrame, sizes: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (class, hub, part) whose registers don't rule out the threshold."""
    own = classes.select("class", F.col("n_shingles").alias("n"), F.col("registers").alias("r"))
    other = _to_parts(classes.select(F.col("class").alias("hub"), F.col("n_shingles").alias("m"), F.col("registers").alias("q")), sizes)
    both = pairs.join(own, "class").join(other, ["hub", "part"]).select("class", "hub", "part", "n", "m", "r", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n, m = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "m"))
                r, q = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("r", "q"))
                ok = (estimates(r, q, n, m) >= floor_of(threshold / 100, n, m)) & (100 * np.minimum(n, m) >= threshold * np.maximum(n, m))
                yield b.select(["class", "hub", "part"]).filter(pa.array(ok))

    return both.mapInArrow(run, "class binary, hub binary, part int")


def _sets(df: DataFrame, wanted: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(class, shingles binary) of the wanted (key, class), made again from the texts, stored."""
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.join(wanted.select(F.col("key").alias("wanted")), F.col("key").eqNullSafe(F.col("wanted")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", CHUNK_BYTES):
                sets = [s.tobytes() for s in shingle_sets(b.column("text"), k)]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(s).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["class", "shingles"])

    made = rows.select("text").mapInArrow(run, "class binary, shingles binary").join(wanted.select("class"), "class", "left_semi")
    return store(made.dropDuplicates(["class"]), "shingle-sets")


def _verified(pairs: DataFrame, sizes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (class, hub) of (class, hub, part) that are linked on their full sets. A hub's set goes once to
    each part that its pairs are dealt over."""
    hubs = _to_parts(sets.select(F.col("class").alias("hub"), F.col("shingles").alias("others")), sizes)
    both = pairs.join(sets, "class").join(hubs, ["hub", "part"]).select("class", "hub", "shingles", "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("shingles"), b.column("others")):
                a, c = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                ok.append(_linked(_common(a, c), len(a), len(c), threshold))
            yield b.select(["class", "hub"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "class binary, hub binary")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of links (a, b) but the smallest of each component: that smallest one. By
    alternating large-star and small-star steps until every node has one neighbour, which has none itself. What a
    step joins to the edges of a node is stored before, so that adaptive execution may split those of one node."""
    edges = store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    for _ in range(rounds):
        low = store(edges.groupBy("a").agg(F.min("b").alias("low")), "least")
        above = low.select(F.col("a").alias("b"), "low")
        if low.count() == edges.count() and edges.join(above, "b", "left_semi").isEmpty():
            discard(low)
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        # large star: a node's greater neighbours move to its least one
        large = store(edges.join(above, "b", "left").select("a", F.coalesce("low", "b").alias("b")).distinct(), "large-star")
        discard(low, edges)
        # small star: so do its smaller ones, and the node itself
        low = store(large.groupBy("a").agg(F.min("b").alias("low")), "least")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b")
        edges = store(small.union(low.select("a", F.col("low").alias("b"))).distinct(), "links")
        discard(low, large)
    raise RuntimeError("components did not settle")


def _labels(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(class, component) of every class that has a link or not."""
    found = components(links.select(F.col("class").alias("a"), F.col("hub").alias("b")))
    return classes.select("class").join(found.withColumnRenamed("node", "class"), "class", "left").select("class", F.coalesce("component", "class").alias("component"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after further links: the components that they join become one."""
    own = lambda name: labels.select(F.col("class").alias(name), F.col("component").alias(f"{name}_component"))
    between = links.join(own("class"), "class").join(own("hub"), "hub").select(F.col("class_component").alias("a"), F.col("hub_component").alias("b"))
    found = components(between).select(F.col("node").alias("component"), F.col("component").alias("into"))
    return labels.join(found, "component", "left").select("class", F.coalesce("into", "component").alias("component"))


def _rest(pairs: DataFrame, sizes: DataFrame, labels: DataFrame, classes: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Of the hub groups with members outside the hub's component: (pairs of small groups to verify,
    members of large groups with their blocks)."""
    home = labels.select(F.col("class").alias("hub"), F.col("component").alias("home"))
    apart = F.col("component") != F.col("home")
    members = pairs.join(labels, "class")
    opened = members.join(_to_parts(home, sizes), ["hub", "part"]).where(apart).groupBy("hub").agg(F.count(F.lit(1)).alias("n_open"))
    groups = store(opened.join(sizes.where("size > 1").select("hub", "size"), "hub").join(home, "hub"), "open-hubs")
    own = classes.select("class", F.col("n_shingles").alias("n"), F.col("registers").alias("r"))
    members = pairs.join(_to_parts(groups, sizes), ["hub", "part"]).join(labels, "class").join(own, "class")
    members = store(members.select("hub", "class", "component", apart.cast("long").alias("open"), "n", "r", "size", "n_open"), "open-groups")
    small = members.where(F.col("size") <= SMALL_GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if not t.num_rows:
                continue
            hub = t.column("hub").combine_chunks().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(hub[1:] != hub[:-1]) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            rest = t.slice(last)
            if last:
                yield from pairs_of(t.slice(0, last), np.append([0], cuts))
        if rest is not None and rest.num_rows:
            yield from pairs_of(rest, np.array([0, rest.num_rows]))

    def pairs_of(t: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        name, comp, n = (t.column(c).combine_chunks() for c in ("class", "component", "n"))
        comp, n = comp.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False)
        free = t.column("open").combine_chunks().to_numpy(zero_copy_only=False) > 0
        regs = np.frombuffer(b"".join(t.column("r").combine_chunks().to_pylist()), "<u2").reshape(-1, REGISTERS)
        left, right = [], []
        for a, b in zip(cuts, cuts[1:]):
            i, j = np.triu_indices(b - a, 1)
            i, j = i + a, j + a
            keep = (free[i] | free[j]) & (comp[i] != comp[j])
            i, j = i[keep], j[keep]
            ok = estimates(regs[i], regs[j], n[i], n[j]) >= floor_of(threshold / 100, n[i], n[j])
            left.append(i[ok]), right.append(j[ok])
        yield pa.RecordBatch.from_arrays([name.take(pa.array(np.concatenate(left))), name.take(pa.array(np.concatenate(right)))], ["class", "hub"])

    found = small.repartition(shuffle_partitions(small.sparkSession), "hub").sortWithinPartitions("hub").mapInArrow(run, "class binary, hub binary")
    return store(found.distinct(), "rest-pairs"), members.where(F.col("size") > SMALL_GROUP)


def _block_links(large: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links of open members of large groups with members of other components, block by block, one for
    each member and component."""
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int")
    at = lambda n: F.pmod(F.xxhash64("class", "hub"), n).cast("int")
    rows = large.withColumn("rows", blocks("n_open")).withColumn("cols", blocks("size")).join(sets, "class")
    mine = rows.where("open > 0").withColumn("i", at(F.col("rows"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    theirs = rows.withColumn("j", at(F.col("cols"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    keep = ["hub", "i", "j", "class", "component", "n", "r", "shingles"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[bytes, bytes]] = []
        if a.num_rows and b.num_rows:
            (ka, ca, na, ra, sa), (kb, cb, nb, rb, sb) = (_columns(t) for t in (a, b))
            for x in range(len(ka)):
                est = estimates(ra[x], rb, np.full(len(nb), na[x]), nb)
                may = np.flatnonzero((est >= floor_of(threshold / 100, np.full(len(nb), na[x]), nb)) & (cb != ca[x]))
                joined: set[bytes] = set()
                for y in may[np.argsort(-est[may])]:
                    if cb[y] not in joined and _linked(_common(sa[x], sb[y]), len(sa[x]), len(sb[y]), threshold):
                        joined.add(cb[y])
                        out.append((ka[x], kb[y]))
        return pa.table({"class": pa.array([p[0] for p in out], pa.binary()), "hub": pa.array([p[1] for p in out], pa.binary())})

    return fresh(mine.select(*keep)).groupBy("hub", "i", "j").cogroup(fresh(theirs.select(*keep)).groupBy("hub", "i", "j")).applyInArrow(run, "class binary, hub binary")


def _columns(t: pa.Table) -> tuple:
    regs = np.frombuffer(b"".join(t.column("r").to_pylist()), "<u2").reshape(-1, REGISTERS)
    sets = [np.frombuffer(s, U64) for s in t.column("shingles").to_pylist()]
    return t.column("class").to_pylist(), np.array(t.column("component").to_pylist(), object), np.array(t.column("n").to_pylist()), regs, sets


def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 5, threshold: int = 80) -> DataFrame:
    """(key, n_shingles long, component_id, kept boolean) of every row: rows are linked when their
    sets of k-word shingles have a Jaccard similarity of threshold per cent or more."""
    docs = store(_sketches(df, key, text, k), "sketches")
    classes = store(docs.where("class is not null").groupBy("class").agg(
        F.min("key").alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")), "classes")
    pairs, sizes = _hub_pairs(classes)
    near = store(_pruned(pairs, sizes, classes, threshold), "near-pairs")
    first_open = near.select("class").union(near.select("hub")).distinct()
    sets = _sets(df, classes.join(first_open, "class", "left_semi"), key, text, k)
    links = store(_verified(near, sizes, sets, threshold), "true-pairs")
    labels = store(_labels(classes, links), "labels")
    more, large = _rest(pairs, sizes, labels, classes, threshold)
    more, more_sizes = _dealt(store(more.join(near, ["class", "hub"], "left_anti"), "new-pairs"))
    large_classes = large.select("class").distinct()
    new = more.select("class").union(more.select("hub")).union(large_classes).distinct().join(sets, "class", "left_anti")
    more_sets = _sets(df, classes.join(new, "class", "left_semi"), key, text, k)
    known = sets.union(more_sets)
    small_links = store(_verified(more, more_sizes, known, threshold), "small-links")
    large_links = store(_block_links(large, known, threshold), "large-links")
    found = small_links.union(large_links)
    if not found.isEmpty():
        labels = store(_joined(labels, found), "labels")
    named = store(labels.join(classes.select("class", "key"), "class").groupBy("component").agg(F.min("key").alias("component_id")), "names")
    discard(classes, pairs, sizes, near, sets, links, more, more_sizes, more_sets, small_links, large_links)
    named = labels.join(named, "component").select("class", "component_id")
    out = docs.join(named, "class", "left").withColumn("component_id", F.when(F.col("class").isNull(), F.col("key")).otherwise(F.col("component_id")))
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
