"""BPE, token shards and packing, against the tokenizers library and brute force."""

import hashlib
import itertools
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sonaris.llm import bpe, packing, queries, token_store
from sonaris.llm.packing import best_fit_decreasing, plan_rows, reduce_instance

PATH = bpe.default_tokenizer()
TOK = Tokenizer.from_file(PATH)
CODEC = bpe.Codec(PATH)
EDGE = ["", " ", "\n\t \r", "don't we'll I'M '''s 's't", "a1b22 333", "Á á ́", "ΑΣ ΑΣ. σΑΣb", "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|> İI ı", "émigré naïve ﬁ Å", "\x1c\x85\xa0  a", "🙂🙂 漢字 עברית", "a" * 5000, "!!!???...,,", "\x00a\x00", "x\x0by\x0cz", "&&& *** ###", "ﷺ 1½²³"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def same_as_library(texts):
    ids, counts = CODEC.encode(pa.array(texts, pa.string()))
    got = np.split(ids, np.cumsum(counts)[:-1])
    for text, mine in zip(texts, got):
        assert mine.tolist() == TOK.encode(text or "", add_special_tokens=False).ids, text
    decoded = CODEC.decode(ids, counts).to_pylist()
    assert decoded == [TOK.decode(x.tolist(), skip_special_tokens=False) for x in got]


def test_edge_texts():
    same_as_library([*EDGE, None, *EDGE])


@given(st.lists(st.text(max_size=60), min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_any_text(texts):
    same_as_library([t.encode("utf-8", "ignore").decode() for t in texts])


@given(st.lists(st.text("aAbZ sS'tT1 2.,!<|>endoftx\ńé", max_size=80), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_awkward_letters(texts):
    same_as_library(texts)


def test_frames_of_odd_texts(spark):
    rows = [*enumerate(EDGE), (100, None), (None, "no key"), (0, EDGE[3]), (0, EDGE[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("ids", F.lit("clash")).withColumn("key", F.lit(1))
    coded = bpe.bpe_encode(df, decode=True)
    got = sorted(map(str, coded.select("doc_id", "n_tokens", bpe.id_array().alias("ids"), "decoded").collect()))
    want = [(k, TOK.encode(t or "", add_special_tokens=False).ids) for k, t in rows]
    assert got == sorted(str(Row(doc_id=k, n_tokens=len(x), ids=x, decoded=TOK.decode(x, skip_special_tokens=False))) for k, x in want)
    back = bpe.bpe_decode(coded.select("doc_id", "ids").union(spark.sql("SELECT 7L, CAST(NULL AS BINARY)")))
    assert sorted(map(str, back.collect())) == sorted(str(Row(doc_id=k, decoded=TOK.decode(x, skip_special_tokens=False))) for k, x in [*want, (7, [])])
    assert bpe.bpe_encode(df.limit(0)).count() == 0 and bpe.bpe_decode(coded.limit(0)).count() == 0


def test_forced_pairs_are_in_no_token():
    free = bpe.forced_pairs({"ab</w>": 0, "bc": 1})
    assert not free[97, 98] and not free[98, 99] and free[98, 97] and free[99, 97]


def test_queries_of_documents(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {k: TOK.encode(t, add_special_tokens=False).ids for k, t in docs.items()}
    raw = lambda x: np.array(x, "<u4").tobytes()
    for r in queries.op8_bpe_roundtrip(spark, sf).collect():
        own = ids[r.doc_id]
        assert r.n_tokens == len(own) and r.ids_sha256 == hashlib.sha256(raw(own)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(TOK.decode(own, skip_special_tokens=False).encode()).hexdigest()
    at = 0
    rows = {r.doc_id: r for r in queries.op3_token_index(spark, sf).collect()}
    assert rows.keys() == docs.keys()
    for k in sorted(docs):
        r = rows[k]
        assert (r.start, r.n_tokens, r.ids_crc32, r.indexed) == (at, len(ids[k]) + 1, zlib.crc32(raw([*ids[k], 1])), True)
        at += r.n_tokens
    check_packing([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in queries.op7_pack(spark, sf).collect()], {k: [*x, 0] for k, x in ids.items()}, 2048)


def check_packing(rows, ids, capacity):
    """Every id once, pieces cut only where needed, sequences gapless; near the lower bound."""
    by_doc, by_seq = {}, {}
    for doc, piece, start, length, crc, seq, offset in rows:
        by_doc.setdefault(doc, []).append((piece, start, length, crc))
        by_seq.setdefault(seq, []).append((offset, length))
    assert by_doc.keys() == ids.keys()
    for doc, own in by_doc.items():
        at = 0
        for i, (piece, start, length, crc) in enumerate(sorted(own)):
            assert (piece, start) == (i, at) and crc == zlib.crc32(np.array(ids[doc][start : start + length], "<u4").tobytes())
            assert length == min(capacity, len(ids[doc]) - start)
            at += length
        assert at == len(ids[doc])
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(map(len, ids.values())) // capacity)
    assert len(by_seq) <= least * 1.05 + 2


def test_shards_of_odd_tables(spark, tmp_path):
    rows = [(5, "b"), (5, "a"), (None, "n"), (-3, None), (7, ""), (1 << 62, "x y z"), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("start", F.lit("x"))
    manifest = token_store.write_token_shards(df, str(tmp_path / "s"), shards=3)
    got = token_store.read_token_shards(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -3, 5, 5, 7, 7, 1 << 62]
    assert {r.doc_id for r in got if r.indexed} == {-3, 5, 7, 1 << 62}
    found = {r.doc_id: r for r in token_store.lookup(manifest, [5, -3, 1 << 62, 99, 5, -(1 << 62)]).collect()}
    assert found.keys() == {5, -3, 1 << 62}
    for k, r in found.items():
        first = next(x for x in got if x.doc_id == k)
        assert (r.shard, r.start, r.n_tokens, r.ids) == (first.shard, first.start, first.n_tokens, first.ids)
    assert sorted(p.name.split(".")[1] for p in (tmp_path / "s").iterdir()) == ["ids"] * manifest.count() + ["idx"] * manifest.count()
    assert token_store.lookup(manifest, df.where("doc_id IS NULL")).count() == 0
    none = token_store.write_token_shards(df.limit(0), str(tmp_path / "e"), shards=3)
    assert none.count() == 0 and token_store.read_token_shards(none).count() == 0 and token_store.lookup(none, [1]).count() == 0


def test_keys_of_a_store_of_many_shards(spark, tmp_path):
    rows = [(3 * i - 300, f"text number {i}") for i in range(200)] + [(12, "the same")] * 150 + [(None, "no key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifest = token_store.write_token_shards(df, str(tmp_path), shards=7)
    ranges = [(r.first_key, r.last_key) for r in manifest.orderBy("shard").collect()]
    assert len(ranges) > 4 and all(a[1] <= b[0] for a, b in itertools.pairwise(ranges))
    assert sum(a <= 12 <= b for a, b in ranges) > 1  # one key holds several shards
    whole = token_store.read_token_shards(manifest).orderBy("start").collect()
    assert len(whole) == len(rows) and sum(r.indexed for r in whole if r.doc_id == 12) >= 1
    first = {}
    for r in whole:
        first.setdefault(r.doc_id, r)
    got = {r.doc_id: r for r in token_store.lookup(manifest, spark.range(-400, 400).withColumnRenamed("id", "doc_id")).collect()}
    assert got.keys() == {k for k, _ in rows if k is not None}
    assert all((r.shard, r.start, r.ids) == (first[k].shard, first[k].start, first[k].ids) for k, r in got.items())
    text = dict(rows)
    assert all(np.frombuffer(r.ids, "<u4").tolist() == [*TOK.encode(text[k], add_special_tokens=False).ids, 1] for k, r in got.items() if k != 12)


def test_shards_by_bytes(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    least = token_store.shuffle_partitions(spark)
    assert token_store.shard_count(docs) == least
    monkeypatch.setattr(token_store, "SHARD_BYTES", 20_000)
    assert token_store.shard_count(docs) > least
    assert token_store.shard_count(spark.createDataFrame(docs.rdd, docs.schema)) > least  # no size is known: texts are measured
    monkeypatch.setattr(token_store, "MAX_SHARDS", 9)
    assert token_store.shard_count(docs) == 9


@given(st.sets(st.integers(-(1 << 63), (1 << 63) - 1), max_size=300))
@settings(max_examples=60, deadline=None)
def test_perfect_hash(keys):
    own = np.array(sorted(keys), np.int64)
    index = token_store.ShardIndex(token_store.index_bytes(own, np.zeros(len(own), bool), np.arange(1, len(own) + 1)))
    assert index.documents()[0]["key"].tolist() == own.tolist() and index.documents()[1].all()
    found, offset, length = index.find(own)
    assert found.all() and length.tolist() == list(range(1, len(own) + 1)) and offset.tolist() == (np.cumsum(length) - length).tolist()
    assert sorted(index.mph.slots(own.view(np.uint64)).tolist()) == list(range(len(own)))
    if len(own):
        others = np.setdiff1d(np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 200), own)
        assert index.find(others)[0].sum() <= 1


def optimal(sizes, capacity):
    """Fewest bins by exhaustive search."""
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity:
                place(i + 1, bins[:j] + [bins[j] + sizes[i]] + bins[j + 1 :])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best[0]


def histogram(sizes, capacity):
    return np.bincount(sizes, minlength=capacity + 1)


@given(st.lists(st.integers(1, 20), max_size=8))
@settings(max_examples=300, deadline=None)
def test_reduction_keeps_the_optimum(sizes):
    counts = histogram(sizes, 20) if sizes else np.zeros(21, np.int64)
    fixed = reduce_instance(counts, 20)
    rest = [s for s in range(21) for _ in range(counts[s])]
    assert sorted(rest + [s for p, t in fixed for s, n in p for _ in range(n * t)]) == sorted(sizes)
    assert all(sum(s * n for s, n in p) <= 20 for p, _ in fixed)
    assert sum(t for _, t in fixed) + optimal(rest, 20) == optimal(sizes, 20)


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=200, deadline=None)
def test_best_fit_on_counts_is_best_fit(sizes):
    runs = best_fit_decreasing(histogram(sizes, 50) if sizes else np.zeros(51, np.int64), 50)
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in bins if sum(b) + s <= 50]
        if fits:
            max(fits, key=sum).append(s)
        else:
            bins.append([s])
    assert sum(t for _, t in runs) == len(bins)
    assert sorted(sum(s * n for s, n in p) for p, t in runs for _ in range(t)) == sorted(map(sum, bins))


@given(st.lists(st.integers(1, 30), max_size=60))
@settings(max_examples=100, deadline=None)
def test_plans_cover_every_rank_once(sizes):
    counts = histogram(sizes, 30) if sizes else np.zeros(31, np.int64)
    seen, bins = [], {}
    for length, lo, hi, seq, each, at in plan_rows(counts, 30):
        for r in range(lo, hi):
            seen.append((length, r))
            bins.setdefault(seq + (r - lo) // each, []).append((at + (r - lo) % each * length, length))
    assert sorted(seen) == [(s, r) for s in range(31) for r in range(counts[s])]
    for own in bins.values():
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(sorted(own))) and min(own)[0] == 0 and sum(n for _, n in own) <= 30


@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 10**6)), max_size=12))
@settings(max_examples=100, deadline=None)
def test_bulk_reduction_keeps_every_item(lengths):
    counts = np.zeros(31, np.int64)
    for length, n in lengths:
        counts[length] += n
    rows = plan_rows(counts, 30)
    got = np.zeros(31, np.int64)
    for length, lo, hi, *_ in sorted(rows):
        assert lo == got[length]
        got[length] = hi
    assert (got == counts).all()
    if rows:
        plan = packing._Plan(rows, 30)
        lo, hi = np.array([(r[0], r[1]) for r in rows]).T, np.array([(r[0], r[2] - 1) for r in rows]).T
        assert plan.place(*lo)[0].tolist() == [r[3] for r in rows] and plan.place(*lo)[1].tolist() == [r[5] for r in rows]
        assert plan.place(*hi)[0].tolist() == [r[3] + (r[2] - r[1] - 1) // r[4] for r in rows]


@pytest.mark.parametrize("first,kinds", [(1100, 100), (300, 1400), (1, 2048), (650, 200)])
def test_plans_grow_with_the_lengths_not_with_the_items(first, kinds):
    sizes = []
    for n in (1000, 10**7, 10**10):
        counts = np.zeros(2049, np.int64)
        counts[first : first + kinds] = n + np.arange(kinds) % 7
        began = time.perf_counter()
        sizes.append(len(plan_rows(counts)))
        assert time.perf_counter() - began < 5
    assert max(sizes) <= 2 * min(sizes) + 100 and max(sizes) < 20 * 2048


def test_many_items_of_few_lengths(spark):
    df = spark.range(30_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 1100 WHEN id % 3 = 1 THEN 1101 ELSE id % 5 + 300 END AS length")
    got = packing.best_fit_pack(df, order=["id"]).toPandas()
    assert len(got) == 30_000 and got.id.is_unique
    by = got.sort_values(["sequence_id", "offset"])
    ends = by.offset + by.length
    assert (ends <= 2048).all() and (by.offset == ends.groupby(by.sequence_id).shift(fill_value=0)).all()
    assert by.sequence_id.nunique() == 20_000  # no two of the long ones fit together, all others join them


def test_packing_of_odd_tables(spark):
    random.seed(4)
    texts = [None, "", "", "same text", "same text", *(" ".join(random.choices("abcdefgh", k=random.choice([3, 40, 2047, 2048, 5000]))) for _ in range(30))]
    df = frame(spark, texts).withColumn("length", F.lit("clash")).withColumn("piece", F.lit(7))
    df = df.union(df.where("doc_id = 3"))
    rows = packing.pack_documents(df)
    assert rows.where("doc_id = 3").count() == 2
    once = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in rows.collect()]
    twice = [r for r in once if r[0] == 3][1]
    ids = {i: [*TOK.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    check_packing([(99, *r[1:]) if r is twice else r for r in once], ids | {99: ids[3]}, 2048)
    assert packing.pack_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.best_fit_pack(spark.createDataFrame([(1, 0)], "id long, length long"), order=["id"])
