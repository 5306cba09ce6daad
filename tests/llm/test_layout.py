"""Sharding, neighbours and the pipeline."""


import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sonaris.llm import curves, queries, sharding
from sonaris.llm.curves import hilbert_keys, nearest_neighbours
from test_near_dup import brute
from test_text import verdicts
from test_tokens import TOK, check_packing

# -- shards ----------------------------------------------------------------------------------------


def check_shards(rows, limit):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for name, own in by.items():
        size = sum(r.n_bytes for r in own)
        assert {(len(name), size, len(own), size > limit)} == {(r.depth, r.shard_bytes, r.shard_rows, r.over) for r in own}
        assert size <= limit or len(own) == 1
    names = sorted(by)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))  # no bucket lies within another
    return by


@pytest.mark.parametrize("limit", [200, 5000, 10**6])
def test_shards_fit(spark, limit):
    rng = np.random.default_rng(0)
    rows = [(i, "x" * int(n)) for i, n in enumerate(rng.integers(0, 150, 300))] + [(400, "é" * 5000), (None, "n" * 90), (None, None), (401, "")]
    rows += [(7, "same key")] * 200  # no bit of the key's hash parts these
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("depth", F.lit("clash"))
    got = sharding.extendible_shards(df.drop("depth") if limit == 200 else df, max_bytes=limit).collect()
    assert len(got) == len(rows)
    check_shards(got, limit)
    if limit == 200:
        back = sharding.write_shards(sharding.extendible_shards(df, max_bytes=limit))
        assert back.count() == len(rows)
    assert sharding.extendible_shards(df.limit(0), max_bytes=limit).count() == 0


def test_only_oversized_buckets_split(spark, sf):
    rows = queries.op5_extendible_shards(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    small = sharding.extendible_shards(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), max_bytes=20_000).collect()
    by = check_shards(small, 20_000)
    for name, own in by.items():
        if name:  # the bucket above was too large
            assert sum(r.n_bytes for r in small if r.shard.startswith(name[:-1])) > 20_000


# -- neighbours ------------------------------------------------------------------------------------


def brute_neighbours(ids, x, asked, k):
    ok = [i for i in range(len(ids)) if x[i] is not None and len(x[i]) == 8 and all(v is not None and np.isfinite(v) for v in x[i]) and any(x[i])]
    out = {}
    for i in ok:
        if asked(ids[i]):
            d = sorted((float(np.sqrt(sum((np.float64(a) - np.float64(b)) ** 2 for a, b in zip(x[i], x[j])))), ids[j]) for j in ok if ids[j] != ids[i])
            out[ids[i]] = d[:k]
    return out


@pytest.mark.parametrize("block", [50_000, 60])
def test_neighbours_with_ties_and_bad_rows(spark, monkeypatch, block):
    if block < 1000:  # several boxes, larger than what is compared at once
        for name, value in (("BOX_ROWS", block // 3), ("MAX_BOXES", 5), ("ROW_BLOCK", 25), ("QUERY_BLOCK", 5)):
            monkeypatch.setattr(curves, name, value)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8)).astype(np.float32).tolist()
    for i in range(100, 180):
        x[i] = x[10]  # a hot vector
    x[5], x[15], x[25], x[35], x[45], x[55] = None, [0.0] * 8, [float("nan")] * 8, [1.0] * 7, [None] * 8, [float("inf")] * 8
    ids = list(range(300))
    df = spark.createDataFrame(list(zip(ids, x)), "vec_id long, embedding array<float>").repartition(3).withColumn("id", F.lit("clash"))
    got = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 5 == 0, window=8).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    want = brute_neighbours(ids, x, lambda i: i % 5 == 0, 10)
    assert got.keys() == want.keys()
    for q, best in want.items():
        assert [got[q][r][1] for r in range(1, 11)] == [v for _, v in best]
        assert [got[q][r][0] for r in range(1, 11)] == pytest.approx([s for s, _ in best], abs=1e-12)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in nearest_neighbours(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1)]
    assert nearest_neighbours(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert nearest_neighbours(df, F.lit(False)).count() == 0


def test_windows_alone_where_the_data_has_few_dimensions(spark):
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((3000, 2)) @ rng.standard_normal((2, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0, exact=False, directions=2, window=64).collect()}
    x = x.astype(float)
    want = {(q, int(j)) for q in range(0, 3000, 100) for j in np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[1:11]}
    assert len(got & want) >= 0.9 * len(want)


def test_most_blocks_are_left_out_where_the_data_has_few_dimensions(spark, monkeypatch):
    monkeypatch.setattr(curves, "BOX_ROWS", 40)
    met = []
    whole = curves.meetings
    monkeypatch.setattr(curves, "meetings", lambda *a: met.append(whole(*a)) or met[-1])
    rng = np.random.default_rng(6)
    x = (rng.standard_normal((4000, 3)) @ rng.standard_normal((3, 24)) + 1e-3 * rng.standard_normal((4000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect()}
    x = x.astype(float)
    assert got == {(q, r): int(j) for q in range(0, 4000, 100) for r, j in enumerate(np.argsort(np.sqrt(((x - x[q]) ** 2).sum(1)), kind="stable")[1:11], 1)}
    assert met[0].count() * 40 < 0.15 * 40 * 4000  # rows compared, of queries times rows


def test_main_directions_are_orthonormal():
    x = np.random.default_rng(1).standard_normal((50, 6)) * [9, 1, 1, 5, 1, 1]
    axes = curves.main_directions(x, 3)
    assert axes.T @ axes == pytest.approx(np.eye(3)) and abs(axes[0, 0]) > 0.9 and abs(axes[3, 1]) > 0.9
    assert curves.main_directions(x[:1], 2).shape == (6, 2)


@pytest.mark.parametrize("d,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_keys_are_a_continuous_order(d, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
    keys = hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    line = cells[np.argsort(keys)]
    assert (np.abs(np.diff(line, axis=0)).sum(1) == 1).all()


# -- pipeline --------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, sf):
    """Each stage is held against a slow version of itself, on what the stage before kept."""
    from sonaris.llm.langid import identify_language
    from sonaris.llm.quality import MIN_DOCS, SHARE

    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs, columns = table, table.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.source, r.text) for r in docs.collect()]
        docs = stage(spark, docs, sf).cache()
        if name == "packing":
            ids = {k: [*TOK.encode(t, add_special_tokens=False).ids, 0] for k, _, t in before}
            check_packing([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in docs.collect()], ids, 2048)
            break
        assert docs.columns == columns
        kept[name] = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
        if name == "language":
            known = identify_language(table).where("lang_pred != 'und' AND score >= 0.05")
            assert kept[name].keys() == {r.doc_id for r in known.collect()} and len(kept[name]) >= 0.99 * len(before)
        elif name == "quality":
            want = {int(v[0]): v[-1] for v in verdicts(before, MIN_DOCS, SHARE) if v[-2]}
            assert {k: t for k, (t, _) in kept[name].items()} == want and all(n == len(t) for t, n in kept[name].values())
        else:
            want = [c for (_, key), _, c, keep in brute([(k, t) for k, _, t in before], 5) if keep]
            assert kept[name].keys() == set(want)
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.drop("sequence_id", "offset").collect())) == sorted(map(tuple, docs.drop("sequence_id", "offset").collect()))


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Repeated rows, null ids, empty texts, another column; and no rows at all."""
    words = [f"word{i}" for i in range(400)]
    text = lambda i: " ".join(words[i : i + 80])
    rows = [(i, text(i * 90), "en", "a", 1) for i in range(3)] + [(1, text(90), "en", "a", 1), (None, text(300), "en", None, None), (8, None, "en", "a", 0), (9, "", None, "a", 0), (10, text(0), "en", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").withColumn("key", F.lit("clash"))
    for name, frame in (("rows", df), ("none", df.limit(0))):
        frame.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r.doc_id for r in out} == ({0, 1, 2, None} if name == "rows" else set())
        assert all(r.offset + r.length <= 2048 for r in out)
