"""Options of the operators whose registered queries cover whole tables."""

import numpy as np
import pytest

from sonaris.operators import events, pooling, search, tokens


@pytest.mark.parametrize("limit", [1000, 3])
def test_rows_of_another_class(spark, limit):
    x = np.random.default_rng(3).standard_normal((40, 5))
    kinds = [None if i == 7 else i % 3 for i in range(40)]
    df = spark.createDataFrame([(i, [float(v) for v in r], k) for i, (r, k) in enumerate(zip(x, kinds))], "id long, vec array<double>, kind int").repartition(4)
    got = search.similarity_topk(df, df, k=4, query_id="id", corpus_id="id", apart="kind", max_broadcast=limit).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = (u @ u.T).round(12)
    want = {(i, r): j for i in range(40) if i != 7 for r, j in enumerate(sorted((j for j in range(40) if j != 7 and kinds[j] != kinds[i]), key=lambda j: (-sims[i, j], j))[:4], 1)}
    assert {(r.query_id, r["rank"]): r.corpus_id for r in got} == want


def test_truncation_is_an_option(spark):
    df = spark.createDataFrame([(0, "aéb" * 40, list(range(50))), (1, "c", [7])], "id int, text string, tokens array<int>")
    assert [len(r.t) for r in tokens.char_tokens(df, out="t").orderBy("id").collect()] == [80, 1]
    assert [r.t for r in tokens.char_tokens(df, max_len=3, out="t").orderBy("id").collect()] == [[97, 98, 97], [99]]
    assert [len(r.padded) for r in pooling.pad_and_mask(df).collect()] == [50, 50]
    assert [r.padded for r in pooling.pad_and_mask(df, max_len=2).orderBy("id").collect()] == [[0, 1], [7, pooling.PAD]]


def test_files_are_merged_by_themselves(spark):
    rows = [("a", o, o, 0, c) for o in range(2) for c in range(9)] + [("b", 0, 0, 0, 3), ("b", 1, 0, 0, 3), ("b", 1, 0, 1, None), (None, 0, 0, 0, 5)]
    df = spark.createDataFrame(rows, "file_id string, ordinal int, track int, seq int, channel int")
    got = events.merge_scores(df, group=["file_id"]).collect()
    assert len(got) == len(rows)
    assert sorted(r.channel for r in got if r.file_id == "a" and r.ordinal == 0) == list(range(9))
    assert sorted(r.channel for r in got if r.file_id == "a" and r.ordinal == 1) == [6, 7, 8, 10, 11, 12, 13, 14, 15]  # six are free, the rest stay
    assert {(r.ordinal, r.seq, r.track, r.channel) for r in got if r.file_id == "b"} == {(0, 0, 0, 3), (1, 0, 1, 0), (1, 1, 1, None)}
    assert [r.channel for r in got if r.file_id is None] == [5]
    assert sorted(r.channel for r in events.merge_scores(df.where("file_id = 'b' AND channel = 3")).collect()) == [0, 3]


def test_heatmap_of_all_pairs_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "MAX_BROADCAST", 7)
    x = np.random.default_rng(5).standard_normal((23, 3))
    x[4] = x[5] = x[6]
    x[9] = 0
    df = spark.createDataFrame([(str(i), [float(v) for v in r]) for i, r in enumerate(x)], "name string, vec array<double>").repartition(3)
    got = {(int(r.a), int(r.b)): (r.sim, r.shown) for r in search.similarity_heatmap(df, key="name", vector="vec").collect()}
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    sims = u @ u.T
    bent = np.sign(sims.round(12)) * np.abs(sims.round(12)) ** 0.55
    lo, hi = np.quantile(bent, [0.02, 0.98])
    assert len(got) == 23 * 23
    assert all(got[i, j] == pytest.approx((sims[i, j], min(max(bent[i, j], lo), hi)), abs=1e-9) for i, j in got)
    assert search.similarity_heatmap(df.limit(0), key="name", vector="vec").count() == 0
