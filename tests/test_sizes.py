"""Incomplete groups, and steps whose memory doesn't follow the input."""

import numpy as np
import pytest

from sonaris.operators import balance, search
from sonaris.sources import midi


def test_what_has_no_pair_in_its_batch_is_not_counted(spark):
    # batch 0: rows 0 and 1, columns 9 and 0, of which 0 alone has a pair; batch 1: none has
    df = spark.createDataFrame([(0, 0, 9, 1.0), (0, 0, 0, 2.0), (0, 1, 9, 1.0), (0, 1, 0, 3.0), (1, 0, 9, 1.0)], "b int, i int, j int, sim double")
    rows = balance.contrastive_metrics(df, batch=["b"]).collect()
    assert [r.b for r in rows] == [0]
    # row 0 finds its column first, column 0 its row second; column 0 is predicted twice
    assert (rows[0].recall_at_1, rows[0].recall_at_top, rows[0].mrr, rows[0].f1) == pytest.approx((0.5, 1.0, 0.75, 1 / 3))


@pytest.mark.parametrize("n", [40, 90])
def test_tiles_find_what_brute_force_finds(monkeypatch, n):
    monkeypatch.setattr(search, "TILE", (4, 16))
    rng = np.random.default_rng(n)
    q, c = rng.integers(-2, 3, (11, 3)).astype(float), rng.integers(-2, 3, (n, 3)).astype(float)  # many ties
    ids, kinds, own = rng.permutation(n), rng.integers(0, 3, n), rng.integers(0, 3, 11)
    found = search._best(np.arange(11), q, ids, c, 20, True, own, kinds)
    want = [(i, ids[j], q[i] @ c[j]) for i in range(11) for j in sorted(range(n), key=lambda j: (-(q[i] @ c[j]), ids[j])) if ids[j] != i and kinds[j] != own[i]]
    want = [x for i in range(11) for x in [w for w in want if w[0] == i][:20]]
    assert list(zip(*found)) == want


def test_no_array_of_similarities_is_wider_than_a_tile(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 300)
    monkeypatch.setattr(search, "LEAST_BLOCK", 50)
    x = np.random.default_rng(2).standard_normal((1000, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = search.knn_self(df, k=3, max_broadcast=10)
    x = x.astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = (u @ u.T).round(12)
    np.fill_diagonal(sims, -np.inf)
    want = {(i, r): j for i in range(1000) for r, j in enumerate(np.lexsort((np.arange(1000), -sims[i]))[:3], 1)}
    assert {(r.query_id, r["rank"]): r.corpus_id for r in got.collect()} == want
    seen = []
    monkeypatch.setattr(np, "nonzero", lambda m, f=np.nonzero: (seen.append(m.shape), f(m))[1])
    search._best(np.arange(1000), u, np.arange(1000), u, 3, True)
    search._best(np.arange(1000), u, np.arange(20_000), np.resize(u, (20_000, 4)), 3, True)
    assert max(np.prod(x) for x in seen) <= search.TILE[0] * search.TILE[1]



def test_tiles_bound_a_search_among_other_labels(monkeypatch):
    monkeypatch.setattr(search, "TILE", (8, 32))
    seen = []
    monkeypatch.setattr(np, "putmask", lambda a, m, v, f=np.putmask: (seen.append(m.shape), f(a, m, v)))
    x, kind = np.random.default_rng(4).standard_normal((200, 3)), np.arange(200) % 3
    q, c, _ = search._best(np.arange(200), x, np.arange(200), x, 5, False, kind, kind)
    assert len(q) == 1000 and (kind[q] != kind[c]).all()
    assert max(seen) == (8, 32)



def test_tiles_bound_a_search_of_variants(monkeypatch):
    monkeypatch.setattr(search, "TILE", (12, 40))
    seen = []
    monkeypatch.setattr(np, "partition", lambda a, n, f=np.partition, **o: (seen.append(a.shape), f(a, n, **o))[1])
    x = np.random.default_rng(6).standard_normal((500, 3))
    q, c, sim = search._best(np.arange(24), x[:24], np.arange(500), x, 16, False)
    assert (np.bincount(q) == 16).all() and (c == np.concatenate([np.lexsort((np.arange(500), -(x[i] @ x.T).round(12)))[:16] for i in range(24)])).all()
    assert set(seen) == {(12, 40)}


def test_files_are_written_from_events_as_they_come(spark, monkeypatch):
    files = {f: [{"track": t, "seq": s, "event": n, "time": s, "channel": t, "a": s % 128, "b": 64} for t in (0, 2) for s, n in enumerate(["note_on", "note_off", "nonsense", "control_change"] * 25)] for f in ("a", "b", "c", None)}
    rows = [(f, 96, *e.values(), None, None) for f, events in files.items() for e in events]
    np.random.default_rng(1).shuffle(rows)
    df = spark.createDataFrame(rows, "file_id string, ticks int, track int, seq int, event string, time bigint, channel int, a int, b int, text binary, extra array<int>").repartition(5)
    want = {f: midi.encode_file(96, events) for f, events in files.items()}
    assert {r.file_id: (bytes(r.content), r.warnings) for r in midi.write_midi(df).collect()} == want
    asked = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: (asked.append((self, f)), self)[1])
    midi.write_midi(df)
    events = asked[0][0].toArrow()
    assert events.num_rows == len(rows)  # not a row for a file
    monkeypatch.setattr(midi, "FILES", 1)
    taken = []
    made = asked[0][1](taken.append(b) or b for b in events.to_batches(max_chunksize=50))
    first = next(made)
    assert sum(b.num_rows for b in taken) <= 250 and first.num_rows == 1
    assert {r["file_id"]: (r["content"], r["warnings"]) for b in (first, *made) for r in b.to_pylist()} == want


def test_hashes_are_made_file_by_file(spark, monkeypatch):
    raw, _ = midi.encode_file(96, [{"track": 0, "seq": 0, "event": "note_on", "time": 5, "channel": 1, "a": 25, "b": 96}])
    df = spark.createDataFrame([(f"d/{i}.mid", raw + b"x" * i) for i in range(3)], "path string, content binary").coalesce(1)
    assert {r.name: r.normalized_md5 for r in midi.normalized_hashes(df).collect()}.keys() == {"0", "1", "2"}
    asked = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema, g=type(df).mapInArrow: (asked.append((self, f)), g(self, f, schema))[1])
    midi.normalized_hashes(df)
    made = list(asked[0][1](iter(asked[0][0].toArrow().combine_chunks().to_batches())))
    assert [b.num_rows for b in made] == [1, 1, 1] and {b.to_pylist()[0]["again"] for b in made} == {raw}
