import numpy as np
import pytest

from sonaris.operators import pooling as P
from sonaris.operators import tokens as T

NOTES = "file_id string, start bigint, dur bigint, channel int, pitch int, velocity int, patch int"


def sequence(spark, tokens=(5, 130, 300, 719), values=(1, 2, 3, 4), mask=(True, True, True, False)):
    return spark.createDataFrame([(0, list(tokens), [[float(v)] for v in values], list(mask))], "seq_id int, tokens array<int>, vecs array<array<double>>, mask array<boolean>")


def test_documented_pooling(spark):
    df = sequence(spark)
    assert P.mean_pool(df).first().pooled == [2.0]
    assert P.weighted_mean_pool(df, {(128, 256): 2}).first().pooled == [2.0]
    assert P.aggregated_pool(df, {(0, 128): 1, (128, 256): 2}).first().pooled == pytest.approx([1.0, 4.0])
    assert P.aggregated_pool(df, {(0, 128): 1, (128, 256): 2}, concat=False).first().pooled == [[1.0], [4.0]]
    assert P.pool(df, "weighted_mean", None).first().pooled == [2.0]


def test_pooling_edges(spark):
    masked = sequence(spark, mask=(False,) * 4)
    assert P.mean_pool(masked).first().pooled == [0.0]
    assert P.weighted_mean_pool(masked, (1, 2, 3)).first().pooled == [0.0]
    assert P.aggregated_pool(sequence(spark), {(500, 600): 1.0}).first().pooled == [0.0]
    # a later range overrides, but a weight of exactly 1 doesn't reset
    df = sequence(spark)
    assert P.weighted_mean_pool(df, {(0, 400): 3.0, (128, 256): 1.0}).first().pooled == pytest.approx([2.0])
    with pytest.raises(TypeError):
        P.normalize_weights("x")
    with pytest.raises(ValueError):
        P.pool(df, "max")
    assert P.pool(spark.createDataFrame([([1.0, 2.0],)], "vecs array<float>")).first().pooled == [1.0, 2.0]


def test_selected_and_concatenated(spark):
    df = sequence(spark)
    assert P.selected_mean_pool(df, [130, 300]).first().pooled == [2.5]
    assert P.selected_mean_pool(df, [77]).first().pooled == [2.0]
    assert P.selected_mean_pool(df, None, {130: 3.0, 300: 1.0}).first().pooled == [2.25]
    assert P.concat_pool(df, [5, 130, 300], 2, dim=1).first().pooled == [1.0, 2.0]
    assert P.concat_pool(df, [5, 130, 300], 2, {300: 9.0}, dim=1).first().pooled == [3.0, 1.0]
    assert P.concat_pool(df, [77], 2, dim=1).first().pooled == [0.0, 0.0]
    assert P.effective_token_ids([1, 2], {2: 1.0}) == [2] and P.effective_token_ids([1], {2: 1.0}) == [1] and P.effective_token_ids(None, None) is None
    assert P.most_matching_tokens(df, [5, 130], 2).first().n == 2


def test_padding(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [4]), (2, []), (3, None)], "id int, tokens array<int>")
    got = {r.id: (r.padded, r.mask) for r in P.pad_and_mask(df, pad_id=9).collect()}
    assert got == {0: ([1, 2, 3], [True] * 3), 1: ([4, 9, 9], [True, False, False]), 2: ([9] * 3, [False] * 3), 3: ([9] * 3, [False] * 3)}
    assert {r.id: r.padded for r in P.pad_and_mask(df, pad_id=9, max_len=2).collect()}[0] == [1, 2]
    assert {r.id: r.padded for r in P.pad_and_mask(df, pad_id=9, right=True).collect()}[1] == [9, 9, 4]
    assert P.pad_and_mask(df.where("id > 1")).first().padded == []


@pytest.mark.parametrize("how,weights", [("mean", None), ("weighted_mean", (1.0, 2.0, 0.5)), ("weighted_mean_aggregated", {(0, 128): 1.0, (128, 720): 2.0})])
def test_model_batches_agree_with_native_pooling(spark, how, weights):
    rng = np.random.default_rng(0)
    lists = [rng.integers(0, 700, n).tolist() for n in (0, 1, 5, 9, 9, 30)]
    df = spark.createDataFrame(list(enumerate(lists)), "seq_id int, tokens array<int>")
    got = {r.seq_id: r.embedding for r in P.embed_sequences(df, lambda: P.HashEmbedder(8), how=how, weights=weights, batch_size=2).collect()}
    model = P.HashEmbedder(8)
    rows = [(i, x, model(np.array([x]), None)[0].tolist() if x else [], [True] * len(x)) for i, x in enumerate(lists)]
    native = spark.createDataFrame(rows, "seq_id int, tokens array<int>, vecs array<array<double>>, mask array<boolean>")
    want = {r.seq_id: r.pooled for r in P.pool(native, how, weights, dim=8).collect()}
    assert got.keys() == want.keys()
    for i in got:
        assert got[i] == pytest.approx(want[i], abs=1e-6)
    unit = P.embed_sequences(df.where("seq_id > 0"), lambda: P.HashEmbedder(8), l2=True).first().embedding
    assert np.linalg.norm(unit) == pytest.approx(1.0, abs=1e-5)


def test_default_chords():
    chords = T.default_chords()
    assert len(chords) == 321 and len(set(chords)) == 321 and chords == sorted(chords)


def test_tokens_and_back(spark):
    notes = [("f", 0, 10, 0, 60, 90, 0), ("f", 0, 12, 0, 64, 90, 0), ("f", 0, 9, 0, 67, 90, 0), ("f", 16, 9, 0, 67, 90, 0)]
    table = T.chord_table(spark)
    chords = T.repair_chords(T.chordify(spark.createDataFrame(notes, NOTES)), table)
    got = T.encode_tokens(chords).first().tokens
    chord = T.default_chords().index((0, 4, 7)) + T.CHORD
    assert got == [0, chord, 67 + 128, 9 + 256, 64 + 128, 12 + 256, 60 + 128, 10 + 256, 16, 391, 195, 265]
    back = T.decode_tokens(spark.createDataFrame([("f", 0, got)], "file_id string, variant int, tokens array<int>"))
    assert sorted((r.event, r.start, r.pitch, r.dur) for r in back.collect()) == [(0, 0, 60, 10), (0, 0, 64, 12), (0, 0, 67, 9), (1, 16, 67, 9)]
    assert T.encode_tokens(chords, max_len=5).first().tokens == got[:5]


def test_repair_is_lossy_for_clusters(spark):
    cluster = [("f", 0, 1, 0, p, 90, 0) for p in (60, 61, 64)]
    r = T.repair_chords(T.chordify(spark.createDataFrame(cluster, NOTES)), T.chord_table(spark)).first()
    assert sorted(n.pitch for n in r.notes) == [60, 64] and r.chord_id == T.default_chords().index((0, 4))


def test_note_preparation(spark):
    notes = spark.createDataFrame([("f", 0, 100, 0, 60, 90, 0), ("f", 50, 100, 0, 60, 90, 0), ("f", 50, 40, 0, 60, 80, 0), ("f", 60, 10, 9, 35, 90, 0)], NOTES)
    out = T.fix_durations(T.distinct_pitches(T.solo_piano(notes)))
    assert sorted((r.start, r.dur) for r in out.collect()) == [(0, 50), (50, 100)]
    assert {r.start for r in T.rebase(notes.where("start > 0")).collect()} == {0, 10}
    assert sorted({r.variant for r in T.transpose_variants(notes, 2).collect()}) == [-2, -1, 0, 1]
    assert {r.variant for r in T.transpose_variants(notes, 0).collect()} == {0}
    assert T.keep_instruments(notes, [1]).count() == 0
    assert sorted(r.start for r in T.quantize(notes, 20).collect()) == [0, 2, 2, 3]  # halves to even


def test_patches_and_pedal(spark):
    notes = spark.createDataFrame([("f", 0, 5, 0, 60, 90, 0), ("f", 10, 5, 0, 61, 90, 0), ("f", 30, 5, 0, 62, 90, 0)], NOTES)
    patches = spark.createDataFrame([("f", 0, 10, 40)], "file_id string, channel int, time bigint, patch int")
    assert {r.pitch: r.patch for r in T.attach_patches(notes, patches).collect()} == {60: 0, 61: 40, 62: 40}
    pedals = spark.createDataFrame([("f", 0, 12, 127), ("f", 0, 14, 100), ("f", 0, 25, 0), ("f", 0, 32, 64)], "file_id string, channel int, time bigint, value int")
    assert {r.pitch: r.dur for r in T.apply_sustain(notes, pedals).collect()} == {60: 5, 61: 15, 62: 5}


def test_masking(spark):
    df = spark.createDataFrame([(0, [1, 2, 3, 4]), (1, [])], "seq_id int, tokens array<int>")
    none = T.ngram_replace(df, prob_single=0, prob_ngram=0)
    assert {tuple(r.masked) for r in none.collect()} == {(1, 2, 3, 4), ()}
    assert set(T.ngram_replace(df.where("seq_id = 0"), prob_single=1.0).first().masked) == {T.MASK}
    assert [r.tokens for r in T.char_tokens(spark.createDataFrame([("aéb",), (None,)], "text string")).collect()] == [[97, 98], []]
    assert [len(r.tokens) for r in T.sort_by_length(df, partitions=2, tie="seq_id").collect()] == [0, 4]
