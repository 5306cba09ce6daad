"""Logits, scores, reduction, balance, attribution and audio."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonaris.functions import logits as L
from sonaris.operators import attribution as A
from sonaris.operators import audio, balance, reduce, scoring


def kept(spark, f):
    df = spark.createDataFrame([([math.log(p) for p in (0.5, 0.3, 0.15, 0.05)],)], "x array<double>")
    return [i for i, v in enumerate(df.select(f("x").alias("y")).first().y) if v > -math.inf]


def test_documented_filters(spark):
    assert kept(spark, lambda x: L.top_p(x, 0.75)) == [0, 1]
    assert kept(spark, lambda x: L.min_p(x, 0.2)) == [0, 1, 2]
    assert kept(spark, lambda x: L.top_a(x, 2, 0.4)) == [0, 1, 2]
    assert kept(spark, lambda x: L.top_k(x, 0.5)) == [0, 1]
    assert kept(spark, lambda x: L.filter_logits("top_k", x, k=9)) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        L.filter_logits("best", "x")
    assert kept(spark, lambda x: L.bias_logits(x, {3: 1.0}, [0])) == [1, 2, 3]
    r = spark.createDataFrame([([1.0, -1.0, 2.0], [0, 1])], "x array<double>, seen array<int>").select(L.repetition_penalty("x", "seen", 2.0).alias("y")).first()
    assert r.y == [0.5, -2.0, 2.0]


def test_probabilities(spark):
    x = np.array([1.0, 2.0, 700.0])
    r = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(L.softmax("x").alias("p"), L.log_softmax("x").alias("lp"), L.entropy("x").alias("h"), L.argmax("x").alias("a")).first()
    assert r.p == pytest.approx([0, 0, 1]) and r.lp == pytest.approx((x - 700).tolist()) and r.h == pytest.approx(0) and r.a == 2


def test_sequence_scores(spark):
    rows = [(0, i, t, [math.log(p) for p in (0.7, 0.2, 0.1)]) for i, t in enumerate([1, 0, 2, 1, 0])] + [(1, 0, 1, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "seq_id int, pos int, token int, logits array<double>")
    m = scoring.sequence_metrics(scoring.position_scores(df)).collect()
    assert len(m) == 1 and m[0].n == 4
    assert m[0].perplexity == pytest.approx((0.7 * 0.1 * 0.2 * 0.7) ** -0.25) and m[0].accuracy == 0.5
    assert scoring.position_scores(df, eos_id=2).count() == 2  # nothing follows the end token
    assert scoring.position_scores(df, pad_id=0).count() == 2
    tiny = spark.createDataFrame([(-800.0,)], "x double").select(L.display_probability(F.exp("x"), F.col("x")).alias("t")).first()
    assert tiny.t == "~10^-347"


def test_generation(spark):
    rows = [(0, s, 1, [0.0, 0.0], [1.0, float(s)]) for s in range(3)]
    df = spark.createDataFrame(rows, "batch int, step int, token int, logits array<double>, h array<double>")
    got = {(r.step, r.metric): r.value for r in scoring.generation_metrics(df, hidden="h").collect()}
    assert got[0, "entropy"] == pytest.approx(math.log(2)) and got[0, "top_k_gap"] == 0 and got[0, "hidden_cos_sim"] is None
    assert got[1, "hidden_cos_sim"] == pytest.approx(1 / math.sqrt(2))
    values = spark.createDataFrame([(0, i, "m", v) for i, v in enumerate([1.0] * 30 + [50.0, float("nan")])], "batch int, step int, metric string, value double")
    a = scoring.analyze_metrics(values)
    assert [(r.step, r.anomaly) for r in a.where("anomaly is not null").collect()] == [(30, "outlier")]
    g = scoring.grouped_issues(a).first()
    assert (g.n_steps, g.n_flagged, g.dense) == (32, 1, False)
    s = scoring.metric_summary(values).first()
    assert s.first_half == 1.0 and s.max == 50.0 and s.drift_percent > 0


def test_masked_prediction(spark):
    class Echo:
        def __call__(self, ids, mask):
            out = np.zeros((*ids.shape, 10))
            np.put_along_axis(out, ((np.arange(ids.shape[1]) * 0 + 3)[None, :, None]).repeat(len(ids), 0), 5.0, 2)
            return out

    df = spark.createDataFrame([(0, [3, 3, 1], [718, 3, 718], [True, False, True]), (1, [], [], [])], "seq_id int, tokens array<int>, corrupted array<int>, chosen array<boolean>")
    out = scoring.predict_masked(df, Echo, iterations=2)
    assert sorted((r.seq_id, r.position, r.original_id, r.predicted_id) for r in out.collect()) == [(0, 0, 3, 3), (0, 2, 1, 3)]
    r = scoring.prediction_report(df, out).where("seq_id = 0").first()
    assert (r.original, r.masked, r.predicted, r.reconstructed) == ("3 3 1", "718 3 718", "3 _ 3", "3 3 3")
    c = scoring.corrupt(df.drop("corrupted", "chosen"), prob=1.0).where("seq_id = 0").first()
    assert all(c.chosen) and len(c.corrupted) == 3
    assert scoring.mask_after_end(df, 3, 9).where("seq_id = 0").first().tokens == [3, 9, 9]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((300, 4)) @ rng.standard_normal((4, 12)) + 0.01 * rng.standard_normal((300, 12)) + 3).astype(np.float32)
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(7)


def test_reduction(points, tmp_path):
    x, df = points
    r = reduce.pca(df, 4, save_dir=str(tmp_path))
    x = x.astype(float)
    np.testing.assert_allclose(r.covariance, np.cov(x.T), atol=1e-9)
    np.testing.assert_allclose(r.mean, x.mean(0), atol=1e-9)
    assert (np.diff(r.eigenvalues) <= 1e-12).all() and r.cumulative_variance[-1] > 0.999
    rows = {q.vec_id: q.reduced for q in r.reduced.collect()}
    y = np.array([rows[i] for i in range(len(x))])
    assert y.shape == (300, 4) and np.abs(y @ r.projection.T + r.mean - x).max() < 0.1
    assert (tmp_path / "mean.npy").exists() and (tmp_path / "reduced.parquet").exists()
    approx = reduce.pca(df, 4, exact_covariance=False, batch_size=50)
    assert np.trace(approx.covariance) <= np.trace(r.covariance) + 1e-9
    cov = {(q.i, q.j): q["cov"] for q in reduce.covariance_native(df).collect()}
    assert all(abs(cov[i, j] - r.covariance[i, j]) < 1e-9 for i in range(12) for j in range(i, 12))


def test_reduction_errors(points, spark):
    _, df = points
    for bad in (0, 13):
        with pytest.raises(ValueError):
            reduce.pca(df, bad)
    with pytest.raises(ValueError):
        reduce.pca(df.limit(0), 2)
    with pytest.raises(ValueError):
        reduce.pca(spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)], "vec_id long, embedding array<float>"), 1)
    with pytest.warns(RuntimeWarning):
        reduce.pca(df.limit(3), 5)
    assert reduce.variance_checkpoints(10) == [1, 2, 4, 8, 10]
    assert reduce.components_for(np.array([0.5, 0.92, 1.0])) == {0.9: 2, 0.95: 3, 0.99: 3}


def test_balance(spark):
    rows = [(0, [1] * 4, [0, 1, 1, 0]), (1, [1] * 4, [1] * 4), (2, [], [])]
    df = spark.createDataFrame(rows, "id int, tokens array<int>, token_types array<int>")
    out = balance.balanced_sequences(df)
    assert [(r.id, r.share) for r in out.collect()] == [(0, 0.5)]
    assert balance.share_stats(out).first().mean == 0.5
    with pytest.raises(Exception, match="differ in length"):
        balance.balanced_sequences(spark.createDataFrame([(0, [1], [])], "id int, tokens array<int>, token_types array<int>")).collect()
    labels = spark.createDataFrame([([0] * 90 + [1] * 10 + [-1],)], "labels array<int>")
    counts = balance.class_counts(labels, "labels", 2, pad=-1)
    assert {r.label: r.n for r in counts.collect()} == {0: 90, 1: 10}
    assert {r.label: round(r.weight, 9) for r in balance.class_weights(counts).collect()} == {0: 1.0, 1: 9.0}


def test_losses_and_eta(spark):
    sims = spark.createDataFrame([(i, j, 5.0 if i == j else 0.0) for i in range(3) for j in range(3)], "i int, j int, sim double")
    want = math.log(math.exp(5) + 2) - 5
    assert balance.contrastive_loss(sims).first().loss == pytest.approx(want)
    f = spark.createDataFrame([([0.0, 0.0], 0)], "logits array<double>, target int")
    assert balance.focal_loss(f).first().loss == pytest.approx(0.25 * math.log(2))
    r = balance.eta(spark.createDataFrame([(7771, 0, 15.07, 5.3)], "steps int, done int, seconds_per_step double, price double").withColumn("start", F.lit("2024-01-01 00:00:00").cast("timestamp")), price="price").first()
    assert (r.hours, r.minutes, r.seconds) == (32, 31, 48) and r.cost == pytest.approx(172.42, abs=0.1) and r.ends.day == 2


def test_attribution(spark):
    att = spark.createDataFrame([(0, layer, 0, i, j, w) for layer in (0, 1) for i, row in enumerate([[1.0, 0.0], [0.5, 0.5]]) for j, w in enumerate(row)], "seq_id int, layer int, head int, i int, j int, w double")
    assert {r.pos: r.score for r in A.attention_received(att).collect()} == {0: 1.5, 1: 0.5}
    a = 0.5 * np.array([[1, 0], [0.5, 0.5]]) + 0.5 * np.eye(2)
    assert {r.pos: r.score for r in A.attention_rollout(att, 2).collect()} == pytest.approx(dict(enumerate((a @ a).sum(0))))
    seq = spark.createDataFrame([(0, [1, 2, 3])], "seq_id int, tokens array<int>")
    assert sorted(tuple(r.tokens) for r in A.occluded_variants(seq).collect()) == [(1, 2, 718), (1, 718, 3), (718, 2, 3)]
    assert A.occluded_variants(seq, pairs=True).count() == 3
    base = spark.createDataFrame([(0, [1.0, 1.0])], "seq_id int, embedding array<double>")
    occ = spark.createDataFrame([(0, 0, [1.0, 3.0]), (0, 1, [1.0, 1.0])], "seq_id int, a int, embedding array<double>")
    assert {r.a: r.score for r in A.occlusion_scores(base, occ).collect()} == {0: 2.0, 1: 0.0}
    single = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (0, 2, 0.0)], "seq_id int, a int, score double")
    pairs = spark.createDataFrame([(0, 0, 1, 5.0), (0, 0, 2, 0.5), (0, 1, 2, 1.0)], "seq_id int, a int, b int, score double")
    assert {r.pos: r.score for r in A.pair_synergy(single, pairs).collect()} == {0: 1.5, 1: 1.5, 2: 0.0}


def test_fusion_leaves_pads_out(spark):
    rows = [(0, p, "occlusion", s, v) for p, (s, v) in enumerate([(1.0, True), (3.0, True), (9.0, False)])]
    df = spark.createDataFrame(rows, "seq_id int, pos int, signal string, score double, valid boolean")
    assert {r.pos: r.fused for r in A.fuse(df).collect()} == {0: 0.0, 1: 1.0}
    top = A.principal_tokens("fused", df, top=1).collect()
    assert [(r.pos, r["rank"]) for r in top] == [(1, 1)]
    with pytest.raises(ValueError):
        A.principal_tokens("gradient", df)
    with pytest.raises(ValueError):
        A.fuse(df, how="sum")


def test_audio(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([0.0, 0.5, -0.25, 0.0, 0.0])], "k int, pos int, value double")
    peak = audio.normalize_audio(df, key=["k"], level_db=0.0)
    assert max(abs(r.normalized) for r in peak.collect()) == pytest.approx(1.0)
    assert audio.trim_silence(df, key=["k"]).count() == 3
    assert {r.sample for r in audio.to_int16(df, key=["k"]).collect()} == {0, 32767, -16383}
    with pytest.raises(ValueError):
        audio.normalize_audio(df, key=["k"], method="loud")
    opus = spark.createDataFrame([("f", 0, 0, "set_tempo", 0, 1_000_000), ("f", 0, 1, "note_on", 96, 60), ("f", 1, 0, "note_on", 48, 60)], "file_id string, track int, seq int, event string, time bigint, a int").selectExpr("*", "96 ticks")
    assert [(r.track, r.sample) for r in audio.sample_schedule(opus, rate=1000).orderBy("place").collect()] == [(0, 0), (1, 500), (0, 1000)]
