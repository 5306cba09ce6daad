"""Generation, masked text and classification with model hooks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonaris.operators import balance, generation, pooling, scoring
from sonaris.sources import files


def _models():  # classes of a function travel to the workers by value
    class Next:
        """Prefers the token after the one it sees, of eight."""

        def __call__(self, ids, mask):
            out = np.zeros((*ids.shape, 8))
            np.put_along_axis(out, ((ids + 1) % 8)[..., None], 4.0, 2)
            return out

    class Chars:
        """Thinks that every place is an e, then the letter seen."""

        def __call__(self, ids, mask):
            out = np.zeros((*ids.shape, 130))
            np.put_along_axis(out, ids[..., None], 1.0, 2)
            out[..., ord("e")] = 2.0
            return out

    return Next, Chars


Next, Chars = _models()


PROMPTS = [(0, [1, 2]), (1, []), (2, None), (3, [7, 7, 7])]


def prompts(spark):
    return spark.createDataFrame(PROMPTS, "seq_id int, tokens array<int>")


def got(df):
    return {r.seq_id: r.tokens for r in df.collect()}


def test_greedy(spark):
    assert got(generation.generate(prompts(spark), Next, steps=3, temperature=0, pad_id=0)) == {0: [1, 2, 3, 4, 5], 1: [1, 2, 3], 2: [1, 2, 3], 3: [7, 7, 7, 0, 1, 2]}
    ended = generation.generate(prompts(spark), Next, steps=9, temperature=0, pad_id=0, eos_id=4).collect()
    assert {r.seq_id: (r.tokens[-1], len(r.log_probs)) for r in ended} == {0: (4, 2), 1: (4, 4), 2: (4, 4), 3: (4, 5)}
    assert ended[0].log_probs[0] == pytest.approx(4 - math.log(math.exp(4) + 7))
    assert got(generation.generate(prompts(spark), Next, steps=1, temperature=0, pad_id=0, forbidden=[3, 1], bias={5: 2.0}))[0] == [1, 2, 5]
    assert got(generation.generate(prompts(spark).limit(0), Next)) == {}


def test_draws_do_not_depend_on_batches(spark):
    one = got(generation.generate(prompts(spark).coalesce(1), Next, steps=20, temperature=1.5, batch_size=4))
    assert one == got(generation.generate(prompts(spark).repartition(3), Next, steps=20, temperature=1.5, batch_size=1))
    assert one != got(generation.generate(prompts(spark), Next, steps=20, temperature=1.5, seed=1))
    assert all(len(one[k]) == 20 + len(p or []) for k, p in PROMPTS)


def test_infill_keeps_the_rest(spark):
    df = spark.createDataFrame([(0, [1, 9, 9, 6]), (1, [9, 5]), (2, [2]), (3, [])], "seq_id int, tokens array<int>")
    out = generation.generate(df, Next, infill=9, temperature=0, pad_id=3)
    assert got(out) == {0: [1, 2, 3, 6], 1: [4, 5], 2: [2], 3: []}
    assert [len(r.log_probs) for r in out.orderBy("seq_id").collect()] == [2, 1, 0, 0]


def test_adjusted_logits():
    x = np.array([3.0, -1.0, 2.0, 0.0])
    assert generation.adjusted(x, np.array([0, 1, 99]), penalty=2.0).tolist() == [1.5, -2.0, 2.0, 0.0]
    assert np.isfinite(generation.adjusted(x, x[:0], top_k=2)).tolist() == [True, False, True, False]
    assert np.isfinite(generation.adjusted(x, x[:0], min_p=math.exp(-2))).tolist() == [True, False, True, False]
    with pytest.raises(ValueError):
        generation._draw(generation.adjusted(x, x[:0], forbidden=[0, 1, 2, 3]), 1.0, np.random.default_rng(0))


def test_masked_text(spark):
    df = spark.createDataFrame([(0, "h\u00e9llo"), (1, ""), (2, None), (None, "xy")], "doc_id int, text string")
    rows = {r.doc_id: r for r in scoring.predict_masked_text(df, Chars, positions=[0, 3, 50], top=2).collect()}
    assert (rows[0].original_text, rows[0].masked_text) == ("hllo", "[M]ll[M]")
    assert [(p.position, p.original_char, p.predicted_char, [t.char for t in p.topk]) for p in rows[0].predictions] == [(0, "h", "e", ["e", "[M]"]), (3, "o", "e", ["e", "[M]"])]
    assert rows[1].predictions == rows[2].predictions == [] and rows[None].masked_text == "[M]y" and len(rows[None].predictions) == 1
    assert len(scoring.predict_masked_text(df, Chars, prob=1.0).where("doc_id = 0").first().predictions) == 4
    for wrong in ({}, {"prob": 0.1, "positions": [1]}):
        with pytest.raises(ValueError):
            scoring.predict_masked_text(df, Chars, **wrong)


def test_classifier(spark):
    class Sum:
        def __call__(self, ids, mask):
            return (ids * mask).sum(1)

    df = spark.createDataFrame([(0, [1, 1]), (1, [-3, 1]), (2, []), (3, [0, 0, 5])], "seq_id int, tokens array<int>")
    rows = {r.seq_id: r for r in scoring.classify_sequences(df, Sum, max_len=2, batch_size=2).collect()}
    assert {k: (r.logit, r.pred) for k, r in rows.items()} == {0: (2.0, 1), 1: (-2.0, 0), 2: (0.0, 1), 3: (0.0, 1)}
    assert rows[0].prob == pytest.approx(1 / (1 + math.exp(-2)))


def test_layers(spark):
    class Layers:
        def __call__(self, ids, mask, layer):
            return np.full((*ids.shape, 2), float(layer)) if layer < 3 else None

        def token_embeddings(self, ids):
            return np.stack([ids, ids], -1)

    df = spark.createDataFrame([(0, [4, 6])], "seq_id int, tokens array<int>")
    assert [pooling.embed_sequences(df, Layers, layer=n).first().embedding for n in (2, 7)] == [[2.0, 2.0], [5.0, 5.0]]


def test_contrastive_metrics(spark):
    x = np.array([[3.0, 1.0, 2.0], [3.0, 2.0, 1.0], [0.0, 1.0, 2.0]])
    df = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(3) for j in range(3)], "i int, j int, sim double")
    r = balance.contrastive_metrics(df, top=2).first()
    # rows rank their own first, second, first; columns first, first, first of equals
    assert (r.recall_at_1, r.recall_at_top, r.mrr) == pytest.approx(((2 / 3 + 2 / 3) / 2, 1.0, (5 / 6 + 5 / 6) / 2))
    assert r.f1 == pytest.approx(((2 / 3 + 0 + 1) / 3 + (2 / 3 + 1 + 0) / 3) / 2)


def test_copies_by_uri(spark, tmp_path):
    (tmp_path / "a.mid").write_bytes(b"x" * 10)
    rows = [(f"file:{tmp_path}/a.mid", f"{tmp_path}/out/b.mid", True), (f"{tmp_path}/none.mid", f"file://{tmp_path}/out/c.mid", True), ("gs2://b/x", f"{tmp_path}/out/d.mid", True)]
    done = files.copy_files(spark.createDataFrame(rows, "src string, dst string, found boolean")).orderBy("dst").collect()
    assert sorted(r.copied for r in done) == [False, False, True] and (tmp_path / "out/b.mid").read_bytes() == b"x" * 10
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["b.mid"]
