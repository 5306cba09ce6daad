import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonaris.functions.tables import patch_names, patch_table, percussion_names, percussion_table
from sonaris.operators.events import opus_length
from sonaris.operators.pooling import HashEmbedder
from sonaris.plans.similarity import build_corpus, discover, files_to_notes, midi_to_ms_score, midi_to_score, score_to_midi, search_files
from sonaris.sources import files as S
from sonaris.sources import midi
from sonaris.streaming.incremental import IncrementalMoments, IncrementalTopK, windowed_notes


def song(pitches, ticks=96):
    events, seq = [], 0
    for p in pitches:
        for name, t in (("note_on", 0), ("note_off", 96)):
            events.append({"track": 0, "seq": seq, "event": name, "time": t, "channel": 0, "a": p, "b": 90})
            seq += 1
    return midi.encode_file(ticks, events)[0]


@pytest.fixture
def songs(tmp_path):
    for name, pitches in (("one", [60, 64, 67, 72]), ("two", [50, 51, 40, 40]), ("three", [62, 66, 69, 74])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.mid").write_bytes(song(pitches))
    (tmp_path / "in" / "bad.mid").write_bytes(b"nothing")
    return tmp_path


def test_from_files_to_copies(spark, songs):
    files = midi.read_files(spark, str(songs / "in"))
    assert files_to_notes(files).count() == 12
    corpus = build_corpus(files, lambda: HashEmbedder(8), str(songs / "corpus"))
    assert corpus.count() == 3
    stored = S.load_embeddings(spark, str(songs / "corpus"))
    names = stored.select(F.xxhash64("name").alias("corpus_id"), S.stem("name").alias("name"))
    vectors = stored.select(F.xxhash64("name").alias("corpus_id"), F.col("embedding").alias("vec"))
    matches = search_files(files.where("path like '%one.mid'"), vectors, lambda: HashEmbedder(8), k=2)
    best = matches.join(names, "corpus_id").orderBy("place").first()
    assert best.name == "one" and best.variant == 0 and best.score == pytest.approx(100, abs=1e-3)
    catalog = S.file_catalog(spark, [str(songs / "in")])
    manifest = discover(files.where("path like '%one.mid'"), vectors, names, catalog, lambda: HashEmbedder(8), str(songs / "out"), k=1)
    done = S.copy_files(manifest).collect()
    assert done and all(r.copied for r in done) and len(list((songs / "out").iterdir())) == len(done)
    gone = S.copy_files(manifest.withColumn("src", F.lit("/nowhere/x.mid"))).first()
    assert not gone.copied and gone.error


def test_scores_of_files_and_back(spark, songs):
    files = midi.read_files(spark, str(songs / "in")).where("path like '%one.mid'")
    score = midi_to_score(files)
    assert [(r.time, r.dur, r.a) for r in score.where("event = 'note'").orderBy("seq").collect()] == [(96 * i, 96, p) for i, p in enumerate([60, 64, 67, 72])]
    assert [(r.time, r.dur) for r in midi_to_ms_score(files).where("event = 'note'").orderBy("seq").collect()] == [(500 * i, 500) for i in range(4)]
    again = midi_to_score(score_to_midi(score), key="file_id")
    assert sorted(map(str, again.drop("ticks").collect())) == sorted(map(str, score.drop("ticks").collect()))
    assert opus_length(midi.opus_events(midi.read_midi(files))).first().nticks == 384
    for folder in ("normal", "in"):
        out = S.write_normalized(files, str(songs / folder)).first()
        assert out.written and out.dst.endswith("one.mid" if folder == "normal" else "one_normalized.mid")
    assert (songs / "in" / "one.mid").read_bytes() == song([60, 64, 67, 72])


def test_catalogue_takes_the_last(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.mid").write_bytes(d.encode())
    r = S.file_catalog(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()
    assert len(r) == 1 and "/b/" in r[0].path
    assert [x.kind for x in S.list_files(spark, str(tmp_path / "a"), "*.mid", "model").collect()] == ["model"]


def test_embedding_files(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "name string, embedding array<float>")
    npy = S.save_embeddings(df, str(tmp_path / "e.npy"))
    assert sorted((r.name, r.embedding) for r in S.load_embeddings(spark, npy).collect()) == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    S.save_embeddings(df, str(tmp_path / "p"))
    assert S.load_embeddings(spark, str(tmp_path / "p")).count() == 2
    for again in range(2):
        S.append_batch(df, str(tmp_path / "batches"), 1)
    S.append_batch(df, str(tmp_path / "batches"), 2)
    assert spark.read.parquet(str(tmp_path / "batches")).count() == 4
    raw = S.to_wave(spark.createDataFrame([("f", [0.0, 1.0, -2.0])], "file_id string, samples array<float>")).first().content
    (tmp_path / "w.wav").write_bytes(raw)
    with wave.open(str(tmp_path / "w.wav")) as w:
        assert w.getframerate() == 16000 and np.frombuffer(w.readframes(9), "<i2").tolist() == [0, 32767, -32767]


def test_dimension_tables(spark):
    assert len(patch_names()) == 128 and patch_names()[127] == "Gunshot" and patch_names()[46] == "Orchestral Harp"
    assert percussion_names()[35] == "Acoustic Bass Drum" and percussion_names()[81] == "Open Triangle"
    assert patch_table(spark, [0]).where("keep").count() == 1 and percussion_table(spark).count() == 47


def test_streams(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, 5))
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    schema = "corpus_id long, vec array<double>"
    for i in range(4):
        spark.createDataFrame(rows[i * 10 : i * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    queries = spark.createDataFrame([(0, x[0].tolist())], "query_id long, vec array<double>")
    top, mom = IncrementalTopK(queries, str(tmp_path / "top"), k=5), IncrementalMoments(str(tmp_path / "mom"), vector="vec")

    def both(batch, batch_id):
        top(batch, batch_id)
        mom(batch, batch_id)
        if batch_id == 1:
            top(batch, batch_id)  # a batch that is run again changes nothing
            mom(batch, batch_id)

    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.foreachBatch(both).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    sims = (x @ x[0]) / np.linalg.norm(x, axis=1) / np.linalg.norm(x[0])
    assert [r.corpus_id for r in top.result(spark).orderBy("rank").collect()] == np.argsort(-sims)[:5].tolist()
    np.testing.assert_allclose(mom.covariance(spark), np.cov(x.T), atol=1e-9)
    assert len(list((tmp_path / "top").glob("batch=*"))) == 2


def test_streams_go_on_in_another_process(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal((20, 4))
    parts = [spark.createDataFrame([(i, x[i].tolist()) for i in range(a, a + 10)], "corpus_id long, vec array<double>") for a in (0, 10)]
    queries = spark.createDataFrame([(0, x[0].tolist())], "query_id long, vec array<double>")
    for batch_id, part in enumerate(parts):  # new objects each time
        IncrementalTopK(queries, str(tmp_path / "top"), k=3)(part, batch_id)
        IncrementalMoments(str(tmp_path / "mom"), vector="vec")(part, batch_id)
    assert IncrementalTopK(queries, str(tmp_path / "top")).result(spark).orderBy("rank").first().corpus_id == 0
    np.testing.assert_allclose(IncrementalMoments(str(tmp_path / "mom")).covariance(spark), np.cov(x.T), atol=1e-9)


def test_windowed_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    batch = windowed_notes(spark.read.parquet(f"{sf}/events.parquet"), window="1 day")
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev" / "e.parquet").symlink_to(f"{sf}/events.parquet")
    q = windowed_notes(spark.readStream.schema(schema).parquet(str(tmp_path / "ev")), window="1 day").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("w").select("window_start", "event_type", "n").collect())) == sorted(map(str, batch.select("window_start", "event_type", "n").collect()))
