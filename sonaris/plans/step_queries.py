"""Registered queries of single steps: codec, event algebra, notes and tokens, logits, attribution, audio.

The tables stand in for the engine's own as in queries.py; each query covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonaris.functions import logits as L
from sonaris.functions.vectors import doubles
from sonaris.operators import attribution, audio, balance, events, pooling, scoring, search, tokens
from sonaris.plans.queries import _events, _logits, _score, _sequences, r6, table
from sonaris.sources import midi

#: Kinds of events as messages of the file format.
MESSAGES = {"click": "note_on", "purchase": "note_off", "view": "patch_change", "error": "control_change", "signup": "set_tempo"}
TEMPO = 250_000


def _text(c: Column | str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


# -- codec and event algebra -----------------------------------------------------------------------

def _opus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as tracks of files of ten, their events as messages with delta times in seconds."""
    rows = _events(spark, sf_dir)
    rows = rows.withColumn("time", F.col("time") - F.min("time").over(Window.partitionBy("file_id")))
    rows = rows.withColumn("track", (F.dense_rank().over(Window.partitionBy("file_id").orderBy("track")) - 1).cast("int"))
    name = F.element_at(F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair]), F.col("kind"))
    tempo = F.col("kind") == "signup"
    rows = rows.withColumn("event", name).withColumn("channel", F.when(~tempo, F.col("channel")))
    rows = rows.withColumn("a", F.when(tempo, TEMPO + F.col("v") * 1000).otherwise(F.col("v") % 128)).withColumn("b", F.when(F.col("event").isin("note_on", "note_off", "control_change"), F.lit(64)))
    return events.delta_times(rows.withColumn("ticks", F.lit(96)))


def midi_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events written to files of the binary format and read back."""
    files = midi.write_midi(events.wide(_opus(spark, sf_dir))).select(F.col("file_id").alias("path"), "content")
    read = midi.opus_events(midi.read_midi(files, key="path", content="content"))
    return read.select("file_id", "ticks", "track", "seq", "event", F.col("time").alias("delta"), "channel", "a", "b")


def midi_message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each written file holds when read back: how many events, of which kinds, and no warning."""
    files = midi.write_midi(events.wide(_opus(spark, sf_dir)))
    decoded = midi.read_midi(files.select(F.col("file_id").alias("path"), "content"), key="path", content="content")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("events", lambda e: e["event"]))), ",")
    return decoded.select("file_id", "ticks", F.size("events").alias("n_events"), kinds.alias("kinds"), F.size("warnings").alias("n_warnings"))


def score_opus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as their two messages, everything as deltas."""
    return events.score_to_opus(_score(spark, sf_dir)).select("event_id", "event", "track", "seq", F.col("time").alias("delta"), "a", "b")


def mixed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tracks of a file as one, notes left out."""
    rows = _opus(spark, sf_dir).where("NOT event LIKE 'note%'")
    first = Window.partitionBy("file_id", "track").orderBy("seq")
    rows = events.delta_times(events.absolute_times(rows).withColumn("seq", F.row_number().over(first)))
    return events.mix_opus_tracks(rows).select("event_id", "track", "seq", F.col("time").alias("delta"))


def common_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of files, one of 96 and one of 48 ticks, brought to milliseconds."""
    rows = _opus(spark, sf_dir).where("event != 'set_tempo'")
    rows = events.delta_times(events.absolute_times(rows)).withColumn("pair", F.floor(F.col("file_id").cast("int") / 2)).withColumn("ticks", F.when(F.col("file_id").cast("int") % 2 == 0, 96).otherwise(48))
    return events.consistent_ticks(rows, group=["pair"]).where("event_id IS NOT NULL").select("event_id", "ticks", F.col("time").alias("delta"))


def score_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first click or purchase of a file says: scores of even, opuses of odd users."""
    rows = _events(spark, sf_dir)
    name = F.when(F.col("kind").isin("click", "purchase"), F.when(F.col("track") % 2 == 0, "note").otherwise("note_on")).otherwise(F.col("kind"))
    return events.score_type(rows.withColumn("event", name))


def file_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deltas of all tracks of a file added up."""
    return events.opus_length(_opus(spark, sf_dir))


def bank_selects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as controllers 0 and 32 by turns of their value."""
    rows = _events(spark, sf_dir).where("kind = 'error'").withColumn("event", F.lit("control_change")).withColumn("a", F.when(F.col("v") % 2 == 0, 0).otherwise(32)).withColumn("b", F.col("v") % 128)
    out = events.bank_selects(rows)
    return out.select("file_id", F.array_join(F.transform("bank_selects", lambda x: F.concat_ws(":", x["msb"].cast("string"), x["lsb"].cast("string"))), " ").alias("selects"))


# -- notes and tokens ------------------------------------------------------------------------------

def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a note that begins at its second of the day."""
    rows = _events(spark, sf_dir)
    return rows.select("file_id", "event_id", (F.col("time") % 86400).alias("start"), (F.col("v") * 40 + 1).cast("long").alias("dur"), "channel", (F.col("v") % 128).cast("int").alias("pitch"), (F.col("event_id") % 128).cast("int").alias("velocity"), (F.col("v") % 7).alias("patch"))


def quantized_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.quantize(_notes(spark, sf_dir)).select("event_id", "start", "dur")


def piano_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of three instruments, drums left out, as one instrument."""
    return tokens.solo_piano(tokens.keep_instruments(_notes(spark, sf_dir), [0, 2, 5])).select("event_id", "channel", "patch")


def distinct_pitch_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.distinct_pitches(tokens.quantize(_notes(spark, sf_dir), 3600)).select("file_id", "start", "pitch", "dur", "velocity")


def fixed_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with one note of each pitch, cut at the next of its pitch."""
    rows = tokens.rebase(tokens.distinct_pitches(tokens.quantize(_notes(spark, sf_dir), 3600)))
    return tokens.fix_durations(rows.withColumn("dur", F.lit(5).cast("long"))).select("file_id", "start", "pitch", "dur")


def transposed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.transpose_variants(tokens.rebase(_notes(spark, sf_dir)), 3).select("event_id", "variant", "start", "pitch")


def patched_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views set the patch of their channel; all other events take the last one."""
    rows = _events(spark, sf_dir)
    changes = rows.where("kind = 'view'").groupBy("file_id", "channel", "time").agg(F.max("v").alias("patch"))
    notes = rows.where("kind != 'view'").select("file_id", "channel", F.col("time").alias("start"), "event_id")
    return tokens.attach_patches(notes, changes, default=-1).select("event_id", "patch")


def sustained_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views press and release the pedal of their channel; clicks last while it is down."""
    rows = _events(spark, sf_dir)
    pedals = rows.where("kind = 'view'").groupBy("file_id", "channel", "time").agg((F.max("v") * 2).alias("value"))
    notes = rows.where("kind = 'click'").select("file_id", "channel", F.col("time").alias("start"), F.lit(60).cast("long").alias("dur"), "event_id")
    return tokens.apply_sustain(notes, pedals, 90).select("event_id", "dur")


def chord_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each set of pitch classes with the chord class that it is repaired to."""
    return tokens.chord_table(spark)


def _chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.distinct_pitches(tokens.quantize(_notes(spark, sf_dir).withColumn("dur", F.col("dur") * 600), 1800))
    return tokens.repair_chords(tokens.chordify(tokens.rebase(rows)), tokens.chord_table(spark))


def repaired_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half hours as chords, without the notes that their class lacks."""
    return _chords(spark, sf_dir).select("file_id", "start", "chord_id", _text(F.transform("notes", lambda n: n["pitch"])).alias("pitches"))


def token_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_tokens(_chords(spark, sf_dir), max_len=1 << 30).select("file_id", "variant", F.size("tokens").alias("n"), F.md5(_text("tokens").cast("binary")).alias("digest"))


def decoded_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of the token sequences."""
    return tokens.decode_tokens(tokens.encode_tokens(_chords(spark, sf_dir), max_len=1 << 30)).select("file_id", "event", "start", "chord", "pitch", "dur")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("seq_id"), F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.length(w)).alias("tokens"))


def corrupted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths of turns with a share masked, replaced or chosen and left."""
    out = scoring.corrupt(_turns(spark, sf_dir))
    return out.select("seq_id", F.size(F.filter("chosen", lambda c: c)).alias("n_chosen"), F.md5(_text("corrupted").cast("binary")).alias("digest"))


def ended_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words after the first of nine letters become pads."""
    return scoring.mask_after_end(_turns(spark, sf_dir), 9, 719).select("seq_id", F.md5(_text("tokens").cast("binary")).alias("digest"))


def matching_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.most_matching_tokens(_turns(spark, sf_dir), [2, 3, 5], 1 << 30)


def concat_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the first three tokens below 400 that are valid, side by side, as their sum a place."""
    out = pooling.concat_pool(_sequences(spark, sf_dir), list(range(400)), 3, dim=64)
    return out.select("seq_id", F.posexplode("pooled").alias("dim", "value")).withColumn("value", r6("value"))


# -- logits and scores -----------------------------------------------------------------------------

def logit_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the largest component is the label's."""
    rows = _logits(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return scoring.accuracy(rows).select(r6("accuracy").alias("accuracy"))


def binary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logits(spark, sf_dir).select("vec_id", F.get("logits", 0).alias("logit"))
    return scoring.binary_predictions(rows).select("vec_id", r6("prob").alias("prob"), "pred")


def generation_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy, probability and gap of every step, and how like the step before it is."""
    rows = _logits(spark, sf_dir).select(F.floor(F.col("vec_id") / 10).cast("long").alias("batch"), (F.col("vec_id") % 10).alias("step"), (F.col("vec_id") * 37 % 64).cast("int").alias("token"), "logits")
    return scoring.generation_metrics(rows, hidden="logits").select("batch", "step", "metric", r6("value").alias("value"))


def sequence_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities made of first components, as text, with those that underflow."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.least(F.get(doubles("embedding"), 0) * 6000 - 600, F.lit(0.0)).alias("x"))
    rows = rows.withColumn("x", F.when(F.col("x") < -600, F.col("x") - 200).otherwise(F.col("x")))  # none with fewer digits than a double has
    return rows.select("vec_id", L.display_probability(F.exp("x"), F.col("x")).alias("shown"))


def penalised_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logits(spark, sf_dir).withColumn("p", L.repetition_penalty("logits", F.array((F.col("vec_id") % 64).cast("int"), (F.col("vec_id") * 7 % 64).cast("int")), 1.3))
    return rows.select("vec_id", F.posexplode("p").alias("token", "value")).withColumn("value", r6("value"))


def biased_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logits(spark, sf_dir).withColumn("p", L.bias_logits("logits", {3: 1.5, 7: -2.0}, [0, 63], 0.7))
    return rows.select("vec_id", F.posexplode("p").alias("token", "value")).where(F.col("value") > float("-inf")).withColumn("value", r6("value"))


def batch_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval metrics of batches of ten rows, in both directions."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("batch"), (F.col("vec_id") % 10).alias("i"), doubles("embedding").alias("v"))
    other = e.select("batch", F.pmod(F.col("i") - 1, F.lit(10)).alias("j"), F.col("v").alias("w"))
    dot = F.round(F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 9)
    out = balance.contrastive_metrics(e.join(other, "batch").select("batch", "i", "j", dot.alias("sim")), batch=["batch"])
    return out.select("batch", *[r6(c).alias(c) for c in ("recall_at_1", "recall_at_top", "mrr", "f1")])


def batch_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrastive loss of batches of ten rows, each row with the one after it in its batch as its pair."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("batch"), (F.col("vec_id") % 10).alias("i"), doubles("embedding").alias("v"))
    other = e.select("batch", F.pmod(F.col("i") - 1, F.lit(10)).alias("j"), F.col("v").alias("w"))
    dot = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    out = balance.contrastive_loss(e.join(other, "batch").select("batch", "i", "j", dot.alias("sim")), scale=5.0, batch=["batch"])
    return out.select("batch", *[r6(c).alias(c) for c in ("loss_rows", "loss_columns", "loss")])


def share_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the conversations kept by balance have for shares."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", (F.col("role") == "assistant").cast("int").alias("t")))).alias("x"))
    rows = rows.select("conv_id", F.transform("x", lambda x: x["turn"]).alias("tokens"), F.transform("x", lambda x: x["t"]).alias("token_types"))
    return balance.share_stats(balance.balanced_sequences(rows)).select("n", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")])


# -- attribution -----------------------------------------------------------------------------------

def _attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty components of a row as its attention to ten places in two layers of two heads."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("seq_id"), (F.col("vec_id") % 10).cast("int").alias("i"), F.posexplode(F.slice(doubles("embedding"), 1, 40)).alias("d", "x"))
    return e.select("seq_id", F.floor(F.col("d") / 20).cast("int").alias("layer"), (F.floor(F.col("d") / 10) % 2).cast("int").alias("head"), "i", (F.col("d") % 10).alias("j"), F.abs("x").alias("w"))


def attention_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attention_received(_attention(spark, sf_dir)).select("seq_id", "pos", r6("score").alias("score"))


def attention_rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attention_rollout(_attention(spark, sf_dir), 2).select("seq_id", "pos", r6("score").alias("score"))


def occluded_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turn lengths once for each turn left out."""
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("seq_id")).agg(F.sort_array(F.collect_list(F.struct("turn", F.length(F.coalesce("text", F.lit(""))).alias("n")))).alias("x"))
    out = attribution.occluded_variants(rows.select("seq_id", F.transform("x", lambda x: x["n"]).alias("tokens")))
    return out.select("seq_id", "a", _text("tokens").alias("tokens"))


def occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence's first vector is the whole, the others are it with a place left out."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("seq_id"), (F.col("vec_id") % 10).alias("a"), "embedding")
    return attribution.occlusion_scores(e.where("a = 0"), e.where("a > 0")).select("seq_id", "a", r6("score").alias("score"))


def prediction_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logits(spark, sf_dir).select(F.floor(F.col("vec_id") / 10).cast("long").alias("seq_id"), (F.col("vec_id") % 10).alias("a"), (F.col("vec_id") * 37 % 64).cast("int").alias("token"), "logits")
    return attribution.prediction_scores(rows).select("seq_id", "pos", r6("score").alias("score"))


def pair_synergy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("seq_id"), (F.col("vec_id") % 10).alias("a"), doubles("embedding").alias("v"))
    single = e.select("seq_id", "a", F.get("v", 0).alias("score"))
    other = e.select("seq_id", F.col("a").alias("b"), F.get("v", 2).alias("y"))
    pairs = e.join(other, "seq_id").where("a < b").select("seq_id", "a", "b", (F.get("v", 1) + F.col("y")).alias("score"))
    return attribution.pair_synergy(single, pairs).select("seq_id", "pos", r6("score").alias("score"))


def valid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best valid places of every sequence."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("seq_id"), (F.col("vec_id") % 10).alias("pos"), F.get(doubles("embedding"), 0).alias("score"), (F.col("vec_id") % 7 != 0).alias("ok"))
    return search.topk_valid(rows, 3, group="seq_id", position="pos", score="score", valid="ok").select("seq_id", "rank", "pos")


# -- audio -----------------------------------------------------------------------------------------

def int16_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") - 50).alias("value"))
    return audio.to_int16(rows, key=["user_id"]).select("event_id", "sample")


def sample_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each event of a file is played, in samples."""
    return audio.sample_schedule(_opus(spark, sf_dir), rate=1600).select("event_id", "place", "tempo", "wait", "sample")


QUERIES = (midi_round_trip, midi_message_counts, score_opus, mixed_tracks, common_ticks, score_kinds, file_lengths, bank_selects, quantized_notes, piano_notes, distinct_pitch_notes, fixed_durations, transposed_notes, patched_notes,
           sustained_notes, chord_table, repaired_chords, token_streams, decoded_notes, corrupted_tokens, ended_sequences, matching_tokens, concat_pooled, logit_accuracy, binary_scores, generation_signals, sequence_probabilities,
           penalised_logits, biased_logits, batch_losses, batch_retrieval, share_summary, attention_received, attention_rollout, occluded_variants, occlusion, prediction_surprise, pair_synergy, valid_topk, int16_samples, sample_schedule)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
