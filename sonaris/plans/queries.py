"""Registered queries over the test tables, and the DuckDB SQL of each.

The tables stand in for the engine's own: `embeddings` for corpora, token vectors and logits, `events` for
timed events (a user is a channel or track, an event type a kind), `conversations` and `documents` for
sequences, `labels` for classes. Derived columns say how.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonaris.functions import logits as L
from sonaris.functions.vectors import doubles, unit
from sonaris.operators import attribution, audio, balance, events, pooling, reduce, scoring, search, tokens
from sonaris.streaming.incremental import windowed_notes

WEIGHTS = {(0, 128): 1.0, (128, 256): 2.0, (256, 384): 0.5, (384, 720): 1.5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded for comparison; zero has no sign."""
    return (F.round(c, 6) + F.lit(0.0))


# -- search ----------------------------------------------------------------------------------------

def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose id is divisible by 20 as queries, and all rows."""
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("vec"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 nearest rows by cosine of every row whose id is divisible by 20."""
    return search.similarity_topk(*_vectors(spark, sf_dir)).withColumn("sim", r6("sim"))


def dot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by inner product."""
    return search.similarity_topk(*_vectors(spark, sf_dir), normalize=False).withColumn("sim", r6("sim"))


def knn_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other rows of every row."""
    return search.knn_self(table(spark, sf_dir, "embeddings"), max_broadcast=search.MAX_BROADCAST).withColumn("sim", r6("sim"))


def knn_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of another label for every row."""
    e = table(spark, sf_dir, "embeddings")
    found = search.similarity_topk(e, e, k=5, query_id="vec_id", corpus_id="vec_id", query_vec="embedding", corpus_vec="embedding", apart="label")
    return found.withColumn("sim", r6("sim"))


def variant_ranked_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every piece's 12 transpositions against the corpus, best match of each row, ranked and named by
    piece. A row whose id is divisible by 20 begins a piece; it and the 11 ids after it are its transpositions."""
    e = table(spark, sf_dir, "embeddings")
    _, corpus = _vectors(spark, sf_dir)
    found = search.similarity_topk(e.where("vec_id % 20 < 12").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), corpus)
    found = found.withColumn("piece", F.col("query_id") - F.col("query_id") % 20).withColumn("query_id", F.col("query_id") % 20)
    ranked = search.rank_matches(found, 12, group=["piece"])
    names = e.select(F.col("vec_id").alias("corpus_id"), F.concat(F.lit("piece-"), F.col("vec_id").cast("string")).alias("name"))
    return search.name_matches(ranked, names, group=["piece"]).select("piece", "place", "name", "variant", r6("score").alias("score"))


def underfull_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 places for every row whose id is divisible by 20; where there are fewer rows, the rest hold -1 and -inf
    (shown as null)."""
    q, c = _vectors(spark, sf_dir)
    out = search.fill_slots(search.similarity_topk(q, c, k=64), q, 64)
    return out.withColumn("sim", F.when(F.col("sim") == float("-inf"), None).otherwise(r6("sim")))


def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bent and clipped similarities of every row whose id is divisible by 20 with all rows."""
    e = table(spark, sf_dir, "embeddings")
    return search.similarity_heatmap(e, queries=e.where("vec_id % 20 = 0")).select("a", "b", r6("sim").alias("sim"), r6("shown").alias("shown"))


def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 20 should find, among all other rows, the one 250 above it, counted on
    from 0 beyond the last."""
    q, c = _vectors(spark, sf_dir)
    truth = q.select("query_id", ((F.col("query_id") + 250) % F.lit(c.count())).alias("corpus_id"))
    m = search.retrieval_metrics(search.similarity_topk(q, c, k=5, exclude_self=True), truth)
    return m.select(*[r6(x).alias(x) for x in m.columns])


# -- sequences -------------------------------------------------------------------------------------

def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.floor(F.col("vec_id") / 10).cast("long").alias("seq_id"), (F.col("vec_id") % 10).cast("int").alias("pos"), (F.col("vec_id") * 37 % 720).cast("int").alias("token"), F.col("embedding").alias("vec"), (F.col("vec_id") % 7 != 0).alias("valid"))
    return pooling.gather_sequences(rows)


def _long(df: DataFrame, key: str = "seq_id", value: str = "pooled") -> DataFrame:
    return df.select(key, F.posexplode(value).alias("dim", "value")).withColumn("value", r6("value"))


def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(pooling.mean_pool(_sequences(spark, sf_dir), dim=64))


def weighted_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(pooling.weighted_mean_pool(_sequences(spark, sf_dir), WEIGHTS, dim=64))


def aggregated_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(pooling.aggregated_pool(_sequences(spark, sf_dir), WEIGHTS, dim=64))


def selected_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over tokens below 100 that are multiples of 37, or over all."""
    return _long(pooling.selected_mean_pool(_sequences(spark, sf_dir), [0, 37, 74], dim=64))


def pad_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths of turns as tokens, padded to the longest of the table."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.length(w)).alias("tokens"))
    out = pooling.pad_and_mask(rows)
    return out.select("conv_id", "turn", F.array_join("padded", " ").alias("padded"), F.size(F.filter("mask", lambda m: m)).alias("n_valid"))


def ngram_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random n-gram masking of the documents' word lengths (reproducible from SHA-256)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.length(w)).alias("tokens"))
    out = tokens.ngram_replace(rows, key="doc_id")
    return out.select("doc_id", F.size(F.filter("masked", lambda t: t == tokens.MASK)).alias("n_masked"), F.md5(F.array_join("masked", " ").cast("binary")).alias("digest"))


def char_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The character codes of whole turns."""
    out = tokens.char_tokens(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", F.array_join("tokens", " ").alias("tokens"))


# -- events ----------------------------------------------------------------------------------------

def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as tracks of files of ten users; clicks begin and purchases end notes."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.floor(F.col("user_id") / 10).cast("string").alias("file_id"), F.col("user_id").cast("int").alias("track"), (F.row_number().over(order) - 1).cast("long").alias("seq"),
                    F.col("event_type").alias("kind"), F.unix_timestamp("ts").alias("time"), (F.col("user_id") % 12).cast("int").alias("channel"), F.floor("value").cast("int").alias("v"), "event_id", "value")


def delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.delta_times(_events(spark, sf_dir))
    return out.select("event_id", "track", "seq", F.col("time").alias("delta"))


def absolute_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas summed up again: the round trip gives the times back."""
    out = events.absolute_times(events.delta_times(_events(spark, sf_dir)))
    return out.select("event_id", "time")


def fifo_note_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks paired with purchases of their user, first in first out."""
    rows = _events(spark, sf_dir).where("kind IN ('click', 'purchase')")
    rows = rows.withColumn("event", F.when(F.col("kind") == "click", "note_on").otherwise("note_off")).withColumn("a", F.lit(60)).withColumn("b", F.lit(64))
    notes = events.opus_to_score(events.delta_times(rows))
    return events.split_columns(notes).select("track", "start", "dur").where(F.col("dur").isNotNull())


def grep_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.keep_channels(_events(spark, sf_dir), [0, 3, 7]).select("event_id", "channel", "time")


def _score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    name = F.when(F.col("kind") == "signup", "set_tempo").when(F.col("kind") == "view", "patch_change").when(F.col("kind") == "error", "control_change").otherwise("note")
    return rows.withColumn("event", name).withColumn("dur", F.when(F.col("event") == "note", F.lit(5).cast("bigint"))).withColumn("a", F.col("v") % 128).withColumn("b", F.lit(64))


def time_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's events after the first 100000 seconds moved 600 seconds to the right."""
    rows = _score(spark, sf_dir)
    rows = rows.withColumn("time", F.col("time") - F.min("time").over(Window.partitionBy("file_id")))
    return events.time_shift(rows, shift=600, from_time=100_000).select("event_id", "time")


def segment_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span of the score, with the tempo, patches and controllers that hold at its start."""
    rows = _score(spark, sf_dir)
    rows = rows.withColumn("time", F.col("time") - F.min("time").over(Window.partitionBy("file_id"))).drop("event_id", "value", "kind", "v")
    return events.segment(rows, 500_000, 900_000).select("file_id", "track", "event", "time", "channel", "a", "restored")


def concat_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a score, played one user after another."""
    rows = _score(spark, sf_dir)
    rows = rows.withColumn("time", F.col("time") - F.min("time").over(Window.partitionBy("track")))
    return events.concatenate_scores(rows, order="track").select("event_id", "time")


def mix_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.mix_scores(_score(spark, sf_dir).withColumn("ordinal", F.col("track"))).select("event_id", "track", "seq")


def merge_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's two scores (its first and last five users) of the same channels 0-4, merged."""
    place = F.col("track") % 10
    rows = _score(spark, sf_dir).withColumn("ordinal", F.floor(place / 5).cast("int")).withColumn("channel", (place % 5).cast("int"))
    return events.merge_scores(rows, group=["file_id"]).select("event_id", "channel")


def tempo_to_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups set the tempo; all other deltas in milliseconds."""
    rows = _score(spark, sf_dir).where("event != 'patch_change'").withColumn("a", F.when(F.col("event") == "set_tempo", 250_000 + F.col("v") * 1000).otherwise(F.col("a")).cast("int")).withColumn("ticks", F.lit(96))
    rows = events.delta_times(rows.withColumn("time", F.col("time") - F.min("time").over(Window.partitionBy("file_id"))))
    return events.to_milliseconds(rows).where("event_id IS NOT NULL").select("event_id", F.col("time").alias("ms"))


def event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.score_stats(_score(spark, sf_dir))
    text = lambda m: F.array_join(F.transform(F.sort_array(F.map_entries(m)), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    return out.select("file_id", "nticks", "num_notes", text("notes_by_channel").alias("notes_by_channel"), F.array_join(F.transform("channels", lambda c: c.cast("string")), ",").alias("channels"), "pitch_range_sum")


def chord_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of an hour as a chord: its pitch classes and number of notes."""
    rows = _events(spark, sf_dir).select("file_id", F.floor(F.col("time") / 3600).cast("long").alias("start"), F.lit(1).cast("long").alias("dur"), F.pmod(F.col("v"), F.lit(128)).cast("int").alias("pitch"), F.lit(64).alias("velocity"))
    chords = tokens.chordify(rows)
    return chords.select("file_id", "start", F.size("notes").alias("n"), tokens.pitch_class_mask(F.transform("notes", lambda n: n["pitch"])).alias("mask"))


def content_hash_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one normalised content (lower case, single spaces), where there are several."""
    norm = F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n]+", " ")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(norm.cast("binary")).alias("hash"))
    return rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def audio_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") - 50).alias("value"))
    out = audio.normalize_audio(rows, key=["user_id"], method="rms", level_db=-20.0)
    return out.select("event_id", r6("normalized").alias("normalized"))


def audio_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return audio.trim_silence(rows, key=["user_id"], pos="event_id", threshold=3.0).select("event_id")


def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowed_notes(table(spark, sf_dir, "events"), window="1 hour")
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", r6("total").alias("total"))


# -- reduction -------------------------------------------------------------------------------------

def pca_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covariance from merged moments, upper triangle."""
    n, _, scatter = reduce.moments(table(spark, sf_dir, "embeddings"))
    cov = scatter / (n - 1)
    rows = [(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(i, len(cov))]
    return spark.createDataFrame(rows, "i int, j int, cov double").withColumn("cov", F.round("cov", 9) + F.lit(0.0))


def pca_explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(component, explained, cumulative) of the first 16 components."""
    r = reduce.pca(table(spark, sf_dir, "embeddings"), 16)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(r.explained_variance_ratio, r.cumulative_variance))]
    return spark.createDataFrame(rows, "component int, explained double, cumulative double")


def pca_reduced_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared length of every row in all 64 components: that of the centred row."""
    r = reduce.pca(table(spark, sf_dir, "embeddings"), 64)
    return r.reduced.select("vec_id", F.round(F.aggregate(doubles("reduced"), F.lit(0.0), lambda s, x: s + x * x), 4).alias("square"))


# -- logits ----------------------------------------------------------------------------------------

def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(doubles("embedding"), lambda x: x * 10).alias("logits"))


def softmax_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir).select("vec_id", r6(L.entropy("logits")).alias("entropy"), r6(F.array_max(L.softmax("logits"))).alias("top_prob"), L.argmax("logits").alias("top_token"))


def _kept(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    rows = _logits(spark, sf_dir).withColumn("f", L.filter_logits(name, "logits", **options))
    kept = F.filter(F.transform("f", lambda v, i: F.struct(i.alias("i"), (v > float("-inf")).alias("k"))), lambda x: x["k"])
    return rows.select("vec_id", F.array_join(F.transform(kept, lambda x: x["i"].cast("string")), ",").alias("kept"))


def filter_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "top_k", frac=0.1)


def filter_top_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "top_p", thres=0.9)


def filter_top_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "top_a", power=2.0, ratio=0.2)


def filter_min_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "min_p", min_p=0.1)


def contrastive_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row as the expert, the row after it as the amateur."""
    a = _logits(spark, sf_dir)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("logits").alias("amateur"))
    rows = a.join(b, "vec_id").withColumn("f", L.contrastive("logits", "amateur"))
    return rows.select("vec_id", F.posexplode("f").alias("token", "value")).where(F.col("value") > float("-inf")).withColumn("value", r6("value"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logits(spark, sf_dir).select(F.floor(F.col("vec_id") / 10).cast("long").alias("seq_id"), (F.col("vec_id") % 10).alias("pos"), (F.col("vec_id") * 37 % 64).cast("int").alias("token"), "logits")
    return scoring.position_scores(rows)


def sequence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.sequence_metrics(_scored(spark, sf_dir))
    return out.select("seq_id", "n", *[r6(c).alias(c) for c in ("total_log_prob", "avg_log_prob", "avg_log_prob_bits", "geometric_mean_prob", "perplexity", "accuracy")])


def metric_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as a metric of their type: far from its mean, or beyond its limits."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), F.col("event_id").alias("step"), F.col("event_type").alias("metric"), "value")
    out = scoring.analyze_metrics(rows, limits={"click": (None, 150.0)})
    return out.where("anomaly IS NOT NULL").select("step", "metric", "anomaly", r6("z").alias("z"))


def metric_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("metric"), "value")
    out = scoring.metric_summary(rows)
    return out.select("metric", *[r6(c).alias(c) for c in ("mean", "min", "max", "std", "first_half", "second_half")])


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    pick = lambda name, i: F.struct(F.lit(name).alias("signal"), F.get("embedding", F.lit(i)).cast("double").alias("score"))
    return e.select(F.floor(F.col("vec_id") / 10).cast("long").alias("seq_id"), (F.col("vec_id") % 10).cast("int").alias("pos"), F.explode(F.array(pick("occlusion", 0), pick("prediction", 1), pick("attention", 2))).alias("s")).select("seq_id", "pos", "s.*")


def signal_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attribution.borda(attribution.minmax(_signals(spark, sf_dir), group=["seq_id", "signal"]), group=["seq_id", "signal"])
    return rows.select("seq_id", "pos", "signal", r6("scaled").alias("scaled"), "points")


def fused_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.fuse(_signals(spark, sf_dir)).select("seq_id", "pos", r6("fused").alias("fused"))


# -- classes ---------------------------------------------------------------------------------------

def balanced_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose share of assistant turns is within 0.1 of one half."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", (F.col("role") == "assistant").cast("int").alias("t")))).alias("x"))
    rows = rows.select("conv_id", F.transform("x", lambda x: x["turn"]).alias("tokens"), F.transform("x", lambda x: x["t"]).alias("token_types"))
    return balance.balanced_sequences(rows).select("conv_id", r6(F.col("share").cast("double")).alias("share"))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") % 16).alias("g")).agg(F.collect_list("label").alias("labels"))
    return balance.class_weights(balance.class_counts(rows, "labels", 12)).select("label", "n", r6("weight").alias("weight"))


def focal_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.transform(doubles("embedding"), lambda x: x * 10).alias("logits"), F.col("label").alias("target"))
    return balance.focal_loss(rows).select(r6("loss").alias("loss"))


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(doubles("embedding"), lambda x: x * 3 + 1).alias("v"))
    return _long(rows.select("vec_id", unit("v").alias("pooled")), "vec_id")


QUERIES = (cosine_topk, dot_topk, knn_self, knn_pairwise, variant_ranked_matches, underfull_topk, heatmap, retrieval_quality, mean_pool, weighted_mean_pool, aggregated_pool, selected_mean_pool, pad_mask, ngram_mask,
           char_tokens, delta_encode, absolute_times, fifo_note_pairs, grep_channels, time_shift, segment_restore, concat_scores, mix_scores, merge_channels, tempo_to_ms, event_stats, chord_classes, content_hash_dupes,
           audio_normalize, audio_trim, windowed_counts, pca_covariance, pca_explained_variance, pca_reduced_norms, softmax_entropy, filter_top_k, filter_top_p, filter_top_a, filter_min_p, contrastive_logits, sequence_scores,
           metric_anomalies, metric_drift, signal_ranks, fused_attribution, balanced_filter, class_weights, focal_loss, unit_vectors)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
