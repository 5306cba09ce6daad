"""The three ways through the engine: build a corpus, search it with many files, reduce it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaris.operators.events import opus_to_score, patch_changes, pedal_changes, score_to_opus, split_columns, to_milliseconds
from sonaris.operators.pooling import embed_sequences
from sonaris.operators.search import rank_matches, similarity_topk
from sonaris.operators.tokens import apply_sustain, attach_patches, notes_to_tokens
from sonaris.sources.files import copy_manifest, save_embeddings
from sonaris.sources.midi import opus_events, read_midi, write_midi


def midi_to_score(files: DataFrame, **options) -> DataFrame:
    """Files as scores in ticks."""
    return opus_to_score(opus_events(read_midi(files, **options)))


def midi_to_ms_score(files: DataFrame, **options) -> DataFrame:
    """Files as scores in milliseconds."""
    return opus_to_score(to_milliseconds(opus_events(read_midi(files, **options))))


def score_to_midi(score: DataFrame) -> DataFrame:
    """(file_id, content, warnings) of scores with ticks."""
    return write_midi(score_to_opus(score))


def files_to_notes(files: DataFrame, *, content: str = "content", key: str = "path") -> DataFrame:
    """(file_id, start, dur, channel, pitch, velocity, patch) in milliseconds, pedals applied."""
    opus = opus_events(read_midi(files, key=key, content=content), exclude=["sysex_f0", "sysex_f7", "sequencer_specific"])
    score = opus_to_score(to_milliseconds(opus))
    notes = attach_patches(split_columns(score), patch_changes(score))
    return apply_sustain(notes, pedal_changes(score)).drop("track")


def build_corpus(files: DataFrame, factory: Callable, path: str | None = None, *, key: str = "path", token_options: dict | None = None, embed_options: dict | None = None) -> DataFrame:
    """(name, embedding) of every file that gives tokens, in its original key; written if path is given."""
    tokens = notes_to_tokens(files_to_notes(files, key=key), **({"factor": 0} | (token_options or {})))
    vectors = embed_sequences(tokens.where(F.size("tokens") > 0), factory, key="file_id", **(embed_options or {})).withColumnRenamed("file_id", "name")
    if path:
        save_embeddings(vectors, path)
    return vectors


def search_files(files: DataFrame, corpus: DataFrame, factory: Callable, *, key: str = "path", k: int = 16, factor: int = 6, token_options: dict | None = None, embed_options: dict | None = None) -> DataFrame:
    """(file_id, corpus_id, variant, score, place): the best matches of every file over all its transpositions, all
    files in one job. corpus: (corpus_id long, vec)."""
    tokens = notes_to_tokens(files_to_notes(files, key=key), **({"factor": factor} | (token_options or {})))
    # one number for each (file, variant): its hash, which joins back to the pair
    tokens = tokens.where(F.size("tokens") > 0).withColumn("row", F.xxhash64("file_id", "variant"))
    vectors = embed_sequences(tokens, factory, key="row", **(embed_options or {}))
    found = similarity_topk(vectors, corpus, k=k, query_id="row", query_vec="embedding")
    found = found.withColumnRenamed("query_id", "row").join(tokens.select("row", "file_id", "variant"), "row")
    labelled = found.withColumn("query_id", (F.col("variant") + max(1, factor)).cast("long")).drop("variant")
    return rank_matches(labelled, 2 * factor or 1, group=["file_id"])


def discover(files: DataFrame, corpus: DataFrame, names: DataFrame, catalog: DataFrame, factory: Callable, out: str, **options) -> DataFrame:
    """The copy manifest of search_files: which corpus file goes where for each file."""
    matches = search_files(files, corpus, factory, **options)
    named = matches.join(names.select("corpus_id", "name"), "corpus_id", "left")
    return copy_manifest(named, catalog, out).withColumn("found", F.col("src").isNotNull())
