"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent n-grams (one to three letters, words padded by a space, lower
case), most frequent first.  A document is given the language whose profile has the smallest
out-of-place distance: the sum over the document's own profile of how far each n-gram's rank is from
its rank in the language's profile, ``profile`` where it is absent.  The score is one minus that
distance over its maximum.

Profiles are learned from the whole texts of all labelled documents that aren't held out; a
document's prediction uses nothing but its whole text.  keep_known_languages rejects scores below a
limit of each language, which comes from the same documents: ``MARGIN`` of the score that all but
``LOWEST`` of them exceed, in whole steps of ``1 / STEPS``, ``MIN_SCORE`` at least.

Edge cases: a null text, or one without any letter, is ``und`` with score 0; so is everything when no
labelled document exists; ties go to the smaller language name, equal frequencies to the smaller
n-gram; rows whose key is null count as held out; repeated rows get equal results; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaris.llm.bpe import slices

#: Length of a profile.
PROFILE = 300
#: Scores are rejected below MARGIN of this quantile of the scores of a language's labelled documents.
LOWEST, MARGIN = 0.01, 0.7
#: For that quantile, scores are counted by whole steps, so that its tables don't grow with the input.
STEPS = 10_000
#: The least limit: words of random letters score up to 0.22 from 20 words on.
MIN_SCORE = 0.25
UNKNOWN = "und"
CHUNK_BYTES = 1 << 20
MAX_ROWS = 60_000
#: N-grams that a task sums before it passes them on.
HELD_GRAMS = 200_000

_SPACE = 32


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Each code point's symbol: itself for letters, one symbol for all letters beyond the basic
    plane, a space for everything else."""
    out = np.full(sys.maxunicode + 1, _SPACE, np.uint16)
    letters = np.array([i for i in range(sys.maxunicode + 1) if chr(i).isalpha()])
    out[letters] = np.minimum(letters, 0xFFFF)
    return out


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count) of every text's distinct n-grams, ordered by text and n-gram."""
    joined = "\0".join(t.replace("\0", " ") for t in texts).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.cumsum(points == 0)
    sym = _symbols()[points]
    gap = sym == _SPACE
    keep = np.ones(len(sym), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    pad = np.array([_SPACE], np.uint64)
    s = np.concatenate([pad, sym[keep].astype(np.uint64), pad])
    d = np.concatenate([[0], doc[keep], [len(texts) - 1]]).astype(np.uint64)
    word = s != _SPACE
    one = (d[word] << np.uint64(48)) | s[word]
    two = word[:-1] | word[1:]
    owner = np.where(word[:-1], d[:-1], d[1:])[two]
    pairs = (owner << np.uint64(48)) | ((s[:-1] << np.uint64(16)) | s[1:])[two]
    mid = word[1:-1]
    three = (d[1:-1][mid] << np.uint64(48)) | ((s[:-2] << np.uint64(32)) | (s[1:-1] << np.uint64(16)) | s[2:])[mid]
    keys = np.sort(np.concatenate([one, pairs, three]))
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(first, len(keys)))
    return (keys[first] >> np.uint64(48)).astype(np.int64), keys[first] & np.uint64((1 << 48) - 1), counts


def ranked(doc: np.ndarray, grams: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, rank from 0) of each text's most frequent n-grams; equal counts by n-gram."""
    order = np.argsort((doc << 32) | ((1 << 32) - 1 - np.minimum(counts, (1 << 32) - 1)), kind="stable")
    doc, grams = doc[order], grams[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    top = rank < size
    return doc[top], grams[top], rank[top]


class Profiles:
    """Languages in order of their names, each with its n-grams sorted and their ranks."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int) -> None:
        self.size = size
        self.names = sorted({r[0] for r in rows})
        self.grams, self.ranks = [], []
        for name in self.names:
            own = sorted((g, rank) for lang, g, rank in rows if lang == name)
            self.grams.append(np.array([g for g, _ in own], np.uint64))
            self.ranks.append(np.array([r for _, r in own], np.int64))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        doc, grams, rank = ranked(*ngram_counts(texts), self.size)
        n = len(texts)
        if not self.names:
            return [UNKNOWN] * n, np.zeros(n)
        found = np.bincount(doc, minlength=n)
        best, at = np.full(n, np.inf), np.zeros(n, np.int64)
        for k, (own, ranks) in enumerate(zip(self.grams, self.ranks)):
            i = np.minimum(np.searchsorted(own, grams), len(own) - 1)
            off = np.where(own[i] == grams, np.abs(ranks[i] - rank), self.size)
            total = np.bincount(doc, weights=off, minlength=n)
            closer = total < best
            best[closer], at[closer] = total[closer], k
        some = found > 0
        score = np.where(some, 1 - best / np.maximum(found * self.size, 1), 0.0).clip(0, 1)
        return [self.names[k] if ok else UNKNOWN for k, ok in zip(at, some)], score


def held_out(key: str = "doc_id") -> Column:
    """The fifth of all documents from which nothing is learned."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _parts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, text, CHUNK_BYTES):
            for at in range(0, b.num_rows, MAX_ROWS):
                yield b.slice(at, MAX_ROWS)


def _added(grams: np.ndarray, counts: np.ndarray, more: np.ndarray, more_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of both with the sums of their counts."""
    own, back = np.unique(np.concatenate([grams, more]), return_inverse=True)
    sums = np.zeros(len(own), np.int64)
    np.add.at(sums, back, np.concatenate([counts, more_counts]))
    return own, sums


def _labelled(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, lang, text) of all documents that are learned from."""
    known = df.where(~held_out(key) & F.col(lang).isNotNull())
    return known.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))


def learn_profiles(df: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles from all labelled documents that aren't held out. What is collected is bounded by
    the number of languages times the profile's length."""
    return _profiles(_labelled(df, key, text, lang), size)


def _profiles(known: DataFrame, size: int) -> Profiles:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in _parts(batches, "text"):
            names = np.array(b.column("lang").to_pylist(), object)
            for name in sorted(set(names)):
                texts = [t for t, keep in zip(b.column("text").to_pylist(), names == name) if keep and t]
                _, grams, counts = ngram_counts([" ".join(texts)])
                held[name] = _added(*held[name], grams, counts) if name in held else (grams, counts)
            if sum(len(grams) for grams, _ in held.values()) > HELD_GRAMS:
                yield from rows(held)
                held = {}
        yield from rows(held)

    def rows(held: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for name, (grams, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    sums = known.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = sums.withColumn("rank", rank).where(F.col("rank") <= size).collect()
    return Profiles([(r.lang, r.gram, r["rank"] - 1) for r in rows], size)


def identify_language(df: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", size: int = PROFILE, profiles: Profiles | None = None) -> DataFrame:
    """All columns of df, held_out boolean, lang_pred string and score double (0 to 1)."""
    model = df.sparkSession.sparkContext.broadcast(profiles or learn_profiles(df, key=key, text=text, lang=lang, size=size))
    made = ["held_out", "lang_pred", "score"]
    own = [c for c in df.columns if c not in made]
    frame = df.select(*own, held_out(key).alias("held_out"), F.col(text).cast("string").alias("__text"))
    fields = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in own) + ", held_out boolean, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, "__text"):
            names, score = model.value.predict([t or "" for t in b.column("__text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in [*own, "held_out"]] + [pa.array(names, pa.string()), pa.array(score)], [*own, *made])

    return frame.mapInArrow(run, fields)


def _limits(known: DataFrame, profiles: Profiles) -> dict[str, float]:
    """Each language's least score, from all documents labelled with it and found to be of it."""
    judged = identify_language(known, key="key", profiles=profiles).where("lang = lang_pred")
    counts = judged.groupBy("lang", F.floor(F.col("score") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy("lang").agg(F.percentile("step", F.lit(LOWEST), F.col("n")).alias("low")).collect()  # one number for each language
    return {r.lang: max(MIN_SCORE, MARGIN * r.low / STEPS) for r in rows}


def keep_known_languages(df: DataFrame, *, min_score: float | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", size: int = PROFILE, profiles: Profiles | None = None) -> DataFrame:
    """df without the documents whose language is unknown or scored below min_score, by default below the
    limit of the language that they are given."""
    limit = F.lit(MIN_SCORE if min_score is None else min_score)
    profiles = profiles or learn_profiles(df, key=key, text=text, lang=lang, size=size)
    if min_score is None:
        found = _limits(_labelled(df, key, text, lang), profiles)
        if found:
            limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in sorted(found.items()) for x in item]), F.col("lang_pred")), limit)
    judged = identify_language(df, key=key, text=text, lang=lang, size=size, profiles=profiles)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= limit)).select(*df.columns)
