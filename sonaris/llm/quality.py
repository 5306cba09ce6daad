"""Quality rules: counts of each text and cross-document line frequency.

Lines are normalised (A-Z lower-cased, words joined by single spaces) and hashed; for each host the
distinct documents that hold a line are counted, where copies of one text count once, so that a
copied document is left to near-duplicate removal.  A line is *frequent* when its count is above
``min_docs`` and above ``share`` of the host's distinct documents.  Frequent lines are removed, and a
document is *depleted*, so rejected, when fewer than ``left`` of its words remain.  ``share`` is relative
to the host, ``min_docs`` is not: it alone decides for hosts of fewer than ``min_docs / share`` distinct
documents (200 by default), and a host of up to ``min_docs`` never loses a line.  In a large host a line
of many documents stays as long as they are no more than ``share`` of them.

Edge cases: null text counts as empty and fails the base rules (n_words < 50); a null host is a host
of its own; rows keep their doc_id whatever it is, and repeated rows get equal verdicts; an empty
table gives an empty result; further columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaris.llm.bpe import slices
from sonaris.llm.common import store
from sonaris.llm.words import CHUNK_BYTES, PLACES, U64, Words, mix, span_hashes

MIN_DOCS = 10
SHARE = 0.05
LEFT = 0.5
#: Frequent lines that are broadcast at most (8 bytes each); beyond it they are joined by shuffle.
BROADCAST_LINES = 1_000_000
#: Parts over which a frequent line's occurrences are spread in that join.
SALTS = 64

#: The counted symbols, a fixed set.
SYMBOLS = "#*$%&|<>"

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _symbol_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in SYMBOLS]] = True
    return table


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True at every key that occurs twice or more."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _per_doc(docs: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(docs, minlength=n).astype(np.int64)


def text_counts(w: Words) -> dict[str, np.ndarray]:
    """The counts of STATS for every text of a chunk."""
    raw = w.hashes(lower=False)
    keys, at = w.windows(raw, 3)
    docs = w.docs()
    twice = np.zeros(len(raw), bool)
    twice[at] = _repeated(mix(keys + docs[at].astype(U64) * PLACES[3]))
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    start, end, line_doc = w.lines()
    wordy = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, line_doc = start[wordy], end[wordy], line_doc[wordy]
    lines = mix(span_hashes(w.buf, start, end) + line_doc.astype(U64) * PLACES[3])
    distinct = _per_doc(line_doc[np.unique(lines, return_index=True)[1]], w.n)
    leads = (w.buf & 0xC0) != 0x80
    return {
        "n_words": w.count.astype(np.int64),
        "word_chars": w.per_text(leads & ~w.white),
        "n_symbols": w.per_text(_symbol_table()[w.buf]),
        "n_dup_lines": _per_doc(line_doc, w.n) - distinct,
        "n_repeat_words": _per_doc(docs[covered], w.n),
    }


def line_keys(w: Words, hosts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key of host and normalised line, text, first byte, end byte, words) of each line with a word."""
    start, end, doc = w.lines()
    a, b = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    wordy = b > a
    start, end, doc, a, b = start[wordy], end[wordy], doc[wordy], a[wordy], b[wordy]
    keys = mix(span_hashes(w.hashes(lower=True), a, b) + hosts[doc])
    return keys, doc, start, end, b - a


def _host_hashes(column: pa.Array) -> np.ndarray:
    """A 64-bit hash of each host; null is a host too."""
    coded = column.cast(pa.string()).dictionary_encode(null_encoding="encode")
    w = Words(pa.array([f"={x}" if x is not None else "" for x in coded.dictionary.to_pylist()], pa.string()))
    whole = span_hashes(w.buf, w.off[:-1], w.off[1:])
    return whole[coded.indices.to_numpy(zero_copy_only=False)] if len(column) else np.zeros(0, U64)


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


def frequent_lines(df: DataFrame, *, host: str = "source", text: str = "text", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(key long, n_docs long): the lines above the limits, stored. The key is a hash of host and line;
    the host's own count travels as the key of its name, so one pass counts both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", CHUNK_BYTES):
                w = Words(b.column("text"))
                hosts = _host_hashes(b.column("host"))
                copies = span_hashes(w.buf, w.off[:-1], w.off[1:])
                keys, doc, *_ = line_keys(w, hosts)
                rows = np.zeros(len(keys) + w.n, [("key", U64), ("host", U64), ("copy", U64)])
                rows["key"] = np.concatenate([keys, hosts])
                rows["host"] = np.concatenate([hosts[doc], hosts])
                rows["copy"] = np.concatenate([copies[doc], copies])
                once = rows[np.unique(mix(rows["key"] + rows["copy"] * PLACES[1]), return_index=True)[1]]
                yield pa.RecordBatch.from_arrays([_signed(np.ascontiguousarray(once[c])) for c in once.dtype.names], list(once.dtype.names))

    held = df.select(F.col(host).alias("host"), F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, host long, copy long")
    counted = held.groupBy("key", "host").agg(F.countDistinct("copy").alias("n_docs")).where(F.col("n_docs") > min_docs)
    counted = store(counted, "line-counts")
    sizes = counted.where(F.col("key") == F.col("host")).select("host", F.col("n_docs").alias("host_docs"))
    lines = counted.where(F.col("key") != F.col("host")).join(sizes, "host")
    return store(lines.where(F.col("n_docs") > share * F.col("host_docs")).select("key", "n_docs"), "frequent-lines")


def quality_rules(df: DataFrame, *, host: str = "source", text: str = "text", min_docs: int = MIN_DOCS, share: float = SHARE, left: float = LEFT,
                  with_text: bool = True, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """All columns of df, and the counts of STATS, base_failed, n_frequent_words long (words in
    frequent lines), kept boolean and, if asked for, clean_text (the text without frequent lines).

    The frequent lines are broadcast when they are broadcast_lines at most; otherwise each row's own
    are found by a salted shuffle join and the judging pass is the same."""
    spark = df.sparkSession
    frequent = frequent_lines(df, host=host, text=text, min_docs=min_docs, share=share).select("key")
    judged = STATS + ["base_failed", "n_frequent_words", "kept"] + ["clean_text"] * with_text
    own = [c for c in df.columns if c not in judged]
    frame = df.select(*own, F.col(host).cast("string").alias("__host"), F.col(text).cast("string").alias("__text"))
    if small := frequent.count() <= broadcast_lines:
        known = spark.sparkContext.broadcast(np.sort(np.array([r.key for r in frequent.collect()], np.int64).view(U64)))
        frame = frame.withColumn("__lines", F.lit(None).cast("array<long>"))
    else:
        known = None
        frame = _with_own_lines(frame, frequent)
    types = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    fields = [f"`{c}` {types[c]}" for c in own]
    fields += [f"{c} long" for c in STATS] + ["base_failed boolean", "n_frequent_words long", "kept boolean"] + ["clean_text string"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "__text", CHUNK_BYTES):
                w = Words(b.column("__text"))
                counts = text_counts(w)
                keys, doc, start, end, words = line_keys(w, _host_hashes(b.column("__host")))
                if small:
                    hit = _member(keys, known.value)
                else:
                    lists = b.column("__lines")
                    mine = np.sort(pc.list_flatten(lists).to_numpy(zero_copy_only=False).view(U64))
                    hit = _member(keys, mine)  # a key holds its host, so another row's key does no harm
                gone = np.bincount(doc[hit], weights=words[hit], minlength=w.n).astype(np.int64)
                n, rep = counts["n_words"], counts["n_repeat_words"]
                failed = (n < 50) | (100 * rep > 50 * n)
                kept = ~failed & ((n - gone) >= left * n)
                cols = [b.column(c) for c in own] + [pa.array(counts[c]) for c in STATS] + [pa.array(failed), pa.array(gone), pa.array(kept)]
                if with_text:
                    cols.append(_without(b.column("__text"), w, doc[hit], start[hit], end[hit]))
                yield pa.RecordBatch.from_arrays(cols, own + judged)

    return frame.mapInArrow(run, ", ".join(fields))


def _member(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _without(texts: pa.Array, w: Words, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts without those lines and their line feeds; untouched texts as they were."""
    if not len(doc):
        return texts
    out = texts.to_pylist()
    for i in np.unique(doc):
        raw, base = w.buf[w.off[i] : w.off[i + 1]].tobytes(), w.off[i]
        gone = set((start[doc == i] - base).tolist())
        at, left = 0, []
        for line in raw.split(b"\n"):
            if at not in gone:
                left.append(line)
            at += len(line) + 1
        out[i] = b"\n".join(left).decode()
    return pa.array(out, pa.string())


def _with_own_lines(frame: DataFrame, frequent: DataFrame) -> DataFrame:
    """__lines: the frequent keys that each row holds, through an equi-join spread over SALTS parts."""
    row = F.xxhash64(F.coalesce(F.col("__host"), F.lit("")), F.coalesce(F.col("__text"), F.lit("")))
    frame = frame.withColumn("__row", row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "__text", CHUNK_BYTES):
                w = Words(b.column("__text"))
                keys, doc, *_ = line_keys(w, _host_hashes(b.column("__host")))
                rows = b.column("__row").to_numpy(zero_copy_only=False)[doc]
                yield pa.RecordBatch.from_arrays([pa.array(rows), _signed(keys)], ["__row", "key"])

    held = frame.select("__row", "__host", "__text").mapInArrow(run, "__row long, key long").distinct()
    held = held.withColumn("salt", F.pmod("__row", F.lit(SALTS)).cast("int"))
    spread = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = held.join(spread, ["key", "salt"], "left_semi").groupBy("__row").agg(F.collect_set("key").alias("__lines"))
    return frame.join(found, "__row", "left").withColumn("__lines", F.coalesce("__lines", F.array().cast("array<long>"))).drop("__row")
