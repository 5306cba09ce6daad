"""Notes to token sequences and back.

Notes are rows (file_id, start, dur, channel, pitch, velocity, patch).  A chord is all notes of one
onset.  Token layout: 0-127 time since the previous chord, 129-255 pitch + 128, 257-383 duration + 256,
384-395 pitch class of a lone note + 384, 396 and above chord class + 396.

The chord classes and the instruments to keep are parameters.  The default chord table is made by a
rule: every set of pitch classes without two neighbours on the circle of twelve, in lexicographic
order, 321 in all.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_LEN, TRANSPOSE = 3072, 6
PITCH, DURATION, SINGLE, CHORD = 128, 256, 384, 396
MASK = 718


def default_chords() -> list[tuple[int, ...]]:
    found = []
    for n in range(1, 7):
        for c in combinations(range(12), n):
            ring = [*c, c[0] + 12]
            if all(b - a > 1 for a, b in zip(ring, ring[1:])):
                found.append(c)
    return sorted(found)


def _bits(classes) -> int:
    return sum(1 << c for c in classes)


def chord_table(spark: SparkSession, chords: list[tuple[int, ...]] | None = None) -> DataFrame:
    """(mask, chord_id, chord_mask) for each of the 4095 sets of pitch classes: the set itself if the
    table has it, else its largest subset that the table has, ties to the first in the table's order.
    Both null if it has none."""
    chords = chords if chords is not None else default_chords()
    ranked = sorted(enumerate(chords), key=lambda x: (-len(x[1]), x[0]))
    masks = [(i, _bits(c)) for i, c in ranked]
    rows = [(m, *next(((i, own) for i, own in masks if own & m == own), (None, None))) for m in range(1, 4096)]
    return spark.createDataFrame(rows, "mask int, chord_id int, chord_mask int")


# -- note preparation ------------------------------------------------------------------------------

def attach_patches(notes: DataFrame, patches: DataFrame, default: int = 0) -> DataFrame:
    """notes with the patch of the last change (file_id, channel, time, patch) at or before their start."""
    changes = patches.select("file_id", "channel", F.col("time").alias("t"), F.lit(0).alias("k"), F.col("patch").cast("int").alias("p"))
    own = notes.drop("patch")
    rows = own.select("file_id", "channel", F.col("start").alias("t"), F.lit(1).alias("k"), F.lit(None).cast("int").alias("p"), F.struct(*own.columns).alias("row"))
    both = changes.withColumn("row", F.lit(None).cast(rows.schema["row"].dataType)).unionByName(rows)
    last = F.last("p", ignorenulls=True).over(Window.partitionBy("file_id", "channel").orderBy("t", "k").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("patch", F.coalesce(last, F.lit(default)).cast("int")).where("k = 1").select("row.*", "patch")


def apply_sustain(notes: DataFrame, pedals: DataFrame, threshold: int = 64) -> DataFrame:
    """Notes that end while the pedal (file_id, channel, time, value) is down last until it comes up, or
    until the channel's last note end."""
    w = Window.partitionBy("file_id", "channel").orderBy("time")
    down = F.col("value") >= threshold
    turns = pedals.withColumn("d", down).withColumn("was", F.coalesce(F.lag("d").over(w), F.lit(False))).where("d != was")
    spans = turns.withColumn("until", F.lead("time").over(w)).where("d").select("file_id", "channel", F.col("time").alias("t"), "until")
    ends = notes.withColumn("end", F.col("start") + F.col("dur"))
    last = F.max("end").over(Window.partitionBy("file_id", "channel"))
    own = ends.withColumn("final", last)
    rows = own.select("file_id", "channel", F.col("end").alias("t"), F.lit(1).alias("k"), F.lit(None).cast("struct<u:bigint>").alias("span"), F.struct(*own.columns).alias("row"))
    marks = spans.select("file_id", "channel", "t", F.lit(0).alias("k"), F.struct(F.col("until").cast("bigint").alias("u")).alias("span"))
    ups = turns.where("NOT d").select("file_id", "channel", F.col("time").alias("t"), F.lit(0).alias("k"), F.struct(F.lit(-1).cast("bigint").alias("u")).alias("span"))
    both = rows.unionByName(marks.unionByName(ups).withColumn("row", F.lit(None).cast(rows.schema["row"].dataType)))
    at = F.last("span", ignorenulls=True).over(Window.partitionBy("file_id", "channel").orderBy("t", "k").rowsBetween(Window.unboundedPreceding, 0))
    held = both.withColumn("at", at).where("k = 1")
    until = F.when(F.col("at").isNull() | (F.col("at.u") == -1), F.col("row.end")).otherwise(F.coalesce("at.u", "row.final"))
    return held.select("row.*", until.alias("__until")).withColumn("dur", F.greatest("dur", F.col("__until") - F.col("start"))).select(*notes.columns)


def quantize(notes: DataFrame, divider: int = 32) -> DataFrame:
    """Times over the divider, rounded half to even."""
    return notes.withColumn("start", F.bround(F.col("start") / divider).cast("long")).withColumn("dur", F.bround(F.col("dur") / divider).cast("long"))


def keep_instruments(notes: DataFrame, patches: list[int] | DataFrame) -> DataFrame:
    """Notes whose patch is in the list, or in the table's rows with keep."""
    if isinstance(patches, DataFrame):
        return notes.join(patches.where("keep").select("patch"), "patch", "left_semi").select(*notes.columns)
    return notes.where(F.col("patch").isin(*patches))


def solo_piano(notes: DataFrame) -> DataFrame:
    """All but drums, as patch 0 of channel 0."""
    return notes.where("channel != 9").withColumn("patch", F.lit(0)).withColumn("channel", F.lit(0))


def distinct_pitches(notes: DataFrame) -> DataFrame:
    """One note of each (onset, pitch): the longest, then the loudest."""
    w = Window.partitionBy("file_id", "start", "pitch").orderBy(F.desc("dur"), F.desc("velocity"), "channel")
    return notes.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def fix_durations(notes: DataFrame, gap: int = 0) -> DataFrame:
    """Cuts a note at the next onset of its pitch, less the gap; at least 1."""
    following = F.lead("start").over(Window.partitionBy("file_id", "pitch").orderBy("start"))
    return notes.withColumn("dur", F.when(following.isNull(), F.col("dur")).otherwise(F.greatest(F.lit(1), F.least("dur", following - F.col("start") - gap))).cast("long"))


def rebase(notes: DataFrame) -> DataFrame:
    """Times from the file's first onset."""
    return notes.withColumn("start", F.col("start") - F.min("start").over(Window.partitionBy("file_id")))


def transpose_variants(notes: DataFrame, factor: int = TRANSPOSE) -> DataFrame:
    """Each note once for each variant -factor .. factor-1 (factor 0 to 6; 0: the variant 0 alone)."""
    factor = max(0, min(6, factor))
    steps = list(range(-factor, factor)) or [0]
    return notes.withColumn("variant", F.explode(F.array(*map(F.lit, steps)))).withColumn("pitch", F.col("pitch") + F.col("variant"))


# -- chords and tokens -----------------------------------------------------------------------------

def pitch_class_mask(pitches: Column) -> Column:
    return F.aggregate(F.array_distinct(F.transform(pitches, lambda p: F.pmod(p, F.lit(12)).cast("int"))), F.lit(0), lambda s, p: s + F.pow(F.lit(2), p).cast("int"))


def chordify(notes: DataFrame) -> DataFrame:
    """(file_id, variant, start, notes array<struct<pitch, dur, velocity>> by falling pitch)."""
    note = F.struct((-F.col("pitch")).alias("order"), F.col("pitch").cast("int").alias("pitch"), F.col("dur").cast("long").alias("dur"), F.col("velocity").cast("int").alias("velocity"))
    rows = notes if "variant" in notes.columns else notes.withColumn("variant", F.lit(0))
    grouped = rows.groupBy("file_id", "variant", "start").agg(F.sort_array(F.collect_list(note)).alias("notes"))
    return grouped.withColumn("notes", F.transform("notes", lambda n: F.struct(n["pitch"].alias("pitch"), n["dur"].alias("dur"), n["velocity"].alias("velocity"))))


def repair_chords(chords: DataFrame, table: DataFrame) -> DataFrame:
    """chords with chord_id, and without the notes that don't belong to the class found; chords of one
    note stay as they are. The table has 4095 rows."""
    rows = chords.withColumn("mask", pitch_class_mask(F.transform("notes", lambda n: n["pitch"])))
    rows = rows.join(F.broadcast(table), "mask", "left")
    belongs = F.filter("notes", lambda n: F.col("chord_mask").bitwiseAND(F.pow(F.lit(2), F.pmod(n["pitch"], F.lit(12))).cast("int")) != 0)
    return rows.withColumn("notes", F.when((F.size("notes") > 1) & F.col("chord_id").isNotNull(), belongs).otherwise(F.col("notes"))).drop("mask", "chord_mask")


def encode_tokens(chords: DataFrame, *, max_len: int = MAX_LEN) -> DataFrame:
    """(file_id, variant, tokens): for each chord its delta, its class and its (pitch, duration) pairs, cut
    at max_len tokens even within a chord."""
    order = Window.partitionBy("file_id", "variant").orderBy("start")
    delta = F.greatest(F.lit(0), F.least(F.lit(127), F.coalesce(F.col("start") - F.lag("start").over(order), F.lit(0)))).cast("int")
    lone = F.size("notes") == 1
    kind = F.when(lone, F.pmod(F.get("notes", 0)["pitch"], F.lit(12)) + SINGLE).otherwise(F.col("chord_id") + CHORD).cast("int")
    clip = lambda x: F.greatest(F.lit(1), F.least(F.lit(127), x)).cast("int")
    pairs = F.flatten(F.transform("notes", lambda n: F.array(clip(n["pitch"]) + PITCH, clip(n["dur"]) + DURATION)))
    rows = chords.withColumn("delta", delta).withColumn("part", F.concat(F.array(F.col("delta"), kind), pairs))
    grouped = rows.groupBy("file_id", "variant").agg(F.sort_array(F.collect_list(F.struct("start", "part"))).alias("parts"))
    return grouped.select("file_id", "variant", F.slice(F.flatten(F.transform("parts", lambda p: p["part"])), 1, max_len).alias("tokens"))


def notes_to_tokens(notes: DataFrame, *, chords: DataFrame | None = None, keep_patches: list[int] | DataFrame | None = None, clean: bool = True, factor: int = TRANSPOSE, max_len: int = MAX_LEN, divider: int = 32) -> DataFrame:
    """The whole way from notes in milliseconds to (file_id, variant, tokens)."""
    rows = quantize(notes, divider)
    if keep_patches is not None:
        rows = keep_instruments(rows, keep_patches)
    if clean:
        rows = solo_piano(rows)
    rows = rebase(fix_durations(distinct_pitches(rows)))
    table = chords if chords is not None else chord_table(notes.sparkSession)
    return encode_tokens(repair_chords(chordify(transpose_variants(rows, factor)), table), max_len=max_len)


def decode_tokens(df: DataFrame, *, key: list[str] | None = None, tokens: str = "tokens") -> DataFrame:
    """(key..., event, start, chord, pitch, dur): the notes of token sequences. A note whose duration was
    cut off is left out."""
    key = key or ["file_id", "variant"]
    rows = df.select(*key, F.posexplode(tokens).alias("pos", "token"))
    order = Window.partitionBy(*key).orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("event", F.sum((F.col("token") < 128).cast("long")).over(so_far) - 1)
    rows = rows.withColumn("start", F.sum(F.when(F.col("token") < 128, F.col("token")).otherwise(0)).over(so_far))
    rows = rows.withColumn("chord", F.last(F.when(F.col("token").between(SINGLE, MASK - 1), F.col("token")), ignorenulls=True).over(so_far)).withColumn("next", F.lead("token").over(order))
    note = F.col("token").between(PITCH + 1, DURATION - 1) & F.col("next").between(DURATION + 1, SINGLE - 1)
    return rows.where(note).select(*key, "event", "start", "chord", (F.col("token") - PITCH).alias("pitch"), (F.col("next") - DURATION).alias("dur"))


# -- other sequence operators ----------------------------------------------------------------------

def uniform(*parts: Column) -> Column:
    """A reproducible number in [0, 1) from the MD5 of the parts joined by slashes."""
    text = F.concat_ws("/", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


#: Places whose numbers come from one digest, as powers of two, and hexadecimal digits of a place.
PLACES_BITS, PLACE_DIGITS = 2, 16


def ngram_replace(df: DataFrame, *, key: str = "seq_id", tokens: str = "tokens", prob_single: float = 0.1, prob_ngram: float = 0.1, max_ngram: int = 5, value: int = MASK, seed: int = 0, out: str = "masked") -> DataFrame:
    """Replaces single tokens, and n-grams of 2 to max_ngram tokens from chosen starts on, cut at the end.

    Four places share the SHA-256 of seed/key/number of the four: each has 16 of its digits, six for the
    single token, six for the start of an n-gram and four for its length, so equal keys and seeds give equal
    masks. Where the n-gram from each place ends is worked out once; a place is covered if one of the
    max_ngram places up to it reaches beyond it."""
    digest = lambda b: F.sha2(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"), b.cast("string")).cast("binary"), 256)
    blocks = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(tokens), PLACES_BITS)), digest)
    digits = lambda d, i, skip, n: F.substring(F.get(d, F.shiftright(i, PLACES_BITS)), i.bitwiseAND((1 << PLACES_BITS) - 1) * PLACE_DIGITS + skip + 1, F.lit(n))
    below = lambda x, prob: x < F.lit(_bound(prob, 6))

    def length(d: Column, i: Column) -> Column:
        return F.shiftright(F.conv(digits(d, i, 12, 4), 16, 10).cast("int") * (max_ngram - 1), 16) + 2

    def masked(d: Column) -> Column:
        single = lambda i: below(digits(d, i, 0, 6), prob_single)
        if max_ngram < 2:
            return F.transform(tokens, lambda t, i: F.when(single(i), F.lit(value)).otherwise(t))
        reach = F.transform(tokens, lambda t, i: F.when(below(digits(d, i, 6, 6), prob_ngram), i + length(d, i)).otherwise(F.lit(0)))
        last = lambda ends, i: F.greatest(*[F.get(ends, i - k) for k in range(max_ngram)])
        return _bind(reach, lambda ends: F.transform(tokens, lambda t, i: F.when((last(ends, i) > i) | single(i), F.lit(value)).otherwise(t)))

    return df.withColumn(out, _bind(blocks, masked))


def _bound(prob: float, digits: int) -> str:
    """The hexadecimal digits below which those of a place stand for a number below prob."""
    n = math.ceil(prob * 16**digits)
    return f"{max(n, 0):0{digits}x}" if n < 16**digits else "g"


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once a row: an array of one gives it a name."""
    return F.get(F.transform(F.array(value), use), 0)


def sort_by_length(df: DataFrame, *, tokens: str = "tokens", partitions: int | None = None, tie: str | None = None) -> DataFrame:
    """Sequences in order of length, range-partitioned, so that batches pad little."""
    by = [F.size(tokens)] + ([F.col(tie)] if tie else [])
    return (df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)).sortWithinPartitions(*by)


def char_tokens(df: DataFrame, *, text: str = "text", max_len: int | None = None, out: str = "tokens") -> DataFrame:
    """ASCII codes of the characters below 128; others are left out."""
    codes = F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), ""), lambda c: (F.length(c) > 0) & (F.octet_length(c) == 1)), lambda c: F.ascii(c))
    return df.withColumn(out, F.slice(codes, 1, max_len) if max_len is not None else codes)
