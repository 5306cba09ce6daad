"""The algebra of timed events.

An *opus* has delta times, a *score* absolute ones with paired notes; both are rows
(file_id, track, seq, event, time, dur, channel, a, b, ...), where seq orders a track, a note's a is its
pitch and b its velocity.  All windows are partitioned by file and track at least, so files spread over
the cluster; a file is bounded, as its format has 32-bit track lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds a quarter where no tempo is set, and those of a score in milliseconds.
DEFAULT_TEMPO, MS_TEMPO, MS_TICKS = 500_000, 1_000_000, 1000
#: The percussion channel.
DRUMS = 9
COLUMNS = ["file_id", "track", "seq", "event", "time", "dur", "channel", "a", "b", "text", "extra"]


def wide(df: DataFrame) -> DataFrame:
    """The columns of COLUMNS, null where df lacks them, and all others of df."""
    kinds = {"file_id": "string", "track": "int", "seq": "bigint", "event": "string", "time": "bigint", "dur": "bigint", "channel": "int", "a": "int", "b": "int", "text": "binary", "extra": "array<int>"}
    return df.select(*[F.col(c).cast(k).alias(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()], *[c for c in df.columns if c not in kinds])


def _track() -> Window:
    return Window.partitionBy("file_id", "track").orderBy("seq")


def absolute_times(opus: DataFrame) -> DataFrame:
    """Delta times summed up along each track."""
    return opus.withColumn("time", F.sum("time").over(_track().rowsBetween(Window.unboundedPreceding, 0)))


def delta_times(score: DataFrame) -> DataFrame:
    """Absolute times, in order of (time, seq), as differences; seq is numbered anew."""
    order = Window.partitionBy("file_id", "track").orderBy("time", "seq")
    return score.withColumn("__d", F.col("time") - F.lag("time", 1, 0).over(order)).withColumn("seq", (F.row_number().over(order) - 1).cast("long")).withColumn("time", F.col("__d")).drop("__d")


def opus_to_score(opus: DataFrame) -> DataFrame:
    """Absolute times; note_on and note_off paired first in, first out within (track, channel, pitch). A
    note stands where its end stood. note_on with velocity 0 is an end; ends without a note are dropped;
    notes without an end last to the end of the track."""
    rows = absolute_times(wide(opus)).withColumn("track_end", F.max("time").over(Window.partitionBy("file_id", "track")))
    is_on = (F.col("event") == "note_on") & (F.coalesce("b", F.lit(0)) > 0)
    is_off = (F.col("event") == "note_off") | ((F.col("event") == "note_on") & (F.coalesce("b", F.lit(0)) == 0))
    voice = Window.partitionBy("file_id", "track", "channel", "a").orderBy("seq")
    marks = rows.where(is_on | is_off).withColumn("step", F.when(is_on, 1).otherwise(-1))
    marks = marks.withColumn("level", F.sum("step").over(voice.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.coalesce(F.min("level").over(voice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = marks.withColumn("stray", (F.col("step") == -1) & (F.col("level") < F.least(F.lit(0), before))).where("NOT stray")
    marks = marks.withColumn("nth", F.row_number().over(Window.partitionBy("file_id", "track", "channel", "a", "step").orderBy("seq")))
    pair = Window.partitionBy("file_id", "track", "channel", "a", "nth")
    off = F.max(F.when(F.col("step") == -1, F.struct("time", "seq"))).over(pair)
    ons = marks.withColumn("off", off).where("step = 1")
    stop = F.coalesce(F.col("off.time"), F.col("track_end"))
    notes = ons.withColumn("event", F.lit("note")).withColumn("dur", stop - F.col("time")).withColumn("place", F.coalesce(F.col("off.seq"), F.col("seq") + F.lit(1 << 40)))
    others = rows.where(~(is_on | is_off)).withColumn("place", F.col("seq"))
    keep = [c for c in rows.columns if c not in ("seq", "track_end")]
    both = notes.select(*keep, "place").unionByName(others.select(*keep, "place"))
    order = Window.partitionBy("file_id", "track").orderBy("place")
    return both.withColumn("seq", (F.row_number().over(order) - 1).cast("long")).drop("place").select(*rows.drop("track_end").columns)


def score_to_opus(score: DataFrame) -> DataFrame:
    """Notes as note_on and note_off (with the note's own velocity), everything in order of time, as
    deltas."""
    rows = wide(score)
    note = F.col("event") == "note"
    ends = F.when(note, F.array(F.struct(F.lit(0).alias("k"), F.lit("note_on").alias("e"), F.col("time").alias("t")),
                                F.struct(F.lit(1).alias("k"), F.lit("note_off").alias("e"), (F.col("time") + F.col("dur")).alias("t")))
                  ).otherwise(F.array(F.struct(F.lit(0).alias("k"), F.col("event").alias("e"), F.col("time").alias("t"))))
    split = rows.withColumn("x", F.explode(ends)).withColumn("seq", F.col("seq") * 2 + F.col("x.k")).withColumn("event", F.col("x.e")).withColumn("time", F.col("x.t"))
    return delta_times(split.withColumn("dur", F.lit(None).cast("bigint")).drop("x"))


def to_milliseconds(opus: DataFrame, *, ticks: str = "ticks") -> DataFrame:
    """Delta times in milliseconds (ticks 1000 at 1 000 000 microseconds a quarter). The tempo changes of
    all tracks hold for the whole file, the last of one tick wins; each delta is the half-even rounding
    of a difference of exact times. Tempo events go; each track begins with the new tempo."""
    rows = absolute_times(wide(opus))
    changes = rows.where("event = 'set_tempo'").groupBy("file_id", "time").agg(F.max(F.struct("track", "seq", "a")).alias("x")).select("file_id", "time", F.col("x.a").alias("us"))
    line = Window.partitionBy("file_id").orderBy("time")
    before = F.coalesce(F.lag("us").over(line), F.lit(DEFAULT_TEMPO))
    # ticks times microseconds, in whole numbers: divided once, at the end
    part = (F.col("time") - F.coalesce(F.lag("time").over(line), F.lit(0))) * before
    tempo = changes.withColumn("part", part).withColumn("done", F.sum("part").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    own = rows.where("event != 'set_tempo'")
    packed = F.struct(*own.columns).alias("row")
    both = own.select("file_id", "time", F.lit(1).alias("k"), F.lit(None).cast("struct<t:bigint,us:int,done:bigint>").alias("at"), packed).unionByName(
        tempo.select("file_id", "time", F.lit(0).alias("k"), F.struct(F.col("time").alias("t"), F.col("us"), F.col("done")).alias("at")).withColumn("row", F.lit(None).cast(own.select(packed).schema["row"].dataType)))
    at = F.last("at", ignorenulls=True).over(Window.partitionBy("file_id").orderBy("time", "k").rowsBetween(Window.unboundedPreceding, 0))
    seen = both.withColumn("at", at).where("k = 1").select("row.*", "at")
    whole = F.coalesce(F.col("at.done"), F.lit(0)) + (F.col("time") - F.coalesce(F.col("at.t"), F.lit(0))) * F.coalesce(F.col("at.us"), F.lit(DEFAULT_TEMPO))
    exact = whole / (F.col(ticks) * 1000.0)
    timed = seen.withColumn("exact", exact)
    timed = timed.withColumn("time", F.bround(F.col("exact") - F.coalesce(F.lag("exact").over(_track()), F.lit(0.0))).cast("long")).drop("exact", "at")
    heads = rows.select("file_id", "track").distinct().withColumn("seq", F.lit(-1).cast("bigint")).withColumn("event", F.lit("set_tempo")).withColumn("time", F.lit(0).cast("bigint")).withColumn("a", F.lit(MS_TEMPO))
    return timed.unionByName(heads, allowMissingColumns=True).withColumn(ticks, F.lit(MS_TICKS).cast(rows.schema[ticks].dataType))


def consistent_ticks(opus: DataFrame, *, group: list[str], ticks: str = "ticks") -> DataFrame:
    """Leaves groups whose files have one tick rate; brings the others to milliseconds."""
    differ = opus.groupBy(*group).agg((F.countDistinct(ticks) > 1).alias("__mixed"))
    rows = opus.join(differ, group)
    return rows.where("NOT __mixed").drop("__mixed").unionByName(to_milliseconds(rows.where("__mixed").drop("__mixed")), allowMissingColumns=True)


def keep_channels(score: DataFrame, channels: list[int] | None) -> DataFrame:
    """Events of the channels, and those without a channel; nothing for channels None."""
    if channels is None:
        return score.where(F.lit(False))
    return score.where(F.col("channel").isNull() | F.col("channel").isin(*channels))


def _in(tracks: list[int] | None, default: Column) -> Column:
    return F.col("track").isin(*tracks) if tracks is not None else default


def time_shift(score: DataFrame, *, shift: int | None = None, start_time: int | None = None, from_time: int = 0, tracks: list[int] | None = None) -> DataFrame:
    """Moves what begins at from_time or later by shift, or so that the earliest comes to start_time (0 if
    neither is given; with both, start_time counts). The earliest never comes before 0, and tempos never
    move right. A move to the left takes the place of what began there, from from_time + shift on. Default
    tracks: all but 9 and 11."""
    chosen = _in(tracks, ~F.col("track").isin(DRUMS, 11))
    moved = chosen & (F.col("time") >= from_time)
    first = score.where(moved).groupBy("file_id").agg(F.min("time").alias("__first"))
    rows = score.join(first, "file_id", "left")
    if shift is not None and start_time is None:
        by = F.greatest(F.lit(shift), -F.col("__first"))
    else:
        by = F.lit(max(0, start_time or 0)) - F.col("__first")
    rows = rows.withColumn("__by", F.coalesce(by, F.lit(0)).cast("bigint"))
    gone = chosen & (F.col("__by") < 0) & (F.col("time") >= from_time + F.col("__by")) & (F.col("time") < from_time)
    held = (F.col("event") == "set_tempo") & (F.col("__by") > 0)
    return rows.where(~gone).withColumn("time", F.when(moved & ~held, F.col("time") + F.col("__by")).otherwise(F.col("time"))).drop("__first", "__by")


def segment(score: DataFrame, start: int, end: int, *, tracks: list[int] | None = None, per_controller: bool = False) -> DataFrame:
    """Events with start <= time <= end of the tracks (default: all but 9), and for each track that has any
    the state at its start: the last tempo, and for each channel the last patch and the last control
    change (one for each controller with per_controller)."""
    rows = score.where(_in(tracks, F.col("track") != DRUMS))
    inside = rows.where(F.col("time").between(start, end))
    alive = inside.select("file_id", "track").distinct()
    past = rows.where((F.col("time") <= start) & F.col("event").isin("set_tempo", "patch_change", "control_change"))
    slot = F.when(F.col("event") == "control_change", F.col("a")) if per_controller else F.lit(None).cast("int")
    keep = [c for c in score.columns if c not in ("file_id", "track", "event", "channel")]
    last = past.groupBy("file_id", "track", "event", "channel", slot.alias("__slot")).agg(F.max(F.struct("time", "seq", F.struct(*keep).alias("row"))).alias("x"))
    state = last.select("file_id", "track", "event", "channel", "x.row.*").withColumn("time", F.lit(start).cast("bigint"))
    tempo = alive.join(past.where("event = 'set_tempo'").select("file_id", "track").distinct(), ["file_id", "track"], "left_anti")
    tempo = tempo.withColumn("event", F.lit("set_tempo")).withColumn("a", F.lit(DEFAULT_TEMPO)).withColumn("time", F.lit(start).cast("bigint")).withColumn("seq", F.lit(-1).cast("bigint"))
    restored = state.join(alive, ["file_id", "track"], "left_semi").unionByName(tempo, allowMissingColumns=True).withColumn("restored", F.lit(True))
    return inside.withColumn("restored", F.lit(False)).unionByName(restored, allowMissingColumns=True)


def score_type(df: DataFrame) -> DataFrame:
    """(file_id, kind): score or opus by the first note or note_on, empty without either."""
    first = F.min(F.when(F.col("event").isin("note", "note_on"), F.struct("track", "seq", "event")))
    return df.groupBy("file_id").agg(first.alias("x")).select("file_id", F.when(F.col("x.event") == "note", "score").when(F.col("x.event") == "note_on", "opus").otherwise("").alias("kind"))


def finish() -> Column:
    """When an event is over."""
    return F.col("time") + F.coalesce(F.col("dur"), F.lit(0))


def concatenate_scores(scores: DataFrame, *, order: str = "ordinal", group: list[str] | None = None) -> DataFrame:
    """Scores one after another: each begins when the one before it is over. Tracks of one number join."""
    group = group or []
    ends = scores.groupBy(*group, order).agg(F.max(finish()).alias("__end"))
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.withColumn("__offset", F.coalesce(F.sum("__end").over(before), F.lit(0))).drop("__end")
    return scores.join(offsets, [*group, order]).withColumn("time", F.col("time") + F.col("__offset")).drop("__offset")


def channel_map(used: dict[int, set[int]]) -> list[tuple[int, int, int]]:
    """(score, old, new) for scores in order: a channel that an earlier score uses moves to the lowest free
    one of 0-15 but 9; when none is free the rest stay."""
    taken: set[int] = set()
    moves = []
    for score in sorted(used):
        for old in sorted(used[score] & taken - {DRUMS}):
            free = [c for c in range(16) if c != DRUMS and c not in taken and c not in used[score]]
            if not free:
                break
            used[score] = used[score] - {old} | {free[0]}
            moves.append((score, old, free[0]))
        taken |= used[score]
    return moves


def merge_scores(scores: DataFrame, *, order: str = "ordinal", group: list[str] | None = None) -> DataFrame:
    """All tracks of the scores of a group (of all, without) played together, tracks numbered on, channels in
    conflict moved, as far as there are free ones. A group is a row of at most 16 channels for each of its scores."""
    group = group or []
    kind = scores.schema[order].dataType.simpleString()
    used = scores.where("channel IS NOT NULL").groupBy(*group, order).agg(F.collect_set("channel").alias("c")).groupBy(*group).agg(F.collect_list(F.struct(F.col(order).alias("o"), "c")).alias("used"))
    moved = F.udf(lambda used: channel_map({u["o"]: set(u["c"]) for u in used}), f"array<struct<o:{kind},channel:int,__new:int>>")
    moves = used.select(*group, F.explode(moved("used")).alias("m")).select(*group, F.col("m.o").alias(order), "m.channel", "m.__new")
    tracks = scores.groupBy(*group, order).agg((F.max("track") + 1).alias("__n"))
    base = tracks.withColumn("__base", F.sum("__n").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))).drop("__n")
    rows = scores.join(base, [*group, order], "left").withColumn("track", (F.col("track") + F.coalesce("__base", F.lit(0))).cast("int")).drop("__base")
    rows = rows.join(moves, [*group, order, "channel"], "left")  # at most 15 for each score
    return rows.withColumn("channel", F.coalesce("__new", "channel")).drop("__new").select(*scores.columns)


def mix_scores(scores: DataFrame, *, order: str = "ordinal") -> DataFrame:
    """All events in one track, in the scores' order, not sorted by time."""
    line = Window.partitionBy("file_id").orderBy(order, "track", "seq")
    return scores.withColumn("seq", (F.row_number().over(line) - 1).cast("long")).withColumn("track", F.lit(0))


def mix_opus_tracks(opus: DataFrame) -> DataFrame:
    """One track of a file's tracks, as deltas."""
    score = opus_to_score(opus)
    line = Window.partitionBy("file_id").orderBy("time", "track", "seq")
    return score_to_opus(score.withColumn("seq", (F.row_number().over(line) - 1).cast("long")).withColumn("track", F.lit(0)))


def score_stats(score: DataFrame) -> DataFrame:
    """(file_id, nticks, num_notes, pitches map, percussion map, notes_by_channel map, channels array, patches
    array, pitch_range_by_track array<struct>, pitch_range_sum, bank_selects array<struct<msb, lsb>>)."""
    note = F.col("event") == "note"
    drum = F.col("channel") == DRUMS
    low = F.coalesce(F.min(F.when(note & ~drum, F.col("a"))), F.lit(0))
    high = F.coalesce(F.max(F.when(note & ~drum, F.col("a"))), F.lit(0))
    tracks = score.groupBy("file_id", "track").agg(low.alias("low"), high.alias("high"))
    ranges = tracks.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("track", "low", "high"))).alias("pitch_range_by_track"), F.sum(F.col("high") - F.col("low")).alias("pitch_range_sum"))
    basic = score.groupBy("file_id").agg(F.max(finish()).alias("nticks"), F.count(F.when(note, 1)).alias("num_notes"), F.sort_array(F.collect_set("channel")).alias("channels"),
                                         F.sort_array(F.collect_set(F.when(F.col("event") == "patch_change", F.col("a")))).alias("patches"))
    out = basic.join(ranges, "file_id")
    for name, rows, key in (("pitches", score.where(note & ~drum), "a"), ("percussion", score.where(note & drum), "a"), ("notes_by_channel", score.where(note), "channel")):
        counts = rows.groupBy("file_id", key).agg(F.count(F.lit(1)).alias("n")).groupBy("file_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias(name))
        out = out.join(counts, "file_id", "left").withColumn(name, F.coalesce(name, F.create_map().cast("map<int,bigint>")))
    return out.join(bank_selects(score), "file_id", "left")


def opus_length(opus: DataFrame) -> DataFrame:
    """(file_id, nticks): the deltas of all tracks added up."""
    return opus.groupBy("file_id").agg(F.coalesce(F.sum("time"), F.lit(0)).alias("nticks"))


def bank_selects(score: DataFrame) -> DataFrame:
    """(file_id, bank_selects): controller 0 with the controller 32 that follows it on its channel before
    another controller 0; -1 for a missing half."""
    line = Window.partitionBy("file_id", "channel").orderBy("time", "track", "seq")
    rows = score.where((F.col("event") == "control_change") & F.col("a").isin(0, 32))
    rows = rows.withColumn("after", F.lead(F.struct("a", "b")).over(line)).withColumn("prior", F.lag("a").over(line))
    lone = (F.col("a") == 32) & ((F.col("prior") != 0) | F.col("prior").isNull())
    pairs = rows.where((F.col("a") == 0) | lone).select("file_id", F.when(F.col("a") == 0, F.col("b")).otherwise(-1).alias("msb"), F.when(F.col("a") == 32, F.col("b")).when(F.col("after.a") == 32, F.col("after.b")).otherwise(-1).alias("lsb"))
    return pairs.distinct().groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("msb", "lsb"))).alias("bank_selects"))


def split_columns(score: DataFrame) -> DataFrame:
    """Notes of a score as (file_id, track, start, dur, channel, pitch, velocity)."""
    return score.where("event = 'note'").select("file_id", "track", F.col("time").alias("start"), "dur", "channel", F.col("a").alias("pitch"), F.col("b").alias("velocity"))


def patch_changes(score: DataFrame) -> DataFrame:
    """(file_id, channel, time, patch), for attaching patches to notes."""
    return score.where("event = 'patch_change'").select("file_id", "channel", "time", F.col("a").alias("patch"))


def pedal_changes(score: DataFrame) -> DataFrame:
    """(file_id, channel, time, value) of the sustain pedal."""
    return score.where("event = 'control_change' AND a = 64").select("file_id", "channel", "time", F.col("b").alias("value"))
