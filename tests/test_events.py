import random

from sonaris.operators import events as E

SCHEMA = "file_id string, track int, seq bigint, event string, time bigint, channel int, a int, b int"


def opus(spark, rows):
    return spark.createDataFrame([("f", 0, i, e, t, c, a, b) for i, (e, t, c, a, b) in enumerate(rows)], SCHEMA)


def notes(df):
    return [(r.time, r.dur, r.channel, r.a, r.b) for r in df.where("event = 'note'").orderBy("track", "seq").collect()]


def test_documented_pair(spark):
    rows = [("patch_change", 0, 1, 8, None), ("note_on", 5, 1, 25, 96), ("note_off", 96, 1, 25, 0), ("note_on", 0, 1, 29, 96), ("note_off", 96, 1, 29, 0)]
    score = E.opus_to_score(opus(spark, rows))
    assert notes(score) == [(5, 96, 1, 25, 96), (101, 96, 1, 29, 96)]
    back = [(r.event, r.time, r.a, r.b) for r in E.score_to_opus(score).orderBy("seq").collect()]
    assert back == [("patch_change", 0, 8, None), ("note_on", 5, 25, 96), ("note_off", 96, 25, 96), ("note_on", 0, 29, 96), ("note_off", 96, 29, 96)]


def test_first_in_first_out(spark):
    on, off = ("note_on", 1), ("note_off", 0)
    line = [(on, 0), (on, 2), (off, 3), (off, 5), (off, 6), (on, 7), (("text_event", 0), 9)]
    rows, before = [], 0
    for (name, _), t in line:
        rows.append((name, t - before, 0, 60, 64))
        before = t
    assert sorted(notes(E.opus_to_score(opus(spark, rows)))) == [(0, 3, 0, 60, 64), (2, 3, 0, 60, 64), (7, 2, 0, 60, 64)]


def test_pairing_against_a_queue(spark):
    rng = random.Random(3)
    rows, want = [], []
    for f in range(40):
        t, queue, own = 0, {}, []
        for seq in range(rng.randint(0, 30)):
            gap, kind, pitch = rng.randint(0, 3), rng.choice(["note_on", "note_off", "note_on0"]), rng.randint(60, 61)
            t += gap
            rows.append((str(f), 0, seq, kind.rstrip("0"), gap, 0, pitch, 0 if kind == "note_on0" else 64))
            if kind == "note_on":
                queue.setdefault(pitch, []).append(t)
            elif queue.get(pitch):
                s = queue[pitch].pop(0)
                own.append((str(f), pitch, s, t - s))
        own += [(str(f), p, s, t - s) for p, q in queue.items() for s in q]
        want += own
    got = E.opus_to_score(spark.createDataFrame(rows, SCHEMA)).where("event = 'note'")
    assert sorted((r.file_id, r.a, r.time, r.dur) for r in got.collect()) == sorted(want)


def test_tempo_change_inside_a_delta(spark):
    rows = opus(spark, [("note_on", 0, 0, 60, 64), ("set_tempo", 48, None, 1_000_000, None), ("note_off", 96, 0, 60, 0)]).selectExpr("*", "96 ticks")
    got = [(r.event, r.time) for r in E.to_milliseconds(rows).orderBy("seq").collect()]
    assert got == [("set_tempo", 0), ("note_on", 0), ("note_off", 1250)]


def test_grep_without_channels_is_empty(spark):
    df = opus(spark, [("note_on", 0, 3, 60, 64), ("set_tempo", 0, None, 1, None)])
    assert E.keep_channels(df, None).count() == 0
    assert E.keep_channels(df, [1]).count() == 1
    assert {r.kind for r in E.score_type(df).collect()} == {"opus"}


def test_shift_left_takes_the_place(spark):
    score = spark.createDataFrame([("f", 0, i, "note", t, 0, 60, 64) for i, t in enumerate((0, 50, 100, 200))], SCHEMA).selectExpr("*", "10L dur")
    assert sorted(r.time for r in E.time_shift(score, shift=-60, from_time=100).collect()) == [0, 40, 140]
    assert sorted(r.time for r in E.time_shift(score).collect()) == [0, 50, 100, 200]
    assert sorted(r.time for r in E.time_shift(score, shift=-500).collect()) == [0, 50, 100, 200]
    assert sorted(r.time for r in E.time_shift(score, start_time=7, shift=3).collect()) == [7, 57, 107, 207]


def test_segment_restores_state(spark):
    rows = [(0, "patch_change", 0, 1, 5), (1, "control_change", 0, 1, 7), (2, "control_change", 1, 1, 9), (3, "note", 10, 1, 60), (4, "note", 30, 1, 61)]
    score = spark.createDataFrame([("f", 0, s, e, t, c, a, 64) for s, e, t, c, a in rows], SCHEMA)
    got = sorted((r.event, r.time, r.a) for r in E.segment(score, 5, 20).collect())
    assert got == [("control_change", 5, 9), ("note", 10, 60), ("patch_change", 5, 5), ("set_tempo", 5, 500_000)]
    assert len([r for r in E.segment(score, 5, 20, per_controller=True).collect() if r.event == "control_change"]) == 2
    assert E.segment(score, 500, 600).count() == 0


def test_channels_of_merged_scores():
    assert E.channel_map({0: {0, 1}, 1: {0, 9}}) == [(1, 0, 2)]
    full = {0: {c for c in range(16)}, 1: {0, 1}}
    assert E.channel_map(full) == []


def test_stats_and_banks(spark):
    rows = [(0, "control_change", 0, 0, 0, 3), (1, "control_change", 0, 0, 32, 4), (2, "control_change", 1, 0, 32, 5), (3, "note", 2, 0, 60, 64), (4, "note", 3, 9, 35, 64)]
    score = spark.createDataFrame([("f", 0, s, e, t, c, a, b) for s, e, t, c, a, b in rows], SCHEMA).selectExpr("*", "IF(event = 'note', 10L, NULL) dur")
    r = E.score_stats(score).first()
    assert (r.nticks, r.num_notes, r.pitches, r.percussion, r.channels) == (13, 2, {60: 1}, {35: 1}, [0, 9])
    assert [(b.msb, b.lsb) for b in r.bank_selects] == [(-1, 5), (3, 4)]


def test_mixed_tick_rates(spark):
    a = opus(spark, [("note_on", 96, 0, 60, 64)]).selectExpr("*", "96 ticks", "1 g")
    b = opus(spark, [("note_on", 480, 0, 60, 64)]).selectExpr("*", "480 ticks", "1 g").withColumn("file_id", __import__("pyspark").sql.functions.lit("h"))
    out = E.consistent_ticks(a.unionByName(b), group=["g"]).where("event = 'note_on'").collect()
    assert {r.time for r in out} == {500} and {r.ticks for r in out} == {1000}


def test_one_track_of_many(spark):
    rows = [("f", 0, 0, "note_on", 0, 0, 60, 64), ("f", 0, 1, "note_off", 10, 0, 60, 0), ("f", 1, 0, "note_on", 5, 1, 62, 64), ("f", 1, 1, "note_off", 10, 1, 62, 0)]
    out = E.mix_opus_tracks(spark.createDataFrame(rows, SCHEMA)).orderBy("seq").collect()
    assert [(r.track, r.event, r.time, r.a) for r in out] == [(0, "note_on", 0, 60), (0, "note_on", 5, 62), (0, "note_off", 5, 60), (0, "note_off", 5, 62)]
