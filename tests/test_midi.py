from hypothesis import given, settings
from hypothesis import strategies as st

from sonaris.sources import midi

CHANNEL = st.integers(0, 15)
SEVEN = st.integers(0, 127)
EVENTS = st.one_of(
    st.builds(lambda t, c, a, b, n: {"event": n, "time": t, "channel": c, "a": a, "b": b}, st.integers(0, 1 << 20), CHANNEL, SEVEN, SEVEN, st.sampled_from(["note_on", "note_off", "control_change", "key_after_touch"])),
    st.builds(lambda t, c, a, n: {"event": n, "time": t, "channel": c, "a": a}, st.integers(0, 1 << 20), CHANNEL, SEVEN, st.sampled_from(["patch_change", "channel_after_touch"])),
    st.builds(lambda t, c, a: {"event": "pitch_wheel_change", "time": t, "channel": c, "a": a}, st.integers(0, 300), CHANNEL, st.integers(-8192, 8191)),
    st.builds(lambda t, a: {"event": "set_tempo", "time": t, "a": a}, st.integers(0, 300), st.integers(0, (1 << 24) - 1)),
    st.builds(lambda t, x, n: {"event": n, "time": t, "text": x}, st.integers(0, 300), st.binary(max_size=200), st.sampled_from(["text_event", "lyric", "track_name", "text_event_0c", "sysex_f0", "sequencer_specific"])),
    st.builds(lambda t: {"event": "time_signature", "time": t, "extra": [4, 2, 24, 8]}, st.integers(0, 300)),
    st.builds(lambda t, k: {"event": "key_signature", "time": t, "extra": [k, 1]}, st.integers(0, 300), st.integers(-7, 7)),
    st.builds(lambda t, a: {"event": "song_position", "time": t, "a": a}, st.integers(0, 300), st.integers(0, (1 << 14) - 1)),
)


@given(st.integers(1, 0x7FFF), st.lists(st.lists(EVENTS, max_size=12), min_size=1, max_size=3))
@settings(max_examples=150, deadline=None)
def test_round_trip(ticks, tracks):
    events = [e | {"track": i, "seq": j} for i, t in enumerate(tracks) for j, e in enumerate(t)]
    raw, warnings = midi.encode_file(ticks, events)
    assert not warnings
    got_ticks, got, warnings = midi.decode_file(raw)
    assert (got_ticks, warnings) == (ticks, []) or len({e["track"] for e in events}) < len(tracks)
    order = sorted({e["track"] for e in events})
    assert got == [e | {"track": order.index(e["track"])} for e in events]


@given(st.binary(max_size=300))
@settings(max_examples=200, deadline=None)
def test_decoding_never_raises(raw):
    midi.decode_file(raw)
    midi.decode_file(b"MThd\0\0\0\6\0\1\0\1\0\x60MTrk" + len(raw).to_bytes(4, "big") + raw)


def test_numbers_of_variable_length():
    for n, raw in ((0, "00"), (127, "7F"), (128, "81 00"), (16383, "FF 7F")):
        assert midi.write_varlen(n) == bytes.fromhex(raw)
        assert midi.read_varlen(bytes.fromhex(raw), 0) == (n, len(bytes.fromhex(raw)))


def test_broken_files():
    assert midi.decode_file(b"abc")[:2] == (1000, [])
    assert midi.decode_file(None)[1] == []
    head = b"MThd\0\0\0\6\0\1\0\2\0\x60"
    track = b"MTrk\0\0\0\x08\x00\x90\x3c\x40\x00\xff\x2f\x00"
    _, events, warn = midi.decode_file(head + track + b"MTrk\0\0\xff\xff\x00")
    assert [e["event"] for e in events] == ["note_on"] and warn
    assert midi.decode_file(head + b"MTrk\0\0\0\x03\x00\x3c\x40")[1] == []  # running status without a status
    late = b"MTrk\0\0\0\x04\x60\xff\x2f\x00"
    assert midi.decode_file(head + late)[1][0] == {"event": "text_event", "time": 96, "text": b"", "track": 0, "seq": 0}
    assert midi.collapse(["a", "a", "a", "b"]) == ["a", "previous message repeated 2 times", "b"]


def test_files_in_spark(spark):
    raw, _ = midi.encode_file(96, [{"track": 0, "seq": 0, "event": "note_on", "time": 5, "channel": 1, "a": 25, "b": 96}, {"track": 0, "seq": 1, "event": "note_off", "time": 96, "channel": 1, "a": 25, "b": 0}])
    files = spark.createDataFrame([("d/a.mid", raw), ("d/b.mid", b"junk"), ("d/c.mid", raw + b"x"), ("d/n.mid", None)], "path string, content binary")
    decoded = midi.read_midi(files)
    assert {r.file_id: len(r.events) for r in decoded.collect()} == {"d/a.mid": 2, "d/b.mid": 0, "d/c.mid": 2, "d/n.mid": 0}
    again = midi.write_midi(midi.opus_events(decoded)).collect()
    assert {bytes(r.content) for r in again} == {raw}
    hashes = {r.name: (r.original_md5, r.normalized_md5) for r in midi.normalized_hashes(files.where("content is not null")).collect()}
    assert hashes["a"][1] == hashes["c"][1] and hashes["a"][0] != hashes["c"][0]
    assert midi.opus_events(decoded, exclude=["note_off"]).count() == 2
