"""Standard MIDI files to and from event rows.

``read_midi`` gives one row a file with its events nested; ``opus_events`` unnests them to
(file_id, ticks, track, seq, event, time, channel, a, b, text, extra), where time is the delta in ticks.
Decoding is total: broken files give what could be read, and warnings.

Event fields: note_on, note_off, key_after_touch a = pitch, b = velocity; control_change a = controller,
b = value; patch_change, channel_after_touch a = value; pitch_wheel_change a = -8192..8191; set_tempo
a = microseconds a quarter; song_position, song_select, set_sequence_number a = number; texts, sysex,
sequencer_specific, raw_meta_event (a = type) and raw_data have text; time_signature, key_signature and
smpte_offset have extra.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of channel messages by status nibble and of text events by meta type: fixed values of the format.
CHANNEL_EVENTS = {0x8: "note_off", 0x9: "note_on", 0xA: "key_after_touch", 0xB: "control_change", 0xC: "patch_change", 0xD: "channel_after_touch", 0xE: "pitch_wheel_change"}
TEXT_EVENTS = {1: "text_event", 2: "copyright_text_event", 3: "track_name", 4: "instrument_name", 5: "lyric", 6: "marker", 7: "cue_point"} | {i: f"text_event_{i:02x}" for i in range(8, 16)}
STATUS = {name: code for code, name in CHANNEL_EVENTS.items()}
META = {name: code for code, name in TEXT_EVENTS.items()}
DEFAULT_TICKS = 1000
#: Events that are Python objects at once, and bytes and files of a batch that is written.
EVENTS, BYTES, FILES = 2_000, 8 << 20, 500

EVENT = "track int, seq int, event string, time bigint, channel int, a int, b int, text binary, extra array<int>"
_FIELDS = ["track", "seq", "event", "time", "channel", "a", "b", "text", "extra"]
_TYPE = pa.list_(pa.struct([("track", pa.int32()), ("seq", pa.int32()), ("event", pa.string()), ("time", pa.int64()), ("channel", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("text", pa.binary()), ("extra", pa.list_(pa.int32()))]))


def write_varlen(n: int) -> bytes:
    """Seven bits a byte, highest first, the high bit set on all but the last."""
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(0x80 | (n & 0x7F))
    return bytes(reversed(out))


def read_varlen(data: bytes, at: int) -> tuple[int, int]:
    """(number, place after it); data that ends early gives what there is."""
    n = 0
    while at < len(data):
        byte = data[at]
        at += 1
        n = (n << 7) | (byte & 0x7F)
        if byte < 0x80:
            break
    return n, at


def split_14_bits(n: int) -> bytes:
    return bytes([n & 0x7F, (n >> 7) & 0x7F])


def join_14_bits(raw: bytes) -> int:
    return raw[0] | (raw[1] << 7)


def _event(name: str, time: int, **fields) -> dict:
    return {"event": name, "time": time, **fields}


def decode_track(data: bytes, warn: list[str]) -> list[dict]:
    """The events of one track's bytes, with delta times."""
    out, at, status = [], 0, None
    while at < len(data):
        delta, at = read_varlen(data, at)
        if at >= len(data):
            break
        first = data[at]
        if first == 0xFF:
            kind = data[at + 1] if at + 1 < len(data) else 0
            size, begin = read_varlen(data, at + 2)
            body, at = data[begin : begin + size], begin + size
            if kind == 0x2F:
                if delta:  # keeps the time up to the track's end
                    out.append(_event("text_event", delta, text=b""))
                break
            out.append(_meta(kind, body, delta))
        elif first in (0xF0, 0xF7):
            size, begin = read_varlen(data, at + 1)
            out.append(_event("sysex_f0" if first == 0xF0 else "sysex_f7", delta, text=data[begin : begin + size]))
            at = begin + size
        elif first == 0xF2:
            out.append(_event("song_position", delta, a=join_14_bits(data[at + 1 : at + 3].ljust(2, b"\0"))))
            at += 3
        elif first == 0xF3:
            out.append(_event("song_select", delta, a=data[at + 1] if at + 1 < len(data) else 0))
            at += 2
        elif first == 0xF6:
            out.append(_event("tune_request", delta))
            at += 1
        elif first > 0xF0:
            out.append(_event("raw_data", delta, text=bytes([first])))
            at += 1
        else:
            if first >= 0x80:
                status, at = first, at + 1
            if status is None:
                warn.append("running status before any status")
                return []
            name, channel = CHANNEL_EVENTS[status >> 4], status & 0x0F
            size = 1 if name in ("patch_change", "channel_after_touch") else 2
            raw = data[at : at + size].ljust(size, b"\0")
            at += size
            if name == "pitch_wheel_change":
                out.append(_event(name, delta, channel=channel, a=join_14_bits(raw) - 8192))
            elif size == 1:
                out.append(_event(name, delta, channel=channel, a=raw[0]))
            else:
                out.append(_event(name, delta, channel=channel, a=raw[0], b=raw[1]))
    return out


def _meta(kind: int, body: bytes, delta: int) -> dict:
    if kind in TEXT_EVENTS:
        return _event(TEXT_EVENTS[kind], delta, text=body)
    if kind == 0x00:
        return _event("set_sequence_number", delta, a=int.from_bytes(body[:2], "big"))
    if kind == 0x51:
        return _event("set_tempo", delta, a=int.from_bytes(body[:3], "big"))
    if kind == 0x54 and len(body) >= 5:
        return _event("smpte_offset", delta, extra=list(body[:5]))
    if kind == 0x58 and len(body) >= 4:
        return _event("time_signature", delta, extra=list(body[:4]))
    if kind == 0x59 and len(body) >= 2:
        return _event("key_signature", delta, extra=list(struct.unpack("bB", body[:2])))
    if kind == 0x7F:
        return _event("sequencer_specific", delta, text=body)
    return _event("raw_meta_event", delta, a=kind, text=body)


def decode_file(data: bytes | None) -> tuple[int, list[dict], list[str]]:
    """(ticks a quarter, events with track and seq, warnings) of one file."""
    data, warn = data or b"", []
    if len(data) < 14 or data[:4] != b"MThd" or int.from_bytes(data[4:8], "big") != 6:
        return DEFAULT_TICKS, [], ["no MIDI header"]
    _, tracks, ticks = struct.unpack(">HHH", data[8:14])
    events, at = [], 14
    for track in range(tracks):
        if at + 8 > len(data):
            if at < len(data):
                warn.append("bytes left over")
            break
        if data[at : at + 4] != b"MTrk":
            warn.append(f"track {track} has the tag {data[at : at + 4]!r}")
        size = int.from_bytes(data[at + 4 : at + 8], "big")
        if at + 8 + size > len(data):
            warn.append(f"track {track} is cut off")
            break
        for seq, e in enumerate(decode_track(data[at + 8 : at + 8 + size], warn)):
            events.append(e | {"track": track, "seq": seq})
        at += 8 + size
    return ticks, events, collapse(warn)


def collapse(warnings: list[str]) -> list[str]:
    """Runs of one warning as that warning and how often it was repeated."""
    out: list[str] = []
    i = 0
    while i < len(warnings):
        j = i
        while j < len(warnings) and warnings[j] == warnings[i]:
            j += 1
        out.append(warnings[i])
        if j - i > 1:
            out.append(f"previous message repeated {j - i - 1} times")
        i = j
    return out


class _Track:
    """One track's bytes as its events come, with running status and an end of track."""

    def __init__(self, warn: list[str]) -> None:
        self.out, self.running, self.wait, self.ended, self.warn = bytearray(), None, 0, False, warn

    def add(self, e: dict) -> None:
        if self.ended:
            return
        name = e["event"]
        body = _encoded(name, e)
        if name == "end_track":
            self.wait += e["time"] or 0
            self.ended = True
            return
        if body is None:
            self.warn.append(f"cannot encode {name}")
            self.wait += e["time"] or 0
            return
        self.out += write_varlen(max(0, (e["time"] or 0) + self.wait))
        self.wait = 0
        if name in STATUS:
            if body[0] != self.running:
                self.out.append(body[0])
            self.running = body[0]
            self.out += body[1:]
        else:
            self.running = None
            self.out += body

    def done(self) -> bytes:
        return bytes(self.out + write_varlen(self.wait) + b"\xff\x2f\x00")


class _File:
    """One file's bytes as its events come, in order of track and seq; format 0 for one track alone, else 1."""

    def __init__(self, ticks: int) -> None:
        self.ticks, self.tracks, self.last, self.track, self.warn = ticks, [], None, None, []

    def add(self, e: dict) -> None:
        if self.track is None or e["track"] != self.last:
            self._close()
            self.last, self.track = e["track"], _Track(self.warn)
        self.track.add(e)

    def _close(self) -> None:
        if self.track is not None:
            self.tracks.append(self.track.done())

    def done(self) -> tuple[bytes, list[str]]:
        self._close()
        head = b"MThd" + struct.pack(">IHHH", 6, 0 if len(self.tracks) == 1 else 1, len(self.tracks), self.ticks)
        return head + b"".join(b"MTrk" + struct.pack(">I", len(t)) + t for t in self.tracks), collapse(self.warn)


def _encoded(name: str, e: dict) -> bytes | None:
    a, b, text = e.get("a") or 0, e.get("b") or 0, bytes(e.get("text") or b"")
    meta = lambda kind, body: bytes([0xFF, kind]) + write_varlen(len(body)) + body
    if name in STATUS:
        head = bytes([(STATUS[name] << 4) | ((e.get("channel") or 0) & 0x0F)])
        if name == "pitch_wheel_change":
            return head + split_14_bits(a + 8192)
        return head + (bytes([a & 0x7F]) if name in ("patch_change", "channel_after_touch") else bytes([a & 0x7F, b & 0x7F]))
    if name in META:
        return meta(META[name], text)
    extra = [x & 0xFF for x in e.get("extra") or []]
    match name:
        case "set_sequence_number":
            return meta(0x00, a.to_bytes(2, "big"))
        case "set_tempo":
            return meta(0x51, a.to_bytes(3, "big"))
        case "smpte_offset":
            return meta(0x54, bytes(extra))
        case "time_signature":
            return meta(0x58, bytes(extra))
        case "key_signature":
            return meta(0x59, bytes(extra))
        case "sequencer_specific":
            return meta(0x7F, text)
        case "raw_meta_event":
            return meta(a & 0xFF, text)
        case "sysex_f0" | "sysex_f7":
            return bytes([0xF0 if name == "sysex_f0" else 0xF7]) + write_varlen(len(text)) + text
        case "song_position":
            return b"\xf2" + split_14_bits(a)
        case "song_select":
            return bytes([0xF3, a & 0x7F])
        case "tune_request":
            return b"\xf6"
        case "end_track":
            return b""
    return None


def encode_track(events: list[dict], warn: list[str]) -> bytes:
    """One track's bytes, with running status and an end of track."""
    out = _Track(warn)
    for e in events:
        out.add(e)
    return out.done()


def encode_file(ticks: int, events: list[dict]) -> tuple[bytes, list[str]]:
    """(bytes, warnings) of events with track and seq; format 0 for one track alone, else 1."""
    out = _File(ticks)
    for e in sorted(events, key=lambda e: (e["track"], e["seq"])):
        out.add(e)
    return out.done()


def read_files(spark: SparkSession, path: str | list[str], glob: str = "*.mid*") -> DataFrame:
    """(path, content) of all files below the folders."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_midi(files: DataFrame, *, key: str = "path", content: str = "content") -> DataFrame:
    """(file_id, ticks int, events array<struct>, warnings array<string>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                ticks, events, warn = decode_file(b.column("content")[at].as_py())
                yield pa.RecordBatch.from_arrays([b.column("file_id").slice(at, 1), pa.array([ticks], pa.int32()), pa.array([events], _TYPE), pa.array([warn], pa.list_(pa.string()))], ["file_id", "ticks", "events", "warnings"])

    rows = files.select(F.col(key).cast("string").alias("file_id"), F.col(content).alias("content"))
    return rows.mapInArrow(run, f"file_id string, ticks int, events array<struct<{', '.join(x.replace(' ', ':', 1) for x in EVENT.split(', '))}>>, warnings array<string>")


def opus_events(decoded: DataFrame, *, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The event rows of decoded files, of some kinds only if asked for."""
    rows = decoded.select("file_id", "ticks", F.explode("events").alias("e")).select("file_id", "ticks", *[F.col(f"e.{c}").alias(c) for c in _FIELDS])
    if include is not None:
        rows = rows.where(F.col("event").isin(*include))
    return rows.where(~F.col("event").isin(*exclude)) if exclude else rows


def write_midi(opus: DataFrame) -> DataFrame:
    """(file_id, content binary, warnings array<string>) of event rows; a file is built by one task, from its sorted
    events as they come: a task holds a batch of them, and the bytes of a batch of files."""
    order = Window.partitionBy("file_id").orderBy(*_FIELDS)
    rows = opus.select("file_id", "ticks", *_FIELDS).withColumn("nth", F.row_number().over(order))  # sorted, so that a file begins where nth is 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, key, made, size = None, None, [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.binary()), pa.array([m[2] for m in made], pa.list_(pa.string()))], ["file_id", "content", "warnings"])

        for b in batches:
            for at in range(0, b.num_rows, EVENTS):
                for e in b.slice(at, EVENTS).to_pylist():
                    if e["nth"] == 1:
                        if file is not None:
                            made.append((key, *file.done()))
                            size += len(made[-1][1])
                        file, key = _File(e["ticks"]), e["file_id"]
                    file.add(e)
                if size > BYTES or len(made) >= FILES:
                    yield batch()
                    made, size = [], 0
        if file is not None:
            made.append((key, *file.done()))
        if made:
            yield batch()

    return rows.mapInArrow(run, "file_id string, content binary, warnings array<string>")


def normalized_hashes(files: DataFrame, *, key: str = "path", content: str = "content") -> DataFrame:
    """(name, original_md5, normalized_md5): hashes of the bytes and of the bytes after decoding and
    encoding. Files of equal normalized_md5 hold the same music."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                again = encode_file(*decode_file(b.column("content")[at].as_py())[:2])[0]
                yield pa.RecordBatch.from_arrays([b.column("path").slice(at, 1), b.column("content").slice(at, 1), pa.array([again], pa.binary())], ["path", "content", "again"])

    rows = files.select(F.col(key).alias("path"), F.col(content).alias("content")).mapInArrow(run, "path string, content binary, again binary")
    return rows.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("name"), F.md5("content").alias("original_md5"), F.md5("again").alias("normalized_md5"))
