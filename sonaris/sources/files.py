"""Embedding tables, file catalogues, copies and wave files."""

from __future__ import annotations

import io
import re
import shutil
import wave
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonaris.sources.midi import decode_file, encode_file

NAMES, VECTORS = "midi_names", "midi_embeddings"


def load_embeddings(spark: SparkSession, path: str, *, names: str = NAMES, vectors: str = VECTORS, allow_pickle: bool = False) -> DataFrame:
    """(name, embedding array<float>) from Parquet, or from a structured .npy array. Names in .npy files
    are pickled objects, which run code when loaded: allow_pickle must be given for those."""
    if not path.endswith(".npy"):
        found = spark.read.parquet(path)
        pick = (names, vectors) if names in found.columns else ("name", "embedding")
        return found.select(F.col(pick[0]).cast("string").alias("name"), F.col(pick[1]).cast("array<float>").alias("embedding"))
    data = np.load(path, allow_pickle=allow_pickle)
    vecs = np.ascontiguousarray(data[vectors], np.float32)
    if vecs.ndim != 2:
        raise ValueError("vectors must have two dimensions")
    return spark.createDataFrame(pa.table({"name": [str(x) for x in data[names]], "embedding": pa.array(list(vecs), pa.list_(pa.float32()))}))


def save_embeddings(df: DataFrame, path: str, *, mode: str = "error", names: str = NAMES, vectors: str = VECTORS) -> str:
    """Parquet (distributed), or for a path ending in .npy one structured array, for exports that fit
    the driver. Names become fixed-width text, so no pickle is needed to read them."""
    rows = df.select(F.col("name").cast("string").alias(names), F.col("embedding").cast("array<float>").alias(vectors))
    if not path.endswith(".npy"):
        rows.write.mode(mode).parquet(path)
        return path
    t = rows.toArrow()
    vecs = np.array(t.column(vectors).to_pylist(), np.float32)
    if vecs.ndim != 2 or len(vecs) != t.num_rows:
        raise ValueError("vectors must have one length")
    text = np.array(t.column(names).to_pylist(), str)
    out = np.zeros(len(vecs), [(names, text.dtype), (vectors, np.float32, (vecs.shape[1],))])
    out[names], out[vectors] = text, vecs
    np.save(path, out)
    return path


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """A checkpoint of one batch; writing a batch again replaces it."""
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def stem(path: str) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def file_catalog(spark: SparkSession, folders: list[str], glob: str = "*.mid*") -> DataFrame:
    """(stem, path) of all files below the folders; of one stem the file of the last folder, and there of
    the last path."""
    rows = None
    for i, folder in enumerate(folders):
        own = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
               .select("path").withColumn("folder", F.lit(i)))
        rows = own if rows is None else rows.unionByName(own)
    last = Window.partitionBy("stem").orderBy(F.desc("folder"), F.desc("path"))
    return rows.withColumn("stem", stem("path")).withColumn("__n", F.row_number().over(last)).where("__n = 1").select("stem", "path")


def copy_manifest(matches: DataFrame, catalog: DataFrame, out: str) -> DataFrame:
    """(place, name, variant, score, src, dst, found): where each match's file is to go."""
    rows = matches.join(catalog.select(F.col("stem").alias("name"), F.col("path").alias("src")), "name", "left")
    name = F.concat(F.format_string("%s_%s_", F.bround("score", 8).cast("string"), F.col("variant").cast("string")), F.col("name"), F.lit(".mid"))
    return rows.select("place", "name", "variant", "score", "src", F.concat(F.lit(out.rstrip("/") + "/"), name).alias("dst"), F.col("src").isNotNull().alias("found"))


def copy_files(manifest: DataFrame) -> DataFrame:
    """Copies what was found, on the executors; (dst, copied, error). Source and target are folders that all
    executors share, or URIs that pyarrow's file systems know (s3a and s3n are read as s3, hdfs, gs); a file that
    fails doesn't stop the others, and none is seen half written: a local or hdfs one is moved into place, an object
    appears when its upload ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for src, dst in zip(b.column("src").to_pylist(), b.column("dst").to_pylist()):
                try:
                    _copy(src, dst)
                    done.append((dst, True, None))
                except (OSError, pa.ArrowException) as e:
                    done.append((dst, False, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.string()))], ["dst", "copied", "error"])

    return manifest.where("found").select("src", "dst").mapInArrow(run, "dst string, copied boolean, error string")


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")


def _copy(src: str, dst: str) -> None:
    (source, at), (target, to) = _file_system(src), _file_system(dst)
    objects = target.type_name in ("s3", "gcs", "abfs")
    aside = to if objects else to + ".part"
    if not objects:
        target.create_dir(to.rpartition("/")[0], recursive=True)
    with source.open_input_stream(at) as read, target.open_output_stream(aside) as write:
        shutil.copyfileobj(read, write, 1 << 20)
    if not objects:
        target.move(aside, to)


def write_normalized(files: DataFrame, out: str, *, key: str = "path", content: str = "content") -> DataFrame:
    """(src, dst, written, error): each MIDI file decoded, encoded and written below out under its own name, or
    with _normalized added where that is the file itself. out must be a folder that all executors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for src, raw in zip(b.column("src").to_pylist(), b.column("content").to_pylist()):
                own = Path(src.removeprefix("file:"))
                target = Path(out, own.name)
                if target.exists() and own.exists() and target.samefile(own):
                    target = target.with_name(f"{own.stem}_normalized{own.suffix}")
                try:
                    target.parent.mkdir(parents=True, exist_ok=True)
                    aside = target.with_name(target.name + ".part")
                    aside.write_bytes(encode_file(*decode_file(raw)[:2])[0])
                    aside.replace(target)
                    done.append((src, str(target), True, None))
                except OSError as e:
                    done.append((src, str(target), False, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.string()))], ["src", "dst", "written", "error"])

    return files.select(F.col(key).alias("src"), F.col(content).alias("content")).mapInArrow(run, "src string, dst string, written boolean, error string")


def list_files(spark: SparkSession, folder: str, glob: str, kind: str) -> DataFrame:
    """(kind, path) of the files of a folder by name: models ("*.pth") or embeddings ("*.npy")."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path").orderBy("path").select(F.lit(kind).alias("kind"), "path")


def wave_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit PCM wave file of samples (frames,) or (frames, channels) in -1..1."""
    pcm = (np.clip(samples, -1, 1) * 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1 if pcm.ndim == 1 else pcm.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(pcm.tobytes())
    return out.getvalue()


def to_wave(df: DataFrame, *, key: str = "file_id", samples: str = "samples", rate: int = 16000) -> DataFrame:
    """(key, content binary): a wave file for each row's samples (array<float>, one channel)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [wave_bytes(np.asarray(x or [], np.float64), rate) for x in b.column("samples").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(made, pa.binary())], ["key", "content"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(samples).alias("samples")).mapInArrow(run, f"key {kind}, content binary").withColumnRenamed("key", key)


def save_arrays(folder: str, arrays: dict[str, np.ndarray]) -> list[str]:
    """Small arrays of the driver (means, projections) as .npy files."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, value in arrays.items():
        np.save(Path(folder, f"{name}.npy"), value)
    return sorted(str(Path(folder, f"{n}.npy")) for n in arrays)
