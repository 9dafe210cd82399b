"""Raw sound as a Spark data source: files of little-endian 32-bit floats, read in byte ranges.

``raw_sound`` reads a file, or all files of a folder that end in ``.f32``, as pieces
(stream_id string, piece_no long, first_sample long, samples array<float>) of ``piece_samples`` samples, the last one
shorter. Tasks take ranges of whole pieces, so one file of any size is many tasks' work and a task holds
a piece at a time. It writes the same columns, sorted by stream and piece, one file a stream.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Samples of a piece: 20 seconds at 16 kHz. Bytes that one task reads at least.
PIECE_SAMPLES, TASK_BYTES = 320_000, 32 << 20
SUFFIX, BYTES = ".f32", 4
SCHEMA = "stream_id string, piece_no long, first_sample long, samples array<float>"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    local = re.match(r"^(?:file:)?(/.*)", path)
    if local:
        return fs.LocalFileSystem(), "/" + local[1].lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Pieces(InputPartition):
    """Some pieces of a file, which follow each other."""

    path: str
    stream_id: str
    first: int
    until: int
    samples: int


class SoundReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.piece = options["path"], int(options.get("piece_samples", PIECE_SAMPLES))
        self.per_task = max(1, int(options.get("task_bytes", TASK_BYTES)) // (BYTES * self.piece))

    def partitions(self) -> list[Pieces]:
        where, path = file_system(self.folder)
        info = where.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.folder)
        found = [info] if info.type == fs.FileType.File else [f for f in where.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.path.endswith(SUFFIX)]
        out = []
        for f in sorted(found, key=lambda f: f.path):
            samples = f.size // BYTES
            pieces = -(-samples // self.piece)
            name = f.path.rsplit("/", 1)[-1].removesuffix(SUFFIX)
            out += [Pieces(f.path, name, i, min(i + self.per_task, pieces), samples) for i in range(0, pieces, self.per_task)]
        return out or [Pieces("", "", 0, 0, 0)]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.until:
            return
        where, _ = file_system(self.folder)
        with where.open_input_file(partition.path) as f:
            for i in range(partition.first, partition.until):
                at = i * self.piece
                data = f.read_at(BYTES * min(self.piece, partition.samples - at), BYTES * at)
                values = pa.array(np.frombuffer(data, "<f4"), pa.float32())
                samples = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([pa.array([partition.stream_id]), pa.array([i]), pa.array([at]), samples], names=["stream_id", "piece_no", "first_sample", "samples"])


class SoundWriter(DataSourceArrowWriter):
    """Each stream's file gets its name once it is whole; a task that runs again writes the same file again."""

    def __init__(self, options: dict):
        self.folder = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, folder = file_system(self.folder)
        where.create_dir(folder, recursive=True)
        stream, out, fresh, expected = None, None, "", 0

        def close() -> None:
            if out is not None:
                out.close()
                where.move(fresh, f"{folder}/{stream}{SUFFIX}")

        for batch in iterator:
            for i in range(batch.num_rows):
                name, first = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                if name != stream:
                    close()
                    stream, fresh, expected = name, f"{folder}/_{uuid.uuid4().hex}", 0
                    out = where.open_output_stream(fresh)
                if first != expected:
                    raise ValueError(f"stream {name} has no samples from {expected} to {first}")
                values = batch.column(3)[i].values.to_numpy(zero_copy_only=False).astype("<f4")
                out.write(values.tobytes())
                expected += len(values)
        close()
        return WriterCommitMessage()


class RawSound(DataSource):
    """Spark's side of the format; see the module."""

    @classmethod
    def name(cls) -> str:
        return "raw_sound"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SoundReader:
        return SoundReader(self.options)

    def writer(self, schema, overwrite: bool) -> SoundWriter:
        return SoundWriter(self.options)


def read_sound(spark: SparkSession, path: str, piece_samples: int = PIECE_SAMPLES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The pieces of a file or folder of raw sound. A trailing part of a sample is dropped; an empty file has no rows;
    a missing path is an error."""
    spark.dataSource.register(RawSound)
    return spark.read.format("raw_sound").option("piece_samples", piece_samples).option("task_bytes", task_bytes).load(path)


def write_sound(pieces: DataFrame, folder: str) -> None:
    """Writes each stream of (stream_id, piece_no, first_sample, samples) as one file named after it. Pieces that
    leave a gap are an error; null streams and empty pieces go."""
    spark = pieces.sparkSession
    spark.dataSource.register(RawSound)
    whole = pieces.where("stream_id is not null and size(samples) > 0").select(F.col("stream_id").cast("string"), F.col("piece_no").cast("long"), F.col("first_sample").cast("long"), F.col("samples").cast("array<float>"))
    whole.repartition("stream_id").sortWithinPartitions("stream_id", "first_sample").write.format("raw_sound").mode("append").save(folder)
