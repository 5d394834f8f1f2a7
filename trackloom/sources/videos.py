"""Video files as a Spark data source: a row for each frame, from the sample tables of MP4 and QuickTime files.

    spark.dataSource.register(VideoFrames)
    spark.read.format("video_frames").option("path", folder).option("frame_skip", 5).load()

A file is dealt to partitions by ranges of bytes, as Spark splits other files: the driver lists
names and sizes only.  Every partition reads the file's index (a few bytes a frame) and gives the
frames that begin in its range; of these it reads the encoded bytes, if they are asked for, after
``frame_skip`` has dropped what isn't wanted.  Decoding is the caller's (``tracking.infer``).

Options: path (a file or a folder, any storage that Arrow reads), frame_skip (1), content (false),
split_bytes (64 MB), skip_broken (false: a file without a usable index raises).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SUFFIXES = (".mp4", ".m4v", ".mov")
SCHEMA = "path string, frame_idx int, fps double, is_sync boolean, offset long, size long"
#: Boxes that hold boxes on the way to the sample tables.
NESTED = (b"trak", b"mdia", b"minf", b"stbl")


@dataclass
class Index:
    """Where the frames of a video track are; ``fps`` is None if the file doesn't tell."""

    offsets: np.ndarray
    sizes: np.ndarray
    sync: np.ndarray
    fps: float | None


def _boxes(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= len(data):
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = len(data) - at if size == 0 else size
        if size < head or at + size > len(data):
            raise ValueError("a box leaves its container")
        yield kind, data[at + head : at + size]
        at += size


def _leaves(data: bytes) -> dict[bytes, bytes]:
    """The boxes of a track, the nested ones laid flat."""
    out: dict[bytes, bytes] = {}
    for kind, body in _boxes(data):
        out |= _leaves(body) if kind in NESTED else {kind: body}
    return out


def _numbers(body: bytes, columns: int, kind: str = ">u4", skip: int = 8) -> np.ndarray:
    """The rows of a full box: version and flags, a count, then numbers."""
    count = struct.unpack_from(">I", body, skip - 4)[0]
    return np.frombuffer(body, kind, count * columns, skip).reshape(count, columns).astype(np.int64)


def _track(boxes: dict[bytes, bytes]) -> Index:
    uniform = struct.unpack_from(">I", boxes[b"stsz"], 4)[0]
    n = struct.unpack_from(">I", boxes[b"stsz"], 8)[0]
    sizes = np.full(n, uniform, np.int64) if uniform else _numbers(boxes[b"stsz"], 1, skip=12)[:, 0]
    chunks = _numbers(boxes[b"stco"], 1)[:, 0] if b"stco" in boxes else _numbers(boxes[b"co64"], 1, ">u8")[:, 0]
    runs = _numbers(boxes[b"stsc"], 3)  # first chunk, samples a chunk, description
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
    if per_chunk.sum() != n:
        raise ValueError("the sample tables disagree")
    first = np.cumsum(per_chunk) - per_chunk
    before = np.cumsum(sizes) - sizes
    offsets = np.repeat(chunks - (before[first] if n else 0), per_chunk) + before
    sync = np.ones(n, bool)
    if b"stss" in boxes:
        sync[:] = False
        sync[_numbers(boxes[b"stss"], 1)[:, 0] - 1] = True
    fps = None
    if b"mdhd" in boxes and b"stts" in boxes:
        scale = struct.unpack_from(">I", boxes[b"mdhd"], 20 if boxes[b"mdhd"][0] == 1 else 12)[0]
        times = _numbers(boxes[b"stts"], 2)
        length = int((times[:, 0] * times[:, 1]).sum())
        fps = scale * int(times[:, 0].sum()) / length if length and scale else None
    return Index(offsets, sizes, sync, fps)


def read_index(file, size: int) -> Index:
    """The index of the first video track of an open file; only box heads and the index are read."""
    at = 0
    while at + 8 <= size:
        file.seek(at)
        head = file.read(16)
        length, kind = struct.unpack_from(">I4s", head)
        if length == 1:
            length = struct.unpack_from(">Q", head, 8)[0]
        length = size - at if length == 0 else length
        if length < 8:
            break
        if kind == b"moov":
            file.seek(at)
            for inner, body in _boxes(next(_boxes(file.read(length)))[1]):
                if inner == b"trak":
                    boxes = _leaves(body)
                    if boxes.get(b"hdlr", b"")[8:12] == b"vide" and b"stsz" in boxes:
                        return _track(boxes)
            break
        at += length
    raise ValueError("no sample tables of a video track")


@dataclass
class Part(InputPartition):
    path: str
    size: int
    start: int
    stop: int


class VideoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.skip = int(options.get("frame_skip", 1))
        self.content = str(options.get("content", "false")).lower() == "true"
        self.split = int(options.get("split_bytes", 64 << 20))
        self.skip_broken = str(options.get("skip_broken", "false")).lower() == "true"
        if self.skip <= 0 or self.split <= 0:
            raise ValueError("frame_skip and split_bytes must be positive")

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Part]:
        store, top = self._store()
        info = store.get_file_info(top)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(top, recursive=True)) if f.is_file and f.path.lower().endswith(SUFFIXES)]
        return [Part(f.path, f.size, a, min(a + self.split, f.size)) for f in sorted(found, key=lambda f: f.path) for a in range(0, f.size, self.split)] or [Part("", 0, 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        store, _ = self._store()
        with store.open_input_file(part.path) as file:
            try:
                index = read_index(file, part.size)
            except (ValueError, KeyError, IndexError, struct.error) as e:
                if self.skip_broken:
                    return
                raise ValueError(f"{part.path}: {e}") from e
            mine = np.flatnonzero((index.offsets >= part.start) & (index.offsets < part.stop))
            mine = mine[mine % self.skip == 0]
            for at in range(0, len(mine), 256):
                k = mine[at : at + 256]
                columns = [
                    pa.array([part.path] * len(k)), pa.array(k, pa.int32()), pa.array([index.fps] * len(k), pa.float64()), pa.array(index.sync[k]),
                    pa.array(index.offsets[k], pa.int64()), pa.array(index.sizes[k], pa.int64()),
                ]
                names = ["path", "frame_idx", "fps", "is_sync", "offset", "size"]
                if self.content:
                    columns.append(pa.array([file.read_at(int(index.sizes[i]), int(index.offsets[i])) for i in k], pa.binary()))
                    names.append("content")
                yield pa.RecordBatch.from_arrays(columns, names=names)


class VideoFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "video_frames"

    def schema(self) -> str:
        return SCHEMA + (", content binary" if str(self.options.get("content", "false")).lower() == "true" else "")

    def reader(self, schema) -> VideoReader:
        return VideoReader(self.options)


def scan(spark: SparkSession, path: str, frame_skip: int = 1, content: bool = False, split_bytes: int = 64 << 20, skip_broken: bool = False) -> DataFrame:
    """Frames of the video files at ``path`` (path, frame_idx, fps, is_sync, offset, size[, content]); ids are multiples of ``frame_skip``."""
    spark.dataSource.register(VideoFrames)
    options = {"path": path, "frame_skip": frame_skip, "content": content, "split_bytes": split_bytes, "skip_broken": skip_broken}
    return spark.read.format("video_frames").options(**{k: str(v) for k, v in options.items()}).load()
