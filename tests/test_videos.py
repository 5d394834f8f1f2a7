"""Video scan over files that this test writes: the frames and bytes that were put in, in any split."""

import random
import struct

import numpy as np
import pytest

from trackloom.config import DEFAULT
from trackloom.sources import sequences as S, videos


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def numbers(*rows):
    return struct.pack(">II", 0, len(rows)) + b"".join(struct.pack(f">{len(r)}I", *r) for r in rows)


def video(frames, per_chunk, *, scale=600, deltas=((None, 20),), sync=None, wide=False, uniform=False, index_first=False, other=True):
    """An MP4 file: chunks of ``per_chunk`` frames with gaps, and its tables."""
    head = box(b"ftyp", b"isom0000")
    counts = [n for n, _ in zip([per_chunk] * len(frames), range(0, len(frames), per_chunk))]
    if frames:
        counts[-1] = len(frames) - per_chunk * (len(counts) - 1)
    groups = [(1, per_chunk, 1)] + ([(len(counts), counts[-1], 1)] if frames and counts[-1] != per_chunk else [])
    groups = groups if frames and not (len(groups) == 2 and groups[1][0] == 1) else ([(1, counts[0], 1)] if frames else [])

    def index(chunks):
        table = [
            box(b"stts", numbers(*[(len(frames) if n is None else n, d) for n, d in deltas])) if deltas is not None else b"",
            box(b"stsz", struct.pack(">III", 0, len(frames[0]) if uniform else 0, len(frames)), b"" if uniform else b"".join(struct.pack(">I", len(f)) for f in frames)),
            box(b"stsc", numbers(*groups)),
            box(b"co64", struct.pack(">II", 0, len(chunks)), b"".join(struct.pack(">Q", c) for c in chunks)) if wide else box(b"stco", numbers(*[(c,) for c in chunks])),
            box(b"stss", numbers(*[(s + 1,) for s in sync])) if sync is not None else b"",
        ]
        media = lambda kind, *inner: box(b"mdia", box(b"mdhd", struct.pack(">IIIII", 0, 0, 0, scale, 0)), box(b"hdlr", struct.pack(">II4s", 0, 0, kind)), box(b"minf", *inner))
        sound = box(b"trak", media(b"soun", box(b"stbl", box(b"stsz", struct.pack(">III", 0, 4, 0))))) if other else b""
        return box(b"moov", box(b"mvhd", b"\0" * 20), sound, box(b"trak", media(b"vide", box(b"stbl", *table))))

    def body(start):
        out, chunks, at = b"", [], 0
        for n in counts:
            out += b"gap!"
            chunks.append(start + len(out))
            out += b"".join(frames[at : at + n])
            at += n
        return out, chunks

    before = len(head) + (len(index([0] * len(counts))) if index_first else 0) + 8
    data, chunks = body(before)
    return head + (index(chunks) + box(b"mdat", data) if index_first else box(b"mdat", data) + index(chunks))


def some_frames(seed, n, equal=False):
    rng = random.Random(seed)
    return [rng.randbytes(40 if equal else rng.randint(1, 90)) for _ in range(n)]


CASES = {
    "plain": dict(frames=some_frames(1, 23), per_chunk=4),
    "index_first": dict(frames=some_frames(2, 40), per_chunk=7, index_first=True, sync=[0, 10, 39], other=False),
    "wide": dict(frames=some_frames(3, 9), per_chunk=3, wide=True, deltas=((4, 10), (5, 40))),
    "equal": dict(frames=some_frames(4, 12, True), per_chunk=5, uniform=True, scale=30, deltas=((None, 1),)),
    "no_rate": dict(frames=some_frames(5, 5), per_chunk=5, deltas=((None, 0),)),
    "no_times": dict(frames=some_frames(6, 3), per_chunk=2, deltas=None),
    "no_frames": dict(frames=[], per_chunk=1),
}
FPS = {"plain": 30.0, "index_first": 30.0, "wide": 600 * 9 / 240, "equal": 30.0, "no_rate": None, "no_times": None}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("videos")
    (top / "deep").mkdir()
    for k, (name, case) in enumerate(CASES.items()):
        (top / ("deep" if k % 2 else "") / f"{name}.mp4").write_bytes(video(**case))
    (top / "readme.txt").write_text("no video")
    return top


@pytest.mark.parametrize(("split", "skip"), [(64 << 20, 1), (100, 1), (333, 3)])
def test_every_frame_once_with_its_bytes(spark, folder, split, skip):
    df = videos.scan(spark, str(folder), skip, content=True, split_bytes=split)
    got = {(r.path.rsplit("/", 1)[1][:-4], r.frame_idx): (bytes(r.content), r.size, r.fps, r.is_sync) for r in df.collect()}
    want = {}
    for name, case in CASES.items():
        for k, f in enumerate(case["frames"]):
            if k % skip == 0:
                want[name, k] = (f, len(f), FPS[name], k in case["sync"] if "sync" in case else True)
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and got[k][3] == want[k][3] and got[k][2] == pytest.approx(want[k][2]) for k in want)
    assert df.count() == len(want)
    if split == 100:
        assert df.rdd.getNumPartitions() > 30


def test_scan_gives_frame_rows_with_the_default_rate(spark, folder):
    rows = S.video_frames(videos.scan(spark, f"file://{folder}"), 2).collect()
    rate = {r.sequence_id: r.frame_rate for r in rows}
    assert rate["no_rate"] == rate["no_times"] == DEFAULT.vision.default_fps and rate["wide"] == 22
    assert sorted(r.frame_id for r in rows if r.sequence_id == "wide") == [0, 2, 4, 6, 8]


def test_only_wanted_bytes_are_read(tmp_path):
    case = CASES["index_first"]
    data = video(**case)
    (tmp_path / "v.mp4").write_bytes(data)
    reader = videos.VideoReader({"path": str(tmp_path), "content": "true", "frame_skip": "10"})
    seen = []

    class Store:
        def open_input_file(self, path):
            file = videos.fs.LocalFileSystem().open_input_file(path)

            class Spy:
                __enter__, __exit__ = lambda s: s, lambda s, *e: file.close()
                seek, read = file.seek, staticmethod(lambda n: (seen.append(n), file.read(n))[1])
                read_at = staticmethod(lambda n, at: (seen.append(n), file.read_at(n, at))[1])

            return Spy()

    (part,) = reader.partitions()
    reader._store = lambda: (Store(), "")
    assert sum(b.num_rows for b in reader.read(part)) == 4
    assert sum(seen) < len(data) - sum(map(len, case["frames"])) + 4 * 90 + 100


def test_broken_files(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"\0\0\0\x08free")
    (tmp_path / "b.mp4").write_bytes(video(**CASES["plain"])[:-30])
    (tmp_path / "c.mp4").write_bytes(video(**CASES["plain"]))
    with pytest.raises(Exception, match="mp4"):
        videos.scan(spark, str(tmp_path)).collect()
    assert videos.scan(spark, str(tmp_path), skip_broken=True).select("path").distinct().count() == 1
    with pytest.raises(Exception, match="positive"):
        videos.scan(spark, str(tmp_path), frame_skip=0).collect()
    (tmp_path / "none").mkdir()
    assert videos.scan(spark, str(tmp_path / "none")).count() == 0


def test_offsets_of_the_index():
    data = video(**CASES["plain"])
    import io

    index = videos.read_index(io.BytesIO(data), len(data))
    assert [data[o : o + s] for o, s in zip(index.offsets, index.sizes)] == CASES["plain"]["frames"] and np.all(index.sync)
