"""ISO base media containers: boxes, sample tables and byte ranges, payloads left alone.

``probe`` walks nested boxes of a file, decodes the sample tables of each track
(stsd, stts, stsc, stsz, stco/co64, stss) and the sample runs of fragments (tfhd, trun) and gives codec, duration and the byte range
of every sample and keyframe. It reads box headers and tables only. ``mux`` stores a
payload as 8-bit samples of one track, without loss.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import blocks, bounded, texts

#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
SAMPLE_BYTES = 1024
SAMPLES_IN_CHUNK = 8
KEY_EVERY = 16
RATE = 8000


class Track(NamedTuple):
    codec: str
    timescale: int
    duration: int
    starts: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray  # indices of keyframes


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    return struct.pack(">I4s", size, kind) + b"".join(parts) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes, sample: int = SAMPLE_BYTES, per_chunk: int = SAMPLES_IN_CHUNK, key_every: int = KEY_EVERY) -> bytes:
    """A one-track file whose samples are ``payload``'s bytes as unsigned 8-bit audio."""
    n = -(-len(payload) // sample)
    last = len(payload) - (n - 1) * sample
    chunks = -(-n // per_chunk)
    tail = n - (chunks - 1) * per_chunk
    duration = len(payload)
    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
    stts = [(n, sample)] if last == sample else ([(n - 1, sample)] if n > 1 else []) + [(1, last)]
    stsc = [(1, per_chunk)] if tail == per_chunk else ([(1, per_chunk)] if chunks > 1 else []) + [(chunks, tail)]
    keys = range(1, n + 1, key_every)

    def stbl(base: int) -> bytes:
        return box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">I", len(stts)), b"".join(struct.pack(">II", *x) for x in stts)),
            full(b"stss", struct.pack(f">{1 + len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(stsc)), b"".join(struct.pack(">III", first, k, 1) for first, k in stsc)),
            full(b"stsz", struct.pack(">II", 0, n), np.concatenate((np.full(n - 1, sample), [last])).astype(">u4").tobytes()),
            full(b"co64", struct.pack(">I", chunks), (base + np.arange(chunks, dtype=np.int64) * sample * per_chunk).astype(">u8").tobytes()),
        )

    def moov(base: int) -> bytes:
        return box(
            b"moov",
            full(b"mvhd", struct.pack(">IIQQ", 0, 0, 0, 0)[:8] + struct.pack(">II", RATE, min(duration, 0xFFFFFFFF)), struct.pack(">IH10x", 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2)),
            box(
                b"trak",
                full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, min(duration, 0xFFFFFFFF)), struct.pack(">8xHHHxx", 0, 0, 0x100), matrix, struct.pack(">II", 0, 0), flags=3),
                box(
                    b"mdia",
                    full(b"mdhd", struct.pack(">QQIQ", 0, 0, RATE, duration), struct.pack(">HH", 0x55C4, 0), version=1),
                    full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"samples\0"),
                    box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl(base)),
                ),
            ),
        )

    base = len(head) + len(moov(0)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return head + moov(base) + box(b"mdat", payload)


def walk(data: memoryview) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """(path, box start, content start, end) of every box, nested boxes after their container, to any depth."""
    todo: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while todo:
        start, end, path = todo.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start}: its size passes its container")
        own = (*path[-8:], kind)
        yield own, start, start + head, start + size
        todo.append((start + size, end, path))
        if kind in CONTAINERS:
            todo.append((start + head, start + size, own))


def table(data: memoryview, at: int, width: int, kind: str, skip: int = 4) -> np.ndarray:
    """Rows of a counted table, as long as the file holds them; ``ValueError`` where it doesn't."""
    (n,) = struct.unpack_from(">I", data, at + skip)
    return np.frombuffer(data, kind, n * width, at + skip + 4).astype(np.int64).reshape(n, width)


def probe(data: bytes) -> list[Track]:
    """The tracks of a file, in order, with the samples of movie fragments after those of the sample tables.

    Raises ``ValueError`` where boxes or tables contradict each other or pass the file's end;
    no table takes more room than the file's size allows.
    """
    view, tracks, now = memoryview(data), [], None
    defaults: dict[int, tuple[int, int, int]] = {}  # of fragments, by track: sample duration, size and flags
    moof, fragment = 0, None
    for path, box_at, start, end in walk(view):
        kind = path[-1]
        if kind == b"trak":
            tracks.append(now := {"id": len(tracks) + 1, "runs": []})
        elif kind == b"trex":
            track, _, *given = struct.unpack_from(">5I", view, start + 4)
            defaults[track] = tuple(given)
        elif kind == b"moof":
            moof = box_at
        elif kind == b"tfhd":
            fragment = _fragment(view, start, moof, defaults)
        elif kind == b"trun" and fragment:
            own = next((t for t in tracks if t["id"] == fragment["id"]), None)
            if own is None:
                raise ValueError("a fragment of no track")
            own["runs"].append(_run(view, start, fragment, len(data)))
        elif now is None:
            continue
        elif kind == b"tkhd":
            (now["id"],) = struct.unpack_from(">I", view, start + (20 if view[start] == 1 else 12))
        elif kind == b"mdhd":
            now["scale"], now["duration"] = struct.unpack_from(">IQ", view, start + 20) if view[start] == 1 else struct.unpack_from(">II", view, start + 12)
        elif kind == b"stsd":
            now["codec"] = bytes(view[start + 12 : start + 16]).decode("latin-1")
        elif kind == b"stsz":
            size, n = struct.unpack_from(">II", view, start + 4)
            if size and n * size > len(data):
                raise ValueError("samples pass the file's end")
            now["sizes"] = np.full(n, size, np.int64) if size else table(view, start, 1, ">u4", 8)[:, 0]
        elif kind in (b"stco", b"co64"):
            now["chunks"] = table(view, start, 1, ">u4" if kind == b"stco" else ">u8")[:, 0]
        elif kind in (b"stts", b"stss", b"stsc"):
            now[kind.decode()] = table(view, start, {b"stts": 2, b"stss": 1, b"stsc": 3}[kind], ">u4")
    return [_track(t, len(data)) for t in tracks]


def _fragment(view: memoryview, at: int, moof: int, defaults: dict) -> dict:
    flags, track = struct.unpack_from(">II", view, at)
    flags, at = flags & 0xFFFFFF, at + 8
    out = {"id": track, "base": moof, "next": None}
    if flags & 1:
        (out["base"],), at = struct.unpack_from(">Q", view, at), at + 8
    if flags & 2:
        at += 4
    for bit, name, usual in zip((8, 16, 32), ("duration", "size", "flags"), defaults.get(track, (0, 0, 0))):
        out[name] = usual
        if flags & bit:
            (out[name],), at = struct.unpack_from(">I", view, at), at + 4
    return out


def _run(view: memoryview, at: int, fragment: dict, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Starts, sizes, keyframe marks and duration of a run of a fragment's samples."""
    flags, n = struct.unpack_from(">II", view, at)
    flags, at = flags & 0xFFFFFF, at + 8
    start = fragment["base"] if fragment["next"] is None else fragment["next"]
    if flags & 1:
        (offset,), at = struct.unpack_from(">i", view, at), at + 4
        start = fragment["base"] + offset
    first = None
    if flags & 4:
        (first,), at = struct.unpack_from(">I", view, at), at + 4
    fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
    if n > length:
        raise ValueError("samples pass the file's end")
    rows = np.frombuffer(view, ">u4", n * len(fields), at).astype(np.int64).reshape(n, len(fields))
    column = lambda bit, usual: rows[:, fields.index(bit)] if bit in fields else np.full(n, usual, np.int64)
    sizes, marks = column(0x200, fragment["size"]), column(0x400, fragment["flags"]).copy()
    if first is not None and n:
        marks[0] = first
    starts = start + np.cumsum(sizes) - sizes
    fragment["next"] = int(start + sizes.sum())
    return starts, sizes, marks & 0x10000 == 0, int(column(0x100, fragment["duration"]).sum())


def _track(t: dict, length: int) -> Track:
    none = np.empty(0, np.int64)
    sizes, chunks, runs, times = t.get("sizes", none), t.get("chunks", none), t.get("stsc", none.reshape(0, 3)), t.get("stts", none.reshape(0, 2))
    n = len(sizes)
    in_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
    if in_chunk.sum() != n or times[:, 0].sum() != n:
        raise ValueError("sample tables do not agree on the number of samples")
    in_chunk, chunks = in_chunk[in_chunk > 0], chunks[: len(in_chunk)][in_chunk > 0]
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(in_chunk) - in_chunk
    starts = np.repeat(chunks - before[first], in_chunk) + before if n else none
    keys = t["stss"][:, 0] - 1 if "stss" in t else np.arange(n)
    duration = int((times[:, 0] * times[:, 1]).sum())
    for more, own, key, took in t["runs"]:
        keys = np.append(keys, len(sizes) + np.flatnonzero(key))
        starts, sizes, duration = np.append(starts, more), np.append(sizes, own), duration + took
    if len(sizes) and (starts.min() < 0 or (starts + sizes).max() > length):
        raise ValueError("samples pass the file's end")
    return Track(t["codec"], int(t["scale"]), duration or int(t["duration"]), starts, sizes, keys)


def key_ranges(track: Track) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each keyframe's bytes."""
    starts = track.starts[track.keys]
    return starts, starts + track.sizes[track.keys]


def samples(data: bytes, track: Track) -> bytes:
    """The stored payload: adjoining samples are read as one range."""
    view, starts, ends = memoryview(data), track.starts, track.starts + track.sizes
    if not len(starts):
        return b""
    cut = np.flatnonzero(starts[1:] != ends[:-1]) + 1
    return b"".join(view[s:e] for s, e in zip(starts[np.r_[0, cut]].tolist(), ends[np.r_[cut - 1, len(ends) - 1]].tolist()))


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary): each text's bytes in a container of its own.

    Null is the empty text, whose payload is 64 zero bytes. One row per input row,
    other columns are not read; a narrow map, a file at a time.
    """
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            raw = [t.encode() for t in texts(block)]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(map(len, raw), pa.int64()), pa.array([mux(padded(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return bounded(source).mapInArrow(run, "doc_id long, n_bytes long, media binary")


INSPECTED = "doc_id long, n_bytes long, codec string, timescale long, duration long, n_samples long, key_starts array<long>, key_ends array<long>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tracks array<struct<codec:string,timescale:long,duration:long,n_samples:long,key_starts:array<long>,key_ends:array<long>>>, error string"


_TRACKS = pa.list_(pa.struct([("codec", pa.string()), *((c, pa.int64()) for c in ("timescale", "duration", "n_samples")), ("key_starts", pa.list_(pa.int64())), ("key_ends", pa.list_(pa.int64()))]))


def inspect(stored: DataFrame) -> DataFrame:
    """Columns of each stored file: codec, duration, keyframe byte ranges, and digests of what it holds.

    These are of the first track; ``tracks`` has them for every track. A file that is null, has no track or contradicts itself gets nulls and an ``error``.
    Extra columns are dropped.
    """

    def one(media: bytes | None) -> dict:
        if media is None:
            return {"error": "no file"}
        out = {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
        try:
            found = probe(media)
            tracks = []
            for t in found:
                starts, ends = key_ranges(t)
                tracks.append({"codec": t.codec, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.sizes), "key_starts": starts, "key_ends": ends})
            payload = samples(media, found[0])
        except (ValueError, KeyError, IndexError, OverflowError, struct.error) as e:
            return out | {"error": str(e) or type(e).__name__}
        return out | tracks[0] | {"tracks": tracks, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:])}

    names = stored.sparkSession.createDataFrame([], INSPECTED).columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "media"):
            found = [one(m) for m in block.column("media").to_pylist()]
            kinds = {"codec": pa.string(), "key_starts": pa.list_(pa.int64()), "key_ends": pa.list_(pa.int64()), "payload_sha256": pa.string(), "media_sha256": pa.string(), "error": pa.string(), "tracks": _TRACKS}
            cols = [block.column(c) if c in ("doc_id", "n_bytes") else pa.array([f.get(c) for f in found], kinds.get(c, pa.int64())) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    return bounded(stored.select("doc_id", "n_bytes", "media")).mapInArrow(run, INSPECTED)


def digests(inspected: DataFrame) -> DataFrame:
    ranges = F.array_join(F.zip_with("key_starts", "key_ends", lambda s, e: F.concat_ws("-", s, e)), ",")
    return inspected.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(";", F.concat(F.lit("codec="), "codec"), F.concat(F.lit("timescale="), "timescale"), F.concat(F.lit("duration="), "duration"), F.concat(F.lit("samples="), "n_samples"), F.concat(F.lit("keyframes="), ranges)).alias("feature"),
    )
