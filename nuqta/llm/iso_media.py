"""ISO base media containers in a binary column.

``tracks`` walks the nested boxes of each file, decodes the sample tables (or the fragments'
runs) and gives, per track, the codec, the duration and the byte ranges of the key frames.
Payloads are never read: nothing in ``mdat`` is touched. ``mux`` builds containers, for tables
that have none of their own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import buffers

CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"mvex", b"moof", b"traf", b"dinf"}


#: Nested boxes at most; 64-bit sizes, offsets and times must be under it.
DEEPEST, GREATEST = 16, 1 << 62


#: Bytes of a box's body at least, in version 0 and 1.
LEAST = {b"ftyp": (4, 4), b"tkhd": (16, 24), b"mdhd": (20, 32), b"hdlr": (12, 12), b"stsz": (12, 12), b"stz2": (12, 12), b"trex": (24, 24), b"tfdt": (8, 12)}
LEAST |= dict.fromkeys((b"stsd", b"stts", b"ctts", b"stss", b"stsc", b"stco", b"co64", b"tfhd", b"trun"), (8, 8))


class Malformed(ValueError):
    pass


def bounded(value: int) -> int:
    if value >= GREATEST:
        raise Malformed(f"{value} is no size or time")
    return value


def boxes(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Type and payload range of each box in a range. Size 1 means a 64-bit size, 0 up to
    the end of the range."""
    while at < end:
        if end - at < 8:
            raise Malformed(f"{end - at} stray bytes at {at}")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise Malformed(f"cut box {kind!r} at {at}")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            head += 16
        if size < head or at + size > end:
            raise Malformed(f"box {kind!r} at {at} of {size} bytes goes beyond {end}")
        least = LEAST.get(kind)
        if least and size - head < least[size > head and kind != b"ftyp" and data[at + head] == 1]:
            raise Malformed(f"cut box {kind!r} at {at}")
        yield kind, at + head, at + size
        at += size


def table(data: memoryview, at: int, end: int, dtype: str, columns: int, start: int = 8) -> np.ndarray:
    """Rows of a full box's table whose count is at ``start - 4``."""
    (n,) = struct.unpack_from(">I", data, at + start - 4)
    item = np.dtype(dtype).itemsize * columns
    if at + start + n * item > end:
        raise Malformed(f"a table of {n} entries goes beyond its box at {at}")
    out = np.frombuffer(data, dtype, n * columns, at + start).reshape(n, columns)
    if item == 8 * columns and n:
        bounded(int(out.max()))
    return out.astype(np.int64)


def codec_of(data: memoryview, at: int, end: int) -> str:
    """The first sample entry's code, with the profile bytes of an avcC box."""
    for kind, a, z in boxes(data, at + 8, end):
        name = kind.decode("latin-1").strip()
        if kind in (b"avc1", b"avc3") and z - a > 78:
            for sub, s, _ in boxes(data, a + 78, z):
                if sub == b"avcC":
                    return name + "." + bytes(data[s + 1 : s + 4]).hex()
        return name
    return ""


class Track:
    def __init__(self) -> None:
        self.id = 0
        self.handler = ""
        self.codec = ""
        self.timescale = 0
        self.duration = 0
        self.tables: dict[bytes, np.ndarray] = {}
        self.size = 0
        self.fragments: list[tuple[np.ndarray, ...]] = []  # as samples()
        self.next_time = 0

    def samples(self) -> tuple[np.ndarray, ...]:
        """Offset, size, decoding time, whether it is a key frame, and the time at which it is
        shown, of each sample. Raises Malformed, whatever is wrong with the tables."""
        try:
            return self._samples()
        except Malformed:
            raise
        except (IndexError, OverflowError, ValueError) as error:
            raise Malformed(f"{type(error).__name__}: {error}") from None

    def _samples(self) -> tuple[np.ndarray, ...]:
        t = self.tables
        sizes = t.get(b"stsz", np.zeros(0, np.int64))
        n = len(sizes)
        parts = []
        if n:
            chunk_at = t.get(b"stco", np.zeros(0, np.int64))
            runs = t.get(b"stsc", np.zeros((0, 3), np.int64))
            if not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any():
                raise Malformed("no chunk map, or one out of order")
            per_chunk = np.repeat(runs[:, 1].clip(0, n), np.diff(np.minimum(np.append(runs[:, 0], len(chunk_at) + 1), len(chunk_at) + 1)))
            until = np.cumsum(per_chunk)
            if not len(until) or until[-1] < n:
                raise Malformed("fewer places than samples")
            per_chunk = per_chunk[: np.searchsorted(until, n) + 1]  # no more than the samples need
            chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)[:n]
            before = np.cumsum(sizes) - sizes
            first = np.searchsorted(chunk, np.arange(len(per_chunk)))
            offset = chunk_at[chunk] + before - before[np.minimum(first, n - 1)][chunk]
            stts = t.get(b"stts", np.zeros((0, 2), np.int64))
            if int(stts[:, 0].sum()) < n:
                raise Malformed("fewer times than samples")
            delta = np.repeat(stts[:, 1], np.diff(np.minimum(np.cumsum(stts[:, 0]), n), prepend=0))
            key = np.ones(n, bool)
            if b"stss" in t:
                key[:] = False
                sync = t[b"stss"] - 1
                key[sync[(sync >= 0) & (sync < n)]] = True
            time = np.cumsum(delta) - delta
            shown = time
            if b"ctts" in t:  # what lacks an entry is shown when it is decoded
                counts, shift = np.minimum(np.cumsum(t[b"ctts"][:, 0]), n), t[b"ctts"][:, 1]
                more = np.repeat(shift, np.diff(counts, prepend=0))
                shown = time + np.concatenate([more, np.zeros(n - len(more), np.int64)])
            parts.append((offset, sizes, time, key, shown))
        parts += self.fragments
        if not parts:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool), np.zeros(0, np.int64))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def parse(content: bytes | memoryview) -> tuple[str, list[Track]]:
    """Brand and tracks of a file. Raises Malformed, whatever is wrong with it."""
    try:
        return _parse(content)
    except Malformed:
        raise
    except (struct.error, IndexError, OverflowError, ValueError) as error:
        raise Malformed(f"{type(error).__name__}: {error}") from None


def _parse(content: bytes | memoryview) -> tuple[str, list[Track]]:
    data = memoryview(content)
    brand, tracks, defaults = "", [], {}
    found, total = False, 0

    def trak(at: int, end: int, t: Track, depth: int = 0) -> None:
        if depth > DEEPEST:
            raise Malformed(f"boxes nested more than {DEEPEST} deep")
        for kind, a, z in boxes(data, at, end):
            if kind in (b"mdia", b"minf", b"stbl"):
                trak(a, z, t, depth + 1)
            elif kind == b"tkhd":
                t.id = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
            elif kind == b"mdhd":
                t.timescale, t.duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
                bounded(t.duration)
            elif kind == b"hdlr":
                t.handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
            elif kind == b"stsd":
                t.codec = codec_of(data, a, z)
            elif kind == b"stts":
                t.tables[kind] = table(data, a, z, ">u4", 2)
            elif kind == b"ctts":
                t.tables[kind] = table(data, a, z, ">u4", 2)
                if data[a] == 1:  # signed
                    t.tables[kind][:, 1] = t.tables[kind][:, 1].astype(np.uint32).view(np.int32)
            elif kind == b"stss":
                t.tables[kind] = table(data, a, z, ">u4", 1)[:, 0]
            elif kind == b"stsc":
                t.tables[kind] = table(data, a, z, ">u4", 3)
            elif kind == b"stsz":
                fixed, n = struct.unpack_from(">II", data, a + 4)
                if n * max(1, fixed) > len(data):
                    raise Malformed(f"{n} samples are more than the file holds")
                t.tables[kind] = np.full(n, fixed, np.int64) if fixed else table(data, a, z, ">u4", 1, 12)[:, 0]
            elif kind == b"stz2":
                bits, n = struct.unpack_from(">BI", data, a + 7)
                if bits not in (4, 8, 16):
                    raise Malformed(f"{bits} bits a size")
                if a + 12 + -(-n * bits // 8) > z:
                    raise Malformed("cut size table")
                raw = np.frombuffer(data, np.uint8, -(-n * bits // 8), a + 12)
                t.tables[b"stsz"] = (np.stack([raw >> 4, raw & 15], 1).ravel()[:n] if bits == 4 else raw if bits == 8 else raw.view(">u2")).astype(np.int64)
            elif kind in (b"stco", b"co64"):
                t.tables[b"stco"] = table(data, a, z, ">u4" if kind == b"stco" else ">u8", 1)[:, 0]

    def traf(at: int, end: int, moof: int) -> None:
        nonlocal total
        t, base, dur, size, flags, time = None, moof, 0, 0, 0, None
        after = moof
        for kind, a, z in boxes(data, at, end):
            if kind == b"tfhd":
                bits, number = struct.unpack_from(">II", data, a)
                bits &= 0xFFFFFF
                t = next((x for x in tracks if x.id == number), None)
                dur, size, flags = defaults.get(number, (0, 0, 0))
                p = a + 8
                if bits & 1:
                    base = bounded(struct.unpack_from(">Q", data, p)[0])
                    p += 8
                p += 4 * bool(bits & 2)
                for bit in (8, 16, 32):
                    if bits & bit:
                        v = struct.unpack_from(">I", data, p)[0]
                        dur, size, flags = (v, size, flags) if bit == 8 else (dur, v, flags) if bit == 16 else (dur, size, v)
                        p += 4
                after = base
            elif kind == b"tfdt":
                time = bounded(struct.unpack_from(">Q" if data[a] == 1 else ">I", data, a + 4)[0])
            elif kind == b"trun" and t is not None:
                bits, n = struct.unpack_from(">II", data, a)
                bits &= 0xFFFFFF
                p = a + 8
                if bits & 1:
                    after = base + struct.unpack_from(">i", data, p)[0]
                    p += 4
                first_flags = None
                if bits & 4:
                    first_flags = struct.unpack_from(">I", data, p)[0]
                    p += 4
                fields = [b for b in (0x100, 0x200, 0x400, 0x800) if bits & b]
                total += n
                if p + 4 * n * len(fields) > z or total > len(data):
                    raise Malformed("cut run of samples, or more of them than bytes")
                rows = np.frombuffer(data, ">u4", n * len(fields), p).reshape(n, len(fields)).astype(np.int64)
                col = {b: rows[:, k] for k, b in enumerate(fields)}
                sizes = col.get(0x200, np.full(n, size, np.int64))
                deltas = col.get(0x100, np.full(n, dur, np.int64))
                f = col.get(0x400, np.full(n, flags, np.int64)).copy()
                if first_flags is not None and n:
                    f[0] = first_flags
                begin = t.next_time if time is None else time
                times = begin + np.cumsum(deltas) - deltas
                shift = col.get(0x800, np.zeros(n, np.int64))
                shift = shift.astype(np.uint32).view(np.int32) if data[a] == 1 else shift
                t.fragments.append((after + np.cumsum(sizes) - sizes, sizes, times, (f & 0x10000) == 0, times + shift))
                after += int(sizes.sum())
                t.next_time = begin + int(deltas.sum())
                time = None

    for kind, a, z in boxes(data, 0, len(data)):
        if kind == b"ftyp":
            brand = bytes(data[a : a + 4]).decode("latin-1")
        elif kind == b"moov":
            found = True
            for sub, s, e in boxes(data, a, z):
                if sub == b"trak":
                    tracks.append(Track())
                    trak(s, e, tracks[-1])
                elif sub == b"mvex":
                    for x, i, _ in boxes(data, s, e):
                        if x == b"trex":
                            number, _, dur, size, flags = struct.unpack_from(">5I", data, i + 4)
                            defaults[number] = dur, size, flags
        elif kind == b"moof":
            for sub, s, e in boxes(data, a, z):
                if sub == b"traf":
                    traf(s, e, a - 8)
    if not found:
        raise Malformed("no moov box")
    return brand, tracks


TRACKS = "media_id long, track_id long, brand string, handler string, codec string, timescale long, duration_s double, n_samples long, n_bytes long, keyframes array<struct<offset:long,size:long,time_s:double>>, error string"


def tracks(media: DataFrame, *, id: str = "media_id", content: str = "content") -> DataFrame:  # noqa: A002
    """One row for each track of each file of a binary column: media_id, track_id, brand,
    handler, codec, timescale, duration_s, n_samples, n_bytes, the key frames' (offset, size,
    time_s, when they are shown) and error.

    A file that is cut, malformed in whatever way, empty or without moov gives one row with
    ``error`` and nulls; a null file one with error ``null``; a file without tracks gives one with error
    ``no track``; a null id is kept; repeated rows give repeated results; an empty table an
    empty result. The duration is the media header's, or where that is 0, the end of the last
    sample. Only the id and the content are read, and of the content no payload."""
    schema = pa.schema([("media_id", pa.int64()), ("track_id", pa.int64()), *[(c, pa.string()) for c in ("brand", "handler", "codec")], ("timescale", pa.int64()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("n_bytes", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64()), ("time_s", pa.float64())]))), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            data, offsets = buffers(b.column(1))
            null = b.column(1).is_null().to_numpy(zero_copy_only=False)
            whole = memoryview(data)
            rows, frames = [], []
            for i, media in enumerate(ids):
                why, found = None, []
                if null[i]:
                    why = "null"
                else:
                    try:
                        brand, found = parse(whole[offsets[i] : offsets[i + 1]])
                        parts = [t.samples() for t in found]
                        why = None if found else "no track"
                    except Malformed as error:
                        why = str(error)
                if why is not None:
                    rows.append((media, None, None, None, None, None, None, None, None, why))
                    frames.append(None)
                    continue
                for t, (at, size, time, key, shown) in zip(found, parts, strict=True):
                    scale = t.timescale or 1
                    end = t.duration or (max(t.next_time, int(time.max())) if len(time) else 0)
                    rows.append((media, t.id, brand, t.handler, t.codec, t.timescale, end / scale, len(size), int(size.sum()), None))
                    frames.append((at[key], size[key], shown[key] / scale))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 10
            n = np.array([0 if f is None else len(f[0]) for f in frames], np.int64)
            flat = [np.concatenate([f[k] for f in frames if f is not None]) if n.any() else np.zeros(0) for k in range(3)]
            key = pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.int64)), pa.array(flat[2].astype(float))], names=["offset", "size", "time_s"])
            none = np.array([f is None for f in frames], bool)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), key, mask=pa.array(none) if none.any() else None)
            arrays = [pa.array(c, schema.field(k).type) for k, c in enumerate(columns[:9])]
            yield pa.RecordBatch.from_arrays([*arrays, lists.cast(schema.field("keyframes").type), pa.array(columns[9], pa.string())], schema=schema)

    return media.select(F.col(id).cast("long").alias("media_id"), F.col(content).cast("binary")).mapInArrow(run, TRACKS)


# --- building containers -----------------------------------------------------------------


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _u32(values: object) -> bytes:
    return np.asarray(values, ">u4").tobytes()


def mux(payload: bytes, *, every: int = 12, sample: int = 400, wide: bool = False, fragmented: bool = False) -> bytes:
    """A file of one video track whose samples of ``sample`` bytes are cut from ``payload``,
    a key frame each ``every``, and one audio track of a fixed sample size over the same
    bytes. ``wide``: 64-bit offsets and sizes; ``fragmented``: in moof boxes."""
    sizes = np.full(-(-len(payload) // sample), sample)
    if len(sizes):
        sizes[-1] = len(payload) - sample * (len(sizes) - 1)
    n = len(sizes)
    avc = box(b"avc1", bytes(78), box(b"avcC", bytes([1, 0x64, 0, 0x1F, 0xFF, 0xE0, 0])))
    mp4a = box(b"mp4a", bytes(28))
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso6mp41")
    beats = len(payload) // 64

    def trak(number: int, handler: bytes, entry: bytes, stbl: bytes, scale: int, duration: int) -> bytes:
        tkhd = full(b"tkhd", struct.pack(">5I", 0, 0, number, 0, duration), bytes(60), flags=3)
        mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, scale, duration, 0x55C4, 0))
        hdlr = full(b"hdlr", bytes(4), handler, bytes(12), b"h\0")
        return box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, box(b"minf", box(b"stbl", full(b"stsd", struct.pack(">I", 1), entry), stbl))))

    def places(offsets: list[int]) -> bytes:
        return full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), np.asarray(offsets, ">u8" if wide else ">u4").tobytes())

    if fragmented:
        none = full(b"stts", _u32([0])) + full(b"stsc", _u32([0])) + full(b"stsz", _u32([0, 0])) + places([])
        trex = full(b"trex", _u32([1, 1, 512, 0, 0x10000]))
        moov = box(b"moov", full(b"mvhd", struct.pack(">4I", 0, 0, 12800, 0), bytes(80)), trak(1, b"vide", avc, none, 12800, 0), box(b"mvex", trex))
        out = [ftyp, moov]
        for k in range(0, n, every):
            part = sizes[k : k + every]
            trun = lambda at: full(b"trun", struct.pack(">IiI", len(part), at, 0), _u32(part), flags=0x205)  # noqa: B023, E731
            moof = lambda at: box(b"moof", full(b"mfhd", _u32([k // every + 1])), box(b"traf", full(b"tfhd", _u32([1]), flags=0x20000), full(b"tfdt", struct.pack(">Q", k * 512), version=1), trun(at)))  # noqa: B023, E731
            body = payload[k * sample : k * sample + int(part.sum())]
            out += [moof(len(moof(0)) + 8), box(b"mdat", body)]
        return b"".join(out)

    def moov(start: int) -> bytes:
        chunks_at = [start + k * sample for k in range(0, n, every)]
        count = [min(every, n - k) for k in range(0, n, every)]
        runs = [(i + 1, c, 1) for i, c in enumerate(count) if i == 0 or c != count[i - 1]]
        keys = list(range(1, n + 1, every))
        video = full(b"stts", _u32([1, n, 512])) + full(b"stss", struct.pack(">I", len(keys)), _u32(keys)) + full(b"stsc", struct.pack(">I", len(runs)), _u32(runs)) + full(b"stsz", _u32([0, n]), _u32(sizes)) + places(chunks_at)
        audio = full(b"stts", _u32([1, beats, 1024])) + full(b"stsc", _u32([1, 1, max(1, beats), 1])) + full(b"stsz", _u32([64, beats])) + places([start])
        return box(b"moov", full(b"mvhd", struct.pack(">4I", 0, 0, 12800, n * 512), bytes(80)), trak(1, b"vide", avc, video, 12800, n * 512), trak(2, b"soun", mp4a, audio, 44100, beats * 1024))

    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    start = len(ftyp) + len(moov(0)) + len(head)
    return ftyp + moov(start) + head + payload


def media_of(docs: DataFrame) -> DataFrame:
    """media_id and content: a container for every document, holding its whole text. Every
    third is fragmented, every fifth of the others has 64-bit offsets. A null text is a null
    container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(1))
            raw = data.tobytes()
            null = b.column(1).is_null().to_pylist()
            out, size, at = [], 0, 0
            ids = b.column(0)
            for i, number in enumerate(ids.to_pylist()):
                k = number or 0
                out.append(None if null[i] else mux(raw[offsets[i] : offsets[i + 1]], every=8 + k % 9, wide=k % 5 == 1, fragmented=k % 3 == 2))
                size += len(out[-1] or b"")
                if size > 4 << 20 or i + 1 == len(ids):
                    yield pa.RecordBatch.from_arrays([ids.slice(at, i + 1 - at), pa.array(out, pa.binary())], names=["media_id", "content"])
                    out, size, at = [], 0, i + 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "media_id long, content binary")
