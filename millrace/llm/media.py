"""Media columns: AVI files of motion-JPEG to timed clip rows, one for each shot."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg

WINDOW = 6
FACTOR = 4.0
LEAST = 0.25


class AviError(ValueError):
    """A file that isn't an AVI of motion-JPEG."""


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start of body, end of body) of the chunks between two places; a truncated last one is cut."""
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield bytes(data[at : at + 4]), at + 8, min(at + 8 + size, end)
        at += 8 + size + (size & 1)


def parse_avi(data: bytes) -> tuple[list[tuple[int, int]], float, str]:
    """Frames as (start, end) in the file, microseconds a frame, and where the frames were found: ``indx``, ``idx1`` or ``scan``.

    The OpenDML index is used if there is one, else the old index of a file with a single movi list, whose
    places count from the list or from the start of the file; an index that doesn't lead to frames is passed over, and the movi
    lists are scanned.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise AviError("not an AVI file")
    micros, stream, handler, number = 0.0, -1, b"", -1
    movi: list[tuple[int, int]] = []
    old: tuple[int, int] | None = None
    super_at: list[tuple[int, int]] = []
    for name, a, b in chunks(data, 0, len(data)):
        if name != b"RIFF":
            continue
        for name, a1, b1 in chunks(data, a + 4, b):
            kind = bytes(data[a1 : a1 + 4])
            if name == b"LIST" and kind == b"movi":
                movi.append((a1, b1))
            elif name == b"idx1":
                old = (a1, b1)
            elif name == b"LIST" and kind == b"hdrl":
                for name, a2, b2 in chunks(data, a1 + 4, b1):
                    if name == b"avih" and b2 - a2 >= 4:
                        micros = micros or float(struct.unpack_from("<I", data, a2)[0])
                    elif name == b"LIST" and bytes(data[a2 : a2 + 4]) == b"strl":
                        number += 1
                        for name, a3, b3 in chunks(data, a2 + 4, b2):
                            if name == b"strh" and b3 - a3 >= 28 and bytes(data[a3 : a3 + 4]) == b"vids" and stream < 0:
                                stream, handler = number, bytes(data[a3 + 4 : a3 + 8])
                                scale, rate = struct.unpack_from("<II", data, a3 + 20)
                                micros = 1e6 * scale / rate if scale and rate else micros
                            elif name == b"strf" and stream == number and b3 - a3 >= 20:
                                handler = bytes(data[a3 + 16 : a3 + 20]) if handler.strip(b"\0 ") == b"" else handler
                            elif name == b"indx" and stream == number and b3 - a3 >= 24:
                                size, _, _, used = struct.unpack_from("<HBBI", data, a3)
                                super_at = [struct.unpack_from("<QI", data, a3 + 24 + 16 * k) for k in range(min(used, (b3 - a3 - 24) // 16))] if size == 4 else []
    if stream < 0:
        raise AviError("no video stream")
    if handler.upper() not in (b"MJPG", b"JPEG", b"AVRN", b"DMB1"):
        raise AviError("not motion-JPEG")
    if micros <= 0:
        raise AviError("no frame rate")
    names = (b"%02ddc" % stream, b"%02ddb" % stream)
    good = lambda at, end: 0 <= at < end <= len(data) and data[at : at + 2] == b"\xff\xd8"
    frames: list[tuple[int, int]] = []
    for at, _ in super_at:
        if at + 32 <= len(data) and bytes(data[at : at + 4]) in (b"ix%02d" % stream,):
            used, base = struct.unpack_from("<I", data, at + 12)[0], struct.unpack_from("<Q", data, at + 20)[0]
            for k in range(min(used, (len(data) - at - 32) // 8)):
                off, size = struct.unpack_from("<II", data, at + 32 + 8 * k)
                size &= 0x7FFFFFFF
                frames.append((base + off, base + off + size))
    if frames and good(*frames[0]):
        return [(a, min(b, len(data))) for a, b in frames if a < len(data)], micros, "indx"
    if old and len(movi) == 1:  # it covers the first list only
        entries = [struct.unpack_from("<4sIII", data, at) for at in range(old[0], old[1] - 15, 16)]
        entries = [(off, size) for name, _, off, size in entries if name in names]
        for base in (movi[0][0], 0):
            if entries and good(base + entries[0][0] + 8, min(base + entries[0][0] + 8 + entries[0][1], len(data))):
                return [(base + off + 8, min(base + off + 8 + size, len(data))) for off, size in entries if base + off + 8 < len(data)], micros, "idx1"
    frames = []
    for a, b in movi:
        for name, x, y in chunks(data, a + 4, b):
            if name in names:
                frames.append((x, y))
            elif name == b"LIST" and bytes(data[x : x + 4]) == b"rec ":
                frames += [(p, q) for name, p, q in chunks(data, x + 4, y) if name in names]
    return frames, micros, "scan"


def histogram(counts: np.ndarray) -> np.ndarray:
    """Shares of pixels by luma in 32 classes, smoothed so that a slight drift over a bound counts little, and by each chroma in 8, from counts of 256 values of each."""
    n = counts[0].sum()
    luma = np.convolve(np.pad(counts[0].reshape(32, 8).sum(1), 2, "reflect"), [1 / 9, 2 / 9, 3 / 9, 2 / 9, 1 / 9], "valid")
    return np.concatenate([luma, *counts[1:].reshape(2, 8, 32).sum(2)]) / n


def value_counts(frames: Sequence[bytes]) -> np.ndarray:
    """For each of the frames, which share a header: (frames, 3, 256), pixels by value of luma and chroma."""
    counts = np.zeros((len(frames), 3, 256), np.int64)
    for at, pixels in jpeg.bands(frames):
        n = len(pixels)
        for k in range(3):
            index = np.arange(n)[:, None] * 256 + pixels[:, :, :, k].reshape(n, -1)
            counts[at : at + n, k] += np.bincount(index.ravel(), minlength=256 * n).reshape(n, 256)
    return counts


def frame_counts(frames: Sequence[bytes]) -> list[np.ndarray | None]:
    """As :func:`value_counts` for any frames; frames in a row that share a header are decoded at once. None for a frame that is damaged."""
    out: list[np.ndarray | None] = []
    at = 0
    while at < len(frames):
        to = at + 1
        try:
            head = jpeg.header(frames[at])
            while to < len(frames) and to - at < 256 and frames[to].startswith(head):
                to += 1
            out += list(value_counts(frames[at:to]))
        except _DAMAGE:
            if to - at == 1:
                out.append(None)
            for f in frames[at:to] if to - at > 1 else ():
                try:
                    out.append(value_counts([f])[0])
                except _DAMAGE:
                    out.append(None)
        at = to
    return out


#: Whatever bytes do to a decoder that reads them as a frame.
_DAMAGE = (ValueError, IndexError, KeyError, OverflowError, ZeroDivisionError, struct.error)


def shot_starts(histograms: Sequence[np.ndarray | None], window: int = WINDOW, factor: float = FACTOR, least: float = LEAST) -> list[int]:
    """Frames with which shots begin, the first included.

    A frame begins a shot if its histogram differs from the last good one's by more than ``least`` of the
    pixels, and by more than ``factor`` standard deviations above the mean of the differences within
    ``window`` frames on both sides, its own left out. Damaged frames (None) have no difference.
    """
    n = len(histograms)
    d = np.zeros(n)
    before = None
    for k, h in enumerate(histograms):
        if h is not None:
            if before is not None:
                d[k] = np.abs(h - before).sum() / 2
            before = h
    starts = [0] if n else []
    for k in range(1, n):
        if d[k] <= least:
            continue
        near = np.concatenate([d[max(1, k - window) : k], d[k + 1 : k + 1 + window]])
        # neighbours that are cuts themselves don't raise the bar
        near = near[near < d[k] / 2]
        mean, spread = (near.mean(), near.std()) if len(near) else (0.0, 0.0)
        if d[k] > mean + factor * spread:
            starts.append(k)
    return starts


def clips(data: bytes | None) -> list[tuple]:
    """(shot, first_frame, last_frame, start_us, end_us, luma, damaged, index, error) for each shot of a file, or one row with an error."""
    try:
        if not data:
            raise AviError("no data")
        places, micros, how = parse_avi(data)
        if not places:
            raise AviError("no frames")
    except (AviError, struct.error, OverflowError) as e:
        return [(None, None, None, None, None, None, 0, None, str(e))]
    seen: list[np.ndarray | None] = []
    luma: list[float] = []
    for at in range(0, len(places), 1024):
        for counts in frame_counts([data[a:b] for a, b in places[at : at + 1024]]):  # a damaged frame keeps its time
            seen.append(None if counts is None else histogram(counts))
            luma.append(np.nan if counts is None else float(counts[0] @ np.arange(256) / counts[0].sum()))
    if all(h is None for h in seen):
        return [(None, None, None, None, None, None, len(seen), how, "no frame can be decoded")]
    starts = shot_starts(seen)
    out = []
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(seen)])):
        own = [x for x in luma[a:b] if x == x]
        out.append((k, a, b - 1, round(a * micros), round(b * micros), round(sum(own) / len(own), 3) if own else None, b - a - len(own), how, None))
    return out


_KIND = "shot int, first_frame int, last_frame int, start_us long, end_us long, luma double, damaged int, frame_index string, error string"


def media_clips(media: DataFrame, key: str = "media_id", column: str = "media") -> DataFrame:
    """(key, shot, first_frame, last_frame, start_us, end_us, luma, damaged, frame_index, error): a row for each shot of each file.

    A null or empty value, a file that isn't an AVI of motion-JPEG, and one of which no frame can be decoded give
    one row with ``error`` and nulls. A damaged frame keeps its time and is counted in ``damaged``. Long
    files are read in whole, one frame's pixels at a time. Rows that repeat give their shots again; a
    null key stays null. No rows give no rows. Other columns aren't read.
    """
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            of: list[int] = []
            for k in range(len(batch)):
                got = clips(batch.column(1)[k].as_py())
                rows += got
                of += [k] * len(got)
            if rows:
                types = [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.float64(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], ["key", "shot", "first_frame", "last_frame", "start_us", "end_us", "luma", "damaged", "frame_index", "error"])

    return media.select(F.col(key), F.col(column).cast("binary")).mapInArrow(run, f"key {kind}, {_KIND}").withColumnRenamed("key", key)


def write_avi(frames: Sequence[bytes], micros: int = 100_000, size: tuple[int, int] = (16, 16), index: str = "idx1") -> bytes:
    """A small AVI file of motion-JPEG frames, for tests: with an old index (``idx1``), an OpenDML one (``indx``), or none."""
    pad = lambda b: b + b"\0" * (len(b) & 1)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + pad(body)
    width, height = size
    avih = struct.pack("<14I", micros, 0, 0, 0x10, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, micros, 1_000_000, 0, len(frames), 0, 0, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", 0, 0, 0, 0, 0)
    places, body = [], b""
    for f in frames:
        places.append((len(body), len(f)))
        body += chunk(b"00dc", f)
    indx = chunk(b"indx", struct.pack("<HBBI4sIII", 4, 0, 0, 1, b"00dc", 0, 0, 0) + struct.pack("<QII", 0, 0, len(frames))) if index == "indx" else b""
    header = lambda x: chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf) + x))
    start = 12 + len(header(indx)) + 12  # of the movi list's first chunk
    if index == "indx":
        ix = chunk(b"ix00", struct.pack("<HBBI4sQI", 2, 0, 1, len(frames), b"00dc", start, 0) + b"".join(struct.pack("<II", off + 8, n) for off, n in places))
        indx = chunk(b"indx", struct.pack("<HBBI4sIII", 4, 0, 0, 1, b"00dc", 0, 0, 0) + struct.pack("<QII", start + len(body), len(ix), len(frames)))
        body += ix
    movi = chunk(b"LIST", b"movi" + body)
    tail = chunk(b"idx1", b"".join(struct.pack("<4sIII", b"00dc", 0x10, off + 4, n) for off, n in places)) if index == "idx1" else b""
    inside = b"AVI " + header(indx) + movi + tail
    return b"RIFF" + struct.pack("<I", len(inside)) + inside


def embedding_frames(vector: Sequence[float], number: int) -> tuple[list[bytes], list[int]]:
    """Frames of a clip made from an embedding, and where its shots begin: each shot shows the vector's values as 8 x 8 patches, brighter or darker, and drifts slowly. Most are grey and tiny; each eighth is in colour, and each 1024th of 320 x 240 pixels."""
    pattern = np.resize(np.asarray(vector, np.float64), 64).reshape(8, 8)
    large = number % 1024 == 0
    pattern = np.kron(pattern / max(np.abs(pattern).max(), 1e-9), np.ones((30, 40) if large else (2, 2)))
    planes, starts = [], []
    for shot in range(1 + number % 4):
        starts.append(len(planes))
        level = (60, 170, 110, 220)[(shot + number // 4) % 4]
        for k in range(3 + (number // 16 + shot) % 3):
            planes.append(np.clip(level + 12 * np.roll(pattern, k, 1) * (1 if shot % 2 else -1), 0, 255))
    luma = np.stack(planes)[:, :, :, None]
    if number % 8:
        return jpeg.encode_all(luma, tables=number % 5 != 0), starts
    # colour, a chroma sample for 2 x 2 pixels, some with restart markers
    tint = np.full_like(luma, 128)
    return jpeg.encode_all(np.concatenate([luma, tint + number % 32, tint - number % 16], 3), tables=number % 5 != 0, across=2, down=2, restart=3 if number % 16 else 0), starts


def embedding_media(embeddings: DataFrame) -> DataFrame:
    """(media_id, media): the tables hold no media, so each embedding becomes a small AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            files = [write_avi(embedding_frames(v or [0.0], i)[0], 100_000, index=("idx1", "indx", "none")[i % 3]) for i, v in zip(ids, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["media_id", "media"])

    return embeddings.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("media_id"), "embedding").mapInArrow(run, "media_id long, media binary")


def op4(spark, sf_dir: str) -> DataFrame:
    """The shots of all media."""
    return media_clips(embedding_media(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


QUERIES: dict[str, Callable] = {"op4_media_clips": op4}
SQL: dict[str, str] = {}
