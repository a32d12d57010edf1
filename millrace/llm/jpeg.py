"""Baseline JPEG, as motion-JPEG frames use it: a decoder, and an encoder for test media."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

_ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
_DCT = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class JpegError(ValueError):
    """A frame that can't be decoded."""


def _from_rows(counts: str, symbols: str) -> bytes:
    return bytes(int(x) for x in counts.split()) + bytes.fromhex(symbols)


# The usual tables, which motion-JPEG frames may leave out (class and number: counts by length, symbols).
STANDARD = {
    0x00: _from_rows("0 1 5 1 1 1 1 1 1 0 0 0 0 0 0 0", "000102030405060708090a0b"),
    0x01: _from_rows("0 3 1 1 1 1 1 1 1 1 1 0 0 0 0 0", "000102030405060708090a0b"),
    0x10: _from_rows("0 2 1 3 3 2 4 3 5 5 4 4 0 0 1 125", "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"),
    0x11: _from_rows("0 2 1 2 4 4 3 4 7 5 4 4 0 1 2 119", "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"),
}


def _codes(table: bytes) -> list[tuple[int, int, int]]:
    """(code, length, symbol) of each entry."""
    out, code, at = [], 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out.append((code, length, table[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(64)
def _lookup(table: bytes, ac: bool) -> tuple[list[int], np.ndarray, np.ndarray]:
    """For any 16 bits, by the code that they begin with: (bits to the next code) * 128 + (coefficients to go on), the code's length, and its symbol.

    A block ends where 64 coefficients are passed; an end mark, and bits that no code begins with, go on by 64.
    """
    if len(table) < 16 or len(table) < 16 + sum(table[:16]):
        raise JpegError("short Huffman table")
    step, length, symbol = np.full(1 << 16, 64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for code, n, s in _codes(table):
        low = code << (16 - n)
        size = s & 15
        on = (64 if not size and s != 0xF0 else 16 if s == 0xF0 else (s >> 4) + 1) if ac else 1
        at = slice(low, low + (1 << (16 - n)))
        step[at], length[at], symbol[at] = (n + size) * 128 + on, n, s
    return step.tolist(), length, symbol


class _Part:
    """A component: sampling factors, quantisation, and the scan that has it."""

    def __init__(self, name: int, across: int, down: int, quant: int) -> None:
        self.name, self.across, self.down, self.quant, self.dc, self.ac = name, across, down, quant, 0, 0


class Frame:
    """A frame's headers, and the scans behind them, read up to the last component."""

    def __init__(self, data: bytes) -> None:
        if data[:2] != b"\xff\xd8":
            raise JpegError("no start of image")
        self.data, self.quant, self.tables = data, {}, dict(STANDARD)
        self.parts: list[_Part] = []
        self.height = self.width = self.restart = 0
        #: (parts, their tables, restart interval, place of the entropy-coded data)
        self.scans: list[tuple[list[_Part], list[tuple[bytes, bytes]], int, int]] = []
        at, missing = 2, None
        while missing is None or missing:
            marker, body, at = self._segment(at)
            if marker == 0xDB:
                self._quantisation(body)
            elif marker == 0xC4:
                while len(body) >= 17:
                    n = 17 + sum(body[1:17])
                    self.tables[body[0]] = bytes(body[1:n])
                    body = body[n:]
            elif marker in (0xC0, 0xC1):
                self._header(body)
                missing = {p.name for p in self.parts}
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise JpegError("not baseline")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2])
            elif marker == 0xDA:
                if missing is None:
                    raise JpegError("no frame header")
                own = self._scan(body, at)
                missing -= own
                if missing:  # to the marker behind this scan
                    while at + 1 < len(data) and not (data[at] == 0xFF and data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7):
                        at += 1
            elif marker == 0xD9:
                raise JpegError("no scan")
        self.across, self.down = max(p.across for p in self.parts), max(p.down for p in self.parts)
        self.columns, self.rows = -(-self.width // (8 * self.across)), -(-self.height // (8 * self.down))

    def _segment(self, at: int) -> tuple[int, bytes, int]:
        data = self.data
        while at < len(data) and data[at] != 0xFF:
            at += 1
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at + 2 >= len(data):
            raise JpegError("no scan")
        size = int.from_bytes(data[at + 1 : at + 3])
        return data[at], data[at + 3 : at + 1 + size], at + 1 + size

    def _quantisation(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            n = 128 if wide else 64
            if len(body) < n + 1:
                raise JpegError("short quantisation table")
            self.quant[body[0] & 15] = np.frombuffer(body[1 : n + 1], ">u2" if wide else np.uint8).astype(np.float32)
            body = body[n + 1 :]

    def _header(self, body: bytes) -> None:
        if len(body) < 6 or body[0] != 8:
            raise JpegError("not 8 bits a sample")
        self.height, self.width = int.from_bytes(body[1:3]), int.from_bytes(body[3:5])
        if not self.height or not self.width or body[5] not in (1, 3) or len(body) < 6 + 3 * body[5]:
            raise JpegError("damaged frame header")
        self.parts = [_Part(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        if any(not 1 <= p.across <= 4 or not 1 <= p.down <= 4 for p in self.parts) or len({p.name for p in self.parts}) < len(self.parts):
            raise JpegError("damaged frame header")
        if len(self.parts) == 1:
            self.parts[0].across = self.parts[0].down = 1

    def _scan(self, body: bytes, at: int) -> set[int]:
        if not body or len(body) < 1 + 2 * body[0]:
            raise JpegError("damaged scan header")
        by = {p.name: p for p in self.parts}
        own, tables = [], []
        for k in range(body[0]):
            name, pair = body[1 + 2 * k], body[2 + 2 * k]
            if name not in by or pair >> 4 not in self.tables or 16 + (pair & 15) not in self.tables or by[name].quant not in self.quant:
                raise JpegError("a scan without its tables")
            own.append(by[name])
            tables.append((self.tables[pair >> 4], self.tables[16 + (pair & 15)]))
        self.scans.append((own, tables, self.restart, at))
        return {p.name for p in own}


def _segments(scans: Sequence[bytes]) -> tuple[np.ndarray, list[int], list[int], list[int]]:
    """The bytes of scans one after the other without stuffing, the bits at which their restart intervals begin and end, and the number of each scan's first."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in scans])])
    raw = np.frombuffer(b"".join([*scans, bytes(16)]), np.uint8)
    at = np.flatnonzero(raw[:-1] == 0xFF)
    of = np.searchsorted(offsets, at, "right") - 1
    inside = at + 1 < offsets[np.minimum(of + 1, len(scans))]
    at, of, after = at[inside], of[inside], raw[at[inside] + 1]
    restarts = (after >= 0xD0) & (after <= 0xD7)
    stuffed = at[after == 0] + 1
    over = at[(after != 0) & (after != 0xFF) & ~restarts]
    k = np.minimum(np.searchsorted(over, offsets[:-1]), max(len(over) - 1, 0))
    end = np.where(over[k] >= offsets[:-1], np.minimum(over[k], offsets[1:]), offsets[1:]) if len(over) else offsets[1:]
    cuts = at[restarts & (at < end[of])]
    starts, ends = np.sort(np.concatenate([offsets[:-1], cuts + 2])), np.sort(np.concatenate([end, cuts]))
    place = lambda x: ((x - np.searchsorted(stuffed, x)) * 8).tolist()
    return np.delete(raw, stuffed), place(starts), place(ends), np.searchsorted(starts, offsets[:-1]).tolist()


_BAND = 1 << 14


def _blocks(frame: Frame, scan: tuple, scans: Sequence[bytes], band: int = _BAND) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Units of the scans of several frames with one header, as if the frames stood one below the other, in bands of whole rows of about ``band`` blocks: first row, last + 1, and quantised coefficients of each component, block by block in zigzag order.

    The bits that a code begins with are looked up at every bit at once; what is left to do code by code
    is to go on to the next. Values are taken from the bits of all codes at once again.
    """
    parts, tables, restart, _ = scan
    if len(parts) == 1:  # a scan of one component has its own blocks only, without those that pad units
        p = parts[0]
        columns, rows = -(-(-(-frame.width * p.across // frame.across)) // 8), -(-(-(-frame.height * p.down // frame.down)) // 8)
        order = [0]
    else:
        columns, rows = frame.columns, frame.rows
        order = [k for k, p in enumerate(parts) for _ in range(p.across * p.down)]
    data, starts, ends, firsts = _segments(scans)
    have = 8 * len(data)
    if columns * rows * len(order) * 2 > have:
        raise JpegError("truncated scan")  # a block has two codes of a bit at least
    walk = [(_lookup(d, False)[0], _lookup(a, True)[0]) for d, a in (tables[k] for k in order)]
    last = np.zeros(len(parts), np.int64)
    each = max(1, band // (columns * len(order)))
    pos = number = left = low = high = 0
    window = memoryview(b"")
    most = len(order) << 11  # bits of a unit
    for row in range(0, rows * len(scans), each):
        to = min(rows * len(scans), row + each)
        at, begins, resets = [], [], []
        add, begin = at.append, begins.append
        windows: list[tuple[int, int, np.ndarray]] = [(0, low, np.asarray(window))]
        for line in range(row, to):
            if line % rows == 0:
                if line and pos > ends[number]:
                    raise JpegError("truncated scan")
                number = firsts[line // rows]
                pos, left = starts[number], restart or -1
                resets.append(len(begins))
            for _ in range(columns):
                if not left:
                    number += 1
                    if number >= len(ends) or pos > ends[number - 1]:
                        raise JpegError("truncated scan")
                    pos, left = starts[number], restart
                    resets.append(len(begins))
                left -= 1
                if pos + most > high and high < have:  # the next bits, enough for many units
                    low = pos & ~7
                    part = data[low >> 3 : (low >> 3) + _WINDOW + (most >> 3) + 4].astype(np.uint32)
                    three = np.zeros(len(part), np.uint32)
                    three[:-2] = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
                    own = (three[:, None] >> np.arange(8, 0, -1, dtype=np.uint32)).astype(np.uint16).ravel()
                    window, high = memoryview(own), low + len(own)
                    windows.append((len(at), low, own))
                try:
                    for dc, ac in walk:
                        begin(len(at))
                        add(pos)
                        pos += dc[window[pos - low]] >> 7
                        k = 1
                        while k < 64:
                            add(pos)
                            step = ac[window[pos - low]]
                            pos += step >> 7
                            k += step & 127
                except IndexError:
                    raise JpegError("truncated scan") from None
        if pos > ends[number]:
            raise JpegError("truncated scan")
        found = _values(np.array(at), np.array(begins), order, tables, data, windows)
        out = []
        kinds = np.tile(order, (to - row) * columns)
        for k in range(len(parts)):
            own = np.flatnonzero(kinds == k)
            coefficients = found[own]
            total = np.cumsum(coefficients[:, 0].astype(np.int64))
            cuts = np.searchsorted(own, resets)
            before = np.concatenate([[-last[k]], np.append(0, total)[cuts]])
            total -= np.repeat(before, np.diff(np.concatenate([[0], cuts, [len(total)]])))
            coefficients[:, 0] = total
            last[k] = total[-1]
            out.append(coefficients)
        yield row, to, out


_WINDOW = 1 << 15


def _values(at: np.ndarray, begins: np.ndarray, order: list[int], tables: list, data: np.ndarray, windows: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """(blocks, 64): the coefficients of codes at the bits ``at``, block after block, each block's first code that of its DC coefficient."""
    n = np.diff(np.append(begins, len(at)))
    block = np.repeat(np.arange(len(begins)), n)
    code = np.empty(len(at), np.int64)
    for (a, low, own), b in zip(windows, [*(x[0] for x in windows[1:]), len(at)]):
        code[a:b] = own[at[a:b] - low]
    part = np.resize(order, len(begins))[block]
    first = np.zeros(len(at), bool)
    first[begins] = True
    symbol, length, step = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for k, (dc, ac) in enumerate(tables):
        for table, kind in ((dc, True), (ac, False)):
            own = (part == k) & (first == kind)
            _, lengths, symbols = _lookup(table, not kind)
            symbol[own], length[own] = symbols[code[own]], lengths[code[own]]
    if (length == 0).any():
        raise JpegError("damaged scan")
    size = symbol & 15
    ac = ~first
    run = np.where(ac, symbol >> 4, 0)
    if (symbol[first] > 11).any():
        raise JpegError("damaged scan")
    end = ac & (size == 0) & (symbol != 0xF0)
    step = np.where(end, 0, run + 1)
    step[first] = 1
    total = np.cumsum(step)
    place = total - np.repeat(total[begins] - 1, n) - 1  # of the coefficient that a code gives
    has = size > 0
    if (place[has] > 63).any():
        raise JpegError("damaged scan")
    q = at[has] + length[has]
    s = size[has]
    o = q >> 3
    wide = data[o].astype(np.int64) << 24 | data[np.minimum(o + 1, len(data) - 1)].astype(np.int64) << 16 | data[np.minimum(o + 2, len(data) - 1)].astype(np.int64) << 8 | data[np.minimum(o + 3, len(data) - 1)]
    value = wide >> (32 - (q & 7) - s) & ((1 << s) - 1)
    value = np.where(value < 1 << (s - 1), value - (1 << s) + 1, value)
    out = np.zeros((len(begins), 64), np.int32)
    out[block[has], place[has]] = value
    return out


def _plane(p: _Part, coefficients: np.ndarray, quant: np.ndarray, rows: int, columns: int, across: int, down: int) -> np.ndarray:
    """Samples of one component; its blocks come in units of ``across`` by ``down``."""
    x = np.zeros((len(coefficients), 64), np.float32)
    x[:, _ZIGZAG] = coefficients * quant
    flat = (coefficients[:, 1:] == 0).all(1)
    pixels = np.empty((len(x), 8, 8), np.float32)
    pixels[flat] = (x[flat, 0] / 8)[:, None, None]
    pixels[~flat] = _DCT32.T @ x[~flat].reshape(-1, 8, 8) @ _DCT32
    return (pixels + np.float32(128)).reshape(rows, columns, down, across, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(rows * down * 8, columns * across * 8)


_DCT32 = _DCT.astype(np.float32)


def bands(frames: Sequence[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Baseline frames with one header, from the first to the last and from top to bottom: (number of a frame, pixels).

    Pixels are (frames, rows, width, 3) as Y, Cb, Cr of 8 bits, of several whole frames, or of some rows
    of one if frames are large; grey frames have chroma 128. Frames of any size and any sampling
    factors can be read, as can frames whose components come in scans of their own; those are held as
    a whole.
    """
    frame = Frame(frames[0])
    if len(frame.scans) == 1 and len(frame.scans[0][0]) == len(frame.parts):
        scan = frame.scans[0]
        tall = 8 * frame.down * frame.rows
        for row, to, found in _blocks(frame, scan, [f[scan[3] :] for f in frames], _whole_rows(frame)):
            planes = [_plane(p, c, frame.quant[p.quant], to - row, frame.columns, p.across, p.down) for p, c in zip(scan[0], found)]
            pixels = _joined(frame, scan[0], planes, (to - row) * 8 * frame.down)
            if row % frame.rows == 0 and (to - row) % frame.rows == 0:
                yield row // frame.rows, pixels.reshape(-1, tall, frame.width, 3)[:, : frame.height]
            else:
                yield row // frame.rows, pixels[None, : frame.height - row % frame.rows * 8 * frame.down]
        return
    for number, data in enumerate(frames):
        frame = frame if not number else Frame(data)
        planes_by: dict[int, np.ndarray] = {}
        for scan in frame.scans:
            every = list(_blocks(frame, scan, [data[scan[3] :]]))
            for k, p in enumerate(scan[0]):
                coefficients = np.concatenate([found[k] for _, _, found in every])
                rows = every[-1][1]
                if len(scan[0]) == 1:
                    planes_by[p.name] = _plane(p, coefficients, frame.quant[p.quant], rows, len(coefficients) // rows, 1, 1)
                else:
                    planes_by[p.name] = _plane(p, coefficients, frame.quant[p.quant], rows, frame.columns, p.across, p.down)
        yield number, _joined(frame, frame.parts, [planes_by[p.name] for p in frame.parts], frame.height)[None]


def _joined(frame: Frame, parts: list[_Part], planes: list[np.ndarray], rows: int) -> np.ndarray:
    """Samples of all components at each pixel, the nearest above and to the left where a component has fewer."""
    out = np.full((rows, frame.width, 3), 128, np.uint8)
    for p, plane in zip(parts, planes):
        k = frame.parts.index(p)
        plane = np.clip(np.rint(plane), 0, 255).astype(np.uint8)
        if p.down != frame.down or p.across != frame.across:
            plane = plane[np.arange(rows) * p.down // frame.down][:, np.arange(frame.width) * p.across // frame.across]
        out[:, :, k] = plane[:rows, : frame.width]
    return out


def _whole_rows(frame: Frame) -> int:
    """Blocks of a band, so that bands are whole frames, or parts of one."""
    row = frame.columns * sum(p.across * p.down for p in frame.parts)
    if row * frame.rows <= _BAND:
        return row * frame.rows * (_BAND // (row * frame.rows))
    rows = max(1, _BAND // row)
    while frame.rows % rows:
        rows -= 1
    return row * rows


def header(data: bytes) -> bytes:
    """What comes before the scan of a frame of a single scan; all of any other frame."""
    frame = Frame(data)
    return data[: frame.scans[0][3]] if len(frame.scans) == 1 else data


def decode(data: bytes) -> np.ndarray:
    """All pixels of a baseline frame, see :func:`bands`."""
    return np.concatenate([pixels[0] for _, pixels in bands([data])])


def encode(luma: np.ndarray, step: int = 16, tables: bool = True) -> bytes:
    """A grey baseline frame of ``luma`` (height, width), all coefficients quantised by ``step``; without its Huffman tables if not ``tables``."""
    return encode_all(luma[None, :, :, None], step, tables)[0]


def encode_all(frames: np.ndarray, step: int = 16, tables: bool = True, across: int = 1, down: int = 1, restart: int = 0) -> list[bytes]:
    """Baseline frames of pixels (frames, height, width, 1 or 3).

    Chroma has a sample for each ``across`` by ``down`` pixels, their mean; with ``restart`` there is a
    restart marker behind so many units.
    """
    n, height, width, parts = frames.shape
    if parts == 1:
        across = down = 1
    rows, columns = -(-height // (8 * down)), -(-width // (8 * across))
    full = np.pad(frames.astype(np.float64) - 128, ((0, 0), (0, rows * 8 * down - height), (0, columns * 8 * across - width), (0, 0)), "edge")
    units = []
    for k in range(parts):
        a, d = (1, 1) if k else (across, down)
        plane = full[:, :, :, k]
        if k:
            plane = plane.reshape(n, rows * 8, down, columns * 8, across).mean((2, 4))
        units.append(plane.reshape(n, rows, d, 8, columns, a, 8).transpose(0, 1, 4, 2, 5, 3, 6).reshape(n * rows * columns, d * a, 8, 8))
    of = np.repeat(np.arange(parts), [u.shape[1] for u in units])
    blocks = np.concatenate(units, 1)
    each = blocks.shape[1]
    quantised = np.rint(_DCT @ blocks.reshape(-1, 8, 8) @ _DCT.T / step).astype(np.int64).reshape(-1, 64)[:, _ZIGZAG]
    unit = np.repeat(np.arange(n * rows * columns), each)
    interval = unit // (rows * columns) * -(-rows * columns // restart) + unit % (rows * columns) // restart if restart else unit // (rows * columns)
    kind = np.tile(of, n * rows * columns)
    for k in range(parts):
        own = np.flatnonzero(kind == k)
        dc = quantised[own, 0]
        new = np.append(True, interval[own][1:] != interval[own][:-1])
        quantised[own, 0] = dc - np.where(new, 0, np.append(0, dc[:-1]))
    # codes: (block, place, symbol, value, bits of the value)
    block, place = np.nonzero(quantised[:, 1:])
    place += 1
    value = quantised[block, place]
    before = np.where(np.append(True, block[1:] != block[:-1]), 0, np.append(0, place[:-1])) if len(block) else place
    run = place - before - 1
    size = lambda v: np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    every = np.arange(len(quantised))
    last = np.zeros(len(quantised), np.int64)
    np.maximum.at(last, block, place)
    skips = run >> 4
    skip = np.repeat(np.arange(len(block)), skips)
    bare = every[last < 63]
    codes = [(every, every * 0, size(quantised[:, 0]), quantised[:, 0]), (block, place * 2 + 1, (run & 15) << 4 | size(value), value), (block[skip], place[skip] * 2, skip * 0 + 0xF0, skip * 0), (bare, bare * 0 + 200, bare * 0, bare * 0)]
    block, place, symbol, value = (np.concatenate(x) for x in zip(*codes))
    order = np.lexsort((place, block))
    block, place, symbol, value = block[order], place[order], symbol[order], value[order]
    code, length = np.zeros((2, 256), np.int64), np.zeros((2, 256), np.int64)
    for k, name in enumerate((0x00, 0x10)):
        for c, m, s in _codes(STANDARD[name]):
            code[k, s], length[k, s] = c, m
    ac = (place > 0).astype(int)
    more = symbol & 15
    bits = np.stack([code[ac, symbol], np.where(value > 0, value, value + (1 << more) - 1)], 1).ravel()
    wide = np.stack([length[ac, symbol], more], 1).ravel()
    own = np.repeat(interval[block], 2)
    total = np.bincount(own, wide, interval[-1] + 1).astype(np.int64)
    pad = -total % 8
    # intervals end with ones up to a whole byte
    at = np.argsort(np.concatenate([own, np.arange(len(pad))]), kind="stable")
    bits, wide = np.concatenate([bits, (1 << pad) - 1])[at], np.concatenate([wide, pad])[at]
    ends = np.cumsum(wide)
    shift = np.repeat(ends, wide) - np.arange(ends[-1]) - 1
    packed = np.packbits((np.repeat(bits, wide) >> shift & 1).astype(np.uint8)).tobytes()
    bounds = np.concatenate([[0], np.cumsum((total + pad) // 8)]).tolist()
    scans = [packed[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(bounds, bounds[1:])]
    part = lambda marker, body: bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2) + body
    huffman = b"".join(part(0xC4, bytes([k]) + STANDARD[k]) for k in (0x00, 0x10)) if tables else b""
    head = b"\xff\xd8" + part(0xDB, b"\0" + bytes([step]) * 64) + (part(0xDD, restart.to_bytes(2)) if restart else b"")
    head += part(0xC0, b"\x08" + height.to_bytes(2) + width.to_bytes(2) + bytes([parts]) + b"".join(bytes([k + 1, 0x11 if k else across << 4 | down, 0]) for k in range(parts))) + huffman
    head += part(0xDA, bytes([parts]) + b"".join(bytes([k + 1, 0]) for k in range(parts)) + b"\x00\x3f\x00")
    many = len(scans) // n
    return [head + b"".join(x + bytes([0xFF, 0xD0 + k % 8]) * (k < many - 1) for k, x in enumerate(scans[f * many : (f + 1) * many])) + b"\xff\xd9" for f in range(n)]
