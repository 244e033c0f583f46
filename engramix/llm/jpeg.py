"""Baseline JPEG in numpy: entropy coding and decoding of many images in lockstep.

Encoding stores blocks of 64 quantised coefficients (the format's unit) without loss,
one restart interval for each block. Decoding parses the markers, takes the stuffing
away and runs all restart intervals of all images side by side: every step decodes
one Huffman symbol of each interval with a table look-up.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Restart intervals that are decoded side by side: what decoding needs beside the file and its coefficients is bounded by them.
GROUP = 1 << 15
#: Application segment that holds the number of blocks of the payload.
PAYLOAD_TAG = b"BLOCKS\0"
_SIZE = np.array([int(v).bit_length() for v in range(2048)], np.int64)


def _code_lengths() -> tuple[dict[int, int], dict[int, int]]:
    """Huffman code lengths by a rule: short codes for the coefficient sizes of text bytes."""
    dc = {s: 4 for s in range(12)}
    ac = {0x07: 1, 0x06: 3, 0x08: 3, 0x00: 4, 0x05: 5, 0x04: 5, 0x01: 6, 0x02: 6, 0x03: 6, 0xF0: 12}
    for run in range(16):
        for s in range(1, 11):
            ac.setdefault(run << 4 | s, 12)
    return dc, ac


def _canonical(lengths: dict[int, int]) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """(number of codes by length, symbols, code by symbol, length by symbol)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    bits, code, last = [0] * 16, 0, 0
    codes, sizes = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s in order:
        n = lengths[s]
        code <<= n - last
        codes[s], sizes[s], last = code, n, n
        bits[n - 1] += 1
        code += 1
    return bytes(bits), bytes(order), codes, sizes


_DC, _AC = (_canonical(x) for x in _code_lengths())


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def _header(columns: int, rows: int, blocks: int) -> bytes:
    quant = bytes([8] + [1] * 63)  # a DC coefficient is eight times the mean: the thumbnail shows it as it is
    return b"".join([
        b"\xff\xd8",
        _segment(0xEB, PAYLOAD_TAG + struct.pack(">Q", blocks)),
        _segment(0xDB, b"\0" + quant),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, columns * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + _DC[0] + _DC[1]),
        _segment(0xC4, b"\x10" + _AC[0] + _AC[1]),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


def layout(blocks: int) -> tuple[int, int]:
    """(columns, rows) of the smallest near-square image with so many blocks."""
    columns = max(1, int(np.ceil(np.sqrt(blocks))))
    return columns, -(-blocks // columns)


def _entropy(blocks: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coded blocks (n, 64), each followed by the restart marker of its number: (bytes, bytes of each block)."""
    n = len(blocks)
    v = blocks.astype(np.int64)
    first = v[:, 0] - 128
    code, size = np.zeros((n, 65), np.int64), np.zeros((n, 65), np.int64)
    s = _SIZE[np.abs(first)]
    code[:, 0] = _DC[2][s] << s | np.where(first < 0, first + (1 << s) - 1, first)
    size[:, 0] = _DC[3][s] + s
    ac = v[:, 1:]
    live = ac > 0
    place = np.arange(1, 64)
    last = np.maximum.accumulate(np.where(live, place, 0), axis=1)
    before = np.concatenate([np.zeros((n, 1), np.int64), last[:, :-1]], axis=1)
    run = place - before - 1
    s = _SIZE[ac]
    symbol = (run & 15) << 4 | s
    code[:, 1:64] = np.where(live, _AC[2][symbol] << s | ac, 0)
    size[:, 1:64] = np.where(live, _AC[3][symbol] + s, 0)
    end = last[:, -1]
    skip = ~live & ((place - last) % 16 == 0) & (place > last) & (place < end[:, None])
    if skip.any():
        code[:, 1:64][skip], size[:, 1:64][skip] = _AC[2][0xF0], _AC[3][0xF0]
    code[:, 64], size[:, 64] = np.where(end < 63, _AC[2][0], 0), np.where(end < 63, _AC[3][0], 0)
    bits = size.sum(axis=1)
    whole = -(-bits // 8)
    begin = np.cumsum(whole) - whole
    at = (8 * begin)[:, None] + np.cumsum(size, axis=1) - size
    used = size.reshape(-1) > 0
    at, code, size = at.reshape(-1)[used], code.reshape(-1)[used], size.reshape(-1)[used]
    word = code << (32 - size - (at & 7))
    byte, total = at >> 3, int(whole.sum())
    data = np.zeros(total + 4)
    for k in range(4):
        data += np.bincount(byte + k, word >> (24 - 8 * k) & 255, total + 4)
    data = data[:total].astype(np.int64)
    data[begin + whole - 1] |= (1 << (8 * whole - bits)) - 1  # fill with ones
    stuffed = data == 255
    closes = np.zeros(total, np.int64)
    closes[begin + whole - 1] = 2
    grow = stuffed + closes
    place = np.arange(total) + np.cumsum(grow) - grow
    out = np.zeros(total + int(grow.sum()), np.uint8)
    out[place] = data
    marks = place[begin + whole - 1] + 1 + stuffed[begin + whole - 1]
    out[marks], out[marks + 1] = 0xFF, 0xD0 + number % 8
    return out, np.add.reduceat(1 + grow, begin) if total else np.zeros(n, np.int64)


def encode(payloads: list[np.ndarray], step: int = 8192) -> list[bytes]:
    """One file for each payload, an array (blocks, 64) of bytes. Blocks are coded in groups, across payloads."""
    shapes = [layout(len(p)) for p in payloads]
    parts: list[list[bytes]] = [[_header(c, r, len(p))] for p, (c, r) in zip(payloads, shapes, strict=True)]
    queue: list[tuple[int, np.ndarray, int]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if queue:
            data, sizes = _entropy(np.concatenate([b for _, b, _ in queue]), np.concatenate([np.arange(f, f + len(b)) for _, b, f in queue]))
            ends = np.cumsum(sizes)
            done = 0
            for k, b, f in queue:
                begin, end = int(ends[done - 1]) if done else 0, int(ends[done + len(b) - 1])
                closing = f + len(b) == shapes[k][0] * shapes[k][1]
                parts[k].append(data[begin : end - 2 * closing].tobytes() + b"\xff\xd9" * closing)
                done += len(b)
        queue.clear()
        held = 0

    for k, p in enumerate(payloads):
        spare = shapes[k][0] * shapes[k][1] - len(p)
        if spare:
            fill = np.zeros((spare, 64), np.uint8)
            fill[:, 0] = 128
        for f in range(0, len(p) + spare, step):
            part = p[f : f + step]
            if len(part) < step and spare:
                part = np.concatenate([part, fill[: step - len(part)] if f <= len(p) else fill[: min(step, len(p) + spare - f)]])
            queue.append((k, part, f))
            held += len(part)
            if held >= step:
                flush()
    flush()
    return [b"".join(x) for x in parts]


@dataclass
class Image:
    """What the markers of a file say."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[tuple[int, int], tuple[bytes, bytes]] = field(default_factory=dict)
    interval: int = 0
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component, DC table, AC table
    payload_blocks: int | None = None
    begin: int = 0

    def units(self) -> tuple[list[int], int, int, int]:
        """(component of each block of an MCU, MCUs in a row, MCUs, blocks in the scan)."""
        if len(self.scan) == 1:
            c = self.components[self.scan[0][0]]
            hm, vm = max(x[1] for x in self.components), max(x[2] for x in self.components)
            across, down = -(-self.width * c[1] // (8 * hm)), -(-self.height * c[2] // (8 * vm))
            return [0], across, across * down, across * down
        hm, vm = max(x[1] for x in self.components), max(x[2] for x in self.components)
        plan = [k for k, (c, _, _) in enumerate(self.scan) for _ in range(self.components[c][1] * self.components[c][2])]
        across, down = -(-self.width // (8 * hm)), -(-self.height // (8 * vm))
        return plan, across, across * down, across * down * len(plan)


def parse(data: bytes) -> Image:
    """Read the markers up to the scan of a baseline file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    image, i = Image(), 2
    while True:
        while data[i] == 0xFF and data[i + 1] == 0xFF:
            i += 1
        if data[i] != 0xFF:
            raise ValueError("a marker was expected")
        marker, n = data[i + 1], struct.unpack_from(">H", data, i + 2)[0]
        body = data[i + 4 : i + 2 + n]
        i += 2 + n
        if marker == 0xC0:
            _, image.height, image.width, count = struct.unpack_from(">BHHB", body)
            image.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
        elif marker in (0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
            raise ValueError("only baseline files are supported")
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                image.quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.int64)
                k += 65 + 64 * bool(wide)
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                bits = body[k + 1 : k + 17]
                image.tables[body[k] >> 4, body[k] & 15] = bits, body[k + 17 : k + 17 + sum(bits)]
                k += 17 + sum(bits)
        elif marker == 0xDD:
            image.interval = struct.unpack(">H", body)[0]
        elif marker == 0xEB and body.startswith(PAYLOAD_TAG):
            image.payload_blocks = struct.unpack_from(">Q", body, len(PAYLOAD_TAG))[0]
        elif marker == 0xDA:
            ids = {c[0]: k for k, c in enumerate(image.components)}
            image.scan = [(ids[body[1 + 2 * k]], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            image.begin = i
            return image


def _lookup(bits: bytes, symbols: bytes) -> np.ndarray:
    """length << 8 | symbol for every 16 bits that begin with a code; 0 where none does."""
    table = np.zeros(1 << 16, np.int64)
    code, k = 0, 0
    for n, count in enumerate(bits, 1):
        for _ in range(count):
            table[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def decode(files: list[bytes]) -> list[tuple[Image, np.ndarray]]:
    """(markers, coefficients (blocks, 64) in scan and zigzag order) of each file."""
    images = [parse(f) for f in files]
    tables: dict[tuple[bytes, bytes], int] = {}
    lanes: list[tuple[np.ndarray, ...]] = []  # image, first byte, first block, blocks of every interval
    streams, base, blocks = [], 0, 0
    plans = [im.units() for im in images]
    firsts = []
    for f, im, (plan, _, mcus, total) in zip(files, images, plans, strict=True):
        raw = np.frombuffer(f, np.uint8, offset=im.begin)
        ff = np.flatnonzero(raw[:-1] == 255)
        after = raw[ff + 1]
        ends = ff[(after != 0) & (after != 255) & ((after < 0xD0) | (after > 0xD7))]
        stop = int(ends[0]) if len(ends) else len(raw)
        ff, after = ff[ff < stop], after[ff < stop]
        marks = ff[(after >= 0xD0) & (after <= 0xD7)]
        gone = np.sort(np.r_[ff[after == 0] + 1, marks, marks + 1])
        keep = np.ones(stop, bool)
        keep[gone] = False
        starts = np.r_[0, marks - np.searchsorted(gone, marks)]
        each = (im.interval or mcus) * len(plan)
        first = np.arange(len(starts), dtype=np.int64) * each
        starts, first = starts[first < total], first[first < total]
        lanes.append((np.full(len(first), len(firsts)), base + starts, blocks + first, np.minimum(each, total - first)))
        firsts.append(blocks)
        streams.append(raw[:stop][keep])
        base += len(streams[-1])
        blocks += total
    most = max((len(p[0]) for p in plans), default=1)
    dc, ac, comp, units = (np.zeros((len(files), most), np.int64) for _ in range(4))
    for i, (im, (plan, *_)) in enumerate(zip(images, plans, strict=True)):
        for j, k in enumerate(plan):
            dc[i, j], ac[i, j] = (tables.setdefault(im.tables[kind, im.scan[k][1 + kind]], len(tables)) << 16 for kind in (0, 1))
            comp[i, j] = k
        units[i] = len(plan)
    look = np.concatenate([_lookup(*t) for t in tables]) if tables else np.zeros(0, np.int64)
    out = np.zeros((blocks, 64), np.int16)
    if blocks:
        made = _Tables(look, dc, ac, comp, units, most == 1)
        stream = np.concatenate([*streams, np.zeros(8, np.uint8)])
        streams.clear()
        image, start, block, left = (np.concatenate(x) for x in zip(*lanes, strict=True))
        stop = np.r_[start[1:], base]
        for i in range(0, len(image), GROUP):
            own = slice(i, i + GROUP)
            low, high = int(start[i]), int(stop[own][-1])
            _intervals(stream[low : high + 8], made, image[own], start[own] - low, block[own], left[own], out.reshape(-1))
    return [(im, out[a : a + p[3]]) for im, a, p in zip(images, firsts, plans, strict=True)]


@dataclass
class _Tables:
    """Huffman look-up, and where in it the tables of a unit of an image begin."""

    look: np.ndarray
    dc: np.ndarray
    ac: np.ndarray
    comp: np.ndarray
    units: np.ndarray
    single: bool


def _intervals(stream: np.ndarray, made: _Tables, image: np.ndarray, start: np.ndarray, block: np.ndarray, left: np.ndarray, flat: np.ndarray) -> None:
    """Decode a group of restart intervals side by side into the coefficients."""
    base = len(stream) - 8
    data = stream.astype(np.uint64)
    window = np.zeros(base + 1, np.uint64)
    for k in range(8):
        window = window << np.uint64(8) | data[k : k + base + 1]
    pos, k, within = start * 8, np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    before = np.zeros((len(start), 4), np.int64)
    row = np.arange(len(start))
    while len(pos):
        held = window[np.minimum(pos >> 3, base)] << (pos & 7).astype(np.uint64)
        unit = 0 if made.single else within % made.units[image, 0]
        opening = k == 0
        found = made.look[np.where(opening, made.dc[image, unit], made.ac[image, unit]) + (held >> np.uint64(48)).astype(np.int64)]
        n, symbol = found >> 8, found & 255
        if not n.all():
            raise ValueError("a code of no symbol")
        size = symbol & 15
        value = ((held << n.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)
        pos += n + size
        run = np.where(opening, 0, symbol >> 4)
        at = k + run
        if opening.any():
            c = made.comp[image, unit]
            total = before[row, c] + value
            before[row[opening], c[opening]] = total[opening]
            value = np.where(opening, total, value)
        write = (size > 0) | opening
        flat[(block * 64 + np.minimum(at, 63))[write]] = value[write]
        close = ~opening & (size == 0) & (run < 15)
        k = np.where(close, 64, at + 1)
        over = k > 63
        if over.any():
            block, within, left, k = block + over, within + over, left - over, np.where(over, 0, k)
            keep = left > 0
            if not keep.all():
                image, block, left, pos, k, within, before = (x[keep] for x in (image, block, left, pos, k, within, before))
                row = np.arange(len(pos))


def thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """The luminance at an eighth of the size, from the DC coefficients alone."""
    plan, across, mcus, _ = image.units()
    c = image.components[image.scan[0][0]]
    values = coefficients[:, 0].astype(np.int64) * int(image.quant[c[3]][0])
    values = np.clip((values + 4) // 8 + 128, 0, 255).astype(np.uint8)
    own = np.flatnonzero(np.array(plan) == 0)
    grid = values.reshape(mcus, len(plan))[:, own]
    h, v = (1, 1) if len(image.scan) == 1 else c[1:3]
    return grid.reshape(mcus // across, across, v, h).transpose(0, 2, 1, 3).reshape(mcus // across * v, across * h)


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 sampling are brighter than their mean."""
    rows, columns = thumb.shape
    cells = thumb[(np.arange(8) * rows // 8)[:, None], np.arange(8) * columns // 8].astype(np.int64)
    return np.packbits(cells * 64 > cells.sum()).tobytes().hex()
