"""Baseline JPEG in numpy: markers, Huffman-coded scans and DC-only luminance thumbnails; and a lossless encoder of samples as such thumbnails.

An entropy-coded segment (between restart markers) is a lane. Lanes do not depend on each other, so all lanes of many images with the same
tables are decoded in lockstep: a step reads one block of every lane. AC coefficients are skipped code by code; only DC ones are kept, and
of those the first component's, which gives a picture of an eighth of each side.

The encoder stores a sample as a flat 8x8 block, that is as its DC coefficient, so a decoder's thumbnail has the samples exactly, and any viewer
shows them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

SOI, EOI = b"\xff\xd8", b"\xff\xd9"
#: Blocks in a row and in a restart interval of what is encoded; rows that fit the format's 16-bit height.
ROW, LANE, MOST_ROWS = 192, 32, 65535 // 8
#: Code lengths of DC categories 0 to 8, short for those that text has most.
DC_LENGTHS = (4, 4, 3, 3, 2, 4, 5, 2, 6)


class JpegError(ValueError):
    """Not a baseline JPEG, or a damaged one."""


def canonical(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(code, length, symbol) of a table given as in a DHT segment."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length, symbols[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For each next 16 bits: length << 8 | symbol; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    for code, length, symbol in canonical(counts, symbols):
        low = code << 16 - length
        out[low : low + (1 << 16 - length)] = length << 8 | symbol
    return out


def _dc_table() -> tuple[list[int], list[int]]:
    order = sorted(range(len(DC_LENGTHS)), key=lambda c: (DC_LENGTHS[c], c))
    return [DC_LENGTHS.count(n) for n in range(1, 17)], order


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _head(rows: int) -> bytes:
    dc_counts, dc_symbols = _dc_table()
    size = (8 * rows).to_bytes(2, "big") + (8 * ROW).to_bytes(2, "big")
    return b"".join((
        SOI,
        _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
        _segment(0xDB, b"\0" + bytes([8]) + bytes([1]) * 63),
        _segment(0xC0, b"\x08" + size + b"\x01\x01\x11\x00"),
        _segment(0xC4, b"\x00" + bytes(dc_counts) + bytes(dc_symbols)),
        _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0"),
        _segment(0xDD, LANE.to_bytes(2, "big")),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each DC difference from -255 to 255: category code, category bits, and the end-of-block code, which is one 0."""
    codes = {symbol: (code, length) for code, length, symbol in canonical(*_dc_table())}
    bits, lengths = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, length = codes[category]
        extra = d if d >= 0 else d + (1 << category) - 1
        bits[d + 255], lengths[d + 255] = (code << category | extra) << 1, length + category + 1
    return bits, lengths


BITS, LENGTHS = _difference_codes()


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stored form for each payload (a positive multiple of ROW bytes): one JPEG, or several in a row beyond MOST_ROWS rows."""
    frames = [(i, p[at : at + ROW * MOST_ROWS]) for i, p in enumerate(payloads) for at in range(0, len(p), ROW * MOST_ROWS)]
    if not frames:
        return []
    samples = np.frombuffer(b"".join(f for _, f in frames), np.uint8).reshape(-1, LANE)
    scans = _encode_lanes(samples, np.array([len(f) // LANE for _, f in frames]))
    out: list[list[bytes]] = [[] for _ in payloads]
    for (i, f), scan in zip(frames, scans, strict=True):
        out[i] += [_head(len(f) // ROW), scan, EOI]
    return [b"".join(x) for x in out]


def _encode_lanes(samples: np.ndarray, lanes: np.ndarray) -> list[bytes]:
    """Entropy-coded data of images that have so many of the lanes each: restart markers between lanes, a zero after each 0xFF."""
    n = len(samples)
    level = samples.astype(np.int16) - 128
    difference = level.copy()
    difference[:, 1:] -= level[:, :-1]
    index = difference + 255
    lengths = LENGTHS[index]
    ends = np.cumsum(lengths, axis=1)
    total = ends[:, -1]
    width = int(total.max() + 7 >> 3) + 3
    buffer = np.zeros(n * width, np.uint8)
    base = np.arange(n) * width
    for k in range(LANE):
        at = ends[:, k] - lengths[:, k]
        value = BITS[index[:, k]] << (24 - lengths[:, k] - (at & 7)).astype(np.uint32)
        place = base + (at >> 3)
        buffer[place] |= (value >> 16).astype(np.uint8)
        buffer[place + 1] |= (value >> 8 & 255).astype(np.uint8)
        buffer[place + 2] |= (value & 255).astype(np.uint8)
    partial = np.flatnonzero(total & 7)  # the last byte is filled up with ones
    buffer[base[partial] + (total[partial] >> 3)] |= (0xFF >> (total[partial] & 7)).astype(np.uint8)
    used = total + 7 >> 3
    data = buffer.reshape(n, width)[np.arange(width) < used[:, None]]
    full = data == 0xFF
    last = np.cumsum(lanes) - 1
    first = np.concatenate(([0], last[:-1] + 1))
    marked = np.ones(n, np.int64)  # lanes that a marker follows
    marked[last] = 0
    lane_end = np.cumsum(used)
    shift = np.zeros(len(data) + 1, np.int64)
    shift[1:] = full
    np.add.at(shift, lane_end, 2 * marked)
    place = np.arange(len(data)) + np.cumsum(shift)[:-1]
    out = np.zeros(len(data) + int(shift.sum()), np.uint8)
    out[place] = data
    after = place[lane_end - 1] + 1 + full[lane_end - 1]
    number = np.arange(n) - np.repeat(first, lanes)
    with_marker = np.flatnonzero(marked)
    out[after[with_marker]] = 0xFF
    out[after[with_marker] + 1] = 0xD0 + (number[with_marker] & 7)
    cut = after[last]
    start = np.concatenate(([0], cut[:-1]))
    return [out[a:b].tobytes() for a, b in zip(start.tolist(), cut.tolist(), strict=True)]


@dataclass
class Component:
    name: int
    h: int
    v: int
    quantizer: int
    dc: int = 0
    ac: int = 0


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    dc_quantizers: dict[int, int] = field(default_factory=dict)
    tables: dict[int, tuple[bytes, list[int], list[int]]] = field(default_factory=dict)  # class << 4 | number
    interval: int = 0
    start: int = 0  # of the entropy-coded data
    end: int = 0  # after EOI

    def signature(self) -> tuple:
        """Images with equal signatures are decoded together."""
        return tuple((c.h, c.v, self.tables[c.dc][0], self.tables[0x10 | c.ac][0]) for c in self.components)

    def units(self) -> tuple[int, int]:
        """Coded units (MCUs) across and down; of a single component a unit is one block."""
        if len(self.components) == 1:
            return -(-self.width // 8), -(-self.height // 8)
        h, v = max(c.h for c in self.components), max(c.v for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes, at: int = 0) -> Image:
    """Markers from SOI to the start of the scan. JpegError for anything but one baseline scan of all components with 8-bit samples."""
    if data[at : at + 2] != SOI:
        raise JpegError("no SOI")
    image, at, scan = Image(), at + 2, []
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise JpegError("no marker where one is due")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if n < 2 or at > len(data):
            raise JpegError("a segment is cut off")
        try:
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    image.dc_quantizers[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                    k += 1 + 64 * (1 + wide)
            elif marker in (0xC0, 0xC1):
                if body[0] != 8:
                    raise JpegError("samples are not of 8 bits")
                image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise JpegError("not baseline")
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    counts = list(body[k + 1 : k + 17])
                    symbols = list(body[k + 17 : k + 17 + sum(counts)])
                    image.tables[body[k]] = (bytes(body[k + 1 : k + 17 + sum(counts)]), counts, symbols)
                    k += 17 + sum(counts)
            elif marker == 0xDD:
                image.interval = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                scan = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
                break
            elif marker == 0xD9:
                raise JpegError("no scan")
        except IndexError as e:
            raise JpegError("a segment is cut off") from e
    by_name = {c.name: c for c in image.components}
    if not image.width or not image.height or sorted(by_name) != sorted(name for name, _ in scan):
        raise JpegError("no size, or not one scan of all components")
    for name, tables in scan:
        by_name[name].dc, by_name[name].ac = tables >> 4, tables & 15
    if any(c.quantizer not in image.dc_quantizers or c.dc not in image.tables or 0x10 | c.ac not in image.tables or not c.h or not c.v for c in image.components):
        raise JpegError("a table is missing")
    image.start = at
    return image


def _lanes(data: np.ndarray, image: Image) -> tuple[np.ndarray, list[int]]:
    """Entropy-coded bytes without stuffing and markers, and where each lane starts in them; sets image.end."""
    part = data[image.start :]
    at = np.flatnonzero(part[:-1] == 0xFF)
    after = part[at + 1]
    ends = at[(after != 0) & (after != 0xFF) & ((after < 0xD0) | (after > 0xD7))]
    if not len(ends) or part[ends[0] + 1] != 0xD9:
        raise JpegError("the scan does not end")
    end = int(ends[0])
    image.end = image.start + end + 2
    part, at, after = part[:end], at[at < end], after[at < end]
    keep = np.ones(end, bool)
    keep[at[after == 0] + 1] = False
    keep[at[after == 0xFF]] = False
    restarts = at[(after >= 0xD0) & (after <= 0xD7)]
    keep[restarts] = keep[restarts + 1] = False
    before = np.concatenate(([0], np.cumsum(keep)))
    return part[keep], [0, *before[restarts].tolist()]


class Decoder:
    """Of images with one signature."""

    def __init__(self, image: Image):
        self.components, self.single = image.components, len(image.components) == 1
        self.dc = [lookup(*image.tables[c.dc][1:]) for c in image.components]
        self.ac = [lookup(*image.tables[0x10 | c.ac][1:]) for c in image.components]
        self.plan = [0] if self.single else [i for i, c in enumerate(self.components) for _ in range(c.h * c.v)]
        self.fused = [self._fuse(d, a) for d, a in zip(self.dc, self.ac, strict=True)]

    @staticmethod
    def _fuse(dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
        """For each next 16 bits that hold a whole block of a DC difference and an end of block: bits << 16 | difference + 32768; else 0."""
        window = np.arange(1 << 16, dtype=np.int64)
        length, category = dc.astype(np.int64) >> 8, dc.astype(np.int64) & 255
        used = length + category
        fits = (length > 0) & (category < 12) & (used < 16)
        extra = np.where(fits, window >> np.where(fits, 16 - used, 0) & (1 << np.where(fits, category, 0)) - 1, 0)
        difference = np.where((category > 0) & (extra < 1 << np.maximum(category - 1, 0)), extra - (1 << np.where(fits, category, 0)) + 1, extra)
        rest = ac[np.where(fits, window << np.where(fits, used, 0) & 0xFFFF, 0)].astype(np.int64)
        whole = fits & (rest >> 8 > 0) & (rest & 255 == 0) & (used + (rest >> 8) <= 16)
        return np.where(whole, used + (rest >> 8) << 16 | difference + 32768, 0).astype(np.int64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, units: np.ndarray) -> np.ndarray:
        """DC levels of the first component: lanes x units x its blocks in a unit (levels after a lane's own units are of no meaning)."""
        padded = np.concatenate((data, np.zeros(16, np.uint8))).astype(np.uint32)
        words = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
        limit = len(data) * 8
        n, steps = len(starts), int(units.max())
        per_unit = self.plan.count(0)
        out = np.zeros((n, steps, per_unit), np.int32)
        at, last = starts.astype(np.int64) * 8, [np.zeros(n, np.int64) for _ in self.components]
        order = np.argsort(-units, kind="stable")
        counts = np.searchsorted(-units[order], -np.arange(steps), side="left")  # lanes with more than so many units
        for step in range(steps):
            lanes = slice(None) if counts[step] == n else order[: counts[step]]
            k = 0
            for c in self.plan:
                here = at[lanes]
                window = words[here >> 3] << (here & 7).astype(np.uint32) >> 16
                found = self.fused[c][window]
                bits, difference = found >> 16, (found & 0xFFFF) - 32768
                if len(slow := np.flatnonzero(found == 0)):
                    bits[slow], difference[slow] = self._block(words, here[slow], c, limit)
                at[lanes] = here + bits
                last[c][lanes] += difference
                if c == 0:
                    out[lanes, step, k] = last[0][lanes]
                    k += 1
        if (at > limit).any():
            raise JpegError("the scan is cut off")
        return out

    def _block(self, words: np.ndarray, start: np.ndarray, c: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(bits, DC difference) of a whole block for each start, any coefficients."""

        def peek(at):
            at = np.minimum(at, limit + 64)
            return (words[at >> 3].astype(np.uint64) << 16 | words[np.minimum((at >> 3) + 2, len(words) - 1)] & 0xFFFF).astype(np.int64) >> 16 - (at & 7).astype(np.int64) & 0xFFFFFFFF

        at, window = start.copy(), peek(start)
        code = self.dc[c][window >> 16].astype(np.int64)
        if (code == 0).any():
            raise JpegError("no such code")
        length, category = code >> 8, code & 255
        if (category > 15).any():
            raise JpegError("no such code")
        extra = window >> 32 - length - category & (1 << category) - 1
        difference = np.where((category > 0) & (extra < 1 << np.maximum(category - 1, 0)), extra - (1 << category) + 1, extra)
        at += length + category
        left, position = np.arange(len(at)), np.ones(len(at), np.int64)
        while len(left):
            code = self.ac[c][peek(at[left]) >> 16].astype(np.int64)
            if (code == 0).any() or (at[left] > limit).any():
                raise JpegError("no such code")
            run, size = code >> 4 & 15, code & 15
            at[left] += (code >> 8) + size
            position[left] += run + 1
            left = left[~((size == 0) & (run == 0)) & (position[left] < 64) | (size == 0) & (run == 15) & (position[left] < 64)]
        return at - start, difference


_decoders: dict[tuple, Decoder] = {}


def thumbnails(stored: list[bytes]) -> list[tuple[Image, np.ndarray] | None]:
    """For each of stored: its first image, and the luminance thumbnails of all its images one below the other; None if it is no baseline JPEG."""
    out: list = [None] * len(stored)
    groups: dict[tuple, list] = {}
    images: list[list[Image]] = [[] for _ in stored]
    for i, data in enumerate(stored):
        raw, at, parts = np.frombuffer(data, np.uint8), 0, []
        try:
            while at < len(data):
                image = parse(data, at)
                part, starts = _lanes(raw, image)
                across, down = image.units()
                interval = image.interval or across * down
                units = [min(interval, across * down - k) for k in range(0, across * down, interval)]
                if len(units) != len(starts):
                    raise JpegError("restart markers are missing")
                if across * down * 2 > 8 * len(part):  # a unit takes two bits at least, so that a frame's size alone can't ask for memory
                    raise JpegError("the scan is cut off")
                parts.append((image, part, np.array(starts), np.array(units)))
                at = image.end
        except JpegError:
            continue
        images[i] = [p[0] for p in parts]
        for k, (image, part, starts, units) in enumerate(parts):
            groups.setdefault(image.signature(), []).append((i, k, image, part, starts, units))
    pieces: list[dict[int, np.ndarray]] = [{} for _ in stored]
    for signature, members in groups.items():
        if signature not in _decoders:
            if len(_decoders) > 16:
                _decoders.clear()
            _decoders[signature] = Decoder(members[0][2])
        try:
            levels = _decode(_decoders[signature], members)
        except (JpegError, IndexError):  # one is damaged: each by itself
            levels = []
            for m in members:
                try:
                    levels += _decode(_decoders[signature], [m])
                except (JpegError, IndexError):
                    levels.append(None)
        for (i, k, image, *_), level in zip(members, levels, strict=True):
            if level is not None:
                pieces[i][k] = _picture(image, level)
    for i, own in enumerate(images):
        if own and len(pieces[i]) == len(own) and len({p.shape[1] for p in pieces[i].values()}) == 1:
            out[i] = own[0], np.concatenate([pieces[i][k] for k in range(len(own))])
    return out


def _decode(decoder: Decoder, members: list) -> list[np.ndarray]:
    offsets = np.cumsum([0, *[len(m[3]) for m in members]])
    starts = np.concatenate([m[4] + o for m, o in zip(members, offsets, strict=False)])
    units = np.concatenate([m[5] for m in members])
    levels = decoder(np.concatenate([m[3] for m in members]), starts, units)
    cuts = np.cumsum([len(m[4]) for m in members])[:-1]
    return [x[np.arange(levels.shape[1]) < u[:, None]] for x, u in zip(np.split(levels, cuts), np.split(units, cuts), strict=True)]


def _picture(image: Image, levels: np.ndarray) -> np.ndarray:
    """levels: units x the first component's blocks in a unit."""
    across, down = image.units()
    c = image.components[0]
    h, v = (1, 1) if len(image.components) == 1 else (c.h, c.v)
    grid = levels.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    samples = np.clip((grid * image.dc_quantizers[c.quantizer] + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    return samples[: -(-image.height // 8), : -(-image.width // 8)]


def average_hash(thumbnail: np.ndarray) -> str:
    """64 bits: which cells of an 8x8 grid are brighter than the whole; 16 hex digits."""
    rows = np.arange(8) * thumbnail.shape[0] // 8
    columns = np.arange(8) * thumbnail.shape[1] // 8
    sums = thumbnail.astype(np.int64)
    for axis, cells in ((0, rows), (1, columns)):
        own, back = np.unique(cells, return_inverse=True)
        sizes = np.diff(np.append(own, thumbnail.shape[axis]))
        sums = np.add.reduceat(sums, own, axis=axis) * 4096 // (sizes[:, None] if axis == 0 else sizes)  # means, as fixed-point numbers
        sums = np.take(sums, back, axis=axis)
    return np.packbits((sums > sums.mean()).ravel()).tobytes().hex()
