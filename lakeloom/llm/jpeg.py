"""Progressive JPEG in numpy, many images at a time.

Images are YCbCr with chroma at half resolution in both directions, coded by separate scans for
each component: spectral bands, and bits of precision by successive approximation. Restart intervals are the lanes of
the coder: all intervals of one kind of scan in a batch of images are coded in step, one symbol (or
coefficient) of each lane at a time, so the cost of a numpy call is shared by thousands of lanes.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from functools import cache

import numpy as np

#: Scans of each component: first and last coefficient, bits known before, bits left out, blocks in a restart interval.
SCANS = [(0, 0, 0, 1, 64), (1, 5, 0, 1, 8), (6, 63, 0, 0, 1), (1, 5, 1, 0, 8), (0, 0, 1, 0, 64)]


@cache
def zigzag() -> np.ndarray:
    """Place in the 8 x 8 block of each coefficient in zigzag order."""
    cells = sorted(((r + c, (r if (r + c) % 2 else c), r * 8 + c) for r in range(8) for c in range(8)))
    return np.array([c[2] for c in cells])


# ---- Huffman tables: lengths from weights, at most 16 bits, the all-ones code left free


def huffman(weights: dict[int, float]) -> tuple[bytes, bytes]:
    """Number of codes of each length from 1 to 16, and the symbols in order of length."""
    nodes = [(w, i, [s]) for i, (s, w) in enumerate(sorted(weights.items()))] + [(0.0, len(weights), [-1])]
    depth = defaultdict(int)
    n = len(nodes)
    while len(nodes) > 1:
        nodes.sort(key=lambda x: x[:2])
        a, b = nodes[:2]
        for s in a[2] + b[2]:
            depth[s] += 1
        nodes = [(a[0] + b[0], n, a[2] + b[2]), *nodes[2:]]
        n += 1
    counts = [0] * 64
    for d in depth.values():
        counts[d] += 1
    for d in range(63, 16, -1):  # as the standard's Annex K shortens codes that are too long
        while counts[d]:
            j = d - 2
            while not counts[j]:
                j -= 1
            counts[d] -= 2
            counts[d - 1] += 1
            counts[j + 1] += 2
            counts[j] -= 1
    longest = max(d for d in range(17) if counts[d])
    counts[longest] -= 1  # the reserved code
    symbols = sorted((s for s in depth if s >= 0), key=lambda s: (depth[s], s))
    return bytes(counts[1:17]), bytes(symbols)


def codes_of(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol."""
    code, length, c, k = np.zeros(256, dtype=np.uint64), np.zeros(256, dtype=np.int64), 0, 0
    for bits, n in enumerate(table[0], 1):
        for _ in range(n):
            code[table[1][k]], length[table[1][k]] = c, bits
            c, k = c + 1, k + 1
        c <<= 1
    return code, length


@cache
def lookup(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length by the next 16 bits; length 0 where there is no such code."""
    symbol, length = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
    code, bits = codes_of(table)
    for s in table[1]:
        a = int(code[s]) << (16 - int(bits[s]))
        symbol[a : a + (1 << (16 - int(bits[s])))] = s
        length[a : a + (1 << (16 - int(bits[s])))] = bits[s]
    return symbol, length


#: Shares of coefficients by the number of bits of their size, from 1, as in plain text stored by ``lakeloom.llm.media``.
SIZES = (0.28, 0.27, 0.26, 0.11, 0.03, 0.02, 0.01, 0.02)


@cache
def tables() -> dict[tuple[int, int, int, int], tuple[bytes, bytes]]:
    """The Huffman table of each kind of scan (none for raw DC bits), from a rule over sizes and runs."""
    out = {}
    for lo, hi, before, left, _ in SCANS:
        if lo == 0:
            if not before:
                out[lo, hi, before, left] = huffman({s: 2.0 ** -abs(s - 4) for s in range(12)})
        elif before:
            out[lo, hi, before, left] = huffman({0: 1.0} | {r << 4 | 1: 0.3**r for r in range(hi - lo + 1)})
        elif hi - lo < 16:
            out[lo, hi, before, left] = huffman({0: 0.3} | {r << 4 | s: 0.28**r * SIZES[min(s, 7)] for r in range(hi - lo + 1) for s in range(1, 9)})
        else:
            out[lo, hi, before, left] = huffman({0: 0.01, 0xF0: 1e-6} | {r << 4 | s: 1e-6**(r > 0) * 0.5**r * SIZES[s - 1] for r in range(16) for s in range(1, 9)})
    return out


# ---- Layout: payload blocks lie MCU by MCU (four of Y, then Cb, then Cr); a component's scans go line by line


def layout(n_blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Width and height in MCUs of images that hold so many blocks, nearly filled, each side under 4096."""
    mcus = -(-n_blocks // 6)
    most = np.maximum(256, -(-mcus // 4000))
    height = np.maximum(1, -(-mcus // most))
    return np.maximum(1, -(-mcus // height)), height


def raster(width: np.ndarray, height: np.ndarray, component: int) -> tuple[np.ndarray, np.ndarray]:
    """For a component of several images: each image's number of blocks, and for every block in
    scan order its place in the images' MCU order (all images' blocks, six to an MCU)."""
    mcus = width * height
    base = np.cumsum(mcus) - mcus
    sub = 2 if component == 0 else 1
    count = mcus * sub * sub
    image = np.repeat(np.arange(len(mcus)), count)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    row, column = np.divmod(k, (width * sub)[image])
    mcu = base[image] + row // sub * width[image] + column // sub
    return count, mcu * 6 + (row % sub * sub + column % sub if component == 0 else 3 + component)


def intervals_of(count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The image of each restart interval of a scan, and how many blocks it has."""
    n = -(-count // size)
    image = np.repeat(np.arange(len(count)), n)
    k = np.arange(len(image)) - np.repeat(np.cumsum(n) - n, n)
    return image, np.minimum(size, count[image] - k * size)


# ---- Encoding


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of the absolute value."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def pack(value: np.ndarray, bits: np.ndarray, lane: np.ndarray, lanes: int, image: np.ndarray, images: int) -> list[bytes]:
    """Items of at most 32 bits, ordered by lane, as each image's entropy-coded bytes.

    Lanes are padded with ones to whole bytes, zero bytes follow bytes of ones, and restart marks
    stand between the lanes of an image.
    """
    per_lane = np.bincount(lane, weights=bits, minlength=lanes).astype(np.int64)
    size = (per_lane + 7) // 8
    start = np.cumsum(size) - size
    ends = np.cumsum(bits)
    before = np.cumsum(per_lane) - per_lane
    at = ends - bits - before[lane] + 8 * start[lane]
    pads = np.flatnonzero(per_lane % 8)
    at = np.concatenate([at, 8 * start[pads] + per_lane[pads]])
    bits = np.concatenate([bits, (-per_lane[pads]) % 8])
    value = np.concatenate([value.astype(np.uint64), (np.uint64(1) << ((-per_lane[pads]) % 8).astype(np.uint64)) - np.uint64(1)])
    window = value << (64 - (at & 31) - bits).astype(np.uint64)
    words = int(size.sum()) // 4 + 3
    total = np.bincount(at >> 5, weights=(window >> np.uint64(32)).astype(np.float64), minlength=words) + np.bincount((at >> 5) + 1, weights=(window & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)
    data = total.astype(">u4").view(np.uint8)[: int(size.sum())]
    ones = data == 0xFF
    of_lane = np.repeat(np.arange(lanes), size)
    last = np.r_[image[1:] != image[:-1], True] if lanes else np.zeros(0, dtype=bool)
    marks = np.cumsum(~last) - ~last  # before each lane
    stuffed = np.cumsum(ones) - ones
    where = np.arange(len(data)) + stuffed + 2 * marks[of_lane]
    lane_end = np.zeros(lanes + 1, dtype=np.int64)
    full = np.r_[0, np.cumsum(ones)]
    lane_end[1:] = start + size + full[start + size] + 2 * np.cumsum(~last)
    out = np.zeros(int(lane_end[-1]), dtype=np.uint8)
    out[where] = data
    mark = np.flatnonzero(~last)
    first = np.r_[0, np.flatnonzero(last)[:-1] + 1] if lanes else np.zeros(0, dtype=np.int64)
    k = np.arange(lanes) - np.repeat(first, np.diff(np.r_[first, lanes]))
    out[lane_end[mark + 1] - 2] = 0xFF
    out[lane_end[mark + 1] - 1] = 0xD0 + k[mark] % 8
    cuts = np.r_[0, lane_end[np.flatnonzero(last) + 1]]
    whole = out.tobytes()
    return [whole[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]


def encode_scan(blocks: np.ndarray, count: np.ndarray, scan) -> list[bytes]:
    """Each image's entropy-coded data of one scan of a component; ``blocks``: (n, 64) in scan order, zigzag coefficients."""
    lo, hi, before, left, restart = scan
    image, size = intervals_of(count, restart)
    lanes, lane = len(image), np.repeat(np.arange(len(size)), size)
    if lo == 0 and before:
        return pack((blocks[:, 0].astype(np.int64) >> left) & 1, np.ones(len(blocks), dtype=np.int64), lane, lanes, image, len(count))
    code, length = codes_of(tables()[lo, hi, before, left])
    if lo == 0:
        v = blocks[:, 0].astype(np.int64) >> left
        v = v - np.where(np.r_[True, lane[1:] != lane[:-1]], 0, np.r_[0, v[:-1]]) if len(v) else v
        s = _size(v)
        raw = np.where(v < 0, v + (1 << s) - 1, v)
        return pack((code[s].astype(np.int64) << s) | raw, length[s] + s, lane, lanes, image, len(count))
    band = blocks[:, lo : hi + 1].astype(np.int64)
    if before:
        return _refine(band, left, code, length, lane, lanes, image, count)
    v = np.sign(band) * (np.abs(band) >> left)
    row, column = np.nonzero(v)
    value = v[row, column]
    same = np.r_[False, row[1:] == row[:-1]] if len(row) else np.zeros(0, dtype=bool)
    run = column - np.where(same, np.r_[0, column[:-1]] + 1 if len(column) else 0, 0)
    s = _size(value)
    symbol = (run % 16) << 4 | s
    item = (code[symbol].astype(np.int64) << s) | np.where(value < 0, value + (1 << s) - 1, value)
    bits = length[symbol] + s
    key = row * 130 + column * 2 + 1
    longs = np.flatnonzero(run >= 16)
    if len(longs):
        times = run[longs] // 16
        key = np.concatenate([key, np.repeat(row[longs] * 130 + column[longs] * 2, times)])
        item = np.concatenate([item, np.full(int(times.sum()), int(code[0xF0]))])
        bits = np.concatenate([bits, np.full(int(times.sum()), int(length[0xF0]))])
    short = np.flatnonzero(v[:, -1] == 0)
    if len(short) or len(longs):
        key = np.concatenate([key, short * 130 + 129])
        item = np.concatenate([item, np.full(len(short), int(code[0]))])
        bits = np.concatenate([bits, np.full(len(short), int(length[0]))])
        order = np.argsort(key, kind="stable")
        key, item, bits = key[order], item[order], bits[order]
    return pack(item, bits, lane[key // 130], lanes, image, len(count))


def _refine(band, left, code, length, lane, lanes, image, count) -> list[bytes]:
    """One more bit of a band of at most 16 coefficients: corrections of those known, signs of new ones."""
    assert band.shape[1] <= 5, "a block's bits are gathered in 64"
    n = len(band)
    size = np.abs(band) >> left
    acc, bits = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    run, held, n_held = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    for k in range(band.shape[1]):
        v = size[:, k]
        known = v > 1
        held = np.where(known, held << np.uint64(1) | (v & 1).astype(np.uint64), held)
        n_held += known.astype(np.uint64)
        new = np.flatnonzero(v == 1)
        symbol = run[new] << 4 | 1
        more = length[symbol].astype(np.uint64) + np.uint64(1) + n_held[new]
        put = ((code[symbol] << np.uint64(1) | (band[new, k] > 0).astype(np.uint64)) << n_held[new]) | held[new]
        acc[new] = acc[new] << more | put
        bits[new] += more
        held[new], n_held[new], run[new] = 0, 0, 0
        run[v == 0] += 1
    rest = np.flatnonzero((run > 0) | (n_held > 0))
    more = np.uint64(length[0]) + n_held[rest]
    acc[rest] = acc[rest] << more | (code[0] << n_held[rest]) | held[rest]
    bits[rest] += more
    high = np.minimum(bits, np.uint64(32))
    low = bits - high
    items = np.stack([acc >> low, acc & ((np.uint64(1) << low) - np.uint64(1))], axis=1).ravel()
    sizes = np.stack([high, low], axis=1).ravel().astype(np.int64)
    return pack(items, sizes, np.repeat(lane, 2), lanes, image, len(count))


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


@cache
def _tables_segment() -> tuple[bytes, dict[tuple, int]]:
    """The DHT segment and the table number of each kind of scan."""
    body, number, used = b"", {}, {0: 0, 1: 0}
    for kind, table in tables().items():
        ac = int(kind[0] > 0)
        number[kind] = used[ac]
        body += bytes([ac << 4 | used[ac]]) + table[0] + table[1]
        used[ac] += 1
    return _segment(0xC4, body), number


def encode(blocks: np.ndarray, n_blocks: np.ndarray) -> list[bytes]:
    """Images whose coefficients are the given blocks ((n, 64) int16, zigzag order, MCU order), as files.

    Blocks after an image's own, up to whole MCU rows, are zero.
    """
    width, height = layout(n_blocks)
    mcus = width * height
    images = len(n_blocks)
    grid = np.zeros((int(mcus.sum()) * 6, 64), dtype=np.int16)
    first = (np.cumsum(mcus) - mcus) * 6
    own = np.repeat(np.arange(images), n_blocks)
    grid[first[own] + np.arange(len(blocks)) - (np.cumsum(n_blocks) - n_blocks)[own]] = blocks
    dht, number = _tables_segment()
    quant = _segment(0xDB, bytes([0]) + bytes([1] * 64))
    files = [[b"\xff\xd8", quant, _segment(0xC2, struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), dht] for w, h in zip(width.tolist(), height.tolist(), strict=True)]
    restart = None
    for scan in SCANS:
        lo, hi, before, left, interval = scan
        if interval != restart:
            restart = interval
            for f in files:
                f.append(_segment(0xDD, struct.pack(">H", interval)))
        for component in range(3):
            count, at = raster(width, height, component)
            table = number.get((lo, hi, before, left), 0)
            head = _segment(0xDA, bytes([1, component + 1, (0 if lo else table) << 4 | (table if lo else 0), lo, hi, before << 4 | left]))
            for f, data in zip(files, encode_scan(grid[at], count, scan), strict=True):
                f += (head, data)
    return [b"".join(f) + b"\xff\xd9" for f in files]


# ---- Decoding


class _File:
    def __init__(self):
        self.width = self.height = 0
        self.quant: dict[int, np.ndarray] = {}
        self.components: list[tuple[int, int, int]] = []
        self.scans: list[tuple] = []


def parse(data: bytes, marks: list[int]) -> _File:
    """Sizes, tables and the places of the scans of one file; ``marks``: places of its marks other than restarts."""
    out, tables_, restart = _File(), {}, 0
    for i, p in enumerate(marks):
        mark = data[p + 1]
        if mark in (0xD8, 0xD9):
            continue
        n = struct.unpack_from(">H", data, p + 2)[0]
        body = data[p + 4 : p + 2 + n]
        if mark == 0xDB:
            while body:
                out.quant[body[0] & 15] = np.frombuffer(body[1:65], dtype=np.uint8).astype(np.float32)
                body = body[65:]
        elif mark == 0xC2:
            _, out.height, out.width, n_components = struct.unpack_from(">BHHB", body)
            out.components = [(body[6 + 3 * k], body[7 + 3 * k], body[8 + 3 * k]) for k in range(n_components)]
        elif mark == 0xC4:
            while body:
                total = sum(body[1:17])
                tables_[body[0]] = (body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            if body[0] != 1:
                raise ValueError("scans of several components aren't read")
            lo, hi, precision = body[3:6]
            table = tables_.get(body[2] >> 4 if lo == 0 else 16 | (body[2] & 15))
            end = marks[i + 1] if i + 1 < len(marks) else len(data)
            component = next(k for k, c in enumerate(out.components) if c[0] == body[1])
            out.scans.append((component, lo, hi, precision >> 4, precision & 15, restart, table, p + 2 + n, end))
    return out


class _Bits:
    """Unstuffed bytes of many lanes, read by bit positions."""

    def __init__(self, raw: np.ndarray, cuts: np.ndarray):
        """``cuts``: where each scan's data starts in ``raw``, and the end."""
        after_ff = np.r_[False, raw[:-1] == 0xFF] if len(raw) else np.zeros(0, dtype=bool)
        stuffing = after_ff & (raw == 0)
        restart = after_ff & (raw >= 0xD0) & (raw <= 0xD7)
        drop = stuffing | restart
        drop[:-1] |= restart[1:]
        kept = np.r_[0, np.cumsum(~drop)]
        self.starts = np.sort(np.concatenate([kept[cuts[:-1]], kept[np.flatnonzero(restart) + 1]]))
        data = np.concatenate([raw[~drop], np.full(8, 0xFF, dtype=np.uint8)]).astype(np.uint32)
        self.word = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next 16 bits, first one highest."""
        return (self.word[at >> 3] >> (16 - (at & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF


def _decode_dc(bits: _Bits, table, size: np.ndarray, before: int, left: int, out: np.ndarray, first: np.ndarray) -> None:
    at = bits.starts * 8
    if before:
        lane = np.repeat(np.arange(len(size)), size)
        k = np.arange(len(lane)) - np.repeat(np.cumsum(size) - size, size)
        out[first[lane] + k, 0] |= ((bits.peek(at[lane] + k) >> 15) << left).astype(np.int16)
        return
    symbol, length = lookup(table)
    last = np.zeros(len(size), dtype=np.int64)
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        p = at[on]
        w = bits.peek(p)
        s = symbol[w]
        p = p + length[w]
        v = bits.peek(p) >> (16 - s)
        v = np.where((s > 0) & (v < (1 << np.maximum(s - 1, 0))), v - (1 << s) + 1, v)
        last[on] += v
        out[first[on] + k, 0] = last[on] << left
        at[on] = p + s


def _decode_ac(bits: _Bits, table, size: np.ndarray, lo: int, hi: int, left: int, out: np.ndarray, first: np.ndarray) -> None:
    symbol, length = lookup(table)
    at, block, end = bits.starts * 8, first.copy(), first + size
    k = np.full(len(size), lo)
    flat = out.reshape(-1)
    while len(at):
        for _ in range(8):
            w = bits.peek(at)
            live = block < end
            s = symbol[w]
            at = at + length[w]
            run, s = s >> 4, s & 15
            v = bits.peek(at) >> (16 - s)
            has = live & (s > 0)
            k = k + np.where(s > 0, run, 0)
            if (k[has] > hi).any():
                raise ValueError("a run leaves its block")
            v = np.where(v < (1 << np.maximum(s - 1, 0)), v - (1 << s) + 1, v)
            flat[(block * 64 + k)[has]] = (v << left)[has]
            at = at + s
            k = k + 1
            stop = (s == 0) & (run < 15)
            k = np.where((s == 0) & (run == 15), k + 15, k)
            many = np.zeros(len(at), dtype=np.int64)
            if (long := stop & (run > 0) & live).any():
                many = np.where(long, (1 << run) - 1 + (bits.peek(at) >> (16 - run)), 0)
                at = at + np.where(long, run, 0)
            over = stop | (k > hi)
            block = block + over + many
            k = np.where(over, lo, k)
        on = np.flatnonzero(block < end)
        if len(on) < len(at):
            at, block, end, k = at[on], block[on], end[on], k[on]


def _decode_refine(bits: _Bits, table, size: np.ndarray, lo: int, hi: int, left: int, out: np.ndarray, first: np.ndarray) -> None:
    """One coefficient of each lane at a time: known ones take a correction bit, others count down the run to a new one."""
    symbol, length = lookup(table)
    at, block, end, flat = bits.starts * 8, first.copy(), first + size, out.reshape(-1)
    n = len(at)
    k, run, new, ending, skip = np.full(n, lo), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
    asked = np.zeros(n, dtype=bool)  # a symbol has been read and isn't used up
    one = 1 << left
    while len(at):
        ask = np.flatnonzero(~asked & ~ending)
        if len(ask):
            w = bits.peek(at[ask])
            s = symbol[w]
            p = at[ask] + length[w]
            r, s = s >> 4, s & 15
            stop = (s == 0) & (r < 15)
            more = bits.peek(p) >> 15
            new[ask] = np.where(s > 0, np.where(more > 0, one, -one), 0)
            p = p + (s > 0)
            skip[ask] = np.where(stop, (1 << r) - 1 + (bits.peek(p) >> (16 - r)), skip[ask])
            at[ask] = p + np.where(stop, r, 0)
            run[ask], ending[ask], asked[ask] = r, stop, ~stop
        c = flat[block * 64 + k].astype(np.int64)
        known = c != 0
        bit = bits.peek(at) >> 15
        fix = known & (bit > 0)
        flat[(block * 64 + k)[fix]] = (c + np.where(c > 0, one, -one))[fix]
        at = at + known
        place = ~known & asked & (run == 0)
        put = place & (new != 0)
        flat[(block * 64 + k)[put]] = new[put]
        asked &= ~place
        run = run - (~known & ~place & asked)
        k = k + 1
        over = k > hi
        block = block + over
        k = np.where(over, lo, k)
        asked &= ~over
        done = over & ending
        ending = np.where(done & (skip == 0), False, ending)
        skip = np.where(done & (skip > 0), skip - 1, skip)
        if (block >= end).any():
            on = np.flatnonzero(block < end)
            at, block, end, k, run, new, ending, skip, asked = (x[on] for x in (at, block, end, k, run, new, ending, skip, asked))


def decode(files: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients of all files ((n, 64) int16, zigzag order, MCU order), and width and height in MCUs of each."""
    raw = np.frombuffer(b"".join(files), dtype=np.uint8)
    starts = np.cumsum([0, *map(len, files)])
    follow = raw[1:]
    at = np.flatnonzero((raw[:-1] == 0xFF) & (follow != 0) & (follow != 0xFF) & ~((follow >= 0xD0) & (follow <= 0xD7)))
    cut = np.searchsorted(at, starts)
    parsed = []
    for i, f in enumerate(files):
        # A mark's body may hold bytes that look like marks: those inside the last segment's length are passed over.
        marks, least = [], 0
        for p in (at[cut[i] : cut[i + 1]] - starts[i]).tolist():
            if p >= least:
                marks.append(p)
                least = p + 2 if f[p + 1] in (0xD8, 0xD9) else p + 2 + struct.unpack_from(">H", f, p + 2)[0]
        parsed.append(parse(f, marks))
    width = np.array([p.width // 16 for p in parsed], dtype=np.int64)
    height = np.array([p.height // 16 for p in parsed], dtype=np.int64)
    grid = np.zeros((int((width * height).sum()) * 6, 64), dtype=np.int16)
    groups: dict[tuple, list[tuple[int, int, int]]] = defaultdict(list)
    for i, p in enumerate(parsed):
        for n, (*kind, a, b) in enumerate(p.scans):
            groups[n, *kind].append((i, a, b))
    planes: dict[int, tuple] = {}
    for component in range(3):
        count, place = raster(width, height, component)
        planes[component] = (np.cumsum(count) - count, place, np.zeros((len(place), 64), dtype=np.int16), count)
    for (_, component, lo, hi, before, left, restart, table), members in sorted(groups.items(), key=lambda g: g[0][0]):
        base, _, plane, count = planes[component]
        images = np.array([m[0] for m in members])
        bits = _Bits(np.concatenate([raw[starts[i] + a : starts[i] + b] for i, a, b in members]), np.cumsum([0, *(b - a for _, a, b in members)]))
        image, size = intervals_of(count[images], restart or int(count.max()))
        if len(image) != len(bits.starts):
            raise ValueError("restart intervals are missing")
        k = np.arange(len(image)) - np.repeat(np.flatnonzero(np.r_[True, image[1:] != image[:-1]]), np.bincount(image))
        first = base[images[image]] + k * (restart or 0)
        if lo == 0:
            _decode_dc(bits, table, size, before, left, plane, first)
        elif before:
            _decode_refine(bits, table, size, lo, hi, left, plane, first)
        else:
            _decode_ac(bits, table, size, lo, hi, left, plane, first)
    for component in range(3):
        _, place, plane, _ = planes[component]
        grid[place] = plane
    return grid, width, height


@cache
def _cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None]
    return (np.where(k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)).astype(np.float32)


def rgb_tiles(grid: np.ndarray, quant: float = 1.0) -> np.ndarray:
    """Coefficients in MCU order as RGB tiles, (n, 16, 16, 3) uint8: inverse transform, chroma upsampled, colours converted."""
    square = np.empty((len(grid), 64), dtype=np.float32)
    square[:, zigzag()] = grid * np.float32(quant)
    c = _cosines()
    samples = c.T @ square.reshape(-1, 8, 8) @ c
    mcu = samples.reshape(-1, 6, 8, 8)
    y = mcu[:, :4].reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 16, 16) + 128
    cb, cr = (np.repeat(np.repeat(mcu[:, k], 2, axis=1), 2, axis=2) for k in (4, 5))
    out = np.empty((*y.shape, 3), dtype=np.uint8)
    for k, plane in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        out[..., k] = np.clip(np.rint(plane), 0, 255)
    return out


def rgb_image(tiles: np.ndarray, width: int, height: int) -> np.ndarray:
    """An image's tiles as one full-resolution tensor, (16 * height, 16 * width, 3)."""
    return tiles.reshape(height, width, 16, 16, 3).transpose(0, 2, 1, 3, 4).reshape(16 * height, 16 * width, 3)
