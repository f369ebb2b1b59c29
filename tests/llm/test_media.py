import hashlib
import random
import zlib

import numpy as np
import pytest

from lakeloom.llm import jpeg, media


def payload(t):
    raw = (t or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def slow_decode(data):
    """A plain decoder, one bit at a time, after the standard's flow charts: coefficients by component in scan order."""
    pos, tables, restart, planes = 2, {}, 0, {}

    def segment():
        nonlocal pos
        mark, n = data[pos + 1], int.from_bytes(data[pos + 2 : pos + 4], "big")
        body = data[pos + 4 : pos + 2 + n]
        pos += 2 + n
        return mark, body

    while data[pos : pos + 2] != b"\xff\xd9":
        mark, body = segment()
        if mark == 0xC2:
            h, w = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            sizes = {1: (w // 8) * (h // 8), 2: (w // 16) * (h // 16), 3: (w // 16) * (h // 16)}
            planes = {c: [[0] * 64 for _ in range(n)] for c, n in sizes.items()}
        elif mark == 0xC4:
            while body:
                total, codes, code, k = sum(body[1:17]), {}, 0, 17
                for length in range(1, 17):
                    for _ in range(body[length]):
                        codes[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]], body = codes, body[17 + total :]
        elif mark == 0xDD:
            restart = int.from_bytes(body, "big")
        elif mark == 0xDA:
            c, lo, hi, before, left = body[1], body[3], body[4], body[5] >> 4, body[5] & 15
            table = tables.get(16 | body[2] & 15 if lo else body[2] >> 4)
            lanes, own = [], []
            while True:
                if data[pos] == 0xFF:
                    if data[pos + 1] == 0:
                        own.append(0xFF)
                    elif 0xD0 <= data[pos + 1] <= 0xD7:
                        lanes.append(own)
                        own = []
                    else:
                        break
                    pos += 2
                else:
                    own.append(data[pos])
                    pos += 1
            lanes.append(own)
            for i, lane in enumerate(lanes):
                bits = iter("".join(f"{b:08b}" for b in lane))
                get = lambda n: int("".join(next(bits) for _ in range(n)) or "0", 2)  # noqa: B023, E731

                def symbol():
                    code = 0
                    for n in range(1, 17):
                        code = code << 1 | get(1)
                        if (n, code) in table:
                            return table[n, code]
                    raise ValueError

                def number(s):
                    v = get(s)
                    return v if not s or v >> (s - 1) else v - (1 << s) + 1

                dc = 0
                for block in planes[c][i * restart : (i + 1) * restart]:
                    if lo == 0:
                        if before:
                            block[0] |= get(1) << left
                        else:
                            dc += number(symbol())
                            block[0] = dc << left
                        continue
                    k = lo
                    if not before:
                        while k <= hi:
                            r, s = divmod(symbol(), 16)
                            if s == 0:
                                if r < 15:
                                    break
                                k += 16
                                continue
                            k += r
                            block[k] = number(s) * (1 << left)
                            k += 1
                        continue
                    ended = False
                    while k <= hi:
                        r, s = divmod(symbol(), 16)
                        ended = s == 0 and r < 15
                        new = (1 if get(1) else -1) if s else 0
                        while k <= hi:
                            if block[k]:
                                if get(1):
                                    block[k] += (1 << left) * (1 if block[k] > 0 else -1)
                            elif ended or r:
                                r -= not ended
                            else:
                                block[k] = new * (1 << left)
                                k += 1
                                break
                            k += 1
    return planes


TEXTS = [None, "", "a", "x" * 64, "y" * 65, "hello world " * 60, "été Straße 日本語 😀", "\x00\x01\x7f" * 50]


def test_payloads_come_back():
    rnd = random.Random(2)
    texts = TEXTS + ["".join(chr(rnd.choice([32, 101, 116, 200, 0x20AC, 0, 10, 255])) for _ in range(rnd.randint(0, 3000))) for _ in range(30)] + ["long " * 40_000]
    files, sizes = media.encode_payloads(texts)
    got, tiles, width, height = media.decode_payloads(files)
    assert got == [payload(t) for t in texts] and sizes == [len((t or "").encode()) for t in texts]
    assert len(tiles) == (width * height).sum()


def test_a_plain_decoder_reads_the_files():
    rnd = np.random.default_rng(3)
    blocks = np.where(rnd.random((40, 64)) < 0.4, 0, rnd.integers(-128, 129, (40, 64))).astype(np.int16)
    blocks[5] = 0
    blocks[6, :] = 0
    blocks[6, [5, 63]] = [1, -1]
    n = np.array([1, 7, 32])
    files = jpeg.encode(blocks, n)
    grid, width, height = jpeg.decode(files)
    at = np.cumsum(width * height * 6) - width * height * 6
    for i, f in enumerate(files):
        planes = slow_decode(f)
        own = grid[at[i] : at[i] + width[i] * height[i] * 6]
        start = int(n[:i].sum())
        assert (own[: n[i]] == blocks[start : start + n[i]]).all() and not own[n[i] :].any()
        for c in range(3):
            _, place = jpeg.raster(width[i : i + 1], height[i : i + 1], c)
            assert (np.array(planes[c + 1]) == own[place]).all()


def test_transform_and_colours():
    rnd = np.random.default_rng(4)
    grid = rnd.integers(-60, 60, (12, 64)).astype(np.int16)
    image = jpeg.rgb_image(jpeg.rgb_tiles(grid), 2, 1)
    assert image.shape == (16, 32, 3)
    k = np.arange(8)
    for y, x in [(0, 0), (3, 9), (12, 31), (15, 16)]:
        mcu, yy, xx = x // 16, y, x % 16

        def sample(block, r, c):
            square = np.zeros(64)
            square[jpeg.zigzag()] = grid[block]
            scale = np.where(k == 0, np.sqrt(0.125), 0.5)
            return (square.reshape(8, 8) * np.outer(scale * np.cos((2 * r + 1) * k * np.pi / 16), scale * np.cos((2 * c + 1) * k * np.pi / 16))).sum()

        lum = sample(mcu * 6 + yy // 8 * 2 + xx // 8, yy % 8, xx % 8) + 128
        cb, cr = sample(mcu * 6 + 4, yy // 2, xx // 2), sample(mcu * 6 + 5, yy // 2, xx // 2)
        want = np.clip(np.rint([lum + 1.402 * cr, lum - 0.344136 * cb - 0.714136 * cr, lum + 1.772 * cb]), 0, 255)
        assert np.abs(image[y, x].astype(int) - want).max() <= 1


def test_zigzag_order():
    assert jpeg.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


@pytest.mark.parametrize("name", ["edge_docs", "small_docs", "no_docs"])
def test_features(name, request):
    docs = request.getfixturevalue(name)
    rows = media.media_features(docs).collect()
    want = sorted(((r["doc_id"] or -1), len((r["text"] or "").encode()), hashlib.sha256(payload(r["text"])).hexdigest(), zlib.crc32(payload(r["text"])[-64:]), len(payload(r["text"]))) for r in docs.collect())
    assert sorted(((r["doc_id"] or -1), r["n_bytes"], r["payload_sha256"], r["tail_crc32"], r["payload_bytes"]) for r in rows) == want
    by = {}
    for r in rows:
        assert by.setdefault(r["payload_sha256"], (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])


def test_tensors(small_docs):
    stored = media.store(small_docs.limit(5))
    for r in media.rgb_tensors(stored).collect():
        assert len(r["rgb"]) == 3 * r["height"] * r["width"]
