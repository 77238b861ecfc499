from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import empty, odd, odd_rows

from pairloom.llm import flac


def test_round_trip():
    r = random.Random(2)
    texts = ["", "a", "é" * 500, "word " * 3000, "\x00" * 192 * 300]
    some = [flac.payload(t) for t in texts] + [r.randbytes(192 * n) for n in (1, 2, 130)] + [bytes([0, 255]) * 96 * 3, b"\xff\xf8\x10\x02\x00\x18" * 32 * 140]
    streams = flac.encode(some)
    assert flac.decode(streams) == some
    assert flac.encode([some[2]]) == [streams[2]]  # equal texts, equal streams, whatever they are coded with
    assert flac.decode([]) == flac.encode([]) == []
    assert len(streams[4]) < len(some[4]) / 10


@pytest.mark.parametrize("at", [-1, -100, 30, 200])
def test_damage_is_an_error(at):
    stream = bytearray(flac.encode([flac.payload("some words that are stored " * 40)])[0])
    stream[at] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(stream)])


class Bits(list):
    def put(self, v, w):
        self.extend((int(v) >> (w - 1 - i)) & 1 for i in range(w))

    def bytes(self):
        return np.packbits(np.array(self, np.uint8)).tobytes()


def bitwise_crc(raw, poly, bits):
    crc = 0
    for byte in raw:
        crc ^= byte << (bits - 8)
        for _ in range(8):
            crc = (crc << 1 ^ poly if crc >> (bits - 1) & 1 else crc << 1) & ((1 << bits) - 1)
    return crc


def write_subframe(out, x, width, how, r):
    """One subframe as another coder may write it, sample by sample."""
    wasted = 0
    if how.endswith("+wasted"):
        while all(v % 2 == 0 for v in x) and any(x):
            x, wasted = [v >> 1 for v in x], wasted + 1
    how, width = how.removesuffix("+wasted"), width - wasted
    kind, coefs, shift = {"constant": (0, (), 0), "verbatim": (1, (), 0)}.get(how, (None, None, 0))
    if how.startswith("fixed"):
        coefs = flac.FIXED[int(how[5:])]
        kind = 8 + len(coefs)
    elif how.startswith("linear"):
        coefs, shift = [r.randint(-30, 30) for _ in range(int(how[6:]))], 4
        kind = 31 + len(coefs)
    out.put(0, 1)
    out.put(kind, 6)
    out.put(wasted > 0, 1)
    if wasted:
        out.put(1, wasted)
    if how == "constant":
        return out.put(x[0] & (1 << width) - 1, width)
    if how == "verbatim":
        return [out.put(v & (1 << width) - 1, width) for v in x]
    n = len(coefs)
    for v in x[:n]:
        out.put(v & (1 << width) - 1, width)
    if shift:
        out.put(6, 4)  # seven bits
        out.put(shift, 5)
        for c in coefs:
            out.put(c & 127, 7)
    wide, order = r.randint(0, 1), 2 if len(x) % 4 == 0 and len(x) // 4 > n else 0
    out.put(wide, 2)
    out.put(order, 4)
    part = len(x) >> order
    for p in range(1 << order):
        rest = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefs)) >> shift) for i in range(max(p * part, n), (p + 1) * part)]
        if r.random() < 0.3:  # escaped, raw bits each
            size = max([(v if v >= 0 else ~v).bit_length() + 1 for v in rest], default=0) if any(rest) else 0
            if size < 25:
                out.put((1 << 4 + wide) - 1, 4 + wide)
                out.put(size, 5)
                for v in rest:
                    out.put(v & (1 << size) - 1, size)
                continue
        k = min(14, max(0, int(np.mean([abs(v) for v in rest] or [0])).bit_length()))
        out.put(k, 4 + wide)
        for v in rest:
            u = 2 * v if v >= 0 else -2 * v - 1
            out.extend([0] * (u >> k) + [1])
            out.put(u & (1 << k) - 1, k)


def write_stream(samples, bits, block, r, variable=False, seek_every=3):
    """A stream of samples [n][channels], with frames of every kind, and a seek table."""
    channels, frames, points, number = len(samples[0]), b"", [], 0
    for a in range(0, len(samples), block):
        part = samples[a : a + block]
        columns = [[row[c] for row in part] for c in range(channels)]
        layout = r.choice([1, 8, 9, 10]) if channels == 2 else channels - 1
        if layout in (8, 9, 10):
            left, right = columns
            side = [p - q for p, q in zip(left, right)]
            columns = {8: [left, side], 9: [side, right], 10: [[p + q >> 1 for p, q in zip(left, right)], side]}[layout]
        if number % seek_every == 0:
            points.append((a, len(frames), len(part)))
        head = Bits()
        head.put(0xFFF9 if variable else 0xFFF8, 16)
        head.put(7, 4)
        head.put(r.choice([0, 12, 13]), 4)
        rate = sum(b << i for i, b in enumerate(head[-4:][::-1]))
        head.put(layout, 4)
        head.put(r.choice([0, {8: 1, 12: 2, 16: 4, 24: 6}[bits]]), 3)
        head.put(0, 1)
        raw = head.bytes() + chr(a if variable else number).encode("utf-8", "surrogatepass") + (len(part) - 1).to_bytes(2, "big") + bytes({0: 0, 12: 1, 13: 2}[rate])
        raw += bytes([bitwise_crc(raw, 0x07, 8)])
        body = Bits()
        for c, x in enumerate(columns):
            side = (layout in (8, 10) and c == 1) or (layout == 9 and c == 0)
            how = "constant" if len(set(x)) == 1 else r.choice([h for h in ("verbatim", "fixed0", "fixed1", "fixed2", "fixed3", "fixed4", "linear1", "linear7", "verbatim+wasted", "fixed2+wasted") if len(x) > 7 or h == "verbatim"])
            write_subframe(body, x, bits + side, how, r)
        raw += body.bytes()
        frames += raw + bitwise_crc(raw, 0x8005, 16).to_bytes(2, "big")
        number += 1
    flat = b"".join(int(v).to_bytes(-(-bits // 8), "little", signed=True) for row in samples for v in row)
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | channels - 1 << 41 | bits - 1 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(flat).digest()
    table = b"".join(p.to_bytes(8, "big") + at.to_bytes(8, "big") + n.to_bytes(2, "big") for p, at, n in points) + b"\xff" * 18
    blocks = b"\x00" + len(info).to_bytes(3, "big") + info + b"\x03" + len(table).to_bytes(3, "big") + table + b"\x84" + (3).to_bytes(3, "big") + b"abc"
    return b"fLaC" + blocks + frames


@pytest.mark.parametrize("bits, channels, block, n, variable", [(16, 2, 4096, 9000, False), (16, 2, 576, 3000, True), (8, 1, 192, 1000, False), (24, 1, 300, 1000, False), (12, 3, 160, 700, True), (16, 1, 4096, 5, False)])
def test_streams_of_another_coder(bits, channels, block, n, variable):
    r = random.Random(bits + n)
    most = (1 << bits - 1) - 1
    walk, samples = [0] * channels, []
    for i in range(n):
        walk = [max(-most, min(most, v + r.randint(-40, 40))) if i // 500 % 4 else 4 * r.randint(-most // 8, most // 8) if i // 500 % 2 == 0 and i > 1500 else v for v in walk]
        samples.append(list(walk))
    stream = write_stream(samples, bits, block, r, variable)
    assert (flac.decode_samples([stream])[0] == np.array(samples)).all()
    assert [len(x) for x in flac.decode_samples([stream, flac.encode([flac.payload("two at once")])[0], stream])] == [n, 192, n]
    for first, count in ((0, 1), (n // 2, 100), (n - 3, 50), (block - 1, 3), (n, 4), (max(0, n - block), block)):
        assert (flac.seek(stream, first, count) == np.array(samples)[first : first + count].reshape(-1, channels)).all()
    for at in ((len(stream) + flac.stream_info(stream).begin) // 2, len(stream) - 3):
        bad = bytearray(stream)
        bad[at] ^= 16
        with pytest.raises(ValueError):
            flac.decode_samples([bytes(bad)])


def test_seeking_reads_only_what_it_needs():
    said = flac.payload("some words " * 20_000)
    stream = bytearray(flac.encode([said])[0])
    stream[flac.stream_info(bytes(stream)).points[3][1] + flac.stream_info(bytes(stream)).begin + 20] ^= 1  # damage elsewhere
    at = len(said) - 1000
    assert (flac.seek(bytes(stream), at, 16)[:, 0] + 128).astype(np.uint8).tobytes() == said[at : at + 16]
    with pytest.raises(ValueError):
        flac.seek(bytes(stream), 3 * flac.SEEK_EVERY * flac.FRAME, 16)


def test_long_text():
    said = flac.payload("long " * 1_000_000)
    stream = flac.encode([said])[0]
    assert flac.decode([stream]) == [said]


def test_wide_frame_numbers():
    rows, n = flac.encode_frames(np.zeros((5, flac.BLOCK), np.int32), np.array([0, 127, 128, 70_000, 1 << 33]))
    assert (flac.decode_frames(rows, n, n - 4, flac.BLOCK, 0, 8) == 0).all()


def test_query_rows(spark):
    rows = flac.digests(odd(spark)).collect()
    assert len(rows) == len(odd_rows())
    want = sorted((str(i), len((t or "").encode()), hashlib.sha256(p := flac.payload(t or "")).hexdigest(), zlib.crc32(p[-16:])) for i, t, *_ in odd_rows())
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert flac.digests(empty(spark)).count() == 0
    blocks = flac.pcm_blocks(flac.media(odd(spark).where("doc_id = 6").limit(1)), 4).orderBy("sample_offset").collect()
    assert bytes(b ^ 128 for r in blocks for b in bytes(r.pcm)) == flac.payload(odd_rows()[6][1])
    assert [r.sample_offset for r in blocks] == list(range(0, len(flac.payload(odd_rows()[6][1])), 4 * flac.BLOCK))
