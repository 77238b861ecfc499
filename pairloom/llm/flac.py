"""FLAC media columns: streams coded and decoded many frames at a time.

Frames are lanes of an array. The decoder walks frames of one form in step: one pass per sample finds each lane's
Rice quotient, reads its low bits and applies its linear predictor (fixed predictors are linear ones too). It reads
any stream of one to eight channels and 4 to 24 bits: fixed and variable block sizes, a short last block, stereo
decorrelation, wasted bits, partitioned Rice codes of both widths, escapes. Frame headers are checked by CRC-8,
frames by CRC-16 and whole streams by their MD5; a mismatch is a ValueError. The coder writes mono streams of 8 bits
in frames of FRAME samples, the last one shorter (constant, verbatim, fixed and linear prediction), with a seek table, by which seek()
decodes a range of samples from the nearest point on; decoded PCM comes in blocks with sample offsets.

A text's payload is its UTF-8 bytes with blanks appended up to a positive multiple of BLOCK; sample = byte
- 128. Null and empty texts give one block of blanks. Equal texts, and so repeated rows and ties, give equal streams
and values. Long texts only make more lanes, which are worked off by at most SLICE, or SLICE_BYTES. An empty table
gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairloom.llm.frames import kept, map_arrow, texts

BLOCK, SLICE, SLICE_BYTES, RATE = 192, 4096, 1 << 20, 8000
#: Samples in a frame, and frames between seek points.
FRAME, SEEK_EVERY = 12 * BLOCK, 8
#: Linear predictors that the coder tries: the last sample, and the mean of the last eight.
PREDICTORS = (((1,), 0), ((1,) * 8, 3))
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}


def _crc_table(poly: int, bits: int) -> np.ndarray:
    at = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        at = np.where(at >> (bits - 1) & 1, at << 1 ^ poly, at << 1) & ((1 << bits) - 1)
    return at.astype(np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc_rows(rows: np.ndarray, n: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of the first n[i] bytes of each row, all rows in step."""
    crc, steps = np.zeros(len(rows), np.uint16), np.ascontiguousarray(rows.T)
    short = int(n.min()) if len(n) else 0
    for i in range(int(n.max()) if len(n) else 0):
        new = table[crc ^ steps[i]] if bits == 8 else crc << np.uint16(8) ^ table[crc >> np.uint16(8) ^ steps[i]]
        crc = new if i < short else np.where(i < n, new, crc)
    return crc


def _number_bytes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frame numbers in the UTF-8 manner, and how many bytes each takes."""
    coded = [n.to_bytes(1, "big") if n < 128 else chr(n).encode("utf-8", "surrogatepass") if n < 0x110000 else _wide(n) for n in numbers.tolist()]
    size = np.array([len(x) for x in coded], np.int64)
    out = np.zeros((len(coded), 7), np.uint8)
    for i, x in enumerate(coded):
        out[i, : len(x)] = np.frombuffer(x, np.uint8)
    return out, size


def _wide(n: int) -> bytes:
    tail = 1
    while n >= 1 << (6 * tail + max(0, 6 - tail)):
        tail += 1
    return bytes([(0xFF << (7 - tail) & 0xFF) | n >> 6 * tail, *(0x80 | n >> 6 * i & 63 for i in range(tail - 1, -1, -1))])


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of one size as rows of bytes, and their lengths."""
    lanes, block = samples.shape
    x = samples.astype(np.int32)
    best = np.full(lanes, 8 * block, np.int64)  # verbatim
    kind, rice = np.full(lanes, -1), np.zeros(lanes, np.int64)
    folded = []
    for n, (coefs, shift) in enumerate(PREDICTORS):
        order = len(coefs)
        guess = sum(c * x[:, order - 1 - j : block - 1 - j] for j, c in enumerate(coefs)) >> shift
        rest = x[:, order:] - guess
        u = np.where(rest < 0, -2 * rest - 1, 2 * rest)
        folded.append(u)
        start = np.clip(np.log2(np.maximum(u.mean(1), 1)).astype(np.int64) - 1, 0, 12)
        for k in (start, start + 1):
            cost = (u >> k[:, None]).sum(1) + (k + 1) * (block - order) + 8 * order + 6 + (9 + 5 * order if shift else 0)
            better = cost < best
            best, kind, rice = np.where(better, cost, best), np.where(better, n, kind), np.where(better, k, rice)
    kind = np.where((x == x[:, :1]).all(1), -2, kind)

    number, size = _number_bytes(numbers)
    code, lane = {192: 1, 576: 2, 1152: 3, 2304: 4}.get(block, 7), np.arange(lanes)
    head = np.zeros((lanes, 14), np.uint8)
    head[:, :4] = (0xFF, 0xF8, code << 4, 0x02)
    head[:, 4:11] = number
    if code == 7:
        head[lane, 4 + size], head[lane, 5 + size] = block - 1 >> 8, block - 1 & 255
    size = size + 2 * (code == 7)
    head[lane, 4 + size] = crc_rows(head, 4 + size, CRC8, 8).astype(np.uint8)
    body = np.zeros((lanes, 8 + int(np.where(kind == -2, 16, best).max(initial=16)) + 80), np.uint8)  # a byte for each bit
    bits = np.zeros(lanes, np.int64)

    def put(rows: np.ndarray, at: int, value: np.ndarray | int, width: int) -> int:
        for i in range(width):
            body[rows, at + i] = value >> (width - 1 - i) & 1
        return at + width

    for what in (-2, -1, *range(len(PREDICTORS))):
        rows = np.flatnonzero(kind == what)
        if not len(rows):
            continue
        if what == -2:
            bits[rows] = put(rows, put(rows, 0, 0, 8), x[rows, 0], 8)
        elif what == -1:
            at = put(rows, 0, 1 << 1, 8)
            raw = np.unpackbits((x[rows] & 255).astype(np.uint8), axis=1)
            body[rows[:, None], at + np.arange(8 * block)] = raw
            bits[rows] = at + 8 * block
        else:
            coefs, shift = PREDICTORS[what]
            order = len(coefs)
            at = put(rows, 0, ((0b100000 | order - 1) if shift else (0b001000 | order)) << 1, 8)
            for j in range(order):
                at = put(rows, at, x[rows, j], 8)
            if shift:
                at = put(rows, put(rows, at, 4, 4), shift, 5)  # five bits for each coefficient
                for c in coefs:
                    at = put(rows, at, c, 5)
            k = rice[rows]
            at = put(rows, put(rows, at, 0, 6), k, 4)
            u = folded[what][rows]
            stop = at + np.cumsum((u >> k[:, None]) + 1 + k[:, None], axis=1) - k[:, None] - 1
            body[rows[:, None], stop] = 1
            for j in range(int(k.max())):
                some = np.flatnonzero(k > j)
                body[rows[some][:, None], stop[some] + (k[some] - j)[:, None]] = u[some] >> j & 1
            bits[rows] = stop[:, -1] + 1 + k
    packed, lead = np.packbits(body, axis=1), 5 + size
    length = lead + (bits + 7) // 8
    out = np.zeros((lanes, int(length.max(initial=0)) + 2), np.uint8)
    for w in np.unique(lead):
        rows = np.flatnonzero(lead == w)
        out[rows, :w] = head[rows, :w]
        out[rows, w:] = packed[rows, : out.shape[1] - w] if packed.shape[1] >= out.shape[1] - w else np.pad(packed[rows], ((0, 0), (0, out.shape[1] - w - packed.shape[1])))
    crc = crc_rows(out, length, CRC16, 16)
    out[lane, length], out[lane, length + 1] = crc >> 8, crc & 255
    return out, length + 2


def payload(text: str) -> bytes:
    """The bytes to store: UTF-8, blanks up to a positive multiple of BLOCK."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % BLOCK if raw else BLOCK)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose length is a positive multiple of BLOCK."""
    jobs: dict[int, list[tuple[int, int]]] = {}
    frames: list[list[bytes]] = []
    for i, p in enumerate(payloads):
        frames.append([b""] * -(-len(p) // FRAME))
        for number in range(len(frames[i])):
            jobs.setdefault(min(FRAME, len(p) - number * FRAME), []).append((i, number))
    for size, all_of in jobs.items():
        step = max(1, SLICE_BYTES // size)
        for at in range(0, len(all_of), step):
            some = all_of[at : at + step]
            flat = np.frombuffer(b"".join(payloads[i][n * FRAME : n * FRAME + size] for i, n in some), np.uint8).reshape(-1, size)
            rows, length = encode_frames(flat.astype(np.int32) - 128, np.array([n for _, n in some], np.int64))
            for (i, n), row, m in zip(some, rows, length.tolist()):
                frames[i][n] = row[:m].tobytes()
    out = []
    for p, parts in zip(payloads, frames):
        sizes = [len(x) for x in parts]
        signed = (np.frombuffer(p, np.uint8) ^ 128).tobytes()
        info = FRAME.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed, usedforsecurity=False).digest()
        ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        seek = b"".join((n * FRAME).to_bytes(8, "big") + ends[n].to_bytes(8, "big") + min(FRAME, len(p) - n * FRAME).to_bytes(2, "big") for n in range(0, len(parts), SEEK_EVERY))
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(parts))
    return out


@dataclass
class Info:
    """What a stream's metadata says: where its frames begin, and its seek points (sample, offset)."""

    block: int
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    begin: int
    points: list[tuple[int, int]]


def stream_info(stream: bytes) -> Info:
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, last, points = 4, b"", False, []
    while not last:
        if at + 4 > len(stream):
            raise ValueError("a FLAC stream's metadata are cut off")
        last, kind, n = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + n]
        if kind == 0:
            info = body
        elif kind == 3:
            points = [(sample, int.from_bytes(body[i + 8 : i + 16], "big")) for i in range(0, n - n % 18, 18) if (sample := int.from_bytes(body[i : i + 8], "big")) < (1 << 64) - 1]
        at += 4 + n
    if len(info) < 34:
        raise ValueError("a FLAC stream has no stream information")
    packed = int.from_bytes(info[10:18], "big")
    found = Info(int.from_bytes(info[2:4], "big"), packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, info[18:34], at, points)
    if found.bits > 24:
        raise ValueError(f"samples of {found.bits} bits are not decoded")
    return found


@dataclass
class Frames:
    """Frames found in data: where each starts and stops, its header's length, its form, its stream and first sample."""

    at: np.ndarray
    stop: np.ndarray
    head: np.ndarray
    block: np.ndarray
    layout: np.ndarray
    bits: np.ndarray
    stream: np.ndarray
    sample: np.ndarray


def _find_frames(data: np.ndarray, begin: np.ndarray, end: np.ndarray, infos: list[Info], first: np.ndarray, last: np.ndarray) -> Frames:
    """The frames of each stream's bytes [begin, end) from sample `first`, until `last` is reached.

    Headers are sync code, fields, CRC-8; of those, the ones whose numbers follow each other are frames. data has 32 bytes of padding.
    """
    at = np.flatnonzero((data[:-32] == 0xFF) & (data[1:-31] & 0xFE == 0xF8))
    stream = np.searchsorted(begin, at, "right") - 1
    fine = (stream >= 0) & (at < end[stream])
    at, stream = at[fine], stream[fine]
    code, rate, layout, width, lead = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7, data[at + 4]
    fine = (code > 0) & (rate < 15) & (layout < 11) & (width != 3) & (data[at + 3] & 1 == 0)
    at, stream, code, rate, layout, width, lead = (v[fine] for v in (at, stream, code, rate, layout, width, lead))
    size = 1 + sum((lead >= m).astype(np.int64) for m in (0xC0, 0xE0, 0xF0, 0xF8, 0xFC, 0xFE))
    more, rates = np.where(code == 6, 1, np.where(code == 7, 2, 0)), np.where(rate == 12, 1, np.where(rate > 12, 2, 0))
    head = 4 + size + more + rates
    rows = data[at[:, None] + np.arange(16)]
    fine = crc_rows(rows, head, CRC8, 8) == rows[np.arange(len(at)), head]
    at, stream, code, layout, width, lead, size, more, head = (v[fine] for v in (at, stream, code, layout, width, lead, size, more, head))
    number = np.where(size == 1, lead.astype(np.int64), lead & (0x7F >> size))
    for j in range(1, 7):
        number = np.where(size > j, number << 6 | data[at + 4 + j] & 63, number)
    tail = data[at + 4 + size].astype(np.int64)
    code = code.astype(np.int64)
    block = np.select([code == 1, code < 6, code == 6, code == 7], [192, 576 << np.clip(code - 2, 0, 3), tail + 1, (tail << 8 | data[at + 5 + size]) + 1], 256 << np.clip(code - 8, 0, 7))
    own = lambda f: np.array([f(x) for x in infos], np.int64)[stream]
    bits = np.where(width == 0, own(lambda x: x.bits), np.array([0, 8, 12, 0, 16, 20, 24, 32])[width])
    sample = np.where(data[at + 1] & 1, number, number * own(lambda x: x.block))
    channels = np.where(layout < 8, layout + 1, 2)
    want, taken = first.copy(), []
    starts = np.append(True, stream[1:] != stream[:-1])
    follow = np.where(starts, first[stream] if len(stream) else 0, np.append(0, (sample + block)[:-1]))
    if (follow == sample).all() and (sample < last[stream]).all():
        taken, want = np.arange(len(at)), np.maximum(want, np.zeros(len(want), np.int64))
        np.maximum.at(want, stream, sample + block)
    else:  # chance syncs within frames, or frames beyond those asked for: take the numbers in order
        for i, (s, n, size_of) in enumerate(zip(stream.tolist(), sample.tolist(), block.tolist())):
            if n == want[s] and n < last[s]:
                taken.append(i)
                want[s] += size_of
        taken = np.array(taken, np.int64)
    if (want < last).any():
        raise ValueError("a frame is missing or its header is damaged")
    if (channels[taken] != own(lambda x: x.channels)[taken]).any() or (bits[taken] > 24).any():
        raise ValueError("a frame's form is not that of its stream")
    at, stream, block, sample = at[taken], stream[taken], block[taken], sample[taken]
    stop = np.append(at[1:], 0)
    final = np.append(stream[1:] != stream[:-1], True)[: len(at)]
    stop[final] = end[stream[final]]
    return Frames(at, stop, head[taken] + 1, block, layout[taken].astype(np.int64), bits[taken], stream, sample)


def decode_frames(rows: np.ndarray, length: np.ndarray, head: np.ndarray, block: int, layout: int, width: int) -> np.ndarray:
    """Samples [channels, lanes, block] of frames given as rows of bytes; CRC-16 is verified."""
    lanes, lane = len(rows), np.arange(len(rows))
    crc = rows[lane, length - 2].astype(np.uint16) << 8 | rows[lane, length - 1]
    if (crc_rows(rows, length - 2, CRC16, 16) != crc).any():
        raise ValueError("a frame's checksum does not match")
    padded = np.pad(rows, ((0, 0), (0, 8)))
    word = sum(padded[:, i : i + rows.shape[1] + 4].astype(np.uint32) << (24 - 8 * i) for i in range(4)).astype(np.uint32)
    bits = np.unpackbits(padded, axis=1)
    places = np.arange(bits.shape[1], dtype=np.int32)
    next_one = np.minimum.accumulate(np.where(bits, places, bits.shape[1] - 1)[:, ::-1], axis=1)[:, ::-1]
    reader = Reader(np.ascontiguousarray(next_one).ravel(), word.ravel(), lane * bits.shape[1], lane * word.shape[1])
    pos, out = 8 * head, []
    for c in range(layout + 1 if layout < 8 else 2):
        side = (layout in (8, 10) and c == 1) or (layout == 9 and c == 0)
        x, pos = _subframes(reader, pos, block, width + side)
        out.append(x)
    if layout == 8:
        out[1] = out[0] - out[1]
    elif layout == 9:
        out[0] = out[1] + out[0]
    elif layout == 10:
        twice = out[0] << 1 | out[1] & 1
        out = [twice + out[1] >> 1, twice - out[1] >> 1]
    return np.stack(out)


@dataclass
class Reader:
    """Bits of many rows: the place of the next one bit, and 32 bits from each byte on."""

    next_one: np.ndarray
    word: np.ndarray
    row_bit: np.ndarray
    row_word: np.ndarray

    def some(self, rows: np.ndarray) -> Reader:
        return Reader(self.next_one, self.word, self.row_bit[rows], self.row_word[rows])

    def read(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        w = np.asarray(width, np.int64)
        got = self.word[self.row_word + (at >> 3)].astype(np.int64) << (at & 7) & 0xFFFFFFFF
        return np.where(w > 0, got >> (32 - w), 0)

    def signed(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        v, w = self.read(at, width), np.asarray(width, np.int64)
        return np.where(w > 0, v - ((v >> np.maximum(w - 1, 0) & 1) << w), 0)

    def one(self, at: np.ndarray) -> np.ndarray:
        return self.next_one[self.row_bit + at].astype(np.int64)


def _subframes(reader: Reader, pos: np.ndarray, block: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples [lanes, block] of a subframe of each lane, and where the next begins."""
    lanes = len(pos)
    header = reader.read(pos, 8)
    kind, pos = header >> 1 & 63, pos + 8
    if ((header >> 7 == 1) | ((kind > 1) & (kind < 8)) | ((kind > 12) & (kind < 32))).any():
        raise ValueError("a subframe is of no known kind")
    wasted = np.zeros(lanes, np.int64)
    if (flag := header & 1 == 1).any():
        stop = reader.one(pos)
        wasted, pos = np.where(flag, stop - pos + 1, 0), np.where(flag, stop + 1, pos)
    size = width - wasted
    x, end = np.zeros((block, lanes), np.int64), pos.copy()
    if (some := np.flatnonzero(kind == 0)).size:
        x[:, some] = reader.some(some).signed(pos[some], size[some])
        end[some] = pos[some] + size[some]
    if (some := np.flatnonzero(kind == 1)).size:
        plain = reader.some(some)
        for i in range(block):
            x[i, some] = plain.signed(pos[some] + size[some] * i, size[some])
        end[some] = pos[some] + size[some] * block
    if (some := np.flatnonzero(kind >= 8)).size:
        x[:, some], end[some] = _predicted(reader.some(some), pos[some], block, kind[some], size[some])
    return (x << wasted).T, end


def _predicted(reader: Reader, pos: np.ndarray, block: int, kind: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples [block, lanes] of fixed and linear prediction, and where the subframes end."""
    lanes, linear = len(pos), kind >= 32
    order = np.where(linear, kind - 31, kind - 8)
    most, y = int(order.max()), np.zeros((block, lanes), np.int64)
    if most > block:
        raise ValueError("a predictor is longer than its block")
    for j in range(most):
        y[j] = np.where(j < order, reader.signed(pos, size), 0)
        pos = np.where(j < order, pos + size, pos)
    coefs, shift = np.zeros((max(most, 4), lanes), np.int64), np.zeros(lanes, np.int64)
    for o, fixed in FIXED.items():
        for j, c in enumerate(fixed):
            coefs[j, ~linear & (order == o)] = c
    if linear.any():
        wide = reader.read(pos, 4) + 1
        shift, pos = np.where(linear, reader.read(pos + 4, 5), 0), np.where(linear, pos + 9, pos)
        for j in range(most):
            mine = linear & (j < order)
            coefs[j] = np.where(mine, reader.signed(pos, wide), coefs[j])
            pos = np.where(mine, pos + wide, pos)
    wider, parts = 4 + reader.read(pos, 2), block >> reader.read(pos + 2, 4)
    if (wider > 5).any() or (parts < np.maximum(order, 1)).any():
        raise ValueError("a residual is coded in no known way")
    pos = pos + 6
    k, raw = np.zeros(lanes, np.int64), np.zeros(lanes, bool)
    uniform = (parts == block).all()
    for i in range(int(order.min()), block):
        live = i >= order
        starts = (i == order) | (live & (i % parts == 0)) if not uniform or i <= most else None
        if starts is not None and starts.any():
            got = reader.read(pos, wider)
            escape = starts & (got == (1 << wider) - 1)
            k, pos = np.where(starts, np.where(escape, reader.read(pos + wider, 5), got), k), np.where(starts, pos + wider + 5 * escape, pos)
            raw = np.where(starts, escape, raw)
        stop = reader.one(pos)
        u = stop - pos << k | reader.read(stop + 1, k)
        rest, after = u >> 1 ^ -(u & 1), stop + 1 + k
        if raw.any():
            rest, after = np.where(raw, reader.signed(pos, k), rest), np.where(raw, pos + k, after)
        guess = sum(coefs[j] * y[i - 1 - j] for j in range(min(most, i))) if most else 0
        value = rest + (guess >> shift)
        if i < most:
            y[i], pos = np.where(live, value, y[i]), np.where(live, after, pos)
        else:
            y[i], pos = value, after
    return y, pos


def _decoded(data: np.ndarray, begin: np.ndarray, end: np.ndarray, infos: list[Info], first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Samples [n, channels] of each stream from `first` on, until `last` is reached."""
    f = _find_frames(data, begin, end, infos, first, last)
    sizes = np.bincount(f.stream, f.block, minlength=len(infos)).astype(np.int64)
    out = [np.zeros((int(n), x.channels), np.int32) for n, x in zip(sizes, infos)]
    form = np.stack([f.block, f.layout, f.bits], 1)
    for block, layout, bits in np.unique(form, axis=0).tolist():
        lanes = np.flatnonzero((form == (block, layout, bits)).all(1))
        step = max(1, min(SLICE, SLICE_BYTES // max(1, int((f.stop - f.at)[lanes].max()))))
        for i in range(0, len(lanes), step):
            some = lanes[i : i + step]
            length = (f.stop - f.at)[some]
            if (length < f.head[some] + 3).any():
                raise ValueError("a frame is cut off")
            rows = data[np.minimum(f.at[some][:, None] + np.arange(int(length.max())), len(data) - 1)]
            got = decode_frames(rows, length, f.head[some], block, layout, bits)
            for n, s, a in zip(range(len(some)), f.stream[some].tolist(), (f.sample[some] - first[f.stream[some]]).tolist()):
                out[s][a : a + block] = got[:, n].T
    return out


def pcm(samples: np.ndarray, bits: int) -> bytes:
    """Samples [n, channels] as signed little-endian bytes, as a stream's MD5 is taken of them."""
    size = -(-bits // 8)
    return np.ascontiguousarray(samples, "<i4").view(np.uint8).reshape(-1, 4)[:, :size].tobytes()


def decode_samples(streams: list[bytes]) -> list[np.ndarray]:
    """Samples [n, channels] of each stream; headers, frames and whole streams are verified."""
    if not streams:
        return []
    infos, sizes = [stream_info(s) for s in streams], np.array([len(s) for s in streams], np.int64)
    data = np.frombuffer(b"".join(streams) + bytes(32), np.uint8)
    end = np.cumsum(sizes)
    got = _decoded(data, end - sizes + np.array([x.begin for x in infos], np.int64), end, infos, np.zeros(len(infos), np.int64), np.array([x.samples for x in infos], np.int64))
    for x, samples in zip(infos, got):
        if len(samples) != x.samples or (any(x.md5) and hashlib.md5(pcm(samples, x.bits), usedforsecurity=False).digest() != x.md5):
            raise ValueError("a stream's MD5 does not match")
    return got


def seek(stream: bytes, first: int, count: int) -> np.ndarray:
    """Samples [count, channels] from `first` on, decoded from the nearest seek point before them."""
    info = stream_info(stream)
    last = min(first + count, info.samples)
    if not 0 <= first < last:
        return np.zeros((0, info.channels), np.int32)
    sample, offset = max((p for p in info.points if p[0] <= first), default=(0, 0))
    stop = min((p[1] for p in info.points if p[0] >= last), default=len(stream) - info.begin)  # a point is where a frame begins
    part = np.frombuffer(stream[info.begin + offset : info.begin + stop] + bytes(32), np.uint8)
    got = _decoded(part, np.array([0]), np.array([len(part) - 32]), [info], np.array([sample]), np.array([last]))[0]
    return got[first - sample : last - sample]


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream that encode() or another coder has made of bytes."""
    out = []
    for samples, stream in zip(decode_samples(streams), streams):
        if samples.shape[1] != 1 or stream_info(stream).bits != 8:
            raise ValueError("payloads are mono streams of 8 bits")
        out.append((samples[:, 0] + 128).astype(np.uint8).tobytes())
    return out


def feature(pcm: bytes) -> str:
    """peak:energy:crossings:blocks of signed samples, all whole numbers."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    return f"{int(np.abs(x).max())}:{int((x * x).sum())}:{int(((x[1:] < 0) != (x[:-1] < 0)).sum())}:{len(x) // BLOCK}"


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, flac binary): every text as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = b.column("text").to_pylist()
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in said]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(encode([payload(t) for t in said]), pa.binary())], ["doc_id", "n_bytes", "flac"])

    return map_arrow(texts(docs), run, "doc_id long, n_bytes long, flac binary")


def pcm_blocks(streams: DataFrame, blocks: int = 64) -> DataFrame:
    """(doc_id, sample_offset, pcm): decoded PCM of (doc_id, flac), in runs of blocks x BLOCK samples that can be sought by offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, flac in zip(b.column("doc_id").to_pylist(), b.column("flac")):
                info = stream_info(flac.as_py())
                held, size = pcm(decode_samples([flac.as_py()])[0], info.bits), -(-info.bits // 8) * info.channels
                at = list(range(0, info.samples, blocks * BLOCK))
                columns = [i] * len(at), at, [held[a * size : (a + blocks * BLOCK) * size] for a in at]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "sample_offset", "pcm"])

    return map_arrow(streams.select("doc_id", "flac"), run, "doc_id long, sample_offset long, pcm binary")


def digests(docs: DataFrame) -> DataFrame:
    """Each document's payload as read back from its stored stream, with digests and a feature string."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda v: hashlib.sha256(v).hexdigest()
        for b in batches:
            flacs = b.column("flac").to_pylist()
            back = decode(flacs)
            columns = [[len(p) for p in back], [sha(p) for p in back], [zlib.crc32(p[-16:]) for p in back], [len(f) for f in flacs], [sha(f) for f in flacs], [feature(p) for p in back]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds[2:]))], names)

    return map_arrow(kept(media(docs), "media", zstd=9), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
