"""FLAC media columns: 8-bit mono streams, encoded and decoded many frames at a time in numpy.

A stream is "fLaC", STREAMINFO with the MD5 of its samples, a SEEKTABLE with a point for every
frame (first sample, byte offset, samples), and frames of BLOCK samples, the last one shorter. A
frame is constant, verbatim, or a linear predictor of order ORDER (coefficients by the
Levinson recursion on the frame's autocorrelation) with Rice-coded residuals in partitions. The
decoder also takes fixed predictors, any order to 32, wasted bits, escaped partitions, and streams
whose seek table is not one point per frame: it finds their frames by sync code, number and checksums.

Frames don't depend on one another, so the decoder walks all frames of a group at once: step i
reads the i-th residual of every frame, another loop runs the predictors. It checks each frame's
sync code, number, CRC-8 and CRC-16 and each stream's MD5, and raises where one is wrong.

:func:`transcode` writes the decoded samples as PCM blocks: a row per stream with an array of blocks, each
with its sample offset, so that :func:`samples` reads any range from the blocks that hold it. Streams and
blocks need disk side by side for a part of the rows at a time only (``portions``).

A byte b of a payload is the sample b - 128, as in 8-bit PCM files.

Defined cases: null and empty payloads are one block of 192 spaces (a stream has to have samples);
the stored stream is a function of the payload alone; very long payloads are encoded whole, in
groups of frames; a null id keeps its row; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.common import bounded_batches, materialise, release, slices

UNIT = 192
BLOCK = 4608
ORDER = 12
PRECISION = 8
#: Partitions of a frame are 2 ** this.
PARTITIONS = 1
RATE = 8000
#: Samples handled in one numpy step.
STEP = 1 << 22


class CorruptStream(ValueError):
    """A stream that breaks the format or one of its checksums."""


def pad(text: bytes) -> bytes:
    """``text`` with spaces up to a positive multiple of UNIT."""
    return text + b" " * (-len(text) % UNIT if text else UNIT)


# ---------------------------------------------------------------- checksums


def _crc_table(polynomial: int, width: int, feed: int) -> np.ndarray:
    """Register after ``feed`` zero bits, for each value of its top ``feed`` bits."""
    value = np.arange(1 << feed, dtype=np.uint32) << (width - feed)
    top, mask = 1 << (width - 1), (1 << width) - 1
    for _ in range(feed):
        value = np.where(value & top, (value << 1) ^ polynomial, value << 1) & mask
    return value


_CRC8 = _crc_table(0x07, 8, 8).astype(np.uint8)
_CRC16 = _crc_table(0x8005, 16, 16).astype(np.uint16)
_CRC16_BYTE = _crc_table(0x8005, 16, 8).astype(np.uint16)


def _crc8(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(starts), dtype=np.uint8)
    for i in range(int(lengths.max(initial=0))):
        on = lengths > i
        crc[on] = _CRC8[crc[on] ^ data[starts[on] + i]]
    return crc


def _crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Two bytes a step, the longest frames first so that those still running are a prefix."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    words = (data[:-1].astype(np.uint16) << 8) | data[1:]
    crc = np.zeros(len(at), dtype=np.uint16)
    running = np.searchsorted(-(left // 2), -np.arange(int(left.max(initial=0)) // 2), side="left")
    for i, n in enumerate(running.tolist()):
        crc[:n] = _CRC16[crc[:n] ^ words[at[:n] + 2 * i]]
    odd = left % 2 == 1
    crc[odd] = (crc[odd] << 8) ^ _CRC16_BYTE[(crc[odd] >> 8) ^ data[at[odd] + left[odd] - 1]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


# ---------------------------------------------------------------- encoding


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frames, ORDER) and their shifts."""
    y = x.astype(np.float64)
    size = y.shape[1]
    r = np.stack([np.einsum("ij,ij->i", y[:, : size - k], y[:, k:]) for k in range(ORDER + 1)], axis=1)
    r[:, 0] = r[:, 0] * (1 + 1e-9) + 1e-3
    a, error = np.zeros((len(x), ORDER)), r[:, 0].copy()
    for k in range(ORDER):
        turn = (r[:, k + 1] - np.einsum("ij,ij->i", a[:, :k], r[:, k:0:-1])) / error
        a[:, :k] -= turn[:, None] * a[:, :k][:, ::-1]
        a[:, k] = turn
        error *= np.maximum(1e-9, 1 - turn**2)
    top = np.frexp(np.abs(a).max(axis=1))[1]
    shift = np.clip(PRECISION - 1 - top, 0, 15)
    limit = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * np.exp2(shift)[:, None]), -limit, limit - 1).astype(np.int32), shift.astype(np.int32)


def _bytes_of(values: np.ndarray, widths: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """``values`` of ``widths`` (at most 15) significant bits, each ending before bit ``ends``, in ``size`` bytes."""
    starts = ends - widths
    first = starts >> 3
    shift = 24 - widths - (starts & 7)
    wide = values << shift
    out = np.bincount(first, weights=wide >> 16, minlength=size + 3)
    second = (wide >> 8) & 255
    out[1:] += np.bincount(first, weights=second, minlength=size + 3)[: size + 2]
    third = np.flatnonzero(wide & 255)
    np.add.at(out, first[third] + 2, wide[third] & 255)
    return out[:size].astype(np.uint8)


def _bodies(x: np.ndarray) -> list[bytes]:
    """Subframes of equally long frames (frames, samples)."""
    n, size = x.shape
    coefficients, shift = _predictors(x)
    guess = np.zeros((n, size - ORDER), dtype=np.int32)
    for k in range(ORDER):
        guess += coefficients[:, k : k + 1] * x[:, ORDER - 1 - k : size - 1 - k]
    guess >>= shift[:, None]
    residual = np.subtract(x[:, ORDER:], guess, out=guess)
    folded = (residual << 1) ^ (residual >> 31)
    part = size >> PARTITIONS
    heads = 1 + ORDER + 2 + ORDER + 1
    columns = heads + (1 << PARTITIONS) + size - ORDER
    value, width = np.empty((n, columns), dtype=np.int32), np.empty((n, columns), dtype=np.int32)
    at = 0

    def fields(values, bits) -> None:
        nonlocal at
        values = np.asarray(values, dtype=np.int32)
        count = values.shape[1] if values.ndim == 2 else 1
        value[:, at : at + count] = values if values.ndim != 1 else values[:, None]
        width[:, at : at + count] = bits
        at += count

    fields((0x20 | (ORDER - 1)) << 1, 8)
    fields(x[:, :ORDER] & 255, 8)
    fields(PRECISION - 1, 4)
    fields(shift, 5)
    fields(coefficients & ((1 << PRECISION) - 1), PRECISION)
    fields(PARTITIONS, 6)
    for p in range(1 << PARTITIONS):
        u = folded[:, max(0, p * part - ORDER) : (p + 1) * part - ORDER]
        k = np.clip(np.floor(np.log2(0.6931 * u.mean(axis=1) + 0.35)) + 1, 0, 14).astype(np.int32)[:, None]
        fields(k, 4)
        fields((u & ((1 << k) - 1)) | (1 << k), (u >> k) + 1 + k)
    bits = width.sum(axis=1, dtype=np.int64)
    sizes = (bits + 7) >> 3
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.cumsum(width, axis=1, dtype=np.int64)
    ends += 8 * starts[:-1, None]
    # A Rice code's leading zeros need no writing: its stop bit and remainder are the last 15 bits at most.
    np.minimum(width, 15, out=width)
    data = _bytes_of(value.reshape(-1), width.reshape(-1), ends.reshape(-1), int(starts[-1])).tobytes()
    constant = (x == x[:, :1]).all(axis=1).tolist()
    raw = (x & 255).astype(np.uint8)
    out = []
    for i in range(n):
        if constant[i]:
            out.append(bytes([0, raw[i, 0]]))
        elif sizes[i] > size:
            out.append(b"\x02" + raw[i].tobytes())
        else:
            out.append(data[starts[i] : starts[i + 1]])
    return out


_SIZE_CODES = {192: 1, 576: 2, 1152: 3, 2304: 4, 4608: 5}


def _header(size: int, number: int) -> bytes:
    """Frame header without its CRC-8."""
    coded = bytes([number]) if number < 0x80 else b""
    tail = 0
    while not coded:
        tail += 1
        if number < 1 << (6 * tail + 6 - tail):
            lead = 0xFF << (7 - tail) & 0xFF
            coded = bytes([lead | number >> 6 * tail, *(0x80 | number >> 6 * k & 0x3F for k in range(tail - 1, -1, -1))])
    code = _SIZE_CODES.get(size, 7)
    return bytes([0xFF, 0xF8, code << 4, 0x02]) + coded + (struct.pack(">H", size - 1) if code == 7 else b"")


def _frames(sizes: list[int], samples: list[np.ndarray]) -> list[bytes]:
    """Whole frames; ``sizes`` holds each frame's number."""
    bodies: list[bytes] = [b""] * len(samples)
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(samples):
        by_size.setdefault(len(s), []).append(i)
    for rows in by_size.values():
        for i, body in zip(rows, _bodies(np.stack([samples[i] for i in rows])), strict=True):
            bodies[i] = body
    heads = [_header(len(s), k) for k, s in zip(sizes, samples, strict=True)]
    lengths = np.fromiter(map(len, heads), dtype=np.int64, count=len(heads))
    joined = np.frombuffer(b"".join(heads), dtype=np.uint8)
    checks = _crc8(joined, np.cumsum(lengths) - lengths, lengths).tolist()
    frames = [h + bytes([c]) + b for h, c, b in zip(heads, checks, bodies, strict=True)]
    lengths = np.fromiter(map(len, frames), dtype=np.int64, count=len(frames))
    joined = np.frombuffer(b"".join(frames), dtype=np.uint8)
    sums = _crc16(joined, np.cumsum(lengths) - lengths, lengths).tolist()
    return [f + struct.pack(">H", c) for f, c in zip(frames, sums, strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload; all payloads are positive multiples of UNIT long."""
    numbers, samples, frames = [], [], []
    waiting = 0
    for payload in payloads:
        signed = np.frombuffer(payload, dtype=np.uint8).astype(np.int32) - 128
        for number, at in enumerate(range(0, len(signed), BLOCK)):
            numbers.append(number)
            samples.append(signed[at : at + BLOCK])
            waiting += len(samples[-1])
            if waiting >= STEP:
                frames += _frames(numbers, samples)
                numbers, samples, waiting = [], [], 0
    if samples:
        frames += _frames(numbers, samples)
    out, at = [], 0
    for payload in payloads:
        own = frames[at : at + -(-len(payload) // BLOCK)]
        at += len(own)
        lengths = [len(f) for f in own]
        md5 = hashlib.md5((np.frombuffer(payload, dtype=np.uint8) ^ 0x80).tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + md5
        points, offset = [], 0
        for k, length in enumerate(lengths):
            points.append(struct.pack(">QQH", k * BLOCK, offset, min(BLOCK, len(payload) - k * BLOCK)))
            offset += length
        out.append(b"".join([b"fLaC\x00\x00\x00\x22", info, b"\x83", (18 * len(points)).to_bytes(3, "big"), *points, *own]))
    return out


# ---------------------------------------------------------------- decoding


class Stream:
    """Metadata of a stream: total samples, MD5 and the seek points of its frames."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"fLaC":
            raise CorruptStream("no stream marker")
        at, last, self.points = 4, False, None
        while not last:
            kind, size = data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            last, body = bool(data[at] & 0x80), data[at + 4 : at + 4 + size]
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.block, self.total, self.md5 = int.from_bytes(body[2:4], "big"), packed & (1 << 36) - 1, body[18:34]
                if (packed >> 41 & 7, packed >> 36 & 31) != (0, 7):
                    raise CorruptStream("not 8-bit mono")
            elif kind == 3:
                self.points = np.frombuffer(body, dtype=np.dtype([("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]))
            at += 4 + size
        self.data, self.audio = data, at
        given = self.points
        if given is None or not len(given) or int(given["size"].sum()) != self.total or (np.diff(given["sample"].astype(np.int64), append=self.total) != given["size"]).any():
            self.points = self._found()
        self.offsets = at + self.points["offset"].astype(np.int64)
        self.ends = np.append(self.offsets[1:], len(data))

    def _found(self) -> np.ndarray:
        """Points of the frames that a walk over sync codes finds: the header's CRC-8 and number have to be right,
        and the CRC-16 of all before it."""
        data = np.frombuffer(self.data, dtype=np.uint8)
        places = self.audio + np.flatnonzero((data[self.audio : -1] == 0xFF) & (data[self.audio + 1 :] == 0xF8))
        frames: list[tuple[int, int, int]] = []
        sample = 0
        for p in places.tolist():
            if p + 16 > len(data) or frames and not self._whole(data, self.audio + frames[-1][1], p) or not frames and p != self.audio:
                continue
            number, size, after = _headers(data, np.array([p]))
            if int(number[0]) == len(frames) and int(after[0]) < len(data) and _crc8(data, np.array([p]), after - p)[0] == data[after[0]]:
                frames.append((sample, p - self.audio, int(size[0])))
                sample += int(size[0])
        if sample != self.total:
            raise CorruptStream("frames are missing")
        return np.array(frames, dtype=np.dtype([("sample", ">u8"), ("offset", ">u8"), ("size", ">u4")]))

    @staticmethod
    def _whole(data: np.ndarray, start: int, end: int) -> bool:
        sums = _crc16(data, np.array([start]), np.array([end - start - 2])) if end - start > 8 else [-1]
        return int(sums[0]) == int(data[end - 2]) << 8 | int(data[end - 1])

    def frame_of(self, sample: int) -> int:
        return int(np.searchsorted(self.points["sample"].astype(np.int64), sample, side="right")) - 1


_CLZ16 = (16 - np.ceil(np.log2(np.arange(1 << 16) + 1.0))).astype(np.int64)
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]  # fixed values of the format


class _Bits:
    """Big-endian bit fields at any positions of a byte array."""

    def __init__(self, data: np.ndarray) -> None:
        padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
        self.words = np.zeros(len(data) + 8, dtype=np.uint64)
        for k in range(8):
            self.words |= padded[k : k + len(self.words)].astype(np.uint64) << np.uint64(56 - 8 * k)

    def window(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from bit ``at`` on, left-aligned."""
        return self.words[at >> 3] << (at & 7).view(np.uint64)

    def take(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        width = np.asarray(width)
        return np.where(width > 0, self.window(at) >> (64 - np.maximum(width, 1)).astype(np.uint64), np.uint64(0)).astype(np.int64)


def _signed(value: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    """Two's complement numbers of ``width`` bits; of none, 0."""
    half = (1 << np.asarray(width, dtype=np.int64)) >> 1
    return (value ^ half) - half


def _headers(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number and size of the frames that begin at ``starts``, and the place of each header's CRC-8."""
    lead = data[starts + 4].astype(np.int64)
    extra = np.where(lead < 0x80, 0, np.maximum(1, 8 - np.ceil(np.log2(256 - lead + 0.0)).astype(np.int64) - 1))
    number = np.where(extra == 0, lead, lead & ((1 << np.maximum(0, 6 - extra)) - 1))
    for k in range(int(extra.max(initial=0))):
        on = extra > k
        number[on] = number[on] << 6 | (data[starts[on] + 5 + k] & 0x3F)
    code, rate = data[starts + 2] >> 4, data[starts + 2] & 15
    after = starts + 5 + extra
    size = np.select([code == 1, (code >= 2) & (code <= 5), code >= 8], [192, 576 << (np.maximum(code, 2).astype(np.int64) - 2 & 7), 256 << (np.maximum(code, 8).astype(np.int64) - 8)], 0)
    size = np.where(code == 6, data[after].astype(np.int64) + 1, size)
    size = np.where(code == 7, (data[after].astype(np.int64) << 8 | data[after + 1]) + 1, size)
    return number, size, after + (code == 6) + 2 * (code == 7) + (rate == 12) + 2 * ((rate == 13) | (rate == 14))


def _decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Samples (frames, longest), each row padded with zeros."""
    if int((ends - starts).min()) < 8 or (data[starts] != 0xFF).any() or (data[starts + 1] != 0xF8).any():
        raise CorruptStream("no sync code at a frame's place")
    if (_crc16(data, starts, ends - starts - 2) != (data[ends - 2].astype(np.uint16) << 8 | data[ends - 1])).any():
        raise CorruptStream("a frame's CRC-16 is wrong")
    number, size, after = _headers(data, starts)
    if (_crc8(data, starts, after - starts) != data[after]).any():
        raise CorruptStream("a frame header's CRC-8 is wrong")
    if (number != numbers).any() or (size != expected).any():
        raise CorruptStream("a frame is not the one that the seek table names")

    bits, kind, at = _Bits(data), data[after + 1] >> 1 & 63, 8 * (after + 2)
    wasted = np.zeros(len(size), dtype=np.int64)
    for i in np.flatnonzero(data[after + 1] & 1):
        wasted[i] = 1 + int(_CLZ16[int(bits.window(at[i : i + 1])[0]) >> 48])
        if wasted[i] > 7:
            raise CorruptStream("more wasted bits than a sample has")
    at, width = at + wasted, 8 - wasted
    longest = int(size.max())
    out = np.zeros((longest, len(size)), dtype=np.int64)
    for i in np.flatnonzero(kind <= 1):
        n = int(size[i])
        if kind[i]:
            raw = data[after[i] + 2 : after[i] + 2 + n].view(np.int8) if not wasted[i] else _signed(bits.take(at[i] + width[i] * np.arange(n), width[i]), width[i])
        else:
            raw = _signed(bits.take(at[i : i + 1], width[i]), width[i])
        out[:n, i] = raw.astype(np.int64) << wasted[i]
    coded = np.flatnonzero(kind > 1)
    if not len(coded):
        return out.T
    coded = coded[np.argsort(-size[coded], kind="stable")]
    kind, size, at, wasted, width = kind[coded].astype(np.int64), size[coded], at[coded], wasted[coded], width[coded]
    if ((kind < 8) | ((kind > 12) & (kind < 32))).any():
        raise CorruptStream("a reserved subframe type")
    linear = kind >= 32
    order = np.where(linear, (kind & 31) + 1, kind - 8)
    most = int(order.max())
    x = np.zeros((longest, len(coded)), dtype=np.int64)
    for i in range(most):
        on = order > i
        x[i, on] = _signed(bits.take(at[on], width[on]), width[on])
        at[on] += width[on]
    weights, shift = np.zeros((most, len(coded)), dtype=np.int64), np.zeros(len(coded), dtype=np.int64)
    for f in np.unique(kind[~linear]):
        for k, c in enumerate(_FIXED[f - 8]):
            weights[k, kind == f] = c
    precision = np.where(linear, bits.take(at, 4) + 1, 0)
    shift[linear] = bits.take(at[linear] + 4, 5)
    at = at + 9 * linear
    for k in range(most):
        on = linear & (order > k)
        p = precision[on]
        weights[k, on] = _signed(bits.take(at[on], p), p)
        at[on] += p
    if (bits.take(at, 2) != 0).any():
        raise CorruptStream("a residual coding method that 8-bit streams don't use")
    part = size >> bits.take(at + 2, 4)
    at = at + 6
    k, escaped = np.zeros(len(coded), dtype=np.int64), np.zeros(len(coded), dtype=bool)
    any_escaped = False
    running = np.searchsorted(-size, -np.arange(longest), side="left").tolist()
    begins = {i for p, o in {*zip(part.tolist(), order.tolist(), strict=True)} for i in (o, *range(p, longest, p)) if i >= o}
    for i, n in enumerate(running):
        here, low = at[:n], k[:n]
        if i in begins:
            on = np.flatnonzero((i % part[:n] == 0) & (i >= order[:n]) | (i == order[:n]))
            low[on] = bits.take(here[on], 4)
            here[on] += 4
            escaped[on] = low[on] == 15
            plain = on[escaped[on]]
            low[plain] = bits.take(here[plain], 5)
            here[plain] += 5
            any_escaped = bool(escaped.any())
        window = bits.window(here)
        zeros = _CLZ16[(window >> np.uint64(48)).view(np.int64)]
        if int(zeros.max(initial=0)) < 16:
            # Stop bit and remainder are in the window: the bits after the stop bit, then one more shift for width 0.
            rest = ((window << (zeros + 1).view(np.uint64)) >> np.uint64(1) >> (63 - low).view(np.uint64)).view(np.int64)
        else:
            more = np.flatnonzero((zeros == 16) & ~escaped[:n])
            place = here[more] + 16
            while len(more):
                again = _CLZ16[(bits.window(place) >> np.uint64(48)).view(np.int64)]
                zeros[more] += again
                place = place[again == 16] + 16
                more = more[again == 16]
            rest = bits.take(here + zeros + 1, low)
        folded = zeros << low | rest
        value = folded >> 1 ^ -(folded & 1)
        used = zeros + low
        used += 1
        if any_escaped:
            plain = np.flatnonzero(escaped[:n])
            value[plain], used[plain] = _signed(bits.take(here[plain], low[plain]), low[plain]), low[plain]
        if i < most:
            on = order[:n] <= i
            x[i, :n] = np.where(on, value, x[i, :n])
            here += np.where(on, used, 0)
        else:
            x[i, :n] = value
            here += used
    for i, n in enumerate(running):
        if i < most:
            guess = np.zeros(n, dtype=np.int64)
            for j in range(i):
                guess += weights[j, :n] * x[i - 1 - j, :n]
            x[i, :n] += np.where(order[:n] <= i, guess >> shift[:n], 0)
        elif most:
            x[i, :n] += np.einsum("ij,ij->j", weights[:, :n], x[i - most : i, :n][::-1]) >> shift[:n]
    out[:, coded] = x << wasted
    return out.T


def decode_blocks(streams: list[Stream], wanted: list[range] | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(stream, first sample, payload bytes) for each frame (or those ``wanted`` of each stream), in order."""
    group: list[tuple[int, int]] = []
    waiting = 0
    for s, stream in enumerate(streams):
        for f in wanted[s] if wanted else range(len(stream.points)):
            group.append((s, f))
            waiting += int(stream.points["size"][f])
            if waiting >= STEP:
                yield from _group(streams, group)
                group, waiting = [], 0
    if group:
        yield from _group(streams, group)


def _group(streams: list[Stream], group: list[tuple[int, int]]) -> Iterator[tuple[int, int, bytes]]:
    spans = [(streams[s].offsets[f], streams[s].ends[f]) for s, f in group]
    data = np.frombuffer(b"".join(streams[s].data[a:b] for (s, _), (a, b) in zip(group, spans, strict=True)), dtype=np.uint8)
    lengths = np.array([b - a for a, b in spans], dtype=np.int64)
    ends = np.cumsum(lengths)
    sizes = np.array([streams[s].points["size"][f] for s, f in group], dtype=np.int64)
    samples = _decode_frames(data, ends - lengths, ends, np.array([f for _, f in group]), sizes)
    payload = (samples + 128).astype(np.uint8)
    for row, (s, f), n in zip(payload, group, sizes.tolist(), strict=True):
        yield s, int(streams[s].points["sample"][f]), row[:n].tobytes()


def checked_blocks(streams: list[Stream]) -> Iterator[tuple[int, int, bytes]]:
    """The blocks of whole streams, whose MD5 is checked at their end."""
    sums = [hashlib.md5() for _ in streams]
    for s, first, block in decode_blocks(streams):
        sums[s].update((np.frombuffer(block, dtype=np.uint8) ^ 0x80).tobytes())
        if first + len(block) == streams[s].total and sums[s].digest() != streams[s].md5:
            raise CorruptStream("the samples' MD5 is wrong")
        yield s, first, block


def decode(media: list[bytes]) -> list[bytes]:
    """The payload of each stream."""
    streams = [Stream(m) for m in media]
    parts: list[list[bytes]] = [[] for _ in streams]
    for s, _, block in checked_blocks(streams):
        parts[s].append(block)
    out = [b"".join(p) for p in parts]
    if any(len(payload) != stream.total for stream, payload in zip(streams, out, strict=True)):
        raise CorruptStream("samples are missing")
    return out


def read_samples(media: bytes, first: int, count: int) -> bytes:
    """Payload bytes ``first`` to ``first + count - 1``, decoding the frames that hold them only."""
    stream = Stream(media)
    last = min(stream.total, first + count)
    if last <= first:
        return b""
    low, high = stream.frame_of(first), stream.frame_of(last - 1)
    blocks = list(decode_blocks([stream], [range(low, high + 1)]))
    joined, base = b"".join(b for _, _, b in blocks), blocks[0][1]
    return joined[first - base : last - base]


# ---------------------------------------------------------------- columns


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a stream."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in slices(batches, 2048):
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            media = encode([pad(t) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


PCM = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, blocks array<struct<sample_offset:bigint,n_samples:int,pcm:binary>>"
_BLOCKS = pa.list_(pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary())]))


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, size and sum of the stream, and its frames as blocks (sample_offset, n_samples, unsigned 8-bit pcm)."""
    bounded_batches(media.sparkSession)

    def run(batches):
        for batch in slices(batches, 2048):
            stored = batch.column(2).to_pylist()
            blocks: list[list[dict]] = [[] for _ in stored]
            for s, first, pcm in checked_blocks([Stream(m) for m in stored]):
                blocks[s].append({"sample_offset": first, "n_samples": len(pcm), "pcm": pcm})
            columns = [batch.column(0), batch.column(1), pa.array([len(m) for m in stored], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in stored]), pa.array(blocks, _BLOCKS)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, PCM)


def transcode(docs: DataFrame, path: str, portions: int = 1) -> DataFrame:
    """Streams of all texts, written, read back and decoded into PCM blocks at ``path``; these, read back.

    Streams hardly compress, so they are written for one of ``portions`` at a time (each row is in one of
    them) and deleted once its blocks are there.
    """
    spark = docs.sparkSession
    for k in range(portions):
        part = docs.where(F.expr(f"pmod(xxhash64(doc_id, text), {portions}) = {k}")) if portions > 1 else docs
        media = materialise(to_media(part), "media")
        pcm_blocks(media).write.mode("append").option("compression", "zstd").parquet(path)
        release(media)
    return spark.read.schema(PCM).parquet(path)


def samples(pcm: DataFrame, first: int, count: int) -> DataFrame:
    """doc_id and the payload bytes ``first`` to ``first + count - 1`` of each row, from the blocks that hold them."""
    held = F.filter("blocks", lambda b: (b["sample_offset"] < first + count) & (b["sample_offset"] + b["n_samples"] > first))
    base = F.greatest(F.lit(0), F.lit(first) - F.coalesce(F.get(held, 0)["sample_offset"], F.lit(first)))
    joined = F.aggregate(held, F.lit(b""), lambda acc, b: F.concat(acc, b["pcm"]))
    return pcm.select("doc_id", F.substring(joined, (base + 1).cast("int"), F.lit(count)).alias("pcm"))


def feature(payload: bytes) -> str:
    """Level, mean square, crossings of the level and largest step of the samples, in integers."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    mean = int(x.sum()) // len(x)
    above = x > mean
    return f"mean={mean} power={int(((x - mean) ** 2).sum()) // len(x)} crossings={int((above[1:] != above[:-1]).sum())} step={int(np.abs(np.diff(x)).max(initial=0))}"


def digests(pcm: DataFrame) -> DataFrame:
    """Per stream, from its stored blocks: sizes, sums and features of the payload; what is known of the stream."""
    bounded_batches(pcm.sparkSession)

    def run(batches):
        for batch in slices(batches, 2048):
            payloads = []
            for blocks in batch.column(4).to_pylist():
                ends = 0
                for b in blocks:
                    if b["sample_offset"] != ends or len(b["pcm"]) != b["n_samples"]:
                        raise CorruptStream("a block is not where it says")
                    ends += b["n_samples"]
                payloads.append(b"".join(b["pcm"] for b in blocks))
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([len(p) for p in payloads], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                batch.column(2),
                batch.column(3),
                pa.array([feature(p) for p in payloads]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return pcm.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks").mapInArrow(run, schema)
