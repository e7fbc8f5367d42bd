"""A small FLAC codec for 8-bit mono streams, vectorised over frames with numpy.

Format: public (RFC 9639). Streams have STREAMINFO, a SEEKTABLE with a point for every frame, and
frames of BLOCK samples. Subframes are constant, verbatim, fixed or LPC, whichever is likely to be the
smallest; LPC coefficients are estimated for each frame from its autocorrelation (Levinson and Durbin).
Residuals are Rice coded, in one partition or PARTITIONS. Samples are bytes in the unsigned convention
of 8-bit PCM files (128 is silence).

The decoder reads what the encoder writes, and besides that any order, precision and number of
partitions, also with long Rice parameters. It needs the seek table, and refuses escaped partitions.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 576
#: Frames handled at once; bounds the memory for a stream of any length.
SLICE = 2048
RATE = 8000
# Fixed values of the format: sync and flags for BLOCK samples at RATE, mono, 8 bits.
HEAD = (0xFF, 0xF8, 0x24, 0x02)
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
CONSTANT, VERBATIM, FIXED_0, LPC_1 = 0, 1, 8, 32
#: The encoder's linear predictors: their order, the bits of a coefficient, and the window for estimating them.
LPC_ORDER, PRECISION = 4, 10
WINDOW = 1 - ((np.arange(BLOCK) - (BLOCK - 1) / 2) / ((BLOCK + 1) / 2)) ** 2
#: Partitions that the encoder splits residuals into, a power of two.
PARTITIONS = 4
LARGEST_K = 14
#: Points of a seek table, whose length has 24 bits.
MOST_BLOCKS = (1 << 24) // 18 - 1


def _crc_table(poly: int, bits: int) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << np.uint32(bits - 8)
    for _ in range(8):
        t = np.where(t >> np.uint32(bits - 1) & 1, t << np.uint32(1) ^ np.uint32(poly), t << np.uint32(1))
    return t & np.uint32((1 << bits) - 1)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(buf: np.ndarray, start: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """The checksums of the byte ranges; all ranges advance together."""
    table, mask, crc = (CRC8 if bits == 8 else CRC16), np.uint32((1 << bits) - 1), np.zeros(len(start), np.uint32)
    last, wide = len(buf) - 1, int(size.min()) if len(size) else 0
    for j in range(int(size.max()) if len(size) else 0):
        now = table[(crc >> np.uint32(bits - 8) & np.uint32(0xFF)) ^ buf[np.minimum(start + j, last)]]
        if bits == 16:
            now = (now ^ crc << np.uint32(8)) & mask
        crc = now if j < wide else np.where(j < size, now, crc)
    return crc


def _number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    lead = (0xFF00 >> size) & 0xFF
    return bytes([lead | n >> 6 * (size - 1)] + [0x80 | n >> 6 * i & 0x3F for i in range(size - 2, -1, -1)])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _residual(x: np.ndarray, coefficients, shift=0) -> np.ndarray:
    """What the predictor leaves of each sample; the first samples, which start it, come out as 0.

    Each coefficient, and the shift, is a number or a column with one for each frame.
    """
    order = len(coefficients)
    out = np.zeros_like(x)
    guess = sum((c * x[:, order - 1 - i : x.shape[1] - 1 - i] for i, c in enumerate(coefficients)), np.zeros_like(x[:, order:]))
    out[:, order:] = x[:, order:] - (guess >> shift)
    return out


def linear_models(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each frame (row) its LPC coefficients as whole numbers, (LPC_ORDER, frames), and their shifts."""
    w = x * WINDOW
    r = np.stack([(w[:, k:] * w[:, : BLOCK - k]).sum(1) for k in range(LPC_ORDER + 1)])
    error, a = np.maximum(r[0], 1.0), np.zeros((0, len(x)))
    for i in range(LPC_ORDER):
        k = (r[i + 1] - (a * r[i:0:-1]).sum(0)) / error
        a = np.concatenate([a - k * a[::-1], k[None]])
        error = np.maximum(error * (1 - k * k), 1e-6)
    limit = (1 << PRECISION - 1) - 1
    shift = np.clip(np.floor(np.log2(limit / np.maximum(np.abs(a).max(0), 1e-6))), 0, 14).astype(np.int32)
    whole = np.rint(a * np.exp2(shift))
    return np.clip(whole, -limit - 1, limit).astype(np.int32), shift


def _rice(sums: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rice parameters for sums of zigzag residuals over so many samples, and about how many bits these then take."""
    k = np.clip(np.floor(np.log2(np.maximum(sums / count * 0.7, 1))), 0, LARGEST_K).astype(np.int64)
    return k, sums / np.exp2(k) + count * (k + 1.0)


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The frames of rows of BLOCK bytes each, end to end, and their sizes."""
    x = samples.astype(np.int32) - 128
    n = len(x)
    models, shifts = linear_models(x)
    choices = [_zigzag(_residual(x, c)) for c in FIXED]
    choices.append(_zigzag(_residual(x, models[:, :, None], shifts[:, None])))
    orders = np.array([*range(len(FIXED)), LPC_ORDER])
    extras = np.array([0] * len(FIXED) + [4 + 5 + LPC_ORDER * PRECISION])
    sums = np.stack([c.sum(1) for c in choices]).astype(np.float64)
    likely = _rice(sums, (BLOCK - orders)[:, None])[1] + (8 * orders + extras)[:, None]
    pick = likely.argmin(0)
    u = np.stack(choices)[pick, np.arange(n)]
    order, extra, linear = orders[pick], extras[pick], pick == len(FIXED)
    wide = BLOCK // PARTITIONS
    counts = np.full((n, PARTITIONS), wide) - np.eye(1, PARTITIONS, dtype=np.int64) * order[:, None]
    parts, apart = _rice(u.reshape(n, PARTITIONS, wide).sum(2).astype(np.float64), counts)
    one, whole = _rice(sums[pick, np.arange(n)], BLOCK - order)
    split = apart.sum(1) + 4 * (PARTITIONS - 1) < whole
    k = np.repeat(np.where(split[:, None], parts, one[:, None]), wide, axis=1)
    live = np.arange(BLOCK)[None, :] >= order[:, None]
    size = np.where(live, (u >> k) + 1 + k, 0)
    # Each partition but the first has its parameter before its samples.
    named = np.where(split[:, None], 4 * (np.arange(BLOCK) // wide), 0)
    bits = 10 + extra + size.sum(1) + named[:, -1]
    kind = np.where(linear, LPC_1 + LPC_ORDER - 1, FIXED_0 + order)
    constant, verbatim = (x == x[:, :1]).all(1), order + (bits + 7) // 8 >= BLOCK
    kind = np.where(constant, CONSTANT, np.where(verbatim, VERBATIM, kind))
    coded = kind >= FIXED_0
    body = np.where(constant, 1, np.where(verbatim, BLOCK, order + (bits + 7) // 8))
    heads = [bytes(HEAD) + _number(int(i)) for i in numbers]
    head = np.array([len(h) for h in heads]) + 1  # with its checksum
    frame = head + 1 + body + 2
    ends = np.cumsum(frame)
    starts = ends - frame
    out = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    # Residuals and what describes them, as single bits.
    flags = np.zeros(len(out) * 8, np.uint8)
    rice = (starts + head + 1 + order) * 8

    def write(rows: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
        for b in range(width):
            flags[at[rows] + b] = values[rows] >> (width - 1 - b) & 1

    own = coded & linear
    write(own, rice, np.full(n, PRECISION - 1), 4)
    write(own, rice + 4, shifts, 5)
    for i, c in enumerate(models):
        write(own, rice + 9 + i * PRECISION, c, PRECISION)
    rice = rice + extra
    write(coded, rice + 2, np.where(split, PARTITIONS.bit_length() - 1, 0), 4)
    write(coded, rice + 6, k[:, 0], 4)
    before = np.cumsum(size, 1) - size + named
    for p in range(1, PARTITIONS):
        write(coded & split, rice + 6 + before[:, p * wide], k[:, p * wide], 4)
    put = live & coded[:, None]
    place = ((rice + 10)[:, None] + before)[put]
    value, low = u[put].astype(np.int64), k[put]
    place += value >> low
    flags[place] = 1
    for b in range(int(low.max()) if len(low) else 0):
        here = b < low
        flags[(place + 1 + b)[here]] = (value[here] >> (low[here] - 1 - b)) & 1
    out |= np.packbits(flags)
    for j in range(int(head.max()) - 1 if n else 0):
        has = np.flatnonzero(j < head - 1)
        out[starts[has] + j] = [heads[i][j] for i in has]
    out[starts + head - 1] = _crc(out, starts, head - 1, 8)
    out[starts + head] = kind << 1
    first = starts + head + 1
    out[first[constant]] = x[constant, 0] & 0xFF
    raw = np.flatnonzero(kind == VERBATIM)
    out[first[raw][:, None] + np.arange(BLOCK)] = x[raw] & 0xFF
    for j in range(int(orders.max())):
        has = coded & (j < order)
        out[first[has] + j] = x[has, j] & 0xFF
    crc = _crc(out, starts, frame - 2, 16)
    out[ends - 2], out[ends - 1] = crc >> 8, crc & 0xFF
    return out.tobytes(), frame


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload; their sizes must be positive multiples of BLOCK."""
    blocks = [len(p) // BLOCK for p in payloads]
    if any(len(p) % BLOCK or not p for p in payloads):
        raise ValueError(f"payloads must have a positive multiple of {BLOCK} bytes")
    if max(blocks, default=0) > MOST_BLOCKS:
        raise ValueError(f"a seek table has {MOST_BLOCKS} points at most")
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(b) for b in blocks]) if blocks else np.zeros(0, np.int64)
    parts = [encode_frames(rows[i : i + SLICE], numbers[i : i + SLICE]) for i in range(0, len(rows), SLICE)]
    data, sizes = b"".join(p[0] for p in parts), np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    out, at, row = [], 0, 0
    for payload, b in zip(payloads, blocks):
        own = sizes[row : row + b]
        total = int(own.sum())
        digest = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + digest
        points = np.zeros(b, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")]))
        points["sample"], points["offset"], points["samples"] = np.arange(b) * BLOCK, np.cumsum(own) - own, BLOCK
        table = points.tobytes()
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + data[at : at + total])
        at, row = at + total, row + b
    return out


def layout(media: bytes) -> tuple[int, np.ndarray, bytes]:
    """Of a stream: where its frames begin, its seek points (sample, offset behind that) and its MD5."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, md5, points = 4, False, b"", None
    while not last:
        last, kind, size = media[at] >> 7, media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        block = media[at + 4 : at + 4 + size]
        if kind == 0:
            md5 = block[18:34]
        elif kind == 3:
            points = np.frombuffer(block, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")]))
        at += 4 + size
    if points is None or not md5:
        raise ValueError("the stream has no seek table or no information block")
    return at, points, md5


def decode_frames(buf: np.ndarray, start: np.ndarray, size: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The samples, as bytes, of frames that lie at the given places; checks headers and both checksums."""
    n = len(start)
    out = np.zeros((n, BLOCK), np.int32)
    for j, byte in enumerate(HEAD):
        if (buf[start + j] != byte).any():
            raise ValueError("a frame header is damaged or of a kind that isn't read here")
    lead = buf[start + 4].astype(np.int64)
    more = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], range(6), 6)
    value = np.where(more == 0, lead, lead & (0x3F >> more))
    for j in range(int(more.max()) if n else 0):
        value = np.where(j < more, value << 6 | buf[start + np.minimum(5 + j, 4 + more)] & 0x3F, value)
    if (value != numbers).any():
        raise ValueError("a frame is not the one that the seek table names")
    crc_at = start + 5 + more
    if (_crc(buf, start, 5 + more, 8) != buf[crc_at]).any():
        raise ValueError("a frame header's checksum is wrong")
    end = start + size
    if (_crc(buf, start, size - 2, 16) != (buf[end - 2].astype(np.uint32) << 8 | buf[end - 1])).any():
        raise ValueError("a frame's checksum is wrong")
    kind, first = buf[crc_at + 1].astype(np.int64) >> 1, crc_at + 2
    wide = np.concatenate([buf, np.zeros(4, np.uint8)]).astype(np.int64)
    window = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    take = lambda bit, width: window[bit >> 3] >> (32 - (bit & 7) - width) & ((1 << width) - 1)
    signed = lambda v, width: v - ((v >> (width - 1) & 1) << width)
    rows = np.flatnonzero(kind == CONSTANT)
    out[rows] = buf[first[rows]].astype(np.int8)[:, None]
    rows = np.flatnonzero(kind == VERBATIM)
    out[rows] = buf[first[rows][:, None] + np.arange(BLOCK)].astype(np.int8)
    if ((kind > VERBATIM) & (kind < FIXED_0) | (kind > FIXED_0 + 4) & (kind < LPC_1)).any():
        raise ValueError("a subframe has a reserved type")
    rows = np.flatnonzero(kind >= FIXED_0)
    if len(rows):
        out[rows] = _coded(buf, kind[rows], first[rows], take, signed, window)
    return (out + 128).astype(np.uint8)


def _coded(buf: np.ndarray, kind: np.ndarray, first: np.ndarray, take, signed, window: np.ndarray) -> np.ndarray:
    """The samples of fixed and LPC subframes, whose bodies lie at the given places; all advance together."""
    n, linear = len(kind), kind >= LPC_1
    order = np.where(linear, kind - LPC_1 + 1, kind - FIXED_0)
    most = int(order.max())
    models, shift = np.zeros((most, n), np.int64), np.zeros(n, np.int64)
    bit = (first + order) * 8
    for o, c in enumerate(FIXED[: most + 1]):
        models[:o, ~linear & (order == o)] = np.array(c, np.int64)[:, None]
    if linear.any():
        width = take(bit, 4) + 1
        shift = np.where(linear, signed(take(bit + 4, 5), 5), 0)
        bit = np.where(linear, bit + 9, bit)
        for i in range(most):
            here = linear & (i < order)
            models[i] = np.where(here, signed(take(bit, width), width), models[i])
            bit = np.where(here, bit + width, bit)
    method, partitions = take(bit, 2), take(bit + 2, 4)
    if (method > 1).any() or (shift < 0).any():
        raise ValueError("a residual has a reserved kind")
    wide, name, bit = BLOCK >> partitions, 4 + method, bit + 6
    if (wide << partitions != BLOCK).any() or (wide < order).any():
        raise ValueError("a residual has partitions that don't fit")
    # For each bit the place of the next one that is set.
    flags = np.unpackbits(buf)
    places = np.where(flags, np.arange(len(flags), dtype=np.int32), np.int32(len(flags)))
    stop = np.minimum.accumulate(places[::-1])[::-1]
    edges = {i for w in np.unique(wide) for i in range(0, BLOCK, int(w))}
    r = np.empty((BLOCK, n), np.int64)
    k = low = mask = np.zeros(n, np.int64)
    for i in range(BLOCK):
        if i in edges:
            here = i % wide == 0
            k = np.where(here, take(bit, name), k)
            if (k >= (1 << name) - 1).any():
                raise ValueError("escaped partitions aren't read here")
            bit = np.where(here, bit + name, bit)
            low, mask = 32 - k, (1 << k) - 1
        one = stop[bit]
        at = one + 1
        u = (one - bit << k) | (window[at >> 3] >> (low - (at & 7)) & mask)
        now = (u >> 1) ^ -(u & 1)
        if i < most:  # samples that start a predictor stand before the residual
            start = i < order
            r[i] = np.where(start, buf[first + i].astype(np.int8), now)
            bit = np.where(start, bit, at + k)
        else:
            r[i] = now
            bit = at + k
    for i in range(1, BLOCK):
        guess = models[0] * r[i - 1] if most else 0
        for j in range(1, min(most, i)):
            guess = guess + models[j] * r[i - 1 - j]
        if i < most:
            guess = np.where(i < order, 0, guess)
        if most:
            r[i] += guess >> shift
    return r.T


def decode(streams: list[bytes], check_md5: bool = True) -> list[tuple[bytes, np.ndarray]]:
    """For each stream its samples as bytes and its seek points."""
    parts = [layout(m) for m in streams]
    begins = np.cumsum([0, *map(len, streams)])
    buf = np.frombuffer(b"".join(streams), np.uint8)
    start = np.concatenate([b + at + p["offset"].astype(np.int64) for b, (at, p, _) in zip(begins, parts)]) if parts else np.zeros(0, np.int64)
    last = np.concatenate([np.append(b + at + p["offset"].astype(np.int64)[1:], e) for b, e, (at, p, _) in zip(begins, begins[1:], parts)]) if parts else start
    numbers = np.concatenate([p["sample"].astype(np.int64) // BLOCK for _, p, _ in parts]) if parts else start
    rows = []
    for i in range(0, len(start), SLICE):
        a, b = start[i : i + SLICE], last[i : i + SLICE]
        rows.append(decode_frames(buf[a[0] : b[-1]], a - a[0], b - a, numbers[i : i + SLICE]))
    data, at, out = (np.concatenate(rows).tobytes() if rows else b""), 0, []
    for _, points, md5 in parts:
        size = len(points) * BLOCK
        samples = data[at : at + size]
        if check_md5 and hashlib.md5((np.frombuffer(samples, np.uint8) ^ 0x80).tobytes()).digest() != md5:
            raise ValueError("the stream's samples don't have its MD5")
        out.append((samples, points))
        at += size
    return out


def read_samples(media: bytes, start: int, count: int) -> bytes:
    """Samples from a place on, decoding only the frames that hold them."""
    at, points, _ = layout(media)
    a, b = start // BLOCK, min(-(-(start + count) // BLOCK), len(points))
    if a >= b:
        return b""
    offsets = np.append(points["offset"].astype(np.int64), len(media) - at)
    buf = np.frombuffer(media, np.uint8)[at + offsets[a] : at + offsets[b]]
    rows = decode_frames(buf, offsets[a:b] - offsets[a], np.diff(offsets[a : b + 1]), np.arange(a, b))
    return rows.tobytes()[start - a * BLOCK :][:count]
