"""FLAC streams of 8-bit mono samples, coded and decoded many frames at a time with numpy.

The format is RFC 9639's: STREAMINFO and SEEKTABLE blocks, frames with CRC-8 headers and CRC-16 footers, constant,
verbatim, fixed and linear-prediction subframes, residuals in Rice partitions. Frames of a batch take each step
together: sample i of all of them is decoded at once.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from typing import NamedTuple

import numpy as np

FRAME = 4096
RATE = 8000
PARTITION_ORDER = 2
#: The encoder's own linear predictor: order, bits and shift of its coefficients.
LPC_ORDER, PRECISION, SHIFT = 4, 12, 9
#: The format's predictors of order 0 to 4, nearest sample first.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
#: Block sizes by code 1 to 5 and 8 to 15; codes 6 and 7 hold it in the header.
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}


class BadStream(ValueError):
    """A stream that breaks the format or fails a checksum."""


def _crc_table(bits: int, poly: int) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        t = np.where(t >> (bits - 1) & 1, t << 1 ^ poly, t << 1) & ((1 << bits) - 1)
    return t.astype(np.uint32)


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)
_LOW = _CRC16[np.arange(65536) >> 8]  # the register after the first of two bytes, on top of the second
_PAIR = (_CRC16[(_LOW >> 8) ^ (np.arange(65536) & 255)] ^ (_LOW << 8 & 0xFFFF)).astype(np.uint32)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def crc16(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start:start + size] for many ranges at once, two bytes a step."""
    order = np.argsort(-size, kind="stable")
    begin, n, c = start[order], size[order], np.zeros(len(size), np.uint32)
    odd = (n & 1).astype(bool)
    c[odd] = _CRC16[data[begin[odd]]]
    begin, pairs = begin + odd, n >> 1
    two = data[:-1].astype(np.uint32) << 8 | data[1:]
    for i in range(int(pairs[0]) if len(pairs) else 0):
        k = int(np.searchsorted(-pairs, -i, "left"))
        c[:k] = _PAIR[c[:k] ^ two[begin[:k] + 2 * i]]
    out = np.empty_like(c)
    out[order] = c
    return out


def coded_number(n: int) -> bytes:
    """A frame number as frame headers hold it, in the manner of UTF-8."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >= 1 << (5 * more + 6):
        more += 1
    tail = [0x80 | n >> 6 * i & 0x3F for i in range(more)]
    return bytes([(0xFF00 >> (more + 1) & 0xFF) | n >> 6 * more, *reversed(tail)])


def _levinson(r: np.ndarray, order: int) -> np.ndarray:
    """Predictor coefficients (frames x order) from autocorrelations (frames x order + 1)."""
    a, error = np.zeros((len(r), order)), np.maximum(r[:, 0], 1e-9)
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    return a


def encode(payloads: list[bytes], frame: int = FRAME, lpc: bool = True) -> list[bytes]:
    """A FLAC stream for each payload of unsigned bytes; byte b is sample b - 128. Lengths are multiples of 64."""
    if not payloads:
        return []
    sizes = np.array([len(p) for p in payloads])
    if (sizes % 64).any() or not sizes.all():
        raise ValueError("lengths must be positive multiples of 64")
    x = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128).astype(np.int32)
    frames_of = -(-sizes // frame)
    stream = np.repeat(np.arange(len(sizes)), frames_of)
    number = np.arange(len(stream)) - np.repeat(np.cumsum(frames_of) - frames_of, frames_of)
    n = np.minimum(frame, sizes[stream] - number * frame)
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    at = np.arange(len(x)) - np.repeat(first, n)

    def total(v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, first, dtype=np.int64)

    def ago(j: int) -> np.ndarray:
        return np.concatenate((np.zeros(j, np.int32), x[:-j]))

    past = [ago(j) for j in range(1, 5)]
    residual = [x, x - past[0]]
    for coefficients in FIXED[2:]:
        residual.append(x - sum(c * p for c, p in zip(coefficients, past, strict=False)).astype(np.int32))
    late = at >= 4
    quantised = np.zeros((len(n), LPC_ORDER), np.int64)
    if lpc:
        r = np.stack([total(x * x)] + [total(np.where(at >= j, x * past[j - 1], 0)) for j in range(1, LPC_ORDER + 1)], 1).astype(float)
        top = (1 << (PRECISION - 1)) - 1
        quantised = np.clip(np.rint(_levinson(r, LPC_ORDER) * (1 << SHIFT)), -top, top).astype(np.int64)
        guess = sum(np.repeat(quantised[:, j].astype(np.int32), n) * past[j] for j in range(LPC_ORDER)) >> SHIFT
        residual.append((x - guess).astype(np.int32))
    cost = np.stack([total(np.where(late, np.abs(v), 0)) for v in residual], 1)
    cost[:, 5:] += 16  # its coefficients
    kind = cost.argmin(1)
    order = np.where(kind == 5, LPC_ORDER, kind)
    of = np.repeat(kind, n)
    res = residual[0].copy()
    for k in range(1, len(residual)):
        mine = of == k
        res[mine] = residual[k][mine]
    warm = at < np.repeat(order, n)
    u = np.where(warm, 0, np.where(res < 0, -2 * res - 1, 2 * res)).astype(np.int32)

    parts = 1 << PARTITION_ORDER
    begins = (first[:, None] + (n >> PARTITION_ORDER)[:, None] * np.arange(parts)).ravel()
    sums, most = np.add.reduceat(u, begins, dtype=np.int64), np.maximum.reduceat(u, begins)
    length = np.repeat(n >> PARTITION_ORDER, parts)
    mean = sums / length
    rice = np.floor(np.log2(np.maximum(mean * 0.6931, 1))).astype(np.int64)
    rice = np.maximum(rice, np.ceil(np.log2(most + 1.0)).astype(np.int64) - 5).clip(0, 14)
    k_of = np.repeat(rice, length)
    width = np.where(warm, 8, (u >> k_of) + 1 + k_of)
    part_start = np.zeros(len(x), np.int64)
    part_start[begins] = 4  # the parameter stands before a partition; before its warm-up samples in a frame's first
    part_start[first] = 0

    lo, hi = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
    constant = lo == hi
    lpc_bits = np.where(kind == 5, 4 + 5 + LPC_ORDER * PRECISION, 0)
    rice_bits = total(width + part_start) + 8 + 6 + 4 + lpc_bits
    verbatim = ~constant & (rice_bits >= 8 + 8 * n)
    coded = ~constant & ~verbatim
    body = np.where(constant, 16, np.where(verbatim, 8 + 8 * n, rice_bits))
    heads = [b"\xff\xf8\x74\x02" + coded_number(int(i)) + struct.pack(">H", int(k) - 1) for i, k in zip(number, n, strict=True)]
    heads = [h + bytes([crc8(h)]) for h in heads]
    head = np.array([len(h) for h in heads])
    size = head + (body + 7) // 8 + 2
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    bits = np.zeros(int(size.sum()) * 8, np.uint8)
    p = (start + head) * 8

    def put(where: np.ndarray, value, w: int) -> None:
        value = np.broadcast_to(value, where.shape)
        for j in range(w):
            bits[where + (w - 1 - j)] = value >> j & 1

    code = np.where(constant, 0, np.where(verbatim, 1, np.where(kind == 5, 31 + LPC_ORDER, 8 + kind)))
    put(p, code << 1, 8)
    put(p[constant] + 8, lo[constant].astype(np.int64) & 255, 8)
    plain = np.repeat(verbatim, n)
    put(np.repeat(p + 8, n)[plain] + 8 * at[plain], x[plain] & 255, 8)
    put(np.repeat(p + 8, n)[warm & np.repeat(coded, n)] + 8 * at[warm & np.repeat(coded, n)], x[warm & np.repeat(coded, n)] & 255, 8)
    after = p + 8 + 8 * order
    tuned = np.flatnonzero(coded & (kind == 5))
    put(after[tuned], PRECISION - 1, 4)
    put(after[tuned] + 4, SHIFT, 5)
    for j in range(LPC_ORDER):
        put(after[tuned] + 9 + j * PRECISION, quantised[tuned, j] & ((1 << PRECISION) - 1), PRECISION)
    after = after + lpc_bits
    put(after[coded] + 2, PARTITION_ORDER, 4)
    put(after[coded] + 6, rice.reshape(-1, parts)[coded, 0], 4)
    # from here on: residuals, with parameters of later partitions between them
    step = np.where(warm, 0, width) + part_start
    end = np.cumsum(step)
    end += np.repeat(after + 10 - (end[first] - step[first]), n)
    use = np.repeat(coded, n)
    later = use & (part_start > 0)
    put((end - step)[later], k_of[later], 4)
    use &= ~warm
    if use.all():
        e, k, v = end, k_of, u
    else:
        e, k, v = end[use], k_of[use], u[use]
    for j in range(int(k.max(initial=0)) + 1):
        if j and (k < j).any():
            some = k >= j
            e, k, v = e[some], k[some], v[some]
        inside = k > j
        bits[e - 1 - j] = np.where(inside, v >> j & 1, 1)
    data = np.packbits(bits)
    for i, h in enumerate(heads):
        data[start[i] : start[i] + head[i]] = np.frombuffer(h, np.uint8)
    crc = crc16(data, start, size - 2)
    data[start + size - 2], data[start + size - 1] = crc >> 8, crc & 255
    raw, out, f = data.tobytes(), [], 0
    signed = x.astype(np.int8).tobytes()
    sample = 0
    for s, count in enumerate(frames_of.tolist()):
        mine = slice(f, f + count)
        whole, base = int(sizes[s]), int(start[f])
        info = struct.pack(">HH", min(frame, max(whole, 16)), min(frame, max(whole, 16))) + int(size[mine].min()).to_bytes(3, "big") + int(size[mine].max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | whole).to_bytes(8, "big") + hashlib.md5(signed[sample : sample + whole]).digest()
        seek = b"".join(struct.pack(">QQH", int(number[i]) * frame, int(start[i]) - base, int(n[i])) for i in range(f, f + count))
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + raw[base : int(start[f + count - 1] + size[f + count - 1])])
        f, sample = f + count, sample + whole
    return out


class Decoded(NamedTuple):
    samples: np.ndarray  # int8
    #: Of each frame: first sample, samples, first byte in the stream, bytes.
    frames: np.ndarray


def _layout(stream: bytes) -> tuple[int, bytes, list[tuple[int, int]]]:
    """Samples, MD5 and (first byte, bytes) of each frame, by the seek table or else by sync codes whose header
    and frame checksums hold."""
    if stream[:4] != b"fLaC":
        raise BadStream("no stream marker")
    p, last, info, points = 4, False, None, []
    while not last:
        if p + 4 > len(stream):
            raise BadStream("metadata cut off")
        last, kind, n = bool(stream[p] >> 7), stream[p] & 127, int.from_bytes(stream[p + 1 : p + 4], "big")
        block = stream[p + 4 : p + 4 + n]
        if kind == 0:
            info = block
        elif kind == 3:
            points = [struct.unpack(">QQH", block[i : i + 18]) for i in range(0, n, 18)]
        p += 4 + n
    if info is None:
        raise BadStream("no STREAMINFO")
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
        raise BadStream("only 8-bit mono streams are read")
    samples = packed & (1 << 36) - 1
    if points and points[0][:2] == (0, 0) and sum(x[2] for x in points) == samples:
        starts = [p + x[1] for x in points]
    else:
        starts, at, begin = [p], p, 0
        while (at := stream.find(b"\xff\xf8", at + 1)) >= 0:
            if _header(stream, at, False) and crc16(np.frombuffer(stream + b"\0", np.uint8), np.array([starts[begin]]), np.array([at - starts[begin] - 2]))[0] == int.from_bytes(stream[at - 2 : at], "big"):
                starts.append(at)
                begin += 1
    ends = [*starts[1:], len(stream)]
    return samples, info[18:34], [(a, b - a) for a, b in zip(starts, ends, strict=True)]


def _header(s: bytes, p: int, strict: bool = True) -> tuple[int, int] | None:
    """Bytes of the frame header at p and samples of the frame; None or BadStream if it isn't one."""
    try:
        if s[p] != 0xFF or s[p + 1] & 0xFE != 0xF8:
            raise BadStream("no sync code")
        size, rate = s[p + 2] >> 4, s[p + 2] & 15
        if s[p + 3] >> 4 or s[p + 3] >> 1 & 7 not in (0, 1):
            raise BadStream("only 8-bit mono frames are read")
        q = p + 5
        if s[p + 4] >= 0xC0:
            q += bin(s[p + 4])[2:].index("0") - 1
        if size in (6, 7):
            n = int.from_bytes(s[q : q + size - 5], "big") + 1
            q += size - 5
        else:
            n = BLOCK_SIZES[size]
        q += {12: 1, 13: 2, 14: 2}.get(rate, 0)
        if crc8(s[p:q]) != s[q]:
            raise BadStream("frame header checksum")
        return q + 1 - p, n
    except (BadStream, IndexError, KeyError) as why:
        if strict:
            raise BadStream(str(why)) from None
        return None


def decode(streams: list[bytes]) -> list[Decoded]:
    """Samples and frame table of each stream; BadStream if any checksum fails."""
    layouts = [_layout(s) for s in streams]
    base = np.cumsum([0, *(len(s) for s in streams)])
    data = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    owner = np.array([i for i, (_, _, fs) in enumerate(layouts) for _ in fs], np.int64)
    within = np.array([a for _, _, fs in layouts for a, _ in fs], np.int64)
    size = np.array([b for _, _, fs in layouts for _, b in fs], np.int64)
    if not len(owner):
        return [Decoded(np.zeros(0, np.int8), np.zeros((0, 4), np.int64)) for _ in streams]
    start = base[owner] + within
    if (crc16(data, start, size - 2) != (data[start + size - 2].astype(np.uint32) << 8 | data[start + size - 1])).any():
        raise BadStream("frame checksum")
    heads = np.array([_header(streams[o], int(w)) for o, w in zip(owner, within, strict=True)], np.int64)
    n = heads[:, 1]
    flat = _frames(data, (start + heads[:, 0]) * 8, n)
    ends, out = np.cumsum(n), []
    for i, (samples, md5, fs) in enumerate(layouts):
        lo, hi = np.searchsorted(owner, [i, i + 1])
        a, b = (int(ends[lo - 1]) if lo else 0), int(ends[hi - 1]) if hi > lo else 0
        mine = flat[a:b]
        if len(mine) != samples or hashlib.md5(mine.tobytes()).digest() != md5:
            raise BadStream("samples differ from the stream's checksum")
        offsets = np.concatenate(([0], np.cumsum(n[lo:hi])[:-1]))
        out.append(Decoded(mine, np.stack([offsets, n[lo:hi], within[lo:hi], size[lo:hi]], 1)))
    return out


def _frames(data: np.ndarray, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Samples of all frames in order; pos is the bit where each one's subframe begins."""
    window = np.zeros(len(data) - 8, np.uint64)
    for r in range(8):
        part = data[r : r + (len(data) - r) // 8 * 8].view(">u8")
        window[r::8] = part[: len(window[r::8])]

    def get(p: np.ndarray, w) -> np.ndarray:
        """Unsigned values of w bits (0 to 57) at bit p."""
        x = window[p >> 3] << (p & 7).astype(np.uint64)
        return (x >> np.uint64(1) >> (np.uint64(63) - np.asarray(w).astype(np.uint64))).astype(np.int64)

    def signed(p: np.ndarray, w) -> np.ndarray:
        v = get(p, w)
        return np.where(np.asarray(w) > 0, v - ((v >> np.maximum(np.asarray(w) - 1, 0) & 1) << w), 0)

    by_size = np.argsort(-n, kind="stable")
    pos, n_of = pos[by_size].copy(), n[by_size]
    out = np.zeros((int(n_of[0]), len(n)), np.int32)
    first = get(pos, 8)
    if (first & 0x81).any():
        raise BadStream("padding or wasted bits in a subframe header")
    kind, pos = first >> 1, pos + 8
    constant, verbatim, fixed, tuned = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | tuned).all():
        raise BadStream("reserved subframe type")
    if constant.any():
        out[:, constant] = signed(pos[constant], 8)
    for i in np.flatnonzero(verbatim):
        out[: n_of[i], i] = signed(pos[i] + 8 * np.arange(n_of[i]), 8)
    some = np.flatnonzero(fixed | tuned)
    if len(some):
        values = _predicted(get, signed, pos[some], n_of[some], kind[some], window)
        out[: len(values), some] = values
    place = np.empty(len(n), np.int64)
    place[by_size] = np.arange(len(n))
    frame = np.repeat(place, n)
    return out[np.arange(len(frame)) - np.repeat(np.cumsum(n) - n, n), frame].astype(np.int8)


def _predicted(get, signed, pos, n, kind, window) -> np.ndarray:
    """Fixed and linear-prediction frames, longest first: samples (time x frames)."""
    order = np.where(kind >= 32, kind - 31, kind - 8)
    high = int(order.max())
    out = np.zeros((int(n[0]), len(n)), np.int32)
    for i in range(high):
        k = np.flatnonzero(order > i)
        out[i, k] = signed(pos[k], 8)
        pos[k] += 8
    weights, shift = np.zeros((high, len(n)), np.int64), np.zeros(len(n), np.int64)
    for o, row in enumerate(FIXED[: high + 1]):
        for j, c in enumerate(row):
            weights[j, (kind == 8 + o)] = c
    t = np.flatnonzero(kind >= 32)
    if len(t):
        precision, shift[t] = get(pos[t], 4) + 1, signed(pos[t] + 4, 5)
        if (precision == 16).any() or (shift < 0).any():
            raise BadStream("coefficient precision or shift")
        pos[t] += 9
        for j in range(high):
            k = order[t] > j
            weights[j, t[k]] = signed(pos[t[k]], precision[k])
            pos[t[k]] += precision[k]
    method, parts = get(pos, 2), 1 << get(pos + 2, 4)
    if (method > 1).any():
        raise BadStream("residual coding method")
    pos += 6
    per = n // parts
    due = defaultdict(list)
    for f, (p, o) in enumerate(zip(per.tolist(), order.tolist(), strict=True)):
        for i in range(int(parts[f])):
            due[max(i * p, o)].append(f)
    rice, raw = np.zeros(len(n), np.int64), np.full(len(n), -1, np.int64)
    one, u63, u11 = np.uint64(1), np.uint64(63), np.uint64(11)
    escaped = False
    for i in range(int(n[0])):
        live = int(np.searchsorted(-n, -i, "left"))
        if i in due:
            d = np.array(due[i])
            wide = 4 + method[d]
            rice[d] = get(pos[d], wide)
            pos[d] += wide
            raw[d] = -1
            e = d[rice[d] == (1 << wide) - 1]
            if len(e):
                raw[e] = get(pos[e], 5)
                pos[e] += 5
            escaped = bool((raw >= 0).any())
        f = slice(0, live) if i >= high and not escaped else np.flatnonzero((order[:live] <= i) & (raw[:live] < 0))
        p, k = pos[f], rice[f]
        w = window[p >> 3] << (p & 7).astype(np.uint64)
        q = 53 - np.frexp((w >> u11).astype(np.float64))[1].astype(np.int64)
        if q.size and int((q + k).max()) > 44:  # a long run of zeros, or one that the window cuts off
            for g in np.flatnonzero(q + k > 44):
                at = int(p[g])
                while not (window[at >> 3] << np.uint64(at & 7)) >> u63:
                    at += 1
                q[g] = at - p[g]
            rest = get(p + q + 1, k)
        else:
            rest = (w << (q + 1).astype(np.uint64) >> one >> (u63 - k.astype(np.uint64))).astype(np.int64)
        pos[f] = p + q + 1 + k
        u = q << k | rest
        value = (u >> 1) ^ -(u & 1)
        if high:
            guess = weights[0][f] * out[i - 1][f]
            for j in range(1, min(high, i)):
                guess += weights[j][f] * out[i - 1 - j][f]
            value += guess >> shift[f] if i else 0
        out[i, f] = value
        if escaped:
            f = np.flatnonzero((order[:live] <= i) & (raw[:live] >= 0))
            value = signed(pos[f], raw[f])
            pos[f] += raw[f]
            if high and i:
                guess = sum(weights[j][f] * out[i - 1 - j][f] for j in range(min(high, i)))
                value = value + (guess >> shift[f])
            out[i, f] = value
    return out
