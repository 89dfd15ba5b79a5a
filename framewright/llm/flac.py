"""FLAC media columns: many frames encoded and decoded side by side.

Frames of all rows of a batch are lanes of NumPy arrays.  The encoder picks a
predictor (constant, fixed order 0 to 4, or a quantised linear predictor of
order 4) and one Rice parameter per partition by size; the decoder walks all
lanes one residual at a time: unary part, low bits, prediction.  Streams carry a
seek table with every frame, header checksums (CRC-8), frame checksums (CRC-16)
and the MD5 of the samples; the decoder verifies all of them and yields PCM
blocks with their sample offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
UNIT = 64
RATE = 8000
LPC_ORDER, LPC_BITS = 4, 12
#: Fixed predictors of order 0 to 4 as coefficients of the previous samples.
FIXED = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]], np.int64)
_SLICE = 2 << 20


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c >> (bits - 1) & 1 else c << 1) & ((1 << bits) - 1)
        out[b] = c
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc16(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of many spans, one byte of every span a step."""
    order = np.argsort(-length, kind="stable")
    s, n = start[order], length[order]
    crc = np.zeros(len(s), np.uint16)
    for i in range(int(n[0]) if len(n) else 0):
        k = np.searchsorted(-n, -i, "left")
        c = crc[:k]
        crc[:k] = (c << np.uint16(8)) ^ _CRC16[(c >> np.uint16(8)) ^ buf[s[:k] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _crc8(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(rows), np.uint16)
    for i in range(int(length.max(initial=0))):
        crc = np.where(i < length, _CRC8[crc ^ rows[:, i]], crc)
    return crc.astype(np.uint8)


class CorruptMedia(ValueError):
    """A stream whose structure or checksum is wrong."""


def _headers(n: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame headers (rows of 16 bytes) and their lengths, CRC-8 included."""
    h = np.zeros((len(n), 16), np.uint8)
    h[:, 0], h[:, 1], h[:, 3] = 0xFF, 0xF8, 0x02  # sync, fixed block size; mono, 8 bits
    h[:, 2] = np.where(n == BLOCK, 0xA0, 0x70)
    at = np.full(len(n), 4)
    lead = [(1 << 7, 0, 0), (1 << 11, 0xC0, 1), (1 << 16, 0xE0, 2), (1 << 21, 0xF0, 3), (1 << 26, 0xF8, 4), (1 << 31, 0xFC, 5)]
    low = 0
    for top, mark, more in lead:  # the number, coded as UTF-8 codes points
        m = (number >= low) & (number < top)
        low = top
        if m.any():
            h[m, 4] = mark | (number[m] >> (6 * more))
            for j in range(more):
                h[m, 5 + j] = 0x80 | ((number[m] >> (6 * (more - 1 - j))) & 0x3F)
            at[m] += 1 + more
    short = np.flatnonzero(n != BLOCK)
    h[short, at[short]], h[short, at[short] + 1] = (n[short] - 1) >> 8, (n[short] - 1) & 0xFF
    at[short] += 2
    h[np.arange(len(n)), at] = _crc8(h, at)
    return h, at + 1


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors (coefficients, shift) of equally long frames."""
    x = x.astype(np.float32)  # products of 8-bit samples summed over a block are exact in 32-bit floats
    lag = np.stack([np.einsum("ij,ij->i", x[:, : x.shape[1] - k], x[:, k:]) for k in range(LPC_ORDER + 1)], 1).astype(float)
    err = np.maximum(lag[:, 0], 1e-9)
    a = np.zeros((len(x), LPC_ORDER))
    for i in range(LPC_ORDER):  # Levinson-Durbin, all frames at once
        k = (lag[:, i + 1] - (a[:, :i] * lag[:, i:0:-1]).sum(1)) / err
        a[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    most = np.maximum(np.abs(a).max(1), 1e-9)
    shift = np.clip(LPC_BITS - 2 - np.ceil(np.log2(most)).astype(np.int64), 0, 15)
    top = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.floor(a * (1 << shift)[:, None] + 0.5), -top, top).astype(np.int64), shift


def _residual(x: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """What the predictor misses; the first ``coef.shape[1]`` columns mean nothing."""
    guess = np.zeros_like(x)
    for j in range(coef.shape[1]):
        guess[:, j + 1 :] += coef[:, j : j + 1] * x[:, : x.shape[1] - j - 1]
    return x - (guess >> shift[:, None])


def _fold(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _encode_equal(x: np.ndarray, header: np.ndarray, header_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of one length (rows of ``x``), checksums still 0: (all bytes one after another, size of each)."""
    f, n = x.shape
    parts_log = 3 if n == BLOCK else 0
    parts, width = 1 << parts_log, n >> parts_log
    lpc, lpc_shift = _lpc(x)
    x = x.astype(np.int32)
    left = [x]
    for _ in range(4):  # the fixed predictors miss the running differences
        left.append(np.diff(left[-1], axis=1, prepend=np.int32(0)))
    left.append(_residual(x, lpc.astype(np.int32), lpc_shift.astype(np.int32)))
    pick = np.stack([np.abs(r[:, 4:]).sum(1) for r in left], 1).argmin(1)
    coef, shift, order = lpc, lpc_shift, np.where(pick == 5, LPC_ORDER, pick)
    constant = (x == x[:, :1]).all(1)
    order = np.where(constant, 0, order)
    u = np.empty_like(x)
    for kind_no in np.unique(pick):
        u[pick == kind_no] = left[kind_no][pick == kind_no]
    u = _fold(u)
    coded = (np.arange(n) >= order[:, None]) & ~constant[:, None]
    u[~coded] = 0
    each = u.reshape(f, parts, width)
    amount = coded.reshape(f, parts, width).sum(2)
    mean = each.sum(2) / np.maximum(amount, 1)
    guess = np.clip(np.floor(np.log2(np.maximum(mean, 1))).astype(np.int64), 0, 14)
    size = np.stack([(each >> np.clip(guess + d, 0, 14)[:, :, None]).sum(2) + amount * (1 + np.clip(guess + d, 0, 14)) for d in (-1, 0, 1)], 2)
    rice = np.clip(guess + size.argmin(2) - 1, 0, 14)
    # fields of a frame: (value, bits), all lanes at once
    kind = np.where(constant, 0x00, np.where(pick == 5, 0x40 | ((LPC_ORDER - 1) << 1), 0x10 | (order << 1)))
    fields: list[tuple[np.ndarray, np.ndarray]] = [(header[:, i].astype(np.int64), np.where(i < header_len, 8, 0)) for i in range(16)]
    fields.append((kind, np.full(f, 8)))
    fields += [(x[:, i] & 0xFF, np.where((i < order) | (constant & (i == 0)), 8, 0)) for i in range(4)]
    linear = np.where((pick == 5) & ~constant, 1, 0)
    fields += [(np.full(f, LPC_BITS - 1), 4 * linear), (shift, 5 * linear)]
    fields += [(coef[:, j] & ((1 << LPC_BITS) - 1), LPC_BITS * linear) for j in range(LPC_ORDER)]
    fields.append((np.full(f, parts_log), np.where(constant, 0, 6)))  # method 0 in the upper two bits
    k = np.repeat(rice, width, 1).astype(np.int32)
    bits = np.where(coded, (u >> k) + 1 + k, 0)
    own = np.where(constant, 0, 4).astype(bits.dtype)
    bits[:, ::width] += own[:, None]  # each partition's parameter stands before its first residual
    head = np.sum([b for _, b in fields], 0)
    inner = np.cumsum(bits, 1)
    total = (head + inner[:, -1] + 7) // 8 + 2
    start = np.cumsum(total) - total
    # code words of up to 16 bits, each known by its last bit; their bits don't overlap, so sums join them
    at, ends, values = start * 8, [], []
    for value, b in fields:
        at = at + b
        m = b > 0
        ends.append(at[m] - 1)
        values.append(value[m])
    last = (start * 8 + head)[:, None] + inner - 1
    ends.append((last - bits)[:, ::width][~constant].ravel() + 4)
    values.append(rice[~constant].ravel())
    ends.append(last[coded])
    values.append(((1 << k) | (u & ((1 << k) - 1)))[coded])
    end, value = np.concatenate(ends), np.concatenate(values).astype(np.int64)
    value = value << (7 - (end & 7))
    byte = end >> 3
    size = int(total.sum())
    joined = np.bincount(byte, value & 0xFF, size)
    joined[:-1] += np.bincount(byte, (value >> 8) & 0xFF, size)[1:]
    joined[:-2] += np.bincount(byte, value >> 16, size)[2:]
    raw = joined.astype(np.uint8)
    return raw, total


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream (mono, 8 bits) of each payload; lengths are positive multiples of 64."""
    data = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8)
    lengths = np.array([len(p) for p in payloads], np.int64)
    frames = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(payloads)), frames)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(frames) - frames, frames)
    n = np.minimum(BLOCK, lengths[owner] - number * BLOCK)
    start = (np.cumsum(lengths) - lengths)[owner] + number * BLOCK
    header, header_len = _headers(n, number)
    raws, sizes, whose = [], [], []
    for size in np.unique(n):
        which = np.flatnonzero(n == size)
        for at in range(0, len(which), 512):
            w = which[at : at + 512]
            raw, total = _encode_equal(data[start[w][:, None] + np.arange(size)], header[w], header_len[w])
            raws.append(raw)
            sizes.append(total)
            whose.append(w)
    raw, total, which = map(np.concatenate, (raws, sizes, whose))
    stop = np.cumsum(total)
    crc = _crc16(raw, stop - total, total - 2)
    raw[stop - 2], raw[stop - 1] = crc >> 8, crc & 0xFF
    raw = raw.tobytes()
    pieces: list = [None] * len(owner)
    for i, a, b in zip(which.tolist(), (stop - total).tolist(), stop.tolist(), strict=True):
        pieces[i] = raw[a:b]
    out, at = [], 0
    for p, count in zip(payloads, frames.tolist(), strict=True):
        own = pieces[at : at + count]
        at += count
        sizes = list(map(len, own))
        block = min(BLOCK, len(p))
        info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big")
        info += hashlib.md5(p.translate(_FLIP)).digest()
        seek, offset = [], 0
        for i, s in enumerate(sizes):
            seek.append(struct.pack(">QQH", i * BLOCK, offset, min(BLOCK, len(p) - i * BLOCK)))
            offset += s
        table = b"".join(seek)
        out.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


_FLIP = bytes(i ^ 0x80 for i in range(256))


def _frames(media: list[bytes]) -> tuple[np.ndarray, ...]:
    """Frames of all streams by their seek tables: (owner, start in the joined bytes, end, sample, samples, stream MD5, totals)."""
    owner, start, end, sample, count, md5, totals = [], [], [], [], [], [], []
    base = 0
    for k, m in enumerate(media):
        if m[:4] != b"fLaC" or len(m) < 42 or m[4] & 0x7F:
            raise CorruptMedia("no stream information")
        at, points = 4, None
        while True:
            last, kind, size = m[at] >> 7, m[at] & 0x7F, int.from_bytes(m[at + 1 : at + 4], "big")
            if kind == 3:
                points = np.frombuffer(m[at + 4 : at + 4 + size], np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
            at += 4 + size
            if last:
                break
        if points is None:
            raise CorruptMedia("no seek table")
        if m[20] & 0x0E or (m[20] & 1) << 4 | m[21] >> 4 != 7:
            raise CorruptMedia("not mono with 8 bits")
        md5.append(m[26:42])
        totals.append((m[21] & 0x0F) << 32 | int.from_bytes(m[22:26], "big"))
        first = points["o"].astype(np.int64) + at + base
        owner.append(np.full(len(points), k))
        start.append(first)
        end.append(np.concatenate([first[1:], [base + len(m)]]))
        sample.append(points["s"].astype(np.int64))
        count.append(points["n"].astype(np.int64))
        base += len(m)
    return (*map(np.concatenate, (owner, start, end, sample, count)), md5, np.array(totals))


def decode(media: list[bytes]) -> tuple[list[bytes], list[dict]]:
    """The payload of each stream and what its frames look like; raises ``CorruptMedia``."""
    owner, start, end, sample, count, md5, totals = _frames(media)
    buf = np.frombuffer(b"".join(media) + bytes(16), np.uint8)
    if (np.add.reduceat(count, np.searchsorted(owner, np.arange(len(media)))) != totals).any():
        raise CorruptMedia("frames and stream disagree on the samples")
    if (_crc16(buf, start, end - start) != 0).any():  # a span with its own CRC behind gives 0
        raise CorruptMedia("a frame's checksum is wrong")
    head = buf[start[:, None] + np.arange(16)]
    lead = head[:, 4].astype(np.int64)
    digits = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [1, 2, 3, 4, 5], 6)
    number = np.select([digits == 1], [lead], lead & (0x7F >> digits))
    for j in range(1, 6):
        number = np.where(j < digits, number << 6 | head[:, 4 + min(j, 11)] & 0x3F, number)
    size = 4 + digits + np.where(head[:, 2] >> 4 == 7, 2, 0)
    lane = np.arange(len(start))
    said = np.where(head[:, 2] >> 4 == 7, (head[lane, 4 + digits].astype(np.int64) << 8 | head[lane, 5 + digits]) + 1, BLOCK)
    if (head[:, 0] != 0xFF).any() or (head[:, 1] != 0xF8).any() or (_crc8(head, size) != head[lane, size]).any():
        raise CorruptMedia("a frame's header is wrong")
    if (said != count).any() or (number * BLOCK != sample).any():
        raise CorruptMedia("a frame is not where the seek table says")
    samples, kinds, rice = _restore(buf, (start + size + 1) * 8, count)
    out, shape = [], []
    flat = np.zeros(int(totals.sum()), np.uint8)
    base = (np.cumsum(totals) - totals)[owner] + sample
    for n in np.unique(count):
        w = np.flatnonzero(count == n)
        flat[base[w][:, None] + np.arange(n)] = (samples[w, :n] & 0xFF) ^ 0x80
    raw = flat.tobytes()
    edges = [0, *np.cumsum(totals).tolist()]
    first = np.searchsorted(owner, np.arange(len(media) + 1))
    for k in range(len(media)):
        p = raw[edges[k] : edges[k + 1]]
        if hashlib.md5(p.translate(_FLIP)).digest() != md5[k]:
            raise CorruptMedia("the samples' digest is wrong")
        out.append(p)
        own = slice(first[k], first[k + 1])
        shape.append({"frames": int(first[k + 1] - first[k]), "kinds": np.bincount(kinds[own], minlength=6).tolist(), "rice": int(rice[own].sum())})
    return out, shape


def _restore(buf: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples of all frames whose subframes begin at bit ``at``."""
    word = buf[:-3].astype(np.uint64)
    for j in (1, 2, 3):
        word = word << np.uint64(8) | buf[j : len(buf) - 3 + j]

    low = np.uint64(0xFFFFFFFF)

    def window(p: np.ndarray) -> np.ndarray:  # 32 bits, the first 25 of which are right
        return (word[p >> 3] << (p & 7).astype(np.uint64)) & low

    def take(p: np.ndarray, bits) -> np.ndarray:
        return (window(p) >> (32 - np.asarray(bits)).astype(np.uint64)).astype(np.int64)

    order_of = np.argsort(-count, kind="stable")
    p, n = at[order_of].copy(), count[order_of]
    f, most = len(p), int(n.max(initial=0))
    head = take(p, 8)
    p += 8
    constant, verbatim = head == 0x00, head == 0x02
    fixed, linear = (head & 0xF0) == 0x10, (head & 0xC0) == 0x40
    if (~(constant | verbatim | fixed | linear)).any() or (head & 0x81).any():
        raise CorruptMedia("unknown subframe")
    order = np.where(fixed, head >> 1 & 7, np.where(linear, (head >> 1 & 31) + 1, 0))
    reach = int(order.max(initial=0))
    s = np.zeros((most + reach, f), np.int64)  # reach rows of nothing before the first sample
    for t in range(most):  # warm-up, constants and plain samples
        k = np.searchsorted(-n, -t, "left")
        m = np.flatnonzero((t < order[:k]) | verbatim[:k] | (constant[:k] & (t == 0)))
        if not len(m) and t >= reach:
            break
        v = take(p[m], 8)
        s[reach + t, m] = v - ((v & 0x80) << 1)
        p[m] += 8
    coef, shift = np.zeros((max(reach, 1), f), np.int64), np.zeros(f, np.int64)
    width = max(reach, 4)
    coef[: min(4, reach)] = np.where(fixed, np.pad(FIXED, ((0, 0), (0, width)))[np.where(fixed, order, 0)].T[: min(4, reach)], 0)
    w = np.flatnonzero(linear)
    if len(w):
        precision, shift[w] = take(p[w], 4) + 1, take(p[w] + 4, 5)
        p[w] += 9
        for j in range(reach):
            m = order[w] > j
            v = take(p[w[m]], precision[m])
            coef[j, w[m]] = v - ((v >> (precision[m] - 1) & 1) << precision[m])
            p[w[m]] += precision[m]
    coded = fixed | linear
    step = np.full(f, 1)
    wide = np.full(f, 4)
    if coded.any():
        method, parts = take(p, 2), take(p + 2, 4)
        wide = np.where(method == 1, 5, 4)
        step = np.where(coded, n >> parts, n)
        p = np.where(coded, p + 6, p)
    rice, rice_sum = np.zeros(f, np.int64), np.zeros(f, np.int64)
    every = np.flatnonzero(coded)
    alike = len(every) == f
    for t in range(most):
        k = int(np.searchsorted(-n, -t, "left"))
        if alike and t >= reach:
            m = slice(0, k)
        else:
            m = np.flatnonzero(coded[:k] & (t >= order[:k]))
            if not len(m):
                continue
        fresh = np.flatnonzero((t % step[m] == 0) | (t == order[m]))
        if len(fresh):
            g = fresh if isinstance(m, slice) else m[fresh]
            r = take(p[g], wide[g])
            if (r == np.where(wide[g] == 5, 31, 15)).any():
                raise CorruptMedia("escaped partitions are not supported")
            rice[g] = r
            rice_sum[g] += r
            p[g] += wide[g]
        q = p[m].copy()
        view = window(q)
        zeros = 32 - np.frexp(view.astype(float))[1]
        run = zeros
        if (zeros > 24).any():  # a long unary part: go on in steps of 24 zeros
            run = zeros.astype(np.int64)
            far = np.flatnonzero(zeros > 24)
            run[far] = 24
            while len(far):
                v = 32 - np.frexp(window(q[far] + run[far]).astype(float))[1]
                run[far] += np.minimum(v, 24)
                far = far[v > 24]
        q += run + 1
        k_now = rice[m]
        u = run.astype(np.int64) << k_now | (window(q) >> (32 - k_now).astype(np.uint64)).astype(np.int64)
        p[m] = q + k_now
        value = (u >> 1) ^ -(u & 1)
        if reach:
            guess = coef[0, m] * s[reach + t - 1, m]
            for j in range(1, reach):
                guess = guess + coef[j, m] * s[reach + t - 1 - j, m]
            value = value + (guess >> shift[m])
        s[reach + t, m] = value
    body = s[reach:].T
    body = np.where(constant[:, None], body[:, :1], body)
    back = np.empty(f, np.int64)
    back[order_of] = np.arange(f)
    kinds = np.where(constant, 0, np.where(verbatim, 1, np.where(linear, 3, 2)))
    return body[back], kinds[back], rice_sum[back]


def payload(text: bytes) -> bytes:
    """The text's bytes and zeros up to a positive multiple of 64."""
    return text + bytes((-len(text)) % UNIT or (0 if text else UNIT))


def flac_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Media table of every row's whole text: doc_id, n_bytes, media.

    Null and empty texts become one unit of zeros.  A text of any length is one
    stream of frames of 1,024 samples.  Equal texts give equal streams, repeated
    rows one stream each, an empty table none; other columns are ignored.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .shingles import as_bytes, in_slices

        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a, b in in_slices(texts, _SLICE):
                media = encode([payload(t) for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(map(len, texts[a:b]), pa.int64()), pa.array(media, pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """PCM blocks (signed 8-bit samples) with seekable offsets: doc_id, block, sample_offset, samples, pcm."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .shingles import in_slices

        for batch in batches:
            streams = batch.column(1).to_pylist()
            for a, b in in_slices(streams, _SLICE):
                ids = batch.column(0).slice(a, b - a).to_pylist()
                rows = [(i, at // BLOCK, at, p[at : at + BLOCK].translate(_FLIP)) for i, p in zip(ids, decode(streams[a:b])[0], strict=True) for at in range(0, len(p), BLOCK)]
                col = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(col[0], pa.int64()), pa.array(col[1], pa.int64()), pa.array(col[2], pa.int64()), pa.array(map(len, col[3]), pa.int32()), pa.array(col[3], pa.binary())],
                    ["doc_id", "block", "sample_offset", "samples", "pcm"],
                )

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, block long, sample_offset long, samples int, pcm binary")


def read_back(media: DataFrame) -> DataFrame:
    """Decode every stream and describe it: the columns of the op2 contract.

    ``feature`` holds frames by subframe kind (constant, plain, fixed, linear),
    the summed Rice parameters, the samples' mean and energy and the number of
    their sign changes, all as whole numbers.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def describe(p: bytes, shape: dict) -> str:
        x = (np.frombuffer(p, np.uint8) ^ 0x80).view(np.int8).astype(np.int64)
        turns = int(np.count_nonzero((x[1:] < -64) != (x[:-1] < -64)))
        kinds = shape["kinds"]
        return f"frames={shape['frames']};constant={kinds[0]};plain={kinds[1]};fixed={kinds[2]};linear={kinds[3]};rice={shape['rice']};sum={int(x.sum())};energy={int((x * x).sum())};turns={turns}"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .shingles import in_slices

        for batch in batches:
            ids, sizes, streams = (batch.column(i).to_pylist() for i in range(3))
            for a, b in in_slices(streams, _SLICE):
                got, shapes = decode(streams[a:b])
                cols = [
                    ids[a:b],
                    sizes[a:b],
                    [len(p) for p in got],
                    [hashlib.sha256(p).hexdigest() for p in got],
                    [zlib.crc32(p[-UNIT:]) for p in got],
                    [len(m) for m in streams[a:b]],
                    [hashlib.sha256(m).hexdigest() for m in streams[a:b]],
                    [describe(p, s) for p, s in zip(got, shapes, strict=True)],
                ]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
