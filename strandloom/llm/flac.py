"""FLAC for byte payloads: 8-bit mono frames of 192 samples, encoded, decoded and checked with numpy.

Frames are worked on side by side: step i reads the i-th Rice code of every frame at once. The decoder knows
constant, verbatim, fixed and LPC subframes with one Rice partition, verifies CRC-8 of headers and CRC-16 of
frames, and returns unsigned 8-bit PCM blocks with their sample offsets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_type, load

BLOCK, RATE, MOST_ORDER = 192, 8000, 2
#: Frames between seek points, and samples of a PCM block.
SEEK_EVERY = 64
PCM_BLOCK = BLOCK * SEEK_EVERY
_CHUNK = 8192  # frames worked on at once


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << bits) - 1)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(buf: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Of every stretch of buf at once."""
    order = np.argsort(-length, kind="stable")
    start, longest = start[order], length[order]
    crc = np.zeros(len(start), np.uint32)
    alive = np.searchsorted(-longest, -np.arange(int(longest[0]) if len(longest) else 0), side="left")
    for t, n in enumerate(alive):
        c = crc[:n]
        crc[:n] = table[(c >> (bits - 8) ^ buf[start[:n] + t]) & 0xFF] ^ (c << 8 & ((1 << bits) - 1))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 of FLAC."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | n >> 6 * i & 0x3F for i in range(size - 1)][::-1]
    return bytes([(0xFF << (8 - size) & 0xFF) | n >> 6 * (size - 1), *tail])


_HEADERS: list[bytes] = []


def _headers(most: int) -> list[bytes]:
    """Frame headers with CRC-8, by frame number."""
    while len(_HEADERS) < most:
        h = bytes([0xFF, 0xF8, 0x10, 0x02]) + _number(len(_HEADERS))
        c = 0
        for b in h:
            c = int(_CRC8[c ^ b])
        _HEADERS.append(h + bytes([c]))
    return _HEADERS


def _fold(x: np.ndarray) -> np.ndarray:
    return (x << 1) ^ (x >> 31)


def _plan(s: np.ndarray, lpc: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """Subframe type, Rice parameter, bits, folded residuals by type and LPC coefficients of each frame of samples."""
    n = len(s)
    kind = np.where((s == s[:, :1]).all(axis=1), 0, 1)
    bits = np.where(kind == 0, 16, 8 + 8 * BLOCK)
    rice, residual = np.zeros(n, np.int32), {}
    coef = np.zeros(n, np.int32)
    d = s
    options = []
    for order in range(MOST_ORDER + 1):
        options.append((8 + order, order, d, 0))
        d = d[:, 1:] - d[:, :-1]
    if lpc:  # one coefficient in sixteenths
        x, y = s[:, 1:].astype(np.float32), s[:, :-1].astype(np.float32)
        coef = np.clip(np.rint(16 * (x * y).sum(axis=1) / np.maximum((y * y).sum(axis=1), 1)), -16, 15).astype(np.int32)
        options.append((32, 1, s[:, 1:] - (coef[:, None] * s[:, :-1] >> 4), 14))
    for code, order, r, extra in options:
        u = _fold(r)
        k = np.maximum(0, np.floor(np.log2(np.maximum(u.mean(axis=1), 1))).astype(np.int32))
        k = np.maximum(k, np.ceil(np.log2((u.max(axis=1) + 1) / 40).clip(1)).astype(np.int32)).clip(0, 14)  # no unary part over 40
        cost = 8 + 8 * order + extra + 10 + (u >> k[:, None]).sum(axis=1) + (k + 1) * u.shape[1]
        better = (cost < bits) & (kind != 0)
        kind[better], rice[better], bits[better] = code, k[better], cost[better]
        residual[code] = u
    return kind, rice, bits, residual, coef


def _encode_frames(samples: np.ndarray, number: np.ndarray, lpc: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the frames one after another, and their lengths. samples: (frames, 192), signed."""
    s = samples.astype(np.int32)
    kind, rice, bits, residual, coef = _plan(s, lpc)
    heads = _headers(int(number.max()) + 1)
    head_len = np.array([len(heads[i]) for i in number])
    length = head_len + (bits + 7) // 8 + 2
    start = np.concatenate(([0], np.cumsum(length)[:-1]))
    total = int(length.sum())
    raw = np.zeros(total * 8, np.uint8)
    for code in np.unique(kind):
        at = np.flatnonzero(kind == code)
        k = rice[at][:, None]
        one = np.ones((len(at), 1), np.int32)
        warm = s[at][:, : 1 if code in (0, 32) else code - 8 if code >= 8 else BLOCK] & 0xFF
        values, widths = [one * (int(code) << 1), warm], [one * 8, np.full_like(warm, 8)]
        if code == 32:
            values += [one * 4, one * 4, coef[at][:, None] & 31]  # precision 5 less one, shift, coefficient
            widths += [one * 4, one * 5, one * 5]
        if code >= 8:
            u = residual[int(code)][at]
            values += [one * 0, k, (1 << k) | (u & ((1 << k) - 1))]
            widths += [one * 6, one * 4, (u >> k) + 1 + k]
        v, w = np.hstack(values), np.hstack(widths)
        end = (np.cumsum(w, axis=1) + ((start[at] + head_len[at]) * 8)[:, None]).ravel()
        v = v.ravel()
        for j in range(int(v.max()).bit_length()):
            raw[end[(v >> j & 1).astype(bool)] - 1 - j] = 1
    out = np.packbits(raw)
    head = b"".join(heads[i] for i in number)
    where = np.repeat(start - np.concatenate(([0], np.cumsum(head_len)[:-1])), head_len) + np.arange(len(head))
    out[where] = np.frombuffer(head, np.uint8)
    crc = _crc(out, start, length - 2, _CRC16, 16)
    out[start + length - 2], out[start + length - 1] = crc >> 8, crc & 0xFF
    return out, length


def encode(payloads: list[bytes], lpc: bool = False) -> list[bytes]:
    """A FLAC file of each payload; lengths are positive multiples of 192."""
    frames = np.array([len(p) // BLOCK for p in payloads])
    samples = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).reshape(-1, BLOCK)
    number = np.arange(len(samples)) - np.repeat(np.cumsum(frames) - frames, frames)
    parts = [_encode_frames(samples[i : i + _CHUNK], number[i : i + _CHUNK], lpc) for i in range(0, len(samples), _CHUNK)]
    body, length = b"".join(p[0].tobytes() for p in parts), np.concatenate([p[1] for p in parts])
    ends = np.concatenate(([0], np.cumsum(length)))
    signed = samples.astype(np.int8)
    out, f = [], 0
    for p, n in zip(payloads, frames, strict=True):
        own = length[f : f + n]
        info = BLOCK.to_bytes(2, "big") * 2 + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed[f : f + n].tobytes()).digest()
        points = b"".join((i * BLOCK).to_bytes(8, "big") + int(ends[f + i] - ends[f]).to_bytes(8, "big") + BLOCK.to_bytes(2, "big") for i in range(0, n, SEEK_EVERY))
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + body[ends[f] : ends[f + n]])
        f += n
    return out


def _decode_frames(buf: np.ndarray, start: np.ndarray, head_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of each frame, and the offset at which its CRC-16 stands. buf has 16 bytes to spare."""
    words = np.ndarray((len(buf) - 7,), ">u8", buf.tobytes(), 0, (1,))
    pos = (start + head_len) * 8

    def read(p: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        w = words[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)
        return (w >> np.uint64(1) >> (63 - np.asarray(width)).astype(np.uint64)).astype(np.int64)

    signed = lambda x, width: x - ((x >> (width - 1)) << width)
    kind = read(pos, 8) >> 1
    pos = pos + 8
    s = np.zeros((len(start), BLOCK), np.int64)
    end = np.zeros(len(start), np.int64)
    for code in np.unique(kind):
        at = np.flatnonzero(kind == code)
        p = pos[at]
        if code == 0:
            s[at] = signed(read(p, 8), 8)[:, None]
            end[at] = p + 8
            continue
        if not (code == 1 or 8 <= code <= 12 or code >= 32):
            raise ValueError(f"subframe type {code}")
        order = BLOCK if code == 1 else code - 8 if code < 32 else code - 31
        own = np.zeros((len(at), BLOCK), np.int64)
        for i in range(order):
            own[:, i] = signed(read(p, 8), 8)
            p = p + 8
        if code == 1:
            s[at], end[at] = own, p
            continue
        if code >= 32:
            precision, shift = read(p, 4) + 1, read(p + 4, 5)
            p = p + 9
            coefs = np.zeros((len(at), order), np.int64)
            for i in range(order):
                c = read(p, precision)
                coefs[:, i] = c - ((c >> (precision - 1)) << precision)
                p = p + precision
        else:  # the fixed predictors are binomial
            row = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}[int(order)]
            coefs, shift = np.tile(np.array(row, np.int64), (len(at), 1)), np.zeros(len(at), np.int64)
        if read(p, 6).any():
            raise ValueError("only plain Rice codes in one partition are read")
        k = read(p + 6, 4)
        p = p + 10
        low = (np.uint64(1) << k.astype(np.uint64)) - np.uint64(1)
        for i in range(order, BLOCK):
            w = words[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)
            q = 53 - np.frexp((w >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
            if (q > 40).any():  # long unary parts, one frame at a time
                for j in np.flatnonzero(q > 40):
                    x = int(p[j])
                    while not buf[x >> 3] >> (7 - (x & 7)) & 1:
                        x += 1
                    q[j] = x - p[j]
                w = words[(p + q) >> 3].astype(np.uint64) << ((p + q) & 7).astype(np.uint64)
                w <<= np.uint64(1)
            else:
                w <<= (q + 1).astype(np.uint64)
            u = (q << k) | ((w >> np.uint64(1) >> (63 - k).astype(np.uint64)) & low).astype(np.int64)
            own[:, i] = (u >> 1) ^ -(u & 1)
            if order:
                own[:, i] += (own[:, i - order : i][:, ::-1] * coefs).sum(axis=1) >> shift
            p = p + q + 1 + k
        s[at], end[at] = own, p
    return s, (end + 7) // 8


def _crc16_fits(data: np.ndarray, start: int, end: int) -> bool:
    """Whether the two bytes before end are the CRC-16 of those from start on."""
    crc = _crc(data, np.array([start]), np.array([end - 2 - start]), _CRC16, 16)[0]
    return int(crc) == int(data[end - 2]) << 8 | int(data[end - 1])


def _heads(data: np.ndarray, frames: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts and header lengths of `frames` frames from number `first` on: sync codes with the next number and a right CRC-8.
    Where two places look like the header of one frame, the CRC-16 of the frame before it decides."""
    sync = np.flatnonzero((data[:-5] == 0xFF) & (data[1:-4] == 0xF8) & (data[2:-3] == 0x10) & (data[3:-2] == 0x02))
    heads = _headers(first + frames)
    start: list[int] = []
    for at in sync.tolist():
        again = heads[first + len(start) - 1] if len(start) > 1 else None
        if again is not None and data[at : at + len(again)].tobytes() == again:
            if not _crc16_fits(data, start[-2], start[-1]):  # the frame before went on: what was taken stood inside it
                start[-1] = at
        elif len(start) < frames and data[at : at + len(heads[first + len(start)])].tobytes() == heads[first + len(start)]:
            start.append(at)
    return np.array(start, np.int64), np.array([len(heads[first + i]) for i in range(len(start))], np.int64)


def _container(f: bytes) -> tuple[int, int, list[tuple[int, int]]]:
    """Samples, start of the audio, and seek points (first sample, byte offset in the audio) of a file."""
    if f[:4] != b"fLaC":
        raise ValueError("not a FLAC file")
    at, last, total, points = 4, False, 0, []
    while not last:
        last, kind, size = bool(f[at] & 0x80), f[at] & 0x7F, int.from_bytes(f[at + 1 : at + 4], "big")
        if kind == 0:
            total = int.from_bytes(f[at + 14 : at + 22], "big") & (1 << 36) - 1
        if kind == 3:
            points = [(int.from_bytes(f[i : i + 8], "big"), int.from_bytes(f[i + 8 : i + 16], "big")) for i in range(at + 4, at + 4 + size, 18)]
        at += 4 + size
    return total, at, points


def samples_from(files: list[bytes], first: list[int]) -> list[bytes]:
    """The samples of each file from sample first[i] on, unsigned. Only the frames that hold them are decoded: the seek table gives
    a frame before, and headers are followed from there."""
    bodies, starts, lens, ends, skip, base = [], [], [], [], [], 0
    for f, sample in zip(files, first, strict=True):
        total, audio, points = _container(f)
        point, offset = max((x for x in points if x[0] <= sample), default=(0, 0))
        body = np.frombuffer(f, np.uint8)[audio + offset :]
        start, length = _heads(np.append(body, np.zeros(8, np.uint8)), (total - point) // BLOCK, point // BLOCK)
        if len(start) * BLOCK != total - point:
            raise ValueError("frames are missing")
        drop = (sample - point) // BLOCK
        bodies.append(body)
        starts.append(start[drop:] + base)
        lens.append(length[drop:])
        ends.append(np.append(start[drop + 1 :], len(body)) + base)
        skip.append(sample % BLOCK)
        base += len(body)
    if not files:
        return []
    pcm = _pcm(np.concatenate(bodies), np.concatenate(starts), np.concatenate(lens), np.concatenate(ends))
    out, at = [], 0
    for start, drop in zip(starts, skip, strict=True):
        out.append(pcm[at + drop : at + len(start) * BLOCK])
        at += len(start) * BLOCK
    return out


def _pcm(buf: np.ndarray, start: np.ndarray, head: np.ndarray, ends: np.ndarray) -> bytes:
    """The samples of frames, their checksums verified."""
    buf = np.append(buf, np.zeros(16, np.uint8))
    pcm = []
    for i in range(0, len(start), _CHUNK):
        part = slice(i, i + _CHUNK)
        lo, hi = int(start[i]), int(ends[part][-1]) + 16
        s, crc_at = _decode_frames(np.append(buf[lo:hi], np.zeros(16, np.uint8)), start[part] - lo, head[part])
        if (crc_at + 2 != ends[part] - lo).any():
            raise ValueError("a frame ends at a wrong place")
        if (_crc(buf[lo:hi], start[part] - lo, crc_at - (start[part] - lo), _CRC16, 16) != buf[lo + crc_at].astype(np.uint32) << 8 | buf[lo + crc_at + 1]).any():
            raise ValueError("CRC-16 of a frame is wrong")
        pcm.append((s + 128).astype(np.uint8).tobytes())
    return b"".join(pcm)


def decode(files: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """PCM blocks (sample offset, unsigned 8-bit samples) of each file. A bad checksum or a short file is a ValueError."""
    return [[(o, data[o : o + PCM_BLOCK]) for o in range(0, len(data), PCM_BLOCK)] for data in samples_from(files, [0] * len(files))]


def payload(text: str | None) -> bytes:
    """The text's UTF-8 bytes, and blanks up to a positive multiple of 192; null is empty."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return b + b" " * ((-len(b)) % BLOCK or (0 if b else BLOCK))


def feature(pcm: bytes) -> str:
    """Root mean square and zero crossings of the samples."""
    s = np.frombuffer(pcm, np.uint8).astype(np.int16) - 128
    rms = float(np.sqrt((s.astype(np.float64) ** 2).mean()))
    return f"rms={rms:.4f};crossings={int(((s[1:] < 0) != (s[:-1] < 0)).sum())}"


def _parts(texts: pd.Series, most: int = 4_000_000) -> Iterator[slice]:
    """Runs of rows with about `most` characters."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "") + BLOCK
        if n >= most:
            yield slice(at, i + 1)
            at, n = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def _ids(rows: pd.DataFrame, kind: str) -> np.ndarray:
    return (rows["doc_id"].astype("Int64") if kind == "long" else rows["doc_id"]).to_numpy()


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the FLAC file of each text. Null and empty texts are 192 blanks; every row is kept, other columns are not."""
    kind = id_type(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _parts(pdf["text"]):
                p = pdf.iloc[part]
                n = [len((t or "").encode("utf-8", "surrogatepass")) for t in p["text"]]
                yield pd.DataFrame({"doc_id": _ids(p, kind), "n_bytes": n, "media": encode([payload(t) for t in p["text"]], lpc=True)})

    return bounded_batches(docs).select(F.col("doc_id").cast(kind).alias("doc_id"), "text").mapInPandas(run, f"doc_id {kind}, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, blocks: array of (sample_offset, pcm) of each media file, its checksums verified."""
    kind = id_type(media)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 512):
                p = pdf.iloc[i : i + 512]
                blocks = [[{"sample_offset": o, "pcm": b} for o, b in x] for x in decode([bytes(m) for m in p["media"]])]
                yield pd.DataFrame({"doc_id": _ids(p, kind), "blocks": blocks})

    return bounded_batches(media).select(F.col("doc_id").cast(kind).alias("doc_id"), "media").mapInPandas(run, f"doc_id {kind}, blocks array<struct<sample_offset:long,pcm:binary>>")


def digests(docs: DataFrame) -> DataFrame:
    """Each text stored as FLAC and read back, and digests of what was read; both in one task, so that no audio is moved.

    Null and empty texts are 192 blanks of 0 bytes; null ids stay null, ids that are no whole numbers are strings; every row is
    kept, equal texts have equal digests, other columns are not kept; an empty table gives an empty result.
    """
    kind = id_type(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _parts(pdf["text"]):
                p = pdf.iloc[part]
                files = encode([payload(t) for t in p["text"]], lpc=True)
                rows = []
                tails = samples_from(files, [_container(f)[0] - 16 for f in files])  # a seek: only the last frame is decoded
                for text, f, blocks, tail in zip(p["text"], files, decode(files), tails, strict=True):
                    data = b"".join(b for _, b in blocks)
                    rows.append((len((text or "").encode("utf-8", "surrogatepass")), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(tail), len(f), hashlib.sha256(f).hexdigest(), feature(data)))
                out = pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
                out.insert(0, "doc_id", _ids(p, kind))
                yield out

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return bounded_batches(docs).select(F.col("doc_id").cast(kind).alias("doc_id"), "text").mapInPandas(run, schema)


def op9_media(spark, sf_dir):
    return digests(load(spark, sf_dir, "documents"))
