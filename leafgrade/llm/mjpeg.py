"""AVI files of motion JPEG: write payloads losslessly, parse the RIFF index, decode frames, cut shots.

A payload is padded with bytes 255 to a multiple of 576 and each 576 bytes become one 24x24 grey frame.
JPEG's lossless unit is the quantised coefficient, so each byte is one coefficient of a baseline
(sequential Huffman) frame with a quantisation table of ones: bytes 97 and up are 1, 2, ..., smaller ones
-1, -2, ..., so no coefficient is zero and no rounding is involved. Files hold avih/strh/strf headers, an
INFO comment with the payload's length, a movi list and an idx1 index.

Reading goes by the index. Frames are Huffman-decoded side by side in numpy, one lane a frame, with the
tables of the standard (as motion JPEG without DHT segments has them) or those of the file; pixels come
from an exact integer inverse transform. A shot begins where the difference of neighbouring frames'
grey histograms exceeds the mean of the shot's earlier differences by `sensitivity` of their mean
absolute deviations (adaptive: a busy shot needs a larger jump). Clips are rows with times. Colour frames
(components in one scan, with any sampling that leaves the first whole, and restart intervals) are read too;
their first component, brightness, makes the histograms.

Defined cases: null and empty texts are one frame of padding; broken or foreign files (progressive frames,
several scans, missing index) raise ValueError and become rows with `error` in clips(); equal texts have
equal files and repeated rows equal results; an empty table gives no row; a very long text is one file,
written and read in a step of its own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, text_batches

FRAME = 576
SIDE = 24
FPS = 25
_PART = 1 << 19

# Fixed values of the JPEG standard (ITU-T T.81, Annex K): numbers of codes by length, then symbols.
DC_BITS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
AC_BITS = [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]
AC_SYMBOLS = list(bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9"
    "aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
))
DC_BITS_CHROMA = (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0)
DC_SYMBOLS_CHROMA = tuple(DC_SYMBOLS)
AC_BITS_CHROMA = (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119)
AC_SYMBOLS_CHROMA = tuple(bytes.fromhex(
    "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8"
    "a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
))


def _zigzag() -> np.ndarray:
    """Row-major place of the k-th coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


def _codes(bits: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code and length by symbol, and the table of (length << 8 | symbol) by the next 16 bits."""
    code = k = 0
    by_code, by_size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    look = np.zeros(1 << 16, np.int32)
    for size, n in enumerate(bits, 1):
        for _ in range(n):
            s = symbols[k]
            by_code[s], by_size[s] = code, size
            look[code << (16 - size) : (code + 1) << (16 - size)] = size << 8 | s
            code += 1
            k += 1
        code <<= 1
    return by_code, by_size, look


_DC, _AC = _codes(DC_BITS, DC_SYMBOLS), _codes(AC_BITS, AC_SYMBOLS)
_BYTE_VALUE = np.where(np.arange(256) >= 97, np.arange(256) - 96, np.arange(256) - 97)
_SIZE = np.array([0] + [int(v).bit_length() for v in range(1, 2048)])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HEAD = b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def _scans(payload: np.ndarray) -> list[bytes]:
    """The entropy-coded bytes of every frame of a payload of whole frames."""
    v = _BYTE_VALUE[payload].reshape(-1, 9, 64)
    frames = len(v)
    diff = v.copy()
    diff[:, 1:, 0] -= v[:, :-1, 0]
    flat = diff.reshape(-1)
    size = _SIZE[np.abs(flat)]
    dc = np.zeros(len(flat), bool)
    dc[::64] = True
    code = np.where(dc, _DC[0][size], _AC[0][size])
    length = np.where(dc, _DC[1][size], _AC[1][size])
    extra = np.where(flat < 0, flat + (1 << size) - 1, flat)
    word = (code << size) | extra
    length = length + size
    ends = np.cumsum(length)
    total = ends[FRAME - 1 :: FRAME]
    own = np.diff(np.append(0, total))
    byte_size = -(-own // 8)
    byte_at = np.append(0, np.cumsum(byte_size))
    begin = ends - length + np.repeat(8 * byte_at[:-1] - (total - own), FRAME)
    out = np.zeros(byte_at[-1] // 4 + 3, np.uint64)
    place = word.astype(np.uint64) << (64 - (begin & 31) - length).astype(np.uint64)
    np.add.at(out, begin >> 5, place >> np.uint64(32))
    np.add.at(out, (begin >> 5) + 1, place & np.uint64(0xFFFFFFFF))
    data = out.astype(">u4").view(np.uint8)[: byte_at[-1]].copy()
    pad = 8 * byte_size - own
    data[byte_at[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)  # the last bits are ones
    ff = data == 0xFF
    at = byte_at + np.append(0, np.cumsum(ff))[byte_at]
    stuffed = np.zeros(at[-1], np.uint8)
    stuffed[np.arange(len(data)) + np.append(0, np.cumsum(ff))[:-1]] = data
    raw = stuffed.tobytes()
    return [raw[at[i] : at[i + 1]] for i in range(frames)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _avi(frames: list[bytes], n_bytes: int) -> bytes:
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload_bytes=%d" % n_bytes))
    sizes = np.array([len(f) for f in frames], np.uint32)
    body = b"".join([_chunk(b"00dc", f) for f in frames])
    index = np.zeros((len(frames), 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10
    index[:, 2] = 4 + np.append(0, np.cumsum(8 + sizes + (sizes & 1)))[:-1]
    index[:, 3] = sizes
    movi = _chunk(b"LIST", b"movi" + body)
    return _chunk(b"RIFF", b"AVI " + hdrl + info + movi + _chunk(b"idx1", index.tobytes()))


def write_avis(texts: list[bytes]) -> list[bytes]:
    """One AVI file for each payload."""
    padded = [t + b"\xff" * ((-len(t)) % FRAME or (FRAME if not t else 0)) for t in texts]
    counts = [len(p) // FRAME for p in padded]
    scans = _scans(np.frombuffer(b"".join(padded), np.uint8))
    out, at = [], 0
    for t, n in zip(texts, counts, strict=True):
        out.append(_avi([_HEAD + s + b"\xff\xd9" for s in scans[at : at + n]], len(t)))
        at += n
    return out


def parse_riff(data: bytes) -> dict:
    """Frames by the idx1 index, the rate, and the payload length of the comment (None without one)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict = {"fps": float(FPS), "payload": None, "frames": None}
    movi, index = None, None

    def walk(at: int, end: int) -> None:
        nonlocal movi, index
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if at + 8 + size > len(data):
                raise ValueError("a chunk is longer than the file")
            if name == b"LIST":
                if data[at + 8 : at + 12] == b"movi":
                    movi = at + 8
                else:
                    walk(at + 12, at + 8 + size)
            elif name == b"avih":
                found["fps"] = 1e6 / max(1, int.from_bytes(data[at + 8 : at + 12], "little"))
            elif name == b"ICMT" and data[at + 8 : at + 22] == b"payload_bytes=":
                found["payload"] = int(data[at + 22 : at + 8 + size])
            elif name == b"idx1":
                index = np.frombuffer(data, "<u4", size // 16 * 4, at + 8).reshape(-1, 4)
            at += 8 + size + (size & 1)

    walk(12, min(len(data), 8 + int.from_bytes(data[4:8], "little")))
    if movi is None or index is None:
        raise ValueError("no movi list or idx1 index")
    frames = []
    for _, _, place, size in index.tolist():
        at = movi + place
        if data[at + 2 : at + 4] == b"dc":
            if int.from_bytes(data[at + 4 : at + 8], "little") != size:
                raise ValueError("the index and a chunk differ")
            frames.append(data[at + 8 : at + 8 + size])
    found["frames"] = frames
    return found


class _Layout(NamedTuple):
    """What frames that are decoded together share: size, blocks of a unit by component, tables, units between restarts."""

    height: int
    width: int
    #: (columns, rows) of blocks that a unit holds of each component.
    sampling: tuple[tuple[int, int], ...]
    quant: bytes
    #: For each component its DC and AC table as (bits, symbols), empty for the standard's.
    tables: tuple[tuple[tuple, tuple], ...]
    restart: int


_OWN = _Layout(SIDE, SIDE, ((1, 1),), b"\x01" * 64, (((), ()),), 0)


def _parse_jpeg(data: bytes) -> tuple[_Layout, bytes]:
    """Layout and scan of a baseline frame of one component, or of several in one scan."""
    if data.startswith(_HEAD):
        return _OWN, data[len(_HEAD) : -2]
    at, restart, shape, components = 2, 0, None, []
    quant: dict[int, bytes] = {}
    huffman: dict[int, tuple] = {}
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("only quantisation tables of 8 bits are read")
                quant[body[0]] = body[1:65]
                body = body[65:]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xC0:
            shape = struct.unpack(">BHHB", body[:6])
            components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(shape[3])]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDA:
            if shape is None or shape[0] != 8 or body[0] != len(components) or [c[0] for c in components] != list(body[1 : 1 + 2 * len(components) : 2]):
                raise ValueError("only frames of 8 bits whose components are all in one scan are decoded")
            which = body[2 : 2 + 2 * len(components) : 2]
            tables = tuple((huffman.get(t >> 4, ()), huffman.get(16 + (t & 15), ())) for t in which)
            if huffman and not all(t for pair in tables for t in pair):
                raise ValueError("a table is missing")
            if not huffman and len(components) > 1:
                tables = (((), ()), *[((DC_BITS_CHROMA, DC_SYMBOLS_CHROMA), (AC_BITS_CHROMA, AC_SYMBOLS_CHROMA))] * (len(components) - 1))
            # A scan of one component has one block a unit, whatever its sampling says.
            sampling = tuple((c[1], c[2]) for c in components) if len(components) > 1 else ((1, 1),)
            if sampling[0] != tuple(map(max, zip(*sampling, strict=True))) or len(quant.get(components[0][3], b"")) != 64:
                raise ValueError("the first component has not the full size, or no quantisation table")
            end = data.rfind(b"\xff\xd9")
            layout = _Layout(shape[1], shape[2], sampling, quant[components[0][3]], tables, restart)
            return layout, data[at + 2 + size : end if end > 0 else len(data)]
        at += 2 + size
    raise ValueError("no scan in a frame")


def _intervals(scan: bytes, units: int, restart: int) -> list[tuple[bytes, int]]:
    """The parts of a scan between restart markers, each with its number of units."""
    if not restart:
        return [(scan, units)]
    parts, at = [], 0
    for k in range(-(-units // restart)):
        end = scan.find(bytes([0xFF, 0xD0 + k % 8]), at)
        last = k == -(-units // restart) - 1
        if end < 0 and not last:
            raise ValueError("a restart marker is missing")
        parts.append((scan[at : len(scan) if last else end], min(restart, units - k * restart)))
        at = end + 2
    return parts


def _coefficients(scans: list[bytes], blocks: np.ndarray, tables: tuple = (((), ()),), pattern: tuple[int, ...] = (0,)) -> np.ndarray:
    """Coefficients (scans, most blocks, 64) in zigzag order; scans are lanes that advance together.

    pattern names the component of each block of a unit; each component has its own tables and predictor.
    """
    n = len(scans)
    size = np.array([len(s) for s in scans], np.int64)
    raw = np.frombuffer(b"".join([*scans, b"\xff\xff" * 8]), np.uint8)
    dropped = np.zeros(len(raw), bool)
    dropped[1:] = (raw[1:] == 0) & (raw[:-1] == 0xFF)
    data = raw[~dropped].astype(np.uint64)
    begin = np.append(0, np.cumsum(size))
    begin = begin - np.append(0, np.cumsum(dropped))[begin]
    m = len(data) - 8
    window = np.zeros(m, np.uint64)
    for j in range(8):
        window = (window << np.uint64(8)) | data[j : j + m]
    look = np.concatenate([x for dc, ac in tables for x in (_codes(*map(list, dc))[2] if dc else _DC[2], _codes(*map(list, ac))[2] if ac else _AC[2])])
    several, unit = len(pattern) > 1, np.array(pattern)
    most = int(blocks.max())
    out = np.zeros((n, most * 64), np.int32)
    lane = np.arange(n)
    bit, limit, k, block, last = 8 * begin[:-1], 8 * begin[1:], np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, len(tables)), np.int64)
    own = np.zeros(n, np.int64)
    while len(lane):
        w = window[np.minimum(bit >> 3, m - 1)] << (bit & 7).astype(np.uint64)
        table = k > 0
        if several:
            own = unit[block % len(unit)]
            table = table + 2 * own
        entry = look[(w >> np.uint64(48)).astype(np.int64) + (table << 16)]
        length, symbol = (entry >> 8).astype(np.int64), (entry & 255).astype(np.int64)
        run = np.where(k > 0, symbol >> 4, 0)
        bits = symbol & 15
        v = ((w << length.astype(np.uint64)) >> np.uint64(1) >> (63 - bits).astype(np.uint64)).astype(np.int64)
        v = np.where((bits > 0) & (v < (1 << bits >> 1)), v - (1 << bits) + 1, v)
        if (length == 0).any() or (bit + length + bits > limit + 16).any():
            raise ValueError("a frame's code is broken")
        bit = bit + length + bits
        first = k == 0
        before = last[np.arange(len(lane)), own]
        now = np.where(first, before + v, before)
        last[np.arange(len(lane)), own] = now
        k = k + run
        value = np.where(first, now, v)
        ok = (bits > 0) | first
        if (k > 63).any():
            raise ValueError("a frame's run leaves its block")
        out[lane[ok], block[ok] * 64 + k[ok]] = value[ok]
        k = np.where((bits == 0) & ~first & (run < 15), 64, k + 1)  # end of block
        over = k >= 64
        block = block + over
        k[over] = 0
        go = block < blocks[lane]
        if not go.all():
            lane, bit, limit, k, block, last, own = (x[go] for x in (lane, bit, limit, k, block, last, own))
    return out.reshape(n, most, 64)


def _basis() -> np.ndarray:
    """Rows are frequencies; entries are integers of 12 bits so that sums are exact in doubles."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    scale = np.where(k == 0, np.sqrt(1 / 8), np.sqrt(2 / 8))
    return np.round(scale * np.cos((2 * x + 1) * k * np.pi / 16) * 4096)


_BASIS = _basis()


def pixels(coefficients: np.ndarray, quant: bytes, height: int, width: int, across: int | None = None) -> np.ndarray:
    """Frames (n, height, width) of grey values, from blocks in rows of `across`."""
    n, blocks, _ = coefficients.shape
    grid = np.zeros((n, blocks, 64))
    grid[:, :, ZIGZAG] = coefficients * np.frombuffer(quant, np.uint8).astype(np.float64)
    grid = grid.reshape(n * blocks, 8, 8)
    cols = (grid.reshape(-1, 8) @ _BASIS).reshape(-1, 8, 8)
    full = (cols.transpose(0, 2, 1).reshape(-1, 8) @ _BASIS).reshape(-1, 8, 8).transpose(0, 2, 1)
    grey = np.clip(np.floor(full / (4096.0 * 4096.0) + 128.5), 0, 255).astype(np.uint8)
    across = across or -(-width // 8)
    return grey.reshape(n, blocks // across, across, 8, 8).transpose(0, 1, 3, 2, 4).reshape(n, -1, across * 8)[:, :height, :width]


def decode_frames(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients in zigzag order and grey pixels of frames of one layout; of colour frames those of the first component (brightness)."""
    parsed = [_parse_jpeg(f) for f in frames]
    if len({layout for layout, _ in parsed}) > 1:
        raise ValueError("frames of different shapes or tables in one call")
    x = parsed[0][0]
    h, v = x.sampling[0]
    across, down = -(-x.width // (8 * h)), -(-x.height // (8 * v))
    pattern = tuple(i for i, (a, b) in enumerate(x.sampling) for _ in range(a * b))
    parts = [p for _, scan in parsed for p in _intervals(scan, across * down, x.restart)]
    blocks = np.array([u for _, u in parts], np.int64) * len(pattern)
    c = _coefficients([s for s, _ in parts], blocks, x.tables, pattern)
    if x.restart:  # intervals of a frame one after the other; the last may be short
        each = len(parts) // len(frames)
        c = c.reshape(len(frames), each * c.shape[1], 64)[:, : across * down * len(pattern)]
    if h * v > 1 or len(pattern) > 1:
        # Units in rows; inside a unit the first component's blocks in rows.
        c = c.reshape(len(frames), down, across, len(pattern), 64)[:, :, :, : h * v].reshape(len(frames), down, across, v, h, 64)
        c = c.transpose(0, 1, 3, 2, 4, 5).reshape(len(frames), -1, 64)
    return c, pixels(c, x.quant, x.height, x.width, across * h)


def shots(grey: np.ndarray, sensitivity: float = 3.0) -> list[int]:
    """First frames of all shots."""
    n = len(grey)
    bins = (grey >> 4).reshape(n, -1).astype(np.int64) + 16 * np.arange(n)[:, None]
    return _cuts(np.bincount(bins.reshape(-1), minlength=16 * n).reshape(n, 16), sensitivity)


def _cuts(h: np.ndarray, sensitivity: float) -> list[int]:
    d = np.abs(np.diff(h, axis=0)).sum(axis=1).tolist()
    out, total, spread, count = [0], 0.0, 0.0, 0
    for i, x in enumerate(d):
        if count >= 3 and x > total / count + sensitivity * max(spread / count, 1.0):
            out.append(i + 1)
            total, spread, count = 0.0, 0.0, 0
            continue
        total, count = total + x, count + 1
        spread += abs(x - total / count)
    return out


def payload_of(coefficients: np.ndarray) -> np.ndarray:
    v = coefficients.reshape(-1)
    return np.where(v > 0, v + 96, v + 97).astype(np.uint8)


def store_text(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` and media: each text as an AVI file."""
    keep = keep or ["doc_id"]
    bound_batches(docs.sparkSession, 500)
    source = docs.select(*keep, *(["text"] if "text" not in keep else []))

    def run(batches):
        for part, buf, off in text_batches(batches, most=_PART):
            raw = buf.tobytes()
            media = write_avis([raw[off[i] : off[i + 1]] for i in range(len(off) - 1)])
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(media, pa.binary())], [*keep, "media"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)
    return source.mapInArrow(run, schema + ", media binary")


_RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(stored: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Payloads read back from `media`, with digests and a feature: frames, shots and a histogram of all pixels."""
    keep = keep or ["doc_id"]

    def run(batches):
        for batch in batches:
            media = batch.column(len(keep)).to_pylist()
            at = 0
            while at < len(media):
                end, size = at, 0
                while end < len(media) and (end == at or size + len(media[end]) <= _PART):
                    size += len(media[end])
                    end += 1
                rows = []
                parsed = [parse_riff(m) for m in media[at:end]]
                c, grey = decode_frames([f for p in parsed for f in p["frames"]])
                payload = payload_of(c).tobytes()
                n = len(grey)
                bins = (grey >> 4).reshape(n, -1).astype(np.int32) + 16 * np.arange(n, dtype=np.int32)[:, None]
                hist = np.bincount(bins.reshape(-1), minlength=16 * n).reshape(n, 16)
                first = 0
                for m, p in zip(media[at:end], parsed, strict=True):
                    k = len(p["frames"])
                    own = payload[first * FRAME : (first + k) * FRAME]
                    h = hist[first : first + k]
                    cuts = _cuts(h, 3.0)
                    feature = f"frames={k};shots={len(cuts)};cuts={'.'.join(map(str, cuts[1:]))};hist={'.'.join(map(str, h.sum(axis=0).tolist()))}"
                    rows.append((p["payload"], len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
                    first += k
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, end - at) for i in range(len(keep))), *(pa.array(v, t) for v, t in zip(cols, kinds, strict=True))], [*keep, *names])
                at = end

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.select(*keep).schema)
    return stored.select(*keep, "media").mapInArrow(run, f"{schema}, {_RESULT}")


def clips(stored: DataFrame, keep: list[str] | None = None, sensitivity: float = 3.0) -> DataFrame:
    """A row for each shot of each file: clip, first and last frame, begin and end in seconds; or one with `error`."""
    keep = keep or ["doc_id"]

    def run(batches):
        for batch in batches:
            out = []
            for i, m in enumerate(batch.column(len(keep)).to_pylist()):
                try:
                    p = parse_riff(m or b"")
                    starts = shots(decode_frames(p["frames"])[1], sensitivity)
                    ends = [*starts[1:], len(p["frames"])]
                    out += [(i, k, a, b - 1, a / p["fps"], b / p["fps"], None) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]
                except (ValueError, struct.error, IndexError) as e:
                    out.append((i, 0, None, None, None, None, str(e) or type(e).__name__))
            which = pa.array([x[0] for x in out], pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
            cols = [pa.array([x[j + 1] for x in out], t) for j, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(which) for j in range(len(keep))), *cols], [*keep, "clip", "first_frame", "last_frame", "begin_s", "end_s", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.select(*keep).schema)
    return stored.select(*keep, "media").mapInArrow(run, f"{schema}, clip long, first_frame long, last_frame long, begin_s double, end_s double, error string")


def op5_mjpeg(spark, sf_dir: str) -> DataFrame:
    return read_media(store_text(spark.read.parquet(f"{sf_dir}/documents.parquet")))
