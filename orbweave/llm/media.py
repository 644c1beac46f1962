"""Media columns: AVI motion-JPEG clips made, parsed, decoded and cut into shots.

A payload of 8-bit samples becomes grey-level baseline JPEG frames of 24 x 8 blocks, one sample a block: each block is
flat, so its DC coefficient (quantiser 8) is the sample itself and the frame is lossless while any decoder shows it.
All twelve DC categories have four-bit codes and end-of-block has one bit, so that a batch of frames is encoded and
decoded side by side in numpy.  The frames go into a RIFF AVI file with an ``idx1`` index.

Reading parses the RIFF tree, follows the index (or the frame list where there is none) to each frame, and decodes the intra frame.
Frames as written here are decoded side by side; any other baseline frame (own Huffman and quantiser tables or the usual
ones, AC coefficients, subsampled components, restart markers) by ``decode_jpeg``, of which the luminance counts.  Shots end
where the difference of neighbouring frames' histograms exceeds mean + ``SIGMA`` deviations of the differences in the same
clip, and, since that can't fire in clips of two to four frames or of many cuts, also where a share of ``HARD`` of the
samples changes its bin, or a share of ``FLOOR`` that is ``TIMES`` the lower quartile of the clip.  They give timed rows.

A null text is an empty one, which is a frame of spaces.  Equal texts have equal files.  A file that is broken or not motion
JPEG gives one row with its error in ``clip_rows`` and no others; a null file gives none.  A long text's frames are dealt over RIFF parts
of ``PART`` frames, the first a file in itself and all others its extensions (AVIX), each with an index; ``digests`` writes,
reads and forgets part by part, so that its memory is the text's and a constant.  ``to_clips`` gives null for a text whose file would pass
the 2 GB of a binary value.  An empty table gives an empty result, repeated rows are read alike, and extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, utf8

UNIT, COLS, ROWS = 192, 24, 8
FPS = 25
#: Frames of a RIFF part, and those that are encoded or decoded side by side; bytes that a value can hold.
PART, STEP, VALUE = 1 << 14, 1 << 12, (1 << 31) - 1
BINS, SIGMA = 16, 1.5
HARD, FLOOR, TIMES = 0.5, 0.25, 3


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg_header() -> bytes:
    """All of a frame before its entropy-coded data."""
    quant = _segment(0xDB, b"\x00" + bytes([8] + [1] * 63))
    frame = _segment(0xC0, struct.pack(">BHHB", 8, ROWS * 8, COLS * 8, 1) + bytes([1, 0x11, 0]))
    # DC: twelve codes of four bits; AC: end-of-block alone, one bit
    dc = _segment(0xC4, b"\x00" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)))
    ac = _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00")
    scan = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    return b"\xff\xd8" + quant + frame + dc + ac + scan


HEADER = jpeg_header()
_DIFF = np.arange(-2047, 2048)
_CAT = np.where(_DIFF == 0, 0, np.floor(np.log2(np.maximum(np.abs(_DIFF), 1))).astype(np.int64) + 1)
_LOW = np.where(_DIFF < 0, _DIFF + (1 << _CAT) - 1, _DIFF)
#: For each DC difference: the code with its value bits and the end of block, and its length.
_CODE = ((_CAT << _CAT | _LOW) << 1).astype(np.int64)
_LEN = _CAT + 5


def encode_frames(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded, byte-stuffed data of frames (n x 192 samples) and their offsets."""
    n = len(samples)
    level = samples.astype(np.int64) - 128
    diff = np.diff(level, axis=1, prepend=0) + 2047
    size = _LEN[diff]
    end = np.cumsum(size, axis=1)
    total = (end[:, -1] + 7) >> 3
    base = np.cumsum(total) - total
    bit = end - size + (base << 3)[:, None]
    code = _CODE[diff] << (24 - size - (bit & 7))
    at = (bit >> 3).ravel()
    length = int(total.sum())
    out = np.zeros(length + 2)
    for k, shift in enumerate((16, 8, 0)):
        out += np.bincount(at + k, weights=((code >> shift) & 255).ravel(), minlength=length + 2)[: length + 2]
    raw = out[:length].astype(np.uint8)
    spare = (total << 3) - end[:, -1]
    raw[base + total - 1] |= ((1 << spare) - 1).astype(np.uint8)  # fill the last byte with ones
    full = raw == 255
    grown = np.repeat(raw, 1 + full)
    stuffed = np.cumsum(1 + full)
    grown[stuffed[full] - 1] = 0
    return grown, np.r_[0, stuffed[base + total - 1]]


def decode_frames(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Samples (n x 192) of the entropy-coded data at data[lo:hi] of each frame."""
    n = len(lo)
    length = hi - lo
    start = np.cumsum(length) - length
    where = np.arange(int(length.sum())) + np.repeat(lo - start, length)
    raw = data[where]
    stuffing = np.zeros(len(raw), bool)
    stuffing[1:] = (raw[1:] == 0) & (raw[:-1] == 255)
    stuffing[start] = False
    lost = np.r_[0, np.cumsum(stuffing)]
    plain = np.r_[raw[~stuffing], np.full(4, 255, np.uint8)].astype(np.uint32)
    window = (plain[:-3] << 24) | (plain[1:-2] << 16) | (plain[2:-1] << 8) | plain[3:]
    bit = (start - lost[start]) << 3
    last = (start + length - lost[start + length]) << 3
    level = np.zeros(n, np.int64)
    out = np.empty((UNIT, n), np.uint8)
    for k in range(UNIT):
        word = window[np.minimum(bit >> 3, len(window) - 1)] << (bit & 7).astype(np.uint32)
        cat = (word >> np.uint32(28)).astype(np.int64)
        value = ((word << np.uint32(4)).astype(np.int64) & 0xFFFFFFFF) >> (32 - cat)
        level += np.where(value >> np.maximum(cat - 1, 0), value, value - (1 << cat) + 1) * (cat > 0)
        out[k] = level + 128
        bit = bit + cat + 5
    if (bit > last).any():
        raise ValueError("a frame's entropy-coded data ends early")
    return out.T


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes], total: int | None = None, extension: bool = False) -> bytes:
    """A RIFF AVI file with an index; of a clip of ``total`` frames the first part, or an extension that holds more of them."""
    wide, high = COLS * 8, ROWS * 8
    most = max(map(len, frames), default=0)
    total = len(frames) if total is None else total
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, wide, high, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, total, most, 0xFFFFFFFF, 0, 0, 0, wide, high)
    strf = struct.pack("<IiiHH4sIiiII", 40, wide, high, 1, 24, b"MJPG", wide * high * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = b"" if extension else _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    size = np.fromiter(map(len, frames), np.int64, len(frames))
    index = np.zeros((len(frames), 4), "<u4")
    index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, size
    index[:, 2] = 4 + np.cumsum(8 + size + (size & 1)) - (8 + size + (size & 1))
    movi = b"movi" + b"".join([b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) & 1) for f in frames])
    return _chunk(b"RIFF", (b"AVIX" if extension else b"AVI ") + hdrl + _chunk(b"LIST", movi) + _chunk(b"idx1", index.tobytes()))


class Stream(NamedTuple):
    """What a file's first part says of its video: the stream's number, and the frame rate."""

    number: int
    scale: int
    rate: int


def part_frames(blob: bytes, begin: int, known: Stream | None = None) -> tuple[np.ndarray, np.ndarray, Stream, int]:
    """Offsets and sizes of the frames of the RIFF part at ``begin`` that its index names, or of all in its list without one; the
    stream, and where the part ends."""
    movi, index, scale, rate, streams, video = None, None, 1, FPS, 0, None

    def chunks(at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
        while at + 8 <= end:
            tag, size = bytes(blob[at : at + 4]), struct.unpack_from("<I", blob, at + 4)[0]
            if at + 8 + size > end:
                raise ValueError("a chunk runs past its parent")
            yield tag, at + 8, size
            at += 8 + size + (size & 1)

    def walk(at: int, end: int) -> None:
        nonlocal movi, index, scale, rate, streams, video
        for tag, at_, size in chunks(at, end):
            if tag == b"LIST":
                if blob[at_ : at_ + 4] == b"movi":
                    movi = (at_, at_ + size) if movi is None else movi
                else:
                    walk(at_ + 4, at_ + size)
            elif tag == b"strh":
                if blob[at_ : at_ + 4] == b"vids" and video is None:
                    if blob[at_ + 4 : at_ + 8].upper() != b"MJPG":
                        raise ValueError("not motion JPEG")
                    video, (scale, rate) = streams, struct.unpack_from("<II", blob, at_ + 20)
                streams += 1
            elif tag == b"idx1":
                index = np.frombuffer(blob, "<u4", size // 16 * 4, at_).reshape(-1, 4)

    end = begin + 8 + struct.unpack_from("<I", blob, begin + 4)[0]
    walk(begin + 12, min(len(blob), end))
    end += end & 1
    if movi is None or video is None and known is None:
        raise ValueError("no list of frames")
    known = known or Stream(video, scale, rate)
    if not known.scale or not known.rate:
        raise ValueError("no frame rate")
    tags = [b"%02ddc" % known.number, b"%02ddb" % known.number]
    if index is None:
        spots, lists = [], [(movi[0] + 4, movi[1])]
        while lists:
            for tag, at, size in chunks(*lists.pop(0)):
                if tag == b"LIST":
                    lists.append((at + 4, at + size))
                elif tag in tags:
                    spots.append((at, size))
        at, size = (np.array(x, np.int64) for x in (zip(*sorted(spots), strict=True) if spots else ((), ())))
        return at, size, known, end
    index = index[np.isin(index[:, 0], [int.from_bytes(t, "little") for t in tags])]
    at, size = index[:, 2].astype(np.int64), index[:, 3].astype(np.int64)
    if len(at) and blob[at[0] + movi[0] : at[0] + movi[0] + 4] in tags:  # from the list on, else from the file's beginning
        at = at + movi[0]
    if len(at) and ((at + 8 + size).max() > len(blob) or blob[at[0] : at[0] + 4] not in tags):
        raise ValueError("the index points outside of the frames")
    return at + 8, size, known, end


def frames_of(blob: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Offsets and sizes of the frames of a file and of its extensions, and the rate (scale, rate)."""
    if blob[:4] != b"RIFF" or blob[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI file")
    at, size, known, end = part_frames(blob, 0)
    parts = [(at, size)]
    while blob[end : end + 4] == b"RIFF" and blob[end + 8 : end + 12] == b"AVIX":
        at, size, _, end = part_frames(blob, end, known)
        parts.append((at, size))
    return np.concatenate([a for a, _ in parts]), np.concatenate([n for _, n in parts]), known.scale, known.rate


#: Fixed values (ITU T.81, K.3): code lengths and symbols of the usual tables, for frames that leave theirs out.
USUAL_DC = (bytes.fromhex("00010501010101010100000000000000"), bytes.fromhex("00030101010101010101010000000000"))
USUAL_AC = (
    (bytes.fromhex("0002010303020403050504040000017d"), bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa")),
    (bytes.fromhex("00020102040403040705040400010277"), bytes.fromhex("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa".replace(" ", ""))),
)
#: Row-major places of coefficients in the order of the diagonals, and the cosines of a block.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) / (2 if u else np.sqrt(8)) for x in range(8)] for u in range(8)])


@functools.lru_cache(maxsize=64)
def _huffman(lengths: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """Length and symbol of the code that each 16 bits begin with; length 0 where none does."""
    size, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    at = k = 0
    for bits, count in enumerate(lengths, 1):
        for _ in range(count):
            span = 1 << (16 - bits)
            if at + span > 1 << 16 or k >= len(symbols):
                raise ValueError("a Huffman table overflows")
            size[at : at + span], symbol[at : at + span] = bits, symbols[k]
            at, k = at + span, k + 1
    return size.tolist(), symbol.tolist()


class _Bits:
    """Codes and values from entropy-coded bytes without stuffing."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.count = data + b"\xff" * 8, 0, 0, 0
        self.last = len(data) * 8

    def block(self, dc, ac, out: np.ndarray) -> None:
        """Difference of the DC level and AC levels of a block, in the order of the diagonals."""
        k = 0
        while k < 64:
            size, symbol = ac if k else dc
            while self.count < 32:
                self.held = (self.held << 32) | int.from_bytes(self.data[self.at : self.at + 4].ljust(4, b"\xff"), "big")
                self.at, self.count = self.at + 4, self.count + 32
            code = (self.held >> (self.count - 16)) & 0xFFFF
            used, value = size[code], symbol[code]
            if not used:
                raise ValueError("a code that no table has")
            bits = value & 15
            if k:
                run = value >> 4
                if not bits:
                    if run != 15:
                        self.count -= used
                        break
                    run = 16
                k += run
            elif value > 11:
                raise ValueError("not eight bits a sample")
            if bits:
                if k > 63:
                    raise ValueError("a block of more than 64 levels")
                level = (self.held >> (self.count - used - bits)) & ((1 << bits) - 1)
                out[k] = level if level >> (bits - 1) else level - (1 << bits) + 1
            self.count -= used + bits
            self.held &= (1 << self.count) - 1
            k += 1 if bits or not k else 0
        if self.at * 8 - self.count > self.last:
            raise ValueError("a frame's entropy-coded data ends early")


def decode_jpeg(frame: bytes) -> np.ndarray:
    """The first component (luminance) of a baseline frame, height x width."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    quant: dict[int, np.ndarray] = {}
    tables = {(0, k): (USUAL_DC[k], bytes(range(12))) for k in (0, 1)} | {(1, k): USUAL_AC[k] for k in (0, 1)}
    shape: tuple[int, int] | None = None
    parts: dict[int, tuple[int, int, int]] = {}  # component to its factors across and down, and its quantiser
    levels: dict[int, np.ndarray] = {}
    restart, at = 0, 2
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise ValueError("no marker where one must be")
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        if marker == 0xD9:
            break
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide == 2 else "u1", 64, 1).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                count = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = (body[1:17], body[17 : 17 + count])
                body = body[17 + count :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif marker in (0xC0, 0xC1):
            depth, high, wide, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not high or not wide:
                raise ValueError("not eight bits a sample, or no size")
            shape = (high, wide)
            parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            if not parts or not all(1 <= h <= 4 and 1 <= v <= 4 for h, v, _ in parts.values()):
                raise ValueError("sampling factors out of range")
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline frame")
        elif marker == 0xDA:
            if shape is None:
                raise ValueError("a scan before its frame")
            end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S).search(frame, at)
            stop = end.start() if end else len(frame)
            named = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
            _scan(frame[at:stop], named, parts, shape, tables, restart, levels)
            at = stop
    if shape is None or not levels or next(iter(parts)) not in levels:
        raise ValueError("a frame without samples")
    first = next(iter(parts))
    h, v, which = parts[first]
    if which not in quant:
        raise ValueError("a quantiser is missing")
    grid = levels[first]
    rows, cols = grid.shape[:2]
    flat = np.zeros((rows * cols, 64))
    flat[:, ZIGZAG] = grid.reshape(-1, 64) * quant[which]
    blocks = COSINES.T @ flat.reshape(-1, 8, 8) @ COSINES
    plane = np.clip(np.rint(blocks) + 128, 0, 255).astype(np.uint8).reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8)
    most_h, most_v = (max(p[k] for p in parts.values()) for k in (0, 1))
    return plane[: -(-shape[0] * v // most_v), : -(-shape[1] * h // most_h)]


def _scan(data: bytes, named: dict, parts: dict, shape: tuple[int, int], tables: dict, restart: int, levels: dict) -> None:
    """Levels (rows x columns x 64) of the components of one scan."""
    most_h, most_v = (max(p[k] for p in parts.values()) for k in (0, 1))
    if not named.keys() <= parts.keys() or not all((0, d) in tables and (1, a) in tables for d, a in named.values()):
        raise ValueError("a scan of an unknown component or table")
    units = (-(-shape[0] // (8 * most_v)), -(-shape[1] // (8 * most_h)))
    for part in named:
        h, v, _ = parts[part]
        levels[part] = np.zeros((units[0] * v, units[1] * h, 64), np.int64)
    if len(named) == 1:  # alone, a component comes block by block
        ((part, _),) = named.items()
        h, v, _ = parts[part]
        units = (-(-(-(-shape[0] * v // most_v)) // 8), -(-(-(-shape[1] * h // most_h)) // 8))
    codes = {part: (_huffman(*tables[0, d]), _huffman(*tables[1, a])) for part, (d, a) in named.items()}
    pieces_ = re.split(rb"\xff[\xd0-\xd7]", data) if restart else [data]
    total = units[0] * units[1]
    step = restart or total
    if len(pieces_) * step < total:
        raise ValueError("a frame's entropy-coded data ends early")
    for number, piece in enumerate(pieces_[: -(-total // step)]):
        bits, last = _Bits(piece.replace(b"\xff\x00", b"\xff")), dict.fromkeys(named, 0)
        for unit in range(number * step, min(total, (number + 1) * step)):
            row, col = divmod(unit, units[1])
            for part, (dc, ac) in codes.items():
                h, v, _ = parts[part] if len(named) > 1 else (1, 1, 0)
                for y in range(v):
                    for x in range(h):
                        out = levels[part][row * v + y, col * h + x]
                        bits.block(dc, ac, out)
                        last[part] += int(out[0])
                        out[0] = last[part]


def _coded(payload: np.ndarray) -> list[bytes]:
    """The frames of a payload, some at a time."""
    out = []
    for lo in range(0, len(payload), STEP * UNIT):
        data, off = encode_frames(payload[lo : lo + STEP * UNIT].reshape(-1, UNIT))
        raw, at = data.tobytes(), off.tolist()
        out += [HEADER + raw[at[j] : at[j + 1]] + b"\xff\xd9" for j in range(len(at) - 1)]
    return out


def encode_parts(payload: np.ndarray) -> Iterator[bytes]:
    """The RIFF parts of the file of a payload (uint8, a multiple of 192)."""
    for lo in range(0, len(payload), PART * UNIT):
        yield avi(_coded(payload[lo : lo + PART * UNIT]), len(payload) // UNIT, lo > 0)


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """An AVI file for each payload (uint8, a multiple of 192)."""
    if sum(map(len, payloads)) > STEP * UNIT * 2:
        return [b"".join(encode_parts(p)) for p in payloads]
    counts = [len(p) // UNIT for p in payloads]
    if not counts:
        return []
    data, off = encode_frames(np.concatenate(payloads).reshape(-1, UNIT))
    raw, at, out = data.tobytes(), off.tolist(), []
    k = 0
    for n in counts:
        out.append(avi([HEADER + raw[at[j] : at[j + 1]] + b"\xff\xd9" for j in range(k, k + n)]))
        k += n
    return out


def decode_at(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[np.ndarray]:
    """The samples of the frames at data[lo:hi], ``STEP`` frames at a time."""
    head = np.frombuffer(HEADER, np.uint8)
    for a in range(0, len(lo), STEP):
        begin, end = lo[a : a + STEP], hi[a : a + STEP]
        if not (data[begin[:, None] + np.arange(len(head))] == head).all():
            raise ValueError("a frame has markers or tables other than those of this format")
        if not ((data[end - 2] == 0xFF) & (data[end - 1] == 0xD9)).all():
            raise ValueError("a frame doesn't end")
        yield decode_frames(data, begin + len(head), end - 2)


def decode(blobs: list[bytes]) -> list[np.ndarray]:
    """The frames (n x 192 samples) of each file."""
    if not blobs:
        return []
    lo, hi, counts, base = [], [], [], 0
    for blob in blobs:
        at, size, _, _ = frames_of(blob)
        lo.append(at + base)
        hi.append(at + size + base)
        counts.append(len(at))
        base += len(blob)
    data = np.frombuffer(blobs[0] if len(blobs) == 1 else b"".join(blobs), np.uint8)
    frames = [np.zeros((0, UNIT), np.uint8), *decode_at(data, np.concatenate(lo), np.concatenate(hi))]
    return np.split(np.concatenate(frames), np.cumsum(counts)[:-1])


def histograms(frames: np.ndarray) -> np.ndarray:
    """Samples by bin of each frame (n x samples)."""
    n = len(frames)
    return np.bincount((np.arange(n)[:, None] * BINS + (frames >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)


def shots(frames: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """First frames of the shots of a clip (n x samples)."""
    return shots_of(histograms(frames), sigma)


def shots_of(hist: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """First frames of the shots of a clip, from its frames' histograms."""
    n = len(hist)
    if n < 2:
        return np.zeros(min(n, 1), np.int64)
    change = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    share = change / (2 * hist[0].sum())
    sharp = (share >= HARD) | (share >= FLOOR) & (share >= TIMES * np.quantile(share, 0.25, method="lower"))
    return np.r_[0, np.flatnonzero(sharp | (change > change.mean() + sigma * change.std())) + 1]


def _payloads(column: pa.Array):
    data, off = utf8(column)
    for lo, hi in pieces(off, 1 << 20):
        out = []
        for k in range(lo, hi):
            raw = data[off[k] : off[k + 1]]
            size = max(1, -(-len(raw) // UNIT)) * UNIT
            full = np.full(size, 32, np.uint8)
            full[: len(raw)] = raw
            out.append(full)
        yield lo, hi, (off[lo + 1 : hi + 1] - off[lo:hi]).tolist(), out


class Digest:
    """What is said of a clip, gathered from its parts."""

    def __init__(self):
        self.stored, self.back, self.media_bytes, self.payload_bytes, self.total, self.tail, self.hist = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, b"", []

    def write(self, part: bytes) -> None:
        self.stored.update(part)
        self.media_bytes += len(part)

    def read(self, frames: np.ndarray) -> None:
        back = np.ascontiguousarray(frames).tobytes()
        self.back.update(back)
        self.payload_bytes, self.tail, self.total = self.payload_bytes + len(back), back[-16:], self.total + int(frames.sum())
        self.hist.append(histograms(frames).astype(np.int16))

    def row(self, n_bytes: int) -> tuple:
        cuts = shots_of(np.concatenate(self.hist))
        feature = f"frames={self.payload_bytes // UNIT};shots={len(cuts)};cuts={zlib.crc32(cuts.astype('<i8').tobytes()):08x};mean={self.total / self.payload_bytes:.3f}"
        return n_bytes, self.payload_bytes, self.back.hexdigest(), zlib.crc32(self.tail), self.media_bytes, self.stored.hexdigest(), feature


def digest_long(n_bytes: int, payload: np.ndarray) -> tuple:
    """The row of a payload of any length, part by part."""
    out, known = Digest(), None
    for part in encode_parts(payload):
        out.write(part)
        at, size, known, _ = part_frames(part, 0, known)
        for frames in decode_at(np.frombuffer(part, np.uint8), at, at + size):
            out.read(frames)
    return out.row(n_bytes)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the text's payload stored as a clip, read back and described."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, sizes, payloads in _payloads(batch.column(1)):
                if sum(map(len, payloads)) > STEP * UNIT * 2:
                    rows = [digest_long(size, payload) for size, payload in zip(sizes, payloads, strict=True)]
                else:
                    blobs, rows = encode(payloads), []
                    for size, blob, frames in zip(sizes, blobs, decode(blobs), strict=True):
                        out = Digest()
                        out.write(blob)
                        out.read(frames)
                        rows.append(out.row(size))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def to_clips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media binary): each text as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, payloads in _payloads(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([x if len(x) <= VALUE else None for x in encode(payloads)], pa.binary())], names=[id_col, "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, media binary")


def clip_histograms(blob: bytes) -> tuple[np.ndarray, float]:
    """Histograms of a file's frames, one held at a time where they are foreign, as samples of a common size; seconds a frame."""
    at, size, scale, rate = frames_of(blob)
    if not len(at):
        return np.zeros((0, BINS), np.int64), scale / rate
    if all(blob[a : a + len(HEADER)] == HEADER for a in at.tolist()):
        return np.concatenate([histograms(frames) for frames in decode_at(np.frombuffer(blob, np.uint8), at, at + size)]), scale / rate
    rows = []
    for a, n in zip(at.tolist(), size.tolist(), strict=True):
        if not n and rows:  # a dropped frame shows the last one again
            rows.append(rows[-1])
            continue
        luma = decode_jpeg(blob[a : a + n])
        rows.append(np.bincount((luma >> 4).ravel(), minlength=BINS) / luma.size)
    return np.array(rows), scale / rate


CLIP = "shot long, first_frame long, n_frames long, start_s double, end_s double, error string"


def clip_rows(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, shot, first_frame, n_frames, start_s, end_s, error): timed rows of the shots of each file, or one row with its error; a
    null has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                blob = batch.column(1)[k].as_py()
                if blob is None:
                    continue
                try:
                    hist, seconds = clip_histograms(blob)
                    first, error = shots_of(hist), None
                    last = np.r_[first[1:], len(hist)].astype(np.int64)[: len(first)]
                    columns = [np.arange(len(first)), first, last - first, first * seconds, last * seconds]
                except (ValueError, IndexError, struct.error) as e:  # what broken bytes lead to
                    columns, error = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], f"{type(e).__name__}: {e}"
                n = len(columns[0])
                owner = batch.column(0).slice(k, 1).take(pa.array(np.zeros(n, np.int64)))
                yield pa.RecordBatch.from_arrays([owner, *map(pa.array, columns), pa.array([error] * n, pa.string())], names=[id_col, *(x.split()[0] for x in CLIP.split(", "))])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, {CLIP}")
