"""AVI motion-JPEG columns: write, read by the RIFF index, decode intra frames, find shots.

Frames are decoded side by side: frames of equal size and tables advance one sample at a
time together, each at its own bit position, so NumPy does the work whatever the number of
frames. Lossless frames (SOF3) carry bytes exactly and are what ``write_avi`` makes; baseline
frames (SOF0) of real recordings are decoded to their luma plane.

A shot ends where the histogram of a frame differs from that of the one before by more than
its neighbourhood explains: over the median of the differences around plus four of their
deviations (by the median too, so that other cuts nearby don't raise it), over mean plus four
deviations of those that lie below that, over a floor, and largest within the shortest shot. Shots at a file's ends may be shorter.

Defined results: a null payload is an empty one; a payload is filled up with spaces to whole
frames, one at least; a null file, or one whose first RIFF is damaged, gives no frames, no clips and an
error text, never a failed task. An empty chunk repeats the frame before (that is how AVI
marks a dropped one). A frame that can't be decoded, or is of another size than most, is
filled with the frame before and named in the error text, so places and times of the others
stay; what comes before the first good frame is filled with that. A file without a good
frame, or of whose chunks half or more aren't JPEG at all, gives no frames and an error.
Repeated rows are handled each; an empty table gives no rows; columns besides the id and the
payload are ignored. Later RIFF segments (AVIX) are read on. A file is a row, below 2 GB.
"""

from __future__ import annotations

import struct
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorvia.llm.common import record_batches

WIDTH, HEIGHT, FRAME = 16, 12, 192
MICROSECONDS = 40_000
FRAMES_AT_ONCE = 8192
PLACES_AT_ONCE = 65536
#: A normal distribution's deviation over its median absolute deviation.
MAD_TO_DEVIATION = 1.4826

#: The standard's table of luminance DC categories, by code length and in code order.
DC_COUNTS, DC_VALUES = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
#: The standard's tables, which stand in for those a frame doesn't bring, by class and number.
STANDARD = {
    0x00: (DC_COUNTS, DC_VALUES),
    0x01: ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), DC_VALUES),
    0x10: (
        (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
        tuple(bytes.fromhex(
            "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
            "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
            "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
        )),
    ),
    0x11: (
        (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
        tuple(bytes.fromhex(
            "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"
            "434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
            "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
        )),
    ),
}
#: The zigzag order of an 8 by 8 block.
ZIGZAG = (0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63)


def huffman(counts: Sequence[int], values: Sequence[int]) -> Iterator[tuple[int, int, int]]:
    """(value, code, length) in code order."""
    code = at = 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            yield values[at], code, length
            code += 1
            at += 1
        code <<= 1


@lru_cache(maxsize=64)
def lookup(counts: tuple[int, ...], values: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Code length (0: no code) and value for every 16 bits that may lie ahead."""
    length, value = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for v, code, n in huffman(counts, values):
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
        value[code << (16 - n) : (code + 1) << (16 - n)] = v
    return length, value


def segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def lossless_head(width: int, height: int) -> bytes:
    """Start, Huffman table, lossless frame of one 8-bit component, scan with the left neighbour as prediction."""
    table = bytes([0, *DC_COUNTS, *DC_VALUES])
    return b"\xff\xd8" + segment(0xC4, table) + segment(0xC3, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)) + segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


_CODE, _LENGTH = np.zeros(12, np.int64), np.zeros(12, np.int64)
for _v, _c, _n in huffman(DC_COUNTS, DC_VALUES):
    _CODE[_v], _LENGTH[_v] = _c, _n


def encode_lossless(frames: np.ndarray) -> list[bytes]:
    """Whole lossless JPEG files of frames (n, height, width) of bytes."""
    head, out = lossless_head(frames.shape[2], frames.shape[1]), []
    for start in range(0, len(frames), FRAMES_AT_ONCE):
        x = frames[start : start + FRAMES_AT_ONCE].astype(np.int64)
        n = len(x)
        before = np.empty_like(x)
        before[:, :, 1:] = x[:, :, :-1]
        before[:, 1:, 0] = x[:, :-1, 0]
        before[:, 0, 0] = 128
        diff = (x - before).reshape(n, -1)
        kind = np.frexp(np.abs(diff).astype(np.float64))[1].astype(np.int64)  # bits of the magnitude
        extra = np.where(diff < 0, diff + (1 << kind) - 1, diff)
        value, length = (_CODE[kind] << kind) | extra, _LENGTH[kind] + kind
        ends = np.cumsum(length, axis=1)
        size = (ends[:, -1] + 7) >> 3
        first = np.concatenate([[0], np.cumsum(size)])
        at = (first[:-1, None] << 3) + ends - length
        word = (value << (24 - (at & 7) - length)).ravel()
        byte = (at >> 3).ravel()
        total = int(first[-1])
        data = sum(np.bincount(byte + i, (word >> (16 - 8 * i)) & 255, total + 3)[:total] for i in range(3))
        data[first[1:] - 1] += (1 << (size * 8 - ends[:, -1])) - 1  # filled up with ones
        data = data.astype(np.uint8)
        blob = data.tobytes()
        marks = np.flatnonzero(np.bincount(np.searchsorted(first, np.flatnonzero(data == 255), "right") - 1, minlength=n))
        stuffed = set(marks.tolist())
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            scan = blob[a:b]
            out.append(head + (scan.replace(b"\xff", b"\xff\x00") if i in stuffed else scan) + b"\xff\xd9")
    return out


def chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def avi(frames: Sequence[bytes], width: int, height: int, microseconds: int = MICROSECONDS) -> bytes:
    """A motion-JPEG file with an index."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", microseconds, 0, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIiIHHHH", 0, 0, 0, 0, microseconds, 1_000_000, 0, len(frames), largest, -1, 0, 0, 0, width, height)
    shape = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", shape)))
    parts, index, at = [b"movi"], [], 4
    for f in frames:
        parts.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(parts[-1])
    return chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", b"".join(parts)) + chunk(b"idx1", b"".join(index)))


INDEX = np.dtype([("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])


def chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks between two places; of a list, its kind as the name."""
    while start + 8 <= end:
        name, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        if start + 8 + size > end:
            raise ValueError("a chunk goes on beyond its list")
        yield (data[start + 8 : start + 12], start + 12, start + 8 + size) if name == b"LIST" else (name, start + 8, start + 8 + size)
        start += 8 + size + (size & 1)


VIDEO = (b"dc", b"db")


def later_segments(data: bytes, at: int) -> tuple[list[bytes], str | None]:
    """The video frames of the RIFF segments from a place on, in file order, and what is missing."""
    frames: list[bytes] = []
    while data[at : at + 4] == b"RIFF":
        end = at + 8 + struct.unpack_from("<I", data.ljust(at + 8, b"\0"), at + 4)[0]
        if data[at + 8 : at + 12] == b"AVIX":
            inside = at + 12
            while inside + 8 <= min(end, len(data)):
                size = struct.unpack_from("<I", data, inside + 4)[0]
                if data[inside : inside + 4] == b"LIST" and data[inside + 8 : inside + 12] == b"movi":
                    inside += 12  # its chunks follow
                    continue
                if data[inside + 2 : inside + 4] in VIDEO and data[inside : inside + 2].isdigit():
                    if inside + 8 + size > len(data):
                        return frames, "a later segment is cut off"
                    frames.append(data[inside + 8 : inside + 8 + size])
                inside += 8 + size + (size & 1)
        if end > len(data):
            return frames, "a later segment is cut off"
        at = end + (end & 1)
    return frames, None


def read_avi(data: bytes) -> tuple[int, list[bytes]]:
    """Microseconds of a frame, and the video frames by the index (or in file order without one)."""
    return read_segments(data)[:2]


def read_segments(data: bytes) -> tuple[int, list[bytes], str | None]:
    """As ``read_avi``, with what is missing of later segments."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    microseconds, movi, index = MICROSECONDS, None, None
    for name, start, end in chunks(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
        if name == b"hdrl":
            microseconds = next((struct.unpack_from("<I", data, a)[0] for n, a, _ in chunks(data, start, end) if n == b"avih"), microseconds)
        elif name == b"movi":
            movi = (start, end)
        elif name == b"idx1":
            index = np.frombuffer(data, INDEX, (end - start) // 16, start)
    if movi is None:
        raise ValueError("no frames")
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    later, missing = later_segments(data, end + (end & 1))
    if index is None:
        return microseconds, [data[a:b] for n, a, b in chunks(data, *movi) if n[2:] in VIDEO] + later, missing
    index = index[[n[2:] in VIDEO for n in index["name"].tolist()]]
    # offsets count from the list's kind, in some files from the file's start
    base = 0 if len(index) and data[index["at"][0] : index["at"][0] + 4] == index["name"][0] else movi[0] - 4
    # a place beyond the file is a damaged frame, not a dropped one
    return microseconds, [(data[a : a + s] or b"\0") if s else b"" for a, s in zip((index["at"].astype(np.int64) + base + 8).tolist(), index["size"].tolist(), strict=True)] + later, missing


def parse_jpeg(frame: bytes) -> dict:
    """The header's facts, and where the scan starts."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, found = 2, {"huffman": {}, "quant": {}, "restart": 0}
    while True:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("a damaged JPEG header")
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        data = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while data:
                n = sum(data[1:17])
                found["huffman"][data[0]] = (tuple(data[1:17]), tuple(data[17 : 17 + n]))
                data = data[17 + n :]
        elif marker == 0xDB:
            while data:
                wide = data[0] >> 4
                found["quant"][data[0] & 15] = np.array(struct.unpack(">64H", data[1:129]) if wide else tuple(data[1:65]), np.float64)
                data = data[129 if wide else 65 :]
        elif marker == 0xDD:
            found["restart"] = struct.unpack(">H", data[:2])[0]
        elif marker in (0xC0, 0xC1, 0xC3):
            bits, found["height"], found["width"], n = struct.unpack(">BHHB", data[:6])
            if bits != 8:
                raise ValueError("samples of other than 8 bits")
            found["kind"], found["parts"] = marker, [(data[6 + 3 * i], data[7 + 3 * i] >> 4, data[7 + 3 * i] & 15, data[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("a kind of JPEG frame that is not read")
        elif marker == 0xDA:
            n = data[0]
            found["scan"] = {data[1 + 2 * i]: data[2 + 2 * i] for i in range(n)}
            found["predictor"], found["shift"] = data[1 + 2 * n], data[3 + 2 * n] & 15
            if "kind" not in found:
                raise ValueError("a scan without a frame")
            return found | {"start": at, "huffman": STANDARD | found["huffman"]}


def decode_lossless(frames: list[bytes], head: dict) -> np.ndarray:
    """Frames (n, height, width) of one component that share a header, decoded side by side."""
    width, height = head["width"], head["height"]
    if head["predictor"] != 1 or head["shift"] or len(head["parts"]) != 1 or head["restart"]:
        raise ValueError("a kind of lossless frame that is not read")
    length, value = lookup(*head["huffman"][head["scan"][head["parts"][0][0]] >> 4])
    if width * height > 8 * max(map(len, frames)):
        raise ValueError("a damaged scan")  # a sample takes a bit at least
    out = np.empty((len(frames), height * width), np.uint8)
    for start in range(0, len(frames), FRAMES_AT_ONCE):
        scans = [f[head["start"] :].replace(b"\xff\x00", b"\xff") for f in frames[start : start + FRAMES_AT_ONCE]]
        n = len(scans)
        first = np.cumsum([0, *map(len, scans)])[:-1]
        raw = np.frombuffer(b"".join([*scans, bytes(8)]), np.uint8).astype(np.uint32)
        ahead = ((raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]).astype(np.int64)
        at, last = first * 8, (first + [len(s) for s in scans]) * 8
        x = np.full(n, 128, np.int64)
        row = x
        lost = np.zeros(n, bool)
        for i in range(height * width):
            if i and i % width == 0:
                x = row
            bits = (ahead[at >> 3] >> (16 - (at & 7))) & 0xFFFF
            step, kind = length[bits], value[bits]
            at = at + step
            extra = (((ahead[at >> 3] << (at & 7)) & 0xFFFFFFFF) >> (32 - kind)) if kind.any() else kind
            half = (1 << kind) >> 1
            x = (x + np.where(extra < half, extra - (1 << kind) + 1, extra)) & 0xFFFF
            at = np.minimum(at + kind, last)
            lost |= step == 0
            out[start : start + n, i] = x
            if i % width == 0:
                row = x
        if lost.any() or (at >= last).any():
            raise ValueError("a damaged scan")
    return out.reshape(len(frames), height, width)


_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


def decode_baseline(frame: bytes, head: dict) -> np.ndarray:
    """The luma plane (height, width) of a baseline frame."""
    scan = frame[head["start"] :]
    parts = [(h, v, *(lookup(*head["huffman"][k]) for k in (head["scan"][c] >> 4, 16 + (head["scan"][c] & 15))), q) for c, h, v, q in head["parts"]]
    wide, high = max(p[0] for p in parts), max(p[1] for p in parts)
    if len(parts) == 1:
        parts, wide, high = [(1, 1, *parts[0][2:])], 1, 1
    across, down = -(-head["width"] // (8 * wide)), -(-head["height"] // (8 * high))
    if across * down > 4 * len(scan):
        raise ValueError("a damaged scan")  # a block takes two bits at least
    pieces, at = [], 0
    for mark in [i for i in range(len(scan) - 1) if scan[i] == 0xFF and 0xD0 <= scan[i + 1] <= 0xD9]:
        pieces.append(scan[at:mark].replace(b"\xff\x00", b"\xff"))
        at = mark + 2
    pieces.append(scan[at:].replace(b"\xff\x00", b"\xff"))
    blocks = np.zeros((down * parts[0][1], across * parts[0][0], 64))
    each = head["restart"] or across * down
    if len(pieces) < -(-across * down // each):
        raise ValueError("a damaged scan")
    for k, piece in enumerate(pieces[: -(-across * down // each)]):
        bits, size, pos, dc = int.from_bytes(piece + bytes(8), "big"), (len(piece) + 8) * 8, 0, [0] * len(parts)

        def take(n: int) -> int:
            nonlocal pos
            pos += n
            if pos > size:
                raise ValueError("a damaged scan")
            return (bits >> (size - pos)) & ((1 << n) - 1)  # noqa: B023

        def coded(table: tuple[np.ndarray, np.ndarray]) -> int:
            nonlocal pos
            ahead = take(16)
            pos -= 16
            if not table[0][ahead]:
                raise ValueError("a damaged scan")
            pos += int(table[0][ahead])
            return int(table[1][ahead])

        def signed(n: int) -> int:
            v = take(n)
            return v if not n or v >> (n - 1) else v - (1 << n) + 1

        for mcu in range(k * each, min((k + 1) * each, across * down)):
            for i, (h, v, dc_table, ac_table, q) in enumerate(parts):
                for b in range(h * v):
                    dc[i] += signed(coded(dc_table))
                    block, z = {0: dc[i]}, 1
                    while z < 64:
                        symbol = coded(ac_table)
                        if not symbol & 15 and symbol != 0xF0:
                            break
                        z += symbol >> 4
                        if symbol & 15:
                            if z > 63:
                                raise ValueError("a damaged scan")
                            block[z] = signed(symbol & 15)
                        z += 1
                    if i == 0:
                        for z, c in block.items():
                            blocks[mcu // across * v + b // h, mcu % across * h + b % h, ZIGZAG[z]] = c * head["quant"][q][z]
        if pos > len(piece) * 8:
            raise ValueError("a damaged scan")
    pixels = np.einsum("abuv,ux,vy->abxy", blocks.reshape(*blocks.shape[:2], 8, 8), _COS, _COS)
    plane = np.clip(np.rint(pixels) + 128, 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, -1)
    if parts[0][0] != wide or parts[0][1] != high:
        raise ValueError("luma that is sampled below chroma")
    return plane[: head["height"], : head["width"]]


def decode(files: Sequence[list[bytes]]) -> list[np.ndarray | str]:
    """Frames (n, height, width) of each file, or what is wrong with it where none can be read."""
    return [planes if len(planes) or error is None else error for planes, error in decode_each(files)]


def decode_each(files: Sequence[list[bytes]]) -> list[tuple[np.ndarray, str | None]]:
    """Frames of each file, filled where they can't be read, and what is wrong. Alike frames of all files go together."""
    heads: dict[bytes, dict] = {}
    groups: dict[bytes, list[tuple[int, int, bytes]]] = defaultdict(list)
    planes: list[list] = [[None] * len(f) for f in files]
    wrong: list[dict[int, str]] = [{} for _ in files]
    last = b"?"
    for i, frames in enumerate(files):
        for j, f in enumerate(frames):
            if not f:
                continue
            try:
                if not f.startswith(last):
                    found = parse_jpeg(f)
                    last = f[: found["start"]]
                    heads[last] = found
                groups[last].append((i, j, f))
            except (ValueError, struct.error, IndexError) as e:
                wrong[i][j] = str(e)
    for key, members in groups.items():
        try:
            together = decode_lossless([f for *_, f in members], heads[key]) if heads[key]["kind"] == 0xC3 else None
        except (ValueError, KeyError, IndexError):
            together = None  # one of them is damaged: look at each
        for k, (i, j, f) in enumerate(members):
            try:
                planes[i][j] = together[k] if together is not None else decode_lossless([f], heads[key])[0] if heads[key]["kind"] == 0xC3 else decode_baseline(f, heads[key])
            except (ValueError, KeyError, IndexError) as e:
                wrong[i][j] = str(e)
    return [filled(frames, *found) for frames, *found in zip(files, planes, wrong, strict=True)]


def filled(frames: list[bytes], planes: list, wrong: dict[int, str]) -> tuple[np.ndarray, str | None]:
    """The frames of one file without gaps, and what is wrong with it."""
    none = np.zeros((0, 1, 1), np.uint8)
    shapes = Counter(p.shape for p in planes if p is not None)
    given = sum(map(bool, frames))
    if not shapes or 2 * sum(bool(f) and f[:2] != b"\xff\xd8" for f in frames) >= given:
        return none, next((f"frame {j}: {e}" for j, e in sorted(wrong.items())), "only empty frames" if frames else None)
    shape = shapes.most_common(1)[0][0]
    wrong |= {j: "of another size" for j, p in enumerate(planes) if p is not None and p.shape != shape}
    out = np.empty((len(frames), *shape), np.uint8)
    good = np.array([p is not None and p.shape == shape for p in planes])
    for j in np.flatnonzero(good).tolist():
        out[j] = planes[j]
    if not good.all():
        # the last good frame so far; before the first, that one
        from_frame = np.maximum.accumulate(np.where(good, np.arange(len(frames)), int(good.argmax())))
        out = out[from_frame]
    if not wrong:
        return out, None
    first = min(wrong)
    return out, f"{len(wrong)} of {len(frames)} frames not read, the first: frame {first}: {wrong[first]}"


def shots(planes: np.ndarray, bins: int = 16, around: int = 8, floor: float = 0.15, shortest: int = 2) -> list[tuple[int, int, float]]:
    """(first frame, frames, change at its start) of each shot."""
    n = len(planes)
    if not n:
        return []
    flat = planes.reshape(n, -1)
    held = np.bincount(((flat >> 4).astype(np.int64) + bins * np.arange(n)[:, None]).ravel(), minlength=bins * n).reshape(n, bins)
    change = np.abs(np.diff(held, axis=0)).sum(1) / (2 * flat.shape[1])
    starts = [0]
    near = np.concatenate([np.zeros(shortest - 1), change, np.zeros(shortest - 1)])
    largest = np.lib.stride_tricks.sliding_window_view(near, 2 * shortest - 1).max(1) if len(change) else change
    places = np.flatnonzero((change > floor) & (change == largest))
    padded = np.concatenate([np.full(around, np.inf), change, np.full(around, np.inf)])
    offsets = np.delete(np.arange(2 * around + 1), around)
    for first in range(0, len(places), PLACES_AT_ONCE):
        some = places[first : first + PLACES_AT_ONCE]
        # of the neighbours without the place itself; of an even number, the lower median
        others = padded[some[:, None] + offsets]
        count = np.isfinite(others).sum(1)
        middle = np.maximum(count - 1, 0) // 2
        row = np.arange(len(some))
        median = np.where(count > 0, np.sort(others, axis=1)[row, middle], 0.0)
        spread = np.where(count > 0, np.sort(np.abs(others - median[:, None]), axis=1)[row, middle], 0.0) * MAD_TO_DEVIATION
        # too few to show a spread: the floor has to be passed above them
        spread = np.where(count < 4, np.maximum(spread, floor / 4), spread)
        # and over mean and deviations of the neighbours that are no cuts themselves
        alike = others <= (median + 4 * spread)[:, None]
        held_back = np.where(alike, others, 0.0)
        n_alike = np.maximum(alike.sum(1), 1)
        mean = held_back.sum(1) / n_alike
        deviation = np.sqrt(np.maximum((held_back**2).sum(1) / n_alike - mean**2, 0))
        for i in some[change[some] > np.maximum(median + 4 * spread, mean + 4 * deviation)].tolist():
            if len(starts) == 1 or i + 1 - starts[-1] >= shortest:
                starts.append(i + 1)
    ends = [*starts[1:], n]
    return [(s, e - s, float(change[s - 1]) if s else 0.0) for s, e in zip(starts, ends, strict=True)]


def write_avi(df: DataFrame, *, id_col: str, payload_col: str) -> DataFrame:
    """id and media (binary): the UTF-8 bytes of the payload as lossless frames of 16 by 12."""
    source = df.select(F.col(id_col), F.col(payload_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches, 2 << 20, "__text"):
            payloads = [t.encode("utf-8", "surrogatepass") if t else b"" for t in batch.column("__text").to_pylist()]
            payloads = [p.ljust(max(1, -(-len(p) // FRAME)) * FRAME) for p in payloads]
            frames = encode_lossless(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, HEIGHT, WIDTH))
            made, at = [], 0
            for p in payloads:
                made.append(avi(frames[at : at + len(p) // FRAME], WIDTH, HEIGHT))
                at += len(p) // FRAME
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], [id_col, "media"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, media binary")


CLIPS = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("change", pa.float64())]))


def scan_avi(media: DataFrame, *, id_col: str, media_col: str = "media") -> DataFrame:
    """id, n_frames, width, height, samples (the decoded luma of all frames, in order), clips
    (timed shots), error, media_bytes, media_sha256."""
    source = media.select(F.col(id_col), F.col(media_col).alias("__media"), F.octet_length(media_col).cast("long").alias("media_bytes"), F.sha2(F.col(media_col), 256).alias("media_sha256"))
    schema = f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, n_frames int, width int, height int, samples binary, clips array<struct<clip int, first_frame int, n_frames int, start_s double, end_s double, change double>>, error string, media_bytes long, media_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches, 2 << 20, "__media"):
            files, times, wrong, missing = [], [], {}, {}
            for i, data in enumerate(batch.column("__media").to_pylist()):
                try:
                    micro, frames, missing[i] = read_segments(data or b"")
                except (ValueError, struct.error, IndexError) as e:
                    micro, frames, wrong[i] = MICROSECONDS, [], str(e)
                files.append(frames)
                times.append(micro / 1e6)
            rows: list[list] = [[] for _ in range(6)]
            for i, (planes, error) in enumerate(decode_each(files)):
                wrong[i] = "; ".join(filter(None, (wrong.get(i), error, missing.get(i)))) or None
                second = times[i]
                clips = [{"clip": k, "first_frame": a, "n_frames": n, "start_s": a * second, "end_s": (a + n) * second, "change": c} for k, (a, n, c) in enumerate(shots(planes))]
                n, high, wide = planes.shape
                for column, value in zip(rows, (n, wide if n else None, high if n else None, planes.tobytes(), clips, wrong.get(i)), strict=True):
                    column.append(value)
            types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), CLIPS, pa.string()]
            names = [id_col, "n_frames", "width", "height", "samples", "clips", "error", "media_bytes", "media_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(rows, types, strict=True)), batch.column("media_bytes"), batch.column("media_sha256")], names)

    return source.mapInArrow(run, schema)


def clip_rows(scanned: DataFrame, *, id_col: str) -> DataFrame:
    """One row per timed clip."""
    return scanned.select(id_col, F.inline("clips"))
