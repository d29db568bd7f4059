import hashlib
import struct
import zlib

import numpy as np
import pytest

from quorvia.llm.media import _COS, DC_COUNTS, DC_VALUES, STANDARD, ZIGZAG, avi, chunk, clip_rows, decode, encode_lossless, huffman, read_avi, scan_avi, segment, shots, write_avi
from quorvia.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_query(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op3_media"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        payload = docs[r.doc_id].ljust(max(1, -(-len(docs[r.doc_id]) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes) == (len(docs[r.doc_id]), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.feature.startswith(f"frames={len(payload) // 192};shots=")


def test_round_trip_of_all_differences():
    rng = np.random.default_rng(1)
    frames = np.concatenate([rng.integers(0, 256, (50, 12, 16)), np.zeros((2, 12, 16)), np.full((2, 12, 16), 255), rng.choice([0, 255], (20, 12, 16))]).astype(np.uint8)
    files = [avi(encode_lossless(frames), 16, 12), avi(encode_lossless(rng.integers(0, 256, (3, 5, 7)).astype(np.uint8)), 7, 5), avi([], 16, 12)]
    found = decode([read_avi(f)[1] for f in files])
    assert np.array_equal(found[0], frames) and found[1].shape == (3, 5, 7) and len(found[2]) == 0


def test_file_without_index_and_absolute_index():
    frames = encode_lossless(np.arange(192 * 3).reshape(3, 12, 16).astype(np.uint8))
    data = avi(frames, 16, 12, 20_000)
    at = data.index(b"idx1")
    short = bytearray(data[:at])
    short[4:8] = struct.pack("<I", len(short) - 8)
    assert read_avi(bytes(short)) == (20_000, frames) == read_avi(data)
    moved = bytearray(data)
    for i in range(3):
        place = at + 8 + 16 * i + 8
        moved[place : place + 4] = struct.pack("<I", struct.unpack_from("<I", data, place)[0] + data.index(b"movi"))
    assert read_avi(bytes(moved)) == (20_000, frames)


def baseline(plane, restart=0):
    """A grey baseline frame with flat quantisation and fixed-length codes."""
    ac = [run << 4 | size for run in range(16) for size in range(1, 11)] + [0, 0xF0]
    ac_counts = [0] * 7 + [len(ac)] + [0] * 8
    codes = {0: {v: (c, n) for v, c, n in huffman(DC_COUNTS, DC_VALUES)}, 1: {v: (c, n) for v, c, n in huffman(ac_counts, ac)}}
    high, wide = plane.shape
    bits, out, last = "", b"", 0

    def put(table, symbol):
        code, n = codes[table][symbol]
        return format(code, f"0{n}b")

    def number(v):
        n = int(abs(v)).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def close():
        whole = bits + "1" * (-len(bits) % 8)
        return bytes(int(whole[i : i + 8], 2) for i in range(0, len(whole), 8)).replace(b"\xff", b"\xff\x00")

    k = 0
    for y in range(0, high, 8):
        for x in range(0, wide, 8):
            if restart and k and k % restart == 0:
                out += close() + bytes([0xFF, 0xD0 + (k // restart - 1) % 8])
                bits, last = "", 0
            block = np.rint(_COS @ (plane[y : y + 8, x : x + 8].astype(float) - 128).T @ _COS.T).astype(int).T.ravel()
            zz = [int(block[i]) for i in ZIGZAG]
            n, extra = number(zz[0] - last)
            last = zz[0]
            bits += put(0, n) + extra
            run = 0
            for v in zz[1:]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    bits += put(1, 0xF0)
                    run -= 16
                n, extra = number(v)
                bits += put(1, run << 4 | n) + extra
                run = 0
            if run:
                bits += put(1, 0)
            k += 1
    head = b"\xff\xd8" + segment(0xDB, bytes([0] + [1] * 64)) + segment(0xC4, bytes([0, *DC_COUNTS, *DC_VALUES])) + segment(0xC4, bytes([16, *ac_counts, *ac]))
    head += segment(0xDD, struct.pack(">H", restart)) if restart else b""
    return head + segment(0xC0, struct.pack(">BHHBBBB", 8, high, wide, 1, 1, 0x11, 0)) + segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + out + close() + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 2])
def test_baseline_frames(restart):
    y, x = np.mgrid[0:24, 0:32]
    plane = (128 + 60 * np.sin(x / 5) + 50 * np.cos(y / 3)).astype(np.uint8)
    (found,) = decode([[baseline(plane, restart)] * 2])
    assert found.shape == (2, 24, 32) and np.abs(found[0].astype(int) - plane).max() <= 2


def test_shots():
    rng = np.random.default_rng(2)
    planes = np.concatenate([rng.normal(level, 12, (n, 12, 16)) for level, n in ((40, 30), (180, 25), (90, 40))]).clip(0, 255).astype(np.uint8)
    assert [(a, n) for a, n, _ in shots(planes)] == [(0, 30), (30, 25), (55, 40)]
    assert [x[:2] for x in shots(planes[:1])] == [(0, 1)] and shots(planes[:0]) == []


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "é🙂" * 100000, 4: "a" * 192, 5: "a" * 193}
    df = spark.createDataFrame([(k, v, b"x") for k, v in texts.items()] + [(None, "dup", b"x"), (None, "dup", b"x")], "id long, text string, samples binary")
    rows = scan_avi(write_avi(df, id_col="id", payload_col="text"), id_col="id")
    found = rows.collect()
    assert sorted(r.n_frames for r in found) == sorted([1, 1, -(-600000 // 192), 1, 2, 1, 1]) and not any(r.error for r in found)
    clips = clip_rows(rows, id_col="id").collect()
    assert all(c.end_s > c.start_s for c in clips)
    frames = encode_lossless(np.zeros((2, 12, 16), np.uint8))
    bad = [None, b"", b"RIFF", avi(frames, 16, 12)[:-60], avi([frames[0][:30]], 16, 12), avi([frames[0], b"junk"], 16, 12), avi([frames[0][:-3] + b"\xff\xd9"], 16, 12)]
    damaged = spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "id int, media binary")
    out = {r.id: r for r in scan_avi(damaged, id_col="id").collect()}
    assert len(out) == len(bad) and all(out[i].error and out[i].n_frames == 0 and not out[i].clips for i in range(6))
    assert scan_avi(damaged.limit(0), id_col="id").count() == 0


def still(cuts, n):
    """Still frames between full cuts."""
    return np.concatenate([np.full((b - a, 12, 16), i % 2 * 200, np.uint8) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, n], strict=True))])


@pytest.mark.parametrize("apart", range(2, 10))
def test_shots_close_together(apart):
    found = lambda planes: [a for a, *_ in shots(planes)]
    assert found(still([30, 30 + apart], 60)) == [0, 30, 30 + apart]
    cuts = list(range(apart, 90, apart))
    assert found(still(cuts, 90)) == [0, *cuts]
    rng = np.random.default_rng(apart)
    noisy = np.concatenate([rng.normal(level, 12, (n, 48, 64)) for level, n in ((40, 30), (180, apart), (90, 40))]).clip(0, 255).astype(np.uint8)
    assert found(noisy) == [0, 30, 30 + apart]


def test_shots_of_short_files():
    for n in (2, 3, 4):
        for cut in range(1, n):
            assert [x[:2] for x in shots(still([cut], n))] == [(0, cut), (cut, n - cut)]
        assert len(shots(still([], n))) == 1


def test_standard_tables():
    for counts, values in STANDARD.values():
        assert sum(counts) == len(values) == len(set(values))
    for k in (0x10, 0x11):
        assert set(STANDARD[k][1]) == {run << 4 | size for run in range(16) for size in range(1, 11)} | {0, 0xF0}
    plane = np.full((8, 8), 128, np.uint8)
    plane[:, :4] = 160
    # all four kinds of tables by three components, with a luma block of DC 0 and AC -2 at place 1
    grey = segment(0xDB, bytes([0] + [8] * 64)) + segment(0xC0, struct.pack(">BHHB9B", 8, 8, 8, 3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0)) + segment(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0]))
    # luma DC category 0 "00", AC 0/2 "01" with "01" for -2, end "1010"; chroma DC category 0 "00", end "00", twice
    bits = "00" + "01" + "01" + "1010" + "0000" + "0000"
    bits += "1" * (-len(bits) % 8)
    frame = b"\xff\xd8" + grey + bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)) + b"\xff\xd9"
    (found,) = decode([[frame]])
    want = np.rint(-2 * 8 * _COS[0][0] * _COS[1])[None, :].repeat(8, 0) + 128
    assert np.abs(found[0] - want).max() <= 1 and want.min() < 128 < want.max()
    own = baseline(plane)
    bare = own.replace(segment(0xC4, bytes([0, *DC_COUNTS, *DC_VALUES])), b"")
    assert bare != own and np.array_equal(decode([[own]])[0], decode([[bare]])[0])


def scanned(spark, files):
    media = spark.createDataFrame(list(enumerate(files)), "id int, media binary")
    return [r for r in sorted(scan_avi(media, id_col="id").collect(), key=lambda r: r.id)]


def test_dropped_damaged_and_odd_frames(spark):
    planes = np.concatenate([still([], 3), still([], 3) + 200]).astype(np.uint8)
    f = encode_lossless(planes)
    other = encode_lossless(np.zeros((1, 5, 7), np.uint8))[0]
    y, x = np.mgrid[0:24, 0:32]
    whole = baseline((128 + 60 * np.sin(x / 5) + 50 * np.cos(y / 3)).astype(np.uint8))
    files = [[f[0], b"", f[1], f[3], b"", f[4]], [b"", f[0], f[3]], [f[0], f[1][:-3] + b"\xff\xd9", f[3], f[4]], [f[0], b"junk", f[1], f[3]], [f[0], other, f[1], f[3]], [b"", b""], [whole, whole[:-40], whole]]
    rows = scanned(spark, [avi(x, 16, 12) for x in files])
    assert [r.n_frames for r in rows] == [6, 3, 4, 4, 4, 0, 3]
    assert [r.error is None for r in rows] == [True, True, False, False, False, False, False]
    frames = lambda r: np.frombuffer(r.samples, np.uint8).reshape(r.n_frames, -1)[:, 0].tolist()
    assert frames(rows[0]) == [0, 0, 0, 200, 200, 200] and [(c.first_frame, c.n_frames) for c in rows[0].clips] == [(0, 3), (3, 3)]
    assert frames(rows[1]) == [0, 0, 200] and frames(rows[2]) == [0, 0, 200, 200] and frames(rows[3]) == frames(rows[4]) == [0, 0, 0, 200]
    assert "frame 1" in rows[2].error and "1 of 4" in rows[3].error and "size" in rows[4].error
    assert len(set(np.frombuffer(rows[6].samples, np.uint8).reshape(3, -1).sum(1).tolist())) == 1


def test_later_segments(spark):
    f = encode_lossless(np.arange(192 * 6).reshape(6, 12, 16).astype(np.uint8))
    parts = [chunk(b"RIFF", b"AVIX" + chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", x) for x in part)) + chunk(b"idx1", b"")) for part in (f[2:4], f[4:])]
    data = avi(f[:2], 16, 12) + parts[0] + parts[1]
    assert read_avi(data)[1] == f
    rows = scanned(spark, [data, data[:-30], data[: -len(parts[1]) // 2]])
    assert rows[0].n_frames == 6 and rows[0].error is None
    assert all(4 <= r.n_frames < 6 and "segment" in r.error for r in rows[1:])


def plain_feature(payload):
    """The feature by its description, frame by frame."""
    frames = [payload[i : i + 192] for i in range(0, len(payload), 192)]
    held = [[sum(b >> 4 == v for b in f) for v in range(16)] for f in frames]
    change = [sum(abs(a - b) for a, b in zip(x, y, strict=True)) / 384 for x, y in zip(held, held[1:], strict=False)]
    starts, peak = [0], 0.0
    for i, c in enumerate(change):
        if c <= 0.15 or c != max(change[max(0, i - 1) : i + 2]):
            continue
        others = sorted(change[max(0, i - 8) : i] + change[i + 1 : i + 9])
        middle = max(len(others) - 1, 0) // 2
        median = others[middle] if others else 0.0
        spread = (sorted(abs(x - median) for x in others)[middle] if others else 0.0) * 1.4826
        spread = max(spread, 0.15 / 4) if len(others) < 4 else spread
        alike = [x for x in others if x <= median + 4 * spread]
        mean = sum(alike) / max(1, len(alike))
        deviation = max(sum(x * x for x in alike) / max(1, len(alike)) - mean**2, 0) ** 0.5
        if c > max(median + 4 * spread, mean + 4 * deviation) and (len(starts) == 1 or i + 1 - starts[-1] >= 2):
            starts.append(i + 1)
            peak = max(peak, c)
    return len(frames), starts, peak


def test_feature_against_plain_python(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    shots_found = 0
    for r in QUERIES["op3_media"](spark, "/root/testdata/sf0.001").collect():
        utf8 = (docs[r.doc_id] or "").encode()
        n, starts, peak = plain_feature(utf8.ljust(max(1, -(-len(utf8) // 192)) * 192))
        head, peak_text = r.feature.rsplit("peak=", 1)
        assert head == f"frames={n};shots={len(starts)};starts={','.join(map(str, starts))};"
        assert float(peak_text) == pytest.approx(peak, abs=6e-5)
        shots_found += len(starts) - 1
    assert shots_found > 0
