"""File formats that need no native library: bytes to samples and back, in numpy.

Each codec has decode(bytes) -> array (height, width, bands) and, where it can write,
encode(array) -> bytes. `tessella.sources.files` runs them on Spark."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np


class CodecError(ValueError):
    pass


#: Limits of a decode: sides and pixels.
MAX_SIDE, MAX_PIXELS = 32768, 256_000_000


def checked(h: int, w: int, bands: int = 1) -> None:
    if not (0 < w <= MAX_SIDE and 0 < h <= MAX_SIDE and w * h <= MAX_PIXELS and bands > 0):
        raise CodecError(f"an image of {w} x {h} x {bands} is outside the limits")


def _three(a: np.ndarray) -> np.ndarray:
    return a[:, :, None] if a.ndim == 2 else a


# ---------------------------------------------------------------- PNM and PFM


def _tokens(data: bytes, n: int, at: int) -> tuple[list[int], int]:
    out = []
    while len(out) < n:
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if not m:
            raise CodecError("a PNM header ends early")
        out.append(int(m[1]))
        at = m.end()
    return out, at


def pnm_decode(data: bytes) -> np.ndarray:
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise CodecError("no PNM file")
    bits, color, ascii_ = kind in (b"P1", b"P4"), kind in (b"P3", b"P6"), kind in (b"P1", b"P2", b"P3")
    head, at = _tokens(data, 2 if bits else 3, 2)
    w, h, bands = head[0], head[1], 3 if color else 1
    checked(h, w, bands)
    if ascii_:
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        v = np.array([int(x) for x in (re.findall(rb"[01]", body) if bits else body.split())][: w * h * bands])
        v = v.reshape(h, w, bands)
        return ((1 - v) * 255).astype(np.uint8) if bits else v.astype(np.uint8 if head[2] < 256 else np.uint16)
    body = data[at + 1 :]
    if bits:
        row = -(-w // 8)
        return ((1 - np.unpackbits(np.frombuffer(body[: row * h], np.uint8).reshape(h, row), axis=1)[:, :w]) * 255)[:, :, None].astype(np.uint8)
    kind_ = np.dtype(np.uint8) if head[2] < 256 else np.dtype(">u2")
    return np.frombuffer(body, kind_, w * h * bands).reshape(h, w, bands).astype(kind_.newbyteorder("="))


def pnm_encode(a: np.ndarray) -> bytes:
    a = _three(a)
    h, w, bands = a.shape
    top = 255 if a.dtype == np.uint8 else 65535
    return f"P{6 if bands == 3 else 5}\n{w} {h}\n{top}\n".encode() + a.astype(np.uint8 if top == 255 else ">u2").tobytes()


def pfm_decode(data: bytes) -> np.ndarray:
    m = re.match(rb"(PF|Pf)\s+(\d+)\s+(\d+)\s+(-?[\d.eE+]+)\s", data)
    if not m:
        raise CodecError("no PFM file")
    bands, w, h = 3 if m[1] == b"PF" else 1, int(m[2]), int(m[3])
    checked(h, w, bands)
    kind = "<f4" if float(m[4]) < 0 else ">f4"
    return np.frombuffer(data, kind, w * h * bands, m.end()).reshape(h, w, bands)[::-1].astype(np.float32)


def pfm_encode(a: np.ndarray) -> bytes:
    a = _three(a)
    return f"{'PF' if a.shape[2] == 3 else 'Pf'}\n{a.shape[1]} {a.shape[0]}\n-1.0\n".encode() + a[::-1].astype("<f4").tobytes()


# ---------------------------------------------------------------- text


def csv_decode(data: bytes) -> np.ndarray:
    """`#` begins a comment; `;`, `,` and tabs separate; a cell that is no number is 0."""

    def cell(x: str) -> float:
        try:
            return float(x)
        except ValueError:
            return 0.0

    rows = [[cell(x) for x in re.split(r"[;,\t]", line)] for line in data.decode().splitlines() if line.strip() and not line.lstrip().startswith("#")]
    width = max(map(len, rows))
    return np.array([r + [0.0] * (width - len(r)) for r in rows])[:, :, None]


def csv_encode(a: np.ndarray) -> bytes:
    return "".join("\t".join(f"{v:g}" if v == int(v) else repr(float(v)) for v in row) + "\n" for row in _three(a)[:, :, 0].astype(float)).encode()


def matrix_decode(data: bytes) -> np.ndarray:
    """`width height [scale [offset]]`, then rows; values are v / scale + offset."""
    lines = data.decode().strip().splitlines()
    head = [float(x) for x in lines[0].split()]
    w, h, scale, offset = int(head[0]), int(head[1]), *[*head[2:], *[1.0, 0.0][len(head) - 2 :]][:2]
    v = np.array(" ".join(lines[1:]).split(), float)[: w * h].reshape(h, w)
    return (v / scale + offset)[:, :, None]


def matrix_encode(a: np.ndarray, scale: float = 1.0, offset: float = 0.0) -> bytes:
    a = _three(a)[:, :, 0].astype(float)
    rows = "".join(" ".join(repr(float(v)) for v in row) + "\n" for row in (a - offset) * scale)
    return f"{a.shape[1]} {a.shape[0]} {scale:g} {offset:g}\n{rows}".encode()


# ---------------------------------------------------------------- PNG, BMP, TIFF


def png_encode(a: np.ndarray) -> bytes:
    a = _three(a)
    h, w, bands = a.shape
    deep = a.dtype != np.uint8
    raw = a.astype(">u2" if deep else np.uint8).reshape(h, -1)
    lines = b"".join(b"\0" + row.tobytes() for row in raw)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 16 if deep else 8, {1: 0, 2: 4, 3: 2, 4: 6}[bands], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def png_decode(data: bytes) -> np.ndarray:
    """Non-interlaced 8- and 16-bit grey and colour, and 8-bit palettes."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise CodecError("no PNG file")
    at, packed, palette = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, color, _, _, lace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    checked(h, w, bands)
    if lace or depth not in (8, 16):
        raise CodecError("this PNG variety is not read")
    size = bands * depth // 8
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * size)
    out = np.zeros((h + 1, w * size), np.int64)
    for y in range(h):
        f, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        up, row = out[y], out[y + 1]
        if f == 0:
            row[:] = line
        elif f == 2:
            row[:] = (line + up) & 255
        else:
            for i in range(len(line)):
                a, b, c = (row[i - size] if i >= size else 0), up[i], (up[i - size] if i >= size else 0)
                if f == 1:
                    p = a
                elif f == 3:
                    p = (a + b) // 2
                else:
                    e = a + b - c
                    p = min((abs(e - a), 0, a), (abs(e - b), 1, b), (abs(e - c), 2, c))[2]
                row[i] = (line[i] + p) & 255
    v = out[1:].astype(np.uint8)
    v = v.reshape(h, w, bands) if depth == 8 else v.tobytes() and np.frombuffer(v.tobytes(), ">u2").reshape(h, w, bands).astype(np.uint16)
    return palette[v[:, :, 0]] if color == 3 else v


def bmp_encode(a: np.ndarray) -> bytes:
    a = _three(a).astype(np.uint8)
    a = np.repeat(a, 3, 2) if a.shape[2] == 1 else a[:, :, :3]
    h, w, _ = a.shape
    pad = -(3 * w) % 4
    body = b"".join(row[:, ::-1].tobytes() + b"\0" * pad for row in a[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def bmp_decode(data: bytes) -> np.ndarray:
    if data[:2] != b"BM":
        raise CodecError("no BMP file")
    start = struct.unpack("<I", data[10:14])[0]
    w, h, _, bits, packing = struct.unpack("<iiHHI", data[18:34])
    checked(abs(h), w, 3)
    if packing or bits not in (24, 32):
        raise CodecError("this BMP variety is not read")
    n = bits // 8
    row = -(-w * n // 4) * 4
    v = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * n].reshape(abs(h), w, n)[:, :, :3][:, :, ::-1]
    return v[::-1] if h > 0 else v


_TIFF_KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def tiff_encode(a: np.ndarray, deflate: bool = False) -> bytes:
    """One strip, little-endian, plain or deflated."""
    a = _three(a)
    h, w, bands = a.shape
    body = a.astype(a.dtype.newbyteorder("<")).tobytes()
    body = zlib.compress(body) if deflate else body
    sample = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, a.dtype.itemsize * 8), (259, 3, 1, 8 if deflate else 1), (262, 3, 1, 2 if bands == 3 else 1), (273, 4, 1, 8), (277, 3, 1, bands), (278, 4, 1, h), (279, 4, 1, len(body)), (284, 3, 1, 1), (339, 3, 1, sample)]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0" * 4
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + ifd


def tiff_pages(data: bytes) -> list[np.ndarray]:
    """All pages whose strips are plain or deflated."""
    e = {b"II": "<", b"MM": ">"}.get(data[:2])
    if e is None or struct.unpack(e + "H", data[2:4])[0] != 42:
        raise CodecError("no TIFF file")
    at, out = struct.unpack(e + "I", data[4:8])[0], []
    while at:
        n, tags = struct.unpack(e + "H", data[at : at + 2])[0], {}
        for i in range(n):
            tag, kind, count, _ = struct.unpack(e + "HHII", data[at + 2 + 12 * i : at + 14 + 12 * i])
            one = {1: "B", 3: "H", 4: "I"}.get(kind)
            if one:
                size = struct.calcsize(one) * count
                place = at + 10 + 12 * i
                place = struct.unpack(e + "I", data[place : place + 4])[0] if size > 4 else place
                tags[tag] = struct.unpack(e + one * count, data[place : place + size])
        w, h, bands = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
        checked(h, w, bands)
        packing = tags.get(259, (1,))[0]
        if packing not in (1, 8, 32946) or tags.get(317, (1,))[0] != 1 or tags.get(284, (1,))[0] != 1:
            raise CodecError("this TIFF variety is not read")
        body = b"".join(zlib.decompress(data[o : o + k]) if packing != 1 else data[o : o + k] for o, k in zip(tags[273], tags[279], strict=True))
        kind = np.dtype(e + _TIFF_KINDS[tags.get(339, (1,))[0], tags.get(258, (8,))[0]])
        out.append(np.frombuffer(body, kind, w * h * bands).reshape(h, w, bands).astype(kind.newbyteorder("=")))
        at = struct.unpack(e + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    return out


def tiff_decode(data: bytes) -> np.ndarray:
    return tiff_pages(data)[0]


# ---------------------------------------------------------------- Radiance, FITS, Analyze, NIfTI, MAT, raw


def radiance_encode(a: np.ndarray) -> bytes:
    """Linear RGB as flat RGBE."""
    a = _three(a).astype(float)[:, :, :3]
    top = a.max(2)
    e = np.where(top > 1e-32, np.floor(np.log2(np.maximum(top, 1e-38))) + 1, -128)
    m = np.where((top > 1e-32)[:, :, None], a * (255.9999 * 2.0 ** -e)[:, :, None], 0)
    return f"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y {a.shape[0]} +X {a.shape[1]}\n".encode() + np.dstack([np.clip(m, 0, 255), e + 128]).astype(np.uint8).tobytes()


def radiance_decode(data: bytes) -> np.ndarray:
    m = re.search(rb"\n\n-Y (\d+) \+X (\d+)\n", data)
    if data[:2] != b"#?" or not m:
        raise CodecError("no Radiance file")
    h, w = int(m[1]), int(m[2])
    checked(h, w, 3)
    at, rows = m.end(), []
    for _ in range(h):
        if 8 <= w < 32768 and data[at : at + 2] == b"\2\2" and struct.unpack(">H", data[at + 2 : at + 4])[0] == w:
            at, line = at + 4, []
            for _ in range(4):
                part = bytearray()
                while len(part) < w:
                    n = data[at]
                    part += data[at + 1 : at + 2] * (n - 128) if n > 128 else data[at + 1 : at + 1 + n]
                    at += 2 if n > 128 else 1 + n
                line.append(np.frombuffer(bytes(part), np.uint8))
            rows.append(np.stack(line, 1))
        else:
            rows.append(np.frombuffer(data, np.uint8, 4 * w, at).reshape(w, 4))
            at += 4 * w
    v = np.stack(rows).astype(float)
    return np.where(v[:, :, 3:] > 0, (v[:, :, :3] + 0.5) * 2.0 ** (v[:, :, 3:] - 136), 0.0).astype(np.float32)


_FITS = {8: ">u1", 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}


def fits_encode(a: np.ndarray) -> bytes:
    a = _three(a)
    bits = {"uint8": 8, "int16": 16, "int32": 32, "float32": -32, "float64": -64}[str(a.dtype)]
    h, w, bands = a.shape
    cards = ["SIMPLE  =                    T", f"BITPIX  = {bits:20d}", f"NAXIS   = {3:20d}", f"NAXIS1  = {w:20d}", f"NAXIS2  = {h:20d}", f"NAXIS3  = {bands:20d}", "END"]
    head = "".join(x.ljust(80) for x in cards).encode()
    body = np.ascontiguousarray(a[::-1].transpose(2, 0, 1)).astype(_FITS[bits]).tobytes()
    return head.ljust(-(-len(head) // 2880) * 2880) + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


def fits_decode(data: bytes) -> np.ndarray:
    if data[:6] != b"SIMPLE":
        raise CodecError("no FITS file")
    cards, at = {}, 0
    while True:
        card = data[at : at + 80].decode("ascii")
        at += 80
        if card.startswith("END") or not card:
            break
        if card[8:10] == "= ":
            cards[card[:8].strip()] = card[10:].split("/")[0].strip()
    at = -(-at // 2880) * 2880
    n = [int(cards[f"NAXIS{i + 1}"]) for i in range(int(cards["NAXIS"]))] + [1, 1]
    checked(n[1], n[0], n[2])
    kind = np.dtype(_FITS[int(cards["BITPIX"])])
    v = np.frombuffer(data, kind, n[0] * n[1] * n[2], at).reshape(n[2], n[1], n[0]).transpose(1, 2, 0)[::-1]
    return v.astype(kind.newbyteorder("="))


_NIFTI = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 512: "u2", 768: "u4"}


def nifti_encode(a: np.ndarray) -> bytes:
    a = _three(a)
    code = next(k for k, v in _NIFTI.items() if np.dtype(v) == a.dtype)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, a.shape[1], a.shape[0], a.shape[2], 1, 1, 1, 1)
    struct.pack_into("<hh", head, 70, code, a.dtype.itemsize * 8)
    struct.pack_into("<f", head, 108, 352.0)
    head[344:348] = b"n+1\0"
    return bytes(head) + np.ascontiguousarray(a.transpose(2, 0, 1)).astype(a.dtype.newbyteorder("<")).tobytes()


def nifti_decode(data: bytes) -> np.ndarray:
    e = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    if struct.unpack(e + "i", data[:4])[0] != 348 or data[344:347] not in (b"n+1", b"ni1"):
        raise CodecError("no NIfTI file")
    dim = struct.unpack(e + "8h", data[40:56])
    w, h, bands = dim[1], max(1, dim[2]), max(1, dim[3]) if dim[0] > 2 else 1
    checked(h, w, bands)
    kind = np.dtype(e + _NIFTI[struct.unpack(e + "h", data[70:72])[0]])
    return np.frombuffer(data, kind, w * h * bands, int(struct.unpack(e + "f", data[108:112])[0])).reshape(bands, h, w).transpose(1, 2, 0).astype(kind.newbyteorder("="))


def analyze_encode(a: np.ndarray) -> tuple[bytes, bytes]:
    """Header (348 bytes, big-endian) and samples."""
    a = _three(a)
    code = {"uint8": 2, "int16": 4, "int32": 8, "float32": 16, "float64": 64}[str(a.dtype)]
    head = bytearray(348)
    struct.pack_into(">i", head, 0, 348)
    struct.pack_into(">8h", head, 40, 3, a.shape[1], a.shape[0], a.shape[2], 1, 1, 1, 1)
    struct.pack_into(">hh", head, 70, code, a.dtype.itemsize * 8)
    return bytes(head), np.ascontiguousarray(a.transpose(2, 0, 1)).astype(a.dtype.newbyteorder(">")).tobytes()


def analyze_decode(head: bytes, body: bytes) -> np.ndarray:
    if struct.unpack(">i", head[:4])[0] != 348:
        raise CodecError("no Analyze header")
    dim = struct.unpack(">8h", head[40:56])
    w, h, bands = dim[1], max(1, dim[2]), max(1, dim[3])
    checked(h, w, bands)
    kind = np.dtype(">" + _NIFTI[struct.unpack(">h", head[70:72])[0]])
    return np.frombuffer(body, kind, w * h * bands).reshape(bands, h, w).transpose(1, 2, 0).astype(kind.newbyteorder("="))


_MAT = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8"}


def mat_decode(data: bytes) -> np.ndarray:
    """The first numeric matrix of a version 5 file."""
    if data[:6] != b"MATLAB":
        raise CodecError("no MAT 5 file")
    e = "<" if data[126:128] == b"IM" else ">"

    def element(d: bytes, at: int) -> tuple[int, bytes, int]:
        kind, n = struct.unpack(e + "II", d[at : at + 8])
        if kind >> 16:
            return kind & 0xFFFF, d[at + 4 : at + 4 + (kind >> 16)], at + 8
        return kind, d[at + 8 : at + 8 + n], at + 8 + -(-n // 8) * 8

    at = 128
    while at < len(data):
        kind, body, at = element(data, at)
        if kind == 15:
            kind, body, _ = element(zlib.decompress(body), 0)
        if kind != 14:
            continue
        _, _, p = element(body, 0)
        _, dims, p = element(body, p)
        shape = struct.unpack(e + f"{len(dims) // 4}i", dims)
        _, _, p = element(body, p)
        sort, raw, _ = element(body, p)
        if sort in _MAT:
            checked(shape[0], shape[1], shape[2] if len(shape) > 2 else 1)
            return _three(np.frombuffer(raw, e + _MAT[sort]).reshape(shape, order="F").astype(np.dtype(_MAT[sort])))
    raise CodecError("the MAT file holds no matrix")


def mat_encode(a: np.ndarray, name: str = "image") -> bytes:
    """A version 5 file, little-endian, of one matrix."""
    a = _three(a)
    code = next(k for k, v in _MAT.items() if np.dtype(v) == a.dtype)
    # Array classes of the element types above.
    kind = {1: 8, 2: 9, 3: 10, 4: 11, 5: 12, 6: 13, 7: 7, 9: 6}[code]

    def element(sort: int, body: bytes) -> bytes:
        return struct.pack("<II", sort, len(body)) + body.ljust(-(-len(body) // 8) * 8, b"\0")

    shape = a.shape if a.shape[2] > 1 else a.shape[:2]
    parts = [element(6, struct.pack("<II", kind, 0)), element(5, struct.pack(f"<{len(shape)}i", *shape)), element(1, name.encode()), element(code, np.asfortranarray(a.reshape(shape)).tobytes(order="F"))]
    head = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    return head + element(14, b"".join(parts))


def analyze_join(a: np.ndarray) -> bytes:
    """Header and samples of an Analyze image in one piece, as `analyze_split` reads it."""
    return b"".join(analyze_encode(a))


def analyze_split(data: bytes) -> np.ndarray:
    return analyze_decode(data[:348], data[348:])


def raw_decode(data: bytes, width: int, height: int, bands: int, dtype: str = "u1") -> np.ndarray:
    """Headerless samples; the data type names size and byte order."""
    checked(height, width, bands)
    return np.frombuffer(data, dtype, width * height * bands).reshape(height, width, bands).astype(np.dtype(dtype).newbyteorder("="))


def raw_encode(a: np.ndarray, dtype: str | None = None) -> bytes:
    return _three(a).astype(dtype or a.dtype).tobytes()


# Band formats of the 64-byte native header.
_NATIVE = {0: "u1", 1: "i1", 2: "u2", 3: "i2", 4: "u4", 5: "i4", 6: "f4", 8: "f8"}


def native_encode(a: np.ndarray) -> bytes:
    a = _three(a)
    code = next(k for k, v in _NATIVE.items() if np.dtype(v) == a.dtype)
    return struct.pack("<9i2f2i", 0x08F2A6B6, a.shape[1], a.shape[0], a.shape[2], 0, code, 0, 0, 1, 1.0, 1.0, 0, 0).ljust(64, b"\0") + a.astype(a.dtype.newbyteorder("<")).tobytes()


def native_decode(data: bytes) -> np.ndarray:
    for e in "<>":
        magic, w, h, bands, _, code = struct.unpack(e + "6i", data[:24])
        if magic == 0x08F2A6B6:
            checked(h, w, bands)
            return np.frombuffer(data, e + _NATIVE[code], w * h * bands, 64).reshape(h, w, bands).astype(_NATIVE[code])
    raise CodecError("no native file")


#: By name: first bytes, extensions, decode, encode.
REGISTRY = {
    "png": (b"\x89PNG", ("png",), png_decode, png_encode), "bmp": (b"BM", ("bmp",), bmp_decode, bmp_encode), "tiff": (b"II*\0", ("tif", "tiff"), tiff_decode, tiff_encode),
    "radiance": (b"#?", ("hdr",), radiance_decode, radiance_encode), "pfm": (b"PF", ("pfm",), pfm_decode, pfm_encode), "fits": (b"SIMPLE", ("fits", "fit"), fits_decode, fits_encode),
    "pnm": (b"P", ("pnm", "pbm", "pgm", "ppm"), pnm_decode, pnm_encode), "csv": (None, ("csv",), csv_decode, csv_encode), "matrix": (None, ("mat.txt", "matrix"), matrix_decode, matrix_encode),
    "mat": (b"MATLAB", ("mat",), mat_decode, mat_encode), "nifti": (None, ("nii",), nifti_decode, nifti_encode), "native": (None, ("v",), native_decode, native_encode),
    "analyze": (None, ("hdr.img",), analyze_split, analyze_join),
}


def sniff(path: str, data: bytes) -> str:
    """The format by first bytes, else by the path's extension."""
    if data[:4] == b"MM\0*":
        return "tiff"
    if data[:2] == b"Pf":
        return "pfm"
    for name, (magic, _, _, _) in REGISTRY.items():
        if magic and data.startswith(magic) and (name != "pnm" or data[1:2] in b"123456"):
            return name
    for name, (_, ends, _, _) in REGISTRY.items():
        if path.lower().endswith(tuple(f".{x}" for x in ends)):
            return name
    raise CodecError(f"no format known for {path}")


def decode(path: str, data: bytes) -> np.ndarray:
    return REGISTRY[sniff(path, data)][2](data)
