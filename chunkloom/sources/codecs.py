"""Byte streams: compression, checksums, and the binary layouts of objects.

Only what the standard library, numpy and zstandard can decode is supported; image
codecs that need other libraries are refused by name.
"""

from __future__ import annotations

import gzip
import io
import lzma
import struct
import zlib
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np

from chunkloom.sources import sparse


class Unsupported(ValueError):
    """A codec that needs a library which is not there."""


def _zstd():
    import zstandard

    return zstandard


def _unzstd(data: bytes) -> bytes:
    if _zstd().frame_content_size(data) > 0:  # at once, where the frame tells its size
        return _zstd().ZstdDecompressor().decompress(data)
    return _zstd().ZstdDecompressor().stream_reader(io.BytesIO(data)).read()


def _gunzip(data: bytes) -> bytes:
    """At once into as many bytes as the end tells; files of several members one by one."""
    size = int.from_bytes(data[-4:], "little")
    if len(data) < 18 or not len(data) <= size <= len(data) * 1032:  # what deflate can reach
        return gzip.decompress(data)
    if data.find(b"\x1f\x8b\x08", 1) >= 0:  # another member perhaps
        return gzip.decompress(data)
    try:
        out = zlib.decompress(data, 31, size)
    except zlib.error:
        return gzip.decompress(data)
    return out if len(out) == size else gzip.decompress(data)


#: name -> (compress, decompress)
STREAMS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "": (bytes, bytes),
    "raw": (bytes, bytes),
    "gzip": (lambda d: gzip.compress(d, mtime=0), _gunzip),
    "zlib": (zlib.compress, zlib.decompress),
    "zstd": (lambda d: _zstd().ZstdCompressor().compress(d), _unzstd),
    "xz": (lzma.compress, lzma.decompress),
}
#: Other names of the same streams, and the suffixes of compressed objects.
ALIASES = {"gz": "gzip", "lzma": "xz", "none": "", None: ""}
SUFFIXES = {".gz": "gzip", ".zstd": "zstd", ".br": "br"}


def stream(name: str | None) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    name = ALIASES.get(name, name)
    if name not in STREAMS:
        raise Unsupported(f"compression {name!r}")
    return STREAMS[name]


#: Data count as sparse where at most one value in so many is not the background.
SPARSE = 32


def packed(name: str | None, data: bytes, sparse: bool = False) -> bytes:
    """Compressed by a stream.  In sparse data runs of one byte are all there is to find, so
    zlib looks for nothing else, which is faster and not larger."""
    bits = {"gzip": 31, "zlib": 15}.get(ALIASES.get(name, name))
    if not sparse or bits is None:
        return stream(name)[0](data)
    z = zlib.compressobj(6, zlib.DEFLATED, bits, 9, zlib.Z_RLE)
    return z.compress(data) + z.flush()


def repacked(data: bytes, before: str | None, after: str | None) -> bytes:
    """Compressed bytes under another stream; under the same they are taken over as they are."""
    return all_repacked([data], before, after)[0]


def all_repacked(data: Sequence[bytes], before: str | None, after: str | None) -> list[bytes]:
    """The same for many; sparse ones are made anew together, without their zeros."""
    if stream(before) is stream(after):
        return list(data)
    before, name = ALIASES.get(before, before), ALIASES.get(after, after)
    out: list[bytes | None] = [None] * len(data)
    short = [k for k, d in enumerate(data) if sparse.told(before, d)] if name in ("gzip", "zlib", "zstd") else []
    found = sparse.expanded(before, [data[k] for k in short]) if short else []
    known = [(k, f) for k, f in zip(short, found) if f and len(f[1]) * 1024 <= f[0]]
    if known:
        owner = np.repeat(np.arange(len(known)), [len(f[1]) for _, f in known])
        places, byte = (np.concatenate([f[i] for _, f in known]) for i in (1, 2))
        for (k, _), d in zip(known, sparse.compressed(name, np.array([f[0] for _, f in known]), owner, places, byte[:, None])):
            out[k] = d
    for k, d in enumerate(data):
        if out[k] is None:
            raw = stream(before)[1](d)
            out[k] = packed(after, raw, len(d) * SPARSE < len(raw))
    return out


def suffix_of(compress: str | None) -> str:
    return {"gzip": ".gz", "zstd": ".zstd"}.get(ALIASES.get(compress, compress) or "", "")


def normalized_compression(compress, encoding: str) -> str:
    """'auto': none for image codecs, else gzip; True is gzip."""
    if compress == "auto":
        return "" if encoding in ("jpeg", "png", "jxl") else "gzip"
    return "gzip" if compress is True else (compress or "")


def _crc_table() -> np.ndarray:
    """What one byte of the remainder adds, for each of its values."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> 1) ^ np.where(out & 1, np.uint32(0x82F63B78), np.uint32(0))
    return out.astype(np.uint32)


_CRC = _crc_table()
#: Bytes that are looked up at once.
_BLOCK = 1024


def _applied(operator: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Remainders after a linear step, given as the images of each value of the four bytes."""
    byte = [c >> np.uint32(8 * k) & np.uint32(0xFF) for k in range(4)]
    return operator[0][byte[0]] ^ operator[1][byte[1]] ^ operator[2][byte[2]] ^ operator[3][byte[3]]


@lru_cache(256)
def _zero_bytes(n: int) -> np.ndarray:
    """The linear step that ``n`` zero bytes make, a power of two, by repeated squaring."""
    unit = np.arange(256, dtype=np.uint32)[None] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    if n == 1:
        return _CRC[unit & np.uint32(0xFF)] ^ (unit >> np.uint32(8))
    half = _zero_bytes(n // 2)
    return _applied(half, half)


@lru_cache(1)
def _by_place() -> np.ndarray:
    """What a byte in a block adds to the remainder, for each place and value."""
    out = np.empty((_BLOCK, 256), np.uint32)
    out[-1] = _CRC
    for k in range(_BLOCK - 2, -1, -1):
        out[k] = _CRC[out[k + 1] & np.uint32(0xFF)] ^ (out[k + 1] >> np.uint32(8))
    return out


def crc32c(data: bytes) -> int:
    """Castagnoli's checksum, which is not the crc32 of zlib.

    The checksum is linear: what the bytes of a block add is looked up by their place, and
    the blocks are joined from the left, each remainder moved past the next block.
    """
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < 4:
        c = 0xFFFFFFFF
        for byte in raw.tolist():
            c = int(_CRC[(c ^ byte) & 0xFF]) ^ (c >> 8)
        return c ^ 0xFFFFFFFF
    blocks = -(-len(raw) // _BLOCK)
    full = np.zeros(blocks * _BLOCK, np.uint8)  # zeros in front leave no trace
    start = len(full) - len(raw)
    full[start:] = raw
    full[start : start + 4] ^= np.uint8(0xFF)  # the register begins with all bits set
    table, places, step, c = _by_place(), np.arange(_BLOCK), _zero_bytes(_BLOCK), 0
    for block in full.reshape(blocks, _BLOCK):
        c = int(np.bitwise_xor.reduce(table[places, block])) ^ int(step[0][c & 255] ^ step[1][c >> 8 & 255] ^ step[2][c >> 16 & 255] ^ step[3][c >> 24])
    return c ^ 0xFFFFFFFF


# --- chunk encodings ------------------------------------------------------------


def encode_chunk(a: np.ndarray, encoding: str, block: Sequence[int] = (8, 8, 8), sparse: bool = False) -> bytes:
    """(x, y, z, c) voxels to bytes, x fastest."""
    if encoding == "raw":
        return a.tobytes("F")
    if encoding == "npz":
        out = io.BytesIO()
        np.save(out, a, allow_pickle=False)
        return zlib.compress(out.getvalue())
    if encoding == "npz_uint8":  # images between 0 and 1; read back as bytes
        return encode_chunk((a * 255).astype(np.uint8), "npz", block)
    if encoding == "png":
        return encode_png(_as_image(a), sparse=sparse)
    if encoding == "compressed_segmentation":
        return _segmentation_bytes(a, block)
    raise Unsupported(f"encoding {encoding!r}")


def decode_chunk(data: bytes, encoding: str, shape: Sequence[int], dtype: np.dtype, block: Sequence[int] = (8, 8, 8)) -> np.ndarray:
    if encoding == "raw":
        return np.frombuffer(data, dtype=dtype).reshape(shape, order="F")
    if encoding == "png":
        return _from_image(decode_png(data), shape).astype(dtype)
    if encoding in ("npz", "npz_uint8"):
        return np.load(io.BytesIO(zlib.decompress(data)), allow_pickle=False).reshape(shape)
    if encoding == "compressed_segmentation":
        return _segmentation_array(data, shape, dtype, block)
    raise Unsupported(f"encoding {encoding!r}")


def _as_image(a: np.ndarray) -> np.ndarray:
    """(rows, columns, channels): x along the rows' length, then y, then z down the image."""
    return a.reshape(a.shape[0], a.shape[1] * a.shape[2], a.shape[3], order="F").transpose(1, 0, 2)


def _from_image(image: np.ndarray, shape: Sequence[int]) -> np.ndarray:
    return image.reshape(-1, shape[3]).reshape(shape, order="F") if image.size == np.prod(shape) else _mismatch(image.shape, shape)


def _mismatch(a, b):
    raise ValueError(f"an image of {tuple(a)} for a chunk of {tuple(b)}")


#: Signature and colour types of PNG by number of channels.
PNG_SIGNATURE, PNG_COLOURS = b"\x89PNG\r\n\x1a\n", {1: 0, 2: 4, 3: 2, 4: 6}


def png_file(columns: int, rows: int, depth: int, channels: int, body: bytes) -> bytes:
    """A PNG around its compressed lines."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", columns, rows, depth, PNG_COLOURS[channels], 0, 0, 0)
    return PNG_SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def png_body(data: bytes, columns: int, rows: int) -> bytes | None:
    """The compressed lines of a gray PNG of 8 bits, if it has this size and one piece of data."""
    if data[:33] != png_file(columns, rows, 8, 1, b"")[:33] or data[37:41] != b"IDAT":
        return None
    (n,) = struct.unpack_from(">I", data, 33)
    return data[41 : 41 + n] if len(data) == 41 + n + 16 else None


def encode_png(image: np.ndarray, level: int = 6, sparse: bool = False) -> bytes:
    """(rows, columns, channels) of 8 or 16 bits as a PNG, every line as it is."""
    if image.dtype not in (np.uint8, np.uint16) or image.shape[2] not in PNG_COLOURS:
        raise Unsupported(f"PNG of {image.dtype} with {image.shape[2]} channels")
    rows, columns, channels = image.shape
    lines = np.ascontiguousarray(image.astype(image.dtype.newbyteorder(">"))).view(np.uint8).reshape(rows, -1)
    body = np.zeros((rows, lines.shape[1] + 1), np.uint8)  # a filter byte in front of each line
    body[:, 1:] = lines
    return png_file(columns, rows, 8 * image.dtype.itemsize, channels, packed("zlib", body.tobytes(), True) if sparse else zlib.compress(body.tobytes(), level))


def decode_png(data: bytes) -> np.ndarray:
    """(rows, columns, channels) of a PNG of 8 or 16 bits without palette or interlacing."""
    if not data.startswith(PNG_SIGNATURE):
        raise ValueError("not a PNG")
    at, head, body = 8, b"", b""
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        head, body = part if kind == b"IHDR" else head, body + part if kind == b"IDAT" else body
        at += 12 + n
    columns, rows, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    channels = {v: k for k, v in PNG_COLOURS.items()}.get(colour)
    if channels is None or depth not in (8, 16) or interlaced:
        raise Unsupported("PNG with a palette, interlacing or fewer than 8 bits")
    step = channels * depth // 8
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(rows, columns * step + 1)
    out, up = np.zeros((rows, columns * step), np.uint8), np.zeros(columns * step, np.uint8)
    out[:] = lines[:, 1:]
    for r in range(rows if lines[:, 0].any() else 0):  # else every line is as it is
        out[r] = up = _unfiltered(int(lines[r, 0]), lines[r, 1:], up, step)
    kind = np.dtype(">u2") if depth == 16 else np.dtype(np.uint8)
    return out.view(kind).astype(kind.newbyteorder("=")).reshape(rows, columns, channels)


def _unfiltered(how: int, line: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    """A line of a PNG from its filtered bytes and the line above."""
    if how == 0:
        return line
    if how == 2:
        return line + up
    if how == 1:  # sums of every step-th byte
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    out = np.zeros(len(line) + step, np.int64)  # the byte to the left of the first pixel is 0
    above = np.concatenate([np.zeros(step, np.int64), up.astype(np.int64)])
    for i, v in enumerate(line.tolist()):
        left, top, corner = out[i], above[i + step], above[i]
        if how == 3:
            guess = (left + top) // 2
        else:
            near = left + top - corner
            guess = min((abs(near - left), 0, left), (abs(near - top), 1, top), (abs(near - corner), 2, corner))[2]
        out[i + step] = (v + guess) & 255
    return out[step:].astype(np.uint8)


#: The widths an encoded value may have.
WIDTHS = (0, 1, 2, 4, 8, 16, 32)


#: Blocks of at most this many labels are encoded together.
FEW_LABELS = 16


def _blocks(v: np.ndarray, block: Sequence[int]) -> np.ndarray:
    """The values of each block as a row, x fastest; a cut block is filled up with its first value."""
    grid = [-(-n // b) for n, b in zip(v.shape, block)]
    whole = v
    if any(g * b != n for g, b, n in zip(grid, block, v.shape)):
        first = v[:: block[0], :: block[1], :: block[2]]
        whole = np.zeros([g * b for g, b in zip(grid, block)], v.dtype, order="F")
        whole[: v.shape[0], : v.shape[1], : v.shape[2]] = v
        for d, n in enumerate(v.shape):
            if grid[d] * block[d] != n:
                rim = tuple(slice(n, None) if k == d else slice(None) for k in range(3))
                for_rim = first
                for k in range(3):
                    for_rim = np.repeat(for_rim, block[k], axis=k)
                whole[rim] = for_rim[rim]
    cells = whole.transpose(2, 1, 0).reshape(grid[2], block[2], grid[1], block[1], grid[0], block[0])
    return cells.transpose(0, 2, 4, 1, 3, 5).reshape(-1, int(np.prod(block)))


def _packed_words(index: np.ndarray, bits: int) -> np.ndarray:
    """Rows of indices as rows of words."""
    per = 32 // bits
    padded = np.zeros((len(index), -(-index.shape[1] // per) * per), np.uint32)
    padded[:, : index.shape[1]] = index
    return np.bitwise_or.reduce(padded.reshape(len(index), -1, per) << (np.arange(per, dtype=np.uint32) * np.uint32(bits)), axis=2)


def _segmentation_bytes(a: np.ndarray, block: Sequence[int]) -> bytes:
    """Per block a table of its labels and packed indices into it, all as uint32 words.

    Blocks of few labels are encoded together, those of more one by one.
    """
    channels = []
    for c in range(a.shape[3]):
        cells = _blocks(a[..., c], block)
        head = np.zeros((len(cells), 2), np.uint32)
        coded: list[tuple[bytes, int, np.ndarray | None]] = [(b"", 0, None)] * len(cells)
        single = (cells == cells[:, :1]).all(axis=1)
        for k, label in zip(np.flatnonzero(single).tolist(), cells[single, 0]):
            coded[k] = (label.tobytes(), 0, None)
        mixed = np.flatnonzero(~single)
        for some in np.array_split(mixed, -(-len(mixed) // 1024)) if len(mixed) else ():
            part = cells[some]
            ranked = np.sort(part, axis=1)
            fresh = np.ones(ranked.shape, bool)
            fresh[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
            counts = fresh.sum(axis=1)
            labels, ends = ranked[fresh], np.cumsum(counts)
            for low, w in zip(WIDTHS, WIDTHS[1:]):
                mine = np.flatnonzero((counts > 1 << low) & (counts <= min(1 << w, FEW_LABELS)))
                if not len(mine):
                    continue
                index = np.zeros((len(mine), part.shape[1]), np.uint8)
                for j in range(1, int(counts[mine].max())):
                    has = np.flatnonzero(counts[mine] > j)
                    rows = mine[has]
                    index[has] += part[rows] >= labels[ends[rows] - counts[rows] + j][:, None]
                for k, words in zip(mine.tolist(), _packed_words(index, w)):
                    coded[some[k]] = (labels[ends[k] - counts[k] : ends[k]].tobytes(), w, words)
            for k in np.flatnonzero(counts > FEW_LABELS).tolist():
                table, index = np.unique(part[k], return_inverse=True)
                w = next(w for w in WIDTHS if 2**w >= len(table))
                coded[some[k]] = (table.tobytes(), w, _packed_words(index.reshape(1, -1), w)[0])
        words: list[np.ndarray] = []
        at, tables = 2 * len(head), {}
        for k, (key, bits, index) in enumerate(coded):
            start = at
            if index is not None:
                words.append(index)
                at += len(index)
            if key not in tables:
                tables[key] = at
                words.append(np.frombuffer(key, np.uint32))
                at += len(key) // 4
            head[k] = tables[key] | (bits << 24), start
        channels.append(np.concatenate([head.reshape(-1), *words]).astype("<u4"))
    offsets, at = [], len(channels)
    for w in channels:
        offsets.append(at)
        at += len(w)
    return np.array(offsets, "<u4").tobytes() + b"".join(w.tobytes() for w in channels)


def _segmentation_array(data: bytes, shape: Sequence[int], dtype: np.dtype, block: Sequence[int]) -> np.ndarray:
    words = np.frombuffer(data, "<u4")
    dtype = np.dtype(dtype)
    out = np.zeros(shape, dtype, order="F")
    n, wide = int(np.prod(block)), dtype.itemsize // 4
    for c in range(shape[3]):
        w = words[words[c] :]
        grid = [-(-s // b) for s, b in zip(shape[:3], block)]
        head = w[: 2 * int(np.prod(grid))].astype(np.int64).reshape(-1, 2)
        bits, at, start = head[:, 0] >> 24, head[:, 0] & 0xFFFFFF, head[:, 1]

        def looked_up(place: np.ndarray) -> np.ndarray:
            if wide == 1:
                return w[place].view(dtype)
            return np.ascontiguousarray(np.stack([w[place + j] for j in range(wide)], axis=-1)).view(dtype)[..., 0]

        cells = np.empty((len(head), n), dtype)
        for width in np.unique(bits).tolist():
            mine = np.flatnonzero(bits == width)
            if not width:
                cells[mine] = looked_up(at[mine])[:, None]
                continue
            per = 32 // width
            for some in np.array_split(mine, -(-len(mine) // 1024)):
                packed = w[start[some][:, None] + np.arange(-(-n // per))]
                mask = np.uint32(2**width - 1)
                index = ((packed[:, :, None] >> (np.arange(per, dtype=np.uint32) * np.uint32(width))) & mask).reshape(len(some), -1)[:, :n]
                cells[some] = looked_up(at[some][:, None] + index.astype(np.int64) * wide)
        whole = cells.reshape(*grid[::-1], *block[::-1]).transpose(0, 3, 1, 4, 2, 5).reshape([g * b for g, b in zip(grid[::-1], block[::-1])]).transpose(2, 1, 0)
        out[..., c] = whole[: shape[0], : shape[1], : shape[2]]
    return out


# --- annotations ------------------------------------------------------------------

#: Numpy types of annotation properties.
PROPERTY_TYPES = {"uint8": "<u1", "int8": "<i1", "uint16": "<u2", "int16": "<i2", "uint32": "<u4", "int32": "<i4", "float32": "<f4", "rgb": "3u1", "rgba": "4u1"}


def annotation_dtype(points: int, properties: Sequence[tuple[str, str]]) -> np.dtype:
    """One record: points, properties by falling size, padding to four bytes."""
    fields: list[tuple] = [(f"_pt{i + 1}", "<f4", (3,)) for i in range(points)]
    fields += [(n, PROPERTY_TYPES[t]) for n, t in properties]
    size = np.dtype(fields).itemsize
    if size % 4:
        fields.append(("_pad", f"V{4 - size % 4}"))
    return np.dtype(fields)


def encode_annotations(records: np.ndarray, ids: np.ndarray) -> bytes:
    return struct.pack("<Q", len(records)) + records.tobytes() + ids.astype("<u8").tobytes()


def decode_annotations(data: bytes, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<Q", data)
    end = 8 + n * dtype.itemsize
    if len(data) != end + 8 * n:
        raise ValueError("length does not match the number of annotations")
    return np.frombuffer(data[8:end], dtype), np.frombuffer(data[end:], "<u8")


def encode_annotation(record: np.ndarray, related: Sequence[Sequence[int]]) -> bytes:
    return record.tobytes() + b"".join(struct.pack("<I", len(r)) + np.array(r, "<u8").tobytes() for r in related)


def decode_annotation(data: bytes, dtype: np.dtype, relations: int) -> tuple[np.void, list[np.ndarray]]:
    record, at, out = np.frombuffer(data, dtype, 1)[0], dtype.itemsize, []
    for _ in range(relations):
        (n,) = struct.unpack_from("<I", data, at)
        out.append(np.frombuffer(data, "<u8", n, at + 4))
        at += 4 + 8 * n
    if at != len(data):
        raise ValueError("bytes left over")
    return record, out


# --- meshes and skeletons -----------------------------------------------------------


def encode_mesh(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    return struct.pack("<I", len(vertices)) + vertices.astype("<f4").tobytes() + faces.astype("<u4").tobytes()


def decode_mesh(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<I", data)
    if (len(data) - 4 - 12 * n) % 12:
        raise ValueError("not a mesh")
    return np.frombuffer(data, "<f4", 3 * n, 4).reshape(-1, 3), np.frombuffer(data[4 + 12 * n :], "<u4").reshape(-1, 3)


def encode_obj(vertices: np.ndarray, faces: np.ndarray) -> str:
    return "".join(f"v {x:.5f} {y:.5f} {z:.5f}\n" for x, y, z in vertices) + "".join(f"f {a} {b} {c}\n" for a, b, c in faces.astype(np.int64) + 1)


def decode_obj(text: str) -> tuple[np.ndarray, np.ndarray]:
    v, f = [], []
    for line in text.splitlines():
        part = line.split()
        if part[:1] == ["v"]:
            v.append([float(x) for x in part[1:4]])
        elif part[:1] == ["f"]:
            f.append([int(x.split("/")[0]) - 1 for x in part[1:4]])
    return np.array(v, np.float32).reshape(-1, 3), np.array(f, np.uint32).reshape(-1, 3)


def encode_ply(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(vertices)}\nproperty float x\nproperty float y\nproperty float z\nelement face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n"
    rows = np.zeros(len(faces), [("n", "u1"), ("v", "<i4", (3,))])
    rows["n"], rows["v"] = 3, faces
    return head.encode() + vertices.astype("<f4").tobytes() + rows.tobytes()


def decode_ply(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    head, body = data.split(b"end_header\n", 1)
    n, m = (int(line.split()[2]) for line in head.decode().splitlines() if line.startswith("element"))
    rows = np.frombuffer(body, [("n", "u1"), ("v", "<i4", (3,))], m, 12 * n)
    return np.frombuffer(body, "<f4", 3 * n).reshape(-1, 3), rows["v"].astype(np.uint32)


def encode_skeleton(vertices: np.ndarray, edges: np.ndarray, attributes: Sequence[tuple[str, np.ndarray]] = ()) -> bytes:
    out = struct.pack("<II", len(vertices), len(edges)) + vertices.astype("<f4").tobytes() + edges.astype("<u4").tobytes()
    return out + b"".join(a.astype(t).tobytes() for t, a in attributes)


def decode_skeleton(data: bytes, attributes: Sequence[tuple[str, str]] = ()) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """``attributes``: (name, numpy type), in stored order."""
    n, m = struct.unpack_from("<II", data)
    at = 8 + 12 * n + 8 * m
    extra = {}
    for name, kind in attributes:
        extra[name] = np.frombuffer(data, kind, n, at)
        at += extra[name].nbytes
    return np.frombuffer(data, "<f4", 3 * n, 8).reshape(-1, 3), np.frombuffer(data, "<u4", 2 * m, 8 + 12 * n).reshape(-1, 2), extra


def decode_swc(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """vertices, edges, radii, types of ``id type x y z radius parent`` lines."""
    rows = [line.split() for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
    at = {int(r[0]): i for i, r in enumerate(rows)}
    edges = [(at[int(r[6])], i) for i, r in enumerate(rows) if int(r[6]) != -1]
    num = np.array([[float(x) for x in r[2:6]] for r in rows], np.float32).reshape(-1, 4)
    return num[:, :3], np.array(edges, np.uint32).reshape(-1, 2), num[:, 3], np.array([int(r[1]) for r in rows], np.uint8)


def encode_swc(vertices: np.ndarray, edges: np.ndarray, radii: np.ndarray, types: np.ndarray) -> str:
    """Roots are vertices no edge points at; edges run from parent to child."""
    parent = {int(b): int(a) for a, b in edges}
    return "".join(f"{i + 1} {types[i]} {v[0]:.6f} {v[1]:.6f} {v[2]:.6f} {radii[i]:.6f} {parent[i] + 1 if i in parent else -1}\n" for i, v in enumerate(vertices))


def decode_manifest(data: bytes) -> dict:
    """Header of a multi-resolution mesh: shapes, levels, fragment positions and sizes."""
    f = lambda at, n, t: np.frombuffer(data, t, n, at)
    shape, origin = f(0, 3, "<f4"), f(12, 3, "<f4")
    (lods,) = struct.unpack_from("<I", data, 24)
    scales, offsets, counts = f(28, lods, "<f4"), f(28 + 4 * lods, 3 * lods, "<f4").reshape(-1, 3), f(28 + 16 * lods, lods, "<u4")
    at, positions, sizes = 28 + 20 * lods, [], []
    for n in counts.tolist():
        positions.append(f(at, 3 * n, "<u4").reshape(3, n).T)
        sizes.append(f(at + 12 * n, n, "<u4"))
        at += 16 * n
    return {"chunk_shape": shape, "grid_origin": origin, "lod_scales": scales, "vertex_offsets": offsets, "positions": positions, "sizes": sizes}


def encode_manifest(m: dict) -> bytes:
    n = len(m["lod_scales"])
    out = np.asarray(m["chunk_shape"], "<f4").tobytes() + np.asarray(m["grid_origin"], "<f4").tobytes() + struct.pack("<I", n) + np.asarray(m["lod_scales"], "<f4").tobytes() + np.asarray(m["vertex_offsets"], "<f4").tobytes()
    out += np.array([len(s) for s in m["sizes"]], "<u4").tobytes()
    return out + b"".join(np.asarray(p, "<u4").reshape(-1, 3).T.tobytes() + np.asarray(s, "<u4").tobytes() for p, s in zip(m["positions"], m["sizes"]))
