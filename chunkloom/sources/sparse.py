"""Compressed streams of bytes that are nearly all zero, made and read without the zeros.

A stream is given by the places of its words (1, 2 or 4 bytes that are not all zero) and
their bytes.  Deflate streams (gzip, zlib) are one block with a fixed tree, in which 258
zeros are two zero bits, so a gap costs nothing but the length of the stream; zstd frames
are raw blocks of one word and blocks that repeat a zero.  Many streams are made and read
at once.  Any decoder reads them; streams of another make are left to the usual decoder.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

#: Bits of the codes of literals and lengths. 258 bytes have 1, a zero has 3.
_LENGTHS = np.full(286, 10)
_LENGTHS[1:73], _LENGTHS[257:285], _LENGTHS[0], _LENGTHS[285] = 9, 9, 3, 1
_BASE = [3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 15, 17, 19, 23, 27, 31, 35, 43, 51, 59, 67, 83, 99, 115, 131, 163, 195, 227]
_EXTRA = [0] * 8 + [1] * 4 + [2] * 4 + [3] * 4 + [4] * 4 + [5] * 4
_END, _LONGEST, _ZSTD, _MOST = 256, 258, b"\x28\xb5\x2f\xfd\xa0", 1 << 17
GZIP_HEAD, ZLIB_HEAD = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03", b"\x78\x9c"
#: Streams of more bytes are left to the usual decoder, which is faster then.
SHORT, SHORT_ZSTD = 30_000, 100_000
#: Bytes of deflate streams that are read together, at most and the last one; what is known of
#: their bits then stays in the processor's caches.  Zero bytes hardly count, they hold no bits.
_BYTES_AT_ONCE = 1 << 14
#: Words of a frame that are looked at together, and at least so many; shorter frames are read
#: together, block by block.
_AT_ONCE, _FEW, _SHORT_FRAME = 512, 8, 2048


def _codes() -> np.ndarray:
    """The code of each symbol, its first bit lowest."""
    out, code, before = np.zeros(286, np.uint64), 0, 0
    for n, k in sorted((int(n), k) for k, n in enumerate(_LENGTHS)):
        code <<= n - before
        before = n
        out[k] = int(format(code, f"0{n}b")[::-1], 2)
        code += 1
    return out


_CODES = _codes()


def _head() -> tuple[int, int]:
    """The block's header as (bits, their number)."""
    parts = [(1, 1), (2, 2), (29, 5), (0, 5), (14, 4)]
    parts += [(2 * (k in (1, 3, 9, 10)), 3) for k in (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1)]
    parts += [({1: 0, 3: 2, 9: 1, 10: 3}[int(n)], 2) for n in (*_LENGTHS, 1)]
    value = size = 0
    for v, n in parts:
        value |= v << size
        size += n
    return value, size


_HEAD_BITS = _head()[1]
_HEAD = np.frombuffer(_head()[0].to_bytes(-(-_HEAD_BITS // 8), "little"), np.uint8)
_WHOLE = _HEAD[:-1].tobytes()  # the last byte is shared with what follows


def _gaps() -> tuple[np.ndarray, np.ndarray]:
    """Bits, and their number, of one zero and 0 to 257 more."""
    value, size = np.zeros(_LONGEST, np.uint64), np.zeros(_LONGEST, np.int64)
    for r in range(_LONGEST):
        v, n = int(_CODES[0]), 3
        if r < 3:
            for _ in range(r):
                v, n = v | int(_CODES[0]) << n, n + 3
        else:
            k = max(i for i, b in enumerate(_BASE) if b <= r)
            v |= int(_CODES[257 + k]) << n
            v |= (r - _BASE[k]) << n + int(_LENGTHS[257 + k])
            n += int(_LENGTHS[257 + k]) + _EXTRA[k] + 1
        value[r], size[r] = v, n
    return value, size


_GAP, _GAP_BITS = _gaps()


def _symbols() -> np.ndarray:
    """The symbol that the next ten bits begin with."""
    out = np.zeros(1024, np.int64)
    for k, n in enumerate(_LENGTHS.tolist()):
        out[int(_CODES[k]) :: 1 << n] = k
    return out


_SYMBOLS = _symbols()
_MORE, _AS_BYTES = np.zeros(286, np.int64), np.ones(286, np.int64)
_MORE[257:285], _AS_BYTES[257:285] = _EXTRA, _BASE
_AS_BYTES[_END] = 0
_POPULATION = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1, dtype=np.uint8)
_BITS = _LENGTHS + _MORE + (np.arange(286) > _END)


# --- checksums ------------------------------------------------------------------------


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo that of crc32, highest bit first."""
    a, b = np.broadcast_arrays(a, b)
    a, out = a.astype(np.uint32), np.zeros(a.shape, np.uint32)
    for k in range(31, -1, -1):
        out ^= a * (b >> np.uint32(k) & np.uint32(1))
        a = (a >> np.uint32(1)) ^ (a & np.uint32(1)) * np.uint32(0xEDB88320)
    return out


@lru_cache(8)
def _powers(digit: int) -> np.ndarray:
    """What 0 to 2047 times 2048^digit zero bytes multiply a remainder by."""
    step = np.array([1 << 23], np.uint32)
    for _ in range(11 * digit):
        step = _product(step, step)
    out = np.array([1 << 31], np.uint32)
    for _ in range(11):
        out = np.concatenate([out, _product(out, step)])
        step = _product(step, step)
    return out


def _past(c: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Remainders after so many zero bytes more."""
    digit = 0
    while len(zeros) and zeros.max():
        c = _product(c, _powers(digit)[zeros & 2047])
        zeros, digit = zeros >> 11, digit + 1
    return c


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ (c & np.uint32(1)) * np.uint32(0xEDB88320)
    return c


_CRC = _byte_table()


def crc32(sizes: np.ndarray, first: np.ndarray, owner: np.ndarray, at: np.ndarray, words: np.ndarray) -> np.ndarray:
    c = np.zeros(len(at), np.uint32)
    for j in range(words.shape[1]):
        c = _CRC[(c ^ words[:, j]) & np.uint32(255)] ^ (c >> np.uint32(8))
    parts = _past(c, sizes[owner] - at - words.shape[1])
    empty = _past(np.full(len(sizes), 0xFFFFFFFF, np.uint32), sizes)
    return np.bitwise_xor.reduceat(parts, first) ^ empty ^ np.uint32(0xFFFFFFFF)


def adler32(sizes: np.ndarray, first: np.ndarray, owner: np.ndarray, at: np.ndarray, words: np.ndarray) -> np.ndarray:
    left = sizes[owner] - at
    low = np.add.reduceat(words.sum(axis=1, dtype=np.int64), first) + 1
    high = np.add.reduceat(sum((left - j) * words[:, j] % 65521 for j in range(words.shape[1])), first) + sizes
    return (high % 65521 << 16 | low % 65521).astype(np.uint32)


# --- writing --------------------------------------------------------------------------


def compressed(name: str, sizes: np.ndarray, owner: np.ndarray, at: np.ndarray, words: np.ndarray) -> list[bytes]:
    """Streams of ``sizes`` bytes; word ``words[k]`` begins at byte ``at[k]`` of stream
    ``owner[k]``.  Words are sorted, none is all zero and each stream has one at least."""
    sizes, owner, at = (np.asarray(a, np.int64) for a in (sizes, owner, at))
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    if words.shape[1] > 4:  # halves, of which one may be zero
        half = words.reshape(len(words), -1, 4)
        held = half.any(axis=2)
        n, k = np.nonzero(held)
        return compressed(name, sizes, owner[n], at[n] + 4 * k, half[held])
    if name == "zstd":
        return _frames(sizes, first, owner, at, words)
    bodies = _deflated(sizes, first, owner, at, words)
    if name == "gzip":
        ends = zip(crc32(sizes, first, owner, at, words).tolist(), (sizes & 0xFFFFFFFF).tolist())
        return [GZIP_HEAD + b + struct.pack("<II", c, n) for b, (c, n) in zip(bodies, ends)]
    return [ZLIB_HEAD + b + struct.pack(">I", c) for b, c in zip(bodies, adler32(sizes, first, owner, at, words).tolist())]


def _after(sizes: np.ndarray, first: np.ndarray, owner: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Zeros between each word and the next one or the end."""
    ends = np.append(at[1:], 0)
    last = np.append(first[1:], len(at)) - 1
    ends[last] = sizes[owner[last]]
    return ends - at - width


def _put(buf: np.ndarray, offset: np.ndarray, value: np.ndarray) -> None:
    """Sets bits; offsets are at least a byte apart."""
    byte, shift = offset >> 3, (offset & 7).astype(np.uint64)
    low, high = value << shift, value >> np.uint64(1) >> (np.uint64(63) - shift)
    for j in range(8):
        buf[byte + j] |= (low >> np.uint64(8 * j)).astype(np.uint8)
    buf[byte + 8] |= high.astype(np.uint8)


def _gap_bits(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of gaps, their number, and the number of zero bits that follow."""
    some = gap > 0
    more = np.maximum(gap - 1, 0)
    return _GAP[more % _LONGEST] * some, _GAP_BITS[more % _LONGEST] * some, more // _LONGEST * 2


def _deflated(sizes, first, owner, at, words) -> list[bytes]:
    value, n = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    for j in range(words.shape[1]):
        b = words[:, j]
        value |= _CODES[b] << n.astype(np.uint64)
        n += _LENGTHS[b]
    gap, gap_n, run = _gap_bits(_after(sizes, first, owner, at, words.shape[1]))
    value |= gap << n.astype(np.uint64)
    n += gap_n + run
    value0, n0, run0 = _gap_bits(at[first])
    inner = np.add.reduceat(n, first)
    bits = _HEAD_BITS + n0 + run0 + inner + _LENGTHS[_END]
    n_bytes = -(-bits // 8)
    stop = np.cumsum(n_bytes)
    start = stop - n_bytes
    buf = np.zeros(int(stop[-1]) + 16, np.uint8)
    buf[start[:, None] + np.arange(len(_HEAD))] = _HEAD
    _put(buf, 8 * start + _HEAD_BITS, value0)
    base = 8 * start + _HEAD_BITS + n0 + run0
    before = np.cumsum(n) - n
    _put(buf, base[owner] + before - before[first][owner], value)
    _put(buf, base + inner, np.full(len(start), _CODES[_END]))
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(start.tolist(), stop.tolist())]


def _frames(sizes, first, owner, at, words) -> list[bytes]:
    width = words.shape[1]
    first_run = -(-at[first] // _MOST)
    gap = _after(sizes, first, owner, at, width)
    runs = -(-gap // _MOST)
    n = 3 + width + 4 * runs
    inner = np.add.reduceat(n, first)
    n_bytes = 9 + 4 * first_run + inner + 3
    stop = np.cumsum(n_bytes)
    start = stop - n_bytes
    buf = np.zeros(int(stop[-1]), np.uint8)
    head = np.concatenate([np.tile(np.frombuffer(_ZSTD, np.uint8), (len(sizes), 1)), sizes.astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1)
    buf[start[:, None] + np.arange(9)] = head
    buf[stop - 3] = 1  # an empty last block
    before = np.cumsum(n) - n
    place = (start + 9 + 4 * first_run)[owner] + before - before[first][owner]
    buf[place] = width << 3
    for j in range(width):
        buf[place + 3 + j] = words[:, j]
    for where, zeros, count in ((start + 9, at[first], first_run), (place + 3 + width, gap, runs)):
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(np.repeat(zeros, count) - k * _MOST, _MOST)
        block = (size << 3 | 2).astype("<u4").view(np.uint8).reshape(-1, 4)
        spot = np.repeat(where, count) + 4 * k
        for j in range(3):
            buf[spot + j] = block[:, j]
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(start.tolist(), stop.tolist())]


# --- reading --------------------------------------------------------------------------


def told(name: str, data: bytes) -> bool:
    """Whether a short stream looks as if it was made here."""
    if len(data) > (SHORT_ZSTD if name == "zstd" else SHORT):
        return False
    head = {"gzip": GZIP_HEAD, "zlib": ZLIB_HEAD}.get(name)
    if head is None:
        return name == "zstd" and data.startswith(_ZSTD)
    return data.startswith(head) and data.startswith(_WHOLE, len(head))


def expanded(name: str, streams: Sequence[bytes]) -> list[tuple[int, np.ndarray, np.ndarray] | None]:
    """(size, places, bytes) of what is not zero; None for a stream of another make."""
    if name == "zstd":
        few = [k for k, d in enumerate(streams) if len(d) <= _SHORT_FRAME]
        short = dict(zip(few, _short_frames([streams[k] for k in few])))
        return [short[k] if k in short else _frame(d) for k, d in enumerate(streams)]
    if not streams:
        return []
    head, tail = (len(GZIP_HEAD), 8) if name == "gzip" else (len(ZLIB_HEAD), 4)
    got: list[tuple[int, np.ndarray, np.ndarray] | None] = []
    held, size = [], 0
    for d in streams:
        held.append(d[head : len(d) - tail])
        size += min(len(d), 2 * (len(d) - d.count(0)))
        if size >= _BYTES_AT_ONCE:
            got += _inflated(held)
            held, size = [], 0
    got += _inflated(held) if held else []
    whole = [k for k, g in enumerate(got) if g and len(g[1])]
    if whole:
        sizes = np.array([got[k][0] for k in whole], np.int64)
        counts = np.array([len(got[k][1]) for k in whole])
        given = (sizes, np.cumsum(counts) - counts, np.repeat(np.arange(len(whole)), counts), np.concatenate([got[k][1] for k in whole]), np.concatenate([got[k][2] for k in whole])[:, None])
        sums = (crc32 if name == "gzip" else adler32)(*given).tolist()
        for k, c, n in zip(whole, sums, sizes.tolist()):
            if streams[k][len(streams[k]) - tail :] != (struct.pack("<II", c, n & 0xFFFFFFFF) if name == "gzip" else struct.pack(">I", c)):
                got[k] = None
    return [g if g and len(g[1]) else None for g in got]


def _inflated(bodies: Sequence[bytes]) -> list[tuple[int, np.ndarray, np.ndarray] | None]:
    """Tokens are read at every bit that is set, then followed: 16 at a time from one to the
    next, and between them for all at once."""
    n_bytes = np.array([len(b) for b in bodies])
    stop = np.cumsum(n_bytes)
    buf = np.frombuffer(b"".join([*bodies, bytes(8)]), np.uint8)
    begin = 8 * (stop - n_bytes) + _HEAD_BITS
    body = buf.copy()
    for a in (stop - n_bytes).tolist():
        body[a : a + len(_WHOLE)] = 0
    full = np.flatnonzero(body)
    bit = np.flatnonzero(np.unpackbits(body[full], bitorder="little").view(bool))
    byte, shift = full[bit >> 3], bit & 7
    ones = 8 * byte + shift
    four = buf[byte].astype(np.uint32) | buf[byte + 1].astype(np.uint32) << np.uint32(8) | buf[byte + 2].astype(np.uint32) << np.uint32(16)
    window = (four >> shift.astype(np.uint32)).astype(np.int64)
    symbol = _SYMBOLS[window & 1023]
    ends = ones + _BITS[symbol]
    counts = _POPULATION[body]
    before = np.cumsum(counts, dtype=np.int64) - counts

    def rank(bits: np.ndarray) -> np.ndarray:
        """How many bits are set before the given ones."""
        return before[bits >> 3] + _POPULATION[body[bits >> 3] & (1 << (bits & 7)) - 1]

    is_end = symbol == _END
    step = np.append(np.where(is_end, np.arange(len(ones)), rank(ends)), len(ones)).astype(np.int32)  # ends stay where they are
    steps = [step]
    for _ in range(4):
        steps.append(steps[-1][steps[-1]])
    far = steps.pop()
    sixteen, last = far.item, is_end.tobytes()
    whole, path, jumps = [], [], []
    for n, (k, limit) in enumerate(zip(rank(begin).tolist(), rank(8 * stop).tolist())):
        before_it = len(path)
        while k < limit and not last[k]:
            path.append(k)
            k = sixteen(k)
        if k < limit and len(path) > before_it:
            whole.append(n)
            jumps.append(len(path) - before_it)
        else:
            del path[before_it:]
    out: list[tuple[int, np.ndarray, np.ndarray] | None] = [None] * len(bodies)
    if not whole:
        return out
    from_here = np.array(path)
    at = from_here
    for further in reversed(steps):
        at = np.stack([at, further[at]], axis=-1).reshape(-1)
    at = np.concatenate([at.reshape(len(path), -1), far[from_here][:, None]], axis=1).reshape(-1)
    kept = np.append(True, at[1:] != at[:-1])
    at, owner = at[kept], np.repeat(np.arange(len(whole)), np.array(jumps) * (len(at) // len(path)))[kept]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    n_out = _AS_BYTES[symbol[at]] + (window[at] >> _LENGTHS[symbol[at]] & (1 << _MORE[symbol[at]]) - 1)
    after, made = np.append(0, ends[at[:-1]]), np.append(0, n_out[:-1])
    after[first], made[first] = begin[whole], 0
    zeros = ones[at] - after
    odd = np.bitwise_or.reduceat(zeros & 1, first).tolist()
    gone = zeros // 2 * _LONGEST + made
    place = np.cumsum(gone)
    place -= (place[first] - gone[first])[owner]
    held = np.flatnonzero((symbol[at] > 0) & (symbol[at] < _END))
    places, found = place[held], symbol[at[held]].astype(np.uint8)
    cuts = np.searchsorted(held, np.append(first, len(at))).tolist()
    for n, o, size, a, b in zip(whole, odd, place[np.append(first[1:], len(at)) - 1].tolist(), cuts, cuts[1:]):
        out[n] = None if o else (size, places[a:b], found[a:b])
    return out


def _short_frames(frames: Sequence[bytes]) -> list[tuple[int, np.ndarray, np.ndarray] | None]:
    """The same as ``_frame`` for many, the next block of all of them at once."""
    stop = np.cumsum([len(d) for d in frames])
    buf = np.frombuffer(b"".join([*frames, bytes(4)]), np.uint8)
    wide = buf.astype(np.int64)
    at, place = np.append(0, stop[:-1]) + 9, np.zeros(len(frames), np.int64)
    good, now, found = np.zeros(len(frames), bool), np.flatnonzero(at + 3 <= stop), []
    while len(now):
        here = at[now]
        block = wide[here] | wide[here + 1] << 8 | wide[here + 2] << 16
        n, raw = block >> 3, block & 6 == 0
        zeros = (block & 6 == 2) & (here + 3 < stop[now]) & (wide[here + 3] == 0)
        after = here + 3 + np.where(raw, n, 1)
        some = np.flatnonzero(raw & (n > 0) & (after <= stop[now]))
        found.append(np.stack([now[some], place[now[some]], here[some] + 3, n[some]]))
        at[now], end = after, block & 1 == 1
        place[now] += n
        good[now] = (raw | zeros) & end & (after == stop[now])
        now = now[(raw | zeros) & ~end & (after + 3 <= stop[now])]
    owner, to, start, n = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    order = np.argsort(owner, kind="stable")
    owner, to, start, n = owner[order], to[order], start[order], n[order]
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    byte, to, owner = buf[np.repeat(start, n) + k], np.repeat(to, n) + k, np.repeat(owner, n)
    good &= np.isin(np.arange(len(frames)), owner) & (place == [int.from_bytes(d[5:9], "little") for d in frames])
    held = byte != 0
    byte, to, owner = byte[held], to[held], owner[held]
    cuts = np.searchsorted(owner, np.arange(len(frames) + 1)).tolist()
    return [(size, to[a:b], byte[a:b]) if ok else None for ok, size, a, b in zip(good.tolist(), place.tolist(), cuts, cuts[1:])]


def _frame(data: bytes) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Blocks one by one, but words of one width that alternate with zeros many at once."""
    at, place, found, end = 9, 0, [], len(data)
    buf = np.frombuffer(data, np.uint8)
    while True:
        if at + 3 > end:
            return None
        block = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        n = block >> 3
        many = min((end - at) // (n + 7), _AT_ONCE)
        if n and not block & 7 and many >= _FEW:
            rows = buf[at : at + many * (n + 7)].reshape(many, n + 7)
            zeros = rows[:, n + 3].astype(np.int64) | rows[:, n + 4].astype(np.int64) << 8 | rows[:, n + 5].astype(np.int64) << 16
            alike = (rows[:, :3] == rows[0, :3]).all(axis=1) & (zeros & 7 == 2) & (rows[:, n + 6] == 0)
            many = many if alike.all() else int(alike.argmin())
            if many:
                size = n + (zeros[:many] >> 3)
                after = np.cumsum(size)
                found.append(np.stack([place + after - size, at + 3 + (n + 7) * np.arange(many), np.full(many, n)], axis=1))
                at, place = at + many * (n + 7), place + int(after[-1])
                continue
        if block & 6 == 2 and at + 3 < end and data[at + 3] == 0:
            at, place = at + 4, place + n
        elif not block & 6:
            if n:
                found.append(np.array([[place, at + 3, n]]))
            at, place = at + 3 + n, place + n
        else:
            return None
        if block & 1:
            break
    if at != end or not found or place != int.from_bytes(data[5:9], "little"):
        return None
    to, start, n = np.concatenate(found).T
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    byte = buf[np.repeat(start, n) + k]
    held = byte != 0
    return place, (np.repeat(to, n) + k)[held], byte[held]


def as_words(places: np.ndarray, byte: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places and bytes as the words that hold them: numbers of the words, and their bytes."""
    number = places // width
    first = np.flatnonzero(np.diff(number, prepend=-1))
    words = np.zeros((len(first), width), np.uint8)
    words[np.cumsum(np.diff(number, prepend=-1) != 0) - 1, places % width] = byte
    return number[first], words
