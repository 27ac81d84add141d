"""Filling containers of a fixed number of tokens by bin completion.

Token counts are integers up to the capacity, so however many documents there are,
the packing problem is the histogram of sizes: at most ``capacity`` numbers, which
merge on the map side.  Branch and bound runs over that histogram.  A branch takes the
largest size left and one of its undominated completions, least waste first, applied
as often as its sizes allow or once; all of them are tried, lazily.  Branches that
cannot have fewer containers than the incumbent are pruned; the incumbent comes from
best fit decreasing.  The search ends at the lower bound, when it is exhausted, or
after BRANCHES branchings (then the incumbent stands).  The resulting list of fillings
is dealt out to the documents in parallel, by their rank within their size.

Texts longer than the capacity are cut: full parts fill a container each and are
numbered without any rank, from FULL on; the rest is packed like any other item.  No
other text is divided.

Defined cases: null ids are ignored; null, empty and other texts without tokens take
no space and are not placed; repeated rows count once; an empty table gives an empty
result; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkloom.llm.tokens import MODEL, sized
from chunkloom.session import cut

CAPACITY = 1024
#: Parts of one size are ranked in chunks of about so many, each a sort of its own.
CHUNK_ROWS = 500_000
#: Branchings after which the incumbent stands.  They bound the search for a better
#: packing, not what is packed.
BRANCHES = 20_000
#: Containers of full parts are numbered from here on.
FULL = 1 << 62

Filling = tuple[tuple[int, ...], int]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer containers: total size, and Martello and Toth's L2."""
    total = sum(s * c for s, c in counts.items())
    best = -(-total // capacity)
    sizes = sorted(counts)
    for k in [0] + [s for s in sizes if s <= capacity // 2]:
        big = sum(c for s, c in counts.items() if s > capacity - k)
        mid = {s: c for s, c in counts.items() if capacity - k >= s > capacity / 2}
        small = sum(s * c for s, c in counts.items() if capacity / 2 >= s >= k)
        room = sum(mid.values()) * capacity - sum(s * c for s, c in mid.items())
        best = max(best, big + sum(mid.values()) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Greedy fillings over the histogram: each size into the fullest bins it fits."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}  # free space -> filling -> bins
    for s in sorted(counts, reverse=True):
        left = counts[s]
        for free in sorted(f for f in open_ if f >= s):
            while left and open_.get(free):
                filling, n = open_[free].popitem()
                each = free // s  # as many as fit into each
                full, rest = divmod(left, each)
                take = min(n, full)
                if take:
                    _put(open_, free - each * s, filling + (s,) * each, take)
                    left -= take * each
                if take < n and left and left < each:
                    _put(open_, free - left * s, filling + (s,) * left, 1)
                    take, left = take + 1, 0
                if take < n:
                    _put(open_, free, filling, n - take)
                    if not left:
                        break
        if left:
            each = capacity // s
            full, rest = divmod(left, each)
            if full:
                _put(open_, capacity - each * s, (s,) * each, full)
            if rest:
                _put(open_, capacity - rest * s, (s,) * rest, 1)
    return [(f, n) for by in open_.values() for f, n in by.items()]


def _put(open_: dict, free: int, filling: tuple[int, ...], n: int) -> None:
    by = open_.setdefault(free, {})
    by[filling] = by.get(filling, 0) + n


def completions(counts: dict[int, int], largest: int, capacity: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, sizes beside the largest) of all undominated fillings, least waste first.

    A filling is dominated if another size left over still fits, if a size in it can
    be exchanged for a larger one left over, or two of its sizes for one at least as
    large as both.
    """
    left = dict(counts)
    left[largest] -= 1
    sizes = sorted((s for s, c in left.items() if c > 0 and s <= capacity - largest), reverse=True)
    target = capacity - largest
    # bit t of reach[i]: some of the sizes from the i-th on add up to t
    reach = [1] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        bits, step, more = reach[i + 1], 1, min(left[sizes[i]], target // sizes[i])
        while more > 0:  # 1, 2, 4, ... copies give every number of copies
            take = min(step, more)
            bits |= bits << (take * sizes[i])
            more, step = more - take, step * 2
        reach[i] = bits & ((2 << target) - 1)
    for room in range(target + 1):
        if reach[0] >> (target - room) & 1:
            for chosen in _sums(sizes, left, reach, target - room):
                if not _dominated(chosen, room, left, sizes):
                    yield room, chosen


def _sums(sizes: list[int], left: dict[int, int], reach: list[int], total: int) -> Iterator[tuple[int, ...]]:
    """Multisets of the sizes that add up to ``total``, larger sizes first, without dead ends."""
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, total, ())]
    while stack:
        at, rest, chosen = stack.pop()
        if not rest:
            yield chosen
            continue
        while at < len(sizes) and sizes[at] > rest:
            at += 1
        s = sizes[at]
        for m in range(min(left[s], rest // s) + 1):  # the largest count is looked at first
            if reach[at + 1] >> (rest - m * s) & 1:
                stack.append((at + 1, rest - m * s, chosen + (s,) * m))


def _dominated(chosen: tuple[int, ...], room: int, left: dict[int, int], sizes: list[int]) -> bool:
    used: dict[int, int] = {}
    for s in chosen:
        used[s] = used.get(s, 0) + 1
    free = [s for s in sizes if left[s] > used.get(s, 0)]
    if free and free[-1] <= room:
        return True
    have = sum(1 << s for s in free)
    if room and any(have >> (s + 1) & ((1 << room) - 1) for s in used):
        return True
    pairs = {a + b for i, a in enumerate(chosen) for b in chosen[i + 1 :]}
    return any(have >> p & ((2 << room) - 1) for p in pairs)


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, branches: int = BRANCHES) -> list[Filling]:
    """Fillings, each with its number of containers, that hold the whole histogram."""
    counts = {s: c for s, c in counts.items() if c > 0}
    if not counts:
        return []
    bound = lower_bound(counts, capacity)
    incumbent = best_fit_decreasing(counts, capacity)
    best = sum(n for _, n in incumbent)
    seen: dict[bytes, int] = {}

    def children(left: dict[int, int]) -> Iterator[tuple[int, tuple[int, ...]]]:
        """Fillings around the largest size with how often: as often as possible, then once."""
        largest, often = max(left), False
        for _, others in completions(left, largest, capacity):
            k = min(left[s] // n for s, n in _tally((largest, *others)).items())
            often |= k > 1
            yield k, (largest, *others)
        if often:
            yield from ((1, (largest, *others)) for _, others in completions(left, largest, capacity))

    # Depth first; a frame is (histogram left, containers so far, its untried fillings).
    path: list[Filling] = []
    frames = [(counts, 0, children(counts))]
    tried = 0
    while frames and best > bound and tried < branches:
        left, used, untried = frames[-1]
        step = next(untried, None)
        if step is None:
            frames.pop()
            if path:
                path.pop()
            continue
        tried += 1
        k, filling = step
        after = dict(left)
        for s, n in _tally(filling).items():
            after[s] -= n * k
            if not after[s]:
                del after[s]
        if not after:
            if used + k < best:
                best, incumbent = used + k, [*path, (filling, k)]
            continue
        # the L2 bound costs the square of the number of sizes
        least = lower_bound(after, capacity) if len(after) <= 48 else -(-sum(s * c for s, c in after.items()) // capacity)
        if used + k + least >= best:
            continue
        key = hashlib.blake2b(repr(sorted(after.items())).encode(), digest_size=16).digest()
        if seen.get(key, best) <= used + k:
            continue
        seen[key] = used + k
        if tried % 64 == 1:  # the rest by best fit may already be better
            rest = best_fit_decreasing(after, capacity)
            n = sum(c for _, c in rest)
            if used + k + n < best:
                best, incumbent = used + k + n, [*path, (filling, k), *rest]
        path.append((filling, k))
        frames.append((after, used + k, children(after)))
    return incumbent


def _tally(filling: tuple[int, ...]) -> dict[int, int]:
    out: dict[int, int] = {}
    for s in filling:
        out[s] = out.get(s, 0) + 1
    return out


def pack(docs: DataFrame, id_col: str, text: str, capacity: int = CAPACITY, model: str = MODEL) -> DataFrame:
    """``container, doc_id, part, n_parts, first_token, n_tokens`` of every part."""
    items = sized(docs, id_col, text, model=model).where("n_tokens > 0")
    items = items.withColumn("n_parts", F.ceil(F.col("n_tokens") / capacity).cast("int"))
    parts = items.select("id", "text_hash", "n_parts", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"))
    first = (F.col("part") * capacity).cast("bigint")
    parts = parts.select("id", "text_hash", "part", "n_parts", first.alias("first_token"), F.least(F.lit(capacity), F.col("n_tokens") - first).cast("int").alias("size"))
    # full parts get their container with the copy that is written, the others by their rank
    own = F.when(F.col("size") == capacity, F.lit(FULL) + F.monotonically_increasing_id())
    parts = cut(parts.withColumn("own", own), "parts")
    full = parts.where("own is not null").select(F.col("own").alias("container"), F.col("id").alias("doc_id"), "part", "n_parts", "first_token", F.col("size").cast("bigint").alias("n_tokens"))
    parts = parts.where("own is null")

    # at most capacity rows each: the histogram, and how many chunks each size is ranked in
    counts = {int(r["size"]): int(r["n"]) for r in parts.groupBy("size").agg(F.count("*").alias("n")).collect()}
    spark = docs.sparkSession
    dealt = spark.sparkContext.broadcast(_segments(bin_completion(counts, capacity)))
    chunks = F.broadcast(spark.createDataFrame([(s, -(-n // CHUNK_ROWS)) for s, n in counts.items()], "size int, n_chunks bigint"))
    parts = parts.join(chunks, "size").withColumn("chunk", F.pmod(F.xxhash64("id", "text_hash", "part"), F.col("n_chunks")))
    # one row for each chunk, so at most capacity plus one for CHUNK_ROWS parts
    by_chunk = parts.groupBy("size", "chunk").agg(F.count("*").alias("n"))
    w = Window.partitionBy("size").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_chunk.select("size", "chunk", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("size", "chunk").orderBy("id", "text_hash", "part")) - 1
    ranked = parts.withColumn("rank", rank).join(F.broadcast(offsets), ["size", "chunk"]).withColumn("rank", F.col("rank") + F.col("offset"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, sizes, each, bins = dealt.value
        for pdf in batches:
            key = (pdf["size"].to_numpy(np.int64) << 44) + pdf["rank"].to_numpy(np.int64)
            at = np.searchsorted(starts, key, side="right") - 1
            yield pd.DataFrame({"container": bins[at] + (key - starts[at]) // each[at], "doc_id": pdf["id"], "part": pdf["part"], "n_parts": pdf["n_parts"], "first_token": pdf["first_token"], "n_tokens": pdf["size"].astype("int64")})

    rest = ranked.select("id", "part", "n_parts", "first_token", "size", "rank").mapInPandas(deal, "container bigint, doc_id bigint, part int, n_parts int, first_token bigint, n_tokens bigint")
    return full.unionByName(rest)


def _segments(fillings: list[Filling]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which containers the ranks of a size go to: (start key, size, per bin, first bin)."""
    out, given, first = [], {}, 0
    for filling, k in fillings:
        for s in sorted(set(filling)):
            m = filling.count(s)
            at = given.get(s, 0)
            out.append(((s << 44) + at, s, m, first))
            given[s] = at + m * k
        first += k
    out.sort()
    return tuple(np.array([r[i] for r in out], dtype=np.int64) for i in range(4))  # type: ignore[return-value]


def containers(packed: DataFrame) -> DataFrame:
    """``container, n_items, n_tokens`` of a packing; hot containers do not exist."""
    return packed.groupBy("container").agg(F.count("*").alias("n_items"), F.sum("n_tokens").cast("bigint").alias("n_tokens"))
