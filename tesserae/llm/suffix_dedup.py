"""Removing byte strings of a given length that start at two or more places of the corpus.

1. Every window of `length` bytes belongs to the smallest hash of its 64-byte grams, so equal
   windows have the same hash. Neighbouring windows of one hash form a piece. A hash at one
   place only can hold a repeat only if its piece has the smallest gram twice (periodic text);
   others go no further. Pieces that occur twice are repeated as a whole.
2. The different pieces of a hash meet in a shard: a suffix array (Larsson-Sadakane
   refinement in numpy) with Kasai's common prefixes tells which windows are equal.
3. A hash with very many different pieces is spread over several shards. Each of them cuts its
   sorted windows into ranges, and the runs that meet in a range are merged by binary search.
4. A document's repeated windows, joined back by its text's digest, are cut out.
5. On request, passages of so many whole words that are shorter than `length` bytes go too:
   each of them is a window of its own, found by its 128-bit digest.

Defined results: a null text is an empty one; texts shorter than `length` stay whole; texts of
at least that length that occur twice go whole; repeated rows are copies of one another; an
empty table gives no rows; other columns pass through under any name. Matches never cross
documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from tesserae.llm.common import Scratch, bounded_batches, gathered

LENGTH = 400
GRAM = 64
PIECE_STARTS = 512  # a piece's windows at most
BLOCK_PIECES = 256  # different pieces of a hash that one shard takes
SHARD_BYTES = 400_000
SLAB_BYTES = 200_000
LONG_BYTES = 1_000_000
SEEN_TEXTS = 200_000
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE_HASH = np.random.default_rng(64).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each position on; gram is a power of two."""
    out, width = _BYTE_HASH[data], 1
    factor = 0x9E3779B97F4A7C15
    while width < gram:
        wide = out[: len(out) - width] * np.uint64(factor)
        wide += out[width:]
        out, width, factor = wide, 2 * width, factor * factor % (1 << 64)
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` values that follow one another, from block minima."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(ahead[: n - width + 1], behind[width - 1 : n])


def gram_of(length: int) -> int:
    return min(GRAM, 1 << (length.bit_length() - 2))


def _gram_twice(grams: np.ndarray, minima: np.ndarray, width: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each run of windows (first to last) has its smallest gram at two positions or more."""
    none = np.full(width - 1, np.iinfo(np.uint64).max, np.uint64)
    # A gram is some window's smallest where it equals the greatest minimum of the windows that hold it.
    at = np.flatnonzero(~window_minima(np.concatenate([none, ~minima, none]), width) == grams)
    values, ids = np.unique(grams[at], return_inverse=True)
    n = len(grams)
    keys = np.append(np.sort(ids * n + at), [len(values) * n] * 2)
    own = np.searchsorted(values, minima[first]) * n
    return keys[np.searchsorted(keys, own + first) + 1] <= own + last + width - 1


def find_pieces(data: np.ndarray, stops: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window, number of windows and hash of the pieces of texts that follow one another.

    Last, whether a piece has its hash's gram more than once: it may repeat within itself.

    stops: the texts' ends; no text is shorter than length.
    """
    gram = gram_of(length)
    grams = gram_hashes(data, gram)
    minima = window_minima(grams, length - gram + 1)
    begins = np.concatenate([[0], stops[:-1]])
    last = stops - length + 1  # no window of a text starts here or later
    cuts = np.unique(np.concatenate([np.flatnonzero(minima[1:] != minima[:-1]) + 1, begins, last]))
    text = np.searchsorted(stops, cuts, "right")
    inside = (text < len(stops)) & (cuts < last[np.minimum(text, len(stops) - 1)])
    run = np.diff(cuts, append=len(minima))[inside]
    first, text = cuts[inside], text[inside]
    parts = -(-run // PIECE_STARTS)
    within = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(first, parts) + within * PIECE_STARTS
    counts = np.minimum(np.repeat(run, parts) - within * PIECE_STARTS, PIECE_STARTS)
    twice = _gram_twice(grams, minima, length - gram + 1, starts, starts + counts - 1)
    return np.repeat(text, parts), starts, counts, minima[starts], twice


def suffix_array(data: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order to at least `depth` characters; ends: each position's end of its text.

    Larsson-Sadakane: suffixes are ranked by their first characters, and groups that still
    tie are refined by the rank of the suffix `known` characters further on, doubling known.
    """
    n = len(data)
    bits = max(1, n.bit_length())
    mask = (1 << bits) - 1
    at = np.arange(n, dtype=np.int64)
    key = np.zeros(n, np.int64)
    wide = np.concatenate([data.astype(np.int64) + 1, np.zeros(4, np.int64)])
    for k in range(4):
        key = (key << 9) | np.where(at + k < ends, wide[k : k + n], 0)
    packed = np.sort((key << bits) | at)
    order = packed & mask
    ranks = np.empty(n + 1, np.int64)
    ranks[n] = 0

    def heads_of(keys: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot where each slot's group begins, and whether it has company."""
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        heads = np.maximum.accumulate(np.where(new, slots, 0))
        return heads, ~(new & np.concatenate([new[1:], [True]]))

    slots = at
    heads, tied = heads_of(packed >> bits, slots)
    ranks[order] = heads + 1
    known = 4
    while known < depth and tied.any():
        slots, heads = slots[tied], heads[tied]
        suffix = order[slots]
        further = suffix + known
        beyond = np.where(further < ends[suffix], further, n)
        packed = np.sort((heads << (2 * bits)) | (ranks[beyond] << bits) | suffix)
        order[slots] = packed & mask
        heads, tied = heads_of(packed >> bits, slots)
        ranks[order[slots]] = heads + 1
        known *= 2
    return order


def common_prefixes(data: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai's common prefix of each suffix with the one before it in order.

    Where two neighbours in order are one character further on than two others in their texts,
    they share one character less. So prefixes are compared only where such a chain begins,
    for all chains at once and eight characters at a time, and carried along the texts.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    chained = np.zeros(n, bool)
    chained[1:] = (before[1:] > 0) & (before[:-1] == before[1:] - 1) & (ends[1:] == ends[:-1])
    chained[1:] &= (data[:-1] == data[before[1:] - 1]) & (ends[before[1:]] == ends[before[1:] - 1])
    heads = np.flatnonzero(~chained)
    shared = np.zeros(n, np.int64)
    mine = heads[before[heads] >= 0]
    theirs = before[mine]
    room = np.minimum(ends[mine] - mine, ends[theirs] - theirs)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]
    words = np.ascontiguousarray(words).view("<u8").ravel()
    length = np.zeros(len(mine), np.int64)
    live = np.arange(len(mine))
    while len(live):
        h = length[live]
        x, y = np.minimum(mine[live] + h, n - 1), np.minimum(theirs[live] + h, n - 1)
        differ = words[x] ^ words[y]
        lowest = differ & (~differ + np.uint64(1))
        step = np.where(differ == 0, 8, np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) >> 3)
        length[live] = np.minimum(h + step, room[live])
        live = live[(step == 8) & (h + 8 < room[live])]
    shared[mine] = length
    chain = np.maximum.accumulate(np.where(chained, 0, at))
    shared = shared[chain] - (at - chain)
    return shared[order]


def equal_windows(pieces: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pieces' windows: class of equal ones (in suffix order), position, piece, first positions."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    stops = np.cumsum(sizes)
    starts = stops - sizes
    ends = np.repeat(stops, sizes)
    order = suffix_array(data, ends, length)
    prefix = common_prefixes(data, ends, order)
    classes = np.cumsum(prefix < length)
    piece_of = np.repeat(np.arange(len(pieces)), sizes)
    piece = piece_of[order]
    window = order - starts[piece] < counts[piece]
    return classes[window], order[window], piece[window], starts


def _longest_agreement(groups: np.ndarray, data: np.ndarray, at: np.ndarray, room: np.ndarray, step: int, far: int) -> np.ndarray:
    """How far each place agrees, going by step, with any other place of its group.

    In sorted order the longest agreement is with a neighbour. One of `far` or more counts as
    all the room there is.
    """
    n, width = len(at), min(far, int(room.max(initial=0)))
    whole, room = room, np.minimum(room, far)
    names = groups.astype(">u8").tobytes()
    text = data.tobytes()
    parts = []
    for k, (a, m) in enumerate(zip(at.tolist(), room.tolist(), strict=True)):
        part = text[a : a + m] if step > 0 else text[a - m + 1 : a + 1][::-1]
        parts.append(names[8 * k : 8 * k + 8] + part.ljust(width, b"\0"))
    rows = np.frombuffer(b"".join(parts), np.uint8).reshape(n, 8 + width)
    order = np.argsort(rows.view(f"S{8 + width}").ravel(), kind="stable")
    ranked, space = rows[order], room[order]
    same = np.ones((n - 1, 8 + width + 1), bool)
    same[:, :-1] = ranked[1:] == ranked[:-1]
    same[:, -1] = False
    shared = np.minimum(same.argmin(axis=1) - 8, np.minimum(space[1:], space[:-1]))
    best = np.full(n, -1)
    best[1:] = shared
    best[:-1] = np.maximum(best[:-1], shared)
    out = np.empty(n, np.int64)
    out[order] = best
    return np.where(out >= far, whole, out)


def trimmed(rows: list[dict], length: int) -> list[tuple[int, int]]:
    """The range of each piece that may hold a window of another piece of its hash.

    A window holds its hash's gram. A piece with that gram at one place only can agree with
    another piece no further to either side than it does with its best partner on that side.
    Pieces of a hash that has other shards are left alone.
    """
    gram = gram_of(length)
    sizes = np.array([len(r["bytes"]) for r in rows], np.int64)
    data = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
    stops = np.cumsum(sizes)
    starts = stops - sizes
    hashes = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    piece = np.repeat(np.arange(len(rows)), sizes)[: len(data) - gram + 1]
    found = np.flatnonzero(gram_hashes(data, gram) == hashes[piece])
    found = found[found + gram <= stops[piece[found]]]
    owner = piece[found]
    single = np.bincount(owner, minlength=len(rows)) == 1
    able = single & np.array([r["blocks"] == 1 for r in rows])
    grouped = np.isin(hashes[owner], hashes[able])  # other groups have nothing to trim
    found, owner = found[grouped], owner[grouped]
    if not len(found):
        return [(0, n) for n in sizes.tolist()]
    right = _longest_agreement(hashes[owner], data, found + gram, stops[owner] - found - gram, 1, length)
    left = _longest_agreement(hashes[owner], data, found - 1, found - starts[owner], -1, length)
    low, high = np.zeros(len(rows), np.int64), sizes.copy()
    at = found - starts[owner]
    alone = able[owner]
    low[owner[alone]] = (at - np.maximum(left, 0))[alone]
    high[owner[alone]] = (at + gram + np.maximum(right, 0))[alone]
    none = alone & ((left < 0) | (right < 0))  # no other piece at all
    high[owner[none]] = low[owner[none]]
    return list(zip(low.tolist(), high.tolist(), strict=True))


def runs_of(positions: np.ndarray) -> np.ndarray:
    """Sorted distinct positions -> first, last, first, last, ..."""
    if not len(positions):
        return np.zeros(0, np.int32)
    cut = np.flatnonzero(np.diff(positions) > 1)
    first = positions[np.concatenate([[0], cut + 1])]
    last = positions[np.concatenate([cut, [len(positions) - 1]])]
    return np.stack([first, last], 1).ravel().astype(np.int32)


SHARDED = "h long, ph1 long, ph2 long, spans array<int>, range int, keys binary, refs binary"
_KEYS = np.dtype([("a", "<u8"), ("b", "<u8")])
_REFS = np.dtype([("ph1", "<i8"), ("ph2", "<i8"), ("at", "<i4")])


def _row(h: int, ph1: int = 0, ph2: int = 0, spans=None, rng=None, keys=None, refs=None) -> dict:
    return {"h": h, "ph1": ph1, "ph2": ph2, "spans": spans, "range": rng, "keys": keys, "refs": refs}


_SHARDED_SCHEMA = pa.schema(
    [("h", pa.int64()), ("ph1", pa.int64()), ("ph2", pa.int64()), ("spans", pa.list_(pa.int32())),
     ("range", pa.int32()), ("keys", pa.binary()), ("refs", pa.binary())]
)


def _solve(rows: list[dict], length: int) -> list[dict]:
    """One shard: repeated windows of its pieces, and sorted runs of hashes that go on elsewhere."""
    import xxhash

    rows = list({(r["h"], r["ph1"], r["ph2"]): r for r in rows}.values())
    ranges = trimmed(rows, length)
    kept = [k for k, (a, b) in enumerate(ranges) if b - a >= length]
    if not kept:
        return []
    rows = [rows[k] | {"from": ranges[k][0], "bytes": rows[k]["bytes"][ranges[k][0] : ranges[k][1]]} for k in kept]
    counts = np.array([len(r["bytes"]) - length + 1 for r in rows], np.int64)
    full = np.array([r["whole"] for r in rows], bool)
    blocks = np.array([r["blocks"] for r in rows], np.int64)
    texts = [r["bytes"] for r in rows]
    classes, place, piece, starts = equal_windows(texts, counts, length)
    edge = np.concatenate([[True], classes[1:] != classes[:-1]]) if len(classes) else np.zeros(0, bool)
    group = np.cumsum(edge) - 1
    size = np.bincount(group)
    repeated = (size + np.bincount(group, full[piece]) >= 2)[group]
    out = []
    own = repeated & ~full[piece]
    by_piece = np.lexsort((place[own], piece[own]))
    p, at = piece[own][by_piece], (place[own] - starts[piece[own]])[by_piece]
    for k in np.unique(p):
        a, b = np.searchsorted(p, [k, k + 1])
        r = rows[k]
        out.append(_row(r["h"], r["ph1"], r["ph2"], (runs_of(at[a:b]) + r["from"]).tolist()))
    heads = np.flatnonzero(edge & (blocks[piece] > 1)) if len(classes) else []
    runs: dict[tuple[int, int], list] = {}
    for k in heads:  # one window of each class
        r, offset = rows[piece[k]], int(place[k] - starts[piece[k]])
        digest = xxhash.xxh3_128_digest(memoryview(r["bytes"])[offset : offset + length])
        key = (int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little"))
        ref = (0, 0, -1) if repeated[k] else (r["ph1"], r["ph2"], offset + r["from"])
        runs.setdefault((r["h"], key[0] % r["blocks"]), []).append((key, ref))
    for (h, rng), run in runs.items():
        run.sort()
        out.append(_row(h, rng=rng, keys=np.array([k for k, _ in run], _KEYS).tobytes(), refs=np.array([x for _, x in run], _REFS).tobytes()))
    return out


def _shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by hash and block -> shards of whole groups."""
    held: list[dict] = []
    size, last = 0, None
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["h"], row["block"])
            if key != last and size >= SHARD_BYTES:
                yield pa.RecordBatch.from_pylist(_solve(held, length), schema=_SHARDED_SCHEMA)
                held, size = [], 0
            held.append(row)
            size += len(row["bytes"])
            last = key
    if held:
        yield pa.RecordBatch.from_pylist(_solve(held, length), schema=_SHARDED_SCHEMA)


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Of each sorted run of keys, the refs of those keys that another run has too."""
    word = [np.array(k["a"]) for k, _ in runs]  # sorted; b tells the few equal a apart
    merged_a, merged_b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    seen_in = np.zeros(0, np.int64)
    for a, (k, _) in zip(word, runs, strict=True):
        known = np.zeros(len(a), bool)
        if len(merged_a):
            low = np.searchsorted(merged_a, a, "left")
            for step in range(2):  # keys of 128 bits: at most two share the first 64
                spot = np.minimum(low + step, len(merged_a) - 1)
                hit = (merged_a[spot] == a) & (merged_b[spot] == k["b"]) & ~known
                seen_in[spot[hit]] += 1
                known |= hit
        fresh = ~known
        into = np.searchsorted(merged_a, a[fresh], "right")
        merged_a = np.insert(merged_a, into, a[fresh])
        merged_b = np.insert(merged_b, into, k["b"][fresh])
        seen_in = np.insert(seen_in, into, 1)
    out = []
    for a, (k, refs) in zip(word, runs, strict=True):
        twice = np.zeros(len(a), bool)
        low = np.searchsorted(merged_a, a, "left")
        for step in range(2):
            spot = np.minimum(low + step, len(merged_a) - 1)
            twice |= (merged_a[spot] == a) & (merged_b[spot] == k["b"]) & (seen_in[spot] > 1)
        out.append(refs[twice & (refs["at"] >= 0)])
    return out


def _merges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by hash and range -> windows that two shards have."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    last = None

    def flush() -> pa.RecordBatch:
        refs = np.concatenate(merge_runs(held))
        rows = [_row(last[0], int(r["ph1"]), int(r["ph2"]), [int(r["at"])] * 2) for r in refs]
        return pa.RecordBatch.from_pylist(rows, schema=_SHARDED_SCHEMA)

    for batch in batches:
        for row in batch.to_pylist():
            key = (row["h"], row["range"])
            if held and key != last:
                yield flush()
                held = []
            held.append((np.frombuffer(row["keys"], _KEYS), np.frombuffer(row["refs"], _REFS)))
            last = key
    if held:
        yield flush()


def _emit_pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """All pieces of texts; copies that lie close together give theirs once."""
    import xxhash

    seen: set[bytes] = set()

    def slab(held: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
        joined = b"".join(part for _, _, part in held)
        stops = np.cumsum([len(part) for _, _, part in held])
        text, starts, n, h, twice = find_pieces(np.frombuffer(joined, np.uint8), stops, length)
        view = memoryview(joined)
        ends = (starts + n + length - 1).tolist()
        digests = [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(starts.tolist(), ends, strict=True)]
        both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        begins = np.concatenate([[0], stops[:-1]]) - np.array([base for _, base, _ in held])
        return pa.RecordBatch.from_arrays(
            [pa.array([tk for tk, _, _ in held], pa.binary()).take(pa.array(text)), pa.array((starts - begins[text]).astype(np.int32)),
             pa.array(n.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(twice)],
            ["tk", "start", "n", "h", "ph1", "ph2", "twice"],
        )

    for batch in gathered(batches, mb=4):
        held: list[tuple[bytes, int, bytes]] = []
        size = 0
        for tk, text in zip(batch.column("tk").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
            if tk in seen:
                continue
            if len(seen) >= SEEN_TEXTS:
                seen.clear()
            seen.add(tk)
            view = memoryview(text.as_buffer())
            # A long text goes in parts that overlap, so that each window is in one of them.
            for base in range(0, len(view) - length + 1, LONG_BYTES):
                held.append((tk, base, bytes(view[base : base + LONG_BYTES + length - 1])))
                size += len(held[-1][2])
                if size >= SLAB_BYTES:
                    yield slab(held)
                    held, size = [], 0
        if held:
            yield slab(held)


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of each asked piece, for its shard."""
    for batch in gathered(batches, mb=4):
        names = ["h", "ph1", "ph2", "n", "whole", "block", "blocks"]
        columns: dict[str, list] = {x: [] for x in [*names, "bytes"]}
        asked = batch.column("asked").to_pylist()
        for text, wanted in zip(batch.column("text").cast(pa.large_binary()), asked, strict=True):
            view = memoryview(text.as_buffer())
            for w in wanted:
                for x in names:
                    columns[x].append(w[x])
                columns["bytes"].append(bytes(view[w["start"] : w["start"] + w["n"] + length - 1]))
        kinds = [pa.int64()] * 3 + [pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns.values(), kinds, strict=True)], list(columns)
        )


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with their text's digest tk; a null text is an empty one."""
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn(
        "tk", F.unhex(F.md5(F.col("text").cast("binary")))
    )


def short_passages(data: np.ndarray, words: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each passage of `words` whole words in fewer than `length` bytes."""
    inside = np.concatenate([[False], ~_BLANK[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edges[::2], edges[1::2][words - 1 :]
    first = first[: len(end)]
    short = end - first < length
    return first[short], end[short]


def _emit_passages(batches: Iterator[pa.RecordBatch], words: int, length: int) -> Iterator[pa.RecordBatch]:
    """All short passages of texts, with their digests."""
    import xxhash

    for batch in gathered(batches, mb=4):
        for tk, text in zip(batch.column("tk").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
            view = memoryview(text.as_buffer())
            first, end = short_passages(np.frombuffer(view, np.uint8), words, length)
            for k in range(0, len(first), 50_000):
                a, b = first[k : k + 50_000], end[k : k + 50_000]
                digests = [xxhash.xxh3_128_digest(view[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tk] * len(a), pa.binary()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)),
                     pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())],
                    ["tk", "first", "end", "d1", "d2"],
                )


def _passage_spans(keyed: DataFrame, words: int, length: int, scratch: Scratch) -> DataFrame:
    """tk, spans: repeated passages of `words` words in fewer than `length` bytes, as spans of `length` bytes.

    The last start is the passage's end less `length`, so it lies before the first.
    """
    passages = scratch.table(
        keyed.where(F.octet_length("text") >= 2 * words - 1)
        .select("tk", "text")
        .mapInArrow(lambda it: _emit_passages(it, words, length), "tk binary, first int, end int, d1 long, d2 long"),
        "passages",
    )
    repeated = scratch.table(passages.groupBy("d1", "d2").count().where("count > 1").select("d1", "d2"), "repeated-passages")
    return (
        passages.join(repeated, ["d1", "d2"], "left_semi")
        .select("tk", "first", "end")
        .distinct()
        .groupBy("tk")
        .agg(F.flatten(F.collect_list(F.array(F.col("first"), F.col("end") - length))).alias("spans"))
    )


def repeated_spans(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """tk, spans: of each text with repeats its repeated windows, as flat (first, last) starts.

    docs needs doc_id and text; with words, repeated passages of so many words count whatever
    their bytes. The result is a table in the shared folder.
    """
    scratch = Scratch(docs.sparkSession)
    with bounded_batches(docs.sparkSession):
        out = _spans(docs, length, words, scratch)
    scratch.drop()
    return out


def _spans(docs: DataFrame, length: int, words: int | None, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    reducers = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(docs.select("doc_id", "text"))
    long_enough = keyed.where(F.octet_length("text") >= length)
    texts = scratch.table(
        long_enough.groupBy("tk").agg(
            F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.max(F.octet_length("text")).alias("bytes")
        ),
        "texts",
    )
    all_pieces = scratch.table(
        long_enough.select("tk", "text").mapInArrow(
            lambda it: _emit_pieces(it, length), "tk binary, start int, n int, h long, ph1 long, ph2 long, twice boolean"
        ),
        "pieces",
    ).withColumn("place", F.xxhash64("tk", "start"))
    # Hashes with two places or more, or with a piece that may repeat within itself.
    shared = scratch.table(
        all_pieces.groupBy("h")
        .agg(F.min("place").alias("a"), F.max("place").alias("b"), F.max("twice").alias("twice"))
        .where("a <> b or twice")
        .select("h"),
        "hashes",
    )
    pieces = scratch.table(all_pieces.join(shared, "h", "left_semi"), "shared-pieces")
    piece = ["h", "ph1", "ph2"]
    kinds = scratch.table(
        pieces.groupBy(*piece).agg(
            F.min("place").alias("place"), (F.min("place") != F.max("place")).alias("whole"), F.max("twice").alias("twice")
        ),
        "kinds",
    )
    sizes = scratch.table(
        kinds.groupBy("h")
        .agg(F.count("*").alias("kinds"), F.count_if(~F.col("whole")).alias("open"), F.max("twice").alias("twice"))
        .where("(kinds > 1 or twice) and open > 0"),
        "sizes",
    )
    blocks = F.ceil(F.col("kinds") / BLOCK_PIECES).cast("int")
    asked = (
        pieces.join(
            kinds.join(sizes, "h").select(*piece, "whole", F.col("place").alias("own_place"), blocks.alias("blocks")), piece
        )
        .where("place = own_place")
        .withColumn("block", F.pmod(F.col("ph1"), F.col("blocks")).cast("int"))
        .groupBy("tk")
        .agg(F.collect_list(F.struct("start", "n", *piece, "whole", "block", "blocks")).alias("asked"))
    )
    located = asked.join(texts.select("tk", "doc_id"), "tk")
    to_shards = (
        long_enough.join(located, (long_enough["tk"] == located["tk"]) & long_enough["doc_id"].eqNullSafe(located["doc_id"]))
        .select("text", "asked")
        .mapInArrow(
            lambda it: _cut_out(it, length),
            "h long, ph1 long, ph2 long, n int, whole boolean, block int, blocks int, bytes binary",
        )
    )
    sharded = scratch.table(
        to_shards.repartition(reducers, "h", "block")
        .sortWithinPartitions("h", "block")
        .mapInArrow(lambda it: _shards(it, length), SHARDED),
        "suffixes",
    )
    across = (
        sharded.where("keys is not null")
        .repartition(reducers, "h", "range")
        .sortWithinPartitions("h", "range")
        .mapInArrow(_merges, SHARDED)
    )
    found = sharded.where("spans is not null").unionByName(across).select(*piece, "spans")
    whole = kinds.where("whole").select(*piece, F.lit(None).cast("array<int>").alias("spans"))
    known = scratch.table(found.unionByName(whole), "known")
    hits = pieces.join(known, piece).select(
        "tk",
        F.transform(F.coalesce("spans", F.array(F.lit(0), F.col("n") - 1)), lambda x: x + F.col("start")).alias("part"),
    )
    single = texts.where("copies = 1").select("tk")
    copies = texts.where("copies > 1").select(
        "tk", F.array(F.lit(0), (F.col("bytes") - length).cast("int")).alias("spans")
    )
    collected = hits.groupBy("tk").agg(F.flatten(F.collect_list("part")).alias("spans")).join(single, "tk", "left_semi")
    spans = collected.unionByName(copies)
    if words:
        spans = spans.unionByName(_passage_spans(keyed, words, length, scratch))
        spans = spans.groupBy("tk").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return Scratch(spark).table(spans, "spans")


def kept_bytes(text: bytes, spans: np.ndarray, length: int) -> tuple[bytes, int, int]:
    """What is left of a text, how many bytes went, and in how many runs."""
    pairs = np.asarray(spans, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(pairs[:, 1] + length)
    new = np.concatenate([[True], pairs[1:, 0] > ends[:-1]])
    first = pairs[new, 0].tolist()
    last = ends[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(ends) - 1]])].tolist()
    kept, at = [], 0
    for a, b in zip(first, last, strict=True):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), sum(last) - sum(first), len(first)


def remove_repeats(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """row (a document's own columns), kept (the remaining bytes), n_bytes, n_removed, n_spans."""
    spans = repeated_spans(docs, length, words)
    rows = docs.select(F.struct("*").alias("row"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("tk"))
    joined = rows.join(spans, "tk", "left").select("row", "spans")
    schema = StructType([joined.schema["row"]])
    for name, kind in (("kept", BinaryType()), ("n_bytes", LongType()), ("n_removed", LongType()), ("n_spans", LongType())):
        schema.add(name, kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, mb=4):
            kept, sizes, removed, runs = [], [], [], []
            texts = pc.fill_null(pc.struct_field(batch.column("row"), "text").cast(pa.large_binary()), b"")
            for text, own in zip(texts, batch.column("spans"), strict=True):
                raw = text.as_buffer().to_pybytes()
                rest, n, k = (raw, 0, 0) if not own.is_valid else kept_bytes(raw, own.values.to_numpy(), length)
                kept.append(rest)
                sizes.append(len(raw))
                removed.append(n)
                runs.append(k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs))],
                ["row", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    return joined.mapInArrow(cut, schema)


def _kept_text() -> Column:
    """The remaining text. A cut may split a character; what is not UTF-8 any more becomes a mark that is dropped."""
    return F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))


def clean_texts(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """docs with repeats taken out of their texts, without the documents of which nothing is left.

    Characters that a cut splits go too; n_chars, where there is one, is counted anew.
    """
    cut = remove_repeats(docs, length, words)
    changed = F.col("n_removed") > 0
    own = {c: F.col("row").getField(c) for c in docs.columns}
    text = F.when(changed, _kept_text()).otherwise(own["text"])
    columns = own | {"text": text}
    if "n_chars" in own:
        columns["n_chars"] = F.when(changed, F.char_length(text).cast("long")).otherwise(own["n_chars"])
    return cut.where(~changed | (F.octet_length("kept") > 0)).select(*[c.alias(name) for name, c in columns.items()])


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text (what is left, without split characters)."""
    return remove_repeats(docs.select("doc_id", "text"), length).select(
        F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), _kept_text().alias("text")
    )
