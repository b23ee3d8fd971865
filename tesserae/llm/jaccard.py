"""Near-duplicate components of documents by Jaccard similarity of word shingles.

1. Equal shingle sets are one node. Nodes are grouped by MinHash bands, whose number makes a
   missed pair at the threshold as unlikely as 1e-10, or, with exact=True, so that none can be
   missed: all shingles have a common order, rare ones first, by a counting sketch over all
   documents, then by hash. Two sets similar enough share one of the first
   n - ceil(percent * n / 100) + 1 shingles of either (n: its size), whatever the order, so
   nodes of like size that have a shingle among their first ones form a group. That takes more
   disk where many documents share passages. Groups of the same nodes are one.
2. Signature trees (their nodes hold OR-combined token bitmaps and size ranges) find the pairs:
   the tree of a group's first node is traversed against trees of the others, node pairs whose
   largest possible overlap is too small are pruned, and what is left is compared exactly where
   it is found. The links give first components; many groups are then of one and are done.
3. In the other groups the trees of the members are traversed against each other, block by
   block; document pairs of one component are skipped. Members of large groups whose shingles
   with any other member are too few for a link are left out before.

Defined results: null and blank texts have an empty set and link with nothing; fewer words
than a shingle has form one shingle; repeated rows and equal texts link; documents with one
doc_id and different texts are nodes of their own, with one doc_id; a null doc_id takes the
smallest doc_id of its component, or null; an empty table gives no rows; near_duplicates()
reads no other columns, one_of_each() passes them through under any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Scratch, bounded_batches, gathered, text_or_empty
from tesserae.llm.components import components

MISS = 1e-10
BITS = 4096
BLOCK = 256
BLOCK_SHINGLES = 1 << 20
FANOUT = 8
SKETCH_BITS = 22  # the sketch has 2 ** 22 cells, at any size of the corpus
CHUNK = 1 << 14
_RANDOM = np.random.default_rng(85)
_MIX = _RANDOM.integers(1, 1 << 63, 16, np.uint64) | np.uint64(1)
_WORD_SALT = _RANDOM.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_ABSENT = np.uint64(0x5851F42D4C957F2D)


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = x * _MIX[k]
    x ^= x >> np.uint64(32)
    x *= _MIX[k + 1]
    x ^= x >> np.uint64(29)
    return x


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles as 64-bit hashes."""
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    bounds = split.offsets.to_numpy().astype(np.int64)
    coded = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    bounds = bounds - bounds[0]
    unique = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in unique), np.uint64, len(unique))
    real = np.fromiter((len(w) > 0 for w in unique), bool, len(unique))
    index = coded.indices.to_numpy()
    words = hashes[index] if len(index) else np.zeros(0, np.uint64)
    keep = real[index] if len(index) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(keep)])[bounds]
    words = words[keep]
    padded = np.concatenate([words, np.full(width, _ABSENT)])
    grams = np.zeros(len(words), np.uint64)
    for k in range(width):
        grams += padded[k : k + len(words)] * _WORD_SALT[k]
    grams = _mixed(grams, 0)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        n = b - a
        if n >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif n:
            short = np.concatenate([words[a:b], np.full(width - n, _ABSENT)])
            total = (short * _WORD_SALT[:width]).sum(dtype=np.uint64).reshape(1)
            out.append(_mixed(total + np.uint64(n), 2))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _name(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    one, two = _mixed(shingles ^ np.uint64(9), 6), _mixed(shingles ^ np.uint64(5), 8)
    return one.sum(dtype=np.uint64).tobytes() + two.sum(dtype=np.uint64).tobytes()


def bands_for(percent: int) -> tuple[int, int]:
    """Rows and number of bands: a pair at the threshold stays apart with probability MISS."""
    rows = 5 if percent >= 85 else 4
    return rows, math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows))


def band_keys(shingles: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key for each band of MinHash values; each value has an offset and a factor of its own."""
    random = np.random.default_rng(7)
    offsets = random.integers(0, 1 << 32, (rows * bands, 1), np.uint32)
    factors = random.integers(0, 1 << 32, (rows * bands, 1), np.uint32) | np.uint32(1)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(rows * bands, np.uint32(0xFFFFFFFF))
    for a in range(0, len(low), 512):
        part = low[None, a : a + 512] ^ offsets
        part *= factors
        np.minimum(least, part.min(axis=1), out=least)
    wide = least.reshape(bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64) * _MIX[4]
    for k in range(rows):
        key = _mixed(key ^ wide[:, k], 5)
    return key.view(np.int64)


def sketch_cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def first_shingles(shingles: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """Those shingles of a sorted set of which a similar set must share one."""
    n = len(shingles)
    order = np.argsort(levels[sketch_cells(shingles)], kind="stable")  # ties by hash
    return shingles[order[: n + 1 + (-percent * n) // 100]]


def bitmap(shingles: np.ndarray) -> bytes:
    flags = np.zeros(BITS, np.uint8)
    flags[(shingles & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(flags).tobytes()


class SignatureTree:
    """Documents in size order under nodes of FANOUT children.

    A level has for each node the OR of its documents' bitmaps, their least and largest size,
    and the most tokens of one document that share a bit with others.
    """

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        own, n = bitmaps[self.order], sizes[self.order].astype(np.int64)
        spare = n - np.bitwise_count(own).sum(axis=1, dtype=np.int64)
        self.levels = [(own, n, n, spare)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, extra = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append(
                (np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                 np.maximum.reduceat(extra, at))
            )

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All children of nodes one level further down, and whose they are."""
        below = len(self.levels[level - 1][1])
        first = nodes * FANOUT
        count = np.minimum(first + FANOUT, below) - first
        owner = np.repeat(np.arange(len(nodes)), count)
        return first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count), owner


def _possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs may hold a pair of documents with enough overlap."""
    low_a, high_a, low_b, high_b = a[1][i], a[2][i], b[1][j], b[2][j]
    ok = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    out = np.zeros(len(i), bool)
    k = np.flatnonzero(ok)
    for part in np.array_split(k, max(1, len(k) // 4096)):
        x, y = i[part], j[part]
        both = np.bitwise_count(a[0][x] & b[0][y]).sum(axis=1, dtype=np.int64)
        most = np.minimum(both + np.minimum(a[3][x], b[3][y]), np.minimum(high_a[part], high_b[part]))
        out[part] = (100 + percent) * most >= percent * (low_a[part] + low_b[part])
    return out


def traverse(one: SignatureTree, other: SignatureTree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of document pairs that no bound rules out, by going down both trees."""
    la, lb = len(one.levels) - 1, len(other.levels) - 1
    i = j = np.zeros(1, np.int64)
    while True:
        keep = _possible(one.levels[la], i, other.levels[lb], j, percent)
        i, j = i[keep], j[keep]
        if la == 0 and lb == 0:
            return one.order[i], other.order[j]
        if la >= lb:
            i, owner = one.children(la, i)
            j = j[owner]
            la -= 1
        else:
            j, owner = other.children(lb, j)
            i = i[owner]
            lb -= 1


def _describe(docs: DataFrame, width: int, sketch: bool) -> DataFrame:
    """Each document's set by size and 128-bit name; rows with a chunk hold a partition's sketch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS if sketch else CHUNK, np.uint32)
        for batch in gathered(batches, mb=1):
            sets = shingle_sets(text_or_empty(batch), width)
            joined = np.concatenate(sets)
            if sketch and len(joined):
                some, n = np.unique(sketch_cells(joined), return_counts=True)
                cells[some] += n.astype(np.uint32)
            names = [_name(s) if len(s) else None for s in sets]
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                ["doc_id", "th", "n_shingles", "sid", "chunk", "cells"],
            )
        parts = np.minimum(cells, 65535).astype("<u2").reshape(-1, CHUNK)
        used = np.flatnonzero(parts.any(axis=1))
        n = len(used)
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(n, pa.int64()) for _ in range(3)), pa.nulls(n, pa.binary()), pa.array(used.astype(np.int32)),
             pa.array([zlib.compress(parts[k].tobytes(), 1) for k in used], pa.binary())],
            ["doc_id", "th", "n_shingles", "sid", "chunk", "cells"],
        )

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(
        scan, "doc_id long, th long, n_shingles long, sid binary, chunk int, cells binary"
    )


def _levels(described: DataFrame) -> np.ndarray:
    """How common a cell's shingles are in all documents: 64 levels to a doubling."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums = None, np.zeros(CHUNK, np.int64)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["chunk", "cells"])
        for batch in batches:
            for chunk, packed in zip(batch.column("chunk").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                if last is not None and chunk != last:
                    yield row()
                    sums = np.zeros(CHUNK, np.int64)
                last = chunk
                sums += np.frombuffer(zlib.decompress(packed), "<u2")
        if last is not None:
            yield row()

    # 2 ** SKETCH_BITS numbers come to the driver and go to the tasks as two bytes each.
    rows = (
        described.where("chunk is not null").select("chunk", "cells").repartition("chunk").sortWithinPartitions("chunk")
        .mapInArrow(total, "chunk int, cells binary").collect()
    )
    counts = np.zeros((1 << SKETCH_BITS) // CHUNK * CHUNK, np.int64)
    for r in rows:
        counts[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["cells"], np.int64)
    return np.ceil(64 * np.log2(counts + 1)).astype(np.uint16)


def _keys(docs: DataFrame, width: int, percent: int, levels: np.ndarray | None) -> DataFrame:
    """sid, n_shingles, keys: each set's bands, or with levels its first shingles; a set may come several times."""
    bands = bands_for(percent)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: set[int] = set()
        for batch in gathered(batches, mb=1):
            # Copies that lie close together give their set once.
            hashes = batch.column("th").to_pylist()
            new = [k for k, h in enumerate(hashes) if h not in last and not last.add(h)]
            if len(last) > 100_000:
                last.clear()
            if not new:
                continue
            sets = [s for s in shingle_sets(text_or_empty(batch).take(pa.array(new, pa.int64())), width) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_name(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([band_keys(s, *bands) if levels is None else first_shingles(s, levels, percent).view(np.int64) for s in sets],
                          pa.list_(pa.int64()))],
                ["sid", "n_shingles", "keys"],
            )

    return docs.select(F.xxhash64("text").alias("th"), "text").mapInArrow(scan, "sid binary, n_shingles long, keys array<bigint>")


def _whole_sets(chosen: DataFrame, width: int) -> DataFrame:
    """node, n_shingles, bits, shingles from node and text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, mb=1):
            sets = shingle_sets(text_or_empty(batch), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([bitmap(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["node", "n_shingles", "bits", "shingles"],
            )

    return chosen.select("node", "text").mapInArrow(scan, "node long, n_shingles long, bits binary, shingles binary")


def linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    need = percent * (len(p) + len(q))
    if (100 + percent) * min(len(p), len(q)) < need:
        return False
    spot = np.minimum(np.searchsorted(q, p), len(q) - 1)
    return (100 + percent) * int(np.count_nonzero(q[spot] == p)) >= need


def _tree(rows: list[dict]) -> SignatureTree:
    return SignatureTree(np.array([r["n_shingles"] for r in rows]), np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1))


def open_pairs(held: list[dict], percent: int) -> Iterator[tuple[dict, dict]]:
    """Pairs of a block with different labels that the trees leave over, closest bitmaps first."""
    queries, targets = [r for r in held if r["query"]], [r for r in held if not r["query"]]
    if not queries:
        return
    mine = _tree(queries)
    for rows, other in ((targets, _tree(targets) if targets else None), (queries, mine if held[0]["inner"] else None)):
        if other is None:
            continue
        i, j = traverse(mine, other, percent)
        differ = np.array([r["label"] for r in queries])[i] != np.array([r["label"] for r in rows])[j]
        i, j = i[differ], j[differ]
        one, two = (t.levels[0][0][np.argsort(t.order)] for t in (mine, other))
        parts = range(0, len(i), 4096)
        shared = [np.bitwise_count(one[i[k : k + 4096]] & two[j[k : k + 4096]]).sum(axis=1, dtype=np.int64) for k in parts]
        for k in np.argsort(-np.concatenate([*shared, np.zeros(0, np.int64)]), kind="stable").tolist():
            yield queries[i[k]], rows[j[k]]


def links_of_block(held: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links that join a block's labels as far as any do; pairs of joined labels are skipped."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    sets = {r["node"]: np.frombuffer(r["shingles"], np.uint64) for r in held}
    out = []
    for x, y in open_pairs(held, percent):
        a, b = find(x["label"]), find(y["label"])
        if a != b and linked(sets[x["node"]], sets[y["node"]], percent):
            root[max(a, b)] = min(a, b)
            out.append((max(x["node"], y["node"]), min(x["node"], y["node"])))
    return out


AT = ["key", "i", "j", "inner"]
PLACED = "key long, i int, j int, inner boolean, node long, label long, query boolean"


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in AT):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _by_trees(rows: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links a, b between different labels in blocks (key, i, j, inner) of queries and targets.

    First the trees alone tell which nodes of a block are in a pair that they leave over; only
    these nodes' whole sets follow into their blocks.
    """
    names = [c.split()[0] for c in PLACED.split(", ")]
    reducers = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]
        for held in _by_block(batches):
            own = {r["node"]: r for pair in open_pairs(held, percent) for r in pair}.values()
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in own], k) for c, k in zip(names, kinds, strict=True)], names)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_block(batches):
            found = links_of_block(held, percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def dealt(some: DataFrame, *columns: str) -> DataFrame:
        # Merged at any size: the sets grow with the input.
        return some.join(sets.select("node", *columns).hint("merge"), "node").select(*names, *columns).repartition(reducers, *AT).sortWithinPartitions(*AT)

    left = scratch.table(dealt(rows, "n_shingles", "bits").mapInArrow(leave, PLACED), "open")
    return dealt(left, "n_shingles", "bits", "shingles").mapInArrow(solve, "a long, b long").distinct()


def _n_blocks(nodes: str, shingles: str) -> Column:
    """Blocks of at most about BLOCK nodes and BLOCK_SHINGLES shingles."""
    return F.greatest(F.ceil(F.col(nodes) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _members(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """key, node, leader: groups of nodes that have a key.

    Groups of the same nodes have the same count and checksums; one of them stands for all.
    A group's leader is the member that meets the most nodes in all its groups: near copies
    agree on one of them, and most of their links are with it.
    """
    counted = placed.groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("least"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    )
    groups = scratch.table(counted.where("n > 1").groupBy("n", "x", "y", "least").agg(F.min("key").alias("key")).select("key", "n"), "groups")
    # Merged at any size, since the groups grow with the input. A node has a bounded number of keys.
    met = placed.join(groups.hint("merge"), "key").groupBy("node").agg(F.sum("n").alias("met"), F.collect_list("key").alias("keys"))
    weighed = scratch.table(met.select("node", "met", F.explode("keys").alias("key")), "weighed")
    leaders = scratch.table(weighed.groupBy("key").agg(F.max(F.struct("met", "node"))["node"].alias("leader")), "leaders")
    return scratch.table(weighed.join(leaders.hint("merge"), "key").select("key", "node", "leader"), "members")


def _by_size(nodes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """node and key: its shared first shingles, each with its size class and the next one.

    Sets similar enough differ by one size class at most.
    """
    keyed = nodes.select("node", "n_shingles", F.explode("keys").alias("shingle"))
    shared = scratch.table(keyed.groupBy("shingle").count().where("count > 1").select("shingle"), "shared")
    own_class = F.floor(F.log("n_shingles") / math.log(100 / percent) - 1e-9).cast("int")
    return scratch.table(
        keyed.join(shared, "shingle").select("node", "shingle", own_class.alias("own"))
        .select("node", F.explode(F.array("own", F.col("own") + 1)).alias("class"), "shingle")
        .select("node", F.xxhash64("shingle", "class").alias("key")),
        "placed",
    )


def _stars(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """Blocks of the nodes that meet a group's first node (leader), each with that node as its query."""
    counts = (
        stars.join(sets.select("node", "n_shingles"), "node").groupBy("leader").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
        .select(F.col("leader").alias("key"), _n_blocks("n", "size").alias("blocks"))
    )
    own = stars.join(counts, F.col("leader") == F.col("key")).select(
        "key", "node", F.lit(False).alias("query"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("j")
    )
    queries = counts.select("key", F.col("key").alias("node"), F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    return own.unionByName(queries).select("key", "node", F.col("node").alias("label"), "query", F.lit(0).alias("i"), "j", F.lit(False).alias("inner"))


def _able(sized: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """sized without those members of groups of over BLOCK nodes that can have no link there.

    A node's core are its shingles that another node of such groups has too: no overlap is
    larger. Members of like size are a class. A node stays if its own core and the largest of
    a class of its group are enough for a link with the smallest size in that class; a target
    needs a class of queries. All links of queries stay, and no row is made for a pair.
    """
    large = scratch.table(sized.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key"), "large")
    if not large.limit(1).count():
        return sized

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
            nodes = np.repeat(batch.column("node").to_numpy(), [len(x) for x in held])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate([*held, np.zeros(0, np.int64)]))], ["node", "shingle"])

    inside = scratch.table(sized.join(large, "key", "left_semi"), "inside")
    single = (
        sets.select("node", "shingles").join(inside.select("node").distinct().hint("merge"), "node", "left_semi")
        .mapInArrow(spread, "node long, shingle long")
        .groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
        .groupBy("node").agg(F.count("*").alias("single"))
    )
    cored = scratch.table(
        inside.join(single, "node", "left").withColumn("core", F.col("n_shingles") - F.coalesce("single", F.lit(0)))
        .withColumn("class", F.floor(F.log("n_shingles") / math.log(1.02))),
        "cored",
    )
    kind = F.struct("low", "high", "most")
    classes = (
        cored.groupBy("key", "class", "query").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"), F.max("core").alias("most"))
        .groupBy("key").agg(F.collect_list(kind).alias("any"), F.collect_list(F.when(F.col("query"), kind)).alias("asking"))
    )
    n, core = F.col("n_shingles"), F.col("core")
    enough = lambda c: (
        (100 * c["high"] >= percent * n) & (100 * n >= percent * c["low"])
        & ((100 + percent) * F.least(core, c["most"]) >= percent * (n + c["low"]))
    )
    able = cored.join(classes, "key").where(F.exists(F.when(F.col("query"), F.col("any")).otherwise(F.col("asking")), enough))
    return scratch.table(sized.join(large, "key", "left_anti").unionByName(able.select(*sized.columns)), "able")


def _blocks(members: DataFrame, labels: DataFrame, sets: DataFrame, scratch: Scratch, percent: int = 0) -> DataFrame:
    """Members of groups with several components, in blocks.

    A group's members outside the component of its first node are queries; the others are
    only targets. Query blocks meet every target block and each other. All pairs of a group of
    two are known from the stars. percent bounds who stays in large groups (0: all).
    """
    named = labels.select("node", "component")
    labelled = scratch.table(
        members.join(named, "node", "left").withColumn("label", F.coalesce("component", "node")).select("key", "node", "leader", "label"),
        "labelled",
    )
    mixed = scratch.table(
        labelled.groupBy("key")
        .agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n"), F.max(F.when(F.col("node") == F.col("leader"), F.col("label"))).alias("first_label"))
        .where("x <> y and n > 2")
        .select("key", "first_label", "n"),
        "mixed",
    )
    within = scratch.table(labelled.join(mixed, "key").select("key", "node", "leader", "label", "n", (F.col("label") != F.col("first_label")).alias("query")), "within")
    # Near copies share most of their keys: groups of one leader are one where that makes fewer pairs.
    firsts = within.where("node = leader").select("key", "leader", "n")
    alone = firsts.groupBy("leader").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.min("key").alias("home"))
    together = within.select("leader", "node").distinct().groupBy("leader").agg(F.count("*").alias("n"))
    homes = firsts.select("key", "leader").join(together.join(alone, "leader").where("n * n <= pairs").select("leader", "home"), "leader").select("key", "home")
    sized = scratch.table(
        within.join(homes, "key", "left").select(F.coalesce("home", "key").alias("key"), "node", "label", "query").distinct()
        .join(sets.select("node", "n_shingles"), "node")
        .select("key", "node", "label", "n_shingles", "query"),
        "sized",
    )
    sized = _able(sized, sets, percent, scratch)
    size = lambda own: F.coalesce(F.sum(F.when(own, F.col("n_shingles"))), F.lit(0))
    counts = scratch.table(
        sized.groupBy("key")
        .agg(F.count_if("query").alias("q"), F.count_if(~F.col("query")).alias("t"), size(F.col("query")).alias("qs"), size(~F.col("query")).alias("ts"))
        .select("key", "q", "t", _n_blocks("q", "qs").alias("nq"), F.greatest(F.lit(1), _n_blocks("t", "ts")).alias("nt")),
        "counts",
    )
    joined = sized.join(counts, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("query"), F.col("nq")).otherwise(F.col("nt"))).cast("int"))
    keep = ["key", "node", "label", "query"]
    all_q, all_t = F.explode(F.sequence(F.lit(0), F.col("nq") - 1)), F.explode(F.sequence(F.lit(0), F.col("nt") - 1))
    targets = joined.where(~F.col("query")).select(*keep, all_q.alias("i"), F.col("own").alias("j"), F.lit(False).alias("inner"))
    against_targets = joined.where("query and t > 0").select(*keep, F.col("own").alias("i"), all_t.alias("j"), F.lit(False).alias("inner"))
    among_queries = joined.where("query and q > 1").select(*keep, "own", all_q.alias("_other"))
    among_queries = among_queries.select(*keep, F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), F.lit(True).alias("inner"))
    return targets.unionByName(against_targets).unionByName(among_queries)


def classified(docs: DataFrame, width: int, percent: int, exact: bool = False) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component (null: an empty set), component_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    with bounded_batches(spark, rows=1000, mb=4):
        described = scratch.table(_describe(docs, width, exact), "described")
        levels = _levels(described) if exact else None
        rows = described.where("chunk is null").drop("chunk", "cells")
        # Of each distinct set the smallest doc_id, and the document that has it in the fewest rows.
        documents = rows.where("sid is not null").groupBy("sid", "doc_id", "th").agg(F.count("*").alias("copies"))
        names = documents.groupBy("sid").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("copies", "doc_id", "th")).alias("one"))
        nodes = scratch.table(
            _keys(docs, width, percent, levels)
            .groupBy("sid").agg(F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
            .withColumn("node", F.monotonically_increasing_id()),
            "nodes",
        )
        named = scratch.table(nodes.select("sid", "node").join(names, "sid"), "names")
        placed = _by_size(nodes, percent, scratch) if exact else nodes.select("node", F.explode("keys").alias("key"))
        members = _members(placed, scratch)
        wanted = members.select("node").distinct().join(named, "node").select("node", "one.*")
        # Texts are dealt by doc_id at any size: the number of wanted nodes grows with the input.
        chosen = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").alias("d").join(
            wanted.hint("merge").alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.th") == F.col("w.th"))
        )
        sets = _whole_sets(chosen, width)
        if named.where("one.copies > 1").limit(1).count():  # rows equal in doc_id and text
            sets = sets.dropDuplicates(["node"])
        sets = scratch.table(sets, "sets")
        stars = scratch.table(members.where("node <> leader").select("leader", "node").distinct(), "stars")
        links = scratch.table(_by_trees(_stars(stars, sets), sets, percent, scratch), "links")
        labels = components(links, scratch)
        more = scratch.table(_by_trees(_blocks(members, labels, sets, scratch, percent), sets, percent, scratch), "more-links")
        final = components(links.unionByName(more), scratch) if more.limit(1).count() else labels
        reached = scratch.table(
            named.join(final, "node", "left").select("sid", "first_id", F.coalesce("component", "node").alias("component")), "reached"
        )
        least = reached.groupBy("component").agg(F.min("first_id").alias("component_id"))
        homes = scratch.table(reached.join(least, "component").select("sid", "component", "component_id"), "homes")
        out = Scratch(spark).table(
            rows.join(homes, "sid", "left").select("doc_id", "th", "n_shingles", "component", "component_id"), "classified"
        )
    scratch.drop()
    return out


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 85, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that a document reaches by links."""
    found = classified(docs, width, percent, exact)
    return found.select(
        "doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: that of its smallest doc_id (nulls last).

    Of several texts under that doc_id one stays, and of equal rows one.
    """
    found = classified(docs, width, percent).where("component is not null")
    key: list[Column] = [F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th")]
    best = found.groupBy("component").agg(F.min(F.struct(*key)).alias("best"))
    gone = (
        found.join(best, "component")
        .where(F.struct(*key) != F.col("best"))
        .select("doc_id", "th")
        .distinct()
    )
    same = F.col("d.doc_id").eqNullSafe(F.col("named.doc_id")) & (F.xxhash64("d.text") == F.col("named.th"))
    kept = docs.alias("d").join(gone.alias("named"), same, "left_anti")
    twice = found.groupBy("doc_id", "th").count().where("count > 1").select("doc_id", "th")
    if not twice.limit(1).count():
        return kept
    once = kept.alias("d").join(twice.alias("named"), same, "left_anti")
    several = kept.alias("d").join(twice.alias("named"), same, "left_semi")
    return once.unionByName(several.dropDuplicates(["doc_id", "text"]))


#: near_duplicates() at four words and 0.85, for tables on which a join by shingle is small.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(w) AS w0, unnest(range(1, len(w) + 1)) AS i FROM d),
v AS (SELECT doc_id, n, i, md5_number(concat_ws(' ', w0, lead(w0, 1) OVER o, lead(w0, 2) OVER o, lead(w0, 3) OVER o)) AS h
      FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, h FROM v WHERE i <= greatest(n - 3, 1)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
q AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM q JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE 185 * k >= 85 * (a.n + b.n)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT DISTINCT x AS node, x AS root FROM e UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.node WHERE reach.root < e.y)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.root, d.doc_id)) AS component_id
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN (SELECT node, min(root) AS root FROM reach GROUP BY 1) m ON m.node = d.doc_id
"""
