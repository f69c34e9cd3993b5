"""N-gram Jaccard join: classes of documents whose word-shingle sets overlap enough.

Documents with the same shingle set are one node. Nodes that can be linked at all are first brought
together by an exact pigeonhole argument: two sets of sizes a and b with Jaccard similarity at least t
differ in at most (1-t)/(1+t)*(a+b) shingles, so when the shingle universe (without frequent shingles) is
cut by hash into more parts than that, some part holds the same shingles in both. Equal parts are found by
one shuffle of short keys; the connected candidates form a block, and different blocks cannot hold a link.

Inside a block the signature tree decides: leaves hold documents ordered by set size, every node holds
the OR of its documents' token bitmaps, its range of sizes and its largest number of tokens that share a
bit. A dual traversal walks pairs of nodes from the root down and drops a pair when the sizes are too far
apart or the maximum possible overlap is too small. Surviving document pairs are compared exactly; pairs
already known to be in one class are not. Large blocks are cut into tiles of bounded size: links inside a
tile first, then across tiles for documents that are not yet in the block's main class.

No pair list of a group is ever written: a task emits spanning links only.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensia.llm.common import WordHashes, as_signed, chunks, doc_columns, lower_ascii, mix, partitions_for, rows_by_key, space_words, window_hashes
from propensia.llm.graph import components
from propensia.session import discard, materialise

TILE, TILE_SHINGLES = 1024, 1_500_000
"""Most documents of a block, and most shingles, that one task compares with each other."""

BROADCAST_ROWS = 400_000
"""Most ids (with four numbers each) that are broadcast to pick documents; counted before."""

FANOUT = 16

Threshold = tuple[int, int]


def shingle_set(text: bytes, shingle: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; fewer words make one shingle, none an empty set."""
    words = space_words(lower_ascii(text))
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(hashes.of(words), min(shingle, len(words))))


def _node(s: np.ndarray) -> int:
    """Name of a shingle set: 64 bits of its content, as a signed number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


# ---------------------------------------------------------------- candidate keys


def _classes(n: int, t: Threshold) -> int:
    """Size class of a set: bounds grow by the factor 1/t, so linked sets are in the same or adjacent classes."""
    return int(math.floor(math.log(n) / math.log(t[1] / t[0]) + 1e-9))


def _bounds(c: int, t: Threshold) -> tuple[int, int]:
    """Smallest and largest size of class ``c``, by the same arithmetic as ``_classes``."""
    r = t[1] / t[0]
    low = max(1, math.floor(r**c) - 2)
    while _classes(low, t) < c:
        low += 1
    high = max(low, math.floor(r ** (c + 1)) - 2)
    while _classes(high + 1, t) <= c:
        high += 1
    return low, high


def _differ(total: int, t: Threshold) -> int:
    """Most shingles in which two linked sets of ``total`` shingles together can differ."""
    return (t[1] - t[0]) * total // (t[1] + t[0])


class KeyPlan:
    """Number of parts per size class, and the keys of a set."""

    def __init__(self, t: Threshold):
        self.t, self._parts = t, {}

    def parts(self, c: int) -> tuple[int, int]:
        """(parts, most differing shingles) for pairs whose larger set is in class ``c``."""
        if c not in self._parts:
            differ = _differ(2 * _bounds(c, self.t)[1], self.t)
            self._parts[c] = (math.ceil(1.12 * (differ + 1)) + 2, differ)
        return self._parts[c]

    def differ(self, n: int, c: int) -> int:
        """Most shingles in which a set of ``n`` differs from a linked one, neither above class ``c``."""
        return _differ(n + min(_bounds(c, self.t)[1], n * self.t[1] // self.t[0]), self.t)

    def keys(self, s: np.ndarray, common: np.ndarray) -> np.ndarray:
        """64-bit keys; two linked sets share at least one. ``common`` marks frequent shingles.

        Only shingles that are not frequent are cut into parts: leaving some out of both sets cannot make them
        differ in more places, and passages that many documents share bring nobody together. As smaller set of
        a pair a document also takes part in the next class. Parts that are empty in both sets prove nothing.
        A set with more filled parts than can differ vouches for all its pairs alone; one without adds the
        single shingles of its prefix (rare ones first, then hash order), so that two such sets meet there.

        A set that vouches shares ``filled - differ`` parts with each of its partners, so all but one of these may go
        if every set drops its last ones in the same order. Equal parts hold equally many shingles: those that hold
        fewest, on which documents agree by chance, are the last. Their number is the top of a key.
        """
        n = len(s)
        c, out = _classes(n, self.t), []
        rare = s[~common]
        for k in (c, c + 1):
            parts, differ = self.parts(k)[0], self.differ(n, k)
            tag = np.uint64(mix(np.array([k + 1], np.uint64))[0])
            filled = 0
            if len(rare):
                part = (rare >> np.uint64(20)) % np.uint64(parts)
                order = np.argsort(part.astype(np.uint16 if parts <= 65_536 else np.uint64), kind="stable")
                own = part[order]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                filled = len(first)
                with np.errstate(over="ignore"):
                    keys = mix(np.add.reduceat(mix(rare[order]), first) + own[first] * np.uint64(0x9E3779B97F4A7C15)) ^ tag
                held = np.minimum(np.diff(np.r_[first, len(own)]), 63).astype(np.uint64)
                keys = (np.uint64(63) - held) << np.uint64(58) | keys >> np.uint64(6)
                out.append(np.partition(keys, differ)[: differ + 1] if filled - differ >= 2 else keys)
            # Equal parts are at least parts - differ; empty ones among them at most parts - filled.
            if filled - differ >= 1:
                continue
            prefix = n - -(-self.t[0] * n // self.t[1]) + 1
            ordered = np.concatenate([np.sort(mix(rare)), np.sort(mix(s[common]))])
            out.append(mix(ordered[:prefix] ^ np.uint64(0x5851F42D4C957F2D)) ^ tag)
        return np.concatenate(out)


_KEY_SCHEMA = "part int, nodes binary, rows binary, keys binary, cuts binary"


def _emit_keys(shingle: int, t: Threshold, dealt: int, shards: int, frequent):
    def run(batches):
        plan, hashes, often = KeyPlan(t), WordHashes(), frequent.value
        nodes, keys, seen, held = [], [], set(), 0
        for _, texts in chunks(batches):
            for text in texts:
                s = shingle_set(text, shingle, hashes)
                if len(s) and (node := _node(s)) not in seen:
                    seen.add(node)
                    own = plan.keys(s, often[_bucket(s, len(often))])
                    nodes.append(node)
                    keys.append(own)
                    held += len(own)
            if held > 500_000:
                yield _sharded(nodes, keys, dealt, shards)
                nodes, keys, seen, held = [], [], set(), 0
        if held:
            yield _sharded(nodes, keys, dealt, shards)

    return run


KEYS_A_TASK = 6_000_000
"""Keys that one task brings together, of about 8 bytes each."""

COUNTERS = (1 << 16, 1 << 24)
"""Fewest and most counters that shingles are hashed into to tell the frequent ones; 16 to 32 shingles a counter on average
while that many counters suffice (about half a billion shingles), so that the bound of FREQUENT does not move with the table."""

COUNTERS_A_ROW = 4096

FREQUENT = 8
"""A shingle is frequent when its counter exceeds this times the mean counter, and 64. Any fixed choice keeps
the keys complete; this one decides how large the blocks around common passages can get."""


def counters_for(total: int) -> int:
    """Number of counters (a power of two) for so many shingles."""
    return min(max(1 << max(0, math.ceil(math.log2(max(total, 1) / 32))), COUNTERS[0]), COUNTERS[1])


def _bucket(s: np.ndarray, counters: int) -> np.ndarray:
    return (s >> np.uint64(36)) & np.uint64(counters - 1)


def _count_shingles(shingle: int, counters: int):
    """Counters of a task, those that are not 0."""
    def run(batches):
        hashes, total = WordHashes(), np.zeros(counters, np.uint32)
        for _, texts in chunks(batches):
            for text in texts:
                s = shingle_set(text, shingle, hashes)
                if len(s):
                    np.add.at(total, _bucket(s, counters), 1)
        # COUNTERS_A_ROW travel together, a byte each where that holds them, compressed: most are 0 or 1.
        rows = total.reshape(-1, COUNTERS_A_ROW)
        at = np.flatnonzero(rows.any(1))
        for i in range(0, len(at), 256):
            part = at[i : i + 256]
            packed = [zlib.compress((r if r.max() > 255 else r.astype(np.uint8)).tobytes(), 1) for r in rows[part]]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(packed, pa.binary())], ["at", "counts"])

    return run


def _add_counters(least: float):
    """(at, flags): for COUNTERS_A_ROW counters whether their sums exceed ``least``, as bits; rows without one are left out."""
    def run(batches):
        for (at,), rows in rows_by_key(batches):
            total = np.zeros(COUNTERS_A_ROW, np.int64)
            for (packed,) in rows:
                counts = zlib.decompress(packed)
                total += np.frombuffer(counts, np.uint8 if len(counts) == COUNTERS_A_ROW else np.uint32)
            if (total > least).any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(total > least).tobytes()], pa.binary())], ["at", "flags"])

    return run


def frequent_shingles(source: DataFrame, shingle: int, total: int) -> np.ndarray:
    """For each counter whether its shingles are frequent, from all documents; a bit for each counter reaches the driver."""
    counters = counters_for(total)
    counted = source.mapInArrow(_count_shingles(shingle, counters), "at int, counts binary")
    parts, least = partitions_for(source.sparkSession, 0, 1), max(64, FREQUENT * total / counters)
    summed = counted.repartition(parts, "at").sortWithinPartitions("at").mapInArrow(_add_counters(least), "at int, flags binary").collect()
    often = np.zeros((counters // COUNTERS_A_ROW, COUNTERS_A_ROW), bool)
    for at, packed in summed:
        often[at] = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
    return often.ravel()


def _sharded(nodes: list[int], keys: list[np.ndarray], dealt: int, shards: int) -> pa.RecordBatch:
    """One row per task (``dealt`` of them): its nodes, and 40-bit keys with the place of their node in that list, cut into ``shards``.

    Keys only nominate candidates, so the few that agree by chance cost a comparison and no result.
    """
    row = np.repeat(np.arange(len(nodes), dtype=np.uint32), [len(k) for k in keys])
    key = np.concatenate(keys)
    shard = (key % np.uint64(dealt * shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    row, key = row[order], key[order] // np.uint64(dealt * shards)
    cuts = np.searchsorted(shard[order], np.arange(dealt * shards + 1))
    names, columns = np.array(nodes, np.int64), [[], [], [], [], []]
    for part in range(dealt):
        own = cuts[part * shards : (part + 1) * shards + 1]
        a, b = int(own[0]), int(own[-1])
        if a == b:
            continue
        used, place = np.unique(row[a:b], return_inverse=True)
        rest = key[a:b]
        columns[0].append(part)
        columns[1].append(names[used].tobytes())
        columns[2].append(place.astype(np.uint32 if len(used) > 65_535 else np.uint16).tobytes())
        columns[3].append((rest & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + ((rest >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).tobytes())
        columns[4].append((own - a).astype(np.uint32).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["part", "nodes", "rows", "keys", "cuts"])


class Forest:
    """Disjoint sets of nodes, each named by its smallest; whole arrays of pairs are united at a time."""

    def __init__(self):
        self.nodes, self.roots = np.empty(0, np.int64), np.empty(0, np.int64)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        names, at = np.unique(np.concatenate([self.nodes, self.roots, a, b]), return_inverse=True)
        n, m = len(self.nodes), len(a)
        x = np.concatenate([at[:n], at[2 * n : 2 * n + m]])
        y = np.concatenate([at[n : 2 * n], at[2 * n + m :]])
        parent = np.arange(len(names))
        while True:
            p, q = parent[x], parent[y]
            differ = p != q
            if not differ.any():
                break
            x, y, p, q = x[differ], y[differ], p[differ], q[differ]
            np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
        own = parent != np.arange(len(names))
        self.nodes, self.roots = names[own], names[parent[own]]


FOREST_NODES = 1 << 20
"""Nodes of a forest that a task keeps before it sends it on."""


def _candidate_edges(batches):
    """Nodes with an equal key belong together: one edge for each node to the smallest it is tied to in the task's shards."""
    forest = Forest()
    for _, rows in rows_by_key(batches):
        for shard in range(len(rows[0][3]) // 4 - 1):
            nodes, keys = [], []
            for names, places, packed, cuts in rows:
                n, (a, b) = len(packed) // 5, np.frombuffer(cuts, np.uint32)[shard : shard + 2].tolist()
                place = np.frombuffer(places, np.uint32 if len(places) == 4 * n else np.uint16)[a:b]
                nodes.append(np.frombuffer(names, np.int64)[place])
                keys.append(np.frombuffer(packed, np.uint32, b - a, 4 * a).astype(np.uint64) | np.frombuffer(packed, np.uint8, b - a, 4 * n + a).astype(np.uint64) << np.uint64(32))
            node, key = np.concatenate(nodes), np.concatenate(keys)
            order = np.lexsort((node, key))
            node, key = node[order], key[order]
            same = (key[1:] == key[:-1]) & (node[1:] != node[:-1])
            if same.any():
                forest.unite(node[1:][same], node[:-1][same])
            if len(forest.nodes) > FOREST_NODES:
                yield from _forest_edges(forest)
                forest = Forest()
    yield from _forest_edges(forest)


def _forest_edges(forest: Forest):
    for a in range(0, len(forest.nodes), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(forest.nodes[a : a + 50_000]), pa.array(forest.roots[a : a + 50_000])], ["a", "b"])


# ---------------------------------------------------------------- signature tree


class SignatureTree:
    """Documents of a tile, ordered by set size, under nodes of FANOUT children."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        sizes = np.array([len(s) for s in sets])
        self.order = np.argsort(sizes, kind="stable")
        words = bits // 64
        maps = np.zeros((len(sets), words), np.uint64)
        for row, i in enumerate(self.order):
            at = sets[i] >> np.uint64(8)
            np.bitwise_or.at(maps[row], (at // np.uint64(64) % np.uint64(words)).astype(np.intp), np.uint64(1) << (at % np.uint64(64)))
        low = sizes[self.order]
        shared = low - np.bitwise_count(maps).sum(1)
        # levels[0] holds the documents, the last level the root.
        self.levels = [(maps, low, low, shared)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, shared = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(shared, at)))


def dual_traversal(x: SignatureTree, y: SignatureTree, t: Threshold) -> np.ndarray:
    """Document pairs (place in x, place in y) whose maximum possible overlap reaches the threshold."""
    p, q = t
    dx, dy = len(x.levels) - 1, len(y.levels) - 1
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        (mx, lx, hx, sx), (my, ly, hy, sy) = x.levels[dx], y.levels[dy]
        keep = (q * hx[a] >= p * ly[b]) & (q * hy[b] >= p * lx[a])
        a, b = a[keep], b[keep]
        kept = []
        for i in range(0, len(a), 1024):
            u, v = a[i : i + 1024], b[i : i + 1024]
            bound = np.bitwise_count(mx[u] & my[v]).sum(1) + np.minimum(sx[u], sy[v])
            # Smallest overlap that any pair below needs: q*o >= p*(m+n-o) with the smallest sizes.
            kept.append((p + q) * np.minimum(bound, np.minimum(hx[u], hy[v])) >= p * (lx[u] + ly[v]))
        keep = np.concatenate(kept) if kept else np.empty(0, bool)
        a, b = a[keep], b[keep]
        if not dx and not dy:
            return np.stack([x.order[a], y.order[b]], 1)
        if dx >= dy and dx:
            dx -= 1
            a, b = _children(a, b, len(x.levels[dx][0]))
        else:
            dy -= 1
            b, a = _children(b, a, len(y.levels[dy][0]))


def _children(parent: np.ndarray, other: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    child = (parent[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    other = np.repeat(other, FANOUT)
    return child[child < n], other[child < n]


def links(xs: list[np.ndarray], ys: list[np.ndarray] | None, labels: np.ndarray, t: Threshold) -> list[tuple[int, int]]:
    """Spanning links among ``xs`` (``ys`` None), or between ``xs`` and ``ys``, numbered on behind ``xs``.

    ``labels`` names the class already known for each document; only pairs of different classes are compared.
    """
    p, q = t
    sets = xs + (ys or [])
    if len(sets) < 2 or not xs:
        return []
    bits = 64 << max(0, math.ceil(math.log2(max(1, min(8 * max(map(len, sets)), 65_536) / 64))))
    x = SignatureTree(xs, bits)
    pairs = dual_traversal(x, x if ys is None else SignatureTree(ys, bits), t)
    if ys is None:
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    else:
        pairs[:, 1] += len(xs)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    # Dense token numbers make a set a few marks in one array.
    tokens, dense = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    mark, labels, found = np.zeros(len(tokens), bool), labels.copy(), []
    cut = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0], True]) if len(pairs) else np.zeros(1, np.int64)
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        a = int(pairs[lo, 0])
        others = pairs[lo:hi, 1]
        others = others[labels[others] != labels[a]]
        if not len(others):
            continue
        own = dense[ends[a] - sizes[a] : ends[a]]
        mark[own] = True
        for b in others.tolist():
            if labels[a] != labels[b]:
                common = int(np.count_nonzero(mark[dense[ends[b] - sizes[b] : ends[b]]]))
                if q * common >= p * (int(sizes[a]) + int(sizes[b]) - common):
                    found.append((a, b))
                    labels[labels == labels[b]] = labels[a]
        mark[own] = False
    return found


def _tile_links(t: Threshold):
    """Links inside each tile: rows (block, tile, node, set) sorted by block and tile."""
    def run(batches):
        for _, rows in rows_by_key(batches, 2):
            # The block's smallest node is in every tile, to tie the tiles of one class together.
            rows = list(dict(rows).items())
            sets = [np.frombuffer(s, np.uint64) for _, s in rows]
            yield _edges([(rows[i][0], rows[j][0]) for i, j in links(sets, None, np.arange(len(sets)), t)])

    return run


def _cross_links(t: Threshold):
    """Links between two tiles: rows (pair name, side, label, node, set) sorted by the first."""
    def run(batches):
        for _, rows in rows_by_key(batches, 1):
            left, right = ([r for r in rows if r[0] == side] for side in (0, 1))
            every = left + right
            names = {label: i for i, label in enumerate(dict.fromkeys(r[1] for r in every))}
            found = links([np.frombuffer(r[3], np.uint64) for r in left], [np.frombuffer(r[3], np.uint64) for r in right], np.array([names[r[1]] for r in every]), t)
            yield _edges([(every[i][2], every[j][2]) for i, j in found])

    return run


SKETCH_BITS = 2048


def parity_sketch(s: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of SKETCH_BITS hash cells.

    A shingle that only one of two sets has flips one cell, so sketches differ in at most as many cells as
    the sets differ in shingles.
    """
    cells = np.bincount(((s >> np.uint64(8)) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(cells.astype(np.uint8)).tobytes()


def _needed(t: Threshold):
    """Documents of a tile pair that may have a link to a document of another class on the other side.

    Rows (pair, side, label, node, doc_id, n, sketch) sorted by the first; the sketches bound the difference
    of two sets from below, so whoever is left out has no such link.
    """
    p, q = t

    def run(batches):
        for (pair,), rows in rows_by_key(batches):
            sides = [[r for r in rows if r[0] == side] for side in (0, 1)]
            if not sides[0] or not sides[1]:
                continue
            names = {label: i for i, label in enumerate({r[1] for r in rows})}
            label, n, sketch = zip(*((np.array([names[r[1]] for r in x]), np.array([r[4] for r in x]), np.frombuffer(b"".join(r[5] for r in x), np.uint64).reshape(len(x), -1)) for x in sides), strict=True)
            wanted = [np.zeros(len(x), bool) for x in sides]
            for a in range(0, len(sides[0]), 32):
                part = slice(a, a + 32)
                m = n[0][part, None] + n[1][None]
                differ = np.bitwise_count(sketch[0][part, None] ^ sketch[1][None]).sum(2, dtype=np.int64)
                may = (label[0][part, None] != label[1][None]) & (differ * (p + q) <= (q - p) * m) & (q * n[0][part, None] >= p * n[1][None]) & (q * n[1][None] >= p * n[0][part, None])
                wanted[0][part] |= may.any(1)
                wanted[1] |= may.any(0)
            kept = [r for x, w in zip(sides, wanted, strict=True) for r, keep in zip(x, w.tolist(), strict=True) if keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[3] for r in kept], pa.int64()), pa.array([pair] * len(kept), pa.int64()), pa.array([r[0] for r in kept], pa.int32()), pa.array([r[1] for r in kept], pa.int64()), pa.array([r[2] for r in kept], pa.int64())],
                ["doc_id", "pair", "side", "label", "node"])

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["a", "b"])


# ---------------------------------------------------------------- the operator


def _describe(shingle: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            at = 0
            for keys, texts in chunks([batch]):
                sets = [shingle_set(x, shingle, hashes) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) if len(s) else None for s in sets], pa.int64()), batch.column(2).slice(at, len(sets))],
                    ["doc_id", "n", "node", "digest"])
                at += len(sets)

    return run


def _with_sets(source: DataFrame, wanted: DataFrame, shingle: int, sketched: bool = False) -> DataFrame:
    """Rows of ``wanted`` (with doc_id and node) with the shingle set of their document, made again from its text,
    or with the set's parity sketch. Where an id names several texts, the one whose set is the node counts.

    The wanted ids are broadcast only up to BROADCAST_ROWS of them, counted; beyond, both sides are shuffled.
    """
    names, make = [c for c in wanted.columns if c != "doc_id"], parity_sketch if sketched else np.ndarray.tobytes
    small = wanted.count() <= BROADCAST_ROWS
    joined = source.join(F.broadcast(wanted) if small else wanted, "doc_id").select(*names, "text")

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            at, keys = 0, batch.select(names)
            for _, texts in chunks([pa.RecordBatch.from_arrays([batch.column(0), batch.column("text")], ["k", "t"])]):
                part, sets = keys.slice(at, len(texts)), [shingle_set(x, shingle, hashes) for x in texts]
                right = [_node(s) == node for s, node in zip(sets, part.column("node").to_pylist(), strict=True)]
                chosen = part.filter(pa.array(right, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array([make(s) for s, ok in zip(sets, right, strict=True) if ok], pa.binary())], [*names, "shingles"])
                at += len(texts)

    return joined.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in wanted.dtypes if c != "doc_id"), "shingles binary"]))


def _linked_nodes(source: DataFrame, described: DataFrame, shingle: int, t: Threshold) -> DataFrame:
    """(node, component) of every node that has a link to another one."""
    spark = source.sparkSession
    if t[0] == t[1]:  # only equal sets are linked, and those are one node
        return spark.createDataFrame([], "node bigint, component bigint")
    total = described.agg(F.sum("n")).first()[0] or 0
    rows = total * 4.5 * (t[1] - t[0]) / (t[1] + t[0])
    frequent = spark.sparkContext.broadcast(frequent_shingles(source, shingle, total))
    # A task holds its packed keys, goes through its shards of them one by one and sends one forest: the fewer tasks, the fewer
    # times a node is sent, both with its keys and in forests.
    dealt = max(12, math.ceil(rows / KEYS_A_TASK))
    shards = max(1, math.ceil(rows / dealt / 700_000))
    keys = source.mapInArrow(_emit_keys(shingle, t, dealt, shards, frequent), _KEY_SCHEMA).repartition(dealt, "part").sortWithinPartitions("part")
    candidates = materialise(keys.mapInArrow(_candidate_edges, "a bigint, b bigint").distinct(), "jaccard-candidates")
    blocks = components(candidates, "jaccard-blocks").withColumnRenamed("component", "block")
    discard(candidates)

    # One document stands for each node. Tiles of a block: runs of similar size, cut further by hash so that
    # none outgrows TILE documents or TILE_SHINGLES shingles. All of this moves ids and sizes only.
    nodes = described.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
    light = materialise(nodes.join(blocks, "node").withColumn("run", F.floor(F.log2("n") * 4).cast("int")), "jaccard-members")
    whole = light.groupBy("block").agg(((F.count("*") > TILE) | (F.sum("n") > TILE_SHINGLES)).alias("large"))
    cuts = F.ceil(F.greatest(F.count("*") / (TILE * 0.8), F.sum("n") / (TILE_SHINGLES * 0.8))).cast("int")
    runs = light.groupBy("block", "run").agg(cuts.alias("cuts")).join(whole, "block").filter("large").drop("large")
    tile = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.col("run") * 65536 + 1 + F.pmod(F.xxhash64("node"), F.col("cuts"))).cast("bigint")
    if runs.count() <= BROADCAST_ROWS:  # at most a row for every TILE documents of large blocks
        runs = F.broadcast(runs)
    tiled = materialise(light.join(runs, ["block", "run"], "left").select("doc_id", "block", tile.alias("tile"), "node", "n"), "jaccard-tiles")
    discard(light)
    discard(blocks)

    large = tiled.filter("tile > 0")
    hubs = large.groupBy("block").agg(F.min_by("doc_id", "node").alias("doc_id"), F.min("node").alias("node"))
    extra = large.select("block", "tile").distinct().join(hubs, "block")
    inside = tiled.select("doc_id", "block", "tile", "node").unionByName(extra)
    parts = partitions_for(spark, total, 20_000_000)
    inside = _with_sets(source, inside, shingle).repartition(parts, "block", "tile").sortWithinPartitions("block", "tile")
    found = materialise(inside.mapInArrow(_tile_links(t), "a bigint, b bigint"), "jaccard-links")

    if large.limit(1).count():
        found = found.unionAll(_across(source, large, found, shingle, t))
    classes = components(found, "jaccard-classes")
    discard(found)
    discard(tiled)
    return classes


def _across(source: DataFrame, large: DataFrame, found: DataFrame, shingle: int, t: Threshold) -> DataFrame:
    """Links between tiles of the blocks that have several, where the classes found so far differ."""
    spark = large.sparkSession
    classes = components(found, "jaccard-tile-classes")
    named = large.join(classes, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    per_label = named.groupBy("block", "label").agg(F.count("*").alias("n_label"))
    main = per_label.groupBy("block").agg(F.max_by("label", F.struct("n_label", "label")).alias("main"))
    named = materialise(named.join(main, "block").withColumn("astray", F.col("label") != F.col("main")), "jaccard-named")
    discard(classes)
    tiles = named.groupBy("block", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("astray").alias("astray"))
    other = tiles.select("block", *(F.col(c).alias(f"{c}2") for c in ("tile", "low", "high", "astray")))
    p, q = t
    pairs = tiles.join(other, "block").filter("tile < tile2 and (astray or astray2)").filter((q * F.col("high") >= p * F.col("low2")) & (q * F.col("high2") >= p * F.col("low")))
    pairs = materialise(pairs.withColumn("pair", F.xxhash64("block", "tile", "tile2")).select("block", "tile", "tile2", "pair", "astray", "astray2"), "jaccard-tile-pairs")
    # A document of the main class is needed only where the other tile has one astray.
    left = named.join(pairs.select("block", "tile", "pair", F.col("astray2").alias("needed")), ["block", "tile"]).withColumn("side", F.lit(0))
    right = named.join(pairs.select("block", F.col("tile2").alias("tile"), "pair", F.col("astray").alias("needed")), ["block", "tile"]).withColumn("side", F.lit(1))
    sketches = materialise(_with_sets(source, large.select("doc_id", "node"), shingle, True).dropDuplicates(["node"]).withColumnRenamed("node", "sketched"), "jaccard-sketches")
    sides = left.unionByName(right).filter("needed or astray").select("pair", "side", "label", "node", "doc_id", "n").join(sketches, F.col("node") == F.col("sketched"))
    parts = partitions_for(spark, pairs.count(), 8)
    sides = sides.select("pair", "side", "label", "node", "doc_id", "n", "shingles").repartition(parts, "pair").sortWithinPartitions("pair")
    # Sketches tell who may have a link across; only their sets are sent.
    sides = materialise(sides.mapInArrow(_needed(t), "doc_id bigint, pair bigint, side int, label bigint, node bigint"), "jaccard-sides")
    return _with_sets(source, sides, shingle).repartition(parts, "pair").sortWithinPartitions("pair").mapInArrow(_cross_links(t), "a bigint, b bigint")


def _classes_of_rows(docs: DataFrame, shingle: int, threshold: Threshold, key: str, text: str) -> DataFrame:
    """doc_id, digest (of the text), n, component_id, component (the class itself: two may have the same smallest id), of every row."""
    if not 0 < threshold[0] <= threshold[1]:
        raise ValueError("threshold must be a fraction above 0 and at most 1")
    source = doc_columns(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    described = source.withColumn("digest", F.xxhash64("text")).mapInArrow(_describe(shingle), "doc_id bigint, n bigint, node bigint, digest bigint")
    described = materialise(described, "jaccard-described")
    classes = _linked_nodes(source, described, shingle, threshold)
    least = described.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = least.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(named.join(smallest, "component").select("node", "component", "component_id"), "jaccard-named-classes")
    discard(classes)
    return described.join(named, "node", "left").select("doc_id", "digest", "n", F.coalesce("component_id", "doc_id").alias("component_id"), "component")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, threshold: Threshold = (80, 100), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Words are cut at ASCII white space after lower-casing A-Z. Two documents link when
    ``threshold[1] * intersection >= threshold[0] * union`` of their shingle sets. A document with fewer
    words than ``shingle`` has its whole sequence as the only shingle. Null or empty texts have 0 shingles and
    are linked with nothing; repeated rows are each returned, and rows with equal ids and different texts are documents of
    their own. Names of shingles and sets are 64-bit hashes.
    """
    rows = _classes_of_rows(docs, shingle, threshold, key, text)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, *, shingle: int = 5, threshold: Threshold = (80, 100), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, all columns kept: the smallest id, of several texts under it the smallest digest.

    Repeated rows of the chosen document are one document. Rows without an id or without words stay.
    """
    rows = materialise(_classes_of_rows(docs, shingle, threshold, key, text).filter("component is not null and doc_id is not null").select("doc_id", "digest", "component"), "jaccard-rows")
    each = rows.groupBy("component", "doc_id", "digest").agg(F.count("*").alias("copies"))
    first = each.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    judged = materialise(each.join(first, "component").select(
        F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "copies", (F.struct("doc_id", "digest") != F.col("first")).alias("goes")).filter("goes or copies > 1"), "jaccard-gone")
    discard(rows)

    names = [f"__c{i}" for i in range(len(docs.columns))]  # columns may be named as these are
    at = {c: F.col(n) for c, n in zip(docs.columns, names, strict=True)}
    marked = docs.toDF(*names)
    digest = F.xxhash64(F.coalesce(at[text].cast("string"), F.lit("")).cast("binary"))

    def matches(side: DataFrame):
        small = side.count() <= BROADCAST_ROWS
        return (F.broadcast(side) if small else side), (at[key].cast("bigint") == F.col("__id")) & (digest == F.col("__digest"))

    gone, on = matches(judged.filter("goes").select("__id", "__digest"))
    kept = marked.join(gone, on, "left_anti")
    repeated = judged.filter("not goes").select("__id", "__digest")
    if repeated.limit(1).count():
        side, on = matches(repeated)
        once = marked.join(side, on).dropDuplicates(["__id", "__digest"]).select(*names)
        kept = kept.join(side, on, "left_anti").unionAll(once)
    return kept.toDF(*docs.columns)
