"""Packing of token sequences by patterns: non-negative least squares over few-document length patterns.

Documents are tokenised once; every piece of at most ``size`` tokens is a row with its length. What has to be decided
depends only on how many pieces there are of each length, a histogram of ``size`` numbers at any corpus size:

1. Patterns of one to three lengths that fill a sequence exactly are enumerated (``triples``).
2. Repeat counts are fitted to the histogram by non-negative least squares (``fit_repeats``), an active set that takes
   several patterns at a time and solves the passive ones by conjugate gradients; a basic solution has no more patterns
   than there are lengths.
3. Counts are rounded to what the histogram still holds, largest first; the residual is packed by best fit decreasing on
   the histogram itself (``pack_residual``): the longest length and the fill that leaves the least room, as often as possible.

The plan is a list of slots (length, first number, how many, first sequence, offset). Pieces are numbered within their
length where they are read (``nth`` in a task, plus the counts of the tasks before it) and look their slot up; no piece is
compared with another, and a length that most pieces share is spread over all tasks.
"""

from __future__ import annotations

import base64
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propensia.llm.common import chunks, doc_columns
from propensia.session import materialise

MAX_SIZE = 16_384
"""Longest sequence that can be planned: the patterns enumerated on the driver are about size * size / 12."""


@cache
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a ranks file; its special token is the first free id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def triples(lengths: np.ndarray, size: int) -> np.ndarray:
    """Patterns (a <= b <= c, unused places 0) of the given lengths whose sum is exactly ``size``."""
    has = np.zeros(size + 1, bool)
    has[lengths] = True
    has[0] = True
    found = []
    for a in np.flatnonzero(has[: size // 3 + 1]).tolist():
        b = np.arange(a, (size - a) // 2 + 1)
        c = size - a - b
        good = has[b] & has[c] & ((b > 0) | (a == 0)) & (c <= size)
        found.append(np.stack([np.full(int(good.sum()), a), b[good], c[good]], 1))
    return np.concatenate(found).astype(np.int32) if found else np.empty((0, 3), np.int32)


def fit_repeats(histogram: np.ndarray, patterns: np.ndarray, *, batch: int = 128, rounds: int = 60, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(pattern numbers, repeats >= 0) minimising the squared difference between pieces used and the histogram.

    An active-set method with block pivoting: patterns with the steepest descent that share no length enter together, the
    passive set is solved without bounds, and patterns that come out negative leave, until none does. It ends when the
    error is within ``tolerance`` of the histogram or falls by less than a fiftieth in a round.
    Residuals are weighted by length, since a long piece left over costs more room.
    """
    size = len(histogram) - 1
    weight = np.arange(size + 1) / size
    weight[0] = 0.0
    target = histogram.astype(float)
    scale = float((weight * target * weight * target).sum()) or 1.0
    passive, x, error = np.empty(0, np.int64), np.empty(0), np.inf

    def used(p, v):
        return np.bincount(patterns[p].ravel(), np.repeat(v, 3), size + 1)

    def gradient(p, residual):
        return (weight * weight * residual)[patterns[p]].sum(1)

    def solve(p, start):
        v = start.copy()
        g = gradient(p, target - used(p, v))
        d, gg = g.copy(), float(g @ g)
        for _ in range(60):
            if gg <= 1e-14 * scale:
                break
            q = used(p, d)
            step = gg / max(float((weight * q * weight * q).sum()), 1e-300)
            v += step * d
            g = gradient(p, target - used(p, v))
            gg, old = float(g @ g), gg
            d = g + gg / old * d
        return v

    everything = np.arange(len(patterns))
    for _ in range(rounds):
        residual = target - (used(passive, x) if len(passive) else 0.0)
        if float((weight * residual * weight * residual).sum()) <= tolerance * tolerance * scale:
            break
        slope = gradient(everything, residual)
        slope[passive] = 0.0
        best = np.argpartition(-slope, min(32 * batch, len(slope) - 1))[: 32 * batch]
        best = best[np.lexsort((best, -slope[best]))]
        taken, entering = set(), []
        for p in best[slope[best] > 1e-9].tolist():
            lengths = set(patterns[p].tolist()) - {0}
            if not lengths & taken:
                taken |= lengths
                entering.append(p)
                if len(entering) == batch:
                    break
        if not entering:
            break
        passive, x = np.append(passive, entering), np.append(x, np.zeros(len(entering)))
        while len(passive):  # patterns that the free solution makes negative leave together
            x = solve(passive, np.maximum(x, 0.0))
            if not (x < 0).any():
                break
            passive, x = passive[x > 0], x[x > 0]
        left = target - used(passive, x)
        now = float((weight * left * weight * left).sum())
        if now > 0.98 * error:
            break
        error = now
    return passive, x


def pack_residual(left: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """[(lengths, repeats)] using up the histogram ``left``: longest first, filled with what leaves the least room.

    Every step compares one and two further lengths and takes its pattern as often as the histogram allows, so the
    number of steps is bounded by the lengths, not by the pieces.
    """
    left = left.copy()
    out = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return out
        pattern = [int(there[-1])]
        room = size - pattern[0]
        have = left.copy()
        have[pattern[0]] -= 1
        while room > 0:
            fits = np.flatnonzero(have[: room + 1])
            if not len(fits):
                break
            one = int(fits[-1])
            add = [one]
            if one < room and len(fits) > 1:
                partner = fits[np.searchsorted(fits, room - fits, "right") - 1]
                total = np.where((fits + partner <= room) & ((fits != partner) | (have[fits] > 1)), fits + partner, 0)
                k = int(total.argmax())
                if total[k] > one:
                    add = [int(fits[k]), int(partner[k])]
            for length in add:
                have[length] -= 1
                room -= length
                pattern.append(length)
        lengths, times = np.unique(pattern, return_counts=True)
        repeats = int((left[lengths] // times).min())
        left[lengths] -= times * repeats
        out.append((pattern, repeats))


def plan(histogram: np.ndarray) -> list[tuple[list[int], int]]:
    """[(lengths of a sequence, how many such sequences)] that use every piece of the histogram exactly once."""
    size = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out = [([size], int(left[size]))] if left[size] else []  # a full piece is a sequence of its own
    left[size] = 0
    lengths = np.flatnonzero(left)
    patterns = triples(lengths, size) if len(lengths) else np.empty((0, 3), np.int32)
    if len(patterns):
        chosen, x = fit_repeats(left, patterns)
        for k in np.argsort(-x, kind="stable").tolist():
            parts = [int(v) for v in patterns[chosen[k]] if v]
            need, times = np.unique(parts, return_counts=True)
            repeats = min(int(x[k] + 0.5), int((left[need] // times).min()))
            if repeats > 0:
                left[need] -= times * repeats
                out.append((parts, repeats))
    return out + pack_residual(left, size)


def slots(packed: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first number, how many, first sequence, offset), sorted by length and number."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, repeats in packed:
        offset = 0
        for length in pattern:
            first = used.get(length, 0)
            rows.append((length, first, repeats, sequence, offset))
            used[length] = first + repeats
            offset += length
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _cut(path: str, pattern: str, size: int, end: int, with_ids: bool):
    """Pieces of each document with their length, digest and their number among the task's pieces of that length."""

    def run(batches):
        enc, part, seen = encoding(path, pattern), TaskContext.get().partitionId(), [0] * (size + 1)
        special = "<|endoftext|>"
        for keys, texts in chunks(batches):
            doc, piece, start, length, crc, nth, held = [], [], [], [], [], [], []
            for key, raw in zip(keys, texts, strict=True):
                text = raw.decode()
                ids = enc.encode(text, allowed_special="all", disallowed_special=()) if special in text else enc.encode_ordinary(text)
                ids.append(end)
                packed = np.array(ids, np.uint32).tobytes()
                at, k = 0, 0
                while at < len(ids):
                    n = (len(ids) - 1) % size + 1 if at == 0 else size
                    body = packed[4 * at : 4 * (at + n)]
                    doc.append(key)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(body))
                    nth.append(seen[n])
                    if with_ids:
                        held.append(body)
                    seen[n] += 1
                    at, k = at + n, k + 1
            arrays = [pa.array(doc), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(doc), pa.int32()), pa.array(nth, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(held, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return run


def cut_pieces(docs: DataFrame, path: str, pattern: str, *, size: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` tokens, written once: doc_id, piece, start, length, ids_crc32, part, nth, ids if wanted.

    A document's tokens are followed by ``end``; only longer ones are cut, the first piece takes what does not fill a sequence.
    """
    source = doc_columns(docs, key, text)
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint" + ", ids binary" * with_ids
    return materialise(source.mapInArrow(_cut(path, pattern, size, end, with_ids), schema), "pieces")


def _place(table: np.ndarray, size: int):
    """Sequence and offset of the piece with a number within its length, by its slot."""
    by_length = {int(n): table[table[:, 0] == n] for n in np.unique(table[:, 0])} if len(table) else {}

    def run(batches):
        for batch in batches:
            length, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                rows, these = by_length[n], np.flatnonzero(length == n)
                k = np.searchsorted(rows[:, 1], number[these], "right") - 1
                sequence[these] = rows[k, 3] + number[these] - rows[k, 1]
                offset[these] = rows[k, 4]
            columns = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*batch.schema.names[2:], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, pattern: str, *, size: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): every piece's place in a sequence.

    Sequences hold at most ``size`` tokens, their pieces lie one behind the other from 0. ``path`` is a file of ranked
    byte tokens and ``pattern`` its word pattern; the string of its special token in a text is that token.

    A null or empty text is one piece that holds ``end`` alone; repeated rows and equal or null ids are documents of
    their own; other columns are not read; an empty table gives no rows. Texts are cut whatever their length.
    """
    if not 1 <= size <= MAX_SIZE:
        raise ValueError(f"size must be 1 to {MAX_SIZE}")
    pieces = cut_pieces(docs, path, pattern, size=size, end=end, key=key, text=text, with_ids=with_ids)
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(size + 1, np.int64)
    for length, n in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``size`` rows
        histogram[length] = n
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(starts, ["part", "length"]).withColumn("number", F.col("before") + F.col("nth"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    source = numbered.select(F.col("length").alias("n"), "number", *columns)
    schema = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in columns) + ", sequence_id bigint, offset bigint"
    return source.mapInArrow(_place(slots(plan(histogram)), size), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, length, ids): the packed sequences themselves, from ``pack(..., with_ids=True)``.

    A sequence holds at most ``size`` tokens, so gathering its pieces is bounded.
    """
    gathered = packed.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return gathered.select("sequence_id", "n_pieces", "length", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))
