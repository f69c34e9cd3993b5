"""Phrase collocations by a multikey three-way quicksort of suffix pointers.

A text is cut into pieces and those into words; a suffix pointer is a word's place, its key the words from there to the
end of the piece, at most ``max_words`` of them. Every task sorts the pointers of what it reads (``equal_partitions``):
the partition of pointers that equal the pivot is a phrase and its size a count. Different keys then travel once per task
piece, with their count, to the bucket of their leading word; leading words that make up a large share of the corpus are
routed by two words, and by three where the second is as frequent. There the keys are sorted again, the sizes of the
equal partitions are the counts of the corpus, and a partition that stays below ``min_count`` is abandoned with all
longer phrases in it.

Words are the texts' own bytes throughout; no hash stands for them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propensia.llm.common import bounded_batches, mix, partitions_for, rows_by_key
from propensia.session import materialise

POINTERS = 1 << 20
"""Suffix pointers that a task sorts at a time."""

BUCKET_KEYS = 1 << 20
"""Words of the corpus per bucket; a bucket is what one task sorts at a time."""

SHARE = 2000
"""A word is frequent when it makes up 1/SHARE of the corpus; there are at most SHARE of them."""

SHARES = 32
"""Parts of a language's candidates that are ranked before its final ranking, which so sorts SHARES * top rows at most."""

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_CLEAN = bytes(ord(".") if b in _BREAKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def piece_words(text: bytes) -> list[bytes]:
    """Words of the text in order, A-Z lower-cased, with ``b"."`` at every cut between pieces."""
    return text.translate(_CLEAN).replace(b".", b" . ").split()


class _Ids(dict):
    """Numbers words from 1 in order of appearance; 0 is the cut between pieces."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i


def equal_partitions(
    symbols: np.ndarray, pointers: np.ndarray, weights: np.ndarray, depth: int, least: int, wide: np.ndarray, *, leaves: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, pointer, weight) of the partitions of pointers with equal leading symbols, up to ``depth`` of them.

    Symbol 0 ends a key. Partitions lighter than ``least`` are abandoned, except below a leading symbol marked in
    ``wide``, whose pointers are spread over several calls: those of one or two symbols are returned whatever they weigh
    where all their symbols are wide. ``leaves`` returns each different key once, at its full length, instead.

    All partitions of one round are split together: pivots are taken from the middle of each, and pointers move by
    counting into the places of smaller, equal and greater ones. The first symbol is dealt by counting.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(symbols[pointers], kind="stable")
    ptr, w = pointers[order], weights[order]
    first = symbols[ptr]
    starts = np.flatnonzero(np.concatenate(([len(ptr) > 0], first[1:] != first[:-1]))) if len(ptr) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(ptr)))
    level = np.ones(len(starts), np.int8)  # symbols known to be equal in the partition

    def settle(ptr, w, sizes, level, fresh):
        """Report partitions known to be equal, leave out those that are done; ``fresh`` marks the newly equal ones."""
        starts = np.cumsum(sizes) - sizes
        total = np.add.reduceat(w, starts) if len(starts) else np.empty(0, w.dtype)
        head = ptr[starts]
        ended = symbols[head + level.astype(np.int64) - 1] == 0 if len(head) else np.empty(0, bool)
        if leaves:
            done = fresh & (ended | (level == depth)) | (sizes == 1)
            out.append((level[done], head[done], total[done]))
            stay = ~done
        else:
            spread = wide[symbols[head]] if len(head) else np.empty(0, bool)
            second = wide[symbols[head + np.minimum(level, 2).astype(np.int64) - 1]] if len(head) else np.empty(0, bool)
            partial = spread & ((level == 1) | (level == 2) & second)
            report = fresh & ~ended & ((total >= least) | partial)
            out.append((level[report], head[report], total[report]))
            stay = ~(fresh & (ended | (level == depth))) & ((total >= least) | spread & (level == 1) | partial & (level == 2))
        kept = np.repeat(stay, sizes)
        return ptr[kept], w[kept], sizes[stay], level[stay]

    ptr, w, sizes, level = settle(ptr, w, sizes, level, np.ones(len(sizes), bool))
    while len(sizes):
        starts = np.cumsum(sizes) - sizes
        at = symbols[ptr + np.repeat(level.astype(np.int64), sizes)]
        pivot = at[starts + sizes // 2]
        step = np.repeat(pivot, sizes)
        side = (at >= step).astype(np.int8) + (at > step)
        n = len(sizes)
        counts = np.bincount(np.repeat(np.arange(n) * 3, sizes) + side, minlength=3 * n)
        place = (np.cumsum(counts) - counts).reshape(n, 3)
        counts = counts.reshape(n, 3)
        ptr2, w2 = np.empty_like(ptr), np.empty_like(w)
        for c in range(3):
            these = np.flatnonzero(side == c)
            of = counts[:, c]
            to = np.arange(len(these)) + np.repeat(place[:, c] - (np.cumsum(of) - of), of)
            ptr2[to], w2[to] = ptr[these], w[these]
        full = counts.ravel() > 0
        sizes = counts.ravel()[full]
        fresh = np.tile(np.array([False, True, False]), n)[full]
        level = np.repeat(level, 3)[full] + fresh.astype(np.int8)
        ptr, w, sizes, level = settle(ptr2, w2, sizes, level, fresh)
    if not out:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _streams(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[_Ids, dict[str, list[np.ndarray]]]]:
    """Word numbers by language of about POINTERS words at a time; a longer text makes a larger piece."""
    ids, held, streams = _Ids(), 0, {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = piece_words(text.as_py())
            words.append(b".")
            streams.setdefault(lang, []).append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
            held += len(words)
            if held >= POINTERS:
                yield ids, streams
                ids, held, streams = _Ids(), 0, {}
    if held:
        yield ids, streams


def _heavy(batches):
    """(lang, word, n): words that make up 1/SHARE of what is counted at a time, and all words (null) per language."""
    for ids, streams in _streams(batches):
        words = list(ids)
        seen = {lang: np.bincount(np.concatenate(parts), minlength=len(words)) for lang, parts in streams.items()}
        total = sum(int(c[1:].sum()) for c in seen.values())
        rows = []
        for lang, c in seen.items():
            c[0] = 0
            rows.append((lang, None, int(c.sum())))
            rows += [(lang, words[i], int(c[i])) for i in np.flatnonzero(c * SHARE >= max(total, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.int64()), strict=True)], ["lang", "word", "n"])


def _pack(words: list[bytes], keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys (rows of word numbers) with counts as one value that carries its own words."""
    used, local = np.unique(keys, return_inverse=True)
    table = b"\n".join([words[i] for i in used.tolist()])
    width = np.uint16 if len(used) <= 0xFFFF else np.uint32
    head = np.array([len(table), len(keys), width().itemsize], np.int64).tobytes()
    return head + table + local.reshape(keys.shape).T.astype(width).tobytes() + counts.astype(np.int64).tobytes()


def _unpack(blob: bytes, ids: _Ids, depth: int) -> tuple[np.ndarray, np.ndarray]:
    size, n, width = np.frombuffer(blob, np.int64, 3).tolist()
    numbers = np.fromiter(map(ids.__getitem__, blob[24 : 24 + size].split(b"\n")), np.int32)
    at = 24 + size
    keys = np.frombuffer(blob, np.uint16 if width == 2 else np.uint32, n * depth, at).reshape(depth, n)
    counts = np.frombuffer(blob[at + n * depth * width :], np.int64, n)
    return numbers[keys].T, counts


def _route(heavy: dict[str, frozenset], n_buckets: int, depth: int):
    """(bucket, lang, keys): the different keys of a task's texts, by the bucket of their leading words."""

    def run(batches):
        for ids, streams in _streams(batches):
            words = list(ids)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            hashes[0] = 0
            for lang, parts in streams.items():
                frequent = heavy.get(lang, frozenset())
                wide = np.fromiter((x in frequent for x in words), bool, len(words))
                symbols = np.concatenate([*parts, np.zeros(depth, np.int32)])
                pointers = np.flatnonzero(symbols)
                if not len(pointers):
                    continue
                length, head, count = equal_partitions(symbols, pointers, np.ones(len(pointers), np.int64), depth, 1, wide, leaves=True)
                keys = np.zeros((len(head), depth), np.int32)
                going = np.ones(len(head), bool)
                for d in range(depth):
                    keys[:, d] = np.where(going, symbols[head + d], 0)
                    going &= keys[:, d] > 0
                with np.errstate(over="ignore"):
                    route = hashes[keys[:, 0]] ^ np.uint64(xxhash.xxh3_64_intdigest(lang))
                    split = wide[keys[:, 0]]
                    for d in range(1, min(depth, 3)):  # equal leading three words always meet
                        route = np.where(split, mix(route) + hashes[keys[:, d]], route)
                        split &= wide[keys[:, d]]
                    bucket = (mix(route) % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, keys, count = bucket[order], keys[order], count[order]
                cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
                held, size = [], 0
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    held.append((int(bucket[a]), lang, _pack(words, keys[a:b], count[a:b])))
                    size += len(held[-1][2])
                    if size > 1 << 22:
                        yield _blobs(held)
                        held, size = [], 0
                if held:
                    yield _blobs(held)

    return run


def _blobs(rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    b, lang, keys = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(lang, pa.string()), pa.array(keys, pa.binary())], ["bucket", "lang", "keys"])


def _count(heavy: dict[str, frozenset], depth: int, least: int):
    """(lang, phrase, n_words, f) of the equal partitions of each bucket that are heavy enough or counted in parts."""

    def run(batches):
        for (_, lang), held in rows_by_key(batches, 2):
            ids, keys, counts = _Ids(), [], []
            while held:
                k, c = _unpack(held.pop()[0], ids, depth)
                keys.append(k)
                counts.append(c)
            words = list(ids)
            words[0] = b""
            frequent = heavy.get(lang, frozenset())
            wide = np.fromiter((x in frequent for x in words), bool, len(words))
            symbols = np.zeros((sum(map(len, keys)), depth + 1), np.int32)
            symbols[:, :depth] = np.concatenate(keys)
            del keys
            length, head, f = equal_partitions(symbols.ravel(), np.arange(len(symbols)) * (depth + 1), np.concatenate(counts), depth, least, wide)
            names = symbols[head // (depth + 1), :depth].tolist()
            phrases = [b" ".join([words[i] for i in row[:n]]) for row, n in zip(names, length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(length, pa.int32()), pa.array(f, pa.int64())],
                ["lang", "phrase", "n_words", "f"])

    return run


def word_totals(docs: DataFrame, *, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, word, n), written once: all words of each language (word null) and the most frequent ones."""
    return materialise(_source(docs, lang, text).mapInArrow(_heavy, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-totals")


def _source(docs: DataFrame, lang: str, text: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"))


def phrase_counts(docs: DataFrame, totals: DataFrame, *, lang: str = "lang", text: str = "text", max_words: int = 3, min_count: int = 10) -> DataFrame:
    """(lang, phrase, n_words, f) of all phrases of 1 to ``max_words`` words that occur ``min_count`` times in a language, written once.

    ``totals`` comes from ``word_totals``. Words of a phrase are joined by a space.
    """
    spark = docs.sparkSession
    everything = totals.where("word IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy: dict[str, set] = {}
    for name, word in totals.where(F.col("word").isNotNull() & (F.col("n") * SHARE >= F.lit(everything))).select("lang", "word").collect():
        heavy.setdefault(name, set()).add(bytes(word))
    frozen = {k: frozenset(v) for k, v in heavy.items()}
    n_buckets = partitions_for(spark, everything, BUCKET_KEYS)
    keys = _source(docs, lang, text).mapInArrow(_route(frozen, n_buckets, max_words), "bucket int, lang string, keys binary")
    dealt = keys.repartitionById(n_buckets, "bucket").sortWithinPartitions("bucket", "lang")
    counted = dealt.mapInArrow(_count(frozen, max_words, min_count), "lang string, phrase string, n_words int, f bigint")
    return materialise(counted.groupBy("lang", "phrase", "n_words").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count), "phrase-counts")


def collocations(
    docs: DataFrame, *, lang: str = "lang", text: str = "text", max_words: int = 3, min_count: int = 10, covered: tuple[int, int] = (50, 100), top: int = 2000
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` best phrases of 2 to ``max_words`` words of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its weakest cut, ``n`` all words of the language; the score is
    floor(1,000,000 a a / (l r)), exact (products have 38 digits). A phrase is left out when a longer candidate that
    contains it occurs at least ``covered`` of its times. Ranks order by score and ``a`` downwards, then by the phrase's bytes.

    A null lang is ``und``, a null or empty text has no words; repeated rows count again. An empty table, or one without
    a phrase that is frequent enough, gives no rows. Other columns are not read.
    """
    totals = word_totals(docs, lang=lang, text=text)
    counts = phrase_counts(docs, totals, lang=lang, text=text, max_words=max_words, min_count=min_count)
    part = counts.select("lang", F.col("phrase").alias("part"), "f")
    candidates = counts.where("n_words > 1").withColumnRenamed("f", "a")

    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', cut)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    cuts = cuts.join(part.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(part.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = "CAST({} AS DECIMAL(19, 0))"
    score = f"CAST(1000000 AS DECIMAL(7, 0)) * ({wide.format('a')} * {wide.format('a')}) div ({wide.format('l')} * {wide.format('r')})"
    scored = cuts.withColumn("score", F.expr(score)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    longer = candidates.where("n_words > 2")
    inner = F.expr("flatten(transform(sequence(2, n_words - 1), m -> transform(sequence(1, n_words - m + 1), s -> array_join(slice(split(phrase, ' '), s, m), ' '))))")
    cover = longer.select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
    kept = scored.join(cover, ["lang", "phrase"], "left").where(F.col("cover").isNull() | (F.col("cover") * covered[1] < F.col("a") * covered[0]))

    order = F.desc("best.score"), F.desc("a"), "phrase"
    # the best of each share of a language first: what its last ranking sorts is bounded at any number of candidates
    kept = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    n = totals.where("word IS NULL").select("lang", "n")
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
