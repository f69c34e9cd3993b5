"""Shared pieces of the text operators: tables, words, hashes and task-side iteration.

Texts travel to Python tasks as UTF-8 bytes in Arrow batches. The two kinds of words that the
operators use are defined by ASCII bytes alone, so bytes can be cut without decoding: bytes from
0x80 upward belong to characters outside ASCII, which always count as part of a word.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
"""Text bytes that a task works on at a time; bounds the arrays derived from them."""

CACHE_WORDS = 150_000
"""Distinct words whose derived values a task keeps; the cache starts afresh beyond it."""

BATCH_ROWS = 512
"""Most rows of an Arrow batch: Spark's limit counts rows, and rows here are whole texts."""


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to BATCH_ROWS; a session that set fewer keeps its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ALNUM = bytes(_LOWER[b] if chr(_LOWER[b]).isalnum() or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: bytes) -> bytes:
    """A-Z lower-cased, everything else untouched."""
    return text.translate(_LOWER)


def alnum_words(text: bytes) -> list[bytes]:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text after lower-casing A-Z."""
    return text.translate(_ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+``; bytes.split() cuts at exactly these six characters."""
    return text.split()


class WordHashes(dict):
    """64-bit hash of a word, remembered per task; two words collide with probability 2**-64."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive 64-bit hash of every run of ``n`` values; one per start."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    k = _MIX[0]
    with np.errstate(over="ignore"):
        for j in range(n):
            out = (out + h[j : j + m]) * k
            k = k * _MIX[0] | np.uint64(1)
        return mix(out)


def as_signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return x.astype(np.uint64).view(np.int64)


def doc_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text as bytes, a null text as an empty one; other columns are left out of the task."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"))


def chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(keys, texts) of about ``limit`` bytes each; a single longer text is a chunk of its own."""
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)) if len(texts) else np.empty(0, np.int64)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield keys.slice(start, i - start).to_pylist(), texts.slice(start, i - start).to_pylist()
                start, held = i, 0
            held += int(size)
        if start < len(sizes):
            yield keys.slice(start).to_pylist(), texts.slice(start).to_pylist()


def filter_rows(docs: DataFrame, text: str, make_keep: Callable[[], Callable[..., list[bool]]], also: tuple[str | None, ...] = ()) -> DataFrame:
    """Rows of ``docs`` for which a task-side function says so, all columns as they are, without a shuffle.

    ``make_keep()`` runs once per task and returns a function of a list of texts (bytes, null as empty) and,
    for each name in ``also``, the list of that column's values as strings (None where there is none).
    """
    bounded_batches(docs.sparkSession)
    first = [F.lit(0).alias("k"), F.col(f"`{text}`").cast("string").cast("binary").alias("t")]
    extra = [F.col(f"`{a}`").cast("string").alias(f"a{i}") if a else F.lit(None).cast("string").alias(f"a{i}") for i, a in enumerate(also)]
    rest = [(i, c) for i, c in enumerate(docs.columns) if c != text]
    source = docs.select(*first, *extra, *(F.col(f"`{c}`").alias(f"c{i}") for i, c in rest))
    kept, n_extra = ["t", *(f"c{i}" for i, _ in rest)], len(extra)

    def run(batches):
        keep = make_keep()
        for batch in batches:
            filled = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).fill_null(b"")], ["k", "t"])
            values, mask = [batch.column(2 + j).to_pylist() for j in range(n_extra)], []
            for _, texts in chunks([filled]):
                mask += keep(texts, *(v[len(mask) : len(mask) + len(texts)] for v in values))
            yield batch.select(kept).filter(pa.array(mask, pa.bool_()))

    done = source.mapInArrow(run, source.select(*kept).schema)
    return done.select(*(F.col("t").cast("string").alias(c) if c == text else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def rows_by_key(batches: Iterable[pa.RecordBatch], n_keys: int = 1) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first ``n_keys`` columns; the input is sorted by them."""
    current, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = row[:n_keys]
            if key != current:
                if held:
                    yield current, held
                current, held = key, []
            held.append(row[n_keys:])
    if held:
        yield current, held


def record_batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for f, v in zip(schema, columns.values(), strict=True)], schema=schema)


def partitions_for(spark: SparkSession, size: float, per_partition: float) -> int:
    """Partitions that keep ``per_partition`` units each, at least the session's shuffle setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / per_partition))


def is_held_out(key: str, modulus: int, remainder: int):
    """crc32 of the key written as text, modulo ``modulus``, equals ``remainder``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder
