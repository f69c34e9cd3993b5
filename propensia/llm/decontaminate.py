"""Benchmark decontamination: which document words lie inside a passage of a benchmark item.

Prefix-filtered set join. Every window of item words is a set of short shingles. Shingles are
ordered by rarity over the whole corpus; a window that is contained in a document brings all its
shingles along, so the rarest one alone (a prefix of length one under exact containment) finds
every occurrence. A document position that holds such a shingle is a candidate; length and
positional bounds drop windows that would start before or end behind the document, and the
remaining ones are compared word by word. Equal windows of the items are one window, and a place of
the text is looked up by the hash of its own window, so that time grows with the text alone, also where
an item or a document repeats a word or a phrase throughout.

The item side is handled in blocks of bounded size (``BLOCK_CHARS``); each block is one pass for
rarity and one for the join over all documents, without a shuffle of text. With several blocks the documents
are written once with a row number, by which the findings of a row are united.

Defined results: a null or empty text has no words and no hits; an empty benchmark hits nothing; an
item without words has no window; rows with the same item id are one item; repeated document rows each get their row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensia.llm.common import WordHashes, alnum_words, chunks, doc_columns, filter_rows, window_hashes
from propensia.session import materialise

WINDOW = 10
SHINGLE = 3
BLOCK_CHARS = 8_000_000
"""Benchmark characters sent to the executors at a time; a block takes about 12 bytes a character (measured, 200-word items)."""

_FILTER_BITS = 22


class ItemBlock:
    """Different windows of a block of items and, once ranked, the rarest shingle of each.

    Words are numbers into a vocabulary; equal windows are one, with the items that hold it. All of it is arrays.
    """

    def __init__(self, items: list[tuple], window: int, shingle: int):
        self.window, self.shingle = window, shingle
        self.ids = [str(i) for i, _ in items]
        numbers, hashes = {}, WordHashes()
        words, self.own, windows = [], [], []
        for _, text in items:
            own = alnum_words((text or "").encode())
            h = hashes.of(own)
            length = min(window, len(own))
            words.append(np.array([numbers.setdefault(w, len(numbers)) for w in own], np.int32))
            self.own.append(self._shingles(h) if own else np.empty(0, np.uint64))
            windows.append(window_hashes(h, length) ^ np.uint64(length) if own else np.empty(0, np.uint64))
        self.vocabulary = list(numbers)
        self.sizes = sorted({min(shingle, len(w)) for w in words if len(w)})
        self.tokens = np.unique(np.concatenate([np.empty(0, np.uint64), *self.own]))
        self._group(words, windows)
        self.prefix_keys = np.empty(0, np.uint64)

    def _shingles(self, h: np.ndarray) -> np.ndarray:
        n = min(self.shingle, len(h))
        own = window_hashes(h, n)
        return own if n == self.shingle else own ^ np.uint64(n)

    def _group(self, words: list[np.ndarray], windows: list[np.ndarray]) -> None:
        """One window for all equal ones: ``keys`` (sorted hashes), ``starts`` and ``lengths`` in ``flat``, items of each."""
        counts = np.array([len(w) for w in windows], np.int64)
        begins = np.cumsum([0, *(len(w) for w in words)])[:-1]
        self.flat = np.concatenate([np.empty(0, np.int32), *words])
        keys = np.concatenate([np.empty(0, np.uint64), *windows])
        items = np.repeat(np.arange(len(windows)), counts)
        inner = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = begins[items] + inner if len(keys) else np.empty(0, np.int64)
        lengths = np.minimum(self.window, np.array([len(w) for w in words], np.int64))[items] if len(keys) else np.empty(0, np.int64)
        order = np.argsort(keys, kind="stable")
        keys, items, starts, lengths, inner = keys[order], items[order], starts[order], lengths[order], inner[order]
        leader = np.searchsorted(keys, keys)
        # Equal hashes of different words stay windows of their own.
        same = lengths == lengths[leader]
        for j in range(self.window):
            at = np.flatnonzero(same & (lengths > j))
            same[at] = self.flat[starts[at] + j] == self.flat[starts[leader[at]] + j]
        first, number = np.unique(np.where(same, leader, np.arange(len(keys))), return_inverse=True)
        self.keys, self.starts, self.lengths, self._place = keys[first], starts[first], lengths[first], (items[first], inner[first])
        held = np.unique(np.stack([number, items]), axis=1) if len(keys) else np.empty((2, 0), np.int64)
        self.item_numbers = held[1].astype(np.int32)
        self.item_ends = np.searchsorted(held[0], np.arange(len(first) + 1))

    def rank(self, counts: np.ndarray) -> None:
        """Choose each window's rarest shingle; ties fall to the smaller hash, then to the first place."""
        place = np.empty(len(counts), np.int64)
        place[np.lexsort((self.tokens, counts))] = np.arange(len(counts))
        tokens, offsets = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for own in self.own:
            if len(own):
                at = np.searchsorted(self.tokens, own)
                inside = min(len(own), self.window - self.shingle + 1)
                best = np.lib.stride_tricks.sliding_window_view(place[at], inside).argmin(1)
                tokens.append(at[np.arange(len(best)) + best])
                offsets.append(best)
        # A window's place among all windows of all items, in the order in which they were just made.
        sizes = np.array([max(0, len(own) - min(len(own), self.window - self.shingle + 1) + 1) if len(own) else 0 for own in self.own], np.int64)
        item, inner = self._place
        at = (np.cumsum(sizes) - sizes)[item] + inner if len(item) else np.empty(0, np.int64)
        found = np.stack([np.concatenate(tokens)[at], np.concatenate(offsets)[at], self.lengths]) if len(at) else np.empty((3, 0), np.int64)
        found = np.unique(found, axis=1)
        held = np.unique(found[0])
        self.prefix_keys, self.offsets, self.sizes_at = self.tokens[held], found[1], found[2]
        self.ends = np.searchsorted(found[0], np.append(held, len(self.tokens)))
        self.own = []

    def words_of(self, window: int) -> list[bytes]:
        start = self.starts[window]
        return [self.vocabulary[i] for i in self.flat[start : start + self.lengths[window]].tolist()]

    def items_of(self, window: int) -> list[str]:
        return [self.ids[i] for i in self.item_numbers[self.item_ends[window] : self.item_ends[window + 1]].tolist()]

    def candidates(self, h: np.ndarray, at: np.ndarray, where: np.ndarray):
        """(starts, windows) in a text of word hashes ``h`` for prefixes number ``where`` at the positions ``at``.

        A prefix names few pairs of (place inside a window, length of the window), whatever the number of its windows;
        one look-up of the text's own window decides each, so repetition costs no more than other text.
        """
        n = self.ends[where + 1] - self.ends[where]
        pair = _spread(self.ends[where], n)
        start, size = np.repeat(at, n) - self.offsets[pair], self.sizes_at[pair]
        inside = (start >= 0) & (start + size <= len(h))
        for length in np.unique(size[inside]).tolist():
            begin = np.unique(start[inside & (size == length)])
            keys = window_hashes(h, length)[begin] ^ np.uint64(length)
            low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
            yield np.repeat(begin, high - low), _spread(low, high - low)

    def positions(self, h: np.ndarray, among: np.ndarray, seen: np.ndarray):
        """(positions, keys, places) of the shingles of ``h`` that occur in the sorted array ``among``."""
        if not len(among):
            return
        for n in self.sizes:
            own = window_hashes(h, n)
            own = own if n == self.shingle else own ^ np.uint64(n)
            at = np.flatnonzero(seen[own & np.uint64((1 << _FILTER_BITS) - 1)])
            keys = own[at]
            where = np.minimum(np.searchsorted(among, keys), len(among) - 1)
            same = among[where] == keys
            yield at[same], keys[same], where[same]


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers ``begin[i], begin[i] + 1, ...`` (``n[i]`` of them) for every i, one after the other."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _filter(keys: np.ndarray) -> np.ndarray:
    """First look: one bit per hash suffix that occurs among the keys."""
    seen = np.zeros(1 << _FILTER_BITS, bool)
    seen[keys & np.uint64((1 << _FILTER_BITS) - 1)] = True
    return seen


def _count(block):
    def run(batches):
        own, cache = block.value, WordHashes()
        seen, total = _filter(own.tokens), np.zeros(len(own.tokens), np.int64)
        for _, texts in chunks(batches):
            for text in texts:
                words = alnum_words(text)
                if words:
                    for _, _, where in own.positions(cache.of(words), own.tokens, seen):
                        np.add.at(total, where, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["token", "n"])

    return run


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


class Matcher:
    """Occurrences of a block's windows in a text."""

    def __init__(self, block: ItemBlock):
        self.block, self.cache, self.seen = block, WordHashes(), _filter(block.prefix_keys)

    def __call__(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[str]]:
        """(number of words, word ranges of occurrences, sorted ids of their items)."""
        own, words, found, known = self.block, alnum_words(text), [], {}
        if words:
            h = self.cache.of(words)
            for at, _, where in own.positions(h, own.prefix_keys, self.seen):
                for starts, windows in own.candidates(h, at, where):
                    for s, w in zip(starts.tolist(), windows.tolist(), strict=True):
                        wanted = known.get(w) or own.words_of(w)
                        if words[s : s + len(wanted)] == wanted:
                            known[w] = wanted
                            found.append((s, s + len(wanted)))
        return len(words), _merged(found), sorted({i for w in known for i in own.items_of(w)})


def _match(block, key_type: pa.DataType = pa.int64()):  # noqa: B008
    schema = _SCHEMA.set(0, pa.field("doc_id", key_type))

    def run(batches):
        matcher = Matcher(block.value)
        for keys, texts in chunks(batches):
            n_words, spans, items = zip(*map(matcher, texts), strict=True)
            flat = [[x for pair in s for x in pair] for s in spans]
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(n_words, pa.int64()), pa.array(flat, _SCHEMA.field("spans").type), pa.array(items, _SCHEMA.field("items").type)], schema=schema)

    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _merge_blocks(batches):
    for batch in batches:
        spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
        merged = [_merged([tuple(s[i : i + 2]) for s in doc for i in range(0, len(s), 2)]) for doc in spans]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array([[x for p in m for x in p] for m in merged], _SCHEMA.field("spans").type),
             pa.array([sorted({i for part in doc for i in part}) for doc in items], _SCHEMA.field("items").type)], schema=_SCHEMA)


def _items(benchmark: DataFrame, item_key: str, item_text: str) -> DataFrame:
    return benchmark.select(F.col(f"`{item_key}`").cast("string").alias("item"), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("text"))


def _n_blocks(items: DataFrame, limit: int) -> int:
    return (items.agg(F.sum(F.length("text"))).first()[0] or 0) // limit + 1


def _item_blocks(benchmark: DataFrame, item_key: str, item_text: str, limit: int):
    """Item rows in blocks of about ``limit`` characters; one block is on the driver at a time."""
    items = _items(benchmark, item_key, item_text)
    n = _n_blocks(items, limit)
    if n == 1:
        yield [tuple(r) for r in items.collect()]
        return
    items = materialise(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))), "benchmark-blocks")
    for b in range(n):
        yield [(r[0], r[1]) for r in items.filter(F.col("block") == b).collect()]


def _ranked(source: DataFrame, block: ItemBlock) -> ItemBlock:
    """The block with its prefixes chosen by the number of occurrences over all documents."""
    counts = np.zeros(len(block.tokens), np.int64)
    if len(counts):
        counted = source.mapInArrow(_count(source.sparkSession.sparkContext.broadcast(block)), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
        for token, n in counted.collect():  # bounded: one row per shingle of the block
            counts[token] = n
    block.rank(counts)
    return block


def find_passages(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, shingle: int = SHINGLE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document row: doc_id, n_words, spans (merged word ranges start, end, start, end, ...) and items (sorted ids).

    ``window`` consecutive item words make a passage; an item of fewer words is one passage.
    """
    spark, parts = docs.sparkSession, []
    source = doc_columns(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    key_ddl, key_type = "bigint", pa.int64()
    if _n_blocks(_items(benchmark, item_key, item_text), block_chars) > 1:
        # Ids may repeat or be null: the row number names the row.
        numbered = source.select(F.struct(F.monotonically_increasing_id().alias("row"), "doc_id").alias("doc_id"), "text")
        source = materialise(numbered, "benchmark-documents")
        key_ddl, key_type = "struct<row: bigint, doc_id: bigint>", pa.struct([("row", pa.int64()), ("doc_id", pa.int64())])
    for items in _item_blocks(benchmark, item_key, item_text, block_chars):
        block = _ranked(source, ItemBlock(items, window, shingle))
        parts.append(source.mapInArrow(_match(spark.sparkContext.broadcast(block), key_type), f"doc_id {key_ddl}, n_words bigint, spans array<bigint>, items array<string>"))
    if len(parts) == 1:
        return parts[0]
    # Blocks of a larger benchmark: unite the findings of a row.
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    grouped = every.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    return grouped.withColumn("doc_id", F.col("doc_id.doc_id")).mapInArrow(_merge_blocks, "doc_id bigint, n_words bigint, spans array<bigint>, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, shingle: int = SHINGLE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows without any benchmark passage, all columns as they are; one counting and one filtering pass a block."""
    source = doc_columns(docs.withColumn("__place", F.lit(0)), "__place", text)
    for items in _item_blocks(benchmark, item_key, item_text, block_chars):
        block = _ranked(source, ItemBlock(items, window, shingle))
        docs = filter_rows(docs, text, _clean(docs.sparkSession.sparkContext.broadcast(block)))
    return docs


def _clean(block):
    def make():
        matcher = Matcher(block.value)
        return lambda texts: [not matcher(t)[1] for t in texts]

    return make


def passage_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The per-document digest of ``find_passages``."""
    found = find_passages(docs, benchmark, **options)
    # spans is flat (start, end, start, end, ...): ends minus starts.
    n_hit = F.expr("aggregate(transform(spans, (x, i) -> IF(i % 2 = 1, x, -x)), 0L, (a, x) -> a + x)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
