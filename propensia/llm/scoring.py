"""Language-model scoring with a hierarchical Pitman-Yor model.

A word's restaurant is that of its context, the word before it (the end of a text before its first word). All
contexts share the root, the root rests on a uniform distribution over the vocabulary and one unknown word. Each
table of a restaurant is one customer of its parent. Seats are sampled by Gibbs: the tables of a dish in a restaurant
are taken out of it and out of the root, and its customers sit down anew by the Chinese-restaurant process, given what
the others make the root predict, sweep after sweep. A dish with one customer has one table and needs no draw.
Predictions are averaged over the seatings kept; the score of a text is their log10 probability, and
perplexity follows from it.

Everything about one context (its dishes, counts and tables) lies in one shard by the context's hash. A context that
would fill half a shard is dealt over all shards by the dish; its totals, one pair of numbers each, are added up
between rounds. What the root holds of a word lies in a bucket by the word's hash: between rounds the shards
send it the tables of their dishes, it seats them as its customers and sends back what the dishes need. So the
number of contexts grows with the corpus and nothing of that size is broadcast.

Scoring sends every occurrence of a word to its context's shard, packed, but those of the pairs seen most often (COMMON of
them), which are scored where they are read. A word that never followed any context of the shard is settled where the
root holds it.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensia.llm.common import CACHE_WORDS, bounded_batches, chunks, is_held_out, lower_ascii, mix, rows_by_key, space_words
from propensia.session import discard, materialise

CONTEXTS = 1 << 20
START = CONTEXTS - 1
"""Contexts of a shard that does not say how many it numbers, and the last of them."""

DISCOUNT = (0.8, 0.7, 0.6)
STRENGTH = (1.0, 1.0, 1.0)
"""Discount and strength by level: 0 the context restaurants, 2 the root (1 has no restaurant: a word's root is its context's parent)."""

ROUNDS, KEPT, SWEEPS = 3, 2, 2
"""Rounds (totals and the root are exchanged between them), how many of the last ones are averaged, sweeps in a round."""

SHARD_CHARS = 10_000_000
COUNT_TOKENS, POST_TOKENS, OPEN_TOKENS = 600_000, 300_000, 100_000
"""Sizes of what a task holds: text behind a shard, tokens before a flush, occurrences left to the root before a flush."""
COMMON = 500_000
"""The pairs seen most often, at most so many: scored where they are read, from a table that every task has."""
SAMPLE_CHARS, CODED = 32_000_000, 65_535
"""Text in which frequent words are counted, and how many of them travel as two bytes instead of a hash.

They decide how words are written and where contexts lie, never what is counted.
"""
END = b" "
"""The end of a text; no word can be a space."""


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(context + mix(word))


class Frequent:
    """Words that travel as two bytes, and contexts dealt over all shards; CODED stands for any other word."""

    def __init__(self, counted: list[tuple[int, int]], total: int, shards: int):
        order = sorted((h % (1 << 64), n) for h, n in counted)
        self.words = np.array([h for h, _ in order], np.uint64)
        self.hot = np.array([h for h, n in order if 2 * n * shards >= total], np.uint64)
        self.shards = shards

    def codes(self) -> dict[int, int]:
        return {h: i for i, h in enumerate(self.words.tolist())}

    def shard_of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        dealt, hot = context.copy(), np.isin(context, self.hot)
        dealt[hot] = pair_hash(context[hot], word[hot])
        return (dealt % np.uint64(self.shards)).astype(np.int64)

    def pack(self, words: np.ndarray) -> bytes:
        at, found = _find(self.words, words, np.ones(len(words), bool))
        return _pack(np.where(found, at, CODED), words)

    def unpack(self, packed: bytes, n: int) -> np.ndarray:
        code = np.frombuffer(packed, np.uint16, n)
        out = np.empty(n, np.uint64)
        rare = code == CODED
        out[rare] = np.frombuffer(packed, np.uint64, offset=2 * n) if rare.any() else 0
        out[~rare] = self.words[code[~rare]]
        return out


def _pack(code: np.ndarray, h: np.ndarray) -> bytes:
    return code.astype(np.uint16).tobytes() + h[code == CODED].tobytes()


class Vocabulary:
    """Numbers of the words of a task, with the hash and the code of each."""

    def __init__(self, codes: dict[int, int]):
        self.codes = codes
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.hash, self.code = array("Q"), array("H")
        self.end = self.add(END)

    def add(self, word: bytes) -> int:
        i = self.ids[word] = len(self.hash)
        h = xxhash.xxh3_64_intdigest(word)
        self.hash.append(h)
        self.code.append(self.codes.get(h, CODED))
        return i

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word numbers, numbers of the words before them, tokens of each text); every text ends with END."""
        words: list[bytes] = []
        lengths = []
        for text in texts:
            own = space_words(lower_ascii(text))
            words += own
            words.append(END)
            lengths.append(len(own) + 1)
        get, add = self.ids.get, self.add
        ids = np.fromiter((i if (i := get(w)) is not None else add(w) for w in words), np.int64, len(words))
        before = np.empty(len(ids), np.int64)
        before[:1], before[1:] = self.end, ids[:-1]
        return ids, before, np.array(lengths)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.hash, np.uint64), np.array(self.code, np.uint16)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """First places of runs of equal values of sorted keys."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _sizes(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(first, n))


def _rows(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _each(batches):
    """Rows one by one, so that only one row's values are copied at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _bytes(x: np.ndarray) -> bytes:
    """Whole numbers below 2^32, most of them small: how many, one byte each, four more for those beyond 254."""
    x = x.astype(np.uint32)
    return np.uint32(len(x)).tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].tobytes()


def _ints(packed: bytes | None) -> np.ndarray:
    if packed is None:
        return np.empty(0, np.int64)
    n = int(np.frombuffer(packed, np.uint32, 1)[0])
    out = np.frombuffer(packed, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(packed, np.uint32, offset=4 + n)
    return out


def _number_bytes(x: np.ndarray) -> bytes:
    """Numbers of words or contexts: two bytes each, and what is above them."""
    return x.astype(np.uint16).tobytes() + _bytes(x >> 16)


def _numbers(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, np.uint16, n) + (_ints(packed[2 * n :]) << 16)


def _dealt(df: DataFrame, n: int, key: str, *order: str) -> DataFrame:
    return df.repartition(n, key).sortWithinPartitions(key, *order)


# ---------------------------------------------------------------- counting


def _word_counts(batches):
    held: Counter[bytes] = Counter()
    for _, texts in chunks(batches):
        for text in texts:
            held.update(space_words(lower_ascii(text)))
        held[END] += len(texts)
        if len(held) > CACHE_WORDS:
            yield _rows("word bigint, n bigint", [(_signed(w), n) for w, n in held.items()])
            held.clear()
    yield _rows("word bigint, n bigint", [(_signed(w), n) for w, n in held.items()])


def _signed(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >= 1 << 63 else h


_COUNT_DDL = "shard int, contexts binary, sizes binary, words binary, counts binary"


def _by_shard(vocabulary: Vocabulary, frequent: Frequent, before: np.ndarray, ids: np.ndarray):
    """(order by shard, context and word; cuts between shards; places where contexts begin; hashes; codes)."""
    h, code = vocabulary.arrays()
    shard = frequent.shard_of(h[before], h[ids])
    n = len(h)
    order = np.argsort((shard * n + before) * n + ids)
    shard, before = shard[order], before[order]
    cut = np.append(_runs(shard), len(shard)).tolist()
    return order, [(int(shard[a]), a, b, a + _runs(before[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)], h, code


def _count(frequent):
    def flush(own, vocabulary, held):
        n = len(vocabulary.ids)
        key, count = np.unique(np.concatenate([b * n + i for i, b in held]), return_counts=True)
        before, ids = key // n, key % n
        order, parts, h, code = _by_shard(vocabulary, own, before, ids)
        before, ids, count = before[order], ids[order], count[order]
        rows = []
        for shard, a, b, first in parts:
            c, w = before[first], ids[a:b]
            rows.append((shard, _pack(code[c], h[c]), _bytes(_sizes(first, b)), _pack(code[w], h[w]), _bytes(count[a:b])))
        return _rows(_COUNT_DDL, rows)

    def run(batches):
        own = frequent.value
        vocabulary, held, n = Vocabulary(own.codes()), [], 0
        for _, texts in chunks(batches):
            ids, before, _ = vocabulary.tokens(texts)
            held.append((ids, before))
            n += len(ids)
            if n > COUNT_TOKENS:
                yield flush(own, vocabulary, held)
                held, n = [], 0
                if len(vocabulary.ids) > CACHE_WORDS:
                    vocabulary.clear()
        if n:
            yield flush(own, vocabulary, held)

    return run


_PAIR_DDL = "shard int, words binary, n_words int, contexts binary, sizes binary, owners binary, counts binary, n_tokens bigint"


def _gather(frequent):
    """Counts of a shard from all tasks, added up: one row of its words, contexts and the dishes of each context."""
    def run(batches):
        own = frequent.value
        for (shard,), rows in rows_by_key(batches):
            context, word, count = [], [], []
            for c, s, w, n in rows:
                sizes, n = _ints(s), _ints(n)
                context.append(np.repeat(own.unpack(c, len(sizes)), sizes))
                word.append(own.unpack(w, len(n)))
                count.append(n)
            del rows
            words, owner = np.unique(np.concatenate(word), return_inverse=True)
            contexts, at = np.unique(np.concatenate(context), return_inverse=True)
            key, count = at * len(words) + owner, np.concatenate(count)
            del word, context, at, owner
            order = np.argsort(key)
            key, count = key[order], count[order]
            first = _runs(key)
            key, count = key[first], np.add.reduceat(count, first)
            at = key // len(words)
            yield _rows(_PAIR_DDL, [(shard, own.pack(words), len(words), contexts.tobytes(), _bytes(_sizes(_runs(at), len(at))), _number_bytes(key % len(words)), _bytes(count), int(count.sum()))])

    return run


class Shard:
    """Counts of words (numbers in ``words``) in contexts (numbers below ``contexts``)."""

    def __init__(self, words: np.ndarray, owner: np.ndarray, context: np.ndarray, count: np.ndarray, contexts: int = CONTEXTS):
        self.words, self.owner, self.context, self.count, self.contexts = words, owner, context, count, contexts

    @classmethod
    def of(cls, row: dict, words: np.ndarray) -> Shard:
        sizes, counts = _ints(row["sizes"]), _ints(row["counts"])
        return cls(words, _numbers(row["owners"], len(counts)), np.repeat(np.arange(len(sizes)), sizes), counts, len(sizes))


def _pairs(row: dict, frequent: Frequent) -> Shard:
    return Shard.of(row, frequent.unpack(row["words"], row["n_words"]))


# ---------------------------------------------------------------- restaurants


class Totals(NamedTuple):
    """Customers and tables of the contexts, of every word in the root, and of the root."""

    customers: np.ndarray
    tables: np.ndarray
    root_customers: np.ndarray
    root_tables: np.ndarray
    all_customers: float
    all_tables: float

    def plus(self, other: Totals) -> Totals:
        return Totals(*(a + b for a, b in zip(self, other, strict=True)))

    def minus(self, other: Totals) -> Totals:
        return Totals(*(a - b for a, b in zip(self, other, strict=True)))

    def root(self, base: float) -> np.ndarray:
        """Prediction of every word by the root."""
        return _predict(self.root_customers, self.root_tables, self.all_customers, self.all_tables, 2, base)


class Seating:
    """Tables of a shard's dishes in the context restaurants, and those of its words in the root."""

    def __init__(self, shard: Shard, tables: np.ndarray, root_tables: np.ndarray):
        self.shard, self.tables, self.root_tables = shard, tables, root_tables

    @classmethod
    def first(cls, shard: Shard) -> Seating:
        return cls(shard, np.ones(len(shard.count), np.int64), np.ones(len(shard.words), np.int64))

    def root_customers(self) -> np.ndarray:
        return np.bincount(self.shard.owner, weights=self.tables, minlength=len(self.shard.words)).astype(np.int64)

    def totals(self) -> Totals:
        s = self.shard
        return Totals(np.bincount(s.context, weights=s.count, minlength=s.contexts), np.bincount(s.context, weights=self.tables, minlength=s.contexts),
                      self.root_customers(), self.root_tables, float(self.tables.sum()), float(self.root_tables.sum()))

    def sweep(self, totals: Totals, base: float, rng: np.random.Generator) -> None:
        """Draw all table numbers anew, contexts first; ``totals`` counts this shard's seats as they are."""
        self.seat(totals, base, rng)
        self.root_tables = _seat_root(self.root_customers(), self.root_tables, totals.all_tables, base, rng)

    def seat(self, totals: Totals, base: float, rng: np.random.Generator) -> None:
        """Draw the tables in the contexts anew, each given what the others make the root predict.

        A dish's tables in a restaurant first leave the restaurant and, as customers, the root.
        """
        s, o = self.shard, self.shard.owner
        customers, tables = totals.root_customers[o].astype(np.int64), totals.root_tables[o].astype(np.int64)
        closed = _leave(customers, tables, self.tables, rng)
        parent = _predict(customers - self.tables, tables - closed, totals.all_customers - self.tables, totals.all_tables - closed, 2, base)
        self.tables = _seat(s.count, 0, totals.tables[s.context] - self.tables, parent, rng)

    def predict(self, totals: Totals, base: float, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Probability of words (numbers in the shard, -1 for a word never seen) in contexts."""
        s = self.shard
        known = word >= 0
        w = np.where(known, word, 0)
        root = totals.root(base)
        p = np.where(known, root[w] if len(root) else 0.0, _predict(0, 0, totals.all_customers, totals.all_tables, 2, base))
        key = s.context * (len(s.words) + 1) + s.owner
        order = np.argsort(key)
        at, found = _find(key[order], context * (len(s.words) + 1) + w, known)
        return _predict(_pick(s.count[order], at, found), _pick(self.tables[order], at, found), totals.customers[context], totals.tables[context], 0, p)


def _seat_root(customers: np.ndarray, tables: np.ndarray, all_tables: float, base: float, rng: np.random.Generator) -> np.ndarray:
    return _seat(customers, 2, all_tables - tables, np.full(len(customers), base), rng)


def _find(keys: np.ndarray, wanted: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, among & (keys[at] == wanted)


def _pick(values: np.ndarray, at: np.ndarray, found: np.ndarray) -> np.ndarray:
    return np.where(found, values[at], 0) if len(values) else np.zeros(len(at))


def _predict(customers, tables, all_customers, all_tables, level: int, parent):
    d, strength = DISCOUNT[level], STRENGTH[level]
    return (customers - d * tables + (strength + d * all_tables) * parent) / (strength + all_customers)


def _leave(customers: np.ndarray, tables: np.ndarray, leaving: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How many of a dish's tables close when some of its customers leave, any of them being as likely as any other.

    One customer of each table opened it; the tables of those who leave close, but a dish that keeps customers keeps
    a table, and never more tables than customers.
    """
    left = customers - leaving
    closed = np.where(left > 0, 0, tables)
    drawn = np.flatnonzero((left > 0) & (tables > 1) & (leaving > 0))
    if len(drawn):
        t = tables[drawn]
        gone = rng.hypergeometric(t, customers[drawn] - t, leaving[drawn])
        closed[drawn] = t - np.clip(t - gone, 1, left[drawn])
    return closed


ONE_BY_ONE, GROWTH = 32, 8
"""Customers of a dish that are seated one by one; later ones in blocks of an eighth of those seated."""


def _seat(customers: np.ndarray, level: int, others: np.ndarray, parent: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish when its customers sit down one after the other beside ``others`` tables of other dishes.

    A block's chance of a new table is its mean over the places of the block (the sum of a / (x + j) as a
    logarithm), with the tables that the block is expected to have opened by its middle.
    """
    d, strength = DISCOUNT[level], STRENGTH[level]
    others = np.broadcast_to(others, customers.shape)
    tables = np.minimum(customers, 1).astype(np.int64)
    i, step = 1, 1
    active = np.flatnonzero(customers > i)
    while len(active):
        t, p = tables[active], parent[active]
        new = (strength + d * (others[active] + t)) * p
        chance = new / (i - d * t + new)
        if step == 1:
            tables[active] += rng.random(len(active)) < chance
        else:
            size = np.minimum(step, customers[active] - i)
            middle = t + chance * size / 2
            new = (strength + d * (others[active] + middle)) * p
            x = i - d * middle + new
            chance = new / size * np.log((x + size - 0.5) / (x - 0.5))
            tables[active] += rng.binomial(size, np.clip(chance, 0, 1))
        i += step
        if i >= ONE_BY_ONE:
            step = max(1, i // GROWTH)
        active = active[customers[active] > i]
    return tables


# ---------------------------------------------------------------- words in the root


_WORD_DDL = ("bucket int, kind int, shard int, words binary, counts binary, fixed binary, customers binary, tables binary, "
             "customers_before binary, tables_before binary, n_types bigint, n_customers bigint, n_tables bigint")
"""Kind 0: what the root holds of a bucket's words; 1: tables of a shard's dishes; 2: all words of a shard; 3 and 4: answers to these."""


def _word_row(bucket: int, kind: int, shard: int | None = None, words: np.ndarray | None = None, *values: np.ndarray | None, sums: tuple[int | None, ...] = (None, None, None)) -> tuple:
    packed = [None if v is None else _bytes(v) for v in values]
    return (bucket, kind, shard, None if words is None else words.tobytes(), *packed, *[None] * (6 - len(packed)), *sums)


def _buckets(words: np.ndarray, buckets: int):
    """(bucket, places of its words), words in their order."""
    bucket = (words % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = [*_runs(bucket[order]).tolist(), len(order)]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _first_words(frequent, buckets: int):
    """Occurrences of a shard's words, and tables of dishes with one customer, for the buckets of the words."""
    def run(batches):
        for row in _each(batches):
            s = _pairs(row, frequent.value)
            n = np.bincount(s.owner, weights=s.count, minlength=len(s.words))
            fixed = np.bincount(s.owner[s.count == 1], minlength=len(s.words))
            yield _rows(_WORD_DDL, [_word_row(b, 1, row["shard"], s.words[at], n[at], fixed[at]) for b, at in _buckets(s.words, buckets)])

    return run


def _add_words(batches):
    for (bucket,), rows in rows_by_key(batches):
        words, at = np.unique(np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows]), return_inverse=True)
        n, fixed = (np.bincount(at, weights=np.concatenate([_ints(r[i]) for r in rows])).astype(np.int64) for i in (3, 4))
        yield _rows(_WORD_DDL, [_word_row(bucket, 0, None, words, n, fixed, fixed, np.ones(len(words)), sums=(len(words), int(fixed.sum()), len(words)))])


def _ask(buckets: int):
    """Tables of a shard's dishes, for the buckets of the words."""
    def run(batches):
        for row in _each(batches):
            words, seats = np.frombuffer(row["words"], np.uint64), _ints(row["tables"])
            tables = np.bincount(_numbers(row["owners"], len(seats)), weights=seats, minlength=len(words))
            yield _rows(_WORD_DDL, [_word_row(b, 1, row["shard"], words[at], None, None, None, tables[at]) for b, at in _buckets(words, buckets)])

    return run


def _ask_all(frequent, buckets: int):
    """All words of a shard, for their buckets."""
    def run(batches):
        for row in _each(batches):
            words = frequent.value.unpack(row["words"], row["n_words"])
            yield _rows(_WORD_DDL, [_word_row(b, 2, row["shard"], words[at]) for b, at in _buckets(words, buckets)])

    return run


def _seat_words(number: int, base: float, all_tables: int):
    """Seat the tables of all dishes as customers of the root, and answer the shards that asked (rows sorted by bucket and kind)."""
    def run(batches):
        for (bucket,), rows in rows_by_key(batches):
            words = np.frombuffer(rows[0][2], np.uint64)
            counts, fixed, customers_before, tables_before = (_ints(rows[0][i]) for i in (3, 4, 5, 6))
            asked = [(kind, shard, np.searchsorted(words, np.frombuffer(w, np.uint64)), t) for kind, shard, w, _, _, _, t, *_ in rows[1:]]
            del rows
            customers = fixed.copy()
            for kind, _, at, t in asked:
                if kind == 1:
                    customers[at] += _ints(t)
            tables, total = np.minimum(tables_before, customers), float(all_tables)
            total += (tables - tables_before).sum()
            rng = np.random.default_rng([bucket, number, 1])
            for _ in range(SWEEPS):
                drawn = _seat_root(customers, tables, total, base, rng)
                total += (drawn - tables).sum()
                tables = drawn
            yield _rows(_WORD_DDL, [_word_row(bucket, 0, None, words, counts, fixed, customers, tables, customers_before, tables_before,
                                              sums=(len(words), int(customers.sum()), int(tables.sum())))])
            for kind, shard, at, _ in asked:
                yield _rows(_WORD_DDL, [_word_row(bucket, kind + 2, shard, None, counts[at], None, customers[at], tables[at], customers_before[at], tables_before[at])])

    return run


# ---------------------------------------------------------------- rounds

_SEAT_DDL = ("shard int, words binary, contexts binary, sizes binary, owners binary, counts binary, of_context binary, fixed binary, tables binary, tables_before binary, "
             "hot_fixed array<bigint>, hot array<bigint>")
"""Dishes with several customers; all customers of their contexts and the ``fixed`` tables of other dishes; customers and tables of the shard's part of hot contexts."""


def _seated(row: dict) -> Shard:
    return Shard.of(row, np.frombuffer(row["words"], np.uint64))


def _hot(own: Frequent, contexts: np.ndarray, values: list[np.ndarray]) -> list[int]:
    """Values of contexts at the places of the hot contexts, one list after the other."""
    at, found = _find(contexts, own.hot, np.ones(len(own.hot), bool))
    return [int(x) for v in values for x in _pick(v, at, found)]


def _first_seats(frequent):
    def run(batches):
        for row in _each(batches):
            s, contexts = _pairs(row, frequent.value), np.frombuffer(row["contexts"], np.uint64)
            several = s.count > 1
            fixed = np.bincount(s.context[~several], minlength=len(contexts))
            customers = np.bincount(s.context, weights=s.count, minlength=len(contexts))
            hot_fixed = _hot(frequent.value, contexts, [customers, fixed])
            hot = _hot(frequent.value, contexts, [customers, np.bincount(s.context, minlength=len(contexts))])
            words, owner = np.unique(s.owner[several], return_inverse=True)
            used, at = np.unique(s.context[several], return_inverse=True)
            ones = np.ones(len(owner))
            yield _rows(_SEAT_DDL, [(row["shard"], s.words[words].tobytes(), contexts[used].tobytes(), _bytes(np.bincount(at, minlength=len(used))), _number_bytes(owner), _bytes(s.count[several]),
                                     _bytes(customers[used]), _bytes(fixed[used]), _bytes(ones), None, hot_fixed, hot)])

    return run


_ANSWER_NAMES = ["counts", "customers", "tables", "customers_before", "tables_before"]


def _place(words: np.ndarray, buckets: int, answers: list[dict], names: list[str]) -> list[np.ndarray]:
    """Values of the words from the answers of all buckets."""
    out = [np.zeros(len(words), np.int64) for _ in names]
    bucket = (words % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    begin = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for a in answers:
        at = order[begin[a["bucket"]] : begin[a["bucket"] + 1]]
        for o, name in zip(out, names, strict=True):
            o[at] = _ints(a[name])
    return out


def _round(frequent, buckets: int, number: int, base: float, hot: list[int], all_customers: int, all_tables: int):
    """Sweeps over a shard's dishes; rows sorted by shard and kind, its seats first, then what the root holds of its words."""
    def seat(own, row, answers):
        s = _seated(row)
        customers, root_tables = _place(s.words, buckets, answers, ["customers", "tables"])
        seating = Seating(s, _ints(row["tables"]), root_tables)
        mine = seating.totals()
        outside = _ints(row["fixed"]).astype(np.float64)
        contexts, n = np.frombuffer(row["contexts"], np.uint64), len(own.hot)
        at, found = _find(contexts, own.hot, np.ones(n, bool))
        outside[at[found]] += (np.array(hot[n:]) - np.array(row["hot"][n:]))[found]
        elsewhere = Totals(np.zeros(s.contexts), mine.tables + outside, customers, root_tables, float(all_customers), float(all_tables)).minus(mine)
        rng = np.random.default_rng([row["shard"], number])
        for _ in range(SWEEPS):
            now = elsewhere.plus(seating.totals())
            seating.seat(now._replace(root_tables=np.minimum(now.root_tables, now.root_customers)), base, rng)
        of_hot = [a + b for a, b in zip(row["hot_fixed"], [0] * n + _hot(own, contexts, [seating.totals().tables]), strict=True)]
        return (*(row[k] for k in ("shard", "words", "contexts", "sizes", "owners", "counts", "of_context", "fixed")), _bytes(seating.tables), row["tables"], row["hot_fixed"], of_hot)

    def run(batches):
        for row, answers in _answered(batches):
            yield _rows(_SEAT_DDL, [seat(frequent.value, row, answers)])

    return run


def _answered(batches):
    """A shard's seats with the answers that follow them."""
    held, answers = None, []
    for row in _each(batches):
        if row["kind"] == 0:
            if held:
                yield held, answers
            held, answers = row, []
        else:
            answers.append(row)
    if held:
        yield held, answers


class Model:
    """What scoring needs everywhere: totals of the root and of hot contexts in the seatings kept, the number of tokens."""

    def __init__(self, frequent: Frequent, n_tokens: int, n_types: int, root: list[tuple[int, int]], hot: list[list[int]]):
        self.frequent, self.n_tokens, self.n_types, self.root = frequent, n_tokens, n_types, root
        self.base = 1.0 / (n_types + 1)
        n = len(frequent.hot)
        self.hot_customers = np.array(hot[0][:n], np.float64)
        self.hot_tables = [np.array(h[n:], np.float64) for h in hot]
        self.hot_empty = np.stack([self.empty(self.hot_customers, t) for t in self.hot_tables], 1)
        self.unknown = np.array([_predict(0, 0, c, t, 2, self.base) for c, t in root])
        self.common, self.common_base, self.common_log = np.empty(0, np.uint64), np.empty(0), np.empty(0)

    @staticmethod
    def empty(customers, tables):
        """Share of its parent's prediction that a context gives to a word never seen in it."""
        return _predict(0, 0, customers, tables, 0, 1.0)

    def words(self, customers: list[np.ndarray], tables: list[np.ndarray]) -> np.ndarray:
        """Predictions by the root, one column for each seating."""
        return np.stack([_predict(c, t, *total, 2, self.base) for c, t, total in zip(customers, tables, self.root, strict=True)], 1)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.n_tokens + self.n_types + 1))


def _common(model, buckets: int, least: int):
    """Predictions of the dishes with at least so many customers; rows as for ``_round``."""
    ddl = "pairs binary, counts binary, log binary"

    def run(batches):
        own = model.value
        k = len(own.root)
        for row, answers in _answered(batches):
            s, contexts, hot = _seated(row), np.frombuffer(row["contexts"], np.uint64), own.frequent.hot
            counts, *root = _place(s.words, buckets, answers, _ANSWER_NAMES[: 1 + 2 * k])
            root = own.words(root[::2], root[1::2])
            at, found = _find(contexts, hot, np.ones(len(hot), bool))
            customers = _ints(row["of_context"]).astype(np.float64)
            customers[at[found]] = own.hot_customers[found]
            often = np.flatnonzero(s.count >= least)
            o, c, p = s.owner[often], s.context[often], np.zeros(len(often))
            for i, name in enumerate(["tables", "tables_before"][:k]):
                tables = _ints(row[name])
                of_context = _ints(row["fixed"]) + np.bincount(s.context, weights=tables, minlength=s.contexts)
                of_context[at[found]] = own.hot_tables[i][found]
                p += _predict(s.count[often], tables[often], customers[c], of_context[c], 0, root[o, i])
            yield _rows(ddl, [(pair_hash(contexts[c], s.words[o]).tobytes(), _bytes(counts[o]), np.log10(p / k).tobytes())])

    return run


def _count_sizes(batches):
    for row in _each(batches):
        n, dishes = np.unique(_ints(row["counts"]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(dishes)], ["n", "dishes"])


class Learned(NamedTuple):
    """Counts of all pairs by shard, seats of those seen several times, the root's words by bucket and its answers to the shards."""

    pairs: DataFrame
    seats: DataFrame
    words: DataFrame
    answers: DataFrame
    model: Model


# ---------------------------------------------------------------- scoring

_POST_DDL = "shard int, kind int, chunk bigint, docs binary, contexts binary, sizes binary, words binary, places binary, sums binary"
_PART_DDL = "kind int, chunk bigint, bucket int, docs binary, words binary, places binary, sums binary"
"""Kind 3: the documents of a chunk; 4: occurrences, or sums of them; 5: occurrences left to the root; 6: these settled. Buckets are those of words or of chunks."""


def _post(model):
    """Common pairs scored here with the documents of each chunk, occurrences of all others packed for the shards of their contexts."""
    def run(batches):
        own = model.value
        vocabulary = Vocabulary(own.frequent.codes())
        held: list[tuple] = []
        n = 0
        for batch in batches:
            doc_ids, at = batch.column(2).to_pylist(), 0
            for uids, texts in chunks([batch]):
                held.append((uids, doc_ids[at : at + len(uids)], *vocabulary.tokens(texts)))
                at += len(uids)
                n += len(held[-1][2])
                if n > POST_TOKENS:
                    yield _posted(own, vocabulary, held)
                    held, n = [], 0
                    if len(vocabulary.ids) > CACHE_WORDS:
                        vocabulary.clear()
        if held:
            yield _posted(own, vocabulary, held)

    return run


def _posted(model: Model, vocabulary: Vocabulary, held: list[tuple]) -> pa.RecordBatch:
    docs = np.array([(-1 if d is None else d, d is None) for _, ids, *_ in held for d in ids], np.int64)
    ids, before, lengths = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
    chunk = int(held[0][0][0])
    place = np.repeat(np.arange(len(docs)), lengths).astype(np.uint16 if len(docs) <= 65_536 else np.uint32)
    h, _ = vocabulary.arrays()
    at, common = _find(model.common, pair_hash(h[before], h[ids]), np.ones(len(ids), bool))
    at, own, rest = at[common], place[common], ~common
    sums = np.stack([np.bincount(own, weights=x, minlength=len(docs)) for x in (model.common_base[at], model.common_log[at])])
    rows = [(chunk % model.frequent.shards, 3, chunk, docs.tobytes(), None, None, None, lengths.astype(np.int64).tobytes(), sums.tobytes())]
    before, ids, place = before[rest], ids[rest], place[rest]
    order, parts, h, code = _by_shard(vocabulary, model.frequent, before, ids)
    before, ids, place = before[order], ids[order], place[order]
    for shard, a, b, first in parts:
        c, w = before[first], ids[a:b]
        rows.append((shard, 4, chunk, None, _pack(code[c], h[c]), _bytes(_sizes(first, b)), _pack(code[w], h[w]), place[a:b].tobytes(), None))
    return _rows(_POST_DDL, rows)


def _places(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, np.uint16 if len(packed) == 2 * n else np.uint32)


class Scorer:
    """Predictions of a shard's dishes, made ready for lookups."""

    def __init__(self, model: Model, buckets: int):
        self.model, self.buckets = model, buckets
        self.begin(None)

    def begin(self, pairs: dict | None) -> None:
        self.pairs, self.seats, self.answers, self.made = pairs, None, [], False

    def ready(self) -> None:
        if self.made:
            return
        self.made = True
        m = self.model
        k = len(m.root)
        if self.pairs is None:
            self.words = self.contexts = np.empty(0, np.uint64)
            self.counts, self.key, self.log = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            self.root, self.empty = np.empty((0, k)), np.empty((0, k))
        else:
            s = _pairs(self.pairs, m.frequent)
            self.words, self.contexts = s.words, np.frombuffer(self.pairs["contexts"], np.uint64)
            self.counts, *root = _place(s.words, self.buckets, self.answers, _ANSWER_NAMES[: 1 + 2 * k])
            self.root = m.words(root[::2], root[1::2])
            at, found = _find(self.contexts, m.frequent.hot, np.ones(len(m.frequent.hot), bool))
            customers = np.bincount(s.context, weights=s.count, minlength=s.contexts)
            customers[at[found]] = m.hot_customers[found]
            empty, p, several = [], 0.0, s.count > 1
            for i, name in enumerate(["tables", "tables_before"][:k]):
                tables = np.ones(len(s.count), np.int64)
                tables[several] = _ints(self.seats[name])
                of_context = np.bincount(s.context, weights=tables, minlength=s.contexts)
                of_context[at[found]] = m.hot_tables[i][found]
                p = p + _predict(s.count, tables, customers[s.context], of_context[s.context], 0, self.root[s.owner, i])
                empty.append(m.empty(customers, of_context))
            self.empty, self.log, self.key = np.stack(empty, 1), np.log10(p / k), s.context * len(s.words) + s.owner
            self.pairs = self.seats = None
            self.answers = []
        at, found = _find(self.words, m.frequent.words, np.ones(len(m.frequent.words), bool))
        self.coded = np.append(np.where(found, at, -1), -1)

    def score(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """(log10 prediction of each occurrence, number of the word or -1, which are left to the root, their hashes and shares)."""
        m, sizes = self.model, _ints(row["sizes"])
        h = m.frequent.unpack(row["contexts"], len(sizes))
        context, seen = _find(self.contexts, h, np.ones(len(h), bool))
        empty = np.ones((len(h), len(m.root)))
        at, hot = _find(m.frequent.hot, h, np.ones(len(h), bool))
        empty[hot] = m.hot_empty[at[hot]]
        empty[seen] = self.empty[context[seen]]
        n = int(sizes.sum())
        code = np.frombuffer(row["words"], np.uint16, n)
        word = self.coded[np.minimum(code, len(m.frequent.words))]
        rare = np.flatnonzero(code == CODED)
        if len(rare):
            at, found = _find(self.words, np.frombuffer(row["words"], np.uint64, offset=2 * n), np.ones(len(rare), bool))
            word[rare] = np.where(found, at, -1)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        known = word >= 0
        at, found = _find(self.key, context[owner] * len(self.words) + word, known & seen[owner])
        out = np.zeros(n)
        out[found] = self.log[at[found]]
        rest = np.flatnonzero(known & ~found)
        out[rest] = np.log10((empty[owner[rest]] * self.root[word[rest]]).mean(1))
        left = np.flatnonzero(~known)
        names = m.frequent.unpack(row["words"], n)[left] if len(left) else np.empty(0, np.uint64)
        return out, word, left, (names, empty[owner[left]])


def _sums(chunk: int, places: np.ndarray, count: np.ndarray, log: np.ndarray, model: Model) -> tuple:
    """Unigram and model scores of the documents at ``places``."""
    used, at = np.unique(places, return_inverse=True)
    sums = np.stack([np.bincount(at, weights=model.unigram(count)), np.bincount(at, weights=log)])
    return (4, chunk, chunk % model.frequent.shards, None, None, _bytes(np.diff(used, prepend=0)), sums.tobytes())


def _score(model, buckets: int):
    """Sums per document from each shard; rows sorted by shard and kind: pairs (0), seats (1), the root's answers (2), then posts."""
    def leave(held):
        chunk, place, word, empty = (np.concatenate(x) for x in zip(*held, strict=True))
        rows = [(5, None, b, chunk[at].tobytes(), word[at].tobytes(), place[at].tobytes(), empty[at].tobytes()) for b, at in _buckets(word, buckets)]
        return _rows(_PART_DDL, rows)

    def run(batches):
        own = model.value
        scorer, current, held, n = Scorer(own, buckets), None, [], 0
        for row in _each(batches):
            if row["shard"] != current:
                current = row["shard"]
                scorer.begin(None)
            if row["kind"] == 0:
                scorer.begin(row)
            elif row["kind"] == 1:
                scorer.seats = row
            elif row["kind"] == 2:
                scorer.answers.append(row)
            elif row["kind"] == 3:
                yield _rows(_PART_DDL, [(3, row["chunk"], row["shard"], row["docs"], None, row["places"], row["sums"])])
            else:
                scorer.ready()
                log, word, left, (names, empty) = scorer.score(row)
                places = _places(row["places"], len(log))
                settled = word >= 0
                if settled.any():
                    yield _rows(_PART_DDL, [_sums(row["chunk"], places[settled], scorer.counts[word[settled]], log[settled], own)])
                if len(left):
                    held.append((np.full(len(left), row["chunk"], np.int64), places[left].astype(np.uint32), names, empty))
                    n += len(left)
                if n > OPEN_TOKENS:
                    yield leave(held)
                    held, n = [], 0
        if held:
            yield leave(held)

    return run


def _settle(model, buckets: int):
    """Occurrences left to the root, settled by its words; rows sorted by bucket and kind, the words (kind 0) first."""
    def flush(own, held):
        chunk, place, count, log = (np.concatenate(x) for x in zip(*held, strict=True))
        values = np.stack([own.unigram(count), log, count == 0])
        return _rows(_PART_DDL, [(6, None, b, chunk[at].tobytes(), None, _bytes(place[at]), values[:, at].tobytes()) for b, at in _buckets(chunk.view(np.uint64), buckets)])

    def run(batches):
        own, current, held, n = model.value, None, [], 0
        k = len(own.root)
        for row in _each(batches):
            if row["bucket"] != current:
                current = row["bucket"]
                words, counts, root = np.empty(0, np.uint64), np.zeros(1, np.int64), own.unknown[None]
            if row["kind"] == 0:
                words = np.frombuffer(row["words"], np.uint64)
                values = [_ints(row[x]) for x in _ANSWER_NAMES[1 : 1 + 2 * k]]
                counts, root = np.append(_ints(row["counts"]), 0), np.concatenate([own.words(values[::2], values[1::2]), own.unknown[None]])
                continue
            wanted = np.frombuffer(row["words"], np.uint64)
            at, found = _find(words, wanted, np.ones(len(wanted), bool))
            at = np.where(found, at, len(words))
            log = np.log10((np.frombuffer(row["sums"], np.float64).reshape(-1, k) * root[at]).mean(1))
            held.append((np.frombuffer(row["docs"], np.int64), np.frombuffer(row["places"], np.uint32), counts[at], log))
            n += len(at)
            if n > OPEN_TOKENS:
                yield flush(own, held)
                held, n = [], 0
        if held:
            yield flush(own, held)

    return run


def _combine(batches):
    """One row per document of a bucket of chunks: its own row (kind 3) and the sums of all shards; rows sorted by bucket and kind."""
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    for _, rows in rows_by_key(batches):
        own = sorted((r for r in rows if r[0] == 3), key=lambda r: r[1])
        docs, lengths = np.concatenate([np.frombuffer(r[2], np.int64).reshape(-1, 2) for r in own]), [np.frombuffer(r[3], np.int64) for r in own]
        chunk, begin = np.array([r[1] for r in own], np.int64), np.cumsum([0, *(len(n) for n in lengths)])
        first, lengths = dict(zip(chunk.tolist(), begin.tolist(), strict=False)), np.concatenate(lengths)
        total = np.zeros((3, len(docs)))
        total[:2] = np.concatenate([np.frombuffer(r[4], np.float64).reshape(2, -1) for r in own], 1)
        for kind, of, chunks_of, places, sums in rows:
            if kind == 4:
                at = first[of] + np.cumsum(_ints(places))
                total[:2, at] += np.frombuffer(sums, np.float64).reshape(2, -1)
            elif kind == 6:
                at = begin[np.searchsorted(chunk, np.frombuffer(chunks_of, np.int64))] + _ints(places)
                for t, x in zip(total, np.frombuffer(sums, np.float64).reshape(3, -1), strict=True):
                    t += np.bincount(at, weights=x, minlength=len(t))
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs[:, 0], pa.int64(), mask=docs[:, 1] == 1), pa.array(lengths), pa.array(lengths - total[2].astype(np.int64)), pa.array(total[0]), pa.array(total[1])], names)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _staged(df: DataFrame, name: str) -> DataFrame:
    """``materialise``, after which the shuffle files of this one write are gone: later steps read the table."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return materialise(df, name)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def _text(name: str):
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).cast("binary").alias("t")


def _frequent(train: DataFrame, text: str, chars: int, shards: int) -> Frequent:
    # Rows by the hash of all their values, so that copies of a text are not all in or all out.
    values = [F.col(f"`{name}`") for name, kind in train.dtypes if "map<" not in kind and "variant" not in kind]
    sample = train.filter(F.xxhash64(*values) % max(1, chars // SAMPLE_CHARS) == 0).select(F.lit(0).alias("k"), _text(text))
    counted = _staged(sample.mapInArrow(_word_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "lm-frequent")
    total = counted.agg(F.sum("n")).first()[0] or 0
    top = counted.orderBy(F.desc("n"), "word").limit(CODED).collect()
    discard(counted)
    return Frequent([(w, n) for w, n in top], total, shards)


def _totals(words: DataFrame) -> tuple[int, int, int]:
    """Words, customers and tables of the root."""
    return tuple(x or 0 for x in words.filter("kind = 0").agg(F.sum("n_types"), F.sum("n_customers"), F.sum("n_tables")).first())


def _hot_totals(seats: DataFrame, hot: int) -> list[int]:
    out = [0] * (2 * hot)
    if hot:
        for at, n in seats.select(F.posexplode("hot").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
            out[at] = n
    return out


def learn(train: DataFrame, text: str = "text") -> Learned:
    """What a model of the texts given consists of."""
    spark = train.sparkSession
    bounded_batches(spark)
    source = train.select(F.lit(0).alias("k"), _text(text))
    chars = source.agg(F.sum(F.length("t"))).first()[0] or 0
    shards = max(8, math.ceil(chars / SHARD_CHARS))
    own = _frequent(train, text, chars, shards)
    frequent = spark.sparkContext.broadcast(own)
    pairs = _staged(_dealt(source.mapInArrow(_count(frequent), _COUNT_DDL), shards, "shard").mapInArrow(_gather(frequent), _PAIR_DDL), "lm-pairs")
    n_tokens = pairs.agg(F.sum("n_tokens")).first()[0] or 0
    seats = _staged(pairs.mapInArrow(_first_seats(frequent), _SEAT_DDL), "lm-seats")
    words = _staged(_dealt(pairs.mapInArrow(_first_words(frequent, shards), _WORD_DDL), shards, "bucket").mapInArrow(_add_words, _WORD_DDL), "lm-words")
    n_types, _, all_tables = _totals(words)
    base = 1.0 / (n_types + 1)
    root, hot = [], []
    for number in range(ROUNDS + 1):
        # The root seats the tables that the shards have, then a round draws them anew beside what it predicts.
        asked = seats.mapInArrow(_ask(shards), _WORD_DDL)
        if number == ROUNDS:
            asked = asked.union(pairs.select("shard", "words", "n_words").mapInArrow(_ask_all(frequent, shards), _WORD_DDL))
        seated = _dealt(words.filter("kind = 0").union(asked), shards, "bucket", "kind", "shard")
        old, words = words, _staged(seated.mapInArrow(_seat_words(number, base, all_tables), _WORD_DDL), "lm-words")
        discard(old)
        _, all_customers, all_tables = _totals(words)
        root.append((all_customers, all_tables))
        hot.append(_hot_totals(seats, len(own.hot)))
        if number < ROUNDS:
            both = _dealt(seats.withColumn("kind", F.lit(0)).unionByName(words.filter("kind = 3"), allowMissingColumns=True), shards, "shard", "kind", "bucket")
            old, seats = seats, _staged(both.mapInArrow(_round(frequent, shards, number, base, hot[-1], *root[-1]), _SEAT_DDL), "lm-seats")
            discard(old)
    model = Model(own, n_tokens, n_types, root[::-1][:KEPT], hot[::-1][:KEPT])
    sizes = seats.mapInArrow(_count_sizes, "n bigint, dishes bigint").groupBy("n").agg(F.sum("dishes").alias("dishes")).orderBy(F.desc("n")).limit(COMMON).collect()
    fits = [n for n, dishes in zip((r[0] for r in sizes), np.cumsum([r[1] for r in sizes]), strict=True) if dishes <= COMMON]
    if fits:
        both = _dealt(seats.withColumn("kind", F.lit(0)).unionByName(words.filter("kind = 3"), allowMissingColumns=True), shards, "shard", "kind", "bucket")
        rows = both.mapInArrow(_common(spark.sparkContext.broadcast(model), shards, fits[-1]), "pairs binary, counts binary, log binary").collect()  # COMMON dishes at most
        pair, counts, log = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows]), np.concatenate([_ints(r[1]) for r in rows]), np.concatenate([np.frombuffer(r[2]) for r in rows])
        order = np.argsort(pair)
        model.common, model.common_base, model.common_log = pair[order], model.unigram(counts[order]), log[order]
    return Learned(pairs, seats, words.filter("kind = 0"), words.filter("kind = 4"), model)


def score_texts(docs: DataFrame, learned: Learned, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    A null or empty text is its end alone. Repeated rows each get their row; a row without an id keeps none.
    """
    bounded_batches(docs.sparkSession)
    pairs, seats, words, answers, model = learned
    shards = model.frequent.shards
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.monotonically_increasing_id().alias("uid"), _text(text), F.col(f"`{key}`").cast("bigint").alias("doc_id"))
    both = source.mapInArrow(_post(shared), _POST_DDL)
    for kind, table in enumerate((pairs, seats.select("shard", "tables", "tables_before"), answers.select("shard", "bucket", *_ANSWER_NAMES))):
        both = both.unionByName(table.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    parts = _staged(_dealt(both, shards, "shard", "kind").mapInArrow(_score(shared, shards), _PART_DDL), "lm-parts")
    left = words.unionByName(parts.filter("kind = 5"), allowMissingColumns=True)
    settled = _dealt(left, shards, "bucket", "kind").mapInArrow(_settle(shared, shards), _PART_DDL)
    summed = parts.filter("kind < 5").union(settled).select("bucket", "kind", "chunk", "docs", "places", "sums")
    out = _dealt(summed, shards, "bucket", "kind").mapInArrow(_combine, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def perplexity(score: str = "score", n_tokens: str = "n_tokens"):
    """Perplexity per token from a log10 probability."""
    return F.pow(F.lit(10.0), -F.col(score) / F.col(n_tokens))


def score_report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", modulus: int = 7, held_out: int = 2) -> DataFrame:
    """Learn from the documents outside of the held-out part, score all of them."""
    learned = learn(docs.filter(~F.coalesce(is_held_out(key, modulus, held_out), F.lit(False))), text)
    scored = score_texts(docs, learned, key=key, text=text)
    discard(learned.pairs)
    discard(learned.seats)
    return scored.select("doc_id", F.coalesce(is_held_out("doc_id", modulus, held_out), F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
                         perplexity().alias("perplexity"))
