"""BPE encoding and decoding by a pair occurrence index.

The distinct pieces of text of a task (words as the vocabulary cuts them) lie one behind the other in one
array of symbols. An index maps every pair of neighbouring symbols that has a rank to all positions where it
occurs. Ranks are taken in ascending order from a heap of active ones: all occurrences of the pair are merged
at once, left to right, and the lists of the pairs that arise around them are extended; positions that a
merge has made stale are recognised when they are read. A pair that arises with a lower rank than the one
just done is simply the next to be taken, so the result is that of merging each piece by itself, lowest rank
first and leftmost first.

Encoded pieces are remembered by each worker process, the older half goes when they are too many; a document is then a
sequence of lookups.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensia.llm.common import chunks, doc_columns

KNOWN_PIECES, KNOWN_BYTES = 250_000, 16 << 20
"""Encoded pieces, and bytes of their ids, that a worker process keeps beside its vocabulary, whatever the number of its tasks."""

TASK_BYTES = 4 << 20
"""Text that is indexed at a time."""


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else 256 and up in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class PairIndex:
    """Merges the pieces of a batch together, rank by rank. A pair of symbols is one number, ``left << 32 | right``."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]):
        order = sorted((rank, left << 32 | right, merged) for (left, right), (rank, merged) in ranks.items())
        self.pairs = [pair for _, pair, _ in order]  # by rank, counted without gaps
        self.merged = [merged for _, _, merged in order]
        self.rank_of = {pair: k for k, pair in enumerate(self.pairs)}
        by_pair = np.array(self.pairs, np.int64)
        self._ranks = np.argsort(by_pair, kind="stable")
        self._sorted = by_pair[self._ranks]

    def _index(self, symbols: np.ndarray) -> dict[int, list[int]]:
        """Positions of every pair that has a rank, by rank."""
        if not len(self._sorted):
            return {}
        pair = symbols[:-1] << 32 | symbols[1:]
        pair[(symbols[:-1] < 0) | (symbols[1:] < 0)] = -1
        at = np.minimum(np.searchsorted(self._sorted, pair), len(self._sorted) - 1)
        places = np.flatnonzero(self._sorted[at] == pair)
        rank = self._ranks[at[places]]
        order = np.argsort(rank, kind="stable")
        places, rank = places[order], rank[order]
        cut = np.flatnonzero(np.concatenate(([len(rank) > 0], rank[1:] != rank[:-1]))) if len(rank) else np.empty(0, np.int64)
        every, ends = places.tolist(), np.append(cut[1:], len(rank)).tolist()
        return {r: every[i:j] for r, i, j in zip(rank[cut].tolist(), cut.tolist(), ends, strict=True)}

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols of pieces that lie between -1s (the first and last symbol are -1), merged; empty places are -2."""
        index = self._index(symbols)
        active = list(index)
        heapq.heapify(active)
        s = symbols.tolist()
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, pop, push, pairs, new = self.rank_of.get, heapq.heappop, heapq.heappush, self.pairs, self.merged
        while active:
            rank = pop(active)
            positions = index.pop(rank)
            left, right, merged = pairs[rank] >> 32, pairs[rank] & 0xFFFFFFFF, new[rank]
            high = merged << 32
            positions.sort()
            for i in positions:
                if s[i] != left:  # stale
                    continue
                j = after[i]
                if s[j] != right:
                    continue
                k = after[j]
                s[i], s[j] = merged, -2
                after[i] = k
                before[k] = i
                b = before[i]
                other = s[b]
                if other >= 0:
                    r = get(other << 32 | merged)
                    if r is not None:
                        if r in index:
                            index[r].append(b)
                        else:
                            index[r] = [b]
                            push(active, r)
                other = s[k]
                if other >= 0:
                    r = get(high | other)
                    if r is not None:
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            push(active, r)
        return np.array(s, np.int64)


def _unicode_space(pattern: str) -> str:
    r"""The pattern with ``\s`` as Unicode's White_Space property, which is what such files mean by it."""
    return pattern.replace(r"\s", r"\p{White_Space}")


class WordBpe:
    """A byte-pair vocabulary with word ends in the file format of the tokenizers library.

    Reads what such a file states: the normalisation (NFC, white space to one space, lower case), the pattern
    that cuts text into pieces (everything else is dropped), the byte alphabet, ranked merges, the suffix
    of a piece's last symbol and special tokens, whose strings in a text are that token.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(_unicode_space(split["pattern"]["Regex"]))
        self.steps = spec["normalizer"]["normalizers"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.alphabet = byte_alphabet()
        self.token_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        ranks = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair = (self.vocab[a], self.vocab[b])
            ranks.setdefault(pair, (rank, self.vocab[a + b]))
        self.index = PairIndex(ranks)
        self.inner, self.last = (np.array([self.vocab[c + end] for c in self.alphabet], np.int64) for end in ("", self.suffix))
        self.known: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        for step in self.steps:
            kind = step["type"]
            if kind == "NFC":
                text = text if text.isascii() else unicodedata.normalize("NFC", text)
            elif kind == "Replace":
                text = regex.sub(_unicode_space(step["pattern"]["Regex"]), step["content"], text)
            elif kind == "Lowercase":
                text = "".join(map(str.lower, text)) if "Σ" in text or "İ" in text else text.lower()
            else:
                raise ValueError(f"normaliser {kind} is not known")
        return text

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text in order; a special token's string is itself a piece."""
        if self.special_pattern is None or not any(s in text for s in self.special):
            return self.pattern.findall(self.normal(text))
        out: list[str] = []
        for part in self.special_pattern.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out.extend(self.pattern.findall(self.normal(part)))
        return out

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of the pieces, merged all together."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(sizes)
        own = self.inner[raw]
        own[ends - 1] = self.last[raw[ends - 1]]
        symbols = np.full(len(raw) + len(pieces) + 1, -1, np.int64)
        piece = np.repeat(np.arange(len(pieces)), sizes)
        symbols[np.arange(len(raw)) + piece + 1] = own
        done = self.index.merge(symbols)
        alive = np.flatnonzero(done >= 0)
        stops = (4 * np.searchsorted(alive, ends + np.arange(1, len(pieces) + 1))).tolist()  # a piece ends where its -1 stands
        packed = done[alive].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def learn(self, pieces: set[str], known: dict[str, bytes]) -> None:
        """Encode the pieces not yet known, all together; the older half goes where ``known`` has grown too large."""
        if len(known) > KNOWN_PIECES or sum(map(len, islice(known.values(), 0, None, 64))) > KNOWN_BYTES // 64:
            for piece in list(islice(known, len(known) // 2 + 1)):
                del known[piece]
        fresh = [p for p in pieces if p not in known]
        for p in fresh:
            if p in self.special:
                known[p] = self.special[p].to_bytes(4, "little")
        fresh = [p for p in fresh if p not in self.special]
        if fresh:
            known.update(zip(fresh, self._merge([p.encode() for p in fresh]), strict=True))

    def encode(self, texts: list[str], known: dict[str, bytes] | None = None) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; ``known`` remembers pieces between calls."""
        known = self.known if known is None else known
        cut = [self.pieces(t) for t in texts]
        self.learn(set().union(*cut), known)
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def decode(self, packed: bytes) -> str:
        """Tokens of the ids joined by single spaces, as a vocabulary without a decoder is read back."""
        ids = memoryview(packed).cast("I")
        return " ".join([self.token_of[i] for i in ids])


@cache
def tokenizer(path: str) -> WordBpe:
    """One vocabulary per worker process, whatever the number of its tasks."""
    return WordBpe(path)


def _encode(path: str):
    def run(batches):
        bpe = tokenizer(path)
        for keys, texts in chunks(batches, TASK_BYTES):
            packed = bpe.encode([t.decode() for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(packed, pa.binary())], ["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches):
        bpe = tokenizer(path)
        for keys, packed in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([bpe.decode(p) for p in packed], pa.string())], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): ids packed as little-endian unsigned 32-bit integers; a null text is an empty one."""
    source = doc_columns(docs, key, text)
    return source.mapInArrow(_encode(path), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) from packed ids."""
    source = encoded.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{ids}`"), F.lit(b"")).alias("ids"))
    return source.mapInArrow(_decode(path), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")


def _digest(path: str, with_ids: bool):
    def run(batches):
        bpe = tokenizer(path)
        for keys, texts in chunks(batches, TASK_BYTES):
            packed = bpe.encode([t.decode() for t in texts])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                 pa.array([hashlib.sha256(bpe.decode(p).encode()).hexdigest() for p in packed], pa.string()), *([pa.array(packed, pa.binary())] if with_ids else [])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    return run


def round_trip_report(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document row: doc_id, n_tokens, digest of the ids, digest of the text decoded from them, ids if wanted.

    A null or empty text has no tokens and decodes to an empty text; repeated rows each get their row.
    """
    source = doc_columns(docs, key, text)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_digest(path, with_ids), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
