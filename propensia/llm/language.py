"""Language identification as inference of a mixture of languages.

Every language is a distribution over hashed byte trigrams of lower-cased letters, learned by counting. A
document is explained as a mixture: expectation-maximisation finds the proportions of the languages that
make its trigrams most likely. The set of languages is selected by penalised likelihood: a further language
must raise the log likelihood by more than the cost of its parameter. The prediction is the language with the
largest proportion.

The likelihood is concave in the proportions, so a document whose best single language cannot be improved by a
small share of any other one is settled without iterating.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensia.llm.common import bounded_batches, chunks, doc_columns, is_held_out

BUCKETS = 1 << 15
"""Hashed trigrams a language's distribution has; the model is languages times this."""

SMOOTHING = 0.5
PENALTY = 3.0
"""Cost of a further language: this times half the logarithm of the number of trigrams. Above 1 because
overlapping trigrams are not independent."""

STEPS = 25

UNKNOWN = "und"

_LETTERS = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


def has_letter(text: bytes) -> bool:
    solid = text.translate(_LETTERS).split()
    if not solid:
        return False
    return any(w[0] < 128 or not w.isascii() and any(c.isalpha() for c in w.decode(errors="ignore")) for w in solid)


def trigrams(text: bytes) -> np.ndarray:
    """Bucket of every byte trigram of the lower-cased letters, runs of anything else being one space."""
    solid = text.decode().lower().encode().translate(_LETTERS).split()
    b = np.frombuffer(b" " + b" ".join(solid) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        code = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(17)).astype(np.int64)


class LanguageModel:
    """Names and the trigram distribution of each."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        smoothed = counts + SMOOTHING
        self.log = np.log(smoothed / smoothed.sum(1, keepdims=True)).T.astype(np.float32).copy()  # [bucket, language]

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, list[tuple[str, float]]]]:
        """(language, its proportion, selected languages with proportions) of each text."""
        out: list = [(UNKNOWN, 0.0, [])] * len(texts)
        if not self.names:
            return out
        docs, buckets, counts = [], [], []
        for i, text in enumerate(texts):
            if has_letter(text):
                n = np.bincount(trigrams(text), minlength=BUCKETS)
                at = np.flatnonzero(n)
                docs.append(i)
                buckets.append(at)
                counts.append(n[at])
        if not docs:
            return out
        sizes = np.array([len(b) for b in buckets])
        first = np.cumsum(sizes) - sizes
        n = np.concatenate(counts).astype(np.float32)
        log = self.log[np.concatenate(buckets)]
        total = np.add.reduceat(n.astype(np.float64), first)
        single = np.add.reduceat(n[:, None] * log, first, dtype=np.float64)
        best = single.argmax(1)
        # Gain per unit of a small share of each other language, at the best single language.
        ratio = np.exp(np.minimum(log - log[np.arange(len(log)), np.repeat(best, sizes)][:, None], 60))
        slope = np.add.reduceat(n[:, None] * ratio, first, dtype=np.float64) - total[:, None]
        cost = PENALTY * 0.5 * np.log(np.maximum(total, 2))
        # Concave: the gain of a share s is at most s times the slope, so at most the slope.
        slope[np.arange(len(best)), best] = -np.inf
        for d, i in enumerate(docs):
            out[i] = (self.names[best[d]], 1.0, [(self.names[best[d]], 1.0)])
        for d in np.flatnonzero(slope.max(1) > cost):
            part = slice(first[d], first[d] + sizes[d])
            out[docs[d]] = self._mixture(log[part].astype(np.float64), n[part].astype(np.float64), single[d], int(best[d]), cost[d])
        return out

    def _mixture(self, log: np.ndarray, n: np.ndarray, single: np.ndarray, best: int, cost: float):
        """Forward selection: the language that raises the likelihood most joins while it pays its cost."""
        chosen, share, likelihood = [best], np.ones(1), single[best]
        p = np.exp(log - log.max(1, keepdims=True))
        base = float((n * log.max(1)).sum())
        while len(chosen) < len(self.names):
            mixed = p[:, chosen] @ share
            slopes = (n / mixed) @ p - n.sum()
            slopes[chosen] = -np.inf
            candidate = int(slopes.argmax())
            if slopes[candidate] <= cost:
                break
            trial = [*chosen, candidate]
            pi = np.append(share * 0.8, 0.2)
            own = p[:, trial]
            for _ in range(STEPS):
                r = own * pi
                pi = (n / r.sum(1)) @ r / n.sum()
            gained = base + float((n * np.log(own @ pi)).sum())
            if gained - likelihood <= cost:
                break
            chosen, share, likelihood = trial, pi, gained
        order = np.lexsort((chosen, -share))
        named = [(self.names[chosen[i]], float(min(1.0, share[i]))) for i in order]
        return named[0][0], named[0][1], named


def _count(batches):
    """Trigram counts per language of a task, as one row per language and bucket met."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        languages, at = batch.column(2).to_pylist(), 0
        for _, texts in chunks([batch]):
            for text, language in zip(texts, languages[at : at + len(texts)], strict=True):
                if has_letter(text):
                    if language not in totals:
                        totals[language] = np.zeros(BUCKETS, np.int64)
                    totals[language] += np.bincount(trigrams(text), minlength=BUCKETS)
            at += len(texts)
    for language, n in totals.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["language", "bucket", "n"])


def learn(docs: DataFrame, *, text: str = "text", language: str = "lang") -> LanguageModel:
    """Count the trigrams of every labelled document; rows without text or label teach nothing.

    The model has one row of BUCKETS numbers per language, so what reaches the driver is bounded by the
    number of languages, not by the documents.
    """
    bounded_batches(docs.sparkSession)
    source = docs.filter(F.col(f"`{language}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    source = source.select(F.lit(0).alias("k"), F.col(f"`{text}`").cast("string").cast("binary").alias("t"), F.col(f"`{language}`").cast("string").alias("language"))
    summed = source.mapInArrow(_count, "language string, bucket int, n bigint").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    rows = summed.toArrow()
    names = sorted(set(rows["language"].to_pylist()))
    counts = np.zeros((len(names), BUCKETS))
    if names:
        place = {x: i for i, x in enumerate(names)}
        counts[[place[x] for x in rows["language"].to_pylist()], rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return LanguageModel(names, counts)


def _predict(model):
    def run(batches):
        for keys, texts in chunks(batches):
            found = model.value.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                 pa.array([",".join(f"{x}:{s:.3f}" for x, s in f[2]) for f in found], pa.string())],
                ["doc_id", "lang_pred", "score", "mixture"])

    return run


def identify(docs: DataFrame, model: LanguageModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, lang_pred, score (its proportion), mixture (the selected languages).

    A null text, a text without a letter and an empty model give ``und`` and 0; repeated rows each get their row.
    """
    source = doc_columns(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return source.mapInArrow(_predict(shared), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, mixture string")


def language_report(docs: DataFrame, *, key: str = "doc_id", modulus: int = 4, held_out: int = 2) -> DataFrame:
    """Learn from the documents outside of the held-out part, predict all of them."""
    out = F.coalesce(is_held_out(key, modulus, held_out), F.lit(False))
    model = learn(docs.filter(~out))
    found = identify(docs, model, key=key)
    return found.select("doc_id", F.coalesce(is_held_out("doc_id", modulus, held_out), F.lit(False)).alias("held_out"), "lang_pred", "score", "mixture")
