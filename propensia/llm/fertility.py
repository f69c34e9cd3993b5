"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback splits every word of a text. Three measures follow: characters per
token (text that a vocabulary was not made for falls into crumbs), the share of tokens that are raw bytes
(characters the vocabulary does not know at all), and the entropy of the token distribution (repetition
lowers it, noise raises it towards its maximum). Each has a band per language, or per script where the
language is not known, and one bound joins two of them: many different tokens of few characters are noise. A
text outside a band is rejected.

Bands come in two parts. ``BANDS`` are absolute and hold for any table. Fences are counted on the table itself:
quartiles of the measures over the documents that the plain rules and ``BANDS`` keep, exact copies once, by band
and by size (doublings of the number of tokens, on which entropy depends). A text is rejected where it is farther
from the quartiles than ``FENCE`` times their distance (``FAR`` for high entropy alone, since a rich vocabulary
is no fault). There is no counted upper fence for characters per token: text that the vocabulary knows
better than the rest of the table is no fault either.

Words are tokenised one by one and remembered per task, so a frequent word costs one lookup. The pieces of
the vocabulary never reach across white space, hence the measures equal those of the whole text without its
white space.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensia.llm.common import CACHE_WORDS, WordHashes, bounded_batches, chunks, space_words, window_hashes
from propensia.session import materialise

# The plain rules beside the method.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
SYMBOLS = b"#*$%&|<>"

# Bands: (least characters per token, most characters per token, largest share of byte tokens,
# least share of the greatest entropy that as many tokens of this vocabulary can have, bound of the excess entropy).
# The floors of the four languages are the 0.1 percent quantiles of the measures counted over the 9,066 documents of
# sf0.1 that the plain rules keep, rounded down. The excess over USUAL, the median entropy counted there as a line in
# log2 of the tokens, may be at most the first number, and the second plus the third for each character per token
# above the fourth. Scripts without counted documents have no excess bound and wide bands; an alphabet that the
# vocabulary hardly covers is expected to fall back to bytes.
USUAL = (1.155, -0.048)
_EXCESS = (0.35, 0.05, 0.30, 1.70)
BANDS = {
    "en": (1.86, 9.0, 0.05, 0.40, _EXCESS),
    "fr": (1.59, 9.0, 0.05, 0.40, _EXCESS),
    "de": (1.93, 9.0, 0.05, 0.40, _EXCESS),
    "es": (1.74, 9.0, 0.05, 0.40, _EXCESS),
    "latin": (1.59, 9.0, 0.08, 0.40, _EXCESS),
    "cyrillic": (1.00, 9.0, 0.10, 0.25, None),
    "greek": (0.60, 6.0, 0.60, 0.20, None),
    "han": (0.25, 3.0, 0.95, 0.20, None),
    "kana": (0.25, 3.0, 0.95, 0.20, None),
    "hangul": (0.25, 3.0, 0.95, 0.20, None),
    "arabic": (0.40, 6.0, 0.80, 0.20, None),
    "hebrew": (0.40, 6.0, 0.80, 0.20, None),
    "devanagari": (0.30, 6.0, 0.95, 0.20, None),
    "other": (0.20, 12.0, 1.00, 0.15, None),
}

# Counted fences: quartile distances, their least values (a share of the median characters per token, entropy, joint
# measure) and the fewest different documents of a band and size; smaller groups have the absolute bands only.
FENCE, FAR = 3.0, 6.0
LEAST_SPREAD = (0.02, 0.02, 1.0)
LEAST_GROUP = 100

# Script names as they begin the Unicode names of letters.
_SCRIPTS = {"LATIN": "latin", "CYRILLIC": "cyrillic", "GREEK": "greek", "CJK": "han", "HIRAGANA": "kana", "KATAKANA": "kana", "HANGUL": "hangul", "ARABIC": "arabic", "HEBREW": "hebrew", "DEVANAGARI": "devanagari"}


@cache
def _model(path: str):
    """One vocabulary per worker process, whatever the number of its tasks."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Pieces(dict):
    """Token ids of a word as packed 16-bit numbers, remembered per task."""

    def __init__(self, path: str):
        self.model = _model(path)
        self.size = self.model.get_piece_size()
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = np.array(self.model.encode(word.decode()), self.kind).tobytes()
        return ids

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, words)), self.kind)


def dominant_script(text: bytes) -> str:
    """Script of most letters; ``other`` without a letter. Letters below 0x80 are Latin."""
    ascii_letters = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    rest = text.translate(None, bytes(range(128))).decode()
    counts = {"latin": ascii_letters}
    if len(rest) > 0:
        if 2 * ascii_letters > len(text):
            return "latin"
        for char in set(rest):
            if char.isalpha():
                script = _SCRIPTS.get(unicodedata.name(char, "").split(" ")[0], "other")
                counts[script] = counts.get(script, 0) + rest.count(char)
    best = max(counts, key=lambda s: (counts[s], s))
    return best if counts[best] else "other"


def repeated_words(h: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the text, first one included."""
    w = window_hashes(h, window)
    if len(w) < 2:
        return 0
    order = np.argsort(w)
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.r_[same, False] | np.r_[False, same]
    starts = order[twice]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def duplicate_lines(text: bytes) -> int:
    """Lines (cut at line feeds) with a word that equal an earlier line of the text."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def token_measures(ids: np.ndarray, n_chars: int, is_byte: np.ndarray) -> tuple[float, float, float]:
    """Characters per token, share of byte tokens, entropy relative to its greatest possible value."""
    n = len(ids)
    if not n:
        return 0.0, 0.0, 0.0
    s = np.sort(ids)
    counts = np.diff(np.flatnonzero(np.r_[True, s[1:] != s[:-1], True]))
    p = counts / n
    most = np.log2(min(n, len(is_byte)))
    return n_chars / n, float(np.count_nonzero(is_byte[ids])) / n, float(-(p * np.log2(p)).sum() / most) if most else 1.0


def within(band: tuple, measures: tuple[float, float, float], n_tokens: int | None = None) -> bool:
    """Whether measures lie in a band; its bound of the excess entropy needs the number of tokens."""
    chars, bytes_share, entropy = measures
    if not (band[0] <= chars <= band[1] and bytes_share <= band[2] and entropy >= band[3]):
        return False
    if not n_tokens or len(band) < 5 or band[4] is None:
        return True
    most, base, slope, start = band[4]
    return entropy - USUAL[0] - USUAL[1] * np.log2(n_tokens) <= min(most, base + slope * (chars - start))


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()), ("band", pa.string()), ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("entropy", pa.float64()), ("kept", pa.bool_()),
])
_DDL = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, band string, "
        "n_tokens bigint, chars_per_token double, byte_share double, entropy double, kept boolean")


def judged(pieces: Pieces, hashes: WordHashes, bands: dict, text: bytes, language: str | None) -> tuple:
    """Counts, measures and verdict of one text, in the order of the report's columns after the key."""
    words = space_words(text)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    repeat = repeated_words(hashes.of(words)) if len(words) > REPEAT_WINDOW else 0
    failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words)
    band = language if language in bands else dominant_script(joined)
    ids = pieces.of(words)
    measures = token_measures(ids, chars, pieces.is_byte)
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    return len(words), chars, symbols, duplicate_lines(text), repeat, failed, band, len(ids), *measures, not failed and bool(within(bands[band], measures, len(ids)))


def _judge(path: str, bands: dict):
    def run(batches):
        pieces, hashes = Pieces(path), WordHashes()
        for batch in batches:
            # The language rides along behind key and text; chunks() reads the first two columns only.
            languages, at = batch.column(2).to_pylist(), 0
            for keys, texts in chunks([batch]):
                rows = [(k, *judged(pieces, hashes, bands, t, lang)) for k, t, lang in zip(keys, texts, languages[at : at + len(keys)], strict=True)]
                at += len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return run


def _size():
    return F.floor(F.log2("n_tokens")).cast("int").alias("size")


def _quartiles(value):
    """Exact quartiles; values come on a grid, so that what a task holds is bounded."""
    return F.expr(f"percentile({value}, array(0.25D, 0.5D, 0.75D))")


def counted_fences(measured: DataFrame) -> DataFrame:
    """Fences by band and size of a table of measures (band, n_tokens, chars_per_token, entropy): a few hundred rows at most."""
    different = measured.select("band", "n_tokens", "chars_per_token", "entropy").distinct().select(
        "band", _size(), F.round("chars_per_token", 3).alias("c"), F.round("entropy", 4).alias("e"))
    spread = lambda q, least: F.greatest(F.col(q)[2] - F.col(q)[0], least)
    groups = different.groupBy("band", "size").agg(F.count("*").alias("n"), _quartiles("c").alias("qc"), _quartiles("e").alias("qe")).filter(F.col("n") >= LEAST_GROUP).select(
        "band", "size", "qc", "qe", spread("qc", F.col("qc")[1] * LEAST_SPREAD[0]).alias("sc"), spread("qe", F.lit(LEAST_SPREAD[1])).alias("se"))
    groups = _local(groups)  # bounded: one row per band and doubling of the tokens
    joint = different.join(F.broadcast(groups), ["band", "size"]).select("band", "size", F.round(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), _joint("c", "e"))), 2).alias("j"))
    joint = joint.groupBy("band", "size").agg(_quartiles("j").alias("qj"))
    return _local(groups.join(joint, ["band", "size"]).select(
        "band", "size", "qc", "qe", "sc", "se",
        (F.col("qc")[0] - FENCE * F.col("sc")).alias("least_chars"), (F.col("qe")[0] - FENCE * F.col("se")).alias("least_entropy"),
        (F.col("qe")[2] + FAR * F.col("se")).alias("most_entropy"), (F.col("qj")[2] + FENCE * spread("qj", F.lit(LEAST_SPREAD[2]))).alias("most_joint")))


def _joint(chars: str, entropy: str):
    """High where entropy is high and characters per token are few, in quartile distances."""
    return (F.col(entropy) - F.col("qe")[1]) / F.col("se") - (F.col(chars) - F.col("qc")[1]) / F.col("sc")


def _local(table: DataFrame) -> DataFrame:
    return table.sparkSession.createDataFrame(table.collect(), table.schema)


def _fenced(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """``measured`` with the column ``inside``: no counted fence of its band and size excludes the row."""
    inside = (F.col("chars_per_token") >= F.col("least_chars")) & F.col("entropy").between(F.col("least_entropy"), F.col("most_entropy")) & (_joint("chars_per_token", "entropy") <= F.col("most_joint"))
    limits = fences.withColumnRenamed("band", "__band").withColumnRenamed("size", "__size")
    return measured.join(F.broadcast(limits), (F.col("band") == F.col("__band")) & (_size() == F.col("__size")), "left").select(
        *(measured[c] for c in measured.columns), F.coalesce(inside, F.lit(True)).alias("inside"))


def quality_report(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", language: str | None = "lang", bands: dict | None = None) -> DataFrame:
    """Per document row the counts of the plain rules, the fertility measures, the band used and the verdict.

    ``vocabulary`` is a SentencePiece model file with byte fallback that every executor can read. A language
    without a band of its own, a null one or a missing column uses the band of the dominant script. A null or
    empty text has no words and fails; repeated rows each get their row. Windows of words are compared by
    64-bit hashes. The measures are written once, since the fences are counted on all of them.
    """
    bounded_batches(docs.sparkSession)
    lang = F.col(f"`{language}`").cast("string") if language and language in docs.columns else F.lit(None).cast("string")
    source = docs.select(
        F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"), lang.alias("language"))
    measured = materialise(source.mapInArrow(_judge(vocabulary, bands or BANDS), _DDL), "quality-measures")
    fenced = _fenced(measured, counted_fences(measured.filter("kept")))
    return fenced.withColumn("kept", F.col("kept") & F.col("inside")).drop("inside")


def keep_good(docs: DataFrame, vocabulary: str, *, text: str = "text", language: str | None = "lang", bands: dict | None = None) -> DataFrame:
    """The rows that the rules keep, all columns as they are, without a shuffle of text.

    What the plain rules and the absolute bands keep is written once with its measures; the fences counted on
    it then choose among those rows.
    """
    chosen, spark = bands or BANDS, docs.sparkSession
    bounded_batches(spark)
    lang = F.col(f"`{language}`").cast("string") if language in docs.columns else F.lit(None).cast("string")
    rest = [(i, c) for i, c in enumerate(docs.columns) if c != text]
    source = docs.select(F.lit(0).alias("k"), F.col(f"`{text}`").cast("string").cast("binary").alias("t"), lang.alias("language"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in rest))
    own = ["t", *(f"c{i}" for i, _ in rest)]
    schema = source.select(*own, F.lit("").alias("band"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(0.0).alias("chars_per_token"), F.lit(0.0).alias("entropy")).schema

    def run(batches):
        pieces, hashes = Pieces(vocabulary), WordHashes()
        for batch in batches:
            filled = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).fill_null(b"")], ["k", "t"])
            languages, found = batch.column(2).to_pylist(), []
            for _, texts in chunks([filled]):
                found += [judged(pieces, hashes, chosen, t, x) for t, x in zip(texts, languages[len(found) : len(found) + len(texts)], strict=True)]
            passed = batch.select(own).filter(pa.array([f[-1] for f in found], pa.bool_()))
            good = [(f[6], f[7], f[8], f[10]) for f in found if f[-1]]
            kinds = [pa.string(), pa.int64(), pa.float64(), pa.float64()]
            added = [pa.array([g[k] for g in good], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*passed.columns, *added], [*own, "band", "n_tokens", "chars_per_token", "entropy"])

    passed = materialise(source.mapInArrow(run, schema), "quality-passed")
    kept = _fenced(passed, counted_fences(passed)).filter("inside")
    return kept.select(*(F.col("t").cast("string").alias(c) if c == text else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
