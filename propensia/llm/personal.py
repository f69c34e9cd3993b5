"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns find what has a form of its own (email, ip, card, phone). The field finds what only its
surroundings give away: secrets, persons, addresses, identity numbers. Its observations are the shape of a
word (case, digits, length, punctuation; not the word itself) and, for words that stand next to an entity
somewhere in the labelled table, their identity as a cue. It is trained from that small table by maximum
likelihood and decoded by Viterbi in numpy batches, a line of text being a sequence.

A line whose every word scores so low for every label that no path can beat "nothing here" is settled
without decoding; the bound is exact, so results are those of decoding every line.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensia.llm.common import CACHE_WORDS, bounded_batches, chunks, doc_columns

# The patterns of the base kinds, in the order in which kinds are listed.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "secret", "person", "address", "id"]
# The same matches in one pass over runs: a run of digits or of domain characters is never entered again.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(PATTERNS["phone"])

# The labelled table: a line is a sentence, [kind words] an entity. Names in braces are filled by value_of().
LABELLED = """
token = "[secret {hex40}]"
the token = "[secret {hex40}]" of the service
api_key = [secret {alnum32}]
api_key: [secret {alnum32}]
here is the key [secret {aws}] for the bucket
some words before [secret {aws}] and some after it
[secret {aws}] was found in a file
it ends with [secret {aws}]
aws_access_key_id = [secret {aws}]
password=[secret {hex18}]
and password=[secret {hex18}] at the end of it
password=[secret {pass}] was used before
my password is [secret {pass}]
your password is [secret {pass}] today
the password was [secret {pass}]
the password is [secret {pass}] for now
password: [secret {pass}]
passwd: [secret {pass}]
secret = [secret {alnum32}]
secret=[secret {alnum32}]
secret: [secret {hex40}]
bearer [secret {alnum32}]
authorization: bearer [secret {alnum32}]
mot de passe : [secret {pass}]
passwort: [secret {pass}]
contraseña: [secret {pass}]
my name is [person {first} {last}] and i live here
hello my name is [person {first} {last}]
please contact [person {first} {last}] for details
mr [person {last}] wrote to us
mrs [person {last}] said that it rains
dear [person {first} {last}], thank you
mr. [person {first} {last}] called
signed by [person {first} {last}]
je m'appelle [person {first} {last}]
mein name ist [person {first} {last}]
me llamo [person {first} {last}]
he lives at [address {num} {last} Street] since then
she lives at [address {num} {last} Avenue]
address: [address {num} {last} Road]
my ssn is [id {ssn}]
ssn: [id {ssn}]
social security number [id {ssn}] on file
the number is [id {ssn}] there
iban: [id {iban}]
my iban is [id {iban}] at the bank
account iban [id {iban}]
passport number [id {passport}]
passport: [id {passport}] was lost
""".strip().split("\n")

# Sentences without an entity; words in braces as above.
PLAIN = """
the quick brown fox jumps over the lazy dog and runs away
The quick brown fox. It jumps over the dog, and away it goes.
Le renard brun saute. Il passe par dessus le chien, et puis il part.
Der Fuchs springt über den Hund. Dann läuft er weg, und das ist alles.
El zorro salta sobre el perro. Luego se va, y eso es todo.
Licensed under the Apache License, Version 2.0.
Released under the MIT License.
This work is licensed under the GNU General Public License, version 3.
Licensed under CC BY-NC 4.0.
see version {num}.{num} of {num} for the {num} items
in {num} there were {num} of them, and {num} more
THE HEADLINE IS IN CAPITALS AND GOES ON
word### other*** third%%% fourth&&& fifth$$$
| a | b | c | d |
call +1 (555) 555-{num} or write to a.b@c.example.com
the server {num}.{num}.{num}.{num} is down
number {card} was there
the password was changed and the token expired
a secret is a secret, and the name of it is not known
my name is not here
the address of the house is not known
commit {hex40} was merged
the hash is {hex40} of the file
checksum {hex40} matches
it has {num} pages, {num} lines and {num} words
Main page | Contact | About | Help
Click here to read more. Subscribe now!
i = i + {num} ; x = y
x = {num}
id = {num}
name = value
the street is long and the road is wide
This Is A Title With Capital Words In It
On Monday The Group Met In The Big Hall
Mr and Mrs are forms of address
contact us for details
please contact support
passport photos are taken here
iban numbers are long
it is by and by. The name of it is. The rest is known
that is my name. The number is. Then the password is. What is it
what is the token. It is the secret. Here it ends
signed by hand, by the. And so on
And And And And And And And And
at the. The at. He lives. She is. Is it the. By the. Was by
{prose}
{prose}
{prose}
{prose}
{prose}
{prose}
{same}
{same}
{same}
{same}
""".strip().split("\n")

REPEATS = 4
"""Fillings of each labelled sentence; the labelled sample is bounded by the two lists times this."""


def value_of(name: str, rng: random.Random) -> str:
    """A made-up value of the kind that a name in braces stands for."""
    letters, digits, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"

    def some(alphabet: str, n: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(n))

    def prose() -> str:
        words = []
        for _ in range(rng.randint(5, 14)):
            word = some(letters + "éüñ", rng.randint(1, 9)) if rng.random() < 0.6 else rng.choice(("the", "is", "a", "of", "and", "by", "in", "to", "at"))
            form = rng.random()
            word = word.capitalize() if form < 0.25 else word.upper() if form < 0.3 else some(digits, rng.randint(1, 16)) if form < 0.33 else word
            words.append(word + (rng.choice((".", ",", ".", "!!", "###")) if rng.random() < 0.25 else ""))
        return " ".join(words)

    return {
        "prose": prose,
        "same": lambda: " ".join([rng.choice(("the", "The", "is", "ist", "With", "name", "And.", some(letters, 4).capitalize()))] * rng.randint(4, 30)),
        "hex40": lambda: some(hexes, 40),
        "hex18": lambda: some(hexes, 18),
        "alnum32": lambda: some(letters + letters.upper() + digits, rng.randint(20, 44)),
        "aws": lambda: "AKIA" + some(letters.upper() + "234567", 16),
        "pass": lambda: some(letters, rng.randint(3, 6)) + some(digits, rng.randint(2, 5)) + some(letters + "!#-_", rng.randint(1, 4)),
        "first": lambda: some(letters, rng.randint(3, 8)).capitalize(),
        "last": lambda: some(letters, rng.randint(4, 10)).capitalize(),
        "num": lambda: str(rng.randint(1, 999)),
        "card": lambda: "4" + some(digits, 15),
        "ssn": lambda: f"{some(digits, 3)}-{some(digits, 2)}-{some(digits, 4)}",
        "iban": lambda: some(letters.upper(), 2) + some(digits, rng.randint(16, 22)),
        "passport": lambda: some(letters.upper(), 1) + some(digits, 8),
    }[name]()


# ---------------------------------------------------------------- observations

_EDGE = "\"'`.,;:!?()[]<>"
_PAIR = re.compile(r"([A-Za-z_]+)[=:](.+)", re.S)

SHAPES = ["edge", "empty", "lower", "capital", "upper", "initial", "number", "long_number", "sign", "equals", "mixed_short", "mixed_medium", "mixed_long", "hex_long", "upper_mixed_long",
          "upper_mixed", "prefixed", "ssn", "marked", "other"]
_SHAPE_ID = {s: i for i, s in enumerate(SHAPES)}
_SSN, _HEX = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), re.compile(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}")
_CODE = re.compile(r"[A-Z0-9]+")
# How keys of well-known services begin.
_PREFIXED = re.compile(r"(AKIA|ASIA|ghp_|gho_|glpat-|xoxb-|xoxp-|sk_live_|AIza)[A-Za-z0-9_-]{12,}")


def core_of(word: str) -> tuple[str, str, int]:
    """(key, value, place of the value): ``key=value`` cut at its sign, surrounding punctuation left out."""
    lead = len(word) - len(word.lstrip(_EDGE))
    core = word.strip(_EDGE)
    m = _PAIR.fullmatch(core)
    if m:
        value = m[2].lstrip(_EDGE)
        return m[1], value, lead + len(core) - len(value)
    return "", core, lead


def shape_of(core: str, word: str) -> str:
    """Shape class of a word by its letters, digits and length."""
    if not core:
        return "equals" if "=" in word else "sign"
    if _PREFIXED.fullmatch(core):
        return "prefixed"
    if core.isalpha():
        if core.islower():
            return "lower"
        if len(core) == 1:
            return "initial"
        return "capital" if core[1:].islower() else "upper" if core.isupper() else "other"
    if core.isdigit():
        return "number" if len(core) < 12 else "long_number"
    if _SSN.fullmatch(core):
        return "ssn"
    if _HEX.fullmatch(core):
        return "hex_long"
    digit, letter = any(c.isdigit() for c in core), any(c.isalpha() for c in core)
    if _CODE.fullmatch(core):
        return "upper_mixed_long" if len(core) >= 16 else "upper_mixed"
    if digit and letter and core.isascii() and "@" not in core and "/" not in core:
        return "mixed_short" if len(core) < 8 else "mixed_medium" if len(core) < 20 else "mixed_long"
    if letter and not digit and core.replace("-", "").replace("'", "").isalpha():
        return "capital" if core[:1].isupper() and core[1:].islower() else "lower" if core.islower() else "other"
    return "other" if not core[-1:].isalnum() or digit else "marked"


class Observer(dict):
    """Number of a word's observation (shape, cue, whether a sign follows it, its own key), remembered per task."""

    def __init__(self, cues: dict[str, int]):
        self.cues, self.n_cues = cues, len(cues) + 1

    @property
    def size(self) -> int:
        return len(SHAPES) * self.n_cues * 2

    def parts(self, word: str) -> tuple[int, int, int]:
        key, core, _ = core_of(word)
        # A key written before the value's sign is the cue of the value itself.
        cue = self.cues.get("=" + key.lower(), 0) if key else self.cues.get(core.lower(), 0)
        return _SHAPE_ID[shape_of(core, word)], cue, int(word[-1:] in ".,;:!?")

    def __missing__(self, word: bytes) -> int:
        shape, cue, ended = self.parts(word.decode())
        number = self[word] = (shape * self.n_cues + cue) * 2 + ended
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


# ---------------------------------------------------------------- the field

_ENTITY = re.compile(r"\[(\w+) ([^\]]*)\]")
FIELD_KINDS = KINDS[len(PATTERNS):]
LABELS = ["O", *(f"{p}-{k}" for k in FIELD_KINDS for p in "BI")]
PLACES = (-2, -1, 0, 1)
"""Words around the labelled one whose observations count."""


def labelled_sentences(seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """The labelled table with its values filled in: words and the number of each word's label."""
    rng, out = random.Random(seed), []
    for line in [x for x in LABELLED for _ in range(REPEATS)] + [x for x in PLAIN for _ in range(REPEATS)]:
        filled = re.sub(r"\{(\w+)\}", lambda m: value_of(m[1], rng), line)
        text, marks, at = "", [], 0
        for m in _ENTITY.finditer(filled):
            text += filled[at : m.start()]
            marks.append((len(text), len(text) + len(m[2]), m[1]))
            text, at = text + m[2], m.end()
        text += filled[at:]
        words, labels, before = [], [], None
        for w in re.finditer(r"\S+", text):
            mark = next((k for k in marks if k[0] < w.end() and w.start() < k[1]), None)
            words.append(w.group())
            labels.append(0 if mark is None else LABELS.index(f"{'I' if mark is before else 'B'}-{mark[2]}"))
            before = mark
        out.append((words, labels))
    return out


def cue_words(sentences) -> dict[str, int]:
    """Words of the table that stand within two words before an entity, at least as often as anywhere else;
    street words that end an address; keys written onto their value."""
    near, seen = Counter(), Counter()
    for words, labels in sentences:
        for i, label in enumerate(labels):
            key, core, _ = core_of(words[i])
            core = core.lower()
            if label and key:
                near["=" + key.lower()] += 1
            if LABELS[label] == "I-address" and core in ("street", "avenue", "road"):
                near[core] += 1
            elif not label and core:
                before = any(labels[i + 1 : i + 3])
                near[core] += before
                seen[core] += not before
    return {w: i + 1 for i, w in enumerate(sorted(w for w, n in near.items() if n and n >= seen[w]))}


class Field:
    """Weights of the chain: one table of label scores per place, and transitions between labels."""

    def __init__(self, cues: dict[str, int], tables: np.ndarray, transitions: np.ndarray):
        self.cues, self.tables, self.transitions = cues, tables, transitions
        gain = transitions - transitions[0, 0]
        # Most that transitions can add to a word that leaves "nothing here".
        self.slack = 2 * max(0.0, float(gain[gain > -1e3].max()))

    def scores(self, observed: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Label scores of every word less the score of O; ``first`` and ``last`` bound each word's line."""
        at = np.arange(len(observed))
        out = np.zeros((len(observed), len(LABELS)), np.float32)
        for table, place in zip(self.tables, PLACES, strict=True):
            j = at + place
            inside = (j >= first) & (j < last)
            out += table[np.where(inside, observed[np.clip(j, 0, len(observed) - 1)], len(table) - 1)]
        return out

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of a padded batch [sequence, word, label]."""
        n, longest, k = scores.shape
        best = scores[:, 0] + self.transitions[0]
        back = np.zeros((n, longest, k), np.int8)
        for t in range(1, longest):
            ways = best[:, :, None] + self.transitions[None]
            back[:, t] = ways.argmax(1)
            step = ways.max(1) + scores[:, t]
            best = np.where((t < lengths)[:, None], step, best)
        labels = np.zeros((n, longest), np.int64)
        current = (best + self.transitions[:, 0]).argmax(1)
        for t in range(longest - 1, -1, -1):
            inside = t < lengths
            labels[:, t] = np.where(inside, current, 0)
            current = np.where(inside & (t > 0), back[np.arange(n), t, current], current)
        return labels


def _forbidden() -> np.ndarray:
    bad = np.zeros((len(LABELS), len(LABELS)), bool)
    for j, label in enumerate(LABELS):
        if label.startswith("I-"):
            bad[:, j] = [x[2:] != label[2:] for x in LABELS]
    return bad


def train(steps: int = 150, rate: float = 0.2, penalty: float = 0.001) -> Field:
    """Penalised maximum likelihood by Adam, forward-backward over the whole table at once."""
    sentences = labelled_sentences()
    cues = cue_words(sentences)
    observer = Observer(cues)
    n_obs, k = observer.size + 1, len(LABELS)
    longest = max(len(w) for w, _ in sentences)
    n = len(sentences)
    obs = np.full((n, longest + 4), n_obs - 1)
    gold, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (words, labels) in enumerate(sentences):
        obs[i, 2 : 2 + len(words)] = [observer[w.encode()] for w in words]
        gold[i, : len(labels)] = labels
        mask[i, : len(labels)] = True
    around = np.stack([obs[:, 2 + p : 2 + p + longest] for p in PLACES])
    # Shape, cue and sign have weights of their own; an observation's score is their sum.
    number = np.arange(observer.size)
    part = [np.append(number // 2 // observer.n_cues, len(SHAPES)), np.append(number // 2 % observer.n_cues, observer.n_cues), np.append(number % 2, 2)]
    sizes = [len(SHAPES) + 1, observer.n_cues + 1, 3]
    weights = [np.zeros((len(PLACES), s, k)) for s in sizes] + [np.zeros((k, k))]
    bad = _forbidden()
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    lengths = mask.sum(1)
    rows = np.arange(n)
    groups = []
    for i in range(len(PLACES)):
        seen = around[i][mask]
        order = np.argsort(seen, kind="stable")
        which, first = np.unique(seen[order], return_index=True)
        groups.append((order, first, which))
    for step in range(1, steps + 1):
        tables = sum(w[:, p] for w, p in zip(weights, part, strict=False))
        trans = np.where(bad, -1e4, weights[3])
        score = sum(tables[i][around[i]] for i in range(len(PLACES)))
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = score[:, 0] + trans[0]
        for t in range(1, longest):
            alpha[:, t] = score[:, t] + _lse(alpha[:, t - 1, :, None] + trans, 1)
        beta[rows, lengths - 1] = trans[:, 0]
        for t in range(longest - 2, -1, -1):
            b = _lse(trans[None] + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where((t < lengths - 1)[:, None], b, beta[:, t])
        z = _lse(alpha[rows, lengths - 1] + trans[:, 0], 1)
        node = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * mask[..., None]
        diff = node.copy()
        np.subtract.at(diff, (*np.nonzero(mask), gold[mask]), 1)
        g_tables = np.zeros_like(tables)
        for i, (order, first, which) in enumerate(groups):
            g_tables[i][which] = np.add.reduceat(diff[mask][order], first)
        grads = []
        for w, p in zip(weights, part, strict=False):
            g = np.zeros_like(w)
            for i in range(len(PLACES)):
                np.add.at(g[i], p, g_tables[i])
            grads.append(g)
        edge = np.zeros((k, k))
        for t in range(1, longest):
            inside = t < lengths
            ways = alpha[inside, t - 1, :, None] + trans + (score[inside, t] + beta[inside, t])[:, None, :] - z[inside, None, None]
            edge += np.exp(np.minimum(ways, 0)).sum(0)
            np.subtract.at(edge, (gold[inside, t - 1], gold[inside, t]), 1)
        edge[0] += diff[:, 0].sum(0)
        edge[:, 0] += diff[rows, lengths - 1].sum(0)
        grads.append(np.where(bad, 0, edge))
        for i, (w, g) in enumerate(zip(weights, grads, strict=True)):
            g = g / n + penalty * w
            m, v = moments[i]
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    tables = sum(w[:, p] for w, p in zip(weights, part, strict=False))
    tables = tables - tables[..., :1]
    return Field(cues, tables.astype(np.float32), np.where(bad, -1e4, weights[3]).astype(np.float32))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


# ---------------------------------------------------------------- spans

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int, str]]:
    """Matches of the email pattern, from each ``@`` to both sides; characters between two ``@`` are read once.

    The leftmost match of an ``@`` starts where the run of address characters before it does, or where the match
    before ended. What follows decides alone, so an ``@`` without a domain matches from no start.
    """
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                last = domain.end()
                found.append((start, last, "email"))
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each base kind that pass its test; a failing match is dropped.

    Time grows with the text alone, also on one run of letters or digits of any length.
    """
    found = []
    if "@" in text:
        found += _emails(text)
    if text.count(".") >= 3:
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (s[0], order[s[2]]))


def line_spans(line: str, labels: list[int]) -> list[tuple[int, int, str]]:
    """Spans of a labelled line: surrounding punctuation and a key in front of its value are left out."""
    spans, words = [], list(_WORD.finditer(line))
    i = 0
    while i < len(words):
        if labels[i]:
            kind, j = LABELS[labels[i]][2:], i + 1
            while j < len(words) and labels[j] and LABELS[labels[j]] == f"I-{kind}":
                j += 1
            start = words[i].start() + core_of(words[i].group())[2]
            last = words[j - 1].group()
            end = words[j - 1].end() - (len(last) - len(last.rstrip(_EDGE)))
            if end > start:
                spans.append((start, end, kind))
            i = j
        else:
            i += 1
    return spans


class Finder:
    """Base and field spans of a chunk of texts."""

    def __init__(self, field: Field):
        self.field, self.observer = field, Observer(field.cues)

    def __call__(self, texts: list[bytes]) -> list[list[tuple[int, int, str]]]:
        words, lengths, line_of = [], [], []
        for i, text in enumerate(texts):
            at = 0
            for line in text.split(b"\n"):
                own = line.split()
                if own:
                    words += own
                    lengths.append(len(own))
                    line_of.append((i, at, len(line)))
                at += len(line) + 1
        added: dict[int, list[tuple[int, int, str]]] = {}
        if words:
            self._decode(texts, words, np.array(lengths), line_of, added)
        out = []
        for i, text in enumerate(texts):
            base = base_spans(text.decode())
            extra = [s for s in added.get(i, ()) if not any(s[0] < b[1] and b[0] < s[1] for b in base)]
            order = {k: n for n, k in enumerate(KINDS)}
            out.append(sorted(base + extra, key=lambda s: (s[0], order[s[2]])))
        return out

    def _decode(self, texts, words, lengths, line_of, added) -> None:
        ends = np.cumsum(lengths)
        starts = ends - lengths
        first, last = np.repeat(starts, lengths), np.repeat(ends, lengths)
        scores = self.field.scores(self.observer.of(words), first, last)
        open_ = scores[:, 1:].max(1) + self.field.slack >= 0
        lines = np.flatnonzero(np.logical_or.reduceat(open_, starts))
        lines = lines[np.argsort(lengths[lines], kind="stable")]
        at = 0
        while at < len(lines):
            # Lines of similar length form a batch of bounded size.
            size = max(1, min(4096, 200_000 // int(lengths[lines[min(at + 4095, len(lines) - 1)]])))
            batch = lines[at : at + size]
            longest = int(lengths[batch].max())
            padded = np.zeros((len(batch), longest, scores.shape[1]), np.float32)
            for row, x in enumerate(batch):
                padded[row, : lengths[x]] = scores[starts[x] : ends[x]]
            for x, labels in zip(batch.tolist(), self.field.viterbi(padded, lengths[batch]), strict=True):
                if labels.any():
                    i, offset, size_of = line_of[x]
                    text = texts[i]
                    shift = len(text[:offset].decode())
                    line = text[offset : offset + size_of].decode()
                    added.setdefault(i, []).extend((a + shift, b + shift, k) for a, b, k in line_spans(line, labels.tolist()))
            at += size


@cache
def _trained() -> Field:
    return train()


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Spans replaced by their kind in brackets; of overlapping spans the first in order names the whole stretch."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def _report(field):
    def run(batches):
        finder = Finder(field.value)
        for keys, texts in chunks(batches):
            found = finder(texts)
            base = [[s for s in spans if s[2] in PATTERNS] for spans in found]
            counts = [pa.array([sum(s[2] == k for s in spans) for spans in base], pa.int64()) for k in PATTERNS]
            digest = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), *counts, pa.array(digest, pa.string()), pa.array([joined(s) for s in found], pa.string())],
                ["doc_id", *(f"n_{k}" for k in PATTERNS), "base_sha256", "spans"])

    return run


def span_report(docs: DataFrame, *, field: Field | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, counts of the base kinds, digest of the base spans, all spans as ``kind:start:end``.

    Offsets are code points, ends exclusive. Field spans that overlap a base span are left out. A null or
    empty text has no spans; repeated rows each get their row.
    """
    source = doc_columns(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(field or _trained())
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_report(shared), f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def _redact(field):
    def run(batches):
        finder = Finder(field.value)
        for batch in batches:
            at, out = 0, []
            valid = batch.column(1).is_valid().to_pylist()
            filled = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).fill_null(b"")], ["place", "text"])
            for keys, texts in chunks([filled]):
                out += [redacted(t.decode(), s) if ok else None for t, s, ok in zip(texts, finder(texts), valid[at : at + len(keys)], strict=True)]
                at += len(keys)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(out, pa.string())], [*batch.schema.names[2:], "__redacted"])

    return run


def redact(docs: DataFrame, *, field: Field | None = None, text: str = "text") -> DataFrame:
    """Every row with its text redacted, all other columns as they are; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(field or _trained())
    bounded_batches(docs.sparkSession)
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    source = docs.select(F.lit(0).alias("place"), F.col(f"`{text}`").cast("binary").alias("text"), *(k for k, c in zip(kept, docs.columns, strict=True) if c != text))
    rest = [f for f in docs.schema.fields if f.name != text]
    names = [f"c{i}" for i, c in enumerate(docs.columns) if c != text]
    ddl = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(names, rest, strict=True)] + ["__redacted string"])
    done = source.mapInArrow(_redact(shared), ddl)
    return done.select(*(F.col("__redacted" if c == text else f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
