"""Plain Python versions of what the text operators compute, for comparison."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def spaced(text, lower=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def jaccard_classes(docs, shingle, threshold):
    """{doc_id: (set size, smallest doc_id reachable)} by comparing all pairs that share a shingle."""
    sets = {}
    for i, text in docs:
        w = spaced(text)
        sets[i] = frozenset(tuple(w[j : j + shingle]) for j in range(len(w) - shingle + 1)) if len(w) >= shingle else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = defaultdict(list)
    for i in sorted(sets):
        common = defaultdict(int)
        for s in sets[i]:
            for j in seen[s]:
                common[j] += 1
            seen[s].append(i)
        for j, n in common.items():
            if threshold[1] * n >= threshold[0] * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def passages(docs, items, window=10):
    """{doc_id: (n_words, hit positions, item ids)}."""
    windows = defaultdict(set)
    for i, text in items:
        w = alnum(text)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(str(i))
    sizes = {len(k) for k in windows}
    out = {}
    for i, text in docs:
        w, hit, ids = alnum(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (key := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    ids |= windows[key]
        out[i] = (len(w), hit, ids)
    return out


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = spaced(text, lower=False)
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def base_spans(text):
    """Spans of the four base kinds by the stated patterns."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        luhn = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1]))
        if 14 <= len(d) <= 19 and luhn % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))
