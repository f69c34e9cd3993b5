"""Records of mixed layouts, pages built from parts of known role, and texts that repeat a character or word."""

import json
import random
import re

import numpy as np
import pytest

from propensia.llm import chat, decontaminate, pages, personal
from tests.llm import plain

# ---- 2 chat: one table of many layouts

U, A = ("user", "hi"), ("assistant", "yes")
MESSAGES = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes"}]
PAIRS = [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yes"}]
RECORDS = [
    ({"prompt": "hi", "messages": MESSAGES}, "messages", [U, A]),
    ({"prompt": "hi", "prompt_id": "7", "messages": MESSAGES, "chosen": MESSAGES, "rejected": []}, "messages", [U, A]),
    ({"system": "s", "conversations": PAIRS}, "from and value", [("system", "s"), U, A]),
    ({"system": "", "conversations": PAIRS, "id": 3}, "from and value", [U, A]),
    ({"context": "c", "messages": MESSAGES}, "messages", [("system", "c"), U, A]),
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": [{"type": "text", "text": "y"}, "es", {"type": "image"}]}]}, "message parts", [U, A]),
    ({"messages": [*MESSAGES, "odd", None, 5]}, "messages", [U, A, None, None, None]),
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant"}]}, "messages", [U, ("assistant", "")]),
    ({"dialog": [{"speaker": "user", "utterance": "hi"}], "source": "x", "text": "t"}, "dialogue", [U]),
    ({"instruction": "hi", "output": "yes", "text": "hi yes"}, "instruction", [U, A]),
    ({"instruction": "hi", "output": "yes", "context": "c"}, "instruction", [U, A]),
    ({"question": "hi", "answer": "yes", "system_prompt": None}, "question and answer", [U, A]),
    ({"prompt": "hi", "chosen": "yes", "rejected": "no", "system": "s"}, "prompt and chosen", [U, A]),
    ({"system_prompt": "s", "prompt": "hi", "response": "yes", "question": "?"}, "prompt and response", [("system", "s"), U, A]),
    ({"prompt": "\ud800hi", "completion": "yes\udfff"}, "prompt and completion", [("user", "�hi"), ("assistant", "yes�")]),
    ({"messages": []}, None, []),
    ({"messages": "text"}, None, []),
    ({"messages": {"role": "user", "content": "hi"}}, None, []),
    ({"messages[].role": "user", "messages[].content": "hi"}, None, []),
]
DEEP = '{"prompt": "hi", "completion": ' + "[" * 20_000 + "]" * 20_000 + "}"


def test_chat_layouts_mixed_in_one_table(spark):
    data = [(i, 0, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(100, 0, DEEP), (101, 0, "{"), (102, 0, None), (103, 0, "")]
    got = {}
    for r in sorted(chat.format_records(spark.createDataFrame(data, "conv_id long, turn long, record string")).collect(), key=lambda r: (r.conv_id, r.seq or 0)):
        got.setdefault(r.conv_id, (r.layout, []))[1].append(chat.read_turn(r.segment) if r.segment is not None else None)
    for i, (record, layout, turns) in enumerate(RECORDS):
        assert got[i] == (layout, turns or [None]), record
    assert all(got[i] == (None, [None]) for i in (100, 101, 102, 103))


def test_chat_exact_layouts_stay(spark):
    """Every mapping recognises its own records, with and without its optional fields, and not those of others."""
    layouts = chat.Layouts()
    for m in chat.MAPPINGS:
        for paths in (m.paths(), m.required()):
            assert layouts.by_print[chat.fingerprint(paths)] is m


# ---- 3 pages: parts of known role

PROSE = [
    "It is the story of the town and of the people that lived in it for as long as they had the river and the mill of the valley.",
    "They were at the market in the morning, and it was not for the first time that the rain had come to them from the hills.",
    "The bridge that was built by the two brothers is still there, and you can see it from the road on a day with no fog in the air.",
]
LONG = " ".join(PROSE)
KEPT = [(f"<p>{t}</p>", t) for t in PROSE] + [
    (f"<div><p>{LONG}</p></div>", LONG),
    (f"<p>{PROSE[0]} <a href=x>more</a> of it</p>", f"{PROSE[0]} more of it"),
    (f"<svg viewBox='0 0 1 1'/><p>{PROSE[1]}</p>", PROSE[1]),
    (f"<svg><text>a label</text><title>t</title></svg><p>{PROSE[2]}</p>", PROSE[2]),
    (f"<video src=a><p>{PROSE[0]}</p>", PROSE[0]),
    (f"<object data=x><p>{PROSE[1]}</p>", PROSE[1]),
    (f"<math><mi>x</mi></math><p>{PROSE[1]}</p>", PROSE[1]),
]
DROPPED = [
    "<nav><a href=a>Home</a> <a href=b>News</a></nav>", "<script>var a = '<p>no</p>';</script>", "<style>p { color: red }</style>", "<form><label>Name</label><input></form>",
    *(f"<div class='{name}'><p>{LONG}</p></div>" for name in ("cookie-banner", "advert", "newsletter signup", "sponsored-post", "gdpr-notice")),
    *(f"<div class='{name}'><p>{PROSE[0]}</p></div>" for name in ("comment-content", "comment-body", "comments", "comment-text", "comment_author_entry")),
    "<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>", "<noscript>Turn it on</noscript>",
]
SHELLS = ["{}", "<html><head><title>T</title><meta a=b></head><body>{}</body></html>", "<html><head><title>T</title><meta a=b>{}", "<title>T</title><main>{}</main>", "<!doctype html><head><style>x</style><body><article>{}</article>"]


@pytest.mark.parametrize("shell", SHELLS)
def test_pages_built_from_parts(shell):
    rng = random.Random(SHELLS.index(shell))
    for _ in range(150):
        kept = [rng.choice(KEPT[:3]) for _ in range(3)] + [("<p>" + LONG + "</p>", LONG)] * 3 + rng.sample(KEPT, 2)
        rng.shuffle(kept)
        # Media that never end take what stands in their element: each part in an element of its own.
        parts = [(f"<div>{h}</div>", t) for h, t in kept] + [(h, None) for h in rng.sample(DROPPED, 3)]
        if "article" not in shell and "main" not in shell:
            rng.shuffle(parts)
        assert pages.main_text(shell.format("".join(h for h, _ in parts)))[0] == " ".join(t for _, t in parts if t)


# ---- 4 personal data: the patterns as they are written, and long runs


def _by_patterns(text):
    found = [(m.start(), m.end(), "email") for m in re.finditer(personal.PATTERNS["email"], text)]
    found += [(m.start(), m.end(), "ip") for m in re.finditer(personal.PATTERNS["ip"], text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(personal.PATTERNS["card"], text):
        digits = re.sub("[ -]", "", m.group())
        if 14 <= len(digits) <= 19 and personal._luhn(digits):
            found.append((m.start(), m.end(), "card"))
    return sorted(found + [(m.start(), m.end(), "phone") for m in re.finditer(personal.PATTERNS["phone"], text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15])


@pytest.mark.parametrize("letters", ["ab@._-%", "012.", "0123 -+()", "a1@. +-_é%", "4 -1", "@.a"])
def test_base_spans_equal_the_patterns(letters):
    rng = random.Random(letters)
    for _ in range(6000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 40)))
        assert sorted(personal.base_spans(text)) == _by_patterns(text), text


@pytest.mark.parametrize("unit", ["a", "1", "1 ", "a@", "1.", "a.", "@", "+1(", "1-"])
def test_base_spans_of_long_runs_end(unit):
    """A million characters of one run: a start inside of each run would take hours."""
    text = unit * (1_000_000 // len(unit)) + " ! a.b@c.de 1.2.3.4"
    got = personal.base_spans(text)
    assert got[-2:] == [(len(text) - 16, len(text) - 8, "email"), (len(text) - 7, len(text), "ip")]


# ---- 10 decontamination: repetition


def _matched(docs, items, window=10, shingle=3):
    block, cache = decontaminate.ItemBlock(items, window, shingle), decontaminate.WordHashes()
    counts = np.zeros(len(block.tokens), np.int64)
    for _, text in docs:
        words = decontaminate.alnum_words(text.encode())
        if words:
            for _, _, where in block.positions(cache.of(words), block.tokens, decontaminate._filter(block.tokens)):
                np.add.at(counts, where, 1)
    block.rank(counts)
    matcher = decontaminate.Matcher(block)
    return block, {i: matcher(text.encode()) for i, text in docs}


def test_passages_of_few_words():
    rng = random.Random(2)
    for _ in range(400):
        words, window = "a b c d".split()[: rng.randrange(1, 5)], rng.choice([10, 10, 4, 3])
        docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(4)]
        items = [(rng.choice(["i", f"i{j}", None]), rng.choice([None, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))])) for j in range(rng.randrange(6))]
        _, got = _matched(docs, items, window)
        for i, (n, hit, ids) in plain.passages(docs, items, window).items():
            assert (got[i][0], {p for a, b in got[i][1] for p in range(a, b)}, got[i][2]) == (n, set(hit), sorted(ids))


def test_passages_of_equal_words_are_looked_up_once_a_place():
    n = 50_000
    items = [(f"i{k}", "x " * n) for k in range(3)] + [("short", "x x")]
    block, got = _matched([(1, "x " * n)], items)
    assert got[1] == (n, [(0, n)], ["i0", "i1", "i2", "short"])
    assert len(block.keys) == 2  # one window of ten words, one of two
    h = decontaminate.WordHashes().of([b"x"] * n)
    seen = decontaminate._filter(block.prefix_keys)
    assert sum(len(s) for at, _, where in block.positions(h, block.prefix_keys, seen) for s, _ in block.candidates(h, at, where)) <= 2 * n


def test_windows_with_one_hash_stay_apart(monkeypatch):
    """Different windows of equal hashes: every one of them is compared word by word."""
    monkeypatch.setattr(decontaminate, "window_hashes", lambda h, n: np.full(max(0, len(h) - n + 1), 7, np.uint64))
    rng = random.Random(4)
    items = [(f"i{k}", " ".join(rng.choice("abc") for _ in range(12))) for k in range(4)]
    docs = [(1, f"z {items[0][1]} z {items[2][1]}"), (2, items[1][1][2:]), (3, "a b c")]
    _, got = _matched(docs, items)
    for i, (n, hit, ids) in plain.passages(docs, items).items():
        assert (got[i][0], {p for a, b in got[i][1] for p in range(a, b)}, got[i][2]) == (n, set(hit), sorted(ids))
