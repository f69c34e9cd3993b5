"""Each text operator beside a plain version, on the smallest given tables and on odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from propensia.llm import bpe, chat, decontaminate, fertility, graph, jaccard, language, licences, pages, personal, scoring
from tests.llm import plain
from tests.llm.conftest import TABLES

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# ---- 1 licences


def test_licence_base_places(spark, odd_docs, odd_rows, given):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

    def expected(i, text):
        w = plain.alnum(text)
        at = [(s, label) for p, label in phrases.items() for s in range(len(w)) if tuple(w[s : s + len(p)]) == p]
        starts = [s for s, _ in at]
        return i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))

    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert rows(licences.licence_report(odd_docs), *columns) == sorted((expected(i, t) for i, t, _ in odd_rows), key=str)
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    assert rows(licences.licence_report(docs), *columns) == sorted((expected(i, t) for i, t in given), key=str)


def test_licence_templates(spark):
    full, keys = licences.TEMPLATES["mit-text"]
    texts = {
        1: "some words " * 40 + full + " more words" * 30,
        2: full.replace("associated documentation files", "its associated documentation files"),  # one word more
        3: full.replace("free of charge, ", ""),  # a key phrase is missing
        4: "the software is without restriction and the above copyright notice " * 5,
        5: "Licensed under CC BY-NC 4.0.\n" + licences.TEMPLATES["isc"][0],
        6: None,
    }
    out = {r[0]: (r[1], r[2]) for r in rows(licences.licence_report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), "doc_id", "labels", "score")}
    assert out[1] == ("mit-text", 1.0) and out[2][0] == "mit-text" and out[3] == ("", 0.0) and out[4] == ("", 0.0) and out[6] == ("", 0.0)
    assert out[5][0] == "cc-by-nc,isc" and 0 < out[5][1] <= 1


# ---- 2 chat


@pytest.mark.parametrize("record, layout, turns", [
    ('{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": null}]}', "messages", [("user", "hi"), ("assistant", "")]),
    ('{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "id": 7}', "from and value", [("user", "a"), ("assistant", "b")]),
    ('{"instruction": "do", "input": "", "output": "done", "meta": {"x": [1, 2]}}', "instruction", [("user", "do"), ("assistant", "done")]),
    ('{"instruction": "do", "output": "done"}', "instruction", [("user", "do"), ("assistant", "done")]),
    ('{"prompt": "p", "completion": "c"}', "prompt and completion", [("user", "p"), ("assistant", "c")]),
    ('{"system_prompt": "s", "question": "q", "response": "r"}', "question and response", [("system", "s"), ("user", "q"), ("assistant", "r")]),
    ('{"messages": [{"role": "user", "content": [{"text": "a"}, {"text": "b"}]}]}', "message parts", [("user", "ab")]),
    ('{"role": "gpt", "text": "kept"}', "turn rows", [("gpt", "kept")]),
    ('{"something": 1}', None, []),
    ('[1, 2]', None, []),
    ('no json', None, []),
    (None, None, []),
])
def test_chat_layouts(spark, record, layout, turns):
    df = spark.createDataFrame([(1, 0, record)], "conv_id long, turn long, record string")
    got = chat.format_records(df).orderBy("seq").collect()
    assert {r.layout for r in got} == {layout}
    assert [chat.read_turn(r.segment) for r in got if r.segment is not None] == turns
    assert [r.segment[r.loss_start : r.loss_end] for r in got if r.segment] == [chat.escape(t) if role == "assistant" else "" for role, t in turns]


def test_chat_escapes_are_reversible():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "\\", "|", "<|im_end|>", "<|im_start|>", "x", "\n", "é"]) for _ in range(rng.randint(0, 12)))
        role = rng.choice(["user", "assistant", "a\nb", text])
        segment, _, _ = chat.format_turn(role, text)
        assert chat.read_turn(segment) == (role, text)
        assert segment.count(chat.START) == 1 and segment.count(chat.END) == 1


def test_chat_report_ties_nulls_and_empty(spark):
    data = [(1, 0, "user", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (None, 0, None, "x"), (2, 0, "assistant", "z" * 100_000)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.conversation_report(chat.format_records(chat.turn_rows_as_records(df))).collect()}
    assert out[1].turns_sha256 == plain.sha("user\n\nassistant\na\nassistant\nb\n") and out[1].loss_sha256 == plain.sha("ab") and out[1].loss_chars == 2
    assert out[None].turns_sha256 == plain.sha("\nx\n") and out[2].loss_chars == 100_000
    assert chat.conversation_report(chat.format_records(chat.turn_rows_as_records(df.limit(0)))).count() == 0


# ---- 3 pages


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("just text", "just text"),
    ("<nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One<b>two</b>\n three<br>four</p><p>End</p></article><footer>Foot</footer>", "A & B Onetwo three four End"),
    ("<body><script>var a='<p>no</p>'</script><style>p{}</style><article><p>Yes<!-- no --></p></article>", "Yes"),
    ("<article><p>Text here</p><div class='comments'><p>I think that this is the best of all the texts on the page</p></div></article>", "Text here"),
    ("<article><p>Text here</p></article><section id=comments><article><p>a reader says that it is the best of all of them</p></article></section>", "Text here"),
    ("<main><p>It is the text of the page and it has a lot of words in it.</p><aside>related</aside><form><input>Name<button>Go</button></form></main>", "It is the text of the page and it has a lot of words in it."),
    ("<div class='ad'>Buy it</div><div><p>It is the text of the page and it has a lot of words in it.</p><p>Short.</p></div><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>",
     "It is the text of the page and it has a lot of words in it. Short."),
    ("<p>&lt;tag&gt; &eacute;&#233;&nbsp;x " + "the word of it " * 5 + "</p>", "<tag> éé x " + ("the word of it " * 5).strip()),
    ("<article><p>unclosed <b>bold <p>next</article>tail of the page", "unclosed bold next"),
])
def test_page_rules(page, text):
    assert pages.main_text(page or "")[0] == text


LONG = "It is the story of the town and of the people that lived in it for as long as they had the river and the mill, " * 3
CARD = "The best of all the things that you can do in the town this year"


@pytest.mark.parametrize("page, there, gone", [
    # Prose in div and section beside unlinked article cards, with and without a hinting name around them.
    (f"<div><p>{LONG}</p><p>{LONG}</p></div><section class='related'><article><h3>Card</h3><p>{CARD}</p></article></section>", [LONG], [CARD]),
    (f"<section><p>{LONG}</p></section><div class='related-posts'><article><p>{CARD}</p></article></div>", [LONG], [CARD]),
    # Prose outside of the article that is long, dense and not linked.
    (f"<article><p>{LONG}</p><p>{LONG}</p></article><div><p>{LONG.replace('town', 'village')}</p></div><div><p>{CARD}</p></div>", [LONG, LONG.replace("town", "village")], [CARD]),
    # A boilerplate name around the card of a page with an article.
    (f"<article><p>{LONG}</p></article><div class='related'><article><p>{CARD}</p></article></div>", [LONG], [CARD]),
])
def test_page_articles_are_evidence(page, there, gone):
    text = pages.main_text(page)[0]
    assert all(x.strip() in text for x in there) and not any(x in text for x in gone)


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "page-header", "legal-text", "search-results", "widget", "ad"])
def test_page_hints_are_evidence(name):
    assert pages.main_text(f"<div class='{name}'><p>{LONG}</p><p>{CARD}</p></div><footer>Foot</footer>")[0] == f"{LONG.strip()} {CARD}"


def test_page_names_count_as_a_whole():
    assert pages.main_text(f"<article><div class='entry-header'><h1>A title</h1></div><p>{LONG}</p></article>")[0] == f"A title {LONG.strip()}"
    for name in ("related", "related-posts", "site-header", "cookie-banner", "adUnit", "social_share"):
        assert pages.main_text(f"<div><p>{LONG}</p><p>{LONG}</p></div><div class='{name}'><p>{CARD}</p></div>")[0] == f"{LONG.strip()} {LONG.strip()}"


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", None, 1), (1, "u", None, 1), (None, None, "<p>é</p>", 2)], "page_id long, url string, html string, text int")
    assert rows(pages.extract_pages(df), "page_id", "url", "text", "n_chars") == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "é", 1)], key=str)
    assert pages.extract_pages(df.limit(0)).count() == 0
    many = "<html>" + "<div>" * 3000 + "x" + "<" * 2000
    assert pages.main_text(many)[0].startswith("x")


# ---- 4 personal data


@pytest.fixture(scope="module")
def field():
    return personal.train()


def test_base_spans(spark, odd_docs, odd_rows, given, field):
    def kept(spans):
        return ",".join(s for s in spans.split(",") if s.split(":")[0] in personal.PATTERNS)

    got = rows(personal.span_report(odd_docs, field=field), "doc_id", "base_sha256", "spans")
    assert [(i, s) for i, s, _ in got] == sorted(((i, plain.sha(plain.base_spans(t))) for i, t, _ in odd_rows), key=str)
    assert all(s == plain.sha(kept(spans)) for _, s, spans in got)
    assert [spans.split(",")[-1].split(":")[0] for i, _, spans in got if i == 52] == ["secret"]
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    assert rows(personal.span_report(docs, field=field), "doc_id", "base_sha256") == sorted(((i, plain.sha(plain.base_spans(t))) for i, t in given), key=str)


def test_field_on_unseen_values(field):
    finder, right, total = personal.Finder(field), 0, 0
    for words, labels in personal.labelled_sentences(seed=1234):
        spans = [s for s in finder([" ".join(words).encode()])[0] if s[2] in personal.FIELD_KINDS]
        wanted = sum(personal.LABELS[x].startswith("B-") for x in labels)
        total += 1
        right += len(spans) == wanted
    assert right >= 0.97 * total


def test_field_skips_only_what_cannot_matter(field):
    """The shortcut for lines without a promising word gives what decoding every line gives."""
    rng = random.Random(2)
    texts = [" ".join(personal.value_of(rng.choice(["prose", "first", "hex18", "num", "pass", "same"]), rng) for _ in range(6)).encode() for _ in range(300)]
    usual = personal.Finder(field)(texts)
    slack, field.slack = field.slack, 1e9
    try:
        assert personal.Finder(field)(texts) == usual
    finally:
        field.slack = slack


def test_viterbi_is_the_best_path(field):
    rng = np.random.default_rng(1)
    k = len(personal.LABELS)
    for n in (1, 2, 3):
        scores = rng.normal(0, 3, (1, n, k)).astype(np.float32)
        best = max(np.ndindex(*[k] * n), key=lambda y: sum(scores[0, i, a] for i, a in enumerate(y)) + sum(field.transitions[a, b] for a, b in zip((0, *y), (*y, 0))))
        assert tuple(field.viterbi(scores, np.array([n]))[0]) == best


def test_redaction(odd_docs, no_docs, field):
    out = {r.doc_id: r for r in personal.redact(odd_docs, field=field).collect()}
    assert out[1].text is None and out[2].text == "" and out[52].node == "n"
    assert out[52].text.startswith("mail [EMAIL] or [IP] and 999.1.1.1, call [PHONE], card [CARD]. password=[SECRET] ")
    assert personal.redact(odd_docs, field=field).schema == odd_docs.schema and personal.redact(no_docs, field=field).count() == 0


# ---- 5 BPE


def test_bpe_equals_the_library(spark, odd_rows, given):
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(WORDS), bpe.WordBpe(WORDS)
    rng = random.Random(9)
    alphabet = "abcé'ſsßΣσİıǅ \n\t\x0b\x1c\x85​ <|>endoftext12½😀ñ한글́"
    texts = [t or "" for _, t, _ in odd_rows] + [t or "" for _, t in given[:60]] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["<|endoftext|>x<|startoftext|>", "a<|endoftext|><|endoftext|>  b", "don't we'll I'M it'S", "<|ENDOFTEXT|>"]
    for text, packed in zip(texts, ours.encode(texts), strict=True):
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, np.uint32).tolist() == ids
        assert ours.decode(packed) == theirs.decode(ids, skip_special_tokens=False)


def test_pair_index_equals_merging_one_by_one():
    rng = random.Random(4)
    ranks, symbols = {}, 4
    while len(ranks) < 30:
        pair = (rng.randrange(symbols), rng.randrange(symbols))
        if pair not in ranks:
            ranks[pair] = (len(ranks), symbols)
            symbols += 1
    pieces = [[rng.randrange(4) for _ in range(rng.randint(0, 25))] for _ in range(400)]

    def alone(p):
        p = list(p)
        while True:
            found = [(ranks[x][0], i) for i, x in enumerate(zip(p, p[1:])) if x in ranks]
            if not found:
                return p
            rank, _ = min(found)
            pair = next(x for x, r in ranks.items() if r[0] == rank)
            i, out = 0, []
            while i < len(p):
                if tuple(p[i : i + 2]) == pair:
                    out.append(ranks[pair][1])
                    i += 2
                else:
                    out.append(p[i])
                    i += 1
            p = out

    flat = np.array([-1] + [s for p in pieces for s in (*p, -1)])
    done, out = bpe.PairIndex(ranks).merge(flat).tolist(), [[]]
    for s in done[1:]:
        if s == -1:
            out.append([])
        elif s >= 0:
            out[-1].append(s)
    assert out[:-1] == [alone(p) for p in pieces]
    assert bpe.PairIndex({}).merge(np.array([-1, 3, -1])).tolist() == [-1, 3, -1]


def test_bpe_keeps_a_bounded_memory_of_pieces(monkeypatch):
    """Ids do not depend on what is remembered; the older half goes."""
    theirs, ours = Tokenizer.from_file(WORDS), bpe.WordBpe(WORDS)
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 60)
    rng = random.Random(5)
    for _ in range(12):
        texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(2)]
        assert [np.frombuffer(p, np.uint32).tolist() for p in ours.encode(texts)] == [theirs.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(ours.known) < 60 + 70


def test_bpe_round_trip(odd_docs, no_docs):
    encoded = bpe.encode(odd_docs, WORDS)
    texts = {r.doc_id: r.text for r in bpe.decode(encoded, WORDS).collect()}
    report = {r.doc_id: r for r in bpe.round_trip_report(odd_docs, WORDS).collect()}
    assert all(r.decoded_sha256 == plain.sha(texts[i]) for i, r in report.items()) and report[1].n_tokens == 0 and texts[2] == ""
    assert bpe.round_trip_report(odd_docs, WORDS).filter("doc_id = 60").count() == 2 and bpe.round_trip_report(no_docs, WORDS).count() == 0


# ---- 6 language model


def test_scores(odd_docs, odd_rows, no_docs):
    out = {r.doc_id: r for r in scoring.score_report(odd_docs).collect()}
    tokens = [(i, [*plain.spaced(t), None]) for i, t, _ in odd_rows]
    held = {i for i, _ in tokens if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(w for i, ws in tokens if i not in held for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens:
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.score < 0 and r.perplexity >= 1
    assert scoring.score_report(odd_docs).filter("doc_id = 60").count() == 2 and scoring.score_report(no_docs).count() == 0
    assert {r.doc_id: round(r.score, 9) for r in scoring.score_report(odd_docs).collect()} == {i: round(r.score, 9) for i, r in out.items()}


def test_predictions_sum_to_one():
    rng = np.random.default_rng(0)
    words = np.sort(rng.integers(0, 1 << 63, 40).astype(np.uint64))
    key = np.unique(rng.integers(0, 40 * scoring.CONTEXTS, 3000))
    key = np.unique(np.append(key, np.arange(40) * scoring.CONTEXTS))
    shard = scoring.Shard(words, key // scoring.CONTEXTS, key % scoring.CONTEXTS, rng.integers(1, 300, len(key)))
    seating, base = scoring.Seating.first(shard), 1 / 41
    for _ in range(3):
        seating.sweep(seating.totals(), base, rng)
    assert (seating.tables <= shard.count).all() and (seating.tables >= 1).all()
    every = np.append(np.arange(40), -1)
    for context in (0, 7, scoring.START):
        assert seating.predict(seating.totals(), base, every, np.full(41, context)).sum() == pytest.approx(1.0)


@pytest.mark.parametrize("level, others, parent", [(0, 50, 0.01), (0, 0, 0.2), (0, 20_000, 0.01), (1, 300, 0.02), (2, 20_000, 1e-5)])
@pytest.mark.parametrize("customers, many", [(1, 100), (2, 20_000), (40, 20_000), (700, 6_000)])
def test_seating_in_blocks_equals_one_by_one(level, others, parent, customers, many):
    rng = np.random.default_rng([level, customers])
    d, strength = scoring.DISCOUNT[level], scoring.STRENGTH[level]
    tables = np.ones(many)
    for i in range(1, customers):
        new = (strength + d * (others + tables)) * parent
        tables += rng.random(many) < new / (i - d * tables + new)
    drawn = scoring._seat(np.full(many, customers), level, np.full(many, others), np.full(many, parent), rng)
    assert drawn.min() >= 1 and drawn.max() <= customers
    # Both means are of random draws: four standard errors of their difference, and half a percent for the blocks.
    assert abs(drawn.mean() - tables.mean()) <= 4 * tables.std() * (2 / many) ** 0.5 + 0.005 * tables.mean()
    assert drawn.std() == pytest.approx(tables.std(), rel=0.08, abs=0.02)


def test_leaving_customers_close_their_tables():
    rng = np.random.default_rng(3)
    customers = rng.integers(1, 60, 5000)
    tables = rng.integers(1, customers + 1)
    leaving = rng.integers(0, customers + 1)
    closed = scoring._leave(customers, tables, leaving, rng)
    left, kept = customers - leaving, tables - closed
    assert (closed >= 0).all() and (closed[leaving == 0] == 0).all() and (kept[left == 0] == 0).all()
    assert (kept[left > 0] >= 1).all() and (kept <= left).all()
    # Half of 1,000 customers at 400 tables leave: half of the tables close.
    many = scoring._leave(np.full(4000, 1000), np.full(4000, 400), np.full(4000, 500), rng)
    assert many.mean() == pytest.approx(200, abs=1)


def test_model_beats_counting_on_held_out_text(spark):
    out = scoring.score_report(spark.read.parquet(f"{TABLES}/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_contexts_are_words(spark):
    """Words that end alike are contexts of their own."""
    texts = [f"{first} {second}" for first, second in (("walking", "home"), ("talking", "loud"), ("baking", "bread")) for _ in range(40)]
    learned = scoring.learn(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    asked = spark.createDataFrame([(i, f"{first} {second}") for i, (first, second) in enumerate((a, b) for a in ("walking", "talking", "baking") for b in ("home", "loud", "bread"))], "doc_id long, text string")
    score = {r.doc_id: r.score for r in scoring.score_texts(asked, learned).collect()}
    for i in range(3):
        assert all(score[3 * i + i] > score[3 * i + j] + 1 for j in range(3) if j != i)


def test_scores_in_shards_equal_plain_sums(spark, odd_docs, odd_rows, monkeypatch):
    """Contexts in many shards, some dealt over all of them, common pairs and words left to the root, beside one dictionary."""
    monkeypatch.setattr(scoring, "SHARD_CHARS", 10_000)
    monkeypatch.setattr(scoring, "COMMON", 40)
    learned = scoring.learn(odd_docs.filter("doc_id % 3 != 0"))
    model, named = learned.model, lambda w: xxhash.xxh3_64_intdigest(b" " if w is None else w.encode())
    assert len(model.frequent.hot) > 1 and 0 < len(model.common) <= 40

    def followed(text):
        words = [named(w) for w in [None, *plain.spaced(text), None]]
        return list(zip(words[:-1], words[1:], strict=True))

    counts = Counter(pair for i, t, _ in odd_rows if i % 3 for pair in followed(t))
    seats = {r["shard"]: r.asDict() for r in learned.seats.collect()}
    found, tables = {}, [{}, {}]
    for row in learned.pairs.collect():
        shard, contexts = scoring._pairs(row.asDict(), model.frequent), np.frombuffer(row["contexts"], np.uint64)
        pairs = list(zip(contexts[shard.context].tolist(), shard.words[shard.owner].tolist(), strict=True))
        found |= dict(zip(pairs, shard.count.tolist(), strict=True))
        for kept, name in zip(tables, ("tables", "tables_before"), strict=True):
            drawn = iter(scoring._ints(seats[row["shard"]][name]).tolist())
            kept |= {pair: next(drawn) if n > 1 else 1 for pair, n in zip(pairs, shard.count.tolist(), strict=True)}
    assert found == counts and all(1 <= t <= counts[pair] for kept in tables for pair, t in kept.items())
    root = [{}, {}]
    for row in learned.words.collect():
        values = [scoring._ints(row[name]).tolist() for name in scoring._ANSWER_NAMES]
        for word, n, *seen in zip(np.frombuffer(row["words"], np.uint64).tolist(), *values, strict=True):
            assert n == sum(c for (_, w), c in counts.items() if w == word)
            for i in (0, 1):
                root[i][word] = tuple(seen[2 * i : 2 * i + 2])
    for kept, of_word in zip(tables, root, strict=True):
        assert {w: c for w, (c, _) in of_word.items()} == {w: sum(t for (_, x), t in kept.items() if x == w) for w in of_word}

    def predict(i, context, word):
        all_customers, all_tables = (sum(v[j] for v in root[i].values()) for j in (0, 1))
        p = scoring._predict(*root[i].get(word, (0, 0)), all_customers, all_tables, 2, 1 / (len(root[i]) + 1))
        of_context = [sum(x[pair] for pair in counts if pair[0] == context) for x in (counts, tables[i])]
        return scoring._predict(counts[context, word], tables[i].get((context, word), 0), *of_context, 0, p)

    assert sum(predict(0, named("the"), w) for w in [*root[0], -1]) == pytest.approx(1.0)
    known = {}
    for r in scoring.score_texts(odd_docs, learned).collect():
        pairs = followed(next(t for i, t, _ in odd_rows if i == r.doc_id))
        for pair in set(pairs) - set(known):
            known[pair] = math.log10((predict(0, *pair) + predict(1, *pair)) / 2)
        assert r.score == pytest.approx(sum(known[pair] for pair in pairs), rel=1e-9) and r.n_known == sum(w in root[0] for _, w in pairs)


# ---- 7 language


def test_language(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    found = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert found >= 0.97
    model = language.learn(docs)
    de, fr = (" ".join(r[0] for r in docs.filter(f"lang = '{x}'").select("text").limit(3).collect()) for x in ("de", "fr"))
    (name, share, mixture), = model.predict([(de + " " + fr[: len(de) // 2]).encode()])
    assert name == "de" and {x for x, _ in mixture} == {"de", "fr"} and 0.5 < share < 0.9
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language.language_report(odd_docs).collect()}
    assert all(odd[i] == ("und", 0.0) for i in (1, 2, 3, 8)) and all(0 <= s <= 1 for _, s in odd.values())
    assert language.language_report(no_docs).count() == 0


# ---- 8 quality


def test_quality_counts(spark, odd_docs, odd_rows, given, no_docs):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    report = fertility.quality_report(odd_docs, PIECES)
    assert rows(report, *columns) == sorted(((i, *plain.quality_counts(t)) for i, t, _ in odd_rows), key=str)
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    assert rows(fertility.quality_report(docs, PIECES), *columns) == sorted(((i, *plain.quality_counts(t)) for i, t in given), key=str)
    assert report.filter("base_failed and kept").count() == 0
    kept = fertility.keep_good(odd_docs, PIECES)
    assert kept.schema == odd_docs.schema and rows(kept, "doc_id") == rows(report.filter("kept"), "doc_id")
    assert fertility.quality_report(no_docs, PIECES).count() == 0 and fertility.keep_good(no_docs, PIECES).count() == 0


def test_fertility_measures():
    pieces, text = fertility.Pieces(PIECES), "plain words ᚠᛇᚻ and more of them"
    ids = pieces.of([w.encode() for w in text.split()])
    assert ids.tolist() == [i for w in text.split() for i in pieces.model.encode(w)]
    chars, share, entropy = fertility.token_measures(ids, len(text.replace(" ", "")), pieces.is_byte)
    assert share == sum(pieces.model.is_byte(i) for i in ids.tolist()) / len(ids) and 0 < entropy <= 1
    good, noise = "the house on the hill was built by a man who came from the north " * 1, "9f3c7a1be04d5528c6e1f09ab7d3"
    assert fertility.within(fertility.BANDS["en"], fertility.token_measures(pieces.of(good.encode().split()), len(good.replace(" ", "")), pieces.is_byte))
    assert not fertility.within(fertility.BANDS["en"], fertility.token_measures(pieces.of([noise.encode()] * 30), 30 * len(noise), pieces.is_byte))
    assert fertility.dominant_script("привет мир".encode()) == "cyrillic" and fertility.dominant_script(b"123") == "other"


NATURAL = {
    "en": "The keeper of the old lighthouse climbed the stairs every evening, lit the lamp and watched the ships pass slowly along the coast until the morning wind drove the fog back over the sea.",
    "fr": "Les élèves étaient très fatigués après la journée à l'école, mais ils ont préféré rester près de la forêt où le père de Zoé leur a raconté l'histoire d'un hérisson égaré.",
    "de": "Die Größe der Häuser überraschte die Gäste, während die Bürger über die schönen Straßen und die großen Plätze sprachen. Später gingen sie müde nach Hause und träumten von früher.",
    "es": "El niño pequeño corrió por la montaña mientras su mamá preparaba la comida. Después, los señores del pueblo cantaron una canción sobre el corazón y todos bailaron hasta la mañana.",
}


def letters(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(n))


def test_quality_bands_reject_noise_and_mojibake(spark):
    rng = random.Random(8)
    texts = [(i, letters(rng, 30 * (i + 1)), ["en", "fr", "de", "es", None][i % 5]) for i in range(50)]
    texts += [(100 + i, t, lang) for i, (lang, t) in enumerate(NATURAL.items())]
    texts += [(200, NATURAL["de"].encode().decode("latin-1"), "de"), (201, None, "de")]
    kept = {r.doc_id for r in fertility.keep_good(spark.createDataFrame(texts, "doc_id long, text string, lang string"), PIECES).collect()}
    assert kept == {100, 101, 102, 103}


def test_quality_fences_are_counted_on_the_table(spark):
    """Text that the absolute bands let pass is rejected where it lies apart from the table's own documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(9)
    clean = [r for r in docs.filter("lang = 'en'").collect() if not plain.quality_counts(r.text)[-1] and 120 < len(r.text.split()) < 300]
    broken = [(10**6 + i, " ".join(w if k % 3 else letters(rng, 1) for k, w in enumerate(r.text.split())), "en") for i, r in enumerate(clean[:20])]
    natural = [(2 * 10**6 + i, t, lang) for i, (lang, t) in enumerate(NATURAL.items())]
    both = docs.unionByName(spark.createDataFrame(broken + natural, docs.schema))
    got = {r.doc_id: r for r in fertility.quality_report(both, PIECES).collect()}
    assert sum(got[i].kept for i, _, _ in broken) <= 4 and all(got[i].kept for i, _, _ in natural)
    assert any(fertility.within(fertility.BANDS["en"], (got[i].chars_per_token, got[i].byte_share, got[i].entropy), got[i].n_tokens) for i, _, _ in broken)
    own = [r for i, r in got.items() if i < 10**6 and not r.base_failed]
    assert sum(not r.kept for r in own) <= 0.06 * len(own)
    assert sorted(r.doc_id for r in fertility.keep_good(both, PIECES).collect()) == sorted(i for i, r in got.items() if r.kept)


# ---- 9 Jaccard


@pytest.mark.parametrize("shingle, threshold", [(3, (90, 100)), (5, (80, 100)), (1, (50, 100)), (3, (1, 1))])
def test_jaccard_classes(odd_docs, odd_rows, given, spark, shingle, threshold):
    def check(df, data):
        expected = plain.jaccard_classes(dict(data).items(), shingle, threshold)
        got = jaccard.near_duplicates(df, shingle=shingle, threshold=threshold).collect()
        assert len(got) == len(data) and all((r.n_shingles, r.component_id) == expected[r.doc_id] for r in got)

    check(odd_docs, [(i, t) for i, t, _ in odd_rows])
    if shingle == 3:
        check(spark.read.parquet(f"{TABLES}/documents.parquet"), given)


def test_jaccard_random_small_sets(spark):
    rng = random.Random(11)
    data = []
    for i in range(500):
        if data and rng.random() < 0.7:
            w = rng.choice(data)[1].split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = str(rng.randrange(60))
        else:
            w = [str(rng.randrange(60)) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 25, 40, 70, 120]))]
        data.append((i, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    for shingle, threshold in ((1, (80, 100)), (2, (70, 100)), (3, (90, 100))):
        expected = plain.jaccard_classes(data, shingle, threshold)
        assert all((r.n_shingles, r.component_id) == expected[r.doc_id] for r in jaccard.near_duplicates(df, shingle=shingle, threshold=threshold).collect())


def test_jaccard_large_block_in_tiles(spark, monkeypatch):
    rng = random.Random(8)
    base, data = [str(rng.randrange(10**6)) for _ in range(150)], []
    for i in range(260):
        w = list(base)
        for _ in range(rng.choice([1, 3, 6, 9, 14])):
            w[rng.randrange(150)] = str(rng.randrange(10**6))
        data.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "TILE", 32)
    expected = plain.jaccard_classes(data, 3, (80, 100))
    got = jaccard.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), shingle=3, threshold=(80, 100)).collect()
    assert all((r.n_shingles, r.component_id) == expected[r.doc_id] for r in got)


def test_keep_one(odd_docs, no_docs):
    kept = jaccard.keep_one(odd_docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.schema == odd_docs.schema and 40 not in ids and 20 in ids and {1, 2, 3} <= set(ids) and 5 not in ids
    assert jaccard.near_duplicates(no_docs).count() == 0 and jaccard.keep_one(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(250)] + [(7, 7), (500, 501), (501, 500)] + [(900, x) for x in range(901, 960)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# ---- 10 decontamination


def digest(found):
    n, hit, ids = found
    return n, len(hit), len(ids), plain.sha(",".join(sorted(ids))), bool(hit)


def test_passages(spark, odd_docs, odd_rows, given, no_docs):
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    benchmark = spark.read.parquet(f"{TABLES}/benchmark.parquet")
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    for block_chars in (decontaminate.BLOCK_CHARS, 1500):
        expected = sorted(((i, *digest(f)) for i, f in plain.passages(given, items).items()), key=str)
        assert rows(decontaminate.passage_report(docs, benchmark, block_chars=block_chars), "doc_id", *columns) == expected
    own = [("a", odd_rows[10][1][:150]), ("b", "one two"), ("c", None), ("d", ""), ("d", "one"), ("e", odd_rows[10][1][40:200])]
    table = spark.createDataFrame(own, "item_id string, text string")
    expected = sorted(((i, *digest(f)) for i, f in plain.passages([(i, t) for i, t, _ in odd_rows], own).items()), key=str)
    assert sorted(set(rows(decontaminate.passage_report(odd_docs, table), "doc_id", *columns)), key=str) == expected
    clean = decontaminate.decontaminate(odd_docs, table)
    assert clean.schema == odd_docs.schema and rows(clean, "doc_id") == rows(decontaminate.passage_report(odd_docs, table).filter("not contaminated"), "doc_id")
    assert decontaminate.passage_report(no_docs, table).count() == 0
    assert decontaminate.passage_report(odd_docs, table.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(odd_docs, table.limit(0)).count() == odd_docs.count()


def test_passages_keep_rows_over_blocks(spark):
    """Repeated, reused and null ids: every row has its own result at any benchmark size."""
    a, b = (" ".join(f"{x}{i}" for i in range(14)) for x in "pq")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (2, a), (None, b), (None, "other words"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate([a, b] * 4)], "item_id string, text string")
    whole, blocks = (rows(decontaminate.find_passages(docs, items, block_chars=n)) for n in (decontaminate.BLOCK_CHARS, 60))
    assert len(whole) == 7 and blocks == whole


def test_repeated_ids_keep_their_rows(odd_docs, odd_rows):
    n = len(odd_rows)
    assert personal.span_report(odd_docs).count() == licences.licence_report(odd_docs).count() == fertility.quality_report(odd_docs, PIECES).count() == n
    assert hashlib.sha256(b"").hexdigest() == plain.sha("")


# ---- 9 and the pipeline: reused ids, repeated rows, common passages


def _prose(rng, n):
    return [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(4000)) for _ in range(n)]


def test_jaccard_reused_ids_keep_their_links(spark):
    rng = random.Random(8)
    x, y = _prose(rng, 120), _prose(rng, 90)
    near = x[:60] + ["changed"] + x[61:]
    rows_ = [(1, " ".join(x)), (1, " ".join(y)), (2, " ".join(near)), (3, " ".join(y[:-1])), (2, " ".join(near)), (None, " ".join(x)), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows_)], "doc_id long, text string, __id int")
    out = sorted((tuple(r) for r in jaccard.near_duplicates(docs, shingle=3, threshold=(90, 100)).collect()), key=str)
    assert [r[2] for r in out if r[0] in (1, 2, 3)] == [1] * 5 and [r[1:] for r in out if r[0] == 4] == [(0, 4), (0, 4)]
    kept = sorted((tuple(r)[:2] for r in jaccard.keep_one(docs, shingle=3, threshold=(90, 100)).collect()), key=str)
    first = [t for i, t in kept if i == 1]  # two classes, both named by id 1
    assert sorted(first) == sorted([" ".join(x), " ".join(y)]) and sorted(str(i) for i, _ in kept) == ["1", "1", "4", "4", "None"]


def test_keep_one_drops_repeated_rows_only_of_the_chosen(spark):
    rng = random.Random(9)
    x, y = " ".join(_prose(rng, 80)), " ".join(_prose(rng, 80))
    docs = spark.createDataFrame([(1, x), (1, x), (2, x), (5, y), (5, y), (6, "other words here")], "doc_id long, text string")
    assert sorted(r[0] for r in jaccard.keep_one(docs).collect()) == [1, 5, 6]


def test_jaccard_passage_in_half_of_the_documents(spark):
    rng = random.Random(10)
    passage = _prose(rng, 60)
    docs = []
    for i in range(160):
        own = _prose(rng, 150)
        docs.append((i, " ".join(own[:70] + (passage if i % 2 else []) + own[70:])))
    docs += [(200 + k, docs[k][1].replace(" ", "  ", 1)) for k in range(0, 160, 16)] + [(300 + k, docs[k][1] + " more") for k in range(1, 160, 16)]
    got = {r[0]: (r[1], r[2]) for r in jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=3, threshold=(90, 100)).collect()}
    assert got == plain.jaccard_classes(docs, 3, (90, 100))


def test_candidate_forest_is_one_edge_a_node():
    rng = np.random.default_rng(1)
    forest = jaccard.Forest()
    parent = list(range(3000))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for _ in range(6):
        a, b = rng.integers(0, 3000, 400), rng.integers(0, 3000, 400)
        forest.unite(a, b)
        for u, v in zip(a.tolist(), b.tolist(), strict=True):
            p, q = find(u), find(v)
            parent[max(p, q)] = min(p, q)
    want = {v: find(v) for v in range(3000) if find(v) != v}
    assert dict(zip(forest.nodes.tolist(), forest.roots.tolist(), strict=True)) == want
    assert jaccard.counters_for(10) == 1 << 16 and jaccard.counters_for(110_000_000) == 1 << 22 and jaccard.counters_for(10**13) == 1 << 24


def near_pairs(rng, t):
    """Pairs of sets that reach the threshold, many of them barely."""
    for _ in range(1500):
        n = int(np.exp(rng.uniform(0.7, 6.5)))
        base = rng.permutation(rng.integers(0, 2**63, 3 * n + 4).astype(np.uint64))
        gone, new = int(rng.integers(0, (1 - t[0] / t[1]) * n + 2)), int(rng.integers(0, (1 - t[0] / t[1]) * 1.3 * n + 2))
        a, b = np.unique(base[:n]), np.unique(np.concatenate([base[gone:n], base[n : n + new]]))
        both = len(np.intersect1d(a, b))
        if len(b) and t[1] * both >= t[0] * (len(a) + len(b) - both):
            yield a, b


@pytest.mark.parametrize("t", [(80, 100), (90, 100), (1, 2)])
def test_jaccard_keys_left_out_cost_no_link(t):
    rng, plan, tried = np.random.default_rng(9), jaccard.KeyPlan(t), 0
    for a, b in near_pairs(rng, t):
        share = np.uint64(rng.choice([0, 20, 50, 100]))  # shingles in a hundred that are frequent
        x, y = (plan.keys(s, s % np.uint64(100) < share) for s in (a, b))
        assert len(np.intersect1d(x, y))
        if not share and t == (80, 100):  # no more parts than can differ and one, in either class
            assert len(x) <= sum(plan.differ(len(a), jaccard._classes(len(a), t) + k) + 1 for k in (0, 1)) or len(a) < 30
        tried += 1
    assert tried > 300


def test_jaccard_long_documents_do_not_meet_by_chance():
    """A chain of long sets, each with fifty shingles of the one before, far from the threshold."""
    rng, plan = np.random.default_rng(4), jaccard.KeyPlan((80, 100))
    sets = [np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64)) for _ in range(101)]
    sets = [np.unique(np.concatenate([a, rng.permutation(b)[:50]])) for a, b in zip(sets[1:], sets, strict=False)]
    keys = [plan.keys(s, np.zeros(len(s), bool)) for s in sets]
    assert sum(bool(len(np.intersect1d(a, b))) for a, b in zip(keys, keys[1:], strict=False)) <= 1


def test_jaccard_a_node_is_sent_once_to_a_task():
    """However many shards a task goes through, the names of the nodes do not come with each of them."""
    rng = np.random.default_rng(2)
    nodes, keys = list(range(1, 301)), [rng.integers(0, 2**63, 200).astype(np.uint64) for _ in range(300)]
    keys[7] = keys[250].copy()
    few, many = jaccard._sharded(nodes, keys, 4, 1), jaccard._sharded(nodes, keys, 4, 32)
    assert sum(map(len, few["nodes"].to_pylist())) == sum(map(len, many["nodes"].to_pylist())) <= 4 * 300 * 8
    for batch in (few, many):
        assert [(e["a"], e["b"]) for b in jaccard._candidate_edges([batch]) for e in b.to_pylist()] == [(251, 8)]
