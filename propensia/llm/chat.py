"""Chat formatting: records of any known layout become turns, turns become marked-up text with a loss mask.

The layout of a record is recognised by a fingerprint: the hash of the set of its nested field paths (array
steps written ``[]``), restricted to paths that any mapping mentions. Each mapping is declarative: where the
turns are, which paths hold role and text, how roles are renamed. All fingerprints that a mapping can have
(with and without its optional paths) are computed once. A fingerprint beyond these belongs to a record that mixes
fields of several layouts: the mapping whose required paths it contains is taken, the most specific one first (most
required paths, then most list steps, then the order of the mappings), and remembered. Recognising is one lookup.

Defined results: a null, no JSON object, JSON nested too deeply or an unknown layout gives no turns but a row with its
fingerprint; a list item that is no object gives a row without a segment at its place; half of a surrogate pair becomes
U+FFFD; a null text is empty; a system text beside a list of turns becomes the first turn.

Turns are written as ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed. Control
strings inside roles and texts are made harmless reversibly: a backslash is put between ``<`` and ``|``, and
one more where backslashes already stand there. Only assistant texts are under the loss mask.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensia.llm.common import bounded_batches, partitions_for

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"

# Other names of the three roles.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """How a layout's fields become turns.

    ``turns`` is the path of a list of turns with ``role`` and ``text`` inside it; without it ``fields`` lists
    (role, paths of the record joined by a blank line). ``optional`` paths may be absent; ``lead`` ones hold
    system texts that stand beside a list of turns.
    """

    name: str
    turns: str | None = None
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: frozenset[str] = frozenset()
    rename: bool = True
    lead: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        if self.turns is not None:
            inner = f"{self.turns}[]." if self.turns else ""
            return {inner + self.role, inner + self.text}
        return {p for _, paths in self.fields for p in paths}

    def required(self) -> set[str]:
        return self.paths() - self.optional


LEAD = ("system", "system_prompt", "context")

MAPPINGS = (
    Mapping("turn rows", turns="", role="role", text="text", rename=False),
    Mapping("messages", turns="messages", role="role", text="content", lead=LEAD),
    Mapping("message parts", turns="messages", role="role", text="content[].text", lead=LEAD),
    Mapping("from and value", turns="conversations", role="from", text="value", lead=LEAD),
    Mapping("dialogue", turns="dialog", role="speaker", text="utterance", lead=LEAD),
    Mapping("instruction", fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=frozenset({"system", "input"})),
    Mapping("prompt and completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt and response", fields=(("system", ("system_prompt",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=frozenset({"system_prompt"})),
    Mapping("prompt and chosen", fields=(("user", ("prompt",)), ("assistant", ("chosen",)))),
    Mapping("question and answer", fields=(("system", ("context",)), ("user", ("question",)), ("assistant", ("answer",))), optional=frozenset({"context"})),
    Mapping("question and response", fields=(("system", ("system_prompt",)), ("user", ("question",)), ("assistant", ("response",))), optional=frozenset({"system_prompt"})),
)


def field_paths(value) -> set[str]:
    """Paths of all leaves; an empty list or object is a leaf."""
    out, todo = set(), [(value, "")]
    while todo:
        value, at = todo.pop()
        if isinstance(value, dict) and value:
            todo += [(v, f"{at}.{k}" if at else k) for k, v in value.items()]
        elif isinstance(value, list) and value:
            todo += [(v, f"{at}[]") for v in value]
        else:
            out.add(at)
    return out


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


class Layouts:
    """Fingerprint to mapping, for every set of paths a mapping can have."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.known = set().union(*(m.paths() for m in mappings))
        # Most specific first; sorting keeps the order of the mappings among equals.
        self.mappings = sorted(mappings, key=lambda m: (-len(m.required()), -sum(p.count("[]") for p in m.required())))
        self.by_print: dict[str, Mapping | None] = {}
        for m in mappings:
            for k in range(len(m.optional) + 1):
                for left_out in itertools.combinations(sorted(m.optional), k):
                    self.by_print.setdefault(fingerprint(m.paths() - set(left_out)), m)

    def recognise(self, record) -> tuple[str, Mapping | None]:
        paths = field_paths(record) & self.known
        print_ = fingerprint(paths)
        if print_ not in self.by_print:
            self.by_print[print_] = next((m for m in self.mappings if m.required() <= paths), None)
        return print_, self.by_print[print_]

    def turns(self, record) -> tuple[str, str | None, list[tuple[str, str] | None]]:
        """(fingerprint, name of the layout or None, turns); a layout that is not known has no turns, None is no turn."""
        print_, m = self.recognise(record)
        if m is None:
            return print_, None, []
        if m.turns is None:
            out = []
            for role, paths in m.fields:
                parts = [t for p in paths if (t := _text(record.get(p)))]
                if parts or not all(p in m.optional for p in paths):
                    out.append((role, "\n\n".join(parts)))
            return print_, m.name, out
        items = record.get(m.turns) if m.turns else [record]
        if not isinstance(items, list):  # a dotted name that only looks like the path
            return print_, None, []
        out = [("system", t) for p in m.lead if (t := _text(record.get(p)))]
        for item in items:
            if not isinstance(item, dict):
                out.append(None)
                continue
            role, text = _text(item.get(m.role)), item.get(m.text.split("[")[0])
            if "[]" in m.text:
                leaf = m.text.split("[].")[1]
                text = "".join(_text(p.get(leaf) if isinstance(p, dict) else p) for p in text) if isinstance(text, list) else text
            out.append((ROLE_NAMES.get(role, role) if m.rename else role, _text(text)))
        return print_, m.name, out


_HALVES = re.compile("[\ud800-\udfff]")


def _text(value) -> str:
    """A null is an empty text; what is no text is written as JSON. Half of a surrogate pair becomes U+FFFD."""
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return text if text.isascii() else _HALVES.sub("\ufffd", text)


_RAW, _SAFE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _RAW.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _SAFE.sub(r"<\1|", text) if "<\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(segment, start and end of the part under the loss mask); a line feed in a role is written ``<|n``."""
    head = f"{START}{escape(role).replace(chr(10), '<|n')}\n"
    body = escape(text)
    segment = f"{head}{body}{END}\n"
    return segment, len(head), len(head) + (len(body) if role == LEARNED else 0)


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a formatted segment."""
    role, _, rest = segment[len(START):].partition("\n")
    return unescape(role.replace("<|n", "\n")), unescape(rest[: -len(END) - 1])


def _format(layouts: Layouts):
    def run(batches):
        for batch in batches:
            out = []
            for conv, turn, record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                print_, name, turns = None, None, []
                try:
                    value = json.loads(record) if record is not None else None
                    if isinstance(value, dict):
                        print_, name, turns = layouts.turns(value)
                except (ValueError, RecursionError):
                    pass
                for i, turn_ in enumerate(turns):
                    out.append((conv, turn, i, print_, name, *(format_turn(*turn_) if turn_ else (None, None, None))))
                if not turns:
                    out.append((conv, turn, None, print_, name, None, None, None))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [batch.schema.field(0).type, batch.schema.field(1).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "turn", "seq", "fingerprint", "layout", "segment", "loss_start", "loss_end"])

    return run


def format_records(records: DataFrame, *, key: str = "conv_id", order: str = "turn", record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """One row per turn: key, order, seq (within the record), fingerprint, layout, segment and its loss range.

    ``record`` holds JSON text. A record that is no JSON object, or of an unknown layout, gives one row without a
    segment, with its fingerprint, so that nothing is lost without a trace.
    """
    bounded_batches(records.sparkSession)
    source = records.select(F.col(f"`{key}`").cast("bigint").alias("conv_id"), F.col(f"`{order}`").cast("bigint").alias("turn"), F.col(f"`{record}`").cast("string").alias("record"))
    return source.mapInArrow(
        _format(Layouts(mappings)), "conv_id bigint, turn bigint, seq bigint, fingerprint string, layout string, segment string, loss_start bigint, loss_end bigint")


def _digest(batches):
    """Read conversations back, turn by turn; a conversation of any length is held as running hashes only."""
    current, state = None, None

    def row():
        return (*current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        out = []
        for conv, segment, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if current != (conv,):
                if current is not None:
                    out.append(row())
                current, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            if segment is None:
                continue
            role, text = read_turn(segment)
            learned = unescape(segment[start:end])
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(learned)
            state[3].update(learned.encode())
            state[4] += len(segment)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names)
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(row(), strict=True), kinds, strict=True)], names)


def conversation_report(formatted: DataFrame) -> DataFrame:
    """Per conversation the digests of what its formatted segments read back as, turns in order.

    A conversation's digest is a hash over all its turns, so its segments pass one task one after the other,
    sorted by Spark (spilling where needed); the task keeps running hashes, never the conversation. Equal
    turn numbers are ordered by segment. A conversation without a readable turn has 0 turns.
    """
    spark = formatted.sparkSession
    parts = partitions_for(spark, 0, 1)
    ordered = formatted.select("conv_id", "turn", "seq", "segment", "loss_start", "loss_end").repartition(parts, "conv_id")
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "seq", "segment").select("conv_id", "segment", "loss_start", "loss_end")
    return ordered.mapInArrow(_digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def turn_rows_as_records(conversations: DataFrame) -> DataFrame:
    """The given table (one turn per row) as records; every field is written, a null one as null."""
    return conversations.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
