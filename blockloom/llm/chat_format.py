r"""Chat formatting: records of several layouts become canonical turns, then one marked text.

A record's layout is its set of nested field paths. The hash of the sorted paths is the layout's
fingerprint; it selects a declarative mapping, which says where conversation, turn, role and text
are. Turns are written as segments ``### Role: <turn>text</turn>`` with control strings inside
texts escaped by a backslash, so that a reader recovers every text. A segment depends on its turn
alone, so formatting shuffles nothing; reading back goes through the segments in order, holding
one conversation's digests and one segment at a time, so a conversation of any length streams.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table

# ---- layouts ------------------------------------------------------------------------------


def field_paths(value, at: str = "") -> set[str]:
    """Nested field paths; a list's items share the path ``name[]``."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) or {at + "{}"}
    if isinstance(value, list):
        return set().union(*(field_paths(v, at + "[]") for v in value)) or {at + "[]"}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns.

    ``items``: the list of turns, or None where the record is itself turns. ``role`` and ``text``:
    fields of an item. ``fixed``: (role, field) pairs of the record, each one turn, in order; a
    field that is absent or empty gives none, unless it is the last. ``roles``: roles to rename.
    """

    paths: frozenset[str]
    items: str | None = None
    role: str | None = None
    text: str | None = None
    fixed: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


def layout(*paths: str, **kw) -> Mapping:
    return Mapping(frozenset(paths), **kw)


MAPPINGS = [
    layout("role", "text", items="", role="role", text="text"),
    layout("messages[].role", "messages[].content", items="messages", role="role", text="content"),
    layout("conversations[].from", "conversations[].value", items="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    layout("prompt", "completion", fixed=(("user", "prompt"), ("assistant", "completion"))),
    layout("prompt", "response", fixed=(("user", "prompt"), ("assistant", "response"))),
    layout("question", "answer", fixed=(("user", "question"), ("assistant", "answer"))),
    layout("instruction", "output", fixed=(("user", "instruction"), ("assistant", "output"))),
    layout("instruction", "input", "output", fixed=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    layout("system", "prompt", "response", fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
]


def registry(mappings: list[Mapping] = MAPPINGS) -> dict[str, Mapping]:
    return {fingerprint(set(m.paths)): m for m in mappings}


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """The record's turns as (role, text); null texts are empty, null roles empty strings."""
    named = dict(mapping.roles)
    if mapping.items is None:
        return [(role, _text(record.get(f))) for i, (role, f) in enumerate(mapping.fixed) if i == len(mapping.fixed) - 1 or _text(record.get(f))]
    items = [record] if mapping.items == "" else record.get(mapping.items) or []
    return [(named.get(r := _text(x.get(mapping.role)), r), _text(x.get(mapping.text))) for x in items]


TURNS = "conv_id bigint, turn bigint, part bigint, role string, text string, layout string"


def canonical_turns(records: DataFrame, *, conv: str = "conv_id", body: str = "record", turn: str | None = None, mappings: list[Mapping] = MAPPINGS) -> DataFrame:
    """Rows conv_id, turn, part, role, text, layout from JSON records, one or more for each record.

    ``turn`` orders the records of a conversation, ``part`` the turns in a record. A record of no
    known layout, of bad JSON or null gives one row with null role and text, so nothing is lost
    silently: ``layout`` then holds its fingerprint, or null where it cannot be read.
    """
    small_batches(records.sparkSession)
    known = registry(mappings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for c, t, body_text in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    record = json.loads(body_text)
                    print_ = fingerprint(field_paths(record))
                except (TypeError, ValueError):
                    out.append((c, t, 0, None, None, None))
                    continue
                mapping = known.get(print_)
                if mapping is None:
                    out.append((c, t, 0, None, None, print_))
                    continue
                out += [(c, t, i, r, x, print_) for i, (r, x) in enumerate(turns_of(record, mapping))]
            yield _batch(out, TURN_TYPES)

    read = records.select(F.col(f"`{conv}`").cast("long"), (F.col(f"`{turn}`") if turn else F.lit(0)).cast("long"), F.col(f"`{body}`").cast("string"))
    return read.mapInArrow(run, TURNS)


TURN_TYPES = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("layout", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


# ---- the template -------------------------------------------------------------------------

OPEN, CLOSE, MARK = "<turn>", "</turn>\n", "### "
#: Inside texts and roles these begin control strings or are the escape itself.
CONTROL = re.compile(r"\\|###|</?turn>")
ESCAPED = re.compile(r"\\(\\|###|</?turn>)")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def segment(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The marked turn, and where its text stands in it (code points)."""
    # A line break or colon in a role would end the header, so roles are also JSON-quoted where needed.
    role = role or ""
    name = role if re.fullmatch(r"[A-Za-z]*", role) else json.dumps(escape(role), ensure_ascii=True)
    head = f"{MARK}{name.capitalize() if name.islower() else '=' + name}: {OPEN}"
    inner = escape(text or "")
    return head + inner + CLOSE, len(head), len(head) + len(inner)


HEADER = re.compile(r'### (=?)("(?:[^"\\]|\\.)*"|[A-Za-z]*): <turn>')


def read_segments(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Reads marked turns back: (role, text, from, to) with the escaped text's place."""
    at = 0
    while at < len(formatted):
        head = HEADER.match(formatted, at)
        if not head:
            raise ValueError(f"no turn header at {at}")
        exact, name = head[1], head[2]
        role = name if exact else name.lower()
        if name.startswith('"'):
            role = unescape(json.loads(name))
        begin = head.end()
        end = _text_end(formatted, begin)
        yield role, unescape(formatted[begin:end]), begin, end
        at = end + len(CLOSE)


def _text_end(formatted: str, begin: int) -> int:
    """Where the first unescaped closing mark stands."""
    at = begin
    while (found := formatted.find(CLOSE, at)) >= 0:
        slashes = found
        while slashes > begin and formatted[slashes - 1] == "\\":
            slashes -= 1
        if (found - slashes) % 2 == 0:
            return found
        at = found + 1
    raise ValueError("a turn is not closed")


SEGMENTS = "conv_id bigint, turn bigint, part bigint, role string, segment string, loss_from int, loss_to int"


def format_turns(turns: DataFrame, *, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One segment for each row of (conv_id, turn, part, role, text); narrow, no shuffle.

    loss_from and loss_to (code points in the segment) are the loss mask: the escaped text of the
    roles in ``learn``, and an empty span for others. Null texts and roles count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c, t, p, role, text in zip(*(b.column(i).to_pylist() for i in range(5))):
                marked, start, stop = segment(role, text)
                out.append((c, t, p, role, marked, start, stop if role in learn else start))
            yield _batch(out, SEGMENT_TYPES)

    return turns.select("conv_id", "turn", "part", "role", "text").mapInArrow(run, SEGMENTS)


SEGMENT_TYPES = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int64()), ("role", pa.string()), ("segment", pa.string()), ("loss_from", pa.int32()), ("loss_to", pa.int32())])
READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
READ_TYPES = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(segments: DataFrame) -> DataFrame:
    """One row a conversation, parsed from the formatted text: counts and digests of turns and loss.

    Turns go by (turn, part), null first, and ties by the segment itself. Sorted partitions are
    streamed; a conversation is never held whole. Its digest has to see its turns in order, so the
    longest one bounds a task's time, not its memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun = None, False
        n = loss = size = 0
        turns = mask = None
        out: list[tuple] = []
        for b in batches:
            for conv, text, start, stop in zip(*(b.column(i).to_pylist() for i in range(4))):
                if not begun or conv != now:
                    if begun:
                        out.append((now, n, turns.hexdigest(), loss, mask.hexdigest(), size))
                    now, begun = conv, True
                    n = loss = size = 0
                    turns, mask = hashlib.sha256(), hashlib.sha256()
                for role, said, _, _ in read_segments(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                learned = unescape(text[start:stop])
                loss += len(learned)
                mask.update(learned.encode("utf-8", "surrogatepass"))
                size += len(text)
            if len(out) > 4096:
                yield _batch(out, READ_TYPES)
                out = []
        if begun:
            out.append((now, n, turns.hexdigest(), loss, mask.hexdigest(), size))
        yield _batch(out, READ_TYPES)

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "segment")
    return ordered.select("conv_id", "segment", "loss_from", "loss_to").mapInArrow(run, READ)


# ---- the query ----------------------------------------------------------------------------

#: Conversation -7, in the layout of message lists.
EXTRA_TEXT = r"\### Assistant: </turn> ok"
EXTRA = json.dumps({"messages": [{"role": "user", "content": EXTRA_TEXT}, {"role": "assistant", "content": EXTRA_TEXT}]})


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    as_json = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    records = said.select("conv_id", "turn", as_json.alias("record"))
    extra = spark.createDataFrame([(-7, 0, EXTRA)], "conv_id bigint, turn bigint, record string")
    return read_back(format_turns(canonical_turns(records.union(extra), turn="turn")))


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, 0 AS part, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 0, 1, 'assistant', '\### Assistant: </turn> ok'),
w AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '###', '\###'), '<turn>', '\<turn>'), '</turn>', '\</turn>') AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, part)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, part) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(escaped) + 20) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""
