"""Chat formatting from an event log.

The log is a stream of events (conv_id, seq, kind, message, role, text). It is partitioned by
conversation and sorted by sequence, and each conversation is folded in one pass:

* ``message``     a whole message
* ``delta``       text to append to the message, begun by its first delta
* ``edit``        replaces the message's text
* ``regenerate``  empties the message's text; deltas that follow fill it again, in its place
* ``delete``      removes the message

A message is final once its conversation ends or ``final`` events say so; final messages are
rendered in order of first appearance. A conversation made of whole messages alone streams: each
message is rendered as it comes, so memory follows the longest message and not the
conversation. Rendering yields one segment a turn; a conversation's text is its segments in order.

Template, a turn: ``<|turn|>role\\n`` text ``<|end|>\\n``. Control strings inside roles and texts get
one escape mark after their first character, one more where they have some already, so removing
one mark gives back any text; a role's newlines and backslashes are backslash escapes. The loss
mask covers the texts of assistant turns.

Defined results: null role or text is empty; null conv_id is a conversation of its own; rows of
equal seq go by message, role and text, and each whole message counts, repeated or not; a null
seq comes first; events of an unknown kind are ignored; an edit of an unknown message begins it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.llm.workspace import lean_batches

OPEN, CLOSE, MARK = "<|turn|>", "<|end|>\n", "\u2060"
#: Control strings of common chat templates besides this one's own.
CONTROL = ["<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>"]
# No control string holds its first character again but <<SYS>>, whose second < is left to the body.
_BODIES = "|".join(re.escape(c[1:]) for c in sorted(set(CONTROL), key=len, reverse=True))
ESCAPE_PATTERN = f"([<\\[])({MARK}*)({_BODIES})"
_ESCAPE = re.compile(ESCAPE_PATTERN)
_UNESCAPE = re.compile(f"([<\\[]){MARK}({MARK}*)({_BODIES})")
_EVENTS = ("conv_id", "seq", "kind", "message", "role", "text")
SEGMENTS = "conv_id long, turn_index long, segment string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return _ESCAPE.sub(rf"\1\2{MARK}\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment and the span of its text in it that the loss covers (empty but for the assistant)."""
    head, body = f"{OPEN}{_role_out(role)}\n", escape(text)
    end = len(head) + (len(body) if role == "assistant" else 0)
    return head + body + CLOSE, len(head), end


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a segment."""
    if not segment.startswith(OPEN) or not segment.endswith(CLOSE):
        raise ValueError("not a turn")
    role, _, body = segment[len(OPEN) : -len(CLOSE)].partition("\n")
    if OPEN in body or CLOSE[:-1] in body or OPEN in role:
        raise ValueError("a control string inside a turn")
    return _role_in(role), unescape(body)


def fold(events: Iterable[tuple]) -> Iterator[tuple[str, str]]:
    """Final (role, text) messages of one conversation, from its (kind, message, role, text) in order.

    Whole messages before the first streamed one are final at once unless a later event could
    name them, which takes a message name: those without one are never kept.
    """
    held: dict[str, list] = {}
    order: list[list] = []
    for kind, message, role, text in events:
        if kind == "message" and message is None:
            if not order:
                yield role or "", text or ""
            else:
                order.append([role or "", [text or ""], True])
            continue
        if kind == "final":
            held.pop(message, None)
            while order and not any(order[0] is x for x in held.values()):
                first = order.pop(0)
                if first[2]:
                    yield first[0], "".join(first[1])
            continue
        if kind not in ("message", "delta", "edit", "regenerate", "delete"):
            continue
        if message not in held:
            if kind == "delete":
                continue
            held[message] = [role or "", [], True]
            order.append(held[message])
        own = held[message]
        if kind == "delete":
            own[2] = False
            own[1].clear()
        else:
            if kind != "delta":
                own[1].clear()
            own[2] = True
            own[0] = role or own[0]
            if kind != "regenerate":
                own[1].append(text or "")
    for role, parts, there in order:
        if there:
            yield role, "".join(parts)


def _conversations(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """Runs of equal first column in sorted rows, each as an iterator over the other columns."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns[:width]]))
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[0]

        def own() -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                yield ahead[1:]
                ahead = next(rows, None)

        run = own()
        yield key, run
        for _ in run:  # whatever was left unread
            pass


def _batched(rows: Iterable[tuple], schema: pa.Schema, most: int = 1000, most_chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    chars = 0
    for r in rows:
        held.append(r)
        chars += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= most or chars >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_SEGMENT_SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn_index", pa.int64()), ("segment", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for conv, events in _conversations(batches, 5):
            for k, (role, text) in enumerate(fold(events)):
                yield conv, k, *render(role, text)

    yield from _batched(rows(), _SEGMENT_SCHEMA)


def format_log(events: DataFrame) -> DataFrame:
    """Segments (conv_id, turn_index, segment, loss_start, loss_end), sorted by conversation and turn in each partition.

    One conversation is read by one task, as a stream: its order is sequential by nature. The
    sort spills to disk, and nothing of a conversation is collected.
    """
    columns = [F.col(c).cast("long" if c in ("conv_id", "seq") else "string").alias(c) for c in _EVENTS]
    lean_batches(events.sparkSession)
    dealt = events.select(*columns).repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "seq", "message", "role", "text")
    return dealt.select("conv_id", "kind", "message", "role", "text").mapInArrow(_render, SEGMENTS)


_DIGEST_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for conv, segments in _conversations(batches, 5):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = chars = covered = 0
            for _, segment, start, end in segments:
                role, text = parse(segment)
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                under = unescape(segment[start:end])
                loss.update(under.encode("utf-8", "surrogatepass"))
                n, chars, covered = n + 1, chars + len(segment), covered + len(under)
            yield conv, n, turns.hexdigest(), covered, loss.hexdigest(), chars

    yield from _batched(rows(), _DIGEST_SCHEMA)


def digests(segments: DataFrame) -> DataFrame:
    """Read formatted conversations back; ``segments`` as ``format_log`` returns them."""
    return segments.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turns_as_events(turns: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log of whole messages."""
    return turns.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("message"), "role", "text")
