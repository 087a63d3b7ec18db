"""Chat formatting with typed content parts.

A turn is a role and an ordered list of parts: text, image, audio or document. A visitor flattens the parts into one
text in which attachments stand as numbered placeholders, and records for each its kind, its reference and the tokens
that it expands to. The template marks turns; control strings inside texts and roles are escaped reversibly. Each turn
is formatted by itself, with the spans that training loss falls on, so no conversation has to fit into one row: a
conversation is its segments in order.

Escaping: a backslash is doubled, and a backslash is put behind the first character of every control string. Text parts
that follow each other are escaped as one text, so no control string can be put together from several of them. Reading
back, a backslash and the character behind it stand for that character.

Defined cases: null texts and parts are empty, a null role is an empty role; turns are ordered by turn (null first), and
turns that tie by role and text, so repeated rows stay as repeated turns; a null conv_id is a conversation of its own;
an empty table gives no rows; an attachment without a reference keeps its placeholder and has an empty one; a part of any
other type is an attachment of kind `other` that expands to no token; a size that is null, negative or not finite counts
as 0, and the tokens of a part stop at ``MOST_TOKENS``; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: The control strings of this template and of the common ones it must not be confused with.
CONTROL = re.compile(r"<\||</?s>|\[/?INST\]|\[/?SYS\]|<</?SYS>>")
LOSS_ROLE = "assistant"
#: Tokens that one attachment expands to: image patches, audio frames a second, tokens a document page.
PATCH, FRAMES_PER_S, PAGE_TOKENS = 14, 25, 512
MOST_TOKENS = 1 << 53

PARTS = "array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
SEGMENTS = (
    "conv_id long, turn long, segment string, loss array<struct<start:int,stop:int>>, "
    "attachments array<struct<placeholder:string,kind:string,uri:string,tokens:long>>, head int"
)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


class PartVisitor:
    """Flattens the parts of one turn. ``at`` is the length of what the turn holds so far; text waits in ``held`` until a
    part of another type or the end of the turn closes it."""

    def __init__(self, at: int):
        self.at, self.out, self.held, self.text_spans, self.attachments = at, [], [], [], []

    def visit(self, part: dict) -> None:
        visit = {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}
        visit.get(part.get("type") or "text", self.visit_other)(part)

    def close(self) -> None:
        text = escape("".join(self.held))
        self.held = []
        if text:
            self.text_spans.append({"start": self.at, "stop": self.at + len(text)})
            self._add(text)

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.close()
        mark = f"<|{kind}:{len(self.attachments)}|>"
        self.attachments.append({"placeholder": mark, "kind": kind, "uri": part.get("uri") or "", "tokens": min(tokens, MOST_TOKENS)})
        self._add(mark)

    def visit_text(self, part: dict) -> None:
        self.held.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, _patches(part.get("width")) * _patches(part.get("height")))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, _units(part.get("seconds"), FRAMES_PER_S))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, _units(part.get("pages"), PAGE_TOKENS))

    def visit_other(self, part: dict) -> None:
        self._attach("other", part, 0)


def _size(size: float | None) -> float:
    return size if size is not None and math.isfinite(size) and size > 0 else 0


def _patches(size: int | None) -> int:
    return math.ceil(_size(size) / PATCH)


def _units(size: float | None, each: int) -> int:
    """Tokens of a size at so many each, rounded up."""
    return math.ceil(min(_size(size) * each, MOST_TOKENS))


def format_turn(role: str | None, parts: list[dict] | None) -> tuple[str, list[dict], list[dict], int]:
    """The segment of one turn, the spans under the loss mask, the attachments and the length of the turn's head."""
    head = TURN + escape(role or "").replace("\n", "\\\n") + "\n"
    visitor = PartVisitor(len(head))
    for part in parts or ():
        visitor.visit(part or {})
    visitor.close()
    loss = visitor.text_spans if role == LOSS_ROLE else []
    return head + "".join(visitor.out) + END + "\n", loss, visitor.attachments, len(head)


_HEAD = re.compile(re.escape(TURN) + r"((?:\\.|[^\\\n])*)\n", re.DOTALL)


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a segment, unescaped; placeholders stay in the text."""
    head = _HEAD.match(segment)
    if not head or not segment.endswith(END + "\n"):
        raise ValueError("not a formatted turn")
    return unescape(head[1]), unescape(segment[head.end() : -len(END) - 1])


def format_turns(turns: DataFrame, content: str = "text") -> DataFrame:
    """One segment per row of (conv_id, turn, role, ``content``). ``content`` is a text or an array of typed parts.
    Formatting a turn needs no other row, so nothing is shuffled."""
    typed = turns.schema[content].dataType.typeName() == "array"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, turn, roles, contents = (batch.column(k) for k in range(4))
            rows = [format_turn(r, c if typed else [{"type": "text", "text": c}]) for r, c in zip(roles.to_pylist(), contents.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    turn,
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                    pa.array([r[2] for r in rows], pa.list_(pa.struct([("placeholder", pa.string()), ("kind", pa.string()), ("uri", pa.string()), ("tokens", pa.int64())]))),
                    pa.array([r[3] for r in rows], pa.int32()),
                ],
                names=["conv_id", "turn", "segment", "loss", "attachments", "head"],
            )

    slim = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), content)
    return slim.mapInArrow(run, SEGMENTS)


class _Conversation:
    """Digests of one conversation, fed turn by turn in constant memory."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n_turns, self.loss_chars, self.chars, self.tokens = conv_id, 0, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, loss: list[dict], attachments: list[dict]) -> None:
        role, text = read_turn(segment)
        self.n_turns += 1
        self.chars += len(segment)
        self.turns.update(f"{role}\n{text}\n".encode())
        for span in loss or ():
            under = unescape(segment[span["start"] : span["stop"]])
            self.loss_chars += len(under)
            self.loss.update(under.encode())
        self.tokens += sum(a["tokens"] for a in attachments or ())

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens


_DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("attachment_tokens", pa.int64())]
)


def digest(segments: DataFrame) -> DataFrame:
    """The contract's columns, read back from the segments. A conversation's segments arrive sorted and are digested one
    by one; a digest of a sequence has to be taken in its order, but nothing of it is held in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if now is None or now.conv_id != row["conv_id"]:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(row["conv_id"])
                now.add(row["segment"], row["loss"], row["attachments"])
            yield _table(done)
        if now is not None:
            yield _table([now.row()])

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * len(_DIGEST), _DIGEST, strict=True)], schema=_DIGEST)

    plain = lambda text: F.regexp_replace(text, r"(?s)\\(.)", "$1")
    head, whole = F.col("head"), F.length("segment")
    role = plain(F.substring("segment", F.lit(len(TURN) + 1), head - len(TURN) - 1))
    text = plain(F.substring("segment", head + 1, whole - head - len(END) - 1))
    ordered = segments.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", role, text)
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachment_tokens long")


#: The conversation that the contract adds: a user and an assistant row made of control strings.
CONTROL_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]

ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), formatted AS (
  SELECT *, length('<|turn|>') + length(role) + 1 + length('<|end|>') + 1
         + length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '<\||</?s>|\[/?INST\]|\[/?SYS\]|<</?SYS>>')) AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS attachment_tokens
FROM formatted GROUP BY conv_id
"""
