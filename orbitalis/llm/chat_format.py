"""Chat formatting of conversations with typed content parts.

A turn's content is a list of parts of type text, image, audio or
document (a text alone is a list of one text part).  A visitor flattens the parts in order: texts are escaped, other
parts become numbered placeholders, and for each of those an attachment record
is kept (kind, reference, position, expanded token count).  The template is

    <s>[INST] user text [/INST] assistant text </s>

with system turns between <<SYS>> and <</SYS>>.  Any control string inside a
text, placeholders included, gets one backslash after its first character; one
that already has some there gets one more.  What opens like a control string counts as one.  So a formatted text can be parsed
and unescaped without loss, for any content and any order of roles.

Loss is on the texts of assistant turns only: placeholders lie outside its spans.

Edge cases: a null text is empty; a part that is a bare string is a text part;
content that isn't a JSON list of parts of known types with whole numbers of tokens and pages is kept, as it stands, as
one text part; a null role is the empty role; roles other
than system, user and assistant are written as <|role|> name <|/role|>; turns of
equal number keep the order of role and text; repeated rows are turns of their
own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the template (fixed values), each with an opening character.
USER_OPEN, USER_CLOSE = "<s>[INST] ", " [/INST]"
ASSISTANT_OPEN, ASSISTANT_CLOSE = "<|assistant|> ", " </s>"
SYSTEM_OPEN, SYSTEM_CLOSE = "<<SYS>> ", " <</SYS>>"
OTHER_OPEN, OTHER_MID, OTHER_CLOSE = "<|role|> ", " <|/role|> ", " <|end|>"
#: The second character of every control string is one of these.
_CONTROL = re.compile(r"([<\[])(\\*)(?=[/sI|<])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=[/sI|<])")
#: Token counts of attachments where a part states none (fixed values).
DEFAULT_TOKENS = {"image": 576, "audio": 750, "document": 1024}


def escape(text: str, after: str = "") -> str:
    """The text with its control strings escaped, given the character that comes after it."""
    done = _CONTROL.sub(r"\1\2\\", text + after)
    return done[: len(done) - len(after)]


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


@dataclass
class Attachment:
    kind: str
    ref: str
    turn: int
    start: int
    tokens: int


@dataclass
class Formatted:
    """A formatted conversation; loss: spans of the text that carry loss."""

    text: str
    loss: list[tuple[int, int]]
    attachments: list[Attachment] = field(default_factory=list)


Content = str | list[dict | str] | None


class PartVisitor:
    """Flattens typed content parts into ordered text and placeholders."""

    def __init__(self) -> None:
        self.attachments: list[Attachment] = []
        self._counts: dict[str, int] = {}

    def flatten(self, content: Content, turn: int, at: int) -> tuple[str, list[tuple[int, int]]]:
        """The formatted content, and the spans of its texts, when it begins at a place."""
        self._out, self._size, self._text, self._spans, self._turn = [], at, [], [], turn
        for part in [content or ""] if content is None or isinstance(content, str) else content:
            part = {"type": "text", "text": part} if isinstance(part, str) else part
            visit = getattr(self, f"visit_{part.get('type')}", None)
            if visit is None:
                raise ValueError(f"unknown part type: {part.get('type')!r}")
            visit(part)
        self._end_text("")
        return "".join(self._out), self._spans

    def _put(self, piece: str) -> None:
        self._out.append(piece)
        self._size += len(piece)

    def _end_text(self, after: str) -> None:
        """Neighbouring texts are escaped as one, as control strings may lie across them."""
        begin, text = self._size, "".join(self._text)
        self._put(escape(text, after))
        if self._text:
            self._spans.append((begin, self._size))
        self._text = []

    def visit_text(self, part: dict) -> None:
        self._text.append(part.get("text") or "")

    def _attach(self, kind: str, part: dict) -> None:
        n = self._counts[kind] = self._counts.get(kind, -1) + 1
        mark = f"<|{kind}_{n}|>"
        self._end_text(mark[0])
        tokens = int(part.get("tokens") or DEFAULT_TOKENS[kind] * int(part.get("pages") or 1))
        self.attachments.append(Attachment(kind, str(part.get("ref") or ""), self._turn, self._size, tokens))
        self._put(mark)

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)


def _known(part) -> bool:
    if isinstance(part, str):
        return True
    if not isinstance(part, dict) or part.get("type") not in ("text", *DEFAULT_TOKENS) or not isinstance(part.get("text"), str | None):
        return False
    return all(part.get(k) is None or isinstance(part[k], int) and 0 <= part[k] < 1 << 31 for k in ("tokens", "pages"))


def parts_of(text: str | None, parts: str | None = None) -> list[dict | str]:
    """A turn's content as parts: those of a JSON list, or one text part."""
    if parts:
        try:
            found = json.loads(parts)
        except ValueError:
            found = None
        return found if isinstance(found, list) and all(map(_known, found)) else [{"type": "text", "text": parts}]
    return [{"type": "text", "text": text or ""}]


def format_turns(turns: list[tuple[str, Content]]) -> Formatted:
    """The conversation of these (role, content) turns; loss is on assistant texts."""
    visitor, pieces, loss, at = PartVisitor(), [], [], 0
    for i, (role, content) in enumerate(turns):
        if role == "user":
            before, after = USER_OPEN, USER_CLOSE
        elif role == "assistant":
            before, after = ASSISTANT_OPEN, ASSISTANT_CLOSE
        elif role == "system":
            before, after = SYSTEM_OPEN, SYSTEM_CLOSE
        else:
            before, after = OTHER_OPEN + escape(role) + OTHER_MID, OTHER_CLOSE
        body, texts = visitor.flatten(content, i, at + len(before))
        if role == "assistant":
            loss += texts
        pieces.append(before + body + after)
        at += len(pieces[-1])
    return Formatted("".join(pieces), loss, visitor.attachments)


_TURN = re.compile(
    "|".join(
        f"(?P<{name}>{re.escape(a)}(?P<{name}_body>.*?){re.escape(b)}(?=<s>|<\\||<<|$(?![\\s\\S])))"
        for name, a, b in (("user", USER_OPEN, USER_CLOSE), ("assistant", ASSISTANT_OPEN, ASSISTANT_CLOSE), ("system", SYSTEM_OPEN, SYSTEM_CLOSE))
    )
    + f"|(?P<other>{re.escape(OTHER_OPEN)}(?P<role>.*?){re.escape(OTHER_MID)}(?P<other_body>.*?){re.escape(OTHER_CLOSE)}(?=<s>|<\\||<<|$(?![\\s\\S])))",
    re.DOTALL,
)


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text; attachments stay placeholders."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup if m.lastgroup in ("user", "assistant", "system", "other") else next(k for k in ("user", "assistant", "system", "other") if m[k] is not None)
        turns.append((unescape(m["role"]) if kind == "other" else kind, unescape(m[f"{kind}_body"])))
        at = m.end()
    return turns


FORMATTED = "conv_id long, text string, loss array<struct<start:int,end:int>>, attachments array<struct<kind:string,ref:string,turn:int,start:int,tokens:int>>"


def format_conversations(turns: DataFrame, parts_col: str | None = None) -> DataFrame:
    """One row for each conv_id of turns (conv_id, turn, role, text): the formatted
    text, its loss spans and attachments.  parts_col: a JSON list of parts that
    stands in for the text where it isn't null.

    Conversations are hash-partitioned and sorted; each worker streams over
    them, so memory follows the longest conversation.
    """
    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")]
    parts = F.col(parts_col).cast("string") if parts_col else F.lit(None).cast("string")
    ordered = turns.select(*cols, F.col("turn").cast("long").alias("turn"), parts.alias("parts")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def emit(done: list[tuple[int | None, Formatted]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"conv_id": c, "text": f.text, "loss": [{"start": a, "end": b} for a, b in f.loss], "attachments": [vars(x) for x in f.attachments]} for c, f in done],
            schema=pa.schema([
                ("conv_id", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("turn", pa.int32()), ("start", pa.int32()), ("tokens", pa.int32())]))),
            ]),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done, size = None, [], [], 0
        for batch in batches:
            for conv, role, text, parts_ in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text", "parts")), strict=True):
                if held and conv != now:
                    done.append((now, format_turns(held)))
                    size += len(done[-1][1].text)
                    held = []
                    if size > 1 << 22:
                        yield emit(done)
                        done, size = [], 0
                now = conv
                held.append((role, parts_of(text, parts_)))
        if held:
            done.append((now, format_turns(held)))
        if done:
            yield emit(done)

    return ordered.mapInArrow(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long"


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations (without attachments)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, loss, attached in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "text", "loss", "attachments")), strict=True):
                turns = parse(text)
                carried = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                rows.append({
                    "conv_id": conv, "n_turns": len(turns),
                    "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                    "loss_chars": len(carried), "loss_sha256": hashlib.sha256(carried.encode()).hexdigest(), "formatted_chars": len(text),
                    "n_attachments": len(attached), "attachment_tokens": sum(x["tokens"] for x in attached),
                })
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in rows[0]]))

    return formatted.select("conv_id", "text", "loss", "attachments").mapInArrow(run, DIGESTS)


#: SQL of the query over conversations: what is read back is what went in, and the
#: formatted length is that of texts, escapes and marks.
ORACLE = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(text, chr(92), '') AS u, replace(role, chr(92), '') AS v FROM t
), m AS (
  SELECT *, length(text) + len(list_filter(range(1, length(u)), lambda i: substr(u, i, 1) IN ('<', '[') AND substr(u, i + 1, 1) IN ('/', 's', 'I', '|', '<'))) AS body,
    length(role) + len(list_filter(range(1, length(v)), lambda i: substr(v, i, 1) IN ('<', '[') AND substr(v, i + 1, 1) IN ('/', 's', 'I', '|', '<'))) AS named
  FROM e
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 19 WHEN 'system' THEN 17 ELSE 28 + named END) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attachment_tokens
FROM m GROUP BY conv_id
"""
