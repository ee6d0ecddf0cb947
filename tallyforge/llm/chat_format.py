r"""Chat formatting with a grammar round trip.

Grammar of the formatted text (one conversation is the concatenation of its turns)::

    conversation := turn*
    turn         := "[INST] " body " [/INST]"                      user
                  | "<s> " body " </s>"                            assistant
                  | "[ROLE] " body " [TEXT] " body " [/ROLE]"      any other role
    body         := (any char except backslash | "\" any char)*   without unescaped control strings

``render_turn`` writes a turn plainly, reparses it and compares the recovered turn with its source;
when they differ the content is escaped more strongly until they are identical.  Every turn starts
and ends outside a body, so the parse of a conversation is the list of the parses of its turns, and
turns can be rendered in parallel however long their conversation is.

Defined results: null text and null role are empty strings; turns sort by ``turn`` (nulls first),
equal turn numbers by their formatted text; repeated rows are repeated turns; null ``conv_id`` is a
conversation of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import ship, written

ESC = "\\"
CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[TEXT]", "[/ROLE]")
USER, ASSISTANT = "user", "assistant"
FORMS = {USER: ("[INST] ", " [/INST]"), ASSISTANT: ("<s> ", " </s>")}
OTHER = ("[ROLE] ", " [TEXT] ", " [/ROLE]")

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_STOP = re.compile(r"\\(.?)|" + "|".join(map(re.escape, CONTROLS)), re.S)


def escape(text: str, level: int) -> str:
    """Level 0: as it is; 1: backslashes and control strings; 2: every character that can begin one."""
    if level == 0:
        return text
    text = text.replace(ESC, ESC + ESC)
    if level == 1:
        return _CONTROL.sub(lambda m: ESC + m[0], text)
    return re.sub(r"[\[<]", lambda m: ESC + m[0], text)


class ParseError(ValueError):
    pass


def _body(s: str, at: int, close: str) -> tuple[str, int]:
    """The unescaped body from ``at`` to the first unescaped control string, which must end ``close``."""
    parts = []
    while m := _STOP.search(s, at):
        if m[0][0] == ESC:
            if not m[1]:
                raise ParseError("an escape at the end")
            parts.append(s[at:m.start()] + m[1])
            at = m.end()
            continue
        lead = len(close) - len(m[0].rstrip()) - (1 if close.endswith(" ") else 0)
        start = m.start() - lead
        if start < at or not s.startswith(close, start):
            raise ParseError(f"{m[0]!r} inside a body")
        parts.append(s[at:start])
        return "".join(parts), start + len(close)
    raise ParseError("a body without an end")


def parse(s: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(s):
        for role, (head, close) in FORMS.items():
            if s.startswith(head, at):
                text, at = _body(s, at + len(head), close)
                break
        else:
            if not s.startswith(OTHER[0], at):
                raise ParseError(f"no turn begins at {at}")
            role, at = _body(s, at + len(OTHER[0]), OTHER[1])
            text, at = _body(s, at, OTHER[2])
        turns.append((role, text))
    return turns


def _render(role: str, text: str, level: int) -> str:
    text = escape(text, level)
    if role in FORMS:
        return FORMS[role][0] + text + FORMS[role][1]
    return OTHER[0] + escape(role, level) + OTHER[1] + text + OTHER[2]


def render_turn(role: str | None, text: str | None) -> str:
    role, text = role or "", text or ""
    for level in (0, 1, 2):
        out = _render(role, text, level)
        try:
            if parse(out) == [(role, text)]:
                return out
        except ParseError:
            pass
    raise AssertionError("the strongest escape must parse back")


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, formatted``: one formatted turn a row; a conversation's text is their
    concatenation by (turn, formatted)."""
    ship(turns.sparkSession)
    cols = turns.select("conv_id", "turn", "role", "text")
    kinds = {f.name: f.dataType.simpleString() for f in cols.schema}

    def run(batches):
        for b in batches:
            out = [render_turn(r, t) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), pa.array(out, pa.string())], ["conv_id", "turn", "formatted"])

    return cols.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, formatted string")


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted turns and digest each conversation.  Turns stream through the task in order,
    so a conversation of any length needs the memory of one batch."""
    kind = dict(formatted.dtypes)["conv_id"]
    ship(formatted.sparkSession)

    def run(batches):
        state, seen, done = None, None, []

        def close():
            conv, n, th, lc, lh, fc = state
            done.append((conv, n, th.hexdigest(), lc, lh.hexdigest(), fc))

        def flush():
            rows, done[:] = list(done), []
            cols = list(zip(*rows)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            key_type = b.column("conv_id").type
            for conv, text in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist()):
                if seen is None or conv != state[0]:
                    if seen:
                        close()
                    state, seen = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                for role, body in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode())
                    if role == ASSISTANT:
                        state[3] += len(body)
                        state[4].update(body.encode())
                state[5] += len(text)
            if done:
                yield flush()
        if seen:
            close()
            yield flush()

    by_turn = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return by_turn.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                   "loss_sha256 string, formatted_chars long")


PROBE = "</s>[INST] ok [/INST]"


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, written, read back and digested."""
    from tallyforge.llm.common import read_table

    turns = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.createDataFrame([(-1, 0, USER, PROBE), (-1, 1, ASSISTANT, PROBE)], turns.schema)
    return read_back(written(format_turns(turns.unionByName(probe)), "chat"))


def _count(x: str, s: str) -> str:
    s = s.replace("'", "''")
    return f"(len({x}) - len(replace({x}, '{s}', ''))) // {len(s)}"


def _escaped_len(x: str) -> str:
    return f"len({x}) + " + " + ".join(_count(x, c) for c in (ESC, *CONTROLS))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')) v(a, b, c, d))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 23 + {_escaped_len('role')} END
           + {_escaped_len('text')}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
