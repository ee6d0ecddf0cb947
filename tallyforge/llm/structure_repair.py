r"""Conversation structure repair by Four-Russians block tables.

A conversation's role initials should read ``(s?(ua)+)?``.  Its rows are kept, given the role user or
assistant, or deleted, and empty turns are inserted, at least cost.  The cheapest edit is a shortest
path through four states (nothing written yet, after a system turn, after a user turn, after an
assistant turn), one step a row.  A row matters to it only through its symbol: must go, or initial and
whether it is truncated.  Costs of the four states relative to their minimum take few values, so

* all normalised cost vectors that can occur are numbered, and for every vector and every block of
  ``BLOCK`` symbols a table holds the vector after the block and the cost added (``Tables``);
* a conversation is processed a block a lookup, keeping one vector number per block;
* blocks are expanded backward: inside each, from its last row to its first, the set of states that lie on
  some cheapest path is kept (a mask of four bits a row), so no tie is decided early;
* a walk forward inside those masks takes the least letter (D, I, K, R) at each point, which gives the
  ASCII-least audit among all cheapest ones.

Defined results: a null role or text counts as one space, a null turn or conv_id as one space in the text
that is hashed for damage; rows sort by turn (nulls first), then role, then SHA-256 of the text, so equal rows are
neighbours; rows with a null conv_id are one conversation; an empty table gives no rows; other columns are
ignored.  Gaps beyond the range of a long are the largest long.

Shape: a light table (digests instead of texts) finds repeated rows by pre-aggregation and is shuffled once for the
audits; texts are shuffled once, after them.  Turns stream in order through a task, a conversation's symbols,
masks and audit take three bytes a row there; the audit is a value of one result row by its contract.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import crc32_sql, read_table, ship, written

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER_INSERT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ACCEPT = (START, ASSISTANT)
INITIALS = "sua"
MUST_GO, PAD, SYMBOLS = 0, 9, 10
FAR = 99          # no path, or one too dear to be part of a cheapest one
# From "after an assistant turn" every ending costs at most 4 more than from any other state (one deleted
# system turn, or one insertion), and it is reached from any state by at most two insertions: a state
# dearer than the least one by more than 10 lies on no cheapest path.
DEAREST = 10
BLOCK = 4


def symbol(initial: str, truncated: bool) -> int:
    """The symbol of a row that may stay."""
    at = INITIALS.find(initial) if initial else -1
    return 1 + 2 * (at if at >= 0 else 3) + int(truncated)


def moves(state: int, sym: int):
    """(letter, next state, cost) of the edits that consume a row, by letter."""
    if sym == PAD:
        return [("", state, 0)]
    out = [("D", state, DELETE)]
    if sym != MUST_GO:
        kind, extra = (sym - 1) // 2, TRUNCATED * ((sym - 1) % 2)
        if (kind, state) == (0, START):
            out.append(("K", SYSTEM, KEEP + extra))
        elif kind == 1 and state != USER:
            out.append(("K", USER, KEEP + extra))
        elif (kind, state) == (2, USER):
            out.append(("K", ASSISTANT, KEEP + extra))
        out.append(("R", AFTER_INSERT[state], REROLE + extra))
    return out


def _with_insertions(costs: list[int]) -> list[int]:
    out = list(costs)
    for _ in range(3):
        for q, to in AFTER_INSERT.items():
            out[to] = min(out[to], out[q] + INSERT)
    return out


def _normalised(costs: list[int]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(c - least if c - least <= DEAREST else FAR for c in costs), least


class Tables:
    """Vectors, their transitions by symbol and by block of symbols, and the masks of tied states."""

    def __init__(self):
        first, _ = _normalised(_with_insertions([0, FAR, FAR, FAR]))
        self.vectors, number, at = [first], {first: 0}, 0
        step, added = [], []
        while at < len(self.vectors):
            f = self.vectors[at]
            row, cost = [], []
            for sym in range(SYMBOLS):
                g = [FAR] * 4
                for q in range(4):
                    if f[q] < FAR:
                        for _, to, c in moves(q, sym):
                            g[to] = min(g[to], f[q] + c)
                v, least = _normalised(_with_insertions(g))
                if v not in number:
                    number[v] = len(self.vectors)
                    self.vectors.append(v)
                row.append(number[v])
                cost.append(least)
            step.append(row)
            added.append(cost)
            at += 1
        self.step, self.added = np.array(step, np.int16), np.array(added, np.int32)
        # compose symbols to blocks: [vector, code], the first symbol in the highest place
        to, cost = self.step, self.added
        for _ in range(BLOCK - 1):
            cost = (cost[:, :, None] + self.added[to]).reshape(len(self.vectors), -1)
            to = self.step[to].reshape(len(self.vectors), -1)
        self.block_to, self.block_cost = to, cost
        self.step_list, self.added_list = self.step.tolist(), self.added.tolist()
        self._before, self._walk = {}, {}

    def spread(self, vector: int, mask: int) -> int:
        """The states of a mask and those that reach one of them by insertions on a cheapest path."""
        f = self.vectors[vector]
        for _ in range(3):
            for q, to in AFTER_INSERT.items():
                if mask >> to & 1 and f[q] < FAR and f[q] + INSERT == f[to]:
                    mask |= 1 << q
        return mask

    def before(self, vector: int, sym: int, mask: int) -> int:
        """The mask before a row, from the mask after it."""
        key = (vector, sym, mask)
        if key not in self._before:
            f, g = self.vectors[vector], self.vectors[self.step_list[vector][sym]]
            add, out = self.added_list[vector][sym], 0
            for q in range(4):
                if f[q] < FAR and any(mask >> to & 1 and f[q] + c == g[to] + add for _, to, c in moves(q, sym)):
                    out |= 1 << q
            self._before[key] = self.spread(vector, out)
        return self._before[key]

    def walk(self, vector: int, sym: int, mask: int, after: int, state: int) -> tuple[str, int]:
        """The least letters from a state up to and with the one that consumes the row, and the next state."""
        key = (vector, sym, mask, after, state)
        if key not in self._walk:
            f, g = self.vectors[vector], self.vectors[self.step_list[vector][sym]]
            add, letters, q = self.added_list[vector][sym], "", state
            while True:
                ways = [(letter, to, True) for letter, to, c in moves(q, sym) if after >> to & 1 and f[q] + c == g[to] + add]
                into = AFTER_INSERT[q]
                if mask >> into & 1 and f[q] + INSERT == f[into]:
                    ways.append(("I", into, False))
                letter, q, consumed = min(ways)
                letters += letter
                if consumed:
                    break
            self._walk[key] = letters, q
        return self._walk[key]


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def audit(symbols) -> tuple[int, str]:
    """(cost, ASCII-least letters) of the cheapest edits of a conversation's symbols."""
    t = tables()
    n = len(symbols)
    padded = np.full(-(-n // BLOCK) * BLOCK, PAD, np.int64)
    padded[:n] = symbols
    codes = padded.reshape(-1, BLOCK) @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)
    vectors = np.empty(len(codes) + 1, np.int16)
    vector, cost = 0, 0
    vectors[0] = 0
    for i, code in enumerate(codes.tolist()):
        cost += int(t.block_cost[vector, code])
        vector = int(t.block_to[vector, code])
        vectors[i + 1] = vector
    f = t.vectors[vector]
    end = min(f[q] for q in ACCEPT)
    mask = t.spread(vector, sum(1 << q for q in ACCEPT if f[q] == end))
    masks = bytearray(len(padded) + 1)
    masks[-1] = mask
    for i in range(len(codes) - 1, -1, -1):
        syms = padded[i * BLOCK:(i + 1) * BLOCK].tolist()
        inner = [int(vectors[i])]
        for s in syms[:-1]:
            inner.append(t.step_list[inner[-1]][s])
        for j in range(BLOCK - 1, -1, -1):
            mask = t.before(inner[j], syms[j], mask)
            masks[i * BLOCK + j] = mask
    letters, state, vector = [], START, 0
    for i in range(n):
        s = int(padded[i])
        text, state = t.walk(vector, s, masks[i], masks[i + 1], state)
        letters.append(text)
        vector = t.step_list[vector][s]
    f, tail = t.vectors[vector], ""
    while not (state in ACCEPT and f[state] == end):
        state, tail = AFTER_INSERT[state], tail + "I"
    return cost + end, "".join(letters) + tail


# --- rows -----------------------------------------------------------------------------------------

def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, kept``: rows damaged by the hash of their place; dropped ones stay as rows
    that are not ``kept``, so their conversation is still known."""
    long, blank = lambda c: F.col(c).cast("long"), F.lit(" ")
    rows = turns.select(long("conv_id").alias("conv_id"), long("turn").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
                        F.coalesce(F.col("text").cast("string"), blank).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.withColumn("_h", F.crc32(name.cast("binary")) % 20)
    copies = F.when(F.col("_h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    text = F.when(F.col("_h") == 1, F.lit("")).when(F.col("_h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_h") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_h") != 0).alias("kept"),
                       F.explode(copies).alias("_copy")).drop("_copy")


def whole_rows(turns: DataFrame) -> DataFrame:
    """Any conversation table as ``conv_id, turn, role, text, kept`` (nulls: one space), nothing damaged."""
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.lit(True).alias("kept"))


def _digest():
    return F.unhex(F.sha2(F.col("text"), 256))


ORDER = ["turn", "role", "digest"]  # ascending: nulls first


def _light(rows: DataFrame) -> DataFrame:
    """Rows without their texts; ``later``: an earlier turn of the conversation has the same role and text."""
    body = F.expr(f"trim(BOTH '{SPACES}' FROM text)")
    light = written(rows.select("conv_id", "turn", "role", _digest().alias("digest"), "kept", (body == "").alias("blank"),
                                (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("open_end")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("b"))
    first = light.where("kept").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    l, f = light.alias("l"), first.alias("f")  # noqa: E741
    same = F.col("l.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("l.role") == F.col("f.role")) & (F.col("l.digest") == F.col("f.digest"))
    met = l.join(f, same, "left").select("l.*", "f.first")
    return met.withColumn("later", F.coalesce(place > F.col("first"), F.lit(False))).drop("first")


STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
LARGEST = 2**63 - 1


def conversation_audits(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation."""
    ship(rows.sparkSession)
    by_turn = _light(rows).repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)

    def run(batches):
        now, begun, done = None, False, []

        class Conversation:
            def __init__(self, conv):
                self.conv, self.symbols, self.counts = conv, bytearray(), [0, 0, 0, 0]
                self.low = self.high = self.initial = self.row = None
                self.turns = 0

            def add(self, turn, role, digest, blank, open_end, later):
                again = later or self.row == (turn, role, digest)
                if turn is not None:
                    if self.low is None:
                        self.low = turn
                    if self.high != turn:
                        self.turns += 1
                    self.high = turn
                initial = role[:1]
                if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
                    self.counts[3] += 1
                self.initial, self.row = initial, (turn, role, digest)
                if blank or again:
                    self.counts[0 if blank else 1] += 1
                    self.symbols.append(MUST_GO)
                else:
                    self.counts[2] += open_end
                    self.symbols.append(symbol(initial, open_end))

            def result(self):
                gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, LARGEST)
                cost, letters = audit(np.frombuffer(bytes(self.symbols), np.uint8))
                return (self.conv, gaps, *self.counts, cost, letters)

        def flush():
            cols = list(zip(*done))
            done.clear()
            kinds = [pa.int64()] * 7 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", *STATS, "audit"])

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "blank", "open_end", "later", "kept")]
            for conv, *fields, kept in zip(*cols):
                if not begun or conv != now.conv:
                    if begun:
                        done.append(now.result())
                    now, begun = Conversation(conv), True
                if kept:
                    now.add(*fields)
            if done:
                yield flush()
        if begun:
            done.append(now.result())
            yield flush()

    return by_turn.mapInArrow(run, "conv_id long, " + ", ".join(f"{s} long" for s in STATS) + ", audit string")


def _repaired_stream(rows: DataFrame) -> DataFrame:
    """Per conversation one row with its audit (position -1) and then its repaired turns, in order,
    inside one partition."""
    audits = written(conversation_audits(rows), "audits")
    lines = rows.where("kept").select("conv_id", "turn", "role", _digest().alias("digest"), "text", F.lit(1).alias("kind"))
    both = lines.unionByName(audits.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    stream = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    numbers = ", ".join(f"{s} long" for s in STATS)
    ship(rows.sparkSession)

    def run(batches):
        letters, at, last, position, conv = "", 0, "", 0, None
        names = ["conv_id", "position", "edit", "role", "text", *STATS, "audit"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * len(STATS), pa.string()]
        blanks = (None,) * (len(STATS) + 1)
        for b in batches:
            out = []

            def insert():
                nonlocal last, position
                role = "assistant" if last == "u" else "user"
                last = role[0]
                out.append((conv, position, "I", role, "", *blanks))
                position += 1

            def finish():
                nonlocal at
                while at < len(letters):
                    insert()
                    at += 1

            stats = list(zip(*[b.column(s).to_pylist() for s in STATS]))
            cols = [b.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "audit")]
            for i, (c, kind, role, text, edits) in enumerate(zip(*cols)):
                if kind == 0:
                    finish()
                    letters, at, last, position, conv = edits, 0, "", 0, c
                    out.append((c, -1, None, None, None, *stats[i], edits))
                    continue
                while letters[at] == "I":
                    insert()
                    at += 1
                edit = letters[at]
                at += 1
                if edit == "D":
                    continue
                if edit == "R":
                    role = "assistant" if last == "u" else "user"
                last = role[:1]
                out.append((c, position, edit, role, text, *blanks))
                position += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)
        out = []
        while at < len(letters):
            role = "assistant" if last == "u" else "user"
            last = role[0]
            out.append((conv, position, "I", role, "", *blanks))
            position, at = position + 1, at + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)

    return stream.mapInArrow(run, f"conv_id long, position long, edit string, role string, text string, {numbers}, audit string")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, position, edit, role, text``: the repaired turns of every conversation."""
    return _repaired_stream(whole_rows(turns)).where("position >= 0").select("conv_id", "position", "edit", "role", "text")


def repair_digests(rows: DataFrame) -> DataFrame:
    """One row per conversation: its statistics, audit and the hash of its repaired turns."""
    stream = _repaired_stream(rows)
    ship(rows.sparkSession)

    def run(batches):
        held, h, lines = None, None, 0

        def close():
            return (*held, h.hexdigest())

        names = ["conv_id", *STATS, "audit", "repaired_sha256"]
        kinds = [*[pa.int64()] * (1 + len(STATS)), pa.string(), pa.string()]
        for b in batches:
            done = []
            cols = [b.column(c).to_pylist() for c in ("position", "role", "text", "conv_id", *STATS, "audit")]
            for position, role, text, *own in zip(*cols):
                if position < 0:
                    if held is not None:
                        done.append(close())
                    held, h, lines = tuple(own), hashlib.sha256(), 0
                else:
                    h.update(("\n" if lines else "").encode() + f"{role}:{text}".encode())
                    lines += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done), kinds)], names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(close()), kinds)], names)

    return stream.mapInArrow(run, "conv_id long, " + ", ".join(f"{s} long" for s in STATS) + ", audit string, repaired_sha256 string")


def op11_structure_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged, repaired and digested."""
    return repair_digests(damaged(read_table(spark, sf_dir, "conversations")))



def _least(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x.c < 900000))[1]"


def _oracle() -> str:
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    far = "{'c': 900000, 'a': '', 't': ''}"

    def plus(q, cost, letter, text):
        return f"{{'c': {q}.c + {cost}, 'a': {q}.a || '{letter}', 't': {q}.t || {text}}}"

    def settled(name, src):
        """Insertions inside a layer: start and system states stay, user and assistant states take them."""
        user, assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"
        u1 = _least(f"{src}.fu", plus(f"{src}.f0", 3, "I", user), plus(f"{src}.fs", 3, "I", user), plus(f"{src}.fa", 3, "I", user))
        return f"""{name}1 AS (SELECT * EXCLUDE (fu), coalesce({u1}, {far}) AS fu FROM {src}),
  {name}2 AS (SELECT * EXCLUDE (fa), coalesce({_least('fa', plus('fu', 3, 'I', assistant))}, {far}) AS fa FROM {name}1),
  {name} AS (SELECT * EXCLUDE (fu), coalesce({_least('fu', plus('fa', 3, 'I', user))}, {far}) AS fu FROM {name}2)"""

    line, extra = "r.role || ':' || r.text || chr(10)", "CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END"
    may = "r.fault NOT IN ('blank', 'duplicate')"

    def kept(q, when):
        return f"CASE WHEN {may} AND {when} THEN {plus('d.' + q, extra, 'K', line)} ELSE {far} END"

    def rerole(q, role):
        text = f"'{role}:' || r.text || chr(10)"
        return f"CASE WHEN {may} THEN {plus('d.' + q, '3 + ' + extra, 'R', text)} ELSE {far} END"

    def gone(q):
        return plus("d." + q, 4, "D", "''")

    step = f"""SELECT d.conv_id, d.i + 1 AS i,
      coalesce({_least(gone('f0'))}, {far}) AS f0,
      coalesce({_least(gone('fs'), kept('f0', "r.initial = 's'"))}, {far}) AS fs,
      coalesce({_least(gone('fu'), *[kept(q, "r.initial = 'u'") for q in ('f0', 'fs', 'fa')], *[rerole(q, 'user') for q in ('f0', 'fs', 'fa')])}, {far}) AS fu,
      coalesce({_least(gone('fa'), kept('fu', "r.initial = 'a'"), rerole('fu', 'assistant'))}, {far}) AS fa
    FROM dp d JOIN faults r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i"""
    return f"""
WITH RECURSIVE h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' ') AS name FROM conversations),
hashed AS (SELECT h.*, {crc32_sql("name")} % 20 AS k FROM h),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(2) c(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
    substr(role, 1, 1) AS initial, trim(text, {ws}) AS body FROM rows_),
faults AS (
  SELECT *, CASE WHEN body = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
stats AS (
  SELECT conv_id, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, max(i) AS n FROM faults GROUP BY conv_id),
dp AS (
  SELECT conv_id, cast(1 AS bigint) AS i, {{'c': 0, 'a': '', 't': ''}} AS f0, {far} AS fs,
    {{'c': 3, 'a': 'I', 't': 'user:' || chr(10)}} AS fu, {{'c': 6, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS fa
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL (
  WITH took AS ({step}),
  {settled('laid', 'took')}
  SELECT conv_id, i, f0, fs, fu, fa FROM laid)),
ends AS (
  SELECT d.conv_id, {_least('d.f0', 'd.fa')} AS best FROM dp d LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM d.conv_id
  WHERE d.i = coalesce(s.n, 0) + 1)
SELECT e.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate,
  coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal, cast(e.best.c AS bigint) AS cost, e.best.a AS audit,
  sha256(CASE WHEN e.best.t = '' THEN '' ELSE substr(e.best.t, 1, len(e.best.t) - 1) END) AS repaired_sha256
FROM ends e LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLE = _oracle()
