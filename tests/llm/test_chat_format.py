import hashlib
import random

import pytest
from fixtures import collect, tables

from tallyforge.llm import chat_format as C

PIECES = [*C.CONTROLS, "\\", " ", "a", "[", "<", "/", "]", "s>", "INST", "", "é", "\n"]


def test_round_trip_of_hostile_texts():
    rng = random.Random(1)
    turns = []
    for _ in range(3000):
        role = rng.choice(["user", "assistant", "system", "", "[TEXT] \\"])
        turns.append((role, "".join(rng.choice(PIECES) for _ in range(rng.randrange(9)))))
    for t in turns:
        assert C.parse(C.render_turn(*t)) == [t]
    assert C.parse("".join(C.render_turn(*t) for t in turns)) == turns


def test_plain_text_stays_plain_and_conflicts_are_escaped():
    assert C.render_turn("user", "hello [x] <b>") == "[INST] hello [x] <b> [/INST]"
    assert C.render_turn("assistant", "</s>") == "<s> \\</s> </s>"


@pytest.mark.parametrize("bad", ["[INST] a", "x", "[INST] a <s> [/INST]", "[INST] a\\", "<s> a [/INST]"])
def test_the_parser_refuses_other_text(bad):
    with pytest.raises(C.ParseError):
        C.parse(bad)


def test_query_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "a\\b", C.PROBE, "long " * 3000, "ok"]))
            for c in (0, 1, 2, None) for t in rng.sample(range(50), 9)]
    got = collect(C.op1_chat_format(spark, tables(conversations=rows)))
    want = {}
    for c in (0, 1, 2, None, -1):
        turns = [(r or "", x or "") for _, _, r, x in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        if c == -1:
            turns = [("user", C.PROBE), ("assistant", C.PROBE)]
        loss = "".join(x for r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), sum(len(C.render_turn(*t)) for t in turns))
    found = {(None if r.conv_id != r.conv_id else int(r.conv_id)): (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars)
             for r in got.itertuples()}
    assert found == want


def test_repeated_rows_ties_and_empty_table(spark):
    rows = [(5, 0, "user", "b"), (5, 0, "user", "a"), (5, 0, "user", "a"), (5, None, "assistant", "z")]
    got = collect(C.op1_chat_format(spark, tables(conversations=rows))).set_index("conv_id")
    text = "assistant\nz\nuser\na\nuser\na\nuser\nb\n"
    assert got.loc[5].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert collect(C.op1_chat_format(spark, tables(conversations=[]))).conv_id.tolist() == [-1]
