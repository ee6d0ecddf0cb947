"""Nodes on cycles against plain reachability."""

import random

import pytest

from tallyforge.operators.cycles import nodes_on_cycles, single_parent_pointers


def plain(edges):
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    out = set()
    for start in ahead:
        seen, todo = set(), list(ahead[start])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += ahead.get(n, ())
        if start in seen:
            out.add(start)
    return out


def _found(spark, edges):
    rows = nodes_on_cycles(spark.createDataFrame(edges, "parent string, child string")).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"] for r in rows}


RING = [(f"r{i}", f"r{(i + 1) % 300}") for i in range(300)] + [(f"r{i}", f"t{i}") for i in range(300)] + [("t5", "u"), ("u", "v")]
TANGLE = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("x", "b"), ("d", "e"), ("e", "f"), ("c", "f"), ("f", "g"), ("s", "s"), ("q", "s")]


@pytest.mark.parametrize("edges", [RING, TANGLE, [("a", "b"), ("b", "c")], [("a", "a")]], ids=["ring", "tangle", "path", "loop"])
def test_shapes(spark, edges):
    assert _found(spark, edges) == plain(edges)


def test_random_graphs(spark):
    rng = random.Random(8)
    edges = []
    for g in range(12):  # several graphs of different density at once
        n = 12
        edges += [(f"{g}_{rng.randrange(n)}", f"{g}_{rng.randrange(n)}") for _ in range(4 + 2 * g)]
    assert _found(spark, edges + edges[:5]) == plain(edges)


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    from tallyforge.operators import cycles
    rounds = []
    real = cycles.materialize
    monkeypatch.setattr(cycles, "materialize", lambda df, name: rounds.append(name) or real(df, name))
    df = spark.range(0, 1000).selectExpr("cast(id as string) a", "cast(id + 1 as string) b")
    out = single_parent_pointers(df).collect()
    assert len(out) == 1000 and {r["to"] for r in out} == {"0"} and len(rounds) <= 12
