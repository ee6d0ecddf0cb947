"""Interval labels against a walk of the tree, and what is asked of labelled trees against plain recursion."""

import random

import pytest

from tallyforge.operators import hierarchy as H
from tallyforge.operators import intervals as I

EDGES = "parent string, child string, ord long"


def _walk(children, roots):
    """Labels by a plain depth-first walk."""
    out, clock = {}, 0

    def visit(v, parent, depth):
        nonlocal clock
        enter, clock, height = clock, clock + 1, 0
        for _, c in sorted(children.get(v, [])):
            height = max(height, visit(c, v, depth + 1) + 1)
        out[v] = (parent, depth, clock - enter, height, enter, clock)
        return height

    for r in sorted(roots):
        visit(r, None, 0)
    return out


@pytest.fixture(scope="module")
def tree(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(150)]
    rows = [(names[rng.randrange(max(0, i - 9), i)], names[i], rng.randrange(4)) for i in range(1, 150) if i % 50]
    rows += [(names[3], f"leaf{i}", 0) for i in range(60)]  # a hot parent with equal places
    children = {}
    for p, c, o in rows:
        children.setdefault(p, []).append((o, c))
    walk = _walk(children, {p for p, _, _ in rows} - {c for _, c, _ in rows})
    return spark.createDataFrame(rows, EDGES), walk


def _up(walk, v):
    while v is not None:
        yield v
        v = walk[v][0]


def test_labels_equal_a_walk(tree):
    edges, walk = tree
    got = {r["node"]: tuple(r)[1:] for r in I.label(edges).collect()}
    assert got == walk
    assert {r["node"]: r["height"] for r in H.heights(edges).collect()} == {v: x[3] for v, x in walk.items()}


def test_frontier_selection_sums_and_covering(spark, tree):
    edges, walk = tree
    labels = I.label(edges)
    rng = random.Random(4)
    opened = set(rng.sample(sorted(walk), 70)) | {"n1", "n2", "n3", "n4", "n5"}
    got = {r["node"] for r in I.frontier(labels, "n0", spark.createDataFrame([(v,) for v in opened], "node string")).collect()}
    want = {v for v in walk if "n0" in list(_up(walk, v))[1:] and all(a in opened or a == "n0" for a in list(_up(walk, v))[1:] if walk[a][4] > walk["n0"][4])
            and (v not in opened or walk[v][3] == 0)}
    assert got == want and len(want) > 3
    assert I.frontier(labels, "nowhere", spark.createDataFrame([], "node string")).count() == 0

    switches = [(k, rng.choice(sorted(walk)), rng.random() < 0.5) for k in range(40)]
    state = {r["node"]: r["active"] for r in I.selection(labels, spark.createDataFrame(switches, "switch_no long, node string, active boolean")).collect()}
    for v in walk:
        above = [(k, on) for k, n, on in switches if n in set(_up(walk, v))]
        assert state[v] == (max(above)[1] if above else True)

    held = [(rng.choice(sorted(walk)), rng.randrange(-50, 50), 1) for _ in range(300)] + [("elsewhere", 9, 1), ("n5", None, 1)]
    sums = {r["node"]: (r["v"], r["n"]) for r in I.subtree_sums(labels, spark.createDataFrame(held, "node string, v long, n long"), ["v", "n"]).collect()}
    for v in walk:
        mine = [x for x in held if x[0] in walk and v in set(_up(walk, x[0]))]
        assert sums[v] == (sum(x[1] or 0 for x in mine), len(mine))

    cover = sorted((r["grp"], r["leaf"]) for r in I.covering(labels, spark.createDataFrame([(v,) for v in want], "grp string")).collect())
    assert cover == sorted((g, v) for v in walk if walk[v][3] == 0 for g in set(_up(walk, v)) & want)


def test_broken_trees_are_refused_and_empty_ones_are_empty(spark):
    for rows in ([("a", "c", 0), ("b", "c", 0)], [("a", "b", 0), ("b", "a", 0)], [("a", "a", 0)], [("r", "s", 0), ("x", "y", 0), ("y", "z", 0), ("z", "x", 0)]):
        with pytest.raises(ValueError):
            I.label(spark.createDataFrame(rows, EDGES))
    assert I.label(spark.createDataFrame([], EDGES)).count() == 0


def test_lines_are_contracted_before_the_doubling(spark, monkeypatch):
    # a long line, one that forks, and one that forks at its root
    line = [(f"a{i}", f"a{i + 1}", 5) for i in range(70)]
    line += [(f"b{i}", f"b{i + 1}", 1) for i in range(9)] + [("b4", "c0", 0), ("c0", "c1", 0), ("b4", "d", 1), ("r", "s", 2), ("r", "q", 2), ("q", "p", 0)]
    children = {}
    for p, c, o in line:
        children.setdefault(p, []).append((o, c))
    walk = _walk(children, {p for p, _, _ in line} - {c for _, c, _ in line})
    seen, below = [], I._below
    monkeypatch.setattr(I, "_below", lambda lines, rounds: seen.append(lines.count()) or below(lines, rounds))
    # keys that names share are noticed and replaced
    key = I._key
    monkeypatch.setattr(I, "_key", lambda name, seed: key(name, seed) if seed else key(name, 0) % 50)
    got = {r["node"]: tuple(r)[1:] for r in I.label(spark.createDataFrame(line, EDGES)).collect()}
    assert got == walk
    assert seen == [8]  # a; b to b4, the rest of b, c, d; r, s, q


def test_nodes_without_a_name_and_long_rings_are_refused(spark):
    for rows in ([("a", "b", 0), (None, "c", 0)], [("a", None, 0)], [("a", "b", 0), ("a", "b", 0)], [("a", f"x{i}", 0) for i in range(3)] + [("x1", "a", 0)]):
        with pytest.raises(ValueError):
            I.label(spark.createDataFrame(rows, EDGES))
