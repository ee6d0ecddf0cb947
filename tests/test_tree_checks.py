"""FIXTURES variants: duplicate child, isolated node, cycle and unknown leaf (H1-H4), frontier
and subtree switches (H8, H9)."""

from tallyforge.operators import hierarchy as H


def _kinds(spark, names):
    return spark.createDataFrame([(n, True) for n in names], "name string, created boolean")


def test_broken_tree_reports(spark):
    tree = {
        "All": ["Living", "Salary", "Coffee"],
        "Living": ["Coffee", "Groceries"],       # Coffee twice -> duplicate child
        "Orphan": ["Misc"],                       # nobody's child -> isolated
        "Loop1": ["Loop2"], "Loop2": ["Loop1"],   # cycle away from the root
    }
    e = H.edges_from_dict(spark, tree)
    assert {r["child"] for r in H.duplicate_children(e).collect()} == {"Coffee"}
    assert {r["node"] for r in H.isolated_nodes(e, "All").collect()} == {"Orphan"}
    assert {r["node"] for r in H.cycle_nodes(e, "All").collect()} == {"Loop1", "Loop2"}
    bad = {r["name"] for r in H.invalid_leaves(e, _kinds(spark, ["Coffee", "Groceries"]), "All").collect()}
    assert bad == {"Salary"}


def test_root_that_is_a_child_is_a_cycle(spark):
    e = H.edges_from_dict(spark, {"All": ["A"], "A": ["All"]})
    assert "All" in {r["node"] for r in H.cycle_nodes(e, "All").collect()}


def test_frontier_and_switches(spark):
    e = H.edges_from_dict(spark, {"All": ["Living", "Salary"], "Living": ["Coffee", "Groceries"]})
    closed = spark.createDataFrame([], "node string")
    assert {r["node"] for r in H.frontier(e, "All", closed).collect()} == {"Living", "Salary"}
    opened = spark.createDataFrame([("Living",)], "node string")
    assert {r["node"] for r in H.frontier(e, "All", opened).collect()} == {"Coffee", "Groceries", "Salary"}
    sw = spark.createDataFrame([(1, "Living", False), (2, "Coffee", True)], "switch_no long, node string, active boolean")
    state = {r["node"]: r["active"] for r in H.selection(e, sw).collect()}
    assert state["Groceries"] is False and state["Coffee"] is True and state["Salary"] is True
    groups = {r["grp"] for r in H.selected_groups(e, "All", opened, sw).collect()}
    assert groups == {"Coffee", "Salary"}


def test_deep_tree_closure_is_whole(spark):
    """200 levels: every pair of the chain, at its depth."""
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 0) for i in range(200)], "parent string, child string, ord long")
    c = H.closure(e, spark.createDataFrame([("n0",)], "node string"))
    assert sorted((r["node"], r["depth"]) for r in c.collect()) == sorted((f"n{i}", i) for i in range(201))
    assert H.closure(e).count() == 201 * 202 // 2
    ring = e.unionByName(spark.createDataFrame([("n200", "n100", 0)], "parent string, child string, ord long"))
    loop = ring.where("try_cast(substr(parent, 2) as int) >= 100")
    assert H.cycle_nodes(loop, "All").count() == 101
