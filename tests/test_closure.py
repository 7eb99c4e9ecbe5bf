"""Walks of several hops a round."""

from gridloom.operators import graphs


def test_closure_is_reachable_without_chains(spark):
    pairs = [("a", f"n{k}", f"n{k + 1}") for k in range(11)] + [("a", "n5", "n2"), ("a", "n3", "n3"), ("b", "n9", "n0"), ("b", "x", "y"), ("a", "q", "n0")]
    edges = spark.createDataFrame(pairs, "repo_id string, src string, dst string")
    seeds = spark.createDataFrame([("a", "n1"), ("b", "n9"), ("b", "lone")], "repo_id string, node string")
    stop = spark.createDataFrame([("a", "n7")], "repo_id string, node string")
    for terminal in (None, stop):
        want = {(r["repo_id"], r["node"]) for r in graphs.reachable(edges, seeds, terminal).collect()}
        got = [tuple(r) for r in graphs.closure(edges, seeds, terminal).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_walk_goes_several_hops_a_round(spark, monkeypatch):
    edges = spark.createDataFrame([("a", f"n{k:02}", f"n{k + 1:02}") for k in range(16)], "repo_id string, src string, dst string")
    roots = spark.createDataFrame([("a", "n00", True, "product", "runtime verified", "shared"), ("a", "n06", True, "product", "static candidate", "owned")], "repo_id string, path string, exists boolean, scope string, confidence string, ownership string")
    writes, keep = [], graphs.staged
    monkeypatch.setattr(graphs, "staged", lambda df: writes.append(1) or keep(df))
    rows = {r["node"]: (r["product_depth"], r["owned_depth"]) for r in graphs.two_walks(edges, roots).collect()}
    assert rows == {f"n{k:02}": (k, k - 6 if k >= 6 else None) for k in range(17)}
    assert len(writes) < 12
