"""Graph operators on traces beyond the sizes of the small tables."""

import pytest
from weftline.operators import graph
from weftline.queries import QUERIES


def test_ancestors_of_a_conversation_deeper_than_256(spark, tmp_path):
    n = 300
    spark.createDataFrame([(1, t, "user", "x") for t in range(n)] + [(2, 0, "user", "y")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["lineage_ancestors"](spark, str(tmp_path)).select("start", "node", "depth").collect()
    want = {(f"1-{a}", f"1-{b}", a - b) for a in range(n) for b in range(a + 1)} | {("2-0", "2-0", 0)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("limit", [None, 2])
def test_ancestors_of_large_traces_and_in_shares(spark, monkeypatch, limit):
    pairs = [("a", str(i), str(i + 1)) for i in range(5)] + [("a", "0", "3")] + [("b", "0", "1"), ("b", "1", "0")]
    edges = spark.createDataFrame(pairs, "trace string, parent string, child string")
    starts = spark.createDataFrame([("a", str(i)) for i in range(6)] + [("b", "1"), ("c", "0")], "trace string, node string")
    whole = sorted(map(repr, graph.ancestors(edges, starts, limit).collect()))
    assert any("trace='c'" in r for r in whole) and ("node=None" in "".join(whole)) == (limit == 2)
    monkeypatch.setattr(graph, "PAIRS", 5)
    monkeypatch.setattr(graph, "MAX_EDGES", 4)  # trace a by levels, b and c in shares
    assert sorted(map(repr, graph.ancestors(edges, starts, limit).collect())) == whole


def test_cycle_sets_of_large_traces(spark):
    """By colours over tables as by a task: rings in rings, loops, tails, several traces."""
    import random

    r = random.Random(7)
    pairs = [("ring", f"r{i}", f"r{(i + 1) % 9}") for i in range(9)] + [("ring", "r3", "s0"), ("ring", "s0", "s1"), ("ring", "s1", "s0"), ("ring", "s1", "tail"), ("ring", "loop", "loop"), ("ring", "r0", "loop")]
    pairs += [(f"t{t}", f"n{r.randrange(14)}", f"n{r.randrange(14)}") for t in range(6) for _ in range(18)]
    edges = spark.createDataFrame(pairs, "trace string, parent string, child string")
    want = sorted((t, m) for t in {p[0] for p in pairs} for m in graph.strong_components([(a, b) for x, a, b in pairs if x == t]))
    assert sorted((x.trace, x.members) for x in graph.coloured_cycles(edges).collect()) == want and len(want) > 5


def test_cycles_of_traces_beyond_a_task(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_EDGES", 3)
    edges = spark.createDataFrame([("a", str(i), str((i + 1) % 5)) for i in range(5)] + [("b", "x", "y"), ("b", "y", "x")], "trace string, parent string, child string")
    assert sorted((x.trace, x.members) for x in graph.cycles(edges).collect()) == [("a", list("01234")), ("b", ["x", "y"])]
