"""Stores compared by digests of ranges: what differs is found, and nothing else is read."""

import random
import re

from weftline.plans import stores

KIND = "trace string, revision long, graph string"


def written(spark, tmp_path, name, rows):
    stores.write_store(spark.createDataFrame(rows, KIND).repartition(3), ["trace", "revision"], str(tmp_path / name))
    return str(tmp_path / name)


def test_differences_of_two_stores(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"t{i % 40}" if i % 50 else None, i, r.choice(["g", "h", None])) for i in range(600)]
    other = [x for x in rows if x[1] != 77]
    other[5] = (*rows[5][:2], "changed")
    other[100] = (*rows[101][:2], None if rows[101][2] else "set")
    other.append((None, None, "new"))
    a, b, same, none = (written(spark, tmp_path, n, x) for n, x in (("a", rows), ("b", other), ("same", rows[::-1]), ("none", [])))
    keys = ["trace", "revision"]
    got = stores.compare(spark, a, b, keys)
    assert {tuple(x) for x in got.collect()} == {(*rows[77][:2], "MISSING"), (*rows[5][:2], "DIFFERS"), (*rows[101][:2], "DIFFERS"), (None, None, "UNEXPECTED")}
    ranges = stores.differing_ranges(spark, a, b)
    assert 1 <= len(ranges) <= 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") == len(re.findall(r"PartitionFilters: \[[^\]]*range#", plan)) >= 2
    assert stores.differing_ranges(spark, a, same) == [] and stores.compare(spark, a, same, keys).count() == 0
    assert stores.compare(spark, none, a, keys).count() == 600
