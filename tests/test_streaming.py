"""Imports followed as a stream give what the table of all events gives."""

import datetime
import random

from weftline.streaming import imports

START = datetime.datetime(2024, 1, 1)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def test_transitions_of_a_table(spark):
    rows = [
        ("a", at(0), "STAGE", at(10)), ("a", at(5), "COMMIT", None), ("a", at(6), "CANCEL", None), ("b", at(0), "STAGE", at(10)), ("b", at(10), "COMMIT", None), ("c", at(3), "COMMIT", None), ("c", at(3), "STAGE", at(9)), ("d", at(1), "CANCEL", None),
        ("e", at(0), "STAGE", at(4)), ("e", at(0), "STAGE", at(4)), ("e", at(2), "STAGE", at(8)), ("f", None, "STAGE", at(4)), ("f", at(1), "OTHER", None),
    ]
    got = imports.history(spark.createDataFrame(rows, imports.EVENT)).collect()
    short = lambda name: [((r.at - START).seconds // 60, r.state, r.reason, r.error) for r in sorted((r for r in got if r["import"] == name), key=lambda r: (r.at, r.error is not None))]
    assert short("a") == [(0, "STAGED", None, None), (5, "COMMITTED", None, None), (6, "COMMITTED", None, "IMPORT_STATE")]
    assert short("b") == [(0, "STAGED", None, None), (10, "CANCELLED", "EXPIRED", None), (10, "CANCELLED", None, "IMPORT_STATE")]
    assert short("c") == [(3, "STAGED", None, None), (3, "COMMITTED", None, None)] or short("c") == [(3, "COMMITTED", None, None), (3, "STAGED", None, None)]
    assert short("d") == [(1, None, None, "NOT_FOUND")] and short("e") == [(0, "STAGED", None, None), (2, "STAGED", None, "IMPORT_STATE"), (4, "CANCELLED", "EXPIRED", None)] and short("f") == []
    assert {r["import"]: (r.state, r.reason) for r in imports.standing(imports.history(spark.createDataFrame(rows, imports.EVENT))).collect()} == {"a": ("COMMITTED", None), "b": ("CANCELLED", "EXPIRED"), "c": ("COMMITTED", None), "e": ("CANCELLED", "EXPIRED")}


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    """Replayed in several batches, rows late by up to the watermark's delay, repeats of a row in another batch."""
    r = random.Random(4)
    rows = []
    for i in range(60):
        t = r.randrange(200)
        rows += [(f"i{i}", at(t), "STAGE", at(t + r.choice([5, 30, 100])))]
        rows += [(f"i{i}", at(t + r.randrange(60)), r.choice(["COMMIT", "CANCEL"]), None) for _ in range(r.choice([0, 1, 1, 2]))]
    rows.sort(key=lambda x: x[1])
    batches = [[] for _ in range(5)]
    for n, row in enumerate(rows):
        batches[min(4, n * 5 // len(rows) + (r.random() < 0.2))].append(row)  # some come a batch late
    batches[2].append(rows[n // 5])
    batches.append([("end", at(10_000), "STAGE", at(10_001))])
    batches.append([("end", at(10_000), "CANCEL", None)])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, imports.EVENT).coalesce(1).write.mode("append").parquet(source)
        stream = imports.follow(spark.readStream.schema(imports.EVENT).parquet(source), "100 minutes")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    show = lambda df: sorted((x["import"], x.at, x.state or "", x.reason or "", x.error or "") for x in df.collect() if x["import"] != "end")
    want = show(imports.history(spark.createDataFrame(rows, imports.EVENT)))
    assert show(spark.read.parquet(out)) == want and len(want) > 100
