"""States of imports from a stream of what is asked of them: staged, committed, cancelled, or over when their time is.

Events are (import, at, kind, expires): a timestamp, STAGE (with the timestamp at which it is over), COMMIT or CANCEL. The
same transitions come from a table of events (``history``) and from a stream (``follow``), which keeps an import's events
until the watermark has passed them, so that what comes late, within the watermark's delay, still stands in its place.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of events of one moment (an import is staged before it is asked for).
TURN = {"STAGE": 0, "COMMIT": 1, "CANCEL": 2}
OUT = "import string, at timestamp, state string, reason string, error string"
EVENT = "import string, at timestamp, kind string, expires timestamp"


def advance(state: list | None, events: list[tuple], until: int | None) -> tuple[list | None, list[tuple]]:
    """The state (name, time it is over) after events (at, kind, expires) in order, and the transitions (at, state, reason, error).

    Times are milliseconds. ``until`` is the time reached; None: all time. A staged import is over at its time, before what is
    asked at that moment or after it: a commit then is IMPORT_STATE. What is asked of an import that isn't staged is
    IMPORT_STATE, of one that is unknown NOT_FOUND; staging one again is IMPORT_STATE too. Errors change nothing.
    """
    out = []

    def expire(now: int | None) -> None:
        nonlocal state
        if state and state[0] == "STAGED" and (now is None or state[1] <= now):
            out.append((state[1], "CANCELLED", "EXPIRED", None))
            state = ["CANCELLED", None]

    for at, kind, expires in sorted(events, key=lambda e: (e[0], TURN[e[1]], e[2] or 0)):
        expire(at)
        if kind == "STAGE":
            if state is None:
                state = ["STAGED", expires]
                out.append((at, "STAGED", None, None))
            else:
                out.append((at, state[0], None, "IMPORT_STATE"))
        elif state is None:
            out.append((at, None, None, "NOT_FOUND"))
        elif state[0] != "STAGED":
            out.append((at, state[0], None, "IMPORT_STATE"))
        else:
            state = ["COMMITTED" if kind == "COMMIT" else "CANCELLED", None]
            out.append((at, state[0], "USER" if kind == "CANCEL" else None, None))
    expire(until)
    return state, out


def _events(pdf: pd.DataFrame) -> list[tuple]:
    """Rows as tuples in milliseconds; repeated ones once, others than the three kinds and those without a time not at all."""
    ms = lambda t: None if pd.isna(t) else int(t.value // 1_000_000)
    return list({(ms(a), k, ms(e) if k == "STAGE" else None) for a, k, e in zip(pdf["at"], pdf["kind"], pdf["expires"]) if k in TURN and not pd.isna(a)})


def _rows(key: str, found: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame([(key, pd.Timestamp(at, unit="ms"), *rest) for at, *rest in found], columns=["import", "at", "state", "reason", "error"])
    return frame.astype({"import": object, "at": "datetime64[ns]", "state": object, "reason": object, "error": object})


def history(events: DataFrame) -> DataFrame:
    """Transitions (import, at, state, reason, error) of a table of events, to the end of all time.

    Imports are dealt to tasks and stream through them in order, so a task runs many at little cost and keeps one's events.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out = []
            for name, *event in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if name != now:
                    out += [(now, *t) for t in advance(None, held, None)[1]]
                    now, held = name, []
                if not held or tuple(event) != held[-1]:
                    held.append(tuple(event))
            yield _batch(out)
        yield _batch([(now, *t) for t in advance(None, held, None)[1]])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["import", "at", "state", "reason", "error"])

    known = events.where(F.col("at").isNotNull() & F.col("kind").isin(*TURN))
    timed = known.select("import", F.unix_millis("at").alias("at"), "kind", F.when(F.col("kind") == "STAGE", F.unix_millis("expires")).alias("expires"))
    made = timed.repartition("import").sortWithinPartitions("import", "at", "kind", "expires").mapInArrow(run, OUT.replace("at timestamp", "at long"))
    return made.withColumn("at", F.timestamp_millis("at"))


def follow(events: DataFrame, delay: str) -> DataFrame:
    """Transitions as a stream, each when the watermark (``delay`` behind the latest event) has passed it.

    Staged imports are over by a timer, without an event of their own. Rows later than the watermark are dropped, as
    Spark's event time has it. State holds an import's name, its time and events not passed yet; of an import that has ended
    the name stays, so that it can't be staged again.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        state, waiting = json.loads(kept.get[0]) if kept.exists else (None, [])
        waiting = [tuple(e) for e in waiting]
        for pdf in parts:
            waiting += _events(pdf)
        waiting = list(dict.fromkeys(waiting))
        now = kept.getCurrentWatermarkMs()
        state, found = advance(state, [e for e in waiting if e[0] <= now], now)
        waiting = [e for e in waiting if e[0] > now]
        kept.update((json.dumps([state, waiting]),))
        due = [e[0] for e in waiting] + ([state[1]] if state and state[0] == "STAGED" else [])
        if due:
            kept.setTimeoutTimestamp(max(min(due), now + 1))
        if found:
            yield _rows(key[0], found)

    timed = events.withWatermark("at", delay).select("import", "at", "kind", "expires")
    return timed.groupBy("import").applyInPandasWithState(run, OUT, "kept string", "append", "EventTimeTimeout")


def standing(transitions: DataFrame) -> DataFrame:
    """(import, state, reason): where each import is after its transitions."""
    real = transitions.where("error is null")
    return real.groupBy("import").agg(F.max_by(F.struct("state", "reason"), F.struct("at", (F.col("state") != "STAGED").alias("later"))).alias("s")).select("import", "s.state", "s.reason")
