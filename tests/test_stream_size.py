"""What streams do per batch must not grow with rows or events known."""

from __future__ import annotations

import random

import pandas as pd

from tidemark.streaming import current


class Stored:
    """A state variable in memory that counts its calls."""

    def __init__(self):
        self.values, self.calls = {}, 0

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)

    def getValue(self, key):
        self.calls += 1
        return self.values.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.values[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.values.pop(key, None)


class Handle:
    def __init__(self):
        self.made = []

    def getValueState(self, *_):
        self.made.append(Stored())
        return self.made[-1]

    getMapState = getValueState


def brute_force(batches):
    """Sums by type and day of the latest row of each event."""
    latest = {}
    for rows in batches:
        for kind, day, event, _, *row in rows:
            name = (kind, day, event)
            latest[name] = max(latest.get(name, tuple(row)), tuple(row))
    sums = {}
    for (kind, day, _), row in latest.items():
        count, amount = sums.get((kind, day), (0, 0.0))
        sums[kind, day] = (count + 1, amount + row[3])
    return sums


def test_calls_to_the_state_are_by_chunk(monkeypatch):
    monkeypatch.setattr(current, "HELD", 3_000)
    draw = random.Random(4)
    columns = ["event_type", "dt", "event_id", "place", "landed", "batch", "tie", "amount"]
    handle, processor = Handle(), current.CurrentRows()
    processor.init(handle)
    batches, changes = [], []
    for batch, count in enumerate((10, 8_000, 30, 9_000)):
        rows = []
        for _ in range(count):
            event = draw.randrange(20_000)
            place = random.Random(event).getrandbits(56)
            rows.append((("a", "b")[event % 2], f"d{event % 3}", f"e{event}", place, draw.randrange(9), batch, draw.randrange(99), float(event % 7 + batch)))
        frames = [pd.DataFrame(rows[at : at + 2_500], columns=columns) for at in range(0, count, 2_500)]
        before = sum(s.calls for s in handle.made)
        changes += [processor.handleInputRows((0,), iter(frames), None)]
        changes[-1] = pd.concat(changes[-1])
        batches.append(rows)
        if count > 1_000:
            assert sum(s.calls for s in handle.made) - before < count / 4
    found = pd.concat(changes).groupby(["event_type", "dt"]).sum()
    want = brute_force(batches)
    assert {k: (r["events"], r["added"] - r["retracted"]) for k, r in found.iterrows()} == want
    assert found["fresh"].sum() == found["events"].sum() == handle.made[0].values[()][1]
    assert found["overwritten"].sum() > 0 and found["unchanged"].sum() > 0
    assert max(len(value[0]) for value in handle.made[1].values.values()) < 60 * 2 * current.CHUNK


def test_repeated_batch_is_not_parsed(spark, tmp_root, event, monkeypatch):
    from tidemark.streaming import jobs, records

    def deliver(checkpoint):
        stream = jobs.record_stream(spark, f"{tmp_root}/source")
        jobs.silver_stream(stream, tmp_root, f"{tmp_root}/check/{checkpoint}", "2026-01-20T00:00:00Z").awaitTermination()

    rows = [event(event_id=f"e{i}", event_ts=None) for i in range(3)]
    events = spark.createDataFrame(rows, ", ".join(f"{k} {'DOUBLE' if k == 'amount_usd' else 'BIGINT' if k == 'quantity' else 'TIMESTAMP' if k == 'event_ts' else 'STRING'}" for k in rows[0]))
    events = events.selectExpr(*[c for c in events.columns if c != "event_ts"], "TIMESTAMP '2026-01-02 12:00:00Z' AS event_ts")
    records.publish(events, f"{tmp_root}/source")
    deliver("first")
    parsed = []
    real = jobs.C.cleanse
    monkeypatch.setattr(jobs.C, "cleanse", lambda *a, **k: parsed.append(1) or real(*a, **k))
    deliver("again")
    assert not parsed and jobs.current_silver(spark, tmp_root).count() == 3


def test_drain_takes_files_for_all_cores(spark, tmp_root):
    import os

    from tidemark.streaming import jobs

    os.makedirs(f"{tmp_root}/queue")
    for part in range(25):
        with open(f"{tmp_root}/queue/{part}.txt", "w") as out:
            out.write("not json\n" * 12)
    jobs.drain_messages(jobs.message_stream(spark, f"{tmp_root}/queue"), f"{tmp_root}/refs", f"{tmp_root}/dlq", f"{tmp_root}/check").awaitTermination()
    units = spark.read.parquet(f"{tmp_root}/refs-invocations").collect()
    assert {int(r["batch"]) for r in units} == {0}
    assert sorted((r["invocation"], r["messages"], r["failed"]) for r in units) == [(0, 10, 10)] * 25 + [(1, 2, 2)] * 25
