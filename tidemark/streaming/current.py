"""Which row of an event counts, kept as keyed state, and what a new row changes.

Silver rows arrive as they are stored, late, repeated and overwritten ones among them.
State holds, for every event of a type and day, the order and amount of its latest row,
many events in one value.
A row that is newer changes the sums of its type and day: its amount is added and, if the
event was known, the amount it replaces is taken back. A row that is older or was seen
before changes nothing. The changes of a batch are partial sums per type and day; sums of
partial sums are the metrics, so no batch reads rows of an earlier one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Groups of events; state is kept, and can be shared out, by these.
BUCKETS = 256
#: Events in a value of the state, on average at most.
CHUNK = 256
#: Events of a bucket that a task holds before it stores them.
HELD = 200_000

CHANGES = (
    "event_type STRING, dt STRING, events BIGINT, added DOUBLE, retracted DOUBLE, "
    "fresh BIGINT, overwritten BIGINT, unchanged BIGINT"
)

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


class CurrentRows(StatefulProcessor):
    """The latest row of each event in a bucket.

    A bucket's events lie in chunks, one value of the state each, by further bits of their
    hash. A batch reads and writes the chunks of its rows, so calls to the state are by
    chunk and not by row. Chunks are dealt out anew, in powers of two, when they hold more
    than CHUNK events on average, so what a row moves does not grow with the events known.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._size = handle.getValueState("size", "chunks BIGINT, events BIGINT")
        self._stored = handle.getMapState("chunks", "chunk BIGINT", "events BINARY")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changes: dict[tuple, list] = {}
        size = self._size.get()
        self._chunks, events = (1, 0) if size is None else size
        self._held: dict[int, dict] = {}
        self._known, held = events, 0
        for frame in rows:
            # Rows of a chunk side by side, so that it is read once a frame however much is held.
            frame = frame.iloc[(frame["place"] & (self._chunks - 1)).argsort()]
            names = ("event_type", "dt", "event_id", "place", "landed", "batch", "tie", "amount")
            for kind, day, event, place, *row in zip(*(frame[c].tolist() for c in names), strict=True):
                change = changes.setdefault((kind, day), [0, 0.0, 0.0, 0, 0, 0])
                name, row = (kind, day, event), (place, *row)
                number = place & (self._chunks - 1)
                chunk = self._held.get(number)
                if chunk is None:
                    chunk = self._held[number] = self._read(number)
                    held += len(chunk)
                known = chunk.get(name)
                if known is not None and known >= row:
                    change[5] += 1
                    continue
                chunk[name] = row
                change[1] += row[4]
                if known is None:
                    change[0] += 1
                    change[3] += 1
                    events += 1
                    held += 1
                else:
                    change[2] += known[4]
                    change[4] += 1
                if held > HELD:
                    self._write(events)
                    held = 0
        self._write(events)
        self._size.update((self._chunks, events))
        rows = [(*name, *change) for name, change in changes.items()]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def _read(self, number: int) -> dict:
        stored = self._stored.getValue((number,)) if self._known else None
        return {} if stored is None else pickle.loads(stored[0])

    def _write(self, events: int) -> None:
        """Store the chunks held; with too many events for their number, deal all out among more."""
        chunks = self._chunks
        while events > chunks * CHUNK:
            chunks *= 2
        for number in range(self._chunks) if chunks > self._chunks else list(self._held):
            held = self._held.pop(number, None)
            parts = {number: self._read(number) if held is None else held}
            if chunks > self._chunks:
                whole, parts = parts[number], {n: {} for n in range(number, chunks, self._chunks)}
                for name, row in whole.items():
                    parts[row[0] & (chunks - 1)][name] = row
            for at, part in parts.items():
                if part:
                    self._stored.updateValue((at,), (pickle.dumps(part, protocol=5),))
                elif at == number and self._known:
                    self._stored.removeKey((at,))
        self._chunks, self._known = chunks, events

    def close(self) -> None:
        pass


def changes(silver: DataFrame) -> DataFrame:
    """Partial sums that a stream of stored Silver rows adds to the metrics.

    Rows of one event are ordered by landed_at, then batch, then a hash of their content,
    as in the last write of a batch query. The stored batches hold an event once, so a hot
    event arrives as one row a batch.
    """
    content = [c for c in silver.columns if c not in ("event_type", "dt", "event_id")]
    place = F.xxhash64("event_type", "dt", "event_id")
    rows = silver.select(
        "event_type",
        "dt",
        "event_id",
        F.shiftrightunsigned(place, 8).alias("place"),
        F.coalesce(F.unix_micros("landed_at"), F.lit(-(2**62))).alias("landed"),
        F.coalesce("batch", F.lit(-1)).cast("bigint").alias("batch"),
        F.xxhash64(*content).alias("tie"),
        F.coalesce("amount_usd", F.lit(0.0)).alias("amount"),
        F.pmod(place, F.lit(BUCKETS)).alias("bucket"),
    )
    return rows.groupBy("bucket").transformWithStateInPandas(CurrentRows(), CHANGES, "Update", "None")


def metrics_of(partials: DataFrame) -> DataFrame:
    """Daily metrics from partial sums."""
    return partials.groupBy("dt", "event_type").agg(
        F.sum("events").alias("events"), F.round(F.sum("added") - F.sum("retracted"), 2).alias("amount_usd")
    )
