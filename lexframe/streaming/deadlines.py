"""Deadlines on event time: an opening must be followed by a closing within a limit.

Rows of a key wait until the watermark has passed them, so that they are taken in the order
of their moments whatever order they came in. The state holds what waits and at most one open
moment of a key; a timer ends it without any later row of the key, and all of it is dropped
with the mark. Keys share the state of a bucket of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from lexframe.streaming.jobs import LATENESS, zoned

_WAITING = StructType(
    [StructField("key", StringType()), StructField("at", LongType()), StructField("opens", BooleanType()), StructField("closes", BooleanType())]
)
_OPEN = StructType([StructField("key", StringType()), StructField("since", LongType())])
#: Keys share the state of their bucket. The number belongs to a job's marks: a stopped job goes on with the same.
BUCKETS = 1_024
#: The setting that names a store for states with timers.
STORE_CHOICE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


class Deadline(StatefulProcessor):
    """Marks of the keys of one bucket: (key, since, state), with state in_time or overdue. Moments are
    microseconds. The state is read and written for many keys at once, and the bucket has one timer for what is
    next to come due, as every call to the state costs more than a row."""

    def __init__(self, key: str, limit: int):
        self.key, self.limit = key, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.open = handle.getListState("open", _OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            # The columns come in their order, not under their names.
            new = [(k, int(at), bool(o), bool(c)) for k, at, o, c in part.iloc[:, -4:].itertuples(index=False, name=None)]
            if new:
                self.waiting.appendList(new)
                at = min(row[1] for row in new)
                first = at if first is None else min(first, at)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All up to the watermark is known, also what lies after this timer.
        until = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = [], []
        for k, at, opens, closes in self.waiting.get():
            (rest if at > until else due).append((k, at, opens, closes))
        before = dict(tuple(row) for row in self.open.get())
        still, found = dict(before), []
        for k, at, opens, closes in sorted(due, key=lambda r: (r[1], not r[2], r[2], r[3])):
            since = still.get(k)
            if since is not None and at > since + self.limit:
                found.append((k, since, "overdue"))
                since = None
            if since is None and opens:
                since = at
            if since is not None and closes:
                found.append((k, since, "in_time"))
                since = None
            if since is None:
                still.pop(k, None)
            else:
                still[k] = since
        late = [k for k, since in still.items() if until > since + self.limit]
        found += [(k, still.pop(k), "overdue") for k in late]
        if due:
            self._keep(self.waiting, rest)
        if still != before:
            self._keep(self.open, list(still.items()))
        timers = [-(-at // 1000) for _, at, _, _ in rest] + [(since + self.limit) // 1000 + 1 for since in still.values()]
        if timers:
            self.handle.registerTimer(min(timers))
        if found:
            yield pd.DataFrame(found, columns=[self.key, "_since", "state"])
        else:
            yield pd.DataFrame()

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def marks(events: DataFrame, key: str, at: str, opens: Column, closes: Column, hours: float) -> DataFrame:
    """(key, opened_at, state) of a stream: an opening with a closing at the same moment or up to `hours` later is
    in_time, any other is marked overdue as soon as the watermark is past its limit. While one is open, further
    openings of the key are part of it."""
    rows = events.filter((opens | closes) & F.col(at).isNotNull()).select(
        F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("_bucket"),
        zoned(at).alias("_at"),
        F.col(key).cast("string").alias("_key"),
        F.unix_micros(zoned(at)).alias("_micros"),
        F.coalesce(opens, F.lit(False)).alias("_opens"),
        F.coalesce(closes, F.lit(False)).alias("_closes"),
    )
    kind = dict(events.dtypes)[key]
    found = rows.withWatermark("_at", LATENESS).groupBy("_bucket").transformWithStateInPandas(
        Deadline(key, int(hours * 3_600_000_000)), f"{key} string, _since long, state string", "append", "eventTime"
    )
    return found.select(F.col(key).cast(kind).alias(key), F.timestamp_micros("_since").alias("opened_at"), "state")
