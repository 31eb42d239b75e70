"""Near-duplicate rides of a stream, merged with state by athlete.

The state of an athlete is the rides that a next one may still match; a timer in event time drops those that the
watermark has passed by more than the tolerance. So neither a task nor the state holds a history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.arrival import Arrival

#: The state store that such state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Suppressor(StatefulProcessor):
    """Each ride that comes gives one row: the ride that its place holds now, the place's name (`first_id`), and the id that is gone."""

    def __init__(self, schema: T.StructType, tolerance_s: int):
        self.names, self.tolerance = schema.names, tolerance_s * 1_000_000
        self.schema, self.whole = schema, {f.name for f in schema if isinstance(f.dataType, T.LongType | T.IntegerType)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rides = handle.getListState("rides", T.StructType([T.StructField("first_id", T.LongType()), *self.schema.fields]))

    def plain(self, name: str, value):
        if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
            return None
        if isinstance(value, pd.Timestamp):
            return value.to_pydatetime()
        return int(value) if name in self.whole else value

    def ride(self, values: dict) -> dict:
        ride = {name: self.plain(name, values[name]) for name in self.names}
        at = values["date"]
        ride["_at"] = None if ride["date"] is None else pd.Timestamp(at).value // 1000
        return ride

    def load(self) -> Arrival:
        rows = self.rides.get() if self.rides.exists() else ()
        return Arrival(self.tolerance, [(r[0], self.ride(dict(zip(self.names, r[1:], strict=True)))) for r in rows])

    def store(self, state: Arrival) -> None:
        rows = [(first, *(ride[c] for c in self.names)) for first, ride in state.open]
        if rows:
            self.rides.put(rows)
        else:
            self.rides.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [self.ride(r) for df in rows for r in df.to_dict("records")]
        state, out = self.load(), []
        for new in sorted(came, key=lambda r: (r["_at"] is not None, r["_at"] or 0, r["id"])):
            first, now, before = state.arrive(new)
            gone = None if before is None else (before["id"] if now["id"] != before["id"] else new["id"])
            out.append({c: now[c] for c in self.names} | {"first_id": first, "gone_id": gone if gone != now["id"] else None})
        state.out_of_reach(timerValues.getCurrentWatermarkInMs() * 1000)
        self.store(state)
        self.set_timer(state)
        yield pd.DataFrame(out, columns=[*self.names, "first_id", "gone_id"], dtype=object)

    def set_timer(self, state: Arrival) -> None:
        """One timer, for the first ride that goes out of reach."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state.open:
            self.handle.registerTimer((min(ride["_at"] for _, ride in state.open) + self.tolerance) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.load()
        state.out_of_reach(timerValues.getCurrentWatermarkInMs() * 1000)
        self.store(state)
        self.set_timer(state)
        return iter(())

    def close(self) -> None:
        pass


def suppressed(rides: DataFrame, tolerance_s: int = 300, late: str = "1 hour") -> DataFrame:
    """The stream of changes of the ride table; of the rows of a place (`first_id`) the last one counts.

    rides: a stream with the columns of a ride. `late`: how much older than the latest start a ride may be to meet the rides of
    its time; older ones are dropped, and counted (arrival_counts()). Set spark.sql.streaming.stateStore.providerClass to STORE.
    """
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rides.schema])
    shape = T.StructType([*schema.fields, T.StructField("first_id", T.LongType()), T.StructField("gone_id", T.LongType())])
    landed = rides.observe(LANDED, F.count(F.lit(1)).alias("n")).withWatermark("date", late)
    kept = landed.groupBy("athlete_id").transformWithStateInPandas(Suppressor(schema, tolerance_s), shape, "Update", "EventTime")
    return kept.observe(KEPT, F.count(F.lit(1)).alias("n"))


#: Names under which a stream's progress tells how many rides landed and how many were not too late.
LANDED, KEPT = "rides_landed", "rides_kept"


def arrival_counts(query: StreamingQuery) -> dict[str, int]:
    """landed, kept and dropped (too late) rides of the micro-batches that the query remembers."""
    seen = {name: sum(p.observedMetrics[name]["n"] for p in query.recentProgress if name in p.observedMetrics) for name in (LANDED, KEPT)}
    return {"landed": seen[LANDED], "kept": seen[KEPT], "dropped": seen[LANDED] - seen[KEPT]}
