"""What each source plays and whether it still sends: state with timers, over restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: A state store that keeps timers is needed; it is asked for when a stream starts.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Mirror(StatefulProcessor):
    """Holds the last row of a source in order of arrival; after `silence` milliseconds without one it is given as not connected."""

    def __init__(self, schema: StructType, order: str, silence: int):
        self.schema, self.order, self.silence = schema, order, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema)

    def _row(self, values: tuple, connected: bool) -> pd.DataFrame:
        frame = pd.DataFrame([values], columns=self.schema.names, dtype=object)
        frame["connected"] = connected
        return frame

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        at = self.schema.names.index(self.order)
        for frame in rows:
            for values in frame[self.schema.names].astype(object).where(frame[self.schema.names].notna(), None).itertuples(index=False, name=None):
                if best is None or (values[at] is not None and (best[at] is None or values[at] >= best[at])):
                    best = values
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence)
        if best is not None:
            self.last.update(best)
            yield self._row(best, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.last.get()
        if held is not None:
            yield self._row(tuple(held), False)

    def close(self) -> None:
        pass


def mirror(states: DataFrame, by: str, order: str, silence: float = 3.0) -> DataFrame:
    """Each change of a source's last state and of `connected`, for a stream written in update mode.

    states: a row for each packet; within a batch that with the largest `order` counts, over batches the later one.
    A source that is silent for `silence` seconds of processing time comes once with connected = false, with what it
    played last; its next packet connects it again. Timers are looked at with each batch, also one without data, so a
    processing-time trigger is needed; a run over what is there (availableNow) would wait for timers for ever. After a
    restart they are looked at from the first packet on.
    """
    spark = states.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    schema = states.schema
    made = StructType(list(schema.fields)).add("connected", "boolean")
    processor = Mirror(schema, order, int(silence * 1000))
    return states.groupBy(by).transformWithStateInPandas(processor, made, "Update", "processingTime")
