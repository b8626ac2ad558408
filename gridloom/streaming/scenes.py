"""Scenes whose bands arrive in several files: state by scene, event time, timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.storage import importable

SCENES = "scene string, status string, n_bands int, n_rows bigint, first_at timestamp, last_at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Whole(StatefulProcessor):
    """A scene's bands until all are there or its time is over.

    Rows out: `whole` once all bands came; `partial` when the timer ends before that;
    `late` for each file that comes after either. A band that comes twice counts once. The
    mark that a scene is done goes with a second timer, as long after it as the first one.
    """

    def __init__(self, bands: int, wait_ms: int) -> None:
        self.wanted, self.wait_ms = bands, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bands = handle.getMapState("bands", "band int", "n_rows long, at long")
        self.done = handle.getValueState("done", "until long")

    def row(self, key, status: str, held: list[tuple]) -> pd.DataFrame:
        at = [pd.Timestamp(t, unit="ms") for _, _, t in held]
        return pd.DataFrame({"scene": [key[0]], "status": [status], "n_bands": [len(held)], "n_rows": [sum(n for _, n, _ in held)], "first_at": [min(at)], "last_at": [max(at)]})

    def held(self) -> list[tuple]:
        return [(k[0], v[0], v[1]) for k, v in self.bands.iterator()]

    def finish(self, at: int) -> None:
        self.bands.clear()
        self.done.update((at + self.wait_ms,))
        self.handle.registerTimer(at + self.wait_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            for band, n, at in zip(some["band"], some["n_rows"], some["taken_at"].astype("int64"), strict=True):
                ms = int(pd.Timestamp(at, unit=some["taken_at"].dt.unit).value // 1_000_000)
                if self.done.exists():
                    yield self.row(key, "late", [(int(band), int(n), ms)])
                    continue
                if not any(True for _ in self.bands.keys()):
                    self.handle.registerTimer(ms + self.wait_ms)
                self.bands.updateValue((int(band),), (int(n), ms))
                if len(held := self.held()) == self.wanted:
                    for timer in list(self.handle.listTimers()):
                        self.handle.deleteTimer(timer)
                    yield self.row(key, "whole", held)
                    self.finish(max(t for _, _, t in held))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            self.done.clear()
        elif held := self.held():
            yield self.row(key, "partial", held)
            self.finish(expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def scenes(bands: DataFrame, wanted: int, delay: str = "10 minutes", wait_seconds: int = 3600) -> DataFrame:
    """The stream SCENES of a stream (scene, band, n_rows, taken_at): one row for each scene, and one for each late file.

    Rows older than the watermark, the latest taken_at less `delay`, don't come this far; Spark counts them
    as numRowsDroppedByWatermark in the query's progress. The state needs Spark's RocksDB store.
    """
    spark = bands.sparkSession
    importable(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return bands.withWatermark("taken_at", delay).groupBy("scene").transformWithStateInPandas(Whole(wanted, wait_seconds * 1000), outputStructType=SCENES, outputMode="Append", timeMode="EventTime")
