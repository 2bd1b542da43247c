"""Snapshot streams: change detection with keyed state, and idempotent ingest.

Change detection keeps, per page, the snapshots of the last ``lateness`` and one older one, in the state store. A snapshot is
compared with the one before it in time, also when it comes late; if a late one lands before a snapshot that was judged already and
turns its verdict, that snapshot is emitted again with a higher revision. A batch reads and writes the state of its own pages only.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tollgauge.operators.history import PAGE
from tollgauge.operators.ordering import latest

COLUMNS = [*PAGE, "snapshot_id", "observed_at", "content_hash"]


class PageChanges(StatefulProcessor):
    """Snapshots of one page in, verdicts out. A page not seen for ``forget_ms`` of event time is forgotten."""

    def __init__(self, id_type: str, forget_ms: int):
        self.state = f"times array<bigint>, ids array<{id_type}>, hashes array<string>, revisions array<int>"
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", self.state)

    def _known(self) -> list[list]:
        if not self.recent.exists():
            return []
        return [list(x) for x in zip(*self.recent.get())]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        first = not known
        seen = {(t, i) for t, i, *_ in known}
        items = [(t, i, h, n, True) for t, i, h, n in known]
        for frame in rows:
            for t, i, h in zip(frame["t"].tolist(), frame["snapshot_id"].tolist(), frame["content_hash"].tolist()):
                if (t, i) not in seen:  # a replay adds nothing
                    seen.add((t, i))
                    items.append((t, i, h, 0, False))
        items.sort(key=lambda x: (x[0], x[1]))
        out, kept = [], []
        before = before_known = None
        for t, i, h, revision, old in items:
            changed = before is None or before[2] != h
            if not old:
                out.append((*key, i, t, h, changed, 0))
            elif before is not None and not before[4]:
                # judged before with the known snapshot in front of it; the very first one of a page counted as changed
                was = before_known is None or before_known[2] != h
                if was != changed:
                    revision += 1
                    out.append((*key, i, t, h, changed, revision))
            before = (t, i, h, revision, old)
            before_known = before if old else before_known
            kept.append((t, i, h, revision))
        horizon = timerValues.getCurrentWatermarkInMs() * 1000
        start = next((x for x, item in enumerate(kept) if item[0] >= horizon), len(kept))
        kept = kept[max(0, start - 1) :]
        self.recent.update(tuple(list(c) for c in zip(*kept)))
        if first:
            self.handle.registerTimer(kept[-1][0] // 1000 + self.forget_ms)
        if out:
            yield pd.DataFrame(out, columns=[*PAGE, "snapshot_id", "t", "content_hash", "changed", "revision"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known()
        last = known[-1][0] // 1000 + self.forget_ms if known else 0
        if last > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(last)
        else:
            self.recent.clear()
        yield from ()

    def close(self) -> None:
        pass


def page_changes(snapshots: DataFrame, lateness: str = "7 days", forget: dt.timedelta = dt.timedelta(days=400)) -> DataFrame:
    """Streaming verdicts: the columns of a snapshot, ``changed`` and ``revision``.

    Snapshots later than ``lateness`` behind the newest one are dropped by the watermark. The session needs the RocksDB state store.
    """
    kind = dict(snapshots.dtypes)
    timed = snapshots.select(*COLUMNS, F.col("observed_at").cast("timestamp").alias("event_time")).withWatermark("event_time", lateness)
    keyed = timed.select(*PAGE, "snapshot_id", "content_hash", F.unix_micros("event_time").alias("t"), "event_time")
    fields = ", ".join(f"{c} {kind[c]}" for c in (*PAGE, "snapshot_id")) + ", t bigint, content_hash string, changed boolean, revision int"
    judge = PageChanges(kind["snapshot_id"], int(forget.total_seconds() * 1000))
    found = keyed.groupBy(*PAGE).transformWithStateInPandas(judge, fields, "Append", "EventTime")
    return found.withColumn("observed_at", F.timestamp_micros("t").cast(kind["observed_at"])).select(*COLUMNS, "changed", "revision")


def run_change_stream(snapshots: DataFrame, root: str, lateness: str = "7 days", forget: dt.timedelta = dt.timedelta(days=400)) -> StreamingQuery:
    """Process everything available, then stop. Verdicts are appended to ``root``/changes, once each whatever fails in between."""
    return (
        page_changes(snapshots, lateness, forget)
        .writeStream.format("parquet")
        .option("path", f"{root}/changes")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def current_changes(spark: SparkSession, root: str) -> DataFrame:
    """The last verdict on every snapshot."""
    return latest(spark.read.parquet(f"{root}/changes"), [*PAGE, "snapshot_id"], [F.col("revision").desc()])


def ingest_once(snapshots: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Drop snapshots already seen within the lateness bound, so replays append nothing."""
    timed = snapshots.withColumn("event_time", F.col("observed_at").cast("timestamp"))
    return timed.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark([*PAGE, "snapshot_id"])
