"""Change detection with keyed state: late snapshots, bounded state, forgotten pages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tollgauge.operators.history import content_changes
from tollgauge.streaming import changes as S

SCHEMA = "provider_id bigint, source_url string, observed_at timestamp_ntz, snapshot_id bigint, content_hash string"
T0 = dt.datetime(2026, 6, 1)


def snap(hour, number, body, page="u"):
    return (1, page, T0 + dt.timedelta(hours=hour), number, body)


def feed(spark, tmp_path, batches, **how):
    """One micro-batch per batch of rows, in one query."""
    src, root = str(tmp_path / "src"), str(tmp_path / "out")
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    S.run_change_stream(stream, root, **how).awaitTermination()
    return root


def state_rows(spark, root):
    state = spark.read.format("statestore").option("stateVarName", "recent").load(f"{root}/checkpoint")
    return [len(r.value.times) for r in state.collect()]


@pytest.mark.parametrize("late", ["a", "b", "c"])
def test_late_snapshots_are_judged_by_time(spark, tmp_path, late):
    batches = [[snap(0, 1, "a"), snap(2, 2, "a"), snap(4, 3, "b")], [snap(1, 4, late), snap(5, 5, "b")], [snap(3, 6, late), snap(1, 7, "a")]]
    root = feed(spark, tmp_path, batches)
    whole = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    assert rows(S.current_changes(spark, root), "snapshot_id", "changed") == rows(content_changes(whole), "snapshot_id", "changed")


def test_replays_and_other_pages(spark, tmp_path):
    batch = [snap(h, h, "ab"[h // 3 % 2], page) for page in "xyz" for h in range(8)]
    root = feed(spark, tmp_path, [batch, batch[:5], batch])
    found = spark.read.parquet(f"{root}/changes")
    assert found.count() == 24 and found.agg(F.max("revision")).first()[0] == 0


def test_state_stays_small(spark, tmp_path):
    batches = [[snap(2 * i, 2 * i, f"h{i // 4}"), snap(2 * i + 1, 2 * i + 1, f"h{i // 4}")] for i in range(12)]
    root = feed(spark, tmp_path, batches[:8], lateness="3 hours")
    (early,) = state_rows(spark, root)
    root = feed(spark, tmp_path, batches[8:], lateness="3 hours")
    (later,) = state_rows(spark, root)
    assert later <= early <= 8


def test_pages_are_forgotten(spark, tmp_path):
    batches = [[snap(0, 1, "a", "old"), snap(0, 2, "a", "new")], [snap(40, 3, "a", "new")], [snap(80, 4, "a", "new")], [snap(81, 5, "a", "new")]]
    root = feed(spark, tmp_path, batches, lateness="1 hour", forget=dt.timedelta(hours=50))
    assert len(state_rows(spark, root)) == 1
    assert rows(S.current_changes(spark, root), "snapshot_id", "changed") == [(1, True), (2, True), (3, False), (4, False), (5, False)]
