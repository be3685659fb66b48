"""Streams whose rows Spark hands over in pieces."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from kilnworks.plans import streams
from kilnworks.streaming import process


def filled(rows, limit=6):
    """The rows (event_id, ts, user_id, value) in order for each user, by hand."""
    out = {}
    for user in {u for _, _, u, _ in rows}:
        good, age = None, 0
        for i, _, _, v in sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0])):
            good, age = (v, 0) if v is not None and 10 <= v <= 400 else (good, age + 1)
            out[i] = good if age <= limit else None
    return out


@pytest.mark.parametrize("most", [1, 7, 10_000])
def test_causal_fill_sorts_what_comes_in_several_frames(spark, tmp_path, most):
    """A batch's frames end after `most` rows, also amid a user, and files are not in order."""
    rng = random.Random(8)
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=rng.randint(0, 900)), rng.choice([1, 2, None]), rng.choice([None, 5.0, 500.0, float("nan"), float(rng.randint(10, 400))])) for i in range(400)]
    rng.shuffle(rows)
    shaped = spark.createDataFrame([(i, t, u, "view", v, None) for i, t, u, v in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    shaped.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        found = streams.run_to_end(spark, str(tmp_path), process.causal_fill).filter("event_id is not null").collect()
    finally:
        spark.conf.set(name, before)
    assert {r["event_id"]: r["value"] for r in found} == filled(rows) and len(found) == len(rows)
