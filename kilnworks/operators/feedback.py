"""A log of feedback on records: submitted, reviewed, revoked, and what each step came to.

The log is only appended to. A record's state follows from folding its events in order; steps that do not fit the state
are refused and leave it as it is, so a batch that arrives twice changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnworks.sources.files import scratch_dir

#: (state, action) to the next state. A rejected record may be submitted anew.
STEPS = {("none", "submit"): "pending", ("rejected", "submit"): "pending", ("pending", "approve"): "approved", ("pending", "reject"): "rejected", ("approved", "revoke"): "rejected"}
#: What an action would make of a record: where it is so already, nothing changes and nothing is wrong.
RESULTS = {"submit": ("pending", "approved"), "approve": ("approved",), "reject": ("rejected",), "revoke": ()}
LOG = "event_id string, record string, at timestamp, action string, actor string, note string"
OUTCOMES = ["event_id", "record", "at", "action", "actor", "note", "before", "after", "outcome", "reason"]


def step(state: str, action: str | None) -> tuple[str, str, str | None]:
    """The next state, the outcome and why it was refused."""
    if (state, action) in STEPS:
        return STEPS[state, action], "applied", None
    if action not in RESULTS:
        return state, "refused", "unknown_action"
    if state in RESULTS[action]:
        return state, "unchanged", None
    return state, "refused", "unknown_record" if state == "none" else "not_approved" if action == "revoke" else "already_decided"


def fold_log(log: DataFrame) -> DataFrame:
    """Each event of a log with the record's state before and after it, its outcome (applied, unchanged or refused) and why.

    Events are taken once by event_id, in order of time and id; those without a record are refused. Records are dealt to
    tasks and sorted there; a task reads its events as they come and holds the state of one record.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, state = None, "none"
        for batch in batches:
            found: list[tuple] = []
            for name, action in zip(batch.column("record").to_pylist(), batch.column("action").to_pylist()):
                if name != record:
                    record, state = name, "none"
                before = state
                state, outcome, reason = step(state, action) if name is not None else ("none", "refused", "no_record")
                found.append((before, state, outcome, reason))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string()) for c in zip(*found))], names=OUTCOMES) if found else pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([], pa.string())] * 4], names=OUTCOMES)

    once = log.select(*OUTCOMES[:6]).dropDuplicates(["event_id"])
    ordered = once.repartition("record").sortWithinPartitions("record", "at", "event_id")
    return ordered.mapInArrow(run, LOG + ", before string, after string, outcome string, reason string")


def records(folded: DataFrame) -> DataFrame:
    """record, status, changed_at and steps: the state of each record that was ever submitted, from a folded log."""
    applied = folded.filter("outcome = 'applied'")
    last = F.max_by("after", F.struct("at", "event_id"))
    return applied.groupBy("record").agg(last.alias("status"), F.max("at").alias("changed_at"), F.count(F.lit(1)).alias("steps"))


def conflicts(subjects: DataFrame, status: DataFrame) -> DataFrame:
    """scope, name, targets: names for which several targets stand approved. subjects: record, scope, name, target."""
    approved = subjects.join(status.filter("status = 'approved'").select("record"), "record")
    return approved.groupBy("scope", "name").agg(F.array_sort(F.collect_set("target")).alias("targets")).filter(F.size("targets") > 1)


class FeedbackTable:
    """A folded log in a folder, partitioned by parts of the records; a batch replaces the parts it touches and no others."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64) -> None:
        self.spark, self.path, self.parts = spark, path, parts

    def frame(self) -> DataFrame:
        schema = LOG + ", before string, after string, outcome string, reason string, part int"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def apply(self, batch: DataFrame) -> dict[str, int]:
        """Adds a batch of events and says how many came to which outcome; events that are there already do not count again."""
        part = F.pmod(F.xxhash64(F.coalesce("record", F.lit(""))), F.lit(self.parts)).cast("int")
        staged = f"{scratch_dir(self.spark)}/feedback-{uuid.uuid4().hex}"
        new = batch.select(*OUTCOMES[:6]).dropDuplicates(["event_id"]).withColumn("part", part)
        touched = [r[0] for r in new.select("part").distinct().collect()]  # parts, of which there are a stated number
        old = self.frame().filter(F.col("part").isin(touched))
        new = new.join(old.select("event_id"), "event_id", "left_anti")
        both = fold_log(old.select(*OUTCOMES[:6]).unionByName(new.drop("part"))).withColumn("part", part)
        both.write.parquet(f"{staged}/rows")  # whole before anything is replaced
        new.select("event_id").write.parquet(f"{staged}/new")
        rows, ids = self.spark.read.parquet(f"{staged}/rows"), self.spark.read.parquet(f"{staged}/new")
        rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
        counts = rows.join(ids, "event_id", "left_semi").groupBy("outcome").count().collect()
        return {r["outcome"]: r["count"] for r in counts}
