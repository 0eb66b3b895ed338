"""Replay of archived or recorded events through the same ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sessions


def candidates(parsed: DataFrame, store_id: str, start: Column, end: Column, event_ids: DataFrame | None = None) -> DataFrame:
    """Events of a store with both ends of the range inclusive, in event time; a line of another store is an error."""
    if event_ids is not None:
        parsed = parsed.join(event_ids.select("source_event_id"), "source_event_id", "left_semi")
    own = F.col("store_id") == store_id
    inside = F.col("error").isNotNull() | ~own | F.col("ts").between(start, end)
    return parsed.where(inside).withColumn("error", F.coalesce("error", F.when(~own, "event of another store")))


def replay(chosen: DataFrame, stored: DataFrame, job_id: str) -> DataFrame:
    """Each candidate's status: accepted (new), duplicate (stored or seen before) or failed; new ones carry the job."""
    good = sessions.receipts(chosen.where("error IS NULL"), arrival=F.struct("ts", "arrival"))
    had = stored.select("store_id", "source_event_id", F.lit(True).alias("_had")).distinct()
    good = good.join(had, ["store_id", "source_event_id"], "left")
    good = good.withColumn("status", F.when(F.coalesce("_had", F.lit(False)), "duplicate").otherwise(F.col("status"))).drop("_had")
    bad = chosen.where("error IS NOT NULL").withColumn("status", F.lit("failed"))
    out = good.unionByName(bad)
    new = F.col("status") == "accepted"
    return out.withColumns({"is_replay": new, "replay_job_id": F.when(new, F.lit(job_id))})


def job_outcome(replayed: DataFrame, *, most_errors: int = 50) -> DataFrame:
    """Counters, outcome and the first errors of a job."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    counts = replayed.agg(n("accepted"), n("duplicate"), n("failed"))
    errors = replayed.where("status = 'failed'").orderBy("arrival").limit(most_errors).agg(F.array_sort(F.collect_list(F.struct("arrival", "error"))).alias("errors"))
    salvaged = F.col("accepted") + F.col("duplicate") > 0
    return counts.crossJoin(errors).withColumn("outcome", F.when(F.col("failed") == 0, "completed").when(salvaged, "partial").otherwise("failed"))  # single rows


def newest_jobs(jobs: DataFrame, store_id: str, most: int = 20) -> DataFrame:
    return jobs.where(F.col("store_id") == store_id).orderBy(F.desc("created_at"), F.desc("job_id")).limit(most)


