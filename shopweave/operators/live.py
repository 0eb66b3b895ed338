"""Live state and series: current queue, occupancy, hourly activity, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import mean, rate, seconds
from .metrics import TERMINAL, customers
from .sessions import ENTITY


def instant(text: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


def as_of(events: DataFrame, at: Column | None = None) -> DataFrame:
    """(store_id, as_of): the given instant, else the store's latest event, never the wall clock."""
    latest = events.groupBy("store_id").agg(F.max("ts").alias("as_of"))
    return latest if at is None else latest.withColumn("as_of", F.coalesce(at, "as_of"))


def current_queue(events: DataFrame, entities: DataFrame, at: DataFrame, finished_jobs: DataFrame | None = None) -> DataFrame:
    """Visits that joined by the store's instant and have no terminal by then, with their wait."""
    timed = events.where(F.col("queue_event_id").isNotNull()).join(at, "store_id").where(F.col("ts") <= F.col("as_of"))
    joins = customers(timed.where("event_type = 'billing_queue_join'"), entities)
    first = joins.groupBy("store_id", "queue_event_id").agg(F.min("ts").alias("joined_at"), F.min_by("entity_id", F.struct("ts", "event_id")).alias("entity_id"), F.max("as_of").alias("as_of"))
    ended = timed.where(F.col("event_type").isin(*TERMINAL)).select("store_id", "queue_event_id")
    open_ = first.join(ended, ["store_id", "queue_event_id"], "left_anti")
    if finished_jobs is not None:
        open_ = open_.join(finished_jobs.select("store_id", "queue_event_id"), ["store_id", "queue_event_id"], "left_anti")
    return open_.select("store_id", "queue_event_id", "entity_id", "joined_at", F.greatest(F.lit(0), seconds(F.col("joined_at"), F.col("as_of"))).alias("waiting_seconds"))


def queue_metrics(events: DataFrame, entities: DataFrame, start: Column, end: Column) -> DataFrame:
    """Terminals in [start, end): counts, abandonment rate, mean and exact median wait (null if none)."""
    done = customers(events.where(F.col("event_type").isin(*TERMINAL) & (F.col("ts") >= start) & (F.col("ts") < end)), entities)
    # A row for each wait of a store: counts, sums and the median all follow from these.
    waits = done.groupBy("store_id", "wait_seconds").agg(F.count(F.when(F.col("event_type") == "queue_completed", 1)).alias("completed"), F.count(F.when(F.col("event_type") == "queue_abandoned", 1)).alias("abandoned"))
    n = F.col("completed") + F.col("abandoned")
    order, store = Window.partitionBy("store_id").orderBy("wait_seconds"), Window.partitionBy("store_id")
    timed = F.when(F.col("wait_seconds").isNotNull(), n).otherwise(0)
    ranked = waits.withColumns({"_n": timed, "_upto": F.sum(timed).over(order), "_all": F.sum(timed).over(store)})
    holds = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
    middle = lambda rank: F.max(F.when(holds(rank), F.col("wait_seconds"))).cast("double")
    out = ranked.groupBy("store_id").agg(
        F.sum("completed").alias("completed"), F.sum("abandoned").alias("abandoned"), F.sum(F.col("wait_seconds") * F.col("_n")).alias("_w"), F.sum("_n").alias("_waits"),
        ((middle(F.floor((F.col("_all") - 1) / 2)) + middle(F.floor(F.col("_all") / 2))) / 2).alias("median_wait_seconds"))
    return out.select("store_id", "completed", "abandoned", rate(F.col("abandoned"), F.col("completed") + F.col("abandoned")).alias("abandonment_rate"), mean(F.col("_w"), F.col("_waits")).alias("mean_wait_seconds"), "median_wait_seconds")


def occupancy_at(visits: DataFrame, entities: DataFrame, at: DataFrame) -> DataFrame:
    """Distinct customers inside: entry <= t and (no exit or exit > t)."""
    here = customers(visits, entities).join(at, "store_id").where("entry_time <= as_of AND (exit_time IS NULL OR exit_time > as_of)")
    inside = here.select(*ENTITY).distinct().groupBy("store_id").agg(F.count("*").alias("occupancy"))
    return at.join(inside, "store_id", "left").select("store_id", "as_of", F.coalesce("occupancy", F.lit(0)).alias("occupancy"))


def spine(stores: DataFrame, start: Column, end: Column, minutes: int, *, with_end: bool = False) -> DataFrame:
    """(store_id, bucket, bucket_start): buckets anchored at ``start``, the last one before ``end``.

    The query fails where ``end`` does not come after ``start``, as a width that is not positive does at once.
    """
    if minutes <= 0:
        raise ValueError("the bucket width must be positive")
    whole = F.when(start < end, seconds(start, end)).otherwise(F.raise_error(F.lit("the end must come after the start")).cast("long"))
    count = F.floor((whole + (0 if with_end else -1)) / (minutes * 60))
    buckets = stores.select("store_id", F.explode(F.sequence(F.lit(0).cast("long"), count)).alias("bucket"))
    return buckets.withColumn("bucket_start", F.timestamp_add("MINUTE", (F.col("bucket") * minutes).cast("int"), start))


def occupancy_series(visits: DataFrame, entities: DataFrame, stores: DataFrame, start: Column, end: Column, minutes: int = 60) -> DataFrame:
    """Distinct customers at start, start + b, ... and ``end``.

    Each entity's visits are merged to runs of samples that it covers without a gap; a run steps up at its first
    sample and down behind its last, and the steps add up along the samples. Rows are two a visit at most.
    """
    width = minutes * 60
    last = F.floor(seconds(start, end) / width)
    ceil = lambda c: F.ceil(seconds(start, c) / width)
    v = customers(visits, entities).where((F.col("entry_time") <= end) & (F.col("exit_time").isNull() | (F.col("exit_time") > start)))
    v = v.select(*ENTITY, F.greatest(F.lit(0).cast("long"), ceil(F.col("entry_time"))).alias("lo"), F.least(last, F.coalesce(ceil(F.col("exit_time")) - 1, last)).alias("hi")).where("lo <= hi")
    order = Window.partitionBy(*ENTITY).orderBy("lo", "hi")
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    v = v.withColumn("_new", (reached.isNull() | (F.col("lo") > reached + 1)).cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = v.groupBy(*ENTITY, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    step = lambda at, by: F.struct(at.alias("bucket"), F.lit(by).alias("step"))
    steps = runs.select("store_id", F.inline(F.array(step(F.col("lo"), 1), step(F.col("hi") + 1, -1)))).groupBy("store_id", "bucket").agg(F.sum("step").alias("step"))
    along = Window.partitionBy("store_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return spine(stores, start, end, minutes, with_end=True).join(steps, ["store_id", "bucket"], "left").select(
        "store_id", F.col("bucket_start").alias("sample_time"), F.sum(F.coalesce("step", F.lit(0))).over(along).alias("occupancy"))


def average_occupancy(series: DataFrame) -> DataFrame:
    return series.groupBy("store_id").agg(mean(F.sum("occupancy"), F.count("*")).alias("average_occupancy"))


def _bucketed(events: DataFrame, start: Column, end: Column, minutes: int) -> DataFrame:
    inside = events.where((F.col("ts") >= start) & (F.col("ts") < end))
    return inside.withColumn("bucket", F.floor(seconds(start, F.col("ts")) / (minutes * 60)))


def hourly_footfall(events: DataFrame, entities: DataFrame, stores: DataFrame, start: Column, end: Column, minutes: int = 60) -> DataFrame:
    """Customer entries by bucket, zero-filled."""
    hits = customers(_bucketed(events.where("event_type = 'entry'"), start, end, minutes), entities).groupBy("store_id", "bucket").agg(F.count("*").alias("entries"))
    return spine(stores, start, end, minutes).join(hits, ["store_id", "bucket"], "left").select("store_id", "bucket_start", F.coalesce("entries", F.lit(0)).alias("entries"))


def hourly_queue(events: DataFrame, entities: DataFrame, stores: DataFrame, start: Column, end: Column, minutes: int = 60) -> DataFrame:
    """Queue joins, completions and abandonments of customers by bucket, zero-filled."""
    kinds = {"joined": "billing_queue_join", "completed": "queue_completed", "abandoned": "queue_abandoned"}
    hits = customers(_bucketed(events.where(F.col("event_type").isin(*kinds.values())), start, end, minutes), entities)
    hits = hits.groupBy("store_id", "bucket").agg(*[F.count(F.when(F.col("event_type") == k, 1)).alias(n) for n, k in kinds.items()])
    return spine(stores, start, end, minutes).join(hits, ["store_id", "bucket"], "left").select("store_id", "bucket_start", *[F.coalesce(n, F.lit(0)).alias(n) for n in kinds])


def peak_hours(footfall: DataFrame) -> DataFrame:
    """Buckets of a store ranked by entries, ties to the earlier; ``is_peak`` only where entries occurred."""
    order = Window.partitionBy("store_id").orderBy(F.desc("entries"), "bucket_start")
    return footfall.withColumn("rank", F.row_number().over(order)).withColumn("is_peak", (F.col("rank") == 1) & (F.col("entries") > 0))


def period_metrics(events: DataFrame, visits: DataFrame, entities: DataFrame, stores: DataFrame, start: Column, end: Column) -> DataFrame:
    """Footfall, distinct entrants, queue joins, queue and occupancy metrics of one window."""
    inside = customers(events.where((F.col("ts") >= start) & (F.col("ts") < end) & F.col("event_type").isin("entry", "billing_queue_join")), entities)
    per = inside.groupBy(*ENTITY).agg(F.count(F.when(F.col("event_type") == "entry", 1)).alias("e"), F.count(F.when(F.col("event_type") == "billing_queue_join", 1)).alias("j"))
    flow = per.groupBy("store_id").agg(F.sum("e").alias("footfall"), F.count(F.when(F.col("e") > 0, 1)).alias("unique_entrants"), F.sum("j").alias("queue_joins"))
    queue = queue_metrics(events, entities, start, end).withColumn("queue_terminals", F.col("completed") + F.col("abandoned")).drop("completed", "abandoned")
    inside_mean = average_occupancy(occupancy_series(visits, entities, stores, start, end))
    out = stores.select("store_id").join(flow, "store_id", "left").join(queue, "store_id", "left").join(inside_mean, "store_id", "left")
    return out.na.fill(0, ["footfall", "unique_entrants", "queue_joins", "queue_terminals"])


#: Compared metrics, in report order.
COMPARED = ("footfall", "unique_entrants", "queue_joins", "abandonment_rate", "mean_wait_seconds", "average_occupancy")


def compare(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Long form: (store_id, metric, current, previous, delta, percent); no row where either side is null."""
    both = current.select("store_id", *[F.col(m).cast("double").alias(f"c_{m}") for m in COMPARED]).join(previous.select("store_id", *[F.col(m).cast("double").alias(f"p_{m}") for m in COMPARED]), "store_id")
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"c_{m}").alias("current"), F.col(f"p_{m}").alias("previous")) for m in COMPARED])
    out = both.select("store_id", F.explode(rows).alias("r")).select("store_id", "r.*").where("current IS NOT NULL AND previous IS NOT NULL")
    four = lambda c: F.floor(c * 10000 + 0.5) / 10000
    return out.withColumns({"delta": four(F.col("current") - F.col("previous")), "percent": F.when(F.col("previous") != 0, four((F.col("current") - F.col("previous")) / F.col("previous")))})
