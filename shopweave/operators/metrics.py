"""Store metrics over all time, one row a store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import mean, rate, seconds
from .sessions import ENTITY, VISIT

TERMINAL = ("queue_completed", "queue_abandoned")
JOINED = ("billing_queue_join", *TERMINAL)


def customers(frame: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows whose entity is not known to be staff; a null or unknown entity stays."""
    return frame.join(entities.where("is_staff").select(*ENTITY), list(ENTITY), "left_anti")


def _count(test) -> F.Column:
    return F.count(F.when(test, 1))


def visitor_metrics(visits: DataFrame, entities: DataFrame) -> DataFrame:
    """Visits, distinct customers, staff, solo visitors, groups and dwell."""
    per = visits.groupBy(*ENTITY).agg(F.count("*").alias("visits"), F.sum("dwell_seconds").alias("dwell"), F.count("dwell_seconds").alias("dwells"))
    seen = per.join(entities, list(ENTITY), "left").withColumn("staff", F.coalesce("is_staff", F.lit(False)))
    cust = ~F.col("staff")
    out = seen.groupBy("store_id").agg(
        F.coalesce(F.sum(F.when(cust, F.col("visits"))), F.lit(0)).alias("total_visitors"), _count(cust).alias("unique_visitors"), _count(F.col("staff")).alias("staff_visitors"),
        _count(cust & F.col("group_id").isNull()).alias("solo_visitors"), F.sum(F.when(cust, F.col("dwell"))).alias("_dwell"), F.sum(F.when(cust, F.col("dwells"))).alias("_dwells"))
    groups = entities.where(~F.coalesce("is_staff", F.lit(False)) & F.col("group_id").isNotNull()).groupBy("store_id", "group_id").agg(F.coalesce(F.max("group_size"), F.lit(0)).alias("size"))
    groups = groups.groupBy("store_id").agg(F.count("*").alias("group_count"), F.sum("size").alias("_sizes"))
    joined = out.join(groups, "store_id", "left").withColumn("group_count", F.coalesce("group_count", F.lit(0)))
    return joined.select("store_id", "total_visitors", "unique_visitors", "staff_visitors", "solo_visitors", "group_count",
                         F.coalesce(mean(F.col("_sizes"), F.col("group_count")), F.lit(0.0)).alias("average_group_size"), F.coalesce(mean(F.col("_dwell"), F.col("_dwells")), F.lit(0.0)).alias("average_dwell_seconds"))


def queue_totals(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Queue counts, abandonment rate and mean wait of customers."""
    kind = F.col("event_type")
    e = customers(events, entities)
    # Visits that queued: one row a visit first, so that no distinct set is held for a store.
    visits = e.where(kind.isin(*JOINED)).groupBy(*VISIT).agg(F.max((kind == "queue_completed").cast("int")).alias("done"))
    visits = visits.groupBy("store_id").agg(F.count("*").alias("queue_join_count"), F.sum("done").alias("queue_complete_count"))
    ends = e.groupBy("store_id").agg(
        _count(kind == "entry").alias("footfall"), _count(kind == "queue_completed").alias("completed"), _count(kind == "queue_abandoned").alias("abandoned"),
        F.sum(F.when(kind.isin(*TERMINAL), F.col("wait_seconds"))).alias("_wait"), F.count(F.when(kind.isin(*TERMINAL), F.col("wait_seconds"))).alias("_waits"))
    total = F.col("completed") + F.col("abandoned")
    return ends.join(visits, "store_id", "left").select(
        "store_id", "footfall", total.alias("queue_visit_count"), rate(F.col("abandoned"), total).alias("queue_abandonment_rate"), F.coalesce(mean(F.col("_wait"), F.col("_waits")), F.lit(0.0)).alias("average_queue_wait_seconds"),
        F.coalesce("queue_join_count", F.lit(0)).alias("queue_join_count"), F.coalesce("queue_complete_count", F.lit(0)).alias("queue_complete_count"))


def attributed_sales(correlations: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct matched transactions and the sum of their items (added up in cents)."""
    matched = correlations.where("status = 'MATCHED'").select("store_id", "order_id").distinct()
    sums = items.groupBy("store_id", "order_id").agg(F.sum(F.round(F.col("amount") * 100).cast("long")).alias("cents"))
    joined = matched.join(sums, ["store_id", "order_id"], "left")
    return joined.groupBy("store_id").agg(F.count("*").alias("attributed_transactions"), (F.coalesce(F.sum("cents"), F.lit(0)) / 100).alias("attributed_revenue"))


def store_metrics(events: DataFrame, visits: DataFrame, entities: DataFrame, correlations: DataFrame, transactions: DataFrame, items: DataFrame) -> DataFrame:
    """All metrics as one row a store; conversion is attributed transactions over visits."""
    stores = reduce(DataFrame.unionByName, [f.select("store_id").distinct() for f in (events, visits, transactions)]).distinct()
    sold = transactions.groupBy("store_id").agg((F.count("*") > 0).alias("has_pos_data"))
    parts = [visitor_metrics(visits, entities), queue_totals(events, entities), attributed_sales(correlations, items), sold]
    out = reduce(lambda a, b: a.join(b, "store_id", "left"), parts, stores)
    out = out.na.fill(0).na.fill(False)
    return out.withColumn("conversion_rate", rate(F.col("attributed_transactions"), F.col("total_visitors")))


def visit_facts(events: DataFrame) -> DataFrame:
    """One row a visit with all that the store metrics need of its events: one pass, and no shuffle over a stored table."""
    kind, terminal = F.col("event_type"), F.col("event_type").isin(*TERMINAL)
    out = events.groupBy(*VISIT).agg(
        F.min("ts").alias("entry_time"), F.max(F.when(kind == "exit", F.col("ts"))).alias("exit_time"), _count(kind == "entry").alias("entries"), _count(kind == "queue_completed").alias("completed"), _count(kind == "queue_abandoned").alias("abandoned"),
        F.sum(F.when(terminal, F.col("wait_seconds"))).alias("waited"), F.count(F.when(terminal, F.col("wait_seconds"))).alias("waits"), F.max(kind.isin(*JOINED).cast("int")).alias("joined"), F.max((kind == "queue_completed").cast("int")).alias("served"))
    return out.withColumn("dwell_seconds", seconds(F.col("entry_time"), F.col("exit_time")))


def metrics_of_visits(facts: DataFrame, entities: DataFrame, correlations: DataFrame, transactions: DataFrame, items: DataFrame) -> DataFrame:
    """:func:`store_metrics` from :func:`visit_facts`, which it reads once."""
    sums = ("dwell_seconds", "entries", "completed", "abandoned", "waited", "waits", "joined", "served")
    per = facts.groupBy(*ENTITY).agg(F.count("*").alias("visits"), F.count("dwell_seconds").alias("dwells"), *[F.sum(c).alias(c) for c in sums])
    seen = per.join(entities.select(*ENTITY, "is_staff", "group_id"), list(ENTITY), "left").withColumn("staff", F.coalesce("is_staff", F.lit(False)))
    of_customers = [F.coalesce(F.sum(F.when(~F.col("staff"), F.col(c))), F.lit(0)).alias(c) for c in ("visits", "dwells", *sums)]
    out = seen.groupBy("store_id").agg(_count(~F.col("staff")).alias("unique_visitors"), _count(F.col("staff")).alias("staff_visitors"), _count(~F.col("staff") & F.col("group_id").isNull()).alias("solo_visitors"), *of_customers)
    groups = entities.where(~F.coalesce("is_staff", F.lit(False)) & F.col("group_id").isNotNull()).groupBy("store_id", "group_id").agg(F.coalesce(F.max("group_size"), F.lit(0)).alias("size"))
    groups = groups.groupBy("store_id").agg(F.count("*").alias("group_count"), F.sum("size").alias("sizes"))
    sold = transactions.groupBy("store_id").agg((F.count("*") > 0).alias("has_pos_data"))
    out = reduce(lambda a, b: a.join(b, "store_id", "full"), [out, sold]).join(groups, "store_id", "left").join(attributed_sales(correlations, items), "store_id", "left").na.fill(0).na.fill(False)
    queued = F.col("completed") + F.col("abandoned")
    mean_of = lambda total, n: F.coalesce(mean(F.col(total), F.col(n)), F.lit(0.0))
    return out.select(
        "store_id", F.col("visits").alias("total_visitors"), "unique_visitors", "staff_visitors", "solo_visitors", "group_count", mean_of("sizes", "group_count").alias("average_group_size"), mean_of("dwell_seconds", "dwells").alias("average_dwell_seconds"),
        F.col("entries").alias("footfall"), queued.alias("queue_visit_count"), rate(F.col("abandoned"), queued).alias("queue_abandonment_rate"), mean_of("waited", "waits").alias("average_queue_wait_seconds"), F.col("joined").alias("queue_join_count"),
        F.col("served").alias("queue_complete_count"), "attributed_transactions", "attributed_revenue", "has_pos_data", rate(F.col("attributed_transactions"), F.col("visits")).alias("conversion_rate"))


def funnel(metrics: DataFrame) -> DataFrame:
    """visitors, queue_join, queue_complete, purchase with rates from the step before and from visitors."""
    base = F.when(F.col("footfall") > 0, F.col("footfall")).otherwise(F.col("total_visitors"))
    steps = [("visitors", base), ("queue_join", F.col("queue_join_count")), ("queue_complete", F.col("queue_complete_count")), ("purchase", F.col("attributed_transactions"))]
    rows = F.array(*[F.struct(F.lit(k).alias("step_no"), F.lit(n).alias("step"), c.cast("long").alias("count"), (steps[k - 1][1] if k else c).cast("long").alias("before"), base.cast("long").alias("base")) for k, (n, c) in enumerate(steps)])
    basis = F.when(F.col("footfall") > 0, "footfall").otherwise("sessions")
    out = metrics.select("store_id", basis.alias("visitor_basis"), F.explode(rows).alias("s")).select("store_id", "visitor_basis", "s.*")
    return out.select("store_id", "visitor_basis", "step_no", "step", "count", rate(F.col("count"), F.col("before")).alias("rate_from_previous"), rate(F.col("count"), F.col("base")).alias("rate_from_visitors"))


def zone_dwell(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Per zone: visits, total and mean dwell; an EXIT pairs with the ENTER directly before it in the visit."""
    moves = customers(events, entities).where(F.col("event_type").isin("zone_entered", "zone_exited") & F.col("zone_id").isNotNull())
    order = Window.partitionBy(*VISIT, "zone_id").orderBy("ts", "event_id")
    pairs = moves.withColumns({"_type": F.lag("event_type").over(order), "_ts": F.lag("ts").over(order)})
    pairs = pairs.where("event_type = 'zone_exited' AND _type = 'zone_entered'").withColumn("dwell", seconds(F.col("_ts"), F.col("ts"))).where("dwell >= 0")
    out = pairs.groupBy("store_id", "zone_id").agg(F.count("*").alias("visits"), F.sum("dwell").alias("total_dwell_seconds"))
    return out.withColumn("average_dwell_seconds", mean(F.col("total_dwell_seconds"), F.col("visits")))


def store_activity(stores: DataFrame, events: DataFrame) -> DataFrame:
    """Event count and latest time of every store; 0 and null without events."""
    per = events.groupBy("store_id").agg(F.count("*").alias("n_events"), F.max("ts").alias("last_event"))
    return stores.join(per, "store_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


def feed_status(activity: DataFrame, now, *, stale_seconds: int = 600) -> DataFrame:
    """``STALE_FEED`` where the latest event is older than ``stale_seconds`` at ``now``."""
    age = seconds(F.col("last_event"), now)
    return activity.select("store_id", "last_event", F.when(age > stale_seconds, "STALE_FEED").otherwise("OK").alias("feed_status"))
