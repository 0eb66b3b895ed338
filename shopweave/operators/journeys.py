"""Paths through a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rate
from .metrics import customers
from .sessions import VISIT


def paths(events: DataFrame, entities: DataFrame, correlations: DataFrame) -> DataFrame:
    """One row a visit: its steps joined by `` > ``, and whether it purchased or abandoned a queue."""
    kind = F.col("event_type")
    steps = customers(events, entities).where(kind.isin("zone_entered", "queue_completed", "queue_abandoned") & F.col("zone_id").isNotNull())
    steps = steps.withColumn("step", F.when(kind == "zone_entered", F.col("zone_id")).otherwise(F.concat("zone_id", F.lit(":queue"))))
    order = Window.partitionBy(*VISIT).orderBy("ts", "event_id")
    last = F.lag("step").over(order)
    kept = steps.withColumn("_new", last.isNull() | (last != F.col("step")))
    per = kept.groupBy(*VISIT).agg(F.array_sort(F.collect_list(F.when(F.col("_new"), F.struct("ts", "event_id", "step")))).alias("s"), F.max(kind == "queue_abandoned").alias("abandoned"))
    bought = correlations.where("status = 'MATCHED'").select(*VISIT, F.lit(True).alias("purchased")).distinct()
    out = per.join(bought, list(VISIT), "left")
    return out.select(*VISIT, F.array_join(F.transform("s", lambda x: x["step"]), " > ").alias("path"), F.coalesce("purchased", F.lit(False)).alias("purchased"), "abandoned")


def path_metrics(journeys: DataFrame) -> DataFrame:
    """Per path: visitors, purchases and abandonments (a queue abandoned, or nothing purchased)."""
    lost = F.col("abandoned") | ~F.col("purchased")
    out = journeys.groupBy("store_id", "path").agg(F.count("*").alias("visitors"), F.count(F.when(F.col("purchased"), 1)).alias("purchases"), F.count(F.when(lost, 1)).alias("abandonments"))
    return out.withColumns({"conversion_rate": rate(F.col("purchases"), F.col("visitors")), "abandonment_rate": rate(F.col("abandonments"), F.col("visitors"))})


#: List name -> its order; ties always end at the path.
LISTS = {
    "popular": ("-visitors", "path"),
    "converting": ("-purchases", "-conversion_rate", "path"),
    "abandoned": ("-abandonments", "-abandonment_rate", "path"),
}


def top_paths(metrics: DataFrame, k: int = 5) -> DataFrame:
    """The three top lists of each store as (list, rank); lists by purchases or losses leave out zeros."""
    keep = {"popular": F.lit(True), "converting": F.col("purchases") > 0, "abandoned": F.col("abandonments") > 0}
    out = None
    for name, order in LISTS.items():
        by = Window.partitionBy("store_id").orderBy(*[F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order])
        one = metrics.where(keep[name]).withColumns({"list": F.lit(name), "rank": F.row_number().over(by)}).where(F.col("rank") <= k)
        out = one if out is None else out.unionByName(one)
    return out
