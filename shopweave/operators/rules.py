"""Alerts and insights: declarative rules over metric rows.

Each rule is a column test with a severity and a value; all rules of a family are
evaluated in one pass over the metric rows and exploded into one row a finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rate, seconds

#: Thresholds (fixed values).
MIN_QUEUE, MIN_VISITORS = 5, 5
ALERT_ORDER = {"CRITICAL": 0, "WARN": 1, "INFO": 2}
INSIGHT_ORDER = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
#: (column of a period, name, label, cluster) of the metrics whose trends are watched; a cluster's first one leads (fixed values).
TRENDS = (
    ("footfall", "footfall", "Footfall", "traffic"),
    ("average_occupancy", "average_occupancy", "Average occupancy", "traffic"),
    ("abandonment_rate", "queue_abandonment_rate", "Queue abandonment rate", "queue_health"),
    ("mean_wait_seconds", "average_queue_wait_seconds", "Average queue wait time", "queue_health"),
)
#: What an alert suggests, by the start of its kind (fixed values).
ACTIONS = {
    "queue_spike": "Open another billing counter and move floor staff to checkout until the queue normalizes.",
    "conversion_drop": "Review assisted selling coverage and inspect funnel drop-off before checkout.",
    "dead_zone": "Check camera coverage, sightlines, signage, and merchandising for this zone.",
    "traffic_increase": "Confirm staffing matches the higher traffic level for this period.",
    "traffic_decrease": "Review marketing, promotions, or external factors for the lower traffic, and confirm entry sensors are reporting correctly.",
    "queue_health": "Open another billing counter and review checkout staffing until wait time and abandonment normalize.",
}
#: Category and recommendation of an insight, by its title up to a colon (fixed values).
INSIGHTS = {
    "Queue Abandonment Risk": ("Queue", "Open an additional billing counter during peak periods and monitor queue length near checkout."),
    "Queue Abandonment Watch": ("Queue", "Review cashier coverage during busy windows before abandonment becomes severe."),
    "Long Queue Wait Time": ("Queue", "Add checkout capacity or move staff to billing when waits exceed the threshold."),
    "Queue Wait Time Building": ("Queue", "Prepare flexible staff coverage for the billing area during similar traffic periods."),
    "No Zone Dwell Signal": ("Zone", "Check camera coverage and zone calibration before making layout decisions."),
    "Hot Zone": ("Zone", "Keep this zone well stocked and consider placing high-margin products nearby."),
    "High Dwell Zone": ("Zone", "Review whether shoppers are engaged, blocked, or waiting for assistance in this area."),
    "Dead Zone": ("Zone", "Review signage, assortment, and sightline visibility for this low-traffic zone."),
    "High Conversion Store": ("Conversion", "Capture the staffing, assortment, and queue practices from this store as a benchmark."),
    "Low Conversion Store": ("Conversion", "Inspect product availability, assisted selling coverage, and checkout friction."),
    "Conversion Below Target": ("Conversion", "Review the funnel and focus on the step with the largest visitor drop-off."),
    "Funnel Drop-Off": ("Conversion", "Investigate this funnel step for staffing, navigation, or checkout bottlenecks."),
    "High Group Traffic": ("Visitor", "Use group-friendly assistance and keep high-interest zones easy to browse together."),
    "High Staff-To-Customer Ratio": ("Visitor", "Check whether staff presence is supporting conversion or occupying customer-facing zones."),
    "High-Value Transaction Mix": ("Revenue", "Protect availability for premium products and replicate this selling pattern in similar stores."),
    "Revenue Opportunity Zone": ("Revenue", "Add assisted selling, sampling, or clearer product calls-to-action in this zone."),
}


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def _whole(value: Column) -> Column:
    return F.rint(value).cast("long")


def _digits(value: Column, digits: int) -> Column:
    """``value`` with so many decimal digits, rounded half up."""
    unit = 10.0**digits
    return F.format_string(f"%.{digits}f", F.floor(value * unit + 0.5) / unit)


def _percent(share: Column) -> Column:
    return _text(_whole(share * 100), "%")


def _duration(value: Column) -> Column:
    """Seconds as ``45s``, ``2m`` or ``2m 5s``."""
    n = _whole(value)
    minutes, rest = F.floor(n / 60), n % 60
    return F.when(n < 60, _text(n, "s")).when(rest > 0, _text(minutes, "m ", rest, "s")).otherwise(_text(minutes, "m"))


def _reading(metric: Column, value: Column) -> Column:
    """A metric's value as its sentences print it."""
    return (F.when(metric == "queue_abandonment_rate", _text(_digits(value * 100, 1), "%")).when(metric == "average_queue_wait_seconds", _text(_whole(value), "s"))
            .when(metric == "average_occupancy", _digits(value, 2)).otherwise(_whole(value).cast("string")))


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _rank(levels: dict[str, int], column: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in levels.items() for x in kv]), F.col(column))


def _finding(ordinal: int, kind: str, test: Column, severity: Column, value: Column, subject: Column | None = None, **texts: Column) -> Column:
    """A struct where the test holds, else null; ``texts`` are further fields of it."""
    subject = F.lit(None).cast("string") if subject is None else subject
    further = [c.alias(name) for name, c in texts.items()]
    return F.when(test, F.struct(F.lit(ordinal).alias("ordinal"), F.lit(kind).alias("kind"), severity.alias("severity"), value.cast("double").alias("value"), subject.alias("subject"), *further))


def _findings(rows: DataFrame, *found: Column) -> DataFrame:
    return rows.select("store_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f")).select("store_id", "f.*")


def queue_spike(metrics: DataFrame) -> DataFrame:
    wait, lost = F.col("average_queue_wait_seconds"), F.col("queue_abandonment_rate")
    severity = F.when(F.col("queue_visit_count") < MIN_QUEUE, "INFO").when((wait >= 300) | (lost >= 0.5), "CRITICAL").otherwise("WARN")
    few = _text("Billing queue abandonment/wait is above threshold, but based on only ", F.col("queue_visit_count"), " queue visit(s) -- too few to act on yet.")
    message = F.when(F.col("queue_visit_count") < MIN_QUEUE, few).otherwise("Billing queue wait or abandonment is above the operating threshold.")
    return _findings(metrics, _finding(0, "queue_spike", (wait >= 120) | (lost >= 0.3), severity, F.greatest(wait, lost), message=message))


def conversion_drop(metrics: DataFrame) -> DataFrame:
    test = F.col("has_pos_data") & (F.col("total_visitors") >= MIN_VISITORS) & (F.col("conversion_rate") < 0.1)
    return _findings(metrics, _finding(1, "conversion_drop", test, F.lit("WARN"), F.col("conversion_rate"), message=F.lit("Current conversion is below the minimum healthy threshold.")))


def dead_zones(events: DataFrame, *, minutes: int = 30, most: int = 5) -> DataFrame:
    """Zones ever seen without a visit in the ``minutes`` before the store's latest event; the first ``most``."""
    latest = events.groupBy("store_id").agg(F.max("ts").alias("latest"))
    seen = events.where("zone_id IS NOT NULL").select("store_id", "zone_id").distinct()
    active = events.where(F.col("event_type").isin("zone_entered", "zone_dwell", "billing_queue_join") & F.col("zone_id").isNotNull()).groupBy("store_id", "zone_id").agg(F.max("ts").alias("last_visit"))
    recent = active.join(latest, "store_id").where(seconds(F.col("last_visit"), F.col("latest")) <= minutes * 60)
    dead = seen.join(recent.select("store_id", "zone_id"), ["store_id", "zone_id"], "left_anti")
    dead = dead.withColumn("_n", F.row_number().over(Window.partitionBy("store_id").orderBy("zone_id"))).where(F.col("_n") <= most)
    message = _text("No visits recorded in ", F.col("zone_id"), f" during the {minutes} minutes before the latest recorded activity.")
    return dead.select("store_id", F.lit(2).alias("ordinal"), F.lit("dead_zone").alias("kind"), F.lit("INFO").alias("severity"), F.lit(0.0).alias("value"), F.col("zone_id").alias("subject"), message.alias("message"))


def trend_signals(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(store_id, metric, cluster, direction, current, previous, delta, percent) of the trends that pass their gates."""
    names = ("footfall", "average_occupancy", "abandonment_rate", "mean_wait_seconds", "queue_terminals")
    both = current.select("store_id", *[F.col(c).alias(f"c_{c}") for c in names]).join(previous.select("store_id", *[F.col(c).alias(f"p_{c}") for c in names]), "store_id")
    four = lambda c: F.floor(c * 10000 + 0.5) / 10000
    enough = (F.col("c_queue_terminals") >= MIN_QUEUE) & (F.col("p_queue_terminals") >= MIN_QUEUE)
    gate = {}
    rows = []
    for k, (m, name, _, cluster) in enumerate(TRENDS):
        c, p = F.col(f"c_{m}").cast("double"), F.col(f"p_{m}").cast("double")
        delta, percent = four(c - p), F.when(p != 0, (c - p) / F.when(p != 0, p))
        gate["footfall"] = (c >= 10) & (p >= 10) & (F.abs(percent) >= 0.3) & (F.abs(delta) >= 8)
        gate["average_occupancy"] = F.abs(delta) >= 0.3
        gate["abandonment_rate"] = enough & (delta >= 0.1)
        gate["mean_wait_seconds"] = enough & (delta >= 30) & (percent >= 0.25)
        rows.append(F.when(gate[m], F.struct(F.lit(k).alias("preference"), F.lit(name).alias("metric"), F.lit(cluster).alias("cluster"), F.when(delta > 0, "increase").otherwise("decrease").alias("direction"), c.alias("current"), p.alias("previous"), delta.alias("delta"), percent.alias("percent"))))
    return both.select("store_id", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("s")).select("store_id", "s.*")


def trend_alerts(signals: DataFrame) -> DataFrame:
    """Signals of a cluster and direction as one alert: the preferred metric leads, others are related."""
    metric, old, new = F.col("metric"), _reading(F.col("metric"), F.col("previous")), _reading(F.col("metric"), F.col("current"))
    label, change, moved = _looked_up({name: label for _, name, label, _ in TRENDS}, metric), _text(old, " → ", new), _text(F.col("direction"), "d")
    points = _text(label, " increased by ", _digits(F.abs("delta") * 100, 1), " percentage points compared with the previous equivalent period (", change, ").")
    by = _text(label, " ", moved, " by ", _digits(F.abs("percent") * 100, 1), "% (", change, ") compared with the previous equivalent period.")
    told = F.when(metric == "queue_abandonment_rate", points).otherwise(F.coalesce(by, _text(label, " ", moved, " (", change, ") compared with the previous equivalent period.")))
    also = _text(label, " also ", moved, " over the same period (", change, ").")
    lead = F.struct("metric", "current", "previous", "delta", "percent", told.alias("message"))
    groups = signals.groupBy("store_id", "cluster", "direction").agg(
        F.min_by(lead, "preference").alias("p"), F.min("preference").alias("preference"), F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct("preference", "metric", also.alias("also")))).alias("all"))  # two metrics a cluster
    down, many = F.col("direction") == "decrease", F.col("n") > 1
    traffic = F.col("cluster") == "traffic"
    severity = (F.when(many & traffic, F.when(down, "CRITICAL").otherwise("WARN")).when(many, "CRITICAL")
                .when(traffic, F.when(~down, "INFO").when((F.col("p.metric") == "footfall") & (F.abs("p.percent") >= 0.5), "CRITICAL").otherwise("WARN"))
                .when((F.col("p.metric") == "queue_abandonment_rate") & (F.col("p.delta") >= 0.2), "CRITICAL").otherwise("WARN"))
    kind = F.when(many & traffic, F.concat(F.lit("trend_traffic_"), "direction")).when(many, F.lit("trend_queue_health_decline")).otherwise(F.concat(F.lit("trend_"), F.col("p.metric"), F.lit("_"), "direction"))
    others = F.slice("all", 2, F.size("all"))
    return groups.select(
        "store_id", (3 + F.col("preference")).alias("ordinal"), kind.alias("kind"), severity.alias("severity"), F.col("p.current").alias("value"), F.when(many, F.array_join(others["metric"], ",")).alias("subject"),
        F.col("p.message").alias("message"), F.when(many, F.array_join(others["also"], " ")).alias("related"))


def alerts(*families: DataFrame) -> DataFrame:
    """All findings with their place in the store's list (severity, then rule order, then subject) and what they suggest."""
    out = families[0]
    for f in families[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    order = Window.partitionBy("store_id").orderBy(_rank(ALERT_ORDER, "severity"), "ordinal", F.col("subject").asc_nulls_first())
    cluster = (F.when(~F.col("kind").startswith("trend_"), F.col("kind")).when(F.col("kind").contains("queue"), "queue_health")
               .otherwise(F.concat(F.lit("traffic_"), F.substring_index("kind", "_", -1))))
    return out.withColumns({"place": F.row_number().over(order), "action": _looked_up(ACTIONS, cluster)})


def headline(placed: DataFrame, k: int = 4) -> DataFrame:
    """The first ``k`` alerts of each store; the first trend among all is its headline."""
    trend = placed.where(F.col("kind").startswith("trend_")).groupBy("store_id").agg(F.min_by("kind", "place").alias("headline"))
    return placed.where(F.col("place") <= k).join(trend, "store_id", "left")


def store_insights(metrics: DataFrame) -> DataFrame:
    """Queue, conversion, visitor and revenue insights of each store."""
    wait, lost, conv = (F.col(c) for c in ("average_queue_wait_seconds", "queue_abandonment_rate", "conversion_rate"))
    few = F.col("queue_visit_count") < MIN_QUEUE
    level = lambda high: F.when(few, "LOW").otherwise(F.when(high, "HIGH").otherwise("MEDIUM"))
    sample = F.when(few, _text(" Based on only ", F.col("queue_visit_count"), " completed or abandoned queue visit(s) -- too few to act on yet.")).otherwise("")
    known, enough = F.col("has_pos_data"), F.col("total_visitors") >= MIN_VISITORS
    unique = F.col("unique_visitors")
    grouped, staff = F.greatest(F.lit(0), unique - F.col("solo_visitors")), F.col("staff_visitors")
    per_sale = F.when(F.col("attributed_transactions") > 0, F.col("attributed_revenue") / F.col("attributed_transactions"))
    of = lambda part: _percent(part / F.when(unique > 0, unique))
    return _findings(
        metrics,
        _finding(0, "queue_abandonment", lost >= 0.15, level(lost >= 0.3), lost, title=F.when(lost >= 0.3, "Queue Abandonment Risk").otherwise("Queue Abandonment Watch"),
                 message=_text(_percent(lost), " of visitors abandon the billing queue.", sample)),
        _finding(1, "queue_wait", wait >= 60, level(wait >= 120), wait, title=F.when(wait >= 120, "Long Queue Wait Time").otherwise("Queue Wait Time Building"),
                 message=_text("Average queue wait is ", _duration(wait), ", above the ", F.when(wait >= 120, "2 minute action").otherwise("1 minute watch"), " threshold.", sample)),
        _finding(2, "high_conversion", known & (conv >= 0.35), F.lit("LOW"), conv, title=F.lit("High Conversion Store"),
                 message=_text("Store conversion is ", _percent(conv), ", above the strong-performance threshold.")),
        _finding(3, "low_conversion", known & enough & (conv < 0.2), F.when(conv < 0.1, "HIGH").otherwise("MEDIUM"), conv, title=F.when(conv < 0.1, "Low Conversion Store").otherwise("Conversion Below Target"),
                 message=F.when(conv < 0.1, _text("Store conversion is ", _percent(conv), " despite ", F.col("total_visitors"), " customer visits."))
                 .otherwise(_text("Store conversion is ", _percent(conv), ", below the 20% watch threshold."))),
        _finding(4, "group_traffic", (unique > 0) & (grouped * 2 >= unique), F.lit("MEDIUM"), rate(grouped, unique), title=F.lit("High Group Traffic"),
                 message=_text(of(grouped), " of customers are assigned to shopping groups.")),
        _finding(5, "staff_ratio", (unique > 0) & (staff * 4 >= unique), F.lit("MEDIUM"), rate(staff, unique), title=F.lit("High Staff-To-Customer Ratio"),
                 message=_text("Inferred staff count is ", of(staff), " of customer visitors.")),
        _finding(6, "high_value_sales", per_sale >= 500, F.lit("LOW"), F.floor(per_sale * 100 + 0.5) / 100, title=F.lit("High-Value Transaction Mix"),
                 message=_text("Average attributed transaction value is INR ", _whole(per_sale), ".")),
    )


def funnel_insights(funnel: DataFrame, metrics: DataFrame) -> DataFrame:
    """Steps that under 60 % of the step before reach, in stores with sales data."""
    known = funnel.join(metrics.where("has_pos_data").select("store_id"), "store_id", "left_semi").where("step_no > 0")
    share, step = F.col("rate_from_previous"), F.initcap(F.replace("step", F.lit("_"), F.lit(" ")))
    return _findings(known, _finding(7, "funnel_drop", (share < 0.6) & (F.col("count") > 0), F.lit("MEDIUM"), share, F.col("step"), title=_text("Funnel Drop-Off: ", step),
                                     message=_text("Only ", _percent(share), " of visitors from the previous step reach ", step, ".")))


def zone_insights(stores: DataFrame, dwell: DataFrame) -> DataFrame:
    """Hot, high-dwell and dead zones against the store's mean zone; LOW where no zone has dwell pairs."""
    store = Window.partitionBy("store_id")
    z = dwell.withColumns({"n": F.count("*").over(store), "v": F.avg("visits").over(store), "d": F.sum(F.round(F.col("average_dwell_seconds") * 10000).cast("long")).over(store) / F.lit(10000.0) / F.count("*").over(store)})
    visits, mean, zone = F.col("visits"), F.col("average_dwell_seconds"), F.col("zone_id")
    found = _findings(
        z,
        _finding(8, "hot_zone", visits >= F.greatest(F.lit(3.0), F.col("v") * 1.5), F.lit("MEDIUM"), visits, zone, title=_text("Hot Zone: ", zone),
                 message=_text(zone, " attracts ", visits, " dwell visits, above the store zone average.")),
        _finding(9, "high_dwell_zone", (mean >= 300) | ((F.col("d") > 0) & (mean >= F.col("d") * 1.5) & (mean >= 60)), F.lit("MEDIUM"), mean, zone, title=_text("High Dwell Zone: ", zone),
                 message=_text("Average dwell in ", zone, " is ", _duration(mean), ".")),
        _finding(10, "dead_zone", (F.col("n") >= 2) & (visits <= F.greatest(F.lit(1.0), F.col("v") * 0.35)), F.lit("LOW"), visits, zone, title=_text("Dead Zone: ", zone),
                 message=_text(zone, " has only ", visits, " dwell visits compared with an average of ", _digits(F.col("v"), 1), ".")),
    )
    silent = stores.select("store_id").join(dwell.select("store_id").distinct(), "store_id", "left_anti")
    return found.unionByName(_findings(silent, _finding(11, "no_zone_signal", F.lit(True), F.lit("LOW"), F.lit(0.0), title=F.lit("No Zone Dwell Signal"),
                                                       message=F.lit("No complete zone entry/exit dwell pairs are available for this store."))))


def opportunity_zones(dwell: DataFrame, metrics: DataFrame, *, most: int = 2) -> DataFrame:
    """Up to ``most`` zones with two visits and a minute of dwell in stores that convert under 25 %."""
    weak = metrics.where("conversion_rate < 0.25").select("store_id", "conversion_rate")
    good = dwell.where("visits >= 2 AND average_dwell_seconds >= 60").join(weak, "store_id")
    picked = good.withColumn("_n", F.row_number().over(Window.partitionBy("store_id").orderBy("zone_id"))).where(F.col("_n") <= most)
    mean, zone = F.col("average_dwell_seconds"), F.col("zone_id")
    return _findings(picked, _finding(12, "opportunity_zone", F.lit(True), F.lit("MEDIUM"), mean, zone, title=_text("Revenue Opportunity Zone: ", zone),
                                      message=_text(zone, " has ", _duration(mean), " average dwell but store conversion is ", _percent(F.col("conversion_rate")), ".")))


def insights(*families: DataFrame) -> DataFrame:
    """All insights with category, recommendation and place: severity, category, title."""
    out = families[0]
    for f in families[1:]:
        out = out.unionByName(f)
    head = F.substring_index("title", ":", 1)
    out = out.withColumns({"category": _looked_up({k: c for k, (c, _) in INSIGHTS.items()}, head), "recommendation": _looked_up({k: t for k, (_, t) in INSIGHTS.items()}, head)})
    return out.withColumn("place", F.row_number().over(Window.partitionBy("store_id").orderBy(_rank(INSIGHT_ORDER, "severity"), "category", "title")))


def windowed_conversion(visits: DataFrame, correlations: DataFrame, *, days: int = 7) -> DataFrame:
    """Matched visits over visits of the ``days`` before each store's latest visit."""
    latest = visits.groupBy("store_id").agg(F.max("entry_time").alias("latest"))
    recent = visits.join(latest, "store_id").where(seconds(F.col("entry_time"), F.col("latest")) <= days * 86400)
    matched = correlations.where("status = 'MATCHED'").select("store_id", "entity_id", "session_no", F.lit(1).alias("m")).distinct()
    out = recent.join(matched, ["store_id", "entity_id", "session_no"], "left").groupBy("store_id").agg(F.count("*").alias("visits"), F.count("m").alias("matched"))
    return out.withColumn("conversion_rate", rate(F.col("matched"), F.col("visits")))
