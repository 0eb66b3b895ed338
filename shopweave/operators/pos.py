"""Point-of-sale import, and which visit a purchase belongs to."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import seconds
from ..sources.storage import children, materialize, remove
from .metrics import customers
from .sessions import VISIT

#: Minutes within which a queue completion, an exit or the visit itself counts.
QUEUE_WINDOW, EXIT_WINDOW, SESSION_WINDOW = 600, 1200, 2700


def parse_rows(rows: DataFrame) -> DataFrame:
    """Trimmed, typed rows with ``error`` (null if the row is good); order of input in ``row_no``."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    digits = F.regexp_extract(F.upper(text("store_id")), r"^(?:(?:STORE[_\-\s]*)?(\d+)|ST(\d+))$", 1)
    other = F.regexp_extract(F.upper(text("store_id")), r"^(?:(?:STORE[_\-\s]*)?(\d+)|ST(\d+))$", 2)
    store = F.nullif(F.concat(digits, other), F.lit(""))
    amount = F.expr("try_cast(trim(total_amount) AS DOUBLE)")
    at = F.expr("CAST(try_to_timestamp(concat_ws(' ', trim(order_date), trim(order_time)), 'd-M-yyyy H:m:s') AS TIMESTAMP_NTZ)")
    out = rows.select("row_no", text("order_id").alias("order_id"), F.concat(F.lit("ST"), store).alias("store_id"), text("product_id").alias("product_id"), F.nullif(text("brand_name"), F.lit("")).alias("brand_name"), amount.alias("amount"), at.alias("ts"))
    problem = (F.when(F.col("order_id") == "", "order_id is required").when(F.col("store_id").isNull(), "store_id is not valid").when(F.col("product_id") == "", "product_id is required")
               .when(F.col("amount").isNull(), "total_amount is not a number").when(F.col("ts").isNull(), "order time is not valid"))
    return out.withColumn("error", F.when(problem.isNotNull(), F.concat(F.lit("row "), F.col("row_no"), F.lit(": "), problem)))


def import_orders(parsed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One transaction an order: time of its first row, items of all rows; stored orders are skipped whole."""
    good = parsed.where("error IS NULL")
    orders = good.groupBy("store_id", "order_id").agg(F.min_by("ts", "row_no").alias("ts"), F.array_sort(F.collect_list(F.struct("row_no", "product_id", "brand_name", "amount"))).alias("items"))
    return orders if stored is None else orders.join(stored.select("store_id", "order_id"), ["store_id", "order_id"], "left_anti")


def import_report(parsed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Counters of an import: rows, failed rows, created and skipped orders."""
    rows = parsed.agg(F.count("*").alias("rows"), F.count("error").alias("failed_rows"))
    every, new = import_orders(parsed), import_orders(parsed, stored)
    counts = every.agg(F.count("*").alias("orders")).crossJoin(new.agg(F.count("*").alias("created")))  # single rows
    return rows.crossJoin(counts).withColumn("skipped", F.col("orders") - F.col("created"))


def _decay(distance: Column, window: int) -> Column:
    return F.when(distance <= window, 1.0 - distance.cast("double") / window).otherwise(F.lit(0.0))


def eligible_visits(visits: DataFrame, events: DataFrame, entities: DataFrame) -> DataFrame:
    """Customers' visits with their latest completed queue and whether a queue was abandoned.

    A completion counts if its event says that it was not abandoned; events without ``abandoned`` are taken by their type.
    """
    kind = F.col("event_type")
    done = (kind == "queue_completed") & (~F.col("abandoned") if "abandoned" in events.columns else F.lit(True))
    queue = events.where(kind.isin("queue_completed", "queue_abandoned")).groupBy(*VISIT).agg(F.max(F.when(done, F.col("ts"))).alias("queue_time"), F.max(kind == "queue_abandoned").alias("queue_abandoned"))
    return customers(visits, entities).join(queue, list(VISIT), "left").withColumn("queue_abandoned", F.coalesce("queue_abandoned", F.lit(False)))


def _scores(at: int, entry: np.ndarray, left: np.ndarray, queue: np.ndarray, has_left: np.ndarray, has_queue: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """Scores of visits for a purchase at ``at``; times in microseconds, gaps in whole seconds."""
    gap = lambda there: np.abs(at - there) // 1000000
    decay = lambda distance, window, known: np.where(known & (distance <= window), 1.0 - distance / float(window), 0.0)
    last = np.where(has_left, left, entry)
    outside = np.where(at < entry, entry - at, np.where(at > last, at - last, 0)) // 1000000
    raw = 0.20 + 0.45 * decay(gap(queue), QUEUE_WINDOW, has_queue) + 0.25 * decay(gap(left), EXIT_WINDOW, has_left) + 0.10 * decay(outside, SESSION_WINDOW, True) - np.where(lost, 0.20, 0.0)
    return np.floor(np.maximum(0.0, np.minimum(1.0, raw)) * 10000 + 0.5) / 10000


def _meeting(least: float, margin: float, reach: int, most: int | None):
    """For each moment of a group, the group's visits within ``margin`` of its best one; the best ``most`` at most."""
    lowest, near = least - margin - 1e-9, 30 * 1000000
    slack = lambda window: window * 1000000 + 999999  # noqa: E731  gaps are cut to whole seconds

    def meet(visits: pa.Table, moments: pa.Table) -> pa.Table:
        number = lambda c: visits[c].fill_null(0).to_numpy().astype("int64")
        known = lambda c: visits[c].is_valid().to_numpy()
        entry, left, queue, has_left, has_queue, lost = number("entry"), number("left"), number("queue"), known("left"), known("queue"), visits["lost"].to_numpy()
        by_queue, by_left = (np.flatnonzero(has)[np.argsort(times[has], kind="stable")] for has, times in ((has_queue, queue), (has_left, left)))
        columns = (entry, left, queue, has_left, has_queue, lost)
        queued, gone = ([c[order] for c in columns] for order in (by_queue, by_left))
        at_queue, at_left = queued[2], gone[1]
        inside = lambda times, at, reach: slice(*np.searchsorted(times, [at - reach, at + reach + 1]))
        when, which, what = [], [], []
        for at in moments["moment"].to_numpy():
            # The nearest queues give a lower bound of the best score, and that a bound of the gaps that can be kept.
            part = inside(at_queue, at, near)
            bound = max(lowest, _scores(at, *[c[part] for c in queued]).max() - margin - 1e-9) if part.stop > part.start else lowest
            window = min(QUEUE_WINDOW, int(QUEUE_WINDOW * (1 - (bound - 0.0001 - 0.55) / 0.45)) + 1)
            part = inside(at_queue, at, slack(window))
            scores, rows = _scores(at, *[c[part] for c in queued]), by_queue[part]
            if bound <= 0.5501:  # visits without a queue hit may be kept too
                part = inside(at_left, at, slack(reach))
                other = [c[part] for c in gone]
                alone = ~(other[4] & (np.abs(at - other[2]) // 1000000 <= QUEUE_WINDOW))
                scores, rows = np.concatenate([scores, _scores(at, *[c[alone] for c in other])]), np.concatenate([rows, by_left[part][alone]])
            if not len(scores):
                continue
            kept = np.flatnonzero(scores >= max(lowest, scores.max() - margin - 2e-9))
            if most is not None and len(kept) > most:
                kept = kept[np.argpartition(-scores[kept], most - 1)[:most]]
            when.append(np.full(len(kept), at))
            which.append(rows[kept])
            what.append(scores[kept])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        out = visits.select(["store_id", "entity_id", "session_no", "entry", "queue"]).take(pa.array(join(which, "int64")))
        return out.append_column("moment", pa.array(join(when, "int64"))).append_column("score", pa.array(join(what, "float64")))

    return meet


def _micros(at: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), at)


def _near(transactions: DataFrame, people: DataFrame, least: float, margin: float, *, most: int | None = None, rows: int = 1 << 18, moments: int = 2048) -> DataFrame:
    """(store_id, moment, entity_id, session_no, entry, score, method): candidates of each moment at which something was sold.

    A superset of those that are kept; with ``most``, so many of the best at least. Purchases of one moment have the same
    candidates, so each moment is worked out once. Without a queue or exit hit a score cannot reach a kept candidate's, so
    moments and visits meet through time buckets of those two windows, never through a store's full product. A crowded
    bucket is cut into groups of about ``moments`` moments and ``rows`` visits.
    """
    if not 0.30 < least - margin:
        raise ValueError("candidates without a queue or exit hit could be kept: least - margin must exceed 0.30")
    # Without a queue hit, 0.20 + 0.10 and at most 0.25 for the exit make up the score (four digits, hence 0.0001).
    reach = max(0, min(EXIT_WINDOW, math.ceil(EXIT_WINDOW * (1 - (least - margin - 0.0001 - 0.30) / 0.25))))
    bucket = lambda at: F.floor(at / (max(QUEUE_WINDOW, reach) * 1000000))
    around = lambda c, window: F.coalesce(F.sequence(bucket(F.col(c) - (window + 1) * 1000000), bucket(F.col(c) + (window + 1) * 1000000)), F.array().cast("array<bigint>"))
    sold = materialize(transactions.where("ts IS NOT NULL").select("store_id", _micros(F.col("ts")).alias("moment")).distinct().withColumn("bucket", bucket(F.col("moment"))), "moments")
    visits = people.select(*VISIT, _micros(F.col("entry_time")).alias("entry"), _micros(F.col("exit_time")).alias("left"), _micros(F.col("queue_time")).alias("queue"), F.col("queue_abandoned").alias("lost"))
    visits = visits.withColumn("bucket", F.explode(F.array_distinct(F.concat(around("queue", QUEUE_WINDOW), around("left", reach)))))
    counts = [f.groupBy("store_id", "bucket").agg(F.ceil(F.count("*") / n).alias(c)) for f, n, c in ((sold, moments, "na"), (visits, rows, "nb"))]
    sizes = materialize(counts[0].join(counts[1], ["store_id", "bucket"]), "sizes")
    part = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = sold.join(sizes, ["store_id", "bucket"]).select("store_id", "bucket", part("na", "moment").alias("i"), every("nb").alias("j"), "moment")
    b = visits.join(sizes, ["store_id", "bucket"]).select("store_id", "bucket", every("na").alias("i"), part("nb", "entity_id", "session_no").alias("j"), "entity_id", "session_no", "entry", "left", "queue", "lost")
    group = ["store_id", "bucket", "i", "j"]
    kind = "store_id string, entity_id string, session_no long, entry long, queue long, moment long, score double"
    met = b.groupBy(*group).cogroup(a.groupBy(*group)).applyInArrow(_meeting(least, margin, reach, most), kind)
    return met.select("store_id", "moment", "entity_id", "session_no", "entry", "score", F.when(F.col("queue").isNotNull(), "queue_exit_time").otherwise("session_exit_time").alias("method"))


def _kept(near: DataFrame, by: list[str], least: float, margin: float) -> DataFrame:
    """``near`` rows within ``margin`` of the best of ``by``, with ``candidates`` and ``rank``; none under ``least``."""
    per = Window.partitionBy(*by)
    kept = near.withColumn("_best", F.max("score").over(per)).where((F.col("_best") >= least) & (F.col("_best") - F.col("score") <= margin + 1e-9)).drop("_best")
    order = per.orderBy(F.desc("score"), "entry", "entity_id", "session_no")
    return kept.withColumns({"candidates": F.count("*").over(per), "rank": F.row_number().over(order)})


CORRELATION = ("store_id", "order_id", "entity_id", "session_no", "status", "score", "method", "candidates", "rank")


def _status(kept: DataFrame, *more: str) -> DataFrame:
    status = F.when(F.col("candidates") == 1, "MATCHED").otherwise("AMBIGUOUS").alias("status")
    return kept.select(*[status if c == "status" else F.col(c) for c in CORRELATION], *more)


def _correlate(transactions: DataFrame, people: DataFrame, least: float, margin: float, tell=None) -> DataFrame:
    """The rows of :func:`correlate`; ``tell(kept)`` adds columns to kept candidates (visit, ``moment``), before they are dealt to orders."""
    tell = tell or (lambda kept: kept)
    near = _near(transactions, people, least, margin)
    kept = materialize(_kept(near, ["store_id", "moment"], least, margin), "matches")  # several branches read them
    once = F.count("*").over(Window.partitionBy("store_id", "order_id")) == 1
    sales = transactions.select("store_id", "order_id", _micros(F.col("ts")).alias("moment")).withColumn("_once", once)
    told = tell(kept)
    more = [c for c in told.columns if c not in kept.columns]
    found = _status(sales.where("_once").join(told, ["store_id", "moment"]), *more)
    several = sales.where("NOT _once")
    if not several.isEmpty():  # rows that share an order are judged together
        own = several.join(kept.drop("candidates", "rank"), ["store_id", "moment"])
        found = found.unionByName(_status(tell(_kept(own, ["store_id", "order_id"], least, margin)), *more))
    met = sales.join(kept.select("store_id", "moment").distinct(), ["store_id", "moment"], "left_semi").select("store_id", "order_id").distinct()
    none = lambda frame, method, **own: frame.select("store_id", *[own.get(c, F.lit(None)).cast(t).alias(c) for c, t in (("order_id", "string"), ("entity_id", "string"), ("session_no", "long"))], F.lit("UNMATCHED").alias("status"), F.lit(0.0).alias("score"), F.lit(method).alias("method"), F.lit(0).cast("long").alias("candidates"), F.lit(0).alias("rank"), *[F.lit(None).cast(told.schema[c].dataType).alias(c) for c in more])
    unsold = none(transactions.join(met, ["store_id", "order_id"], "left_anti"), "no_eligible_visitor", order_id=F.col("order_id"))
    # Each moment is an order's, and what it keeps is kept, unless its order has other rows.
    taken = kept if several.isEmpty() else found
    idle = none(people.join(taken.select(*VISIT).distinct(), list(VISIT), "left_anti"), "no_eligible_transaction", entity_id=F.col("entity_id"), session_no=F.col("session_no"))
    return found.unionByName(unsold).unionByName(idle)


def correlate(transactions: DataFrame, visits: DataFrame, events: DataFrame, entities: DataFrame, *, least: float = 0.55, margin: float = 0.10) -> DataFrame:
    """One row for each kept candidate of a transaction, and UNMATCHED rows of either side.

    All candidates within ``margin`` of the best are kept: one is MATCHED, more are
    AMBIGUOUS. A best score under ``least`` leaves the transaction UNMATCHED.
    """
    return _correlate(transactions, materialize(eligible_visits(visits, events, entities), "people"), least, margin)


def matches(transactions: DataFrame, visits: DataFrame, events: DataFrame, entities: DataFrame, *, least: float = 0.55, margin: float = 0.10) -> DataFrame:
    """The MATCHED rows of :func:`correlate`, and no others: the two best candidates of a transaction tell whether it has one.

    Rows that are ambiguous grow with the square of the visits at one time; these do not.
    """
    near = _near(transactions, materialize(eligible_visits(visits, events, entities), "people"), least, margin, most=2)
    best = Window.partitionBy("store_id", "moment").orderBy(F.desc("score"))
    near = near.withColumn("_n", F.row_number().over(best)).where("_n <= 2").drop("_n")
    sales = transactions.select("store_id", "order_id", _micros(F.col("ts")).alias("moment"))
    return _status(_kept(sales.join(near, ["store_id", "moment"]), ["store_id", "order_id"], least, margin).where("candidates = 1"))


def _told(since, least: float) -> Column:
    """The reasons of a candidate; ``since(c)``: whole seconds from the time ``c`` to the purchase."""
    gap = lambda c: F.abs(since(F.col(c)))
    last = since(F.coalesce("exit_time", "entry_time"))
    outside = F.when(since(F.col("entry_time")) < 0, gap("entry_time")).when(last > 0, last).otherwise(0)
    units = lambda c: F.floor(c * 10000 + 0.5) / 10000
    queue, left = (F.coalesce(_decay(gap(c), w), F.lit(0.0)) for c, w in (("queue_time", QUEUE_WINDOW), ("exit_time", EXIT_WINDOW)))
    return F.struct(
        F.lit(True).alias("store_match"), gap("queue_time").alias("queue_seconds_delta"), gap("exit_time").alias("exit_seconds_delta"), outside.cast("long").alias("session_seconds_delta"),
        units(queue).alias("queue_score"), units(left).alias("exit_score"), units(_decay(outside, SESSION_WINDOW)).alias("session_score"),
        F.col("queue_abandoned").alias("has_queue_abandonment"), F.lit(least).alias("minimum_confidence"))


def _ranked() -> Column:
    return F.to_json(F.struct("_told.*", F.col("rank").alias("candidate_rank"), F.col("candidates").alias("candidate_count")))


def _unmatched(least: float) -> Column:
    unsold = F.to_json(F.struct(F.lit("no POS transaction met the confidence threshold").alias("reason"), "store_id"))
    unseen = F.to_json(F.struct(F.lit("no visitor candidate met the confidence threshold").alias("reason"), F.lit(least).alias("minimum_confidence")))
    return F.when(F.col("order_id").isNull(), unsold).otherwise(unseen)


def explanation(kept: DataFrame, transactions: DataFrame, visits: DataFrame, events: DataFrame, entities: DataFrame, *, least: float = 0.55) -> DataFrame:
    """``kept`` with its reasons as JSON text: gaps in seconds, the scores of each, abandonment and rank; why, where nothing matches."""
    people = eligible_visits(visits, events, entities).select(*VISIT, "entry_time", "exit_time", "queue_time", "queue_abandoned")
    facts = kept.where("order_id IS NOT NULL AND entity_id IS NOT NULL").select("store_id", "order_id", *VISIT[1:])
    facts = facts.join(transactions.select("store_id", "order_id", F.col("ts").alias("sold_at")), ["store_id", "order_id"]).join(people, list(VISIT))
    told = _told(lambda c: seconds(c, F.col("sold_at")), least)
    out = kept.join(facts.select("store_id", "order_id", *VISIT[1:], told.alias("_told")), ["store_id", "order_id", *VISIT[1:]], "left")
    return out.withColumn("explanation", F.when(F.col("status") != "UNMATCHED", _ranked()).otherwise(_unmatched(least))).drop("_told")


def explained(transactions: DataFrame, visits: DataFrame, events: DataFrame, entities: DataFrame, *, least: float = 0.55, margin: float = 0.10, kind: str | None = None) -> DataFrame:
    """:func:`correlate` with the :func:`explanation` of each row, parsed as ``kind`` if that is given.

    Purchases of one moment share their candidates' reasons, which are written once; no row is joined by its order again.
    """
    people = materialize(eligible_visits(visits, events, entities), "people")
    own = people.select(*VISIT, "entry_time", "exit_time", "queue_time", "queue_abandoned")
    text = lambda c: F.from_json(c, kind) if kind else c
    since = lambda c: ((F.col("moment") - _micros(c)) / 1000000).cast("long")  # noqa: E731  cut toward zero

    def tell(kept: DataFrame) -> DataFrame:
        told = kept.join(own, list(VISIT)).withColumn("_told", _told(since, least))
        return told.select(*kept.columns, text(_ranked()).alias("explanation"))

    out = _correlate(transactions, people, least, margin, tell)
    return out.withColumn("explanation", F.when(F.col("status") != "UNMATCHED", F.col("explanation")).otherwise(text(_unmatched(least))))


def replace_correlations(correlations: DataFrame, path: str) -> None:
    """Write a full replacement of the correlation table: readers of ``path`` see the old rows or the new ones.

    Runs are numbered and the largest number counts; the run before stays for readers that have begun, older ones go.
    """
    spark = correlations.sparkSession
    now = 1 + (_last_run(spark, path) or 0)
    correlations.write.mode("overwrite").parquet(f"{path}/runs/run={now}")  # a crashed attempt of this number goes
    spark.createDataFrame([(now,)], "run long").coalesce(1).write.mode("append").parquet(f"{path}/current")
    remove(spark, *[f"{path}/runs/{name}" for name in children(spark, f"{path}/runs") if int(name.split("=")[1]) < now - 1])


def _last_run(spark: SparkSession, path: str) -> int | None:
    return spark.read.schema("run long").parquet(f"{path}/current").agg(F.max("run")).first()[0] if children(spark, f"{path}/current") else None


def read_correlations(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last replacement; fails before the first one."""
    last = _last_run(spark, path)
    if last is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/runs/run={last}")
