"""Column expressions shared by the operators; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """part / whole rounded half up to four digits by integer arithmetic; 0.0 where whole is 0."""
    n, d = part.cast("long"), whole.cast("long")
    return F.when(d > 0, F.floor((n * 20000 + d) / (d * 2)) / 10000).otherwise(F.lit(0.0))


def mean(total: Column, count: Column) -> Column:
    """total / count as a double; null where there is nothing to average."""
    return F.when(count > 0, total.cast("double") / count.cast("double"))


def seconds(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, truncated toward zero."""
    return F.timestamp_diff("SECOND", start, end)


def plus_seconds(at: Column, amount: Column) -> Column:
    return F.timestamp_add("SECOND", amount.cast("int"), at)


def iso_utc(at: Column) -> Column:
    """ISO-8601 text with ``Z``; the fraction is written only when it is not zero."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(at, "SSSSSS")
    return F.concat(whole, F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z"))


def uuid5(namespace: str, *parts: Column) -> Column:
    """Name-based UUID (SHA-1) of the parts joined by 0x1f."""
    name = F.concat_ws("\x1f", *[p.cast("string") for p in parts])
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    cut = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    return F.concat_ws("-", *cut)


def yes_no(value: Column) -> Column:
    """Null stays null, "Yes" is true, anything else false."""
    return F.when(value.isNotNull(), value == "Yes")


def has_word(text: Column, words: tuple[str, ...]) -> Column:
    """Whether lower-cased text contains one of the words; false for null."""
    return F.coalesce(F.lower(text).rlike("|".join(words)), F.lit(False))


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd ray casting over an array of (x, y) structs."""
    n = F.size(points)

    def crossing(k: Column) -> Column:
        a, b = F.element_at(points, (k + 1).cast("int")), F.element_at(points, (F.when(k == 0, n).otherwise(k)).cast("int"))
        spans = (a["y"] > y) != (b["y"] > y)
        return F.coalesce(spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(spans, b["y"] - a["y"]) + a["x"]), F.lit(False))

    crossings = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), lambda inside, k: inside != crossing(k))
    return F.when(n >= 3, crossings).otherwise(F.lit(False))
