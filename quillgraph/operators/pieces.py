"""Ordered folds of busy keys without their histories in one row.

What events do to a key is a function, and functions compose: a run of events is one function again, whatever came before
it. Two sorts are enough here. A register keeps the last (or first) writer by the order of events, or a count; it is a plain
aggregate, so tasks combine it before they shuffle. A number that is multiplied, raised and capped is changed by maps
``x -> min(cap, times * x + plus)``; two such maps in a row are one such map, and one with ``times`` 0 sets the number anew.

So events are folded in pieces: an hour of a key (rows without a time, by blocks of positions), then the pieces of a key.
A key with half of all events is spread over its hours, and no row holds more than an hour of one key or one entry an hour.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for no cap; finite, so that a map that sets a number anew may be composed with it.
NO_CAP = 1e300
_MAP = "struct<times:double,plus:double,cap:double>"
EPOCH = "1970-01-01"


@dataclass(frozen=True)
class Register:
    """An aggregate of events, and how the results of pieces are put together."""

    name: str
    of_events: Column
    of_pieces: Column


def _order() -> Column:
    return F.struct("_at", "_pos")


def last(name: str, value: Column, when: Column) -> Register:
    """The value of the last event that ``when`` holds for, null values included."""
    return Register(name, F.max(F.when(when, F.struct(_order().alias("at"), value.alias("value")))).alias(name), F.max(name).alias(name))


def first(name: str, value: Column, when: Column) -> Register:
    return Register(name, F.min(F.when(when, F.struct(_order().alias("at"), value.alias("value")))).alias(name), F.min(name).alias(name))


def count(name: str, when: Column) -> Register:
    return Register(name, F.count(F.when(when, 1)).alias(name), F.sum(name).alias(name))


def mapped(times: Column | float = 1.0, plus: Column | float = 0.0, cap: float = NO_CAP) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.struct(lit(times).alias("times"), lit(plus).alias("plus"), F.lit(float(cap)).alias("cap")).cast(_MAP)


def set_to(value: Column | float) -> Column:
    return mapped(0.0, value)


def composed(earlier: Column, later: Column) -> Column:
    """Both maps in a row as one."""
    cap = F.least(later["cap"], F.when(later["times"] == 0, later["plus"]).otherwise(later["times"] * earlier["cap"] + later["plus"]))
    return F.struct((earlier["times"] * later["times"]).alias("times"), (later["times"] * earlier["plus"] + later["plus"]).alias("plus"), cap.alias("cap")).cast(_MAP)


def applied(step: Column, start: Column | float) -> Column:
    return F.least(step["cap"], step["times"] * (start if isinstance(start, Column) else F.lit(float(start))) + step["plus"])


def _chained(rows: str) -> Column:
    """The maps of sorted rows as one (of none: the map that changes nothing)."""
    return F.aggregate(F.array_sort(rows), mapped(), lambda s, x: composed(s, x["step"]))


def fold(events: DataFrame, by: str, at: str, pos: str, registers: list[Register], step: Column | None = None, hours: int = 1, block: int = 1 << 16) -> DataFrame:
    """(by, registers..., step): each register of a key (structs of ``at`` and ``value``; counts are plain), and the map that all its steps make.

    ``step`` is the map of an event, null where it has none. Events are ordered by time, then position; a null time comes
    first. Rows with a null key are left out.
    """
    rows = events.where(F.col(by).isNotNull()).withColumn("_at", F.coalesce(F.col(at).cast("timestamp"), F.lit(EPOCH).cast("timestamp"))).withColumn("_pos", F.col(pos))
    if step is None:
        return rows.groupBy(by).agg(*[r.of_events for r in registers])
    rows = rows.withColumn("_step", step)
    hour = F.floor(F.unix_micros("_at") / (hours * 3_600_000_000)).alias("_hour")
    untimed = F.when(F.col("_at") == F.lit(EPOCH).cast("timestamp"), F.floor(F.col("_pos") / block)).otherwise(F.lit(1 << 62)).cast("long").alias("_block")
    listed = F.collect_list(F.when(F.col("_step").isNotNull(), F.struct("_at", "_pos", F.col("_step").alias("step"))))
    parts = rows.groupBy(by, hour, untimed).agg(*[r.of_events for r in registers], listed.alias("_steps"))
    parts = parts.withColumn("_steps", F.when(F.size("_steps") > 0, F.struct("_hour", "_block", _chained("_steps").alias("step"))))
    whole = parts.groupBy(by).agg(*[r.of_pieces for r in registers], F.collect_list("_steps").alias("_steps"))
    return whole.select(by, *[r.name for r in registers], _chained("_steps").alias("step"))
