"""Days against intervals of days, as equality joins.

An interval is the union of a few aligned blocks whose lengths are powers of two, at most
two of each length; a day lies in one block of each length. Both sides name their blocks by
(level, number), so a day meets exactly the intervals that hold it: each pair once, without
a nested loop, and a long or open interval costs as little as a short one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Days are below two to the power of LEVELS: year 11,000 and later are out of range.
LEVELS = 22
LAST_DAY = (1 << LEVELS) - 1


def day_blocks(day: Column) -> Column:
    """The block of each level that holds a day; none for a NULL day or one out of range."""
    levels = F.sequence(F.lit(0), F.lit(LEVELS))
    found = F.transform(levels, lambda level: F.struct(level.alias("level"), (day / F.pow(F.lit(2.0), level)).cast("long").alias("number")))
    return F.when(day.between(0, LAST_DAY), found)


def interval_blocks(first: Column, last: Column) -> Column:
    """The blocks of the days from ``first`` to ``last``, both included; clipped to the range.

    The walk of a segment tree from below: at each level an odd left end and an even right
    end are blocks, and what is between goes up.
    """
    low, high = F.greatest(first.cast("long"), F.lit(0)), F.least(last.cast("long"), F.lit(LAST_DAY)) + 1
    none = F.array().cast("array<struct<level:int,number:bigint>>")

    def step(state: Column, level: Column) -> Column:
        left, right = state["left"], state["right"]
        open_ = left < right

        def block(number: Column) -> Column:
            return F.array(F.struct(level.cast("int").alias("level"), number.alias("number")))

        at_left, at_right = open_ & (left % 2 == 1), open_ & (right % 2 == 1)
        taken = F.concat(state["blocks"], F.when(at_left, block(left)).otherwise(none), F.when(at_right, block(right - 1)).otherwise(none))
        return F.struct(F.floor((left + at_left.cast("long")) / 2).cast("long").alias("left"), F.floor((right - at_right.cast("long")) / 2).cast("long").alias("right"),
                        taken.alias("blocks"))

    walk = F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), F.struct(low.alias("left"), high.alias("right"), none.alias("blocks")), step, lambda s: s["blocks"])
    return F.when(first.isNotNull() & last.isNotNull() & (low < high), walk)


def containing(days: DataFrame, day: str, intervals: DataFrame, first: str, last: str) -> DataFrame:
    """Every pair of a row of ``days`` and a row of ``intervals`` whose range holds its day.
    Rows with a NULL day or bound meet nothing. Column names of the two sides must differ."""
    left = days.withColumn("__b", F.explode(day_blocks(F.col(day)))).select(*days.columns, "__b.level", "__b.number")
    right = intervals.withColumn("__b", F.explode(interval_blocks(F.col(first), F.col(last)))).select(*intervals.columns, "__b.level", "__b.number")
    return left.join(right, ["level", "number"]).drop("level", "number")
