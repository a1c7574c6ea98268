"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1000    # at most so many keys are broadcast
LEAST = 1000  # rows of a key that is hot at least


def hot_limit(total: int, hot: int = HOT, least: int = LEAST) -> int:
    """Fewer than ``hot`` keys can each have more rows than this, if all together have ``total``."""
    return max(least, total // hot)


def join_split(rows: DataFrame, table: DataFrame, on: list[str], weight: str, limit: int) -> DataFrame:
    """``rows`` inner join ``table``, which has one row a key and in ``weight`` at least the number of ``rows`` of the key.

    Keys with more than ``limit`` rows are broadcast, so none of their rows is shuffled; with hot_limit() there are fewer
    than HOT of them, whatever the data.  The others meet by a shuffle, of ``limit`` rows a key at most.  ``weight`` is not
    kept.  ``table`` should be a written one, and ``rows`` cheap to make: each is read twice if there is a hot key."""
    if table.where(F.col(weight) > limit).isEmpty():
        return rows.join(table.drop(weight), on)
    hot = F.broadcast(table.where(F.col(weight) > limit).drop(weight))
    rest = rows.join(hot.select(*on), on, "left_anti").join(table.where(F.col(weight) <= limit).drop(weight), on)
    return rows.join(hot, on).unionByName(rest)
