"""How tables of one row or more for each key of the input meet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(rows: DataFrame) -> DataFrame:
    """`rows` as a side of a join that deals both sides by their keys and sorts them, whatever their sizes.

    A side that grows with the input must not be broadcast: Spark chooses by compressed bytes, and exploded rows of
    hours, clauses or names compress to a hundredth of what they take in the driver's memory.
    """
    return rows.hint("merge")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """`rows` dealt by their keys to as many tasks as a shuffle has, for work that costs more than reading: a table of few
    bytes is read by few tasks, and Spark would join small parts again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
