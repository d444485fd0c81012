"""Joins whose result is much larger than their input, spread over tasks by the rows they make."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A join that makes no more rows is left to Spark.
LEAST_ROWS = 16_000_000
#: Rows that one cell makes, and those that one task makes on average.
CELL_ROWS, TASK_ROWS = 2_000_000, 8_000_000
#: Tasks at most; beyond, cells and tasks grow.
MOST_TASKS = 20_000


def _pairs(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[float, float, float, float]:
    """Rows of each side that meet others, pairs, and pairs of the most frequent key."""
    n = lambda df, name: (df.where(" and ".join(f"`{k}` is not null" for k in on)).groupBy(*on) if on else df.groupBy()).agg(F.count("*").cast("double").alias(name))
    a, b = n(left, "_a"), n(right, "_b")
    met = a.join(b, on) if on else a.crossJoin(b)
    made = F.col("_a") * F.col("_b")
    return tuple(x or 0.0 for x in met.agg(F.sum("_a"), F.sum("_b"), F.sum(made), F.max(made)).first())


def _dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
    """Each row in one of ``n`` parts by a hash of its values, once for each of the ``m`` parts of the other side."""
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    part = F.pmod(F.xxhash64(*hashed) if hashed else F.lit(0), F.lit(n)).cast("int")
    return df.withColumn(own, part).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))


def spread_join(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, bool]:
    """Inner join on ``on`` (all pairs if empty), and whether it was spread.

    The pairs are counted first. If there are many, the sides of a key are cut
    into parts and each pair of parts (a cell) meets by a key of its own, so that
    neither a frequent key nor a large side lands in one task, and nothing is
    broadcast. What is shuffled is the pairs' number by the root of a cell's.
    Within a cell few values repeat, which written columns keep small. Equal rows
    stay in one part.
    """
    if len(right.columns) > len(left.columns):  # the rows of the left come in runs: the more columns the better
        left, right = right, left
    a, b, pairs, most = _pairs(left, right, on)
    if pairs <= LEAST_ROWS:
        return (left.join(right, on) if on else left.crossJoin(right)), False
    larger = max(1.0, pairs / TASK_ROWS / MOST_TASKS)
    cells = max(1.0, most / (CELL_ROWS * larger))
    mine = min(max(1, round(math.sqrt(cells * a / b))), math.ceil(cells))
    theirs = math.ceil(cells / mine)
    keys = [*on, "_mine", "_theirs"]
    tasks = math.ceil(pairs / (TASK_ROWS * larger))
    x = _dealt(left, "_mine", mine, "_theirs", theirs).repartition(tasks, *keys)
    y = _dealt(right, "_theirs", theirs, "_mine", mine).repartition(tasks, *keys)
    return x.join(y.hint("merge"), keys).drop("_mine", "_theirs"), True
