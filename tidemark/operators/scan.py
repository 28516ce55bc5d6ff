"""Linear recurrences over whole series as an associative scan of built-in expressions.

A state that follows s[i] = M s[i - 1] + b[i] is a chain of affine maps, and affine maps
compose: after the step of width w every s[i] holds the last 2 w inputs, by adding
M^w s[i - w]. Seventeen steps cover every series of days from 1900 to 2200, the dates
that the store takes; a step that is wider than a series does nothing. One row holds one
series, which is one user's years of one metric. No Python worker runs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 to the power of this is more than the days from 1900 to 2200.
STEPS = 17


def states(columns: Sequence[Column]) -> Column:
    """Arrays of equal length as one array of inputs (x0, x1, ...)."""
    return F.transform(F.arrays_zip(*[c.alias(f"x{i}") for i, c in enumerate(columns)]), lambda v: F.struct(*[v[f"x{i}"].cast("double").alias(f"x{i}") for i in range(len(columns))]))


def moved(column: str, width: int, power: np.ndarray) -> Column:
    """Every state, from ``width`` on with M^width times the state ``width`` before it added."""
    grown = [f"'x{i}', v.x{i}" + "".join(f" + p.x{j} * {float(f)!r}D" for j, f in enumerate(line) if f) for i, line in enumerate(power)]
    later, earlier = f"slice({column}, {width + 1}, size({column}) - {width})", f"slice({column}, 1, size({column}) - {width})"
    step = f"zip_with({later}, {earlier}, (v, p) -> named_struct({', '.join(grown)}))"
    return F.expr(f"CASE WHEN size({column}) <= {width} THEN {column} ELSE concat(slice({column}, 1, {width}), {step}) END")


def scanned(rows: DataFrame, column: str, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """``rows`` with the inputs of ``column`` replaced by the states; the state before the first is 0."""
    power = np.array(matrix, dtype=float)
    for step in range(STEPS):
        rows = rows.withColumn(column, moved(column, 1 << step, power))
        power = power @ power
    return rows


def collected(points: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """One row a series: ``first`` day and the ``days`` (date, value) in order."""
    days = F.array_sort(F.collect_list(F.struct("date", F.col(value).cast("double").alias("value"))))
    return points.groupBy(*keys).agg(F.min("date").alias("first"), days.alias("days"))


def dense_values(days: Column) -> Column:
    """The values of days in order, with a 0 for every calendar day between that is missing."""
    after = F.concat(F.slice(F.transform(days, lambda d: d["date"]), F.lit(2), F.size(days)), F.array(F.lit(None).cast("date")))
    return F.flatten(F.zip_with(days, after, lambda d, n: F.concat(F.array(F.coalesce(d["value"], F.lit(0.0))), F.array_repeat(F.lit(0.0), F.coalesce(F.date_diff(n, d["date"]) - 1, F.lit(0))))))
