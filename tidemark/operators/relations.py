"""Two series together: alignment at a lag, correlation, behaviour splits, drivers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.stats import finite, fisher_p_sql
from tidemark.functions.vocab import DERIVED_FROM
from tidemark.operators.series import average_ranks


def align(x: DataFrame, y: DataFrame, lag: int | Column = 0) -> DataFrame:
    """Days of ``y`` with the value of ``x`` from ``lag`` days before: (date, x, y)."""
    shifted = x.where(finite("value")).select(F.date_add("date", lag).alias("date"), F.col("value").alias("x"))
    return y.where(finite("value")).select("date", F.col("value").alias("y")).join(shifted, "date")


def all_lags(x: DataFrame, y: DataFrame, x_key: str, y_key: str, max_lag: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Every pair of different series of ``x`` and ``y`` at every lag: (by, x_key, y_key, lag, date, x, y).

    One equi-join on ``by`` and the date for all pairs and lags; each day of ``x`` is repeated once a lag.
    """
    spread = x.where(finite("value")).select(*by, F.col("metric_key").alias(x_key), F.col("value").alias("x"), "date", F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"))
    shifted = spread.withColumn("date", F.date_add("date", F.col("lag")))
    return shifted.join(y.where(finite("value")).select(*by, F.col("metric_key").alias(y_key), "date", F.col("value").alias("y")), [*by, "date"]).where(F.col(x_key) != F.col(y_key))


def pearson(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; null below 3 rows or without variance."""
    n = F.count("*").cast("double")
    sxx = F.var_pop(x) * n
    syy = F.var_pop(y) * n
    sxy = F.covar_pop(x, y) * n
    return F.when((F.count("*") >= 3) & (sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy))


def lagged_correlation(pairs: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """Spearman correlation and its significance for each group of (x, y) rows of at least ``least``."""
    ranked = pairs.withColumn("_rx", average_ranks(pairs, keys, "x")).withColumn("_ry", average_ranks(pairs, keys, "y"))
    found = ranked.groupBy(*keys).agg(F.count("*").alias("n"), pearson("_rx", "_ry").alias("r")).where((F.col("n") >= least) & F.col("r").isNotNull())
    return found.withColumn("p", F.expr(fisher_p_sql("r", "n")))


def best_lag(correlations: DataFrame, keys: list[str]) -> DataFrame:
    """The lag of strongest correlation, the earliest of equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round(F.abs("r"), 12)), "lag")
    return correlations.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def not_derived(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of metrics that are not related by construction, in either direction."""
    related = [(k, x) for k, xs in DERIVED_FROM.items() for x in xs]
    both = pairs.sparkSession.createDataFrame([*related, *((x, k) for k, x in related)], [a, b]).distinct()
    return pairs.join(F.broadcast(both), [a, b], "left_anti")


def behaviour_split(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of ``y`` on days with ``x`` above its upper median, and on the others."""
    ordered_x = F.sort_array(F.collect_list("x"))
    middle = pairs.groupBy(*keys).agg(F.count("*").alias("n"), ordered_x.alias("_x")).where("n >= 12").select(*keys, F.get("_x", F.floor(F.col("n") / 2).cast("int")).alias("threshold"))
    high, low = F.col("x") > F.col("threshold"), F.col("x") <= F.col("threshold")
    found = pairs.join(middle, keys).groupBy(*keys, "threshold").agg(F.avg(F.when(low, F.col("y"))).alias("low_mean"), F.avg(F.when(high, F.col("y"))).alias("high_mean"), F.count_if(low).alias("n_low"), F.count_if(high).alias("n_high"))
    delta = F.col("high_mean") - F.col("low_mean")
    return found.where("n_low >= 4 AND n_high >= 4").withColumn("delta", delta).withColumn("delta_pct", F.try_divide(delta, F.nullif(F.abs("low_mean"), F.lit(0.0))) * 100)


def ridge(x: np.ndarray, y: np.ndarray, strength: float) -> np.ndarray | None:
    """Coefficients without intercept under an absolute penalty; None if it has no solution."""
    try:
        return np.linalg.solve(x.T @ x + strength * np.eye(x.shape[1]), x.T @ y)
    except np.linalg.LinAlgError:
        return None


DRIVERS = "target string, driver string, lag int, correlation double, p double, coefficient double, contribution double, direction string, favourable boolean, n long, r2 double, adj_r2 double"


def fit_drivers(target: str, rows: pd.DataFrame, least: int, per_feature: int, strength: float, higher_better: bool | None) -> pd.DataFrame:
    """One target's model from long rows (date, y, driver, lag, r, p, x)."""
    empty = pd.DataFrame(columns=[c.split()[0] for c in DRIVERS.split(", ")])
    rank = rows.drop_duplicates("driver").assign(a=lambda d: d["r"].abs().round(12)).sort_values(["a", "driver"], ascending=[False, True])
    chosen = rank.head(8)
    if chosen.empty:
        return empty
    wide = rows[rows["driver"].isin(chosen["driver"])].pivot(index="date", columns="driver", values="x")[list(chosen["driver"])].dropna()
    y = rows.drop_duplicates("date").set_index("date")["y"].reindex(wide.index)
    n = len(wide)
    if n < max(least, len(chosen) + 5):
        return empty
    while len(chosen) > 1 and n < len(chosen) * per_feature:
        chosen = chosen.iloc[:-1]
    x = wide[list(chosen["driver"])].to_numpy()
    spread = lambda a: np.where((s := a.std(axis=0, ddof=1)) == 0, 1.0, s)
    x = (x - x.mean(axis=0)) / spread(x)
    z = (y.to_numpy() - y.mean()) / (y.std(ddof=1) or 1.0)
    beta = ridge(x, z, strength)
    if beta is None:
        return empty
    left, whole = float(((z - x @ beta) ** 2).sum()), float((z**2).sum())
    r2 = max(0.0, 1 - left / whole) if whole else 0.0
    free = n - len(beta) - 1
    adjusted = max(0.0, 1 - (1 - r2) * (n - 1) / free) if free > 0 else 0.0
    total = np.abs(beta).sum() or 1.0
    return pd.DataFrame(
        {
            "target": target, "driver": list(chosen["driver"]), "lag": chosen["lag"].astype("int32").to_numpy(), "correlation": chosen["r"].to_numpy(), "p": chosen["p"].to_numpy(),
            "coefficient": beta, "contribution": np.abs(beta) / total, "direction": np.where(beta >= 0, "raises", "lowers"),
            "favourable": [None if higher_better is None else bool((b >= 0) == higher_better) for b in beta], "n": n, "r2": r2, "adj_r2": adjusted,
        }
    )


def drivers(
    series: DataFrame, targets: list[str] | DataFrame | None = None, max_lag: int = 3, least: int = 20, per_feature: int = 8, strength: float = 1.0, higher_better: dict[str, bool | None] | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """Standardised ridge models of each target from the other metrics at their best lags.

    ``targets`` names metrics of ``series`` or holds the targets' own points. With ``by``, say
    the user, only series that share it meet, and each of its values has its own models. Lags and correlations of all pairs come from one join; only each target's complete
    rows of its at most eight strongest candidates reach the model of that target.
    """
    wanted = series if targets is None else targets if isinstance(targets, DataFrame) else series.where(F.col("metric_key").isin(targets))
    pairs = not_derived(all_lags(series, wanted, "driver", "target", max_lag, by), "driver", "target")
    best = best_lag(lagged_correlation(pairs, [*by, "target", "driver", "lag"]), [*by, "target", "driver"]).where(F.col("n") >= least)
    top = Window.partitionBy(*by, "target").orderBy(F.desc(F.round(F.abs("r"), 12)), "driver")
    best = best.withColumn("_k", F.row_number().over(top)).where("_k <= 8").select(*by, "target", "driver", "lag", "r", "p")
    rows = pairs.join(best, [*by, "target", "driver", "lag"])
    sign = higher_better or {}
    schema = StructType([*(series.schema[c] for c in by), *StructType.fromDDL(DRIVERS)])

    def model(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = fit_drivers(key[-1], frame, least, per_feature, strength, sign.get(key[-1]))
        return found.assign(**dict(zip(by, key, strict=False)))[schema.names]

    return rows.groupBy(*by, "target").applyInPandas(model, schema)
