"""Time-series operators on keyed buckets: gap filling, rolling scores, spikes, forecasts, event lift.

All work is grouped by the series key, so series are independent partitions; a
rolling frame needs `HISTORY` rows only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 14


def gap_filled(counts: DataFrame, day: str, values: list[str], until: Column, keys: list[str] | None = None) -> DataFrame:
    """A row for each day from a series' first to its last, or to `until` if that is later; absent values are 0."""
    keys = keys or []
    ends = counts.groupBy(*keys).agg(F.min(day).alias("a"), F.greatest(F.max(day), until).alias("b")).where("a is not null")
    days = ends.select(*keys, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias(day))
    filled = days.join(counts, [*keys, day], "left")
    return filled.select(*keys, day, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def empty_series(days: int, until: Column, day: str, values: list[str], spark) -> DataFrame:
    """The series of a query without rows: `days` zeros that end at `until`."""
    at = F.explode(F.sequence(F.date_sub(until, days - 1), until, F.expr("INTERVAL 1 DAY")))
    return spark.range(1).select(at.alias(day), *[F.lit(0).alias(v) for v in values])


def _frame(order: str, keys: list[str], history: int):
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return window.orderBy(order).rowsBetween(-history, -1)


def robust_z(series: DataFrame, order: str, value: str, keys: list[str] | None = None, history: int = HISTORY) -> DataFrame:
    """Adds `z`: distance to the upper median of the rows before, in scaled median absolute deviations.

    Fewer than 3 rows before give 0.  Without spread the deviation is the root mean
    square around the median, and 1 if that is 0 too.
    """
    past = series.withColumn("__h", F.array_sort(F.collect_list(F.col(value).cast("double")).over(_frame(order, keys or [], history))))
    n = F.size("__h")
    upper = lambda a: F.get(a, F.floor(n / 2).cast("int"))
    with_median = past.withColumn("__m", upper(F.col("__h")))
    spread = with_median.withColumn("__d", F.array_sort(F.transform("__h", lambda x: F.abs(x - F.col("__m")))))
    squares = F.aggregate("__d", F.lit(0.0), lambda a, x: a + x * x)
    scale = F.when(upper(F.col("__d")) > 0, 1.4826 * upper(F.col("__d"))).when(squares > 0, F.sqrt(squares / n)).otherwise(1.0)
    return spread.withColumn("z", F.when(n < 3, 0.0).otherwise((F.col(value) - F.col("__m")) / scale)).drop("__h", "__m", "__d")


def rolling_z(series: DataFrame, order: str, value: str, keys: list[str] | None = None, history: int = HISTORY) -> DataFrame:
    """Adds `z`: distance to the mean of the rows before, in population standard deviations (1 if there is none)."""
    over = _frame(order, keys or [], history)
    sd = F.stddev_pop(value).over(over)
    score = (F.col(value) - F.avg(value).over(over)) / F.when(sd > 0, sd).otherwise(1.0)
    return series.withColumn("z", F.when(F.count(value).over(over) < 3, 0.0).otherwise(score))


def spikes(scored: DataFrame, value: str, least_z: float = 2.5, least: int = 3) -> DataFrame:
    return scored.withColumn("is_spike", (F.col("z") >= least_z) & (F.col(value) >= least))


def naive_forecast(series: DataFrame, order: str, value: str, horizon: int, width: float = 1.28) -> DataFrame:
    """(step, forecast, low, high): the mean of the last 7 values, with a band; the same for each step."""
    last = series.orderBy(F.desc(order)).limit(7)
    level = last.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    return level.select(steps, F.round("m", 3).alias("forecast"), F.round(F.greatest(F.lit(0.0), F.col("m") - width * F.col("s")), 3).alias("low"), F.round(F.col("m") + width * F.col("s"), 3).alias("high"))


#: Smoothing weights (level, trend, season) that are tried for each series.
GRID = [(a, b, c) for a in (0.1, 0.2, 0.3, 0.5, 0.8) for b in (0.02, 0.1) for c in (0.1, 0.3)]


#: Bounds of smoothing weights in the search.
LOWEST, HIGHEST = 1e-3, 0.999


def one_step_error(y: list[float], a: float, b: float, c: float) -> float:
    """The squared error of one step ahead of additive smoothing with these weights, as :func:`holt_winters` folds it."""
    n = len(y)
    seasonal = n >= 21
    level, trend, total = sum(y[:7]) / len(y[:7]), 0.0, 0.0
    season = [v - level for v in y[:7]] if seasonal else [0.0] * 7
    for t, x in enumerate(y):
        error = x - (level + trend + season[t % 7])
        level, trend = level + trend + a * error, trend + a * b * error
        if seasonal:
            season[t % 7] += c * (1 - a) * error
        total += error * error
    return total


def simplex(y: list[float], start: tuple[float, float, float], steps: int) -> tuple[float, float, float]:
    """Weights within bounds by a downhill simplex from a start: the worst corner is mirrored, stretched or drawn in, or all shrink to the best."""
    held = lambda p: tuple(min(HIGHEST, max(LOWEST, v)) for v in p)
    error = lambda p: one_step_error(y, *p)
    corners = [held(start)] + [held([v + (0.2 if i == j and v < 0.5 else -0.2 if i == j else 0.0) for j, v in enumerate(start)]) for i in range(3)]
    points = sorted((error(p), p) for p in corners)
    for _ in range(steps):
        if points[-1][0] - points[0][0] <= 1e-10 * (1 + points[0][0]):
            break
        worst = points[-1]
        centre = [sum(p[j] for _, p in points[:-1]) / 3 for j in range(3)]
        at = lambda far: held([m + far * (w - m) for m, w in zip(centre, worst[1], strict=True)])  # noqa: B023, E731
        mirrored = (error(at(-1.0)), at(-1.0))
        if mirrored[0] < points[0][0]:
            stretched = (error(at(-2.0)), at(-2.0))
            points[-1] = min(mirrored, stretched)
        elif mirrored[0] < points[-2][0]:
            points[-1] = mirrored
        else:
            drawn = (error(at(0.5)), at(0.5)) if mirrored[0] >= worst[0] else (error(at(-0.5)), at(-0.5))
            if drawn[0] < min(mirrored[0], worst[0]):
                points[-1] = drawn
            else:
                best = points[0][1]
                moved = [held([(u + v) / 2 for u, v in zip(best, p, strict=True)]) for _, p in points[1:]]
                points = [points[0], *((error(p), p) for p in moved)]
        points.sort()
    return points[0][1]


def _searched(series: DataFrame, steps: int) -> DataFrame:
    """The rows with `a`, `b`, `c` taken further by :func:`simplex` over their list `y`."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [simplex([float(v) for v in y], start, steps) if len(y) >= 7 else tuple(start) for y, *start in zip(rows["y"], rows["a"], rows["b"], rows["c"], strict=True)]
            yield rows.assign(**{c: [f[i] for f in found] for i, c in enumerate("abc")})

    return series.mapInPandas(search, series.schema)


def holt_winters(series: DataFrame, order: str, value: str, keys: list[str], horizon: int, grid: list[tuple[float, float, float]] | None = None, width: float = 1.28, search: int = 0) -> DataFrame:
    """(keys, step, forecast, low, high): additive trend, and a season of 7 from 21 values on.

    A series of buckets is short however many rows it counts, so each key's list is
    folded in one expression, once for each weights of the grid; those with the least
    squared error of one step ahead, the first of equals, are taken.  With `search` a
    simplex of so many steps goes on from there, and its weights are taken if their
    error is less.  Below 7 values, or
    all zero, the level is the mean of the last 7.  The band grows with the root of the step.
    """
    gathered = series.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("y"))
    y, n = F.col("y"), F.size("y")
    seasonal = n >= 21
    first = F.slice(y, 1, F.least(F.lit(7), n))
    base = F.aggregate(first, F.lit(0.0), lambda a, x: a + x) / F.size(first)
    empty = F.array_repeat(F.lit(0.0), 7)
    start = F.struct(base.alias("level"), F.lit(0.0).alias("trend"), F.when(seasonal, F.transform(first, lambda x: x - base)).otherwise(empty).alias("season"), F.lit(0.0).alias("sse"), F.lit(0).alias("t"))

    def fold(w: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            at = F.pmod(s["t"], F.lit(7))
            effect = F.when(seasonal, F.get(s["season"], at)).otherwise(0.0)
            error = x - (s["level"] + s["trend"] + effect)
            level = s["level"] + s["trend"] + w["a"] * error
            trend = s["trend"] + w["a"] * w["b"] * error
            season = F.transform(s["season"], lambda v, i: F.when(seasonal & (i == at), v + w["c"] * (1 - w["a"]) * error).otherwise(v))
            return F.struct(level.alias("level"), trend.alias("trend"), season.alias("season"), (s["sse"] + error * error).alias("sse"), (s["t"] + 1).alias("t"))

        return F.aggregate("y", start, step)

    weights = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for i, (a, b, c) in enumerate(grid or GRID)])
    tried = F.transform(weights, lambda w: F.struct(w["i"].alias("i"), fold(w).alias("f")))
    ranked = F.array_sort(F.transform(tried, lambda s: F.struct(s["f"]["sse"].alias("sse"), s["i"].alias("i"), s["f"].alias("f"))))
    state = gathered.withColumn("f", F.get(ranked, F.lit(0))["f"])
    if search:
        begin = F.get(weights, F.get(ranked, F.lit(0))["i"])
        further = _searched(gathered.select("*", begin["a"].alias("a"), begin["b"].alias("b"), begin["c"].alias("c")), search)
        state = further.withColumn("g", fold(F.struct("a", "b", "c"))).withColumn("f", F.get(ranked, F.lit(0))["f"])
        state = state.withColumn("f", F.when(F.col("g.sse") < F.col("f.sse"), F.col("g")).otherwise(F.col("f"))).drop("g", "a", "b", "c")
    tail = F.slice(y, F.greatest(F.lit(1), n - 6), F.least(F.lit(7), n))
    mean = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail)
    sd = F.sqrt(F.aggregate(tail, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(tail))
    plain = (n < 7) | ~F.exists(y, lambda v: v != 0)
    steps = state.select(*keys, "y", "f", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    h = F.col("step")
    f = F.col("f")
    effect = F.when(seasonal, F.get(f["season"], F.pmod(f["t"] + h - 1, F.lit(7)))).otherwise(0.0)
    centre = F.when(plain, mean).otherwise(f["level"] + f["trend"] * h + effect)
    band = F.when(plain, width * sd).otherwise(width * F.sqrt(f["sse"] / n) * F.sqrt(h))
    return steps.select(*keys, "step", F.round(F.greatest(F.lit(0.0), centre), 3).alias("forecast"), F.round(F.greatest(F.lit(0.0), centre - band), 3).alias("low"), F.round(centre + band, 3).alias("high"))


def event_lift(series: DataFrame, day: str, value: str, events: DataFrame, span: int = 3) -> DataFrame:
    """Adds mean values before and after each event's day `at`, and the lift.

    Each day is joined to the few event days that it can belong to by equality on
    the day, so neither side is paired with all of the other.
    """
    near = events.select("*", F.explode(F.sequence(F.lit(-span), F.lit(span - 1))).alias("offset")).withColumn(day, F.date_add("at", F.col("offset")))
    joined = near.join(series.select(day, F.col(value).cast("double").alias("__v")), day, "left")
    means = joined.groupBy(*events.columns).agg(F.coalesce(F.avg(F.when(F.col("offset") < 0, F.col("__v"))), F.lit(0.0)).alias("b"), F.coalesce(F.avg(F.when(F.col("offset") >= 0, F.col("__v"))), F.lit(0.0)).alias("a"))
    lift = F.when(F.col("b") > 0, (F.col("a") - F.col("b")) / F.col("b")).when(F.col("a") > 0, F.col("a")).otherwise(0.0)
    return means.select(*events.columns, F.round("b", 2).alias("before"), F.round("a", 2).alias("after"), F.round(lift, 3).alias("lift"))


def pointed(series: DataFrame, at: str, many: int = 400) -> DataFrame:
    """The series with `point`, its time as a day, or as a full timestamp from `many` points on."""
    size = series.agg(F.count(F.lit(1)).alias("__points"))
    name = F.when(F.col("__points") >= many, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd"))
    return series.crossJoin(F.broadcast(size)).withColumn("point", name).drop("__points")  # one row
