"""Column functions that Spark lacks or means otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def months_between_boundaries(start: Column, end: Column) -> Column:
    """Month boundaries crossed from start to end: 31 January to 1 February is 1."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def safe_ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    return F.when((b == 0) | b.isNull(), F.lit(otherwise)).otherwise(a.cast("double") / b)


def joined(column: Column, sep: str = "|") -> Column:
    """Distinct values in order, joined; what a STRING_AGG(DISTINCT ...) leaves to chance."""
    return F.array_join(F.array_sort(F.collect_set(column)), sep)


#: Values that one task may sort for a quantile.
SORTED_AT_ONCE = 1_000_000


def order_statistic(df: DataFrame, column: str, rank: int, total: int, at_once: int = SORTED_AT_ONCE) -> float:
    """The value of that rank, from 0, exactly: approximate quantiles narrow the range until one task can sort it."""
    below, size, accuracy = 0, total, 10_000
    while size > at_once:
        p, slack = (rank - below) / size, 2 / accuracy
        low, high = df.agg(F.percentile_approx(column, [max(0.0, p - slack), min(1.0, p + slack)], accuracy)).first()[0]
        c = F.col(column)
        less, within = df.agg(F.count_if(c < low), F.count_if((c >= low) & (c <= high))).first()
        if not below + less <= rank < below + less + within:
            raise ArithmeticError(f"the bracket {low} to {high} misses rank {rank}")
        if low == high:
            return low
        df, below, shrunk = df.where((c >= low) & (c <= high)), below + less, within
        if shrunk == size:  # few values, many of each
            counted = df.groupBy(column).count()
            return counted.agg(F.percentile(column, (rank - below) / max(1, size - 1), F.col("count"))).first()[0]
        size = shrunk
    return df.agg(F.element_at(F.sort_array(F.collect_list(column)), rank - below + 1)).first()[0]


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float], at_once: int = SORTED_AT_ONCE) -> list[list[float]]:
    """Interpolated quantiles of each column's non-null values, as `percentile` gives them, with bounded memory for any size; [] for none.

    Columns of few rows share one aggregate.
    """
    values = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    totals = values.agg(*(F.count(c) for c in columns)).first()
    if max(totals) <= at_once:
        return [list(x) if x is not None else [] for x in values.agg(*(F.percentile(c, shares) for c in columns)).first()]
    out = []
    for c, total in zip(columns, totals, strict=True):
        places = [q * (total - 1) for q in shares] if total else []
        own = values.select(c).where(F.col(c).isNotNull())
        found = {r: order_statistic(own, c, r, total, at_once) for r in sorted({r for x in places for r in (int(x), min(int(x) + 1, total - 1))})}
        out.append([found[int(x)] + (x - int(x)) * (found[min(int(x) + 1, total - 1)] - found[int(x)]) for x in places])
    return out


def quantile_codes(df: DataFrame, columns: dict[str, str], bins: int = 5, descending: tuple[str, ...] = ()) -> DataFrame:
    """Adds codes 1 to bins, named by `columns`, by quantiles as pandas' qcut(duplicates="drop") cuts them: interpolated edges,
    equal ones merged, right-closed, the first bin with its lowest value. All values equal: the middle code. Nulls stay null.
    """
    found = exact_quantiles(df, list(columns), [i / bins for i in range(bins + 1)])
    codes = {}
    for (column, name), edges in zip(columns.items(), (sorted(set(e)) for e in found), strict=True):
        code = F.lit(1)
        for e in edges[1:-1]:
            code = code + (F.col(column) > F.lit(e)).cast("int")
        if column in descending:
            code = bins + 1 - code
        codes[name] = F.when(F.col(column).isNotNull(), F.lit((bins + 1) // 2) if len(edges) < 2 else code).cast("int")
    return df.withColumns(codes)


def rolling(df: DataFrame, value: str, by: list[str], order: str, rows: int = 14, at_least: int = 3) -> DataFrame:
    """Adds the mean and sample deviation of the last `rows` rows of each group, null where there are fewer than at_least."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - rows, 0)
    enough = F.count(value).over(w) >= at_least
    return df.withColumn("rolling_mean", F.when(enough, F.avg(value).over(w))).withColumn("rolling_std", F.when(enough, F.stddev_samp(value).over(w)))


def z_score(value: Column, mean: Column, std: Column) -> Column:
    """0 where it can't be told; a deviation of 0 gives 0 at the mean and infinity beside it."""
    apart = value - mean
    return F.when(apart.isNull() | std.isNull(), F.lit(0.0)).when(std == 0, F.when(apart == 0, F.lit(0.0)).otherwise(F.signum(apart) * F.lit(float("inf")))).otherwise(apart / F.nullif(std, F.lit(0.0)))
