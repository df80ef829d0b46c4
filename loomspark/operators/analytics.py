"""Customer and revenue analytics, over plain DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import months_between_boundaries, quantile_codes, rolling, safe_ratio, z_score

#: Tiers of an RFM score 100 r + 10 f + m, highest first.
RFM_TIERS = ((454, "champion"), (344, "loyal"), (234, "potential"), (123, "at_risk"))
RFM_REST = "hibernating"
#: Expected remaining months by segment.
LTV_MONTHS = {"vip": 36, "loyal": 24, "regular": 18, "at_risk": 9, "lost": 3}


def rfm_tier(score: Column) -> Column:
    out = F.lit(RFM_REST)
    for least, name in reversed(RFM_TIERS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def rfm(inputs: DataFrame, key: str, recency: str, frequency: str, monetary: str) -> DataFrame:
    """Codes 1 to 5 for recency (low is good), frequency and value, the score and its tier."""
    df = quantile_codes(inputs, {recency: "r", frequency: "f", monetary: "m"}, 5, descending=(recency,))
    df = df.withColumn("rfm_score", F.col("r") * 100 + F.col("f") * 10 + F.col("m"))
    return df.withColumn("tier", rfm_tier(F.col("rfm_score"))).select(key, recency, frequency, monetary, "r", "f", "m", "rfm_score", "tier")


def anomalies(daily: DataFrame, value: str, by: list[str], day: str, rows: int = 14, at_least: int = 3, limit: float = 2.0) -> DataFrame:
    """Days whose value is `limit` deviations or more from the rolling mean."""
    df = rolling(daily, value, by, day, rows, at_least)
    df = df.withColumn("z", z_score(F.col(value), F.col("rolling_mean"), F.col("rolling_std")))
    return df.withColumn("is_anomaly", F.abs("z") >= limit)


def cohorts(first: DataFrame, orders: DataFrame, key: str, cohort: str, month: str, by: list[str]) -> DataFrame:
    """Customers of each cohort seen in each later month, and their share of the cohort.

    first: key, cohort month and the columns `by`; orders: key and month.
    """
    sizes = first.groupBy(cohort, *by).agg(F.countDistinct(key).alias("cohort_size"))
    seen = first.join(orders.select(key, month).distinct(), key).where(F.col(month) >= F.col(cohort))
    active = seen.groupBy(cohort, *by, month).agg(F.countDistinct(key).alias("active"))
    out = active.join(sizes, [cohort, *by])
    return out.withColumn("months", months_between_boundaries(F.col(cohort), F.col(month))).withColumn("retention", safe_ratio(F.col("active"), F.col("cohort_size")))


def segment(frequency: Column, monetary: Column, in_window: Column, recency: Column, vip_orders: int, vip_spend: float) -> Column:
    """vip, loyal, regular, at_risk or lost; the first that fits."""
    vip = (F.coalesce(frequency, F.lit(0)) >= vip_orders) & (F.coalesce(monetary, F.lit(0.0)) >= vip_spend)
    return (
        F.when(vip, "vip")
        .when(in_window >= 3, "loyal")
        .when(in_window.isNotNull(), "regular")
        .when(recency <= 365, "at_risk")
        .otherwise("lost")
    )


def lifetime_value(customers: DataFrame, segment_column: str, orders: str, revenue: str, digits: int = 5) -> DataFrame:
    """Average order value times half the orders, over the months the segment is expected to stay."""
    months = F.create_map(*(x for k, v in LTV_MONTHS.items() for x in (F.lit(k), F.lit(v))))
    df = customers.withColumn("expected_months", F.coalesce(months[F.col(segment_column)], F.lit(LTV_MONTHS["lost"])))
    df = df.withColumn("aov", safe_ratio(F.col(revenue), F.col(orders)))
    return df.withColumn("ltv", F.round(F.col("aov") * F.col(orders) / 2 * F.col("expected_months") / 12, digits))
