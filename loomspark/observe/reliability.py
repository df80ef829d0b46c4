"""Reliability from run history: plain functions for few runs, DataFrames for many."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import Graph


def nearest_rank(values: list[float], q: float) -> float | None:
    """The value whose index is q * (n - 1), rounded half to even."""
    ordered = sorted(values)
    return ordered[round(q * (len(ordered) - 1))] if ordered else None


def _when(text: str) -> dt.datetime:
    t = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    return t if t.tzinfo else t.replace(tzinfo=dt.UTC)


def within(runs: list[dict[str, Any]], days: float, now: dt.datetime | None = None) -> list[dict[str, Any]]:
    now = now or dt.datetime.now(dt.UTC)
    return [r for r in runs if now - dt.timedelta(days=days) <= _when(r["started_at"]) <= now]


def success_rate(statuses: list[str]) -> float | None:
    """Share of successes among what ran; None when nothing did."""
    ran = [s for s in statuses if s in ("success", "failed", "partial")]
    return sum(s == "success" for s in ran) / len(ran) if ran else None


def model_history(runs: list[dict[str, Any]], name: str, limit: int = 20) -> dict[str, Any]:
    rows = [{"run_id": r["run_id"], "started_at": r["started_at"], **m} for r in runs for m in r["models"] if m["name"] == name][:limit]
    times = [m["elapsed_seconds"] for m in rows if m["status"] == "success"]
    return {"model": name, "runs": rows, "p50": nearest_rank(times, 0.5), "p95": nearest_rank(times, 0.95), "success_rate": success_rate([m["status"] for m in rows])}


def portfolio(graph: Graph, runs: list[dict[str, Any]], now: dt.datetime | None = None, days: float = 30) -> list[dict[str, Any]]:
    """Each model's last status and age, and whether it breaks its freshness or success target."""
    now = now or dt.datetime.now(dt.UTC)
    recent, out = within(runs, days, now), []
    for name in sorted(graph.models):
        m = graph.models[name]
        every = [(_when(r["started_at"]), x) for r in runs for x in r["models"] if x["name"] == name]
        last_ok = max((t for t, x in every if x["status"] == "success"), default=None)
        age = (now - last_ok).total_seconds() / 3600 if last_ok else None
        rate = success_rate([x["status"] for r in recent for x in r["models"] if x["name"] == name])
        sla = m.governance.sla
        fresh, target = sla.get("freshness_hours"), sla.get("success_rate_target")
        out.append(
            {
                "model": name,
                "owner": m.governance.owner,
                "team": m.governance.team,
                "criticality": m.governance.criticality,
                "last_status": every[0][1]["status"] if every else None,
                "hours_since_success": age,
                "success_rate": rate,
                "freshness_breach": fresh is not None and (age is None or age > fresh),
                "success_breach": target is not None and rate is not None and rate < target,
                "consumers": m.governance.consumers,
            }
        )
    return out


def reliability(graph: Graph, runs: list[dict[str, Any]], windows: tuple[int, ...] = (1, 7, 30), now: dt.datetime | None = None, slowest: int = 10) -> dict[str, Any]:
    """Attainment by tier and window (each run counts by its own date), the slowest models, and errors by bucket."""
    from .diagnostics import run_diagnostics

    tiers: dict[str, dict[str, float | None]] = defaultdict(dict)
    for days in windows:
        by_tier = defaultdict(list)
        for r in within(runs, days, now):
            for x in r["models"]:
                tier = graph.models[x["name"]].governance.criticality if x["name"] in graph.models else None
                by_tier[tier or "untiered"].append(x["status"])
        for tier in {m.governance.criticality or "untiered" for m in graph.models.values()}:
            tiers[tier][f"{days}d"] = success_rate(by_tier[tier])
    times, buckets = defaultdict(list), defaultdict(int)
    for r in runs:
        for x in r["models"]:
            if x["status"] == "success":
                times[x["name"]].append(x["elapsed_seconds"])
        for k, n in run_diagnostics(r)["buckets"].items():
            buckets[k] += n
    ranked = sorted(((nearest_rank(v, 0.95), k) for k, v in times.items()), key=lambda x: (-x[0], x[1]))[:slowest]
    return {"tiers": dict(tiers), "slowest": [{"model": k, "p95": v} for v, k in ranked], "buckets": dict(buckets)}


def model_rows(history: DataFrame) -> DataFrame:
    """A row for each model of each run, from history.runs_frame()."""
    return history.select("run_id", F.to_timestamp("started_at").alias("started_at"), F.explode("models").alias("m")).select("run_id", "started_at", "m.name", "m.status", "m.elapsed_seconds", "m.row_count", "m.error")


def summary(rows: DataFrame) -> DataFrame:
    """By model: runs, success rate, median and 95th percentile (nearest rank) of the seconds of successes, last status."""
    ran = F.col("status").isin("success", "failed", "partial")
    ok = F.col("status") == "success"
    own = Window.partitionBy("name", ok)
    ranked = rows.withColumn("__at", F.row_number().over(own.orderBy("elapsed_seconds")) - 1).withColumn("__n", F.count(F.lit(1)).over(own))
    at = lambda q: F.max(F.when(ok & (F.col("__at") == F.bround(F.lit(q) * (F.col("__n") - 1), 0)), F.col("elapsed_seconds")))
    return ranked.groupBy("name").agg(
        F.count(F.lit(1)).alias("runs"),
        (F.count_if(ok) / F.nullif(F.count_if(ran), F.lit(0))).alias("success_rate"),
        at(0.5).alias("p50"),
        at(0.95).alias("p95"),
        F.max_by("status", "started_at").alias("last_status"),
    )


def latest(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("name").orderBy(F.col("started_at").desc(), F.col("run_id"))
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
