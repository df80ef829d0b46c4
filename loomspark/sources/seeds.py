"""Seed files: a CSV becomes a table, a directory of parquet slices a view with typed columns."""

from __future__ import annotations

import json
import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .inference import Inference, infer_types, native, spark_type, typed


@dataclass
class Seed:
    name: str
    path: Path
    format: str  # csv or parquet
    overrides: dict[str, str] = field(default_factory=dict)


def discover(root: Path, overrides: dict[str, dict[str, str]] | None = None) -> list[Seed]:
    """Seeds below root, by name. A directory's name is its path with dots; it goes before a CSV of the same name."""
    found: dict[str, Seed] = {}
    if not root.is_dir():
        return []
    for folder, dirs, files in os.walk(root, followlinks=True):
        dirs.sort()
        at = Path(folder)
        if any(f.endswith(".parquet") for f in files):
            name = ".".join(at.relative_to(root).parts) or root.name
            found[name] = Seed(name, at, "parquet")
        for f in sorted(files):
            if f.endswith(".csv") and Path(f).stem not in found:
                found[Path(f).stem] = Seed(Path(f).stem, at / f, "csv")
    for name, seed in found.items():
        seed.overrides = (overrides or {}).get(name, {})
    return sorted(found.values(), key=lambda s: s.name)


def read_seed(spark: SparkSession, seed: Seed) -> tuple[DataFrame, Inference | None]:
    if seed.format == "csv":
        df = spark.read.csv(str(seed.path), header=True, inferSchema=True)
        wide = {f.name: "BIGINT" for f in df.schema if isinstance(f.dataType, T.IntegerType)}
        if seed.overrides:  # from the text itself: an inferred number would have lost its form
            raw = spark.read.csv(str(seed.path), header=True)
            kinds = {f.name: native(f.dataType) for f in df.schema} | wide | seed.overrides
            return typed(raw, kinds), None
        return typed(df, {f.name: native(f.dataType) for f in df.schema} | wide), None
    df = spark.read.parquet(str(seed.path))
    found = infer_types(df, seed.overrides)
    return typed(df, found.types), found


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with every column as text."""
    return spark.read.csv(path, header=True)


def load(backend, seeds: list[Seed], reuse: bool = False, threads: int = 4) -> dict[str, int | None]:
    """Seeds as tables and views of the backend; rows of those loaded, None where an existing one is reused or is a view."""

    def one(seed: Seed) -> tuple[str, int | None]:
        if reuse and backend.exists(seed.name):
            return seed.name, None
        df, _ = read_seed(backend.spark, seed)
        if seed.format == "csv":
            return seed.name, backend.write_table(seed.name, df)
        backend.write_view_of(seed.name, df, f"parquet.`{seed.path}`")
        return seed.name, None

    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        return dict(pool.map(one, seeds))


def signature(seed: Seed) -> list:
    files = [seed.path] if seed.path.is_file() else sorted(seed.path.glob("*.parquet"))
    return [[str(f), f.stat().st_mtime_ns, f.stat().st_size] for f in files]


def schemas(spark: SparkSession, seeds: list[Seed], cache: Path | None = None) -> dict[str, dict[str, str]]:
    """Column types by seed, from parquet footers and overrides; the cache holds as long as the files are the same."""
    known = json.loads(cache.read_text()) if cache and cache.is_file() else {}
    out, fresh = {}, {}
    for s in seeds:
        sign = signature(s)
        if s.format == "parquet":
            old = known.get(s.name, {})
            kinds = old["types"] if old.get("files") == sign else {f.name: native(f.dataType) for f in spark.read.parquet(str(s.path)).schema}
            fresh[s.name] = {"files": sign, "types": kinds}
        else:
            kinds = {}
        kinds = {**kinds, **s.overrides}
        if kinds:
            out[s.name] = kinds
    if cache:
        cache.parent.mkdir(parents=True, exist_ok=True)
        cache.write_text(json.dumps(fresh))
    return out


__all__ = ["Seed", "discover", "load", "read_seed", "read_text", "schemas", "spark_type"]
