"""Chains of stages that are set up by a configuration, resume where they were, and sum up while they write.

A stage is a function of a DataFrame and its settings.  Its fingerprint is made of its name, its settings and the fingerprints of
what it comes after, the first one's of the input's; its result is kept in a folder of that name.  So a killed run goes on
after its last complete stage, and a changed setting runs again only what depends on it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

Run = Callable[[DataFrame, dict], DataFrame]


@dataclass(frozen=True)
class Stage:
    """after: the stage whose result it takes; None for the one before it in the chain."""

    name: str
    run: Run
    settings: dict = field(default_factory=dict)
    summary: dict[str, Column] = field(default_factory=dict)
    after: str | None = None


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def fingerprint(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def chosen(stages: list[Stage], names: list[str] | None) -> list[Stage]:
    """The stages of these names (all without), in the chain's order, each after the last chosen one before it if its own is not
    among them.  A name that is no stage's is an error."""
    if names is None:
        return stages
    unknown = set(names) - {s.name for s in stages}
    if unknown:
        raise ValueError(f"no such stages: {', '.join(sorted(unknown))}")
    return [s for s in stages if s.name in names]


def plan(stages: list[Stage], version: str) -> dict[str, tuple[str, str | None]]:
    """Each stage's fingerprint, and the name of the stage it takes its rows from."""
    out: dict[str, tuple[str, str | None]] = {}
    before: str | None = None
    for s in stages:
        source = s.after if s.after in out else before
        out[s.name] = fingerprint(s.name, s.settings, out[source][0] if source else version), source
        before = s.name
    return out


def run(rows: DataFrame, stages: list[Stage], folder: str, version: str = "", only: list[str] | None = None, tidy: bool = False) -> tuple[DataFrame, dict[str, dict]]:
    """The last stage's rows, read from the folder, and each stage's summary.

    version tells one input from another.  A stage whose folder is complete is read, not run; its summary was kept beside it.  tidy: at
    the end every folder of the chain's but the last stage's goes, also those of former settings."""
    spark = rows.sparkSession
    stages = chosen(stages, only)
    marks = plan(stages, version)
    results: dict[str, DataFrame] = {}
    summaries: dict[str, dict] = {}
    for s in stages:
        mark, source = marks[s.name]
        path = f"{folder}/{s.name}-{mark}"
        if not _exists(spark, f"{path}/_SUCCESS") or not _exists(spark, f"{path}.summary/_SUCCESS"):
            summaries[s.name] = _write(s.run(results[source] if source else rows, dict(s.settings)), path, s.summary)
            spark.createDataFrame([(json.dumps(summaries[s.name], default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.summary")
        else:
            summaries[s.name] = json.loads(spark.read.text(f"{path}.summary").first()[0])
        results[s.name] = spark.read.parquet(path)
    if tidy and stages:
        _clean(spark, folder, {s.name for s in stages}, f"{stages[-1].name}-{marks[stages[-1].name][0]}")
    return (results[stages[-1].name] if stages else rows), summaries


def _write(rows: DataFrame, path: str, summary: dict[str, Column]) -> dict:
    """Writes rows; n_rows and the summary's aggregates are observed meanwhile, without another pass."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), *(c.alias(n) for n, c in summary.items())).write.mode("overwrite").parquet(path)
    return dict(seen.get)


def _clean(spark: SparkSession, folder: str, names: set[str], keep: str) -> None:
    fs, at = _fs(spark, folder)
    for f in fs.listStatus(at):
        name = f.getPath().getName()
        if name.removesuffix(".summary").rpartition("-")[0] in names and name.removesuffix(".summary") != keep:
            fs.delete(f.getPath(), True)


def shares(column: str, values: list[str]) -> dict[str, Column]:
    """Aggregates: the share of rows of each value."""
    return {f"{column}_{v}": F.avg(F.when(F.col(column) == v, 1.0).otherwise(0.0)) for v in values}


def spread(column: str) -> dict[str, Column]:
    """Aggregates: least, mean and greatest."""
    return {f"{column}_{n}": f(column) for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))}


def configured(spark: SparkSession, path: str, sources: dict[str, Callable[[SparkSession, dict], DataFrame]], stages: Callable[[dict], list[Stage]], folder: str) -> dict[str, dict[str, dict]]:
    """Runs the datasets that a JSON file lists, each an object with source, input, output and settings, and returns their summaries by
    output.  The file is read by Spark, so it may lie wherever data do; what is done already is not done again."""
    listed = json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))  # one file
    out = {}
    for entry in listed:
        if entry["source"] not in sources:
            raise ValueError(f"no such source: {entry['source']}")
        version = fingerprint(entry)
        rows, out[entry["output"]] = run(sources[entry["source"]](spark, entry), stages(entry), f"{folder}/{version}", version)
        done = fingerprint(version, plan(stages(entry), version))
        mark = f"{entry['output']}.{done}"
        if not _exists(spark, f"{mark}/_SUCCESS"):
            rows.write.mode("overwrite").parquet(entry["output"])
            spark.range(0).write.mode("overwrite").parquet(mark)
    return out
