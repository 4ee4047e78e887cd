"""Versioned table snapshots: publish a set of changed tables all-or-nothing.

Parquet has no MERGE and no multi-table transaction.  A job writes each
changed table under ``{root}/v={version}/{table}`` and, last, a one-row commit
marker under ``{root}/_commits/v={version}``.  Readers take the highest
committed version, so a job that dies half-way leaves nothing visible, and
a retried job overwrites its own version directory.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatplan.sources import schemas
from seatplan.sources.tables import Tables, conform


def _vdir(version: int) -> str:
    return f"v={version:012d}"


def write_snapshot(spark: SparkSession, tables: dict[str, DataFrame], root: str,
                   version: int, base_version: int | None = None) -> None:
    """Write ``tables`` as ``version``; unchanged tables are carried by reference."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{_vdir(version)}/{name}")
    marker = {"version": version, "tables": sorted(tables),
              "base_version": base_version,
              "committed_at": dt.datetime.now(dt.timezone.utc).isoformat()}
    (spark.createDataFrame([(json.dumps(marker),)], "marker string")
     .coalesce(1).write.mode("overwrite").text(f"{root}/_commits/{_vdir(version)}"))


def committed_versions(spark: SparkSession, root: str) -> DataFrame:
    m = spark.read.text(f"{root}/_commits/*")
    return m.select(F.from_json("value", "version long, tables array<string>, "
                                "base_version long").alias("m")).select("m.*")


def latest_version(spark: SparkSession, root: str) -> int | None:
    row = committed_versions(spark, root).agg(F.max("version").alias("v")).first()
    return None if row is None else row["v"]


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> Tables:
    """Tables as of ``version`` (default: latest committed).  A table not
    rewritten in a version is read from the newest earlier version that has it."""
    versions = committed_versions(spark, root)
    if version is None:
        version = latest_version(spark, root)
    rows = (versions.filter(F.col("version") <= version)
            .select("version", F.explode("tables").alias("table"))
            .groupBy("table").agg(F.max("version").alias("v")).collect())
    where = {r["table"]: r["v"] for r in rows}
    dfs = {}
    for name, schema in schemas.TABLE_SCHEMAS.items():
        dfs[name] = conform(spark.read.parquet(f"{root}/{_vdir(where[name])}/{name}"), schema)
    return Tables(**dfs)


def publish(spark: SparkSession, new: Tables, root: str, version: int,
            changed: list[str] | None = None) -> None:
    """Write the changed tables of ``new`` as ``version`` of ``root``."""
    d = new.as_dict()
    names = changed or list(d)
    write_snapshot(spark, {n: d[n] for n in names}, root, version)
