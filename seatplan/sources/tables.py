"""Typed reads of the nine tables and the ``Tables`` bundle the operators take."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatplan.sources import schemas


@dataclass(frozen=True)
class Tables:
    """The booking database as DataFrames (one per table)."""

    customers: DataFrame
    venues: DataFrame
    staff: DataFrame
    suppliers: DataFrame
    events: DataFrame
    bookings: DataFrame
    booking_audit_log: DataFrame
    event_staff: DataFrame
    event_suppliers: DataFrame

    def with_(self, **changed: DataFrame) -> "Tables":
        return replace(self, **changed)

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def conform(df: DataFrame, schema) -> DataFrame:
    """Select and cast ``df`` to ``schema`` (column order and types)."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def load_tables(spark: SparkSession, path: str, fmt: str = "parquet",
                options: dict | None = None) -> Tables:
    """Read ``{path}/{table}`` for each of the nine tables with its fixed schema.

    ``fmt`` is any file source Spark reads (parquet, orc, csv, json).  No
    schema inference: the declared schema is given to the reader, so a CSV
    read is a single pass and parquet reads prune to the selected columns.
    """
    opts = dict(options or {})
    if fmt == "csv":
        opts.setdefault("header", "true")
    dfs = {}
    for name, schema in schemas.TABLE_SCHEMAS.items():
        reader = spark.read.format(fmt).options(**opts)
        if fmt != "parquet":
            reader = reader.schema(schema)
        dfs[name] = conform(reader.load(f"{path}/{name}"), schema)
    return Tables(**dfs)


def jdbc_reader(spark: SparkSession, url: str, table: str, partition_column: str,
                lower: int, upper: int, num_partitions: int, properties: dict | None = None):
    """Parallel JDBC read of one table, split on an integer key range.

    The MySQL driver jar is not bundled; the caller supplies it on the classpath.
    """
    return (spark.read.format("jdbc")
            .option("url", url).option("dbtable", table)
            .option("partitionColumn", partition_column)
            .option("lowerBound", str(lower)).option("upperBound", str(upper))
            .option("numPartitions", str(num_partitions))
            .options(**(properties or {})).load())
