"""Distributed row numbers and stable row keys.

``row_numbers`` gives each row its place in an order, without a window over
the whole table: rows are cut into ranges, counted per range, and the counts
are prefix-summed, so what one task sorts is one range.

``keyed_rows`` gives each row a key that a second read gives it again.  A
number by partition and position (``monotonically_increasing_id``) is none:
how files are packed into partitions follows the cores that are registered
when a plan is made, so a lost or late executor renumbers the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from seatplan.plans.lineage import materialize, written

#: Plan nodes that pass each row of a scan on once at most.
_ROW_BY_ROW = {"Project", "Filter", "SubqueryAlias"}


def row_numbers(df: DataFrame, order: list[str], out: str, keys: list[str] | None = None,
                keep: list[Column] | None = None) -> DataFrame:
    """``df`` plus ``out``: the place (from 1) of each row in ``order`` among
    the rows of its ``keys`` (which are not null), or among all rows.

    ``keep`` lists the columns that go on (all, if none is given; the keys
    always), so wide columns that only order the rows move once.  Rows equal
    in ``order`` are numbered in any order.  The ranges are checkpointed.
    """
    keys = keys or []
    sort = [*keys, *order]
    ranged = (df.repartitionByRange(*sort).sortWithinPartitions(*sort)
              .withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    if keep is not None:
        ranged = ranged.select(*keys, *keep, "__range", "__at")
    ranged = materialize(ranged)
    # One row per key and range; without keys one per range.
    counts = ranged.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__range", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # Rows of a key lie side by side in a range, so their places there have no gap.
    placed = ranged.join(offsets, [*keys, "__range"])
    return (placed.withColumn(out, F.col("__before") + F.col("__at") - F.col("__first") + 1)
            .drop("__range", "__at", "__n", "__first", "__before"))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _reads_one_parquet_scan(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in _ROW_BY_ROW:
        plan = plan.children().head()
    return plan.nodeName().startswith("LogicalRelation") or plan.nodeName().startswith("Relation")


def keyed_rows(df: DataFrame, key: str = "_row", name: str = "keyed-rows") -> DataFrame:
    """``df`` plus ``key``, a struct (file, at) that is the same whenever the result is read.

    Rows of a Parquet table have the file's path and the row's place in it.
    Anything else is written to the shared folder once with its numbers, so
    use the result for every read.
    """
    if _reads_one_parquet_scan(df):
        try:
            meta = df.metadataColumn("_metadata")
            return df.select("*", F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("at")).alias(key))
        except AnalysisException:  # another file format: no row index
            pass
    number = F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("at"))
    return written(df.withColumn(key, number), name)
