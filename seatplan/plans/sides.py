"""Join sides chosen on counted rows.

A size estimate does not see what an explode or a well-compressed file holds,
so Catalyst may broadcast a side that grows with the data.  Here a side is
stored, counted and measured first: within the bounds it is broadcast, beyond
them the join is a merge join (split by AQE where a key is skewed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatplan.plans.lineage import materialize

#: Bounds of a broadcast side: rows, and bytes of its strings.
ROWS, BYTES = 100_000, 16 << 20


def counted_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` checkpointed, hinted as a broadcast side if it is proven small, else for a merge join."""
    kept = materialize(df)
    texts = [F.octet_length(f.name) for f in kept.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    size = sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(0).cast("long"))
    n, total = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(kept) if n <= (ROWS if rows is None else rows) and total <= BYTES else kept.hint("merge")
