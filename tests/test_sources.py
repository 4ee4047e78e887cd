import tempfile

from seatplan.operators import reports as R
from seatplan.sources.tables import load_tables


def test_load_tables_formats_round_trip(spark, seed):
    for fmt in ("parquet", "csv", "json", "orc"):
        root = tempfile.mkdtemp(prefix=f"seatplan-{fmt}-")
        for name, df in seed.as_dict().items():
            w = df.write.mode("overwrite")
            (w.option("header", "true").csv if fmt == "csv" else getattr(w, fmt))(f"{root}/{name}")
        t = load_tables(spark, root, fmt=fmt)
        assert t.events.schema == seed.events.schema
        got = sorted((r["event_id"], r["booking_total"]) for r in R.event_catalogue(t).collect())
        assert got == [(1, 1), (2, 1), (3, 1)], fmt
