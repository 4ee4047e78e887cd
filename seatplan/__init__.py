"""seatplan: event-booking analytics and set-based booking jobs on Spark.

Every public function takes DataFrames (or a ``Tables`` bundle) and returns
DataFrames; nothing is collected to the driver inside an operator.
"""

from seatplan.sources.tables import Tables, load_tables

__all__ = ["Tables", "load_tables"]
