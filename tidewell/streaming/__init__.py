"""Extension: key-value changes that arrive as a stream.

The engine's queries are all batch queries; this is an addition beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators.kv import Store


def append_changes(changes: DataFrame, store: Store, name: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of change rows to a table. Reading takes the last write of each
    cell, so a batch that is written twice after a failure changes nothing."""
    return changes.writeStream.foreachBatch(lambda df, _: store.put(name, df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
