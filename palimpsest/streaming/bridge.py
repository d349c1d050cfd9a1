"""A stream of (key, value) rows into a store: one commit for each micro-batch, applied once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import Store
from ..sources.files import Files, NameTaken


def write_stream(rows: DataFrame, store: Store, checkpoint: str, order: str | None = None, **trigger) -> StreamingQuery:
    """Start a query that writes every micro-batch by `put_frame`. A batch that is sent again after a failure is skipped if its
    commit was recorded; if not, its rows are written again at a new time, with the same result for readers. Streams are told
    apart by the query's identifier, which its checkpoint holds, so any number of them may write into one store."""
    place = Files(store.spark, checkpoint)

    def apply(batch: DataFrame, number: int) -> None:
        folder, name = f"streams/{json.loads(place.read('metadata'))['id']}", f"{number:012d}.json"
        if name in store.files.names(folder):
            return
        ts = store.put_frame(batch, order)
        try:
            store.files.publish(f"{folder}/{name}", json.dumps({"batch": number, "ts": ts}).encode())
        except NameTaken:
            pass

    query = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (query.trigger(**trigger) if trigger else query).start()
