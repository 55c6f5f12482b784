"""Incremental ingest: a stream of posted documents, appended to the store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import ingest
from ..sources.store import Change, Store


def start_ingest(posted: DataFrame, store: Store, checkpoint: str, once: bool = True, order: str | None = None) -> StreamingQuery:
    """Append documents of new addresses from the stream ``posted`` (``url``, ``text``; ``order`` tells what was posted first).

    A batch that runs again after a failure finds its addresses known and adds
    nothing. An id is 60 bits of the address's hash, so no batch asks for the
    greatest one and writers need not agree.
    """
    def append(batch: DataFrame, number: int) -> None:
        def work(c: Change) -> None:
            if c.mark(f"ingest {checkpoint}", number):
                new = ingest(c.read("documents"), batch, order).withColumn("id", F.conv(F.substring("url_hash", 1, 15), 16, 10).cast("bigint"))
                c.write("documents", new.withColumn("fetch_timestamp", F.current_timestamp()), "append")

        store.retrying(work)

    writer = posted.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
