"""Documents from a stream, indexed batch by batch; batches that come again change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from corpusloom.engine import Engine


def index_stream(engine: Engine, docs: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """docs(text), a stream -> a query that indexes each batch. trigger is as in writeStream.trigger."""
    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: engine.index(batch))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
