"""Streamed documents into a chunk store: an extension, not a part of the batch semantics."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.chunks import EXAMPLE_WIDTH, chunk, min_len
from corvane.operators.store import ChunkStore


def ingest(docs: DataFrame, store: ChunkStore, checkpoint: str, max_chars: int = EXAMPLE_WIDTH) -> StreamingQuery:
    """docs: a streaming DataFrame of (doc_id, text). Each micro-batch is one upsert.

    Micro-batches come in the order of arrival; within one, documents are in the order of their
    ids and chunks in that of the text. An add is named by the stream (its checkpoint) and the
    number of the micro-batch, so a batch that is replayed after a failure changes nothing. The store is
    compacted as it grows, so that a long stream leaves few tables.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.add(min_len(chunk(batch, max_chars)).withColumn("wseq", F.struct("doc_id", "seq")), batch=f"{name}-{number}")
            store.compact()

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
