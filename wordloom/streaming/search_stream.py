"""A stream of queries answered from a static index, batch by batch; no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.search import search_many


def answer_stream(docs: DataFrame, postings: DataFrame, queries: DataFrame, n: int, sink: Callable[[DataFrame, int], None]):
    """A DataStreamWriter over streaming queries (query_id, query); sink gets each batch's answers."""
    return queries.writeStream.foreachBatch(lambda batch, epoch: sink(search_many(docs, postings, batch, n), epoch))
