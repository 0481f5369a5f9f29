"""Extensions for live input: keystrokes settled into queries, queries searched as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import Corpus
from ..plans.search import search_batch


def debounce(keystrokes: DataFrame, *, gap: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """user, query, at: of each burst of a user's keystrokes (user, ts, query) that no more
    than ``gap`` parts, the last query. For streams and for tables; in a stream, keystrokes
    more than ``late`` behind are dropped."""
    marked = keystrokes.withWatermark("ts", late) if keystrokes.isStreaming else keystrokes
    burst = marked.groupBy(F.session_window("ts", gap).alias("burst"), "user").agg(F.max_by("query", "ts").alias("query"), F.max("ts").alias("at"))
    return burst.select("user", "query", "at")


def search_stream(queries: DataFrame, corpus: Corpus, sink: Callable[[DataFrame, int], None], *, checkpoint: str | None = None, **options: object) -> StreamingQuery:
    """Search each micro-batch of a stream of (qid, query) as one batch; ``sink`` gets its page
    and the batch's number, by which it can make repeated deliveries harmless."""
    writer = queries.writeStream.foreachBatch(lambda batch, number: sink(search_batch(batch, corpus, **options), number))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
