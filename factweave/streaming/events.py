"""The change log as a stream: reading from a cursor, following, closing edges as state, and windows over valid time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Stateful operators need the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "seq long, at timestamp, kind string, data string"


def since(log: DataFrame, cursor: int, limit: int = 500) -> DataFrame:
    """The next events after a cursor."""
    return log.filter(F.col("seq") > cursor).orderBy("seq").limit(limit)


def follow(spark: SparkSession, path: str, each: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second", once: bool = False) -> StreamingQuery:
    """Calls each(batch, number) with new events of a log folder; the checkpoint is the cursor."""
    stream = spark.readStream.schema(EVENT).parquet(path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime=every)).start()


def rhythm(events: DataFrame, at: str, topic: str, width: str = "30 days", late: str | None = None) -> DataFrame:
    """(start, topic, n) by windows of time; on a stream, `late` is the watermark."""
    rows = events if late is None else events.withWatermark(at, late)
    return rows.groupBy(F.window(at, width).alias("w"), F.col(topic).alias("topic")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "topic", "n")


def sessions(events: DataFrame, at: str, user: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user, start, end, n): stretches without a pause of `gap`."""
    rows = events if late is None else events.withWatermark(at, late)
    return rows.groupBy(F.session_window(at, gap).alias("w"), F.col(user).alias("user")).agg(F.count("*").alias("n")).select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class _First(StatefulProcessor):
    """Keeps whether an edge is closed; of the closings that come together the one with the smallest seq counts, as in the batch fold."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.closed = handle.getValueState("closed", "seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802 - the interface's name
        first = pd.concat(list(rows)).nsmallest(1, "seq")
        if not self.closed.exists():
            self.closed.update((int(first["seq"].iloc[0]),))
            yield first[["edge", "seq", "at", "by"]]

    def close(self) -> None:
        pass


def first_closings(closings: DataFrame) -> DataFrame:
    """The first closing of each edge on a stream of closings(edge, seq, at, by) that comes in order of seq: state is one number for each edge. Later ones change nothing."""
    return closings.groupBy("edge").transformWithStateInPandas(_First(), "edge string, seq long, at timestamp, by string", "append", "none")


def current_versions(sources: DataFrame) -> DataFrame:
    """(old, by, uri, at): on a stream of sources(seq, uri, id, at) each version that a later one of its address takes the place of. State is one id for each address."""
    return sources.groupBy("uri").transformWithStateInPandas(_Versions(), "uri string, old string, by string, at timestamp", "append", "none")


class _Versions(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "id string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        now, out = self.last.get()[0] if self.last.exists() else None, []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if now is not None and now != r.id:
                out.append((r.uri, now, r.id, r.at))
            now = r.id
        self.last.update((now,))
        yield pd.DataFrame(out, columns=["uri", "old", "by", "at"]).astype({"uri": object, "old": object, "by": object, "at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def live_page(log: DataFrame, render: Callable[[DataFrame], str], write: Callable[[str], None], checkpoint: str, every: str = "2 seconds", once: bool = False) -> StreamingQuery:
    """Renders a page again whenever a stream of events brings new ones: render(the new events) gives the page, write(page) puts it where its readers look."""

    def again(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            write(render(batch))

    out = log.writeStream.foreachBatch(again).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()
