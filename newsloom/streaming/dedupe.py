"""Incremental arrivals as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from newsloom.sources.sinks import insert_if_absent

#: Keyed state with timers lives in this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_arrivals(
    spark: SparkSession, path: str, schema, max_files: int | None = None
) -> DataFrame:
    """Parquet files as they arrive; `max_files` caps a micro-batch, not the run."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def drop_seen(stream: DataFrame, ts: str, key: str = "article_hash", hours: int = 48) -> DataFrame:
    """Drops a key that was seen less than `hours` ago in event time.

    State holds the keys of the window only. A key that returns later passes
    again; `load_new` compares with the stored table instead.
    """
    return (
        stream.withColumn("_at", F.col(ts).cast("timestamp"))
        .withWatermark("_at", f"{hours} hours")
        .dropDuplicatesWithinWatermark([key])
        .drop("_at")
    )


class Absence(StatefulProcessor):
    """Lets a row pass whose key was not seen for some hours before it, in event time.

    The state of a key is the latest moment it was seen at. A key has one timer, set when
    it comes into the store: it clears a key that stayed away, and waits for the end of the
    window of one that was seen since. So the store holds the keys of the window only, and a
    micro-batch costs a key one read and one write, and no timer. Every call to the store is a
    message between Python and the JVM, which costs more than the rows of a key.
    """

    def __init__(self, columns: list[str], order: list[str], hours: int):
        self.columns, self.order, self.window = columns, order, hours * 3_600_000_000
        self.passed = Row(*columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("us", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self.seen.get()
        last = before = stored[0] if stored else None
        arrived = list(rows)
        if len(arrived) > 1:
            arrived.sort(key=lambda r: (r["_us"], *(r[c] for c in self.order)))
        for row in arrived:
            us = row["_us"]
            if last is None or us - last >= self.window:
                yield self.passed(*(row[c] for c in self.columns))
            last = us if last is None else max(last, us)
        if last != before:
            self.seen.update((last,))
        if before is None:
            self.handle.registerTimer(self.end(last))

    def end(self, last: int) -> int:
        """The first millisecond behind the window."""
        return -(-(last + self.window) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        stored = self.seen.get()
        end = self.end(stored[0]) if stored else 0
        if end > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(end)
        elif stored:
            self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def after_absence(
    stream: DataFrame, ts: str, order: list[str], key: str = "article_hash", hours: int = 48, late: str = "1 hour"
) -> DataFrame:
    """Rows whose key was not seen in the `hours` before them; columns unchanged.

    Every arrival counts as seen, whether it passed or not, so a key passes again
    once it stayed away for `hours`. Rows of one key and moment go by `order`.
    State and timers survive a restart from the log. Rows that come more than
    `late` behind the newest moment are dropped, as are rows without a moment. The
    session needs the store `STATE_STORE` (see `with_state_store`).
    """
    columns = stream.columns
    moments = stream.withColumn("_at", F.col(ts).cast("timestamp")).filter("_at is not null").withWatermark("_at", late)
    rows = moments.withColumn("_us", F.unix_micros("_at"))
    return rows.groupBy(key).transformWithState(
        statefulProcessor=Absence(columns, order, hours),
        outputStructType=stream.schema,
        outputMode="Append",
        timeMode="EventTime",
    )


def with_state_store(spark: SparkSession) -> SparkSession:
    """A session beside the given one whose new streaming jobs keep their state in `STATE_STORE`."""
    other = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        other.conf.set(name, spark.conf.get(name))
    other.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return other


def load_new(
    stream: DataFrame,
    table: str,
    checkpoint_location: str,
    order: list[str],
    key: str = "article_hash",
    buckets: int | None = None,
) -> StreamingQuery:
    """Appends the rows with new keys of everything that has arrived, then ends.

    Every micro-batch is compared with the table it appends to, so a batch that
    is repeated after a failure adds nothing. `buckets` as in `insert_if_absent`.
    """

    def insert(batch: DataFrame, _: int) -> None:
        insert_if_absent(batch, table, key, order, buckets)

    return (
        stream.writeStream.foreachBatch(insert)
        .option("checkpointLocation", checkpoint_location)
        .trigger(availableNow=True)
        .start()
    )


def append_stream(stream: DataFrame, table: str, checkpoint_location: str) -> StreamingQuery:
    """Plain append of everything that has arrived, then ends."""
    return (
        stream.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint_location)
        .trigger(availableNow=True)
        .start()
    )
