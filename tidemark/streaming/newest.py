"""The newest row of each key in a stream, with corrections until the watermark passes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.dedupe import keep_last
from tidemark.operators.versions import CommitConflict, VersionedTable
from tidemark.sources.workdir import work_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestRow(StatefulProcessor):
    """Keeps a key's newest row until the watermark is ``delay`` past its time, and emits each row that is newer than the one before.

    Rows of one time are settled by the text of all columns, larger first, as in no engine
    the order of arrival is the same twice.
    """

    def __init__(self, schema: T.StructType, delay: dt.timedelta):
        self.schema, self.delay = schema, int(delay.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.newest = handle, handle.getValueState("newest", self.schema)

    def _rank(self, row: tuple) -> tuple:
        # the last column is the time in microseconds
        return row[-1], [(v is not None, str(v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v)) for v in row]

    def _until(self, row: tuple) -> int:
        return row[-1] // 1000 + self.delay

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = max((tuple(r) for r in rows), key=self._rank)
        if self.newest.exists():
            old = tuple(self.newest.get())
            if self._rank(old) >= self._rank(best):
                return
            self.handle.deleteTimer(self._until(old))
        self.newest.update(best)
        self.handle.registerTimer(self._until(best))
        yield Row(**dict(zip(self.schema.names, best, strict=True)))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.newest.clear()
        yield from ()

    def close(self) -> None:
        pass


def newest_events(stream: DataFrame, key: str, time: str, delay: dt.timedelta = dt.timedelta(hours=1)) -> DataFrame:
    """A stream's rows that are newer than all before of their key: the last one of a key agrees with the batch rule.

    Where ``dropDuplicatesWithinWatermark`` keeps the first to arrive, this corrects it
    when a newer one comes. Rows older than the watermark, and rows without a time, are
    left out. State is a row for each key until the watermark has passed its time by
    ``delay``; it is kept by RocksDB, which the session is set to.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.where(stream[time].isNotNull() & stream[key].isNotNull()).withWatermark(time, f"{int(delay.total_seconds())} seconds")
    rows = rows.withColumn("__at", F.unix_micros(F.col(time).cast("timestamp")))
    return rows.groupBy(key).transformWithState(NewestRow(rows.schema, delay), rows.schema, "Update", "EventTime").select(*stream.columns)


def upsert_newest(stream: DataFrame, table: VersionedTable, key: str, time: str, checkpoint: str, delay: dt.timedelta = dt.timedelta(hours=1)) -> StreamingQuery:
    """Loads the newest row of each key into a table; a correction replaces what an earlier batch brought. Ends when all files are read.

    The table is the state, as it has a row for each key anyway: a batch's newest rows are
    held against the table's rows of their keys, for which only files that may hold one are
    opened, and the newer ones are loaded. Rows of one time are settled as by ``keep_last``.
    Rows without a key or a time are left out, and so are rows ``delay`` or more before the
    newest time of the batches before; the table gives that time from its log, if ``time``
    is one of its cursors. A repeated batch is skipped.
    """
    spark = table.spark

    def load(batch: DataFrame, batch_id: int) -> None:
        run_id = f"{checkpoint}/{batch_id}"
        if table.has_run(run_id):
            return
        rows, mark = batch.dropna(subset=[key, time]), table.mark(time) if table.version() else None
        if mark is not None:
            rows = rows.where(F.col(time) > F.timestamp_add("SECOND", F.lit(-int(delay.total_seconds())), F.lit(mark)))
        path = work_folder(spark, "newest-batch")
        keep_last(rows, [key], [time]).write.parquet(path)
        rows = spark.read.schema(batch.schema).parquet(path)  # a stream's own session plans without what is known at run time
        for attempt in range(10):
            version, old = table.version() or 0, table.read_keys(rows.select(key))
            try:
                table.upsert(rows if old is None else _newer(rows, old, key, time), [key], run_id, expected=version)
                return
            except CommitConflict:
                if attempt == 9:
                    raise

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newer(rows: DataFrame, old: DataFrame, key: str, time: str) -> DataFrame:
    """The rows, one a key, that come after the old row of their key in the order of ``keep_last``."""
    order = [time, *sorted(set(rows.columns) - {key, time})]
    there = [(F.col(c) if c in old.columns else F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in order]
    joined = rows.join(old.select(F.col(key).alias("__key"), F.struct(*there).alias("__old")), F.col(key) == F.col("__key"), "left")
    return joined.where(F.col("__old").isNull() | (F.struct(*order) > F.col("__old"))).select(*rows.columns)
