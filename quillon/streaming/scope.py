"""Incremental scope over arriving record files, with the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from quillon.operators.incremental import checkpoint, compare, fingerprint

# The state store that timers need; a session names it before its first stream.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def follow(spark: SparkSession, arriving: str, schema: str, prior: DataFrame, columns: list[str], out: str, state: str) -> StreamingQuery:
    """Classify every arriving snapshot file against ``prior`` and append ``id, state``.

    Runs over what is there and ends (``availableNow``); the next run goes on
    from the state folder.
    """

    def each(batch: DataFrame, number: int) -> None:
        found = compare(checkpoint(batch, columns), prior).filter("state <> 'deleted'")
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = spark.readStream.schema(schema).parquet(arriving)
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start()


class Memory(StatefulProcessor):
    """One fingerprint for each id, and a timer for the snapshot that lacks it.

    An id's timer lies just behind the last snapshot that held it. The next
    snapshot moves the timers of all ids that it holds, and its time, once it is
    the watermark, makes those of the others go off.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "fingerprint string, seen long")

    def handleInputRows(self, key, rows, timerValues):
        (issue_id,) = key
        for seen, print_ in sorted({(int(r.seen), r.fingerprint) for r in rows}, key=lambda r: (r[0], r[1] or "")):
            before = self.known.get() if self.known.exists() else None
            if before is not None:
                if seen <= before[1]:
                    continue  # a snapshot that was read already
                self.handle.deleteTimer(before[1] + 1)
                passed = timerValues.getCurrentWatermarkInMs()
                if passed > before[1]:  # rows come before timers: the snapshot before this one lacked the id
                    yield Row(id=issue_id, snapshot=passed, state="deleted")
                    before = None
            state = "new" if before is None else "unchanged" if before[0] == print_ else "changed"
            self.known.update((print_, seen))
            self.handle.registerTimer(seen + 1)
            yield Row(id=issue_id, snapshot=seen, state=state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.known.exists() and self.known.get()[1] < expiredTimerInfo.getExpiryTimeInMs():
            self.known.clear()
            yield Row(id=key[0], snapshot=timerValues.getCurrentWatermarkInMs(), state="deleted")

    def close(self) -> None:
        pass


def remembered(snapshots: DataFrame, columns: list[str], time: str = "taken_at") -> DataFrame:
    """``id, snapshot, state`` of a stream of whole snapshots, without a prior table.

    ``time`` is the moment of a row's snapshot, the same for all its rows and later
    than that of the one before; ``snapshot`` gives it in milliseconds. An id is
    ``new``, ``changed``, ``unchanged`` or, in the first snapshot after the last
    that held it, ``deleted``; one that comes back is new. Snapshots must arrive
    one to a batch, and a deletion is told in the batch that follows, which needs no
    new rows. Of rows that repeat an id within a snapshot the first fingerprint
    counts. The session must keep state in RocksDB (``ROCKSDB``).
    """
    moment = F.col(time).cast("timestamp")
    rows = snapshots.select(F.col("id").cast("string").alias("id"), moment.alias("at"), F.unix_millis(moment).alias("seen"), fingerprint(columns).alias("fingerprint"))
    keyed = rows.withWatermark("at", "0 seconds").groupBy("id")
    return keyed.transformWithState(Memory(), "id string, snapshot long, state string", "append", "eventTime")


def follow_snapshots(spark: SparkSession, arriving: str, schema: str, columns: list[str], out: str, state: str, files: int | None = None) -> StreamingQuery:
    """Append ``id, snapshot, state`` of the snapshots that have arrived to ``out``.

    Ends once all is read (``availableNow``); the next run goes on from the state.
    A run reads one snapshot, or several of ``files`` files each.
    """
    rows = spark.readStream.schema(schema).options(**{"maxFilesPerTrigger": files} if files else {}).parquet(arriving)
    return remembered(rows, columns).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
