"""Streaming forms of the batch operators. They share their logic with the batch side."""
from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from foliocheck.operators import findings as O, identity as I, review as R
from foliocheck.session import ship_package
from foliocheck.streaming.buckets import BucketTable

PAGE = ["book_id", "page_number"]
REPORT_SCHEMA = I.MERGE_SCHEMA + ", analyzed_at timestamp"


def read_folder(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; only files that arrived since the last look are read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def live_findings(stream: DataFrame) -> DataFrame:
    """Findings as they arrive, in the reviewer's form."""
    return O.review_view(stream)


def live_stats(stream: DataFrame) -> DataFrame:
    """Finding totals per book, kept up to date; start it in `update` or `complete` mode."""
    return stream.groupBy("book_id").agg(
        F.count("*").alias("findings"), *[F.sum((F.col("severity") == s).cast("bigint")).alias(s) for s in ("critical", "major", "minor")],
        *[F.sum((F.col("status") == s).cast("bigint")).alias(s) for s in ("accepted", "dismissed")])


class _PageHistory(StatefulProcessor):
    """Keeps the findings of one page across analyses; emits the whole page after each of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.findings = handle.getMapState("findings", "uid string", I.HISTORY_SCHEMA + I.KEY_SCHEMA)

    def handleInputRows(self, key, rows, timerValues):
        fresh = pd.concat(list(rows), ignore_index=True)
        columns = [*I.HISTORY_COLUMNS, *I.KEY_COLUMNS]
        page = pd.DataFrame([value for _, value in self.findings.iterator()], columns=columns)
        for moment, run in fresh.groupby("analyzed_at", sort=True):
            page = I.update_history(page, run.reindex(columns=columns), pd.Timestamp(moment).to_pydatetime())
        for row in page.to_dict("records"):
            self.findings.updateValue((row["uid"],), tuple(_plain(row[c], c) for c in columns))
        yield I.typed(page, I.HISTORY_COLUMNS)

    def close(self) -> None:
        pass


def _plain(value, column: str):
    if value is None or value is pd.NaT or value != value:
        return None
    if column in ("page_number", "seq", "text_start", "text_end", "edit_at"):
        return int(value)
    if column in ("first_detected_at", "last_detected_at"):
        return pd.Timestamp(value).to_pydatetime()
    return value


def reconcile_stream(reports: DataFrame) -> DataFrame:
    """Page histories from a stream of detected findings (merge columns and `analyzed_at`).

    State is one page's findings under its own key, so it is spread over the cluster and grows
    only with the findings of pages.
    """
    ship_package(reports.sparkSession)
    return I.keyed(reports).groupBy(*PAGE).transformWithStateInPandas(
        statefulProcessor=_PageHistory(), outputStructType=I.HISTORY_SCHEMA, outputMode="Update", timeMode="None")


def decisions_to_table(decisions: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps the last decision of every finding in a folder of snapshots, one per batch.

    No watermark: a decision is never dropped as late. Each batch reads the newest snapshot and
    writes the next one under its batch number, so a repeated batch overwrites its own result.
    Every batch writes the whole table: for large ones use `decisions_to_buckets`.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = batch.select("book_id", "page_number", "uid", "status", "ts", "seq")
        if batch_id > 0:
            last = last.unionByName(spark.read.parquet(f"{table}/batch={batch_id - 1}"))
        newest = last.groupBy("book_id", "page_number", "uid").agg(F.max_by(F.struct("status", "ts", "seq"), F.struct("ts", "seq")).alias("d"))
        newest.select("book_id", "page_number", "uid", "d.*").write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
    writer = decisions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def decision_table(path: str, buckets: int = 64) -> BucketTable:
    return BucketTable(path, "book_id string, page_number int, uid string, status string, ts timestamp, seq bigint", ("book_id", "page_number", "uid"), buckets)


def decisions_to_buckets(decisions: DataFrame, path: str, checkpoint: str, buckets: int = 64, **trigger) -> StreamingQuery:
    """Keeps the last decision of every finding in `decision_table(path)`; a batch rewrites only the buckets of its findings.

    The greatest (ts, seq, status) of a finding holds, so no decision is dropped as late and a repeated one changes nothing.
    """
    table = decision_table(path, buckets)
    keys = list(table.keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        reached = table.touched(batch)
        rows = table.read(batch.sparkSession, batch_id - 1, reached).unionByName(batch.select(*keys, "status", "ts", "seq"))
        newest = rows.groupBy(*keys).agg(F.max(F.struct("ts", "seq", "status")).alias("d"))
        table.write(newest.select(*keys, "d.status", "d.ts", "d.seq"), batch_id, reached)
    writer = decisions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


class _Heartbeats(StatefulProcessor):
    """Emits a page once when its running attempt has been silent longer than the cutoff."""

    def __init__(self, cutoff_ms: int):
        self.cutoff_ms = cutoff_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues):
        running, latest = None, -1
        for pdf in rows:
            for at, status in zip(pdf["heartbeat_at"], pdf["status"]):
                ms = int(pd.Timestamp(at).timestamp() * 1000)
                if ms >= latest:
                    latest, running = ms, status == "processing"
        if self.last.exists() and self.last.get()[0] >= latest:
            return iter(())
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if running:
            self.last.update((latest,))
            self.handle.registerTimer(latest + self.cutoff_ms)
        else:
            self.last.clear()
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        yield pd.DataFrame({"book_id": [key[0]], "page_number": [key[1]], "new_status": ["pending"]})

    def close(self) -> None:
        pass


def stale_stream(heartbeats: DataFrame, cutoff: dt.timedelta = dt.timedelta(minutes=15)) -> DataFrame:
    """Running pages whose heartbeat stops, by event time (watermark 30 minutes)."""
    h = heartbeats.withWatermark("heartbeat_at", "30 minutes")
    ship_package(h.sparkSession)
    return h.groupBy(*PAGE).transformWithStateInPandas(
        statefulProcessor=_Heartbeats(int(cutoff.total_seconds() * 1000)), outputStructType="book_id string, page_number int, new_status string",
        outputMode="Append", timeMode="EventTime")
