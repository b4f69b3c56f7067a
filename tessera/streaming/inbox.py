"""Structured Streaming jobs: the inbox of new files, retries of failed ones, and windows over events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tessera.functions import text as T
from tessera.operators import records
from tessera.sources import pagefiles as P


def normalized(files: DataFrame) -> DataFrame:
    """path, adapter, title, markdown, error of files (path, content), of either kind of DataFrame."""
    kind, c = P.adapter(F.col("path"), F.col("content")), F.col("content")
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1)
    return files.select(
        "path", kind.alias("adapter"), F.coalesce(F.when(kind == "text", P.text_title(c)), T.title_case(F.translate(stem, "-_", "  "))).alias("title"),
        F.when(kind == "text", P.text_markdown(c)).otherwise(F.trim(c)).alias("markdown"), F.when(kind.isNull(), "unsupported type").when(F.trim(c) == "", "invalid format: empty").alias("error"),
    )


def run_inbox(spark: SparkSession, inbox: str, queue: str, failed: str, checkpoint: str) -> None:
    """Take the files that are new since the last run: good ones into the queue, the others into the failed table with their
    reason. A batch that is run again after a failure replaces its own files."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(inbox)

    def take(batch: DataFrame, no: int) -> None:
        rows = normalized(batch.select("path", P.decoded(F.col("content")).alias("content"))).persist()
        rows.where("error is null").drop("error").write.mode("overwrite").parquet(f"{queue}/batch={no}")
        rows.where("error is not null").select("path", "error", T.failure_reason(F.col("error")).alias("reason")).write.mode("overwrite").parquet(f"{failed}/batch={no}")
        rows.unpersist()

    files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


RETRY_SCHEMA = "file_path string, failure_count int, reason string, permanent boolean, next_retry timestamp"


def retry_state(attempts: DataFrame, max_retries: int = 5) -> DataFrame:
    """attempts (a stream): file_path, at, error (null: it succeeded, the file is cleared) -> each change of a file's
    state. State is one count a file."""

    def advance(key, batches, state):
        count, permanent = state.get if state.exists else (0, False)
        # each batch is reduced as it comes: the attempts after the last success count, and the last one's reason and time
        cleared, fails, last = None, [], None
        for rows in batches:
            good = rows[rows["reason"].isna()]["at"].max()
            if not pd.isna(good) and (cleared is None or good > cleared):
                cleared = good
            bad = rows[rows["reason"].notna()]
            if cleared is not None:
                bad = bad[bad["at"] > cleared]
            if len(bad):
                fails.append(pd.DataFrame({"at": bad["at"], "end": bad["reason"].isin(T.PERMANENT)}).groupby("at", as_index=False).agg(n=("end", "size"), end=("end", "any")))
                end = bad.sort_values("at").iloc[-1]
                last = end if last is None or end["at"] >= last["at"] else last
        counted = pd.concat(fails) if fails else None
        if cleared is not None:
            count, permanent = 0, False
            counted = counted[counted["at"] > cleared] if counted is not None else None
        if counted is None or not len(counted):
            out = (key[0], 0, "cleared", False, pd.NaT) if cleared is not None else None
        else:
            count += int(counted["n"].sum())
            permanent = permanent or bool(counted["end"].any()) or count >= max_retries
            wait = T.RETRY_SECONDS[min(count, len(T.RETRY_SECONDS)) - 1]
            out = (key[0], count, last["reason"], permanent, pd.NaT if permanent else last["at"] + pd.Timedelta(seconds=wait))
        if count:
            state.update((count, permanent))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame([out], columns=["file_path", "failure_count", "reason", "permanent", "next_retry"])

    rows = attempts.select("file_path", "at", F.when(F.col("error").isNotNull(), T.failure_reason(F.col("error"))).alias("reason"))
    return rows.groupBy("file_path").applyInPandasWithState(advance, RETRY_SCHEMA, "count int, permanent boolean", "update", "NoTimeout")


class Retries(StatefulProcessor):
    """State of one file: its failures, and a processing-time timer at its next retry. When the timer fires the file is due:
    a row says so, and whoever replays it sends the outcome back as the next attempt."""

    def __init__(self, max_retries: int = 5, seconds: tuple[float, ...] = T.RETRY_SECONDS):
        self.max_retries, self.seconds = max_retries, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("failures", "count int, reason string, permanent boolean, due long")

    def _row(self, key, event, count, reason, permanent, due):
        at = pd.Timestamp(due, unit="ms", tz="UTC") if due is not None else pd.NaT
        return pd.DataFrame({"file_path": [key[0]], "event": [event], "failure_count": [count], "reason": [reason], "permanent": [permanent], "next_retry": pd.Series([at], dtype="datetime64[ns, UTC]")})

    def handleInputRows(self, key, rows, timerValues):
        attempts = pd.concat(list(rows)).sort_values("at")
        count, reason, permanent, due = self.state.get() if self.state.exists() else (0, None, False, None)
        for r in attempts.itertuples():
            if due is not None:
                self.handle.deleteTimer(due)
                due = None
            if r.reason is None:
                count, reason, permanent = 0, None, False
                continue
            count, reason = count + 1, r.reason
            permanent = permanent or reason in T.PERMANENT or count >= self.max_retries
            if not permanent:
                due = int(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.seconds[min(count, len(self.seconds)) - 1])
                self.handle.registerTimer(due)
        if count:
            self.state.update((count, reason, permanent, due))
        else:
            self.state.clear()
        yield self._row(key, "failed" if count else "cleared", count, reason, permanent, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():
            count, reason, permanent, due = self.state.get()
            if due is not None and due <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.update((count, reason, permanent, None))
                yield self._row(key, "due", count, reason, permanent, due)

    def close(self) -> None:
        pass


RETRY_EVENTS = "file_path string, event string, failure_count int, reason string, permanent boolean, next_retry timestamp"


def retries(attempts: DataFrame, max_retries: int = 5, seconds: tuple[float, ...] = T.RETRY_SECONDS) -> DataFrame:
    """attempts (a stream): file_path, at, error (null: it succeeded) -> `failed` and `cleared` as they come, and `due` when a
    file's time has come, by the processing time. State and timers are the state store's (RocksDB; set
    spark.sql.streaming.stateStore.providerClass), so they outlive the query and any executor."""
    rows = attempts.select("file_path", "at", F.when(F.col("error").isNotNull(), T.failure_reason(F.col("error"))).alias("reason"))
    return rows.groupBy("file_path").transformWithStateInPandas(Retries(max_retries, seconds), RETRY_EVENTS, "Update", "ProcessingTime")


def retried(state: DataFrame, files: DataFrame, as_of: str, max_retries: int = 5) -> DataFrame:
    """The failed files (state: as records.failures() gives it) whose time has come, taken again from files (path, content
    of the failed folder), by file name: file_path, outcome, title, markdown and the new failure_count, reason, permanent
    and next_retry. Outcomes: `cleared` (the file is gone), `queued` (good now), `failed` (counted once more). An
    availableNow run on a timer calls it with its own as_of."""
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    due = records.retryable(state, as_of, max_retries).select("file_path", name("file_path").alias("__name"), "failure_count")
    taken = normalized(files).withColumn("__name", name("path"))
    rows = due.join(taken, "__name", "left")
    count, failed, reason = F.col("failure_count") + 1, F.col("error").isNotNull(), T.failure_reason(F.col("error"))
    permanent = reason.isin(*T.PERMANENT) | (count >= max_retries)
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), T.retry_seconds(count))
    only = lambda c: F.when(failed, c)
    return rows.select(
        "file_path", F.when(F.col("path").isNull(), "cleared").when(failed, "failed").otherwise("queued").alias("outcome"), F.when(~failed, F.col("title")).alias("title"), F.when(~failed, F.col("markdown")).alias("markdown"),
        only(count).alias("failure_count"), only(reason).alias("reason"), only(permanent).alias("permanent"), F.when(failed & ~permanent, F.lit(as_of).cast("timestamp_ntz") + wait).alias("next_retry"),
    )


def event_windows(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: counts and sums of events in tumbling windows, late rows within the watermark included."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return at.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
