"""What listeners are told: one event when an answer is done, new elements only, and a time-out (CNV-06, CNV-07), as state with timers.

Each message has a little state: when it was first seen, how many of its elements were sent, and whether it is over. A timer of event time ends those that
stay open; it fires when the watermark passes it. State lives in the state store, so a restart goes on where the checkpoint is. The batch forms give
the same rows for a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..plans import contract as C
from ..registry import query

# Seconds until a listener is told that nothing came, for answers and for progress.
ANSWER_SECONDS, PROGRESS_SECONDS = 780, 120
TOLD = "message long, event string, at timestamp, element long"
_STATE = StructType([StructField("began", LongType()), StructField("seen", LongType()), StructField("over", BooleanType())])


def _at(ms: int) -> pd.Timestamp:
    return pd.Timestamp(datetime.fromtimestamp(ms / 1000, UTC)).tz_localize(None)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["message", "event", "at", "element"]).astype({"element": "Int64"})


class _Listener(StatefulProcessor):
    """Keeps (began, seen, over) of a message and ends it after `seconds`."""

    seconds = ANSWER_SECONDS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("message", _STATE)

    def get(self, first: int) -> tuple[int, int, bool]:
        """The state, new with the first event's time where there is none."""
        if self.state.exists():
            return tuple(self.state.get())
        self.handle.registerTimer(first + self.seconds * 1000)
        return first, 0, False

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        began, seen, over = tuple(self.state.get())
        if not over:
            self.state.update((began, seen, True))
            yield _rows([(key[0], "Timeout", _at(began + self.seconds * 1000), None)])

    def close(self) -> None:
        pass


class Answers(_Listener):
    """(message, ts, status) to one event when the status is first Processed or Failed within the time."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows)).sort_values("ts", kind="stable")
        ms = (d["ts"].astype("int64") // 10**6 if d["ts"].dtype == "datetime64[ns]" else d["ts"].astype("datetime64[ms]").astype("int64")).to_numpy()
        began, seen, over = self.get(int(ms[0]))
        if not over:
            done = [(int(t), s) for t, s in zip(ms, d["status"], strict=True) if s in ("Processed", "Failed") and t <= began + self.seconds * 1000]
            if done:
                over = True
                yield _rows([(key[0], done[0][1], _at(done[0][0]), None)])
            self.state.update((began, seen, over))


class Elements(_Listener):
    """(message, ts, n, done): how many elements a message has at a time, to an event for each element that wasn't told yet; over when done."""

    seconds = PROGRESS_SECONDS

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows)).sort_values(["ts", "n"], kind="stable")
        ms = (d["ts"].astype("int64") // 10**6 if d["ts"].dtype == "datetime64[ns]" else d["ts"].astype("datetime64[ms]").astype("int64")).to_numpy()
        began, seen, over = self.get(int(ms[0]))
        out = []
        for t, n, done in zip(ms.tolist(), d["n"].tolist(), d["done"].tolist(), strict=True):
            if not over and t <= began + self.seconds * 1000:
                out += [(key[0], "Element", _at(t), k) for k in range(seen, n)]
                seen, over = max(seen, n), bool(done)
        self.state.update((began, seen, over))
        yield _rows(out)


def told(events: DataFrame, listener: Callable[[], StatefulProcessor], late: str = "0 seconds") -> DataFrame:
    """events, a stream with message and ts, as a stream of what its listeners are told."""
    keyed = events.withWatermark("ts", late).groupBy("message")
    return keyed.transformWithStateInPandas(listener(), TOLD, "Append", "EventTime")


def statuses(events: DataFrame) -> DataFrame:
    """The driver's events as (message, ts, status): purchases end a message well, errors badly."""
    status = F.when(F.col("event_type") == "purchase", "Processed").when(F.col("event_type") == "error", "Failed").otherwise("Processing")
    return events.select(F.col("user_id").alias("message"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))


def told_answers(rows: DataFrame, seconds: int = ANSWER_SECONDS) -> DataFrame:
    """(message, event, at) of a table of statuses: the first end within the time, else the time-out."""
    limit = F.make_dt_interval(secs=F.lit(seconds))
    a = rows.withColumn("began", F.min("ts").over(Window.partitionBy("message")))
    ends = F.when(F.col("status").isin("Processed", "Failed") & (F.col("ts") <= F.col("began") + limit), F.struct("ts", "status"))
    g = a.groupBy("message").agg(F.min("began").alias("began"), F.min(ends).alias("end"))
    return g.select("message", F.coalesce(F.col("end.status"), F.lit("Timeout")).alias("event"), F.coalesce(F.col("end.ts"), F.col("began") + limit).alias("at"))


#: Six hours stand for the minutes of a chat, for the driver's events are hours apart.
_SPAN = 6 * 3600


@query(
    "cnv_06_told_answers",
    f"""SELECT message, coalesce(arg_min(status, {{'t': ts, 's': status}}) FILTER (status <> 'Processing' AND ts <= began + INTERVAL {_SPAN} SECOND), 'Timeout') AS event, coalesce(min(ts) FILTER (status <> 'Processing' AND ts <= began + INTERVAL {_SPAN} SECOND), min(began) + INTERVAL {_SPAN} SECOND) AS at
    FROM (SELECT user_id AS message, ts, CASE event_type WHEN 'purchase' THEN 'Processed' WHEN 'error' THEN 'Failed' ELSE 'Processing' END AS status, min(ts) OVER (PARTITION BY user_id) AS began FROM events) GROUP BY message""",
)
def told_answers_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each listener is told once: done, failed or nothing in time."""
    return told_answers(statuses(C.table(spark, sf_dir, "events")), _SPAN)


def told_elements(rows: DataFrame, seconds: int = PROGRESS_SECONDS) -> DataFrame:
    """(message, element, at) of a table (message, ts, n, done): each element when it was first there, until the message is done or its time is up."""
    ordered = Window.partitionBy("message").orderBy("ts", "n")
    a = rows.withColumns({"began": F.min("ts").over(Window.partitionBy("message")), "over": F.max("done").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), "seen": F.max("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1))})
    a = a.where(~F.coalesce("over", F.lit(False)) & (F.col("ts") <= F.col("began") + F.make_dt_interval(secs=F.lit(seconds))))
    seen = F.coalesce("seen", F.lit(0)).cast("long")
    return a.where(F.col("n") > seen).select("message", F.explode(F.sequence(seen, F.col("n") - 1)).alias("element"), F.col("ts").alias("at"))


@query(
    "cnv_07_told_elements",
    f"""SELECT message, n - 1 AS element, ts AS at FROM (SELECT *, coalesce(bool_or(done) OVER (PARTITION BY message ORDER BY ts, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over_by_then FROM (
        SELECT user_id AS message, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type = 'purchase' AS done, min(ts) OVER (PARTITION BY user_id) AS began FROM events))
    WHERE NOT over_by_then AND ts <= began + INTERVAL {_SPAN} SECOND""",
)
def told_elements_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New elements of each message only, until it is done or its time is up; each event adds one."""
    e = C.table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = e.select(F.col("user_id").alias("message"), F.col("ts").cast("timestamp").alias("ts"), n.cast("long").alias("n"), (F.col("event_type") == "purchase").alias("done"))
    return told_elements(rows, _SPAN)
