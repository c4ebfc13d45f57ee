"""Fixed-window rate limits, in batches and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def verdicts(requests: DataFrame, limit: int, seconds: int = 60, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """``requests`` with ``allowed`` and ``retry_after`` (seconds to the window's end, 1 at least; null if allowed).

    Windows are aligned to the epoch.  A key's requests of one window are ranked together, so a task
    holds no more than one key and window.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    size = seconds * 1_000_000
    start = F.floor(at / size)
    nth = F.row_number().over(Window.partitionBy(key, start).orderBy(ts, tie))
    left = F.ceil(((start + 1) * size - at) / 1_000_000).cast("long")
    allowed = nth <= limit
    return requests.withColumn("allowed", allowed).withColumn("retry_after", F.when(~F.col("allowed"), F.greatest(left, F.lit(1).cast("long"))))


def counts(requests: DataFrame, limit: int, seconds: int = 60, late: str = "10 minutes", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Requests and denials per key and window, of a batch or (with a watermark) of a stream."""
    own = requests.withWatermark(ts, late) if requests.isStreaming else requests
    grouped = own.groupBy(F.window(ts, f"{seconds} seconds").alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("window_start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("denied"))


class _Counter(StatefulProcessor):
    """Counts of a key's open windows; a timer at the end of each forgets it once the watermark has passed."""

    def __init__(self, limit: int, micros: int, at: str, ties: list[str], columns: list[str]):
        self.limit, self.micros, self.at, self.ties, self.columns = limit, micros, at, ties, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "window long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows), ignore_index=True)
        own = own.sort_values([self.at, *self.ties], ignore_index=True)
        window = own[self.at] // self.micros
        nth = own.groupby(window).cumcount() + 1
        for w, n in window.value_counts().items():
            before = self.open.getValue((int(w),))[0] if self.open.containsKey((int(w),)) else 0
            if not before:
                self.handle.registerTimer((int(w) + 1) * self.micros // 1000)
            nth[window == w] += before
            self.open.updateValue((int(w),), (before + int(n),))
        left = -((own[self.at] - (window + 1) * self.micros) // 1_000_000)
        allowed = nth <= self.limit
        yield own.assign(allowed=allowed, retry_after=left.clip(lower=1).where(~allowed).astype("Int64"))[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.removeKey((expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.micros - 1,))
        return iter(())

    def close(self) -> None:
        pass


def verdict_stream(requests: DataFrame, limit: int, seconds: int = 60, late: str = "10 minutes", key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """:func:`verdicts` of a stream: each request is answered once, in the batch that brings it.

    State is a count for each key and open window; a window's count goes when the watermark, ``late``
    behind the latest request, has passed its end, and requests that are later still are dropped by
    then.  Requests of one batch are ranked by time, so a request that comes late counts after those
    answered before.  A key's requests of one batch meet in one task.
    """
    plain = requests.withColumn(ts, F.col(ts).cast("timestamp"))
    names = plain.columns
    sent = plain.withColumn("at_micros", F.unix_micros(ts)).withWatermark(ts, late)
    # times go as whole microseconds: pandas would change their type
    moved = [F.unix_micros(c).alias(c) if f.dataType == T.TimestampType() and c != ts else F.col(c) for c, f in zip(names, plain.schema)]
    sent = sent.select(*moved, "at_micros").where(F.col("at_micros").isNotNull())
    fields = [T.StructField(f.name, T.LongType() if f.dataType == T.TimestampType() and f.name != ts else f.dataType) for f in plain.schema if f.name != ts]
    out = T.StructType([*fields, T.StructField("at_micros", T.LongType()), T.StructField("allowed", T.BooleanType()), T.StructField("retry_after", T.LongType())])
    ties = [tie] if tie in names else []
    processor = _Counter(limit, seconds * 1_000_000, "at_micros", ties, out.names)
    found = sent.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")
    back = [F.timestamp_micros("at_micros").alias(c) if c == ts else F.timestamp_micros(c).alias(c) if f.dataType == T.TimestampType() else F.col(c) for c, f in zip(names, plain.schema)]
    return found.select(*back, "allowed", "retry_after")
