"""Streams whose state goes by event time: sessions that end by themselves, and tickets redeemed once.

Both need the RocksDB state store or a watermark: what is kept of a session or a
ticket is dropped when the watermark has passed its end, so state is bounded by what is open."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarnkit.streaming.state import SlidingSession, in_order

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "key long, id long, at long, session long, event string"
REQUEST, EXPIRED = "request", "expired"


class SessionProcessor(StatefulProcessor):
    """A key's sessions. state: its number of sessions; open: start and end of the one that runs, cleared by a timer at its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "number long")
        self.open = handle.getValueState("open", "start long, ends long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        session = SlidingSession()
        if self.count.exists():
            session.number = self.count.get()[0]
        if self.open.exists():
            session.start, session.end = self.open.get()
        set_before = session.end
        for frame in in_order(rows):
            out = []
            for at, id_ in zip(frame["at"].tolist(), frame["id"].tolist(), strict=True):
                number, end = session.number, session.end
                if session.touch(at) > number and end >= 0:
                    out.append((key[0], None, end, number, EXPIRED))
                out.append((key[0], id_, at, session.number, REQUEST))
            yield _events(out)
        self.count.update((session.number,))
        self.open.update((session.start, session.end))
        if session.end != set_before:
            if set_before >= 0:
                self.handle.deleteTimer(_timer(set_before))
            self.handle.registerTimer(_timer(session.end))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The session ends though nobody asked."""
        if self.open.exists():
            end, number = self.open.get()[1], self.count.get()[0]
            if _timer(end) <= expiredTimerInfo.getExpiryTimeInMs():
                self.open.clear()
                yield _events([(key[0], None, end, number, EXPIRED)])

    def close(self) -> None:
        pass


def _timer(at: int) -> int:
    """The first millisecond at which a time in microseconds has passed."""
    return -(-at // 1000)


def _events(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "id", "at", "session", "event"]).astype({"id": "Int64"})


def session_stream(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """key, id, at, session and event of a stream with columns key, id and at (microseconds): each
    request with the number of its key's session, and each session's end as a row without an id.

    A request later than the watermark is dropped. Sessions number from 1 for a key; that
    number is all that is kept of a key without an open session."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = stream.select("key", "id", "at", F.timestamp_micros("at").alias("time")).withWatermark("time", late)
    return timed.groupBy("key").transformWithStateInPandas(SessionProcessor(), EVENTS, "Append", "EventTime")


def redeemed(issued: DataFrame, uses: DataFrame, life_seconds: int, late: str = "1 hour") -> DataFrame:
    """ticket, id and at (microseconds) of the one use that redeems each ticket, as a stream.

    issued: a stream of ticket and at; uses: of ticket, id and at. A use counts within
    life_seconds of the issue, and the first that counts redeems; unknown tickets, uses too
    early, expired or repeated give no row, nor does what comes later than the watermark.
    The join drops a ticket, and the aggregate answers for it, when both watermarks have passed its life."""
    life = F.expr(f"interval {life_seconds} seconds")
    # the watermark of a ticket is that of its deadline, so that the answer waits for its last use
    issue = issued.select(F.col("ticket").alias("issued_ticket"), (F.timestamp_micros("at") + life).alias("deadline")).withWatermark("deadline", late)
    use = uses.select("ticket", "id", F.timestamp_micros("at").alias("used")).withWatermark("used", late)
    inside = (F.col("ticket") == F.col("issued_ticket")) & (F.col("used") >= F.col("deadline") - life) & (F.col("used") < F.col("deadline"))
    first = issue.join(use, inside).groupBy("ticket", "deadline").agg(F.min(F.struct(F.unix_micros("used").alias("at"), "id")).alias("first"))
    return first.select("ticket", "first.id", "first.at")


