"""Stateful rules over event streams, each as a batch fold and as a streaming query.

A batch fold sorts the log by key and time inside partitions and passes over it once; a
key's state is a few numbers, so a busy key costs time, not memory. The streaming form
keeps the same state between batches."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND
FRAME_ROWS = 10_000


class SlidingLog:
    """At most limit accepted requests in any window; refused ones leave no trace."""

    def __init__(self, limit: int, window: int, times: list[int] | None = None) -> None:
        self.limit, self.window, self.times = limit, window, deque(times or ())

    def allow(self, at: int) -> bool:
        while self.times and self.times[0] <= at - self.window:
            self.times.popleft()
        if len(self.times) >= self.limit:
            return False
        self.times.append(at)
        return True


class SlidingSession:
    """A session of 24 hours, extended when less than half is left, for 7 days at most."""

    def __init__(self, life: int = 24 * HOUR, most: int = 7 * 24 * HOUR) -> None:
        self.life, self.most, self.number, self.start, self.end = life, most, 0, 0, -1

    def touch(self, at: int) -> int:
        if at >= self.end:
            self.number, self.start, self.end = self.number + 1, at, at + self.life
        elif self.end - at < self.life // 2:
            self.end = min(at + self.life, self.start + self.most)
        return self.number


class Streak:
    """Failures since the last success."""

    def __init__(self, count: int = 0) -> None:
        self.count = count

    def add(self, success: int) -> int:
        self.count = 0 if success else self.count + 1
        return self.count


def fold_by_key(log: DataFrame, make: Callable, step: Callable, out: str, kind: str) -> DataFrame:
    """log (key, id, at in microseconds, value) with a column out: step(state, at, value)
    in the order of at and id, from a fresh make() for each key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            got = []
            for key, at, value in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if key != last:
                    last, state = key, make()
                got.append(step(state, at, value))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(got)], ["key", "id", "at", out])

    ordered = log.select("key", "id", "at", "value").repartition("key").sortWithinPartitions("key", "at", "id")
    key = log.schema["key"].dataType.simpleString()
    return ordered.mapInArrow(work, f"key {key}, id long, at long, {out} {kind}")


def rate_limited(log: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    return fold_by_key(log, lambda: SlidingLog(limit, window_seconds * SECOND), lambda s, at, _: s.allow(at), "allowed", "boolean")


def sessions(log: DataFrame) -> DataFrame:
    return fold_by_key(log, SlidingSession, lambda s, at, _: s.touch(at), "session", "long")


def failure_streaks(log: DataFrame) -> DataFrame:
    """value: 1 for a success, 0 for a failure."""
    return fold_by_key(log, Streak, lambda s, _, value: s.add(value), "streak", "long")


def in_order(frames: Iterator[pd.DataFrame], *columns: str) -> Iterator[pd.DataFrame]:
    """A key's rows of one micro-batch by at and id, FRAME_ROWS at a time.

    Of the frames that come only these whole numbers are kept, 8 bytes each; a
    micro-batch is as large as the source's limit of files or offsets lets it be."""
    names = ("at", "id", *columns)
    held = [np.stack([f[c].to_numpy(np.int64) for c in names]) for f in frames]
    rows = np.concatenate(held, axis=1)
    held.clear()
    order = np.lexsort((rows[1], rows[0]))
    for a in range(0, len(order), FRAME_ROWS):
        yield pd.DataFrame(dict(zip(names, rows[:, order[a : a + FRAME_ROWS]], strict=True)))


def rate_limited_stream(stream: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """The limiter on a stream with columns key, id and at; its state outlives batches."""

    def work(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        log = SlidingLog(limit, window_seconds * SECOND, list(state.get[0]) if state.exists else None)
        for rows in in_order(frames):
            yield rows.assign(key=key[0], allowed=[log.allow(at) for at in rows["at"].tolist()])[["key", "id", "at", "allowed"]]
        state.update((list(log.times),))

    return stream.groupBy("key").applyInPandasWithState(work, "key long, id long, at long, allowed boolean", "times array<long>", "append", "NoTimeout")


def streak_stream(stream: DataFrame) -> DataFrame:
    """Failure streaks on a stream with columns key, id, at and value."""

    def work(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak = Streak(state.get[0] if state.exists else 0)
        for rows in in_order(frames, "value"):
            yield rows.assign(key=key[0], streak=[streak.add(v) for v in rows["value"].tolist()])[["key", "id", "at", "streak"]]
        state.update((streak.count,))

    return stream.groupBy("key").applyInPandasWithState(work, "key long, id long, at long, streak long", "count long", "append", "NoTimeout")


def once_per_ticket(stream: DataFrame, ticket: str, time: str, life: str = "5 minutes") -> DataFrame:
    """The first use of each ticket; later ones within its life are dropped."""
    return stream.withWatermark(time, life).dropDuplicatesWithinWatermark([ticket])


def first_uses(issued: DataFrame, uses: DataFrame, life_seconds: int) -> DataFrame:
    """uses (ticket, id, at in microseconds) with used: whether the ticket was issued (ticket, at)
    less than life_seconds before and hadn't been used. Only the first use in time can be that
    one, so an aggregate finds it and no ticket's uses meet in a window."""
    timed = uses.join(issued.select("ticket", F.col("at").alias("issued")), "ticket", "left")
    valid = (F.col("at") >= F.col("issued")) & (F.col("at") < F.col("issued") + life_seconds * SECOND)
    timed = timed.withColumn("valid", F.coalesce(valid, F.lit(False)))
    first = timed.where("valid").groupBy("ticket").agg(F.min(F.struct("at", "id")).getField("id").alias("first"))
    return timed.join(first, "ticket", "left").select("ticket", "id", "at", (F.col("valid") & F.coalesce(F.col("id") == F.col("first"), F.lit(False))).alias("used"))


def report_progress(stream: DataFrame, by: str, totals: DataFrame, folder: str) -> DataFrame:
    """Progress of a streamed import: what each batch adds by key goes to a sink of its own, a
    folder named by the batch, so that a batch made again replaces its report. Gives by, done,
    total and percent as of the last batch."""
    path = f"{folder.rstrip('/')}/progress-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.groupBy(by).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    kind = stream.schema[by].dataType.simpleString()
    done = stream.sparkSession.read.schema(f"{by} {kind}, n long, batch int").parquet(f"{path}/out").groupBy(by).agg(F.sum("n").alias("done"))
    return done.join(totals, by).select(by, "done", "total", F.floor(F.col("done") * 100 / F.col("total")).alias("percent"))


def tumbling_counts(stream: DataFrame, time: str, size: str, late: str, *by: str) -> DataFrame:
    """Counts by window and keys; a window comes out once nothing late can reach it."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), *by, "n")


def replayed(rows: DataFrame, folder: str, name: str) -> DataFrame:
    """rows as a stream: written below folder, and read from there as they would arrive."""
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def run_available(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Run a streaming query over what is there, into Parquet below folder, and read it."""
    spark: SparkSession = stream.sparkSession
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
