"""Stateful operators: accept-only rate limits, daily reservations, and windows over a stream of events."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, SECONDS, PAPERS = 3, 3600, 40


def accepted_calls(events: DataFrame, limit: int = LIMIT) -> DataFrame:
    """event_id, user_id, accepted: at most `limit` accepted calls in any hour; rejected ones aren't remembered. Calls stream by user in order of time."""
    own = events.select("event_id", "user_id", F.unix_timestamp("ts").alias("second")).repartition("user_id").sortWithinPartitions("user_id", "second", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict[int, deque[int]] = {}
        for batch in batches:
            for user, calls in batch.groupby("user_id", sort=False):
                if user not in memory:
                    memory = {user: deque()}  # users come one after the other
                held = memory[user]
                accepted = []
                for now in calls["second"]:
                    while held and held[0] <= now - SECONDS:
                        held.popleft()
                    accepted.append(len(held) < limit)
                    if accepted[-1]:
                        held.append(now)
                yield pd.DataFrame({"event_id": calls["event_id"], "user_id": user, "accepted": accepted})

    return own.mapInPandas(run, "event_id long, user_id long, accepted boolean")


def reserve_daily(events: DataFrame, papers: int = PAPERS) -> DataFrame:
    """day, event_id, n, reserved: requests of n papers in order of time, each granted whole or not at all while the day's quota lasts."""
    own = events.select(F.to_date("ts").cast("string").alias("day"), "event_id", F.unix_timestamp("ts").alias("second"), (F.col("event_id") % 5 + 1).alias("n")).repartition("day").sortWithinPartitions("day", "second", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        today, used = None, 0
        for batch in batches:
            granted = []
            for day, n in zip(batch["day"], batch["n"], strict=True):
                today, used = (today, used) if day == today else (day, 0)
                granted.append(used + n <= papers)
                used += n if granted[-1] else 0
            yield pd.DataFrame({"day": batch["day"], "event_id": batch["event_id"], "n": batch["n"], "reserved": granted})

    return own.mapInPandas(run, "day string, event_id long, n long, reserved boolean")


def timed(events: DataFrame, late: str) -> DataFrame:
    """ts as an instant (watermarks need one); on a stream with a watermark."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return own.withWatermark("ts", late) if own.isStreaming else own


def hourly_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events of each hour and kind, from a batch or a stream; a stream drops what is later than the watermark."""
    own = timed(events, late)
    return own.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    own = timed(events, late)
    return own.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("closes"), "n")


def first_lookups(events: DataFrame, key: str = "user_id", late: str = "1 hour") -> DataFrame:
    """One lookup for each key, as far back as the watermark remembers on a stream."""
    return timed(events, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
