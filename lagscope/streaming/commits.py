"""Committed offsets with both sides as streams.

Scrapes ask for the committed offset of their assigned partitions, and
commits arrive as a stream of their own. Both are merged in one keyed state
per (group, topic, partition) in event-time order: a question is answered once
the watermark has passed it (the slower of both streams decides), with the
latest commit at or before it by (time, offset), or -1 from a timer when there
is none. No commit folder is ever read again, and state keeps one commit behind the
watermark, and in front of it what the watermark's delay can hold.

A commit that arrives after the watermark has passed it is not lost: Spark
hands over rows behind the watermark to no one, so give such sources a
watermark delay that covers their lateness; there is no second bound.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lagscope.operators import groups as GR
from lagscope.streaming.jobs import _run
from lagscope.streaming.processors import _schema

KEYS = ["group_id", "topic", "partition"]

COMMIT_STATE = _schema("last_t bigint, last_o bigint, has boolean, "
                       "pend_t array<bigint>, pend_o array<bigint>, asked array<bigint>")


class CommitProcessor(StatefulProcessor):
    """Rows: ``us`` (event time in microseconds) and ``offset`` (null: a
    scrape asks). Emits ``(keys, scrape_ts, committed)`` per question, once."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("commits", COMMIT_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        st = self._load()
        commits, asked = list(zip(st[3] or [], st[4] or [])), set(st[5] or [])
        for b in rows:
            asks = b["is_scrape"].to_numpy(bool)
            us = b["us"].to_numpy(np.int64)
            asked.update(us[asks].tolist())
            commits += zip(us[~asks].tolist(), b["offset"][~asks].astype(np.int64).tolist())
        commits = sorted(set(commits))
        st[3], st[4], st[5] = [c[0] for c in commits], [c[1] for c in commits], sorted(asked)
        yield from self._emit(key, st, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._emit(key, self._load(), timerValues)

    def _load(self) -> list:
        return list(self.state.get()) if self.state.exists() else [None, None, False, [], [], []]

    def _emit(self, key, st: list, timerValues) -> Iterator[pd.DataFrame]:
        """Answers what lies before the watermark, and folds the commits there
        into the last one."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        times, offsets = list(st[3] or []), list(st[4] or [])
        asked = list(st[5] or [])
        due = [t for t in asked if t < passed]
        if due:
            at = np.searchsorted(np.array(times, np.int64), np.array(due, np.int64), side="right") - 1
            none = st[1] if st[2] else -1
            # commits behind the last one came late and stand no more
            out = [none if i < 0 or (st[2] and (times[i], offsets[i]) < (st[0], st[1])) else offsets[i] for i in at]
            yield pd.DataFrame({**{k: [v] * len(due) for k, v in zip(self.keys, key)},
                                "scrape_ts": pd.to_datetime(np.array(due, np.int64), unit="us", utc=True),
                                "committed": np.array(out, np.int64)})
        n = int(np.searchsorted(np.array(times, np.int64), passed, side="left"))
        if n and (not st[2] or (times[n - 1], offsets[n - 1]) > (st[0], st[1])):
            st[0], st[1], st[2] = times[n - 1], offsets[n - 1], True
        st[3], st[4], st[5] = times[n:], offsets[n:], asked[len(due):]
        self.state.update(tuple(st))
        waiting = st[5][:1] or st[3][:1]
        if waiting:
            self.handle.registerTimer(waiting[0] // 1000 + 1)

    def close(self) -> None:
        pass


def assignment_stream(listings: DataFrame, descriptions: DataFrame, out: str, ckpt: str,
                      available_now: bool = True):
    """Assigned partitions of each scrape from streams of listings and
    descriptions (both watermarked on ``scrape_ts``): a stream-stream join on
    scrape and group, whose state is dropped as the watermark passes. A
    partition may come out more than once, as groups are listed by several
    brokers; ``committed_stream`` answers it once."""
    listed = listings.select("scrape_ts", "group_id")
    described = GR.stable_consumer_filter(listed.join(descriptions, ["scrape_ts", "group_id"]))
    rows = (described.select("scrape_ts", "group_id", F.explode("members").alias("m"))
            .select("scrape_ts", "group_id", F.explode("m.assignment").alias("topic", "parts"))
            .select("scrape_ts", "group_id", "topic", F.explode("parts").alias("partition")))
    w = rows.writeStream.format("parquet").option("checkpointLocation", ckpt).option("path", out)
    return _run(w.outputMode("append"), available_now)


def committed_stream(assigned: DataFrame, commits: DataFrame, out: str, ckpt: str,
                     available_now: bool = True):
    """``(scrape_ts, group_id, topic, partition, committed)`` for every
    assigned partition. ``assigned`` has its watermark on ``scrape_ts``,
    ``commits`` on ``commit_ts``; rows may come in any order within them."""
    keys = [F.col(k).cast("string").alias(k) for k in KEYS]
    asked = assigned.select(*keys, F.col("scrape_ts").alias("at"), F.lit(True).alias("is_scrape"),
                            F.lit(0).cast("bigint").alias("offset"))
    given = commits.select(*keys, F.col("commit_ts").alias("at"), F.lit(False).alias("is_scrape"), "offset")
    both = asked.unionByName(given).withColumn("us", F.unix_micros("at"))
    rows = (both.groupBy(*KEYS)
            .transformWithStateInPandas(CommitProcessor(KEYS), "group_id string, topic string, partition string, "
                                        "scrape_ts timestamp, committed bigint", "Append", "EventTime")
            .withColumn("partition", F.col("partition").cast("int")))
    w = rows.writeStream.format("parquet").option("checkpointLocation", ckpt).option("path", out)
    return _run(w.outputMode("append"), available_now)
