"""Notifications as a keyed state machine with event-time timers.

Firing steps are held until the watermark has passed them and are then taken in order, so it does
not matter in which batches or in which order they came. What becomes due without a further row
(the last repeats, the notice that a group has resolved, the end of a group) is brought about by
timers; a group that has resolved leaves no state behind.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MICRO = 1_000_000

#: A group's session and, as three arrays, the steps that the watermark has not passed yet.
STATE = (
    "start_us BIGINT, last_k BIGINT, notified_us BIGINT, again_us BIGINT, waiting ARRAY<BIGINT>,"
    " ahead_k ARRAY<BIGINT>, ahead_changed ARRAY<BIGINT>, ahead_repeat_s ARRAY<BIGINT>"
)
#: Groups that are kept as one row of state: their keys, sessions, steps ahead and next moments.
BUCKET_STATE = "groups STRING"
#: How many such rows a stream has. Python is called once for each of them that a batch touches,
#: not once a group; a row that is touched is written whole.
BUCKETS = 1024
#: A state store that holds more groups than the memory of an executor.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Session:
    """A group from its first firing step on. Times are microseconds, steps are numbers of width
    ``width``; ``notified_us`` and ``last_k`` are -1 and None before the first notice and step."""

    width: int
    wait: int
    every: int
    start_us: int = 0
    last_k: int | None = None
    notified_us: int = -1
    again_us: int = 0
    waiting: list[int] = field(default_factory=list)

    def step(self, k: int, changed: bool, repeat_s: int) -> list[tuple[int, str]]:
        """Take the group's next firing step; notices that fall due by its end."""
        sent = []
        if self.last_k is None or k != self.last_k + 1:
            sent = self.ended(k * self.width)
            self.start_us, self.notified_us, self.waiting = k * self.width + self.wait, -1, []
        self.last_k, self.again_us = k, -(-repeat_s * MICRO // self.every) * self.every
        if changed:
            tick = self.start_us + -(-max(k * self.width - self.start_us, 0) // self.every) * self.every
            if tick not in self.waiting:
                self.waiting.append(tick)
        while True:
            due = self.waiting[:1] + ([self.notified_us + self.again_us] if self.notified_us >= 0 else [])
            if not due or min(due) >= (k + 1) * self.width:
                return sent
            fresh = self.waiting[:1] == [min(due)]
            self.notified_us = self.waiting.pop(0) if fresh else min(due)
            sent.append((self.notified_us, "new" if fresh else "repeat"))

    def look_us(self) -> int:
        """The first look at the group after its last firing step."""
        return self.start_us + -(-((self.last_k + 1) * self.width - self.start_us) // self.every) * self.every

    def ended(self, next_us: int | None = None) -> list[tuple[int, str]]:
        """The notice that it has resolved, unless it fires again at ``next_us`` before that."""
        if self.last_k is None or self.notified_us < 0 or (next_us is not None and next_us <= self.look_us()):
            return []
        return [(self.look_us(), "resolved")]

    def over_us(self) -> int:
        """When it is certain that the group has not fired again by its look."""
        return (self.look_us() if self.notified_us >= 0 else (self.last_k + 1) * self.width) + self.width


class Notices:
    """Rows in: ``by``, k, changed, repeat_s; rows out: ``by``, notify_us, reason.

    The state of a group is read and written once a batch, and it has one timer: the first moment
    at which the watermark brings a step or the end of the session.
    """

    def __init__(self, by: list[str], step_s: int, wait_s: int, interval_s: int):
        self.by, self.width, self.wait, self.every = by, step_s * MICRO, wait_s * MICRO, interval_s * MICRO

    @staticmethod
    def put(ahead: dict[int, tuple[int, int]], k: int, changed: int, repeat_s: int) -> None:
        """Hold a step until its time; rows of one step are taken together."""
        before = ahead.get(k, (changed, repeat_s))
        ahead[k] = max(changed, before[0]), min(repeat_s, before[1])

    def advance(self, session: Session, ahead: dict[int, tuple[int, int]], now_us: int) -> tuple[Session, list[tuple[int, str]], int | None]:
        """Take the steps up to ``now_us`` out of ``ahead``. The session as it is then, the notices
        that fell due, and the next moment at which there is something to do (None: nothing left)."""
        sent = []
        for k in sorted(k for k in ahead if (k + 1) * self.width <= now_us):
            changed, repeat_s = ahead.pop(k)
            sent += session.step(k, bool(changed), repeat_s)
        if session.last_k is not None and session.over_us() <= now_us:
            sent += session.ended()
            session = Session(self.width, self.wait, self.every)
        due = [(min(ahead) + 1) * self.width] if ahead else []
        due += [session.over_us()] if session.last_k is not None else []
        return session, sent, min(due, default=None)

    @staticmethod
    def timer(due_us: int, watermark_ms: int) -> int:
        """A timer runs once the watermark is past it; it has to lie ahead of the watermark."""
        return max(-(-due_us // 1000) - 1, watermark_ms + 1)

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, ahead = Session(self.width, self.wait, self.every), {}
        if state.exists:
            start, last_k, notified, again, waiting, *steps = state.get
            session = Session(self.width, self.wait, self.every, start, last_k, notified, again, list(waiting))
            ahead = {k: (changed, repeat_s) for k, changed, repeat_s in zip(*steps)}
        for batch in batches:
            for k, changed, repeat_s in zip(batch["k"].tolist(), batch["changed"].tolist(), batch["repeat_s"].tolist()):
                self.put(ahead, int(k), int(changed), int(repeat_s))
        watermark = state.getCurrentWatermarkMs()
        session, sent, due = self.advance(session, ahead, watermark * 1000)
        if due is not None:
            ks = sorted(ahead)
            state.update((
                session.start_us, session.last_k, session.notified_us, session.again_us, session.waiting,
                ks, [ahead[k][0] for k in ks], [ahead[k][1] for k in ks],
            ))
            state.setTimeoutTimestamp(self.timer(due, watermark))
        elif state.exists:
            state.remove()
        if sent:
            yield pd.DataFrame(
                {**{c: [v] * len(sent) for c, v in zip(self.by, key)}, "notify_us": [at for at, _ in sent], "reason": [why for _, why in sent]}
            )


def rows_of(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """Rows as plain tuples: there are many groups and few rows in each."""
    for batch in batches:
        yield from zip(*[batch[c].tolist() for c in columns])


def told(by: list[str], sent: list[tuple]) -> Iterator[pd.DataFrame]:
    """Notices (key, microseconds, reason) as one frame, or none."""
    if sent:
        yield pd.DataFrame(
            {**{c: [key[i] for key, _, _ in sent] for i, c in enumerate(by)}, "notify_us": [at for _, at, _ in sent], "reason": [why for _, _, why in sent]}
        )


def bucket_of(by: list[str], buckets: int) -> Column:
    """A group's bucket; NULL and text never get in each other's way, the key itself is compared."""
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


class BucketNotices:
    """``Notices`` of all groups of a bucket at once, with one timer for the earliest of them."""

    def __init__(self, notices: Notices):
        self.notices = notices

    def __call__(self, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        notices, groups, fresh = self.notices, {}, set()
        by, shape = notices.by, (notices.width, notices.wait, notices.every)
        if state.exists:
            for key, session, ahead, due in json.loads(state.get[0]):
                groups[tuple(key)] = [session, {k: (changed, repeat_s) for k, changed, repeat_s in ahead}, due]
        for *key, k, changed, repeat_s in rows_of(batches, [*by, "k", "changed", "repeat_s"]):
            key = tuple(key)
            fresh.add(key)
            notices.put(groups.setdefault(key, [None, {}, None])[1], int(k), int(changed), int(repeat_s))
        watermark, sent = state.getCurrentWatermarkMs(), []
        for key in [key for key, (_, _, due) in groups.items() if key in fresh or due <= watermark * 1000]:
            given, ahead, _ = groups[key]
            session, notes, due = notices.advance(Session(*shape, *(given or [])), ahead, watermark * 1000)
            sent += [(key, at, why) for at, why in notes]
            if due is None:
                del groups[key]
                continue
            idle = session.last_k is None
            groups[key] = [None if idle else [session.start_us, session.last_k, session.notified_us, session.again_us, session.waiting], ahead, due]
        if groups:
            kept = [[key, session, [[k, *x] for k, x in ahead.items()], due] for key, (session, ahead, due) in groups.items()]
            state.update((json.dumps(kept, separators=(",", ":")),))
            state.setTimeoutTimestamp(notices.timer(min(due for _, _, due in groups.values()), watermark))
        elif state.exists:
            state.remove()
        yield from told(by, sent)


def notice_stream(
    steps: DataFrame, by: list[str], step_s: int, wait_s: int, interval_s: int, late_s: int = 0, buckets: int | None = BUCKETS
) -> DataFrame:
    """Notifications of each group: new, repeated and, at its end, resolved.

    ``steps`` is a stream of firing alerts or groups of them (``by``, k, changed, repeat_s), in
    any order up to ``late_s``. Time is that of the whole stream: a step of any group, or a clock
    row with other values in ``by``, lets the timers of all groups run. ``buckets`` rows of state
    hold all groups; with None each group has its own, which suits few groups in many batches.
    """
    clocked = steps.withColumn("t", F.timestamp_micros(F.col("k") * step_s * MICRO)).withWatermark("t", f"{late_s} seconds")
    output = ", ".join([*(f"{c} STRING" for c in by), "notify_us BIGINT", "reason STRING"])
    notices = Notices(by, step_s, wait_s, interval_s)
    of_bucket = BucketNotices(notices)

    def advance(key, batches, state):  # a plain function: Spark looks at its signature
        return notices(key, batches, state) if buckets is None else of_bucket(batches, state)

    grouped = clocked.groupBy(*by) if buckets is None else clocked.withColumn("_bucket", bucket_of(by, buckets)).groupBy("_bucket")
    sent = grouped.applyInPandasWithState(advance, output, STATE if buckets is None else BUCKET_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return sent.select(*by, F.timestamp_micros("notify_us").cast("timestamp_ntz").alias("notify_at"), "reason")
