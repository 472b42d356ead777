"""Order-dependent decisions per key, in Arrow groups, and their streaming twins in lexquarry.streaming.

Each works on one key's rows in time order; a key's rows are read in batches, so a busy key needs no more memory than
its window. Times are epoch microseconds.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SlidingWindow:
    """At most `limit` accepted events in the last `width` microseconds; refused ones do not count."""

    def __init__(self, limit: int, width: int):
        self.limit, self.width, self.accepted = limit, width, deque()

    def take(self, at: int) -> tuple[bool, int]:
        """Whether the event is accepted, and else how long to wait."""
        while self.accepted and self.accepted[0] <= at - self.width:
            self.accepted.popleft()
        if len(self.accepted) >= self.limit:
            return False, self.accepted[0] + self.width - at
        self.accepted.append(at)
        return True, 0


class FloodShaping:
    """At most `limit` records a window that begins with its first record; the left-out count goes with the next kept one."""

    def __init__(self, limit: int, width: int):
        self.limit, self.width = limit, width
        self.began, self.seen, self.left_out = None, 0, 0

    def filter(self, at: int) -> int | None:
        """None if the record is left out, else how many were left out before it."""
        if self.began is None or at - self.began >= self.width:
            self.began, self.seen = at, 0
        self.seen += 1
        if self.seen > self.limit:
            self.left_out += 1
            return None
        said, self.left_out = self.left_out, 0
        return said


class Waker:
    """When a request may wake a model: not while it answered lately or a wake-up runs, and so often a UTC day at most."""

    def __init__(self, awake_s: int, takes_s: int, per_day: int, heard: int | None = None, started: int | None = None, day: int | None = None, spent: int = 0):
        self.awake, self.takes, self.per_day = awake_s * 1_000_000, takes_s * 1_000_000, per_day
        self.heard, self.started, self.day, self.spent = heard, started, day, spent

    def take(self, at: int, kind: str) -> str | None:
        """What a request is told; None for an answer, which is only heard. A wake-up that is done has been heard, too."""
        if self.started is not None and at >= self.started + self.takes:
            self.heard, self.started = max(self.heard or 0, self.started + self.takes), None
        if kind == "click":
            self.heard = at
            return None
        if self.started is not None:
            return "waking"
        if self.heard is not None and at - self.heard < self.awake:
            return "awake"
        if (day := at // 86_400_000_000) != self.day:
            self.day, self.spent = day, 0
        if self.spent >= self.per_day:
            return "limit"
        self.spent, self.started = self.spent + 1, at
        return "woken"


def _by_key(df: DataFrame, key: str, order: list[str], make, step, ddl: str) -> DataFrame:
    """make() a state for each key and step(state, row) -> output tuple or None, rows in order.

    One pass over partitions that hold whole keys, sorted by Spark: state is one object, whatever the key's size.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, fresh = None, None, True
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if fresh or row[key] != current:
                    state, current, fresh = make(), row[key], False
                if (made := step(state, row)) is not None:
                    out.append(made)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(v), type=f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _micros(df: DataFrame, at: str) -> DataFrame:
    return df.withColumn("__at", F.unix_micros(F.col(at).cast("timestamp")))


def sliding_admission(events: DataFrame, limit: int, width_seconds: int, key: str = "user_id", at: str = "ts", ident: str = "event_id") -> DataFrame:
    """Every event with whether it was accepted and the seconds to wait if not."""

    def step(state, row):
        accepted, wait = state.take(row["__at"])
        return row[key], row[ident], accepted, -(-wait // 1_000_000)

    rows = _micros(events.select(key, ident, at), at).select(key, ident, "__at")
    return _by_key(rows, key, ["__at", ident], lambda: SlidingWindow(limit, width_seconds * 1_000_000), step, f"{key} bigint, {ident} bigint, accepted boolean, wait_seconds bigint")


def shape_flood(events: DataFrame, limit: int, width_seconds: int, key: str, at: str = "ts", ident: str = "event_id") -> DataFrame:
    """The kept records, each with how many were left out before it."""

    def step(state, row):
        said = state.filter(row["__at"])
        return None if said is None else (row[key], row[ident], said)

    rows = _micros(events.select(key, ident, at), at).select(key, ident, "__at")
    return _by_key(rows, key, ["__at", ident], lambda: FloodShaping(limit, width_seconds * 1_000_000), step, f"{key} {dict(events.dtypes)[key]}, {ident} bigint, left_out bigint")


class Admission:
    """Two queues in front of one server: after `weight` from the first queue one from the second; or plain arrival order."""

    def __init__(self, weight: int = 4, fifo: bool = False):
        self.weight, self.fifo = weight, fifo

    def simulate(self, jobs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
        """jobs: (id, arrival, service, queue 0 or 1) -> (id, wait, waiting jobs when it began)."""
        jobs = sorted(jobs, key=lambda j: (j[1], j[0]))
        queues: tuple[deque, deque] = (deque(), deque())
        out, clock, k, turn = [], 0, 0, 0
        while k < len(jobs) or queues[0] or queues[1]:
            if not queues[0] and not queues[1]:
                clock = max(clock, jobs[k][1])
            while k < len(jobs) and jobs[k][1] <= clock:
                queues[jobs[k][3]].append(jobs[k])
                k += 1
            if self.fifo:
                pick = min((q for q in (0, 1) if queues[q]), key=lambda q: (queues[q][0][1], queues[q][0][0]))
            elif queues[0] and queues[1]:
                pick = 1 if turn >= self.weight else 0
            else:
                pick = 0 if queues[0] else 1
            turn = turn + 1 if pick == 0 else 0
            job = queues[pick].popleft()
            out.append((job[0], clock - job[1], len(queues[0]) + len(queues[1])))
            clock += job[2]
        return out


def admission_waits(jobs: DataFrame, fifo: bool, weight: int = 4) -> DataFrame:
    """jobs: server, job_id, arrival, service, queue (bigint) -> waits by server; one server is one ordered simulation."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*[table.column(c).to_pylist() for c in ("job_id", "arrival", "service", "queue")]))
        server = table.column("server")[0].as_py()
        done = Admission(weight, fifo).simulate(rows)
        return pa.table({"server": pa.array([server] * len(done), pa.int64()), **{n: pa.array([d[k] for d in done], pa.int64()) for k, n in enumerate(("job_id", "wait", "depth"))}})

    return jobs.groupBy("server").applyInArrow(run, "server bigint, job_id bigint, wait bigint, depth bigint")


def lives(events: DataFrame, ttl_seconds: int, key: str = "user_id", at: str = "ts", ident: str = "event_id") -> DataFrame:
    """Every event with the start of the life it falls into: the first event of a key begins one, as does the first after it ends."""

    def step(state: list, row):
        if not state or row["__at"] >= state[0] + ttl_seconds * 1_000_000:
            state[:] = [row["__at"]]
        return row[key], row[ident], state[0]

    rows = _micros(events.select(key, ident, at), at).select(key, ident, "__at")
    return _by_key(rows, key, ["__at", ident], list, step, f"{key} bigint, {ident} bigint, began bigint")


def wake_states(events: DataFrame, models: int, awake_s: int, takes_s: int, per_day: int) -> DataFrame:
    """What each request of each model is told; a click is an answer, anything else a request."""

    def step(state: Waker, row):
        said = state.take(row["__at"], row["event_type"])
        return None if said is None else (row["model"], row["event_id"], said)

    rows = _micros(events.select((F.col("user_id") % models).alias("model"), "event_id", "event_type", "ts"), "ts").select("model", "event_id", "event_type", "__at")
    return _by_key(rows, "model", ["__at", "event_id"], lambda: Waker(awake_s, takes_s, per_day), step, "model bigint, event_id bigint, state string")
