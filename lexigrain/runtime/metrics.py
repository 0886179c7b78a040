"""Stage timers and counters of a job, progress, and stopping it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Metrics:
    """Milliseconds of named stages and of all, and counters that plans fill in as they run."""

    def __init__(self, progress: Callable[[str], None] | None = None):
        self.began, self.stages, self.observed, self.progress = time.perf_counter(), {}, {}, progress

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        """Times a block of work, told to ``progress`` when it begins; a stage that comes again is added up."""
        if self.progress:
            self.progress(name)
        began = time.perf_counter()
        try:
            yield
        finally:
            self.stages[name] = self.stages.get(name, 0.0) + (time.perf_counter() - began) * 1000

    def counted(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as it is; its rows are counted by the job that runs it, not by one of its own."""
        seen = Observation(name)
        self.observed[name] = seen
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def report(self) -> dict:
        """``total_ms``, ``stages_ms`` and ``counters``; a plan must have run before its counter is asked."""
        return {"total_ms": (time.perf_counter() - self.began) * 1000, "stages_ms": dict(self.stages), "counters": {n: o.get["rows"] for n, o in self.observed.items()}}


class Cancelled(RuntimeError):
    """The work was stopped from outside."""


class Control:
    """Jobs started under a tag, which one call stops."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.stopped = spark, tag, False

    def __enter__(self) -> Control:
        self.spark.sparkContext.addJobTag(self.tag)
        return self

    def __exit__(self, *_) -> None:
        self.spark.sparkContext.removeJobTag(self.tag)

    def checkpoint(self, stage: str) -> None:
        """Raises Cancelled, naming the stage, after ``stop``."""
        if self.stopped:
            raise Cancelled(f"stopped before {stage}")

    def stop(self) -> None:
        self.stopped = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


def session_bytes(entries: int, xml_sizes: list[int], binary: int) -> int:
    """What a session over a package is expected to hold: 1 MiB, 1 KiB an entry, twice its XML, twelve times the largest part, binaries up to 8 MiB."""
    return (1 << 20) + (1 << 10) * entries + 2 * sum(xml_sizes) + 12 * max(xml_sizes, default=0) + min(binary, 8 << 20)


class Admission:
    """Reserves expected bytes for sessions; the longest unused ones make room, and what can't fit is refused."""

    def __init__(self, most_bytes: int = 512 << 20, most_sessions: int = 4):
        self.most_bytes, self.most_sessions = most_bytes, most_sessions
        self.held: dict[str, int] = {}
        self.used: dict[str, float] = {}

    def admit(self, key: str, size: int) -> list[str]:
        """The sessions that have to be closed for this one; MemoryError where it can't fit alone."""
        if size > self.most_bytes:
            raise MemoryError(f"{size} bytes are more than {self.most_bytes}")
        closed = []
        while self.held and key not in self.held and (sum(self.held.values()) + size > self.most_bytes or len(self.held) >= self.most_sessions):
            oldest = min(self.held, key=self.used.__getitem__)
            self.release(oldest)
            closed.append(oldest)
        self.held[key], self.used[key] = size, time.monotonic()
        return closed

    def touch(self, key: str) -> None:
        if key in self.held:
            self.used[key] = time.monotonic()

    def release(self, key: str) -> None:
        self.held.pop(key, None)
        self.used.pop(key, None)

    def expired(self, idle: float = 600.0) -> list[str]:
        """Sessions not used for ``idle`` seconds, released."""
        now = time.monotonic()
        gone = [k for k, t in self.used.items() if now - t >= idle]
        for k in gone:
            self.release(k)
        return gone


class Results:
    """Texts and bytes kept for reading in pieces, the oldest dropped beyond a bound in bytes."""

    def __init__(self, most_bytes: int = 64 << 20, idle: float = 600.0):
        self.most_bytes, self.idle, self.number = most_bytes, idle, 0
        self.held: dict[str, tuple[str | bytes, str, float]] = {}

    @staticmethod
    def size(value: str | bytes) -> int:
        return len(value.encode()) if isinstance(value, str) else len(value)

    def put(self, value: str | bytes, owner: str = "") -> str:
        """Keeps a value and gives its id; ValueError for one larger than the bound."""
        if self.size(value) > self.most_bytes:
            raise ValueError("the result is larger than what is kept")
        self.expire()
        while sum(self.size(v) for v, _, _ in self.held.values()) + self.size(value) > self.most_bytes:
            del self.held[next(iter(self.held))]
        self.number += 1
        key = f"result-{self.number}"
        self.held[key] = (value, owner, time.monotonic())
        return key

    def read(self, key: str, offset: int = 0, length: int = 12_000) -> dict:
        """A piece of a value and where the next one begins; KeyError for one that isn't kept."""
        if offset < 0 or length < 1:
            raise ValueError("offset isn't negative, length is 1 at least")
        value, owner, _ = self.held.pop(key)
        self.held[key] = (value, owner, time.monotonic())
        end = min(len(value), offset + length)
        return {"piece": value[offset:end], "total": len(value), "next_offset": end if end < len(value) else None}

    def release(self, owner: str) -> None:
        self.held = {k: v for k, v in self.held.items() if v[1] != owner}

    def expire(self) -> None:
        now = time.monotonic()
        self.held = {k: v for k, v in self.held.items() if now - v[2] < self.idle}
