"""Running queries: middleware, hooks, batches, a result cache, time limits and raw SQL."""

from __future__ import annotations

import hashlib
import random
import re
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .errors import InvalidQuery, TimedOut, classify


@dataclass
class Event:
    action: str
    model: str | None = None
    started: float = 0.0
    seconds: float = 0.0
    error: str | None = None
    notes: dict = field(default_factory=dict)


Middleware = Callable[[Event, Callable[[], Any]], Any]


class Runtime:
    """Actions pass through the middleware in order, and hooks see them before and after."""

    def __init__(self, spark: SparkSession):
        self.spark, self.middleware = spark, []
        self.hooks: dict[tuple[str, str], list[Callable[[Event], None]]] = {}

    def use(self, m: Middleware) -> Runtime:
        self.middleware.append(m)
        return self

    def on(self, when: str, action: str, hook: Callable[[Event], None]) -> Runtime:
        if when not in ("before", "after"):
            raise InvalidQuery("hooks run before or after")
        self.hooks.setdefault((when, action), []).append(hook)
        return self

    def run(self, action: str, f: Callable[[], Any], model: str | None = None) -> Any:
        event = Event(action, model, time.time())
        for h in self.hooks.get(("before", action), ()):
            h(event)
        call = f
        for m in reversed(self.middleware):
            call = lambda m=m, inner=call: m(event, inner)
        try:
            return call()
        except Exception as e:
            event.error = classify(e)
            raise
        finally:
            event.seconds = time.time() - event.started
            for h in self.hooks.get(("after", action), ()):
                h(event)

    def batch(self, frames: list[DataFrame], parallel: int = 1) -> list[list]:
        """The rows of several queries; with parallel, as jobs side by side. The first error ends the batch: queries that wait
        aren't started and those that run are cancelled."""
        if parallel <= 1:
            return [self.run("query", df.collect) for df in frames]
        tag, context, failed = uuid.uuid4().hex, self.spark.sparkContext, threading.Event()

        def one(df: DataFrame) -> list:
            if failed.is_set():
                raise InvalidQuery("the batch has ended")
            context.setJobGroup(tag, "batch", interruptOnCancel=True)
            try:
                return self.run("query", df.collect)
            except BaseException:
                failed.set()
                context.cancelJobGroup(tag)
                raise
            finally:
                context.setLocalProperty("spark.jobGroup.id", None)

        with ThreadPoolExecutor(parallel) as pool:
            jobs = [pool.submit(one, df) for df in frames]
            wait(jobs, return_when=FIRST_EXCEPTION)
            broken = [e for j in jobs if j.done() and (e := j.exception())]
            for j in jobs:
                j.cancel()
            if broken:
                raise next((e for e in broken if not isinstance(e, InvalidQuery)), broken[0])
            return [j.result() for j in jobs]

    def collect(self, df: DataFrame, seconds: float | None = None) -> list:
        """Rows; a query that runs longer is cancelled."""
        if seconds is None:
            return self.run("query", df.collect)
        tag, expired, context = uuid.uuid4().hex, threading.Event(), self.spark.sparkContext

        def stop():
            expired.set()
            context.cancelJobGroup(tag)

        def timed():
            context.setJobGroup(tag, "timed query", interruptOnCancel=True)
            timer = threading.Timer(seconds, stop)
            timer.start()
            try:
                return df.collect()
            except Exception as e:
                raise TimedOut(f"more than {seconds} s") if expired.is_set() else e
            finally:
                timer.cancel()
                context.setLocalProperty("spark.jobGroup.id", None)

        return self.run("query", timed)


def timing(log: list[tuple[str, float]]) -> Middleware:
    def run(event: Event, call):
        t = time.time()
        try:
            return call()
        finally:
            log.append((event.action, time.time() - t))

    return run


def retrying(times: int = 3, first: float = 0.1, most: float = 5.0, codes: tuple[str, ...] = ("P1001", "P1008", "P1017"), jitter: float = 0.1) -> Middleware:
    """Spark retries tasks itself; this is for actions that meet a failing outside system. Waits double and vary by the share jitter."""

    def run(event: Event, call):
        for k in range(times):
            try:
                return call()
            except Exception as e:
                if k + 1 == times or classify(e) not in codes:
                    raise
                time.sleep(min(most, first * 2**k) * (1 + random.uniform(-jitter, jitter)))

    return run


def transforming(f: Callable[[Any], Any]) -> Middleware:
    return lambda event, call: f(call())


class ResultCache:
    """Persisted results by plan, least recently used out first, with an age limit; invalidate by table."""

    def __init__(self, entries: int = 100, seconds: float = 300.0):
        self.entries, self.seconds = entries, seconds
        self.held: OrderedDict[str, tuple[float, DataFrame, tuple[str, ...]]] = OrderedDict()
        self.hits = self.misses = 0

    @staticmethod
    def key(df: DataFrame) -> str:
        return hashlib.sha256(f"{df.semanticHash()}:{df.schema.simpleString()}".encode()).hexdigest()

    def get(self, df: DataFrame, tables: tuple[str, ...] = ()) -> DataFrame:
        k, now = self.key(df), time.time()
        if k in self.held and now - self.held[k][0] <= self.seconds and self.held[k][1].sameSemantics(df):
            self.held.move_to_end(k)
            self.hits += 1
            return self.held[k][1]
        self.misses += 1
        self._drop(k)
        self.held[k] = (now, df.persist(), tables)
        while len(self.held) > self.entries:
            self._drop(next(iter(self.held)))
        return df

    def _drop(self, k: str) -> None:
        if k in self.held:
            self.held.pop(k)[1].unpersist()

    def invalidate(self, table: str | None = None) -> None:
        for k in [k for k, v in self.held.items() if table is None or table in v[2]]:
            self._drop(k)


#: Quoted text, quoted names and comments, which are left as they are; or a numbered argument.
_PART = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|\$(\d+)""", re.S)
_WITH = re.compile(r"\s*WITH\s+(RECURSIVE\s+)?", re.I)


def with_tables(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None, args=None) -> DataFrame:
    """Runs a query that reads the tables by their names, which no other query sees and which hide the session's own."""
    if not tables:
        return spark.sql(sql, args=args)
    views = {name: f"_marlstone_{uuid.uuid4().hex}" for name in tables}
    m = _WITH.match(sql)
    rest = f", {sql[m.end():]}" if m else f" {sql}"
    named = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(views[name])
        return spark.sql(f"WITH {'RECURSIVE ' if m and m[1] else ''}{named}{rest}", args=args)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def raw_query(spark: SparkSession, sql: str, *args, tables: dict[str, DataFrame] | None = None, **named) -> DataFrame:
    """SQL with ?, $n or :name arguments, bound and never pasted in. Text in quotes and comments is left alone."""
    if args and named:
        raise InvalidQuery("positional and named arguments don't mix")
    numbers: list[int] = []

    def place(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        numbers.append(int(m[1]))
        return "?"

    text = _PART.sub(place, sql)
    if numbers and not 1 <= min(numbers) <= max(numbers) <= len(args):
        raise InvalidQuery(f"${max(numbers)} has no argument")
    given = [args[n - 1] for n in numbers] if numbers else list(args) if args else named or None
    return with_tables(spark, text, tables, given)


def raw_exec(spark: SparkSession, sql: str, *args, **named) -> int:
    """Runs a statement and returns how many rows it says it changed; 0 where the table's format doesn't tell."""
    rows = raw_query(spark, sql, *args, **named).collect()
    return int(rows[0]["num_affected_rows"]) if rows and "num_affected_rows" in rows[0] else 0


def raw_into(spark: SparkSession, cls: type, sql: str, *args, tables: dict[str, DataFrame] | None = None, **named) -> list:
    """The rows of a raw query as dataclass instances."""
    from ..sources.tables import to_objects

    return to_objects(raw_query(spark, sql, *args, tables=tables, **named), cls)
