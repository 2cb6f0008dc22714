"""Policy queries over ordered events and call edges: matching, reach, missing guard, missing clean-up, forbidden flow.

A query is a small frozen object; compiling it gives a plan. Results carry status, precision and confidence columns, so an
empty answer is not taken for a proof. Events are rows (scope, position, name): the scope is a function, user or session,
the position its order in it. Nulls in scope or name match nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import CONFIDENCE_RANK, is_http_source, is_logger, names_call, passes_floor, rank
from ..functions.text import contains_any_folded
from .fixpoint import bounded_paths


@dataclass(frozen=True)
class EventPattern:
    """Calls of a target (whole name or last dotted segment), or writes of a field, of which no facts exist."""

    target: str
    kind: str = "call"

    @staticmethod
    def call(target: str) -> EventPattern:
        return EventPattern(target)

    @staticmethod
    def write_field(name: str) -> EventPattern:
        return EventPattern(name, "write_field")

    def matches(self, name: Column) -> Column:
        return names_call(name, self.target) if self.kind == "call" else F.lit(False)


@dataclass(frozen=True)
class GuardPattern:
    targets: tuple[str, ...]

    @staticmethod
    def call_any(*targets: str) -> GuardPattern:
        return GuardPattern(targets)

    def matches(self, name: Column) -> Column:
        out = F.lit(False)
        for t in self.targets:
            out = out | names_call(name, t)
        return out


class BarrierPattern(GuardPattern):
    @staticmethod
    def none() -> BarrierPattern:
        return BarrierPattern(())

    @staticmethod
    def call_any(*targets: str) -> BarrierPattern:
        return BarrierPattern(targets)


@dataclass(frozen=True)
class SourcePattern:
    """HTTP request data, or names that look like one of the given secrets."""

    kind: str
    names: tuple[str, ...] = ()

    @staticmethod
    def http_request() -> SourcePattern:
        return SourcePattern("http")

    @staticmethod
    def secret_like(*names: str) -> SourcePattern:
        return SourcePattern("secret", names)

    def matches(self, name: Column) -> Column:
        return is_http_source(name) if self.kind == "http" else contains_any_folded(name, list(self.names))


@dataclass(frozen=True)
class SinkPattern:
    kind: str
    target: str = ""

    @staticmethod
    def call(target: str) -> SinkPattern:
        return SinkPattern("call", target)

    @staticmethod
    def logger() -> SinkPattern:
        return SinkPattern("logger")

    def matches(self, name: Column) -> Column:
        return names_call(name, self.target) if self.kind == "call" else is_logger(name)


@dataclass(frozen=True)
class ReachQuery:
    target: EventPattern
    roots: tuple[str, ...] = ()
    max_depth: int = 20
    max_paths: int = 20
    min_confidence: str = "low"
    min_precision: str = "conservative"


@dataclass(frozen=True)
class GuardQuery:
    event: EventPattern
    guard: GuardPattern
    max_depth: int = 4
    max_paths: int = 20


@dataclass(frozen=True)
class LifecycleQuery:
    start: EventPattern
    cleanup: EventPattern
    max_depth: int = 4
    max_paths: int = 20


@dataclass(frozen=True)
class FlowQuery:
    source: SourcePattern | EventPattern
    sink: SinkPattern | EventPattern
    barrier: BarrierPattern = field(default_factory=BarrierPattern.none)
    max_depth: int = 8
    max_paths: int | None = 20
    min_precision: str = "conservative"


def events_matching(events: DataFrame, pattern: EventPattern) -> DataFrame:
    return events.where(F.coalesce(pattern.matches(F.col("name")), F.lit(False)))


def missing_guard(events: DataFrame, query: GuardQuery) -> DataFrame:
    """Events without an earlier guard in their scope.

    The first guard of each scope is an aggregate with partial combination; it meets the events on the scope, so neither
    side is gathered, whatever the number of events of a scope.
    """
    if query.max_depth == 0 or query.max_paths == 0:
        return events.limit(0)
    first = events.where(query.guard.matches(F.col("name"))).groupBy("scope").agg(F.min("position").alias("__first"))
    hit = events_matching(events, query.event).join(first, "scope", "left")
    return hit.where(F.col("__first").isNull() | (F.col("__first") >= F.col("position"))).drop("__first")


def missing_cleanup(events: DataFrame, query: LifecycleQuery) -> DataFrame:
    """Starts without a later clean-up in their scope."""
    if query.max_depth == 0 or query.max_paths == 0:
        return events.limit(0)
    last = events_matching(events, query.cleanup).groupBy("scope").agg(F.max("position").alias("__last"))
    hit = events_matching(events, query.start).join(last, "scope", "left")
    return hit.where(F.col("__last").isNull() | (F.col("__last") <= F.col("position"))).drop("__last")


def forbidden_flow(events: DataFrame, query: FlowQuery) -> DataFrame:
    """Pairs (scope, source, sink, steps) of a source event and a later sink of the same scope, without a barrier between.

    Between two barriers of a scope lies a segment; only the ``max_depth`` events after a source are looked at, so each
    event meets at most that many others.
    """
    if query.max_depth == 0 or query.max_paths == 0:
        return events.select("scope", F.col("position").alias("source"), F.col("position").alias("sink"), F.lit(0).alias("steps")).limit(0)
    w = Window.partitionBy("scope").orderBy("position")
    ahead = F.collect_list(F.struct("position", "name")).over(w.rowsBetween(1, query.max_depth))
    x = events.withColumn("ahead", ahead).where(query.source.matches(F.col("name")))
    later = x.select("scope", F.col("position").alias("source"), "ahead", F.posexplode("ahead").alias("i", "e"))
    open_ = ~F.exists(F.slice("ahead", F.lit(1), F.col("i")), lambda b: F.coalesce(query.barrier.matches(b["name"]), F.lit(False)))
    return later.where(F.coalesce(query.sink.matches(F.col("e.name")), F.lit(False)) & open_).select("scope", "source", F.col("e.position").alias("sink"), (F.col("i") + 1).alias("steps"))


def forbidden_reachable(edges: DataFrame, roots: DataFrame, query: ReachQuery) -> DataFrame:
    """Paths from the roots to calls of the target.

    edges (src, dst, name, status, precision, confidence). Edges below the floors are dropped, but statuses that are
    not resolved pass the precision floor: they can be hits, yet only resolved edges are followed.
    """
    kept = edges.where((rank(F.col("confidence"), CONFIDENCE_RANK) >= CONFIDENCE_RANK[query.min_confidence]) & ((F.col("status") != "resolved") | passes_floor(F.col("status"), F.col("precision"), query.min_precision)))
    start = roots.where(F.col("node").isin(*query.roots)) if query.roots else roots
    return bounded_paths(kept, start, query.target.matches(F.col("name")), query.max_depth, query.max_paths, F.col("status") == "resolved")


def transitions(events: DataFrame) -> DataFrame:
    """How often each event name follows each other one in a scope."""
    w = Window.partitionBy("scope").orderBy("position")
    return events.withColumn("next", F.lead("name").over(w)).where("next is not null").groupBy("name", "next").agg(F.count(F.lit(1)).alias("times"))
