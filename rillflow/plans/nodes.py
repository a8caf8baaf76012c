"""Logical plan nodes. Expressions are SQL text that the engine's own parser reads."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass

AGGREGATES = ("sum", "count", "avg", "min", "max")


def _text(value) -> str:
    if isinstance(value, tuple):
        return "(" + ",".join(map(_text, value)) + ")"
    if is_dataclass(value):
        named = [f for f in fields(value) if not f.metadata.get("later") or getattr(value, f.name) != f.default]  # keys stay as they were
        return f"{type(value).__name__}({','.join(_text(getattr(value, f.name)) for f in named)})"
    if callable(value):
        return f"{value.__module__}.{value.__qualname__}#{getattr(value, 'version', 0)}"
    return repr(value)


@dataclass(frozen=True)
class Node:
    @property
    def inputs(self) -> tuple[Node, ...]:
        return tuple(v for f in fields(self) if isinstance(v := getattr(self, f.name), Node))

    def sources(self) -> list[str]:
        """Names of the tables it reads, each once, in order."""
        own = [self.name] if isinstance(self, Scan) else []
        return list(dict.fromkeys(own + [s for i in self.inputs for s in i.sources()]))

    def key(self) -> str:
        """The same in every process: a function counts by its module and qualified name
        and, if it has one, its attribute `version`, which its author raises when its
        results change."""
        return hashlib.sha256(_text(self).encode()).hexdigest()


@dataclass(frozen=True)
class Scan(Node):
    """A table. With an alias, its columns are named alias.column."""

    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Filter(Node):
    input: Node
    predicate: str


@dataclass(frozen=True)
class Project(Node):
    """(expression, name) pairs."""

    input: Node
    items: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Map(Node):
    """A function from a table to a table that treats each row by itself."""

    input: Node
    apply: Callable


@dataclass(frozen=True)
class Join(Node):
    """Equi-join on pairs of columns; how is inner, left, right, full, semi or anti."""

    left: Node
    right: Node
    on: tuple[tuple[str, str], ...]
    how: str = "inner"


@dataclass(frozen=True)
class Union(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Difference(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Distinct(Node):
    input: Node


@dataclass(frozen=True)
class Agg:
    """fn(expression) as name; count's expression may be *. distinct counts or sums
    each value once."""

    fn: str
    expression: str
    name: str
    distinct: bool = False


@dataclass(frozen=True)
class GroupAgg(Node):
    """keys are (expression, name) pairs; without keys there is one group."""

    input: Node
    keys: tuple[tuple[str, str], ...]
    aggs: tuple[Agg, ...]


@dataclass(frozen=True)
class GroupMap(Node):
    """An aggregate of one's own: apply takes a group's rows as a pandas frame, each
    as often as it counts, and returns result rows of the given schema. A group is
    one task's; for large ones use aggregates that merge."""

    input: Node
    keys: tuple[str, ...]
    apply: Callable
    schema: str


@dataclass(frozen=True)
class TimeWindow(Node):
    """Adds __window_start and __window_end (milliseconds, end exclusive) to the keys
    of an aggregation. kind: tumble (size), hop (size, slide) or session (gap)."""

    input: Node
    kind: str
    time: str
    size: int
    slide: int
    keys: tuple[tuple[str, str], ...]
    aggs: tuple[Agg, ...]


@dataclass(frozen=True)
class Over(Node):
    """(window expression, name) pairs added to the input's columns. partition names
    the columns that all of them are partitioned by."""

    input: Node
    items: tuple[tuple[str, str], ...]
    partition: tuple[str, ...]


@dataclass(frozen=True)
class GroupsFrame(Node):
    """fn(expression) over a GROUPS frame: peers of the order columns count as one
    step. Bounds are numbers of peer groups; None is unbounded."""

    input: Node
    fn: str
    expression: str
    partition: tuple[str, ...]
    order: tuple[str, ...]
    start: int | None
    end: int | None
    name: str


@dataclass(frozen=True)
class Sort(Node):
    """order items are SQL: column, column DESC, column ASC NULLS LAST."""

    input: Node
    order: tuple[str, ...]


@dataclass(frozen=True)
class Limit(Node):
    input: Node
    count: int
    offset: int = 0


@dataclass(frozen=True)
class TopK(Node):
    """The first k rows by order (all, if k is negative), of each partition if there
    are any; without a partition, after the first offset rows."""

    input: Node
    k: int
    order: tuple[str, ...]
    partition: tuple[str, ...] = ()
    offset: int = field(default=0, metadata={"later": True})
