"""Tables and rules that stay: facts and rules can be added at any time, and results follow.

A rule is a Python function from DataFrames to a DataFrame. What it reads is declared,
so that a change recomputes only what depends on it. Rules with one head are united;
a head may depend on itself, alone or with others, but not on its own absence or on
an aggregate of itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..errors import BadLocation, NoSuchTable, NotStratified, RuleError, TableExists, TypeMismatch, UnsafeRule, WrongArity
from ..functions.scalar import printed
from ..operators.located import local, outbox
from ..operators.recursion import MOST_ROUNDS, fixpoints, freed, stored
from ..sources.durable import DurableTable
from ..sources.tables import facts, relation, schema, ticks

Callback = Callable[[str, DataFrame, DataFrame], None]


@dataclass
class Rule:
    name: str
    head: str
    function: Callable[..., DataFrame]
    reads: dict[str, str]  # parameter -> table
    whole: dict[str, str]  # parameter -> table that must be complete: negated, or under an aggregate


class RuleBook:
    """Named tables, the facts put into them, and rules that derive more rows."""

    def __init__(self, spark: SparkSession, folder: str | None = None, most_rounds: int = MOST_ROUNDS, here: str | None = None):
        """folder: where durable tables live; here: this node's location, tcp:host:port."""
        self.spark, self.folder, self.most_rounds, self.here = spark, folder, most_rounds, here
        self.locations: dict[str, str] = {}
        self.held: list[DataFrame] = []
        self.columns: dict[str, dict[str, str]] = {}
        self.base: dict[str, DataFrame] = {}
        self.durable: dict[str, DurableTable] = {}
        self.rules: list[Rule] = []
        self.timers: dict[str, tuple[int, int]] = {}
        self.now = 0
        self.results: dict[str, DataFrame] = {}
        self.stale: set[str] = set()
        self.callbacks: list[tuple[str, Callback]] = []

    # what is there

    def define(self, name: str, columns: dict[str, str], durable: bool = False, location: str | None = None) -> None:
        """A table of named, typed columns (bool, char, int, double, string).

        durable: its facts outlive the session. location: a string column that says
        where a row belongs; rows of other nodes are no rows here, but in outbox().
        """
        if name in self.columns:
            raise TableExists(name)
        made = schema(columns)
        if durable and self.folder is None:
            raise RuleError(f"{name}: no folder for durable tables")
        if location is not None and (columns.get(location) != "string" or self.here is None):
            raise BadLocation(f"{name}.{location}: a location is a string column, in a book that has one itself")
        self.columns[name] = dict(columns)
        if location is not None:
            self.locations[name] = location
        if durable:
            self.durable[name] = DurableTable(self.spark, f"{self.folder}/{name}", made)
        self.base[name] = self.durable[name].read() if durable else self.spark.createDataFrame([], made)
        self.stale.add(name)

    def timer(self, name: str, period_ms: int) -> None:
        """A table (deadline) that gets a row each time the clock passes a multiple of the period; see advance()."""
        ticks(self.spark, period_ms, 0, 0)
        self.define(name, {"deadline": "int"})
        self.timers[name] = (period_ms, self.now)

    def _known(self, name: str) -> str:
        if name not in self.columns:
            raise NoSuchTable(name)
        return name

    def _fitting(self, name: str, df: DataFrame) -> DataFrame:
        wanted = schema(self.columns[name])
        if len(df.columns) != len(wanted):
            raise WrongArity(f"{name}: {len(df.columns)} columns, {len(wanted)} expected")
        for have, want in zip(df.schema, wanted, strict=True):
            if have.dataType != want.dataType:
                raise TypeMismatch(f"{name}.{want.name}: {have.dataType.simpleString()} is no {want.dataType.simpleString()}")
        return df.toDF(*wanted.names)

    # changes

    def add(self, name: str, rows: Iterable[Sequence]) -> None:
        """Facts. Nothing is added if one of them doesn't fit."""
        self._put(name, facts(self.spark, self.columns[self._known(name)], rows))

    def load(self, name: str, df: DataFrame) -> None:
        """A DataFrame's rows as facts: numbers and timestamps are widened, nulls are an error."""
        self._put(name, self._fitting(self._known(name), relation(df, check=True)))

    def _put(self, name: str, rows: DataFrame) -> None:
        if name in self.durable:
            self.durable[name].insert(rows)
            self.base[name] = self.durable[name].read()
        else:
            self.base[name] = self._held(self.base[name].union(rows).distinct())
        self.stale.add(name)

    def _held(self, df: DataFrame) -> DataFrame:
        self.held.append(stored(df))
        return self.held[-1]

    def close(self) -> None:
        """Deletes what the book keeps in the shared folder; durable tables stay. The book can't be used any more."""
        for df in self.held:
            freed(df)
        self.held, self.base, self.results, self.columns = [], {}, {}, {}

    def advance(self, now_us: int) -> None:
        """Moves the clock; every deadline passed becomes a row of its timer's table."""
        for name, (period, start) in self.timers.items():
            self._put(name, ticks(self.spark, period, start, now_us).subtract(self.base[name]))
        self.now = now_us

    def rule(self, head: str, function: Callable[..., DataFrame], reads: Mapping[str, str] | Sequence[str] = (), whole: Mapping[str, str] | Sequence[str] = (), name: str | None = None) -> None:
        """head gets the rows that function makes of the tables it reads, now and later.

        reads, whole: tables, by the function's parameter names ({"x": "edge", "y": "edge"})
        or, where they are the same, as a list. whole: tables that are negated or
        aggregated, and so must be complete first. A function that reads a table of
        its own recursion gets only the new rows for one parameter at a time.
        """
        of = lambda x: dict(x) if isinstance(x, Mapping) else {t: t for t in x}
        made = Rule(name or f"rule {len(self.rules) + 1}", self._known(head), function, of(reads), of(whole))
        if any(r.name == made.name for r in self.rules):
            raise RuleError(f"two rules named {made.name}")
        for table in (*made.reads.values(), *made.whole.values()):
            self._known(table)
        if not made.reads and not made.whole:
            raise UnsafeRule(f"{made.name} reads no table")
        self._strata([*self.rules, made])
        self._fitting(head, function(**{p: self.base[t] for p, t in (made.reads | made.whole).items()}))
        self.rules.append(made)
        self.stale.add(head)

    def on_change(self, name: str, call: Callback) -> None:
        """call(name, new rows, rows gone) once for each refresh that changes the table."""
        self.callbacks.append((self._known(name), call))

    # results

    def _strata(self, rules: list[Rule]) -> list[list[str]]:
        """Groups of tables, each after what it depends on; a group of several, or of one that reads itself, is recursive."""
        below: dict[str, set[str]] = {t: set() for t in self.columns}
        for r in rules:
            below[r.head] |= {*r.reads.values(), *r.whole.values()}
        reach = {t: set(b) for t, b in below.items()}
        for via in reach:
            for b in reach.values():
                if via in b:
                    b |= reach[via]
        for r in rules:
            for t in r.whole.values():
                if t == r.head or r.head in reach[t]:
                    raise NotStratified(f"{r.name}: {r.head} depends on all of {t}, and {t} on {r.head}")
        out, done = [], set()
        for t in sorted(reach, key=lambda t: len(reach[t] | {t})):
            if t not in done:
                group = [t, *(u for u in reach if u != t and u in reach[t] and t in reach[u])]
                done |= set(group)
                out.append(group)
        return out

    def refresh(self) -> None:
        """Recomputes what depends on a change, stratum by stratum, and calls back. A failure leaves all results as they were."""
        if not self.stale:
            return
        results, changed = dict(self.results), set(self.stale)
        here = lambda rows: {t: local(df, self.locations[t], self.here) if t in self.locations else df for t, df in rows.items()}
        for group in self._strata(self.rules):
            rules = [r for r in self.rules if r.head in group]
            if not changed & {*group, *(t for r in rules for t in (*r.reads.values(), *r.whole.values()))}:
                continue
            changed |= set(group)
            results |= self._computed(group, rules, here(results))
        for name, call in self.callbacks:
            if name in changed:
                old = self.results.get(name, results[name].limit(0))
                more, less = results[name].subtract(old), old.subtract(results[name])
                if not more.isEmpty() or not less.isEmpty():
                    call(name, more, less)
        self.results, self.stale = results, set()

    def _computed(self, group: list[str], rules: list[Rule], results: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        inner = [r for r in rules if set(r.reads.values()) & set(group)]
        bases = {}
        for t in group:
            parts = [self.base[t], *(self._fitting(t, r.function(**{p: results[u] for p, u in (r.reads | r.whole).items()})) for r in rules if r.head == t and r not in inner)]
            bases[t] = reduce(DataFrame.union, parts)
        if not inner:
            return {t: self._held(df.distinct()) for t, df in bases.items()}

        def step(new: Mapping[str, DataFrame], whole: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
            found: dict[str, list[DataFrame]] = {}
            for r in inner:
                given = {p: whole.get(t, results.get(t)) for p, t in (r.reads | r.whole).items()}
                for p, t in r.reads.items():
                    if t in group:
                        found.setdefault(r.head, []).append(self._fitting(r.head, r.function(**(given | {p: new[t]}))))
            return {t: reduce(DataFrame.union, x) for t, x in found.items()}

        return {t: self._held(df) for t, df in fixpoints(bases, step, self.most_rounds).items()}

    def table(self, name: str) -> DataFrame:
        """All rows of a table, derived ones included; of a table with a location, those that belong here."""
        self._known(name)
        self.refresh()
        found = self.results[name]
        return local(found, self.locations[name], self.here) if name in self.locations else found

    def outbox(self, name: str) -> DataFrame:
        """Rows of a table with a location that belong to other nodes: for the caller to write where those read."""
        if self._known(name) not in self.locations:
            raise BadLocation(f"{name} has no location")
        self.refresh()
        return outbox(self.results[name], self.locations[name], self.here)

    def dump(self, name: str) -> str:
        """A table as text, one row a line, in byte order: for looking at results, as it brings them to the driver."""
        return "\n".join(sorted((r.line for r in printed(self.table(name)).collect()), key=str.encode))

    def explain(self) -> str:
        """Strata in order, with their rules."""
        lines = []
        for k, group in enumerate(self._strata(self.rules)):
            lines.append(f"{k}: {', '.join(group)}")
            lines += [f"   {r.name}: {r.head} from {', '.join([*r.reads.values(), *(f'all of {t}' for t in r.whole.values())])}" for r in self.rules if r.head in group]
        return "\n".join(lines)
