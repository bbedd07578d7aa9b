"""A versioned module: the upstream columns it uses, and the tables it makes as DataFrames."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructType

from ..functions.types import schema_of
from ..plans.contracts import MODES, Description, Relation, Step
from ..plans.version import Version


class Resolver(Protocol):
    """Gives contracts of upstream modules, and their tables: empty ones while planning, stored ones while running."""

    def resolve_contract(self, name: str, version: str) -> Description: ...

    def upstream_table(self, name: str, version: str, table: str, schema: StructType) -> DataFrame: ...


_active: ContextVar[Resolver | None] = ContextVar("resolver", default=None)


@contextmanager
def resolving(resolver: Resolver | None) -> Iterator[None]:
    token = _active.set(resolver)
    try:
        yield
    finally:
        _active.reset(token)


def select_as(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Project {output: input} in the order given; an input may feed several outputs."""
    if not columns:
        raise ValueError("choose at least one column")
    return df.select(*(F.col("`" + src.replace("`", "``") + "`").alias(out) for out, src in columns.items()))


@dataclass
class _Table:
    frame: DataFrame
    relation: Relation


class Upstream:
    """One declared upstream."""

    def __init__(self, module: Module, name: str) -> None:
        self._module, self._name = module, name

    def get(self, table: str, columns: Mapping[str, str]) -> DataFrame:
        """Chosen columns of an exported table, under new names. Without a resolver: a warning, and an empty frame of doubles."""
        m = self._module
        used = [c for c in columns.values() if c]
        contract = m.contracts.get(self._name)
        if contract is None:
            warnings.warn(f"{m.name}: the contract of {self._name} is unknown; its columns are taken as double", RuntimeWarning, stacklevel=2)
            frame = m.spark.createDataFrame([], schema_of({c: DoubleType() for c in sorted(set(used))}))
        else:
            promised = contract[table]
            promised.need(used, f"{m.name} reads {self._name}.{table}")
            frame = m.resolver.upstream_table(self._name, contract.version, table, promised.schema)
        m.usage.setdefault((self._name, table), set()).update(used)
        return select_as(frame, columns)


class UpstreamMap(Mapping):
    def __init__(self, module: Module) -> None:
        self._module = module

    def __getitem__(self, name: str) -> Upstream:
        if name not in self._module.sources:
            raise KeyError(f"{self._module.name} declares no source {name!r}; it has {sorted(self._module.sources)}")
        return Upstream(self._module, name)

    def __iter__(self) -> Iterator[str]:
        return iter(self._module.sources)

    def __len__(self) -> int:
        return len(self._module.sources)


class Module:
    def __init__(self, name: str, version: str, description: str | None = None, *, spark: SparkSession | None = None) -> None:
        if not name:
            raise ValueError("a module needs a name")
        Version.parse(version)
        self.name, self.version, self.description = name, version, description
        self._spark = spark
        self.sources: dict[str, str] = {}
        self.contracts: dict[str, Description] = {}
        self.usage: dict[tuple[str, str], set[str]] = {}
        self.tables: dict[str, _Table] = {}
        self.steps: list[Step] = []
        self._pending: list[str] = []
        self.upstream = UpstreamMap(self)
        self.resolver: Resolver | None = None
        if (r := _active.get()) is not None:
            self.attach(r)

    @property
    def spark(self) -> SparkSession:
        return self._spark or SparkSession.active()

    def attach(self, resolver: Resolver) -> None:
        self.resolver = resolver
        self._resolve()

    def _resolve(self) -> None:
        for name, version in self.sources.items() if self.resolver else ():
            if name not in self.contracts:
                self.contracts[name] = self.resolver.resolve_contract(name, version)

    def source(self, upstreams: Mapping[str, str]) -> None:
        """Declare upstream modules by exact version; a later entry wins."""
        for name, version in upstreams.items():
            if not name or not version or name == self.name:
                raise ValueError(f"{self.name} can't have the source {name!r}@{version!r}")
            Version.parse(version)
            if self.sources.get(name) != version:
                self.contracts.pop(name, None)
            self.sources[name] = version
        self._resolve()

    def get(self, table: str, columns: Mapping[str, str]) -> DataFrame:
        """Chosen columns of a table made earlier in this module; once it is materialized, the stored table is read."""
        if table not in self.tables:
            raise KeyError(f"{self.name} has made no table {table!r}; it has {sorted(self.tables)}")
        t = self.tables[table]
        t.relation.need(list(columns.values()), f"{self.name} reads its own {table}")
        stored = getattr(self.resolver, "own_table", lambda *_: None)(self, table)
        return select_as(t.frame if stored is None else stored, columns)

    def previous(self, table: str) -> DataFrame | None:
        """A table of this module as an earlier run left it; None while planning, on a first run, and where runs start afresh."""
        return getattr(self.resolver, "previous_table", lambda *_: None)(self, table)

    def sink(self, tables: Mapping[str, DataFrame], **how: object) -> None:
        """Make exported tables; see _register for how they are written."""
        self._register(tables, True, **how)

    def sink_internal(self, tables: Mapping[str, DataFrame], **how: object) -> None:
        """Make tables that are stored, and are no part of the contract."""
        self._register(tables, False, **how)

    def _register(self, tables: Mapping[str, DataFrame], public: bool, *, description: str | None = None, mode: str = "replace", keys: Sequence[str] = (), order: Sequence[str] = ()) -> None:
        """mode: replace the stored table, append to it, or merge (rows with the ``keys`` of new ones go); order: columns that files are ranged and sorted by."""
        if mode not in MODES or (mode == "merge") != bool(keys):
            raise ValueError(f"a table is written by one of {MODES}, and keys are for merging")
        for name, frame in tables.items():
            if not name or name in self.tables:
                raise ValueError(f"{self.name}: a table needs a new name, not {name!r}")
            relation = Relation(schema_of(frame.schema), public, description, mode, tuple(keys), tuple(order))
            relation.need([*keys, *order], f"{self.name} writes {name}")
            self.tables[name] = _Table(frame, relation)
            self._pending.append(name)

    def flow(self, *, notes: str | None = None) -> None:
        """Close a stage: what was made since the last one."""
        self.steps.append(Step(tuple(self._pending), notes))
        self._pending = []
        done = getattr(self.resolver, "step_done", None)
        if done:
            done(self, self.steps[-1])

    def columns_used(self, upstream: str, table: str) -> set[str] | None:
        got = self.usage.get((upstream, table))
        return None if got is None else set(got)

    def build(self) -> Description:
        if self._pending:
            self.flow(notes="left open by the module")
        return Description(self.name, self.version, {n: t.relation for n, t in self.tables.items()}, dict(self.sources), tuple(self.steps), self.description)
