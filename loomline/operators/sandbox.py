"""A sandbox for one module: saved subsets of its inputs, and runs of it over these alone."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import replace
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..plans.contracts import Description, Step
from ..sources.storage import Storage
from .graph import call_factory, load_factory
from .module import Module
from .workspace import Workspace


class Sample:
    """A DataFrame with the one table it comes from; transform keeps it."""

    def __init__(self, frame: DataFrame, origin: tuple[str, str, str, str]) -> None:
        self.frame, self.origin = frame, origin

    def transform(self, f: Callable[[DataFrame], DataFrame]) -> Sample:
        return Sample(f(self.frame), self.origin)


class _Inputs(Mapping):
    def __init__(self, sandbox: Sandbox) -> None:
        self._s = sandbox

    def __getitem__(self, name: str) -> _Input:
        if name not in self._s.module.sources:
            raise KeyError(f"{self._s.module.name} declares no source {name!r}")
        return _Input(self._s, name)

    def __iter__(self) -> Iterator[str]:
        return iter(self._s.module.sources)

    def __len__(self) -> int:
        return len(self._s.module.sources)


class _Input:
    def __init__(self, sandbox: Sandbox, name: str) -> None:
        self._s, self._name = sandbox, name

    def get(self, table: str, *, infer_select: bool = False, select: list[str] | None = None) -> Sample:
        """A stored upstream table, whole, or the columns given, or those that the module uses."""
        s, version = self._s, self._s.module.sources[self._name]
        frame = s.source.read(s.source.table_path(self._name, version, table))
        if infer_select and select is None:
            used = s.module.columns_used(self._name, table)
            if used is None:
                raise KeyError(f"{s.module.name} reads no {self._name}.{table}")
            select = sorted(used)
        return Sample(frame.select(*select) if select else frame, ("upstream", self._name, version, table))


class Sandbox:
    def __init__(self, factory: Callable[..., Module] | str, source: Workspace, name: str, version: str, *, sink: Workspace | None = None, spark: SparkSession | None = None) -> None:
        self.factory = load_factory(factory) if isinstance(factory, str) else factory
        self.code = factory if isinstance(factory, str) else None
        self.spark = spark or SparkSession.active()
        self.name, self.version = name, version
        self.workspaces = (source, sink or source)
        self.source, self.sink_ = (Storage(self.spark, w.root) for w in self.workspaces)
        self.queue: list[Sample] = []
        self._module: Module | None = None
        self.upstream = _Inputs(self)
        self._running: dict[str, str] | None = None
        self._in_place = True

    @property
    def root(self) -> str:
        return f"{self.sink_.root}/sandboxes/{self.name}/{self.version}"

    @property
    def module(self) -> Module:
        if self._module is None:
            self._module = call_factory(self.factory, self)
        return self._module

    # what the module asks
    def resolve_contract(self, name: str, version: str) -> Description:
        """From the saved inputs, else from the source workspace."""
        saved = Storage(self.spark, self.root)
        try:
            return saved.discover(name, version, area="upstream")
        except FileNotFoundError:
            return self.source.discover(name, version)

    def upstream_table(self, name: str, version: str, table: str, schema: StructType) -> DataFrame:
        if self._running is None:
            return self.spark.createDataFrame([], schema)
        return self.sink_.read(f"{self.root}/upstream/{name}/{version}/{table}.parquet")

    def own_table(self, module: Module, table: str) -> DataFrame | None:
        path = (self._running or {}).get(table)
        return self.sink_.read(path) if path else None

    def previous_table(self, module: Module, table: str) -> DataFrame | None:
        """The earlier output that an in-place run goes on from: its own last one, else the one saved from the source workspace."""
        if self._running is None or not self._in_place:
            return None
        paths = [f"{self.root}/{part}/{table}.parquet" for part in ("output", "downstream")]
        return next((self.sink_.read(p) for p in paths if self.sink_.has(p)), None)

    def step_done(self, module: Module, step: Step) -> None:
        if self._running is None:
            return
        for table in step.tables:
            path, relation = f"{self.root}/output/{table}.parquet", module.tables[table].relation
            frame = module.tables[table].frame
            saved = f"{self.root}/downstream/{table}.parquet"
            if self._in_place and relation.mode != "replace" and not self.sink_.has(path) and self.sink_.has(saved):
                self.sink_.write(self.sink_.read(saved), path)
            self.sink_.write(frame, path, relation if self._in_place else replace(relation, mode="replace", keys=()))
            self._running[table] = path

    def downstream(self, table: str) -> Sample:
        """The module's own earlier output in the source workspace."""
        frame = self.source.read(self.source.table_path(self.name, self.version, table))
        return Sample(frame, ("downstream", self.name, self.version, table))

    def sink(self, sample: Sample) -> None:
        if not isinstance(sample, Sample):
            raise ValueError("only what comes from one table of the sandbox can be saved; use transform to change it")
        self.queue.append(sample)

    def materialize(self, *, registry: str | Path, activate: bool = True) -> None:
        """Write what is queued, and enter the sandbox in a registry."""
        for s in self.queue:
            kind, module, version, table = s.origin
            path = f"{self.root}/upstream/{module}/{version}/{table}.parquet" if kind == "upstream" else f"{self.root}/downstream/{table}.parquet"
            self.sink_.write(s.frame, path)
        self.queue = []
        self._module = None
        path = Path(registry)
        known = json.loads(path.read_text()) if path.exists() else {"sandboxes": {}, "active": None}
        key = f"{self.name}@{self.version}"
        known["sandboxes"][key] = {"name": self.name, "version": self.version, "code": self.code, "source": self.workspaces[0].to_dict(), "sink": self.workspaces[1].to_dict(), "materialized_at": datetime.now(timezone.utc).isoformat()}
        known["active"] = key if activate else known["active"]
        path.write_text(json.dumps(known, indent=1))

    @classmethod
    def load_active(cls, registry: str | Path, factory: Callable[..., Module] | str | None = None) -> Sandbox:
        known = json.loads(Path(registry).read_text())
        if not known["active"]:
            raise KeyError("no sandbox is active")
        e = known["sandboxes"][known["active"]]
        code = factory or e["code"] or str(Path(registry).parent / "module.py")
        return cls(code, Workspace.from_dict(e["source"]), e["name"], e["version"], sink=Workspace.from_dict(e["sink"]))

    def flow(self, *, in_place: bool = True) -> Module:
        """Run the module over the saved inputs; its tables go to output/. In place, it goes on from its earlier outputs."""
        self._running, self._in_place = {}, in_place
        try:
            module = call_factory(self.factory, self)
            module.build()
            return module
        finally:
            self._running = None

    def get(self, table: str) -> DataFrame:
        """A result of flow, or else a saved earlier output."""
        for part in ("output", "downstream"):
            path = f"{self.root}/{part}/{table}.parquet"
            if self.sink_.has(path):
                return self.sink_.read(path)
        raise FileNotFoundError(f"the sandbox of {self.name}@{self.version} has no {table}")
