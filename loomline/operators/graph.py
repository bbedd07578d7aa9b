"""A graph of modules, built backward from its targets: resolve, freeze, plan, run."""

from __future__ import annotations

import importlib.util
import inspect
import json
import shutil
import sys
import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..plans.contracts import Description, Step, to_json
from ..plans.order import layers, topological
from ..plans.state import StateStore
from ..plans.version import Version, VersionMismatch, merge
from ..sources.storage import Storage
from .module import Module, resolving
from .workspace import SparkProfile, Workspace


@dataclass(frozen=True)
class Plan:
    order: list[str]
    layers: list[list[str]]
    targets: dict[str, str]
    manifests: dict[str, Description]

    def explain(self) -> str:
        """Level by level, what is read, made and written."""
        out = []
        for i, level in enumerate(self.layers):
            for name in level:
                d = self.manifests[name]
                mark = " (target)" if name in self.targets else ""
                out.append(f"{i}: {name}@{d.version}{mark} reads {', '.join(f'{u}@{self.manifests[u].version}' for u in sorted(d.reads)) or 'nothing'}")
                for step in d.steps:
                    out += [f"   {'+' if d.relations[t].public else '-'} {t} ({d.relations[t].mode}): {d.relations[t].schema.simpleString()}" for t in step.tables]
        return "\n".join(out)


@dataclass
class RunResult:
    plan: Plan
    run_id: str
    started: float
    ended: float | None = None
    success: bool = False
    seconds: dict[str, float] = field(default_factory=dict)

    @property
    def duration(self) -> float | None:
        return None if self.ended is None else self.ended - self.started


def load_factory(path: str) -> Callable[..., Module]:
    """The function ``module`` of module.py in a folder, imported afresh."""
    file = Path(path) / "module.py" if Path(path).is_dir() else Path(path)
    if not file.exists():
        raise FileNotFoundError(file)
    spec = importlib.util.spec_from_file_location(f"_loomline_{uuid.uuid4().hex}", file)
    code = importlib.util.module_from_spec(spec)
    sys.modules[spec.name] = code
    spec.loader.exec_module(code)
    return code.module


def call_factory(factory: Callable[..., Module], resolver: object) -> Module:
    """By its signature: with the resolver, if it takes one; an error inside is never taken for another signature."""
    with resolving(resolver):
        return factory(resolver=resolver) if "resolver" in inspect.signature(factory).parameters else factory()


class Graph:
    def __init__(self, workspace: Workspace, targets: Mapping[str, str], *, name: str | None = None, spark: SparkSession | None = None, profiles: Mapping[str, str] | None = None) -> None:
        self.workspace, self.name, self._spark = workspace, name, spark
        self.frozen: dict[str, dict] = {}
        self.mode = workspace.mode
        self.profiles: dict[str, str] = {}
        self.set_profiles(profiles or {})
        self.set_targets(targets)

    def set_workspace(self, workspace: Workspace) -> None:
        """Another workspace; what was resolved and frozen before is forgotten."""
        self.workspace = workspace
        self.set_targets(self.targets)

    def set_mode(self, mode: str) -> None:
        """How the graph is run; what was resolved before is forgotten."""
        if mode not in self.workspace.MODES:
            raise ValueError(f"a graph runs {' or '.join(self.workspace.MODES)}, not {mode!r}")
        self.mode = mode
        self.set_targets(self.targets)

    def set_profiles(self, profiles: Mapping[str, str]) -> None:
        """Profiles of modules in this graph alone; they go before the workspace's, and nothing else changes."""
        self.profiles = dict(profiles)

    def profile_of(self, name: str) -> SparkProfile:
        """A module's profile: this graph's, else the workspace's for the module, else its default one."""
        w = self.workspace
        profile = self.profiles.get(name) or w.module_profiles.get(name) or w.default_profile
        if profile not in w.profiles:
            raise ValueError(f"{name} has the profile {profile!r}; there are {sorted(w.profiles)}")
        return w.profiles[profile]

    @property
    def spark(self) -> SparkSession:
        return self._spark or SparkSession.active()

    @property
    def state(self) -> StateStore:
        return StateStore(self.workspace.home / "state" / "state.sqlite")

    def set_targets(self, targets: Mapping[str, str]) -> None:
        """Choose targets by exact version; what was resolved and frozen before is forgotten."""
        for name, version in targets.items():
            Version.parse(version)
            if name not in self.workspace.modules:
                raise KeyError(f"no module {name!r} in the workspace")
        self.targets = dict(targets)
        self.versions: dict[str, str] = {}
        self.edges: dict[str, set[str]] = {}
        self.manifests: dict[str, Description] = {}
        self._chosen: dict[str, str] = {}
        self._upgrade = True
        self.frozen = {}

    # what modules ask while planning
    def resolve_contract(self, name: str, version: str) -> Description:
        """The contract of the version chosen for a module, which must satisfy the one asked for; while versions are being
        chosen, of the one that is chosen so far, or would be for this requirement alone."""
        chosen = self.versions.get(name) or self._chosen.get(name) or self.targets.get(name) or (self._upgraded(name, version) if self._upgrade else version)
        if self.versions and (Version.parse(chosen).major != Version.parse(version).major or Version.parse(chosen) < Version.parse(version)):
            raise VersionMismatch(f"{name} is read in {version}, and the graph has it in {chosen}")
        return self._manifest(name, chosen).offer()

    def upstream_table(self, name: str, version: str, table: str, schema: StructType) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _manifest(self, name: str, version: str) -> Description:
        key = f"{name}@{version}"
        if key in self._building:
            raise ValueError(f"cycle: {' -> '.join([*self._building, key])}")
        if key not in self._built:
            self._building.append(key)
            module = call_factory(load_factory(self._code(name, version)), self)
            if module.version != version or module.name != name:
                raise VersionMismatch(f"the code of {key} makes {module.name}@{module.version}")
            self._built[key] = module.build()
            self._building.pop()
        return self._built[key]

    def _code(self, name: str, version: str) -> str:
        return self.frozen[name]["path"] if self.frozen.get(name, {}).get("version") == version else self.workspace.module_path(name, version)

    def _upgraded(self, name: str, version: str) -> str:
        """The newest version of the same major that has been run, if it is newer."""
        had = self.state.version(name, Version.parse(version).major)
        if had and Version.parse(had) >= Version.parse(version):
            self.workspace.module_path(name, had)  # it must still be there
            return had
        return version

    def resolve(self, *, auto_upgrade: bool = True) -> None:
        """Choose all versions first, to a fixed point, and build the manifests of exactly these."""
        if self.manifests:
            return
        try:
            while True:
                self._built: dict[str, Description] = {}
                self._building: list[str] = []
                before = dict(self.versions)
                chosen: dict[str, str] = {}
                self._chosen, self._upgrade = chosen, auto_upgrade
                for name, version in self.targets.items():
                    chosen[name] = merge(name, version, chosen.get(name), pin=True)
                queue, edges = list(self.targets), {}
                while queue:
                    name = queue.pop(0)
                    manifest = self._declared(name, chosen[name])
                    edges[name] = set(manifest)
                    for up, version in manifest.items():
                        pinned = up in self.targets
                        wanted = version if pinned or not auto_upgrade else self._upgraded(up, version)
                        got = merge(up, wanted, chosen.get(up), pinned_have=pinned)
                        if chosen.get(up) != got:
                            chosen[up] = got
                            queue.append(up)
                self.versions, self.edges = chosen, edges
                if before == chosen:
                    break
            topological(self.edges)
            self.manifests = {n: self._manifest(n, v) for n, v in self.versions.items()}
        except BaseException:
            self.versions, self.edges, self.manifests = {}, {}, {}
            raise

    def _declared(self, name: str, version: str) -> dict[str, str]:
        """The sources of a module, by running its factory against the versions known so far."""
        return self._manifest(name, version).reads

    def freeze(self, *, auto_upgrade: bool = False) -> None:
        """Copy the code of each chosen version, once, and write its manifest beside it; runs then use the copies."""
        self.resolve(auto_upgrade=auto_upgrade)
        for name, version in self.versions.items():
            to = self.workspace.home / "modules" / name / version
            if not to.exists():
                code = Path(self.workspace.module_path(name, version))
                if code.is_dir():
                    shutil.copytree(code, to)
                else:
                    to.mkdir(parents=True)
                    shutil.copy(code, to / "module.py")
            (to / "loomline.manifest.json").write_text(json.dumps(to_json(self.manifests[name]), indent=1))
            self.frozen[name] = {"version": version, "path": str(to), "depends_on": sorted(self.edges[name])}

    def plan(self) -> Plan:
        self.resolve()
        return Plan(topological(self.edges), layers(self.edges), dict(self.targets), dict(self.manifests))

    def run(self, *, parallel: int = 1, freshness: float | None = None, verbose: bool = False) -> RunResult:
        """One pass over all modules in order; those of one layer run side by side on ``parallel`` threads.

        The first failure stops the run and is raised; modules that are done stay done. ``freshness``: seconds within
        which an earlier success of a module, in the version now chosen, counts, unless a module it reads has succeeded since.
        """
        self.workspace.validate()
        self.freeze(auto_upgrade=not self.frozen)
        plan = self.plan()
        profiles = {name: self.profile_of(name) for name in plan.order}
        result = RunResult(plan, uuid.uuid4().hex, time.time())
        for level in plan.layers:
            # modules of one profile run side by side, as settings are the session's
            for profile in {id(profiles[n]): profiles[n] for n in level}.values():
                group = [n for n in level if profiles[n] is profile]
                with profile.applied(self.spark):
                    if parallel <= 1 or len(group) == 1:
                        for name in group:
                            self._run_module(name, result, freshness, verbose)
                    else:
                        with ThreadPoolExecutor(parallel) as pool:
                            list(pool.map(inheritable_thread_target(self.spark)(lambda n: self._run_module(n, result, freshness, verbose)), group))
        result.ended, result.success = time.time(), True
        return result

    def _run_module(self, name: str, result: RunResult, freshness: float | None, verbose: bool) -> None:
        state, began, version = self.state, time.time(), self.versions[name]
        done = state.last_success(name, version)
        if freshness is not None and done is not None and began - done < freshness:
            if all((state.last_success(u, self.versions[u]) or began) <= done for u in self.edges[name]):
                return
        if not state.acquire(name, result.run_id):
            raise RuntimeError(f"{name} is locked by another run")
        try:
            call_factory(load_factory(self.frozen[name]["path"]), _Runner(self, name, state, result.run_id)).build()
            state.record_version(name, version)
            state.record_success(name, version)
        finally:
            state.release(name, result.run_id)
        result.seconds[name] = time.time() - began
        if verbose:
            print(f"{name}@{version}: {result.seconds[name]:.1f} s")

    def column_lineage(self) -> list[tuple[str, str, str, str]]:
        """(module, upstream, table, column) of all that modules read."""
        self.resolve()
        out = []
        for name, version in self.versions.items():
            m = call_factory(load_factory(self._code(name, version)), self)
            out += [(name, up, t, c) for (up, t), cols in m.usage.items() for c in cols]
        return sorted(out)

    # JSON
    def to_dict(self) -> dict:
        w = self.workspace
        return {"spec_version": 1, "name": self.name, "targets": self.targets, "profiles": self.profiles, "workspace": w.saved_at or w.to_dict()}

    @classmethod
    def from_dict(cls, d: dict) -> Graph:
        w = d["workspace"]
        return cls(Workspace.load(w) if isinstance(w, str) else Workspace.from_dict(w), d["targets"], name=d.get("name"), profiles=d.get("profiles"))

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), indent=1))

    @classmethod
    def load(cls, path: str | Path) -> Graph:
        return cls.from_dict(json.loads(Path(path).read_text()))


class _Runner:
    """What a module asks while it runs: stored upstream tables, and its own tables, stored as each stage closes."""

    def __init__(self, graph: Graph, name: str, state: StateStore, run_id: str) -> None:
        self.graph, self.name, self.state, self.run_id = graph, name, state, run_id
        self.storage = Storage(graph.spark, graph.workspace.root)
        self.stored: dict[str, str] = {}

    def resolve_contract(self, name: str, version: str) -> Description:
        return self.graph.manifests[name].offer()

    def upstream_table(self, name: str, version: str, table: str, schema: StructType) -> DataFrame:
        return self.storage.read(self.storage.table_path(name, self.graph.versions[name], table), schema)

    def own_table(self, module: Module, table: str) -> DataFrame | None:
        path = self.stored.get(table)
        return None if path is None else self.storage.read(path, module.tables[table].relation.schema)

    def previous_table(self, module: Module, table: str) -> DataFrame | None:
        path = self.storage.table_path(self.name, module.version, table)
        return self.storage.read(path) if self.storage.has(path) else None

    def step_done(self, module: Module, step: Step) -> None:
        version = Version.parse(module.version)
        for table in step.tables:
            t = module.tables[table]
            path = f"{self.storage.root}/data/{self.name}/{version}/{table}.parquet"
            self.storage.write(t.frame, path, t.relation)
            self.stored[table] = path
            if t.relation.public:
                self.storage.publish(self.name, str(version), table, path, version >= (self.storage.newest(self.name) or version))
            self.state.record_table(self.name, table)
            self.state.renew(self.name, self.run_id)
