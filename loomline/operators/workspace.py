"""A workspace: where modules and data are, which Spark profiles there are, and how graphs run."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from ..plans.contracts import from_json
from ..plans.version import Version, parse_reference
from ..sources.storage import Storage


@dataclass(frozen=True)
class SparkProfile:
    """Session settings that a run applies to the modules which have the profile."""

    kind: str = "local"
    conf: Mapping[str, str] = field(default_factory=dict)

    def validate(self) -> None:
        if self.kind not in ("local", "cluster"):
            raise ValueError(f"a profile is local or cluster, not {self.kind!r}")

    @contextmanager
    def applied(self, spark: SparkSession) -> Iterator[None]:
        """The session with these settings, and as it was afterwards. Those that are fixed when a session starts must agree."""
        local = spark.sparkContext.master.startswith("local")
        if local != (self.kind == "local"):
            raise ValueError(f"the profile is for a {self.kind} session, and this one runs on {spark.sparkContext.master}")
        before = {k: spark.conf.get(k, None) for k in self.conf}
        fixed = sorted(k for k, v in self.conf.items() if before[k] != v and not spark.conf.isModifiable(k) and k.startswith("spark.") and before[k] is not None)
        if fixed:
            raise ValueError(f"{fixed} must be set when the session starts")
        try:
            for k, v in self.conf.items():
                spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Workspace:
    MODES = ("once",)

    def __init__(self, root: str | Path = ".loomline", *, name: str | None = None, home: str | Path | None = None) -> None:
        """root: where tables are, on any file system; home: where state and frozen code are, a folder of the driver (root itself, if that is one)."""
        self.root, self.name = str(root), name
        self._home = None if home is None else str(home)
        self.modules: dict[str, dict[str, str] | str] = {}
        self.profiles: dict[str, SparkProfile] = {}
        self.default_profile: str | None = None
        self.module_profiles: dict[str, str] = {}
        self.mode = "once"
        self.saved_at: str | None = None

    @property
    def home(self) -> Path:
        if self._home is not None:
            return Path(self._home)
        scheme, mark, path = self.root.partition(":")
        if mark and len(scheme) > 1 and scheme != "file":
            raise ValueError(f"{self.root} is no folder of the driver; give the workspace a home for state and code")
        return Path("/" + path.lstrip("/") if mark and scheme == "file" else self.root)

    def publish(self, spark: SparkSession) -> None:
        """The views of all tables that runs have stored here, for a session that has not made them itself."""
        offers = [from_json(json.loads(p.read_text())) for p in sorted(self.home.glob("modules/*/*/loomline.manifest.json"))]
        Storage(spark, self.root).publish_all(sorted(offers, key=lambda d: Version.parse(d.version)))

    # catalogue of modules
    def set_module(self, reference: str, path: str | Path, *, overwrite: bool = False, base: str | Path | None = None) -> None:
        """Where the code of name@version (or of an unversioned name) is. Another path for it is an error unless overwriting."""
        name, version = parse_reference(reference)
        where = str((Path(base or ".") / path).resolve())
        have = self.modules.get(name)
        if version is None:
            if have is not None and have != where and not overwrite:
                raise ValueError(f"{name} is already at {have}")
            self.modules[name] = where
            return
        Version.parse(version)
        versions = dict(have) if isinstance(have, dict) else {}
        if versions.get(version, where) != where and not overwrite:
            raise ValueError(f"{reference} is already at {versions[version]}")
        self.modules[name] = versions | {version: where}

    def set_modules(self, modules: Mapping[str, str | Path], *, overwrite: bool = False, base: str | Path | None = None) -> None:
        """Folders of modules by a template with {version}: each sub-folder that is a version becomes one."""
        for name, template in modules.items():
            head, mark, tail = str(template).partition("{version}")
            if not mark:
                raise ValueError(f"{template!r} has no {{version}}")
            folder = Path(base or ".") / head
            for d in sorted(folder.iterdir()):
                try:
                    Version.parse(d.name)
                except ValueError:
                    continue
                self.set_module(f"{name}@{d.name}", f"{d}{tail}", overwrite=overwrite)

    def load_modules(self, path: str | Path, *, overwrite: bool = False) -> None:
        """Read a catalogue: {"data": [{"version_by": "directory", "modules": {}}]}, {"modules": {}} or {reference: path}; paths are relative to it."""
        spec, base = json.loads(Path(path).read_text()), Path(path).parent
        if "data" in spec:
            for part in spec["data"]:
                if part.get("reference_type", "local") != "local" or part.get("version_by", "directory") != "directory":
                    raise ValueError("only local folders named by version can be listed")
                self.set_modules(part["modules"], overwrite=overwrite, base=base)
            return
        for reference, where in spec.get("modules", spec).items():
            self.set_module(reference, where, overwrite=overwrite, base=base)

    def module_path(self, name: str, version: str | None = None) -> str:
        entry = self.modules.get(name)
        if entry is None:
            raise KeyError(f"no module {name!r}; there are {sorted(self.modules)}")
        if isinstance(entry, str):
            return entry
        if version is None:
            if len(entry) > 1:
                raise KeyError(f"{name} has several versions: {sorted(entry)}")
            return next(iter(entry.values()))
        if version not in entry:
            raise FileNotFoundError(f"{name} has no version {version}; it has {sorted(entry)}")
        return entry[version]

    # profiles and modes
    def set_profile(self, name: str, profile: SparkProfile, *, overwrite: bool = False) -> None:
        profile.validate()
        if self.profiles.get(name, profile) != profile and not overwrite:
            raise ValueError(f"profile {name!r} is already set")
        self.profiles[name] = profile

    def set_default_profile(self, name: str) -> None:
        self.default_profile = self._known(name)

    def set_module_profile(self, module: str, name: str) -> None:
        self.module_profiles[module] = self._known(name)

    def _known(self, name: str) -> str:
        if name not in self.profiles:
            raise KeyError(f"no profile {name!r}; there are {sorted(self.profiles)}")
        return name

    def set_mode(self, mode: str) -> None:
        if mode not in self.MODES:
            raise ValueError(f"a graph runs {' or '.join(self.MODES)}, not {mode!r}")
        self.mode = mode

    def validate(self) -> None:
        if not self.modules:
            warnings.warn("the workspace has no modules", RuntimeWarning, stacklevel=2)
        if self.default_profile is None:
            raise ValueError("set a default profile")
        for p in self.profiles.values():
            p.validate()

    def graph(self, targets: Mapping[str, str], *, name: str | None = None, profiles: Mapping[str, str] | None = None):
        from .graph import Graph

        return Graph(self, targets, name=name, profiles=profiles)

    # JSON
    def to_dict(self) -> dict:
        return {"spec_version": 1, "name": self.name, "root": self.root, "home": self._home, "modules": self.modules, "profiles": {k: asdict(p) for k, p in self.profiles.items()}, "default_profile": self.default_profile, "module_profiles": self.module_profiles, "mode": self.mode}

    @classmethod
    def from_dict(cls, d: dict) -> Workspace:
        w = cls(d["root"], name=d.get("name"), home=d.get("home"))
        w.modules = {k: dict(v) if isinstance(v, dict) else v for k, v in d["modules"].items()}
        w.profiles = {k: SparkProfile(p["kind"], dict(p["conf"])) for k, p in d["profiles"].items()}
        w.default_profile, w.module_profiles = d.get("default_profile"), dict(d.get("module_profiles", {}))
        w.set_mode(d.get("mode", "once"))
        return w

    def save(self, path: str | Path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(self.to_dict(), indent=1))
        self.saved_at = str(Path(path).resolve())

    @classmethod
    def load(cls, path: str | Path, *, spark: SparkSession | None = None) -> Workspace:
        """Read a saved workspace; with a session, the views of its tables are registered there."""
        w = cls.from_dict(json.loads(Path(path).read_text()))
        w.saved_at = str(Path(path).resolve())
        if spark is not None:
            w.publish(spark)
        return w
