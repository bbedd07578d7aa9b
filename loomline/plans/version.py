"""Exact three-part versions, references and the merging of requirements."""

from __future__ import annotations

import re
from typing import NamedTuple


class VersionConflict(ValueError):
    """Two requirements that no one version of a module meets."""


class VersionMismatch(ValueError):
    """A module that is of another version than was asked for."""


class Version(NamedTuple):
    major: int
    minor: int
    patch: int

    @classmethod
    def parse(cls, text: str) -> Version:
        m = re.fullmatch(r"(\d+)\.(\d+)\.(\d+)", text or "")
        if not m:
            raise ValueError(f"a version is three numbers like 1.0.0, not {text!r}")
        return cls(*map(int, m.groups()))

    def __str__(self) -> str:
        return f"{self.major}.{self.minor}.{self.patch}"


def parse_reference(text: str) -> tuple[str, str | None]:
    """name@version, or name alone."""
    name, at, version = text.partition("@")
    if not name or (at and not version):
        raise ValueError(f"not a reference: {text!r}")
    return name, version or None


def merge(name: str, wanted: str, have: str | None, *, pinned_have: bool = False, pin: bool = False) -> str:
    """The version that satisfies a further requirement.

    A pin (of a target) must equal what is recorded; a dependency keeps a pin of the same version, conflicts with any
    other pin and with another major, and otherwise raises the version to the higher one.
    """
    new = Version.parse(wanted)
    if have is None:
        return wanted
    old = Version.parse(have)
    if pin and new != old:
        raise VersionConflict(f"the targets ask for {name} in {have} and in {wanted}")
    if pinned_have and new != old:
        raise VersionConflict(f"a module reads {name} in {wanted}, and the target is {have}")
    if new.major != old.major:
        raise VersionConflict(f"{name} is read in {have} and in {wanted}, whose majors differ")
    return str(max(new, old))
