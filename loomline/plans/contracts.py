"""What a module offers and how it is made, as one record that goes to JSON and back."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql.types import StructType

#: How a run brings a table's new rows together with the stored ones.
MODES = ("replace", "append", "merge")


class Step(NamedTuple):
    """Tables that are stored together, once what they are made of is."""

    tables: tuple[str, ...]
    note: str | None = None


@dataclass(frozen=True)
class Relation:
    """A table: its columns, whether others may read it, and how it is written."""

    schema: StructType = field(default_factory=StructType)
    public: bool = True
    about: str | None = None
    mode: str = "replace"
    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ()

    def need(self, columns: list[str], reader: str) -> None:
        """Every column by its exact name, or a KeyError with what is missing and what there is."""
        missing = sorted(set(columns) - set(self.schema.names))
        if missing:
            raise KeyError(f"{reader}: no columns {missing}; there are {sorted(self.schema.names)}")


@dataclass(frozen=True)
class Description:
    """A version of a module; as far as others are concerned only offer() counts."""

    module: str
    version: str
    relations: dict[str, Relation]
    reads: dict[str, str] = field(default_factory=dict)
    steps: tuple[Step, ...] = ()
    about: str | None = None

    def names(self, public: bool) -> list[str]:
        return [n for n, r in self.relations.items() if r.public is public]

    def offer(self) -> Description:
        return replace(self, relations={n: self.relations[n] for n in self.names(True)}, reads={}, steps=())

    def __getitem__(self, table: str) -> Relation:
        if table not in self.relations:
            raise KeyError(f"{self.module}@{self.version} has no table {table!r} to read; it has {sorted(self.relations)}")
        return self.relations[table]


def to_json(d: Description) -> dict:
    return vars(d) | {"relations": {n: vars(r) | {"schema": r.schema.jsonValue(), "keys": list(r.keys), "order": list(r.order)} for n, r in d.relations.items()}, "steps": [[list(s.tables), s.note] for s in d.steps]}


def from_json(j: dict) -> Description:
    relations = {n: Relation(**r | {"schema": StructType.fromJson(r["schema"]), "keys": tuple(r["keys"]), "order": tuple(r["order"])}) for n, r in j["relations"].items()}
    return Description(**j | {"relations": relations, "steps": tuple(Step(tuple(t), n) for t, n in j["steps"])})
