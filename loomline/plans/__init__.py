"""Contracts, versions, orders of a graph, and its state."""

from .contracts import Description, Relation, Step, from_json, to_json
from .order import layers, topological
from .state import StateStore
from .version import Version, VersionConflict, VersionMismatch, merge, parse_reference

__all__ = ["Description", "Relation", "StateStore", "Step", "Version", "VersionConflict", "VersionMismatch", "from_json", "layers", "merge", "parse_reference", "to_json", "topological"]
